"""Training-data operators: deduplication, joins on similarity, decontamination, scans, scoring and
mixing. Nothing outside this folder (besides ``corpus_pipeline.py`` and the guarded lines of
``__spark_entry__.py``) imports it."""
