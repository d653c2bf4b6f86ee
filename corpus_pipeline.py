"""Corpus preparation: filter, deduplicate, decontaminate and mix the documents, stage by stage.

Each stage takes what its predecessor kept; all but the last return the columns of ``documents``.
Rows without an identifier or text pass through the filters by each operator's rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.decontamination import decontaminate
from riskloom.llm.line_dedup import EXACT_WORDS, line_dedup
from riskloom.llm.mixing import mix_sources
from riskloom.llm.ngram_join import ngram_join
from riskloom.llm.registry import saved, table
from riskloom.llm.toxicity import fit_toxicity, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose toxicity score is above the threshold that 3 % of the ordinary calibration texts reach
    (``toxicity.FALSE_SHARE``)."""
    score = "_toxicity_" + "_".join(docs.columns)[:60]              # no column of the input has that name
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity(docs, model, score=score)
    return scored.where(F.col(score) <= F.lit(model.threshold)).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats up to one word go, those of fewer than five words where they are
    equal; ``n_chars`` follows the text."""
    return line_dedup(docs, exact_words=EXACT_WORDS).drop("lines_removed").withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard similarity the one with the smallest identifier stays
    (rows that share that identifier all stay); documents without words or identifier stay."""
    gone = saved(ngram_join(docs).where("component_id < doc_id").select("doc_id").distinct(), "pipeline-near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mixture: documents taken, by epoch, with the words taken of each."""
    return mix_sources(docs, with_text=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
ORACLE_SQL = None       # scores, edits and tilings are no SQL; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
