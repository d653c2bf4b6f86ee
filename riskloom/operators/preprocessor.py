"""The fitted preparation of model data as a pipeline stage.

``ModelPreprocessor`` learns, from training rows alone, the medians, the rare values and the category codes;
``ModelPreprocessorModel`` applies them to any rows. Both are stages of ``pyspark.ml``: the model is written with
its tables as Parquet beside its parameters, and read back by itself or inside a ``PipelineModel``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import cleaning, profiling
from riskloom.sources import tables


class _Columns(Params):
    target = Param(Params._dummy(), "target", "label column, passed through where there is one", TypeConverters.toString)
    idColumn = Param(Params._dummy(), "idColumn", "unique row key", TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "columns passed through in front", TypeConverters.toListString)
    rareThreshold = Param(Params._dummy(), "rareThreshold", "share below which a training value is rare", TypeConverters.toFloat)
    numeric = Param(Params._dummy(), "numeric", "numeric features", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical features", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(target="isFraud", idColumn="TransactionID", keep=[], rareThreshold=0.005, numeric=[], categorical=[])

    def _get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class ModelPreprocessor(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fit on training rows: every column but the target, the key and those kept is a feature, numeric by its type."""

    @keyword_only
    def __init__(self, *, target: str = "isFraud", idColumn: str = "TransactionID", keep: list | None = None, rareThreshold: float = 0.005):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "ModelPreprocessorModel":
        rest = [c for c in dataset.columns if c not in (self._get("target"), self._get("idColumn"), *self._get("keep"))]
        numeric = profiling.numeric_columns(dataset.select(*rest).schema)
        categorical = [c for c in rest if c not in numeric]
        train = tables.materialised(dataset, "preprocessor-train")
        if categorical:
            shares = tables.materialised(cleaning.value_shares(train, categorical), "shares")
        else:
            shares = train.sparkSession.createDataFrame([], "column_name string, value string, n long, share double")
        rare = shares.where(F.col("share") < self._get("rareThreshold")).select("column_name", "value", "share")
        frequent = cleaning.frequent_values(shares, self._get("rareThreshold"))
        medians = cleaning.median_values(train, numeric)
        model = ModelPreprocessorModel(medians, rare, frequent, None)
        model._set(**{p.name: self.getOrDefault(p) for p in self.params} | {"numeric": numeric, "categorical": categorical})
        if categorical:
            model.codes = cleaning.fit_code_table(model.filled(train), categorical)
        return model


class ModelPreprocessorModel(Model, _Columns, MLReadable, MLWritable):
    """What was learnt: ``medians`` by column, the table of ``rare`` values, the ``frequent`` values by column (at most
    1 / threshold each) and the table of ``codes``."""

    def __init__(self, medians: dict | None = None, rare: DataFrame | None = None, frequent: dict | None = None, codes: DataFrame | None = None):
        super().__init__()
        self.medians, self.rare, self.frequent, self.codes = medians or {}, rare, frequent or {}, codes

    def filled(self, df: DataFrame) -> DataFrame:
        """Rare values reduced, nulls filled."""
        categorical = self._get("categorical")
        if categorical:
            df = cleaning.apply_rare(df, self.rare, categorical, key=self._get("idColumn"), frequent=self.frequent)
        return cleaning.impute_constant(cleaning.apply_medians(df, self.medians), categorical)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numeric, categorical, target = self._get("numeric"), self._get("categorical"), self._get("target")
        tables.require_columns(dataset, [*numeric, *categorical, self._get("idColumn")], "rows to prepare")
        out = self.filled(dataset)
        if categorical:
            out = cleaning.apply_codes(out, self.codes, categorical, key=self._get("idColumn"))
        if target not in out.columns:                                   # rows to score carry no label
            out = out.withColumn(target, F.lit(None).cast("byte"))
            return cleaning.model_ready(out, numeric, categorical, target, keep=self._get("keep")).drop(target)
        return cleaning.model_ready(out, numeric, categorical, target, keep=self._get("keep"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ModelPreprocessorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(model, path, spark)
        medians = spark.createDataFrame(sorted(model.medians.items()), "column_name string, median double")
        frequent = spark.createDataFrame(sorted(model.frequent.items()), "column_name string, vals array<string>")
        codes = model.codes if model.codes is not None else spark.createDataFrame([], "column_name string, value string, code int")
        for name, table in (("medians", medians), ("frequent", frequent), ("rare", model.rare), ("codes", codes)):
            table.write.mode("overwrite").parquet(f"{path}/{name}")


class _Reader(MLReader):
    def load(self, path: str) -> ModelPreprocessorModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        read = lambda name: spark.read.parquet(f"{path}/{name}")      # noqa: E731
        model = ModelPreprocessorModel({r["column_name"]: r["median"] for r in read("medians").collect()}, read("rare"),
                                       {r["column_name"]: list(r["vals"]) for r in read("frequent").collect()}, read("codes"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def write_model_data(cleaned: DataFrame, root: str, prefix: str, target: str = "isFraud", id_column: str = "TransactionID", size: float = 0.2,
                     rare_threshold: float = 0.005, seed: int = 42, source_path: str = "") -> dict[str, str]:
    """The model-data stage with its outputs: split, fit on the training part, and write ``<prefix>_train``,
    ``<prefix>_validation``, the fitted preprocessor (a ``PipelineModel`` of one stage) and the report. Returns their paths."""
    from pyspark.ml import Pipeline

    from riskloom.operators.sampling import stratified_split
    split = tables.materialised(stratified_split(cleaned, target, size, seed, key=id_column), "split")
    part = lambda name: split.where(F.col("split") == name).drop("split")       # noqa: E731
    fitted = Pipeline(stages=[ModelPreprocessor(target=target, idColumn=id_column, rareThreshold=rare_threshold)]).fit(part("train"))
    paths = {k: f"{root.rstrip('/')}/{prefix}_{k}" for k in ("train", "validation", "preprocessor", "report")}
    for name in ("train", "validation"):
        tables.write_table(fitted.transform(part(name)), paths[name])
    fitted.write().overwrite().save(paths["preprocessor"])
    stage = fitted.stages[0]
    spark = cleaned.sparkSession
    ready = (spark.read.parquet(paths["train"]).withColumn("split", F.lit("train"))
             .unionByName(spark.read.parquet(paths["validation"]).withColumn("split", F.lit("validation"))))
    report = profiling.preparation_report(spark, ready, stage._get("numeric"), stage._get("categorical"), target, stage.rare, source_path)
    tables.write_profile(report, paths["report"])
    return paths


def load_preprocessor(spark: SparkSession, path: str):
    """The written preprocessor, ready to transform raw rows."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
