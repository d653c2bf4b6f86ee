"""Preparation workflows (E9, G12, and the model-data stage E4-E7)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import cleaning, payments, prep, profiling, sampling
from riskloom.session import checkpoint_dir
from riskloom.sources import tables

# Workflow presets (names, sample sizes, role sentences, threshold, seed) of the reference.
IEEE_FULL = {"name": "ieee_cis_full_train", "sample_size": 0,
             "role": "core knowledge base for model training and feature engineering"}
IEEE_SAMPLE = {"name": "ieee_cis_dev_sample", "sample_size": 10000,
               "role": "fast end-to-end pipeline development and debugging"}
PAYSIM = {"name": "paysim_graph", "sample_size": 50000,
          "role": "graph-based fraud detection and relationship analysis"}
MISSING_THRESHOLD = 0.85
RARE_THRESHOLD = 0.005
VALIDATION_SIZE = 0.2
SEED = 42


@dataclass
class Prepared:
    frame: DataFrame
    raw_profile: DataFrame
    cleaned_profile: DataFrame
    dropped: list[str] = field(default_factory=list)


def prepare_transactions(transactions: DataFrame, identity: DataFrame, preset: dict = IEEE_FULL,
                         sample_size: int | None = None, threshold: float = MISSING_THRESHOLD,
                         seed: int = SEED, prototype: bool = False, narrow: bool = True) -> Prepared:
    """Sample (B1) -> left join (F1) -> narrow (D17) -> raw profile (C2) -> features
    -> clean (E8) -> cleaned profile (C2 + C4). The full preset keeps every row; the sample preset
    reads 0 or None as its default size."""
    tables.require_columns(transactions, ["TransactionID"], "transactions")
    tables.require_columns(identity, ["TransactionID"], "identity")
    n = 0 if preset["sample_size"] == 0 else (sample_size or preset["sample_size"])
    sampled = sampling.sample_n(transactions, n or None, seed, key="TransactionID")
    merged = tables.materialised(prep.left_enrich(sampled, identity), "merged")     # every decision below reads this
    if narrow:
        merged = prep.narrow_types(merged)
    raw = profiling.dataset_profile(merged, "isFraud", preset["name"], preset["role"]) \
        .withColumn("sample_size", F.lit(int(n or 0)))
    enriched = tables.materialised(prep.add_ieee_features(merged, prototype=prototype), "enriched")
    cleaned, dropped = cleaning.clean_transactions(enriched, threshold, narrow=narrow)
    prof = profiling.dataset_profile(cleaned, "isFraud", preset["name"], preset["role"])
    prof = profiling.cleaning_report(prof, n or 0, threshold, dropped)
    return Prepared(cleaned, raw, prof, dropped)


@dataclass
class PaymentGraph:
    prepared: DataFrame
    edges: DataFrame
    nodes: DataFrame
    profile: DataFrame


def prepare_payments(payments_df: DataFrame, sample_size: int | None = None, seed: int = SEED,
                     key: str = "_row_key", narrow: bool = True) -> PaymentGraph:
    """Sample (B1, sorted by step at the sink) -> D11-D16 -> D17 -> G1, G2 -> C6.
    0 or None means the preset size; the preset always samples, by the seeded hash of a key column,
    and a table without that column is an error."""
    n = sample_size or PAYSIM["sample_size"]
    tables.require_columns(payments_df, [key], "payments")
    base = sampling.sample_n(payments_df, n, seed, key=key)
    prepared = prep.payment_features(base)
    if narrow:
        prepared = prep.narrow_types(prepared)
    edges = payments.payment_edges(prepared)
    nodes = payments.payment_nodes(prepared)
    if narrow:
        edges, nodes = prep.narrow_types(edges), prep.narrow_types(nodes)
    prof = profiling.dataset_profile(prepared, "isFraud", PAYSIM["name"], PAYSIM["role"]) \
        .withColumn("sample_size", F.lit(int(n or 0)))
    prof = profiling.graph_profile(prof, nodes, edges)
    return PaymentGraph(prepared, edges, nodes, prof)


@dataclass
class ModelData:
    frame: DataFrame            # model-ready rows with a ``split`` column
    numeric: list[str]
    categorical: list[str]
    rare_map: DataFrame
    codes: DataFrame
    medians: dict
    report: DataFrame


def prepare_model_data(cleaned: DataFrame, target: str = "isFraud", id_column: str = "TransactionID",
                       size: float = VALIDATION_SIZE, rare_threshold: float = RARE_THRESHOLD,
                       seed: int = SEED, keep_id: bool = False) -> ModelData:
    """B2 -> E4 -> E5 -> E3 -> E6 -> E7 and the preparation report."""
    checkpoint_dir(cleaned.sparkSession)
    cleaned = tables.materialised(cleaned, "cleaned")
    # cut lineage once the split is fixed: the fits below each run an action over it
    split = sampling.stratified_split(cleaned, target, size, seed, key=id_column).checkpoint()
    features = [c for c in cleaned.columns if c not in (target, id_column)]
    numeric = [c for c in profiling.numeric_columns(cleaned.select(*features).schema)]
    categorical = [c for c in features if c not in numeric]
    train = split.where(F.col("split") == "train")
    if categorical:
        shares = tables.materialised(cleaning.value_shares(train, categorical), "shares")
        rare_map = shares.where(F.col("share") < rare_threshold).select("column_name", "value", "share")
        split = cleaning.apply_rare(split, rare_map, categorical, key=id_column,
                                    frequent=cleaning.frequent_values(shares, rare_threshold))
        train = split.where(F.col("split") == "train")
    else:
        rare_map = train.sparkSession.createDataFrame([], "column_name string, value string, share double")
    medians = cleaning.median_values(train, numeric)
    split = cleaning.apply_medians(split, medians)
    split = cleaning.impute_constant(split, categorical).checkpoint()
    train = split.where(F.col("split") == "train")
    codes = cleaning.fit_code_table(train, categorical) if categorical else None
    if categorical:
        split = cleaning.apply_codes(split, codes, categorical, key=id_column)
    keep = ([id_column] if keep_id else []) + ["split"]
    ready = cleaning.model_ready(split, numeric, categorical, target, keep=keep)
    report = profiling.preparation_report(cleaned.sparkSession, ready, numeric, categorical, target, rare_map)
    return ModelData(ready, numeric, categorical, rare_map, codes, medians, report)


def write_transaction_outputs(prepared: Prepared, root: str, name: str = IEEE_FULL["name"],
                              dataset: str = "ieee_cis") -> dict[str, str]:
    """A2-A4 for E9: processed table and raw / cleaned profiles in the dataset's folders."""
    lay = tables.dataset_layout(root, dataset)
    tables.write_table(sampling.sort_by_key(prepared.frame, "TransactionID"), f"{lay['processed']}/{name}_processed")
    tables.write_profile(prepared.raw_profile, f"{lay['profiles']}/{name}_raw_profile")
    tables.write_profile(prepared.cleaned_profile, f"{lay['profiles']}/{name}_cleaned_profile")
    return lay


def write_payment_outputs(g: PaymentGraph, root: str, dataset: str = "paysim") -> dict[str, str]:
    """A2-A4 for G12: processed transactions, edge and node tables, profile."""
    lay = tables.dataset_layout(root, dataset)
    tables.write_table(sampling.sort_by_key(g.prepared, "step"), f"{lay['processed']}/{PAYSIM['name']}_transactions_processed")
    tables.write_table(sampling.sort_by_key(g.edges, "source", "target"), f"{lay['graph']}/{PAYSIM['name']}_edges")
    tables.write_table(sampling.sort_by_key(g.nodes, "node_id"), f"{lay['graph']}/{PAYSIM['name']}_nodes")
    tables.write_profile(g.profile, f"{lay['profiles']}/{PAYSIM['name']}_profile")
    return lay
