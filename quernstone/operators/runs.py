"""Runs of a predictor: choice, union, pairing, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import storage

_TEXTS = ("course_code", "root_cause_summary_pred", "pain_point_snippet_pred", "confidence_pred")
_FLAGS = ("parse_error", "schema_error", "used_fallback", "llm_failure")


def run_folders(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Folders that the patterns match, each once, in the order they are first met."""
    return list(dict.fromkeys(p for pattern in patterns for p in storage.matches(spark, pattern)))


def pick_runs(index: DataFrame, split: str | None = None, models: list[str] | None = None, prompts: list[str] | None = None) -> DataFrame:
    """Rows of a run index by split, model and prompt; a prompt matches its name or its file. None: any."""
    out = index
    if split is not None:
        out = out.where(F.lower(F.trim("split")) == split.strip().lower())
    if models:
        out = out.where(F.col("model").isin(models))
    if prompts:
        out = out.where(F.col("prompt").isin(prompts) | F.col("prompt_file").isin(prompts))
    return out


def normalised(predictions: DataFrame, keys: tuple[str, ...] = ("post_id",)) -> DataFrame:
    """The keys, labels trimmed and lower-cased, absent or null texts empty, absent flags false."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in predictions.columns else F.lit("")
    flag = lambda c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("false")) == "true" if c in predictions.columns else F.lit(False)
    labels = [F.lower(F.trim(text(c))).alias(c) for c in ("true_contains_painpoint", "pred_contains_painpoint")]
    return predictions.select(*keys, *labels, *[text(c).alias(c) for c in _TEXTS], *[flag(c).alias(c) for c in _FLAGS])


def read_runs(spark: SparkSession, folders: list[str], file: str = "predictions.csv") -> DataFrame:
    """All rows of all runs' prediction files, normalised, with the folder's name as run_dir; one scan reads them all."""
    missing = [f for f in folders if not storage.exists(spark, f"{f}/{file}")]
    if missing or not folders:
        raise FileNotFoundError(", ".join(missing) or "no runs")
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv([f"{f}/{file}" for f in folders])
    named = raw.drop("run_dir").withColumn("run_dir", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return normalised(named, ("run_dir", "post_id"))


def union_runs(runs: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of all runs with their run id; columns that a run lacks are null."""
    out = None
    for name, df in runs:
        part = df.withColumn("run_id", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def outcome(gold: Column, pred: Column) -> Column:
    """TP, FN, FP or TN; IGNORE where the gold label is neither y nor n. An undecided prediction is not positive."""
    g, p = F.lower(F.coalesce(gold, F.lit(""))), F.lower(F.coalesce(pred, F.lit("")))
    return F.when(~g.isin("y", "n"), "IGNORE").when(g == "y", F.when(p == "y", "TP").otherwise("FN")).otherwise(F.when(p == "y", "FP").otherwise("TN"))


def eligible_labels(gold: DataFrame, split: str) -> DataFrame:
    """(post_id, split, gold): labels y or n of one split with an id."""
    t = gold.select(F.trim("post_id").alias("post_id"), F.upper(F.trim("split")).alias("split"), F.lower(F.trim("contains_painpoint")).alias("gold"))
    return t.where((F.col("split") == split.strip().upper()) & F.col("gold").isin("y", "n") & (F.coalesce("post_id", F.lit("")) != ""))


def rows_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, rows): a map entry of each key, its rows as an ordered array; for keys with few rows each, as posts have runs."""
    listed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (key, *order)])))
    return df.groupBy(key).agg(listed.alias("rows"))


def held_to_invariants(predictions: DataFrame, version: str) -> DataFrame:
    """Rows with any error flag are undecided, a confidence outside 0..1 is 0, a missing version is the given one."""
    wrong = F.coalesce("parse_error", F.lit(False)) | F.coalesce("schema_error", F.lit(False)) | F.coalesce("llm_failure", F.lit(False))
    c = F.col("confidence")
    version_now = F.coalesce("schema_version", F.lit(version)) if "schema_version" in predictions.columns else F.lit(version)
    return predictions.withColumn("label", F.when(wrong, "u").otherwise(F.col("label"))).withColumn("confidence", F.when(c.between(0, 1), c).otherwise(0.0)).withColumn("schema_version", version_now)
