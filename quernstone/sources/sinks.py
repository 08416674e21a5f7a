"""Writers: JSON lines, CSV, chunks, archives, snapshots, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.rows import chunk_of, rank_all
from quernstone.sources import storage


def write_jsonl(df: DataFrame, path: str, append: bool = False, refuse: bool = False) -> int:
    """Writes JSON lines (null fields kept) and returns the number of rows. refuse: raise when the path exists."""
    mode = "append" if append else "errorifexists" if refuse else "overwrite"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def write_csv(df: DataFrame, path: str, columns: list[str], formats: dict[str, str] | None = None) -> None:
    """CSV with exactly these columns; missing ones and nulls are empty. formats: column -> as ``%.2f``."""
    shown = lambda c: F.format_string(formats[c], F.col(c).cast("double")) if c in (formats or {}) else F.col(c).cast("string")
    out = df.select([F.when(F.col(c).isNotNull(), shown(c)).otherwise(F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_chunks(df: DataFrame, group: str, path: str, size: int = 5) -> None:
    """Folders of so many groups each, in the order of the group's key.

    Ranks are global, so only the distinct groups are ranked, range by range.
    """
    groups = rank_all(df.select(group).distinct(), group).select(group, chunk_of(F.col("rank"), size).alias("chunk"))
    df.join(groups, group).write.mode("overwrite").partitionBy("chunk").json(path)


def write_archive(df: DataFrame, group: str, path: str) -> None:
    """One folder of JSON for each group, spread so a large group has several files."""
    df.write.mode("overwrite").partitionBy(group).json(path)


def append_snapshot(df: DataFrame, path: str, stamp: float) -> None:
    df.withColumn("captured_at", F.lit(stamp).cast("double")).write.mode("append").parquet(path)


def copy_tables(spark, names: list[str], source: str, target: str) -> list[str]:
    """Copies the kept tables that exist; refuses to overwrite."""
    kept = [n for n in names if storage.exists(spark, f"{source}/{n}.parquet")]
    for n in kept:
        spark.read.parquet(f"{source}/{n}.parquet").write.mode("errorifexists").parquet(f"{target}/{n}.parquet")
    return kept


def write_manifest(path: str, counts: DataFrame, began: float | None = None, files: DataFrame | None = None, **more) -> dict:
    """A JSON file of one aggregated row and further values; with ``began`` the seconds since, with ``files``
    (path, sha256, length) their digests."""
    import time

    row = counts.first().asDict() | more
    if began is not None:
        row |= {"started_at": began, "elapsed_sec": time.time() - began}
    if files is not None:
        row["files"] = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in files.select("path", "sha256").toLocalIterator()}
    storage.write_text(counts.sparkSession, path, json.dumps(row, ensure_ascii=False, sort_keys=True, default=str))
    return row


def is_locked(spark: SparkSession, path: str) -> bool:
    """Whether a manifest forbids a rebuild."""
    return storage.exists(spark, path) and json.loads(storage.read_text(spark, path)).get("status") == "locked"


def write_labels(labels: DataFrame, path: str, columns: list[str]) -> None:
    """Labels rewritten as a whole, DEV before TEST, then by course and post, with exactly these columns."""
    order = [F.when(F.upper(F.trim("split")) == "DEV", 0).otherwise(1), F.col("course_code"), F.col("post_id")]
    write_csv(labels.orderBy(*order), path, columns)


def refresh_dimension(new: DataFrame, path: str, key: str, snapshots: str, stamp: float) -> None:
    """Replaces known rows of a dimension and adds new ones; every refresh is appended to the snapshots too."""
    from quernstone.operators.rows import upsert
    from quernstone.session import stored

    spark = new.sparkSession
    merged = upsert(spark.read.parquet(path), new, [key], []) if storage.exists(spark, path) else new
    stored(merged, "dimension").write.mode("overwrite").parquet(path)  # it can't be read and replaced at once
    append_snapshot(new, snapshots, stamp)


def overview(totals: DataFrame, title: str) -> str:
    """Markdown of a one-row table of totals."""
    row = totals.first().asDict()
    return "\n".join([f"# {title}", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in row.items()], ""])
