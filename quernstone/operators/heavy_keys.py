"""Per-key results when a few keys hold most of the rows.

Heavy keys are found with a mergeable frequent-items sketch (one pass, partial
aggregation, bounded state).  Rows of heavy keys are picked with a broadcast join
against that bounded list and aggregated in two salted steps; all other rows take the
ordinary shuffle on the key; both results are unioned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the sketch: its error is at most 3.5 / SLOTS of all rows.
SLOTS = 4096
SALTS = 32


@dataclass(frozen=True)
class HeavyKeys:
    """total: all rows of the table. keys: heavy candidates, never more than 2 / share."""

    total: int
    keys: list


def find_heavy(df: DataFrame, key: Column, share: float) -> HeavyKeys:
    """Candidates for keys holding at least ``share`` of all rows (null keys count in the total only).

    No false negatives while ``share`` exceeds twice the sketch's error; the list is
    bounded by ``2 / share`` whatever the table's size, so it may be sent to the driver.
    """
    if share < 7 / SLOTS:
        raise ValueError(f"share must be at least {7 / SLOTS:.5f} for {SLOTS} slots")
    most = int(2 / share)
    row = df.select(key.cast("string").alias("__key")).agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(__key, {most}, {SLOTS})").alias("top")).first()
    floor = 0.5 * share * row["total"]
    return HeavyKeys(row["total"], [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] >= floor])


def _two_step(df: DataFrame, key: str, distinct: dict[str, str], salts: int) -> DataFrame:
    """Counts of heavy keys: each distinct value has one salt, so salted counts add up."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))  # counted within each task first
    for name, column in distinct.items():
        part = (
            df.where(F.col(column).isNotNull())
            .groupBy(key, column)
            .agg(F.lit(1).alias("__one"))
            .groupBy(key, F.pmod(F.xxhash64(column), F.lit(salts)).alias("__salt"))
            .agg(F.count(F.lit(1)).alias(name))
            .groupBy(key)
            .agg(F.sum(name).alias(name))
        )
        out = out.join(F.broadcast(part), key, "left")  # at most one row for each heavy key
    return out.select(key, "n_rows", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in distinct])


def counts_per_key(df: DataFrame, key: str, distinct: dict[str, str], heavy_share: float = 0.01, salts: int = SALTS, heavy: HeavyKeys | None = None) -> DataFrame:
    """Rows and distinct values for each key, without one key's work dominating.

    df: any table; rows whose ``key`` is null belong to no key. distinct: result column
    -> column whose distinct non-null values are counted. Returns (key, n_rows,
    *distinct), one row per key; an empty table gives no rows. Repeated rows count each
    time in ``n_rows`` and once in the distinct counts. Other columns are ignored, so
    their names cannot clash.
    """
    columns = list(dict.fromkeys([key, *distinct.values()]))
    df = df.select(*columns)
    heavy = heavy or find_heavy(df, F.col(key), heavy_share)
    keyed = df.where(F.col(key).isNotNull())
    spark = df.sparkSession
    hot = F.broadcast(spark.createDataFrame([(k,) for k in heavy.keys], f"{key} string"))
    rest = keyed.join(hot, key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(c).alias(n) for n, c in distinct.items()])
    if not heavy.keys:
        return rest
    return _two_step(keyed.join(hot, key, "left_semi"), key, distinct, salts).unionByName(rest)


def heavy_keys(df: DataFrame, key: str, distinct: dict[str, str], share: float) -> DataFrame:
    """Exactly the keys with at least ``share`` of all rows of ``df``, with their counts.

    The sketch proposes, the salted counts decide. Ties at the threshold are kept.
    """
    heavy = find_heavy(df, F.col(key), share)
    picked = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in heavy.keys], f"{key} string"))
    hot = df.select(*dict.fromkeys([key, *distinct.values()])).join(picked, key, "left_semi")
    return _two_step(hot, key, distinct, SALTS).where(F.col("n_rows") >= F.lit(share * heavy.total))
