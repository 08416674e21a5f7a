"""One row per key, upserts, set checks, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def insert_absent(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Current rows, and the first new row of each key that is not there yet."""
    return current.unionByName(first_per_key(new, keys, order).join(current.select(*keys), keys, "left_anti"))


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows replace current ones of their key."""
    return new.unionByName(current.join(new.select(*keys).distinct(), keys, "left_anti")) if not order else first_per_key(current.unionByName(new), keys, order)


def append_widened(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of unknown keys appended; columns of either side are kept."""
    return current.unionByName(new.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def first_in_order(df: DataFrame, order: list[Column | str], n: int | None) -> DataFrame:
    """The first n rows in the given order; all of them where n is None."""
    return df.orderBy(*order) if n is None else df.orderBy(*order).limit(n)


def known_in_order(wanted: DataFrame, known: DataFrame, key: str, order: list[Column | str], n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(present, missing): wanted rows whose key is known, the first n of them in order, and those whose key is not."""
    ids = known.select(key).distinct()
    return first_in_order(wanted.join(ids, key, "left_semi"), order, n), wanted.join(ids, key, "left_anti")


def coverage(assigned: DataFrame, unassigned: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(violation, key): ids assigned and unassigned at once, missing from both, or unknown."""
    a, u, k = (x.select(key).distinct() for x in (assigned, unassigned, known))
    tag = lambda df, name: df.select(F.lit(name).alias("violation"), key)
    both = a.unionByName(u).distinct()
    return tag(a.intersect(u), "both").unionByName(tag(k.join(both, key, "left_anti"), "missing")).unionByName(tag(both.join(k, key, "left_anti"), "unknown"))


def rank_all(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds a 1-based unique rank over all rows in the given order: ranges first, rows within a range then.

    No task sees more than a range; the ranges' sizes, one row each, are summed up and broadcast.
    The rows are stored in between, so that both readings see the same ranges.
    """
    order = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    ranges = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    held = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__held"))
    before = held.select("__part", (F.sum("__held").over(Window.orderBy("__part")) - F.col("__held")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranges.withColumn("__rn", within).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__rn")).drop("__part", "__rn", "__before")


def chunk_of(rank: Column, size: int) -> Column:
    """1-based chunk of a 1-based rank."""
    return (F.floor((rank - 1) / size) + 1).cast("int")


def cap_children(df: DataFrame, parent: str, order: list[Column], width: int) -> DataFrame:
    """At most so many children of each parent."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("__rn") <= width).drop("__rn")


def page(df: DataFrame, order: list[Column], number: int, size: int = 50, total: int | None = None) -> DataFrame:
    """One page of an ordered result; pages start at 1. With a ``total`` of rows, a number past the last page gives the last."""
    if total is not None:
        number = min(number, max(1, -(-total // size)))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)
