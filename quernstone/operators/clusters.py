"""Nested cluster files: flattening, batches, merging, global ids, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.rows import rank_all


def nest(index: DataFrame) -> DataFrame:
    """(course_code, clusters array<struct<cluster_id, num_posts, post_ids>>): the shape of a cluster file."""
    per = index.where("course_code IS NOT NULL AND cluster_id IS NOT NULL").groupBy("course_code", "cluster_id").agg(F.array_sort(F.collect_set("post_id")).alias("post_ids"))
    return per.groupBy("course_code").agg(F.array_sort(F.collect_list(F.struct("cluster_id", F.size("post_ids").alias("num_posts"), "post_ids"))).alias("clusters"))


def flatten(nested: DataFrame) -> DataFrame:
    return nested.select("course_code", F.explode("clusters").alias("c")).select("course_code", F.col("c.cluster_id").alias("cluster_id"), F.col("c.num_posts").alias("num_posts"), F.col("c.post_ids").alias("post_ids"))


def batches(clusters: DataFrame, order: list, size: int = 60) -> DataFrame:
    """0-based batch of every cluster in the given order."""
    return rank_all(clusters, *order, name="__rank").withColumn("batch", F.floor((F.col("__rank") - 1) / size).cast("int")).drop("__rank")


def merge(groups: DataFrame, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Batch groups (batch, *keys, description, members) merged by their keys: members joined, first description."""
    return groups.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"), F.min_by("description", "batch").alias("description"))


def global_ids(df: DataFrame, total: str, label: str) -> DataFrame:
    """G001, G002, … by total, then label, over one row per issue."""
    return rank_all(df, F.desc(total), F.asc(label), name="__rank").withColumn("global_id", F.format_string("G%03d", "__rank")).drop("__rank")


def violations(clusters: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, course_code, cluster_id): broken rules of flattened clusters (course_code, cluster_id, num_posts, post_ids)."""
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "course_code", "cluster_id")
    prefix = clusters.where(~F.startswith("cluster_id", F.concat("course_code", F.lit("_"))))
    count = clusters.where(F.col("num_posts") != F.size("post_ids"))
    members = clusters.select("course_code", "cluster_id", F.explode("post_ids").alias("post_id"))
    unknown = members.join(known.select("post_id").distinct(), "post_id", "left_anti").select("course_code", "cluster_id").distinct()
    repeated = clusters.groupBy("cluster_id").agg(F.min("course_code").alias("course_code"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rule(prefix, "prefix").unionByName(rule(count, "count")).unionByName(rule(unknown, "unknown_post")).unionByName(rule(repeated, "duplicate"))


def out_of_order(ranked: DataFrame, value: str, rank: str) -> DataFrame:
    """Rows whose value exceeds the one ranked before them; ranks follow each other without gaps."""
    before = ranked.select((F.col(rank) + 1).alias(rank), F.col(value).alias("before"))
    return ranked.join(before, rank).where(F.col("before") < F.col(value))


#: What a global issue carries; what a file lacks is null.
ISSUE_FIELDS = {"global_cluster_id": "string", "normalized_issue_label": "string", "provisional_label": "string", "short_description": "string", "total_num_posts": "bigint", "num_clusters": "bigint", "num_courses": "bigint"}


def flatten_issues(nested: DataFrame, column: str = "global_clusters") -> DataFrame:
    """One row of ISSUE_FIELDS for each issue of nested files; fields that the files lack are null."""
    one = nested.select(F.explode(column).alias("g"))
    known = one.schema["g"].dataType.fieldNames()
    return one.select(*[(F.col(f"g.{n}") if n in known else F.lit(None)).cast(kind).alias(n) for n, kind in ISSUE_FIELDS.items()])


def check_files(files: DataFrame, known: DataFrame, courses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(violations, totals, skipped) of cluster files (course_code, total_posts, clusters array<struct<cluster_id, course_code, issue_summary, num_posts, post_ids>>).

    violations (rule, course_code, cluster_id): no cluster list, a cluster of another course, an id without the
    course's prefix, a blank summary, a number of posts other than listed, unknown posts, an id used twice. A post in
    several clusters is allowed. totals (course_code, stated, total): files whose stated total is not the number of
    distinct posts, with that number. skipped: files of courses that are not known, which are not checked.
    """
    own = files.join(courses.select("course_code").distinct(), "course_code", "left_semi")
    skipped = files.join(courses.select("course_code").distinct(), "course_code", "left_anti").select("course_code")
    shape = own.where("clusters IS NULL").select(F.lit("shape").alias("rule"), "course_code", F.lit(None).cast("string").alias("cluster_id"))
    flat = own.select("course_code", F.explode("clusters").alias("c")).select("course_code", F.col("c.cluster_id").alias("cluster_id"), F.col("c.course_code").alias("own"), F.col("c.issue_summary").alias("summary"), F.col("c.num_posts").alias("num_posts"), F.col("c.post_ids").alias("post_ids"))
    rule = lambda df, name: df.select(F.lit(name).alias("rule"), "course_code", "cluster_id")
    other = rule(flat.where(~F.col("own").eqNullSafe(F.col("course_code"))), "course")
    blank = rule(flat.where(F.trim(F.coalesce("summary", F.lit(""))) == ""), "summary")
    distinct = own.select("course_code", F.explode("clusters").alias("c")).select("course_code", F.explode("c.post_ids").alias("p")).groupBy("course_code").agg(F.countDistinct("p").alias("total"))
    totals = own.select("course_code", F.col("total_posts").alias("stated")).join(distinct, "course_code", "left").withColumn("total", F.coalesce("total", F.lit(0))).where(~F.col("stated").eqNullSafe(F.col("total")))
    return shape.unionByName(other).unionByName(blank).unionByName(violations(flat.select("course_code", "cluster_id", "num_posts", "post_ids"), known)), totals, skipped
