"""Reporting: joins of posts, pain points, clusters and courses, and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import preview, split_multi


def post_master(posts: DataFrame, pains: DataFrame, index: DataFrame, courses: DataFrame) -> DataFrame:
    """One row for each post and cluster: posts left-joined with pain points, index and courses."""
    return (
        posts.select("post_id", "course_code")
        .join(pains.select("post_id", F.lit(1).alias("is_pain_point"), "root_cause_summary"), "post_id", "left")
        .join(index.select("post_id", "cluster_id", "global_cluster_id", F.col("course_title").alias("index_title")), "post_id", "left")
        .join(courses.select(F.col("coursecode").alias("course_code"), "title", "colleges"), "course_code", "left")
        .select("post_id", "course_code", F.coalesce("is_pain_point", F.lit(0)).alias("is_pain_point"), "cluster_id", "global_cluster_id", F.coalesce("title", "index_title").alias("course_title"), "colleges")
    )


def collapse(master: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per post: joined distinct ids, greatest flag, and the heaviest global id."""
    weighed = master.join(weights, "global_cluster_id", "left")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    order = F.when(F.col("global_cluster_id").isNotNull(), F.struct(-F.coalesce("weight", F.lit(0)), F.col("global_cluster_id")))
    return weighed.groupBy("post_id").agg(
        F.min("course_code").alias("course_code"), joined("cluster_id").alias("cluster_ids"), joined("global_cluster_id").alias("global_ids"), F.max("is_pain_point").alias("is_pain_point"), F.coalesce(F.min_by("global_cluster_id", order), F.lit("")).alias("main_issue")
    )


def top_labels(df: DataFrame, group: str, label: str, counted: str, n: int = 3) -> DataFrame:
    """(group, top): the n labels with most distinct values of ``counted``, ties by label."""
    per = df.where(F.col(label).isNotNull() & F.col(group).isNotNull()).groupBy(group, label).agg(F.countDistinct(counted).alias("n"))
    ranked = per.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc(label)))).where(F.col("rn") <= n)
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", label))), lambda x: x[label]), ", ").alias("top"))


def course_summary(master: DataFrame) -> DataFrame:
    """Per course: title, posts, pain points, clusters and the top three issues."""
    base = (
        master.where("course_code IS NOT NULL")
        .groupBy("course_code")
        .agg(
            F.min("course_title").alias("course_title"),
            F.countDistinct("post_id").alias("posts"),
            F.countDistinct(F.when(F.col("is_pain_point") == 1, F.col("post_id"))).alias("pain_posts"),
            F.countDistinct(F.when(F.col("is_pain_point") == 1, F.col("cluster_id"))).alias("clusters"),
        )
    )
    return base.join(top_labels(master, "course_code", "global_cluster_id", "post_id"), "course_code", "left").select("course_code", "course_title", "posts", "pain_posts", "clusters", F.coalesce("top", F.lit("")).alias("top_issues"))


def cluster_detail(index: DataFrame, pains: DataFrame) -> DataFrame:
    """Per course and cluster: rows, share of the course's pain posts, first three post ids with their snippets."""
    ids = index.where("course_code IS NOT NULL AND cluster_id IS NOT NULL AND post_id IS NOT NULL").select("course_code", "cluster_id", "post_id").distinct()
    three = ids.withColumn("__rn", F.row_number().over(Window.partitionBy("course_code", "cluster_id").orderBy("post_id"))).where("__rn <= 3").drop("__rn")
    texts = pains.groupBy("post_id").agg(F.min("pain_point_snippet").alias("snippet"))
    first = three.join(texts, "post_id", "left").groupBy("course_code", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("post_id", F.coalesce("snippet", F.lit("")).alias("snippet")))).alias("first"))
    totals = pains.groupBy("course_code").agg(F.countDistinct("post_id").alias("total"))
    return (
        index.where("course_code IS NOT NULL AND cluster_id IS NOT NULL")
        .groupBy("course_code", "cluster_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("global_cluster_id").alias("global_cluster_id"))
        .join(totals, "course_code", "left")
        .join(first, ["course_code", "cluster_id"], "left")
        .select("course_code", "cluster_id", "n_rows", "global_cluster_id", (F.col("n_rows") / F.coalesce(F.nullif("total", F.lit(0)), F.lit(1))).alias("share"), F.coalesce(F.array_join(F.transform("first", lambda x: x["post_id"]), ";"), F.lit("")).alias("example_ids"), F.coalesce(F.array_join(F.transform("first", lambda x: preview(x["snippet"], 40)), " | "), F.lit("")).alias("example_snippets"))
    )


def with_summaries(detail: DataFrame, summaries: DataFrame) -> DataFrame:
    """Cluster detail with the clusters' summaries (cluster_id, issue_summary), where there are any."""
    return detail.join(summaries.groupBy("cluster_id").agg(F.min("issue_summary").alias("issue_summary")), "cluster_id", "left")


def with_index(master: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with the labels (cluster_id, global_cluster_id, normalized_issue_label, provisional_label) of both their keys; null keys find none."""
    labels = index.select("cluster_id", "global_cluster_id", "normalized_issue_label", "provisional_label").dropDuplicates(["cluster_id", "global_cluster_id"])
    return master.join(labels, ["cluster_id", "global_cluster_id"], "left")


def display_label(issue: Column, cluster: Column, otherwise: str = "Unlabelled") -> Column:
    """The issue's label, else the cluster's, else a constant; blank ones count as missing."""
    there = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(there(issue), there(cluster), F.lit(otherwise))


def contributors(cells: DataFrame, keys: list[str], member: str, n: str, most: int = 10) -> DataFrame:
    """(keys, contributors): the members with the greatest counts as ``member(n)``, joined by ``; ``; ties by member."""
    ranked_cells = cells.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(n), F.asc(member)))).where(F.col("__rn") <= most)
    listed = F.array_sort(F.collect_list(F.struct("__rn", F.format_string("%s(%d)", F.col(member), F.col(n)).alias("t"))))
    return ranked_cells.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "; ").alias("contributors"))


def issue_course_matrix(index: DataFrame) -> DataFrame:
    return index.where("global_cluster_id IS NOT NULL AND course_code IS NOT NULL").groupBy("global_cluster_id", "course_code").agg(F.countDistinct("post_id").alias("posts"), F.countDistinct("cluster_id").alias("clusters"))


def ranked(df: DataFrame, *order) -> DataFrame:
    """1-based unique rank over an aggregate of bounded size (courses, issues)."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def aligned_counts(spine: DataFrame, key: str, parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Every key of the spine with each part's count, 0 where it has none."""
    out = spine.select(key).where(F.col(key).isNotNull()).distinct()
    for name, part in parts:
        out = out.join(part.select(key, F.col("n").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def pipeline_counts(posts: DataFrame, pains: DataFrame, index: DataFrame) -> DataFrame:
    """The funnel of every course: posts, pain posts, clustered posts, clusters, issues, the rest."""
    n = lambda df, c: df.where("course_code IS NOT NULL").groupBy("course_code").agg(F.countDistinct(c).alias("n"))
    out = aligned_counts(posts, "course_code", [("posts", n(posts, "post_id")), ("pain_posts", n(pains, "post_id")), ("clustered_posts", n(index, "post_id")), ("clusters", n(index, "cluster_id")), ("issues", n(index, "global_cluster_id"))])
    return out.withColumn("no_pain", F.greatest(F.col("posts") - F.col("pain_posts"), F.lit(0))).withColumn("unclustered", F.greatest(F.col("pain_posts") - F.col("clustered_posts"), F.lit(0)))


def by_college(counts: DataFrame, courses: DataFrame, measures: list[str]) -> DataFrame:
    """Sums by college; a course of several colleges counts in each, one without is Unknown."""
    colleges = courses.select(F.col("coursecode").alias("course_code"), split_multi(F.col("colleges")).alias("college"))
    joined = counts.join(colleges, "course_code", "left")
    listed = F.when(F.size("college") > 0, F.col("college")).otherwise(F.array(F.lit("Unknown")))
    exploded = joined.withColumn("college", F.explode(F.when(F.col("college").isNull(), F.array(F.lit("Unknown"))).otherwise(listed)))
    return exploded.groupBy("college").agg(*[F.sum(m).alias(m) for m in measures])


def over_representation(cells: DataFrame, group: str, label: str, n: str, least: int = 5) -> DataFrame:
    """Share of a label within its group against its share of all; cells of at least ``least``."""
    within, overall = F.sum(n).over(Window.partitionBy(group)), F.sum(n).over(Window.partitionBy(label))
    total = cells.agg(F.sum(n).alias("__total"))
    shares = cells.withColumn("group_share", F.col(n) / within).withColumn("__label", overall).crossJoin(F.broadcast(total))
    return shares.withColumn("overall_share", F.col("__label") / F.col("__total")).where(F.col(n) >= least).select(group, label, n, "group_share", "overall_share", (F.col("group_share") / F.col("overall_share")).alias("ratio"))
