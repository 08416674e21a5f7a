"""The cleaned inputs that the queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.codes import code_key
from quernstone.operators.rows import first_per_key
from quernstone.sources.tables import table

KEY = r"nullif(regexp_replace(upper(course_code), '[^\p{L}\p{N}]', '', 'g'), '')"


def posts(spark: SparkSession, d: str) -> DataFrame:
    """The latest capture of every post, with its course code normalised."""
    latest = first_per_key(table(spark, d, "stage0_filtered_posts"), ["post_id"], [F.desc_nulls_last("captured_at"), F.desc_nulls_last("score"), F.desc_nulls_last("num_comments")])
    return latest.withColumn("course_code", code_key(F.col("course_code")))


def pains(spark: SparkSession, d: str) -> DataFrame:
    """One row of every post and course with a pain point; the least non-null texts."""
    keyed = table(spark, d, "painpoints").withColumn("course_code", code_key(F.col("course_code"))).where("course_code IS NOT NULL AND post_id IS NOT NULL")
    return keyed.groupBy("post_id", "course_code").agg(F.min("root_cause_summary").alias("root_cause_summary"), F.min("pain_point_snippet").alias("pain_point_snippet"))


def index(spark: SparkSession, d: str) -> DataFrame:
    """Distinct memberships of posts in clusters, courses normalised, the least non-null title."""
    keyed = table(spark, d, "post_global_index").withColumn("course_code", code_key(F.col("course_code")))
    return keyed.groupBy("post_id", "cluster_id", "global_cluster_id", "course_code").agg(F.min("course_title").alias("course_title"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """One label of every post: DEV before TEST, then course and label."""
    t = table(spark, d, "gold_labels").select(
        F.trim("post_id").alias("post_id"), F.upper(F.trim("split")).alias("split"), code_key(F.col("course_code")).alias("course_code"), F.lower(F.trim("contains_painpoint")).alias("gold")
    ).where("post_id <> ''")
    return first_per_key(t, ["post_id"], [F.when(F.col("split") == "DEV", 0).otherwise(1).asc(), F.asc_nulls_last("course_code"), F.asc_nulls_last("gold"), F.asc_nulls_last("split")])


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labelled posts with two rule predictors: by sentiment, and by sentiment and replies."""
    p = posts(spark, d).select("post_id", "title", "selftext", "vader_compound", "num_comments")
    known: Column = F.col("vader_compound").isNotNull() & ~F.isnan("vader_compound")
    old = F.when(~known, "u").when(F.col("vader_compound") < -0.5, "y").otherwise("n")
    new = F.when(~known, "u").when((F.col("vader_compound") < -0.4) & (F.col("num_comments") > 4), "y").otherwise("n")
    return gold(spark, d).join(p, "post_id").withColumn("pred_old", old).withColumn("pred_new", new)


SQL = {
    "posts": f"posts AS (SELECT * REPLACE ({KEY} AS course_code) FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY captured_at DESC NULLS LAST, score DESC NULLS LAST, num_comments DESC NULLS LAST) AS rn FROM stage0_filtered_posts) WHERE rn = 1)",
    "pains": f"pains AS (SELECT post_id, {KEY} AS course_code, min(root_cause_summary) AS root_cause_summary, min(pain_point_snippet) AS pain_point_snippet FROM painpoints WHERE {KEY} IS NOT NULL AND post_id IS NOT NULL GROUP BY 1, 2)",
    "idx": f"idx AS (SELECT post_id, cluster_id, global_cluster_id, {KEY} AS course_code, min(course_title) AS course_title FROM post_global_index GROUP BY 1, 2, 3, 4)",
    "gold": f"gold AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY CASE WHEN split = 'DEV' THEN 0 ELSE 1 END, course_code NULLS LAST, gold NULLS LAST, split NULLS LAST) AS rn FROM (SELECT trim(post_id) AS post_id, upper(trim(split)) AS split, {KEY} AS course_code, lower(trim(contains_painpoint)) AS gold FROM gold_labels) WHERE post_id <> '') WHERE rn = 1)",
    "preds": "preds AS (SELECT g.*, p.title, p.selftext, p.vader_compound, p.num_comments, CASE WHEN p.vader_compound IS NULL OR isnan(p.vader_compound) THEN 'u' WHEN p.vader_compound < -0.5 THEN 'y' ELSE 'n' END AS pred_old, CASE WHEN p.vader_compound IS NULL OR isnan(p.vader_compound) THEN 'u' WHEN p.vader_compound < -0.4 AND p.num_comments > 4 THEN 'y' ELSE 'n' END AS pred_new FROM gold g JOIN posts p USING (post_id))",
    "master": "master AS (SELECT p.post_id, p.course_code, CASE WHEN n.post_id IS NULL THEN 0 ELSE 1 END AS is_pain_point, i.cluster_id, i.global_cluster_id, coalesce(c.title, i.course_title) AS course_title, c.colleges FROM posts p LEFT JOIN (SELECT DISTINCT post_id FROM pains) n ON p.post_id = n.post_id LEFT JOIN idx i ON p.post_id = i.post_id LEFT JOIN courses c ON p.course_code = c.coursecode)",
}
_NEEDS = {"preds": ["posts", "gold"], "master": ["posts", "pains", "idx"]}


def sql(body: str, *ctes: str) -> str:
    """A query over the shared inputs."""
    names: list[str] = []
    for c in ctes:
        names += [x for x in (*_NEEDS.get(c, []), c) if x not in names]
    return (f"WITH {', '.join(SQL[n] for n in names)} " if names else "") + body
