"""Problem 5: a few course codes hold most rows of painpoints and post_global_index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.codes import code_key
from quernstone.operators.heavy_keys import counts_per_key, heavy_keys
from quernstone.sources.tables import table

SHARE = 0.05
TABLES = {
    "painpoints": {"n_posts": "post_id"},
    "post_global_index": {"n_posts": "post_id", "n_clusters": "cluster_id"},
}


def _keyed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).withColumn("course_code", code_key(F.col("course_code")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows, posts and clusters of every course in both tables."""
    parts = [
        counts_per_key(_keyed(spark, d, name), "course_code", distinct).select(
            F.lit(name).alias("table_name"), "course_code", "n_rows", "n_posts", (F.col("n_clusters") if "n_clusters" in distinct else F.lit(None).cast("bigint")).alias("n_clusters")
        )
        for name, distinct in TABLES.items()
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Codes with at least 5 % of all rows stored in a table."""
    parts = [heavy_keys(_keyed(spark, d, name), "course_code", {}, SHARE).select(F.lit(name).alias("table_name"), "course_code") for name in TABLES]
    return parts[0].unionByName(parts[1])


_KEY = r"nullif(regexp_replace(upper(course_code), '[^\p{L}\p{N}]', '', 'g'), '')"

QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
ORACLE = {
    "p5_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, k AS course_code FROM (SELECT {_KEY} AS k FROM {t}) WHERE k IS NOT NULL GROUP BY k HAVING count(*) >= 0.05 * (SELECT count(*) FROM {t})" for t in TABLES
    ),
    "p5_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {_KEY} AS course_code, count(*) AS n_rows, count(DISTINCT post_id) AS n_posts, {'count(DISTINCT cluster_id)' if t == 'post_global_index' else 'CAST(NULL AS BIGINT)'} AS n_clusters FROM {t} WHERE {_KEY} IS NOT NULL GROUP BY 2"
        for t in TABLES
    ),
}
