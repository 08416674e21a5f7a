"""Clusters and issues: nesting, batches, merging, ids, validation; serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import clusters, reports, rows, search
from quernstone.plans.base import index, pains, posts, sql
from quernstone.sources.tables import table


def q_flatten_nested(spark, d):
    """Clusters nested by course and flattened again."""
    return clusters.flatten(clusters.nest(index(spark, d))).select("course_code", "cluster_id", "num_posts", F.array_join("post_ids", ";").alias("post_ids"))


def q_explode_membership(spark, d):
    flat = clusters.flatten(clusters.nest(index(spark, d)))
    return flat.select("course_code", F.explode("post_ids").alias("post_id")).groupBy("course_code").agg(F.count(F.lit(1)).alias("memberships"), F.countDistinct("post_id").alias("posts"))


def q_cluster_batches(spark, d):
    """Clusters by size in batches of sixty."""
    flat = clusters.flatten(clusters.nest(index(spark, d))).select("course_code", "cluster_id", "num_posts")
    return clusters.batches(flat, [F.desc("num_posts"), F.asc("course_code"), F.asc("cluster_id")])


def q_merge_global(spark, d):
    """Batch groups of one issue merged: their clusters, and the first batch's description."""
    flat = index(spark, d).where("global_cluster_id IS NOT NULL AND cluster_id IS NOT NULL").withColumn("batch", F.ascii(F.reverse("cluster_id")) % 4)
    groups = flat.groupBy(F.col("global_cluster_id").alias("label"), "batch").agg(F.collect_set("cluster_id").alias("members"), F.concat(F.min("course_code"), F.lit(" in batch "), F.first("batch").cast("string")).alias("description"))
    return clusters.merge(groups).select("label", F.array_join("members", ";").alias("members"), "description")


def q_global_ids(spark, d):
    totals = index(spark, d).where("global_cluster_id IS NOT NULL").groupBy(F.col("global_cluster_id").alias("label")).agg(F.countDistinct("post_id").alias("total"))
    return clusters.global_ids(totals, "total", "label")


def q_global_totals(spark, d):
    """Totals of every issue recomputed from its members."""
    i = index(spark, d).where("global_cluster_id IS NOT NULL AND cluster_id IS NOT NULL AND course_code IS NOT NULL")
    members = i.groupBy("global_cluster_id").agg(F.collect_set("cluster_id").alias("members")).select("global_cluster_id", F.explode("members").alias("cluster_id"))
    sizes = i.groupBy("cluster_id").agg(F.countDistinct("post_id").alias("num_posts"), F.min("course_code").alias("course_code"))
    return members.join(sizes, "cluster_id").groupBy("global_cluster_id").agg(F.sum("num_posts").alias("posts"), F.countDistinct("cluster_id").alias("clusters"), F.countDistinct("course_code").alias("courses"))


def q_validate_clusters(spark, d):
    return clusters.violations(clusters.flatten(clusters.nest(index(spark, d))), pains(spark, d))


def q_validate_cover(spark, d):
    """Clusters assigned to an issue and not, missing, or unknown."""
    i = index(spark, d).where("cluster_id IS NOT NULL").select("cluster_id", "global_cluster_id")
    return rows.coverage(i.where("global_cluster_id IS NOT NULL"), i.where("global_cluster_id IS NULL"), i.select("cluster_id"), "cluster_id")


def q_coverage_share(spark, d):
    i = index(spark, d).where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.max(F.when(F.col("global_cluster_id").isNotNull(), 1).otherwise(0)).alias("ok"), F.countDistinct("post_id").alias("posts"))
    return i.agg(F.count(F.lit(1)).alias("clusters"), F.sum("ok").alias("assigned"), (F.sum("ok") / F.count(F.lit(1))).alias("cluster_share"), (F.sum(F.col("ok") * F.col("posts")) / F.sum("posts")).alias("post_share"))


def q_lag_order_check(spark, d):
    """Issues, in the order of their ids, whose total exceeds the one before."""
    totals = index(spark, d).where("global_cluster_id IS NOT NULL").groupBy("global_cluster_id").agg(F.countDistinct("post_id").alias("total"))
    return clusters.out_of_order(reports.ranked(totals, F.asc("global_cluster_id")), "total", "rank").select("global_cluster_id", "total", "before")


def q_search_posts(spark, d):
    """Second page of the posts that mention webinars, newest first."""
    found = search.search_posts(posts(spark, d), "webinar")
    return rows.page(found.where("created_utc IS NOT NULL AND NOT isnan(created_utc)"), [F.desc("created_utc"), F.asc("post_id")], 2).select("post_id", "course_code")


def q_search_courses(spark, d):
    return search.search_courses(table(spark, d, "courses"), "of", "college of care").select("coursecode", "title")


def q_facets(spark, d):
    return search.facet(posts(spark, d), "flair")


def q_topn_per_region(spark, d):
    """The six customers with the greatest balance of every region."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("r_name").orderBy(F.desc("c_acctbal"), F.asc("c_custkey"))).cast("bigint")).where("rn <= 6").select("r_name", "c_custkey", "rn")


def q_thread_cap(spark, d):
    """At most three events of each type and day: the cap on replies of a parent."""
    e = table(spark, d, "events").withColumn("parent", F.concat("event_type", F.lit("_"), F.date_format("ts", "yyyyMMdd")))
    return rows.cap_children(e, "parent", [F.asc("ts"), F.asc("event_id")], 3).select("parent", "event_id")


_FLAT = "flat AS (SELECT course_code, cluster_id, count(DISTINCT post_id) AS num_posts FROM idx WHERE course_code IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2)"


def _idx(body: str, *more: str, also: tuple[str, ...] = ()) -> str:
    head, _, tail = sql("\x00" + body, *also, "idx").partition("\x00")
    return ", ".join([head.rstrip(), *more]) + " " + tail


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLE = {
    "q_flatten_nested": _idx("SELECT course_code, cluster_id, CAST(count(DISTINCT post_id) AS INT) AS num_posts, string_agg(DISTINCT post_id, ';' ORDER BY post_id) AS post_ids FROM idx WHERE course_code IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2"),
    "q_explode_membership": _idx("SELECT course_code, count(*) AS memberships, count(DISTINCT post_id) AS posts FROM (SELECT DISTINCT course_code, cluster_id, post_id FROM idx WHERE course_code IS NOT NULL AND cluster_id IS NOT NULL AND post_id IS NOT NULL) GROUP BY 1"),
    "q_cluster_batches": _idx("SELECT course_code, cluster_id, CAST(num_posts AS INT) AS num_posts, CAST((row_number() OVER (ORDER BY num_posts DESC, course_code, cluster_id) - 1) // 60 AS INT) AS batch FROM flat", _FLAT),
    "q_merge_global": _idx("SELECT label, string_agg(DISTINCT cluster_id, ';' ORDER BY cluster_id) AS members, (SELECT min(j.course_code) || ' in batch ' || min(f.b) FROM f j WHERE j.label = f.label AND j.b = min(f.b)) AS description FROM f GROUP BY label", "f AS (SELECT global_cluster_id AS label, cluster_id, course_code, ascii(reverse(cluster_id)) % 4 AS b FROM idx WHERE global_cluster_id IS NOT NULL AND cluster_id IS NOT NULL)"),
    "q_global_ids": _idx("SELECT label, total, printf('G%03d', row_number() OVER (ORDER BY total DESC, label)) AS global_id FROM (SELECT global_cluster_id AS label, count(DISTINCT post_id) AS total FROM idx WHERE global_cluster_id IS NOT NULL GROUP BY 1)"),
    "q_global_totals": _idx("SELECT m.global_cluster_id, CAST(sum(num_posts) AS BIGINT) AS posts, count(DISTINCT m.cluster_id) AS clusters, count(DISTINCT s.course_code) AS courses FROM (SELECT DISTINCT global_cluster_id, cluster_id FROM i) m JOIN (SELECT cluster_id, count(DISTINCT post_id) AS num_posts, min(course_code) AS course_code FROM i GROUP BY 1) s USING (cluster_id) GROUP BY 1", "i AS (SELECT * FROM idx WHERE global_cluster_id IS NOT NULL AND cluster_id IS NOT NULL AND course_code IS NOT NULL)"),
    "q_validate_clusters": _idx("SELECT 'prefix' AS rule, course_code, cluster_id FROM flat WHERE NOT starts_with(cluster_id, course_code || '_') UNION ALL SELECT 'unknown_post', course_code, cluster_id FROM (SELECT DISTINCT course_code, cluster_id FROM idx WHERE course_code IS NOT NULL AND cluster_id IS NOT NULL AND post_id IS NOT NULL AND post_id NOT IN (SELECT post_id FROM pains)) UNION ALL SELECT 'duplicate', min(course_code), cluster_id FROM flat GROUP BY cluster_id HAVING count(*) > 1", _FLAT, also=("pains",)),
    "q_validate_cover": _idx("SELECT 'both' AS violation, cluster_id FROM idx WHERE cluster_id IS NOT NULL GROUP BY cluster_id HAVING count(global_cluster_id) > 0 AND count(global_cluster_id) < count(*)"),
    "q_coverage_share": _idx("SELECT count(*) AS clusters, CAST(sum(ok) AS BIGINT) AS assigned, sum(ok) / count(*) AS cluster_share, sum(ok * posts) / sum(posts) AS post_share FROM (SELECT cluster_id, max(CASE WHEN global_cluster_id IS NOT NULL THEN 1 ELSE 0 END) AS ok, count(DISTINCT post_id) AS posts FROM idx WHERE cluster_id IS NOT NULL GROUP BY 1)"),
    "q_lag_order_check": _idx("SELECT global_cluster_id, total, before FROM (SELECT *, lag(total) OVER (ORDER BY global_cluster_id) AS before FROM (SELECT global_cluster_id, count(DISTINCT post_id) AS total FROM idx WHERE global_cluster_id IS NOT NULL GROUP BY 1)) WHERE before < total"),
    "q_search_posts": sql("SELECT post_id, course_code FROM posts WHERE (contains(lower(coalesce(title, '')), 'webinar') OR contains(lower(coalesce(selftext, '')), 'webinar')) AND created_utc IS NOT NULL AND NOT isnan(created_utc) ORDER BY created_utc DESC, post_id LIMIT 50 OFFSET 50", "posts"),
    "q_search_courses": "SELECT coursecode, title FROM courses WHERE (contains(lower(coalesce(coursecode, '')), 'of') OR contains(lower(coalesce(title, '')), 'of')) AND list_contains(list_transform(string_split(lower(coalesce(colleges, '')), ';'), lambda x: trim(x)), 'college of care')",
    "q_facets": sql("SELECT flair AS value, count(*) AS n FROM posts WHERE trim(flair) <> '' GROUP BY 1", "posts"),
    "q_topn_per_region": "SELECT r_name, c_custkey, rn FROM (SELECT r_name, c_custkey, row_number() OVER (PARTITION BY r_name ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE rn <= 6",
    "q_thread_cap": "SELECT parent, event_id FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ts, event_id) AS rn FROM (SELECT *, event_type || '_' || strftime(ts, '%Y%m%d') AS parent FROM events)) WHERE rn <= 3",
}
