"""Reporting tables: master, summaries, matrices, ranks, funnel, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import split_multi
from quernstone.operators import reports
from quernstone.plans.base import index, pains, posts, sql
from quernstone.sources.tables import table


def _master(spark: SparkSession, d: str) -> DataFrame:
    pain_posts = pains(spark, d).groupBy("post_id").agg(F.min("root_cause_summary").alias("root_cause_summary"))
    return reports.post_master(posts(spark, d), pain_posts, index(spark, d), table(spark, d, "courses"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).where("global_cluster_id IS NOT NULL").groupBy("global_cluster_id").agg(F.countDistinct("post_id").alias("weight"))


def q_post_master(spark, d):
    return _master(spark, d)


def q_collapse_post(spark, d):
    return reports.collapse(_master(spark, d), _weights(spark, d))


def q_course_summary(spark, d):
    return reports.course_summary(_master(spark, d))


def q_cluster_detail(spark, d):
    return reports.cluster_detail(index(spark, d), pains(spark, d))


def q_issue_course_matrix(spark, d):
    return reports.issue_course_matrix(index(spark, d))


def q_course_rank(spark, d):
    return reports.ranked(reports.course_summary(_master(spark, d)), F.desc("pain_posts"), F.desc("posts"), F.asc("course_code")).select("rank", "course_code", "pain_posts", "posts")


def _issues(spark, d):
    return index(spark, d).where("global_cluster_id IS NOT NULL").groupBy("global_cluster_id").agg(F.countDistinct("post_id").alias("total"), F.countDistinct("course_code").alias("courses"), F.countDistinct("cluster_id").alias("clusters"))


def q_issue_rank(spark, d):
    return reports.ranked(_issues(spark, d), F.desc("total"), F.desc("courses"), F.asc("global_cluster_id"))


def q_pipeline_counts(spark, d):
    return reports.pipeline_counts(posts(spark, d), pains(spark, d), index(spark, d))


_MEASURES = ["posts", "pain_posts", "clustered_posts", "clusters", "issues", "no_pain", "unclustered"]


def q_college_rollup(spark, d):
    return reports.by_college(q_pipeline_counts(spark, d), table(spark, d, "courses"), _MEASURES)


def q_overview_totals(spark, d):
    """One row of corpus totals."""
    return q_pipeline_counts(spark, d).agg(*[F.sum(m).alias(m) for m in _MEASURES], F.count_if(F.col("pain_posts") > 0).alias("courses_with_pain"))


def q_college_issue_topn(spark, d):
    """The six issues with most posts of every college."""
    cells = reports.issue_course_matrix(index(spark, d))
    colleges = table(spark, d, "courses").select(F.col("coursecode").alias("course_code"), F.explode(split_multi(F.col("colleges"))).alias("college"))
    per = cells.join(colleges, "course_code").groupBy("college", "global_cluster_id").agg(F.sum("posts").alias("posts"))
    return per.withColumn("rn", F.row_number().over(Window.partitionBy("college").orderBy(F.desc("posts"), F.asc("global_cluster_id"))).cast("bigint")).where("rn <= 6")


def q_overrep(spark, d):
    """Issues over-represented among the posts of courses of a single college."""
    single = table(spark, d, "courses").select(F.col("coursecode").alias("course_code"), split_multi(F.col("colleges")).alias("c")).where(F.size("c") == 1).select("course_code", F.col("c")[0].alias("college"))
    cells = index(spark, d).where("global_cluster_id IS NOT NULL").join(single, "course_code").groupBy("college", "global_cluster_id").agg(F.countDistinct("post_id").alias("n"))
    return reports.over_representation(cells, "college", "global_cluster_id", "n")


def q_archetypes(spark, d):
    """Courses with at least five posts and three issues, and the sorted list of these."""
    return (
        index(spark, d).where("course_code IS NOT NULL").groupBy("course_code").agg(F.countDistinct("post_id").alias("posts"), F.array_join(F.array_sort(F.collect_set("global_cluster_id")), ";").alias("issues"), F.countDistinct("global_cluster_id").alias("n_issues")).where("posts >= 5 AND n_issues >= 3")
    )


def q_low_signal(spark, d):
    """Issues with the fewest posts (a fifth of the greatest or less), and their breadth."""
    issues = _issues(spark, d)
    most = issues.agg(F.max("total").alias("most"))
    return issues.join(F.broadcast(most), F.col("total") <= F.col("most") / 5).select("global_cluster_id", "total", "courses", "clusters")


def q_single_multi_college(spark, d):
    c = table(spark, d, "courses").select("coursecode", split_multi(F.col("colleges")).alias("c")).select("coursecode", F.explode("c").alias("college"), (F.size("c") == 1).alias("single"))
    return c.groupBy("college").agg(F.count_if("single").alias("single_courses"), F.count_if(~F.col("single")).alias("shared_courses"))


def q_sample_ids(spark, d):
    """Up to ten post ids, by their digest, of each issue."""
    i = index(spark, d).where("global_cluster_id IS NOT NULL").select("global_cluster_id", "post_id").distinct()
    r = i.withColumn("rn", F.row_number().over(Window.partitionBy("global_cluster_id").orderBy(F.md5("post_id"), "post_id"))).where("rn <= 10")
    return r.groupBy("global_cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "post_id"))), lambda x: x["post_id"]), ";").alias("ids"))


_TOP = "top AS (SELECT course_code, string_agg(global_cluster_id, ', ' ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY course_code ORDER BY n DESC, global_cluster_id) AS rn FROM (SELECT course_code, global_cluster_id, count(DISTINCT post_id) AS n FROM master WHERE course_code IS NOT NULL AND global_cluster_id IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1)"
_SUMMARY = f", {_TOP}, summary AS (SELECT course_code, min(course_title) AS course_title, count(DISTINCT post_id) AS posts, count(DISTINCT CASE WHEN is_pain_point = 1 THEN post_id END) AS pain_posts, count(DISTINCT CASE WHEN is_pain_point = 1 THEN cluster_id END) AS clusters, coalesce(any_value(top), '') AS top_issues FROM master LEFT JOIN top USING (course_code) WHERE course_code IS NOT NULL GROUP BY 1)"
_ISSUES = "SELECT global_cluster_id, count(DISTINCT post_id) AS total, count(DISTINCT course_code) AS courses, count(DISTINCT cluster_id) AS clusters FROM idx WHERE global_cluster_id IS NOT NULL GROUP BY 1"
_FUNNEL = """, per AS (SELECT c.course_code, count(DISTINCT p.post_id) AS posts, coalesce(any_value(n.n), 0) AS pain_posts, coalesce(any_value(i.a), 0) AS clustered_posts, coalesce(any_value(i.b), 0) AS clusters, coalesce(any_value(i.c), 0) AS issues FROM (SELECT DISTINCT course_code FROM posts WHERE course_code IS NOT NULL) c JOIN posts p ON p.course_code = c.course_code LEFT JOIN (SELECT course_code, count(DISTINCT post_id) AS n FROM pains GROUP BY 1) n ON n.course_code = c.course_code LEFT JOIN (SELECT course_code, count(DISTINCT post_id) AS a, count(DISTINCT cluster_id) AS b, count(DISTINCT global_cluster_id) AS c FROM idx GROUP BY 1) i ON i.course_code = c.course_code GROUP BY 1), counts AS (SELECT *, greatest(posts - pain_posts, 0) AS no_pain, greatest(pain_posts - clustered_posts, 0) AS unclustered FROM per)"""
_COLLEGES = "(SELECT coursecode, trim(x) AS college FROM (SELECT coursecode, unnest(string_split(coalesce(colleges, ''), ';')) AS x FROM courses) WHERE trim(x) <> '')"
_SINGLE = f"(SELECT coursecode, min(college) AS college FROM {_COLLEGES} GROUP BY 1 HAVING count(*) = 1)"
_SHORT = r"regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), 'https?://[^ \t\n\f\r]+', '', 'g'), '[ \t\n\f\r]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in _MEASURES)


def _with(body: str, extra: str, *ctes: str) -> str:
    """Further common tables after the shared ones."""
    head, _, tail = sql("\x00" + body, *ctes).partition("\x00")
    return head.rstrip() + extra + " " + tail


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLE = {
    "q_post_master": sql("SELECT post_id, course_code, is_pain_point, cluster_id, global_cluster_id, course_title, colleges FROM master", "master"),
    "q_collapse_post": _with(
        "SELECT m.post_id, min(course_code) AS course_code, coalesce(string_agg(DISTINCT cluster_id, ';' ORDER BY cluster_id), '') AS cluster_ids, coalesce(string_agg(DISTINCT m.global_cluster_id, ';' ORDER BY m.global_cluster_id), '') AS global_ids, max(is_pain_point) AS is_pain_point, coalesce(first(m.global_cluster_id ORDER BY w.weight DESC, m.global_cluster_id) FILTER (m.global_cluster_id IS NOT NULL), '') AS main_issue FROM master m LEFT JOIN w ON m.global_cluster_id = w.global_cluster_id GROUP BY 1",
        ", w AS (SELECT global_cluster_id, count(DISTINCT post_id) AS weight FROM idx WHERE global_cluster_id IS NOT NULL GROUP BY 1)",
        "master",
    ),
    "q_course_summary": _with("SELECT * FROM summary", _SUMMARY, "master"),
    "q_cluster_detail": _with(
        "SELECT i.course_code, i.cluster_id, count(*) AS n_rows, min(global_cluster_id) AS global_cluster_id, count(*) / coalesce(nullif(any_value(t.total), 0), 1) AS share, coalesce(any_value(f.ids), '') AS example_ids, coalesce(any_value(f.texts), '') AS example_snippets FROM idx i LEFT JOIN (SELECT course_code, count(DISTINCT post_id) AS total FROM pains GROUP BY 1) t ON i.course_code = t.course_code LEFT JOIN firsts f ON f.course_code = i.course_code AND f.cluster_id = i.cluster_id WHERE i.course_code IS NOT NULL AND i.cluster_id IS NOT NULL GROUP BY 1, 2",
        f", three AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_code, cluster_id ORDER BY post_id) AS rn FROM (SELECT DISTINCT course_code, cluster_id, post_id FROM idx WHERE course_code IS NOT NULL AND cluster_id IS NOT NULL AND post_id IS NOT NULL)) WHERE rn <= 3), firsts AS (SELECT course_code, cluster_id, string_agg(post_id, ';' ORDER BY rn) AS ids, string_agg(CASE WHEN length(s) > 40 THEN s[1:39] || '…' ELSE s END, ' | ' ORDER BY rn) AS texts FROM (SELECT three.*, {_SHORT} AS s FROM three LEFT JOIN (SELECT post_id, min(pain_point_snippet) AS x FROM pains GROUP BY 1) USING (post_id)) GROUP BY 1, 2)",
        "pains", "idx",
    ),
    "q_issue_course_matrix": sql("SELECT global_cluster_id, course_code, count(DISTINCT post_id) AS posts, count(DISTINCT cluster_id) AS clusters FROM idx WHERE global_cluster_id IS NOT NULL AND course_code IS NOT NULL GROUP BY 1, 2", "idx"),
    "q_course_rank": _with("SELECT row_number() OVER (ORDER BY pain_posts DESC, posts DESC, course_code) AS rank, course_code, pain_posts, posts FROM summary", _SUMMARY, "master"),
    "q_issue_rank": sql(f"SELECT *, row_number() OVER (ORDER BY total DESC, courses DESC, global_cluster_id) AS rank FROM ({_ISSUES})", "idx"),
    "q_pipeline_counts": _with("SELECT * FROM counts", _FUNNEL, "posts", "pains", "idx"),
    "q_college_rollup": _with(f"SELECT coalesce(k.college, 'Unknown') AS college, {_SUMS} FROM counts c LEFT JOIN {_COLLEGES} k ON c.course_code = k.coursecode GROUP BY 1", _FUNNEL, "posts", "pains", "idx"),
    "q_overview_totals": _with(f"SELECT {_SUMS}, count(*) FILTER (pain_posts > 0) AS courses_with_pain FROM counts", _FUNNEL, "posts", "pains", "idx"),
    "q_college_issue_topn": sql(f"SELECT * FROM (SELECT college, global_cluster_id, CAST(sum(posts) AS BIGINT) AS posts, row_number() OVER (PARTITION BY college ORDER BY sum(posts) DESC, global_cluster_id) AS rn FROM (SELECT global_cluster_id, course_code, count(DISTINCT post_id) AS posts FROM idx WHERE global_cluster_id IS NOT NULL AND course_code IS NOT NULL GROUP BY 1, 2) m JOIN {_COLLEGES} k ON m.course_code = k.coursecode GROUP BY 1, 2) WHERE rn <= 6", "idx"),
    "q_overrep": _with("SELECT college, global_cluster_id, n, n / g AS group_share, l / t AS overall_share, (n / g) / (l / t) AS ratio FROM (SELECT *, sum(n) OVER (PARTITION BY college) AS g, sum(n) OVER (PARTITION BY global_cluster_id) AS l, sum(n) OVER () AS t FROM cells) WHERE n >= 5", f", cells AS (SELECT college, global_cluster_id, count(DISTINCT post_id) AS n FROM idx JOIN {_SINGLE} s ON idx.course_code = s.coursecode WHERE global_cluster_id IS NOT NULL GROUP BY 1, 2)", "idx"),
    "q_archetypes": sql("SELECT course_code, count(DISTINCT post_id) AS posts, string_agg(DISTINCT global_cluster_id, ';' ORDER BY global_cluster_id) AS issues, count(DISTINCT global_cluster_id) AS n_issues FROM idx WHERE course_code IS NOT NULL GROUP BY 1 HAVING count(DISTINCT post_id) >= 5 AND count(DISTINCT global_cluster_id) >= 3", "idx"),
    "q_low_signal": sql(f"SELECT global_cluster_id, total, courses, clusters FROM ({_ISSUES}) WHERE total <= (SELECT max(total) FROM ({_ISSUES})) / 5", "idx"),
    "q_single_multi_college": f"SELECT college, count(*) FILTER (k = 1) AS single_courses, count(*) FILTER (k > 1) AS shared_courses FROM (SELECT *, count(*) OVER (PARTITION BY coursecode) AS k FROM {_COLLEGES}) GROUP BY 1",
    "q_sample_ids": sql("SELECT global_cluster_id, string_agg(post_id, ';' ORDER BY rn) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY global_cluster_id ORDER BY md5(post_id), post_id) AS rn FROM (SELECT DISTINCT global_cluster_id, post_id FROM idx WHERE global_cluster_id IS NOT NULL)) WHERE rn <= 10 GROUP BY 1", "idx"),
}
