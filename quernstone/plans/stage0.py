"""Corpus selection: structural filter, code match, thresholds, allowlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import filters, rows
from quernstone.plans.base import KEY, pains, posts, sql
from quernstone.sources.tables import table

_OK = "coalesce(is_removed, 0) = 0 AND coalesce(is_deleted, 0) = 0 AND coalesce(is_promotional, 0) = 0 AND length(trim(coalesce(title, '') || ' ' || coalesce(selftext, ''))) > 0"


def q_structural_filter(spark: SparkSession, d: str) -> DataFrame:
    """Kept posts with the name of their board from the dimension table."""
    boards = table(spark, d, "subreddits").select("subreddit_id", F.col("name").alias("board"))
    return filters.structural_filter(posts(spark, d)).join(boards, "subreddit_id", "left").select("post_id", "board", "score")


def q_code_match_exact_one(spark: SparkSession, d: str) -> DataFrame:
    """Posts that mention exactly one known course."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    found = filters.match_codes(posts(spark, d), "post_id", text, table(spark, d, "courses"), "coursecode")
    return found.select("post_id", F.col("matched")[0].alias("code"))


def q_any_word_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(filters.any_word(F.col("text"), ["rubric", "webinar", "textbook"])).select("doc_id", "source")


def q_threshold_strict(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where(filters.below(F.col("vader_compound"), -0.2)).select("post_id", "vader_compound")


def q_threshold_incl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(filters.below(F.col("value"), 20.0, inclusive=True)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


def q_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why labelled rows are dropped, first failing reason first; kept rows have none."""
    g = table(spark, d, "gold_labels").join(pains(spark, d).groupBy(F.col("post_id").alias("p")).agg(F.min("pain_point_snippet").alias("snippet")), F.trim("post_id") == F.col("p"), "left")
    reason = filters.pain_point_reasons(F.col("contains_painpoint"), F.coalesce(F.trim("ambiguity_flag") == "1", F.lit(False)), F.col("root_cause_summary"), F.col("snippet"))
    return g.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_semi_allowlist(spark: SparkSession, d: str) -> DataFrame:
    """Posts of boards that are listed, by normalised name."""
    name = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"\s", "")), "^/?r/", "")
    listed = table(spark, d, "subreddits").where("is_nsfw = 0").select(name(F.col("name")).alias("board")).where("board <> ''").distinct()
    return posts(spark, d).withColumn("board", name(F.col("subreddit_name"))).join(listed, "board", "left_semi").groupBy("board").agg(F.count(F.lit(1)).alias("n_posts"), F.countDistinct("username").alias("n_authors"))


def q_anti_missing(spark: SparkSession, d: str) -> DataFrame:
    """Pain points whose post is not stored."""
    return pains(spark, d).join(posts(spark, d).select("post_id"), "post_id", "left_anti").select("post_id", "course_code")


def q_semi_urgent_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an order of the highest priority."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def q_dedup_prefer_split(spark: SparkSession, d: str) -> DataFrame:
    from quernstone.plans.base import gold

    return gold(spark, d).select("post_id", "split", "course_code", "gold")


def q_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    """First event of every user of the first half of January; later users' first events are added."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    order = [F.asc("ts"), F.asc("event_id")]
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return rows.insert_absent(rows.first_per_key(e.where(F.col("ts") < cut), ["user_id"], order), e.where(F.col("ts") >= cut), ["user_id"], order).select("user_id", "event_id", "event_type")


def q_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return rows.upsert(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


def q_frontier_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Events past each type's frontier (the latest of the first half)."""
    e = table(spark, d, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    frontier = e.where(F.col("ts") < cut).groupBy("event_type").agg(F.max("ts").alias("frontier"))
    return e.join(frontier, "event_type", "left").where("frontier IS NULL OR ts > frontier").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


_BOARD = "regexp_replace(lower(regexp_replace({}, '\\s', '', 'g')), '^/?r/', '')"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLE = {
    "q_structural_filter": sql(f"SELECT p.post_id, s.name AS board, p.score FROM posts p LEFT JOIN subreddits s ON p.subreddit_id = s.subreddit_id WHERE {_OK}", "posts"),
    "q_code_match_exact_one": sql(
        r"""SELECT post_id, min(code) AS code FROM (SELECT post_id, code FROM posts, (SELECT code, CASE WHEN regexp_full_match(code, '[A-Z]+[0-9]+') THEN regexp_replace(code, '^([A-Z]+)', '\1[ -]?') ELSE code END AS p
        FROM (SELECT DISTINCT regexp_replace(upper(coursecode), '[- ]', '', 'g') AS code FROM courses) WHERE length(code) >= 2)
        WHERE regexp_matches(upper(coalesce(title, '') || ' ' || coalesce(selftext, '')), '(^|[^A-Z0-9])' || p || '($|[^A-Z0-9])')) GROUP BY post_id HAVING count(*) = 1""",
        "posts",
    ),
    "q_any_word_match": r"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)\b(?:rubric|webinar|textbook)\b')",
    "q_threshold_strict": sql("SELECT post_id, vader_compound FROM posts WHERE vader_compound < -0.2 AND NOT isnan(vader_compound)", "posts"),
    "q_threshold_incl": "SELECT event_type, count(*) AS n, max(value) AS most FROM events WHERE value <= 20 AND NOT isnan(value) GROUP BY 1",
    "q_filter_reasons": sql(
        "SELECT CASE WHEN lower(trim(coalesce(contains_painpoint, ''))) <> 'y' THEN 'not_painpoint' WHEN coalesce(trim(ambiguity_flag) = '1', false) THEN 'error_flagged' WHEN trim(coalesce(root_cause_summary, '')) = '' THEN 'empty_root_cause' WHEN trim(coalesce(snippet, '')) = '' THEN 'empty_snippet' ELSE 'kept' END AS reason, count(*) AS n FROM gold_labels LEFT JOIN (SELECT post_id AS p, min(pain_point_snippet) AS snippet FROM pains GROUP BY 1) ON trim(post_id) = p GROUP BY 1",
        "pains",
    ),
    "q_semi_allowlist": sql(f"SELECT {_BOARD.format('subreddit_name')} AS board, count(*) AS n_posts, count(DISTINCT username) AS n_authors FROM posts WHERE {_BOARD.format('subreddit_name')} IN (SELECT {_BOARD.format('name')} FROM subreddits WHERE is_nsfw = 0) AND {_BOARD.format('subreddit_name')} <> '' GROUP BY 1", "posts"),
    "q_anti_missing": sql("SELECT post_id, course_code FROM pains WHERE post_id NOT IN (SELECT post_id FROM posts WHERE post_id IS NOT NULL)", "posts", "pains"),
    "q_semi_urgent_customers": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1",
    "q_dedup_prefer_split": sql("SELECT post_id, split, course_code, gold FROM gold", "gold"),
    "q_insert_absent": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
    "q_upsert_latest": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "q_frontier_incremental": "WITH f AS (SELECT event_type, max(ts) AS frontier FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1) SELECT e.event_type, count(*) AS n, min(event_id) AS first_id FROM events e LEFT JOIN f ON e.event_type = f.event_type WHERE frontier IS NULL OR ts > frontier GROUP BY 1",
}
__all__ = ["KEY", "ORACLE", "QUERIES"]
