"""Text profiles, samples, response parsing, sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import parse, text
from quernstone.functions.sentiment import NEGATIONS, STRONGER, WEAKER, WEIGHTS, compound
from quernstone.operators import profile, rows, sampling
from quernstone.plans.base import gold, posts, sql
from quernstone.sources.tables import table


def _tokens(spark, d):
    p = posts(spark, d)
    return p.withColumn("tokens", text.token_count(text.assemble_stripped(F.col("title"), F.col("selftext"))))


def q_length_profile(spark, d):
    return profile.quantile_profile(_tokens(spark, d), "tokens").withColumn("mean", F.round("mean", 6))


def q_length_profile_by_type(spark, d):
    t = table(spark, d, "documents").withColumn("tokens", text.token_count(F.col("text")))
    return profile.quantile_profile(t, "tokens", ["doc_type"]).withColumn("mean", F.round("mean", 6))


def q_length_histogram(spark, d):
    return profile.histogram(_tokens(spark, d), "tokens", 50)


def q_bucket_counts(spark, d):
    return _tokens(spark, d).groupBy(F.coalesce(text.length_bucket(F.col("tokens")), F.lit("none")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def q_group_token_max(spark, d):
    return profile.largest_groups(_tokens(spark, d).where("course_code IS NOT NULL"), "course_code", "tokens")


def q_sample_round_robin(spark, d):
    """Two hundred posts in turn from every course and length bucket, one board kept whole."""
    t = _tokens(spark, d).where("course_code IS NOT NULL").withColumn("bucket", text.length_bucket(F.col("tokens"))).where("bucket IS NOT NULL").select("post_id", "course_code", "bucket")
    return sampling.round_robin(t, "post_id", ["course_code", "bucket"], 200, "20251107", F.col("course_code") == "Q915")


def q_split_70_30(spark, d):
    t = _tokens(spark, d).where("course_code IS NOT NULL").select("post_id", "course_code")
    return sampling.split_by_share(t, "post_id", ["course_code"], 0.7, "20251107")


def q_chunk_index(spark, d):
    """Posts of the labels in chunks of five, in the order of their ids within a course."""
    from pyspark.sql.window import Window

    g = gold(spark, d).where("course_code IS NOT NULL")
    return g.withColumn("chunk", rows.chunk_of(F.dense_rank().over(Window.partitionBy("course_code").orderBy("post_id")), 5)).select("course_code", "post_id", "chunk")


def q_text_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


def q_preview(spark, d):
    return posts(spark, d).select("post_id", text.preview(F.col("selftext"), 80).alias("preview"))


def q_epoch_date(spark, d):
    return posts(spark, d).select("post_id", text.epoch_date(F.col("created_utc")).alias("created"), text.epoch_date(F.col("edited_utc")).alias("edited"))


def q_prompt_render(spark, d):
    return table(spark, d, "documents").select("doc_id", text.render("Course {course}: {body}", course=F.col("course_code"), body=F.col("text")).alias("prompt"))


def q_json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"), F.count(k).alias("n"))


def q_json_metadata(spark, d):
    """Posts whose extra metadata is an object, by number of its keys."""
    keys = F.size(F.json_object_keys("extra_metadata"))
    return posts(spark, d).where("extra_metadata IS NOT NULL").groupBy(F.coalesce(keys, F.lit(-1)).alias("n_keys")).agg(F.count(F.lit(1)).alias("n"))


def _responses(spark, d):
    """Model responses of every kind, made from the labels: plain, fenced, with prose, ambiguous, cut."""
    g = gold(spark, d).where("gold IS NOT NULL").select("post_id", "gold")
    body = F.format_string('{"contains_painpoint": "%s", "confidence": 0.5, "pain_points": [{"root_cause_summary": "c", "pain_point_snippet": "s"}]}', F.upper("gold"))
    kind = F.pmod(F.length("post_id") + F.ascii("post_id") + F.ascii(F.reverse("post_id")), F.lit(5))
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), body, F.lit(" Done."))).when(kind == 3, F.lit("contains_painpoint: y or contains_painpoint: n")).otherwise(F.concat(F.lit("contains_painpoint = "), F.col("gold"), F.lit(" {")))
    return g.select("post_id", "gold", kind.alias("kind"), raw.alias("raw"))


def q_parse_response(spark, d):
    return _responses(spark, d).select("post_id", parse.parse_response(F.col("raw")).alias("r")).select("post_id", "r.*")


def q_sentiment(spark, d):
    return posts(spark, d).select("post_id", F.round(compound(F.col("selftext")), 9).alias("compound"))


_TOK = "tok AS (SELECT *, CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(t) / 4) AS BIGINT)) END AS tokens FROM (SELECT *, regexp_replace(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || regexp_replace(coalesce(selftext, ''), '^\\s+|\\s+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM posts))"
_BUCKET = "CASE WHEN tokens BETWEEN 20 AND 149 THEN 'short' WHEN tokens BETWEEN 150 AND 299 THEN 'medium' WHEN tokens BETWEEN 300 AND 600 THEN 'long' END"


def _tok(body: str) -> str:
    head, _, tail = sql("\x00" + body, "posts").partition("\x00")
    return f"{head.rstrip()}, {_TOK} {tail}"


_QUANT = "count(tokens) AS n, CAST(min(tokens) AS BIGINT) AS least, CAST(max(tokens) AS BIGINT) AS most, round(avg(tokens), 6) AS mean, " + ", ".join(f"CAST(round_even(quantile_cont(tokens, {q}), 0) AS BIGINT) AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))
_WEIGHT = "CASE w " + " ".join(f"WHEN '{w}' THEN {x}" for w, x in WEIGHTS.items()) + " ELSE 0.0 END"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLE = {
    "q_length_profile": _tok(f"SELECT {_QUANT} FROM tok"),
    "q_length_profile_by_type": f"SELECT doc_type, {_QUANT} FROM (SELECT doc_type, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) END AS tokens FROM documents) GROUP BY 1",
    "q_length_histogram": _tok("SELECT b * 50 AS low, b * 50 + 49 AS high, count(t.tokens) AS n FROM (SELECT unnest(range(0, (SELECT max(tokens) // 50 FROM tok) + 1)) AS b) s LEFT JOIN tok t ON t.tokens // 50 = s.b GROUP BY b"),
    "q_bucket_counts": _tok(f"SELECT coalesce({_BUCKET}, 'none') AS bucket, count(*) AS n FROM tok GROUP BY 1"),
    "q_group_token_max": _tok("SELECT course_code, total FROM (SELECT course_code, CAST(sum(tokens) AS BIGINT) AS total, rank() OVER (ORDER BY sum(tokens) DESC) AS rk FROM tok WHERE course_code IS NOT NULL GROUP BY 1) WHERE rk = 1"),
    "q_sample_round_robin": _tok(f"SELECT post_id, course_code, bucket FROM (SELECT *, {_BUCKET} AS bucket FROM tok) WHERE bucket IS NOT NULL AND course_code = 'Q915' UNION ALL (SELECT post_id, course_code, bucket FROM (SELECT *, row_number() OVER (PARTITION BY course_code, bucket ORDER BY md5('20251107' || post_id), post_id) AS r FROM (SELECT *, {_BUCKET} AS bucket FROM tok) WHERE bucket IS NOT NULL AND course_code <> 'Q915') ORDER BY r, course_code, bucket, post_id LIMIT greatest(0, 200 - (SELECT count(*) FROM tok WHERE {_BUCKET} IS NOT NULL AND course_code = 'Q915')))"),
    "q_split_70_30": sql("SELECT post_id, course_code, CASE WHEN r <= greatest(1, least(round_even(n * 0.7, 0), n - 1)) THEN 'DEV' ELSE 'TEST' END AS part FROM (SELECT post_id, course_code, row_number() OVER (PARTITION BY course_code ORDER BY md5('20251107' || post_id), post_id) AS r, count(*) OVER (PARTITION BY course_code) AS n FROM posts WHERE course_code IS NOT NULL)", "posts"),
    "q_chunk_index": sql("SELECT course_code, post_id, CAST((dense_rank() OVER (PARTITION BY course_code ORDER BY post_id) - 1) // 5 + 1 AS INT) AS chunk FROM gold WHERE course_code IS NOT NULL", "gold"),
    "q_text_digest": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "q_preview": sql(r"SELECT post_id, CASE WHEN length(t) > 80 THEN t[1:79] || '…' ELSE t END AS preview FROM (SELECT post_id, regexp_replace(regexp_replace(regexp_replace(coalesce(selftext, ''), 'https?://[^ \t\n\f\r]+', '', 'g'), '[ \t\n\f\r]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM posts)", "posts"),
    "q_epoch_date": sql("SELECT post_id, CASE WHEN created_utc IS NOT NULL AND NOT isnan(created_utc) AND created_utc > 0 THEN strftime(make_timestamp(CAST(floor(created_utc * 1000000) AS BIGINT)), '%Y-%m-%d') ELSE '' END AS created, CASE WHEN edited_utc IS NOT NULL AND NOT isnan(edited_utc) AND edited_utc > 0 THEN strftime(make_timestamp(CAST(floor(edited_utc * 1000000) AS BIGINT)), '%Y-%m-%d') ELSE '' END AS edited FROM posts", "posts"),
    "q_prompt_render": "SELECT doc_id, replace(replace('Course {course}: {body}', '{course}', coalesce(course_code, '')), '{body}', coalesce(text, '')) AS prompt FROM documents",
    "q_json_props": "SELECT event_type, CAST(sum(k) AS BIGINT) AS total, max(k) AS most, count(k) AS n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "q_json_metadata": sql("SELECT CAST(CASE WHEN json_valid(extra_metadata) AND json_type(extra_metadata) = 'OBJECT' THEN len(json_keys(extra_metadata)) ELSE -1 END AS INT) AS n_keys, count(*) AS n FROM posts WHERE extra_metadata IS NOT NULL GROUP BY 1", "posts"),
    "q_parse_response": sql("SELECT post_id, CASE WHEN kind = 3 THEN 'u' WHEN gold IN ('y', 'n', 'u') THEN gold ELSE 'u' END AS label, CASE WHEN kind < 3 AND gold = 'y' THEN 'c' ELSE '' END AS summary, CASE WHEN kind < 3 AND gold = 'y' THEN 's' ELSE '' END AS snippet, CAST(CASE WHEN kind < 3 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS confidence, kind >= 3 AS parse_error, kind >= 3 OR gold NOT IN ('y', 'n', 'u') AS schema_error, kind >= 3 AS used_fallback FROM (SELECT post_id, gold, (length(post_id) + ascii(post_id) + ascii(reverse(post_id))) % 5 AS kind FROM gold WHERE gold IS NOT NULL)", "gold"),
    "q_sentiment": sql(f"SELECT post_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 9) AS compound FROM posts LEFT JOIN (SELECT post_id, sum(CASE WHEN p IN {NEGATIONS} THEN CAST({_WEIGHT} AS DOUBLE) * -0.74::DOUBLE WHEN p IN {STRONGER} THEN CAST({_WEIGHT} AS DOUBLE) * 1.29::DOUBLE WHEN p IN {WEAKER} THEN CAST({_WEIGHT} AS DOUBLE) * 0.71::DOUBLE ELSE CAST({_WEIGHT} AS DOUBLE) END ORDER BY i) AS s FROM (SELECT post_id, i, ws[i] AS w, ws[i - 1] AS p FROM (SELECT post_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT post_id, regexp_extract_all(lower(coalesce(selftext, '')), '[a-z]+') AS ws FROM posts))) GROUP BY 1) USING (post_id)", "posts"),
}
