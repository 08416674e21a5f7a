"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import abuse, bpe, leaks, lookalikes, nearduplicates, pii, spans, splits
from quernstone.sources.tables import table

FULL_POST_WORDS = 20


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose labelled records stand in more than one split."""
    return splits.leaking_keys(table(spark, d, "gold_labels"), table(spark, d, "stage0_filtered_posts"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled record with its component and its new split."""
    return splits.linked_splits(table(spark, d, "gold_labels"), table(spark, d, "stage0_filtered_posts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts with abusive, hateful or sexually explicit language."""
    return abuse.post_scores(table(spark, d, "stage0_filtered_posts")).where(F.col("score") >= abuse.CASE).select("post_id")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every post's score and category."""
    return abuse.post_scores(table(spark, d, "stage0_filtered_posts"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Every board's rate of such posts."""
    return abuse.source_rates(table(spark, d, "stage0_filtered_posts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of full posts that are near-duplicates."""
    return nearduplicates.similar_pairs(table(spark, d, "stage0_filtered_posts"), "post_id", "title", "selftext")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every post's group of near-duplicates."""
    return nearduplicates.similar_groups(table(spark, d, "stage0_filtered_posts"), "post_id", "title", "selftext")


_PERSONAL = {"stage0_filtered_posts": "selftext", "painpoints": "pain_point_snippet"}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Types of personal information in any row of a post."""
    parts = [pii.types_found(table(spark, d, name), "post_id", column).select(F.lit(name).alias("table_name"), "post_id", "pii_type") for name, column in _PERSONAL.items()]
    return parts[0].unionByName(parts[1])


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every stored text with placeholders for personal information."""
    parts = []
    for name, column in _PERSONAL.items():
        df = table(spark, d, name)
        parts.append(df.select(F.lit(name).alias("table_name"), "post_id", pii.redacted(df, column)["text"].alias("text")))
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Full posts that look the same and are stored differently."""
    return lookalikes.same_look(table(spark, d, "stage0_filtered_posts"), "post_id", ["title", "selftext"], "selftext", FULL_POST_WORDS)


def p6_seen(spark: SparkSession, d: str) -> DataFrame:
    """Title and selftext of every stored row in one consistent form."""
    posts = table(spark, d, "stage0_filtered_posts").select("post_id", "title", "selftext")
    return lookalikes.with_seen(posts, ["title", "selftext"]).select("post_id", "title_seen", "selftext_seen")


def tokenizer_file(name: str) -> str:
    """A public vocabulary: in the folder TOKENIZER_DIR names, else beside the installed files."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.environ.get("TOKENIZER_DIR") or (os.path.dirname(spec.origin) if spec else "/opt/tokenizers")
    return os.path.join(folder, name)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return bpe.encode_table(table(spark, d, "documents"), "doc_id", "text", tokenizer_file("byte_bpe_50k.tiktoken"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items that stand fully or partly in a document."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id").select("doc_id", "item_id")


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents without any benchmark item, with their text; the others are removed."""
    docs = table(spark, d, "documents")
    keep = leaks.cleaned(docs, table(spark, d, "benchmark"), "doc_id", "item_id").where("keep").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select("doc_id", "text")


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the passages of benchmark items."""
    return leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a passage of at least 150 characters."""
    return spans.shared_windows(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Of every document the share found elsewhere, and the passages as start-stop in code points."""
    found = spans.shared_spans(table(spark, d, "documents"), "doc_id", "text")
    listed = F.array_join(F.transform("passages", lambda p: F.concat_ws("-", p["start"].cast("string"), p["stop"].cast("string"))), ",")
    return found.withColumn("passages", listed)


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document without sentences that a repeated run, but for its first place, covers."""
    return spans.without_repeats(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p2_found, p2_scores, p2_rates, p3_found, p3_groups, p4_found, p4_redacted, p6_found, p6_seen, p7_ids, p8_found, p8_kept, p8_cleaned, p9_found, p9_spans, p9_cleaned)}
_CODE = r"nullif(regexp_replace(upper(course_code), '[^\p{L}\p{N}]', '', 'g'), '')"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_RECORD = "concat_ws(chr(31), " + ", ".join(rf"coalesce({c}, '\N')" for c in ("post_id", "split", "course_code", "contains_painpoint", "root_cause_summary", "ambiguity_flag", "labeler_id", "notes")) + ")"
_HITS = f"""WITH i AS (SELECT item_id, ws, least(12, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL) WHERE len(ws) > 0),
        g AS (SELECT DISTINCT item_id, k, array_to_string(ws[j : j + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS j FROM i)),
        d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, j, k, array_to_string(ws[j : j + k - 1], ' ') AS gram FROM (SELECT d.*, n.k, unnest(range(1, len(ws) - n.k + 2)) AS j FROM d, (SELECT DISTINCT k FROM g) n WHERE len(ws) >= n.k)),
        hits AS (SELECT DISTINCT doc_id, item_id, j, k FROM w JOIN g USING (k, gram))"""
_SHARED = """WITH w AS (SELECT doc_id, j, md5(substr(text, j, 150)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) AS j FROM documents WHERE length(text) >= 150)),
        shared AS (SELECT doc_id, j FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1))"""
ORACLE = {
    "p1_splits": f"""WITH RECURSIVE g AS (SELECT row_number() OVER () AS r, *, nullif(trim(post_id), '') AS p, {_CODE} AS c FROM gold_labels),
        k AS (SELECT r, 'post_id:' || p AS k FROM g WHERE p IS NOT NULL UNION ALL SELECT r, 'course_code:' || c FROM g WHERE c IS NOT NULL
            UNION ALL SELECT r, 'username:' || username FROM g JOIN (SELECT DISTINCT post_id AS p, username FROM stage0_filtered_posts WHERE username IS NOT NULL AND username <> '[deleted]') USING (p)),
        e AS (SELECT DISTINCT a.k AS a, b.k AS b FROM k a JOIN k b USING (r)),
        reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
        comp AS (SELECT a AS k, min(b) AS component FROM reach GROUP BY 1),
        placed AS (SELECT g.*, coalesce(m.component, 'record:' || md5({_RECORD})) AS component FROM g LEFT JOIN (SELECT r, min(component) AS component FROM k JOIN comp USING (k) GROUP BY 1) m USING (r)),
        s AS (SELECT component, count(*) AS n, ('0x' || substr(md5(component), 1, 15))::BIGINT AS h FROM placed GROUP BY 1),
        t AS (SELECT component, (sum(n) OVER (ORDER BY h, component) - n / 2.0::DOUBLE) / sum(n) OVER () AS m FROM s)
        SELECT placed.* EXCLUDE (r, p, c), CASE WHEN m < 0.8 THEN 'train' WHEN m < 0.9 THEN 'validation' ELSE 'test' END AS new_split FROM placed JOIN t USING (component)""",
    "p1_found": f"""WITH g AS (SELECT nullif(trim(post_id), '') AS p, {_CODE} AS c, nullif(upper(trim(split)), '') AS s FROM gold_labels),
        u AS (SELECT DISTINCT post_id AS p, username AS u FROM stage0_filtered_posts WHERE username IS NOT NULL AND username <> '[deleted]'),
        k AS (SELECT 'post_id' AS key_kind, p AS key_value, s FROM g UNION ALL SELECT 'course_code', c, s FROM g UNION ALL SELECT 'username', u, s FROM g JOIN u USING (p))
        SELECT key_kind, key_value FROM k WHERE key_value IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT s) > 1""",
    "p8_found": f"{_HITS} SELECT DISTINCT doc_id, item_id FROM hits",
    "p8_kept": f"{_HITS} SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)",
    "p8_cleaned": f"""{_HITS}, t AS (SELECT doc_id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS ts FROM documents WHERE doc_id IN (SELECT doc_id FROM hits))),
        n AS (SELECT *, regexp_matches(t, '^[\\p{{L}}\\p{{N}}]') AS is_word, sum(CASE WHEN regexp_matches(t, '^[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS w FROM t),
        x AS (SELECT n.doc_id, n.i, n.t, bool_or(coalesce(CASE WHEN is_word THEN n.w BETWEEN h.j AND h.j + h.k - 1 ELSE n.w >= h.j AND n.w < h.j + h.k - 1 END, false)) AS gone FROM n LEFT JOIN hits h USING (doc_id) GROUP BY 1, 2, 3)
        SELECT doc_id, coalesce(string_agg(t, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM x GROUP BY 1
        UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)""",
    "p9_found": f"{_SHARED} SELECT DISTINCT doc_id FROM shared",
    "p9_spans": f"""{_SHARED}, f AS (SELECT *, CASE WHEN j <= lag(j) OVER (PARTITION BY doc_id ORDER BY j) + 150 THEN 0 ELSE 1 END AS fresh FROM shared),
        i AS (SELECT doc_id, j, sum(fresh) OVER (PARTITION BY doc_id ORDER BY j) AS k FROM f),
        p AS (SELECT doc_id, min(j) - 1 AS a, max(j) + 149 AS b FROM i GROUP BY doc_id, k),
        s AS (SELECT doc_id, sum(b - a) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS l FROM p GROUP BY 1)
        SELECT doc_id, length(text) AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, coalesce(n / length(text), 0.0)::DOUBLE AS share, coalesce(l, '') AS passages FROM documents LEFT JOIN s USING (doc_id)""",
}
