"""Further operators: threads, classifier stub, mappings, ordered lists, overlaps, grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import classify, filters, rows
from quernstone.operators.threads import thread
from quernstone.plans.base import gold, pains, posts, sql
from quernstone.sources.tables import table

_WORDS = ("broken", "stuck", "unclear", "freezes", "useless")


def q_thread_tree(spark, d):
    """Orders as threads: three first orders of a customer, and of each the first three lines."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent"))
    n = table(spark, d, "lineitem").select(F.concat_ws("_", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent"))
    return thread(o.unionByName(n), "id", "parent", F.startswith("parent", F.lit("c")), [F.asc("id")]).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("parent").alias("parents"))


def q_classify_stub(spark, d):
    """Every post through the rule client, its answers read strictly."""
    p = posts(spark, d).select("post_id", "title", "selftext")
    prompt = text.render("Post: {body}", body=text.assemble(F.col("title"), F.col("selftext")))
    return classify.classify(p, prompt, classify.RuleClient(_WORDS)).select("post_id", "label", "summary", "confidence", "parse_error", "llm_failure")


def q_error_counters(spark, d):
    from quernstone.functions.parse import parse_response
    from quernstone.plans.profiling import _responses

    r = _responses(spark, d).select(parse_response(F.col("raw")).alias("r")).select("r.*")
    return r.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("parse_error", "schema_error", "used_fallback")])


def q_submission_mapping(spark, d):
    """Stored posts as submissions map to flags, type and link."""
    p = posts(spark, d)
    link = F.when(F.startswith("permalink", F.lit("/")), F.concat(F.lit("https://forum.example"), F.col("permalink"))).otherwise(F.col("permalink"))
    return p.select("post_id", F.when(F.col("username").isNull() | (F.col("username") == "[deleted]"), 1).otherwise(0).alias("author_gone"), F.when(F.col("selftext") == "[removed]", 1).otherwise(0).alias("text_gone"), F.coalesce(F.nullif(link, F.lit("")), F.col("url")).alias("best_url"))


def q_pain_ids(spark, d):
    """Ids COURSE_POST of pain points, and whether they are well formed."""
    pid = F.concat("course_code", F.lit("_"), F.col("post_id"))
    return pains(spark, d).select(pid.alias("pain_id"), pid.rlike("^[A-Z0-9]+_[a-z0-9]+$").alias("valid"))


def q_both_blank(spark, d):
    """Pain points with at least one text."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return table(spark, d, "painpoints").where(~(blank("root_cause_summary") & blank("pain_point_snippet"))).groupBy(blank("pain_point_snippet").alias("no_snippet")).agg(F.count(F.lit(1)).alias("n"))


def q_group_lists(spark, d):
    """Pain points of a course as one ordered list: how many, and the first and last of it."""
    return pains(spark, d).groupBy("course_code").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("post_id").alias("first_post"), F.max("post_id").alias("last_post"))


def q_zip_examples(spark, d):
    """First four snippets of a course beside their ids."""
    four = rows.cap_children(pains(spark, d).where("pain_point_snippet IS NOT NULL"), "course_code", [F.asc("post_id"), F.asc("pain_point_snippet")], 4)
    g = four.groupBy("course_code").agg(F.array_sort(F.collect_list(F.struct("post_id", "pain_point_snippet"))).alias("l"))
    pairs = F.slice(F.arrays_zip(F.col("l.post_id").alias("i"), F.col("l.pain_point_snippet").alias("s")), 1, 4)
    return g.select("course_code", F.array_join(F.transform(pairs, lambda x: F.concat(x["i"], F.lit(":"), text.preview(x["s"], 12))), "|").alias("examples"))


def q_split_overlap(spark, d):
    """Posts whose labels stand in both splits."""
    g = table(spark, d, "gold_labels").select(F.trim("post_id").alias("post_id"), F.upper(F.trim("split")).alias("split"))
    return g.where("split = 'DEV'").select("post_id").intersect(g.where("split = 'TEST'").select("post_id"))


def q_length_range(spark, d):
    return posts(spark, d).withColumn("tokens", text.token_count(F.col("selftext"))).where(F.col("tokens").between(100, 200)).groupBy("course_code").agg(F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("mean"))


def q_like_board(spark, d):
    """Posts whose permalink names a board, whatever the case."""
    return posts(spark, d).where(F.lower("permalink").like("%/comments/%")).groupBy("post_type").agg(F.count(F.lit(1)).alias("n"))


def q_truthy_flags(spark, d):
    g = table(spark, d, "gold_labels")
    narrow, wide = text.truthy(F.col("ambiguity_flag")), text.truthy(F.col("contains_painpoint"), ("1", "true", "t", "yes", "y"))
    return g.groupBy(narrow.alias("ambiguous"), wide.alias("positive")).agg(F.count(F.lit(1)).alias("n"))


def q_mean_tokens_by_set(spark, d):
    """Mean tokens of all posts and of each labelled set; empty sets are left out."""
    t = posts(spark, d).select("post_id", text.token_count(F.col("selftext")).alias("tokens")).where("tokens > 0")
    sets = gold(spark, d).where("split IN ('DEV', 'TEST')").select("post_id", "split")
    full = t.agg(F.lit("FULL").alias("dataset"), F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("mean"))
    return full.unionByName(t.join(sets, "post_id").groupBy(F.col("split").alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("mean")))


def q_board_rules(spark, d):
    """Boards with their number of rules."""
    return table(spark, d, "subreddits").select("subreddit_id", F.coalesce(F.json_array_length("rules"), F.lit(0)).alias("n_rules"))


def q_board_counts(spark, d):
    """Posts and authors of every board in the dimension table."""
    p = posts(spark, d).select("subreddit_id", "post_id", "username")
    b = table(spark, d, "subreddits").select("subreddit_id", "is_nsfw")
    return b.join(p, "subreddit_id", "left").groupBy("subreddit_id", "is_nsfw").agg(F.count("post_id").alias("posts"), F.countDistinct("username").alias("authors"))


def q_grouping_sets(spark, d):
    """Posts by type and flair with all subtotals."""
    p = posts(spark, d).select(F.coalesce("post_type", F.lit("none")).alias("post_type"), F.coalesce("flair", F.lit("none")).alias("flair"))
    return p.cube("post_type", "flair").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def q_code_any_count(spark, d):
    """Posts by the number of distinct known courses they mention."""
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    m = filters.match_codes(posts(spark, d), "post_id", body, table(spark, d, "courses"), "coursecode", None)
    return m.groupBy(F.size("matched").alias("codes")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
_BODY = "CASE WHEN coalesce(selftext, '') = '' THEN coalesce(title, '') WHEN coalesce(title, '') = '' THEN selftext ELSE title || chr(10) || chr(10) || selftext END"
_TOK = "CASE WHEN coalesce(selftext, '') = '' THEN 0 ELSE greatest(1, CAST(ceil(length(selftext) / 4) AS BIGINT)) END"
_PREVIEW = r"regexp_replace(regexp_replace(regexp_replace(pain_point_snippet, 'https?://[^ \t\n\f\r]+', '', 'g'), '[ \t\n\f\r]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
ORACLE = {
    "q_thread_tree": "WITH o AS (SELECT * FROM (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY 'o' || o_orderkey) AS rn FROM orders) WHERE rn <= 3), n AS (SELECT * FROM (SELECT 'l_' || l_orderkey || '_' || l_linenumber AS id, 'o' || l_orderkey AS parent, row_number() OVER (PARTITION BY l_orderkey ORDER BY 'l_' || l_orderkey || '_' || l_linenumber) AS rn FROM lineitem) WHERE rn <= 3 AND parent IN (SELECT id FROM o)) SELECT CAST(1 AS INT) AS level, count(*) AS n, count(DISTINCT parent) AS parents FROM o UNION ALL SELECT CAST(2 AS INT), count(*), count(DISTINCT parent) FROM n",
    "q_classify_stub": sql(f"SELECT post_id, label, CASE WHEN label = 'y' THEN 'rule' ELSE '' END AS summary, CAST(1.0 AS DOUBLE) AS confidence, false AS parse_error, false AS llm_failure FROM (SELECT post_id, CASE WHEN regexp_matches({_BODY}, '(?i)\\b(?:{'|'.join(_WORDS)})\\b') THEN 'y' ELSE 'n' END AS label FROM posts)", "posts"),
    "q_error_counters": sql("SELECT count(*) AS n, count(*) FILTER (kind >= 3) AS parse_error, count(*) FILTER (kind >= 3 OR gold NOT IN ('y', 'n', 'u')) AS schema_error, count(*) FILTER (kind >= 3) AS used_fallback FROM (SELECT gold, (length(post_id) + ascii(post_id) + ascii(reverse(post_id))) % 5 AS kind FROM gold WHERE gold IS NOT NULL)", "gold"),
    "q_submission_mapping": sql("SELECT post_id, CASE WHEN username IS NULL OR username = '[deleted]' THEN 1 ELSE 0 END AS author_gone, CASE WHEN selftext = '[removed]' THEN 1 ELSE 0 END AS text_gone, coalesce(nullif(CASE WHEN starts_with(permalink, '/') THEN 'https://forum.example' || permalink ELSE permalink END, ''), url) AS best_url FROM posts", "posts"),
    "q_pain_ids": sql("SELECT course_code || '_' || post_id AS pain_id, regexp_full_match(course_code || '_' || post_id, '[A-Z0-9]+_[a-z0-9]+') AS valid FROM pains", "pains"),
    "q_both_blank": "SELECT trim(coalesce(pain_point_snippet, '')) = '' AS no_snippet, count(*) AS n FROM painpoints WHERE NOT (trim(coalesce(root_cause_summary, '')) = '' AND trim(coalesce(pain_point_snippet, '')) = '') GROUP BY 1",
    "q_group_lists": sql("SELECT course_code, CAST(count(*) AS INT) AS n, min(post_id) AS first_post, max(post_id) AS last_post FROM pains GROUP BY 1", "pains"),
    "q_zip_examples": sql(f"SELECT course_code, string_agg(post_id || ':' || CASE WHEN length(s) > 12 THEN s[1:11] || '…' ELSE s END, '|' ORDER BY rn) AS examples FROM (SELECT course_code, post_id, {_PREVIEW} AS s, row_number() OVER (PARTITION BY course_code ORDER BY post_id) AS rn FROM pains WHERE pain_point_snippet IS NOT NULL) WHERE rn <= 4 GROUP BY 1", "pains"),
    "q_split_overlap": "SELECT trim(post_id) AS post_id FROM gold_labels WHERE upper(trim(split)) = 'DEV' INTERSECT SELECT trim(post_id) FROM gold_labels WHERE upper(trim(split)) = 'TEST'",
    "q_length_range": sql(f"SELECT course_code, count(*) AS n, avg(tokens) AS mean FROM (SELECT course_code, {_TOK} AS tokens FROM posts) WHERE tokens BETWEEN 100 AND 200 GROUP BY 1", "posts"),
    "q_like_board": sql("SELECT post_type, count(*) AS n FROM posts WHERE lower(permalink) LIKE '%/comments/%' GROUP BY 1", "posts"),
    "q_truthy_flags": "SELECT lower(trim(coalesce(ambiguity_flag, ''))) IN ('true', '1', 'y', 'yes') AS ambiguous, lower(trim(coalesce(contains_painpoint, ''))) IN ('1', 'true', 't', 'yes', 'y') AS positive, count(*) AS n FROM gold_labels GROUP BY 1, 2",
    "q_mean_tokens_by_set": sql(f"SELECT 'FULL' AS dataset, count(*) AS n, avg(tokens) AS mean FROM (SELECT {_TOK} AS tokens FROM posts) WHERE tokens > 0 UNION ALL SELECT split, count(*), avg(tokens) FROM (SELECT post_id, {_TOK} AS tokens FROM posts) JOIN gold USING (post_id) WHERE tokens > 0 AND split IN ('DEV', 'TEST') GROUP BY 1", "posts", "gold"),
    "q_board_rules": "SELECT subreddit_id, CAST(coalesce(CASE WHEN json_valid(rules) THEN CASE WHEN json_type(rules) = 'ARRAY' THEN json_array_length(rules) END END, 0) AS INT) AS n_rules FROM subreddits",
    "q_board_counts": sql("SELECT s.subreddit_id, s.is_nsfw, count(p.post_id) AS posts, count(DISTINCT p.username) AS authors FROM subreddits s LEFT JOIN posts p ON s.subreddit_id = p.subreddit_id GROUP BY 1, 2", "posts"),
    "q_grouping_sets": sql("SELECT post_type, flair, count(*) AS n, CAST(grouping_id(post_type, flair) AS INT) AS level FROM (SELECT coalesce(post_type, 'none') AS post_type, coalesce(flair, 'none') AS flair FROM posts) GROUP BY CUBE (post_type, flair)", "posts"),
    "q_code_any_count": sql(
        r"""SELECT CAST(k AS INT) AS codes, count(*) AS n FROM (SELECT post_id, count(*) AS k FROM posts, (SELECT code, CASE WHEN regexp_full_match(code, '[A-Z]+[0-9]+') THEN regexp_replace(code, '^([A-Z]+)', '\1[ -]?') ELSE code END AS p
        FROM (SELECT DISTINCT regexp_replace(upper(coursecode), '[- ]', '', 'g') AS code FROM courses) WHERE length(code) >= 2)
        WHERE regexp_matches(upper(coalesce(title, '') || ' ' || coalesce(selftext, '')), '(^|[^A-Z0-9])' || p || '($|[^A-Z0-9])') GROUP BY post_id) GROUP BY 1""",
        "posts",
    ),
}
