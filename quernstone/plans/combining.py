"""Runs combined, labels taken up again, and the finer parts of clusters, issues and serving."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import text
from quernstone.functions.codes import code_key
from quernstone.functions.text import split_multi
from quernstone.operators import clusters, filters, labelling, reports, rows, runs, search
from quernstone.operators import evaluation as ev
from quernstone.plans.base import gold, index, pains, posts, predictions, sql
from quernstone.schemas import ISSUE_FAMILIES, issue_families
from quernstone.sources.files import college_pairs, nonblank_ids
from quernstone.sources.tables import table


# ------------------------------------------------------------------ runs
def _runs(spark, d):
    """Two runs' predictions, the second without texts of its own."""
    p = predictions(spark, d)
    one = p.select("post_id", "course_code", F.upper("gold").alias("true_contains_painpoint"), F.concat(F.lit(" "), F.upper("pred_old")).alias("pred_contains_painpoint"), F.lit("True").alias("parse_error"))
    two = p.select("post_id", F.col("gold").alias("true_contains_painpoint"), F.col("pred_new").alias("pred_contains_painpoint"))
    return [("run_a", runs.normalised(one)), ("run_b", runs.normalised(two))]


def _run_index(spark):
    return spark.createDataFrame([("run_a", "rules", "short", "short_v1.txt", "DEV"), ("run_b", "rules", "long", "long_v2.txt", "dev "), ("run_c", "other", "long", "long_v2.txt", "TEST")], "run_id string, model string, prompt string, prompt_file string, split string")


def q_runs_union(spark, d):
    """Rows of all runs, labels normalised, by run, label and flag."""
    return runs.union_runs(_runs(spark, d)).groupBy("run_id", "pred_contains_painpoint", "parse_error", F.col("course_code") == "").agg(F.count(F.lit(1)).alias("n")).toDF("run_id", "label", "parse_error", "no_course", "n")


def q_runs_picked(spark, d):
    """Runs of the DEV split whose prompt is named, by name or file, with their rows."""
    picked = runs.pick_runs(_run_index(spark), "dev", ["rules"], ["long_v2.txt"])
    return runs.union_runs(_runs(spark, d)).join(picked, "run_id").groupBy("run_id", "prompt").agg(F.count(F.lit(1)).alias("n"))


def q_runs_outcomes(spark, d):
    """Outcomes of every run in capitals, without those that are ignored."""
    o = runs.union_runs(_runs(spark, d)).withColumn("outcome", runs.outcome(F.col("true_contains_painpoint"), F.col("pred_contains_painpoint")))
    return o.where("outcome <> 'IGNORE'").groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def q_runs_false_positives(spark, d):
    """False positives of all runs with the run's model and prompt."""
    u = runs.union_runs(_runs(spark, d)).where("true_contains_painpoint = 'n' AND pred_contains_painpoint = 'y'")
    return u.join(F.broadcast(_run_index(spark)), "run_id").select("run_id", "model", "prompt", "post_id")  # a few runs


def q_runs_paired(spark, d):
    """Labels of two runs of the same posts side by side, joined by post."""
    a, b = (df.select("post_id", F.col("true_contains_painpoint").alias("gold"), F.col("pred_contains_painpoint").alias("label")) for _, df in _runs(spark, d))
    return ev.pair(a, b).groupBy("gold", "old", "new").agg(F.count(F.lit(1)).alias("n"))


def q_runs_by_post(spark, d):
    """Each post's rows of all runs as one ordered list."""
    u = runs.union_runs(_runs(spark, d)).select("post_id", "run_id", F.col("pred_contains_painpoint").alias("label"))
    return runs.rows_by_key(u, "post_id", ["run_id"]).select("post_id", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["run_id"], r["label"])), ",").alias("labels"))


def q_post_chunks(spark, d):
    """All posts of all runs in chunks of five, in the order of their ids."""
    ids = runs.union_runs(_runs(spark, d)).select("post_id").distinct()
    return rows.rank_all(ids, "post_id").select("post_id", rows.chunk_of(F.col("rank"), 5).alias("chunk"))


def q_mcnemar_log(spark, d):
    """The paired test's p as a logarithm, so that small ones differ."""
    return ev.paired(predictions(spark, d), F.col("gold"), F.col("pred_old"), F.col("pred_new")).select("b", "c", F.round("log10_p", 6).alias("log10_p"))


def q_label_shift_test(spark, d):
    return ev.label_shift(predictions(spark, d), F.col("pred_old"), F.col("pred_new")).select(F.round("chi2", 6).alias("chi2"), "dof", F.round(F.log10("p_value"), 6).alias("log10_p"), "shifted")


def q_invariants(spark, d):
    """Records held to their invariants: errors are undecided, confidences within bounds."""
    p = predictions(spark, d).select("post_id", F.col("pred_new").alias("label"), (F.col("num_comments") / 20).alias("confidence"), (F.col("gold") == "u").alias("parse_error"), F.lit(False).alias("schema_error"), F.col("vader_compound").isNull().alias("llm_failure"))
    return runs.held_to_invariants(p, "1.0.0").groupBy("label", "schema_version").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == 0).alias("zero"))


def q_confidence_clamp(spark, d):
    """Numbers as text clamped into 0..1: above 1 it is 1, what is no number is 0."""
    raw = F.when(F.col("score") % 7 == 0, F.lit("high")).when(F.col("score") % 7 == 1, F.lit("NaN")).otherwise((F.col("score") / 100).cast("string"))
    return posts(spark, d).where("score IS NOT NULL").select("post_id", filters.clamp_confidence(raw).alias("confidence"))


# ------------------------------------------------------------------ labels
def q_gold_eligible(spark, d):
    """Labels y or n of the TEST split."""
    return runs.eligible_labels(table(spark, d, "gold_labels"), "test").groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("post_id").alias("posts"))


def q_labels_left(spark, d):
    """Posts of labelled courses that have no label yet."""
    g = table(spark, d, "gold_labels").withColumn("post_id", F.trim("post_id"))
    courses = g.select(code_key(F.col("course_code")).alias("course_code")).where("course_code IS NOT NULL").distinct()
    return labelling.remaining(posts(spark, d).join(courses, "course_code", "left_semi"), g).groupBy("course_code").agg(F.count(F.lit(1)).alias("left"))


def q_label_order(spark, d):
    """Labels ranked as the label file orders them: DEV first, then course and post."""
    order = [F.when(F.col("split") == "DEV", 0).otherwise(1), F.asc_nulls_first("course_code"), F.asc("post_id")]
    return rows.rank_all(gold(spark, d), *order).select("post_id", F.col("rank").cast("bigint").alias("rank"))


def q_gold_present(spark, d):
    """The first forty labelled posts, in order, that are stored."""
    present, _ = rows.known_in_order(gold(spark, d).select("post_id"), posts(spark, d), "post_id", ["post_id"], 40)
    return present


def q_gold_missing(spark, d):
    """Labelled posts that are not stored."""
    return rows.known_in_order(gold(spark, d).select("post_id"), posts(spark, d), "post_id", ["post_id"])[1]


def q_length_bounds(spark, d):
    """Posts of every length bucket within the default bounds of tokens, and within bounds that a profile gives."""
    from quernstone.operators.profile import length_bounds

    t = posts(spark, d).withColumn("tokens", text.token_count(text.assemble_stripped(F.col("title"), F.col("selftext"))))
    own, given = length_bounds(None), length_bounds('{"bounds": {"min_tokens": 100}}')
    return t.groupBy(F.coalesce(text.length_bucket(F.col("tokens")), F.lit("none")).alias("bucket")).agg(F.count_if(filters.within(F.col("tokens"), own)).alias("n"), F.count_if(filters.within(F.col("tokens"), given)).alias("narrow"))


# ------------------------------------------------------------------ clusters and issues
def _labels(spark, d):
    """Issues with made-up labels: of clusters, of issues, some blank."""
    i = index(spark, d).where("global_cluster_id IS NOT NULL AND cluster_id IS NOT NULL")
    return i.select("cluster_id", "global_cluster_id").distinct().withColumn("provisional_label", F.concat(F.lit("part "), F.right("global_cluster_id", F.lit(1)))).withColumn("normalized_issue_label", F.when(F.ascii(F.reverse("cluster_id")) % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("issue "), "global_cluster_id")))


def q_issue_fields(spark, d):
    """Issues nested in one document and flattened into their seven fields; the description is missing there."""
    i = index(spark, d).where("global_cluster_id IS NOT NULL").groupBy("global_cluster_id").agg(F.countDistinct("post_id").alias("total_num_posts"), F.countDistinct("cluster_id").alias("num_clusters"), F.countDistinct("course_code").alias("num_courses"))
    named = i.withColumn("normalized_issue_label", F.concat(F.lit("issue "), "global_cluster_id")).withColumn("provisional_label", F.lower("global_cluster_id"))
    nested = named.groupBy(F.substring("global_cluster_id", 1, 1).alias("file")).agg(F.collect_list(F.struct(*named.columns)).alias("global_clusters"))
    return clusters.flatten_issues(nested)


def q_issue_families(spark, d):
    """Families of issues with the number of issues that fall to each, here by the issues' names."""
    i = index(spark, d).where("global_cluster_id IS NOT NULL").select("global_cluster_id").distinct().withColumn("place", F.ascii(F.reverse("global_cluster_id")) % 8 + 1)
    return issue_families(spark).join(i, "place", "left").groupBy("label", "place").agg(F.count("global_cluster_id").alias("issues"))


def q_merge_by_labels(spark, d):
    """Batch groups merged by both their labels: members joined, the first batch's description."""
    g = _labels(spark, d).withColumn("batch", F.ascii(F.reverse("cluster_id")) % 4)
    groups = g.groupBy("provisional_label", "normalized_issue_label", "batch").agg(F.collect_set("cluster_id").alias("members"), F.concat(F.lit("from batch "), F.first("batch").cast("string")).alias("description"))
    return clusters.merge(groups, ("provisional_label", "normalized_issue_label")).select("provisional_label", "normalized_issue_label", F.array_join("members", ";").alias("members"), "description")


def q_labelled_members(spark, d):
    """Memberships with the label to show: the issue's, else the cluster's, else a constant."""
    known = _labels(spark, d).where(F.ascii(F.reverse("cluster_id")) % 5 != 0)
    m = reports.with_index(index(spark, d).select("post_id", "cluster_id", "global_cluster_id"), known)
    return m.groupBy(reports.display_label(F.col("normalized_issue_label"), F.col("provisional_label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def q_cluster_summaries(spark, d):
    """Cluster detail with the least root cause of its posts as its summary."""
    s = index(spark, d).join(pains(spark, d).select("post_id", "root_cause_summary"), "post_id").select("cluster_id", F.col("root_cause_summary").alias("issue_summary"))
    return reports.with_summaries(reports.cluster_detail(index(spark, d), pains(spark, d)), s).select("course_code", "cluster_id", "n_rows", "issue_summary")


def _files(spark, d):
    """Cluster files with what can be wrong in them: totals, summaries, courses, missing lists."""
    i = index(spark, d).where("course_code IS NOT NULL AND cluster_id IS NOT NULL AND post_id IS NOT NULL")
    per = i.groupBy("course_code", "cluster_id").agg(F.array_sort(F.collect_set("post_id")).alias("post_ids"))
    odd = F.ascii(F.reverse("cluster_id")) % 6
    one = F.struct("cluster_id", F.when(odd == 1, F.lit("XX0")).otherwise(F.col("course_code")).alias("course_code"), F.when(odd == 2, F.lit(" ")).otherwise(F.lit("a summary")).alias("issue_summary"), (F.size("post_ids") + F.when(odd == 3, 1).otherwise(0)).alias("num_posts"), "post_ids")
    return per.groupBy("course_code").agg(F.sum(F.size("post_ids")).alias("total_posts"), F.collect_list(one).alias("clusters")).withColumn("clusters", F.when(F.col("course_code").endswith("0"), F.lit(None)).otherwise(F.col("clusters")))


def q_check_files(spark, d):
    """Broken rules of cluster files, by rule."""
    broken, _, _ = clusters.check_files(_files(spark, d), pains(spark, d), table(spark, d, "courses").select(F.col("coursecode").alias("course_code")))
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("course_code").alias("courses"))


def q_check_totals(spark, d):
    """Files whose stated total is not the number of distinct posts, with that number."""
    return clusters.check_files(_files(spark, d), pains(spark, d), table(spark, d, "courses").select(F.col("coursecode").alias("course_code")))[1]


def q_check_skipped(spark, d):
    """Cluster files of unknown courses."""
    return clusters.check_files(_files(spark, d), pains(spark, d), table(spark, d, "courses").select(F.col("coursecode").alias("course_code")))[2]


# ------------------------------------------------------------------ reports
def _college_cells(spark, d):
    single = table(spark, d, "courses").select(F.col("coursecode").alias("course_code"), split_multi(F.col("colleges")).alias("c")).where(F.size("c") == 1).select("course_code", F.col("c")[0].alias("college"))
    return index(spark, d).where("global_cluster_id IS NOT NULL").join(single, "course_code")


def q_overrep_courses(spark, d):
    """The ten courses that give an issue most posts within a college."""
    cells = _college_cells(spark, d).groupBy("college", "global_cluster_id", "course_code").agg(F.countDistinct("post_id").alias("n"))
    return reports.contributors(cells, ["college", "global_cluster_id"], "course_code", "n")


def q_low_signal_breadth(spark, d):
    """The five issues with the fewest posts, and how many courses and colleges they reach."""
    i = index(spark, d).where("global_cluster_id IS NOT NULL")
    colleges = table(spark, d, "courses").select(F.col("coursecode").alias("course_code"), F.explode(split_multi(F.col("colleges"))).alias("college"))
    breadth = i.select("global_cluster_id", "course_code").distinct().join(colleges, "course_code").groupBy("global_cluster_id").agg(F.countDistinct("college").alias("colleges"))
    total = i.groupBy("global_cluster_id").agg(F.countDistinct("post_id").alias("posts"), F.countDistinct("course_code").alias("courses"))
    return rows.first_in_order(total.join(breadth, "global_cluster_id", "left").withColumn("colleges", F.coalesce("colleges", F.lit(0))), ["posts", "colleges", "courses", "global_cluster_id"], 5)


def q_sample_college_issue(spark, d):
    """Up to ten post ids, by their digest, of each college and issue."""
    i = _college_cells(spark, d).select("college", "global_cluster_id", "post_id").distinct()
    r = i.withColumn("rn", F.row_number().over(Window.partitionBy("college", "global_cluster_id").orderBy(F.md5("post_id"), "post_id"))).where("rn <= 10")
    return r.groupBy("college", "global_cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "post_id"))), lambda x: x["post_id"]), ";").alias("ids"))


def q_overview_distinct(spark, d):
    """Distinct issues, by label where there is one, and colleges of the corpus."""
    issues = index(spark, d).agg(F.countDistinct("global_cluster_id").alias("issues"))
    seen = posts(spark, d).select("course_code").where("course_code IS NOT NULL").distinct()
    colleges = reports.by_college(seen.withColumn("n", F.lit(1)), table(spark, d, "courses"), ["n"]).agg(F.count(F.lit(1)).alias("colleges"))
    return issues.crossJoin(colleges)  # one row each


def q_counts_order(spark, d):
    """Courses as the funnel lists them: most pain posts, then clusters, then code."""
    return reports.ranked(reports.pipeline_counts(posts(spark, d), pains(spark, d), index(spark, d)), F.desc("pain_posts"), F.desc("clusters"), F.asc("course_code")).select("rank", "course_code")


def q_cards_order(spark, d):
    """Clusters as a course lists them: by size, then id."""
    n = index(spark, d).where("course_code IS NOT NULL AND cluster_id IS NOT NULL").groupBy("course_code", "cluster_id").agg(F.countDistinct("post_id").alias("posts"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("course_code").orderBy(F.desc("posts"), F.asc("cluster_id"))).cast("bigint"))


def q_first_courses(spark, d):
    """The first twelve courses by name that have pain points."""
    return rows.first_in_order(pains(spark, d).select("course_code").distinct(), ["course_code"], 12)


def q_nonblank_pairs(spark, d):
    """Index rows whose post and cluster ids are both there."""
    return nonblank_ids(table(spark, d, "post_global_index"), "post_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster_id").alias("clusters"))


def q_colleges_from_map(spark, d):
    """Courses and colleges through their JSON map."""
    listed = table(spark, d, "courses").where("coursecode IS NOT NULL").groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("coursecode", split_multi(F.col("colleges")))))).alias("j"))
    return college_pairs(listed, "j")


# ------------------------------------------------------------------ serving and ingest
def q_course_hits(spark, d):
    """Posts of one course that mention labs, and over how many courses such posts spread."""
    found = search.search_posts(posts(spark, d), "lab")
    one = search.search_posts(posts(spark, d), "lab", "q915")
    return found.agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("course_code").alias("courses")).crossJoin(one.agg(F.count(F.lit(1)).alias("in_course")))  # one row each


def q_last_page(spark, d):
    """A page past the end gives the last page of the error events."""
    e = table(spark, d, "events").where("event_type = 'error'")
    return rows.page(e, [F.asc("ts"), F.asc("event_id")], 10**6, total=e.count()).select("event_id", "user_id")


def q_board_frontier(spark, d):
    """The newest post of every board that permalinks name."""
    named = table(spark, d, "stage0_filtered_posts").withColumn("board", F.lower(F.regexp_extract("permalink", r"(?i)/r/([^/]+)/", 1)))
    return named.where("board <> '' AND NOT isnan(created_utc)").groupBy("board").agg(F.max("created_utc").alias("frontier"), F.count(F.lit(1)).alias("n"))


def q_board_posts(spark, d):
    """Posts of boards of the dimension table, by nsfw flag."""
    return posts(spark, d).join(table(spark, d, "subreddits").select("subreddit_id", "is_nsfw"), "subreddit_id").groupBy("is_nsfw").agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("subreddit_id").alias("boards"))


def q_submission_flags(spark, d):
    """Submissions as stored: promotional where it has no text of its own, deleted without an author, its kind and link."""
    p = table(spark, d, "stage0_filtered_posts")
    own = F.coalesce(F.col("post_type") == "self", F.lit(False))
    mapped = p.select((~own).cast("int").alias("is_promotional"), F.col("username").isNull().cast("int").alias("is_deleted"), F.when(own, "self").otherwise("link").alias("post_type"), F.startswith(F.coalesce("permalink", F.lit("")), F.lit("/")).alias("relative"))
    return mapped.groupBy("is_promotional", "is_deleted", "post_type", "relative").agg(F.count(F.lit(1)).alias("n"))


def q_rules_json(spark, d):
    """Rules of boards read, reduced to two fields and written as JSON again."""
    rules = F.from_json("rules", "array<struct<short_name:string,description:string>>")
    kept = F.transform(rules, lambda r: F.struct(F.coalesce(r["short_name"], F.lit("")).alias("short_name")))
    return table(spark, d, "subreddits").select("subreddit_id", F.coalesce(F.size(F.from_json(F.to_json(kept), "array<struct<short_name:string>>")), F.lit(0)).alias("n_rules"))


def q_pain_ids_indexed(spark, d):
    """Ids COURSE_POST[n] of a post's pain points, in the order of their texts, and whether they are well formed."""
    n = F.row_number().over(Window.partitionBy("course_code", "post_id").orderBy(F.asc_nulls_first("pain_point_snippet"))) - 1
    p = table(spark, d, "painpoints").withColumn("course_code", code_key(F.col("course_code"))).where("course_code IS NOT NULL AND post_id IS NOT NULL").select("course_code", "post_id", "pain_point_snippet").distinct()
    pid = F.format_string("%s_%s[%d]", F.col("course_code"), F.col("post_id"), n)
    return p.select(pid.alias("pain_id")).withColumn("valid", F.col("pain_id").rlike(r"^[A-Za-z0-9\-]+_[A-Za-z0-9\-]+\[\d+\]$"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_RUNS = "runs AS (SELECT 'run_a' AS run_id, post_id, coalesce(course_code, '') AS course_code, coalesce(gold, '') AS g, pred_old AS p, true AS e FROM preds UNION ALL SELECT 'run_b', post_id, '', coalesce(gold, ''), pred_new, false FROM preds)"
_BC = "SELECT count(*) FILTER (pred_old = gold AND pred_new <> gold) AS b, count(*) FILTER (pred_old <> gold AND pred_new = gold) AS c FROM preds WHERE gold IN ('y', 'n') AND pred_old IN ('y', 'n') AND pred_new IN ('y', 'n')"
_LABELS = "labels AS (SELECT DISTINCT cluster_id, global_cluster_id, 'part ' || right(global_cluster_id, 1) AS provisional_label, CASE WHEN ascii(reverse(cluster_id)) % 3 = 0 THEN ' ' ELSE 'issue ' || global_cluster_id END AS normalized_issue_label FROM idx WHERE global_cluster_id IS NOT NULL AND cluster_id IS NOT NULL)"
_FILES = "fc AS (SELECT course_code, cluster_id, count(DISTINCT post_id) AS k, ascii(reverse(cluster_id)) % 6 AS odd FROM idx WHERE course_code IS NOT NULL AND cluster_id IS NOT NULL AND post_id IS NOT NULL GROUP BY 1, 2), own AS (SELECT * FROM fc WHERE course_code IN (SELECT coursecode FROM courses)), lists AS (SELECT * FROM own WHERE NOT ends_with(course_code, '0'))"
_COLLEGES = "(SELECT coursecode, trim(x) AS college FROM (SELECT coursecode, unnest(string_split(coalesce(colleges, ''), ';')) AS x FROM courses) WHERE trim(x) <> '')"
_CELLS = f"cells AS (SELECT idx.*, s.college FROM idx JOIN (SELECT coursecode, min(college) AS college FROM {_COLLEGES} GROUP BY 1 HAVING count(*) = 1) s ON idx.course_code = s.coursecode WHERE global_cluster_id IS NOT NULL)"
_TOKENS = r"(SELECT *, CASE WHEN length(b) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(b) / 4) AS BIGINT)) END AS tokens FROM (SELECT *, regexp_replace(regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || regexp_replace(coalesce(selftext, ''), '^\s+|\s+$', '', 'g'), '^\s+|\s+$', '', 'g') AS b FROM posts))"


def _q(body: str, *parts: str, also: tuple[str, ...] = ()) -> str:
    """A query over shared tables (``also``) and further common tables."""
    head, _, tail = sql("\x00" + body, *also).partition("\x00")
    return (", ".join([head.rstrip(), *parts]) if head else "WITH " + ", ".join(parts)) + " " + tail


ORACLE = {
    "q_runs_union": _q("SELECT run_id, p AS label, e AS parse_error, course_code = '' AS no_course, count(*) AS n FROM runs GROUP BY 1, 2, 3, 4", _RUNS, also=("preds",)),
    "q_runs_picked": _q("SELECT run_id, 'long' AS prompt, count(*) AS n FROM runs WHERE run_id = 'run_b' GROUP BY 1", _RUNS, also=("preds",)),
    "q_runs_outcomes": _q("SELECT run_id, CASE WHEN g = 'y' THEN CASE WHEN p = 'y' THEN 'TP' ELSE 'FN' END ELSE CASE WHEN p = 'y' THEN 'FP' ELSE 'TN' END END AS outcome, count(*) AS n FROM runs WHERE g IN ('y', 'n') GROUP BY 1, 2", _RUNS, also=("preds",)),
    "q_runs_false_positives": _q("SELECT run_id, 'rules' AS model, CASE run_id WHEN 'run_a' THEN 'short' ELSE 'long' END AS prompt, post_id FROM runs WHERE g = 'n' AND p = 'y'", _RUNS, also=("preds",)),
    "q_runs_paired": sql("SELECT coalesce(gold, '') AS gold, pred_old AS old, pred_new AS new, count(*) AS n FROM preds GROUP BY 1, 2, 3", "preds"),
    "q_runs_by_post": sql("SELECT post_id, 'run_a:' || pred_old || ',run_b:' || pred_new AS labels FROM preds", "preds"),
    "q_post_chunks": sql("SELECT post_id, CAST((row_number() OVER (ORDER BY post_id) - 1) // 5 + 1 AS INT) AS chunk FROM (SELECT DISTINCT post_id FROM preds)", "preds"),
    "q_mcnemar_log": sql(f"SELECT b, c, round(log10(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM (SELECT unnest(range(0, least(b, c) + 1)) AS i)))), 6) AS log10_p FROM ({_BC})", "preds"),
    "q_label_shift_test": sql("SELECT round(x, 6) AS chi2, k - 1 AS dof, round(log10(exp(-x / 2)), 6) AS log10_p, exp(-x / 2) < 0.05 AS shifted FROM (SELECT sum((o - eo) * (o - eo) / eo + (n - en) * (n - en) / en) AS x, count(*) AS k FROM (SELECT o, n, (o + n) * so / (so + sn) AS eo, (o + n) * sn / (so + sn) AS en FROM (SELECT *, sum(o) OVER () AS so, sum(n) OVER () AS sn FROM (SELECT label, count(*) FILTER (v = 'o') AS o, count(*) FILTER (v = 'n') AS n FROM (SELECT pred_old AS label, 'o' AS v FROM preds UNION ALL SELECT pred_new, 'n' FROM preds) GROUP BY 1))))", "preds"),
    "q_invariants": sql("SELECT CASE WHEN coalesce(gold = 'u', false) OR vader_compound IS NULL THEN 'u' ELSE pred_new END AS label, '1.0.0' AS schema_version, count(*) AS n, count(*) FILTER (num_comments IS NULL OR num_comments / 20 NOT BETWEEN 0 AND 1 OR num_comments = 0) AS zero FROM preds GROUP BY 1", "preds"),
    "q_confidence_clamp": sql("SELECT post_id, CASE WHEN score % 7 IN (0, 1) OR score < 0 THEN 0.0 WHEN score > 100 THEN 1.0 ELSE score / 100 END::DOUBLE AS confidence FROM posts WHERE score IS NOT NULL", "posts"),
    "q_gold_eligible": "SELECT gold, count(*) AS n, count(DISTINCT p) AS posts FROM (SELECT trim(post_id) AS p, upper(trim(split)) AS s, lower(trim(contains_painpoint)) AS gold FROM gold_labels) WHERE s = 'TEST' AND gold IN ('y', 'n') AND p <> '' GROUP BY 1",
    "q_labels_left": sql(r"SELECT course_code, count(*) AS left FROM posts WHERE course_code IN (SELECT nullif(regexp_replace(upper(course_code), '[^\p{L}\p{N}]', '', 'g'), '') FROM gold_labels) AND post_id NOT IN (SELECT trim(post_id) FROM gold_labels WHERE post_id IS NOT NULL) AND trim(post_id) <> '' GROUP BY 1", "posts"),
    "q_label_order": sql("SELECT post_id, row_number() OVER (ORDER BY CASE WHEN split = 'DEV' THEN 0 ELSE 1 END, course_code NULLS FIRST, post_id) AS rank FROM gold", "gold"),
    "q_gold_present": sql("SELECT post_id FROM gold WHERE post_id IN (SELECT post_id FROM posts) ORDER BY post_id LIMIT 40", "gold", "posts"),
    "q_gold_missing": sql("SELECT post_id FROM gold WHERE post_id NOT IN (SELECT post_id FROM posts WHERE post_id IS NOT NULL)", "gold", "posts"),
    "q_length_bounds": sql(f"SELECT CASE WHEN tokens BETWEEN 20 AND 149 THEN 'short' WHEN tokens BETWEEN 150 AND 299 THEN 'medium' WHEN tokens BETWEEN 300 AND 600 THEN 'long' ELSE 'none' END AS bucket, count(*) FILTER (tokens BETWEEN 20 AND 600) AS n, count(*) FILTER (tokens BETWEEN 100 AND 600) AS narrow FROM {_TOKENS} GROUP BY 1", "posts"),
    "q_issue_fields": sql("SELECT global_cluster_id, 'issue ' || global_cluster_id AS normalized_issue_label, lower(global_cluster_id) AS provisional_label, CAST(NULL AS VARCHAR) AS short_description, count(DISTINCT post_id) AS total_num_posts, count(DISTINCT cluster_id) AS num_clusters, count(DISTINCT course_code) AS num_courses FROM idx WHERE global_cluster_id IS NOT NULL GROUP BY 1", "idx"),
    "q_issue_families": _q("SELECT f.label, f.place, count(global_cluster_id) AS issues FROM fam f LEFT JOIN (SELECT DISTINCT global_cluster_id, ascii(reverse(global_cluster_id)) % 8 + 1 AS place FROM idx WHERE global_cluster_id IS NOT NULL) USING (place) GROUP BY 1, 2", "fam AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i})" for i, k in enumerate(ISSUE_FAMILIES, 1)) + ") t(label, place))", also=("idx",)),
    "q_merge_by_labels": _q("SELECT provisional_label, normalized_issue_label, string_agg(DISTINCT cluster_id, ';' ORDER BY cluster_id) AS members, 'from batch ' || min(ascii(reverse(cluster_id)) % 4) AS description FROM labels GROUP BY 1, 2", _LABELS, also=("idx",)),
    "q_labelled_members": _q("SELECT coalesce(CASE WHEN trim(normalized_issue_label) <> '' THEN normalized_issue_label END, CASE WHEN trim(provisional_label) <> '' THEN provisional_label END, 'Unlabelled') AS label, count(*) AS n FROM idx LEFT JOIN (SELECT * FROM labels WHERE ascii(reverse(cluster_id)) % 5 <> 0) l USING (cluster_id, global_cluster_id) GROUP BY 1", _LABELS, also=("idx",)),
    "q_cluster_summaries": sql("SELECT i.course_code, i.cluster_id, count(*) AS n_rows, any_value(s.issue_summary) AS issue_summary FROM idx i LEFT JOIN (SELECT cluster_id, min(root_cause_summary) AS issue_summary FROM idx JOIN pains USING (post_id) GROUP BY 1) s ON i.cluster_id = s.cluster_id WHERE i.course_code IS NOT NULL AND i.cluster_id IS NOT NULL GROUP BY 1, 2", "idx", "pains"),
    "q_check_files": _q(
        "SELECT rule, count(*) AS n, count(DISTINCT course_code) AS courses FROM (SELECT DISTINCT 'shape' AS rule, course_code FROM own WHERE ends_with(course_code, '0') UNION ALL SELECT 'course', course_code FROM lists WHERE odd = 1 UNION ALL SELECT 'summary', course_code FROM lists WHERE odd = 2 UNION ALL SELECT 'count', course_code FROM lists WHERE odd = 3 UNION ALL SELECT 'prefix', course_code FROM lists WHERE NOT starts_with(cluster_id, course_code || '_') UNION ALL SELECT 'unknown_post', course_code FROM (SELECT DISTINCT l.course_code, l.cluster_id FROM lists l JOIN idx USING (course_code, cluster_id) WHERE post_id IS NOT NULL AND post_id NOT IN (SELECT post_id FROM pains)) UNION ALL SELECT 'duplicate', min(course_code) FROM lists GROUP BY cluster_id HAVING count(*) > 1) GROUP BY 1",
        _FILES, also=("idx", "pains"),
    ),
    "q_check_totals": _q("SELECT o.course_code, o.stated, coalesce(x.total, 0) AS total FROM (SELECT course_code, CAST(sum(k) AS BIGINT) AS stated FROM own GROUP BY 1) o LEFT JOIN (SELECT course_code, count(DISTINCT post_id) AS total FROM lists JOIN idx USING (course_code, cluster_id) WHERE post_id IS NOT NULL GROUP BY 1) x USING (course_code) WHERE o.stated IS DISTINCT FROM coalesce(x.total, 0)", _FILES, also=("idx",)),
    "q_check_skipped": _q("SELECT DISTINCT course_code FROM fc WHERE course_code NOT IN (SELECT coursecode FROM courses WHERE coursecode IS NOT NULL)", _FILES, also=("idx",)),
    "q_overrep_courses": _q("SELECT college, global_cluster_id, string_agg(course_code || '(' || n || ')', '; ' ORDER BY rn) AS contributors FROM (SELECT *, row_number() OVER (PARTITION BY college, global_cluster_id ORDER BY n DESC, course_code) AS rn FROM (SELECT college, global_cluster_id, course_code, count(DISTINCT post_id) AS n FROM cells GROUP BY 1, 2, 3)) WHERE rn <= 10 GROUP BY 1, 2", _CELLS, also=("idx",)),
    "q_low_signal_breadth": sql(f"SELECT global_cluster_id, posts, courses, coalesce(colleges, 0) AS colleges FROM (SELECT global_cluster_id, count(DISTINCT post_id) AS posts, count(DISTINCT course_code) AS courses FROM idx WHERE global_cluster_id IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT global_cluster_id, count(DISTINCT college) AS colleges FROM idx JOIN {_COLLEGES} k ON idx.course_code = k.coursecode WHERE global_cluster_id IS NOT NULL GROUP BY 1) USING (global_cluster_id) ORDER BY posts, coalesce(colleges, 0), courses, global_cluster_id LIMIT 5", "idx"),
    "q_sample_college_issue": _q("SELECT college, global_cluster_id, string_agg(post_id, ';' ORDER BY rn) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY college, global_cluster_id ORDER BY md5(post_id), post_id) AS rn FROM (SELECT DISTINCT college, global_cluster_id, post_id FROM cells)) WHERE rn <= 10 GROUP BY 1, 2", _CELLS, also=("idx",)),
    "q_overview_distinct": sql(f"SELECT (SELECT count(DISTINCT global_cluster_id) FROM idx) AS issues, (SELECT count(DISTINCT coalesce(college, 'Unknown')) FROM (SELECT DISTINCT course_code FROM posts WHERE course_code IS NOT NULL) p LEFT JOIN {_COLLEGES} k ON p.course_code = k.coursecode) AS colleges", "idx", "posts"),
    "q_counts_order": sql("SELECT row_number() OVER (ORDER BY coalesce(a, 0) DESC, coalesce(b, 0) DESC, course_code) AS rank, course_code FROM (SELECT DISTINCT course_code FROM posts WHERE course_code IS NOT NULL) LEFT JOIN (SELECT course_code, count(DISTINCT post_id) AS a FROM pains GROUP BY 1) USING (course_code) LEFT JOIN (SELECT course_code, count(DISTINCT cluster_id) AS b FROM idx GROUP BY 1) USING (course_code)", "posts", "pains", "idx"),
    "q_cards_order": sql("SELECT *, row_number() OVER (PARTITION BY course_code ORDER BY posts DESC, cluster_id) AS place FROM (SELECT course_code, cluster_id, count(DISTINCT post_id) AS posts FROM idx WHERE course_code IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2)", "idx"),
    "q_first_courses": sql("SELECT DISTINCT course_code FROM pains ORDER BY course_code LIMIT 12", "pains"),
    "q_nonblank_pairs": "SELECT count(*) AS n, count(DISTINCT cluster_id) AS clusters FROM post_global_index WHERE trim(coalesce(post_id, '')) <> '' AND trim(coalesce(cluster_id, '')) <> ''",
    "q_colleges_from_map": f"SELECT coursecode AS course_code, college FROM {_COLLEGES} WHERE coursecode IS NOT NULL",
    "q_course_hits": sql("SELECT count(*) AS posts, count(DISTINCT course_code) AS courses, count(*) FILTER (upper(trim(course_code)) = 'Q915') AS in_course FROM posts WHERE contains(lower(coalesce(title, '')), 'lab') OR contains(lower(coalesce(selftext, '')), 'lab')", "posts"),
    "q_last_page": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events WHERE event_type = 'error') WHERE rn > (greatest(n - 1, 0) // 50) * 50",
    "q_board_frontier": "SELECT board, max(created_utc) AS frontier, count(*) AS n FROM (SELECT lower(regexp_extract(permalink, '/r/([^/]+)/', 1, 'i')) AS board, created_utc FROM stage0_filtered_posts WHERE NOT isnan(created_utc)) WHERE board <> '' GROUP BY 1",
    "q_board_posts": sql("SELECT is_nsfw, count(*) AS posts, count(DISTINCT subreddit_id) AS boards FROM posts JOIN subreddits USING (subreddit_id) GROUP BY 1", "posts"),
    "q_submission_flags": "SELECT CASE WHEN coalesce(post_type = 'self', false) THEN 0 ELSE 1 END AS is_promotional, CASE WHEN username IS NULL THEN 1 ELSE 0 END AS is_deleted, CASE WHEN coalesce(post_type = 'self', false) THEN 'self' ELSE 'link' END AS post_type, starts_with(coalesce(permalink, ''), '/') AS relative, count(*) AS n FROM stage0_filtered_posts GROUP BY 1, 2, 3, 4",
    "q_rules_json": "SELECT subreddit_id, CAST(coalesce(CASE WHEN json_valid(rules) THEN CASE WHEN json_type(rules) = 'ARRAY' THEN json_array_length(rules) END END, 0) AS INT) AS n_rules FROM subreddits",
    "q_pain_ids_indexed": r"SELECT pain_id, regexp_full_match(pain_id, '[A-Za-z0-9\-]+_[A-Za-z0-9\-]+\[\d+\]') AS valid FROM (SELECT c || '_' || post_id || '[' || (row_number() OVER (PARTITION BY c, post_id ORDER BY pain_point_snippet NULLS FIRST) - 1) || ']' AS pain_id FROM (SELECT DISTINCT nullif(regexp_replace(upper(course_code), '[^\p{L}\p{N}]', '', 'g'), '') AS c, post_id, pain_point_snippet FROM painpoints) WHERE c IS NOT NULL AND post_id IS NOT NULL)",
}
