"""Stages as functions: each reads tables, writes its outputs and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.functions.sentiment import compound
from quernstone.operators import classify, clusters, evaluation, filters, profile, reports, rows, runs, sampling
from quernstone.session import cut_lineage
from quernstone.sources import sinks, storage


def run_stage0(posts: DataFrame, boards: DataFrame, courses: DataFrame, out: str, threshold: float = -0.2, manifest: str | None = None) -> DataFrame | None:
    """Selected posts: structurally kept, exactly one course, sentiment below the threshold (scored where missing).

    Does nothing when the manifest is locked.
    """
    if manifest and sinks.is_locked(posts.sparkSession, manifest):
        return None
    kept = filters.structural_filter(posts).join(boards.select("subreddit_id", F.col("name").alias("board")), "subreddit_id", "left")
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    matched = filters.match_codes(kept, "post_id", body, courses, "coursecode")
    known = F.when(~F.isnan("vader_compound"), F.col("vader_compound"))
    scored = kept.join(matched, "post_id").withColumn("sentiment", F.coalesce(known, compound(body)))
    result = scored.where(filters.below(F.col("sentiment"), threshold)).withColumn("course_code", F.col("matched")[0])
    result.write.mode("overwrite").parquet(out)
    written = posts.sparkSession.read.parquet(out)
    if manifest:
        sinks.write_manifest(manifest, written.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("course_code").alias("courses")), status="built")
    return written


def build_length_profile(posts: DataFrame, out: str) -> DataFrame:
    t = posts.select(text.token_count(text.assemble_stripped(F.col("title"), F.col("selftext"))).alias("tokens"))
    profile.quantile_profile(t, "tokens").write.mode("overwrite").json(f"{out}/profile")
    profile.histogram(t, "tokens", 50).write.mode("overwrite").option("header", True).csv(f"{out}/histogram")
    return posts.sparkSession.read.json(f"{out}/profile")


def build_stratified_sample(posts: DataFrame, out: str, target: int = 200, share: float = 0.7, seed: str = "20251107") -> DataFrame:
    t = posts.withColumn("bucket", text.length_bucket(text.token_count(text.assemble_stripped(F.col("title"), F.col("selftext"))))).where("bucket IS NOT NULL")
    picked = sampling.round_robin(t, "post_id", ["course_code", "bucket"], target, seed)
    sampling.split_by_share(picked, "post_id", ["course_code"], share, seed).write.mode("overwrite").partitionBy("part").json(out)
    return posts.sparkSession.read.json(out)


def run_classifier(posts: DataFrame, template: str, client: classify.Client, out: str, **options) -> DataFrame:
    """Predictions of every post and a manifest of error counters."""
    prompt = text.render(template, course=F.col("course_code"), body=text.assemble(F.col("title"), F.col("selftext")))
    classify.classify(posts.select("post_id", "course_code", "title", "selftext"), prompt, client, **options).drop("title", "selftext").write.mode("overwrite").parquet(out)
    done = posts.sparkSession.read.parquet(out)
    sinks.write_manifest(f"{out.rstrip('/')}.json", classify.error_counters(done))
    return done


def evaluate(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Metrics of predictions on their gold labels; a prediction without a label raises."""
    if not predictions.join(gold, "post_id", "left_anti").isEmpty():
        raise ValueError("predictions without gold labels")
    return evaluation.confusion(predictions.join(gold, "post_id"), F.col("gold"), F.col("label"))


def preprocess_painpoints(predictions: DataFrame, out: str) -> DataFrame:
    """Kept pain points in the order of their course's size, and counts of the reasons of dropping."""
    failed = F.col("parse_error") | F.col("schema_error") | F.col("llm_failure")
    reasoned = predictions.withColumn("reason", filters.pain_point_reasons(F.col("label"), failed, F.col("summary"), F.col("snippet")))
    reasoned.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{out}/dropped")
    kept = reasoned.where("reason IS NULL").select("post_id", "course_code", F.col("summary").alias("root_cause_summary"), F.col("snippet").alias("pain_point_snippet"))
    size = kept.groupBy("course_code").agg(F.countDistinct("post_id").alias("posts"))
    kept.join(size, "course_code").orderBy(F.desc("posts"), "course_code", "post_id").write.mode("overwrite").parquet(f"{out}/kept")
    return predictions.sparkSession.read.parquet(f"{out}/kept")


def validate_clusters(nested: DataFrame, pains: DataFrame) -> None:
    """Raises when a cluster breaks a rule: how many there are of each, and twenty of them by name."""
    broken = cut_lineage(clusters.violations(clusters.flatten(nested), pains))
    counts = broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy("rule").collect()
    if counts:
        shown = broken.orderBy("rule", "course_code", "cluster_id").limit(20).collect()
        raise ValueError(", ".join(f"{r['rule']} {r['n']}" for r in counts) + ": " + "; ".join(f"{r['rule']} {r['course_code']} {r['cluster_id']}" for r in shown))


def build_analytics(posts: DataFrame, pains: DataFrame, index: DataFrame, courses: DataFrame, out: str) -> dict[str, int]:
    """Writes the reporting tables; returns their sizes."""
    master = reports.post_master(posts, pains.dropDuplicates(["post_id"]), index, courses)
    weights = index.where("global_cluster_id IS NOT NULL").groupBy("global_cluster_id").agg(F.countDistinct("post_id").alias("weight"))
    counts = reports.pipeline_counts(posts, pains, index)
    made = {
        "post_master": reports.collapse(master, weights),
        "course_summary": reports.course_summary(master),
        "course_cluster_detail": reports.cluster_detail(index, pains),
        "issue_course_matrix": reports.issue_course_matrix(index),
        "pipeline_counts_by_course": counts,
        "pipeline_counts_by_college": reports.by_college(counts, courses, [c for c in counts.columns if c != "course_code"]),
    }
    sizes = {}
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        sizes[name] = posts.sparkSession.read.parquet(f"{out}/{name}").count()
    return sizes


def build_panel(index: DataFrame, runs_: list[tuple[str, DataFrame]], texts: DataFrame, out: str, split: str | None = None, models: list[str] | None = None, prompts: list[str] | None = None) -> DataFrame:
    """One row of each post and picked run: labels, outcome, whether it is right, and the post's length. No picked run raises."""
    picked = runs.pick_runs(index, split, models, prompts)
    if picked.isEmpty():
        raise ValueError("no run is picked")
    rows_ = runs.union_runs(runs_).join(F.broadcast(picked.select("run_id", "model", "prompt", "split")), "run_id")  # a row for each run
    gold, pred = F.col("true_contains_painpoint"), F.col("pred_contains_painpoint")
    n = texts.select("post_id", F.length(text.assemble(F.col("title"), F.col("selftext"))).alias("n_chars"))
    rows_.withColumn("error_type", F.lower(runs.outcome(gold, pred))).withColumn("is_correct", (gold == pred) & gold.isin("y", "n")).join(n, "post_id", "left").write.mode("overwrite").parquet(out)
    return index.sparkSession.read.parquet(out)


def combine_runs(spark: SparkSession, patterns: list[str], out: str, size: int = 5) -> dict[str, int]:
    """All runs that the patterns match in one table, without ignored rows, and in chunks of so many posts; returns row counts."""
    every = runs.read_runs(spark, runs.run_folders(spark, patterns)).withColumn("error_type", runs.outcome(F.col("true_contains_painpoint"), F.col("pred_contains_painpoint"))).where("error_type <> 'IGNORE'")
    every.write.mode("overwrite").parquet(f"{out}/combined")
    combined = spark.read.parquet(f"{out}/combined")
    sinks.write_chunks(combined, "post_id", f"{out}/chunks", size)
    one = combined.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("post_id").alias("posts"), F.countDistinct("run_dir").alias("runs")).first()
    return one.asDict()


def collect_false_positives(index: DataFrame, runs_: list[tuple[str, DataFrame]], out: str) -> int:
    """False positives of all runs with the run's metadata; returns their number."""
    found = runs.union_runs(runs_).where("true_contains_painpoint = 'n' AND pred_contains_painpoint = 'y'")
    return sinks.write_jsonl(found.join(F.broadcast(index), "run_id"), out)  # a row for each run


_GROUPS = "array<struct<cluster_id:string,issue_summary:string,post_ids:array<string>>>"


def run_clustering(pains: DataFrame, template: str, client: classify.Client, out: str, most: int | None = None, **options) -> DataFrame:
    """Each course's pain points put to a client, whose answer, a JSON list of clusters, becomes the course's nested file.

    Courses in the order of their codes, the first ``most`` of them; a failed call or an answer that can't be read gives
    a null list. A prompt holds one course, as the client groups what it sees.
    """
    courses = rows.first_in_order(pains.select("course_code").where("course_code IS NOT NULL").distinct(), ["course_code"], most)
    line = F.concat_ws(": ", "post_id", F.coalesce("root_cause_summary", F.lit("")))
    listed = pains.join(courses, "course_code", "left_semi").groupBy("course_code").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("lines"), F.countDistinct("post_id").cast("int").alias("total_posts"))
    asked = classify.generate(listed, text.render(template, course=F.col("course_code"), painpoints=F.col("lines")), client, **options)
    groups = F.from_json(F.when(~F.col("llm_failure"), F.col("raw_text")), _GROUPS)
    with_size = F.transform(groups, lambda c: F.struct(c["cluster_id"].alias("cluster_id"), F.col("course_code").alias("course_code"), c["issue_summary"].alias("issue_summary"), F.size(c["post_ids"]).alias("num_posts"), c["post_ids"].alias("post_ids")))
    asked.select("course_code", "total_posts", with_size.alias("clusters"), "llm_failure", "num_retries").write.mode("overwrite").parquet(out)
    return pains.sparkSession.read.parquet(out)


def preprocess_clusters(files: DataFrame, out: str, size: int = 60) -> DataFrame:
    """Clusters of all files by course and id, in batches of so many."""
    flat = files.where("clusters IS NOT NULL").select("course_code", F.explode("clusters").alias("c")).select("course_code", "c.cluster_id", "c.issue_summary", "c.num_posts")
    clusters.batches(flat, [F.asc_nulls_first("course_code"), F.asc_nulls_first("cluster_id")], size).write.mode("overwrite").partitionBy("batch").json(out)
    return files.sparkSession.read.json(out)


def run_global_clusters(batched: DataFrame, template: str, client: classify.Client, out: str, **options) -> DataFrame:
    """Each batch of clusters put to a client; the groups of all answers merged by label, counted and numbered."""
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "cluster_id", F.coalesce("issue_summary", F.lit(""))))), "\n")
    asked = classify.generate(batched.groupBy("batch").agg(shown.alias("lines")), text.render(template, clusters=F.col("lines")), client, **options)
    answer = F.from_json(F.when(~F.col("llm_failure"), F.col("raw_text")), "array<struct<provisional_label:string,normalized_issue_label:string,description:string,members:array<string>>>")
    groups = asked.select("batch", F.explode(answer).alias("g")).select("batch", "g.*")
    merged = clusters.merge(groups, ("provisional_label", "normalized_issue_label"))
    sizes = batched.select("cluster_id", "course_code", "num_posts")
    counted = merged.select("provisional_label", "normalized_issue_label", F.explode("members").alias("cluster_id")).join(sizes, "cluster_id").groupBy("provisional_label", "normalized_issue_label").agg(F.sum("num_posts").alias("total_num_posts"), F.count(F.lit(1)).alias("num_clusters"), F.countDistinct("course_code").alias("num_courses"))
    numbered = clusters.global_ids(merged.join(counted, ["provisional_label", "normalized_issue_label"]).withColumnRenamed("description", "short_description"), "total_num_posts", "normalized_issue_label")
    numbered.withColumnRenamed("global_id", "global_cluster_id").write.mode("overwrite").parquet(out)
    return batched.sparkSession.read.parquet(out)


def validate_global_clusters(issues: DataFrame, known: DataFrame, unassigned: DataFrame | None = None) -> dict[str, int]:
    """Raises where clusters stand in an issue and not, are missing or unknown, totals differ from their members', or
    issues are not numbered by size; else returns what is covered."""
    members = issues.select("global_cluster_id", "total_num_posts", F.explode("members").alias("cluster_id"))
    left = unassigned if unassigned is not None else known.where("false")
    broken = rows.coverage(members, left, known, "cluster_id").groupBy("violation").agg(F.count(F.lit(1)).alias("n")).collect()
    totals = members.join(known.select("cluster_id", "num_posts"), "cluster_id").groupBy("global_cluster_id", "total_num_posts").agg(F.sum("num_posts").alias("n")).where("n <> total_num_posts").count()
    order = clusters.out_of_order(issues.withColumn("rank", F.substring("global_cluster_id", 2, 12).cast("bigint")), "total_num_posts", "rank").count()
    found = {r["violation"]: r["n"] for r in broken} | ({"total": totals} if totals else {}) | ({"order": order} if order else {})
    if found:
        raise ValueError(", ".join(f"{k} {v}" for k, v in sorted(found.items())))
    return members.agg(F.countDistinct("global_cluster_id").alias("issues"), F.countDistinct("cluster_id").alias("clusters")).first().asDict()


def build_reports(posts: DataFrame, pains: DataFrame, index: DataFrame, courses: DataFrame, out: str) -> str:
    """The ranked courses and issues as CSV, and an overview in Markdown, which is returned."""
    master = reports.post_master(posts, pains.dropDuplicates(["post_id"]), index, courses)
    ranked_courses = reports.ranked(reports.course_summary(master), F.desc("pain_posts"), F.desc("posts"), F.asc("course_code"))
    sinks.write_csv(ranked_courses, f"{out}/courses", ["rank", "course_code", "course_title", "posts", "pain_posts", "clusters", "top_issues"])
    issues = index.where("global_cluster_id IS NOT NULL").groupBy("global_cluster_id").agg(F.countDistinct("post_id").alias("posts"), F.countDistinct("course_code").alias("courses"))
    sinks.write_csv(reports.ranked(issues, F.desc("posts"), F.asc("global_cluster_id")), f"{out}/issues", ["rank", "global_cluster_id", "posts", "courses"])
    counts = reports.pipeline_counts(posts, pains, index)
    made = sinks.overview(counts.agg(F.sum("posts").alias("posts"), F.sum("pain_posts").alias("pain_posts"), F.sum("clusters").alias("clusters"), F.count_if(F.col("pain_posts") > 0).alias("courses_with_pain")), "Overview")
    storage.write_text(posts.sparkSession, f"{out}/overview.md", made)
    return made


def daily_update(steps: list[tuple[str, object]], log: str, spark: SparkSession) -> int:
    """Runs steps in order; failures are logged, not raised. Returns how many failed."""
    import time

    done = []
    for name, step in steps:
        began = time.time()
        try:
            step()
            done.append((name, began, time.time(), None))
        except Exception as e:  # noqa: BLE001 - the next step runs all the same
            done.append((name, began, time.time(), str(e)[:500]))
    spark.createDataFrame(done, "step string, started_at double, finished_at double, failure string").write.mode("append").parquet(log)
    return sum(d[3] is not None for d in done)


def inspect_tables(spark: SparkSession, data: str, names: list[str]) -> DataFrame:
    """(table_name, columns, n_rows) of stored tables."""
    out = None
    for n in names:
        df = spark.read.parquet(f"{data}/{n}.parquet")
        part = df.agg(F.lit(n).alias("table_name"), F.lit(",".join(df.columns)).alias("columns"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["build_analytics", "build_length_profile", "build_panel", "build_reports", "build_stratified_sample", "collect_false_positives", "combine_runs", "preprocess_clusters", "run_clustering", "run_global_clusters", "validate_global_clusters", "daily_update", "evaluate", "inspect_tables", "preprocess_painpoints", "rows", "run_classifier", "run_stage0", "validate_clusters"]
