"""Runs, labelling, stored ranks, cluster files, readers and the classifier's bounds."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quernstone.operators import classify, clusters, evaluation, filters, labelling, profile, reports, rows, runs
from quernstone.sources import files, sinks, storage
from quernstone.streaming import feeds


def test_runs_are_read_once_each(spark, tmp_path):
    for name, text in {"r2": 'post_id,true_contains_painpoint,pred_contains_painpoint,parse_error\na, Y ,n,True\n', "r1": 'post_id,pred_contains_painpoint,extra\nb,"U",x\n'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "predictions.csv").write_text(text)
    folders = runs.run_folders(spark, [f"{tmp_path}/r2", f"{tmp_path}/r*"])
    assert [f.rsplit("/", 1)[1] for f in folders] == ["r2", "r1"]
    one = runs.read_runs(spark, folders[:1]).first()
    assert (one["run_dir"], one["post_id"], one["true_contains_painpoint"], one["parse_error"], one["course_code"]) == ("r2", "a", "y", True, "")
    assert runs.read_runs(spark, folders[1:]).first()["pred_contains_painpoint"] == "u"
    with pytest.raises(FileNotFoundError):
        runs.read_runs(spark, [f"{tmp_path}/none"])
    with pytest.raises(FileNotFoundError):
        runs.read_runs(spark, [])


def test_pick_runs(spark):
    index = spark.createDataFrame([("a", "m", "p", "p.txt", "DEV"), ("b", "m", "q", "q.txt", " dev"), ("c", "n", "q", "q.txt", None)], "run string, model string, prompt string, prompt_file string, split string")
    pick = lambda **k: sorted(r["run"] for r in runs.pick_runs(index, **k).collect())
    assert pick() == ["a", "b", "c"] and pick(split="Dev") == ["a", "b"] and pick(prompts=["q.txt"]) == ["b", "c"] and pick(split="DEV", models=["m"], prompts=["p", "q"]) == ["a", "b"]


def test_outcomes_and_invariants(spark):
    df = spark.createDataFrame([("Y", "y"), ("y", "u"), ("n", "y"), ("N", None), ("maybe", "y"), (None, "y")], "g string, p string")
    assert [r[0] for r in df.select(runs.outcome(F.col("g"), F.col("p"))).collect()] == ["TP", "FN", "FP", "TN", "IGNORE", "IGNORE"]
    p = spark.createDataFrame([("y", 0.5, False, None, False, None), ("y", 1.5, False, False, True, "2")], "label string, confidence double, parse_error boolean, schema_error boolean, llm_failure boolean, schema_version string")
    assert [(r["label"], r["confidence"], r["schema_version"]) for r in runs.held_to_invariants(p, "1").collect()] == [("y", 0.5, "1"), ("u", 0.0, "2")]


def test_rank_over_ranges(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE id % 50 END AS a", "id")
    got = rows.rank_all(df.repartition(7), F.desc_nulls_last("a"), "id").collect()
    want = sorted(((None if i % 7 == 0 else i % 50, i) for i in range(1000)), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(r["a"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 1001))
    assert rows.rank_all(df.where("false"), "id").count() == 0


def test_pages_and_first_rows(spark):
    df = spark.range(7)
    assert [r[0] for r in rows.page(df, [F.asc("id")], 99, 3, total=7).collect()] == [6]
    assert [r[0] for r in rows.page(df, [F.asc("id")], -1, 3, total=7).collect()] == [0, 1, 2]
    present, missing = rows.known_in_order(df, spark.range(5, 9), "id", [F.desc("id")], 1)
    assert [r[0] for r in present.collect()] == [6] and missing.count() == 5


def test_labelling_goes_on_where_it_stopped(spark, tmp_path):
    posts = spark.createDataFrame([(f"p{i}",) for i in range(40)] + [("p1",), (" ",), (None,)], "post_id string")
    calls = []

    def label(df):
        if len(calls) == 5:
            raise RuntimeError("stopped")
        calls.append(1)
        return df.withColumn("label", F.lit("y"))

    with pytest.raises(RuntimeError):
        labelling.label_all(posts, str(tmp_path / "labels"), label, parts=8)
    before = spark.read.parquet(str(tmp_path / "labels")).count()
    calls.extend([1] * 9)
    done = labelling.label_all(posts, str(tmp_path / "labels"), label, parts=8)
    stored = spark.read.parquet(str(tmp_path / "labels"))
    assert 0 < before < 40 and done == 40 - before and stored.count() == stored.select("post_id").distinct().count() == 40
    assert labelling.remaining(posts, stored).count() == 0


def test_labels_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([("b", "TEST", "A"), ("c", "dev", "B"), ("a", "DEV", "B")], "post_id string, split string, course_code string")
    sinks.write_labels(df.coalesce(1), str(tmp_path / "l"), ["post_id", "split", "notes"])
    lines = [x for f in sorted((tmp_path / "l").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x.split(",")[0] for x in lines if not x.startswith("post_id")] == ["a", "c", "b"]


def test_cluster_files(spark):
    schema = "course_code string, total_posts int, clusters array<struct<cluster_id string, course_code string, issue_summary string, num_posts int, post_ids array<string>>>"
    data = [("A", 2, [("A_1", "A", "s", 2, ["p", "q"]), ("A_2", "B", " ", 1, ["q"]), ("X_1", "A", "s", 3, ["p"])]), ("B", 5, [("B_1", "B", "s", 1, ["zz"])]), ("C", 1, None), ("D", 1, [])]
    known, courses = spark.createDataFrame([("p",), ("q",)], "post_id string"), spark.createDataFrame([("A",), ("B",), ("C",)], "course_code string")
    broken, totals, skipped = clusters.check_files(spark.createDataFrame(data, schema), known, courses)
    assert {tuple(r) for r in broken.collect()} == {("course", "A", "A_2"), ("summary", "A", "A_2"), ("prefix", "A", "X_1"), ("count", "A", "X_1"), ("unknown_post", "B", "B_1"), ("shape", "C", None)}
    assert {tuple(r) for r in totals.collect()} == {("B", 5, 1), ("C", 1, 0)} and [r[0] for r in skipped.collect()] == ["D"]


def test_issue_fields_missing_are_null(spark):
    row = clusters.flatten_issues(spark.createDataFrame([([("G1", 3)],)], "global_clusters array<struct<global_cluster_id string, total_num_posts int>>")).first()
    assert row["global_cluster_id"] == "G1" and row["total_num_posts"] == 3 and row["short_description"] is None and len(row) == 7


def test_labels_shown(spark):
    df = spark.createDataFrame([("a", "b"), (" ", "b"), (None, ""), (None, None)], "i string, c string")
    assert [r[0] for r in df.select(reports.display_label(F.col("i"), F.col("c"), "-")).collect()] == ["a", "b", "-", "-"]


def test_shift_and_logarithm(spark):
    df = spark.createDataFrame([("y", "y", "n")] * 200 + [("n", "n", "n")] * 50, "g string, o string, n string")
    r = evaluation.label_shift(df, F.col("o"), F.col("n")).first()
    assert r["dof"] == 1 and r["shifted"] and 0 <= r["p_value"] < 1e-20
    p = evaluation.paired(df, F.col("g"), F.col("o"), F.col("n")).first()
    assert p["b"] == 200 and abs(p["log10_p"] - (1 - 200) * 0.30103) < 0.01
    three = spark.createDataFrame([("y", "n")] * 30 + [("n", "u")] * 30 + [("u", "y")] * 20, "o string, n string")
    t = evaluation.label_shift(three, F.col("o"), F.col("n")).first()
    assert t["dof"] == 2 and abs(t["p_value"] - 2.718281828 ** (-t["chi2"] / 2)) < 1e-6


def test_codes_with_signs_and_escaped_words(spark):
    codes = spark.createDataFrame([("A.1",), ("X/2",), ("C 10",), (".net",)], "code string")
    df = spark.createDataFrame([("p", "see a.1, and x/2"), ("q", "a.12 aa.1 X/ 2"), ("r", "C-10 (A.1)"), ("s", None)], "post_id string, t string")
    got = {r["post_id"]: r["matched"] for r in filters.match_codes(df, "post_id", F.col("t"), codes, "code", None).collect()}
    assert got == {"p": ["A.1", "X/2"], "r": ["A.1", "C10"]}
    assert [r[0] for r in spark.createDataFrame([("axb",), ("a.b",)], "t string").select(filters.any_word(F.col("t"), ["a.b"])).collect()] == [False, True]


def test_clamp_and_bounds(spark):
    df = spark.createDataFrame([("0.4",), ("7",), ("-1",), ("NaN",), ("Infinity",), ("high",), (None,)], "c string")
    assert [r[0] for r in df.select(filters.clamp_confidence(F.col("c"))).collect()] == [0.4, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert profile.length_bounds(None) == (20, 600) == profile.length_bounds("{") == profile.length_bounds("[]") and profile.length_bounds('{"bounds": {"max_tokens": 9}}') == (20, 9)


def test_storage_and_readers(spark, tmp_path):
    storage.write_text(spark, f"{tmp_path}/t.txt", "ü {x}\n")
    assert storage.read_text(spark, f"{tmp_path}/t.txt") == "ü {x}\n" and storage.children(spark, f"{tmp_path}/none") == [] and storage.matches(spark, f"{tmp_path}/*.zip") == []
    assert files.file_digests(spark, f"{tmp_path}/t.txt").first()["length"] == 7
    assert files.code_dictionary(spark, f"{tmp_path}/none").count() == 0 == files.code_dictionary(spark, f"{tmp_path}/t.txt").count()
    (tmp_path / "c.csv").write_text("CourseCode,x\n A1 ,1\n,2\n  ,3\n")
    assert [r[0] for r in files.code_dictionary(spark, f"{tmp_path}/c.csv").collect()] == ["A1"]
    (tmp_path / "m.json").write_text(json.dumps({"A": ["x", "y"], "B": []}))
    assert {tuple(r) for r in files.college_map(spark, f"{tmp_path}/m.json").collect()} == {("A", "x"), ("A", "y")}
    spark.range(1).write.parquet(f"{tmp_path}/one")
    assert set(files.required_tables(spark, {"o": f"{tmp_path}/one"})) == {"o"}
    with pytest.raises(FileNotFoundError, match="two"):
        files.required_tables(spark, {"o": f"{tmp_path}/one", "t": f"{tmp_path}/two"})
    ids = spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "cluster_id string")
    assert files.cluster_index(ids).count() == 1
    with pytest.raises(ValueError):
        files.cluster_index(ids.where("false"))
    sinks.write_csv(spark.createDataFrame([(1.239, None)], "a double, b double"), f"{tmp_path}/f", ["a", "b"], {"a": "%.2f", "b": "%.0f"})
    assert tuple(files.read_csv_text(spark, f"{tmp_path}/f", ["a"]).first()) == ("1.24", "")


def test_dimension_refresh(spark, tmp_path):
    new = lambda *r: spark.createDataFrame(list(r), "id string, v int")
    sinks.refresh_dimension(new(("a", 1), ("b", 1)), f"{tmp_path}/dim", "id", f"{tmp_path}/snap", 1.0)
    sinks.refresh_dimension(new(("b", 2), ("c", 2)), f"{tmp_path}/dim", "id", f"{tmp_path}/snap", 2.0)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/dim").collect()} == {("a", 1), ("b", 2), ("c", 2)} and spark.read.parquet(f"{tmp_path}/snap").count() == 4


def test_slow_and_unknown_clients():
    class Slow:
        def __call__(self, prompt):
            time.sleep(5)
            return "late"

    began = time.time()
    answer = classify.call_with_retry(Slow(), "p", 1, lambda s: None, timeout=0.2)
    assert answer[1] and "TimeoutError" in answer[3] and time.time() - began < 3
    makers = {"rule": lambda: classify.RuleClient(("x",)), "slow": Slow}
    assert [(n, ok) for n, ok, _ in classify.probe(makers, ["rule", "slow", "none"], timeout=0.2)] == [("rule", True), ("slow", False), ("none", False)]
    with pytest.raises(ValueError, match="unknown provider"):
        classify.client_of("none", makers)


def test_watermark_drops_what_is_too_late(spark, tmp_path):
    write = lambda name, times: (tmp_path / "in" / name).write_text("".join(json.dumps({"ts": t, "event_type": "a", "value": 1.0, "user_id": 1}) + "\n" for t in times))
    (tmp_path / "in").mkdir()
    write("1.json", ["2024-01-01T00:10:00Z", "2024-01-01T05:00:00Z"])
    read = spark.readStream.schema("ts timestamp, event_type string, value double, user_id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = feeds.run_to_table(feeds.windowed_counts(read, "1 hour", "2 hours"))
    assert [r["n"] for r in out.collect()] == [1]  # the second window may still grow
    assert feeds.run_to_table(feeds.sessions(read, "30 minutes"), "complete").count() == 2
