import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import classify
from quernstone.operators.threads import thread
from quernstone.plans import base, stages
from quernstone.sources.tables import table

DATA = "/root/testdata/sf0.001"


class Flaky:
    """Fails so often before it answers."""

    def __init__(self, fails):
        self.fails = fails

    def __call__(self, prompt):
        self.fails -= 1
        if self.fails >= 0:
            raise TimeoutError("late")
        return "ok " + prompt


def test_retries():
    waits = []
    assert classify.call_with_retry(Flaky(2), "p", 2, waits.append) == ("ok p", False, 2, "") and waits == [2.0, 4.0]
    assert classify.call_with_retry(Flaky(9), "p", 2, waits.append) == ("", True, 2, "TimeoutError: late")


def test_classify(spark):
    df = spark.createDataFrame([("a", "it is broken"), ("b", "fine"), ("c", None)], "id string, t string")
    got = {r["id"]: r for r in classify.classify(df, F.col("t"), classify.RuleClient(("broken",)), at_once=2).collect()}
    assert {k: v["label"] for k, v in got.items()} == {"a": "y", "b": "n", "c": "n"} and got["a"]["summary"] == "rule"
    replay = classify.ReplayClient({"fine": '{"contains_painpoint": "u"}'})
    got = {r["id"]: r for r in classify.classify(df, F.col("t"), replay, retries=0).collect()}
    assert got["b"]["label"] == "u" and not got["b"]["llm_failure"]
    assert got["a"]["label"] == "u" and got["a"]["llm_failure"] and not got["a"]["parse_error"]
    assert classify.error_counters(classify.classify(df, F.col("t"), replay, retries=0)).first()["llm_failure"] == 2
    assert classify.classify(df.where("false"), F.col("t"), replay).count() == 0


def test_thread_drops_replies_of_dropped_ones(spark):
    rows = [(f"r{i}", "post") for i in range(5)] + [(f"s{i}{j}", f"r{i}") for i in range(5) for j in range(4)]
    out = thread(spark.createDataFrame(rows, "id string, parent string"), "id", "parent", F.col("parent") == "post", [F.asc("id")]).collect()
    assert {r["id"] for r in out if r["level"] == 1} == {"r0", "r1", "r2"}
    assert len([r for r in out if r["level"] == 2]) == 9


def test_stages(spark, tmp_path):
    posts, courses = base.posts(spark, DATA), table(spark, DATA, "courses")
    built = stages.run_stage0(posts, table(spark, DATA, "subreddits"), courses, str(tmp_path / "s0"), manifest=str(tmp_path / "m.json"))
    n = built.count()
    assert n > 0 and built.where("sentiment >= -0.2").count() == 0 and json.loads((tmp_path / "m.json").read_text())["rows"] == n
    (tmp_path / "m.json").write_text('{"status": "locked"}')
    assert stages.run_stage0(posts, table(spark, DATA, "subreddits"), courses, str(tmp_path / "s0"), manifest=str(tmp_path / "m.json")) is None
    assert stages.build_length_profile(built, str(tmp_path / "len")).first()["n"] == n
    assert stages.build_stratified_sample(built, str(tmp_path / "sample"), target=20).count() <= max(20, n)
    done = stages.run_classifier(built, "{course}: {body}", classify.RuleClient(("broken", "unclear", "stuck")), str(tmp_path / "pred"))
    assert done.count() == n
    kept = stages.preprocess_painpoints(done, str(tmp_path / "pains"))
    assert kept.count() == done.where("label = 'y'").count()
    gold = done.select("post_id", F.col("label").alias("gold"))
    assert stages.evaluate(done, gold).first()["accuracy"] == 1.0
    with pytest.raises(ValueError):
        stages.evaluate(done, gold.limit(1))


def test_reports(spark, tmp_path):
    sizes = stages.build_analytics(base.posts(spark, DATA), base.pains(spark, DATA), base.index(spark, DATA), table(spark, DATA, "courses"), str(tmp_path))
    assert set(sizes) == {"post_master", "course_summary", "course_cluster_detail", "issue_course_matrix", "pipeline_counts_by_course", "pipeline_counts_by_college"} and all(sizes.values())


def test_validation_raises(spark):
    nested = spark.createDataFrame([("A", [("B_1", 2, ["p"])])], "course_code string, clusters array<struct<cluster_id:string,num_posts:int,post_ids:array<string>>>")
    with pytest.raises(ValueError, match="prefix"):
        stages.validate_clusters(nested, spark.createDataFrame([("p",)], "post_id string"))


def test_daily_update(spark, tmp_path):
    assert stages.daily_update([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: None)], str(tmp_path / "log"), spark) == 1
    assert spark.read.parquet(str(tmp_path / "log")).where("failure IS NOT NULL").first()["step"] == "b"


def test_inspect(spark):
    got = {r["table_name"]: r["n_rows"] for r in stages.inspect_tables(spark, DATA, ["region", "nation"]).collect()}
    assert got == {"region": 5, "nation": 25}
