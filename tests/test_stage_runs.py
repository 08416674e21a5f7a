"""Stages from runs to issues on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import runs
from quernstone.plans import stages
from quernstone.sources import storage


def test_panel_and_false_positives(spark, tmp_path):
    index = spark.createDataFrame([("a", "m", "p", "p.txt", "DEV"), ("b", "m", "q", "q.txt", "TEST")], "run_id string, model string, prompt string, prompt_file string, split string")
    rows = spark.createDataFrame([("x", "n", "y"), ("y", "y", "y"), ("z", "maybe", "y")], "post_id string, true_contains_painpoint string, pred_contains_painpoint string")
    every = [("a", runs.normalised(rows)), ("b", runs.normalised(rows.limit(1)))]
    texts = spark.createDataFrame([("x", "T", "body")], "post_id string, title string, selftext string")
    panel = {(r["run_id"], r["post_id"]): (r["error_type"], r["is_correct"], r["n_chars"]) for r in stages.build_panel(index, every, texts, f"{tmp_path}/p", split="dev").collect()}
    assert panel == {("a", "x"): ("fp", False, 7), ("a", "y"): ("tp", True, None), ("a", "z"): ("ignore", False, None)}
    with pytest.raises(ValueError):
        stages.build_panel(index, every, texts, f"{tmp_path}/q", models=["none"])
    assert stages.collect_false_positives(index, every, f"{tmp_path}/fp") == 2


def test_combine_runs(spark, tmp_path):
    for name in ("r1", "r2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "predictions.csv").write_text("post_id,true_contains_painpoint,pred_contains_painpoint\n" + "".join(f"p{i},{'y' if i % 2 else 'n'},y\n" for i in range(12)) + "q,,y\n")
    assert stages.combine_runs(spark, [f"{tmp_path}/r*"], f"{tmp_path}/out") == {"rows": 24, "posts": 12, "runs": 2}
    assert spark.read.json(f"{tmp_path}/out/chunks").groupBy("chunk").agg(F.countDistinct("post_id").alias("n")).where("n <= 5").count() == 3


def test_from_pain_points_to_issues(spark, tmp_path):
    class Groups:
        """Puts all posts of a course into one cluster; fails for course B."""

        def __call__(self, prompt):
            course, lines = prompt.split("|", 1)
            if course == "B":
                raise RuntimeError("no")
            ids = [x.split(":")[0] for x in lines.splitlines()]
            return json.dumps([{"cluster_id": f"{course}_1", "issue_summary": "s", "post_ids": ids}])

    class Issues:
        def __call__(self, prompt):
            return json.dumps([{"provisional_label": "p", "normalized_issue_label": "one", "description": "d", "members": [x.split(":")[0] for x in prompt.splitlines()]}])

    pains = spark.createDataFrame([("p1", "A", "x"), ("p2", "A", None), ("p3", "B", "y"), ("p4", "C", "z"), ("p4", None, "z")], "post_id string, course_code string, root_cause_summary string")
    nested = stages.run_clustering(pains, "{course}|{painpoints}", Groups(), f"{tmp_path}/c", wait=lambda s: None)
    assert {r["course_code"]: None if r["clusters"] is None else [c["num_posts"] for c in r["clusters"]] for r in nested.collect()} == {"A": [2], "B": None, "C": [1]}
    assert stages.run_clustering(pains, "{course}|{painpoints}", Groups(), f"{tmp_path}/c1", most=1).count() == 1
    batched = stages.preprocess_clusters(nested, f"{tmp_path}/b", 1)
    assert batched.count() == 2 and batched.select("batch").distinct().count() == 2
    issues = stages.run_global_clusters(batched, "{clusters}", Issues(), f"{tmp_path}/g")
    row = issues.first()
    assert issues.count() == 1 and (row["global_cluster_id"], row["total_num_posts"], row["num_clusters"], row["num_courses"], row["short_description"]) == ("G001", 3, 2, 2, "d")
    assert stages.validate_global_clusters(issues, batched) == {"issues": 1, "clusters": 2}
    more = batched.unionByName(batched.limit(1).withColumn("cluster_id", F.lit("Z_9")))
    with pytest.raises(ValueError, match="missing 1"):
        stages.validate_global_clusters(issues, more)
    with pytest.raises(ValueError, match="total 1"):
        stages.validate_global_clusters(issues.withColumn("total_num_posts", F.lit(9)), batched)


def test_reports_are_written(spark, tmp_path):
    posts = spark.createDataFrame([("p1", "A"), ("p2", "A")], "post_id string, course_code string")
    pains = spark.createDataFrame([("p1", "A", "s")], "post_id string, course_code string, root_cause_summary string")
    index = spark.createDataFrame([("p1", "A_1", "G1", "A", "t")], "post_id string, cluster_id string, global_cluster_id string, course_code string, course_title string")
    courses = spark.createDataFrame([("A", "Title", "x")], "coursecode string, title string, colleges string")
    assert "- pain posts: 1" in stages.build_reports(posts, pains, index, courses, str(tmp_path / "r"))
    assert storage.exists(spark, f"{tmp_path}/r/overview.md") and spark.read.option("header", True).csv(f"{tmp_path}/r/courses").first()["top_issues"] == "G1"
