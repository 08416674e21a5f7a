import pytest
from pyspark.sql import functions as F

from quernstone.functions import parse, text
from quernstone.functions.sentiment import compound
from quernstone.operators import clusters, evaluation, filters, profile, reports, rows, sampling, search


def one(spark, schema, values, *columns):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]


def test_code_match(spark):
    codes = spark.createDataFrame([("D335",), ("d-336",), ("ABC",), ("X",), (None,)], "code string")
    df = spark.createDataFrame([("a", "D335!"), ("b", "about d-335"), ("c", "D 335 D336"), ("d", "xD335"), ("e", "D3350"), ("f", "abc"), ("g", None), ("h", "D335 d335"), ("i", "")], "id string, t string")
    got = {r["id"]: r["matched"] for r in filters.match_codes(df, "id", F.col("t"), codes, "code").collect()}
    assert got == {"a": ["D335"], "b": ["D335"], "f": ["ABC"], "h": ["D335"]}
    every = {r["id"]: r["matched"] for r in filters.match_codes(df, "id", F.col("t"), codes, "code", None).collect()}
    assert every["c"] == ["D335", "D336"]


def test_structural_filter(spark):
    schema = "post_id string, title string, selftext string, is_removed int, is_deleted int, is_promotional int"
    values = [("a", "t", None, None, None, None), ("b", None, " ", 0, 0, 0), ("c", "t", "x", 1, 0, 0), ("d", "t", "x", 0, 0, 1)]
    assert [r["post_id"] for r in filters.structural_filter(spark.createDataFrame(values, schema)).collect()] == ["a"]


def test_thresholds(spark):
    values = [(-0.3,), (-0.2,), (None,), (float("nan"),)]
    assert [r[0] for r in one(spark, "x double", values, filters.below(F.col("x"), -0.2))] == [True, False, False, False]
    assert [r[0] for r in one(spark, "x double", values, filters.below(F.col("x"), -0.2, True))] == [True, True, False, False]


def test_first_failing_reason_wins(spark):
    values = [("n", True, "", ""), ("y", True, "", "s"), ("Y ", False, " ", "s"), ("y", False, "c", None), ("y", False, "c", "s")]
    got = one(spark, "l string, e boolean, c string, s string", values, filters.pain_point_reasons(*(F.col(x) for x in "lecs")))
    assert [x[0] for x in got] == ["not_painpoint", "error_flagged", "empty_root_cause", "empty_snippet", None]


def test_text(spark):
    assert [x[0] for x in one(spark, "t string, b string", [("a", "b"), ("a", ""), (None, "b"), (None, None)], text.assemble(F.col("t"), F.col("b")))] == ["a\n\nb", "a", "b", ""]
    assert [x[0] for x in one(spark, "t string", [("",), (None,), ("abc",), ("abcde",), ("é😀",)], text.token_count(F.col("t")))] == [0, 0, 1, 2, 1]
    assert [x[0] for x in one(spark, "n int", [(19,), (20,), (149,), (150,), (299,), (300,), (600,), (601,)], text.length_bucket(F.col("n")))] == [None, "short", "short", "medium", "medium", "long", "long", None]
    assert one(spark, "t string", [("see  https://x.y/z now " + "a" * 20,)], text.preview(F.col("t"), 10)) == [("see now a…",)]
    assert [x[0] for x in one(spark, "s double", [(0.0,), (None,), (float("nan"),), (86400.5,)], text.epoch_date(F.col("s")))] == ["", "", "", "1970-01-02"]
    assert [x[0] for x in one(spark, "c string", [("A; B ;",), ("",), (None,)], text.split_multi(F.col("c")))] == [["A", "B"], [], []]
    assert one(spark, "a string, b string", [("{b}", "x.*")], text.render("{a}-{b}", a=F.col("a"), b=F.col("b"))) == [("x.*-x.*",)]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"contains_painpoint": "Y", "confidence": "0.7", "pain_points": [{"root_cause_summary": "r", "pain_point_snippet": "s"}]}', ("y", "r", "s", 0.7, False, False, False)),
        ('```json\n{"contains_painpoint": "n", "confidence": 1.5}\n```', ("n", "", "", 0.0, False, False, False)),
        ('Sure: {"contains_painpoint": "x"} done', ("u", "", "", 0.0, False, True, False)),
        ("contains_painpoint: y", ("y", "", "", 0.0, True, True, True)),
        ("contains_painpoint: y contains_painpoint: n", ("u", "", "", 0.0, True, True, True)),
        ('{"contains_painpoint": "y", "confidence": NaN, "pain_points": [null]}', ("y", "", "", 0.0, False, False, False)),
        ('[{"contains_painpoint": "y"} , 1', ("y", "", "", 0.0, False, False, False)),
        ("", ("u", "", "", 0.0, True, True, True)),
        (None, ("u", "", "", 0.0, True, True, True)),
    ],
)
def test_responses(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "r string").select(parse.parse_response(F.col("r")).alias("p")).select("p.*").first()
    assert tuple(row) == want


def test_confidence(spark):
    assert [x[0] for x in one(spark, "c double", [(0.5,), (-1.0,), (1.5,), (None,), (float("nan"),)], parse.clamp_confidence(F.col("c")))] == [0.5, 0.0, 0.0, 0.0, 0.0]


def test_confusion_guards_zero(spark):
    df = spark.createDataFrame([("n", "n"), ("n", "u")], "g string, p string")
    row = evaluation.confusion(df, F.col("g"), F.col("p")).first()
    assert (row["tn"], row["precision"], row["recall"], row["f1"], row["accuracy"]) == (2, 0.0, 0.0, 0.0, 1.0)
    assert evaluation.confusion(df.where("false"), F.col("g"), F.col("p")).first()["accuracy"] == 0.0


@pytest.mark.parametrize("b, c, p", [(2, 35, 1.024e-08), (0, 29, 3.725e-09), (7, 16, 0.09314), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, p):
    rows_ = [("y", "y", "n")] * b + [("y", "n", "y")] * c + [("y", "y", "y"), ("u", "y", "n")]
    got = evaluation.paired(spark.createDataFrame(rows_, "g string, o string, n string"), F.col("g"), F.col("o"), F.col("n")).first()
    assert (got["b"], got["c"]) == (b, c) and got["p_value"] == pytest.approx(p, rel=1e-3)


def test_profile(spark):
    df = spark.createDataFrame([(0,), (49,), (120,)], "n long")
    assert [tuple(r) for r in profile.histogram(df, "n", 50).orderBy("low").collect()] == [(0, 49, 2), (50, 99, 0), (100, 149, 1)]
    assert profile.histogram(df.where("false"), "n", 50).count() == 0
    ties = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "g string, v long")
    assert {r["g"] for r in profile.largest_groups(ties, "g", "v").collect()} == {"a", "b"}


def test_rows(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    assert {tuple(r) for r in rows.insert_absent(old, new, ["k"], [F.asc("v")]).collect()} == {(1, "a"), (2, "c")}
    assert {tuple(r) for r in rows.upsert(old, new, ["k"], [F.desc("v")]).collect()} == {(1, "b"), (2, "d")}
    wide = rows.append_widened(old, spark.createDataFrame([(1, 9), (3, 8)], "k int, w int"), "k")
    assert {tuple(r) for r in wide.collect()} == {(1, "a", None), (3, None, 8)}
    a, u, k = (spark.createDataFrame([(x,) for x in v], "id int") for v in ([1, 2], [2, 9], [1, 2, 3]))
    assert {tuple(r) for r in rows.coverage(a, u, k, "id").collect()} == {("both", 2), ("missing", 3), ("unknown", 9)}
    assert [r[0] for r in spark.range(1, 12).select(rows.chunk_of(F.col("id"), 5)).collect()] == [1] * 5 + [2] * 5 + [3]


def test_sampling(spark):
    df = spark.createDataFrame([(f"p{i}", f"c{i % 3}", "f" if i < 4 else "x") for i in range(30)], "id string, c string, kind string")
    got = sampling.round_robin(df, "id", ["c"], 12, "s", F.col("kind") == "f").collect()
    assert len(got) == 12 and {"p0", "p1", "p2", "p3"} <= {r["id"] for r in got}
    split = sampling.split_by_share(df, "id", ["c"], 0.7, "s").groupBy("c", "part").count().collect()
    assert {(r["part"], r["count"]) for r in split} == {("DEV", 7), ("TEST", 3)}
    single = sampling.split_by_share(df.limit(1), "id", ["c"], 0.7, "s").collect()
    assert len(single) == 1


def test_clusters(spark):
    flat = spark.createDataFrame([("A", "A_1", 2, ["p", "q"]), ("A", "B_1", 1, ["p"]), ("B", "B_2", 3, ["x"]), ("B", "A_1", 1, ["p"])], "course_code string, cluster_id string, num_posts int, post_ids array<string>")
    known = spark.createDataFrame([("p",), ("q",)], "post_id string")
    got = {tuple(r) for r in clusters.violations(flat, known).collect()}
    assert got == {("prefix", "A", "B_1"), ("prefix", "B", "A_1"), ("count", "B", "B_2"), ("unknown_post", "B", "B_2"), ("duplicate", "A", "A_1")}
    groups = spark.createDataFrame([("x", 1, ["b", "a"], "late"), ("x", 0, ["c"], "first")], "label string, batch int, members array<string>, description string")
    assert tuple(clusters.merge(groups).first()) == ("x", ["a", "b", "c"], "first")
    ids = clusters.global_ids(spark.createDataFrame([("b", 5), ("a", 5), ("c", 9)], "label string, total int"), "total", "label").collect()
    assert {r["label"]: r["global_id"] for r in ids} == {"c": "G001", "a": "G002", "b": "G003"}


def test_top_labels_break_ties_by_name(spark):
    df = spark.createDataFrame([("c", x, f"p{i}") for i, x in enumerate("ddaabbe")], "course string, label string, post string")
    assert tuple(reports.top_labels(df, "course", "label", "post").first()) == ("c", "a, b, d")


def test_search(spark):
    df = spark.createDataFrame([("Q1 ", "A Webinar", None), ("q1", None, "webinar!"), ("R2", "x", "y")], "course_code string, title string, selftext string")
    assert search.search_posts(df, "WEBINAR", "q1").count() == 2
    assert search.search_posts(df).count() == 3
    courses = spark.createDataFrame([("Q1", "Art", "Care; Law"), ("Q2", "Art", None)], "coursecode string, title string, colleges string")
    assert [r["coursecode"] for r in search.search_courses(courses, "art", "LAW").collect()] == ["Q1"]


def test_sentiment(spark):
    got = [x[0] for x in one(spark, "t string", [("good",), ("not good",), ("",), (None,), ("x " * 20000,)], compound(F.col("t")))]
    assert got[0] > 0 > got[1] and got[2:] == [0.0, 0.0, 0.0]
