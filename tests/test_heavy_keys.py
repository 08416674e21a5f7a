from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.functions.codes import code_key
from quernstone.operators.heavy_keys import counts_per_key, find_heavy, heavy_keys


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [("A" if i % 3 else f"k{i % 500}", f"p{i % 700}", f"c{i % 11}" if i % 5 else None, i) for i in range(6000)] + [(None, "p1", "c1", -1)] * 30
    return spark.createDataFrame(rows, "code string, post string, cluster string, n_rows long"), rows


def test_counts_match_plain_grouping(skewed):
    df, rows = skewed
    got = {r["code"]: (r["n_rows"], r["n_posts"], r["n_clusters"]) for r in counts_per_key(df, "code", {"n_posts": "post", "n_clusters": "cluster"}).collect()}
    n = Counter(r[0] for r in rows if r[0])
    assert got == {k: (n[k], len({r[1] for r in rows if r[0] == k}), len({r[2] for r in rows if r[0] == k and r[2]})) for k in n}


def test_heavy_is_exact_with_ties_and_null_keys(spark):
    df = spark.createDataFrame([("x",)] * 5 + [("y",)] * 5 + [("z",)] * 4 + [(None,)] * 86, "code string")
    assert {r["code"] for r in heavy_keys(df, "code", {}, 0.05).collect()} == {"x", "y"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "code string, post string")
    assert counts_per_key(df, "code", {"n": "post"}).count() == 0
    assert heavy_keys(df, "code", {}, 0.05).count() == 0
    assert find_heavy(df, F.col("code"), 0.05).keys == []


def test_no_null_share(spark):
    with pytest.raises(ValueError):
        find_heavy(spark.range(1).selectExpr("'a' AS code"), F.col("code"), 1e-6)


def test_code_key(spark):
    df = spark.createDataFrame([(" d-335",), ("D 335!",), ("",), ("  ",), (None,)], "c string")
    assert [r[0] for r in df.select(code_key(F.col("c"))).collect()] == ["D335", "D335", None, None, None]


def test_very_long_keys_and_extra_columns(spark):
    long = "k" * 100_000
    df = spark.createDataFrame([(long, "p", 1), (long, "p", 2), ("b", None, 3)], "code string, post string, total long")
    got = {r["code"][:1]: (r["n_rows"], r["n_posts"]) for r in counts_per_key(df, "code", {"n_posts": "post"}).collect()}
    assert got == {"k": (2, 1), "b": (1, 0)}
