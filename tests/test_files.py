import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone import schemas
from quernstone.sources import files, sinks
from quernstone.sources.tables import require_columns
from quernstone.streaming import feeds

S = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n{"id": "b"\n{"id": "c", "n": 3}\n')
    assert {r["id"] for r in files.read_jsonl(spark, str(p), S, strict=False).collect()} == {"a", "c"}
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), S).collect()
    assert files.read_jsonl(spark, str(tmp_path / "none"), S).count() == 0
    assert tuple(files.count_bad_lines(spark, str(p), S).first()) == (2, 1)


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é😀", 1), (None, None)], S)
    assert sinks.write_jsonl(df, str(tmp_path / "o")) == 2
    assert set(files.read_jsonl(spark, str(tmp_path / "o"), S).collect()) == set(df.collect())
    with pytest.raises(Exception):
        sinks.write_jsonl(df, str(tmp_path / "o"), refuse=True)
    sinks.write_jsonl(df, str(tmp_path / "o"), append=True)
    assert files.read_jsonl(spark, str(tmp_path / "o"), S).count() == 4


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([('a "quoted", line\nbreak', None)], S)
    sinks.write_csv(df, str(tmp_path / "c"), ["id", "n", "extra"])
    row = files.read_csv_text(spark, str(tmp_path / "c"), ["id", "extra"]).first()
    assert tuple(row) == ('a "quoted", line\nbreak', "", "")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "c"), ["missing"])


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, ord int, v string")
    assert files.last_wins(df, "k", "ord").first()["v"] == "y"


def test_allowlist(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("# no\n\n r/One \nTwo\nr/One\n")
    assert {r["name"] for r in files.allowlist(spark, str(p)).collect()} == {"One", "Two"}


@pytest.mark.parametrize("body", ['[{"post_id": "a", "t": "x"}]', '{"items": [{"post_id": "a", "t": "x"}]}', '{"a": {"t": "x"}}'])
def test_post_index_shapes(spark, tmp_path, body):
    p = tmp_path / "i.json"
    p.write_text(body)
    assert [r["post_id"] for r in files.read_post_index(spark, str(p)).collect()] == ["a"]


def test_nested_folder_and_latest(spark, tmp_path):
    for name in ("r1", "r2", "r3"):
        (tmp_path / name).mkdir()
        if name != "r3":
            (tmp_path / name / "m.json").write_text(json.dumps({"courses": [{"course_code": "A", "clusters": []}]}))
    assert files.latest_by_name(spark, str(tmp_path), ["m.json"]).endswith("r2")
    assert files.latest_by_time(spark, f"{tmp_path}/*/m.json").endswith("m.json")
    df = files.read_json_folder(spark, f"{tmp_path}/*/m.json", schemas.CLUSTER_FILE)
    assert df.count() == 2 and df.first()["file_name"] == "m.json"


def test_optional_table(spark, tmp_path):
    assert files.optional_table(spark, str(tmp_path / "x"), S).count() == 0
    spark.range(2).selectExpr("CAST(id AS string) AS id").write.parquet(str(tmp_path / "y"))
    assert files.optional_table(spark, str(tmp_path / "y"), S).columns == ["id", "n"]


def test_columns(spark):
    df = spark.range(1).selectExpr("id AS z", "id AS a")
    assert files.keep_existing(df, ["a", "b", "z"]).columns == ["a", "z"]
    assert files.widen(df, S).columns == ["z", "a", "id", "n"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i:02}", i) for i in range(12)], S)
    sinks.write_chunks(df, "id", str(tmp_path / "chunks"))
    assert {r["chunk"]: r["count"] for r in spark.read.json(str(tmp_path / "chunks")).groupBy("chunk").count().collect()} == {1: 5, 2: 5, 3: 2}
    sinks.write_archive(df, "n", str(tmp_path / "arch"))
    assert (tmp_path / "arch" / "n=3").is_dir()
    sinks.append_snapshot(df, str(tmp_path / "snap"), 1.5)
    sinks.append_snapshot(df, str(tmp_path / "snap"), 2.5)
    assert spark.read.parquet(str(tmp_path / "snap")).groupBy("captured_at").count().count() == 2
    got = sinks.write_manifest(str(tmp_path / "m.json"), df.agg(F.count("*").alias("rows")), status="locked")
    assert got["rows"] == 12 and sinks.is_locked(spark, str(tmp_path / "m.json")) and not sinks.is_locked(spark, str(tmp_path / "no"))
    assert "- rows: 12" in sinks.overview(df.agg(F.count("*").alias("rows")), "T")
    df.write.parquet(str(tmp_path / "src" / "a.parquet"))
    assert sinks.copy_tables(spark, ["a", "b"], str(tmp_path / "src"), str(tmp_path / "dst")) == ["a"]
    with pytest.raises(Exception):
        sinks.copy_tables(spark, ["a"], str(tmp_path / "src"), str(tmp_path / "dst"))
    with pytest.raises(ValueError):
        require_columns(df, ["zzz"])


def test_frontier_ingest(spark, tmp_path):
    schema = "id string, source string, t long"
    read = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    write = lambda rows, name: (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("id", "source", "t"), r))) + "\n" for r in rows))
    (tmp_path / "in").mkdir()
    write([("a", "s", 5), ("a", "s", 5), ("b", "s", 3)], "1.json")
    feeds.ingest(read(), str(tmp_path / "out"), "id", "t", "source", str(tmp_path / "ck"))
    write([("c", "s", 4), ("d", "s", 9), ("a", "s", 10), ("e", "new", 1)], "2.json")
    feeds.ingest(read(), str(tmp_path / "out"), "id", "t", "source", str(tmp_path / "ck"))
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b", "d", "e"}
