"""Readers of JSON lines, CSV, text and nested JSON; choice of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernstone.sources import storage


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """One object per line, blank lines skipped. strict: a bad line raises; else it is dropped. A missing path gives no rows."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def count_bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(good, bad): lines that do and don't read as the schema."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return lines.agg(F.count_if(F.col("r._corrupt").isNull()).alias("good"), F.count_if(F.col("r._corrupt").isNotNull()).alias("bad"))


def read_csv(spark: SparkSession, path: str, required: list[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks. All values are text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {', '.join(missing)}")
    return df


def read_csv_text(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV as text with nulls as empty strings."""
    return read_csv(spark, path, required).na.fill("")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the last in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__rn = 1").drop("__rn")


def read_json_folder(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON documents with their file name."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file_name", F.col("_metadata.file_name"))


def optional_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one; of columns it lacks counts (integers) are 0, the others null."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    lacking = lambda f: F.lit(0 if isinstance(f.dataType, T.IntegralType) else None).cast(f.dataType).alias(f.name)
    return df.select([F.col(f.name) if f.name in df.columns else lacking(f) for f in schema.fields])


def code_dictionary(spark: SparkSession, path: str, column: str = "CourseCode") -> DataFrame:
    """(code): trimmed non-blank codes of a CSV; a missing file, or one that can't be read or lacks the column, gives none."""
    none = spark.createDataFrame([], "code string")
    if not storage.exists(spark, path):
        return none
    try:
        return read_csv(spark, path, [column]).select(F.trim(column).alias("code")).where("code <> ''")
    except Exception:  # noqa: BLE001 - as documented
        return none


def required_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Parquet tables by name; raises with all that are missing before any is read."""
    missing = sorted(p for p in paths.values() if not storage.exists(spark, p))
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return {name: spark.read.parquet(p) for name, p in paths.items()}


def cluster_index(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    """One row of each non-blank cluster id; raises when there is none."""
    kept = df.where(F.trim(F.coalesce(key, F.lit(""))) != "")
    if kept.isEmpty():
        raise ValueError(f"no {key}")
    return kept.dropDuplicates([key])


def nonblank_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose ids are all there."""
    for k in keys:
        df = df.where(F.trim(F.coalesce(F.col(k), F.lit(""))) != "")
    return df


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256, length) of whole files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"), "length")


def college_map(spark: SparkSession, path: str) -> DataFrame:
    """(course_code, college): a JSON object of course code -> list of colleges; an empty list gives no row."""
    raw = spark.read.text(path, wholetext=True)
    return college_pairs(raw, "value")


def college_pairs(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("course_code", "c")).select("course_code", F.explode("c").alias("college"))


def allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(name): one per line; blank lines and # comments skipped, an r/ prefix dropped."""
    line = F.trim("value")
    return spark.read.text(path).select(F.regexp_replace(line, "^/?r/", "").alias("name")).where((F.col("name") != "") & ~F.startswith("name", F.lit("#"))).distinct()


def latest_by_name(spark: SparkSession, folder: str, needed: list[str]) -> str | None:
    """The sub-folder greatest by name that holds all needed files."""
    for name in reversed(storage.children(spark, folder)):
        if all(storage.exists(spark, f"{folder}/{name}/{n}") for n in needed):
            return f"{folder}/{name}"
    return None


def latest_by_time(spark: SparkSession, pattern: str) -> str | None:
    """The most recently written file."""
    row = spark.read.format("binaryFile").load(pattern).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row["p"]


def read_post_index(spark: SparkSession, path: str) -> DataFrame:
    """(post_id, fields map): a JSON index that is an array, an object holding one, or a map of objects by id."""
    fields = "map<string,string>"
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    array = F.from_json("v", f"array<{fields}>")
    held = F.from_json("v", f"struct<posts:array<{fields}>,post_index:array<{fields}>,items:array<{fields}>,data:array<{fields}>>")
    listed = F.when(F.startswith("v", F.lit("[")), array).otherwise(F.coalesce(held["posts"], held["post_index"], held["items"], held["data"]))
    flat = raw.select("v", listed.alias("l"))
    rows = flat.where("l IS NOT NULL").select(F.explode("l").alias("fields")).select(F.col("fields")["post_id"].alias("post_id"), "fields")
    keyed = flat.where("l IS NULL").select(F.explode(F.from_json("v", f"map<string,{fields}>"))).select(F.coalesce(F.col("value")["post_id"], F.col("key")).alias("post_id"), F.col("value").alias("fields"))
    return rows.unionByName(keyed)


def read_sql(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A relational table by query over JDBC; filters on it are pushed down. With partitionColumn, lowerBound,
    upperBound and numPartitions (and dbtable in place of the query) it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return (reader if "dbtable" in options else reader.option("query", query)).load()


def keep_existing(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    return df.select([n for n in names if n in df.columns])


def widen(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Adds missing columns as nulls; never drops one."""
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns])

