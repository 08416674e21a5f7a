"""Files by the file system that Spark resolves a path to, local or shared."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _plain(fs):
    """Without the local file system's checksums: small files are edited by hand too, as locks are set."""
    return fs.getRawFileSystem() if fs.getScheme() == "file" else fs


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _resolve(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where it is missing."""
    fs, where = _resolve(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches, in order."""
    fs, where = _resolve(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [])


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, as prompts and manifests are."""
    fs, where = _resolve(spark, path)
    stream = _plain(fs).open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small text file."""
    fs, where = _resolve(spark, path)
    stream = _plain(fs).create(where, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
