"""Faceted search over posts and courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import split_multi


def contains_text(words: str, *columns: str) -> Column:
    """A lower-cased substring in any of the columns."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(words.lower()))
    return out


def search_posts(posts: DataFrame, words: str = "", course: str = "") -> DataFrame:
    found = posts.where(contains_text(words, "title", "selftext")) if words else posts
    return found.where(F.upper(F.trim("course_code")) == course.strip().upper()) if course else found


def search_courses(courses: DataFrame, words: str = "", college: str = "") -> DataFrame:
    found = courses.where(contains_text(words, "coursecode", "title")) if words else courses
    return found.where(F.exists(split_multi(F.col("colleges")), lambda x: F.lower(x) == college.strip().lower())) if college else found


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values with their number of rows."""
    return df.where(F.trim(F.col(column)) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
