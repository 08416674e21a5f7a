"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(), "a": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in spec.split())])


POSTS = _struct("post_id:s subreddit_id:s username:s title:s selftext:s created_utc:d edited_utc:d score:l upvote_ratio:d is_promotional:i is_removed:i is_deleted:i flair:s post_type:s num_comments:l url:s permalink:s extra_metadata:s captured_at:d")
COMMENTS = _struct("comment_id:s post_id:s username:s parent_comment_id:s body:s created_utc:d edited_utc:d score:l is_promotional:i is_removed:i is_deleted:i extra_metadata:s captured_at:d")
SUBREDDITS = _struct("subreddit_id:s name:s description:s is_nsfw:i created_utc:d rules:s sidebar_text:s")
SUBREDDIT_STATS = _struct("subreddit_id:s captured_at:d subscriber_count:l active_users:l posts_per_day:d total_posts:l")
RUN_LOG = _struct("run_id:l started_at:d finished_at:d seeds_read:l posts_attempted:l comments_inserted:l failures:l")
GOLD = _struct("post_id:s split:s course_code:s contains_painpoint:s root_cause_summary:s ambiguity_flag:s labeler_id:s notes:s")
PREDICTIONS = _struct("post_id:s course_code:s true_contains_painpoint:s pred_contains_painpoint:s root_cause_summary_pred:s pain_point_snippet_pred:s confidence_pred:d parse_error:b schema_error:b used_fallback:b llm_failure:b")
PAINPOINTS = _struct("post_id:s course_code:s root_cause_summary:s pain_point_snippet:s")
INDEX = _struct("post_id:s cluster_id:s global_cluster_id:s course_code:s course_title:s")
CLUSTER_FILE = T.StructType(
    [
        T.StructField(
            "courses",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("course_code", T.StringType()),
                        T.StructField("course_title", T.StringType()),
                        T.StructField("total_posts", T.IntegerType()),
                        T.StructField("clusters", T.ArrayType(T.StructType([T.StructField("cluster_id", T.StringType()), T.StructField("issue_summary", T.StringType()), T.StructField("num_posts", T.IntegerType()), T.StructField("post_ids", T.ArrayType(T.StringType()))]))),
                    ]
                )
            ),
        )
    ]
)

# Labels of the issue families, in their order, with a description.
ISSUE_FAMILIES = {
    "assessment_material_misalignment": "what is tested is not what the material teaches",
    "unclear_or_ambiguous_instructions": "what is asked for is vague or contradicts itself",
    "course_pacing_or_workload": "time and effort are out of proportion",
    "technology_or_platform_issues": "labs, platforms or tools do not work",
    "staffing_or_instructor_availability": "nobody helps in time",
    "course_structure_or_navigation": "the order of the content stands in the way",
    "prerequisite_or_readiness_mismatch": "knowledge is presupposed that most lack, or repeated that most have",
    "other_or_uncategorized": "problems of a course that fit no other family",
}


def issue_families(spark: SparkSession) -> DataFrame:
    """(label, description, place): the families as a dimension of eight rows."""
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(ISSUE_FAMILIES.items(), 1)], "label string, description string, place int")
