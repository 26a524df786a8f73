"""Explicit schemas of the engine's tables; nothing is inferred."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


BOARDS = _strings("company", "url")
POSTINGS_RAW = _strings("company", "title", "url", "place", "via", "ats")
POSTINGS_DETAILED = _strings("company", "title", "description", "url", "place", "via", "ats")
POSTINGS_FILTERED = T.StructType([*POSTINGS_DETAILED.fields, T.StructField("keyword_hits", T.LongType())])
MISSES = _strings("company", "url", "reason")
FETCHES = T.StructType([
    *_strings("url", "method", "request_body").fields,
    T.StructField("status", T.IntegerType()),
    *_strings("content_type", "final_url").fields,
    T.StructField("redirect_chain", T.ArrayType(T.StringType())),
    *_strings("body", "error").fields,
])
JOB_DATA = T.StructType([T.StructField("id", T.LongType()), *_strings("company", "title", "description", "url", "place").fields, T.StructField("timestamp", T.TimestampNTZType())])
ANALYSES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("adequation_grade", T.IntegerType()), T.StructField("depth_analysis", T.StringType()),
    T.StructField("ai_model", T.StringType()), T.StructField("job_id", T.LongType()),
])
GENERATED_CVS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("locale", T.StringType()), T.StructField("cv", T.StringType()), T.StructField("job_id", T.LongType()),
    T.StructField("ai_analysis_id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
])
VERDICT = "adequation_grade int, depth_analysis string"
CV = (
    "cv_introduction string, profile_text string, skills array<struct<competence:string, skills:array<string>>>, "
    "experiences array<struct<role:string, company:string, location:string, start_date:string, end_date:string, bullets:array<string>>>, "
    "education array<struct<diploma:string, institution:string, location:string, period:string, degree:string, details:string>>"
)
EVIDENCE = "page_id long, rule_idx int, ats string, signal_id string, source string, points int, tier int, matched string"
