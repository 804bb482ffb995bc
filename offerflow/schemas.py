"""Record types of the data model as explicit Spark schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()

# One offer as it arrives from a source. seq/batch_id/source_rank carry the
# arrival order, because keep-first / keep-last depend on it.
OFFER = T.StructType(
    [
        T.StructField("seq", L),
        T.StructField("batch_id", L),
        T.StructField("source_rank", L),
        T.StructField("title", S),
        T.StructField("company", S),
        T.StructField("location", S),
        T.StructField("job_url", S),
        T.StructField("site", S),
        T.StructField("description", S),
        T.StructField("posted_at", S),
    ]
)

# History file as the reference writes it: a JSON array of offer records.
HISTORY_JSON = T.StructType(
    [
        T.StructField("title", S),
        T.StructField("company", S),
        T.StructField("location", S),
        T.StructField("job_url", S),
        T.StructField("site", S),
        T.StructField("description", S),
        T.StructField("posted_at", S),
        T.StructField("_corrupt_record", S),
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("match_score", T.IntegerType()),
        T.StructField("missing_skills", T.ArrayType(S)),
        T.StructField("advice", S),
    ]
)

# Raw verdict as text: score read as a string so that "80", 80.0 and 80.5
# can be told apart instead of silently becoming null.
VERDICT_RAW = T.StructType(
    [
        T.StructField("match_score", S),
        T.StructField("missing_skills", T.ArrayType(S)),
        T.StructField("advice", S),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("company", S),
        T.StructField("title", S),
        T.StructField("url", S),
        T.StructField("location", S),
        T.StructField("analysis", VERDICT),
    ]
)

RESULT_JSON = T.StructType(list(RESULT.fields) + [T.StructField("_corrupt_record", S)])

PROFILE = T.StructType(
    [
        T.StructField("profile_id", L),
        T.StructField("job_titles", T.ArrayType(S)),
        T.StructField("experience_levels", T.ArrayType(S)),
        T.StructField("exclude_keywords", T.ArrayType(S)),
        T.StructField("location", S),
        T.StructField("remote_only", T.BooleanType()),
        T.StructField("max_days_old", T.IntegerType()),
        T.StructField("model_name", S),
    ]
)

# One (search, address) pair in the table of attempts at scoring; the offer and its
# text are kept while the pair is not scored.
ATTEMPT = T.StructType(
    [
        T.StructField("profile_id", L),
        T.StructField("job_url", S),
        T.StructField("status", S),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("last_error", S),
        T.StructField("batch_id", L),
        T.StructField("source_rank", L),
        T.StructField("seq", L),
        T.StructField("title", S),
        T.StructField("company", S),
        T.StructField("location", S),
        T.StructField("description", S),
    ]
)

COMPILED = T.StructType(
    [
        T.StructField("groups", T.ArrayType(T.ArrayType(S))),
        T.StructField("excludes", T.ArrayType(S)),
    ]
)

# The same pair as it is stored: the text by its digest, and each text once.
ATTEMPT_ROW = T.StructType([*(f for f in ATTEMPT.fields if f.name != "description"), T.StructField("text_id", S)])
TEXT = T.StructType([T.StructField("text_id", S), T.StructField("description", S)])

# One HTML element of a page, as produced by the parse pass.
ELEMENT = T.StructType(
    [
        T.StructField("page_id", L),
        T.StructField("pos", L),
        T.StructField("depth", L),
        T.StructField("parent_pos", L),
        T.StructField("tag", S),
        T.StructField("el_id", S),
        T.StructField("el_class", S),
        T.StructField("data_test", S),
        T.StructField("href", S),
        T.StructField("text", S),
    ]
)
