"""Declared schemas of the tables and file-borne records."""

from pyspark.sql import types as T

PAGE = T.StructType([
    T.StructField("startAt", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("issues", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("fields", T.VariantType()),      # as delivered, declared or not
    ]))),
])

ISSUES = T.StructType([
    T.StructField("issue_key", T.StringType(), False),
    T.StructField("issue_id", T.LongType(), False),
    T.StructField("project", T.StringType(), False),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("resolution", T.StringType()),
    T.StructField("created", T.TimestampType(), False),
    T.StructField("updated", T.TimestampType()),
    T.StructField("resolutiondate", T.TimestampType()),
    T.StructField("raw", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("date_suspect", T.BooleanType()),
])

CHUNKS = T.StructType([
    T.StructField("issue_key", T.StringType(), False),
    T.StructField("strategy", T.StringType(), False),
    T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("embedded_at", T.TimestampType()),
])

GOLD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected", T.ArrayType(T.StringType())),
    T.StructField("candidate_sql", T.StringType()),
    T.StructField("judged", T.BooleanType()),
    T.StructField("notes", T.StringType()),
])

# One answered question: text, cited and context keys, cost.
ANSWERS = T.StructType([T.StructField("questions", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("cited_keys", T.ArrayType(T.StringType())),
    T.StructField("context_keys", T.ArrayType(T.StringType())),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("desc_chars_total", T.LongType()),
])))])

# {qid: {keys, scores{key: score}, seconds}}
SCORES = T.MapType(T.StringType(), T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("expected", T.ArrayType(T.StringType())),
    T.StructField("keys", T.ArrayType(T.StringType())),
    T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("seconds", T.DoubleType()),
]))

FORM_COLUMNS = ["priority", "issue_type", "open", "resolution",
                "created_from", "created_to", "text_terms", "parse_error"]
FORM = T.StructType([
    T.StructField("priority", T.ArrayType(T.StringType())),
    T.StructField("issue_type", T.ArrayType(T.StringType())),
    T.StructField("open", T.BooleanType()),
    T.StructField("resolution", T.ArrayType(T.StringType())),
    T.StructField("created_from", T.StringType()),
    T.StructField("created_to", T.StringType()),
    T.StructField("text_terms", T.ArrayType(T.StringType())),
    T.StructField("parse_error", T.BooleanType()),
])

PARSE_CACHE = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("parses", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("form", FORM),
        T.StructField("seconds", T.DoubleType()),
    ]))),
])
