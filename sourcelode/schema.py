"""Fixed row shapes."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values ---------------------------------------------------------------------------
SUMMARY_FILE = "whole project"
SUMMARY_NAME = "whole project summary"
# ---- end of fixed values --------------------------------------------------------------------

FILE_KEY = ["project", "file"]
ROW_KEY = ["project", "file", "kind_rank", "ord"]

INDEX = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("md5", T.StringType()),
        T.StructField("code_type", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("kind_rank", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("n_chunks", T.IntegerType()),
        T.StructField("decode_ok", T.BooleanType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("md5", T.StringType()),
        T.StructField("decode_ok", T.BooleanType()),
    ]
)
