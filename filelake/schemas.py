"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

FILE_METADATA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("mtime", T.DoubleType(), False),
        T.StructField("crypto_hash", T.StringType(), False),
        T.StructField("mime_type", T.StringType(), True),
        T.StructField("perceptual_hash", T.StringType(), True),
        T.StructField("content", T.StringType(), True),
        T.StructField("pronom_id", T.StringType(), True),
        T.StructField("exif_data", T.StringType(), True),
        T.StructField("content_embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("pii_types", T.ArrayType(T.StringType()), True),
        T.StructField("is_archived_file", T.BooleanType(), False),
        # Set once extraction was tried, so that files without text are not tried again.
        T.StructField("text_extracted", T.BooleanType(), True),
    ]
)

SCAN_LOG = T.StructType(
    [
        T.StructField("scan_id", T.StringType(), False),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("start_time", T.TimestampType(), False),
        T.StructField("end_time", T.TimestampType(), True),
        T.StructField("root_paths", T.ArrayType(T.StringType()), True),
        T.StructField("files_scanned", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
    ]
)

LISTING = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("ext", T.StringType(), False),
        T.StructField("parent", T.StringType(), False),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("mtime", T.DoubleType(), False),
    ]
)

ERRORS = T.StructType(
    [
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("stage", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
    ]
)
