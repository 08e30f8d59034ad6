"""Spark schemas of the records that move between the operators."""

from pyspark.sql import types as T

JOB_SIZE = T.StructType(
    [
        T.StructField("container_mb", T.IntegerType()),
        T.StructField("container_num_cores", T.IntegerType()),
        T.StructField("container_count", T.IntegerType()),
    ]
)

# Wire form of one click: {"timestamp": "...", "page": "..."}.
CLICK_JSON = T.StructType(
    [T.StructField("timestamp", T.StringType()), T.StructField("page", T.StringType())]
)

# Envelope of one diagnostics message. The metric tree has no fixed shape, so it is read
# as a variant, in the same pass as the envelope.
DIAGNOSTICS_JSON = T.StructType(
    [
        T.StructField("metricHeader", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metricsSnapshot", T.VariantType()),
        T.StructField("autoScalingEnabled", T.BooleanType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

# One parsed diagnostics message. `arr` is the arrival number: unique and increasing
# in the order in which the messages of a job were received. `ts` is epoch millis.
MESSAGES = T.StructType(
    [
        T.StructField("arr", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("attempt_id", T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("ts", T.LongType()),
        T.StructField("is_worker", T.BooleanType()),
        T.StructField("load", T.DoubleType()),
    ]
)


CAPACITY = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("free_cores", T.LongType()),
        T.StructField("free_mb", T.LongType()),
    ]
)

SIZING_ACTIONS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("attempt_id", T.StringType()),
        T.StructField("current_size", JOB_SIZE),
        T.StructField("target_size", JOB_SIZE),
        T.StructField("status", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)
