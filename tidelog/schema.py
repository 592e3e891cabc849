"""Canonical schemas and enumerations of the log model."""

from __future__ import annotations

from pyspark.sql import types as T

RECORDS = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("segment_id", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("subject", T.StringType()),
        T.StructField("headers", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

# Record flag bits.
FLAGS = {"compressed": 1, "has_key": 2, "has_xxh3": 4, "has_subject": 8, "has_stream_tag": 16, "encrypted": 32}

# Loss reasons by code; all but the torn tail lose data.
LOSS_REASONS = {
    1: "torn_tail",
    2: "corrupt_record_header",
    3: "corrupt_record_body",
    4: "corrupt_segment_header",
    5: "sequence_gap",
    6: "scrubber_suspect",
    7: "unresolved_dict_id",
    8: "unknown_key_id",
    9: "aead_tag_mismatch",
}
HARMLESS_REASON = "torn_tail"

# Gap reasons.
GAP_TRIMMED, GAP_COMPACTED, GAP_FILTERED = 1, 2, 3
