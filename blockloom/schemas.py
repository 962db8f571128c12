"""Explicit schemas and fixed ids."""

from __future__ import annotations

from pyspark.sql import types as T

# Layout of the special ids in front of every built vocabulary.
SPECIALS = {"pad": 0, "unk": 1, "bos": 2, "eos": 3, "mask": 4}

# Fixed value: the label that losses ignore.
IGNORE_LABEL = -100

# Fixed value: rows handed to one packing call.
PACK_BATCH_ROWS = 16_000

TEXT = T.StructType([T.StructField("text", T.StringType())])

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("split", T.StringType(), False),
        T.StructField("text", T.StringType()),
    ]
)

VOCAB = T.StructType(
    [
        T.StructField("token", T.StringType(), False),
        T.StructField("id", T.IntegerType(), False),
    ]
)

PREPARED_ENTRY = T.StructType(
    [
        T.StructField("base", T.StringType(), False),
        T.StructField("fingerprint", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("created", T.TimestampType()),
    ]
)
