"""The one record type of a log, and the names its columns go by."""

from __future__ import annotations

from pyspark.sql import types as T

#: What identifies a key within a partition.
KEY = ("prefix", "key")
#: A log row: order in the log (tx_id, seq), key, value and what decides between versions.
LOG = T.StructType(
    [
        T.StructField("tx_id", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("prefix", T.BinaryType()),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("ts_id", T.LongType(), False),
        T.StructField("tombstoned", T.BooleanType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("row_type", T.StringType(), False),
    ]
)
#: Kinds of rows a log holds.
ROW_TYPES = ("end_of_merge", "system", "highwater", "primary", "snappy_primary")
PRIMARY_TYPES = ("primary", "snappy_primary")
