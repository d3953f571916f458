"""Schemas and constants of the data model."""

from pyspark.sql import types as T

PUT, DELETE = 1, 2

#: One version of a key. ``value`` is NULL iff ``kind`` is DELETE; an empty value is a value.
KVLOG = T.StructType(
    [
        T.StructField("user_key", T.StringType(), False),
        T.StructField("seqno", T.LongType(), False),
        T.StructField("kind", T.IntegerType(), False),
        T.StructField("value", T.StringType(), True),
    ]
)
OP = T.StructType([T.StructField("op_type", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
BATCH = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("ops", T.ArrayType(OP))])
RECORD = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("start_offset", T.LongType()),
        T.StructField("end_offset", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("status", T.StringType()),
    ]
)
INTERNAL_KEY = T.StructType([T.StructField("user_key", T.BinaryType()), T.StructField("seqno", T.LongType()), T.StructField("kind", T.IntegerType())])
FILE_REF = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("file_id", T.LongType())])
ADDED_FILE = T.StructType([*FILE_REF.fields, T.StructField("size", T.LongType()), T.StructField("smallest", INTERNAL_KEY), T.StructField("largest", INTERNAL_KEY)])
EDIT = T.StructType(
    [
        T.StructField("edit_idx", T.LongType()),
        T.StructField("next_file_id", T.LongType()),
        T.StructField("last_sequence", T.LongType()),
        T.StructField("log_number", T.LongType()),
        T.StructField("deleted", T.ArrayType(FILE_REF)),
        T.StructField("added", T.ArrayType(ADDED_FILE)),
    ]
)

# Sizes of the binary layouts: fixed values.
RECORD_HEADER = 18
BATCH_HEADER = 8
KEY_SUFFIX = 9
BLOCK_ENTRY = 17
BLOCK_TRAILER = 4
INDEX_ENTRY = 25
FOOTER = 40
MEMTABLE_NODE = 41
DEFAULT_BLOCK_BYTES = 4096
MAX_RECORD_PAYLOAD = 64 << 20
MAX_EDIT_FIELD = 64 << 10

# Magics of our own artefacts.
WAL_MAGIC, MANIFEST_MAGIC, RUN_MAGIC = b"LLAKEWAL", b"LLAKEMAN", b"LLAKERUN"
FORMAT_VERSION = 1
FULL_RECORD = 1
