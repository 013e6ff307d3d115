"""Table schemas and the fixed values of the container format."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("row_seq", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("version_id", T.StringType(), False),
        T.StructField("sha256", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("last_modified_at", T.LongType(), False),
        T.StructField("created_at", T.LongType()),
        T.StructField("deleted_at", T.LongType()),
    ]
)

# What a run hands over for insertion; row_seq, created_at and deleted_at are ours to set.
NEW_FILES = T.StructType(
    [f for f in FILES.fields if f.name not in ("row_seq", "created_at", "deleted_at")]
)

EVENTS = T.StructType(
    [
        T.StructField("started_at", T.LongType(), False),
        T.StructField("ended_at", T.LongType()),
        T.StructField("type", T.StringType(), False),
        T.StructField("details", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)

INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("last_modified_at", T.LongType(), False),
    ]
)

STAMPS = T.StructType(
    [
        T.StructField("row_seq", T.LongType(), False),
        T.StructField("deleted_at", T.LongType(), False),
    ]
)

# What a run stamps as deleted, by path, so that what is asked for a path prunes it as well.
DELETIONS = T.StructType([T.StructField("path", T.StringType(), False), *STAMPS.fields])

CHUNK_KEY = ["path", "version_id"]

# Sizes, defaults and limits of the container format. The 12-byte tag that
# opens a container is an argument (`magic`) wherever it is needed.
MAGIC_SIZE = 12
FORMAT_VERSION = 1
SALT_SIZE = 16
NONCE_PREFIX_SIZE = 7
NONCE_SIZE = 12
TAG_SIZE = 16
HEADER_SIZE = 49
CHUNK_SIZE = 16 * 1024 * 1024
ARGON_TIME = 3
ARGON_MEMORY_KIB = 65536
ARGON_THREADS = 4
MAX_ARGON_TIME = 20
MAX_ARGON_MEMORY_KIB = 4 * 1024 * 1024
MAX_ARGON_THREADS = 64
MAX_CHUNK_SIZE = 1024 * 1024 * 1024

# Event types and the message lines of empty listings.
EVENT_TYPES = ("backup", "restore")
NO_FILES = "No files found"
NO_VERSIONS = "No versions for file found"
NO_BACKUPS = "No backups found"
NO_RESTORES = "No restores found"
