"""Readers and writers."""

from catalog_engine.sources.catalog import (
    compact_catalog,
    last_row_seq,
    read_catalog,
    read_events,
)
from catalog_engine.sources.chunks import digest_files, read_chunks, read_file_chunks, read_ranges
from catalog_engine.sources.inventory import read_containers, read_heads, scan_inventory
from catalog_engine.sources.manifest import read_manifest
from catalog_engine.sources.runs import discard_run, write_run
from catalog_engine.sources.sinks import (
    adopt_snapshot,
    finish_parts,
    publish_catalog,
    write_containers,
    write_listing,
    write_parts,
)

__all__ = [
    "adopt_snapshot",
    "compact_catalog",
    "digest_files",
    "discard_run",
    "finish_parts",
    "last_row_seq",
    "publish_catalog",
    "read_catalog",
    "read_chunks",
    "read_containers",
    "read_events",
    "read_file_chunks",
    "read_heads",
    "read_manifest",
    "read_ranges",
    "scan_inventory",
    "write_containers",
    "write_listing",
    "write_parts",
    "write_run",
]
