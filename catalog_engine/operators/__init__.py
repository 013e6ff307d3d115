"""Operators: DataFrames in, DataFrames out."""

from catalog_engine.operators.catalog import (
    file_exists,
    files_as_of,
    filter_prefix,
    latest_versions,
    list_files_multi,
    list_versions,
    live_only,
    sample_live,
    walked_paths,
)
from catalog_engine.operators.containers import (
    audit_containers,
    detect_format,
    forged_containers,
    open_legacy,
    parse_headers,
    split_container,
    split_legacy,
)
from catalog_engine.operators.content import (
    chunk_nonces,
    file_digests,
    open_chunks,
    plan_headers,
    seal_chunks,
    verify_sealed,
)
from catalog_engine.operators.diff import (
    apply_stamps,
    deletion_stamps,
    detect_changed,
    detect_deleted,
    detect_deletion_stamps,
    mark_deleted,
)
from catalog_engine.operators.events import (
    append_event,
    append_events,
    filter_events,
    list_events,
)
from catalog_engine.operators.listing import format_events, format_files, format_versions
from catalog_engine.operators.maintenance import (
    append_versions,
    applied_steps,
    current_schema_version,
    run_summary,
    upgrade_catalog,
    validate_events,
    validate_files,
)
from catalog_engine.operators.manifest import (
    check_bucket,
    format_status,
    lookup_checksums,
    parse_object_uri,
    restore_layout,
    restore_status,
    status_summary,
    to_manifest,
    verify_checksums,
)

__all__ = [
    "append_event",
    "append_events",
    "append_versions",
    "applied_steps",
    "apply_stamps",
    "audit_containers",
    "check_bucket",
    "chunk_nonces",
    "current_schema_version",
    "deletion_stamps",
    "detect_changed",
    "detect_deleted",
    "detect_deletion_stamps",
    "detect_format",
    "file_digests",
    "file_exists",
    "files_as_of",
    "filter_events",
    "filter_prefix",
    "forged_containers",
    "format_events",
    "format_files",
    "format_status",
    "format_versions",
    "latest_versions",
    "list_events",
    "list_files_multi",
    "list_versions",
    "live_only",
    "lookup_checksums",
    "mark_deleted",
    "open_chunks",
    "open_legacy",
    "parse_headers",
    "parse_object_uri",
    "plan_headers",
    "restore_layout",
    "restore_status",
    "run_summary",
    "sample_live",
    "seal_chunks",
    "split_container",
    "split_legacy",
    "status_summary",
    "to_manifest",
    "upgrade_catalog",
    "validate_events",
    "validate_files",
    "verify_checksums",
    "verify_sealed",
    "walked_paths",
]
