"""End-to-end jobs."""

from catalog_engine.plans.backup import BackupResult, backup_run
from catalog_engine.plans.listing import (
    list_events_to,
    list_files_to,
    list_sample_to,
    list_status_to,
    list_versions_to,
)
from catalog_engine.plans.restore import RestoreResult, restore_run

__all__ = [
    "BackupResult",
    "RestoreResult",
    "backup_run",
    "list_events_to",
    "list_files_to",
    "list_sample_to",
    "list_status_to",
    "list_versions_to",
    "restore_run",
]
