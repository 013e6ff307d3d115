"""Column functions."""

from catalog_engine.functions.sizes import n_chunks, sealed_size, upload_parts
from catalog_engine.functions.status import parse_restore_header, status_text
from catalog_engine.functions.text import (
    as_of_seconds,
    clean_details,
    clean_path,
    epoch_text,
    folded,
    hex_digest,
    normalize_dir,
    prefix_condition,
    prefix_stem,
    trim_space,
)

__all__ = [
    "as_of_seconds",
    "clean_details",
    "clean_path",
    "epoch_text",
    "folded",
    "hex_digest",
    "n_chunks",
    "normalize_dir",
    "parse_restore_header",
    "prefix_condition",
    "prefix_stem",
    "sealed_size",
    "status_text",
    "trim_space",
    "upload_parts",
]
