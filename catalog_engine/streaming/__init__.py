"""Incremental ingestion."""

from catalog_engine.streaming.ingest import IngestResult, ingest_stream

__all__ = ["IngestResult", "ingest_stream"]
