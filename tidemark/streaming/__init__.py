"""Structured Streaming: continuous ingest, live bars and replication."""

from tidemark.streaming.bars import maintain_bars
from tidemark.streaming.ingest import ingest_json, ingest_kafka, ingest_stream, parse_ticks
from tidemark.streaming.replication import Replica, read_since

__all__ = ["Replica", "ingest_json", "ingest_kafka", "ingest_stream", "maintain_bars", "parse_ticks", "read_since"]
