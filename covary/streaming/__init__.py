"""Incremental ingestion of event shards.

The reference has no streaming query: its event tables arrive as numbered
shard files that are read in one batch. This package only offers the
incremental form of that read-and-count step (Structured Streaming over a
shard folder, ``availableNow`` trigger, state and offsets in the reliable
checkpoint folder), so newly arrived shards update the same counts without
rescanning old ones. All analyses run on the resulting count table.
"""

from covary.streaming.incremental import run_available, stream_events, streaming_counts

__all__ = ["run_available", "stream_events", "streaming_counts"]
