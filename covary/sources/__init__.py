"""Sources and sinks: typed scans of event facts and indicator tables."""

from covary.sources.ingest import Ingested, ingest
from covary.sources.readers import (
    parse_json_column,
    read_events,
    read_indicator,
    read_table,
    union_all,
    write_table,
)

__all__ = [
    "Ingested",
    "ingest",
    "parse_json_column",
    "read_events",
    "read_indicator",
    "read_table",
    "union_all",
    "write_table",
]
