from revloom.sources.readers import (
    read_businesses,
    read_json,
    read_lines,
    read_numbered_lines,
    read_reviews,
    read_table,
    read_users,
    read_whole_records,
)
from revloom.sources.writers import append_metrics, load_model, save_model, write_edges, write_summary, write_table

__all__ = [
    "append_metrics",
    "load_model",
    "read_businesses",
    "read_json",
    "read_lines",
    "read_numbered_lines",
    "read_reviews",
    "read_table",
    "read_users",
    "read_whole_records",
    "save_model",
    "write_edges",
    "write_summary",
    "write_table",
]
