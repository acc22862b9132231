"""Targets: replace, insert, update by key, JSON and CSV records, fan-out, packets."""

from weftline.sinks.writers import (
    append,
    compact,
    convert,
    fan_out,
    finish_update,
    merge_by_key,
    nest_packet,
    update_by_key,
    update_files,
    update_partitions,
    write_csv,
    write_files,
    write_json,
    write_routes,
)

__all__ = [
    "append", "compact", "convert", "fan_out", "finish_update", "merge_by_key", "nest_packet", "update_by_key",
    "update_files", "update_partitions", "write_csv", "write_files", "write_json", "write_routes",
]
