"""Scans: files, tables, incremental fetch, generated rows, XML records."""

from weftline.sources.readers import (
    batch_report,
    fetch_incremental,
    fetch_next,
    generate,
    high_water,
    incremental,
    read_batch,
    read_fetched,
    read_files,
    read_jdbc,
    read_table,
    source_qualifier,
    sql_call,
    unread_files,
)
from weftline.sources.xml import attributes_map, read_xml, xml_children, xml_flatten

__all__ = [
    "attributes_map", "batch_report", "fetch_incremental", "fetch_next", "generate", "high_water", "incremental", "read_batch",
    "read_fetched", "read_files", "read_jdbc", "read_table", "read_xml", "source_qualifier", "sql_call",
    "unread_files", "xml_children", "xml_flatten",
]
