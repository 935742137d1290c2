"""Tables in and out."""

from deltascope.sources.materialize import materialize
from deltascope.sources.scan import scan, scan_csv, scan_json, scan_parquet
from deltascope.sources.sinks import export_csv, preview, run_records, write_run_records, write_snapshot

__all__ = [
    "export_csv", "materialize", "preview", "run_records", "scan", "scan_csv", "scan_json", "scan_parquet",
    "write_run_records", "write_snapshot",
]
