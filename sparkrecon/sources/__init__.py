from sparkrecon.sources.dumps import (
    ingest_directory,
    ingest_files,
    inserts,
    parse_statements,
    rejected_files,
    rejected_statements,
    rejects,
    scan_directory,
    scan_files,
    statements_of_text,
    supported,
    unreadable_documents,
)

__all__ = [
    "ingest_directory",
    "ingest_files",
    "inserts",
    "parse_statements",
    "rejected_files",
    "rejected_statements",
    "rejects",
    "scan_directory",
    "scan_files",
    "statements_of_text",
    "supported",
    "unreadable_documents",
]
