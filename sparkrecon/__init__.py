"""Spark-native reconciliation and data-quality checks of tables."""

from sparkrecon.operators.reconcile import (
    reconcile,
    reconcile_rows,
    reconcile_rows_once,
    reconcile_rows_summary,
    reconcile_summary,
    reconcile_tables,
)
from sparkrecon.options import FIRST_MATCH, INDEXED, IngestOptions, ReconOptions, RunOptions
from sparkrecon.plans.validation import RunResult, reconcile_inserts, run

__all__ = [
    "FIRST_MATCH",
    "INDEXED",
    "IngestOptions",
    "ReconOptions",
    "RunOptions",
    "RunResult",
    "reconcile",
    "reconcile_inserts",
    "reconcile_rows",
    "reconcile_rows_once",
    "reconcile_rows_summary",
    "reconcile_summary",
    "reconcile_tables",
    "run",
]
