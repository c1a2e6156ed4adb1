from millrace.operators.dedup import absent_from, keep_first
from millrace.operators.ordering import number_rows, running
from millrace.operators.quality import (
    clean,
    conformance_report,
    judge,
    rejected,
    rule_violations,
    split,
    to_event_columns,
    valid,
)

__all__ = [
    "absent_from",
    "clean",
    "conformance_report",
    "judge",
    "keep_first",
    "number_rows",
    "rejected",
    "rule_violations",
    "running",
    "split",
    "to_event_columns",
    "valid",
]
