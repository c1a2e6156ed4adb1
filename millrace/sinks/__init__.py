from millrace.sinks.events import EventTable
from millrace.sinks.export import export_landing
from millrace.sinks.jdbc import JdbcEvents
from millrace.sinks.layout import save_bucketed, write_report_layout
from millrace.sinks.ledger import Ledger
from millrace.sinks.quarantine import read_rejected, write_rejected
from millrace.sinks.retry import with_retry

__all__ = [
    "EventTable",
    "JdbcEvents",
    "Ledger",
    "export_landing",
    "read_rejected",
    "save_bucketed",
    "with_retry",
    "write_rejected",
    "write_report_layout",
]
