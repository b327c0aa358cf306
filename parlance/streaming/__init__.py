"""Growing folders of records, folded run by run."""

from .sessions import RECORD, latest, run_once, session_totals, unfinished

__all__ = ["RECORD", "latest", "run_once", "session_totals", "unfinished"]
