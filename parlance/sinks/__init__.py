"""Sinks: tables in several formats, a ledger of quotable numbers, sessions as JSON lines, and an index of what is there."""

from .ledger import entries, read_ledger, save_numbers
from .tables import artifacts, cumulative_seconds, log_session, orphan_captions, read_markdown, save_conversations, save_pairs, save_records, save_table

__all__ = ["artifacts", "cumulative_seconds", "entries", "log_session", "orphan_captions", "read_ledger", "read_markdown", "save_conversations", "save_numbers", "save_pairs", "save_records", "save_table"]
