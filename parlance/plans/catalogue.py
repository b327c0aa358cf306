"""Every registered query of the analytics layer and its oracle SQL."""

from . import contrasts, costs, detail, extra, faith, ledgers, older, scores, sessions, signals, studies
from .views import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "contrasts", "costs", "detail", "extra", "faith", "ledgers", "older", "scores", "sessions", "signals", "studies"]
