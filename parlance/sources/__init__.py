"""Readers of the files that runs and graders leave behind: a score lake of CSV, its fold to Parquet, nested JSON lines, manifests."""

from .events import bad_tails, boundaries, read_events, smoothed, training_curves
from .lake import cached, discover_arms, filter_arms, fold, fold_report, fold_status, judge_scores, judges, read_generations, read_pairs, read_scores, reset_cache, served, signatures, verify_fold
from .ragged import aligned, load_beside, load_crossgen, load_evaluations, read_ragged, state_means

__all__ = [
    "aligned", "bad_tails", "boundaries", "cached", "discover_arms", "filter_arms", "fold", "fold_report", "fold_status", "judge_scores", "judges", "load_beside", "load_crossgen", "load_evaluations",
    "read_events", "read_generations", "read_pairs", "read_ragged", "read_scores", "reset_cache", "served", "signatures", "smoothed", "state_means", "training_curves", "verify_fold",
]
