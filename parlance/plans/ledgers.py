"""Ledgers of quotable numbers: entries of a query's rows under keys that name them."""

from __future__ import annotations

from ..sinks.ledger import entries
from . import contrasts, costs, faith, scores, sessions, signals, studies
from .views import ORACLE_SQL, QUERIES

#: ledger: (query, keys, values)
LEDGERS = {
    "lookahead_numbers": (scores.k_summary, ("method", "questionnaire"), ("n_sig_k0", "n_sig_k5", "mean_delta_trained", "max_abs_dz")),
    "transfer_numbers": (studies.sign_ladder, ("questionnaire", "rung"), ("n", "pct")),
    "retention_numbers": (contrasts.retention_by_k, ("reference", "questionnaire", "k"), ("n_kept", "mean_retention")),
    "instruments_numbers": (contrasts.wai_fig_data, ("arm", "scale"), ("gain", "lo", "hi")),
    "replication_numbers": (contrasts.sd_tally, ("method", "questionnaire"), ("n_k5_lower", "median_ratio")),
    "crossgen_numbers": (contrasts.pooled_arm_contrast, ("judge", "method"), ("mean_delta", "dz", "p")),
    "faithfulness_numbers": (faith.k_faithfulness_summary, ("method",), ("pooled", "by_iteration")),
    "dispersion_numbers": (studies.dispersion_by_iter, ("arm", "train_iter"), ("sd_mean", "margin_mean", "frac_sd_zero")),
    "tails_numbers": (signals.tail_audit_by_iter, ("method", "iteration"), ("full_share", "early_share", "mean_turns")),
    "compute_numbers": (costs.crossjudge_verdicts, ("select_judge", "eval_judge"), ("mean_delta", "p_holm")),
    "behavior_numbers": (sessions.miti_proficiency_by_iter, ("arm", "iteration"), ("r_to_q", "pct_cr", "pct_mico")),
}


def _ledger(name: str, query, keys: tuple[str, ...], values: tuple[str, ...]) -> None:
    def ledger(spark, sf_dir):
        return entries(query(spark, sf_dir), list(keys), list(values), query.__name__, digits=None)

    ledger.__name__ = name
    QUERIES[name] = ledger
    key = ", ".join(f"{k}::VARCHAR" for k in keys)
    text = "coalesce(regexp_replace({0}::DECIMAL(28,6)::VARCHAR, '\\.?0+$', ''), 'null')"
    parts = [f"SELECT concat_ws('.', {key}, '{v}') AS key, {text.format(v)} AS value, '{query.__name__}' AS source, '' AS note FROM base" for v in values]
    ORACLE_SQL[name] = f"WITH base AS ({ORACLE_SQL[query.__name__]}) " + " UNION ALL ".join(parts)


for _name, _spec in LEDGERS.items():
    _ledger(_name, *_spec)
