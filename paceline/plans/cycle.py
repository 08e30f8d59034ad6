"""One round of the scaler: evaluate, queue, issue."""

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

from paceline.operators.actions import enqueue, mark_issued, next_to_issue, trim, with_capacity
from paceline.plans.evaluate import Now, evaluate
from paceline.plans.policies import Settings
from paceline.session import saved

log = logging.getLogger(__name__)

# Receives the actions to apply and returns the (job_id, seq) of those it has applied, or None
# for all. What it does not return stays queued for the next round, and so does all after an
# exception, so an enforcer that can fail half-way should catch that and return what is done.
Enforcer = Callable[[DataFrame], DataFrame | None]

# A table, or where to read it anew in every round.
Fresh = DataFrame | Callable[[], DataFrame] | None


def now_read(table: Fresh) -> DataFrame | None:
    return table() if callable(table) and not isinstance(table, DataFrame) else table


def queue_round(
    actions: DataFrame, proposals: DataFrame, seq: int, settings: Settings
) -> DataFrame:
    """Queue after the proposals of a round were appended and old actions trimmed."""
    return trim(enqueue(actions, proposals, seq), settings.max_actions)


def issue_round(
    actions: DataFrame, capacity: Fresh = None, enforce: Enforcer | None = None
) -> tuple[DataFrame, DataFrame]:
    """(queue after the round, actions issued in it). A head that finds no capacity or that
    was not applied stays enqueued and is tried again in the next round."""
    issued = with_capacity(next_to_issue(actions), now_read(capacity))
    if enforce is not None:
        issued = saved(issued)
        try:
            applied = enforce(issued)
        except Exception:
            log.exception("applying actions failed; they stay enqueued")
            return actions, issued.limit(0)
        if applied is not None:
            keys = ["job_id", "seq"]
            issued = issued.join(saved(applied.select(*keys)), keys, "left_semi")
    return mark_issued(actions, issued), issued


def run_round(
    messages: DataFrame,
    actions: DataFrame,
    settings: Settings,
    now_ms: Now,
    seq: int,
    *,
    job_config: Fresh = None,
    capacity: Fresh = None,
    enforce: Enforcer | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Evaluate, enqueue, trim and issue once; returns (queue, issued)."""
    proposals = evaluate(
        messages, settings, now_ms, job_config=now_read(job_config), actions=actions
    )
    return issue_round(queue_round(actions, proposals, seq, settings), capacity, enforce)
