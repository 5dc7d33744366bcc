"""Decisions on schema changes that hold files back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.model import PENDING_APPROVAL
from tidemark.operators import ledger
from tidemark.operators.schema_history import open_decisions
from tidemark.operators.state_store import StateStore

# What a decided change is called in the history, by action.
DECIDED = {"accept": "approved", "merge": "approved", "reject": "rejected"}


def decide(store: StateStore, ingestion_id: str, action: str, at: datetime) -> int:
    """Accepts or rejects what waits for an ingestion; returns how many files that concerns.

    Accepted files are taken by the next run, which adds their columns and widens the types they need. Rejected ones
    are not read again. Repeating a decision made at the same moment replaces it.
    """
    token = f"decide-{at:%Y%m%dT%H%M%S%f}"
    store.append("ledger", ingestion_id, token, "decide", ledger.approve_schema(store.state(ingestion_id), action, F.lit(at)).drop("run_id"))
    waiting = open_decisions(store.read("schema_versions", ingestion_id)).filter(F.col("resolution_type") == PENDING_APPROVAL)
    decided = waiting.withColumns({"resolution_type": F.lit(DECIDED[action]), "resolved_at": F.lit(at), "run_id": F.lit(token)})
    store.append("schema_versions", ingestion_id, token, "decide", decided)
    return store.events(ingestion_id, token).count()
