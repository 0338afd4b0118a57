"""Everything in a row: ingest, fuse, plan the training, sum up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeflow.operators import reports
from nodeflow.params import Params
from nodeflow.plans.fuse import fuse
from nodeflow.plans.ingest import ingest
from nodeflow.plans.training import training_plan


def with_training_columns(nodes: DataFrame) -> DataFrame:
    """Columns the plan reads that fresh nodes do not have yet."""
    fresh = {"has_weights": F.col("is_trained"), "forced_root": F.lit(False), "quarantine_count": F.lit(0),
             "last_quarantine_exit": F.lit(None).cast("timestamp_ntz")}
    return nodes.withColumns({c: F.coalesce(c, v) if c in nodes.columns else v for c, v in fresh.items()})


def full_run(rows: DataFrame, params: Params, as_of: Column, batches: int = 1) -> dict[str, DataFrame]:
    state = ingest(rows, params, batches)
    state, report = fuse(state, params)
    plan = training_plan(with_training_columns(state["nodes"]), state["pointers"], as_of, params)
    return {**state, "report": report, "plan": plan, "summary": reports.run_summary(state["nodes"]),
            "top": reports.top_nodes(state["nodes"])}
