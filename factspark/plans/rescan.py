"""Rescan: compare, invalidate, write, and commit last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.operators.artifacts import invalidate, sweep, swept
from factspark.operators.snapshot import changed_packages, next_snapshot, snapshot_diff
from factspark.session import cut_lineage
from factspark.sources import store as S


def rescan_state(previous: DataFrame, current: DataFrame, old_ids: DataFrame, new_ids: DataFrame,
                 ledger: DataFrame, new_version: int) -> dict[str, DataFrame]:
    """All outcomes of a rescan as DataFrames, without writing anything.

    Workspaces without a real change keep their ledger rows as they are.
    """
    diff = cut_lineage(snapshot_diff(previous, current))
    changed = cut_lineage(changed_packages(diff, old_ids, new_ids))
    moved = diff.where(F.col("change").isin("added", "modified", "removed")).select("ws").union(changed.select("ws")).distinct()
    active = sweep(ledger).join(moved, "ws", "left_semi")
    state = invalidate(active, changed, F.lit(new_version))
    return {"diff": diff, "changed": changed, "ledger": state, "swept": swept(ledger), "snapshot": next_snapshot(diff)}


def rescan(current: DataFrame, old_ids: DataFrame, new_ids: DataFrame, store: str, new_version: int) -> dict[str, DataFrame]:
    """Run a rescan against a store; the snapshot pointers are written last, those of vanished workspaces too."""
    spark = current.sparkSession
    previous = S.load_snapshot(spark, store)
    ledger = cut_lineage(S.load_ledger(spark, store).drop("payload")).withColumn("payload", F.lit(None).cast("string"))
    out = rescan_state(previous, current, old_ids, new_ids, ledger, new_version)
    S.append_states(out["ledger"], store, new_version)
    S.remove_artifacts(out["swept"], store, new_version)
    S.write_snapshot(out["snapshot"], store, new_version)
    S.commit_snapshot(out["diff"], store, new_version)
    return out
