"""Keeping an index current from a stream of changed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiforge.sources.index import Analyzer, IndexStore


def latest(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last change of each key."""
    last = changes.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(*order, F.struct(*changes.columns).alias("row"))).alias("m"))
    return last.select("m.row.*")


def apply_changes(store: IndexStore, model_type: str, changes: DataFrame, key: str, columns: Sequence[str], analyzer: Analyzer = Analyzer(), op: str = "op", order: Sequence[str] = ("seq",)) -> None:
    """Applies a batch of rows (key, columns, op, order): "delete" or all columns null removes, anything else indexes anew.

    Rows whose columns are as they were when last indexed are passed over. The state after a batch depends on the batch and
    the state before only, and applying a batch twice is the same as once, so a redelivered micro-batch does no harm.
    What is written is the batch's own segment (see IndexStore).
    """
    rows = latest(changes, key, order).persist()
    gone = F.coalesce((F.col(op) == "delete") | F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull(), F.lit(False))
    new = rows.where(~gone)
    removed = rows.where(gone).select(F.col(key).cast("string").alias("model_id"))
    if not removed.isEmpty():
        store.remove(model_type, removed)
    if not new.isEmpty():
        store.upsert(model_type, new, key, columns, analyzer, skip_unchanged=True)
    rows.unpersist()


def index_stream(changes: DataFrame, store: IndexStore, model_type: str, key: str, columns: Sequence[str], checkpoint: str, analyzer: Analyzer = Analyzer(), op: str = "op", order: Sequence[str] = ("seq",), **trigger) -> StreamingQuery:
    """Starts a query that applies each micro-batch of a change stream to the index."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            apply_changes(store, model_type, df, key, columns, analyzer, op, order)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
