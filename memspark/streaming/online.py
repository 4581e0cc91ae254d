"""Streams into the store, and supersession of facts as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import STORES
from ..sources.store import Store

#: An arrival, and the first and the last write of the facts it closes; null where it closes none.
CHANGE = "subject string, predicate string, object string, write_seq bigint, written_at timestamp, closed_first bigint, closed_last bigint"


def read_table(spark: SparkSession, path: str, store: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(STORES[store])
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def append_to(store: Store, name: str):
    """A foreachBatch function that appends each micro-batch to the log of a store. A batch that is retried is upserted again, to the same effect."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.append(batch, name)

    return write


def supersede_online(writes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Arrivals with the interval of writes they close: those of another object of their subject and predicate, one after another.

    State per (subject, predicate), of a fixed size: the open object, its first and its last write. Arrival
    decides; rows later than the watermark are dropped. Within a micro-batch rows count in the order of write_seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("write_seq", ignore_index=True)
        obj, first, last = state.get if state.exists else (None, None, None)
        known = obj is not None
        before = rows["object"].shift(1)
        before.iloc[0] = obj if known else rows["object"].iloc[0]
        # islands of one object; the open one goes on where the first row has its object
        changed = rows["object"] != before
        island = changed.cumsum()
        ends = rows.groupby(island)["write_seq"].agg(["min", "max"])
        if known:
            ends.loc[0, "min"], ends.loc[0, "max"] = first, ends["max"].get(0, last)
        closed = ends.reindex((island - 1).where(changed, -1)).reset_index(drop=True).astype("Int64")
        out = rows[["object", "write_seq", "written_at"]].assign(subject=key[0], predicate=key[1], closed_first=closed["min"], closed_last=closed["max"])
        open_ = ends.loc[island.iloc[-1]]
        state.update((rows["object"].iloc[-1], int(open_["min"]), int(open_["max"])))
        yield out[["subject", "predicate", "object", "write_seq", "written_at", "closed_first", "closed_last"]]

    keyed = writes.withWatermark("written_at", late).select("subject", "predicate", "object", "write_seq", "written_at")
    return keyed.groupBy("subject", "predicate").applyInPandasWithState(step, CHANGE, "object string, first bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"))
