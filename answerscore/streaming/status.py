"""Status changes of registrations as a stream: emit a row when a key's status differs from the last one seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, status string, seq long"


LEAST_ID = 256  # fixed value: registrations below it are not watched


def watched(rows: DataFrame, id_col: str = "key", least: int = LEAST_ID) -> DataFrame:
    """The rows whose registration id is ``least`` or more; ids that are no whole numbers count as 0."""
    return rows.filter(F.coalesce(F.expr(f"try_cast(`{id_col}` AS BIGINT)"), F.lit(0)) >= least)


def status_changes(stream: DataFrame) -> DataFrame:
    """(key, status, seq) changes of a stream of (key, status, seq); state is one status per key.

    A - B - A emits three rows.  Pending rows are ignored.  Within a batch, rows of a key are taken by ``seq``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        keep = []
        for status in rows["status"]:
            keep.append(status != last)
            last = status
        state.update((last,))
        yield rows[keep][["key", "status", "seq"]]

    rows = stream.filter("status is not null and status != 'pending'").select(F.col("key").cast("string"), "status", F.col("seq").cast("long"))
    return rows.groupBy("key").applyInPandasWithState(step, OUT, "last string", "append", GroupStateTimeout.NoTimeout)


def changes_in_batch(rows: DataFrame) -> DataFrame:
    """The same over a bounded table: rows whose status is not that of the row before it with their key."""
    from pyspark.sql import Window

    rows = rows.filter("status is not null and status != 'pending'").select(F.col("key").cast("string"), "status", F.col("seq").cast("long"))
    last = F.lag("status").over(Window.partitionBy("key").orderBy("seq"))
    return rows.withColumn("last", last).filter("last is null or last != status").drop("last")


def log_changes(stream: DataFrame, path: str, checkpoint: str):
    """Append each change to a Parquet log; returns the running query."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    return status_changes(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
