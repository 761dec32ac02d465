"""Stateful breach counter over a stream of evaluation windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltframe.operators.governance import BREACH_THRESHOLD, REQUIRED_BREACHES

OUTPUT = (
    "area string, target string, window_start timestamp, degraded boolean, "
    "consecutive_breaches long, rollback boolean"
)


def _count(threshold: float, required: int):
    def run(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches), ignore_index=True).sort_values("window_start")
        degraded = rows["champion_error"] > rows["reference_error"] * (1 + threshold)
        counts = []
        for breach in degraded.tolist():
            streak = streak + 1 if breach else 0
            counts.append(streak)
        state.update((streak,))
        yield pd.DataFrame(
            {
                "area": key[0],
                "target": key[1],
                "window_start": rows["window_start"],
                "degraded": degraded,
                "consecutive_breaches": counts,
                "rollback": [c >= required for c in counts],
            }
        )

    return run


def stream_breaches(
    windows: DataFrame, threshold: float = BREACH_THRESHOLD, required: int = REQUIRED_BREACHES
) -> DataFrame:
    """Per (area, target): consecutive degraded windows; the state is a single counter.

    Windows of one micro-batch and key are sorted in the task; a trigger interval holds few of them.
    A reference error that is null or not positive fails the query, as in the batch counter.
    """
    reference = F.col("reference_error")
    positive = F.when(reference > 0, reference).otherwise(
        F.raise_error(F.lit("reference error must be positive")).cast("double")
    )
    return windows.withColumn("reference_error", positive).groupBy("area", "target").applyInPandasWithState(
        _count(threshold, required), OUTPUT, "streak long", "append", GroupStateTimeout.NoTimeout
    )


class OrderedBreaches(StatefulProcessor):
    """Holds windows until the watermark has passed them and then counts them in the order of their start.

    State per product: the windows that wait, one entry per start, and the streak. A timer per waiting window fires when the watermark
    passes its start; until then earlier windows may still arrive, in whatever batch.
    """

    def __init__(self, threshold: float, required: int):
        self.threshold, self.required = threshold, required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        errors = T.StructType([T.StructField("champion", T.DoubleType()), T.StructField("reference", T.DoubleType())])
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("start", T.LongType())]), errors)
        self.streak = handle.getValueState("streak", T.StructType([T.StructField("length", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            starts = batch["window_start"].astype("datetime64[us]").astype("int64").tolist()
            for start, champion, reference in zip(starts, batch["champion_error"].tolist(), batch["reference_error"].tolist(), strict=True):
                self.waiting.updateValue((start,), (champion, reference))
                self.handle.registerTimer(-(-start // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All waiting windows that the watermark has passed, in order; other timers of the batch then find none."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((start[0], errors) for start, errors in self.waiting.iterator() if start[0] <= passed)
        if not due:
            return
        streak = self.streak.get()[0] if self.streak.exists() else 0
        out = []
        for start, (champion, reference) in due:
            degraded = champion > reference * (1 + self.threshold)
            streak = streak + 1 if degraded else 0
            out.append((*key, pd.Timestamp(start, unit="us"), degraded, streak, streak >= self.required))
            self.waiting.removeKey((start,))
        self.streak.update((streak,))
        yield pd.DataFrame(out, columns=["area", "target", "window_start", "degraded", "consecutive_breaches", "rollback"])

    def close(self) -> None:
        pass


def stream_ordered_breaches(
    windows: DataFrame, delay: str, threshold: float = BREACH_THRESHOLD, required: int = REQUIRED_BREACHES
) -> DataFrame:
    """``stream_breaches`` in event time: a window that arrives up to ``delay`` after later ones, in any batch, still counts in order.

    A window is answered once the watermark has passed its start; of windows with one start the last counts. Windows later than the
    delay are dropped, as the watermark promises. The state store must be RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    reference = F.col("reference_error")
    positive = F.when(reference > 0, reference).otherwise(
        F.raise_error(F.lit("reference error must be positive")).cast("double")
    )
    return (
        windows.withColumn("reference_error", positive)
        .withWatermark("window_start", delay)
        .groupBy("area", "target")
        .transformWithStateInPandas(OrderedBreaches(threshold, required), OUTPUT, "append", "EventTime")
    )
