"""Lives of pivots as keyed state of a streaming operator.

A pivot lives from its first touch until its score has decayed below the least
one to keep. Each pivot has its own state and a timer; a tick stands for a
millisecond of event time, so the watermark is the engine's clock.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..config import Settings
from ..deploy import ship

TOUCH = "topic_id long, pivot_id long, tick long"
LIFE = "topic_id long, pivot_id long, first_tick long, last_tick long, touches long, expired_tick long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def ticks_to_live(settings: Settings) -> int:
    """The first number of ticks without a touch after which a pivot's score is below the least one."""
    return math.floor(-math.log2(settings.min_keep) / settings.decay) + 1


class Lives(StatefulProcessor):
    """State of a pivot: first tick, last tick and touches of its present life.

    A touch that comes when the pivot's ticks are over ends the life and begins
    the next one, whether the timer has fired or not, so the rows don't depend
    on how the stream is cut into batches. A batch's ticks of one pivot are
    sorted in memory, 8 bytes each.
    """

    def __init__(self, ticks: int):
        self.ticks = ticks

    def init(self, handle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "first_tick long, last_tick long, touches long")

    def handleInputRows(self, key, rows, timerValues):
        ticks = np.sort(np.concatenate([f["tick"].to_numpy() for f in rows]))
        first, last, touches = self.life.get() if self.life.exists() else (int(ticks[0]), int(ticks[0]), 0)
        cuts = np.flatnonzero(np.diff(ticks, prepend=last) >= self.ticks)
        ended = []
        for run in np.split(ticks, cuts)[: len(cuts)]:
            if len(run):
                last, touches = int(run[-1]), touches + len(run)
            ended.append(self._row(key, first, last, touches))
            first, touches = int(ticks[cuts[len(ended) - 1]]), 0
        rest = ticks[cuts[-1] :] if len(cuts) else ticks
        last = int(rest[-1])
        self.life.update((first, last, touches + len(rest)))
        self.handle.registerTimer(last + self.ticks)
        if ended:
            yield pd.DataFrame(ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.life.exists():
            first, last, touches = self.life.get()
            if last + self.ticks <= expiredTimerInfo.getExpiryTimeInMs():
                self.life.clear()
                yield pd.DataFrame([self._row(key, first, last, touches)])

    def _row(self, key, first, last, touches) -> dict:
        names = (c.split()[0] for c in LIFE.split(", "))
        return dict(zip(names, (*map(int, key), first, last, touches, last + self.ticks), strict=True))

    def close(self) -> None:
        pass


class PivotLives:
    """Touches arrive in files, in the order of ticks from one advance to the next; ended lives leave in others, once each.

    The state is in the stream's checkpoint below root, which all executors
    share: whoever opens the same root goes on where the last one stopped.
    Rows without a topic, pivot or tick are left out; a tick below those of an
    earlier advance is late and dropped.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()

    def add(self, touches: DataFrame) -> None:
        """Appends touches (topic_id, pivot_id, tick) to the stream's input."""
        touches.dropna(subset=["topic_id", "pivot_id", "tick"]).select("topic_id", "pivot_id", "tick").write.mode("append").parquet(f"{self.root}/touches")

    def advance(self) -> None:
        """Takes all that was added since the last time, then stops."""
        ship(self.spark)
        rows = self.spark.readStream.schema(TOUCH).parquet(f"{self.root}/touches")
        rows = rows.withColumn("at", F.timestamp_millis("tick")).withWatermark("at", "0 seconds")
        ended = rows.groupBy("topic_id", "pivot_id").transformWithStateInPandas(Lives(ticks_to_live(self.settings)), LIFE, "append", "eventtime")
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            query = ended.writeStream.format("parquet").option("path", f"{self.root}/ended").option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
        finally:
            self.spark.conf.set(PROVIDER, before)
        query.awaitTermination()

    def ended(self) -> DataFrame:
        """(topic_id, pivot_id, first_tick, last_tick, touches, expired_tick) of the lives that are over at the last tick taken."""
        return self.spark.read.schema(LIFE).parquet(f"{self.root}/ended")
