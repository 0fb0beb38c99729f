"""Watch a folder for finished frame stacks.

Symmetrising needs whole stacks, so the stream only notices files.  A state by
folder counts the different frames; a stack is handed over once, when it has
its frames, or when it has grown no more for a while.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STACKS = "folder string, frames long, bytes long, reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """New frame files below ``root``, without their content: folder, name, bytes, modified."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.[iI][mM][gG]").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


class Stack(StatefulProcessor):
    """The frames of one folder: their names and sizes, and whether the stack was handed over.

    With ``frames`` a stack is complete at that many different names; else, or
    if it falls short, when ``quiet_ms`` pass without a new name.  Names that
    come again count once.  Names that come after a stack was handed over are
    kept, and start no new one.
    """

    def __init__(self, frames: int | None, quiet_ms: int) -> None:
        self.frames, self.quiet_ms = frames, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "name string", "bytes long")
        self.done = handle.getValueState("done", "frames long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = 0
        for row in rows:
            new += not self.names.containsKey((row.name,))
            self.names.updateValue((row.name,), (row.bytes or 0,))
        if self.done.exists() or not new:
            return
        sizes = [v[0] for v in self.names.values()]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.frames is not None and len(sizes) >= self.frames:
            yield self._hand_over(key, sizes, "complete")
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.done.exists():
            yield self._hand_over(key, [v[0] for v in self.names.values()], "quiet")

    def _hand_over(self, key, sizes: list[int], reason: str) -> Row:
        self.done.update((len(sizes),))
        return Row(folder=key[0], frames=len(sizes), bytes=sum(sizes), reason=reason)

    def close(self) -> None:
        pass


def stacks(files: DataFrame, frames: int | None = None, quiet_ms: int = 60_000) -> DataFrame:
    """``files(folder, name, bytes)``, a stream, to one row for each finished stack: (folder, frames, bytes, reason).

    The state is a row a frame, in RocksDB, dealt by folder.
    """
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return files.select("folder", "name", "bytes").groupBy("folder").transformWithState(statefulProcessor=Stack(frames, quiet_ms), outputStructType=STACKS, outputMode="append", timeMode="processingTime")


def watch(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[SparkSession, str, int], None], frames: int | None = None, quiet_ms: int = 60_000, every: str = "10 seconds") -> StreamingQuery:
    """Call ``handle(spark, folder, frames)`` once for each finished stack."""

    def batch(df: DataFrame, _: int) -> None:
        for folder, n in df.select("folder", "frames").toLocalIterator():
            handle(spark, folder, n)

    return stacks(arrivals(spark, root), frames, quiet_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
