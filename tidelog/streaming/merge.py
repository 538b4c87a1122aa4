"""Streams: accepting a log's rows with state per log, and releasing many logs in one order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accept_stream(rows: DataFrame, emitted: int = 0, start_floor: int = 0) -> DataFrame:
    """A stream (log_id, ordinal, idx, seq) with outcome, as operators.delivery.accept has it; the state of a
    log is the highest seq it has shown. A micro-batch's rows are put in the log's order first."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (high,) = state.get if state.exists else (0,)
        df = pd.concat(list(parts)).sort_values(["ordinal", "idx"])
        out = []
        for seq in df["seq"]:
            if seq <= high:
                out.append("duplicate")
            elif seq <= emitted:
                out.append("floor" if seq <= start_floor else "late")
            else:
                out.append("accepted")
            high = max(high, seq)
        state.update((int(high),))
        yield df.assign(outcome=out)[["log_id", "ordinal", "idx", "seq", "outcome"]]

    kind = rows.schema["log_id"].dataType.simpleString()
    out = rows.select("log_id", "ordinal", "idx", "seq").groupBy("log_id")
    return out.applyInPandasWithState(step, f"log_id {kind}, ordinal long, idx long, seq long, outcome string", "high long", "append", GroupStateTimeout.NoTimeout)


class Merger:
    """A foreachBatch sink that releases rows up to the least watermark of all logs followed, in seq order.

    Rows that wait are a table per batch (pending/<batch>), released ones another (out/<batch>), and so is what
    is known of the logs (state/<batch>): all are named by the batch and overwritten, so a batch that is run
    again leaves what it left before. Watermarks come as rows of their own (kind 'watermark'), for an idle log
    moves on too. `logs` are followed from the start and hold everything back until they are heard.

    A log is followed from a row of kind 'join' on: it owes the events above the merger's position of then, and
    its watermark starts just below it, so nothing is released until it is heard. From a row of kind 'leave' on
    it holds nothing back; what it has sent is still released. What comes at or below the position is late: it
    is counted and left out, for others were released past it."""

    STATE = "log_id long, watermark long, late long"

    def __init__(self, spark: SparkSession, root: str, logs: list, schema: str, start_floor: int = 0):
        self.spark, self.root, self.logs, self.schema, self.start_floor = spark, root, logs, schema, start_floor

    def _read(self, name: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            first = [(None, self.start_floor, 0), *[(x, self.start_floor - 1, 0) for x in self.logs]] if name == "state" else []
            return self.spark.createDataFrame(first, schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{batch}")

    def position(self, batch: int) -> int:
        """Everything at or below this has been released when the batch is done, or is below the start floor."""
        return self._read("state", batch, self.STATE).filter("log_id is null").first()["watermark"]

    def late(self, batch: int) -> int:
        """Rows of the batch that came too late."""
        return self._read("state", batch, self.STATE).filter("log_id is null").first()["late"]

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        before, at = self._read("state", batch - 1, self.STATE).filter("log_id is not null"), self.position(batch - 1)
        own = F.col("log_id").cast("long").alias("log_id")
        joined = rows.filter("kind = 'join'").select(own, F.lit(at - 1).cast("long").alias("watermark"))
        heard = rows.filter("kind not in ('join', 'leave')").groupBy(own).agg(F.max("seq").alias("_heard"))
        marks = before.select("log_id", "watermark").unionByName(joined).groupBy("log_id").agg(F.max("watermark").alias("watermark"))
        marks = marks.join(rows.filter("kind = 'leave'").select(own), "log_id", "left_anti").join(heard, "log_id", "left")
        marks = marks.select("log_id", F.greatest("watermark", "_heard").alias("watermark"))
        marks = [(r[0], r[1], 0) for r in marks.collect()]  # a row a log
        bound = max(at, min((m for _, m, _ in marks), default=at))
        names = [c.split()[0] for c in self.schema.split(", ")]
        events = rows.filter("kind not in ('watermark', 'join', 'leave')").select(*names)
        late = events.filter(F.col("seq") <= at).count()
        self.spark.createDataFrame([(None, bound, late), *marks], self.STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/state/{batch}")
        wait = events.filter(F.col("seq") > at).unionByName(self._read("pending", batch - 1, self.schema))
        wait.filter(F.col("seq") > bound).write.mode("overwrite").parquet(f"{self.root}/pending/{batch}")
        out = wait.filter(F.col("seq") <= bound).withColumn("batch_id", F.lit(batch).cast("long"))
        out.repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(f"{self.root}/out/{batch}")
        rows.unpersist()

    def released(self, after: int = -1) -> DataFrame:
        """All rows released by batches above `after`, as the folder has them."""
        every = self.spark.read.schema(self.schema + ", batch_id long").option("recursiveFileLookup", "true").parquet(f"{self.root}/out")
        return every.filter(F.col("batch_id") > after)


def hand_off(merger: Merger, log: DataFrame, segments: DataFrame, cursor: int, batch: int) -> DataFrame:
    """Events above a cursor for a subscriber that comes when `batch` is done: those up to the merger's position
    from the stored segments, all others from what is released later, each once. Adds part (backfill or live)."""
    from ..operators.logs import backfill

    floor = merger.position(batch)
    live = merger.released(batch).filter(F.col("seq") > max(cursor, floor)).drop("batch_id")
    stored = backfill(log, segments, cursor, floor).select(*live.columns)
    return stored.withColumn("part", F.lit("backfill")).unionByName(live.withColumn("part", F.lit("live")))
