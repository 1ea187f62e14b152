"""Reassembly of conversation turns that arrive out of order, in batches, some of them twice.

A stateful streaming query keeps each conversation under its key: one value for its progress, a map of
the turns that wait for an earlier one, and a tombstone once it is closed. Batch numbers are the event
time. Every arrival deletes the conversation's timer and registers it anew at last + idle batches. The
watermark comes from the batch before, by a row that carries only the clock, also in an empty batch: in
batch b it has just passed the number b. A batch's arrivals are handled first and are a little younger,
so what expires then has been silent in b too, and is closed. The query is started anew for every batch
on one checkpoint, which holds all its state; a batch's files appear in its folder by one rename.

Of a turn, the earliest arrival is kept; the run of kept turns without a gap from the conversation's
smallest turn is released as it grows, each turn once. What arrives after the close is rejected.

Defined cases: rows without a turn are dropped; a null role or text is empty; rows without a conv_id
are one conversation; equal rows of one batch are one arrival (its smallest payload, then its smallest
role); a table without rows gives no events. Other columns of the input are ignored. A conversation's
rows of one batch go through one task, row by row; what is held of it are the turns that wait.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusweave.llm.store import table_path

BATCHES = 10
#: Batches in a row without an arrival that close a conversation.
IDLE = 2
#: Milliseconds of event time from one batch to the next; a batch's arrivals stand halfway.
TICK = 1000
ARRIVAL = "conv_id long, turn long, role string, payload string, first long, batch int, at timestamp"
EVENT = "event string, conv_id long, turn long, payload string, batch int, n_missing long, n_breaks long, unreleased array<long>"
Event = Row("event", "conv_id", "turn", "payload", "batch", "n_missing", "n_breaks", "unreleased")
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.maintenanceInterval": "2s",  # stores of an ended start go, which take some MB of disk each
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # the watermark of the next batch has to wait for its arrivals
}
#: For a shared folder that is a local one: Spark's usual manager of checkpoint files starts a chmod process for every file there,
#: which takes longer than all else of a small store's commit. A local rename replaces a file left by an earlier attempt, as the usual one does.
LOCAL_SETTINGS = {
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}


def time_of(batch: int) -> int:
    """The number of a batch as a time in milliseconds, which is when a timer for it expires."""
    return batch * TICK


class Reassembler(StatefulProcessor):
    """What becomes of one conversation's arrivals. After `batches` batches all that is open closes."""

    def __init__(self, batches: int, idle: int) -> None:
        self.batches, self.idle = batches, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "first long, following long, highest long, kept long, breaks long, role string, last int")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, payload string")
        self.tombstone = handle.getValueState("tombstone", "batch int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        conv_id, closed, state, timer = key[0], self.tombstone.get() is not None, None, None
        if not closed and (found := self.progress.get()):
            state, timer = list(found), found[6]
        for row in rows:
            if row.turn is None:
                continue  # the clock
            if closed:
                yield Event("reject", conv_id, row.turn, row.payload, row.batch, None, None, None)
                continue
            if not state:
                state = [row.first, row.first, row.first - 1, 0, 0, None, row.batch]
            state[6] = row.batch
            yield from self._arrive(conv_id, state, row)
        if state and state[6] != timer:
            if timer is not None:
                self.handle.deleteTimer(time_of(timer + self.idle))
            self.handle.registerTimer(time_of(state[6] + self.idle))
        if state:
            self.progress.update(tuple(state))

    def _arrive(self, conv_id, state: list, row: Row) -> Iterator[Row]:
        """Keep a turn that isn't kept yet, and release what no gap holds back any more."""
        first, following, highest, kept, _, role, _ = state
        waits = kept - (following - first)
        if row.turn < following or (waits and self.waiting.containsKey((row.turn,))):
            return
        after = self.waiting.getValue((row.turn + 1,)) if waits else None
        if row.turn > following:
            before = self.waiting.getValue((row.turn - 1,)) if waits else None
            role_before = before and before[0]
        else:
            role_before = role  # of the turn released last, if any
        state[2], state[3] = max(highest, row.turn), kept + 1
        state[4] += (role_before == row.role) + (after is not None and after[0] == row.role)
        if row.turn > following:
            self.waiting.updateValue((row.turn,), (row.role, row.payload))
            return
        turn, role, payload = row.turn, row.role, row.payload
        while True:
            yield Event("release", conv_id, turn, payload, row.batch, None, None, None)
            turn += 1
            found = self.waiting.getValue((turn,)) if waits else None
            if found is None:
                break
            self.waiting.removeKey((turn,))
            waits -= 1
            role, payload = found
        state[1], state[5] = turn, role

    def _close(self, conv_id, state: list) -> Row:
        first, following, highest, kept, breaks, _, last = state
        left = sorted(turn for (turn,) in self.waiting.keys()) if kept > following - first else []
        self.waiting.clear()
        self.progress.clear()
        batch = min(last + self.idle, self.batches)
        self.tombstone.update((batch,))
        return Event("close", conv_id, -1, None, batch, highest - first + 1 - kept, breaks, left)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if state := self.progress.get():
            yield self._close(key[0], list(state))

    def close(self) -> None:
        pass


def timed(rows: DataFrame, batches: int) -> DataFrame:
    """rows(conv_id, turn, role, payload, first, batch) with their event time, and the clock's row of
    each batch, which lets the watermark pass the number of the next one; after the last batch comes one
    that only closes, so its watermark passes all numbers."""
    next_ = F.col("batch") + F.when(F.col("batch") + 1 < batches, 1).otherwise(2 * batches + IDLE)
    clock = rows.sparkSession.range(batches + 1).select(F.col("id").cast("int").alias("batch"))
    clock = clock.select("batch", F.timestamp_millis(next_.cast("long") * TICK + 1).alias("at"))
    rows = rows.withColumn("batch", F.col("batch").cast("int")).withColumn("at", F.timestamp_millis(F.col("batch").cast("long") * TICK + TICK // 2))
    names = [c.split(" ")[0] for c in ARRIVAL.split(", ")]
    return rows.unionByName(clock, allowMissingColumns=True).select(*names)


def events(stream: DataFrame, batches: int, idle: int = IDLE) -> DataFrame:
    """The events of a stream of timed() rows."""
    keyed = stream.withWatermark("at", "0 seconds").groupBy("conv_id")
    return keyed.transformWithState(Reassembler(batches, idle), EVENT, "append", "eventTime")


def reassemble(rows: DataFrame, batches: int, idle: int = IDLE) -> DataFrame:
    """The events of rows(conv_id, turn, role, payload, first, batch): batches 0 to `batches` - 1 are
    fed in order to a streaming query that is started anew for each. `first` is the smallest turn that
    a conversation will have. Returns release and reject rows with turn and payload, and close rows
    with turn -1, n_missing, n_breaks and the turns that were never released."""
    spark = rows.sparkSession
    top = table_path(spark, "reassembly")
    staged, fed, state, out = (f"{top}/{x}" for x in ("staged", "fed", "state", "out"))
    # about as many files in all as there are partitions, each of one batch
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    dealt = timed(rows, batches).withColumn("part", F.col("batch"))
    dealt.repartition("part", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(slices))).write.partitionBy("part").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(top).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(fed))
    settings = SETTINGS | (LOCAL_SETTINGS if files.getUri().getScheme() == "file" else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for batch in range(batches + 1):
            if not files.rename(path(f"{staged}/part={batch}"), path(f"{fed}/part={batch}")):
                raise OSError(f"batch {batch} can't be moved to {fed}")
            arriving = spark.readStream.schema(ARRIVAL).parquet(fed)
            writer = events(arriving, batches, idle).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for done in (staged, fed, state):
        files.delete(path(done), True)
    return spark.read.schema(EVENT).parquet(out)


def _deal(conv_id: Column, turn: Column) -> Column:
    name = F.concat(F.coalesce(conv_id.cast("string"), F.lit("")), F.lit(":"), turn.cast("string"))
    return F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def arrivals(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The turns of conversations(conv_id, turn, role, text) as they come in over `batches` batches,
    dealt by a hash of conv_id and turn; some come a second time with the role of a user. Of each turn
    the smallest payload of a batch arrives. For reassemble()."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")))
    c = c.where("turn IS NOT NULL")
    firsts = c.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "of")
    own = F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), F.col("role").alias("role"))
    again = F.concat(F.lit("user|"), F.col("text"))
    turns = c.groupBy("conv_id", "turn").agg(F.min(own).alias("own"), F.min(again).alias("again"))
    h = F.col("h")
    once = F.struct((h % batches).alias("batch"), F.col("own.payload").alias("payload"), F.col("own.role").alias("role"))
    twice = F.struct(((h + batches // 2) % batches).alias("batch"), F.col("again").alias("payload"), F.lit("user").alias("role"))
    turns = turns.withColumn("h", _deal(F.col("conv_id"), F.col("turn")))
    turns = turns.withColumn("x", F.explode(F.when(h % 7 < 2, F.array(once, twice)).otherwise(F.array(once))))
    turns = turns.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")))
    return turns.select("conv_id", "turn", "x.role", "x.payload", "first", F.col("x.batch").cast("int").alias("batch"))
