"""Sliding-window rate limits, a cache's replay, coalesced requests and progress events.

A denied request is not recorded, so what is decided changes what comes later: no window frame expresses it, and each key's
requests are gone through in order. Keys are independent; a key's state is at most `limit` times.
"""

from __future__ import annotations

import bisect
import math
from collections import OrderedDict, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECISIONS = "key string, at double, seq long, allowed boolean, retry_after long"
HELD = T.StructType([T.StructField("at", T.DoubleType()), T.StructField("seq", T.LongType())])
STATE = T.StructType([T.StructField("times", T.ArrayType(T.DoubleType())), T.StructField("held", T.ArrayType(HELD))])


def decided(times: deque[float], now: float, limit: int, window: float) -> int | None:
    """None if a request at now is allowed (and then recorded in times), else seconds until another try."""
    if limit <= 0:
        return None
    while times and now - times[0] >= window:
        times.popleft()
    if len(times) < limit:
        times.append(now)
        return None
    return max(1, math.ceil(window - (now - times[0])))


def _rows(key: str, requests: Iterable[tuple[float, int]], times: deque[float], limit: int, window: float) -> pd.DataFrame:
    out = [(key, at, seq, retry is None, retry) for at, seq in requests for retry in [decided(times, at, limit, window)]]
    return pd.DataFrame(out, columns=["key", "at", "seq", "allowed", "retry_after"]).astype({"retry_after": "Int64"})


def limited(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """requests(key, at seconds, seq) decided in order of at, seq for each key.

    Without a limit nothing depends on order and nothing meets. With one, a key's requests are streamed through one task in
    order, in batches, so a hot key bounds the time but not the memory.
    """
    if limit <= 0:
        return requests.select("key", F.col("at").cast("double"), F.col("seq").cast("long"), F.lit(True).alias("allowed"), F.lit(None).cast("long").alias("retry_after"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, deque()
        for pdf in frames:
            for k, part in pdf.groupby("key", sort=False):
                if k != key:
                    key, times = k, deque()
                yield _rows(k, zip(part["at"], part["seq"], strict=True), times, limit, window)

    rows = requests.select("key", F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInPandas(run, DECISIONS)


def limited_stream(requests: DataFrame, limit: int, window: float, delay: float) -> DataFrame:
    """The same on a stream, whose requests may come up to `delay` seconds out of order. A request is held in its key's state
    until the watermark has passed it, when no earlier one can come; then all those held are decided in order of at, seq. So
    what is decided doesn't depend on how requests were cut into batches. Timers of event time wake a key for its next held
    request, and drop its state once its last one has left the window. Requests that come later than `delay` are left out, as
    Spark leaves out late rows; the last ones are decided when the watermark passes them (see `ended`).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        seen, held = ([*state.get[0]], [tuple(x) for x in state.get[1]]) if state.exists else ([], [])
        passed, times = state.getCurrentWatermarkMs(), deque(seen)
        held += [(float(at), int(seq)) for pdf in frames for at, seq in zip(pdf["at"], pdf["seq"], strict=True)]
        held.sort()
        n = bisect.bisect_right(held, (passed / 1000, math.inf))
        if n:
            yield _rows(key[0], held[:n], times, limit, window)
        held = held[n:]
        wake = held[0][0] if held else times[-1] + window if times else 0.0
        if not held and wake * 1000 <= passed:
            if state.exists:
                state.remove()
            return
        state.update((list(times), held))
        state.setTimeoutTimestamp(max(passed + 1, math.ceil(wake * 1000)))

    rows = requests.select("key", F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"))
    timed = rows.withColumn("time", F.col("at").cast("timestamp")).withWatermark("time", f"{math.ceil(delay * 1000)} milliseconds")
    return timed.groupBy("key").applyInPandasWithState(step, DECISIONS, STATE, "append", "EventTimeTimeout").filter(F.col("key") != END)


#: The key of the request that ends a stream.
END = "\x00end"


def ended(requests: DataFrame, window: float, delay: float) -> DataFrame:
    """One request that moves the watermark beyond all of requests(key, at, seq), for the end of a stream that has one."""
    last = requests.agg(F.max("at").alias("at")).filter("at is not null")
    return last.select(F.lit(END).alias("key"), (F.col("at") + F.lit(2 * delay + window + 2)).cast("double").alias("at"), F.lit(-1).cast("long").alias("seq"))


def dealt(requests: DataFrame, path: str, parts: int, delay: float, window: float) -> None:
    """requests(key, at, seq) written to a folder in so many steps of time, oldest first, and then the end: what a collector
    would have left there, to be read as a stream."""
    cuts = requests.approxQuantile("at", [k / parts for k in range(1, parts)], 0.01)
    lows, highs = [-math.inf, *cuts], [*cuts, math.inf]
    for low, high in zip(lows, highs, strict=True):
        requests.filter((F.col("at") >= low) & (F.col("at") < high)).coalesce(1).write.mode("append").parquet(path)
    ended(requests, window, delay).coalesce(1).write.mode("append").parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, in as many batches as the source gives, appended to Parquet files at path. Started again
    with the same checkpoint it goes on where it stopped, even within a batch: a batch's files count once it is committed."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def cache_replay(requests: DataFrame, most: int, ttl: float) -> DataFrame:
    """requests(shard, key, at, seq) against a cache of most entries in each shard: hit or miss. A hit makes an entry the
    newest, but not younger; one older than ttl is dropped; a miss stores the key. A shard is gone through in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = None, OrderedDict()
        for pdf in frames:
            out = []
            for s, key, at, seq in zip(pdf["shard"], pdf["key"], pdf["at"], pdf["seq"], strict=True):
                if s != shard:
                    shard, held = s, OrderedDict()
                hit = key in held and at - held[key] <= ttl
                if hit:
                    held.move_to_end(key)
                else:
                    held.pop(key, None)
                    if most > 0 and ttl > 0:
                        held[key] = at
                        while len(held) > most:
                            held.popitem(last=False)
                out.append((s, key, at, seq, hit))
            yield pd.DataFrame(out, columns=["shard", "key", "at", "seq", "hit"])

    rows = requests.select("shard", "key", F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"))
    return rows.repartition("shard").sortWithinPartitions("shard", "at", "seq").mapInPandas(run, "shard string, key string, at double, seq long, hit boolean")


def coalesced(requests: DataFrame) -> DataFrame:
    """requests(key, start, end): a request joins the running one of its key if it starts before that ends. Adds run, the
    start of the one that runs, and leader."""
    w = W.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = requests.withColumn("leader", F.coalesce(F.col("start") >= reach, F.lit(True)))
    return marked.withColumn("run", F.max(F.when(F.col("leader"), F.col("start"))).over(w.rowsBetween(W.unboundedPreceding, 0)))


STAGES = ("validate", "metadata", "tree", "contents", "analyze", "result")
EVENTS = "request string, stage string, ts timestamp"


def framed(chunks: DataFrame) -> DataFrame:
    """chunks(stream, seq, chunk) as rows (stream, line_no, line) of newline-delimited text: a line may be split over any number
    of chunks. A stream is gone through in order; what follows the last newline is a line if it isn't empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, rest, n = None, [], 0
        for pdf in frames:
            out = []
            for s, chunk in zip(pdf["stream"], pdf["chunk"], strict=True):
                if s != stream:
                    if rest and (last := "".join(rest)):
                        out.append((stream, n, last))
                    stream, rest, n = s, [], 0
                *ended, left = (chunk or "").split("\n")
                for part in ended:
                    out.append((s, n, "".join([*rest, part])))
                    rest, n = [], n + 1
                rest.append(left)
            yield pd.DataFrame(out, columns=["stream", "line_no", "line"])
        if rest and (last := "".join(rest)):
            yield pd.DataFrame([(stream, n, last)], columns=["stream", "line_no", "line"])

    rows = chunks.select("stream", "seq", "chunk")
    return rows.repartition("stream").sortWithinPartitions("stream", "seq").select("stream", "chunk").mapInPandas(run, "stream string, line_no long, line string")


def progress_source(spark, path: str, files_per_batch: int = 32) -> DataFrame:  # noqa: ANN001
    """A stream of progress events, one JSON object a line; lines may be split over writes, not over files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def latest_stage(events: DataFrame) -> DataFrame:
    """Each request's latest stage; error ends a request as result does. Works on streams and batches."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0))
    last = F.max_by("stage", F.struct("ts", rank))
    return events.groupBy("request").agg(last.alias("stage"), F.count(F.lit(1)).alias("events"))
