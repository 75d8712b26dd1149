"""The life of requests for contexts as a stream: pending, tried again, expired, failed or collected; and how requests are put into batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What a batch may hold.
MAX_REQUESTS, MAX_BYTES = 100_000, 256 << 20
#: Requests that a task orders at once, about.
BUCKET_REQUESTS = 50_000
STATUS = "request_id string, ts timestamp, status string, attempt int, context string, error string"


class LifeCycle(StatefulProcessor):
    """Follows one request by its events, and by a timer where a response stays away."""

    def __init__(self, timeout_ms: int, attempts: int):
        self.timeout_ms, self.attempts = timeout_ms, attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", "attempt int, due long")

    def wait(self, attempt: int, since_ms: int) -> None:
        due = since_ms + self.timeout_ms
        self.state.update((attempt, due))
        self.handle.registerTimer(due)

    def again(self, at_ms: int, error: str, last: str) -> tuple:
        """The next attempt, if there is one; the request is over otherwise."""
        attempt, due = self.state.get()
        self.handle.deleteTimer(due)
        if attempt < self.attempts:
            self.wait(attempt + 1, at_ms)
            return at_ms, "retry", attempt + 1, None, error
        self.state.clear()
        return at_ms, last, attempt, None, error

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        # a request's events of one trigger in their order, a submission before the response of the same moment
        events = events.assign(late=events["what"] != "submit").sort_values(["ts", "late"], kind="stable")
        out = []
        for e in events.itertuples():
            at = int(pd.Timestamp(e.ts).value // 1_000_000)
            waiting = self.state.exists()
            if e.what == "submit":
                if not waiting:  # a repeated submission belongs to the attempt that is waiting
                    self.wait(1, at)
                    out.append((at, "pending", 1, None, None))
            elif not waiting:
                out.append((at, "ignored", 0, e.context, e.error))
            elif e.error is None or pd.isna(e.error):
                attempt, due = self.state.get()
                self.handle.deleteTimer(due)
                self.state.clear()
                out.append((at, "collected", attempt, e.context, None))
            else:
                out.append(self.again(at, e.error, "failed"))
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists() and self.state.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            out.append(self.again(expiredTimerInfo.getExpiryTimeInMs(), "no response", "expired"))
        yield self.rows(key, out)

    @staticmethod
    def rows(key, out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["ts", "status", "attempt", "context", "error"])
        made.insert(0, "request_id", key[0])
        return made.assign(ts=pd.to_datetime(made["ts"], unit="ms"), attempt=made["attempt"].astype("int32"))

    def close(self) -> None:
        pass


def life_cycle(events: DataFrame, timeout: int, attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """What becomes of requests, from a stream of events (request_id, ts, what: submit or response, context, error).

    Status rows: `pending` when a request is submitted; `retry` when a response is an error or stays away for
    timeout seconds of event time, with the number of the next attempt, for which the timer starts anew; `failed` or
    `expired` after the last attempt; `collected` with the context. A response to a request that isn't
    waiting (late, repeated, unknown) is `ignored`. The session's state store provider must be RocksDB's.
    """
    watched = events.select("request_id", "ts", "what", "context", "error").filter("request_id is not null and ts is not null").withWatermark("ts", late)
    return watched.groupBy("request_id").transformWithStateInPandas(LifeCycle(timeout * 1000, attempts), STATUS, "Append", "EventTime")


def request_batches(requests: DataFrame, key: str, body: str, max_requests: int = MAX_REQUESTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """requests with the number of their batch: at most max_requests and max_bytes of key and body in UTF-8 each.

    Batches are cut along a fixed order of hashes, by running sums over buckets of it, so no task orders all
    requests, and a rerun gives the same batches. A request over the limit by itself is an error.
    """
    size = F.octet_length(F.coalesce(F.col(body), F.lit(""))) + F.octet_length(F.coalesce(F.col(key).cast("string"), F.lit("")))
    sized = requests.withColumns({"_size": size.cast("long"), "_order": F.xxhash64(key, body)})
    whole = sized.agg(F.count("*").alias("n"), F.coalesce(F.max("_size"), F.lit(0)).alias("most")).first()
    if whole["most"] > max_bytes:
        raise ValueError(f"a request has {whole['most']} bytes, a batch at most {max_bytes}")
    # a batch of requests that start within `room` bytes ends within max_bytes
    room = max(1, max_bytes - whole["most"])
    buckets = 1 + whole.n // BUCKET_REQUESTS
    sized = sized.withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    along = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    sums = sized.groupBy("_bucket").agg(F.count("*").alias("c"), F.sum("_size").alias("s"))
    sums = sums.select("_bucket", F.coalesce(F.sum("c").over(along), F.lit(0)).alias("_rows"), F.coalesce(F.sum("s").over(along), F.lit(0)).alias("_bytes"))
    inside = Window.partitionBy("_bucket").orderBy("_order", key, body).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"_row": F.count(F.lit(1)).over(inside), "_at": F.coalesce(F.sum("_size").over(inside), F.lit(0))}).join(sums, "_bucket")
    number = F.floor((F.col("_rows") + F.col("_row")) / max_requests) + F.floor((F.col("_bytes") + F.col("_at")) / room)
    return placed.withColumn("batch", number).drop("_size", "_order", "_bucket", "_row", "_at", "_rows", "_bytes")
