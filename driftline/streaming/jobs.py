"""Streaming counts and online past-facing surprise."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import vocabulary
from ..operators.surprise import _decay_sums, _divergence, vocabulary_size

DAY_MS = 86_400_000


def windowed_counts(
    events: DataFrame, width: str, slide: str | None = None, delay: str = "1 day", key: str = "event_type"
) -> DataFrame:
    """Counts and sums per key in tumbling or sliding event-time windows; rows later
    than the watermark are dropped and only closed windows are emitted."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total"
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into a parquet table, then stop."""
    q = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def map_state_store(spark: SparkSession):
    """Keyed state needs the RocksDB store; a query keeps the setting it was started with, so the
    session gets its own one back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class TermDecay(StatefulProcessor):
    """State of one (class, term bucket): its part of the vocabulary, decayed term weights, and rows
    of days still open.

    Terms are 64-bit hashes.  A bucket's vocabulary is its initial state, so rows of other terms are
    dropped where the state is and joined to nothing.  Rows wait until the watermark has passed
    their day.  Then days are taken in order: a document's terms meet the weights of the days
    before, and only after all documents of a day the day is added.  One timer, at the first day that
    waits, is enough.  What is kept are arrays in bytes; no value becomes a Python object.
    """

    ROW = np.dtype([("day", "<i4"), ("doc", "<i8"), ("at", "<i4"), ("cnt", "<i8")])
    HELD = 1_000_000  # rows of one entry of the list state

    def __init__(self, rate: float, alpha: float):
        self.rate, self.alpha = rate, alpha

    def init(self, handle) -> None:
        self.handle = handle
        self.vocab = handle.getValueState("vocab", "terms binary")
        self.weights = handle.getValueState("weights", "day int, weights binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def _terms(self) -> np.ndarray:
        return np.frombuffer(self.vocab.get()[0] if self.vocab.exists() else b"", "<i8")  # sorted

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.vocab.update((np.union1d(self._terms(), initialState["term"].to_numpy("<i8")).tobytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        vocab, first, parts, size = self._terms(), None, [], 0
        for f in rows:
            f = f[f["terms"].notna()]  # without terms a row only moves the clock
            if not len(f):
                continue
            day, doc = f["day"].to_numpy("<i4"), f["doc_id"].to_numpy("<i8")
            term, cnt = (np.concatenate(f[c].to_list()).astype("<i8") for c in ("terms", "cnts"))
            row = np.repeat(np.arange(len(f)), [len(t) for t in f["terms"]])
            at = np.searchsorted(vocab, term)
            known = at < len(vocab)
            known[known] = vocab[at[known]] == term[known]
            # the last rows only say that the documents are there
            part = np.empty(int(known.sum()) + len(f), self.ROW)
            row = np.append(row[known], np.arange(len(f)))
            part["day"], part["doc"] = day[row], doc[row]
            part["at"] = np.append(at[known], np.full(len(f), len(vocab)))
            part["cnt"] = np.append(cnt[known], np.zeros(len(f)))
            first = int(day.min()) if first is None else min(first, int(day.min()))
            parts.append(part)
            size += len(part)
            if size >= self.HELD:
                self._hold(np.concatenate(parts))
                parts, size = [], 0
        if parts:
            self._hold(np.concatenate(parts))
        if first is not None:
            self.handle.registerTimer(first * DAY_MS)
        yield from ()

    def _hold(self, rows: np.ndarray) -> None:
        for lo in range(0, len(rows), self.HELD):
            self.waiting.appendValue((rows[lo : lo + self.HELD].tobytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_from = timerValues.getCurrentWatermarkInMs() // DAY_MS + 1
        held = [np.frombuffer(v[0], self.ROW) for v in self.waiting.get()]
        rows = np.concatenate(held) if held else np.empty(0, self.ROW)
        closed = rows["day"] < open_from
        if not closed.any():  # an earlier timer took them, and has set one for the rest
            return
        self.waiting.clear()
        rest = rows[~closed]
        if len(rest):
            self._hold(rest)
            self.handle.registerTimer(int(rest["day"].min()) * DAY_MS)
        rows = rows[closed]
        rows = rows[np.argsort(rows["day"], kind="stable")]
        days = np.flatnonzero(np.diff(rows["day"], prepend=rows["day"][0] - 1))
        cuts = np.unique(days[np.searchsorted(days, np.arange(0, len(rows), self.HELD), "right") - 1])
        for lo, hi in zip(cuts, np.append(cuts[1:], len(rows))):  # whole days, about HELD rows at a time
            yield self._score(key, rows[lo:hi])

    def _score(self, key, rows: np.ndarray) -> pd.DataFrame:
        n_known = len(self._terms())
        order = np.lexsort((rows["at"], rows["doc"], rows["day"]))
        day, doc, at = (rows[c][order] for c in ("day", "doc", "at"))
        new_day = np.diff(day, prepend=day[0] - 1) != 0
        new_doc = new_day | (np.diff(doc, prepend=doc[0] - 1) != 0)
        # rows of one document and term are added up
        head = np.flatnonzero(new_doc | (np.diff(at, prepend=at[0] - 1) != 0))
        cnt = np.add.reduceat(rows["cnt"][order], head).astype(float)
        day, doc, at, new_day, new_doc = (x[head] for x in (day, doc, at, new_day, new_doc))
        w = np.zeros(n_known + 1)  # the last place is that of rows without a term
        last = int(day[0])
        if self.weights.exists():
            last, kept = self.weights.get()
            w[:n_known] = np.frombuffer(kept, "<f8")
        logs = np.zeros(len(day))
        starts = np.flatnonzero(new_day)
        for lo, hi in zip(starts, np.append(starts[1:], len(day))):
            w *= math.exp(-self.rate * (int(day[lo]) - last) / 365.25)
            last = int(day[lo])
            logs[lo:hi] = np.log(w[at[lo:hi]] + self.alpha)
            np.add.at(w, at[lo:hi], cnt[lo:hi])
        self.weights.update((last, w[:n_known].tobytes()))
        docs = np.flatnonzero(new_doc)
        total = lambda x: np.add.reduceat(x, docs)
        return pd.DataFrame({
            "doc_id": doc[docs], "grp": key[0], "day": day[docs], "n_terms": total((at < n_known).astype(np.int64)), "n": total(cnt),
            "own": total(cnt * np.log(np.maximum(cnt, 1.0))), "past": total(cnt * logs),
        })

    def close(self) -> None:
        pass


class OnlineSurprise:
    """Past-facing decayed surprise of a stream of documents.

    Terms are counted inside a document's row, hashed to 64 bits and keyed by class and range of the
    hash, so that a class with most of the traffic is spread over ``buckets`` keys; a key's state
    holds its share of the class's vocabulary and waiting rows, so ``buckets`` should follow the
    input (and stays the same under one ``root``).  A row a document and bucket moves.  Documents may be up to ``delay`` late, whatever
    their class; later ones are dropped by the watermark.  A day is scored once the watermark
    has passed it, and a document never sees its own day.  The sink gets a document's
    sums per bucket; :meth:`scores` adds them up and joins the totals of the days before, a row per
    class and day.  A row without ``doc_id`` only moves the clock: a late date in it closes all days.

    A restart goes on from the checkpoint under ``root``.
    """

    PARTS = "doc_id long, grp string, day int, n_terms long, n double, own double, past double"

    def __init__(self, spark: SparkSession, vocab: DataFrame, terms: Column, root: str, halflife: float, alpha: float = 1.0, delay: str = "1 day", buckets: int = 16):
        self.spark, self.vocab, self.terms, self.root = spark, vocab, terms, root
        self.rate, self.alpha, self.delay, self.buckets = math.log(2) / halflife, alpha, delay, buckets

    def bucket(self, term: Column) -> Column:
        """0 to ``buckets - 1``, rising with the hash: sorted terms of a bucket lie side by side."""
        return F.shiftright((F.shiftright(term, 32) + (1 << 31)) * F.lit(self.buckets), 32)

    def rows(self, docs: DataFrame) -> DataFrame:
        """``grp, bucket, doc_id, at, day, terms, cnts``: a row a document and bucket with its distinct
        terms there.  A document without terms has one row; one that only moves the clock has no
        array in it."""
        present = F.col("doc_id").isNull() | (F.length("body") > 0)
        known = F.coalesce(F.when(F.col("doc_id").isNotNull(), self.terms), F.array().cast("array<string>"))
        terms = F.transform(F.array_compact(known), lambda t: F.xxhash64(t))

        def runs(s: Column) -> Column:
            n = F.size(s)
            of = lambda i: self.bucket(F.get(s, i)["term"])
            starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (of(i) != of(i - 1)))
            cut = lambda p: F.transform(
                F.slice(p, 1, F.size(p) - 1), lambda i, j: F.struct(of(i).alias("bucket"), F.slice(s, i + 1, F.get(p, j + 1) - i).alias("t"))
            )
            return F.transform(F.array(starts), cut)[0]

        # each array is bound once, by a transform of one element
        split = F.transform(F.array(vocabulary.term_counts(terms)), runs)[0]
        empty = F.array().cast("array<struct<term:bigint,cnt:bigint>>")
        alone = F.struct(self.bucket(F.xxhash64("doc_id")).alias("bucket"), F.when(F.col("doc_id").isNotNull(), empty).alias("t"))
        parts = F.transform(F.array(split), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(alone)))[0]
        rows = docs.filter(present).select("doc_id", "cls", "at", F.unix_date("filed").alias("day"), F.inline(parts))
        return rows.select(
            # state rows are built by name, where "cls" is taken
            F.col("cls").alias("grp"), "bucket", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "at", "day",
            F.col("t.term").alias("terms"), F.col("t.cnt").alias("cnts"),
        )

    def run(self, stream: DataFrame) -> None:
        """Score what has arrived in ``stream`` (``doc_id, cls, filed, body``), then stop."""
        docs = stream.withColumn("at", F.col("filed").cast("timestamp")).withWatermark("at", self.delay)
        keyed = self.rows(docs).groupBy("grp", "bucket")
        hashed = self.vocab.select(F.col("cls").alias("grp"), F.xxhash64("term").alias("term"))
        own = hashed.select("grp", self.bucket(F.col("term")).alias("bucket"), "term").groupBy("grp", "bucket")
        parts = keyed.transformWithStateInPandas(TermDecay(self.rate, self.alpha), self.PARTS, "append", "eventtime", own)
        with map_state_store(self.spark):
            q = (
                parts.writeStream.format("parquet").outputMode("append").option("path", f"{self.root}/parts")
                .option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
            )
        q.awaitTermination()

    def scores(self) -> DataFrame:
        """``doc_id, cls, day, n_terms, kl_past`` of the documents of closed days; null before the
        first day of a class, and no row for a document without a term of the vocabulary."""
        parts = self.spark.read.schema(self.PARTS).parquet(f"{self.root}/parts").filter(F.col("doc_id").isNotNull())
        docs = parts.groupBy("doc_id", F.col("grp").alias("cls"), "day").agg(
            F.sum("n_terms").alias("n_terms"), F.sum("n").alias("_t"), F.sum("own").alias("_self"), F.sum("past").alias("_past")
        )
        daily = docs.groupBy("cls", "day").agg(F.sum("_t").alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
        first = daily.agg(F.min("day")).scalar()
        daily = daily.withColumn("_t_years", (F.col("day") - first) / F.lit(365.25))
        totals = daily.select(
            "cls", "day", _decay_sums(daily, ["cls"], "m", self.rate, "past").alias("_total"),
            _decay_sums(daily, ["cls"], "n", self.rate, "past").alias("_w"),
        )
        out = docs.filter("n_terms > 0").join(totals, ["cls", "day"]).join(vocabulary_size(self.vocab), "cls")
        score = F.when(F.col("_w") > 0, _divergence("past", F.col("_total") + self.alpha * F.col("v_size")))
        return out.select("doc_id", "cls", "day", "n_terms", score.alias("kl_past"))
