"""Long exact spans shared between records, by a log-structured fingerprint index.

Fingerprints: of every window of SPAN characters the least hash of its GRAM-character grams (the last of equals) stands
for the window. Equal windows choose the equal gram at the same place, so records that share a span share a fingerprint.
Neighbouring windows mostly choose the same gram; they form one row with a hash of the text that they cover together.

Index: each batch of records becomes an immutable run of rows, bucketed and sorted by fingerprint. A new batch is
merge-joined, bucket by bucket and without another shuffle, with the runs of earlier batches; runs are compacted into
one when there are many. Runs and the manifest that names them stay in the index's folder, so a later session goes on
from there. What shares a fingerprint is verified: rows whose whole covered text recurs in another record first, then,
one row for each distinct text, window by window.
Rows of one task with the same fingerprint and text become one row before the shuffle. One that then holds many places (a
passage that a third of all records hold) is known to be shared, needs no partner, and goes to a bucket by chance, so
that no bucket takes all of them; groups are only ever reduced to their least and greatest record.
"""

from __future__ import annotations

import json
from functools import reduce
from math import ceil, log2
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm import kernel as K
from quarryline.llm.records import fresh
from quarryline.shared import bucketed, exists, opened, read_text, remove, scratch_path, tidy, write_text, written

SPAN, GRAM = 160, 96
#: A row has its fingerprint as key, exclusive or with its salt, which is 0 but in rows of HEAVY further places and more.
ROW = "key long, salt long, ctx long, rec long, start int, n int, others array<struct<rec: bigint, start: int>>"
HEAVY = 64
#: Rows that a bucket should hold at most, and characters that one row stands for on average.
BUCKET_ROWS, ROW_CHARS = 2_000_000, (SPAN - GRAM) // 2
_PLACE = K.U64(24)
_MASK = K.U64((1 << 24) - 1)


def _segments(texts: list[str], span: int) -> list[tuple[int, int, str]]:
    """(row, offset, part) that together hold each window of `span` characters once."""
    out = []
    for row, t in enumerate(texts):
        windows = len(t) - span + 1
        for a in range(0, windows, K.CHUNK):
            out.append((row, a, t[a : min(a + K.CHUNK, windows) + span - 1]))
    return out


def _joined(segments: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes over the parts' characters, and the parts' bounds."""
    bounds = np.zeros(len(segments) + 1, np.int64)
    np.cumsum([len(p) for *_, p in segments], out=bounds[1:])
    return K.prefix_hash(K.char_table("noise")[K.code_points("".join(p for *_, p in segments))]), bounds


def winnowed(segments: list[tuple[int, int, str]], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(fp, ctx, segment, first window's offset in the segment, number of windows) of each run of windows."""
    h, bounds = _joined(segments)
    n = bounds[-1]
    at = np.arange(n - gram + 1)
    g = K.span_hash(h, at, at + gram)
    order = (g >> _PLACE << _PLACE) | (_MASK - at.astype(np.uint64))
    chosen = (_MASK - (K.sliding_min(order, span - gram + 1) & _MASK)).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, bounds[:-1], 1)
    np.add.at(valid, bounds[1:] - span + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid[:-1])[: len(chosen)])
    pick = chosen[windows]
    new = np.flatnonzero(np.diff(pick, prepend=-1))
    first, last = windows[new], windows[np.append(new[1:], len(windows)) - 1]
    gram_at = pick[new]
    text = K.span_hash(h, first, last + span)
    ctx = K.mixed(text + ((gram_at - first) * 65536 + last - first).astype(np.uint64))
    segment = np.searchsorted(bounds, first, "right") - 1
    return g[gram_at], ctx, segment, first - bounds[segment], last - first + 1


def _batched(segments: list[tuple[int, int, str]]):
    for i, j in K.chunks([p for *_, p in segments]):
        yield segments[i:j]


def _fingerprint(span: int, gram: int):
    def run(batches):
        for keys, texts in fresh(batches, ["rec"], "text"):
            parts = []
            for segments in _batched(_segments(texts, span)):
                fp, ctx, seg, first, n = winnowed(segments, span, gram)
                row, offset = (np.array([s[c] for s in segments])[seg] for c in (0, 1))
                parts.append((fp.view(np.int64), ctx.view(np.int64), np.array([r for (r,) in keys], np.int64)[row], (offset + first).astype(np.int32), n.astype(np.int32)))
            if parts:
                yield _combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _combined(fp: np.ndarray, ctx: np.ndarray, rec: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row for each fingerprint and text, sorted by fingerprint; places after the first go to `others`."""
    order = np.lexsort((start, rec, ctx, fp))
    fp, ctx, rec, start, n = (x[order] for x in (fp, ctx, rec, start, n))
    head = np.ones(len(fp), bool)
    head[1:] = (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])
    first = np.flatnonzero(head)
    counts = np.diff(np.append(first, len(fp))) - 1
    # Records are in order, so a row's first and last place tell whether it has several.
    heavy = (counts >= HEAVY) & (rec[first] != rec[first + counts])
    salt = np.where(heavy, K.mixed((rec[first] ^ start[first]).view(np.uint64)) | K.U64(1), K.U64(0)).view(np.int64)
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32), mask=np.append(counts == 0, False))
    places = pa.StructArray.from_arrays([pa.array(rec[~head]), pa.array(start[~head])], names=["rec", "start"])
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (fp[head] ^ salt, salt, ctx[head], rec[head], start[head], n[head])] + [pa.ListArray.from_arrays(offsets, places)],
        names=["key", "salt", "ctx", "rec", "start", "n", "others"],
    )


ASKED = "fp long, ctx long, low long, high long, windows array<long>"


def _windows(span: int):
    """Window hashes of the asked places of each text: from rows (asked array of (start, n, fp, ctx, low, high), text)."""

    def run(batches):
        for b in batches:
            for asked, text in zip(b.column("asked").to_pylist(), b.column("text").to_pylist(), strict=True):
                asked = [a for a in asked if a["start"] + a["n"] - 1 + span <= len(text)]
                for some in _batched([(k, a["start"], text[a["start"] : a["start"] + a["n"] - 1 + span]) for k, a in enumerate(asked)]):
                    h, bounds = _joined(some)
                    counts = np.diff(bounds) - span + 1
                    ends = np.append(0, np.cumsum(counts))
                    at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], counts)
                    of = [asked[k] for k, *_ in some]
                    hashes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(K.span_hash(h, at, at + span).view(np.int64)))
                    asks = pa.RecordBatch.from_arrays(
                        [pa.array([a[c] for a in of], pa.int64()) for c in ("fp", "ctx", "low", "high")] + [hashes], names=["fp", "ctx", "low", "high", "windows"]
                    )
                    # Of a record with several texts only that which holds the asked one: ctx less its hash is the gram's place.
                    ctx = np.array([a["ctx"] for a in of], np.int64).view(np.uint64)
                    rest = K.unmixed(ctx) - K.span_hash(h, bounds[:-1], bounds[1:]) - (counts - 1).astype(np.uint64)
                    yield asks.filter(pa.array((rest % K.U64(65536) == 0) & (rest // K.U64(65536) < span)))

    return run


def keyed(recs: DataFrame) -> DataFrame:
    """records() with a number for each record."""
    return recs.withColumn("rec", F.xxhash64("rec_table", "rec_key"))


_LOW = "least(rec, array_min(others.rec))"
_HIGH = "greatest(rec, array_max(others.rec))"


def _buckets(rows: float, least: int) -> int:
    """A power of two, so that runs of unlike sizes can grow together."""
    return 1 << max(0, ceil(log2(max(1, least, rows / BUCKET_ROWS))))


class SpanIndex:
    """Runs of fingerprints of all records so far, for finding the spans that new records share with them.

    path: a folder in shared storage. An index that is there is opened and goes on with its own span and gram; without a path
    the index lives until the process ends. The folder holds runs/ and manifests (which also say whether a run has rows of many
    places), of which the last one counts: an append or
    a compaction that is lost with its driver leaves the index as it was before.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, span: int = SPAN, gram: int = GRAM, fanout: int = 4):
        self.spark, self.path, self.span, self.gram, self.fanout = spark, path or scratch_path(spark, "span-index"), span, gram, fanout
        self.version, self.buckets, self.names, self.runs, self.heavy = 0, 0, [], [], {}
        while exists(spark, self._manifest(self.version + 1)):
            self.version += 1
        if self.version:
            known = json.loads(read_text(spark, self._manifest(self.version)))
            self.span, self.gram, self.buckets, self.names = known["span"], known["gram"], known["buckets"], [*known["runs"]]
            self.heavy = known["runs"]
            self.runs = [opened(spark, f"{self.path}/runs/{name}", ROW, "key", self.buckets) for name in self.names]

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version:06}.json"

    def _commit(self, names: list[str], runs: list[DataFrame]) -> None:
        state = {"span": self.span, "gram": self.gram, "buckets": self.buckets, "runs": {n: self.heavy[n] for n in names}}
        write_text(self.spark, self._manifest(self.version + 1), json.dumps(state))
        self.version, self.names, self.runs = self.version + 1, names, runs

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name = uuid4().hex
        run = bucketed(rows, f"{self.path}/runs/{name}", "key", self.buckets)
        # Row groups without a salt are told by their statistics, so this costs little where nothing is heavy.
        self.heavy[name] = run.where("salt <> 0").limit(1).count() > 0
        tidy(self.spark)
        return name, run

    def append(self, recs: DataFrame) -> DataFrame:
        """Add a batch of keyed() records. Returns the rows, of this batch and of earlier ones, whose fingerprint is now
        known to be in more than one record and is in this batch: (fp, ctx, rec, start, n, others)."""
        if not self.buckets:
            size = recs.agg(F.sum(F.length("text"))).first()[0] or 0
            self.buckets = _buckets(size / ROW_CHARS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        name, new = self._write(recs.select("rec", "text").mapInArrow(_fingerprint(self.span, self.gram), ROW).repartition(self.buckets, "key"))
        runs, fp = [new, *self.runs], F.expr("key ^ salt")
        light, heavy = ([r.where(f"salt {op} 0") for r in runs] for op in ("=", "<>"))
        ends = lambda rows: rows.groupBy("key").agg(F.min(F.expr(_LOW)).alias("low"), F.max(F.expr(_HIGH)).alias("high"))
        stats = ends(light[0])
        for k, run in enumerate(light[1:]):
            old = ends(run).select("key", F.col("low").alias(f"low{k}"), F.col("high").alias(f"high{k}"))
            stats = stats.join(old.hint("merge"), "key", "left").select("key", F.least("low", f"low{k}").alias("low"), F.greatest("high", f"high{k}").alias("high"))
        shared = stats.where("low <> high").select("key")
        heavy = [h for h, n in zip(heavy, [name, *self.names], strict=True) if self.heavy[n]]
        if heavy:
            many = [h.select(fp.alias("key")).distinct() for h in heavy]
            own = many.pop(0) if self.heavy[name] else many[0].limit(0)
            # Parted anew by hand: a union of bucketed scans says that it keeps their parts when the scans may have given them up.
            earlier = reduce(DataFrame.union, many, own.limit(0)).repartition("key").distinct().join(light[0].select("key"), "key", "left_semi")
            shared = shared.union(own).union(earlier).repartition("key").distinct()
        # Written once for all runs: it is small beside them, and they keep their buckets when they meet it.
        shared = written(shared, "span-shared")
        cols = [fp.alias("fp"), "ctx", "rec", "start", "n", "others"]
        hits = [r.join(shared, "key", "left_semi").select(*cols) for r in light]
        hits += [r.withColumn("fp", fp).join(shared.select(F.col("key").alias("fp")), "fp", "left_semi").select("fp", *cols[1:]) for r in heavy]
        found = written(reduce(DataFrame.unionByName, hits), "span-hits")
        self._commit([*self.names, name], [*self.runs, new])
        if len(self.runs) > self.fanout:
            self.compact()
        return found

    def discard(self) -> None:
        """Remove the index with all its runs."""
        self.runs, self.names = [], []
        remove(self.spark, self.path)
        tidy(self.spark)

    def compact(self) -> None:
        """Merge all runs into one sorted run, rows of records that were delivered again only once, in more buckets if the
        rows ask for them; the runs before are removed."""
        before, rows = self.names, reduce(DataFrame.unionByName, self.runs)
        self.buckets = _buckets(rows.count(), self.buckets)
        name, run = self._write(rows.repartition(self.buckets, "key").distinct())
        self._commit([name], [run])
        for old in before:
            remove(self.spark, f"{self.path}/runs/{old}")


def shared_intervals(batches: list[DataFrame], span: int = SPAN, gram: int = GRAM, fanout: int = 4) -> DataFrame:
    """(rec, lo, hi): parts of keyed() records that each consist of spans of at least `span` characters found in another
    record. They may overlap and touch."""
    spark = batches[0].sparkSession
    index = SpanIndex(spark, None, span, gram, fanout)
    hits = index.append(batches[0])
    recs = batches[0]
    for b in batches[1:]:
        tidy(spark)
        hits = hits.unionByName(index.append(b))
        recs = recs.unionByName(b)
    # What was found is written; nothing will be asked of this index again.
    index.discard()
    texts = written(
        hits.groupBy("fp", "ctx").agg(F.min(F.expr(_LOW)).alias("low"), F.max(F.expr(_HIGH)).alias("high"), F.min(F.struct("rec", "start", "n")).alias("rep")), "span-texts"
    )
    full = hits.join(texts.where("low <> high").select("fp", "ctx"), ["fp", "ctx"], "left_semi")
    each = F.explode(F.expr("concat(array(struct(rec, start)), coalesce(others, array()))")).alias("at")
    whole = full.select("n", each).select("at.rec", "at.start", "n")

    # Texts of one record only, beside other texts with the fingerprint: window by window, each text once.
    open_fps = texts.groupBy("fp").agg(F.count("*").alias("texts"), F.min(F.expr("low <> high")).alias("all_whole")).where("texts > 1 AND NOT all_whole")
    asked = (
        texts.join(open_fps.select("fp"), "fp", "left_semi")
        .groupBy(F.col("rep.rec").alias("rec"))
        .agg(F.collect_set(F.struct(F.col("rep.start").alias("start"), F.col("rep.n").alias("n"), "fp", "ctx", "low", "high")).alias("asked"))
    )
    # A record delivered again in another task gives its windows twice; that changes no least and greatest record.
    places = written(recs.join(asked, "rec").groupBy("rec", "text").agg(F.first("asked").alias("asked")).mapInArrow(_windows(span), ASKED), "span-windows")
    tidy(spark)
    same = (
        places.select("low", "high", F.explode("windows").alias("window"))
        .groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("greatest"))
        .where("least <> greatest").select("window")
    )
    # They were looked at where each text stands first; what is shared of it is shared wherever the text stands.
    parts = (
        places.where("low = high").select("fp", "ctx", F.posexplode("windows").alias("k", "window"))
        .join(same, "window", "left_semi").groupBy("fp", "ctx").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    )
    single = (
        hits.join(parts, ["fp", "ctx"]).select("ks", each).select("at.rec", "at.start", "ks").distinct()
        .select("rec", "start", F.explode("ks").alias("k")).select("rec", (F.col("start") + F.col("k")).alias("start"), F.lit(1).alias("n"))
    )
    return whole.unionByName(single).select("rec", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + span).alias("hi"))


def records_sharing(batches: list[DataFrame], span: int = SPAN, gram: int = GRAM, fanout: int = 4) -> DataFrame:
    """(rec_table, rec_key) of each record() with a span of at least `span` characters that another record holds.

    A record is a table and key, whatever repeats there are; rows with a null key or text are left out, texts shorter
    than the span share nothing, and empty tables give no rows."""
    batches = [keyed(b) for b in batches]
    found = shared_intervals(batches, span, gram, fanout).select("rec").distinct()
    return _names(batches).join(found, "rec", "left_semi").select("rec_table", "rec_key")


def _names(batches: list[DataFrame]) -> DataFrame:
    names = batches[0].select("rec", "rec_table", "rec_key")
    for b in batches[1:]:
        names = names.unionByName(b.select("rec", "rec_table", "rec_key"))
    return names.distinct()


def shared_shares(batches: list[DataFrame], span: int = SPAN, gram: int = GRAM, fanout: int = 4) -> DataFrame:
    """(rec_table, rec_key, n_chars, shared_chars) of each record(): its length in code points and how many of them lie in
    spans of at least `span` characters that another record holds. Nulls and repeats as in records_sharing; of a
    record with several texts the longest counts for n_chars."""
    batches = [keyed(b) for b in batches]
    parts = shared_intervals(batches, span, gram, fanout).groupBy("rec", "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy("rec").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        parts.withColumn("seen", F.coalesce(F.max("hi").over(before), F.lit(0)))
        .groupBy("rec")
        .agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "seen"))).alias("shared_chars"))
    )
    lengths = None
    for b in batches:
        own = b.select("rec", "rec_table", "rec_key", F.length("text").cast("long").alias("n_chars"))
        lengths = own if lengths is None else lengths.unionByName(own)
    return (
        lengths.groupBy("rec", "rec_table", "rec_key")
        .agg(F.max("n_chars").alias("n_chars"))
        .join(shared, "rec", "left")
        .select("rec_table", "rec_key", "n_chars", F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"))
    )
