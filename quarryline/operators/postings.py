"""Keyword search in Arrow batches: postings of the asked words, and the best documents of blocks of queries.

A task holds a share of the queries and reads the postings of all documents once, in blocks and in the order of their ids. Words that
many documents have are a matrix, in which a block of queries is scored by one product in single precision; the others are added by
their postings. What by that may reach a query's best k is scored again in double precision, so single precision decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# They change what is computed at a time, not the result.
DOCS, QUERIES, PAIRS = 8192, 256, 16384
#: A word is in the matrix if a document in so many has it, and of such words so many at most, the most frequent.
COMMON, COLUMNS = 64, 512


def _files(path: str) -> Iterator[pa.NativeFile]:
    """A table's files in the order of the partitions that wrote them, which Spark numbers in their names."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path)
    for f in sorted((f for f in where.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-")), key=lambda f: int(f.base_name.split("-")[1])):
        with where.open_input_file(f.path) as opened:
            yield opened


def _blocks(path: str, columns: list[str], rows: int = DOCS) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for f in _files(path):
        yield from (b for b in pq.ParquetFile(f).iter_batches(rows, columns=columns, use_threads=False) if b.num_rows)


def _vocabulary(path: str) -> pa.Array:
    """The asked words; a word's number is its place here."""
    words = pa.concat_arrays([pa.array([], pa.string()), *(b.column(0).cast(pa.string()) for b in _blocks(path, ["term"], 1 << 16))])
    return words.sort()


def _numbered(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Each word's number, -1 without one."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)


def list_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The size of each list, and the row of each value of its flat values."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return size, np.repeat(np.arange(len(size)), size)


def counts(vocabulary_path: str) -> Callable:
    """(key, w) to (key, len, terms, tfs): the number of words, the asked words among them, and how often each stands there."""

    def run(batches):
        vocabulary = None
        for b in batches:
            vocabulary = _vocabulary(vocabulary_path) if vocabulary is None else vocabulary
            size, row = list_rows(b.column("w"))
            term = _numbered(b.column("w").flatten(), vocabulary)
            pairs, tf = np.unique(row[term >= 0] * max(1, len(vocabulary)) + term[term >= 0], return_counts=True)
            at = np.searchsorted(pairs, np.arange(len(size) + 1) * max(1, len(vocabulary))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(vocabulary)), tf)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(size, pa.int32()), *lists], names=["key", "len", "terms", "tfs"])

    return run


class _Queries:
    """A block of queries: which words of the matrix each has, its other words, and its best documents so far."""

    def __init__(self, at: np.ndarray, common: np.ndarray, other: tuple[np.ndarray, np.ndarray], n_terms: np.ndarray, k: int):
        self.at, self.k = at, k
        self.columns = np.flatnonzero(common.any(axis=0))
        self.common = np.ascontiguousarray(common[:, self.columns], dtype=np.float32)
        self.row, self.term = other
        self.score, self.doc = np.full((len(at), k), -1.0), np.full((len(at), k), -1, np.int64)
        # All weights are positive, so that a sum in single precision is off by less than this share of it.
        self.off = (n_terms + 8) * 1.2e-7

    def see(self, block: _Docs) -> None:
        n, k = block.n, self.k
        many = block.single[self.columns]
        about = self.common @ many if len(self.columns) else np.zeros((len(self.at), n), np.float32)
        lo = block.first[self.term]
        size = block.first[self.term + 1] - lo
        one = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        place, weight = np.repeat(self.row, size) * n + block.doc[one], block.weight[one]
        np.add.at(about.reshape(-1), place, weight.astype(np.float32))
        # Blocks come in the order of ids: an equal score comes too late.
        least = self.score[:, k - 1].copy()
        low = (least - 1e-6) * (1 - self.off)
        new = np.flatnonzero(least < 0)
        if len(new) and n > k:
            kth = np.partition(about[new], n - k, axis=1)[:, n - k].astype(np.float64)
            low[new] = (kth * (1 - self.off[new]) - 1e-6) * (1 - self.off[new])
        low = np.maximum(low, np.finfo(np.float32).tiny).astype(np.float32)
        low = np.where(low > np.finfo(np.float32).tiny, np.nextafter(low, np.float32(0)), low)
        may = np.flatnonzero(about >= low[:, None])
        if not len(may):
            return
        row, doc = np.divmod(may, n)
        score = np.empty(len(may))
        for i in range(0, len(may), PAIRS):
            r, d = row[i : i + PAIRS], doc[i : i + PAIRS]
            score[i : i + PAIRS] = (block.double[self.columns[:, None], d[None, :]] * self.common.T[:, r]).sum(axis=0)
        at = np.minimum(np.searchsorted(may, place), len(may) - 1)
        same = may[at] == place
        np.add.at(score, at[same], weight[same])
        score = np.round(score, 6)
        better = score > least[row]
        row, doc, score = row[better], doc[better] + block.before, score[better]
        own = np.unique(row)
        known = np.repeat(own, k), self.doc[own].reshape(-1), self.score[own].reshape(-1)
        row, doc, score = (np.concatenate([x[known[1] >= 0], y]) for x, y in zip(known, (row, doc, score), strict=True))
        order = np.lexsort((doc, -score, row))
        row, doc, score = row[order], doc[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, doc, score, rank = (x[rank < k] for x in (row, doc, score, rank))
        self.score[row, rank], self.doc[row, rank] = score, doc


class _Docs:
    """A block of documents: a matrix of the weights of common words, and the postings of the others by word."""

    def __init__(self, b: pa.RecordBatch, before: int, idf: np.ndarray, column: np.ndarray, avg_len: float, k1: float, b_len: float):
        self.n, self.before = b.num_rows, before
        _, doc = list_rows(b.column("terms"))
        term, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
        length = b.column("len").to_numpy(zero_copy_only=False)[doc]
        weight = idf[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b_len + b_len * length / avg_len)))
        own = column[term]
        self.double = np.zeros((column.max(initial=-1) + 1, self.n))
        self.double[own[own >= 0], doc[own >= 0]] = weight[own >= 0]
        self.single = self.double.astype(np.float32)
        rest = np.flatnonzero(own < 0)
        rest = rest[np.argsort(term[rest], kind="stable")]
        self.doc, self.weight = doc[rest], weight[rest]
        self.first = np.searchsorted(term[rest], np.arange(len(idf) + 1))


def best(vocabulary_path: str, frequency_path: str, postings_path: str, n: int, avg_len: float, k: int, k1: float, b_len: float) -> Callable:
    """(query_id, terms) to (query_id, key, score, rank)."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key, lists = (pa.concat_arrays([b.column(c) for b in held]) for c in ("query_id", "terms"))
        vocabulary = _vocabulary(vocabulary_path)
        df = np.zeros(len(vocabulary))
        for b in _blocks(frequency_path, ["term", "df"], 1 << 16):
            df[b.column("term").to_numpy()] = b.column("df").to_numpy()
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        common = np.argsort(-df, kind="stable")[:COLUMNS]
        common = common[df[common] * COMMON >= max(1, n)]
        column = np.full(len(df), -1)
        column[common] = np.arange(len(common))

        _, row = list_rows(lists)
        term = _numbered(lists.flatten(), vocabulary)
        row, term = row[df[term] > 0], term[df[term] > 0]
        has = np.zeros((len(key), len(common)), bool)
        has[row[column[term] >= 0], column[term[column[term] >= 0]]] = True
        row, term = row[column[term] < 0], term[column[term] < 0]
        # Queries of like words stand together, so that a block of them has few columns.
        order = np.lexsort(has.T[::-1]) if len(common) else np.arange(len(key))
        asked = []
        for i in range(0, len(key), QUERIES):
            at = order[i : i + QUERIES]
            local = np.full(len(key), -1)
            local[at] = np.arange(len(at))
            own = np.flatnonzero(local[row] >= 0)
            own = own[np.lexsort((term[own], local[row[own]]))]
            asked.append(_Queries(at, has[at], (local[row[own]], term[own]), has[at].sum(axis=1) + np.bincount(local[row[own]], minlength=len(at)), k))
        before = 0
        for b in _blocks(postings_path, ["len", "terms", "tfs"]):
            block = _Docs(b, before, idf, column, avg_len, k1, b_len)
            for q in asked:
                q.see(block)
            before += b.num_rows

        wanted = np.unique(np.concatenate([q.doc[q.doc >= 0] for q in asked]))
        ids, before = [], 0
        for b in _blocks(postings_path, ["key"], 1 << 16):
            lo, hi = np.searchsorted(wanted, [before, before + b.num_rows])
            ids.append(b.column(0).take(pa.array(wanted[lo:hi] - before)))
            before += b.num_rows
        if not len(wanted):
            return
        ids = pa.concat_arrays(ids)
        for q in asked:
            r, rank = np.nonzero(q.doc >= 0)
            found = ids.take(pa.array(np.searchsorted(wanted, q.doc[r, rank])))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(q.at[r])), found, pa.array(q.score[r, rank]), pa.array(rank + 1, pa.int32())], names=["query_id", "key", "score", "rank"])

    return run
