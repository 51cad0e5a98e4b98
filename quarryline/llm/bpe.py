"""Byte-pair encoding by prefix dynamic programming.

A prefix's encoding has one valid last token. For each byte prefix of a piece that token is stored: it is the one suffix in
the vocabulary that is compatible with the stored last token of what stands before it. Reading the stored tokens from the
end gives the encoding; appending bytes only adds entries, and after an edit only the entries from there on are new, up to where they
agree with the old ones again.

Texts are cut into pieces by character class in numpy, equal pieces of a chunk are looked up once, and each worker keeps the encodings of the pieces it has met.
"""

from __future__ import annotations

import base64
import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import kernel as K

#: A public vocabulary file: on each line a token in base64 and its rank, which is its id.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 200_000


class Vocabulary:
    """Token ranks, and whether two tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a single byte and for a token that no merges make."""
        if token not in self._parts:
            self._parts[token] = None
            if len(token) > 1:
                own, limit = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
                while len(own) > 2:
                    best, at = min((self.ranks.get(own[i] + own[i + 1], limit), i) for i in range(len(own) - 1))
                    if best >= limit:
                        break
                    own[at : at + 2] = [own[at] + own[at + 1]]
                if len(own) == 2:
                    self._parts[token] = (own[0], own[1])
        return self._parts[token]

    def whole(self, token: bytes) -> bool:
        """Whether the token's bytes encode to the token itself."""
        return token in self.ranks and (len(token) == 1 or self.parts(token) is not None)

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The tokens that stand at one edge while `token` is being merged, each with the rank that ends its time there."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            made = self.parts(token)
            if made is None:
                return out
            until, token = self.ranks[token], made[side]

    def fits(self, a: int, b: int) -> bool:
        """Whether b may directly follow a: no merge across their border comes before those that make a and b."""
        known = self._fits.get((a, b))
        if known is None:
            known = True
            right = self._edge(self.token[b], 0)
            for x, x_until in self._edge(self.token[a], 1):
                for y, y_until in right:
                    across = self.ranks.get(x + y)
                    # Of equal ranks the left-most is merged first: that of a before the border's, the border's before that of b.
                    if across is not None and (now := max(across, self.ranks[x], self.ranks[y])) < x_until and now <= y_until:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            self._fits[a, b] = known
        return known


class Prefixes:
    """The last tokens of all prefixes of a piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b"") -> None:
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def _token(self, end: int) -> int:
        """The last token of the prefix up to `end`; those of the shorter prefixes are stored."""
        v = self.vocabulary
        for start in range(max(0, end - v.longest), end):
            rank = v.ranks.get(self.piece[start:end])
            if rank is not None and (v.whole(self.piece[start:end]) if start == 0 else v.fits(self.last[start - 1], rank)):
                return rank
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Add bytes at the end; what is stored for the prefixes so far stays valid."""
        done = len(self.piece)
        self.piece += more
        for end in range(done + 1, len(self.piece) + 1):
            self.last.append(self._token(end))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Exchange piece[start:end]; returns how many prefixes were computed again.

        A prefix's token depends on those of as many shorter prefixes as the longest token has bytes. Once so many on end
        behind the edit are as before, all others are."""
        old, moved = self.last[end:], start + len(new)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last[start:] = []
        same = 0
        for at in range(start + 1, len(self.piece) + 1):
            token = self._token(at)
            self.last.append(token)
            if at > moved:
                same = same + 1 if token == old[at - moved - 1] else 0
                if same == self.vocabulary.longest:
                    self.last += old[at - moved :]
                    return at - start
        return len(self.piece) - start

    def tokens(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


def _classes() -> np.ndarray:
    """By code point: 1 letters, 2 numbers, 3 white space, 0 others."""
    if "bpe" not in K._tables:
        import unicodedata

        out = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            out[c] = 1 if kind == "L" else 2 if kind == "N" else 3 if chr(c).isspace() and not 0x1C <= c <= 0x1F else 0
        K._tables["bpe"] = out
    return K._tables["bpe"]


def piece_starts(cp: np.ndarray, texts_at: np.ndarray) -> np.ndarray:
    """Where pieces begin. cp: the texts' code points on end; texts_at: where each non-empty text begins, with the end.

    A piece is a run of letters, of numbers or of others, with a space before it if there is one; or white space, of which
    the last character stands alone unless it is that space or ends the text; or one of the endings 's 't 're 've 'm 'll 'd
    after which a run of letters begins anew."""
    n = len(cp)
    kind = _classes()[cp]
    begins = np.zeros(n + 1, bool)
    begins[texts_at] = True
    starts = begins.copy()
    starts[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(starts)
    a, b = run[:-1], run[1:]
    gap = (kind[a] == 3) & ~begins[b]
    last = b[gap] - 1
    starts[last] = True
    space = cp[last] == 32
    starts[last[space] + 1] = False
    mark = a[(b - a == 1) & (cp[a] == 39) & starts[a] & ~begins[b]]
    if len(mark):
        one = cp[mark + 1]
        two = np.where((mark + 2 < n) & ~begins[np.minimum(mark + 2, n)], cp[np.minimum(mark + 2, n - 1)], 0)
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        size = np.where(is_(one, "stmd"), 1, np.where(is_(one, "rv") & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        starts[mark + 1] = False
        starts[mark + 1 + size] = True
    return np.flatnonzero(starts[:n])


class Encoder:
    """Token ids of texts, with the encodings of the pieces met so far."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary.load(path)
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: bytes) -> tuple[int, ...]:
        if self.vocabulary.whole(piece):
            return (self.vocabulary.ranks[piece],)
        return tuple(Prefixes(self.vocabulary, piece).tokens())

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and each text's bounds."""
        joined = "".join(texts)
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        bounds = np.append(0, np.cumsum(lens))
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cp = K.code_points(joined)
        start = piece_starts(cp, np.unique(bounds))
        end = np.append(start[1:], len(cp))
        hashes = K.span_hash(K.prefix_hash(K.char_table("noise")[cp]), start, end)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        # Pieces of one hash are compared, character by character, with the first of them; a stranger stands for itself.
        size = end - start
        twin = first[which]
        unlike = size != size[twin]
        other = np.arange(len(cp)) + np.repeat(start[twin] - start, size)
        away = np.flatnonzero(cp != cp[np.minimum(other, len(cp) - 1, out=other)])
        unlike[np.searchsorted(start, away, "right") - 1] = True
        if unlike.any():
            strange = np.flatnonzero(unlike)
            which[strange] = len(first) + np.arange(len(strange))
            first = np.append(first, strange)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        rows = []
        for k in first.tolist():
            own = joined[start[k] : end[k]]
            ids = self.known.get(own)
            if ids is None:
                ids = self.known[own] = self.piece(own.encode("utf-8", "surrogatepass"))
            rows.append(ids)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for ids in rows for i in ids), np.int32, int(size.sum()))
        offset = np.append(0, np.cumsum(size))
        each = size[which]
        ends = np.append(0, np.cumsum(each))
        ids = flat[np.arange(ends[-1]) + np.repeat(offset[which] - ends[:-1], each)]
        return ids, ends[np.searchsorted(start, bounds)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str):
    def run(batches):
        encode = encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in K.chunks(texts):
                ids, bounds = encode(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(i, j - i), lists], names=["key", "ids"])

    return run


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens; strings that look like special tokens are
    ordinary text. Null and empty texts give an empty list, null keys stay, repeated rows stay. vocabulary: the path
    of the file, the same on all executors."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_encode(vocabulary), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
