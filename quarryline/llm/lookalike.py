"""One consistent form for texts that look alike but differ in their characters.

Look-alike pairs, of code points and of strings, come from fixed lists and from rules over the Unicode database. Union-find
joins them into transitive classes; each class is written as its member that is most frequent in the texts at hand, and an
Aho-Corasick automaton rewrites the longest members first, from left to right. Marks without any shape are alike to the
empty string, all gaps to one space. Accents, case, digits and punctuation stay what they are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarryline.llm import kernel as K

# Letters of other scripts that look like Latin ones.
CYRILLIC = "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX ҮY ԌG ԚQ ԜW аa сc еe һh іi јj оo рp ԛq ѕs ԝw хx уy ԁd"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ρp νv ϲc ϳj"
OTHER = "ɡg ɑa ϹC"
ARMENIAN = "ՕO ՍU ՏS օo ոn սu հh ցg զq յj"
COPTIC = "ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc"
CHEROKEE = "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
# Styles of quotes and dashes.
SINGLE_QUOTES = "'‘’‚‛′‵ʼʹ`´‹›"
DOUBLE_QUOTES = '"“”„‟″‶〝〞〟«»'
DASHES = "-‐‑‒–—―−⁃﹘﹣"
# Code points without shape that are not in category Cf, and code points of Cf that have a shape.
SHAPELESS = "͏ᅟᅠ឴឵ㅤﾠ⠀"
SHAPED = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
#: Compatibility decompositions that only change a letter's width, place or face (bold, script, double-struck), or write a
#: ligature as one.
SAME_SHAPE = {"<font>", "<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
LIGATURES = [(0xFB00, 0xFB18), (0x2160, 0x2180), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0x0132, 0x0134), (0x2024, 0x2027)]


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: str, y: str) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def all(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def _shapeless(c: str) -> bool:
    kind = unicodedata.category(c)
    return (kind == "Cf" and c not in SHAPED) or c in SHAPELESS or (kind == "Cc" and not c.isspace()) or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or 0x180B <= ord(c) <= 0x180F


@cache
def classes() -> tuple[tuple[str, ...], ...]:
    """All look-alike classes. Their number is fixed by the Unicode database, some thousands, whatever the data."""
    found = Classes()
    for pair in f"{CYRILLIC} {GREEK} {OTHER} {ARMENIAN} {COPTIC} {CHEROKEE} {LISU}".split():
        found.join(pair[0], pair[1])
    for alike in (SINGLE_QUOTES, DOUBLE_QUOTES, DASHES):
        for c in alike[1:]:
            found.join(alike[0], c)
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if c.isspace():
            found.join(" ", c)
        elif _shapeless(c):
            found.join("", c)
        elif part := unicodedata.decomposition(c):
            kind, _, codes = part.partition(" ")
            if kind in SAME_SHAPE or (kind == "<compat>" and any(a <= code < b for a, b in LIGATURES)):
                to = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in codes.split()))
                if not to.startswith(" "):
                    found.join(c, to)
    return tuple(tuple(x) for x in found.all() if len(x) > 1)


def members() -> list[str]:
    return [m for group in classes() for m in group]


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """Of each class member what is written for it: the member of the greatest length, so that it is made of plain
    characters, that is most frequent (then the least), itself rewritten. Gaps become a space, shapeless marks nothing."""
    best = {}
    for group in classes():
        if "" in group:
            to = ""
        elif " " in group:
            to = " "
        else:
            longest = max(map(len, group))
            to = min((m for m in group if len(m) == longest), key=lambda m: (-counts.get(m, 0), m))
        best |= dict.fromkeys(group, to)
    return {m: to if len(to) < 2 else "".join(best.get(c, c) for c in to) for m, to in best.items() if m}


class Rewriter:
    """Texts in their consistent form, by a multi-pattern automaton over the class members that change.

    It runs over the stretches of a text that those members' characters can be in; elsewhere none can match."""

    def __init__(self, table: dict[str, str]) -> None:
        changing = {m: to for m, to in table.items() if m != to}
        self.automaton = ahocorasick.Automaton()
        for m, to in changing.items():
            self.automaton.add_word(m, (len(m), to))
        self.automaton.make_automaton()
        # All but ASCII characters that no changing member has: a small class, which the search passes over fast.
        self.stretch = re.compile("[^" + "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in "".join(changing)) + "]+")

    def _rewritten(self, stretch: re.Match) -> str:
        text, out, at = stretch.group(), [], 0
        for end, (n, to) in self.automaton.iter_long(text):
            out += (text[at : end + 1 - n], to)
            at = end + 1
        return "".join([*out, text[at:]])

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        plain = self.stretch.sub(self._rewritten, unicodedata.normalize("NFD", text))
        return re.sub(" +", " ", unicodedata.normalize("NFC", plain)).strip(" ")


def _counter(single: np.ndarray):
    """Counts of the code points `single`, which come from the driver: a task then needs no class table of its own."""

    def run(batches):
        total = np.zeros(sys.maxunicode + 1, np.int64)
        for b in batches:
            for i, j in K.chunks(texts := [unicodedata.normalize("NFD", t) for t in b.column("text").to_pylist() if t]):
                total += np.bincount(K.code_points("".join(texts[i:j])), minlength=len(total))
        hits = single[total[single] > 0]
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in hits], pa.string()), pa.array(total[hits], pa.int64())], names=["member", "n"])

    return run


def frequencies(texts: DataFrame) -> dict[str, int]:
    """How often each class member of one code point occurs in all of texts (text); one row a member reaches the driver,
    so at most as many as there are class members."""
    single = np.array(sorted(ord(m) for m in members() if len(m) == 1))
    counted = texts.select("text").mapInArrow(_counter(single), "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))
    return {r["member"]: r["n"] for r in counted.collect()}


def canonical(df: DataFrame, text: str, out: str, table: dict[str, str]) -> DataFrame:
    """df with `out`: the consistent form of `text` under a rewriting() table. Null stays null; empty and blank texts, and
    such as consist of shapeless marks, become empty. A filter on `out` stays behind the rewriting, which then runs once."""

    def run(batches):
        rewrite = Rewriter(table)
        for b in batches:
            forms = pa.array([rewrite(t) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, forms], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def look_alikes(a: DataFrame, a_key: str, a_text: str, b: DataFrame, b_key: str, b_text: str) -> DataFrame:
    """(a_key, b_key): each pair of rows, over all of both tables, whose texts have the same consistent form without being
    the same string. Null keys and null, empty and blank texts pair with nothing; repeated rows count once; a table may
    be empty."""
    x = a.select(F.col(a_key).alias("__a"), F.col(a_text).alias("text")).where("__a IS NOT NULL AND text IS NOT NULL").distinct()
    y = b.select(F.col(b_key).alias("__b"), F.col(b_text).alias("text")).where("__b IS NOT NULL AND text IS NOT NULL").distinct()
    table = rewriting(frequencies(x.select("text").unionByName(y.select("text"))))
    x = canonical(x, "text", "form", table).where("form <> ''").withColumnRenamed("text", "__x")
    y = canonical(y, "text", "form", table).where("form <> ''").withColumnRenamed("text", "__y")
    return x.join(y, "form").where("__x <> __y").select(F.col("__a").alias(a_key), F.col("__b").alias(b_key)).distinct()
