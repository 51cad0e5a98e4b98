"""Sentence units with offsets, for texts of any language, by a pushdown automaton.

A text is cut into blocks at blank lines; a table is one unit. Over the marks of a block runs an automaton whose stack
holds the open quotations and brackets: a closing mark inside them ends nothing. A second stack holds the levels of lists,
so that a clause number is known by the one before it; it belongs to the sentence that it begins. Each language's
abbreviations stand in tries that are read backwards from a period; other scripts end sentences by marks of their own, Thai
by a gap. A block's language is that of most of its function words, else the text's, else the one that its row names.

Every step looks at what it has not seen before or at a bounded number of characters, so the time is linear in the text.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by language, without the last period. After those a sentence always goes on: what follows is a
# name or the abbreviated phrase's rest.
GOES_ON = {
    "": """Dr Prof M/s Messrs vs Vs v cf Cf St
        п пп ст гл рис табл стр см ср им проф акад г-н г-жа т.е т.к т.н ул тел
        रु क्र मे डॉ श्री सु प्रो सं د أ م ص ت พ.ศ ค.ศ ดร นพ น.ส""",
    "en": "Mr Mrs Ms Hon Shri Smt Kum Rev Gen Col Capt Gov Rs e.g E.g i.e I.e viz Viz approx r/w w.r.t w.e.f Pvt Encl Dept Ver ver Tel tel",
    "de": "Hr Herr Fr Frau gem bzw ca vgl Vgl ggf evtl inkl exkl zzgl z.B d.h i.H.v i.d.R u.U",
    "fr": "M MM Mme Mmes Mlle Me Mgr env av bd c.-à-d p.ex",
    "es": "Sr Sra Sres Dra Srta D Dña Lic Ing Av p.ej",
}
# Abbreviations after which a sentence goes on if a number, a numeral, a letter or a code follows.
REFERS = {
    "": "F.Y FY Ref ref p pp vol Vol fig Fig",
    "en": "Nos nos Sec sec Art Arts art arts para paras Para cl cls Cl Clause Refs Annex Annexure Figs figs Ch ch Reg regs Chap chap Eq eq Tab pg Sch sch",
    "de": "Nr Nrn Abs Ziff Art Bd Kap lit Anm Anl Abb Tab Str",
    "fr": "n no n° réf chap art al cap",
    "es": "núm núms pág págs cap art arts",
}
# Abbreviations of any language that may also be a sentence's last word.
MAY_END = """
Ltd Inc Co Corp LLC LLP Plc plc Bros Jr Assn GmbH AG S.A S.L S.p.A S.A.S S.R.L al etc Etc a.m p.m A.M P.M U.S U.K U.N E.U
usw u.a o.ä u.ä Mio Mrd Uhr EUR ggü
Cie Sté
Cía EE.UU Uds
руб коп тыс млн млрд г гг в вв ч мин сек т.д т.п др лот
लि प्रा
""".split()
# Function words that tell languages of Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to is for be with by under that was were are".split(),
    "de": "der die das und ist nicht für von mit dem den wird werden auf".split(),
    "fr": "le les et du au aux est pour dans que une sur avec ne".split(),
    "es": "el los las del y por una con para se al su como más".split(),
}
# Thai abbreviations of eras. They go on with the year before them, so a gap before one ends nothing.
ERAS = ("พ.ศ.", "ค.ศ.", "ร.ศ.", "จ.ศ.", "ฮ.ศ.")
# Months after an ordinal number in German.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Pairs of quotation marks and brackets.
PAIRS = {"„": "“”", "“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "【": "】"}
CLOSES = {c: tuple(o for o, closers in PAIRS.items() if c in closers) for c in "".join(PAIRS.values())} | {'"': ('"',)}
OPENS, CLOSERS = {*PAIRS, '"'}, {*CLOSES}
# Hiragana with which a sentence goes on after a closing quotation mark, and words that begin a new one.
PARTICLES = "とはがをにでものやへよなっだ"
STARTERS = ("とくに", "ところ", "とはいえ", "ともあれ", "はじめ", "でも", "では", "ですが", "もし", "もっとも", "もちろん", "なお", "なぜ", "なかでも", "だが", "だから", "にもかかわらず", "やがて", "よって", "のち")

STRONG = "。！？｡।॥؟۔!?"
_MARKS = ".…" + STRONG
#: A pair's mark alone, or a run of closing marks; one class of first characters, so that the search skips to them.
EVENT = re.compile("[" + re.escape("".join(PAIRS) + "".join(CLOSERS)) + _MARKS + "](?:(?<=[" + _MARKS + "])[" + _MARKS + "]+)?")
THAI = re.compile("[ก-ฺเ-๎]")
THAI_GAP = re.compile("(?<=[ก-ฺเ-๎])[^\\S\\n\\r]+(?=[ก-ฺเ-๎])")
BLANK = re.compile(r"(?:\r\n|\n|\r)(?:[^\S\n\r]*(?:\r\n|\n|\r))+")
NUMBERED = re.compile(r"(?:\((?:[A-Za-z]|[ivxIVX]{1,5}|\d{1,3})\)|\d{1,3}(?:\.\d{1,3})*[.)]|[A-Za-z]\))(?=\s)\s*")
#: What a word before a period begins after.
BREAKS = frozenset("\"“”„«»‹›「」『』（([【")
SPACE = re.compile(r"\s")
GAP = re.compile(r"[\s﻿]*")
CELL = re.compile(r"(?:^|\s)\|(?:\s|$)|\S\t+\S")
WORD = re.compile(r"[^\W\d_]+")
INITIAL = re.compile(r"[^\W\d_]\.")
#: A number or code, of 64 characters at most up to its first digit.
REFERENCE = re.compile(r"\S{0,63}[\d/]")
CODE = re.compile(r"[(\[]?(?:\S{0,63}\d|[A-Z]{2,}[/-]|Nos?\b|[IVXLCDM]{2,}\b|[A-Za-z]\b)")
ORDINAL = re.compile(r"\d{1,2}$")
DOTTED = re.compile(r"[^\W\d_]\.[^\W\d_]$")


class Trie:
    """Words read from their last character on."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = True

    def ends(self, text: str, at: int, start: int) -> bool:
        """Whether one of the words stands before `at`, as a whole word, from `start` on at the earliest."""
        node, i = self.root, at
        while i > start and text[i - 1] in node:
            i -= 1
            node = node[text[i]]
            if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] in ".-_@/&" or _is_mark(text[i - 1]))):
                return True
        return False


def _is_mark(c: str) -> bool:
    return "ऀ" <= c <= "ः" or "ा" <= c <= "ॏ"


_ON, _REF = ({x: Trie(f"{lists['']} {lists[x]}".split()) for x in FUNCTION_WORDS} for lists in (GOES_ON, REFERS))
_ANY, _MAY = Trie(" ".join([*GOES_ON.values(), *REFERS.values()]).split()), Trie(MAY_END)
_FUNCTION = {x: frozenset(words) for x, words in FUNCTION_WORDS.items()}
#: Abbreviations written with gaps, by their letters, and the number of letters of the longest.
_SPACED_ON = ("z.b", "d.h", "i.h.v", "i.h", "u.u", "т.е", "т.к", "p.ej", "p.ex")
_SPACED = 6


def _votes(text: str) -> Counter:
    """How many of each language's function words the text holds."""
    words = set(text.lower().split())
    return Counter({x: len(own & words) for x, own in _FUNCTION.items()})


def _most(votes: Counter) -> str | None:
    (first, n), (_, m) = votes.most_common(2)
    return first if n > m else None


ROMAN = {c: n for n, c in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split(), 1)}


class Levels:
    """The open list levels: a stack of (form, number) of the last clause number of each."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[int, ...]]] = []

    @staticmethod
    def _read(mark: str) -> list[tuple[str, tuple[int, ...]]]:
        """What a clause number can be; a letter can be a roman numeral."""
        mark = mark.strip()
        body, form = mark.strip("()."), re.sub(r"\w+", "x", mark)
        if body[0].isdigit():
            return [(form, tuple(map(int, body.split("."))))]
        out = [(form + "a", (ord(body) - 96,))] if len(body) == 1 and body.islower() else [(form + "A", (ord(body) - 64,))] if len(body) == 1 else []
        if body.lower() in ROMAN:
            out.append((form + ("r" if body.islower() else "R"), (ROMAN[body.lower()],)))
        return out

    def _place(self, mark: str) -> int | None:
        """The level that the number goes on with."""
        for form, n in self._read(mark):
            before = (form, (*n[:-1], n[-1] - 1))
            if before in self.stack:
                return self.stack.index(before)
        return None

    def goes_on(self, mark: str) -> bool:
        return self._place(mark) is not None

    def enter(self, mark: str) -> None:
        """Go on with a level, closing those within it, or open one; a form is open only once, so there are few levels."""
        read, at = self._read(mark), self._place(mark)
        if at is not None:
            form = self.stack[at][0]
            self.stack[at:] = [x for x in read if x[0] == form]
        elif read:
            new = min(read, key=lambda x: x[1])
            forms = [f for f, _ in self.stack]
            self.stack[forms.index(new[0]) if new[0] in forms else len(forms) :] = [new]


def _is_table(block: str) -> bool:
    """Whether at least half of the lines have cells, parted by bars that stand free or by tabs."""
    if "|" not in block and "\t" not in block:
        return False
    lines = block.split("\n")
    return sum(CELL.search(x.strip()) is not None for x in lines) * 2 >= len(lines)


def _matched(marks: list[str]) -> dict[int, int]:
    """Of each mark that opens or closes a pair within the block its partner; others are ignored."""
    stack: list[tuple[str, int]] = []
    held = dict.fromkeys(OPENS, 0)
    out: dict[int, int] = {}
    for k, c in enumerate(marks):
        for o in CLOSES.get(c, ()):
            if held[o]:
                break
        else:
            if c in held:
                stack.append((c, k))
                held[c] += 1
            continue
        while True:
            o, at = stack.pop()
            held[o] -= 1
            if o in CLOSES[c]:
                break
        out[at], out[k] = k, at
    return out


def _starts(text: str, at: int, end: int, levels: Levels) -> str:
    """What begins at `at`: "upper", "lower", "uncased", "number", "opening", "clause" or "other"."""
    c = text[at]
    if m := NUMBERED.match(text, at, end):
        k = GAP.match(text, m.end(), end).end()
        if k < end and (text[k].isupper() or text[k] in "\"“„«¿¡" or (text[k].isalpha() and not text[k].islower()) or levels.goes_on(m.group())):
            return "clause"
    if c.isupper() or c in "¿¡":
        return "upper"
    if c.islower():
        return "lower"
    if c.isdigit():
        return "number"
    if c in "([（":
        k = at + 1
        return "opening" if k < end and (text[k].isupper() or text[k] in "\"“„«") else "aside"
    if c == '"' or c in PAIRS:
        return "opening"
    return "uncased" if c.isalpha() or _is_mark(c) else "other"


def _dotted(text: str, lo: int, p: int) -> str:
    """The letters with periods, each with a space or none behind, that end with the period at `p`: the last ones, without
    the gaps; empty if a longer word ends in them."""
    out, i = "", p
    while len(out) < 2 * _SPACED and i > lo and text[i] == "." and text[i - 1].isalpha():
        if i - 1 > lo and (text[i - 2].isalnum()):
            break
        out = text[i - 1] + "." + out
        i -= 2
        if i > lo and text[i].isspace():
            i -= 1
    return out.lower()


def _after_number(text: str, lo: int, p: int) -> bool:
    """Whether a number, or a bracket's end, stands before `p`, gaps aside: a letter there is a unit."""
    while p > lo and text[p - 1].isspace():
        p -= 1
    return p > lo and text[p - 1] in "0123456789)"


class Text:
    """One text and where its automaton stands."""

    def __init__(self, text: str, lang: str | None) -> None:
        self.text, self.levels, self.named = text, Levels(), (lang or "")[:2].lower()
        self.thai = THAI.search(text) is not None
        self._known: str | None = None
        self._word, self._space, self._at = (0, 0), -1, -1

    def language(self, lo: int, hi: int) -> str:
        """The language of a block."""
        return _most(_votes(self.text[lo:hi])) or self.whole()

    def whole(self) -> str:
        if self._known is None:
            self._known = _most(_votes(self.text)) or (self.named if self.named in _ON else "en")
        return self._known

    def word_start(self, lo: int, p: int) -> int:
        """Where the word before `p` begins; `p` grows from call to call, so what was gone through is not gone through again."""
        seen, start = self._word
        i, text = p, self.text
        while i > lo and not ((c := text[i - 1]).isspace() or c in BREAKS):
            i -= 1
            if i == seen:
                i = max(start, lo)
                break
        self._word = (p, i)
        return i

    def token_holds_at(self, at: int) -> bool:
        """Whether an "@" stands in the run without gaps that begins at `at`."""
        if self._space < at:
            m = SPACE.search(self.text, at)
            self._space = m.start() if m else len(self.text)
        if self._at < at:
            found = self.text.find("@", at)
            self._at = found if found >= 0 else len(self.text)
        return self._at < self._space

    def ends(self, lo: int, hi: int, p: int, q: int, e: int, closed: bool, lang: list[str | None]) -> bool:
        """Whether the marks [p, q), with closing marks up to e, end a sentence of the block [lo, hi)."""
        text = self.text
        ne = GAP.match(text, e, hi).end()
        if ne >= hi:
            return True
        gap, last = ne > e, text[q - 1]
        nxt = text[ne]
        if nxt in ",;:，、；：)]）】%％" or nxt in "-–—" and gap:
            return False
        kind = _starts(text, ne, hi, self.levels)
        if "…" in text[p:q] or q - p > 1 and ".." in text[p:q]:
            return kind in ("upper", "opening", "clause")
        if last in "。！？｡":
            return not (closed and not gap and nxt in PARTICLES and not text.startswith(STARTERS, ne))
        if last in STRONG:
            return kind != "lower" and not (kind == "aside" and closed)
        # A period.
        if closed and kind == "lower":
            return False
        first = self.word_start(lo, p)
        # What follows depends on words of few characters and on the ends of longer ones.
        word = text[max(first, p - 40) : p]
        one = p - first == 1 and word.isalpha()
        if not gap and e == q:
            if kind == "clause":
                return word[-1:].isalpha()
            if nxt.isdigit() or nxt == "_" or kind in ("lower", "uncased", "other", "aside"):
                return False
            if nxt.isupper():
                mail = self.token_holds_at(ne)
                short = len(word) < 2 or not (word[-2].isalnum() or word[-2] == "_")
                if mail or short or not word[-1].islower():
                    return _MAY.ends(text, p, lo) and not mail and p - first > 1 and not text.startswith(".", ne + 1)
        if kind == "lower":
            return False
        if word.lower() in ("no", "n") and REFERENCE.match(text, ne, hi):
            return False
        if kind == "upper" and ORDINAL.fullmatch(word) and (m := WORD.match(text, ne, hi)) and m.group() in MONTHS:
            return False
        letters = _dotted(text, lo, p) if one else ""
        if one and letters.rstrip(".").endswith(_SPACED_ON):
            return False
        if _ANY.ends(text, p, lo) and not (one and word.islower() and _after_number(text, lo, p - 1)):
            if lang[0] is None:
                lang[0] = self.language(lo, hi)
            if _ON[lang[0]].ends(text, p, lo):
                return False
            # "A" and "I" are words as well, but not after a capitalised reference.
            if _REF[lang[0]].ends(text, p, lo) and (m := CODE.match(text, ne, hi)) and (m.group() not in ("A", "I") or text[first].isupper()):
                return False
        if one and not _after_number(text, lo, p - 1):
            if not (letters.count(".") > 1 and not INITIAL.match(text, ne)):
                return False
        if _MAY.ends(text, p, lo) or one or DOTTED.search(word):
            return kind in ("upper", "opening", "clause")
        return kind != "aside" or word[-1:] != "."

    def _begin(self, at: int, hi: int) -> int:
        """Where the marks of a sentence that begins at `at` count from: behind its clause number."""
        m = NUMBERED.match(self.text, at, hi)
        if m is None:
            return at
        self.levels.enter(m.group())
        return m.end()

    def block(self, lo: int, hi: int) -> list[tuple[int, int]]:
        text, out, start = self.text, [], GAP.match(self.text, lo, hi).end()
        if start >= hi:
            return out
        end = start + len(text[start:hi].rstrip())
        if _is_table(text[start:hi]):
            return [(start, end)]
        events = list(EVENT.finditer(text, start, hi))
        if self.thai:
            gaps = [m for m in THAI_GAP.finditer(text, start, hi) if not text.startswith(ERAS, m.end())]
            events = sorted([*events, *gaps], key=re.Match.start)
        marks = [m.group() for m in events]
        partner = _matched(marks)
        closers = {events[k].start(): marks[o] for k, o in partner.items() if o < k}
        depth = angles = 0  # open pairs, and those of angled marks among them
        done, lang = self._begin(start, hi), [None]
        for k, c in enumerate(marks):
            known = k in partner
            if not known and (c in OPENS or c in CLOSERS):
                continue
            p = events[k].start()
            if p < done:
                continue
            if known:
                step = 1 if partner[k] > k else -1
                depth += step
                angles += step * ((c if step > 0 else closers[p]) in "«‹")
                continue
            if c[0].isspace():
                e = p if not depth else 0
            else:
                q = e = events[k].end()
                while e < hi:
                    at = e
                    if angles and text[e].isspace():
                        to = GAP.match(text, e, hi).end()
                        at = to if to < hi and text[to] in "»›" else e
                    if at in closers:
                        depth -= 1
                        angles -= closers[at] in "«‹"
                    elif not (text[at] in "'’" and (at + 1 == hi or text[at + 1].isspace())):
                        break
                    e = at + 1
                closed = e > q
                done = max(done, e)
                if depth or not self.ends(lo, hi, p, q, e, closed, lang):
                    e = 0
            if e:
                out.append((start, e))
                start = GAP.match(text, e, hi).end()
                done = max(self._begin(start, hi), done)
        if start < hi:
            out.append((start, end))
        return [(s, e) for s, e in out if e > s]


def sentences(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """[start, end) of each sentence, without white space around it. lang: the language if neither words nor script tell it."""
    out, lo, own = [], 0, Text(text, lang)
    for m in BLANK.finditer(text):
        out += own.block(lo, m.start())
        lo = m.end()
    return out + own.block(lo, len(text))


def _run(batches):
    for b in batches:
        keys, starts, ends = [], [], []
        for key, text, lang in zip(b.column("key"), b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            if text:
                found = sentences(text, lang)
                keys += [key.as_py()] * len(found)
                starts += [s for s, _ in found]
                ends += [e for _, e in found]
        yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("key").type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "sent_start", "sent_end"])


def sentence_units(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """(key, sent_start, sent_end) of every sentence of every row, in code points, half-open, without white space or a
    byte-order mark around it. Null, empty and blank texts give no rows; rows with a null key keep it; repeated rows
    repeat their sentences; very long texts are read whole. lang: a column that names the language, by which abbreviations
    are taken where the words don't tell it; it may be wrong or null."""
    kind = df.schema[key].dataType.simpleString()
    named = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), named.alias("lang"))
    return rows.mapInArrow(_run, f"key {kind}, sent_start int, sent_end int").withColumnRenamed("key", key)
