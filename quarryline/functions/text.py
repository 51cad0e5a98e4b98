"""Column functions over texts. All run in the JVM and count code points; a null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that both Java and RE2 read alike. `\\s` and `\\w` of either know ASCII only, so classes are spelt out.
GAP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"({MONTHS}){GAP}+([0-9]{{1,2}}),?{GAP}+([0-9]{{4}})"
PAGE_LINE = rf"(?i)^{GAP}*Page{GAP}+[0-9]+{GAP}+of{GAP}+[0-9]+{GAP}*$"
SHEET_LINE = rf"(?i)^{GAP}*Continuation Sheet{GAP}*$"
SUBJECT_LABEL = rf"^{GAP}*Sub(?:ject)?{GAP}*:"
ADDRESSEE = rf"^{GAP}*(?:All Members|All Mutual Funds|To,?)(?:[^\p{{L}}\p{{N}}_].*)?$"
BODY_OPENING = r"(?i)^(?:this is|members are|in pursuance|exchange is)"
QUESTION_OPENING = rf"(?i)^(?:what|when|who|which|how){GAP}+(?:is|are|does|do|must|should){GAP}+"
TOKEN = r"[A-Za-z0-9]+(?::[0-9]+)?"
LABELLED = r"(?:^|; ?)[^;]*: "


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{GAP}+|{GAP}+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, rf"{GAP}+", " ")


def norm_text(text: Column) -> Column:
    """White space collapsed and stripped, lower case."""
    return F.lower(F.trim(collapse(text)))


def clean_lines(text: Column) -> Column:
    """Lines joined again without page marks, continuation marks, blank lines and trailing white space."""
    keep = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(PAGE_LINE) | x.rlike(SHEET_LINE) | x.rlike(rf"^{GAP}*$")))
    return F.array_join(F.transform(keep, lambda x: F.regexp_replace(x, rf"{GAP}+$", "")), "\n")


def collapse_blank_lines(text: Column) -> Column:
    """At most one blank line on end, nothing around, one line end behind."""
    return F.concat(strip(F.regexp_replace(text, r"\n{3,}", "\n\n")), F.lit("\n"))


def table_row_labelled(headers: list[Column], cells: list[Column]) -> Column:
    """"header: cell" of each non-empty cell, joined by "; ", after two spaces; of unequal lists the shorter counts."""
    pairs = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(h, F.lit(": "), c)) for h, c in zip(headers, cells, strict=False)]
    return F.concat(F.lit("  "), F.array_join(F.array_compact(F.array(*pairs)), "; "))


def doc_date(text: Column) -> Column:
    """The first date written as Month D, YYYY among the first 800 code points."""
    head = F.substring(text, 1, 800)
    part = lambda k: F.regexp_extract(head, DATE, k)
    return F.try_to_timestamp(F.concat_ws(" ", part(1), part(2), part(3)), F.lit("MMMM d yyyy")).cast("date")


def _tidy_subject(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(collapse(line)), r"\.+$", ""))


def doc_subject(text: Column) -> Column:
    """The labelled subject line of the first 1500 code points; without one, the first line after an addressee that is
    neither blank nor an addressee, unless it is too long for a heading or opens like a body."""
    head = F.substring(text, 1, 1500)
    lines = F.split(head, "\n")
    labelled = F.filter(lines, lambda x: x.rlike(rf"{SUBJECT_LABEL}{GAP}*[^\s\x{{a0}}]"))
    label = F.regexp_replace(F.element_at(labelled, 1), SUBJECT_LABEL, "")
    first = F.array_position(F.transform(lines, lambda x: x.rlike(ADDRESSEE)), True)
    after = F.filter(F.slice(lines, F.greatest(first, F.lit(1)) + 1, F.size(lines)), lambda x: ~x.rlike(rf"^{GAP}*$") & ~x.rlike(ADDRESSEE))
    line = strip(F.element_at(after, 1))
    heading = F.when((F.length(line) <= 160) & ~line.rlike(BODY_OPENING), _tidy_subject(line))
    return F.when(F.size(labelled) > 0, _tidy_subject(label)).when(first > 0, F.when(F.size(after) > 0, heading))


def doc_serial(doc_id: Column) -> Column:
    """What follows the last hyphen."""
    return F.substring_index(doc_id, "-", -1)


def doc_header(text: Column) -> Column:
    """What stands before a subject label at a line's start; without one, the first 600 code points."""
    return F.when(text.rlike(rf"(?m){SUBJECT_LABEL}"), F.split(text, rf"(?m){SUBJECT_LABEL}", 2)[0]).otherwise(F.substring(text, 1, 600))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), 0)


def words(text: Column) -> Column:
    """Lower-cased words of letters, numbers and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def bound(value: Column, use) -> Column:
    """use(value) with `value` evaluated once, however often `use` mentions it: in a lambda it would be evaluated each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct n-word windows; none for fewer words."""
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return bound(words(text), lambda w: F.when(F.size(w) >= n, F.array_distinct(windows(w))).when(w.isNotNull(), F.array().cast("array<string>")))


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """As shingles(), a hash of each window in its place."""
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    return bound(words(text), lambda w: F.when(F.size(w) >= n, F.array_distinct(windows(w))).when(w.isNotNull(), F.array().cast("array<bigint>")))


def own_serial(doc_id: Column, text: Column) -> Column:
    """The document's serial if it stands in the first 3000 code points with no digit beside it."""
    serial = doc_serial(doc_id)
    return F.when(F.array_contains(digit_runs(F.substring(text, 1, 3000)), serial), serial)


def exact_id_question(doc_id: Column, serial: Column, question: Column) -> Column:
    """The question without its opening and question marks, after "issuer circular serial"."""
    plain = F.regexp_replace(F.regexp_replace(question, QUESTION_OPENING, ""), r"\?+$", "")
    return F.concat(F.substring_index(doc_id, "-", 1), F.lit(" circular "), serial, F.lit(" "), plain)


def strip_fences(text: Column) -> Column:
    """Without the code fence that a model puts around JSON."""
    return F.regexp_replace(strip(text), r"^```(?:json)?[\s]*|[\s]*```$", "")


def canon_tokens(text: Column) -> Column:
    """Value tokens in lower case; of a labelled table row, only those after each cell's first ": "."""
    labelled = F.contains(text, F.lit(";")) & strip(text).rlike(LABELLED)
    cells = F.transform(F.split(strip(text), ";"), lambda c: F.regexp_replace(c, r"^(?s:.*?): ", ""))
    plain = F.when(labelled, F.array_join(cells, " ")).otherwise(text)
    return F.transform(F.regexp_extract_all(plain, F.lit(TOKEN), 0), lambda t: F.lower(t))


def context(text: Column, start: Column, end: Column, around: int) -> Column:
    """The text from `around` code points before a place to as many after it, white space collapsed."""
    low = F.greatest(F.lit(0), start - around)
    return collapse(F.substring(text, (low + 1).cast("int"), (end + around - low).cast("int")))


def ntok(text: Column) -> Column:
    """Tokens taken as four characters: a quarter of the length, rounded half to even, one at least; null for null."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(4.0)).cast("int")))
