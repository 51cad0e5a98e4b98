"""Operators over documents: lines, passages, validation, duplicates, citations and subject families.

Documents are rows of a text and a key; a null text takes no part unless a docstring says otherwise, other columns are
not looked at, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators.ranking import positions
from quarryline.operators.similarity import prefix_pairs, similar_pairs
from quarryline.shared import written


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line_start, line_end, line): every line with its half-open place; line_no from 0."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")
    return rows.withColumn("line_start", start).select(key, "line_no", "line_start", (F.col("line_start") + F.length("line")).alias("line_end"), "line")


def identity_failures(docs: DataFrame, key: str, doc_id: str, text: str) -> DataFrame:
    """(key, doc_id): documents whose own header doesn't hold their serial as a digit-bounded number."""
    return docs.where(F.col(text).isNotNull() & ~F.array_contains(T.digit_runs(T.doc_header(F.col(text))), T.doc_serial(F.col(doc_id)))).select(key, doc_id)


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, same_as): every document whose text equals, but for white space, that of one with a lesser key: the least.

    The groups are reduced, not gathered: a text that a third of all documents share is one row before the join."""
    # Written once: the digests are read twice, the texts are not.
    hashed = written(docs.where(F.col(text).isNotNull()).select(key, F.unhex(F.sha2(F.trim(T.collapse(F.col(text))), 256)).alias("digest")), "digests")
    first = hashed.groupBy("digest").agg(F.min(key).alias("same_as"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(first, "digest").where(F.col(key) > F.col("same_as")).select(key, "same_as")


def near_duplicates(docs: DataFrame, key: str, text: str, threshold: float = 0.9, n: int = 5) -> DataFrame:
    """(doc_a, doc_b, jaccard, copies_a, copies_b): pairs of different texts whose n-word windows have a Jaccard similarity of
    at least threshold, doc_a < doc_b; each text is named by the least key that has it, copies_ counts the keys.

    Exact by a prefix filter that knows both sizes (similarity.prefix_pairs), so windows that many documents hold join nothing
    unless they make their documents similar. Texts without windows pair with nothing.
    """
    texts = docs.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias("doc"), F.count("*").alias("copies"))
    # Filtered behind the writing: a filter on the windows before it would make them twice.
    sets = written(texts.select("doc", "copies", T.shingle_hashes(F.col(text), n).alias("s")), "shingle-sets").where(F.size("s") > 0)
    tokens = sets.select(F.col("doc").alias("item"), F.col("s").alias("tokens"))
    near = similar_pairs(tokens, written(prefix_pairs(tokens, threshold), "near-candidates"), threshold)
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("copies").alias(f"copies_{x}"))
    named = near.join(side("a"), "a").join(side("b"), "b")
    return named.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.round("similarity", 6).alias("jaccard"), "copies_a", "copies_b")


def citation_edges(docs: DataFrame, key: str, doc_id: str, text: str, serials: DataFrame, least: int = 4, around: int = 110) -> DataFrame:
    """(key, from_doc, to_doc, cited_at, context): each document and circular whose serial, of at least `least` digits, stands in it
    with no digit beside it; cited_at is the place of the first, context the text around it. serials: (circular_id, serial).

    A digit-bounded serial is a whole run of digits, so the runs are joined with the serials by equality.
    """
    found = docs.where(F.col(text).isNotNull()).select(key, F.col(doc_id).alias("from_doc"), text, F.explode(F.array_distinct(T.digit_runs(F.col(text)))).alias("serial"))
    to = serials.where(F.col("circular_id").isNotNull() & (F.length("serial") >= least) & F.col("serial").rlike("^[0-9]+$")).select(F.col("circular_id").alias("to_doc"), "serial").distinct()
    # What stands before the first whole run: the text up to it, by splitting once at the bounded serial.
    before = F.expr(f"split({text}, concat('(?<![0-9])', serial, '(?![0-9])'), 2)[0]")
    met = found.join(to, "serial").where("to_doc <> from_doc").withColumn("cited_at", F.length(before).cast("int"))
    return met.select(key, "from_doc", "to_doc", "cited_at", T.context(F.col(text), F.col("cited_at"), F.col("cited_at") + F.length("serial"), around).alias("context"))


def _family_rows(circulars: DataFrame, doc_id: str, subject: str, issued: str) -> DataFrame:
    return circulars.where(F.col(subject).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(subject).alias("subject"), F.col(issued).alias("on")).distinct()


def subject_families(circulars: DataFrame, doc_id: str, subject: str, issued: str) -> DataFrame:
    """(subject, members, newest): subjects that at least two documents share, the members' number and the newest by date,
    undated ones first, then by id. Reduced to the newest, never gathered."""
    last = F.max(F.struct(F.coalesce(F.col("on"), F.lit("0001-01-01").cast("date")).alias("on"), "doc"))
    rows = _family_rows(circulars, doc_id, subject, issued)
    return rows.groupBy("subject").agg(F.count("*").alias("members"), last.alias("last")).where("members > 1").select("subject", "members", F.col("last.doc").alias("newest"))


def family_members(circulars: DataFrame, doc_id: str, subject: str, issued: str) -> DataFrame:
    """(subject, member_no, doc, on): the members of subject_families(), numbered in the order of their date, undated ones first, then
    of their id. Rows are numbered by ranges, so a subject may hold any share of them."""
    rows = _family_rows(circulars, doc_id, subject, issued)
    rows = rows.join(rows.groupBy("subject").agg(F.count("*").alias("n")).where("n > 1").select("subject"), "subject")
    return positions(rows, ["subject"], [F.col("on").asc_nulls_first(), F.col("doc")], "member_no").select("subject", F.col("member_no").cast("int").alias("member_no"), "doc", "on")


def in_date_order(edges: DataFrame, on: str, by: list[str]) -> DataFrame:
    """edges with place: their number from 1 in the order of the date `on`, undated ones first, then of `by`, which must tell them apart."""
    return positions(edges, [], [F.col(on).asc_nulls_first(), *[F.col(c) for c in by]], "place").withColumn("place", F.col("place").cast("int"))


def locate_passages(pairs: DataFrame, text: str, passage: str) -> DataFrame:
    """pairs with span_start and span_end of `passage` in `text`: the exact place, else the first place where it stands with
    other white space, each of its white-space characters matching one or more; null where there is none."""
    at = F.expr(f"instr({text}, {passage})")
    # Each literal part between white space is quoted for the pattern.
    parts = F.split(T.strip(F.col(passage)), T.GAP)
    quoted = F.array_join(F.transform(parts, lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), T.GAP + "+")
    loose = F.when(T.strip(F.col(passage)) != "", quoted)
    out = pairs.withColumn("__at", at).withColumn("__hit", F.when((F.col("__at") == 0) & loose.isNotNull(), F.regexp_substr(F.col(text), loose)))
    start = F.when(F.col("__at") > 0, F.col("__at") - 1).when(F.col("__hit").isNotNull(), F.expr(f"instr({text}, __hit)") - 1)
    length = F.when(F.col("__at") > 0, F.length(passage)).otherwise(F.length("__hit"))
    return out.withColumn("span_start", start.cast("int")).withColumn("span_end", (start + length).cast("int")).drop("__at", "__hit")


def spans_in_chunks(spans: DataFrame, chunks: DataFrame, doc: str, low: str, high: str, cell: int = 1024) -> DataFrame:
    """spans (doc, span_start, span_end, ...) with each chunk (doc, low, high, ...) that holds the whole span.

    A range join by cells of a document: a chunk stands in each cell that it touches, a span in that of its start, so a document
    that holds a third of all rows is spread over its cells and no span meets all of its chunks."""
    at = spans.where("span_start IS NOT NULL").withColumn("__cell", F.expr(f"span_start div {cell}"))
    own = chunks.where(f"{low} <= {high}").withColumn("__cell", F.explode(F.expr(f"sequence({low} div {cell}, {high} div {cell})")))
    return at.join(own, [doc, "__cell"]).where(f"{low} <= span_start AND span_end <= {high}").drop("__cell")


def table_twins(spans: DataFrame, docs: DataFrame, key: str, text: str, least: int = 4, most_lines: int = 4) -> DataFrame:
    """(span key, key, twin_start, twin_end) for spans (span_key, key, span_start, span_end) of documents: the first window of
    one to `most_lines` whole lines, the narrowest first, outside the span and with the same value tokens, its indent left out.
    Spans of fewer than `least` tokens have no twin. Windows and spans meet by equality of key and tokens."""
    body = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__text"))
    asked = (
        spans.join(body, key)
        .withColumn("canon", T.canon_tokens(F.expr("substring(__text, span_start + 1, span_end - span_start)")))
        .where(F.size("canon") >= least)
        .select("span_key", key, "span_start", "span_end", "canon")
    )
    own = docs.join(asked.select(key).distinct(), key, "left_semi")
    all_lines = lines(own, key, text)
    order = Window.partitionBy(key).orderBy("line_no")
    windows = None
    for width in range(1, most_lines + 1):
        some = all_lines.withColumns({"w_end": F.lead("line_end", width - 1).over(order), "window": F.array_join(F.collect_list("line").over(order.rowsBetween(0, width - 1)), "\n")})
        some = some.where(F.col("w_end").isNotNull()).select(key, F.lit(width).alias("width"), F.col("line_start").alias("w_start"), "w_end", "window")
        windows = some if windows is None else windows.unionByName(some)
    windows = windows.withColumn("canon", T.canon_tokens(F.col("window"))).where(F.size("canon") >= least)
    met = windows.join(asked, [key, "canon"]).where("w_end <= span_start OR w_start >= span_end")
    first = F.min(F.struct("width", "w_start", "w_end", (F.length("window") - F.length(F.regexp_replace("window", rf"^{T.GAP}+", ""))).alias("lead")))
    return met.groupBy("span_key", key).agg(first.alias("f")).select("span_key", key, (F.col("f.w_start") + F.col("f.lead")).alias("twin_start"), F.col("f.w_end").alias("twin_end"))

