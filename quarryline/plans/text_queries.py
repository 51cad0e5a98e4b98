"""Queries over document texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import documents as D
from quarryline.sources.tables import table

G = T.GAP
SQL: dict[str, str] = {}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "circular_id")


def clean_lines(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_lines(F.col("text")).alias("cleaned"))


SQL["clean_lines"] = f"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)),
 lambda x: NOT regexp_matches(x, '{T.PAGE_LINE}') AND NOT regexp_matches(x, '{T.SHEET_LINE}') AND NOT regexp_matches(x, '^{G}*$')), lambda x: regexp_replace(x, '{G}+$', '')), chr(10)) AS cleaned FROM documents"""


def collapse_blank_lines(spark, d):
    return _docs(spark, d).select("doc_id", T.collapse_blank_lines(F.col("text")).alias("collapsed"))


SQL["collapse_blank_lines"] = f"""SELECT doc_id, regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{G}+|{G}+$', '', 'g') || chr(10) AS collapsed FROM documents"""


def doc_quality(spark, d):
    """Four flags of a text: too short, with replacement characters, with few letters, without a reference in its head."""
    t = F.col("text")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return _docs(spark, d).where(t.isNotNull()).select(
        "doc_id", (F.length(t) < 500).alias("too_short"), F.contains(t, F.lit("�")).alias("has_replacement"),
        (letters / F.greatest(F.lit(1), F.length(t)) < 0.4).alias("few_letters"), (~F.substring(t, 1, 2000).rlike("[A-Z]{2,}[/-]")).alias("no_reference"),
    )


SQL["doc_quality"] = r"""SELECT doc_id, length(text) < 500 AS too_short, contains(text, chr(65533)) AS has_replacement,
 length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(1, length(text)) < 0.4 AS few_letters, NOT regexp_matches(substr(text, 1, 2000), '[A-Z]{2,}[/-]') AS no_reference
 FROM documents WHERE text IS NOT NULL"""


def norm_text(spark, d):
    return _docs(spark, d).select("doc_id", T.norm_text(F.col("text")).alias("normal"))


SQL["norm_text"] = f"SELECT doc_id, lower(trim(regexp_replace(text, '{G}+', ' ', 'g'))) AS normal FROM documents"


def fold_text(spark, d):
    """norm_text after NFKC and with the styles of quotes, dashes and spaces folded; NFKC is not built in."""
    from quarryline.functions.unicode import fold

    return _docs(spark, d).select("doc_id", fold(F.col("text")).alias("folded"))


def doc_date(spark, d):
    return _docs(spark, d).select("doc_id", T.doc_date(F.col("text")).alias("dated"))


SQL["doc_date"] = f"""SELECT doc_id, try_strptime(regexp_extract(substr(text, 1, 800), '{T.DATE}', 1) || ' ' || regexp_extract(substr(text, 1, 800), '{T.DATE}', 2) || ' ' || regexp_extract(substr(text, 1, 800), '{T.DATE}', 3), '%B %d %Y')::DATE AS dated FROM documents"""


def doc_subject(spark, d):
    return _docs(spark, d).select("doc_id", T.doc_subject(F.col("text")).alias("subject"))


SQL["doc_subject"] = f"""WITH l AS (SELECT doc_id, string_split(substr(text, 1, 1500), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, list_filter(ls, lambda x: regexp_matches(x, '{T.SUBJECT_LABEL}{G}*[^\\s\\x{{a0}}]')) AS lab, list_position(list_transform(ls, lambda x: regexp_matches(x, '{T.ADDRESSEE}')), true) AS f FROM l),
q AS (SELECT doc_id, lab, f, list_filter(ls[f + 1:], lambda x: NOT regexp_matches(x, '^{G}*$') AND NOT regexp_matches(x, '{T.ADDRESSEE}')) AS after FROM p),
r AS (SELECT doc_id, lab, f, after, regexp_replace(after[1], '^{G}+|{G}+$', '', 'g') AS line FROM q)
SELECT doc_id, CASE WHEN len(lab) > 0 THEN lower(regexp_replace(trim(regexp_replace(regexp_replace(lab[1], '{T.SUBJECT_LABEL}', ''), '{G}+', ' ', 'g')), '\\.+$', ''))
 WHEN f > 0 AND len(after) > 0 AND length(line) <= 160 AND NOT regexp_matches(line, '{T.BODY_OPENING}') THEN lower(regexp_replace(trim(regexp_replace(line, '{G}+', ' ', 'g')), '\\.+$', '')) END AS subject FROM r"""


def doc_header(spark, d):
    return _docs(spark, d).select("doc_id", T.doc_header(F.col("text")).alias("header"), T.doc_serial(F.col("circular_id")).alias("serial"))


SQL["doc_header"] = f"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?m){T.SUBJECT_LABEL}') THEN regexp_extract(text, '(?s)^(.*?)(?m:{T.SUBJECT_LABEL})', 1) ELSE substr(text, 1, 600) END AS header,
 regexp_replace(circular_id, '^.*-', '') AS serial FROM documents"""


def shingles(spark, d):
    """The number of distinct five-word windows of each text, and the least of them."""
    s = T.shingles(F.col("text"))
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.size(s).alias("n"), F.array_min(s).alias("least"))


SQL["shingles"] = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [] END AS s FROM w)
SELECT doc_id, len(s) AS n, list_min(s) AS least FROM s"""


def own_serial(spark, d):
    return _docs(spark, d).select("doc_id", T.own_serial(F.col("circular_id"), F.col("text")).alias("serial"))


SQL["own_serial"] = """SELECT doc_id, CASE WHEN list_contains(regexp_extract_all(substr(text, 1, 3000), '[0-9]+'), regexp_replace(circular_id, '^.*-', '')) THEN regexp_replace(circular_id, '^.*-', '') END AS serial FROM documents"""


def exact_id_query(spark, d):
    """Each gold query as an exact-id question about the circular of its first span; null where no document of the circular names its
    own serial."""
    g = table(spark, d, "designed_slice_final").where("size(gold_spans) > 0").select("query_id", "query_text", F.col("gold_spans")[0]["doc_id"].alias("doc")).distinct()
    own = _docs(spark, d).select(F.col("circular_id").alias("doc"), T.own_serial(F.col("circular_id"), F.col("text")).alias("serial"))
    named = own.where("doc IS NOT NULL AND serial IS NOT NULL").distinct()
    return g.join(named, "doc", "left").select("query_id", T.exact_id_question(F.col("doc"), F.col("serial"), F.col("query_text")).alias("question"))


SQL["exact_id_query"] = f"""WITH n AS (SELECT DISTINCT circular_id AS doc FROM documents WHERE list_contains(regexp_extract_all(substr(text, 1, 3000), '[0-9]+'), regexp_replace(circular_id, '^.*-', '')))
SELECT DISTINCT query_id, CASE WHEN n.doc IS NOT NULL THEN regexp_replace(gold_spans[1].doc_id, '-.*$', '') || ' circular ' || regexp_replace(gold_spans[1].doc_id, '^.*-', '') || ' ' ||
 regexp_replace(regexp_replace(query_text, '{T.QUESTION_OPENING}', ''), '\\?+$', '') END AS question FROM designed_slice_final LEFT JOIN n ON n.doc = gold_spans[1].doc_id WHERE len(gold_spans) > 0"""


def strip_fences(spark, d):
    """A fenced JSON answer parsed: the answers of the api put into a fence and read back."""
    a = table(spark, d, "api").select("citation_id", "answered").distinct()
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct("answered")), F.lit("\n```"))
    return a.select("citation_id", F.from_json(T.strip_fences(raw), "answered boolean")["answered"].alias("answered"))


SQL["strip_fences"] = "SELECT DISTINCT citation_id, answered FROM api"


def canon_tokens(spark, d):
    return D.lines(_docs(spark, d), "doc_id", "text").select("doc_id", "line_no", T.canon_tokens(F.col("line")).alias("tokens"))


SQL["canon_tokens"] = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, regexp_replace(line, '^{G}+|{G}+$', '', 'g') AS st FROM l)
SELECT doc_id, line_no::INTEGER AS line_no, list_transform(regexp_extract_all(CASE WHEN contains(line, ';') AND regexp_matches(st, '{T.LABELLED}')
 THEN array_to_string(list_transform(string_split(st, ';'), lambda c: regexp_replace(c, '^(?s:.*?): ', '')), ' ') ELSE line END, '{T.TOKEN}'), lambda t: lower(t)) AS tokens FROM s"""


def lines_with_offsets(spark, d):
    return D.lines(_docs(spark, d), "doc_id", "text").select("doc_id", "line_no", "line_start", "line_end")


SQL["lines_with_offsets"] = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, line_no, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
SELECT doc_id, line_no::INTEGER AS line_no, s::INTEGER AS line_start, (s + n)::INTEGER AS line_end FROM o"""


def table_rows_labelled(spark, d):
    """Rows of nation and region as labelled table rows."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, n.n_regionkey == r.r_regionkey)
    row = T.table_row_labelled([F.lit("nation"), F.lit("region"), F.lit("note")], [F.col("n_name"), F.col("r_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("even"))])
    return both.select("n_nationkey", row.alias("labelled"))


SQL["table_rows_labelled"] = """SELECT n_nationkey, '  nation: ' || n_name || '; region: ' || r_name || CASE WHEN n_nationkey % 2 = 0 THEN '; note: even' ELSE '' END AS labelled FROM nation JOIN region ON n_regionkey = r_regionkey"""


def _span_passages(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, span_no, id, content, cs, passage): each gold span in each chunk that holds the whole of it, with its text there. The passages
    that the queries bring are of another build and stand in no chunk."""
    gold = table(spark, d, "designed_slice_final").select("query_id", F.posexplode("gold_spans").alias("span_no", "s")).select("query_id", "span_no", "s.*").distinct()
    chunks = table(spark, d, "retrieve").where("content IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("char_start").alias("cs"), F.min("content").alias("content"))
    here = D.spans_in_chunks(gold.where("span_start < span_end"), chunks.withColumn("ce", F.col("cs") + F.length("content")), "doc_id", "cs", "ce")
    return here.withColumn("passage", F.expr("substring(content, span_start - cs + 1, span_end - span_start)")).drop("span_start", "span_end", "doc_id", "ce")


def locate_passage(spark, d):
    """Where the text of each gold span stands first in each chunk that holds it."""
    return D.locate_passages(_span_passages(spark, d), "content", "passage").select("query_id", "span_no", "id", "span_start", "span_end")


_SPAN_TEXTS = """WITH g AS (SELECT DISTINCT query_id, (i - 1)::INTEGER AS span_no, gold_spans[i] AS s FROM (SELECT *, unnest(range(1, len(gold_spans) + 1)) AS i FROM designed_slice_final)),
c AS (SELECT id, min(doc_id) AS doc_id, min(char_start) AS cs, min(content) AS content FROM retrieve WHERE content IS NOT NULL GROUP BY id),
h AS (SELECT query_id, span_no, id, cs, content, substr(content, s.span_start - cs + 1, s.span_end - s.span_start) AS passage FROM g JOIN c ON c.doc_id = s.doc_id AND cs <= s.span_start AND s.span_end <= cs + length(content) AND s.span_start < s.span_end AND s.span_start >= 0)
"""
SQL["locate_passage"] = _SPAN_TEXTS + "SELECT query_id, span_no, id, (instr(content, passage) - 1)::INTEGER AS span_start, (instr(content, passage) - 1 + length(passage))::INTEGER AS span_end FROM h"


def locate_reflowed(spark, d):
    """The same with the passages' white space written as single spaces: found across line ends as well."""
    rows = _span_passages(spark, d).withColumn("passage", T.collapse(F.col("passage")))
    return D.locate_passages(rows, "content", "passage").select("query_id", "span_no", "id", "span_start", "span_end")


def citation_quotes(spark, d):
    """The place of each quote, as an earlier build of the chunks had it, in the content of the chunk that it cites, white space aside."""
    quotes = table(spark, d, "api").where("trim(source_quote) <> ''").select("citation_id", "chunk_id", F.col("source_quote").alias("quote")).distinct()
    chunks = table(spark, d, "retrieve").where("content IS NOT NULL").groupBy(F.col("id").alias("chunk_id")).agg(F.min("content").alias("content"))
    return D.locate_passages(quotes.join(chunks, "chunk_id"), "content", "quote").select("citation_id", "span_start", "span_end")


def header_spans(spark, d):
    """Gold spans that begin within the first 250 code points of their document are header text and left out."""
    g = table(spark, d, "designed_slice_final").select("query_id", F.explode("gold_spans").alias("s")).distinct()
    return g.where("s.span_start >= 250").select("query_id", "s.doc_id", "s.span_start", "s.span_end")


SQL["header_spans"] = "SELECT DISTINCT query_id, s.doc_id AS doc_id, s.span_start AS span_start, s.span_end AS span_end FROM (SELECT query_id, unnest(gold_spans) AS s FROM designed_slice_final) WHERE s.span_start >= 250"


def question_types(spark, d):
    """Of each document's questions all but the last are natural, the last a keyword question, and the first exact-id as well.
    The ends of a document's questions are reduced and joined back: no document's questions are gathered."""
    g = table(spark, d, "designed_slice_final").where("size(gold_spans) > 0").select("query_id", F.col("gold_spans")[0]["doc_id"].alias("doc_id")).distinct()
    ends = g.groupBy("doc_id").agg(F.min("query_id").alias("first"), F.max("query_id").alias("last"))
    kinds = F.array_compact(F.array(F.when(F.col("query_id") == F.col("last"), "keyword").otherwise("natural"), F.when(F.col("query_id") == F.col("first"), "exact_id")))
    return g.join(ends, "doc_id").select("query_id", "doc_id", F.explode(kinds).alias("kind"))


SQL["question_types"] = """WITH g AS (SELECT DISTINCT query_id, gold_spans[1].doc_id AS doc_id FROM designed_slice_final WHERE len(gold_spans) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_id) AS a, count(*) OVER (PARTITION BY doc_id) AS n FROM g)
SELECT query_id, doc_id, CASE WHEN a = n THEN 'keyword' ELSE 'natural' END AS kind FROM r UNION ALL SELECT query_id, doc_id, 'exact_id' FROM r WHERE a = 1"""


def context_window(spark, d):
    """Each gold span with 110 and with 300 code points on either side in each chunk that holds it, white space collapsed."""
    rows = D.locate_passages(_span_passages(spark, d), "content", "passage")
    around = lambda n: T.context(F.col("content"), F.col("span_start"), F.col("span_end"), n)
    return rows.select("query_id", "span_no", "id", around(110).alias("near"), around(300).alias("wide"))


def _around(n: int) -> str:
    at, end = "(instr(content, passage) - 1)", "(instr(content, passage) - 1 + length(passage))"
    return f"regexp_replace(substr(content, greatest(0, {at} - {n}) + 1, {end} + {n} - greatest(0, {at} - {n})), '{G}+', ' ', 'g')"


SQL["context_window"] = _SPAN_TEXTS + f"SELECT query_id, span_no, id, {_around(110)} AS near, {_around(300)} AS wide FROM h"


def prompt_context(spark, d):
    """The first five chunks of each query's hybrid list as they are laid before a model."""
    from quarryline.operators.runs import ranked

    top = ranked(table(spark, d, "retrieve").where("mode = 'hybrid'"), 5, keep=["content"])
    block = F.concat(F.lit("[chunk_"), F.col("rank").cast("string"), F.lit("] (circular "), F.col("doc_id"), F.lit(")\n"), F.col("content"))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


SQL["prompt_context"] = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY config, mode, query_id, rank_no, id ORDER BY loaded_at DESC) AS rn FROM retrieve WHERE mode = 'hybrid'),
r AS (SELECT *, row_number() OVER (PARTITION BY config, mode, query_id ORDER BY rank_no, id) AS rank FROM l WHERE rn = 1)
SELECT query_id, string_agg('[chunk_' || rank || '] (circular ' || doc_id || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY query_id"""

QUERIES = [
    clean_lines, collapse_blank_lines, doc_quality, norm_text, fold_text, doc_date, doc_subject, doc_header, shingles, own_serial, exact_id_query, strip_fences,
    canon_tokens, lines_with_offsets, table_rows_labelled, locate_passage, locate_reflowed, citation_quotes, header_spans, question_types, context_window, prompt_context,
]
