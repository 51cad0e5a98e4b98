"""Retrieval evaluation queries, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import GAP, ntok
from quarryline.operators import answering, chunking, experiment, search
from quarryline.operators import metrics as M
from quarryline.operators.answering import TOP
from quarryline.operators.answers import REFUSALS
from quarryline.operators.runs import ranked
from quarryline.shared import written
from quarryline.sources.tables import table

SQL: dict[str, str] = {}
K, BUDGETS = 5, (1280, 2560)

_RANKED = """WITH l AS (SELECT * REPLACE (coalesce(char_end, char_start + length(content)) AS char_end, CASE WHEN content IS NULL THEN coalesce(token_count, 0) ELSE greatest(1, round_even(length(content) / 4, 0)::INTEGER) END AS token_count),
 row_number() OVER (PARTITION BY config, mode, query_id, rank_no, id ORDER BY loaded_at DESC) AS rn FROM retrieve),
r0 AS (SELECT *, row_number() OVER (PARTITION BY config, mode, query_id ORDER BY rank_no, id) AS rank FROM l WHERE rn = 1),
r AS (SELECT * FROM r0 WHERE rank <= 20)"""
_OUT = (
    _RANKED
    + """,
g AS (SELECT DISTINCT query_id, query_type, coalesce(require, 'all') AS require, coalesce(gold_spans, []) AS spans FROM designed_slice_final WHERE verified),
s AS (SELECT query_id, unnest(spans) AS s, generate_subscripts(spans, 1) AS span_no FROM g),
ov AS (SELECT r.config, r.mode, r.query_id, span_no, s.span_start AS a, s.span_end AS b, rank, greatest(char_start, s.span_start) AS lo, least(char_end, s.span_end) AS hi
       FROM r JOIN s ON r.query_id = s.query_id AND r.doc_id = s.s.doc_id WHERE least(char_end, s.span_end) > greatest(char_start, s.span_start)),
pos AS (SELECT config, mode, query_id, span_no, a, b, p, min(rank) AS rank FROM (SELECT *, unnest(range(lo, hi)) AS p FROM ov) GROUP BY ALL),
cum AS (SELECT config, mode, query_id, span_no, a, b, rank, sum(count(*)) OVER (PARTITION BY config, mode, query_id, span_no ORDER BY rank) AS c FROM pos GROUP BY config, mode, query_id, span_no, a, b, rank),
sr AS (SELECT config, mode, query_id, span_no, min(rank) AS ar FROM cum WHERE c / greatest(1, b - a) >= 0.8::DOUBLE GROUP BY ALL),
q AS (SELECT config, mode, query_id, count(*) AS met, max(ar) AS last, min(ar) AS first FROM sr GROUP BY ALL),
o1 AS (SELECT n.config, n.mode, n.query_id, g.query_type, n.results::INTEGER AS results,
         (CASE WHEN require = 'any' THEN first WHEN len(spans) = 0 THEN 1 WHEN met = len(spans) THEN last END)::INTEGER AS rank
       FROM (SELECT config, mode, query_id, count(*) AS results FROM r GROUP BY ALL) n JOIN g USING (query_id) LEFT JOIN q ON q.config = n.config AND q.mode = n.mode AND q.query_id = n.query_id),
o AS (SELECT o1.*, CASE WHEN o1.rank IS NOT NULL THEN (SELECT sum(token_count) FROM r WHERE r.config = o1.config AND r.mode = o1.mode AND r.query_id = o1.query_id AND r.rank <= o1.rank) END::BIGINT AS budget FROM o1)
"""
)


def _lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieve")
    return ranked(rows)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return M.outcomes(_lists(spark, d), M.gold(table(spark, d, "designed_slice_final")))


def load_runs(spark, d):
    """Runs as lists: each result's position in its list, delivered-again rows once."""
    return _lists(spark, d).select("config", "mode", "query_id", "rank", "id")


SQL["load_runs"] = _RANKED + "SELECT config, mode, query_id, rank, id FROM r"


def load_gold(spark, d):
    g = M.gold(table(spark, d, "designed_slice_final"))
    return g.select("query_id", "query_type", "require", F.size("spans").alias("n_spans"))


SQL["load_gold"] = "SELECT query_id, query_type, coalesce(require, 'all') AS require, coalesce(len(gold_spans), 0) AS n_spans FROM (SELECT DISTINCT query_id, query_type, require, gold_spans FROM designed_slice_final WHERE verified)"


def satisfied_at_rank(spark, d):
    return _outcomes(spark, d).select("config", "mode", "query_id", "rank")


SQL["satisfied_at_rank"] = _OUT + "SELECT config, mode, query_id, rank FROM o"


def satisfied_at_budget(spark, d):
    return _outcomes(spark, d).select("config", "mode", "query_id", "budget")


SQL["satisfied_at_budget"] = _OUT + "SELECT config, mode, query_id, budget FROM o"


def recall_at_k(spark, d):
    return M.recall(_outcomes(spark, d), ["config", "mode"], K)


SQL["recall_at_k"] = _OUT + f"SELECT config, mode, count(*) FILTER (rank <= {K}) AS hits, count(*) AS n, round(count(*) FILTER (rank <= {K}) / count(*), 6) AS recall FROM o GROUP BY ALL"


def recall_at_budget(spark, d):
    out = _outcomes(spark, d)
    both = F.explode(F.array(*[F.lit(b) for b in BUDGETS])).alias("limit")
    met = out.select("config", "mode", "budget", both).withColumn("met", F.coalesce(F.col("budget") <= F.col("limit"), F.lit(False)))
    return met.groupBy("config", "mode", "limit").agg(F.count_if("met").alias("hits"), F.count("*").alias("n"))


SQL["recall_at_budget"] = _OUT + "SELECT config, mode, \"limit\", count(*) FILTER (budget <= \"limit\") AS hits, count(*) AS n FROM o, (VALUES (1280), (2560)) v(\"limit\") GROUP BY ALL"


def recall_by_subgroup(spark, d):
    return M.recall(_outcomes(spark, d), ["config", "mode", "query_type"], K)


SQL["recall_by_subgroup"] = _OUT + f"SELECT config, mode, query_type, count(*) FILTER (rank <= {K}) AS hits, count(*) AS n, round(count(*) FILTER (rank <= {K}) / count(*), 6) AS recall FROM o GROUP BY ALL"

TYPES = ["exact_id", "keyword", "multi_hop", "natural", "supersession"]


def subgroup_pivot(spark, d):
    """Recall of each mode by query type; a type that a mode has no query of is null."""
    return _outcomes(spark, d).groupBy("mode").pivot("query_type", TYPES).agg(F.round(F.count_if(M.hit(K)) / F.count(F.lit(1)), 6))


SQL["subgroup_pivot"] = _OUT + "SELECT mode, " + ", ".join(f"round(count(*) FILTER (rank <= {K} AND query_type = '{t}') / nullif(count(*) FILTER (query_type = '{t}'), 0), 6) AS {t}" for t in TYPES) + " FROM o GROUP BY mode"


HEADLINE = "512-recursive"
PAIRS = [((HEADLINE, a), (HEADLINE, b)) for a, b in (("bm25", "hybrid"), ("dense", "hybrid"), ("hybrid", "hybrid+rerank"))] + [
    ((a, "hybrid+rerank"), (b, "hybrid+rerank")) for a, b in (("256-fixed", "512-fixed"), ("512-fixed", "512-recursive"))
]


def mcnemar(spark, d):
    """Five pairs: three of modes in one configuration, two of configurations in one mode. In these data a query has one configuration,
    so the last two have no query in common; mcnemar_modes has pairs of modes over all configurations."""
    return M.mcnemar(_outcomes(spark, d), ["config", "mode"], PAIRS, K)


MODE_PAIRS = [("bm25", "hybrid"), ("dense", "hybrid"), ("hybrid", "hybrid+rerank"), ("bm25", "dense")]


def mcnemar_modes(spark, d):
    return M.mcnemar(_outcomes(spark, d), "mode", MODE_PAIRS, K)


def _mcnemar_sql(side: str, pairs: list[tuple[str, str]]) -> str:
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return _OUT + f""", h AS (SELECT {side} AS side, query_id, coalesce(rank <= 5, false) AS hit FROM o), v(a, b) AS (VALUES {values}),
c AS (SELECT v.a, v.b, count(*) FILTER (x.hit AND y.hit) AS both, count(*) FILTER (x.hit AND NOT y.hit) AS a_only, count(*) FILTER (NOT x.hit AND y.hit) AS b_only, count(*) FILTER (NOT x.hit AND NOT y.hit) AS neither
 FROM v LEFT JOIN h x ON x.side = v.a LEFT JOIN h y ON y.side = v.b AND y.query_id = x.query_id GROUP BY ALL)
SELECT *, round(least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))), 6) AS p FROM c"""


SQL["mcnemar"] = _mcnemar_sql("config || ' / ' || mode", [(" / ".join(a), " / ".join(b)) for a, b in PAIRS])
SQL["mcnemar_modes"] = _mcnemar_sql("mode", MODE_PAIRS)


def bootstrap_ci(spark, d):
    counts = M.recall(_outcomes(spark, d), ["config", "mode"], K)
    return M.bootstrap_interval(counts, ["config", "mode"])


def missed_by_all(spark, d):
    """The first 25 gold queries that no list satisfies within its results: a report's length."""
    best = _outcomes(spark, d).groupBy("query_id", "query_type").agg(F.max(F.col("rank").isNotNull()).alias("met"))
    return best.where("NOT met").select("query_id", "query_type").orderBy("query_id").limit(25)


SQL["missed_by_all"] = _OUT + "SELECT query_id, query_type FROM o GROUP BY ALL HAVING count(rank) = 0 ORDER BY query_id LIMIT 25"


def ablation_table(spark, d):
    """Recall at 5 and 20 of each configuration and mode over the same number of queries."""
    share = lambda k: F.round(F.count_if(M.hit(k)) / F.count("*"), 6)
    return _outcomes(spark, d).groupBy("config", "mode").agg(F.count("*").alias("n"), share(5).alias("recall_5"), share(20).alias("recall_20"))


SQL["ablation_table"] = _OUT + "SELECT config, mode, count(*) AS n, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (rank <= 20) / count(*), 6) AS recall_20 FROM o GROUP BY ALL"


def ablation_report(spark, d):
    """The report's sections as rows (section, row, column, value, low, high): recall at 5, with its interval, and at 20; by query type in
    the headline configuration; at token budgets; the paired tests' p."""
    out = written(_outcomes(spark, d), "outcomes")
    named = lambda df, section, row, column, value, low="NULL", high="NULL": df.selectExpr(f"'{section}' AS section", f"{row} AS row", f"{column} AS column", f"CAST({value} AS DOUBLE) AS value", f"CAST({low} AS DOUBLE) AS low", f"CAST({high} AS DOUBLE) AS high")
    at5 = M.bootstrap_interval(M.recall(out, ["config", "mode"], 5), ["config", "mode"])
    both = "concat(config, ' / ', mode)"
    parts = [named(at5, "recall", both, "'5'", "round(hits / n, 6)", "low", "high"), named(M.recall(out, ["config", "mode"], 20), "recall", both, "'20'", "recall")]
    parts.append(named(M.recall(out.where(F.col("config") == HEADLINE), ["mode", "query_type"], K), "by type", "mode", "query_type", "recall"))
    for budget in BUDGETS:
        parts.append(named(M.recall(out.where("mode = 'hybrid+rerank'"), ["config"], budget, "budget"), "budget", "config", f"'{budget}'", "recall"))
    tests = M.mcnemar(out, ["config", "mode"], PAIRS, K)
    parts += [named(tests, "paired", "concat(a, ' : ', b)", f"'{c}'", c) for c in ("a_only", "b_only", "p")]
    return reduce(DataFrame.unionByName, parts)


def produce_runs(spark, d):
    """Runs of every gold question whose id is divisible by 20 against the chunks of all documents: three configurations, four modes."""
    q = table(spark, d, "designed_slice_final").where("query_id % 20 = 0").select("query_id", "query_text").distinct()
    chunks = chunking.build(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return experiment.produce(q, "query_id", "query_text", chunks, [c for c, *_ in chunking.CONFIGS]).drop("search_score")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Verified questions answered from their hybrid lists by a scripted answerer, which by the question's type makes no call, gives what is
    no JSON, finds the context too small, quotes one chunk rightly and one that isn't there, or quotes the first chunk in a code fence."""
    q = table(spark, d, "designed_slice_final").where("verified AND query_id IS NOT NULL").select("query_id", "query_text", "query_type").distinct()
    lists = ranked(table(spark, d, "retrieve").where("mode = 'hybrid'"), TOP, keep=["content"])

    def scripted(_question, chunks):
        first = F.get(chunks, F.lit(0))["content"]
        cite = lambda label, text: F.struct(F.lit(label).alias("chunk_id"), text.alias("source_quote"))
        call = lambda *cites: F.to_json(F.struct(F.lit(True).alias("sufficient_context"), F.lit("As quoted.").alias("answer"), F.array(*cites).alias("citations")))
        kind = F.col("query_type")
        return (
            F.when(kind == "exact_id", F.lit(None).cast("string")).when(kind == "keyword", "It is as follows").when(kind == "multi_hop", '{"sufficient_context": false, "answer": ""}')
            .when(kind == "supersession", call(cite("chunk_1", F.substring(first, 1, 80)), cite("chunk_9", F.lit("gone"))))
            .otherwise(F.concat(F.lit("```json\n"), call(cite("chunk_1", F.substring(first, 11, 80))), F.lit("\n```")))
        )

    return answering.ask(q, lists, scripted, question="query_text")


def answer_path(spark, d):
    place = lambda c: F.get("citations", F.lit(0))[c]
    return _answers(spark, d).select(
        "query_id", "answered", "answer", "refusal_reason", F.size("citations").alias("good"), F.size("bad_citations").alias("bad"),
        place("char_start").alias("quote_start"), place("char_end").alias("quote_end"), F.array_join("retrieved", ",").alias("retrieved"),
    )


_ANSWERS = _RANKED + f""", a0 AS (SELECT q.query_id, query_type, count(r.id) AS chunks, string_agg(doc_id, ',' ORDER BY rank) AS retrieved, any_value(content ORDER BY rank) FILTER (rank = 1) AS content, min(char_start) FILTER (rank = 1) AS cs, min(char_end) FILTER (rank = 1) AS ce
 FROM (SELECT DISTINCT query_id, query_text, query_type FROM designed_slice_final WHERE verified AND length(query_text) BETWEEN 3 AND 500) q LEFT JOIN (SELECT * FROM r WHERE mode = 'hybrid' AND rank <= 5) r ON r.query_id = q.query_id GROUP BY ALL),
a1 AS (SELECT *, CASE WHEN query_type = 'supersession' THEN substr(content, 1, 80) ELSE substr(content, 11, 80) END AS quote FROM a0),
a2 AS (SELECT *, CASE WHEN chunks > 0 AND query_type NOT IN ('exact_id', 'keyword', 'multi_hop') THEN 1 ELSE 0 END AS calls, trim(regexp_replace(quote, '{GAP}+', ' ', 'g')) <> '' AS holds FROM a1),
a3 AS (SELECT *, (calls * (holds IS TRUE)::INTEGER)::INTEGER AS good, (calls * ((holds IS NOT TRUE)::INTEGER + (query_type = 'supersession')::INTEGER))::INTEGER AS bad FROM a2),
a4 AS (SELECT *, CASE WHEN chunks = 0 THEN '{REFUSALS[0]}' WHEN query_type = 'exact_id' THEN '{REFUSALS[1]}' WHEN query_type = 'keyword' THEN '{REFUSALS[2]}' WHEN query_type = 'multi_hop' THEN '{REFUSALS[3]}' WHEN good = 0 THEN '{REFUSALS[4]}' WHEN bad > 0 THEN '{REFUSALS[5]}' END AS reason FROM a3)
"""
SQL["answer_path"] = _ANSWERS + """SELECT query_id, reason IS NULL AS answered, CASE WHEN reason IS NULL THEN 'As quoted.' ELSE '' END AS answer, reason AS refusal_reason, good, bad,
 CASE WHEN good > 0 THEN cs + instr(content, quote) - 1 END::INTEGER AS quote_start, CASE WHEN good > 0 THEN cs + instr(content, quote) - 1 + length(quote) END::INTEGER AS quote_end, coalesce(retrieved, '') AS retrieved FROM a4"""


def answer_outcomes(spark, d):
    """Answers beside whether retrieval satisfied their question at 5: the four cells; a question without an outcome counts as missed."""
    found = _outcomes(spark, d).where("mode = 'hybrid'").select("query_id", M.hit(K).alias("hit"))
    both = _answers(spark, d).join(found, "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return both.groupBy("hit", "answered").agg(F.count("*").alias("n"))


SQL["answer_outcomes"] = _OUT + ", " + _ANSWERS.removeprefix(_RANKED).lstrip(", ") + "SELECT coalesce(o.rank <= 5, false) AS hit, reason IS NULL AS answered, count(*) AS n FROM a4 LEFT JOIN (SELECT * FROM o WHERE mode = 'hybrid') o USING (query_id) GROUP BY ALL"


def judge_verdicts(spark, d):
    """The answers by the verdict of a scripted judge: grounded for natural questions, no JSON for others."""
    judge = lambda q, a: F.when(F.col("query_type") == "natural", '{"grounded": true}').otherwise("I can't say")
    out = answering.judged(_answers(spark, d), judge, "query_text")
    return out.groupBy("query_type", F.col("verdict.grounded").alias("grounded")).agg(F.count("*").alias("n"))


SQL["judge_verdicts"] = _ANSWERS + "SELECT query_type, CASE WHEN reason IS NULL AND query_type = 'natural' THEN true END AS grounded, count(*) AS n FROM a4 GROUP BY ALL"


def worked_examples(spark, d):
    """One question for every outcome."""
    return answering.examples(_answers(spark, d))


SQL["worked_examples"] = _ANSWERS + "SELECT coalesce(reason, 'answered') AS outcome, min(query_id) AS query_id FROM a4 GROUP BY ALL"


def demo(spark, d):
    """The first three results of each mode for the first question of each configuration: a look at the lists."""
    lists = _lists(spark, d)
    first = lists.groupBy("config").agg(F.min("query_id").alias("query_id"))
    return lists.join(first, ["config", "query_id"]).where("rank <= 3").select("config", "mode", "query_id", "rank", "id", "doc_id")


SQL["demo"] = _RANKED + "SELECT config, mode, query_id, rank, id, doc_id FROM r SEMI JOIN (SELECT config, min(query_id) AS query_id FROM r GROUP BY config) f USING (config, query_id) WHERE rank <= 3"


def hybrid_rrf(spark, d):
    """The keyword and the vector list of each query fused."""
    lists = _lists(spark, d).where("mode IN ('bm25', 'dense')")
    return search.fuse(lists, ["config", "query_id"], "id", "rank", 20)


SQL["hybrid_rrf"] = _RANKED + """, f AS (SELECT config, query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r WHERE mode IN ('bm25', 'dense') GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, id) AS rank FROM f) SELECT config, query_id, id, score, rank FROM n WHERE rank <= 20"""


def rerank(spark, d):
    return search.rerank(_lists(spark, d).where("mode = 'hybrid+rerank'"), ["config", "query_id"], "rerank_score", "rank").select("config", "query_id", "id", "rank", "new_rank")


SQL["rerank"] = _RANKED + "SELECT config, query_id, id, rank, row_number() OVER (PARTITION BY config, query_id ORDER BY rerank_score DESC NULLS LAST, rank) AS new_rank FROM r WHERE mode = 'hybrid+rerank'"


def rerank_compare(spark, d):
    """The reranked lists against the order that they came in: recall before and after, gained and lost queries, p."""
    g = M.gold(table(spark, d, "designed_slice_final"))
    lists = _lists(spark, d).where("mode = 'hybrid+rerank'")
    after = search.rerank(lists, ["config", "query_id"], "rerank_score", "rank").withColumns({"rank": F.col("new_rank"), "mode": F.lit("after")}).drop("new_rank")
    out = M.outcomes(lists.withColumn("mode", F.lit("before")).unionByName(after), g)
    four = M.mcnemar(out, "mode", [("before", "after")], K)
    n = F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")
    return four.select(F.round((F.col("both") + F.col("a_only")) / n, 6).alias("recall_before"), F.round((F.col("both") + F.col("b_only")) / n, 6).alias("recall_after"), F.col("a_only").alias("lost"), F.col("b_only").alias("gained"), "p")


SQL["rerank_compare"] = (
    _OUT.replace("r0 AS (", "r00 AS (").replace("r AS (SELECT * FROM r0 WHERE rank <= 20)", """r1 AS (SELECT * FROM r00 WHERE rank <= 20 AND mode = 'hybrid+rerank'),
r AS (SELECT * REPLACE ('before' AS mode) FROM r1 UNION ALL SELECT * REPLACE ('after' AS mode, row_number() OVER (PARTITION BY config, query_id ORDER BY rerank_score DESC NULLS LAST, rank) AS rank) FROM r1)""")
    + """, w AS (SELECT query_id, bool_or(rank <= 5) FILTER (mode = 'before') IS TRUE AS x, bool_or(rank <= 5) FILTER (mode = 'after') IS TRUE AS y FROM o GROUP BY query_id),
c AS (SELECT count(*) AS n, count(*) FILTER (x) AS nx, count(*) FILTER (y) AS ny, count(*) FILTER (x AND NOT y) AS lost, count(*) FILTER (y AND NOT x) AS gained FROM w)
SELECT round(nx / n, 6) AS recall_before, round(ny / n, 6) AS recall_after, lost, gained, round(least(1.0, 2 * list_sum(list_transform(range(0, least(lost, gained) + 1), lambda i: exp(lgamma(lost + gained + 1) - lgamma(i + 1) - lgamma(lost + gained - i + 1) - (lost + gained) * ln(2))))), 6) AS p FROM c"""
)


def rerank_by_type(spark, d):
    """Recall of the reranked lists before and after, by query type."""
    g = M.gold(table(spark, d, "designed_slice_final"))
    lists = _lists(spark, d).where("mode = 'hybrid+rerank'")
    after = search.rerank(lists, ["config", "query_id"], "rerank_score", "rank").withColumns({"rank": F.col("new_rank"), "mode": F.lit("after")}).drop("new_rank")
    out = M.outcomes(lists.withColumn("mode", F.lit("before")).unionByName(after), g)
    share = lambda side: F.round(F.coalesce(F.count_if((F.col("mode") == side) & M.hit(K)) / F.nullif(F.count_if(F.col("mode") == side), F.lit(0)), F.lit(0.0)), 6)
    return out.groupBy("query_type").agg(F.count_if(F.col("mode") == "before").alias("n"), share("before").alias("before"), share("after").alias("after"))


SQL["rerank_by_type"] = SQL["rerank_compare"].split(", w AS (")[0] + "SELECT query_type, count(*) FILTER (mode = 'before') AS n, round(coalesce(count(*) FILTER (mode = 'before' AND rank <= 5) / nullif(count(*) FILTER (mode = 'before'), 0), 0), 6) AS before, round(coalesce(count(*) FILTER (mode = 'after' AND rank <= 5) / nullif(count(*) FILTER (mode = 'after'), 0), 0), 6) AS after FROM o GROUP BY query_type"


def _pair_lengths(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "designed_slice_final").where("verified").select("query_id", "query_text").distinct()
    lists = ranked(table(spark, d, "retrieve").where("mode = 'hybrid+rerank' AND content IS NOT NULL"), keep=["content"])
    return lists.join(q, "query_id").select("query_id", "rank", (ntok(F.col("query_text")) + ntok(F.col("content"))).alias("n"))


def truncation_histogram(spark, d):
    """Questions by the number of their first five pairs that exceed the limit."""
    own = _pair_lengths(spark, d).groupBy("query_id").agg(F.count_if((F.col("n") > 512) & (F.col("rank") <= K)).alias("truncated"))
    return own.groupBy("truncated").agg(F.count("*").alias("queries"))


def truncation_stats(spark, d):
    """Lengths of question and chunk together, in tokens of four characters, against a reranker's limit of 512: how many pairs exceed it, their
    share in per cent, and the median and the greatest number of tokens that they lose."""
    pairs = written(_pair_lengths(spark, d), "pairs")
    sums = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("n") > 512).alias("over"), F.max("n").alias("longest"), F.countDistinct(F.when((F.col("n") > 512) & (F.col("rank") <= K), F.col("query_id"))).alias("queries"))
    points = M.floor_quantiles(pairs.withColumn("all", F.lit(1)), ["all"], "n", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).select("p50", "p90", "p99")
    lost = M.floor_quantiles(pairs.where("n > 512").select(F.lit(1).alias("all"), (F.col("n") - 512).alias("lost")), ["all"], "lost", {"lost_median": 0.5, "lost_worst": 1.0}).select("lost_median", "lost_worst")
    reading = F.when(100 * F.col("over") / F.col("pairs") < 2, "none").when(100 * F.col("over") / F.col("pairs") < 15, "partial").otherwise("mechanical")
    # One row each; where no pair exceeds the limit, nothing is lost.
    both = sums.crossJoin(points).join(lost, F.lit(True), "left")
    return both.withColumns({"share": F.round(100 * F.col("over") / F.col("pairs"), 6), "reading": reading})


SQL["truncation_histogram"] = _RANKED + """, q AS (SELECT DISTINCT query_id, query_text FROM designed_slice_final WHERE verified),
p AS (SELECT query_id, rank, greatest(1, round_even(length(query_text) / 4, 0)::INT) + greatest(1, round_even(length(content) / 4, 0)::INT) AS n FROM r JOIN q USING (query_id) WHERE mode = 'hybrid+rerank' AND content IS NOT NULL)
SELECT truncated, count(*) AS queries FROM (SELECT query_id, count(*) FILTER (n > 512 AND rank <= 5) AS truncated FROM p GROUP BY query_id) GROUP BY truncated"""
SQL["truncation_stats"] = _RANKED + """, q AS (SELECT DISTINCT query_id, query_text FROM designed_slice_final WHERE verified),
p AS (SELECT query_id, rank, greatest(1, round_even(length(query_text) / 4, 0)::INT) + greatest(1, round_even(length(content) / 4, 0)::INT) AS n FROM r JOIN q USING (query_id) WHERE mode = 'hybrid+rerank' AND content IS NOT NULL),
s AS (SELECT count(*) AS pairs, count(*) FILTER (n > 512) AS over, max(n) AS longest, count(DISTINCT query_id) FILTER (n > 512 AND rank <= 5) AS queries, list_sort(list(n)) AS l, list_sort(list(n) FILTER (n > 512)) AS x FROM p)
SELECT x[floor(0.5 * over)::BIGINT + 1] - 512 AS lost_median, x[over] - 512 AS lost_worst, round(100 * over / pairs, 6) AS share, pairs, over, longest, queries, l[least(pairs, floor(0.5 * pairs)::BIGINT + 1)] AS p50, l[least(pairs, floor(0.9 * pairs)::BIGINT + 1)] AS p90, l[least(pairs, floor(0.99 * pairs)::BIGINT + 1)] AS p99,
 CASE WHEN 100 * over / pairs < 2 THEN 'none' WHEN 100 * over / pairs < 15 THEN 'partial' ELSE 'mechanical' END AS reading FROM s"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """(met, score, value): of each hybrid list its first score and the mean of its first five, and whether it is satisfied at 5."""
    lists = _lists(spark, d).where("mode = 'hybrid'")
    out = M.outcomes(lists, M.gold(table(spark, d, "designed_slice_final")))
    own = lists.where("rank <= 5").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("search_score"))).alias("top1"), F.round(F.avg("search_score"), 9).alias("mean5"))
    return out.join(own, "query_id").select(M.hit(K).alias("met"), F.explode(F.create_map(F.lit("top1"), F.col("top1"), F.lit("mean5"), F.col("mean5"))).alias("score", "value"))


_SCORES = _OUT + """, own AS (SELECT query_id, max(search_score) FILTER (rank = 1) AS top1, round(avg(search_score), 9) AS mean5 FROM r WHERE mode = 'hybrid' AND rank <= 5 GROUP BY ALL),
sc AS (SELECT coalesce(rank <= 5, false) AS met, 'top1' AS score, top1 AS value FROM o JOIN own USING (query_id) WHERE mode = 'hybrid' UNION ALL SELECT coalesce(rank <= 5, false), 'mean5', mean5 FROM o JOIN own USING (query_id) WHERE mode = 'hybrid')
"""
_POINTS = {"least": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "greatest": 1.0}


def score_quantiles(spark, d):
    return M.floor_quantiles(_scores(spark, d), ["met", "score"], "value", _POINTS)


SQL["score_quantiles"] = _SCORES + ", v AS (SELECT met, score, count(*) AS n, list_sort(list(value)) AS l FROM sc WHERE value IS NOT NULL GROUP BY ALL) SELECT met, score, n, " + ", ".join(f"l[least(n, floor({p} * n)::BIGINT + 1)] AS {k}" for k, p in _POINTS.items()) + " FROM v"


def threshold_sweep(spark, d):
    """Nine thresholds between the least and the greatest value of each score: how many hits and misses each would refuse."""
    s = _scores(spark, d).where("value IS NOT NULL")
    ends = s.groupBy("score").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    steps = ends.select("score", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("step"), "lo", "hi").withColumn("threshold", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / 10)
    below = F.col("value") < F.col("threshold")
    # Nine steps of two scores: a bound that no data move.
    return s.join(F.broadcast(steps), "score").groupBy("score", "step").agg(F.round(F.max("threshold"), 9).alias("threshold"), F.count_if(below & F.col("met")).alias("hits"), F.count_if(below & ~F.col("met")).alias("misses"))


SQL["threshold_sweep"] = _SCORES + """, e AS (SELECT score, min(value) AS lo, max(value) AS hi FROM sc GROUP BY ALL), t AS (SELECT score, i::INT AS step, lo + (hi - lo) * i / 10 AS threshold FROM e, range(1, 10) x(i))
SELECT score, step, round(max(threshold), 9) AS threshold, count(*) FILTER (value < threshold AND met) AS hits, count(*) FILTER (value < threshold AND NOT met) AS misses FROM sc JOIN t USING (score) WHERE value IS NOT NULL GROUP BY ALL"""


def latency_percentiles(spark, d):
    """Floor-index percentiles of the answers' times, each answer once."""
    a = table(spark, d, "api").where("elapsed_ms IS NOT NULL").groupBy("answer_id").agg(F.max("elapsed_ms").alias("ms")).withColumn("all", F.lit(1))
    return M.floor_quantiles(a, ["all"], "ms", {"p50": 0.5, "p95": 0.95, "longest": 1.0}).drop("all")


SQL["latency_percentiles"] = """WITH a AS (SELECT answer_id, max(elapsed_ms) AS ms FROM api WHERE elapsed_ms IS NOT NULL GROUP BY ALL), v AS (SELECT count(*) AS n, list_sort(list(ms)) AS l FROM a)
SELECT n, l[least(n, floor(0.5 * n)::BIGINT + 1)] AS p50, l[least(n, floor(0.95 * n)::BIGINT + 1)] AS p95, l[n] AS longest FROM v"""


def event_percentiles(spark, d):
    return M.floor_quantiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "longest": 1.0})


SQL["event_percentiles"] = """WITH v AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, n, l[least(n, floor(0.5 * n)::BIGINT + 1)] AS p50, l[least(n, floor(0.95 * n)::BIGINT + 1)] AS p95, l[n] AS longest FROM v"""


def bm25_topk(spark, d):
    """The best 20 chunks for every gold question, against all chunks."""
    q = table(spark, d, "designed_slice_final").select("query_id", "query_text").distinct()
    chunks = table(spark, d, "retrieve").where("id IS NOT NULL AND content IS NOT NULL").groupBy("id").agg(F.min("content").alias("content"))
    return search.bm25(q, "query_id", "query_text", chunks, "id", "content", 20)


SQL["bm25_topk"] = r"""WITH c AS (SELECT id, min(content) AS content FROM retrieve WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS w FROM c), n AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w),
tf AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, unnest(w) AS term, len(w) AS len FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query_text), '[\p{L}\p{N}_]+')) AS term FROM (SELECT DISTINCT query_id, query_text FROM designed_slice_final)),
s AS (SELECT query_id, id, round(sum(ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / n.avg_len))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM k WHERE rank <= 20"""


def dense_topk(spark, d):
    """The 20 nearest vectors by cosine to every vector whose id is divisible by 20, against all vectors."""
    return search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


SQL["dense_topk"] = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(x, y), 6) AS score FROM q, e WHERE query_id <> vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 20"""

QUERIES = [
    load_runs, load_gold, satisfied_at_rank, satisfied_at_budget, recall_at_k, recall_at_budget, recall_by_subgroup, subgroup_pivot, mcnemar, mcnemar_modes, bootstrap_ci, missed_by_all,
    ablation_table, ablation_report, produce_runs, answer_path, answer_outcomes, judge_verdicts, worked_examples, demo, hybrid_rrf, rerank, rerank_compare, rerank_by_type, truncation_stats, truncation_histogram, score_quantiles, threshold_sweep, latency_percentiles, event_percentiles, bm25_topk, dense_topk,
]
