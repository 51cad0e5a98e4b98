"""Files in and out: whole texts, JSON lines, threshold tables, chunk indexes and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryline.functions.text import ntok, words
from quarryline.shared import exists, move, read_text, remove, write_text

# Schemas of the line files.
RESULT = "id string, doc_id string, char_start int, char_end int, token_count int, search_score double, rerank_score double"
RUN = f"config string, mode string, query_id int, results array<struct<{RESULT}>>"
GOLD = "query_id int, query string, query_type string, query_source string, verified boolean, gold_spans array<struct<doc_id string, start int, end int>>, require string, answer_passage string, reference_answer string"


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc_id, text) of text files in UTF-8, a file's name without its suffix as doc_id."""
    rows = spark.read.text(pattern, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON objects, one a line, blank lines skipped; a line that is no JSON fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(config, mode, query_id, rank, ...) of run lines, rank being the place in the list; a list that occurs again fails."""
    rows = read_lines(spark, path, RUN)
    again = F.count("*").over(Window.partitionBy("config", "mode", "query_id")) > 1
    once = rows.withColumn("again", again).where(F.when(F.col("again"), F.raise_error(F.lit("a list occurs twice"))).otherwise(F.lit(True)))
    return once.select("config", "mode", "query_id", F.posexplode("results").alias("at", "r")).select("config", "mode", "query_id", (F.col("at") + 1).alias("rank"), "r.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Verified gold queries of a line file."""
    return read_lines(spark, path, GOLD).where("verified")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(section, name, bound, limit, on_breach) of a YAML file of sections, metrics and their bounds."""
    rows, section, metric = [], "", {}
    for line in [*Path(path).read_text(encoding="utf-8").splitlines(), "end:"]:
        body = line.split("#", 1)[0].rstrip()
        if not body.strip():
            continue
        depth, (name, _, value) = (len(body) - len(body.lstrip())) // 2, body.strip().partition(":")
        if depth < 2 and metric.get("limit") is not None:
            rows.append((section, metric["name"], metric["bound"], metric["limit"], metric.get("on_breach", "block")))
        if depth == 0:
            section, metric = name, {}
        elif depth == 1:
            metric = {"name": name}
        elif name in ("min", "max"):
            metric |= {"bound": name, "limit": float(value)}
        else:
            metric[name] = value.strip()
    return spark.createDataFrame(rows, "section string, name string, bound string, limit double, on_breach string")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as one row; a file that isn't there gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def write_document(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """A folder that stands for one JSON document: under each name the rows of a table, as JSON lines, and the names in index.json,
    written last. Rows stay where they are computed; read_document_folder() reads it."""
    for name, df in tables.items():
        write_lines(df, f"{path}/{name}")
    write_text(spark, f"{path}/index.json", json.dumps({n: df.schema.jsonValue() for n, df in tables.items()}))


def read_document_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that write_document() wrote; none if it didn't end."""
    if not exists(spark, f"{path}/index.json"):
        return {}
    return {n: read_lines(spark, f"{path}/{n}", StructType.fromJson(t)) for n, t in json.loads(read_text(spark, f"{path}/index.json")).items()}


def write_log(df: DataFrame, line: str, path: str, at: str) -> None:
    """A log of one line a row (the column `line`) behind a header with the time and the number of rows, in order of the rows' `line`."""
    n = df.count()
    head = df.sparkSession.createDataFrame([(0, f"# run {at}"), (1, f"# {n} rows"), (2, "")], "place int, value string")
    rows = head.unionByName(df.select(F.lit(3).alias("place"), F.col(line).alias("value")))
    rows.repartitionByRange("place", "value").sortWithinPartitions("place", "value").select("value").write.mode("errorifexists").text(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON objects, one a line, nulls written."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write df to a new folder and put that in place of `path`; df may be read from there."""
    spark = df.sparkSession
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(new)
    before = exists(spark, path)
    if before and not move(spark, path, old):
        remove(spark, new)
        raise OSError(f"{path} could not be moved away")
    if not move(spark, new, path):
        # The table before comes back; what was written stays beside it under its own name.
        if before:
            move(spark, old, path)
        raise OSError(f"{new} could not be moved to {path}")
    remove(spark, old)


def write_index(chunks: DataFrame, path: str, embedder: Callable[[Column], Column] | None = None, dimensions: int | None = None) -> None:
    """Chunks (id, doc_id, content, char_start, char_end) as tables `chunks` and `postings`, the latter in files by ranges of words,
    and with an embedder `vectors` (id, vector), computed in Arrow batches. Fails if an id occurs twice or is null, if rows are
    lost, or if a vector is null or has not `dimensions` (unless given those of the first)."""
    spark = chunks.sparkSession
    out = chunks.withColumn("token_count", ntok(F.col("content")))
    out.write.mode("errorifexists").parquet(f"{path}/chunks")
    done = spark.read.parquet(f"{path}/chunks")
    n, named, ids = done.agg(F.count("*"), F.count("id"), F.countDistinct("id")).first()
    if not n == named == ids == chunks.count():
        raise ValueError("an id occurs twice or is null, or rows were lost")
    posting = done.select("id", F.explode(words(F.col("content"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    posting.repartitionByRange("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{path}/postings")
    if embedder is None:
        return
    done.select("id", embedder(F.col("content")).alias("vector")).write.mode("errorifexists").parquet(f"{path}/vectors")
    vectors = spark.read.parquet(f"{path}/vectors")
    size = F.coalesce(F.size("vector"), F.lit(-1))
    rows, least, most = vectors.agg(F.count("*"), F.min(size), F.max(size)).first()
    if rows != n or rows and not least == most == (most if dimensions is None else dimensions) > 0:
        raise ValueError(f"{rows} vectors of {least} to {most} dimensions for {n} chunks")


def markdown(df: DataFrame, title: str, most: int = 1000, text: str = "") -> str:
    """A report's section: a table, nulls as a dash. A report is for reading, so it shows `most` rows and says how many there are."""
    rows = df.limit(most + 1).collect()
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    body = ["| " + " | ".join("-" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:most]]
    more = ["", f"{df.count() - most} more rows."] if len(rows) > most else []
    return "\n".join([f"## {title}", "", *([text, ""] if text else []), *(head + body if rows else ["None."]), *more, ""])


def write_report(spark: SparkSession, path: str, title: str, sections: dict[str, DataFrame], most: int = 1000) -> str:
    """A Markdown file of one table a section; returns its text."""
    text = "\n".join([f"# {title}", "", *(markdown(df, name, most) for name, df in sections.items())])
    write_text(spark, path, text)
    return text
