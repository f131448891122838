"""JSON lines and JSON documents: strict and lenient reads, writes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BAD = "_bad_record"


def read_jsonl(spark: SparkSession, path: str, schema: str, allow_empty: bool = False) -> DataFrame:
    """Typed JSON lines (S1-S6): blank lines are skipped, a malformed line or an empty file is an error.

    The error names the line's number in its file. Unknown fields are dropped; find them with
    validation.unknown_fields on the raw lines.
    """
    raw = spark.read.schema(f"{schema}, {_BAD} STRING").option("columnNameOfCorruptRecord", _BAD).json(path)
    # the first bad line ends this search; a sound input is parsed once here
    bad = raw.where(F.col(_BAD).isNotNull()).limit(1).collect()
    if bad:
        raise ValueError(f"malformed line {_line_number(spark, path, bad[0][_BAD])} in {path}: {bad[0][_BAD][:200]}")
    if not allow_empty and raw.limit(1).count() == 0:
        raise ValueError(f"no rows in {path}")
    return spark.read.schema(schema).json(path)


def _line_number(spark: SparkSession, path: str, line: str) -> int:
    """The number, from 1, of a line in its file; only errors ask for it."""
    return spark.sparkContext.textFile(path).zipWithIndex().filter(lambda x: x[0].strip() == line.strip()).map(lambda x: x[1] + 1).min()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Schema-less lines as variants."""
    return spark.read.text(path).where("trim(value) != ''").select(F.parse_json("value").alias("record"))


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines, overwriting, non-ASCII characters as they are (K1-K3); ``single`` gives one file, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def write_pretty(df: DataFrame, path: str) -> None:
    """A one-row frame as an indented JSON file (K4)."""
    row = df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("j")).first()
    Path(path).write_text((row["j"] if row else "{}") + "\n", encoding="utf-8")


def write_csv(df: DataFrame, path: str) -> None:
    """Failures with header; quotes doubled (K5)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_text(path: str) -> str:
    """A text resource without blanks at its ends."""
    return Path(path).read_text(encoding="utf-8").strip()


GRAPH = (
    "nodes MAP<STRING, STRUCT<name_fa: STRING, domain: STRING, domain_fa: STRING, description: STRING, status_levels: MAP<STRING, STRUCT<code: STRING, description: STRING>>, interventions: MAP<STRING, STRING>>>, "
    "edges ARRAY<STRUCT<source: STRING, target: STRING, type: STRING, description: STRING>>"
)


def read_graph(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document.

    A missing or malformed file gives an empty graph, or an error where ``strict`` is set. Edges keep
    their position in ``position``.
    """
    try:
        doc = spark.read.text(path, wholetext=True).select(F.from_json("value", GRAPH).alias("g"))
        if strict and doc.where("g.nodes IS NOT NULL AND size(g.nodes) > 0").limit(1).count() == 0:
            raise ValueError(f"no nodes in {path}")
    except Exception as e:
        if strict:
            raise ValueError(f"no graph at {path}") from e
        doc = spark.createDataFrame([("{}",)], "value string").select(F.from_json("value", GRAPH).alias("g"))
    nodes = doc.select(F.explode("g.nodes").alias("node_id", "n")).select("node_id", "n.*")
    edges = doc.select(F.posexplode("g.edges").alias("position", "e")).select(F.col("e.source").alias("source_id"), F.col("e.target").alias("target_id"), F.col("e.type").alias("relation_type"), "e.description", "position")
    return nodes, edges
