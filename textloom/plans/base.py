"""What the registered queries share: tables, the decorated documents, rounding, and pieces of oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: Adds to every document, by its id, what the operators look for and the plain documents lack. Valid in both engines.
DECORATED = """CASE WHEN doc_id % 12 = 1 THEN '﻿' ELSE '' END
  || CASE WHEN doc_id % 12 = 2 THEN '[Model: demo-1] ' WHEN doc_id % 12 = 3 THEN '[AI Generated draft] '
          WHEN doc_id % 12 = 4 THEN 'Generated by toolx ' ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END
  || CASE WHEN doc_id % 12 = 5 THEN chr(13) || chr(10) || 'tail' ELSE '' END
  || CASE WHEN doc_id % 12 = 6 THEN chr(10) || 'line   ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN ' However, we don' || chr(39) || 't utilize it. Is it used? It was tested!' ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN ' See <script src="https://u:p@cdn.example.org:8443/a.js"></script> and [x](https://example.com/y).' ELSE '' END
  || CASE WHEN doc_id % 6 = 2 THEN ' "Anna Miller met Bob Stone in Old Harbour" was said.' ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN ' Anna Miller paid $' || CAST(doc_id * 7 AS STRING) || ' on 2024-01-'
          || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || ' (Smith, 2020) [1, 2].' ELSE '' END"""
DX = f"WITH dx AS (SELECT doc_id, source, lang, {DECORATED} AS text FROM documents)"
S = r"[\x09-\x0D ]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the decorated text."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "lang", f"{DECORATED} AS text")


def over_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(decorated(spark, sf_dir)))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to `places` digits (and -0 to 0), integers as they are."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def lst(values) -> str:
    """SQL list of string literals."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{S}+|{S}+$', '', 'g')"


def words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[a-zA-Z0-9]+(?:''[a-zA-Z]+)?')"


def _parts(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


def sentences(t: str) -> str:
    return _parts(rf"regexp_replace({strip(t)}, '([.!?]){S}+', '\1' || chr(1), 'g')")


def paragraphs(t: str) -> str:
    return _parts(rf"regexp_replace({strip(t)}, '\n{S}*\n', chr(1), 'g')")


def clauses(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '[,:;—–]'), lambda x: {strip('x')} <> '')"


def figures(of: str, prefix: str = "") -> str:
    """The ten figures of an expression over grouped rows."""
    q = lambda p: f"round(coalesce(quantile_cont(CAST({of} AS DOUBLE), {p}), 0), 6)"
    return (
        f"count({of}) AS n, round(coalesce(min({of}), 0), 6)::DOUBLE AS minimum, {q(0.1)} AS p10, {q(0.25)} AS p25, {q(0.5)} AS median, {q(0.75)} AS p75, {q(0.9)} AS p90, "
        f"round(coalesce(max({of}), 0), 6)::DOUBLE AS maximum, round(coalesce(avg({of}), 0), 6) AS mean, round(coalesce(stddev_samp({of}), 0), 6) AS stdev"
    )


def occurs(t: str, piece: str) -> str:
    p = "'" + piece.replace("'", "''") + "'"
    return f"((length({t}) - length(replace({t}, {p}, ''))) // {len(piece)})"
