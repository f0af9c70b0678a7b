"""Raw files as rows: identity by extension and leading bytes, byte-order marks, strict decoding, listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions and the kinds they declare.
EXTENSIONS = {"txt": "txt", "text": "txt", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "docx": "docx", "odt": "odt", "rtf": "rtf", "pdf": "pdf", "doc": "legacy_doc"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length, modified of every file under a folder, by Spark's own reader."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length", F.col("modificationTime").alias("modified"))


def _starts(content: Column, *prefixes: str) -> Column:
    head, hit = F.hex(F.substring(content, 1, 8)), F.lit(False)
    for p in prefixes:
        hit = hit | head.startswith(p)
    return hit


def magic_kind(content: Column) -> Column:
    """The kind that leading bytes show; plain UTF-8 without NUL is txt, anything else unknown."""
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 256), "ISO-8859-1"), r"^\s+", ""))
    page = head.rlike("^(?:<!doctype html|<html|<head|<body)")
    return (
        F.when(_starts(content, "EFBBBF", "FFFE", "FEFF"), "txt").when(_starts(content, "255044462D"), "pdf").when(_starts(content, "504B0304", "1F8B"), "unknown")
        .when(_starts(content, "D0CF11E0A1B11AE1"), "legacy_doc").when(_starts(content, "7B5C727466"), "rtf").when(page, "html")
        .when(F.is_valid_utf8(content.cast("string")) & ~F.coalesce(F.locate("\x00", F.try_validate_utf8(content.cast("string"))) > 0, F.lit(False)), "txt").otherwise("unknown")
    )


def identity(files: DataFrame) -> DataFrame:
    """path, extension, declared, magic, mismatch, route: text under a Markdown name is no mismatch and goes there."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    rows = files.select("path", ext.alias("extension"), F.coalesce(F.try_element_at(table, ext), F.lit("unknown")).alias("declared"), magic_kind(F.col("content")).alias("magic"))
    d, m = F.col("declared"), F.col("magic")
    text = (m == "txt") & d.isin("txt", "markdown")
    return rows.withColumn("mismatch", (d != "unknown") & (m != "unknown") & (d != m) & ~text).withColumn("route", F.when((m == "txt") & (d == "markdown"), "markdown").when(m == "txt", "txt").otherwise(d))


def bom(content: Column) -> Column:
    """The byte-order mark's name or the empty string; 32-bit marks are looked for first."""
    return F.when(_starts(content, "FFFE0000"), "utf-32-le").when(_starts(content, "0000FEFF"), "utf-32-be").when(_starts(content, "EFBBBF"), "utf-8").when(_starts(content, "FFFE"), "utf-16-le").when(_starts(content, "FEFF"), "utf-16-be").otherwise("")


def decoded(files: DataFrame) -> DataFrame:
    """path, status, text: strict UTF-8 without its mark; empty files, other encodings and invalid bytes have no text."""
    name, raw = bom(F.col("content")), F.col("content").cast("string")
    status = F.when(F.octet_length("content") == 0, "empty").when(name.isin("", "utf-8") == F.lit(False), "unsupported_encoding").when(~F.is_valid_utf8(raw), "invalid_utf8").otherwise("ok")
    return files.select("path", status.alias("status"), F.when(status == "ok", F.regexp_replace(F.try_validate_utf8(raw), "^﻿", "")).alias("text"))


def read_strict(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that may be read strictly (path, text), and the others with why not (path, reason): a mark, bad bytes, empty."""
    rows = decoded(files).join(files.select("path", bom(F.col("content")).alias("bom")), "path")
    reason = F.when(F.col("status") == "empty", "empty").when(F.col("bom") != "", "bom").when(F.col("status") != "ok", F.col("status"))
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").select("path", "text"), rows.where("reason IS NOT NULL").select("path", "reason")


def identity_findings(files: DataFrame) -> DataFrame:
    """path, code, severity, evidence of files whose bytes don't fit their name, aren't text, or are of no supported format."""
    container = _starts(F.col("content"), "504B0304", "1F8B", "D0CF11E0A1B11AE1")
    rows = identity(files).join(files.select("path", container.alias("container")), "path")
    evidence = F.concat(F.lit("extension="), "extension", F.lit(" magic="), "magic")
    one = lambda when, code: F.when(when, F.struct(F.lit(code).alias("code"), F.lit("error").alias("severity"), evidence.alias("evidence")))
    found = F.array_compact(F.array(
        one(F.col("mismatch"), "magic.mismatch"), one(~F.col("mismatch") & (F.col("magic") == "unknown") & ~F.col("container"), "encoding.binary"),
        one(F.col("route").isin("legacy_doc"), "unsupported.format"),
    ))
    return rows.select("path", F.inline(found))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified of every file under a folder, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


_MANIFEST = "schema_version int, samples array<struct<sample_id:string,group:string,file:string>>"


def corpus_manifest(spark: SparkSession, root: str, groups: tuple[str, ...], version: int = 1) -> tuple[DataFrame, DataFrame]:
    """The samples of root/corpus-manifest.json (sample_id, group, text), and what is wrong with it (sample_id, problem).

    Problems: schema_version, samples (none at all), and of an entry sample_id, group (not one of groups), file (none
    named), repeated (its id), missing (no such file, or one of no bytes, which Spark's reader passes over), and why a file
    can't be read strictly (blank, bom, invalid_utf8, unsupported_encoding). Only samples without a problem are given, and none of another schema version.
    """
    whole = spark.read.text(f"{root}/corpus-manifest.json", wholetext=True).select(F.from_json("value", _MANIFEST).alias("m"))
    bad = F.array_compact(F.array(F.when(~F.coalesce(F.col("m.schema_version") == version, F.lit(False)), "schema_version"), F.when(F.coalesce(F.size("m.samples"), F.lit(0)) <= 0, "samples")))
    general = whole.select(F.lit("").alias("sample_id"), F.explode(bad).alias("problem"))
    entries = whole.select((F.col("m.schema_version") == version).alias("known"), F.inline("m.samples")).select("known", F.coalesce("sample_id", F.lit("")).alias("sample_id"), F.coalesce("group", F.lit("")).alias("group"), F.coalesce("file", F.lit("")).alias("file"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    named = lambda df: df.withColumn("file", F.regexp_replace("path", "^.*?" + re.escape(root.split("://")[-1].removeprefix("file:").rstrip("/")) + "/+", "")).drop("path")
    good, odd = map(named, read_strict(files))
    read = entries.join(good, "file", "left").join(odd, "file", "left")
    repeated = F.count("*").over(Window.partitionBy("sample_id")) > 1
    problems = F.array_compact(F.array(
        F.when(F.col("sample_id") == "", "sample_id"), F.when(~F.col("group").isin(*groups), "group"), F.when(F.col("file") == "", "file"), F.when((F.col("sample_id") != "") & repeated, "repeated"),
        F.when((F.col("file") != "") & F.col("text").isNull() & F.col("reason").isNull(), "missing"), F.col("reason"), F.when(F.col("text").rlike(r"(?U)\A\s+\z"), "blank"),
    ))
    checked = read.withColumn("problems", problems)
    found = general.unionByName(checked.select("sample_id", F.explode("problems").alias("problem"))).distinct()
    samples = checked.where((F.size("problems") == 0) & F.col("known")).select("sample_id", "group", "text")
    return samples, found
