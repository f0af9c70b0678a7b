"""Texts and notes made from structured rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def plain_text(title: Column, sections: Column) -> Column:
    """Title and sections with a blank line between and one newline at the end; null where all are blank."""
    parts = F.filter(F.concat(F.array(title), sections), lambda x: x.isNotNull() & (T.strip(x) != ""))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n\n"), F.lit("\n")))


def markdown(title: Column, sections: Column) -> Column:
    return plain_text(F.concat(F.lit("# "), title), sections)


def slug(c: Column) -> Column:
    """The whole text's letters and digits joined by hyphens, cut to 40 characters; untitled where there are none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(plain, 1, 40), "-+$", ""), F.lit("")), F.lit("untitled"))


def notes(nodes: DataFrame) -> DataFrame:
    """One note per heading: doc_id, file_name, heading, paragraphs, content; equal slugs of a document get -1, -2 and so on."""
    order = Window.partitionBy("doc_id").orderBy("node_no")
    section = F.last(F.when(F.col("node_type") == "heading", F.col("node_no")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = nodes.withColumn("section", section).where("section IS NOT NULL")
    per = rows.groupBy("doc_id", "section").agg(F.max(F.when(F.col("node_no") == F.col("section"), F.col("text"))).alias("heading"), F.count_if(F.col("node_type") == "paragraph").alias("paragraphs"), F.collect_list(F.when(F.col("node_type") == "paragraph", F.struct("node_no", "text"))).alias("body"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("section")) - 1
    per = per.withColumn("slug", slug(F.col("heading"))).withColumn("nth", nth)
    name = F.concat(F.col("slug"), F.when(F.col("nth") > 0, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise(""), F.lit(".md"))
    body = F.array_join(F.transform(F.sort_array(F.col("body")), lambda x: x["text"]), "\n\n")
    return per.select("doc_id", name.alias("file_name"), "heading", "paragraphs", F.concat(body, F.lit("\n")).alias("content"), "section")


def export_problems(requests: DataFrame) -> DataFrame:
    """doc_id, problem of export requests (doc_id, path, format, text)."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    checks = F.array_compact(F.array(
        F.when(F.coalesce(T.strip(F.col("text")), F.lit("")) == "", "empty_document"), F.when(F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)|^/"), "unsafe_output_path"),
        F.when(suffix != F.col("format"), "format_extension_mismatch"),
    ))
    return requests.select("doc_id", F.explode(checks).alias("problem"))


#: The heading lines of an overview note.
WARNING = "Vault content is plaintext unless the vault volume is encrypted."


def _ordered(rows: DataFrame, order: str, name: str, *fields: Column | str) -> DataFrame:
    """doc_id and an array, by `order`, of structs of fields."""
    kept = rows.select("doc_id", F.col(order).alias("_o"), F.struct(*fields).alias("_s")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("_o", "_s"))).alias("x"))
    return kept.select("doc_id", F.transform("x", lambda v: v["_s"]).alias(name))


def _public(docs: DataFrame, nodes: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """docs with nodes, claims and citations as arrays in order, without ids of their own; empty where there are none."""
    parts = (
        _ordered(nodes, "node_no", "nodes", F.col("node_no").alias("position"), F.col("node_type").alias("type"), "text"),
        _ordered(claims, "claim_no", "claims", "proposition", "modality", "negation", F.lit("proposed").alias("status")), _ordered(citations, "citation_no", "citations", "kind", "text"),
    )
    for part in parts:
        name = part.columns[1]
        docs = docs.join(part, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return docs


def projection(docs: DataFrame, nodes: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, json: the public view of documents (doc_id, lang): nodes, claims and citations, without internal ids."""
    return _public(docs.select("doc_id", "lang"), nodes, claims, citations).select("doc_id", F.to_json(F.struct("lang", "nodes", "claims", "citations")).alias("json"))


def overviews(docs: DataFrame, nodes: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, file_name, content of one overview note per document (doc_id, title): outline, claims, citations."""
    rows = _public(docs.select("doc_id", "title"), nodes, claims, citations)
    files = notes(nodes)
    section = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_no"))
    outline = _ordered(files.withColumn("node_no", F.col("section")).withColumn("k", section), "k", "files", "heading", "file_name")
    rows = rows.join(outline, "doc_id", "left")
    lines = lambda xs, f: F.when(F.size(xs) > 0, F.array_join(F.transform(xs, f), "\n")).otherwise("- (none)")
    heads = F.coalesce(F.array_join(F.transform("files", lambda x: F.concat(F.lit("- ["), x["heading"], F.lit("]("), x["file_name"], F.lit(")"))), "\n"), F.lit("- (no headings in the source document)"))
    claim = lambda c: F.concat(F.lit("- Proposition: "), c["proposition"], F.lit(" | Modality: "), c["modality"], F.lit(" | Negation: "), F.when(c["negation"], "yes").otherwise("no"), F.lit(" | Status: "), c["status"])
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.lit(""), F.lit(f"> {WARNING}"), F.lit(""), F.lit("## Document structure"), F.lit(""), heads, F.lit(""), F.lit("## Claims"), F.lit(""), lines("claims", claim), F.lit(""), F.lit("## Citations"), F.lit(""), lines("citations", lambda c: F.concat(F.lit("- "), c["kind"], F.lit(": "), c["text"])))
    return rows.select("doc_id", F.concat(slug(F.col("title")), F.lit("-overview.md")).alias("file_name"), F.concat(body, F.lit("\n")).alias("content"))
