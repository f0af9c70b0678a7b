"""HTML pages and Markdown texts as node rows, parsed in Arrow batches on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.scrub import host_only

NODES = "doc_id long, node_no int, parent_no int, node_type string, depth int, start int, end int, text string"
_BLOCKS = {"p": "paragraph", "ul": "list", "ol": "list", "li": "list_item", "blockquote": "quotation", "pre": "code_block", "table": "table", "tr": "table_row", "td": "table_cell", "th": "table_cell", **{f"h{k}": "heading" for k in range(1, 7)}}
_DROPPED = {"script", "style", "iframe", "object", "embed", "noscript", "template"}
_ALONE = {"embed"}
#: What a dropped element is reported as, and what the value of a link or source may begin with.
_ACTIVE_TAGS = {"script": ("active_content.html_script", "html_script"), "iframe": ("active_content.iframe", "iframe"), "object": ("active_content.embed_object", "embed_object"), "embed": ("active_content.embed_object", "embed_object"), "style": ("unsupported.feature", "style_element")}
_SCHEMES = (("javascript:", "active_content.javascript_link", "javascript_link"), ("vbscript:", "active_content.vbscript_link", "vbscript_link"), ("data:", "active_content.data_uri", "data_uri"))
_REMOTE = ("http://", "https://", "//")


class _Places(HTMLParser):
    """A parser that knows the offset of what it handles."""

    def feed_whole(self, html: str) -> None:
        self.html = html
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column


class _Page(_Places):
    """Collects [parent, type, depth, start, end, text parts] in document order; loose text becomes a paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[tuple[str, int]] = []
        self.dropped = 0
        self.head = 0

    def _new(self, kind: str, start: int, end: int) -> int:
        self.nodes.append([self.open[-1][1] if self.open else 0, kind, len(self.open) + 1, start, end, []])
        return len(self.nodes)

    def _end(self, at: int) -> None:
        self.nodes[self.open.pop()[1] - 1][4] = at

    def handle_starttag(self, tag, attrs):
        at = self.place()
        if tag in _DROPPED:
            self.dropped += tag not in _ALONE
        elif tag in ("head", "title"):
            self.head += 1
        elif tag in _BLOCKS and not self.dropped:
            while self.open and self.open[-1][0] == "p":  # a block ends an open paragraph
                self._end(at)
            if tag == "li" and self.open and self.open[-1][0] == "li":
                self._end(at)
            self.open.append((tag, self._new(_BLOCKS[tag], at, at)))
        elif tag == "img" and not self.dropped:  # keeps an image's place; what it shows is never fetched
            self._new("image_placeholder", at, at + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in ("head", "title"):
            self.head = max(0, self.head - 1)
        elif any(t == tag for t, _ in self.open):
            at = self.place()
            while self.open[-1][0] != tag:
                self._end(at)
            self._end(at + len(tag) + 3)

    def handle_data(self, data):
        if self.dropped or self.head or not data.strip():
            return
        at = self.place()
        node = self.open[-1][1] if self.open else self._new("paragraph", at, at + len(data))
        self.nodes[node - 1][5].append(data)


def _page_nodes(html: str | None) -> list[tuple]:
    page = _Page()
    page.feed_whole(html or "")
    while page.open:
        page._end(len(html or ""))
    return [(k, parent, kind, depth, start, end, " ".join("".join(parts).split())) for k, (parent, kind, depth, start, end, parts) in enumerate(page.nodes, 1)]


class _Attributes(_Places):
    """Collects (code, severity, evidence, offset) of elements and attributes that run or fetch something."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        at = self.place()
        if tag in _ACTIVE_TAGS:
            code, evidence = _ACTIVE_TAGS[tag]
            self.found.append((code, "warning" if tag == "style" else "error", evidence, at))
        for name, value in attrs:
            if value is None:
                continue
            if re.fullmatch(r"on[a-z]+", name):
                self.found.append(("active_content.event_handler", "error", "html_event_handler", at))
            elif name in ("src", "href"):
                low = value.strip().lower()
                known = next(((c, e) for p, c, e in _SCHEMES if low.startswith(p)), None)
                if known:
                    self.found.append((known[0], "error", known[1], at))
                elif low.startswith(_REMOTE):
                    self.found.append(("external.remote_resource", "error", value, at))


def _page_findings(html: str | None) -> list[tuple]:
    page = _Attributes()
    page.feed_whole(html or "")
    return page.found


class _Metadata(_Places):
    """Collects (kind, key, value) of titles, meta tags that have a name and a content, and comments."""

    def __init__(self, bare: bool = True):
        super().__init__(convert_charrefs=True)
        self.bare = bare
        self.found: list[tuple] = []
        self.title: list[str] | None = None

    def _finish(self) -> None:
        if self.title is not None:
            self.found.append(("title", "title", "".join(self.title).strip()))
            self.title = None

    def handle_starttag(self, tag, attrs):
        self._finish()  # a title without an end is over where an element begins
        if tag == "title":
            self.title = []
        elif tag == "meta":
            # of repeated attributes the first counts
            own = dict(reversed(attrs))
            if own.get("name") is not None and own.get("content") is not None:
                self.found.append(("meta", own["name"], own["content"].strip()))

    def handle_endtag(self, tag):
        if tag == "title":
            self._finish()

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data if self.bare else self._ended(data))

    def _ended(self, data: str) -> str:
        """A piece of text in which only entities that end with a semicolon are resolved."""
        at = self.place()
        end = self.html.find("<", at)
        raw = self.html[at : end if end >= 0 else None]
        return _ENTITY.sub(lambda m: unescape(m[0]), raw) if unescape(raw) == data else data

    def handle_comment(self, data):
        self.found.append(("comment", "comment", data.strip()))


_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _page_metadata(html: str | None, bare: bool = True) -> list[tuple]:
    page = _Metadata(bare)
    page.feed_whole(html or "")
    page._finish()
    return page.found


_FENCE, _HEAD, _RULE = re.compile(r"^ {0,3}(```|~~~)"), re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*$"), re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
_ITEM, _QUOTE, _ROW = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(.*)$"), re.compile(r"^ {0,3}>\s?(.*)$"), re.compile(r"^\s*\|(.+)\|\s*$")


_LINK = re.compile(r"(!?)\[([^\]]*)\]\(([^)\s]+)[^)]*\)")


def _markdown_nodes(text: str | None) -> list[tuple]:
    """Lines to nodes: front matter, fences, headings, rules, quotes, items, table cells, paragraphs and their links.

    A node's place is that of its lines in the text, from the first line's start to the last one's end.
    """
    out: list[tuple] = []
    add = lambda kind, body, start, end, parent=0, depth=1: out.append((len(out) + 1, parent, kind, depth, start, end, body)) or len(out)
    lines = (text or "").split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    k, block, fence, since = 0, [], None, 0
    if lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        k = next(i for i in range(1, len(lines)) if lines[i].strip() == "---") + 1
        add("front_matter", "\n".join(lines[1 : k - 1]), 0, starts[k - 1] + len(lines[k - 1]))

    def flush(kind="paragraph", glue=" "):
        """The lines gathered since the last node, up to the one before the current."""
        if block:
            last = max(since, k - 2 if kind == "paragraph" else k - 1)
            while last > since and not lines[last].strip():
                last -= 1
            body = glue.join(block)
            node = add(kind, body, starts[since], starts[last] + len(lines[last]))
            block.clear()
            if kind == "paragraph":
                for m in _LINK.finditer(body):
                    add("image" if m[1] else "hyperlink", m[2], starts[since], starts[last] + len(lines[last]), node, 2)

    while k < len(lines):
        line = lines[k]
        here, end = starts[k], starts[k] + len(line)
        k += 1
        if fence:
            if line.strip().startswith(fence):
                add("code_block", "\n".join(block), starts[since], end)
                block.clear()
                fence = None
            else:
                block.append(line)
        elif m := _FENCE.match(line):
            flush()
            fence, since = m[1], k - 1
        elif m := _HEAD.match(line):
            flush()
            add("heading", m[2], here, end)
        elif block and re.match(r"^ {0,3}(=+|-+)\s*$", line):
            add("heading", " ".join(block), starts[since], end)
            block.clear()
        elif _RULE.match(line):
            flush()
            add("rule", "", here, end)
        elif m := _QUOTE.match(line):
            flush()
            add("quotation", m[1], here, end)
        elif m := _ITEM.match(line):
            flush()
            add("list_item", m[2], here, end, 0, 2 if len(m[1]) > 1 else 1)
        elif m := _ROW.match(line):
            flush()
            cells = [c.strip() for c in m[1].split("|")]
            if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                row = add("table_row", "", here, end)
                for c in cells:
                    add("table_cell", c, here, end, row, 2)
        elif line.strip():
            if not block:
                since = k - 1
            block.append(line.strip())
        else:
            flush()
    k += 1
    if fence:
        add("code_block", "\n".join(block), starts[since], len(text or ""))
    else:
        flush()
    return out


#: Texts that are taken from a batch at once, and rows and letters that are handed on together.
_TEXTS, _HELD_ROWS, _HELD_LETTERS = 32, 4096, 1 << 20
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _rows(parse, schema: str):
    """Batches of (doc_id, text) to rows of what parse finds, a few texts at a time: neither a batch's texts nor its rows are held whole."""
    types = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, letters = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                few = batch.slice(at, _TEXTS)
                for i, t in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                    rows.extend((i, *n) for n in parse(t))
                    letters += len(t or "")
                    if rows and (len(rows) >= _HELD_ROWS or letters >= _HELD_LETTERS):
                        yield made()
                        rows, letters = [], 0
        if rows:
            yield made()

    return run


def html_nodes(pages: DataFrame) -> DataFrame:
    """(doc_id, text) pages to nodes with their places in the source. Scripts and styles are dropped."""
    return pages.select("doc_id", "text").mapInArrow(_rows(_page_nodes, NODES), NODES)


def page_findings(pages: DataFrame) -> DataFrame:
    """doc_id, code, severity, evidence, offset of elements and attributes of pages that could run or fetch something.

    Event handlers, script and data links, remote sources (scheme and host only), scripts, frames and objects, inside
    dropped elements too; style elements are a warning.
    """
    schema = "doc_id long, code string, severity string, evidence string, offset int"
    rows = pages.select("doc_id", "text").mapInArrow(_rows(_page_findings, schema), schema)
    return rows.withColumn("evidence", F.when(F.col("code") == "external.remote_resource", host_only(F.col("evidence"))).otherwise(F.col("evidence")))


def markdown_nodes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_rows(_markdown_nodes, NODES), NODES)


def surface_text(nodes: DataFrame) -> DataFrame:
    """doc_id, surface: the nodes' texts in order, one line each."""
    held = nodes.where("text <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_no", "text"))).alias("x"))
    return held.select("doc_id", F.array_join("x.text", "\n").alias("surface"))


def page_metadata(pages: DataFrame, bare: bool = True) -> DataFrame:
    """doc_id, kind, key, value of titles, meta tags with a name and a content, and comments.

    Attributes count in any order and any quotes, entities are resolved, what stands in scripts is no markup. bare:
    whether titles' entities count without their semicolon too, as browsers take them.
    """
    schema = "doc_id long, kind string, key string, value string"
    return pages.select("doc_id", "text").mapInArrow(_rows(partial(_page_metadata, bare=bare), schema), schema)


def markdown_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, kind, key, value of front matter lines (key: value) and comments of Markdown texts."""
    t = F.col("text")
    front = F.regexp_extract(t, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    line = r"^\s*([A-Za-z0-9_-]+)\s*:\s*(.*?)\s*$"
    pairs = F.transform(F.filter(F.split(front, "\n"), lambda x: x.rlike(line)), lambda x: F.struct(F.lit("front_matter").alias("kind"), F.regexp_extract(x, line, 1).alias("key"), F.regexp_extract(x, line, 2).alias("value")))
    notes = F.transform(F.regexp_extract_all(t, F.lit("(?s)<!--(.*?)-->"), F.lit(1)), lambda x: F.struct(F.lit("comment").alias("kind"), F.lit("comment").alias("key"), F.trim(x).alias("value")))
    return docs.select("doc_id", F.inline(F.concat(pairs, notes)))


def tree_depth(nodes: DataFrame, most: int = 32) -> DataFrame:
    """doc_id, depth, too_deep of node trees (doc_id, node_no, parent_no; 0: no parent), walked from the roots down.

    Walks end one level below `most`: what is deeper is too_deep, and its depth is most + 1. Nodes whose parents don't
    lead to a root don't count. The walk is a recursive query; its limit on rows is lifted while it runs.
    """
    from textloom.sources.store import materialize

    spark = nodes.sparkSession
    n = materialize(nodes.select("doc_id", "node_no", "parent_no"), "nodes")  # every level reads them
    walk = f"""WITH RECURSIVE t AS (SELECT doc_id, node_no, 1 AS level FROM {{n}} WHERE parent_no = 0
      UNION ALL SELECT m.doc_id, m.node_no, t.level + 1 FROM t JOIN {{n}} m ON m.doc_id = t.doc_id AND m.parent_no = t.node_no WHERE t.level <= {int(most)})
      SELECT doc_id, max(level) AS depth, max(level) > {int(most)} AS too_deep FROM t GROUP BY doc_id"""
    names = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(most + 2)}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        return materialize(spark.sql(walk, n=n), "depths")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def structure_signature(nodes: DataFrame) -> DataFrame:
    """doc_id, signature, headings, paragraphs: digest of node types and heading texts in order, with the version before."""
    framed = F.when(F.col("node_type") == "heading", F.concat_ws("\x00", "node_type", "text")).otherwise(F.col("node_type"))
    rows = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_no", "node_type", "text", framed.alias("v")))).alias("x"), F.count_if(F.col("node_type") == "paragraph").alias("paragraphs"))
    signature = F.sha2(F.concat_ws("\x00", F.lit("structure-signature-v1"), F.array_join("x.v", "\x00"), F.concat(F.lit("paragraphs="), F.col("paragraphs").cast("string"))), 256)
    return rows.select("doc_id", signature.alias("signature"), F.transform(F.filter("x", lambda n: n["node_type"] == "heading"), lambda n: n["text"]).alias("headings"), "paragraphs")
