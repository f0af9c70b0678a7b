"""License scans with DataFrame functions only.

Whole license texts and standard headers are held in `license_texts.json`. Templates are cut into five-word shingles.
Texts are read in windows of twice a template's length that step by its length, so every stretch as long as the
template lies whole in one window. A window keeps the shingles that some template of its length has. Each window and
template has one minimum per band under BANDS reorderings of the shingle hashes, and they meet by an equi-join on band
and minimum. A window that holds 0.75 of a template has a Jaccard similarity of at least 1/3 with it, so with one row a band it
meets the template with probability 1 - (2/3)**BANDS, over 0.9999. What meets is verified by exact containment.

Licenses whose texts are near copies of each other (GPL and AGPL, GPL headers of two versions) are told apart by the
shingles that one has and the other lacks: one that shows less than half of its own, and less than the other, goes.

Notices of one line are too short for shingles: they are found as phrases (NOTICES) and counted apart. Phrases that
belong to a whole text found in the document are no notices.

Only texts with one of the templates' anchor words are cut. Anchors are chosen so that a text without any of them
lacks more than a quarter of every template's shingles: no match is lost.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_broadcast, materialize

BANDS, WIDTH, CONTAINED = 24, 5, 0.75
#: Shingles of all templates up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Templates of fewer shingles are phrases; templates that share this part of the smaller one are near copies.
LEAST_SHINGLES, NEAR = 4, 0.5

#: Short notices by which texts name their license, then whole texts and headers.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    *((r["license"], r["text"]) for r in json.loads(Path(__file__).with_name("license_texts.json").read_text(encoding="utf-8"))),
)
_WORD = "[a-z0-9]+"

_UNDER = "(?:released|licen[sc]ed|relicensed|distributed|published|provided|available|covered|governed|shared|issued|offered|redistributed|used)(?: only)? (?:under|by) (?:a |an |the )?(?:terms (?:and conditions )?of (?:a |an |the )?)?"
_LEAD = f"(?:{_UNDER}|licen[sc]e(?: is)? (?:a |an |the )?|spdx license identifier )"


def _gnu(name: str, short: str, version: str) -> str:
    """The GNU license's name in full or short, with a version, or with none where version is empty."""
    major, _, minor = version.partition(".")
    number = f"(?: ?v| version)? ?{major}{f' {minor}' if minor not in ('', '0') else '(?: 0)?'}(?! [0-9])" if version else "(?! ?v ?[0-9]| ?[0-9]| version [0-9]| as published)"
    return f"(?:gnu )?(?:{name}(?: {short})?|{short}){number}"


def _creative(kind: str, version: str) -> str:
    long = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s"}
    parts = kind.split("-")
    number = f" {version.replace('.', ' ')}" if version else "(?! [0-9] [0-9]| sa| nc| nd| share| non| no ?deriv)"
    return f"(?:cc|creative commons) (?:{' '.join(parts)}|{' '.join(long[p] for p in parts)}){number}"


#: License and regular expression over a text's words joined by single blanks.
NOTICES = (
    ("MIT", f"{_LEAD}mit(?: x11)?(?: license| licence)?"),
    ("Apache-2.0", f"{_LEAD}(?:apache(?: software)?(?: license| licence)? (?:v|version )?2(?: 0)?|asl ?2(?: 0)?)"),
    *((f"BSD-{n}-Clause", f"{_LEAD}(?:(?:new |modified |simplified )?bsd {n} clause|{n} clause bsd)") for n in (2, 3, 4)),
    ("BSD", f"{_LEAD}(?:new |modified |simplified )?bsd(?! [234] clause)"),
    ("ISC", f"{_LEAD}isc"), ("Unlicense", f"{_LEAD}unlicense"), ("Zlib", f"{_LEAD}zlib"), ("BSL-1.0", f"{_LEAD}(?:boost software license|bsl 1 0)"),
    *((f"MPL-{v}", f"{_LEAD}(?:mozilla public license|mpl)(?: mpl)? ?(?:v|version )? ?{v.replace('.', ' ')}") for v in ("1.1", "2.0")),
    *((f"GPL{v and '-' + v}", _LEAD + _gnu("general public license", "gpl", v)) for v in ("1.0", "2.0", "3.0", "")),
    *((f"LGPL{v and '-' + v}", _LEAD + _gnu("(?:lesser|library) general public license", "lgpl", v)) for v in ("2.0", "2.1", "3.0", "")),
    *((f"AGPL{v and '-' + v}", _LEAD + _gnu("affero general public license", "agpl", v)) for v in ("3.0", "")),
    *((f"CC-{k.upper()}{v and '-' + v}", _LEAD + _creative(k, v)) for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0", "")),
    ("CC0-1.0", f"{_LEAD}(?:creative commons )?cc ?0"),
)
#: One of these stands at a word's start in every text that a notice matches.
_NOTICE_MARKS = (r"(?:re)?licen[sc]e", r"(?:re)?(?:released|distributed|published|provided|available|covered|governed|shared|issued|offered|used)(?:[^a-z0-9]+only)?[^a-z0-9]+(?:under|by)[^a-z0-9]")


def _lower(text: Column) -> Column:
    """A-Z in lower case; lower() does that alone, and faster, where all is ASCII."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def anchors(words: list[str], width: int, held: Sequence[str] = ()) -> list[str]:
    """What to add to the held words such that fewer than 0.75 of the shingles hold none: what stands in most, long words first."""
    left = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    bound = CONTAINED * len(left)
    left = {s for s in left if not set(s) & set(held)}
    chosen: list[str] = []
    while left and len(left) >= bound:
        counts = Counter(w for s in left for w in set(s))
        chosen.append(max(counts, key=lambda w: (len(w) >= 7, counts[w], len(w), w)))
        left = {s for s in left if chosen[-1] not in s}
    return chosen


def _rivals(held: list[tuple[str, list[str]]]) -> list[list[tuple[int, list[list[str]]]]]:
    """Per template its near copies under other licenses, each with the shingles that this one has and the other lacks."""
    sets = [{tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)} for _, w in held]
    near = lambda a, b: held[a][0] != held[b][0] and len(sets[a] & sets[b]) >= NEAR * min(len(sets[a]), len(sets[b]))
    return [[(b, [list(s) for s in sorted(sets[a] - sets[b])]) for b in range(len(held)) if near(a, b) and sets[a] - sets[b]] for a in range(len(held))]


def _shingles(words: Column, width: int) -> Column:
    """Hashes of the width-word shingles of an array of words, in order."""
    places = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(width)]))


def _notices(cut: DataFrame, phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """doc_id, row, license, n, at (words before the first) of the phrases in the words of each row."""
    joined = cut.select("doc_id", "row", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("joined"))
    # most texts hold none of them: one search for all, in which those that begin alike share their beginning
    led = [p.removeprefix(_LEAD) for _, p in phrases if p.startswith(_LEAD)]
    some = [p for _, p in phrases if not p.startswith(_LEAD)] + ([f"{_LEAD}(?:{'|'.join(led)})"] if led else [])
    joined = joined.where(F.col("joined").rlike(f"(?<= )(?:{'|'.join(some)})(?= )"))
    hits = []
    for name, phrase in phrases:
        pattern = f"(?<= ){phrase}(?= )"
        place = F.regexp_instr(F.col("joined"), F.lit(pattern))
        at = F.length(F.regexp_replace(F.col("joined").substr(F.lit(1), place - 1), "[^ ]", "")) - 1
        hits.append(F.when(place > 0, F.struct(F.lit(name).alias("license"), F.regexp_count(F.col("joined"), F.lit(pattern)).cast("long").alias("n"), at.cast("int").alias("at"))))
    return joined.select("doc_id", "row", F.inline(F.array_compact(F.array(*hits))))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, notices: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Per document and license found: doc_id, license, containment, n_windows, first_word, n_notices.

    containment is the largest of a template in a window, 1 where only notices name the license; n_windows counts
    windows that hold a template, n_notices one-line notices, first_word is the place of the first window or notice.
    Words are runs of a-z and 0-9 after lower-casing A-Z. Null, empty and wordless texts match nothing, nor do
    templates without words. Rows repeated under one doc_id are reported together; null ids likewise. Extra columns
    are ignored. No template or no match gives no rows. NOTICES belong to TEMPLATES: other templates come with none
    unless stated.
    """
    spark = docs.sparkSession
    notices = (NOTICES if templates is TEMPLATES else ()) if notices is None else notices
    of = [(name, words) for name, text in templates if (words := _words(text))]
    held = [(name, words) for name, words in of if len(words) - WIDTH + 1 >= LEAST_SHINGLES]
    phrases = [(name, " ".join(words)) for name, words in of if len(words) - WIDTH + 1 < LEAST_SHINGLES]
    marks: list[str] = list(_NOTICE_MARKS) if notices else []
    marks += [p for _, phrase in phrases if not re.search("licen[sc]e", phrase) or not notices for p in [max(phrase.split(), key=len)]]
    chosen: list[str] = ["license"] if notices else []
    for _, words in held:
        chosen += anchors(words, WIDTH, chosen)
    marks = sorted({*marks, *chosen})

    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # marks are words, or begin as words do: looked for at the starts of words alone
    able = able.where(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(marks)})")) if marks else able.where(F.lit(False))
    # equal rows are one: their matches are equal
    cut = able.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.regexp_extract_all(_lower(F.col("text")), F.lit(_WORD), F.lit(0)).alias("words"))
    out = spark.createDataFrame([], "doc_id long, row long, license string, containment double, template int, at int, n long, inside long")
    if phrases or notices:
        named = _notices(cut, [*phrases, *notices])
        out = out.unionByName(named, allowMissingColumns=True)
    if held:
        out = out.unionByName(_windows(cut, held, notices), allowMissingColumns=True)
    windows, left = F.countDistinct(F.when(F.col("template").isNotNull(), F.struct("template", "at"))), F.greatest(F.lit(0), F.coalesce(F.max("n"), F.lit(0)) - F.coalesce(F.max("inside"), F.lit(0)))
    found = out.groupBy("doc_id", "row", "license").agg(F.max("containment").alias("containment"), windows.alias("n_windows"), F.min("at").alias("at"), left.cast("long").alias("n_notices"))
    found = found.where("n_windows > 0 OR n_notices > 0")
    return found.groupBy("doc_id", "license").agg(F.coalesce(F.max("containment"), F.lit(1.0)).alias("containment"), F.max("n_windows").alias("n_windows"), F.min("at").alias("first_word"), F.max("n_notices").alias("n_notices"))


def _signed(members: DataFrame, *keys: str) -> DataFrame:
    """keys, band, least: per set of shingle hashes h and band the least hash under the band's reordering."""
    least = members.groupBy(*keys).agg(*[F.min(F.xxhash64("h", F.lit(b))).alias(f"m{b}") for b in range(BANDS)])
    return least.select(*keys, F.posexplode(F.array(*[f"m{b}" for b in range(BANDS)])).alias("band", "least"))


def _windows(cut: DataFrame, held: list[tuple[str, list[str]]], notices: Sequence[tuple[str, str]]) -> DataFrame:
    """doc_id, row, license, containment, template, at of the templates that windows hold, and in rows of their own the
    notices of other licenses that belong to these templates (license, inside).

    The templates' tables are broadcast up to BROADCAST_ROWS counted rows and joined by a shuffle beyond.
    """
    spark = cut.sparkSession
    own_notices = [[(name, n) for name, phrase in notices if (n := len(re.findall(f"(?<= ){phrase}(?= )", f" {' '.join(w)} ")))] for _, w in held]
    rows = [(len(w) - WIDTH + 1, k, name, w, against, own_notices[k]) for k, ((name, w), against) in enumerate(zip(held, _rivals(held)))]
    known = spark.createDataFrame(rows, "length int, template int, license string, words array<string>, against array<struct<rival:int,single:array<array<string>>>>, inner array<struct<license:string,n:long>>")
    own = materialize(known.select("template", "license", "length", F.explode(F.array_distinct(_shingles(F.col("words"), WIDTH))).alias("h")), "templates")
    n_own = own.count()
    sent = lambda df: bounded_broadcast(df, n_own, BROADCAST_ROWS)  # noqa: E731  (none of them has more rows than this times BANDS)
    # a shingle counts for windows of those lengths whose templates have it
    pool = own.groupBy("h").agg(F.collect_set("length").alias("lengths"))
    hits = cut.select("doc_id", "row", F.posexplode(_shingles(F.col("words"), WIDTH)).alias("pos", "h")).join(sent(pool), "h")
    hits = hits.select("doc_id", "row", "pos", "h", F.explode("lengths").alias("length"))
    # window w begins at w * length and is twice as long: a place is in two
    of = F.floor(F.col("pos") / F.col("length")).cast("int")
    placed = hits.select("doc_id", "row", "length", F.explode(F.filter(F.array(of - 1, of), lambda w: w >= 0)).alias("w"), "h")
    members = materialize(placed.distinct(), "windows")
    window = ["row", "length", "w"]
    # windows and templates meet where a band's minimum is the same
    index = _signed(own, "template", "length")
    met = _signed(members, *window).join(sent(index), ["length", "band", "least"]).select(*window, "template").distinct()
    sizes = own.groupBy("template").agg(F.count("*").alias("size"))
    exact = met.join(members, window).join(sent(own), ["template", "length", "h"]).groupBy("doc_id", *window, "template", "license").agg(F.count("*").alias("shared"))
    exact = exact.join(sent(sizes), "template").withColumn("containment", F.col("shared") / F.col("size")).where(F.col("containment") >= CONTAINED)
    seen = materialize(exact.select("doc_id", *window, "template", "license", "containment", (F.col("w") * F.col("length")).alias("at")), "held")
    # of near copies under other licenses those go that show less of what only they have
    hashed = lambda xs: F.transform(xs, lambda x: F.xxhash64(*[F.element_at(x, k + 1) for k in range(WIDTH)]))
    single = known.select("template", F.inline("against")).select("template", "rival", F.size("single").alias("n"), F.explode(hashed(F.col("single"))).alias("h"))
    shown = seen.select(*window, "template").distinct().join(members.select(*window, "h").distinct(), window).join(single, ["template", "h"])
    best = shown.groupBy(*window, "template", "rival", "n").agg(F.count("*").alias("shared")).groupBy("row", "template", "rival").agg(F.max(F.col("shared") / F.col("n")).alias("shown"))
    # a template that shows nothing of its own has no row here: both directions start from what was seen
    pairs = single.select("template", "rival").distinct().join(seen.select("row", "template").distinct(), "template")
    pairs = pairs.join(best, ["row", "template", "rival"], "left").withColumn("shown", F.coalesce("shown", F.lit(0.0)))
    other = pairs.select("row", F.col("rival").alias("template"), F.col("template").alias("rival"), F.col("shown").alias("theirs"))
    gone = pairs.join(other, ["row", "template", "rival"]).where((F.col("shown") < NEAR) & (F.col("shown") < F.col("theirs"))).select("row", "template").distinct()
    told = seen.join(gone, ["row", "template"], "left_anti")
    inner = known.select("template", F.inline("inner")).select("template", F.col("license").alias("notice"), F.col("n").alias("inside"))
    inside = told.select("doc_id", "row", "template").join(inner, "template").select("doc_id", "row", F.col("notice").alias("license"), "inside")
    return told.select("doc_id", "row", "license", "containment", "template", "at").unionByName(inside.distinct(), allowMissingColumns=True)
