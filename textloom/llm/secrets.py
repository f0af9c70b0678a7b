"""Secret scans with DataFrame functions only.

Base spans come from three patterns. The method adds spans of kind `random`: runs of 20 and more token characters
that a battery of tests takes for random over their alphabet. The encoding (hex, base32, base36, letters, base58,
base62, base64; padding left out) is inferred from the classes of characters present. The tests: uniform use of the
alphabet by chi-squared; runs about the mean place in the alphabet; runs of one class of characters, of which ordinary
writing has too few; lag-one serial correlation. The least of their p-values, corrected for their number, is the run's.

Random runs have even p-values, ordinary writing has small ones. So those over one half show how many random runs
there are, and for every cut how many of the runs above it are ordinary. Within each band of lengths the lowest cut
is taken at which that share is at most FALSE_DISCOVERY; runs with p-values under 0.001 are never reported. A string counts once
in these figures, however often it is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.llm.common import materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs are whole, so that they can only start where no character of theirs is before.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Runs of one class of characters (and marks between) say nothing about randomness: at least two classes are there.
CANDIDATE = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]"
#: Share of ordinary runs among those reported; least p-value of a reported run, as bins of a quarter of its logarithm.
FALSE_DISCOVERY, LEAST_BIN = 0.1, 12
#: Patterns by which an encoding is inferred, the first that holds, and its alphabet; - and _ stand for + and /.
ENCODINGS = (
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (r"^[1-9A-HJ-NP-Za-km-z]+$", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"),
    (r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Structs (start, kind, end, found) of a pattern's leftmost matches that do not overlap; offsets in code points."""
    spans = F.transform(T.matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["text"].alias("found")))
    spans = F.filter(spans, keep) if keep else spans
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>"))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal law, by the usual rational approximation (7.1.26 of Abramowitz and Stegun)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _pairs(xs: Column, f) -> Column:
    """f of each two neighbours of an array."""
    return F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.size(xs)), f)


def _alphabet(bare: Column) -> Column:
    """The letters of the encoding that a run without padding shows, and the chances that two and three are of one class."""

    def known(letters: str) -> Column:
        share = [sum(map(f, letters)) / len(letters) for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum())]
        return F.struct(F.lit(letters).alias("letters"), F.lit(sum(x**2 for x in share)).alias("two"), F.lit(sum(x**3 for x in share)).alias("three"))

    out = known(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        out = F.when(bare.rlike(pattern), known(letters)).otherwise(out)
    return out


def _measured(found: Column) -> Column:
    """Of a run: its length, the size of its alphabet, places in it and their mean, chances and changes of class.

    Each step binds what the next one uses more than once: inside a lambda nothing is shared by itself.
    """
    kind = lambda c: F.when(c.between("0", "9"), 1).when(c.between("a", "z"), 2).when(c.between("A", "Z"), 3).otherwise(4)

    def placed(x: Column) -> Column:
        codes = F.transform(x["chars"], lambda c: F.instr(x["alphabet"]["letters"], c).cast("double"))
        changes = F.size(F.filter(_pairs(F.transform(x["chars"], kind), lambda a, b: a != b), lambda y: y))
        return F.struct(
            F.size(x["chars"]).cast("double").alias("n"), F.length(x["alphabet"]["letters"]).cast("double").alias("size"), x["alphabet"]["two"].alias("two"), x["alphabet"]["three"].alias("three"),
            codes.alias("codes"), changes.cast("double").alias("changes"),
        )

    def averaged(x: Column) -> Column:
        mean = F.aggregate(x["codes"], F.lit(0.0), lambda acc, c: acc + c) / x["n"]
        return T.bound(mean, lambda m: F.struct(*[x[c].alias(c) for c in ("n", "size", "two", "three", "codes", "changes")], m.alias("mean"), F.transform(x["codes"], lambda c: c > m).alias("above")))

    bare = F.translate(F.rtrim(found, F.lit("=")), "-_", "+/")
    parts = T.bound(bare, lambda b: F.struct(F.regexp_extract_all(b, F.lit("."), F.lit(0)).alias("chars"), _alphabet(b).alias("alphabet")))
    return T.bound(T.bound(parts, placed), averaged)


def _p_value(x: Column) -> Column:
    """The battery's p-value of a run, from what _measured() made of it: the least of four, corrected for their number."""
    codes, n, size, mean, above = x["codes"], x["n"], x["size"], x["mean"], x["above"]
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, y: acc + f(y))

    def counted(acc: Column, y: Column) -> Column:
        """Sum of squared counts over sorted places: the k-th copy of a place adds 2k - 1."""
        k = F.when(y == acc["last"], acc["k"] + 1).otherwise(F.lit(1.0))
        return F.struct(y.alias("last"), k.alias("k"), (acc["sum"] + 2 * k - 1).alias("sum"))

    squares = F.aggregate(F.array_sort(codes), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum")), counted, lambda acc: acc["sum"])
    sums = F.struct(
        squares.alias("squares"), F.size(F.filter(above, lambda y: y)).cast("double").alias("n1"), (1 + F.size(F.filter(_pairs(above, lambda a, b: a != b), lambda y: y))).alias("runs"),
        total(codes, lambda y: (y - mean) * (y - mean)).alias("var"), total(_pairs(codes, lambda a, b: (a - mean) * (b - mean)), lambda y: y).alias("serial"),
    )

    def tested(v: Column) -> Column:
        chi, free = size / n * v["squares"] - n, size - 1
        # Wilson and Hilferty: the cube root of chi-squared over its degrees is nearly normal
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        expected = 1 + 2 * (n - v["n1"]) * v["n1"] / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(spread > 0, (v["runs"] - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(99.0))
        z_serial = F.when(v["var"] > 0, v["serial"] / F.greatest(v["var"], F.lit(1e-9)) * F.sqrt(n)).otherwise(F.lit(99.0))
        # changes of class between neighbours that are independent draws from the alphabet
        two, three = x["two"], x["three"]
        change_var = (n - 1) * two * (1 - two) + 2 * (n - 2) * (three - two * two)
        z_class = F.when(change_var > 0, ((n - 1) * (1 - two) - x["changes"] - 0.5) / F.sqrt(F.greatest(change_var, F.lit(1e-9)))).otherwise(F.lit(0.0))
        z = F.struct(z_chi.alias("chi"), F.abs(z_runs).alias("runs"), z_class.alias("class"), F.abs(z_serial).alias("serial"))
        least = T.bound(z, lambda z: F.least(_tail(z["chi"]), 2 * _tail(z["runs"]), _tail(z["class"]), 2 * _tail(z["serial"]), F.lit(1.0)))
        return 1 - F.pow(1 - least, F.lit(4.0))

    return T.bound(sums, tested)


def _random_runs(text: Column) -> Column:
    """Structs (start, kind, end, found, band, p, bin) of the candidate runs of a text."""
    runs = _spans(text, RANDOM, 3, lambda s: s["found"].rlike(CANDIDATE))

    def scored(s: Column) -> Column:
        return T.bound(_measured(s["found"]), lambda m: T.bound(_p_value(m), lambda p: F.struct(
            *[s[c].alias(c) for c in ("start", "kind", "end", "found")], F.floor(F.log2(m["n"])).cast("int").alias("band"), p.alias("p"),
            F.least(F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-9)))), F.lit(LEAST_BIN)).cast("int").alias("bin"),
        )))

    return F.transform(runs, scored)


def _cuts(tested: DataFrame) -> DataFrame:
    """Per band of lengths the first bin that isn't reported: band, cut. tested: band, bin and p of distinct runs.

    At most LEAST_BIN + 1 bins per band, and as many bands as a length has bits.
    """
    by = Window.partitionBy("band")
    hist = tested.groupBy("band", "bin").agg(F.count("*").alias("n"), F.count_if(F.col("p") > 0.5).alias("upper"))
    above = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    upper = F.sum("upper").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hist = hist.withColumns({"above": above, "random": 2 * (upper + 1) * (1 - F.pow(F.lit(10.0), -(F.col("bin") + 1) / 4))})
    fine = hist.where((F.col("bin") < LEAST_BIN) & (1 - F.col("random") / F.col("above") <= FALSE_DISCOVERY))
    return fine.groupBy("band").agg((F.max("bin") + 1).alias("cut"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, all_spans and the columns in keep.

    Spans are whole matches (kind:start:end, code points, end exclusive), by start and then kind. Null and empty
    texts have none, and the digest of the empty string. Ids may be null or repeated: rows are never joined by them,
    each is scanned by itself; an empty table gives no rows. Texts are scanned whole, in time that grows about as their
    length. all_spans is the array behind spans. Extra columns are ignored unless kept.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 8
    # first all candidate runs, for the cuts (a few rows); then every document by itself, without a join or a shuffle
    runs = docs.where(text.rlike(RANDOM)).select(F.explode(_random_runs(text)).alias("r")).select("r.found", "r.band", "r.p", "r.bin").distinct()
    cuts = {r["band"]: r["cut"] for r in _cuts(materialize(runs, "runs")).collect()}
    kept = [F.col(c) for c in keep if c != "doc_id"]
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    odd = lambda r: F.coalesce(r["bin"] < F.try_element_at(F.create_map(*[F.lit(int(x)) for kv in cuts.items() for x in kv]), r["band"]), F.lit(False))
    plain = lambda r: F.struct(*[r[c].alias(c) for c in ("start", "kind", "end", "found")])
    random = F.when(text.rlike(RANDOM), F.transform(F.filter(_random_runs(text), odd), plain)).otherwise(empty) if cuts else empty
    out = docs.select("doc_id", *kept, _spans(text, ASSIGN, 0, value).alias("assign"), _spans(text, ACCESS, 1, lambda s: F.length(s["found"]) >= 16).alias("access"), _spans(text, HEX, 2).alias("hex"), random.alias("random"))
    out = out.withColumn("all_spans", F.concat("assign", "access", "hex", "random"))
    size = lambda c: F.size(c).cast("long")
    return out.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), F.sha2(_joined(F.concat("assign", "access", "hex")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"), "all_spans", *[c for c in keep if c != "doc_id"])


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by mark; spans that overlap are replaced as one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    # what is kept stands between the end of all spans before and the start of the next one
    gaps = T.sweep(ordered, F.lit(0), lambda at, s: (F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(at.alias("from"), s["start"].alias("to")))), "struct<from:int,to:int>")
    width = 1024  # a long text is cut from short pieces, as finding a place in it takes time by its length
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / width).cast("int"), F.floor(b / width).cast("int")
        part = lambda k, x, n: F.coalesce(F.substring(F.get(chunks, k), x + 1, n), F.lit(""))
        middle = F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(i == j, part(i, a % width, b - a)).otherwise(F.concat(part(i, a % width, F.lit(width)), middle, part(j, F.lit(0), b % width)))

    def joined(x: Column) -> Column:
        last = piece(x["chunks"], x["gaps"]["last"], F.length(text))
        return F.array_join(F.concat(F.transform(x["gaps"]["out"], lambda g: piece(x["chunks"], g["from"], g["to"])), F.array(last)), mark)

    return T.bound(F.struct(gaps.alias("gaps"), chunks.alias("chunks")), joined)
