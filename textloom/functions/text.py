"""Column builders for words, sentences, paragraphs and match offsets; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[a-zA-Z0-9]+(?:'[a-zA-Z]+)?"
SPACE = r"[ \t\n\x0B\f\r]"


#: An end of a sentence inside a stripped text: a mark and the white space after it.
_ENDS = rf"[.!?]{SPACE}+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def words(c: Column) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def cased_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def sentences(c: Column) -> Column:
    # cut at whole runs of white space, the pieces of a stripped text need no stripping
    return F.filter(F.split(strip(c), rf"(?<=[.!?]){SPACE}+"), lambda x: x != "")


def sentence_count(c: Column) -> Column:
    """How many sentences a text has that is stripped and not empty."""
    return F.regexp_count(c, F.lit(_ENDS)) + 1


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), rf"\n{SPACE}*\n"), strip), lambda x: x != "")


def clauses(c: Column) -> Column:
    return F.filter(F.split(c, "[,:;—–]"), lambda x: strip(x) != "")


def occurrences(c: Column, piece: str | Column) -> Column:
    """How often a piece of text occurs, not overlapping."""
    p = F.lit(piece) if isinstance(piece, str) else piece
    return ((F.length(c) - F.length(F.replace(c, p, F.lit("")))) / F.length(p)).cast("long")


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once: the value becomes a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Elements that one step of a running sum appends to: long arrays are summed in pieces, so that copies stay short.
_PIECE = 32


def _sums(xs: Column) -> Column:
    """struct(total, before): the sum of a short array and the sums before each element."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("before"))
    return F.aggregate(xs, start, lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")))


def running(xs: Column) -> Column:
    """Sums of the elements before each element of an array of longs.

    Pieces are summed one by one, then pieces of pieces, so the work grows with the length to the power 4/3.
    """

    def two(xs: Column, inner) -> Column:
        places = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(_PIECE))).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(places, lambda i: _sums(F.slice(xs, i + 1, F.lit(_PIECE))))
        return bound(pieces, lambda p: F.flatten(F.zip_with(p["before"], inner(p["total"]), lambda own, base: F.transform(own, lambda x: x + base))))

    return bound(xs, lambda xs: two(xs, lambda xs: two(xs, lambda xs: _sums(xs)["before"])))


def sweep(xs: Column, start: Column, step, kind: str) -> Column:
    """One pass over an array in order: struct(last, out).

    step takes the last value and an element and gives the new last value and what goes to out (null: nothing). Long
    arrays are swept in pieces, so that what is appended to stays short.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        last, out = step(acc["last"], x)
        return F.struct(last.alias("last"), F.when(out.isNotNull(), F.concat(acc["out"], F.array(out))).otherwise(acc["out"]).alias("out"))

    def piece(acc: Column, ys: Column) -> Column:
        own = F.aggregate(ys, F.struct(acc["last"].alias("last"), empty.alias("out")), one)
        return bound(own, lambda r: F.struct(r["last"].alias("last"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        places = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(_PIECE))).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(places, lambda i: F.slice(xs, i + 1, F.lit(_PIECE)))
        nothing = F.struct(start.alias("last"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(pieces, nothing, piece, lambda acc: F.struct(acc["last"].alias("last"), F.flatten(acc["out"]).alias("out")))

    return bound(xs, whole)


def matches(c: Column, pattern: str) -> Column:
    """Matches of a pattern in order as structs (start, end, text), offsets in code points."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(c, pattern, -1), F.length)

    def spans(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: (g + F.length(m)).cast("long"))
        return bound(steps, lambda steps: F.zip_with(
            F.zip_with(running(steps), steps, lambda b, s: (b + s).cast("int")), x["found"],
            lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")),
        ))

    return bound(F.struct(gaps.alias("gaps"), found.alias("found")), spans)


def with_distribution(df: DataFrame, values: Column, names: dict[str, str] | None = None) -> DataFrame:
    """df with ten figures of an array of numbers: linear percentiles, sample deviation; 0 where there is nothing.

    names: which figures to add and under what name; all under their own names if left out. The array is sorted in
    a step of its own, so that its expression is evaluated once a row.
    """
    df = df.withColumn("_xs", F.sort_array(F.transform(values, lambda x: x.cast("double"))))
    zero = F.lit(0.0)
    df = df.withColumns({"_sum": F.aggregate("_xs", zero, lambda acc, x: acc + x), "_squares": F.aggregate("_xs", zero, lambda acc, x: acc + x * x)})
    xs, n = F.col("_xs"), F.size("_xs")

    def at(q: float) -> Column:
        place = (n - 1) * F.lit(q)
        low = F.floor(place)
        a, b = F.get(xs, low.cast("int")), F.get(xs, F.ceil(place).cast("int"))
        return F.coalesce(a + (place - low) * (b - a), zero)

    mean = F.when(n > 0, F.col("_sum") / n).otherwise(0.0)
    spread = F.greatest(F.col("_squares") - F.col("_sum") * F.col("_sum") / n, zero) / (n - 1)
    figures = {
        "n": n.cast("long"), "minimum": at(0.0), "p10": at(0.1), "p25": at(0.25), "median": at(0.5), "p75": at(0.75), "p90": at(0.9), "maximum": at(1.0),
        "mean": mean, "stdev": F.when(n > 1, F.sqrt(spread)).otherwise(0.0),
    }
    names = names or {k: k for k in figures}
    return df.withColumns({v: figures[k] for k, v in names.items()}).drop("_xs", "_sum", "_squares")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def counted(c: Column, values: list[str] | tuple[str, ...]) -> Column:
    """How many elements of an array of words are in a list."""
    return F.size(F.filter(c, lambda w: w.isin(*values))).cast("long")


def decimals(v: Column, digits: int) -> Column:
    """A number from 0 on with so many digits after the point, rounded by its binary value, halves to even."""
    unit = 10**digits
    k = F.floor(v * unit)
    # twice the unit times v against the next half, by powers of two, the largest first: each step is exact near it
    first, *rest = [1 << j for j in range((2 * unit).bit_length() - 1, -1, -1) if 2 * unit >> j & 1]
    over = v * first - (2 * k + 1)
    for power in rest:
        over = over + v * power
    n = k + F.when((over > 0) | ((over == 0) & (k % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))


def tenths(v: Column) -> Column:
    return decimals(v, 1)


def whole_or_tenths(v: Column) -> Column:
    """A number as an integer if it is whole to one digit, else with one digit."""
    return F.regexp_replace(tenths(v), r"\.0$", "")


def runs(xs: Column) -> Column:
    """Structs (value, n, first) of an array of strings: how often each value occurs and where first, in linear sweeps."""
    kind = "struct<value:string,n:int,first:int>"
    placed = F.sort_array(F.transform(xs, lambda x, i: F.struct(x.alias("value"), i.alias("at"))))
    # sorted by value and place: a value's first row starts a run, which ends where the next one starts
    starts = bound(placed, lambda p: F.filter(F.transform(p, lambda x, i: F.struct(x["value"].alias("value"), x["at"].alias("first"), i.alias("i"), ((i == 0) | (x["value"] != F.get(p, i - 1)["value"])).alias("new"))), lambda x: x["new"]))
    return bound(F.struct(starts.alias("s"), F.size(xs).alias("n")), lambda r: F.transform(r["s"], lambda x, k: F.struct(x["value"].alias("value"), (F.coalesce(F.get(r["s"], k + 1)["i"], r["n"]) - x["i"]).alias("n"), x["first"].alias("first")).cast(kind)))


#: Word runs, and everything else one by one: joined again, tokens give the text.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"
WORD_RUN = r"^[\p{L}\p{N}_]"


def folded(c: Column) -> Column:
    """A token as a search without regard to case sees it; its length may differ from the token's."""
    return F.translate(F.lower(F.translate(c, "İ", "i")), "ıſς", "isσ")


def places(n: Column) -> Column:
    """0 to n - 1; none for n of 0 and less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_grams(df: DataFrame, keys: str, lengths: list[int], name: str = "grams") -> DataFrame:
    """df with all runs of k elements of an array of strings, for each k of lengths, as structs (k, h, at).

    h is a hash of the run; equal runs have equal ones. Runs of 1, 2, 4, ... elements are hashed from two halves each, and
    any other length from those, so the work for a length is the array's length times at most its number of binary digits.
    """
    high = max(lengths).bit_length() - 1

    def run(k: int, n: Column, powers: list[Column]) -> Column:
        def h(i: Column) -> Column:
            value, at = None, 0
            for j in range(high, -1, -1):
                if k >> j & 1:
                    part = F.get(powers[j], i + at)
                    value, at = part if value is None else F.xxhash64(value, part), at + (1 << j)
            return value

        return F.transform(places(n - (k - 1)), lambda i: F.struct(F.lit(k).alias("k"), h(i).alias("h"), i.alias("at")))

    def grown(powers: list[Column]) -> Column:
        last, half = powers[-1], 1 << (len(powers) - 1)
        if len(powers) > high:
            return F.concat(*[run(k, F.size(powers[0]), powers) for k in lengths])
        doubled = F.transform(places(F.size(last) - half), lambda i: F.xxhash64(F.get(last, i), F.get(last, i + half)))
        return bound(doubled, lambda p: grown([*powers, p]))

    # bound, as a column would be worked out anew for each element that looks at it
    return df.withColumn(name, bound(F.transform(keys, lambda x: F.xxhash64(x)), lambda p: grown([p])))
