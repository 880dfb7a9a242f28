"""Regex spans with code-point offsets, as column expressions only.

``regexp_extract_all`` gives the matches and ``split`` by the same pattern the
gaps between them.  They alternate (gap 0, match 0, gap 1, ...), so running
sums of their lengths are the offsets.  ``length`` counts code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running values are made in blocks of this many, whose totals are run over in blocks again.
BLOCK = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def running(xs: Column, op: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """What ``op`` (associative, 0 neutral, on integers) makes of all elements before each one, 0 for the first.

    A block's fold copies what it has at every step, so the work is elements x BLOCK plus the square of
    elements / BLOCK^levels.  ``xs`` must not be null or empty.
    """
    def fold(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(op(F.get(a, F.size(a) - 1), x))))

    if not levels:
        return bound(fold(xs), lambda v: F.slice(v, F.lit(1), F.size(v) - 1))

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / F.lit(BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

    def joined_up(w: Column) -> Column:
        before = running(F.transform(w, lambda b: F.get(b, F.size(b) - 1)), op, levels - 1)
        return F.flatten(F.zip_with(w, before, lambda b, t: F.transform(
            F.slice(b, F.lit(1), F.size(b) - 1), lambda x: op(t, x))))

    return bound(bound(xs, blocks), joined_up)


def raw_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<i, start, end, match, part, before, after>>, null if nothing matches.

    ``pattern`` must never match the empty string.  ``part`` is the capture
    group ``group`` of the match, ``before`` / ``after`` up to 40 / 8 characters of
    the gap around it (never reaching into a neighbouring match).  Null text gives null.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    found = F.when(F.size(matches) > 0, F.struct(
        matches.alias("m"), parts.alias("p"), F.split(text, pattern, -1).alias("g")))
    # one-element array + transform: the three arrays are evaluated once per row
    return F.flatten(F.transform(F.filter(F.array(found), lambda x: x.isNotNull()), _offsets))


def _offsets(x: Column) -> Column:
    sizes = F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), x["m"], lambda g, m: F.length(g) + F.length(m))
    packed = F.struct(running(sizes, lambda a, b: a + b).alias("pre"), x["m"].alias("m"), x["p"].alias("p"), x["g"].alias("g"))

    def one(y: Column) -> Column:
        def at(i: Column) -> Column:
            start = F.get(y["pre"], i) + F.length(F.get(y["g"], i))
            return F.struct(
                i.alias("i"), start.alias("start"), (start + F.length(F.get(y["m"], i))).alias("end"),
                F.get(y["m"], i).alias("match"), F.get(y["p"], i).alias("part"),
                F.substring(F.get(y["g"], i), -40, 40).alias("before"),
                F.substring(F.get(y["g"], i + 1), 1, 8).alias("after"))

        return F.transform(F.sequence(F.lit(0), F.size(y["m"]) - 1), at)

    return bound(packed, one)


def apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of ``others``, both arrays of structs with start and end, sorted.

    One sorted list of the others' starts and the spans' ends: the furthest end of the others
    that start before a span's end tells whether one reaches into it.
    """
    none = F.lit(None).cast("boolean")
    starts = F.transform(others, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("turn"), b["end"].alias("reach"),
                                                    F.when(none, F.get(spans, 0)).alias("span")))
    ends = F.transform(spans, lambda w: F.struct(w["end"].alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("reach"),
                                                 w.alias("span")))

    def free(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), F.greatest)
        judged = F.zip_with(events, reach, lambda e, r: F.struct(e["span"].alias("span"), (r <= e["span"]["start"]).alias("free")))
        return F.array_sort(F.transform(F.filter(judged, lambda j: j["free"]), lambda j: j["span"]))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), bound(F.array_sort(F.concat(starts, ends)), free)).otherwise(spans)


#: Code points in a stretch of a text that is cut at many places.
STRETCH = 1024


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with ``mark(span)`` for every span (structs with start and end, sorted by start);
    of spans that overlap, the first one's mark stands for all.  Linear: the text is cut into stretches once."""
    def piece(parts: Column, start: Column, end: Column) -> Column:
        def part(c: Column) -> Column:
            low = F.greatest(start - c * STRETCH, F.lit(0))
            return F.substr(F.get(parts, c), low + 1, F.least(end - c * STRETCH, F.lit(STRETCH)) - low)

        first, last = (F.floor(x / F.lit(STRETCH)).cast("int") for x in (start, end - 1))
        return F.when(start < end, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

    def pieces(v: Column) -> Column:
        reach = running(F.transform(v["spans"], lambda s: s["end"]), F.greatest)
        kept = F.zip_with(v["spans"], reach, lambda s, r: F.when(
            s["start"] >= r, F.concat(piece(v["parts"], r, s["start"]), mark(s))).otherwise(""))
        rest = piece(v["parts"], F.array_max(F.transform(v["spans"], lambda s: s["end"])), v["size"])
        return F.concat(F.array_join(kept, ""), rest)

    parts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}+" % STRETCH), F.lit(0))
    packed = F.struct(parts.alias("parts"), spans.alias("spans"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, bound(packed, pieces)).otherwise(text)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn checksum of a string of digits."""
    rev = F.reverse(d)

    def add(a: Column, i: Column) -> Column:
        v = F.substr(rev, i, F.lit(1)).cast("int")
        twice = v * 2
        return a + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def ip_parts_ok(s: Column) -> Column:
    """Every dotted part at most 255 (leading zeros allowed, any length)."""
    return F.forall(F.split(s, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                    & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` comma-joined; ``spans`` sorted as (start, kind number, end, ...) structs."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
