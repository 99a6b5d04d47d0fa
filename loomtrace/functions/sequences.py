"""Column functions on event sequences (arrays of event ids). None of them needs a Python worker."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.functions.packed import LAST_EVENT

GRAM_SEPARATOR = "\u001f"
BLANKS = " \t\r\n"


def bracket_list(text: Column) -> Column:
    """The trimmed items of ``[a,b,...]``; empty for ``[]``; null for null, for a text without both brackets and for one
    with an empty item."""
    body = text.substr(F.lit(2), F.length(text) - 2)
    items = F.transform(F.split(body, ","), lambda x: F.btrim(x, F.lit(BLANKS)))
    closed = text.startswith("[") & text.endswith("]") & (F.length(text) >= 2)
    return F.when(closed & (F.btrim(body, F.lit(BLANKS)) == ""), F.array().cast("array<string>")).when(closed & ~F.array_contains(items, ""), items)


def number_list(text: Column) -> Column:
    """A `bracket_list` as doubles, with null for an item that is no number; null where the list is malformed."""
    return F.transform(bracket_list(text), lambda x: x.try_cast("double"))


def trace_signature(events: Column) -> Column:
    """SHA-256 of the compact JSON array; order and repetition count."""
    return F.sha2(F.to_json(events).cast("binary"), 256)


def spaced_json(events: Column) -> Column:
    """A JSON array with a blank behind each comma; ids must not need escaping."""
    return F.concat(F.lit("["), F.array_join(F.transform(events, lambda e: F.concat(F.lit('"'), e, F.lit('"'))), ", "), F.lit("]"))


def knowledge_id(label: Column, events: Column) -> Column:
    """``normal_`` or ``anomaly_`` and 16 hex digits of the SHA-1 of the spaced JSON array."""
    return F.concat(F.lower(label), F.lit("_"), F.left(F.sha1(spaced_json(events)), F.lit(16)))


def pairs(events: Column) -> Column:
    """Neighbouring events as structs ``a``, ``b``; empty for fewer than two events."""
    return F.when(
        F.size(events) > 1,
        F.transform(F.sequence(F.lit(0), F.size(events) - 2), lambda i: F.struct(F.get(events, i).alias("a"), F.get(events, i + 1).alias("b"))),
    ).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def run_lengths(events: Column) -> Column:
    """Runs of equal neighbours as structs ``event``, ``n``, found from the places where runs start."""
    size = F.size(events)
    starts = F.when(
        size > 0, F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(events, i) != F.get(events, i - 1)))
    ).otherwise(F.array().cast("array<int>"))
    return F.get(
        F.transform(
            F.array(starts),
            lambda s: F.transform(s, lambda at, k: F.struct(F.get(events, at).alias("event"), (F.coalesce(F.get(s, k + 1), size) - at).alias("n"))),
        ),
        F.lit(0),
    )


def rendered_trace(events: Column, templates: Mapping[str, str]) -> Column:
    """The text of a trace: the definition of each event in order of first appearance, then the events in order with
    runs folded. It never holds a label. Null where an event has no template."""
    table = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair)) if templates else F.lit(None).cast("map<string,string>")
    distinct = F.array_distinct(events)
    lines = F.transform(distinct, lambda e: F.concat(e, F.lit(": "), F.element_at(table, e)))
    runs = F.transform(run_lengths(events), lambda r: F.when(r["n"] == 1, r["event"]).otherwise(F.concat(r["event"], F.lit(" × "), r["n"].cast("string"))))
    text = F.concat(F.lit("EVENT DEFINITIONS:\n"), F.array_join(lines, "\n"), F.lit("\n\nORDERED TRACE:\n"), F.array_join(runs, " → "))
    return F.when(~F.exists(lines, lambda x: x.isNull()), text)


def template_text(events: Column, templates: Mapping[str, str]) -> Column:
    """One line ``id: template`` per event, in order."""
    table = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair))
    return F.array_join(F.transform(events, lambda e: F.concat(e, F.lit(": "), F.element_at(table, e))), "\n")


def ngrams(events: Column, smallest: int = 2, largest: int = 3) -> Column:
    """All n-grams of ``smallest`` to ``largest`` events, joined by the unit separator; the events themselves where the
    sequence is shorter than every n."""
    size = F.size(events)

    def of_size(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(events, i, n), GRAM_SEPARATOR))
        return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.when(size < smallest, events).otherwise(F.concat(*(of_size(n) for n in range(smallest, largest + 1))))


def gram_bucket(gram: Column, buckets: int) -> Column:
    """A place in a hashed vector: the first 15 hex digits of the MD5, modulo the number of places."""
    return F.pmod(F.conv(F.left(F.md5(gram.cast("binary")), F.lit(15)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def blake_bucket(buckets: int):
    """The place in a hashed vector by BLAKE2b (8 bytes, big-endian), for vectors that must equal those of other
    programs. A Pandas UDF on arrays of n-grams, since there is no such built-in; `gram_bucket` is the fast way."""
    import hashlib

    import pandas as pd

    @F.pandas_udf("array<int>")
    def places(grams):
        known: dict[str, int] = {}

        def place(gram: str) -> int:
            if gram not in known:
                known[gram] = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big") % buckets
            return known[gram]

        return grams.map(lambda own: None if own is None else [place(g) for g in own])

    return places


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct events; 1 for two empty sequences."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def event_bits(events: Column) -> Column:
    """The distinct events of a sequence as bits of a BIGINT; an id other than E1 to the last event's is an error."""
    number = lambda e: F.when(e.startswith("E"), F.substr(e, F.lit(2)).try_cast("int"))
    bit = lambda e: F.when(number(e).between(1, LAST_EVENT), F.call_function("shiftleft", F.lit(1).cast("long"), number(e))).otherwise(F.raise_error(F.concat(F.lit("no event id: "), F.coalesce(e, F.lit("null")))).cast("long"))
    return F.aggregate(events, F.lit(0).cast("long"), lambda bits, e: bits.bitwiseOR(bit(e)))


def jaccard_bits(a: Column, b: Column, decimals: int) -> Column:
    """The `jaccard` of two `event_bits`, rounded: looked up by the numbers of common and of all events, since rounding
    costs far more than counting bits."""
    shares = F.array(F.lit(1.0), *(F.round(F.lit(common) / F.lit(every), decimals) for every in range(1, LAST_EVENT + 1) for common in range(every + 1)))
    common, every = F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))
    return F.get(shares, F.call_function("shiftright", every * (every + 1), F.lit(1)) + common)


def lcs_share(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence over the longer length; 1 for two empty sequences, 0 for one.

    One row of the table of lengths is kept; it is rebuilt for each event of ``a``."""
    start = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda made, j: F.concat(
                made, F.array(F.when(F.get(b, j - 1) == x, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(made, j - 1))))
            ),
        )

    length = F.element_at(F.aggregate(a, start, next_row), -1)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(length / F.greatest(F.size(a), F.size(b)))
    )


def hash_part(text: Column, parts: int = 100) -> Column:
    """A number from 0 below ``parts`` that depends on the text alone."""
    return F.pmod(F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("long"), F.lit(parts))
