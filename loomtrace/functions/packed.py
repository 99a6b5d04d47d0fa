"""Packed lists: several values in one text field, in any of many packings, as JVM-side column expressions.

A packed list is a text of values in order, as a whole optionally in one matching pair of brackets, each value
optionally in quotes, set apart by separators that may differ within the field. A comma inside a quoted number is
its decimal point; nothing between two separators, or outside the first or last of them, is an empty value.

The text is split on its runs of quote characters: pieces at odd places are literals, pieces at even places hold
separators and bare values. Even pieces have their separators replaced by one mark, the pieces are joined again
and split on that mark, so that position in the resulting array is the value's ordinal. All steps take time in
proportion to the text; texts in the plain packing skip them.

Blanks (spaces, tabs, line ends) between two values separate them only where no other separator stands, so a run
of blanks never holds an empty value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brackets, quotes, blanks and separators of packed lists.
OPENING, CLOSING = "[({<", "])}>"
QUOTES = "\"'`“”„‘’‚«»"
BLANKS = " \t\r\n\f\u000b\u00a0\ufeff"
SEPARATORS, WEAK_SEPARATORS = ",;|，；、｜", "/:\\&~•·"
ARROWS = ("->", "=>", "→")
LAST_EVENT = 29

_BLANK = r"[\s\u00a0\ufeff]"
_QUOTE = f"[{QUOTES}]"
_WEAK = "[" + WEAK_SEPARATORS.replace("\\", "\\\\").replace("&", "\\&") + "]"
#: A weak separator between the letter E and a number is that event id's punctuation.
_SEPARATOR = rf"{_BLANK}*(?:{'|'.join(ARROWS)}|[{SEPARATORS}]|(?!(?<=[Ee]){_WEAK}\d){_WEAK}){_BLANK}*|{_BLANK}+"
_PAIRED_LITERAL = rf"([\"'`]+)[^{QUOTES}]*\1|[“„][^{QUOTES}]*[”“]|[‘‚][^{QUOTES}]*[’‘]|«[^{QUOTES}]*»"
_LITERAL, _SPLIT, _NO_VALUE = "\u0001", "\u0002", "?"
_EVENT = rf"^{_LITERAL}?{_BLANK}*[Ee][\p{{P}}\p{{S}}&&[^\[\](){{}}<>{QUOTES}]]*0*([1-9][0-9]?){_BLANK}*{_LITERAL}?\z"
_NUMBER = rf"^{_LITERAL}?{_BLANK}*(\+?[0-9]+\.?[0-9]*|\+?\.[0-9]+|-0+\.?0*){_BLANK}*{_LITERAL}?\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _general(text: Column, value_pattern: str, prefix: str) -> Column:
    """Values of any packing, each in plain spelling or ``?`` where it is no value, joined by commas; null
    where brackets or quotes are unpaired."""

    def of_inner(inner: Column) -> Column:
        def of_pieces(pieces: Column) -> Column:
            marked = F.array_join(
                F.transform(
                    pieces,
                    lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(_LITERAL), F.translate(p, ",", "."), F.lit(_LITERAL))).otherwise(
                        F.regexp_replace(p, _SEPARATOR, _SPLIT)
                    ),
                ),
                "",
            )
            values = F.transform(F.split(marked, _SPLIT, -1), lambda v: let(F.regexp_extract(v, value_pattern, 1), lambda x: F.when(x == "", _NO_VALUE).otherwise(F.concat(F.lit(prefix), x))))
            return (
                F.when(F.size(pieces) % 2 == 0, F.lit(None).cast("string"))
                .when((F.size(pieces) > 1) & F.regexp_replace(inner, _PAIRED_LITERAL, "").rlike(_QUOTE), F.lit(None).cast("string"))
                .otherwise(F.array_join(values, ","))
            )

        return F.when(inner == "", F.lit("")).otherwise(let(F.split(inner, f"{_QUOTE}+", -1), of_pieces))

    def of_text(t: Column) -> Column:
        first, last = F.left(t, F.lit(1)), F.right(t, F.lit(1))
        opened = F.when(t == "", 0).otherwise(F.instr(F.lit(OPENING), first))
        closed = F.when(t == "", 0).otherwise(F.instr(F.lit(CLOSING), last))
        inner = F.when((opened > 0) & (opened == closed) & (F.length(t) >= 2), F.btrim(t.substr(F.lit(2), F.length(t) - 2), F.lit(BLANKS))).when(
            (opened == 0) & (closed == 0), t
        )
        return let(inner, lambda x: F.when(x.isNotNull(), of_inner(x)))

    # marks of our own can't stand in a value
    return let(F.btrim(F.translate(text, _LITERAL + _SPLIT, "??"), F.lit(BLANKS)), of_text)


def event_values(text: Column) -> Column:
    """The ids of a packed list of event ids as one comma-joined text of ``E<number>``; null where the text is null
    or its brackets or quotes are unpaired, ``?`` where a value is no event id, '' for no value."""
    body = text.substr(F.lit(2), F.length(text) - 2)
    bare = F.replace(F.replace(text.substr(F.lit(3), F.length(text) - 4), F.lit('", "'), F.lit(",")), F.lit('","'), F.lit(","))
    short = ~text.rlike("E0|[0-9]{3}")  # other spellings are for the general way to judge
    json_like = short & text.rlike(r'^\["[E0-9", ]*"\]\z')
    return (
        F.when(short & text.rlike(r"^\[[E0-9,]*\]\z"), body)
        .when(json_like & bare.rlike(r"^[E0-9,]+\z"), bare)
        .when(text.isNotNull(), _general(text, _EVENT, "E"))
    )


def number_values(text: Column) -> Column:
    """The numbers of a packed list, joined by commas; null, empty and ``?`` as in `event_values`, for values that are no
    decimal number of at least 0."""
    body = text.substr(F.lit(2), F.length(text) - 2)
    return F.when(text.rlike(r"^\[[0-9.,]*\]\z"), body).when(text.isNotNull(), _general(text, _NUMBER, ""))


def event_numbers(values: Column, names: Sequence[int] | None = None) -> Column:
    """Event numbers of the text made by `event_values`, with null for a value that is no event id.

    ``names`` replaces number n by ``names[n]``, for events that are the same under several numbers."""
    names = list(names) if names else list(range(LAST_EVENT + 1))
    table = F.array(F.lit(None).cast("int"), *(F.lit(n) for n in names[1:]))
    numbers = F.transform(F.split(values, ","), lambda x: F.when(x.startswith("E"), F.get(table, F.substr(x, F.lit(2)).try_cast("int"))))
    return F.when(values == "", F.array().cast("array<int>")).otherwise(numbers)


def gap_numbers(values: Column) -> Column:
    """Doubles of the text made by `number_values`, with null for a value that is no number."""
    return F.when(values == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(values, ","), lambda x: x.try_cast("double")))


def is_plain(text: Column, values: Column) -> Column:
    """Whether a readable list stands in square brackets with single commas and without blank or quote."""
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    return (
        text.startswith("[")
        & text.endswith("]")
        & ~text.rlike(rf"{_BLANK}|{_QUOTE}")
        & ((values == "") | (F.size(F.split(values, ",")) == commas + 1))
    )
