"""SQL that reads packed lists by regular expressions, as a second way to the rows of the packing queries."""

from __future__ import annotations

_BLANK = r"[ \t\r\n]"
_PUNCTUATION = r"[!#$%&*+,./:;=?@^_|~-]"
_NUMBER = r"(?:\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)|-0+(?:\.0*)?)"


def _quoted(value: str, inside: str) -> str:
    return "(?:" + "|".join([value, *(rf"{q}{_BLANK}*{inside}{_BLANK}*{q}" for q in ('"', "''", '""', "`"))]) + ")"


def _list(value: str) -> str:
    # a blank separates too; between two values there must be something
    gap = rf"(?:{_BLANK}*(?:->|=>|[,;|/:]){_BLANK}*|{_BLANK}+)"
    body = rf"{_BLANK}*{value}(?:{gap}{value})*{_BLANK}*"
    whole = "|".join(rf"{a}{body}{b}" for a, b in ((r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"), ("<", ">"), ("", "")))
    return rf"{_BLANK}*(?:{whole}){_BLANK}*"


_EVENT = rf"[Ee]{_PUNCTUATION}*0*(?:[12][0-9]|[1-9])"
EVENT_LIST = _list(_quoted(rf"[Ee][_#.-]*0*(?:[12][0-9]|[1-9])", _EVENT))
NUMBER_LIST = _list(_quoted(_NUMBER, rf"(?:{_NUMBER}|[0-9]+,[0-9]*)"))
EMPTY_LIST = rf"{_BLANK}*(?:\[{_BLANK}*\]|\({_BLANK}*\)|\{{{_BLANK}*\}}|<{_BLANK}*>)?{_BLANK}*"

def events_sql(column: str) -> str:
    """Events of a text that is an event list, else null."""
    return f"CASE WHEN regexp_full_match({column}, '{EVENT_LIST}') THEN list_transform(regexp_extract_all({column}, '[Ee][^0-9A-Za-z]*0*([1-9][0-9]?)', 1), lambda x: x::INT) END"


def numbers_sql(column: str) -> str:
    """Texts of the numbers of a number list, with points; empty for a list without values; else null."""
    pointed = rf"regexp_replace({column}, '([\"''`]{_BLANK}*[0-9]+),([0-9]*{_BLANK}*[\"''`])', '\1.\2', 'g')"
    return f"CASE WHEN regexp_full_match({column}, '{NUMBER_LIST}') THEN regexp_extract_all({pointed}, '[0-9.]+') WHEN regexp_full_match({column}, '{EMPTY_LIST}') THEN []::VARCHAR[] END"


TYPED = f"""
typed AS (SELECT *, {events_sql("f")} AS events, {numbers_sql("g")} AS gap_texts FROM texts),
judged AS (SELECT *, CASE WHEN events IS NULL OR len(events) = 0 THEN 'features'
  WHEN gap_texts IS NULL OR len(gap_texts) <> len(events) - 1 OR isinf(coalesce(list_sum(list_transform(gap_texts, lambda x: x::DOUBLE)), 0)) THEN 'interval'
  WHEN l IS NULL OR isnan(l) OR isinf(l) OR l < 0 OR abs(l - coalesce(list_sum(list_transform(gap_texts, lambda x: x::DOUBLE)), 0)) > 1e-6 THEN 'latency' END AS fault FROM typed)"""

TRACES = "texts AS (SELECT row_id, Features AS f, TimeInterval AS g, Latency AS l FROM event_traces)," + TYPED

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _nth(i: int) -> str:
    field = f"regexp_extract(t, '^(?:{_FIELD},){{{i}}}({_FIELD})', 1, 's')"
    return f"CASE WHEN starts_with({field}, '\"') THEN replace({field}[2:length({field})-1], '\"\"', '\"') ELSE {field} END"


LINES = f"""lines AS (SELECT line_id AS row_id, regexp_replace(line, '(\\r\\n|\\n|\\r)$', '') AS t FROM raw_trace_lines),
shaped AS (SELECT row_id, t, t IS NOT NULL AND NOT regexp_full_match(t, '{_FIELD}(?:,{_FIELD})*', 's') AS quoting FROM lines),
counted AS (SELECT *, CASE WHEN NOT quoting THEN length(x) - length(replace(x, ',', '')) + 1 END AS n FROM (SELECT *, regexp_replace(t, '"(?:[^"]|"")*"', 'q', 'gs') AS x FROM shaped)),
texts AS (SELECT row_id, quoting, n, CASE WHEN n = 6 THEN {_nth(3)} END AS f, CASE WHEN n = 6 THEN {_nth(4)} END AS g,
  CASE WHEN n = 6 AND regexp_full_match({_nth(5)}, '\\s*[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?\\s*') THEN try_cast(trim({_nth(5)}) AS DOUBLE) END AS l FROM counted)""" + ","

P5_FOUND = f"""SELECT * FROM (WITH {TRACES} SELECT 'event_traces' AS src, row_id, fault AS reason FROM judged WHERE fault IS NOT NULL)
UNION ALL SELECT * FROM (WITH {LINES}{TYPED} SELECT 'raw_trace_lines' AS src, row_id, CASE WHEN quoting THEN 'quoting' WHEN n IS NULL OR n <> 6 THEN 'columns' ELSE fault END AS reason FROM judged WHERE quoting OR n IS NULL OR n <> 6 OR fault IS NOT NULL)"""

_THREE = "list_transform(gap_texts, lambda x: CASE WHEN starts_with(x, '.') THEN '0' || x ELSE x END::DECIMAL(38, 3)::VARCHAR)"
_LISTS = f"array_to_string(list_transform(events, lambda x: 'E' || x), ' ') AS events, array_to_string({_THREE}, ' ') AS gaps, l AS latency"
P5_LOADED = f"""SELECT * FROM (WITH {TRACES} SELECT 'event_traces' AS src, row_id, BlockId, Label, Type, {_LISTS} FROM judged JOIN event_traces USING (row_id) WHERE fault IS NULL)
UNION ALL SELECT * FROM (WITH {LINES}{TYPED} SELECT 'raw_trace_lines' AS src, judged.row_id, {_nth(0)} AS BlockId, {_nth(1)} AS Label, {_nth(2)} AS Type, {_LISTS} FROM judged JOIN shaped ON shaped.row_id = judged.row_id WHERE NOT judged.quoting AND n = 6 AND fault IS NULL)"""

_VALUES = f"""WITH {TRACES},
lists AS (SELECT row_id, 'Features' AS field, f AS text, list_transform(events, lambda x: 'E' || x) AS v FROM judged WHERE fault IS NULL
  UNION ALL SELECT row_id, 'TimeInterval', g, {_THREE} FROM judged WHERE fault IS NULL),
flat AS (SELECT row_id, field, text, unnest(v) AS value, (generate_subscripts(v, 1) - 1)::INT AS pos FROM lists)"""
P3_VALUES = _VALUES + " SELECT row_id, field, pos, value FROM flat"
P3_FOUND = _VALUES + r""" SELECT row_id, field, pos, value FROM flat WHERE NOT regexp_full_match(text, '\[[^ \t\r\n"''`,;|/:>]*(?:,[^ \t\r\n"''`,;|/:>]+)*\]')"""

#: The same event: numbers whose templates agree apart from case, blanks and punctuation, named by the smallest.
NAMES = r"""names AS (SELECT a.n, min(b.n) AS name FROM (SELECT EventId[2:]::INT AS n, regexp_replace(lower(EventTemplate), '[^0-9a-z]', '', 'g') AS k FROM hdfs_log_templates) a
 JOIN (SELECT EventId[2:]::INT AS n, regexp_replace(lower(EventTemplate), '[^0-9a-z]', '', 'g') AS k FROM hdfs_log_templates) b USING (k) GROUP BY a.n)"""
