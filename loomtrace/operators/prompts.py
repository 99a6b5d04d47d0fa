"""Prompts for a text classifier, and its answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that the classifier is asked with.
SYSTEM_PROMPT = """You are a system-log anomaly classifier.
Classify one complete HDFS BlockId event sequence as NORMAL or ANOMALY.
Historical references, when provided, are training sequences with their ground-truth labels.
Use each reference's NORMAL or ANOMALY label when comparing it with the query.
Pay attention to missing, additional, repeated, or differently ordered events.
Return valid JSON only."""
REFERENCES_HEAD, QUERY_HEAD = "LABELED HISTORICAL REFERENCES:\n", "QUERY BLOCK SEQUENCE:\n"
ANSWER_FORM = '{"label":"NORMAL or ANOMALY","reason":"one short sentence"}'
REMINDER = f"Return valid JSON only: {ANSWER_FORM}."
INVALID = "INVALID_OUTPUT"


def references(contexts: Column) -> Column:
    """Numbered references of an array of structs ``label``, ``text``; a null label is left out of the heading; NONE
    without any."""
    each = F.transform(
        contexts,
        lambda c, i: F.concat(F.lit("REFERENCE "), (i + 1).cast("string"), F.coalesce(F.concat(F.lit(" — LABEL: "), c["label"]), F.lit(":")), F.lit("\n"), c["text"]),
    )
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) > 0, F.array_join(each, "\n\n")).otherwise("NONE")


def messages(query_text: Column, contexts: Column) -> Column:
    """System and user message, ``role`` and ``content``."""
    user = F.concat(F.lit(REFERENCES_HEAD), references(contexts), F.lit(f"\n\n{QUERY_HEAD}"), query_text, F.lit(f"\n\nReturn: {ANSWER_FORM}"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user))


def single_input(chat: Column) -> Column:
    """A chat as one text, for services without roles."""
    return F.array_join(F.transform(chat, lambda m: F.concat(F.upper(F.coalesce(m["role"], F.lit("user"))), F.lit(":\n"), F.coalesce(m["content"], F.lit("")))), "\n\n")


def parsed_answer(text: Column) -> Column:
    """``label`` and ``reason`` of an answer: its fenced block, else its outermost braces, as JSON. INVALID_OUTPUT with
    an empty reason for anything that has no NORMAL or ANOMALY label or no reason."""
    blanks = F.lit(" \t\r\n")
    trimmed = F.btrim(text, blanks)
    fenced = F.regexp_extract(trimmed, r"(?is)\A```(?:json)?\s*(.*?)\s*```\z", 1)
    inside = F.regexp_extract(trimmed, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).when(inside != "", inside).otherwise(trimmed)
    label = F.upper(F.btrim(F.get_json_object(body, "$.label"), blanks))
    reason = F.btrim(F.get_json_object(body, "$.reason"), blanks)
    valid = F.coalesce(label.isin("NORMAL", "ANOMALY") & (reason != ""), F.lit(False))
    return F.struct(F.when(valid, label).otherwise(INVALID).alias("label"), F.when(valid, reason).otherwise("").alias("reason"))


def response_text(payload: Column, form: str) -> Column:
    """The answer's text in a service's JSON response, '' where there is none; ``form`` is ``input_text`` or
    ``chat_completions``."""
    if form == "input_text":
        items = F.from_json(payload, "struct<output:array<struct<type:string,content:string>>>")["output"]
        found = F.filter(items, lambda x: (x["type"] == "message") & (F.coalesce(x["content"], F.lit("")) != ""))
        return F.coalesce(F.get(found, F.lit(0))["content"], F.lit(""))
    return F.coalesce(F.get_json_object(payload, "$.choices[0].message.content"), F.lit(""))


def request_key(**fields: Column) -> Column:
    """SHA-256 of a request's fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields))), {"ignoreNullFields": "false"}).cast("binary"), 256)
