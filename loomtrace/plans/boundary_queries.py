"""Queries on prompts, answers, stand-in models, files and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.sequences import template_text
from loomtrace.operators import classify as C
from loomtrace.operators import prompts as M
from loomtrace.operators import splits as S
from loomtrace.plans.base import TRACES_SQL, held_traces, signed, templates
from loomtrace.sources import files
from loomtrace.sources.tables import table
from loomtrace.streaming.blocks import session_traces

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T = "WITH " + TRACES_SQL


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Answers as services give them, sound and broken, from the labels and ids of all rows of block_sequences."""
    label, kind = F.coalesce("label", F.lit("null")), F.col("row_id") % 6
    answer = lambda *fields: F.to_json(F.struct(label.alias("label"), *fields))
    sound = answer(F.concat(F.lit("block "), F.coalesce("block_id", F.lit("?"))).alias("reason"))
    text = (
        F.when(kind == 0, sound).when(kind == 1, F.concat(F.lit("```json\n"), sound, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I think "), sound, F.lit(" fits.")))
        .when(kind == 3, answer()).when(kind == 4, label).otherwise(answer(F.lit(" ").alias("reason")))
    )
    return table(s, d, "block_sequences").select("row_id", "block_id", text.alias("text"))


def _parsed(answers: DataFrame) -> DataFrame:
    return answers.withColumn("x", M.parsed_answer(F.col("text"))).select("row_id", "x.label", "x.reason")


query("parse_llm_output", """SELECT row_id, CASE WHEN row_id % 6 <= 2 AND upper(trim(label)) IN ('NORMAL', 'ANOMALY') THEN upper(trim(label)) ELSE 'INVALID_OUTPUT' END AS label,
 CASE WHEN row_id % 6 <= 2 AND upper(trim(label)) IN ('NORMAL', 'ANOMALY') THEN 'block ' || coalesce(block_id, '?') ELSE '' END AS reason
 FROM block_sequences WHERE block_id IS NULL OR NOT regexp_matches(block_id, '[\\s"]')""")(
    lambda s, d: _parsed(_answers(s, d).where("block_id IS NULL OR NOT block_id RLIKE '[\\\\s\"]'"))  # as the SQL
)
query("parse_llm_output_all")(lambda s, d: _parsed(_answers(s, d)))


def _chats(s: SparkSession, d: str) -> DataFrame:
    """A prompt for each test sequence, with the two most frequent normal and anomalous training sequences."""
    rows = S.hash_split(signed(held_traces(s, d)))
    text = lambda df: df.withColumn("text", template_text(F.col("event_ids"), templates(s, d)))
    train = rows.where("split = 'train'").groupBy("label", "sig").agg(F.count("*").alias("n"), F.any_value("event_ids").alias("event_ids"))
    best = None
    for label in ("Normal", "Anomaly"):
        two = text(train.where(F.col("label") == label).orderBy(F.desc("n"), "sig").limit(2)).select(F.upper("label").alias("label"), "n", "sig", "text")
        best = two if best is None else best.unionByName(two)
    contexts = best.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.when(F.col("label") == "NORMAL", 0).otherwise(1).alias("o"), (-F.col("n")).alias("m"), "sig", "label", "text"))), lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"))).alias("contexts"))
    asked = text(rows.where("split = 'test'").groupBy("sig").agg(F.any_value("event_ids").alias("event_ids"), F.min("block_id").alias("block_id")))
    return asked.join(F.broadcast(contexts)).select("block_id", M.messages(F.col("text"), F.col("contexts")).alias("chat"))  # one row of four contexts


_CHAT = T + """,
 train AS (SELECT label, sig, count(*) AS n, any_value(event_ids) AS event_ids FROM splits WHERE split = 'train' GROUP BY label, sig),
 best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, sig) AS r FROM train QUALIFY r <= 2),
 asked AS (SELECT sig, any_value(event_ids) AS event_ids, min(block_id) AS block_id FROM splits WHERE split = 'test' GROUP BY sig),
 every AS (SELECT 'b' || label || sig AS id, event_ids FROM best UNION ALL SELECT block_id, event_ids FROM asked),
 flat AS (SELECT id, unnest(event_ids) AS e, generate_subscripts(event_ids, 1) AS i FROM every),
 texts AS (SELECT id, string_agg(e || ': ' || EventTemplate, chr(10) ORDER BY i) AS text FROM flat JOIN hdfs_log_templates ON EventId = e GROUP BY id),
 refs AS (SELECT string_agg('REFERENCE ' || o || ' — LABEL: ' || upper(label) || chr(10) || text, chr(10) || chr(10) ORDER BY o) AS refs FROM
   (SELECT label, text, row_number() OVER (ORDER BY label DESC, n DESC, sig) AS o FROM best JOIN texts ON id = 'b' || label || sig))"""
query("build_messages", _CHAT + """ SELECT block_id, md5('LABELED HISTORICAL REFERENCES:' || chr(10) || refs || chr(10) || chr(10) || 'QUERY BLOCK SEQUENCE:' || chr(10) || text || chr(10) || chr(10) || 'Return: {"label":"NORMAL or ANOMALY","reason":"one short sentence"}') AS user_md5
 FROM asked JOIN texts ON id = block_id, refs""")(lambda s, d: _chats(s, d).select("block_id", F.md5(F.get("chat", F.lit(1))["content"].cast("binary")).alias("user_md5")))
query("messages_to_input", _CHAT + f""" SELECT block_id, md5('SYSTEM:' || chr(10) || '{M.SYSTEM_PROMPT.replace("'", "''")}' || chr(10) || chr(10) || 'USER:' || chr(10) || 'LABELED HISTORICAL REFERENCES:' || chr(10) || refs || chr(10) || chr(10) || 'QUERY BLOCK SEQUENCE:' || chr(10) || text || chr(10) || chr(10) || 'Return: {{"label":"NORMAL or ANOMALY","reason":"one short sentence"}}') AS input_md5
 FROM asked JOIN texts ON id = block_id, refs""")(lambda s, d: _chats(s, d).select("block_id", F.md5(M.single_input(F.col("chat")).cast("binary")).alias("input_md5")))
query("llm_classify_stub")(lambda s, d: C.classify(_chats(s, d), "stub")[0].select("block_id", "prediction", "reason", "prompt_tokens", "request_count", "cache_hit"))
query("encode_stub")(lambda s, d: C.encode_texts(table(s, d, "normal_knowledge_base"), "trace_id", "template_text"))
query("file_inventory")(lambda s, d: files.inventory(s, d))
query("file_sha256")(lambda s, d: files.provenance(s, d))
query("session_traces", """WITH e AS (SELECT user_id, ts, event_type, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
 SELECT user_id || '_' || strftime(min(ts), '%Y%m%d%H%M%S') AS block_id, string_agg(event_type, ' ' ORDER BY ts, event_type) AS events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS latency FROM g GROUP BY user_id, s""")(
    lambda s, d: session_traces(table(s, d, "events")).select("block_id", F.array_join("event_ids", " ").alias("events"), F.round("latency", 6).alias("latency"))
)
