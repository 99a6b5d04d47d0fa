"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions.sequences import GRAM_SEPARATOR, gram_bucket, knowledge_id, ngrams, rendered_trace, run_lengths, template_text
from loomtrace.operators import profile as P
from loomtrace.plans.base import RAW_SQL, TRACES_SQL, held_traces, raw_rows, signed, templates, traces
from loomtrace.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


T = "WITH " + TRACES_SQL
R = "WITH " + RAW_SQL

query("parse_feature_list", R + " SELECT row_id, event_ids IS NULL AS malformed, len(event_ids)::BIGINT AS n_events, event_ids[1] AS first_event, event_ids[-1] AS last_event FROM raw")(
    lambda s, d: raw_rows(s, d).select("row_id", F.col("event_ids").isNull().alias("malformed"), F.when(F.col("event_ids").isNotNull(), F.size("event_ids").cast("long")).alias("n_events"), F.get("event_ids", F.lit(0)).alias("first_event"), F.try_element_at("event_ids", F.lit(-1)).alias("last_event"))
)
query(
    "trace_features",
    T + " SELECT block_id, label, len(event_ids)::INT AS length, len(list_distinct(event_ids))::INT AS unique_events, latency, CASE WHEN gaps IS NULL OR len(list_filter(gaps, lambda x: x IS NULL)) > 0 THEN NULL ELSE round(coalesce(list_sum(gaps), 0), 6) END AS gap_sum FROM traces",
)(lambda s, d: P.trace_features(traces(s, d)).withColumn("gap_sum", F.round("gap_sum", 6)))
query("trace_signature", T + " SELECT block_id, sig, lower(label) || '_' || substr(sha1('[' || list_aggregate(list_transform(event_ids, lambda x: '\"' || x || '\"'), 'string_agg', ', ') || ']'), 1, 16) AS knowledge_id FROM signed")(
    lambda s, d: signed(traces(s, d)).select("block_id", "sig", knowledge_id(F.col("label"), F.col("event_ids")).alias("knowledge_id"))
)

_RUNS = T + """,
 flat AS (SELECT block_id, unnest(event_ids) AS e, generate_subscripts(event_ids, 1) AS i FROM traces),
 islands AS (SELECT block_id, e, i, i - row_number() OVER (PARTITION BY block_id, e ORDER BY i) AS g FROM flat),
 runs AS (SELECT block_id, e, min(i) AS start, count(*) AS n FROM islands GROUP BY block_id, e, g)"""
_FOLDED = "string_agg(CASE WHEN n = 1 THEN e ELSE e || ' × ' || n END, ' → ' ORDER BY start)"
query("rle_trace", _RUNS + f" SELECT block_id, {_FOLDED} AS folded, count(*)::INT AS runs FROM runs GROUP BY block_id")(
    lambda s, d: traces(s, d).withColumn("r", run_lengths(F.col("event_ids"))).select(
        "block_id", F.array_join(F.transform("r", lambda x: F.when(x["n"] == 1, x["event"]).otherwise(F.concat(x["event"], F.lit(" × "), x["n"].cast("string")))), " → ").alias("folded"), F.size("r").alias("runs")
    )
)
query(
    "rendered_trace",
    _RUNS + f""",
 firsts AS (SELECT block_id, e, min(i) AS pos FROM flat GROUP BY block_id, e),
 defs AS (SELECT block_id, string_agg(e || ': ' || EventTemplate, chr(10) ORDER BY pos) AS defs FROM firsts JOIN hdfs_log_templates ON EventId = e GROUP BY block_id),
 ordered AS (SELECT block_id, {_FOLDED} AS folded FROM runs GROUP BY block_id)
 SELECT block_id, 'EVENT DEFINITIONS:' || chr(10) || defs || chr(10) || chr(10) || 'ORDERED TRACE:' || chr(10) || folded AS text FROM defs JOIN ordered USING (block_id)""",
)(lambda s, d: traces(s, d).select("block_id", rendered_trace(F.col("event_ids"), templates(s, d)).alias("text")))
query("template_text", T + """, flat AS (SELECT block_id, unnest(event_ids) AS e, generate_subscripts(event_ids, 1) AS i FROM traces)
 SELECT block_id, string_agg(e || ': ' || EventTemplate, chr(10) ORDER BY i) AS text FROM flat JOIN hdfs_log_templates ON EventId = e GROUP BY block_id""")(
    lambda s, d: traces(s, d).select("block_id", template_text(F.col("event_ids"), templates(s, d)).alias("text"))
)
_GRAMS = T + f""",
 grams AS (SELECT block_id, unnest(CASE WHEN len(event_ids) < 2 THEN event_ids ELSE list_concat(
   list_transform(range(1, len(event_ids)), lambda i: event_ids[i] || chr({ord(GRAM_SEPARATOR)}) || event_ids[i + 1]),
   CASE WHEN len(event_ids) >= 3 THEN list_transform(range(1, len(event_ids) - 1), lambda i: event_ids[i] || chr({ord(GRAM_SEPARATOR)}) || event_ids[i + 1] || chr({ord(GRAM_SEPARATOR)}) || event_ids[i + 2]) ELSE [] END) END) AS gram FROM traces)"""
query("ngrams", _GRAMS + " SELECT gram, count(*) AS n, count(DISTINCT block_id) AS blocks FROM grams GROUP BY gram")(
    lambda s, d: P.counted_items(traces(s, d), ngrams(F.col("event_ids")), "block_id").withColumnRenamed("item", "gram").groupBy("gram").agg(F.sum("k").alias("n"), F.count("*").alias("blocks"))
)
query("ngram_bucket_counts", _GRAMS + " SELECT block_id, (('0x' || substr(md5(gram), 1, 15))::BIGINT % 1024)::INT AS bucket, count(*) AS n FROM grams GROUP BY ALL")(
    lambda s, d: P.counted_items(traces(s, d), F.transform(ngrams(F.col("event_ids")), lambda g: gram_bucket(g, 1024)), "block_id").select("block_id", F.col("item").alias("bucket"), F.col("k").alias("n"))
)
_PAIRS = T + """,
 flat AS (SELECT block_id, label, unnest(list_transform(range(1, len(event_ids)), lambda i: struct_pack(a := event_ids[i], b := event_ids[i + 1]))) AS p FROM traces WHERE len(event_ids) > 1),
 sizes AS (SELECT label, count(*) AS size FROM traces GROUP BY label),
 counted AS (SELECT label, p.a AS source, p.b AS target, count(*) AS n, count(DISTINCT block_id) AS blocks FROM flat GROUP BY ALL)
 SELECT label, source, target, n, round(n / sum(n) OVER (PARTITION BY label), 9) AS share, blocks, round(blocks / size, 9) AS prevalence FROM counted JOIN sizes USING (label)"""
query("transitions", _PAIRS)(lambda s, d: P.transitions(held_traces(s, d)).withColumns({c: F.round(c, 9) for c in ("share", "prevalence")}))
_STATS = T + """,
 flat AS (SELECT block_id, label, unnest(event_ids) AS event_id FROM traces),
 stats AS (SELECT event_id, count(DISTINCT block_id) FILTER (label = 'Normal') AS blocks_normal, count(DISTINCT block_id) FILTER (label = 'Anomaly') AS blocks_anomaly,
   count(*) FILTER (label = 'Normal') AS occurrences_normal, count(*) FILTER (label = 'Anomaly') AS occurrences_anomaly FROM flat GROUP BY event_id),
 sizes AS (SELECT count(*) FILTER (label = 'Normal') AS nn, count(*) FILTER (label = 'Anomaly') AS na FROM traces),
 final AS (SELECT stats.*, round(blocks_normal / nn, 9) AS prevalence_normal, round(blocks_anomaly / na, 9) AS prevalence_anomaly, round(blocks_anomaly / na - blocks_normal / nn, 9) AS prevalence_difference FROM stats, sizes)
 SELECT * FROM final"""


def _event_statistics(s, d):
    return P.event_statistics(held_traces(s, d)).withColumns({c: F.round(c, 9) for c in ("prevalence_normal", "prevalence_anomaly", "prevalence_difference")})


query("event_statistics", _STATS)(_event_statistics)
query("top_prevalence_difference", _STATS + " ORDER BY abs(prevalence_difference) DESC, event_id LIMIT 12")(
    lambda s, d: P.largest_differences(_event_statistics(s, d), "prevalence_difference")
)
query("occurrence_long", T + " SELECT block_id, event_id, count(*) AS n FROM (SELECT block_id, unnest(event_ids) AS event_id FROM traces) GROUP BY ALL")(lambda s, d: P.occurrences(traces(s, d)))
_EVENTS = [f"E{i}" for i in range(1, 30)]
query("occurrence_matrix", T + " SELECT block_id, label, type, " + ", ".join(f"len(list_filter(event_ids, lambda x: x = '{e}'))::INT AS {e}" for e in _EVENTS) + " FROM traces")(
    lambda s, d: P.occurrence_matrix(traces(s, d), _EVENTS)
)
_SUMMARY = ", ".join(f"round(quantile_cont({{0}}::DOUBLE, {p}), 6) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99))
_DESCRIBE = " SELECT label, '{0}' AS measure, count({0}) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, min({0})::DOUBLE AS min, " + _SUMMARY + ", max({0})::DOUBLE AS max FROM (SELECT label, latency, len(event_ids) AS length FROM traces) GROUP BY label"


def _describe(s, d, value):
    made = P.describe(P.trace_features(held_traces(s, d)), value, "label").withColumn("measure", F.lit(value))
    return made.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p50", "p90", "p95", "p99")})


query("summary_by_label_length", T + _DESCRIBE.format("length"))(lambda s, d: _describe(s, d, "length"))
query("summary_by_label_latency", T + _DESCRIBE.format("latency"))(lambda s, d: _describe(s, d, "latency"))
query("type_distribution", T + " SELECT label, type, count(*) AS n FROM traces GROUP BY ALL")(lambda s, d: P.type_tables(traces(s, d))[0])
query("type_missingness", T + " SELECT label, count(*) AS rows, count(*) FILTER (type IS NULL) AS missing FROM traces GROUP BY label")(lambda s, d: P.type_tables(traces(s, d))[1])
query("type_leak_mismatches", T + " SELECT count(*) AS rows, count(*) FILTER ((type IS NOT NULL) <> (label = 'Anomaly')) AS mismatches FROM traces")(lambda s, d: P.type_tables(traces(s, d))[2])
_COLUMNS = ("BlockId", "Label", "Type", "Features", "TimeInterval", "Latency", "node_id", "started_at", "loaded_at")
query("missing_value_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, count(*) AS rows FROM event_traces" for c in _COLUMNS))(
    lambda s, d: P.missing_values(table(s, d, "event_traces"), _COLUMNS)
)
query("length_ecdf", T + """, counted AS (SELECT label, len(event_ids)::INT AS value, count(*) AS n FROM traces GROUP BY ALL)
 SELECT label, value, n, round(sum(n) OVER (PARTITION BY label ORDER BY value) / sum(n) OVER (PARTITION BY label), 9) AS fraction FROM counted""")(
    lambda s, d: P.ecdf(P.trace_features(traces(s, d)), "length", "label").withColumn("fraction", F.round("fraction", 9))
)
query("latency_ecdf", T + """, counted AS (SELECT label, latency AS value, count(*) AS n FROM traces WHERE latency IS NOT NULL GROUP BY ALL)
 SELECT label, value, n, round(sum(n) OVER (PARTITION BY label ORDER BY value) / sum(n) OVER (PARTITION BY label), 9) AS fraction FROM counted""")(
    lambda s, d: P.ecdf(P.trace_features(traces(s, d)), "latency", "label").withColumn("fraction", F.round("fraction", 9))
)
query("unique_event_rates", T + """, counted AS (SELECT label, len(list_distinct(event_ids))::INT AS value, count(*) AS n FROM traces GROUP BY ALL)
 SELECT label, value, n, round(n / sum(n) OVER (PARTITION BY label), 9) AS share FROM counted""")(
    lambda s, d: P.value_shares(P.trace_features(traces(s, d)), F.col("unique_events"), "label").withColumn("share", F.round("share", 9))
)
query("group_size_histogram", T + """, sizes AS (SELECT event_ids, count(*) AS blocks FROM traces GROUP BY 1), width AS (SELECT ln(max(blocks) + 1.0) / 30 AS w FROM sizes)
 SELECT least(29, floor(ln(blocks) / w + 1e-9))::INT AS bin, count(*) AS groups FROM sizes, width GROUP BY 1""")(lambda s, d: P.group_size_histogram(traces(s, d)))
_GROUPS = T + """, grouped AS (SELECT event_ids, count(*) AS blocks, count(*) FILTER (label = 'Normal') AS normal, count(*) FILTER (label = 'Anomaly') AS anomaly, min(block_id) AS representative FROM traces GROUP BY event_ids)"""
query("sequence_groups", _GROUPS + " SELECT array_to_string(event_ids, ' ') AS pattern, blocks, normal, anomaly, representative, sha256(to_json(event_ids)::VARCHAR) AS trace_signature, normal > 0 AND anomaly > 0 AS conflicting FROM grouped")(
    lambda s, d: P.sequence_groups(traces(s, d)).withColumn("pattern", F.array_join("event_ids", " ")).drop("event_ids")
)
query("conflicting_sequences", _GROUPS + " SELECT sha256(to_json(event_ids)::VARCHAR) AS trace_signature, normal, anomaly FROM grouped WHERE normal > 0 AND anomaly > 0")(
    lambda s, d: P.sequence_groups(traces(s, d)).where("conflicting").select("trace_signature", "normal", "anomaly")
)
query("canonical_sequences", T + """, each AS (SELECT event_ids, label, count(*) AS occurrence_count, min(block_id) AS representative_block_id FROM traces GROUP BY ALL),
 both_ AS (SELECT event_ids, count(DISTINCT label) > 1 AS conflicting_sequence FROM traces GROUP BY 1)
 SELECT array_to_string(event_ids, ' ') AS pattern, label, occurrence_count, representative_block_id, conflicting_sequence,
   lower(label) || '_' || substr(sha1('[' || list_aggregate(list_transform(event_ids, lambda x: '"' || x || '"'), 'string_agg', ', ') || ']'), 1, 16) AS trace_id FROM each JOIN both_ USING (event_ids)""")(
    lambda s, d: P.canonical_traces(held_traces(s, d)).withColumn("pattern", F.array_join("event_ids", " ")).drop("event_ids")
)
query("duplicate_summary", _GROUPS + """ SELECT sum(blocks)::BIGINT AS blocks, count(*) AS sequences, count(*) FILTER (blocks > 1) AS repeated_sequences, coalesce(sum(blocks) FILTER (blocks > 1), 0)::BIGINT AS blocks_in_repeated,
 (sum(blocks) - count(*))::BIGINT AS blocks_beyond_first, count(*) FILTER (normal > 0 AND anomaly > 0) AS conflicting_sequences, coalesce(sum(blocks) FILTER (normal > 0 AND anomaly > 0), 0)::BIGINT AS conflicting_blocks,
 coalesce(sum(least(normal, anomaly)), 0)::BIGINT AS least_errors FROM grouped""")(lambda s, d: P.duplicate_summary(traces(s, d)))
query("ambiguous_blocks", _GROUPS + """ SELECT t.block_id, t.label, sha256(to_json(t.event_ids)::VARCHAR) AS trace_signature, len(t.event_ids)::INT AS length FROM traces t JOIN grouped g USING (event_ids) WHERE normal > 0 AND anomaly > 0""")(
    lambda s, d: P.ambiguous_blocks(held_traces(s, d))
)
query("trace_examples", T + """, ranked AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY block_id)::INT AS rank, block_id, array_to_string(event_ids, ' ') AS events FROM traces)
 SELECT * FROM ranked WHERE rank <= 2""")(lambda s, d: P.examples(traces(s, d)))
