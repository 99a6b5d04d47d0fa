"""Queries on splits, knowledge bases, integrity and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.sequences import rendered_trace
from loomtrace.operators import profile as P
from loomtrace.operators import quality as Q
from loomtrace.operators import sets as K
from loomtrace.operators import splits as S
from loomtrace.operators import verify as V
from loomtrace.plans.base import BLANKS, RAW_SQL, TRACES_SQL, TRIM, held_traces, raw_rows, signed, templates, traces
from loomtrace.plans.packing_sql import events_sql
from loomtrace.session import shared_checkpoint
from loomtrace.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T = "WITH " + TRACES_SQL
_TEXTS = T + """,
 flat AS (SELECT block_id, unnest(event_ids) AS e, generate_subscripts(event_ids, 1) AS i FROM traces),
 islands AS (SELECT block_id, e, i, i - row_number() OVER (PARTITION BY block_id, e ORDER BY i) AS g FROM flat),
 runs AS (SELECT block_id, e, min(i) AS start, count(*) AS n FROM islands GROUP BY block_id, e, g),
 firsts AS (SELECT block_id, e, min(i) AS pos FROM flat GROUP BY block_id, e),
 defs AS (SELECT block_id, string_agg(e || ': ' || EventTemplate, chr(10) ORDER BY pos) AS defs FROM firsts JOIN hdfs_log_templates ON EventId = e GROUP BY block_id),
 ordered AS (SELECT block_id, string_agg(CASE WHEN n = 1 THEN e ELSE e || ' × ' || n END, ' → ' ORDER BY start) AS folded FROM runs GROUP BY block_id),
 texts AS (SELECT block_id, 'EVENT DEFINITIONS:' || chr(10) || defs || chr(10) || chr(10) || 'ORDERED TRACE:' || chr(10) || folded AS text FROM defs JOIN ordered USING (block_id))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _split(s: SparkSession, d: str) -> DataFrame:
    return S.hash_split(signed(held_traces(s, d)))


query("stratified_split", T + """, ranked AS (SELECT block_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || block_id), block_id) - 1 AS at_, count(*) OVER (PARTITION BY label) AS total FROM traces)
 SELECT block_id, label, CASE WHEN at_ < floor(total * 0.15::DOUBLE) THEN 'validation' WHEN at_ < floor(total * 0.15::DOUBLE) + floor(total * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ranked""")(
    lambda s, d: S.stratified_split(held_traces(s, d)).select("block_id", "label", "split")
)
query("hash_group_split", T + " SELECT block_id, label, sig, split FROM splits")(lambda s, d: _split(s, d).select("block_id", "label", "sig", "split"))
query("group_split_greedy")(lambda s, d: S.greedy_split(signed(held_traces(s, d))).select("block_id", "label", "sig", "split"))
query("split_violations", T + """ SELECT 'repeated_blocks' AS "check", (count(*) - count(DISTINCT block_id))::BIGINT AS violations FROM splits
 UNION ALL SELECT 'unassigned_rows', count(*) FILTER (split IS NULL) FROM splits
 UNION ALL SELECT 'splits_without_both_labels', count(*) FROM (SELECT split FROM splits GROUP BY split HAVING count(DISTINCT label) < 2)
 UNION ALL SELECT 'groups_across_splits', count(*) FROM (SELECT sig FROM splits GROUP BY sig HAVING count(DISTINCT split) > 1)""")(lambda s, d: S.split_violations(_split(s, d)))
query("split_composition", T + """, c AS (SELECT split, count(*) AS blocks, count(*) FILTER (label = 'Normal') AS normal, count(*) FILTER (label = 'Anomaly') AS anomaly FROM splits GROUP BY split)
 SELECT split, blocks, normal, anomaly, round(anomaly / blocks, 9) AS anomaly_prevalence, round(blocks / sum(blocks) OVER (), 9) AS fraction_of_all FROM c""")(
    lambda s, d: S.composition(_split(s, d)).withColumns({c: F.round(c, 9) for c in ("anomaly_prevalence", "fraction_of_all")})
)
query("pairwise_overlap", T + """, strat AS (SELECT sig, CASE WHEN at_ < floor(total * 0.15::DOUBLE) THEN 'validation' WHEN at_ < 2 * floor(total * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM
   (SELECT sig, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || block_id), block_id) - 1 AS at_, count(*) OVER (PARTITION BY label) AS total FROM signed)),
 held AS (SELECT sig, list_distinct(list(split)) AS s FROM strat GROUP BY sig)
 SELECT a, b, count(*) FILTER (list_contains(s, a) AND list_contains(s, b)) AS shared FROM held, (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(a, b) GROUP BY a, b""")(
    lambda s, d: S.pairwise_overlap(S.stratified_split(signed(held_traces(s, d))))
)
_STRAT = T + """, strat AS (SELECT *, CASE WHEN at_ < floor(total * 0.15::DOUBLE) THEN 'validation' WHEN at_ < 2 * floor(total * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM
   (SELECT block_id, sig, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || block_id), block_id) - 1 AS at_, count(*) OVER (PARTITION BY label) AS total FROM signed)),
 facts AS (SELECT sig, bool_or(split = 'train') AS seen_in_train, bool_or(split = 'train' AND label = 'Normal') AS exact_match_in_normal_kb, count(DISTINCT label) > 1 AS conflicting_trace FROM strat GROUP BY sig),
 flagged AS (SELECT block_id, sig, label, split, seen_in_train, exact_match_in_normal_kb, conflicting_trace FROM strat JOIN facts USING (sig) WHERE split <> 'train')"""
query("evaluation_annotations", _STRAT + " SELECT * FROM flagged")(
    lambda s, d: S.seen_flags(S.stratified_split(signed(held_traces(s, d)))).select("block_id", "sig", "label", "split", "seen_in_train", "exact_match_in_normal_kb", "conflicting_trace")
)
query("seen_unseen_by_label", _STRAT + """ SELECT split, label, count(*) AS blocks, count(*) FILTER (seen_in_train) AS seen, count(*) FILTER (exact_match_in_normal_kb) AS exact,
 round(count(*) FILTER (seen_in_train) / count(*), 9) AS seen_rate, round(count(*) FILTER (exact_match_in_normal_kb) / count(*), 9) AS exact_rate FROM flagged GROUP BY split, label""")(
    lambda s, d: S.seen_report(S.stratified_split(signed(held_traces(s, d)))).withColumns({c: F.round(c, 9) for c in ("seen_rate", "exact_rate")})
)
query("normal_kb", T + """, kb AS (SELECT sig AS trace_id, count(*) AS occurrence_count, min(block_id) AS representative_block_id, any_value(event_ids) AS event_ids FROM splits WHERE split = 'train' AND label = 'Normal' GROUP BY sig),
 flat AS (SELECT trace_id, unnest(event_ids) AS e, generate_subscripts(event_ids, 1) AS i FROM kb),
 texts AS (SELECT trace_id, string_agg(e || ': ' || EventTemplate, chr(10) ORDER BY i) AS template_text FROM flat JOIN hdfs_log_templates ON EventId = e GROUP BY trace_id)
 SELECT trace_id, to_json(event_ids)::VARCHAR AS event_ids, template_text, occurrence_count, representative_block_id FROM kb JOIN texts USING (trace_id)""")(
    lambda s, d: S.with_template_text(S.normal_knowledge(_split(s, d)), templates(s, d)).select(F.col("sig").alias("trace_id"), F.to_json("event_ids").alias("event_ids"), "template_text", "occurrence_count", "representative_block_id")
)
query("kb_variants", T + """, train AS (SELECT * FROM splits WHERE split = 'train'),
 each AS (SELECT event_ids, label, count(*) AS occurrence_count, min(block_id) AS representative_block_id FROM train GROUP BY ALL),
 both_ AS (SELECT event_ids, count(DISTINCT label) > 1 AS conflicting_sequence FROM train GROUP BY 1),
 rows_ AS (SELECT *, unnest([lower(label), 'mixed']) AS variant FROM each JOIN both_ USING (event_ids))
 SELECT variant, (row_number() OVER (PARTITION BY variant ORDER BY label DESC, event_ids) - 1)::INT AS kb_index, label, array_to_string(event_ids, ' ') AS pattern, occurrence_count, representative_block_id, conflicting_sequence FROM rows_""")(
    lambda s, d: S.knowledge_variants(_split(s, d)).withColumn("pattern", F.array_join("event_ids", " ")).drop("event_ids")
)
query("kb_compression", T + " SELECT count(*) AS blocks, count(DISTINCT sig) AS entries, round(count(DISTINCT sig) / count(*), 9) AS ratio FROM splits WHERE split = 'train' AND label = 'Normal'")(
    lambda s, d: S.knowledge_compression(_split(s, d)).withColumn("ratio", F.round("ratio", 9))
)
query("sample_uniform", T + " SELECT block_id, label FROM traces ORDER BY md5('42|' || block_id), block_id LIMIT 200")(lambda s, d: S.sample_uniform(traces(s, d), 200).select("block_id", "label"))
query("sample_stratified", T + """, ranked AS (SELECT block_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || block_id), block_id) AS r FROM traces)
 SELECT block_id, label FROM ranked WHERE (label = 'Normal' AND r <= 40) OR (label = 'Anomaly' AND r <= 10)""")(
    lambda s, d: S.sample_stratified(traces(s, d), {"Normal": 40, "Anomaly": 10}).select("block_id", "label")
)

query("query_manifest", _TEXTS + """, picked AS (SELECT block_id FROM traces ORDER BY md5('42|' || block_id), block_id LIMIT 200)
 SELECT block_id, upper(label) AS label, sig AS trace_signature, array_to_string(event_ids, ' ') AS events, text FROM picked JOIN signed USING (block_id) JOIN texts USING (block_id)""")(
    lambda s, d: S.sample_uniform(signed(traces(s, d)), 200).select("block_id", F.upper("label").alias("label"), F.col("sig").alias("trace_signature"), F.array_join("event_ids", " ").alias("events"), rendered_trace(F.col("event_ids"), templates(s, d)).alias("text"))
)


def _block_keys(s: SparkSession, d: str, name: str, column: str) -> DataFrame:
    return table(s, d, name).select(F.nullif(F.lower(F.btrim(column, F.lit(BLANKS))), F.lit("")).alias("key"))


def _keys_sql(column: str, name: str) -> str:
    return f"SELECT DISTINCT nullif(lower(trim({column}, {TRIM})), '') AS key FROM {name} WHERE nullif(lower(trim({column}, {TRIM})), '') IS NOT NULL"


query("key_sets", f"""WITH a AS ({_keys_sql("BlockId", "event_traces")}), b AS ({_keys_sql("BlockId", "anomaly_label")}), u AS (SELECT a.key AS a, b.key AS b FROM a FULL JOIN b USING (key))
 SELECT count(a) AS in_a, count(b) AS in_b, count(*) AS either, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b,
 count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS equal, count(*) FILTER (b IS NULL) = 0 AS a_in_b, count(*) FILTER (a IS NULL) = 0 AS b_in_a FROM u""")(
    lambda s, d: K.overlap(_block_keys(s, d, "event_traces", "BlockId"), _block_keys(s, d, "anomaly_label", "BlockId"))
)
query("blocks_present", f"WITH a AS ({_keys_sql('block_id', 'block_sequences')}), b AS ({_keys_sql('BlockId', 'event_traces')}) SELECT key FROM a WHERE key IN (SELECT key FROM b)")(
    lambda s, d: K.present(K.keys(_block_keys(s, d, "block_sequences", "block_id"), "key"), _block_keys(s, d, "event_traces", "BlockId"), "key")
)
query("blocks_absent", f"WITH a AS ({_keys_sql('block_id', 'block_sequences')}), b AS ({_keys_sql('BlockId', 'anomaly_label')}) SELECT key FROM a WHERE key NOT IN (SELECT key FROM b)")(
    lambda s, d: K.absent(K.keys(_block_keys(s, d, "block_sequences", "block_id"), "key"), _block_keys(s, d, "anomaly_label", "BlockId"), "key")
)


def _labels(s: SparkSession, d: str) -> DataFrame:
    """One label per block; Anomaly where records disagree."""
    word = F.lower(F.btrim("Label", F.lit(BLANKS)))
    label = F.when(word == "normal", "Normal").when(word == "anomaly", "Anomaly")
    block = F.nullif(F.lower(F.btrim("BlockId", F.lit(BLANKS))), F.lit(""))
    return table(s, d, "anomaly_label").select(block.alias("block_id"), label.alias("truth")).where("block_id IS NOT NULL").groupBy("block_id").agg(F.min("truth").alias("truth"))


_EVENTS = [f"E{i}" for i in range(1, 30)]
_LABELS_SQL = f"""labels AS (SELECT block_id, min(truth) AS truth FROM (SELECT nullif(lower(trim(BlockId, {TRIM})), '') AS block_id, CASE lower(trim(Label, {TRIM})) WHEN 'normal' THEN 'Normal' WHEN 'anomaly' THEN 'Anomaly' END AS truth FROM anomaly_label) WHERE block_id IS NOT NULL GROUP BY block_id)"""
_BADGAP = "list_filter(gaps, lambda x: x IS NULL OR isnan(x) OR x < 0 OR isinf(x))"
query("quality_counters", "WITH " + RAW_SQL + ", " + _LABELS_SQL + f""",
 j AS (SELECT raw.*, truth, latency IS NOT NULL AND (isnan(latency) OR latency < 0 OR isinf(latency)) AS bad_latency,
   CASE WHEN gaps IS NULL OR len(list_filter(gaps, lambda x: x IS NULL)) > 0 THEN NULL ELSE coalesce(list_sum(gaps), 0) END AS gap_sum FROM raw LEFT JOIN labels USING (block_id))
 SELECT 'missing_trace_block_ids' AS "check", count(*) FILTER (block_id IS NULL) AS violations FROM j
 UNION ALL SELECT 'unknown_trace_labels', count(*) FILTER (label IS NULL) FROM j
 UNION ALL SELECT 'trace_label_disagreement', count(*) FILTER (truth IS NOT NULL AND label IS DISTINCT FROM truth) FROM j
 UNION ALL SELECT 'malformed_features', count(*) FILTER (event_ids IS NULL) FROM j
 UNION ALL SELECT 'empty_traces', count(*) FILTER (len(event_ids) = 0) FROM j
 UNION ALL SELECT 'unknown_event_tokens', coalesce(sum(len(list_filter(event_ids, lambda x: NOT regexp_full_match(x, 'E([1-9]|1[0-9]|2[0-9])')))), 0)::BIGINT FROM j
 UNION ALL SELECT 'interval_length_disagreement', count(*) FILTER (event_ids IS NOT NULL AND gaps IS NOT NULL AND len(gaps) <> greatest(len(event_ids) - 1, 0)) FROM j
 UNION ALL SELECT 'invalid_intervals', coalesce(sum(len({_BADGAP})), 0)::BIGINT FROM j
 UNION ALL SELECT 'malformed_time_fields', count(*) FILTER (gaps IS NULL) FROM j
 UNION ALL SELECT 'invalid_latency', count(*) FILTER (bad_latency) FROM j
 UNION ALL SELECT 'latency_vs_interval_sum_disagreement', count(*) FILTER (latency IS NOT NULL AND NOT bad_latency AND abs(latency - gap_sum) > 1e-6) FROM j
 UNION ALL SELECT 'duplicate_trace_block_ids', (count(block_id) - count(DISTINCT block_id))::BIGINT FROM raw
 UNION ALL SELECT 'unknown_ground_truth_labels', count(*) FILTER (truth IS NULL) FROM labels
 UNION ALL SELECT 'labels_without_trace', count(*) FROM labels WHERE block_id NOT IN (SELECT block_id FROM raw WHERE block_id IS NOT NULL)
 UNION ALL SELECT 'traces_without_labels', count(DISTINCT block_id) FROM raw WHERE block_id IS NOT NULL AND block_id NOT IN (SELECT block_id FROM labels)""")(
    lambda s, d: Q.trace_counters(raw_rows(s, d), _labels(s, d), _EVENTS)
)
def _matrix_counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return Q.matrix_counters(P.occurrence_matrix(rows, _EVENTS), labels, rows, _EVENTS)


_ZERO = "('matrix_events_without_template', 0), ('templates_without_matrix_column', 0), ('unknown_matrix_labels', 0), ('invalid_matrix_cells', 0), ('trace_matrix_count_disagreement', 0), ('matrix_without_trace', 0)"
query("matrix_quality_counters", T + ", " + _LABELS_SQL + f""" SELECT * FROM (VALUES {_ZERO}) v("check", violations)
 UNION ALL SELECT 'matrix_label_disagreement', count(*) FILTER (label IS DISTINCT FROM truth) FROM traces LEFT JOIN labels USING (block_id)
 UNION ALL SELECT 'labels_without_matrix', count(*) FROM labels WHERE block_id NOT IN (SELECT block_id FROM traces)
 UNION ALL SELECT 'matrix_without_labels', count(*) FROM traces WHERE block_id NOT IN (SELECT block_id FROM labels)""")(
    lambda s, d: _matrix_counters(held_traces(s, d), _labels(s, d)).withColumn("violations", F.col("violations").cast("int"))
)


@query("verifier_checks", """SELECT * FROM (VALUES ('annotations_beyond_manifest', 0), ('annotations_missing', 0), ('conflict_annotation_differs', 0), ('conflict_flag_differs', 0), ('events_differ', 0), ('exact_flag_differs', 0),
 ('knowledge_counts_differ', 0), ('knowledge_repeated_ids', 0), ('knowledge_representatives_differ', 0), ('label_differs', 0), ('manifest_repeated_blocks', 0), ('manifest_rows_differ', 0), ('prepared_repeated_blocks', 0),
 ('prepared_without_trace', 0), ('representatives_outside_normal_train', 0), ('seen_flag_differs', 0), ('signature_differs', 0), ('signatures_across_splits', 0), ('splits_without_both_labels', 0), ('template_text_differs', 0), ('traces_not_prepared', 0)) v("check", violations)""")
def verifier_checks(s: SparkSession, d: str) -> DataFrame:
    """All checks of tables prepared from the traces."""
    source = held_traces(s, d)
    conflicts = P.sequence_groups(source).select("event_ids", F.col("conflicting").alias("conflicting_trace"))
    prepared = shared_checkpoint(S.with_template_text(signed(source), templates(s, d)).join(conflicts, "event_ids").withColumnRenamed("sig", "trace_signature"))
    manifest = shared_checkpoint(S.hash_split(signed(source)).select("block_id", F.col("sig").alias("trace_signature"), "label", "split"))
    knowledge = S.normal_knowledge(S.hash_split(signed(source))).withColumnRenamed("sig", "trace_id")
    annotations = S.seen_flags(manifest, "trace_signature")
    checks = Q.union_checks(V.verify_sequences(prepared, source, templates(s, d)), V.verify_manifest(manifest, prepared, True), V.verify_knowledge(knowledge, manifest), V.verify_annotations(annotations, manifest))
    return checks.withColumn("violations", F.col("violations").cast("int"))


_HEX = "nullif(regexp_extract(lower({}), '([0-9a-f]{{64}})', 1), '')"
_DELIVERED = f"""WITH {_LABELS_SQL},
 b AS (SELECT nullif(lower(trim(block_id, {TRIM})), '') AS block, {_HEX.format("trace_signature")} AS sig, {events_sql("event_ids")} AS events, event_ids IS NOT NULL AS listed, sequence_length AS n, conflicting_trace AS flag,
   CASE lower(trim(label, {TRIM})) WHEN 'normal' THEN 'Normal' WHEN 'anomaly' THEN 'Anomaly' END AS label FROM block_sequences),
 own AS (SELECT *, CASE WHEN events IS NOT NULL THEN sha256('[' || array_to_string(list_transform(events, lambda x: '"E' || x || '"'), ',') || ']') END AS again FROM b),
 c AS (SELECT events, count(DISTINCT label) > 1 AS both_ FROM own WHERE events IS NOT NULL GROUP BY events),
 j AS (SELECT own.*, truth, both_ FROM own LEFT JOIN labels ON labels.block_id = own.block LEFT JOIN c USING (events)),
 k AS (SELECT trace_id, {events_sql("event_ids")} AS events, template_text FROM normal_knowledge_base)
 SELECT 'block_ids_missing' AS "check", count(*) FILTER (block IS NULL) AS violations FROM j
 UNION ALL SELECT 'block_ids_repeated', (count(block) - count(DISTINCT block))::BIGINT FROM j
 UNION ALL SELECT 'signatures_missing', count(*) FILTER (sig IS NULL) FROM j
 UNION ALL SELECT 'events_unreadable', count(*) FILTER (listed AND events IS NULL) FROM j
 UNION ALL SELECT 'events_missing', count(*) FILTER (NOT listed) FROM j
 UNION ALL SELECT 'signature_differs', count(*) FILTER (sig <> again) FROM j
 UNION ALL SELECT 'length_differs', count(*) FILTER (n <> len(events)) FROM j
 UNION ALL SELECT 'labels_unknown', count(*) FILTER (label IS NULL) FROM j
 UNION ALL SELECT 'label_differs', count(*) FILTER (label <> truth) FROM j
 UNION ALL SELECT 'conflict_flag_differs', count(*) FILTER (flag <> both_) FROM j
 UNION ALL SELECT 'knowledge_ids_repeated', (count(trace_id) - count(DISTINCT trace_id))::BIGINT FROM k
 UNION ALL SELECT 'knowledge_id_differs', count(*) FILTER (trace_id <> sha256('[' || array_to_string(list_transform(events, lambda x: '"E' || x || '"'), ',') || ']')) FROM k
 UNION ALL SELECT 'knowledge_texts_missing', count(*) FILTER (template_text IS NULL) FROM k
 UNION ALL SELECT 'knowledge_without_block', count(*) FROM k WHERE trace_id NOT IN (SELECT sig FROM own WHERE sig IS NOT NULL)"""


@query("delivered_checks", _DELIVERED)
def delivered_checks(s: SparkSession, d: str) -> DataFrame:
    """Checks of the tables as they were delivered: block_sequences, normal_knowledge_base and anomaly_label."""
    return V.verify_delivered(table(s, d, "block_sequences"), table(s, d, "normal_knowledge_base"), _labels(s, d))
