"""The experiment of all methods with the stand-in classifier, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import evaluation as E
from loomtrace.operators import experiment as X
from loomtrace.operators import prompts as M
from loomtrace.operators.splits import hash_split
from loomtrace.plans.base import TRACES_SQL, held_traces, signed, templates
from loomtrace.plans.retrieval_queries import _JACCARD, _LCS

_SYSTEM = M.SYSTEM_PROMPT.replace("'", "''")
_SQL = (
    "WITH "
    + TRACES_SQL
    + f""",
 q AS (SELECT * FROM (SELECT block_id, split, label, event_ids AS a, row_number() OVER (PARTITION BY split, label ORDER BY md5('42|' || block_id), block_id) AS r FROM splits WHERE split <> 'train') WHERE r <= CASE label WHEN 'Normal' THEN {X.SAMPLE["Normal"]} ELSE {X.SAMPLE["Anomaly"]} END),
 base AS (SELECT event_ids AS b, label, min(block_id) AS base_id FROM splits WHERE split = 'train' GROUP BY ALL),
 every AS (SELECT block_id AS id, a AS e FROM q UNION ALL SELECT base_id, b FROM base),
 grams AS (SELECT id, unnest(CASE WHEN len(e) < 2 THEN e ELSE list_concat(list_transform(range(1, len(e)), lambda i: e[i] || chr(31) || e[i + 1]),
   CASE WHEN len(e) >= 3 THEN list_transform(range(1, len(e) - 1), lambda i: e[i] || chr(31) || e[i + 1] || chr(31) || e[i + 2]) ELSE [] END) END) AS gram FROM every),
 cells AS (SELECT id, ('0x' || substr(md5(gram), 1, 15))::BIGINT % 1024 AS bucket, count(*) AS n FROM grams GROUP BY ALL),
 norms AS (SELECT id, sqrt(sum(n * n)) AS norm FROM cells GROUP BY id),
 dots AS (SELECT x.id AS block_id, y.id AS base_id, sum(x.n * y.n) AS dot FROM cells x JOIN cells y USING (bucket) WHERE x.id IN (SELECT block_id FROM q) AND y.id IN (SELECT base_id FROM base) GROUP BY ALL),
 near AS MATERIALIZED (SELECT q.block_id, q.split, base.base_id, base.label, (least(1, coalesce(dot, 0) / nq.norm / nb.norm) + 1) / 2 AS cosine, {_JACCARD} AS jaccard, {_LCS} AS lcs
   FROM q JOIN base ON true LEFT JOIN dots ON dots.block_id = q.block_id AND dots.base_id = base.base_id JOIN norms nq ON nq.id = q.block_id JOIN norms nb ON nb.id = base.base_id),
 scored AS (SELECT 'semantic' AS retrieval, block_id, split, base_id, label, round(cosine, 9) AS score FROM near UNION ALL SELECT 'structure', block_id, split, base_id, label, round(0.5::DOUBLE * cosine + 0.2::DOUBLE * jaccard + 0.3::DOUBLE * lcs, 9) FROM near),
 pools AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY retrieval, kb, block_id ORDER BY score DESC, base_id) AS rank FROM (SELECT *, unnest([lower(label), 'mixed']) AS kb FROM scored) QUALIFY rank <= {X.POOL}),
 flat AS (SELECT id, unnest(e) AS ev, generate_subscripts(e, 1) AS i FROM every),
 texts AS (SELECT id, string_agg(ev || ': ' || EventTemplate, chr(10) ORDER BY i) AS text FROM flat JOIN hdfs_log_templates ON EventId = ev GROUP BY id),
 cuts AS (SELECT retrieval, kb, unnest({list(X.QUANTILES)})::DOUBLE AS quantile, round(unnest(quantile_cont(score, {list(X.QUANTILES)})), 6) AS threshold FROM pools WHERE split = 'validation' GROUP BY retrieval, kb),
 settings AS (SELECT retrieval, kb, 'k' || k AS setting, k, NULL::DOUBLE AS threshold FROM (SELECT DISTINCT retrieval, kb FROM cuts), (SELECT unnest({list(X.SWEEP)}) AS k)
   UNION ALL SELECT retrieval, kb, printf('q%.2f', quantile), NULL, threshold FROM cuts),
 asked AS (SELECT CASE WHEN threshold IS NULL THEN CASE retrieval WHEN 'semantic' THEN 'm2' ELSE 'm4' END ELSE CASE retrieval WHEN 'semantic' THEN 'm3' ELSE 'm5' END END AS method, retrieval, kb, setting, k, threshold, q.block_id, q.split, upper(q.label) AS label FROM settings, q
   UNION ALL SELECT 'm1', NULL, NULL, NULL, NULL, NULL, block_id, split, upper(label) FROM q),
 contexts AS (SELECT asked.method, asked.kb, setting, asked.block_id, count(*) AS n, string_agg('REFERENCE ' || rank || ' — LABEL: ' || upper(pools.label) || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS refs
   FROM asked JOIN pools ON pools.retrieval = asked.retrieval AND pools.kb = asked.kb AND pools.block_id = asked.block_id AND (rank <= k OR round(score, 6) >= threshold) JOIN texts ON id = base_id GROUP BY ALL),
 said AS (SELECT method, kb, setting, threshold, asked.block_id, split, label, coalesce(n, 0) AS context_count, CASE WHEN ('0x' || substr(h, 1, 1))::INT < 4 THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction, size // 4 AS prompt_tokens
   FROM (SELECT asked.*, n, md5(chat) AS h, length(chat) AS size FROM (SELECT asked.*, n, '{_SYSTEM}' || chr(31) || 'LABELED HISTORICAL REFERENCES:' || chr(10) || coalesce(refs, 'NONE') || chr(10) || chr(10) || 'QUERY BLOCK SEQUENCE:' || chr(10) || text || chr(10) || chr(10) || 'Return: {M.ANSWER_FORM}' AS chat
     FROM asked JOIN texts ON id = asked.block_id LEFT JOIN contexts c ON c.method = asked.method AND c.kb = asked.kb AND c.setting = asked.setting AND c.block_id = asked.block_id) asked) asked),
 rates AS (SELECT method, kb, setting, threshold, avg(context_count) AS average_contexts, coalesce(2 * count(*) FILTER (label = 'ANOMALY' AND prediction = 'ANOMALY') / nullif(2 * count(*) FILTER (label = 'ANOMALY' AND prediction = 'ANOMALY') + count(*) FILTER (label <> prediction), 0), 0) AS f1
   FROM said WHERE split = 'validation' AND threshold IS NOT NULL GROUP BY ALL),
 locked AS (SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY method, kb ORDER BY round(f1, 6) DESC, average_contexts, threshold) = 1),
 votes0 AS (SELECT block_id, split, k, upper(label) AS label, 1 - (2 * score - 1) AS dist, max((1 - (2 * score - 1) <= 1e-7)::INT) OVER (PARTITION BY block_id, k) AS z FROM pools JOIN (SELECT unnest({list(X.NEIGHBOURS)}) AS k) ON rank <= k WHERE retrieval = 'semantic' AND kb = 'mixed'),
 votes1 AS (SELECT block_id, split, k, coalesce(sum(CASE WHEN z = 1 THEN (dist <= 1e-7)::INT ELSE 1 / greatest(dist, 1e-7) END) FILTER (label = 'ANOMALY'), 0) - coalesce(sum(CASE WHEN z = 1 THEN (dist <= 1e-7)::INT ELSE 1 / greatest(dist, 1e-7) END) FILTER (label = 'NORMAL'), 0) AS d FROM votes0 GROUP BY ALL),
 votes AS (SELECT votes1.block_id, votes1.split, k, upper(q.label) AS label, CASE WHEN round(d, 6) > 0 THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction FROM votes1 JOIN q USING (block_id)),
 ks AS (SELECT k, count(*) FILTER (label = 'ANOMALY' AND prediction = 'ANOMALY') AS tp, count(*) FILTER (label <> prediction) AS wrong, count(*) FILTER (label = 'ANOMALY') AS pos FROM votes WHERE split = 'validation' GROUP BY k),
 best_k AS (SELECT k FROM ks ORDER BY round(coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0), 9) DESC, round(coalesce(tp / nullif(pos, 0), 0), 9) DESC, k LIMIT 1),
 final AS (SELECT method, kb, setting, block_id, label, context_count, prediction, prompt_tokens FROM said WHERE split = 'test' AND (threshold IS NULL OR (method, kb, setting) IN (SELECT (method, kb, setting) FROM locked))
   UNION ALL SELECT 'm0', NULL, 'k' || k, block_id, label, NULL, prediction, NULL FROM votes JOIN best_k USING (k) WHERE split = 'test')"""
)


def _experiment(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return X.run_experiment(hash_split(signed(held_traces(s, d))), templates(s, d))


def rag_predictions(s: SparkSession, d: str) -> DataFrame:
    """What every method says of every sampled test query."""
    return _experiment(s, d)[0].select("method", "kb", "setting", "block_id", "label", "context_count", "prediction", "prompt_tokens")


def rag_summary(s: SparkSession, d: str) -> DataFrame:
    """The scores of every run on the test queries."""
    run = _experiment(s, d)[0].withColumns({"query_seconds_uncached": F.lit(None).cast("double"), "candidate_count": F.lit(X.POOL), "filtered_out": F.lit(X.POOL) - F.col("context_count")})
    made = E.run_summary(run, "method", "kb", "setting")
    return made.select("method", "kb", "setting", "queries", "TP", "TN", "FP", "FN", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "average_contexts", "average_prompt_tokens")))


def threshold_locks(s: SparkSession, d: str) -> DataFrame:
    """The thresholds that are best on the validation queries."""
    return _experiment(s, d)[1].withColumns({c: F.round(c, 6) for c in ("threshold", "f1", "average_contexts")})


def context_distribution(s: SparkSession, d: str) -> DataFrame:
    """Test queries of every run by the number of contexts they were shown."""
    run = _experiment(s, d)[0].where("method <> 'm0'")
    return E.context_distribution(run, "method", "kb", "setting").select("method", "kb", "setting", F.explode("context_count_distribution").alias("contexts", "n"))


def prediction_identity(s: SparkSession, d: str) -> DataFrame:
    """Whether every run answers exactly the sampled test queries with their labels."""
    rows = hash_split(signed(held_traces(s, d)))
    queries = X.queries_of(rows).where("split = 'test'")
    return X.identity_violations(X.run_experiment(rows, templates(s, d))[0], queries, "method", "kb", "setting")


QUERIES = {"rag_predictions": rag_predictions, "rag_summary": rag_summary, "threshold_locks": threshold_locks, "context_distribution": context_distribution, "prediction_identity": prediction_identity}
_CELLS = "count(*) AS queries, count(*) FILTER (label = 'ANOMALY' AND prediction = 'ANOMALY') AS \"TP\", count(*) FILTER (label = 'NORMAL' AND prediction = 'NORMAL') AS \"TN\", count(*) FILTER (label = 'NORMAL' AND prediction = 'ANOMALY') AS \"FP\", count(*) FILTER (label = 'ANOMALY' AND prediction = 'NORMAL') AS \"FN\""
ORACLES = {
    "rag_predictions": _SQL + " SELECT method, kb, setting, block_id, label, context_count, prediction, prompt_tokens FROM final",
    "rag_summary": _SQL + f""", c AS (SELECT method, kb, setting, {_CELLS}, avg(context_count) AS average_contexts, coalesce(avg(prompt_tokens), 0) AS average_prompt_tokens FROM final GROUP BY ALL)
 SELECT method, kb, setting, queries, "TP", "TN", "FP", "FN", round(coalesce("TP" / nullif("TP" + "FP", 0), 0), 6) AS precision, round(coalesce("TP" / nullif("TP" + "FN", 0), 0), 6) AS recall,
  round(coalesce(2 * "TP" / nullif(2 * "TP" + "FP" + "FN", 0), 0), 6) AS f1, round(average_contexts, 6) AS average_contexts, round(average_prompt_tokens, 6) AS average_prompt_tokens FROM c""",
    "context_distribution": _SQL + " SELECT method, kb, setting, context_count::VARCHAR AS contexts, count(*) AS n FROM final WHERE method <> 'm0' GROUP BY ALL",
    "prediction_identity": _SQL + """, t AS (SELECT block_id, upper(label) AS label FROM q WHERE split = 'test'), runs AS (SELECT method, kb, setting, count(*) AS n, count(DISTINCT block_id) AS d FROM final GROUP BY ALL)
 SELECT 'predictions_of_unknown_queries' AS "check", count(*) AS violations FROM final WHERE block_id NOT IN (SELECT block_id FROM t) UNION ALL SELECT 'prediction_labels_differ', count(*) FROM final f JOIN t USING (block_id) WHERE f.label <> t.label
 UNION ALL SELECT 'repeated_predictions', coalesce(sum(n - d), 0)::BIGINT FROM runs UNION ALL SELECT 'missing_predictions', coalesce(sum((SELECT count(*) FROM t) - d), 0)::BIGINT FROM runs""",
    "threshold_locks": _SQL + " SELECT method, kb, setting, threshold, round(f1, 6) AS f1, round(average_contexts, 6) AS average_contexts FROM locked",
}
