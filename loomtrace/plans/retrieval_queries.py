"""Retrieval, voting, selection and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.vectors import cosine, unit
from loomtrace.operators import evaluation as E
from loomtrace.operators import retrieval as R
from loomtrace.operators.splits import stratified_split
from loomtrace.plans.base import RAW_SQL, TRACES_SQL, held_traces, raw_rows
from loomtrace.plans.preparation_queries import _LABELS_SQL, _labels
from loomtrace.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T = "WITH " + TRACES_SQL
SWEEP, POOL = tuple(range(1, 11)), 10


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every hundredth vector) and knowledge base (all vectors) of embeddings; the three first classes are
    anomalies."""
    all_rows = table(s, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") < 3, "ANOMALY").otherwise("NORMAL").alias("label"))
    return all_rows.where(F.col("vec_id") % 100 == 0), all_rows


def _ranked(s: SparkSession, d: str, k: int = POOL) -> DataFrame:
    queries, base = _vectors(s, d)
    top = R.block_top(queries.select("vec_id", "embedding"), base.select(F.col("vec_id").alias("base_id"), "embedding"), k, R.cosine_block("embedding", "embedding"), "vec_id", "base_id", leave_out_self=True)
    return top.join(base.select(F.col("vec_id").alias("base_id"), "label"), "base_id")


_TOP = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN label < 3 THEN 'ANOMALY' ELSE 'NORMAL' END AS label FROM embeddings),
 scored AS (SELECT q.vec_id, b.vec_id AS base_id, b.label, q.label AS actual, round(list_cosine_similarity(q.e, b.e), 9) AS score FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
 ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, base_id)::INT AS rank FROM scored) WHERE rank <= 10)"""
query("cosine_topk", _TOP + " SELECT vec_id, base_id, rank, round(score, 6) AS score, label FROM ranked")(
    lambda s, d: _ranked(s, d).select("vec_id", "base_id", "rank", F.round("score", 6).alias("score"), "label")
)
query("cosine_columns", _TOP + " SELECT vec_id, base_id, round(score, 6) AS score FROM scored")(  # the same scores in column expressions
    lambda s, d: _column_scores(s, d)
)


def _column_scores(s: SparkSession, d: str) -> DataFrame:
    queries, base = _vectors(s, d)
    asked = queries.select("vec_id", unit(F.col("embedding")).alias("q"))  # a stated query set against all rows; broadcast if its size allows
    return base.select(F.col("vec_id").alias("base_id"), unit(F.col("embedding")).alias("b")).join(asked, F.col("vec_id") != F.col("base_id")).select("vec_id", "base_id", F.round(F.round(cosine(F.col("q"), F.col("b")), 9), 6).alias("score"))


_VOTES = _TOP + """, ks AS (SELECT unnest([1, 3, 5]) AS k),
 at_ AS (SELECT vec_id, actual, k, label, 1 - score AS dist, max((1 - score <= 1e-7)::INT) OVER (PARTITION BY vec_id, k) AS z FROM ranked JOIN ks ON rank <= k),
 votes AS (SELECT vec_id, any_value(actual) AS actual, k, coalesce(sum(CASE WHEN z = 1 THEN (dist <= 1e-7)::INT ELSE 1 / greatest(dist, 1e-7) END) FILTER (label = 'ANOMALY'), 0) AS a,
   coalesce(sum(CASE WHEN z = 1 THEN (dist <= 1e-7)::INT ELSE 1 / greatest(dist, 1e-7) END) FILTER (label = 'NORMAL'), 0) AS n FROM at_ GROUP BY vec_id, k),
 said AS (SELECT vec_id, k, actual, CASE WHEN round(a - n, 6) > 0 THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction FROM votes)"""
query("knn_predict", _VOTES + " SELECT vec_id, k, prediction FROM said")(lambda s, d: R.knn_votes(_ranked(s, d), "vec_id", (1, 3, 5)))
_COUNTS = "count(*) AS queries, count(*) FILTER (actual = 'NORMAL') AS \"Normal\", count(*) FILTER (actual = 'ANOMALY') AS \"Anomaly\", count(*) FILTER (actual = 'ANOMALY' AND prediction = 'ANOMALY') AS \"TP\", count(*) FILTER (actual = 'NORMAL' AND prediction = 'NORMAL') AS \"TN\", count(*) FILTER (actual = 'NORMAL' AND prediction = 'ANOMALY') AS \"FP\", count(*) FILTER (actual = 'ANOMALY' AND prediction = 'NORMAL') AS \"FN\", count(*) FILTER (prediction IS NULL OR prediction NOT IN ('NORMAL', 'ANOMALY')) AS bad"
_RATES = """CASE WHEN bad = 0 THEN round(coalesce("TP" / nullif("TP" + "FP", 0), 0), 9) END AS precision, CASE WHEN bad = 0 THEN round(coalesce("TP" / nullif("TP" + "FN", 0), 0), 9) END AS recall,
 CASE WHEN bad = 0 THEN round(coalesce(2 * "TP" / nullif(2 * "TP" + "FP" + "FN", 0), 0), 9) END AS f1"""


def _knn_rates(s: SparkSession, d: str) -> DataFrame:
    votes = R.knn_votes(_ranked(s, d), "vec_id", (1, 3, 5)).join(_vectors(s, d)[0].select("vec_id", "label"), "vec_id")
    return E.confusion(votes, "k")


query("knn_rates", _VOTES + f', c AS (SELECT k, {_COUNTS} FROM said GROUP BY k) SELECT k, queries, "TP", "TN", "FP", "FN", {_RATES} FROM c')(
    lambda s, d: _knn_rates(s, d).select("k", "queries", "TP", "TN", "FP", "FN", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))
)
query("knn_k_selection", _VOTES + f", c AS (SELECT k, {_COUNTS} FROM said GROUP BY k), r AS (SELECT k, {_RATES} FROM c) SELECT k FROM r ORDER BY f1 DESC, recall DESC, k LIMIT 1")(
    lambda s, d: E.best_k(_knn_rates(s, d).withColumns({c: F.round(c, 9) for c in ("f1", "recall")}))
)


def _structure(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (blocks whose row id is divisible by 100) and all distinct sequences, by smallest block."""
    rows = held_traces(s, d)
    base = rows.groupBy("event_ids").agg(F.min("block_id").alias("base_id"))
    return rows.where(F.col("row_id") % 100 == 0).select("block_id", "event_ids"), base


def _structure_top(s: SparkSession, d: str, weights: tuple[float, float, float], k: int = 3, vector: bool = False) -> DataFrame:
    queries, base = _structure(s, d)
    if vector:
        queries, base = R.gram_cells(queries, "event_ids"), R.gram_cells(base, "event_ids")
    top = R.block_top(queries, base, k, R.structure_block("event_ids", weights), "block_id", "base_id")
    return top.select("block_id", "base_id", "rank", F.round("score", 6).alias("score"))


_BASE = T + """, base AS (SELECT event_ids AS b, min(block_id) AS base_id FROM traces GROUP BY 1), q AS (SELECT block_id, event_ids AS a FROM traces WHERE row_id % 100 = 0),"""
_JACCARD = "len(list_intersect(a, b)) / (len(list_distinct(a)) + len(list_distinct(b)) - len(list_intersect(a, b)))"
_LCS = """list_reduce(a, lambda row_, x: list_reduce(range(1, len(b) + 1), lambda made, j: list_append(made, CASE WHEN b[j] = x THEN row_[j] + 1 ELSE greatest(row_[j + 1], made[j]) END), [0::BIGINT]), list_transform(range(0, len(b) + 1), lambda i: 0::BIGINT))[len(b) + 1] / greatest(len(a), len(b))"""
_RANKED = " ranked AS (SELECT block_id, base_id, score, row_number() OVER (PARTITION BY block_id ORDER BY score DESC, base_id)::INT AS rank FROM scored) SELECT block_id, base_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 3"
query("jaccard_topk", _BASE + f" scored AS (SELECT block_id, base_id, round({_JACCARD}, 9) AS score FROM q, base)," + _RANKED)(lambda s, d: _structure_top(s, d, (0, 1.0, 0)))
query("lcs_topk", _BASE + f" scored AS (SELECT block_id, base_id, round({_LCS}, 9) AS score FROM q, base)," + _RANKED)(lambda s, d: _structure_top(s, d, (0, 0, 1.0)))


@query("jaccard_columns", _BASE + f" scored AS (SELECT block_id, base_id, round({_JACCARD}, 6) AS score FROM q, base) SELECT * FROM scored")
def jaccard_columns(s: SparkSession, d: str) -> DataFrame:
    """The Jaccard scores in column expressions, a stated query set against all rows."""
    return R.jaccard_pairs(*_structure(s, d), "event_ids", "block_id", "base_id")


_GRAMS = """ grams AS (SELECT id, unnest(CASE WHEN len(e) < 2 THEN e ELSE list_concat(list_transform(range(1, len(e)), lambda i: e[i] || chr(31) || e[i + 1]),
   CASE WHEN len(e) >= 3 THEN list_transform(range(1, len(e) - 1), lambda i: e[i] || chr(31) || e[i + 1] || chr(31) || e[i + 2]) ELSE [] END) END) AS gram FROM (SELECT base_id AS id, b AS e FROM base UNION SELECT block_id, a FROM q)),
 cells AS (SELECT id, ('0x' || substr(md5(gram), 1, 15))::BIGINT % 1024 AS bucket, count(*) AS n FROM grams GROUP BY ALL),
 norms AS (SELECT id, sqrt(sum(n * n)) AS norm FROM cells GROUP BY id),"""
query("gram_cosine_topk", _BASE + _GRAMS + """ dots AS (SELECT x.id AS block_id, y.id AS base_id, sum(x.n * y.n) AS dot FROM cells x JOIN cells y USING (bucket) WHERE x.id IN (SELECT block_id FROM q) AND y.id IN (SELECT base_id FROM base) GROUP BY ALL),
 scored AS (SELECT q.block_id, base.base_id, round((least(1, coalesce(dot, 0) / nq.norm / nb.norm) + 1) / 2, 9) AS score FROM q JOIN base ON true LEFT JOIN dots ON dots.block_id = q.block_id AND dots.base_id = base.base_id
   JOIN norms nq ON nq.id = q.block_id JOIN norms nb ON nb.id = base.base_id),""" + _RANKED)(lambda s, d: _structure_top(s, d, (1.0, 0, 0), vector=True))

query("hybrid_topk", _BASE + _GRAMS + f""" dots AS (SELECT x.id AS block_id, y.id AS base_id, sum(x.n * y.n) AS dot FROM cells x JOIN cells y USING (bucket) WHERE x.id IN (SELECT block_id FROM q) AND y.id IN (SELECT base_id FROM base) GROUP BY ALL),
 scored AS (SELECT q.block_id, base.base_id, round(0.5::DOUBLE * (least(1, coalesce(dot, 0) / nq.norm / nb.norm) + 1) / 2 + 0.2::DOUBLE * {_JACCARD} + 0.3::DOUBLE * {_LCS}, 9) AS score FROM q JOIN base ON true LEFT JOIN dots ON dots.block_id = q.block_id AND dots.base_id = base.base_id
   JOIN norms nq ON nq.id = q.block_id JOIN norms nb ON nb.id = base.base_id),""" + _RANKED)(lambda s, d: _structure_top(s, d, (0.5, 0.2, 0.3), vector=True))

query("fixed_selection_sweep", _TOP + ", ks AS (SELECT unnest(range(1, 11))::INT AS k) SELECT vec_id, k, count(*) AS contexts, count(*) FILTER (label = 'ANOMALY') AS anomalies, round(avg(score), 6) AS mean_score FROM ranked JOIN ks ON rank <= k GROUP BY ALL")(
    lambda s, d: R.select_fixed(_ranked(s, d), SWEEP).groupBy("vec_id", "k").agg(F.count("*").alias("contexts"), F.count_if(F.col("label") == "ANOMALY").alias("anomalies"), F.round(F.avg("score"), 6).alias("mean_score"))
)
query("score_quantiles", _TOP + " SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS quantile, round(unnest(quantile_cont(score::DOUBLE, [0.25, 0.5, 0.75])), 6) AS threshold FROM ranked")(
    lambda s, d: R.score_quantiles(_ranked(s, d), POOL).withColumn("threshold", F.round("threshold", 6))
)


def _adaptive(s: SparkSession, d: str) -> DataFrame:
    """Predictions for each threshold: the majority label of the passing contexts, NORMAL without any or in a tie."""
    ranked, (queries, _) = _ranked(s, d), _vectors(s, d)
    thresholds = F.broadcast(R.score_quantiles(ranked, POOL).withColumn("threshold", F.round("threshold", 6)))  # three rows
    asked = queries.select("vec_id", F.col("label").alias("actual")).join(thresholds)
    passing = ranked.select("vec_id", "label", "score").join(thresholds, F.round("score", 6) >= F.col("threshold")).groupBy("vec_id", "quantile").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "ANOMALY").alias("a"))
    return asked.join(passing, ["vec_id", "quantile"], "left").na.fill(0, ["n", "a"]).withColumn("prediction", F.when(2 * F.col("a") > F.col("n"), "ANOMALY").otherwise("NORMAL"))


_ADAPTIVE = _TOP + """, th AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS quantile, round(unnest(quantile_cont(score::DOUBLE, [0.25, 0.5, 0.75])), 6) AS threshold FROM ranked),
 asked AS (SELECT vec_id, label AS actual, quantile, threshold FROM v, th WHERE vec_id % 100 = 0),
 passing AS (SELECT vec_id, quantile, count(*) AS n, count(*) FILTER (label = 'ANOMALY') AS a FROM ranked, th WHERE round(score, 6) >= threshold GROUP BY ALL),
 chosen AS (SELECT asked.*, coalesce(n, 0) AS n, coalesce(a, 0) AS a, CASE WHEN 2 * coalesce(a, 0) > coalesce(n, 0) THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction FROM asked LEFT JOIN passing USING (vec_id, quantile))"""
query("adaptive_selection", _ADAPTIVE + ", size AS (SELECT count(*) AS k FROM v) SELECT vec_id, quantile, n AS passing_count, k - n AS filtered_out, prediction FROM chosen, size")(
    lambda s, d: _adaptive(s, d).select("vec_id", "quantile", F.col("n").alias("passing_count"), (F.lit(_vectors(s, d)[1].count()) - F.col("n")).alias("filtered_out"), "prediction")
)


def _threshold_runs(s: SparkSession, d: str) -> DataFrame:
    rows = _adaptive(s, d)
    rates = E.confusion(rows, "quantile", "threshold", label="actual")
    return rates.join(rows.groupBy("quantile").agg(F.avg("n").alias("average_contexts")), "quantile")


_TRUNS = _ADAPTIVE + f", c AS (SELECT quantile, threshold, avg(n) AS average_contexts, {_COUNTS} FROM chosen GROUP BY quantile, threshold), r AS (SELECT *, {_RATES} FROM c)"
query("threshold_choice", _TRUNS + " SELECT quantile, threshold, round(f1, 6) AS f1, round(average_contexts, 6) AS average_contexts FROM r ORDER BY round(f1, 6) DESC, average_contexts, threshold LIMIT 1")(
    lambda s, d: E.best_threshold(_threshold_runs(s, d)).withColumns({c: F.round(c, 6) for c in ("f1", "average_contexts")})
)


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Fixed runs for every k and the adaptive run of each quantile, by majority of the contexts' labels."""
    actual = _vectors(s, d)[0].select("vec_id", F.col("label").alias("actual"))
    fixed = R.select_fixed(_ranked(s, d), SWEEP).groupBy("vec_id", "k").agg(F.when(2 * F.count_if(F.col("label") == "ANOMALY") > F.count("*"), "ANOMALY").otherwise("NORMAL").alias("prediction")).join(actual, "vec_id")
    names = lambda method, selection, setting: {"model_profile": F.lit("stub"), "method": F.lit(method), "retrieval": F.lit("semantic"), "selection": F.lit(selection), "kb": F.lit("mixed"), "context_setting": setting}
    a = E.confusion(fixed, "k", label="actual").withColumns(names("m2", "fixed", F.format_string("k%d", "k"))).withColumns({"contexts": F.col("k"), "average_contexts": F.col("k").cast("double")}).drop("k")
    b = _threshold_runs(s, d).withColumns(names("m3", "adaptive", F.format_string("q%.2f", "quantile"))).withColumn("contexts", F.lit(None).cast("int")).drop("quantile", "threshold")
    return a.unionByName(b).withColumn("is_tuning_run", F.lit(False))


_REPORT = _TRUNS + f""", ks AS (SELECT unnest(range(1, 11))::INT AS k),
 fx AS (SELECT vec_id, any_value(actual) AS actual, k, CASE WHEN 2 * count(*) FILTER (label = 'ANOMALY') > count(*) THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction FROM ranked JOIN ks ON rank <= k GROUP BY vec_id, k),
 fc AS (SELECT k, {_COUNTS} FROM fx GROUP BY k),
 runs AS (SELECT 'm2' AS method, 'fixed' AS selection, 'k' || k AS context_setting, k AS contexts, k::DOUBLE AS average_contexts, "TN", "FP", "FN", "TP", {_RATES} FROM fc
   UNION ALL SELECT 'm3', 'adaptive', printf('q%.2f', quantile), NULL, average_contexts, "TN", "FP", "FN", "TP", precision, recall, f1 FROM r),
 fmax AS (SELECT f1 AS fixed_kmax_f1 FROM runs WHERE contexts = 10), fbest AS (SELECT f1 AS best_fixed_f1, context_setting AS best_setting FROM runs WHERE selection = 'fixed' ORDER BY f1 DESC, contexts LIMIT 1)"""
query("comparison_report", _REPORT + """ SELECT method, context_setting, round(f1, 6) AS f1, CASE WHEN selection = 'adaptive' THEN round(1 - average_contexts / 10, 6) ELSE 0 END AS context_reduction_vs_fixed_contexts,
 CASE WHEN selection = 'adaptive' THEN round(fixed_kmax_f1, 6) END AS fixed_kmax_f1, CASE WHEN selection = 'adaptive' THEN round(best_fixed_f1, 6) END AS best_fixed_f1, CASE WHEN selection = 'adaptive' THEN best_setting END AS best_fixed_context_setting,
 CASE WHEN selection = 'adaptive' THEN round(f1 - best_fixed_f1, 6) END AS delta_f1_vs_best_fixed, 'TN=' || "TN" || ' FP=' || "FP" || ' FN=' || "FN" || ' TP=' || "TP" AS confusion_matrix,
 f1 = max(f1) OVER (PARTITION BY method) AS best_in_method_kb, f1 = max(f1) OVER () AS best_overall FROM runs, fmax, fbest""")(
    lambda s, d: E.comparison_report(_runs(s, d).withColumn("f1", F.round("f1", 9)), SWEEP).select(
        "method", "context_setting", *(F.round(c, 6).alias(c) for c in ("f1", "context_reduction_vs_fixed_contexts", "fixed_kmax_f1", "best_fixed_f1", "delta_f1_vs_best_fixed")), "best_fixed_context_setting", "confusion_matrix", "best_in_method_kb", "best_overall"
    )
)
query("heat_pivot", _REPORT + " SELECT method, max(f1) FILTER (selection = 'fixed') AS fixed, max(f1) FILTER (selection = 'adaptive') AS adaptive FROM runs GROUP BY method")(
    lambda s, d: E.heat_pivot(_runs(s, d).withColumn("f1", F.round("f1", 9)), "method", "selection", ("fixed", "adaptive"))
)


def _source_predictions(s: SparkSession, d: str) -> DataFrame:
    """The label table as the truth and the traces' own label as the prediction, null where it can't be read."""
    rows = raw_rows(s, d).where("block_id IS NOT NULL").select("block_id", F.upper("label").alias("prediction"), "latency", "event_ids")
    return rows.join(_labels(s, d).select("block_id", F.upper("truth").alias("label")), "block_id").where("label IS NOT NULL")


_SOURCE = "WITH " + RAW_SQL + ", " + _LABELS_SQL + ", said AS (SELECT upper(truth) AS actual, upper(label) AS prediction, latency, event_ids FROM raw JOIN labels USING (block_id) WHERE truth IS NOT NULL)"
query("confusion_metrics", _SOURCE + f""", c AS (SELECT {_COUNTS}, count(*) FILTER (prediction IS NULL AND actual = 'NORMAL') AS invalid_normal, count(*) FILTER (prediction IS NULL AND actual = 'ANOMALY') AS invalid_anomaly FROM said)
 SELECT queries, "Normal", "Anomaly", "TP", "TN", "FP", "FN", invalid_normal, invalid_anomaly, round(bad / queries, 9) AS invalid_output_rate, {_RATES} FROM c""")(
    lambda s, d: E.confusion(_source_predictions(s, d)).withColumns({c: F.round(c, 9) for c in ("invalid_output_rate", "precision", "recall", "f1")})
)
query("confusion_rows", _SOURCE + f""", c AS (SELECT {_COUNTS} FROM said) SELECT unnest(['NORMAL', 'NORMAL', 'ANOMALY', 'ANOMALY']) AS actual, unnest(['NORMAL', 'ANOMALY', 'NORMAL', 'ANOMALY']) AS predicted, unnest(["TN", "FP", "FN", "TP"]) AS n FROM c""")(
    lambda s, d: E.confusion_rows(E.confusion(_source_predictions(s, d)))
)


query("vector_overlap_audit", _TOP + """, k AS (SELECT list_transform(e, lambda x: round(x, 7)) AS key, count(*) AS matches, count(*) FILTER (label = 'ANOMALY') AS anomaly_matches, count(*) FILTER (label = 'NORMAL') AS normal_matches, min(vec_id) AS first_match FROM v WHERE vec_id % 100 <> 0 GROUP BY 1),
 q AS (SELECT vec_id, label, list_transform(e, lambda x: round(x, 7)) AS key FROM v WHERE vec_id % 100 = 0)
 SELECT vec_id, label, matches, anomaly_matches, normal_matches, first_match, coalesce(anomaly_matches > 0 AND normal_matches > 0, false) AS ambiguous FROM q LEFT JOIN k USING (key)""")(
    lambda s, d: R.vector_audit(_vectors(s, d)[0], _vectors(s, d)[1].where("vec_id % 100 <> 0").withColumn("base_id", F.col("vec_id")), "vec_id", "embedding")
)


def _audit(s: SparkSession, d: str) -> DataFrame:
    """Held-out blocks of the stratified split (row ids divisible by 100) against all training sequences with their labels."""
    rows = stratified_split(held_traces(s, d))
    base = rows.where("split = 'train'").groupBy("event_ids", "label").agg(F.min("block_id").alias("base_id"))
    asked = rows.where("split <> 'train' AND row_id % 100 = 0").select("block_id", "label", "event_ids")
    return R.overlap_audit(R.gram_cells(asked, "event_ids"), R.gram_cells(base, "event_ids"))


_AUDIT = T + """, strat AS (SELECT *, CASE WHEN at_ < floor(total * 0.15::DOUBLE) THEN 'validation' WHEN at_ < 2 * floor(total * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM
   (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || block_id), block_id) - 1 AS at_, count(*) OVER (PARTITION BY label) AS total FROM traces)),
 q AS (SELECT block_id, label, event_ids AS a FROM strat WHERE split <> 'train' AND row_id % 100 = 0), base AS (SELECT event_ids AS b, label, min(block_id) AS base_id FROM strat WHERE split = 'train' GROUP BY ALL),""" + _GRAMS + """
 keys AS (SELECT id, string_agg(bucket || ':' || round(n / norm, 7), ' ' ORDER BY bucket) AS key FROM cells JOIN norms USING (id) GROUP BY id),
 groups_ AS (SELECT key, count(*) FILTER (label = 'Anomaly') AS na, count(*) FILTER (label = 'Normal') AS nn, min(base_id) AS nearest FROM base JOIN keys ON id = base_id GROUP BY key),
 known AS (SELECT block_id, label, true AS exact, na > 0 AND nn > 0 AS ambiguous, nearest, 1.0::DOUBLE AS score, CASE WHEN na > nn THEN 'ANOMALY' ELSE 'NORMAL' END AS prediction FROM q JOIN keys ON id = block_id JOIN groups_ USING (key)),
 others AS (SELECT * FROM q WHERE block_id NOT IN (SELECT block_id FROM known)),
 dots AS (SELECT x.id AS block_id, y.id AS base_id, sum(x.n * y.n) AS dot FROM cells x JOIN cells y USING (bucket) WHERE x.id IN (SELECT block_id FROM others) AND y.id IN (SELECT base_id FROM base) GROUP BY ALL),
 near AS (SELECT o.block_id, o.label, base.base_id, upper(base.label) AS prediction, round(least(1, coalesce(dot, 0) / nq.norm / nb.norm), 9) AS score FROM others o JOIN base ON true LEFT JOIN dots ON dots.block_id = o.block_id AND dots.base_id = base.base_id JOIN norms nq ON nq.id = o.block_id JOIN norms nb ON nb.id = base.base_id
   QUALIFY row_number() OVER (PARTITION BY o.block_id ORDER BY round(least(1, coalesce(dot, 0) / nq.norm / nb.norm), 9) DESC, base.base_id) = 1),
 audited AS (SELECT block_id, label, exact, ambiguous, nearest, score, prediction FROM known UNION ALL SELECT block_id, label, false, false, base_id, score, prediction FROM near)"""
query("overlap_audit", _AUDIT + " SELECT block_id, label, exact, ambiguous, nearest, round(score, 6) AS score, prediction FROM audited")(lambda s, d: _audit(s, d).withColumn("score", F.round("score", 6)))
query("audit_ratios", _AUDIT + """ SELECT count(*) AS queries, round(avg(exact::INT), 9) AS exact_share, round(avg(ambiguous::INT), 9) AS ambiguous_share, round(avg((upper(label) = prediction)::INT), 9) AS accuracy,
 round(avg((upper(label) = prediction)::INT) FILTER (exact), 9) AS exact_accuracy, round(avg((upper(label) = prediction)::INT) FILTER (NOT exact), 9) AS other_accuracy FROM audited""")(
    lambda s, d: R.audit_ratios(_audit(s, d)).select("queries", *(F.round(c, 9).alias(c) for c in ("exact_share", "ambiguous_share", "accuracy", "exact_accuracy", "other_accuracy")))
)
