"""One experiment from traces to scored answers: queries, retrieval, selection, prompts, a classifier, tuning and test.

Every retrieval is ranked once for each query, up to the pool; a fixed selection takes the first k of it, an adaptive
one those with at least a threshold's score. The threshold and the neighbours' k are chosen on validation queries and
locked before test queries are asked."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.sequences import template_text
from loomtrace.operators import evaluation as E
from loomtrace.operators import retrieval as R
from loomtrace.operators.classify import Client, Stub, classify
from loomtrace.operators.prompts import messages
from loomtrace.operators.splits import sample_stratified
from loomtrace.session import shared_checkpoint

#: Weights of cosine, Jaccard and order of each kind of retrieval.
RETRIEVALS = {"semantic": (1.0, 0.0, 0.0), "structure": (0.5, 0.2, 0.3)}
POOL, SWEEP, QUANTILES, NEIGHBOURS = 10, (1, 3, 5, 10), (0.25, 0.5, 0.75), (1, 3, 5)
SAMPLE = {"Normal": 40, "Anomaly": 10}
_TUNED = {"semantic": ("m2", "m3"), "structure": ("m4", "m5")}


def queries_of(rows: DataFrame, counts: dict[str, int] = SAMPLE, seed: int = 42) -> DataFrame:
    """The sampled queries of validation and test: ``block_id``, ``split``, ``label``, ``event_ids``."""
    parts = [sample_stratified(rows.where(F.col("split") == split), counts, seed) for split in ("validation", "test")]
    return parts[0].unionByName(parts[1]).select("block_id", "split", "label", "event_ids")


def knowledge_of(rows: DataFrame) -> DataFrame:
    """The training sequences of each label, once: ``base_id`` (the smallest block), ``label``, ``event_ids``."""
    return rows.where("split = 'train'").groupBy("event_ids", "label").agg(F.min("block_id").alias("base_id"))


def ranked_pools(queries: DataFrame, knowledge: DataFrame, pool: int = POOL) -> DataFrame:
    """``block_id``, ``retrieval``, ``kb``, ``base_id``, ``label``, ``score``, ``rank``: the best of each knowledge base.

    The mixed base is the union of the two others, so its best are among theirs and nothing is scored twice."""
    asked, base = R.gram_cells(queries.select("block_id", "event_ids"), "event_ids"), R.gram_cells(knowledge, "event_ids")
    found = None
    for kind, weights in RETRIEVALS.items():
        for label in ("Normal", "Anomaly"):
            top = R.block_top(asked, base.where(F.col("label") == label), pool, R.structure_block("event_ids", weights), "block_id", "base_id")
            part = top.drop("rank").withColumns({"retrieval": F.lit(kind), "label": F.lit(label)})
            found = part if found is None else found.unionByName(part)
    every = found.withColumn("kb", F.explode(F.array(F.lower("label"), F.lit("mixed"))))
    order = Window.partitionBy("retrieval", "kb", "block_id").orderBy(F.desc("score"), "base_id")  # two pools at most
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def neighbour_votes(pools: DataFrame, queries: DataFrame, ks: Sequence[int] = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """M0: the predictions of every k from the nearest training sequences, and the k that is best on validation."""
    near = pools.where("retrieval = 'semantic' AND kb = 'mixed'").withColumns({"score": 2 * F.col("score") - 1, "label": F.upper("label")})
    votes = R.knn_votes(near, "block_id", ks).join(queries.select("block_id", "split", F.upper("label").alias("label")), "block_id")
    return votes, E.best_k(E.confusion(votes.where("split = 'validation'"), "k").withColumns({c: F.round(c, 9) for c in ("f1", "recall")}))


def contexts_of(pools: DataFrame, knowledge: DataFrame, queries: DataFrame, templates: dict[str, str], sweep: Sequence[int] = SWEEP, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """What every run shows for every query: ``method``, ``kb``, ``setting``, ``threshold``, ``block_id``, ``split``,
    ``label``, ``contexts`` (ARRAY<STRUCT<label, text>>), ``candidate_count``, ``text``.

    M1 shows none. Fixed runs are named by their k; adaptive ones by the quantile of the validation queries' pooled
    scores that is their threshold."""
    entry = F.struct("rank", "score", F.upper("label").alias("label"), "text")
    texts = knowledge.select("base_id", template_text(F.col("event_ids"), templates).alias("text"))
    gathered = pools.join(texts, "base_id").groupBy("block_id", "retrieval", "kb").agg(F.sort_array(F.collect_list(entry)).alias("pool"))  # `POOL` rows
    asked = queries.select("block_id", "split", F.upper("label").alias("label"), template_text(F.col("event_ids"), templates).alias("text"))
    both = gathered.join(asked, "block_id")
    scores = pools.join(asked.where("split = 'validation'").select("block_id"), "block_id")
    cut = scores.groupBy("retrieval", "kb").agg(F.percentile("score", F.array(*(F.lit(q) for q in quantiles))).alias("t"))  # the sampled queries' pools
    named = F.array(*(F.struct(F.lit(f"q{q:.2f}").alias("setting"), F.round(F.get("t", F.lit(i)), 6).alias("threshold")) for i, q in enumerate(quantiles)))
    shown = lambda keep: F.transform(F.filter("pool", keep), lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text")))
    method = lambda i: F.element_at(F.create_map(*(F.lit(x) for kind, names in _TUNED.items() for x in (kind, names[i]))), F.col("retrieval"))
    columns = ("method", "kb", "setting", "threshold", "block_id", "split", "label", "contexts", "text")
    fixed = both.withColumn("k", F.explode(F.array(*(F.lit(k) for k in sweep)))).withColumns(
        {"method": method(0), "setting": F.format_string("k%d", "k"), "threshold": F.lit(None).cast("double"), "contexts": shown(lambda x: x["rank"] <= F.col("k"))}
    )
    adaptive = both.join(cut.select("retrieval", "kb", F.inline(named)), ["retrieval", "kb"]).withColumns({"method": method(1), "contexts": shown(lambda x: F.round(x["score"], 6) >= F.col("threshold"))})
    none = F.array().cast("array<struct<label:string,text:string>>")
    alone = asked.withColumns({"method": F.lit("m1"), "kb": F.lit(None).cast("string"), "setting": F.lit(None).cast("string"), "threshold": F.lit(None).cast("double"), "contexts": none})
    return fixed.select(*columns).unionByName(adaptive.select(*columns)).unionByName(alone.select(*columns))


def answered(shown: DataFrame, model: str = "stub", make_client: Callable[[], Client] = Stub) -> DataFrame:
    """The rows of `contexts_of` with ``prediction`` and what the answers took; equal prompts are asked once."""
    chats = shown.withColumns({"chat": messages(F.col("text"), F.col("contexts")), "context_count": F.size("contexts")}).drop("contexts", "text")
    return classify(chats, model, make_client)[0].drop("chat", "cache_key")


def locks(validation: DataFrame) -> DataFrame:
    """``method``, ``kb``, ``setting``, ``threshold``, ``f1``, ``average_contexts`` of the adaptive run that is best on
    validation: by F1 to six decimals, then fewest contexts, then the smallest threshold."""
    runs = validation.where("split = 'validation' AND threshold IS NOT NULL")
    by = ("method", "kb", "setting", "threshold")
    rated = E.confusion(runs, *by).join(runs.groupBy(*by).agg(F.avg("context_count").alias("average_contexts")), [*by])
    best = F.max_by(F.struct("setting", "threshold", "f1", "average_contexts"), F.struct(F.round("f1", 6).alias("f"), (-F.col("average_contexts")).alias("c"), (-F.col("threshold")).alias("t")))
    return rated.groupBy("method", "kb").agg(best.alias("x")).select("method", "kb", "x.*")


def run_experiment(rows: DataFrame, templates: dict[str, str], counts: dict[str, int] = SAMPLE, make_client: Callable[[], Client] = Stub) -> tuple[DataFrame, DataFrame]:
    """Predictions of the test queries of all methods, and the locks.

    ``rows`` has block_id, split, label (Normal or Anomaly), event_ids. Predictions: ``method``, ``kb``, ``setting``,
    ``block_id``, ``label``, ``prediction``, ``context_count``, ``prompt_tokens``, ``request_count``, ``cache_hit``,
    ``new_api_calls``, ``latency_seconds``. Adaptive runs are tested with their locked threshold only, M0 with its locked
    k. An error is raised if validation lacks a label, since nothing can be tuned then."""
    queries = shared_checkpoint(queries_of(rows, counts))
    require_both_labels(queries)
    knowledge = shared_checkpoint(knowledge_of(rows))
    pools = shared_checkpoint(ranked_pools(queries, knowledge))
    said = shared_checkpoint(answered(contexts_of(pools, knowledge, queries, templates), make_client=make_client))
    locked = locks(said)
    chosen = said.where("split = 'test'").join(locked.select("method", "kb", F.col("setting").alias("_locked")), ["method", "kb"], "left")
    kept = chosen.where(F.col("threshold").isNull() | (F.col("setting") == F.col("_locked")))
    votes, k = neighbour_votes(pools, queries)
    nearest = votes.where("split = 'test'").join(F.broadcast(k), "k")  # one row
    columns = {"method": "string", "kb": "string", "setting": "string", "block_id": "string", "label": "string", "prediction": "string", "context_count": "int", "prompt_tokens": "long", "request_count": "int", "cache_hit": "boolean", "new_api_calls": "int", "latency_seconds": "double"}
    m0 = {"method": F.lit("m0"), "setting": F.format_string("k%d", "k")}
    without = [c for c in columns if c not in (*m0, "block_id", "label", "prediction")]
    neighbours = nearest.withColumns({**m0, **{c: F.lit(None).cast(columns[c]) for c in without}})
    return kept.select(*columns).unionByName(neighbours.select(*columns)), locked


def require_both_labels(queries: DataFrame) -> None:
    """Raise where a split of the sampled queries lacks a label."""
    labels = queries.groupBy("split").agg(F.count_distinct("label").alias("n")).collect()  # two rows
    if lacking := sorted({"validation", "test"} - {r["split"] for r in labels if r["n"] == 2}):
        raise ValueError(f"queries of both labels are needed in: {', '.join(lacking)}")


def identity_violations(predictions: DataFrame, queries: DataFrame, *run: str) -> DataFrame:
    """``check``, ``violations``: predictions of unknown queries, with another label than the query's, repeated in a run,
    and queries that a run lacks."""
    known = queries.select("block_id", F.upper("label").alias("_label"))
    joined = predictions.join(known, "block_id", "left")
    per_query = predictions.groupBy(*run, "block_id").agg(F.count("*").alias("n"))
    per_run = per_query.join(known, "block_id", "left_semi").groupBy(*run).agg(F.count("*").alias("have"), F.sum(F.col("n") - 1).alias("again"))
    total = F.broadcast(known.agg(F.count("*").alias("all")))  # one row
    counts = [
        joined.agg(F.lit("predictions_of_unknown_queries").alias("check"), F.count_if(F.col("_label").isNull()).alias("violations")),
        joined.agg(F.lit("prediction_labels_differ").alias("check"), F.count_if(F.col("label") != F.col("_label")).alias("violations")),
        per_run.agg(F.lit("repeated_predictions").alias("check"), F.coalesce(F.sum("again"), F.lit(0)).alias("violations")),
        per_run.join(total).agg(F.lit("missing_predictions").alias("check"), F.coalesce(F.sum(F.col("all") - F.col("have")), F.lit(0)).alias("violations")),
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


def run_name(*parts: str) -> Column:
    """Names joined by ``_``, nulls left out."""
    return F.concat_ws("_", *(F.col(p) for p in parts))
