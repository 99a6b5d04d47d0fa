"""A mix of sources in which each has its target share of the tokens.

Method: iterative proportional fitting. Tokens are summed by cell (source, language, topic); the cells' weights, that
is how often their documents come on average, are raked to the source, language and topic marginals, never above the
source's cap, and end on the source marginal. Documents then get the integral part of their cell's weight, and one
copy more with the rest as probability, by a hash of their key. That probability is calibrated for each source: one
factor, found from histograms of hash over probability, makes the source's tokens meet their target within a few
documents.

The driver gets sums of cells only: sources are those of the weights table, languages are tags of two or three letters,
topics number ``TOPICS``, histograms have ``BUCKETS`` places a source; and of the topics' model, ``SEEDS`` documents' bags at
once and ``TOPICS`` sums of ``PLACES`` places. No rows are dropped or gathered; every document is weighed.

Topics come from a model that is trained here: spherical k-means over hashed bags of tokens, weighted by their inverse
document frequency, of all documents. A text is encoded once; its bag is kept beside its number of tokens, and every
pass reads all bags: one counts in how many documents a place occurs, some draw first centres by distance from those
there are, and each round sums the directions of all documents by nearest centre. Directions and centres are whole
numbers whose sums are exact, so that the model is the same however the rows are spread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.encode import VOCABULARY, encoder_of
from loomtrace.llm.truncation import source_key
from loomtrace.session import shared_checkpoint

BUCKETS, ROUNDS = 4096, 200
#: Topics, places of a bag of tokens (a power of two), first centres drawn in one pass, documents in one matrix product.
TOPICS, PLACES, SEEDS, AT_ONCE = 16, 1024, 4, 256
#: The length of directions and centres, the parts of one in which a bag holds damped counts, the share by which a round of k-means has to come nearer to go on.
UNIT, PARTS, NEARER = 2**20, 2**17, 1e-3
OTHER = "(other)"
# Three-letter names of languages and the two-letter ones.
LONG_NAMES = {"eng": "en", "vie": "vi", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "zho": "zh", "chi": "zh", "jpn": "ja"}


class Mix(NamedTuple):
    mixed: DataFrame
    report: DataFrame
    marginals: DataFrame


def language_key(lang: Column) -> Column:
    """The primary part of a language tag, two or three letters, in lower case and two letters where there are;
    ``(other)`` for null and anything else."""
    first = F.lower(F.regexp_extract(F.btrim(lang), r"^([A-Za-z]{2,3})(?:[-_].*)?\z", 1))
    known = F.create_map(*(F.lit(x) for pair in LONG_NAMES.items() for x in pair))
    return F.when(F.coalesce(first, F.lit("")) == "", OTHER).otherwise(F.coalesce(F.element_at(known, first), first))


def bags(ids: Sequence[Sequence[int]]) -> list[bytes]:
    """Bags of token ids, hashed to `PLACES`: four bytes for each place that occurs, with its damped count and number."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
    counts = np.bincount(np.repeat(np.arange(len(ids)), sizes) * PLACES + flat * 2_654_435_761 % 2**32 % PLACES, minlength=len(ids) * PLACES)
    at = np.flatnonzero(counts)
    packed = (np.rint(np.log1p(counts[at]) * PARTS).astype(np.int64) * PLACES + at % PLACES).astype("<u4").tobytes()
    ends = 4 * np.searchsorted(at, np.arange(len(ids) + 1) * PLACES)
    return [packed[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Directions(NamedTuple):
    """The directions of documents, with whole numbers for components: each component's document, place and value, and
    the same as a matrix."""

    row: np.ndarray
    place: np.ndarray
    value: np.ndarray
    matrix: np.ndarray


def directions(bags: Sequence[bytes], rarity: np.ndarray) -> Directions:
    """Bags as directions of length `UNIT`, places weighted by ``rarity``; an empty bag is all zeros."""
    packed = np.frombuffer(b"".join(bags), "<u4")
    row = np.repeat(np.arange(len(bags)), np.fromiter(map(len, bags), np.int64, len(bags)) // 4)
    place = (packed % PLACES).astype(np.int64)
    weight = (packed // PLACES) / PARTS * rarity[place]
    value = np.rint(weight * (UNIT / np.maximum(np.sqrt(np.bincount(row, weight * weight, len(bags))), 1e-12))[row])
    matrix = np.zeros((len(bags), PLACES))
    matrix[row, place] = value
    return Directions(row, place, value, matrix)


def _slices(column: pa.Array) -> Iterator[list]:
    return (column.slice(at, AT_ONCE).to_pylist() for at in range(0, len(column), AT_ONCE))


def _summed(bagged: DataFrame, size: int, add: Callable[[list[bytes], np.ndarray], None]) -> np.ndarray:
    """``size`` whole numbers that ``add`` sums over all bags, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for own in _slices(batch.column(0)):
                add(own, sums)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(sums[held])], names=["at", "n"])

    sums = np.zeros(size, np.int64)
    found = bagged.select("_bag").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # size rows at most
    sums[found["at"].to_numpy()] = found["n"].to_numpy()
    return sums


def _rarity(bagged: DataFrame) -> np.ndarray:
    """The inverse document frequency of every place, over all documents."""

    def add(bags: list[bytes], sums: np.ndarray) -> None:
        sums[:PLACES] += np.bincount(np.frombuffer(b"".join(bags), "<u4") % PLACES, minlength=PLACES)
        sums[PLACES] += len(bags)

    sums = _summed(bagged, PLACES + 1, add)
    return np.log((1 + sums[PLACES]) / (1 + sums[:PLACES])) + 1


def _first_centres(bagged: DataFrame, rarity: np.ndarray) -> np.ndarray:
    """Up to `TOPICS` documents' directions. All documents take part in each draw, with a chance in proportion to their
    distance from the nearest centre there is (k-means++, `SEEDS` at a time); documents that equal one are not drawn."""
    centres = np.zeros((0, PLACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.concatenate([_far(directions(own, rarity).matrix, centres) for own in _slices(batch.column(2))] or [np.zeros(0)])
            chance = (batch.column(1).to_numpy().view(np.uint64) >> np.uint64(11)).astype(float)
            race = np.divide(-np.log((chance + 0.5) / 2**53), far, out=np.full(len(far), np.inf), where=far > 0)
            best = np.argsort(race, kind="stable")[:SEEDS]
            best = pa.array(best[np.isfinite(race[best])])
            yield pa.RecordBatch.from_arrays([pa.array(race).take(best), batch.column(0).take(best), batch.column(2).take(best)], names=["race", "_draw", "_bag"])

    for turn in range(TOPICS):  # every turn adds one at least
        raced = bagged.select("_draw", F.xxhash64("_draw", F.lit(turn)).alias("chance"), "_bag").mapInArrow(run, "race double, _draw long, _bag binary")
        first = [bytes(r["_bag"]) for r in raced.orderBy("race", "_draw", "_bag").limit(SEEDS).collect()]
        for own in directions(first, rarity).matrix:
            if len(centres) < TOPICS and _far(own[None], centres)[0] > 0:
                centres = np.concatenate([centres, own[None]])
        if not first or len(centres) == TOPICS:
            break
    return centres


def _far(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """One less the cosine of the nearest centre, 0 up to the rounding of directions."""
    if not len(centres):
        return np.ones(len(matrix))
    far = 1 - (matrix @ centres.T).max(1) / UNIT**2
    return np.where(far > 1e-4, far, 0.0)


def fit_topics(bagged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The places' rarity and up to `TOPICS` centres of all documents; of none, one centre of zeros.

    ``bagged`` has ``_bag`` and ``_draw``, a number for each document by which first centres are drawn."""
    rarity = _rarity(bagged)
    centres = _first_centres(bagged, rarity)
    if not len(centres):
        return rarity, np.zeros((1, PLACES))

    def add(bags: list[bytes], sums: np.ndarray) -> None:
        own = directions(bags, rarity)
        cosines = own.matrix @ centres.T
        nearest = cosines.argmax(1)
        sums[:-1] += np.bincount(nearest[own.row] * PLACES + own.place, own.value, centres.size).astype(np.int64)
        sums[-1] += int((cosines.max(1) // UNIT).sum())

    near = 0
    while True:
        *sums, now = _summed(bagged, centres.size + 1, add).tolist()
        means = np.array(sums, float).reshape(centres.shape)
        norm = np.linalg.norm(means, axis=1, keepdims=True)
        centres = np.where(norm > 0, np.rint(means / np.maximum(norm, 1e-12) * UNIT), centres)
        if now <= near * (1 + NEARER):
            return rarity, centres
        near = now


def sized_documents(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """``key``, the columns of ``keep``, ``n_tokens`` BIGINT and ``topic`` STRING of every document.

    Null, empty and blank texts have the topic ``(other)``, null and empty ones no token. The topics of a table depend
    on its rows alone, and on all of them. Repeated keys stay repeated; an empty table gives no row."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    n = 1 + len(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            sizes, held = [], []
            for texts in _slices(batch.column(n + 1)):
                ids = [encoder(t) for t in texts]
                sizes += map(len, ids)
                held += bags([x if t and t.strip() else () for x, t in zip(ids, texts)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=[*batch.schema.names[: n + 1], "n_tokens", "_bag"])

    drawn = df.select(key, *keep, F.xxhash64(key, text).alias("_draw"), text)
    bagged = shared_checkpoint(drawn.mapInArrow(count, f"{fields}, _draw long, n_tokens long, _bag binary"))
    rarity, topics = fit_topics(bagged.where(F.length("_bag") > 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for held in _slices(batch.column(n + 1)):
                nearest = (directions(held, rarity).matrix @ topics.T).argmax(1)
                names += [f"topic {i + 1}" if x else OTHER for i, x in zip(nearest.tolist(), held)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(names, pa.string())], names=[*batch.schema.names[: n + 1], "topic"])

    return bagged.select(key, *keep, "n_tokens", "_bag").mapInArrow(assign, f"{fields}, n_tokens long, topic string")


def rake(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], caps: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells so that the weighted tokens meet the targets of the first axis, capped, and come near those of
    the others. ``axes`` number the class of each cell, ``targets`` give each class's tokens, ``caps`` each cell's
    largest weight. A class that its caps keep below its target gets as much as they allow."""
    weight = np.minimum(caps, targets[0].sum() / max(1.0, tokens.sum()))

    def fit(axis: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
        now = np.bincount(axis, tokens * weight, len(target))
        scale = np.divide(target, now, out=np.ones_like(now), where=now > 0)
        return weight * scale[axis]

    for _ in range(rounds):
        before = weight
        for axis, target in [*zip(axes[1:], targets[1:]), (axes[0], targets[0])]:
            weight = np.minimum(fit(axis, target, weight), caps)
        if np.abs(weight - before).max(initial=0) < 1e-9:
            break
    for _ in range(rounds):  # what caps took goes to the source's other cells
        weight = np.minimum(fit(axes[0], targets[0], weight), caps)
    return weight


def mix_sources(df: DataFrame, key: str, weights: list[tuple[str, float, int]], total_tokens: float | None = None) -> Mix:
    """A mix, its report and what it comes to by language and topic.

    ``df`` has ``key`` (unique), ``source``, ``lang``, ``topic`` and ``n_tokens``; ``weights`` are the sources of the
    mix with target weight and largest number of copies of a document. The mix has ``key``, ``source``, ``lang``,
    ``topic``, ``n_tokens`` and ``copies`` (at least 1); the report one row per source: ``source``, ``target_share``, ``reachable_share`` (the
    target among the sources that have tokens), ``available_tokens``, ``target_tokens``, ``mix_tokens``, ``actual_share``, ``n_docs``, ``n_copies``, ``unused_tokens``
    (of documents that are not in the mix), ``at_cap`` (all the source has, as often as it may come, is no more than its
    target, so that it bounds the mix or falls short), ``met`` (within 0.005 of its target). The marginals have one row
    for each language and topic: ``axis``, ``value``, ``available_tokens``, ``target_share`` (that of the documents of
    the mix's sources), ``mix_tokens``, ``actual_share``.

    Sources compare as `source_key`; documents of others, and those with null source, are left out. Without
    ``total_tokens`` the mix is as large as can be while every source that has tokens meets its share; sources without
    tokens leave theirs to the others in proportion, and the report shows both shares. A larger total leaves capped
    sources short. Documents without tokens are not in the mix. Weights of one source are added, its largest cap holds;
    null or negative weights count 0. An empty table gives an empty mix and a report of zeros."""
    spark = df.sparkSession
    shares: dict[str, float] = defaultdict(float)
    caps: dict[str, int] = defaultdict(int)
    for source, weight, repeats in weights:
        name = (source or "").strip(" \t\r\n").lower().replace("-", "_")
        if name:
            shares[name] += max(0.0, weight or 0.0)
            caps[name] = max(caps[name], repeats or 0)
    whole = sum(shares.values()) or 1.0
    shares = {name: share / whole for name, share in shares.items()}
    names = sorted(shares)

    rows = shared_checkpoint(
        df.select(F.col(key).alias("key"), source_key(F.col("source")).alias("source"), F.coalesce("lang", F.lit(OTHER)).alias("lang"), F.coalesce("topic", F.lit(OTHER)).alias("topic"), "n_tokens")
        .where(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    )
    known = rows
    cells = known.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")).collect()

    tokens = np.array([c["n"] for c in cells], float)
    numbered = [{v: i for i, v in enumerate(names if axis == "source" else sorted({c[axis] for c in cells}))} for axis in ("source", "lang", "topic")]
    axes = [np.array([numbers[c[axis]] for c in cells], np.int64) for numbers, axis in zip(numbered, ("source", "lang", "topic"))]
    have = np.bincount(axes[0], tokens, len(names)) if cells else np.zeros(len(names))
    share = np.array([shares[n] for n in names])
    cap = np.array([caps[n] for n in names], float)
    usable = (have > 0) & (share > 0) & (cap > 0)
    own_share = np.where(usable, share, 0) / max(share[usable].sum(), 1e-300)
    if total_tokens is None:
        total_tokens = (cap * have / np.where(usable, own_share, 1))[usable].min() if usable.any() else 0.0
    target = own_share * total_tokens
    if cells:
        reach = np.minimum(target, cap * have).sum()
        marginals = [np.bincount(axis, tokens, len(numbers)) / tokens.sum() * reach for axis, numbers in zip(axes[1:], numbered[1:])]
        weight = rake(tokens, axes, [target, *marginals], np.where(usable, cap, 0)[axes[0]])
    else:
        weight = np.zeros(0)

    schema = "source string, lang string, topic string, weight double"
    table = spark.createDataFrame([(c["source"], c["lang"], c["topic"], float(w)) for c, w in zip(cells, weight)], schema)
    base = F.floor(F.col("weight") + 1e-9)
    part = F.greatest(F.col("weight") - base, F.lit(0.0))
    chance = F.shiftrightunsigned(F.xxhash64("key", F.lit("mix")), 11) / F.lit(float(2**53))
    drawn = known.join(F.broadcast(table), ["source", "lang", "topic"]).select(  # one row for each cell
        "key", "source", "lang", "topic", "n_tokens", base.alias("base"), F.when(part > 1e-9, chance / part).alias("x")
    )
    # the factor of a source: the place on the line of x up to which documents get one copy more
    bounds = {name: (0.0, 4.0) for name in names}
    need = dict(zip(names, np.minimum(target, cap * have)))
    for r in drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("base")).alias("n")).collect():
        need[r["source"]] -= r["n"]
    for finest in (False, True):
        low, width = (F.element_at(F.create_map(*(v for n, b in bounds.items() for v in (F.lit(n), F.lit(f(b))))), F.col("source")) for f in (lambda b: b[0], lambda b: (b[1] - b[0]) / BUCKETS))
        bucket = F.floor((F.col("x") - low) / width).alias("b")
        histogram = defaultdict(dict)
        if names:
            inside = drawn.where(F.col("x").isNotNull()).select("source", bucket, "n_tokens").where(F.col("b").between(0, BUCKETS - 1))
            for r in inside.groupBy("source", "b").agg(F.sum("n_tokens").alias("n")).collect():
                histogram[r["source"]][r["b"]] = r["n"]
        for name in names:
            start, stop = bounds[name]
            step = (stop - start) / BUCKETS
            for b, n in sorted(histogram[name].items()):
                if n > need[name]:
                    nearer = b + 1 if finest and 2 * need[name] > n else b
                    bounds[name] = (start + nearer * step, start + (b + 1) * step)
                    break
                need[name] -= n
            else:
                bounds[name] = (stop, stop + step)
    factor = F.element_at(F.create_map(*(v for n, b in bounds.items() for v in (F.lit(n), F.lit(b[0])))), F.col("source")) if names else F.lit(0.0)
    mixed = shared_checkpoint(
        drawn.withColumn("copies", (F.col("base") + F.coalesce((F.col("x") < factor).cast("int"), F.lit(0))).cast("int")).where("copies > 0").select(F.col("key").alias(key), "source", "lang", "topic", "n_tokens", "copies")
    )
    wanted = spark.createDataFrame([(n, float(s), float(o), int(h), float(t), bool(h > 0 and c * h <= t * (1 + 1e-9))) for n, s, o, h, t, c in zip(names, share, own_share, have, target, cap)], "source string, target_share double, reachable_share double, available_tokens long, target_tokens double, at_cap boolean")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum("n_tokens").alias("used"))
    report = wanted.join(got, "source", "left").na.fill(0, ["mix_tokens", "n_docs", "n_copies", "used"])
    everything = got.agg(F.sum("mix_tokens").alias("all"))
    report = report.join(F.broadcast(everything)).select(  # one row
        "source", "target_share", "reachable_share", "available_tokens", F.round("target_tokens").cast("long").alias("target_tokens"), "mix_tokens",
        F.coalesce(F.try_divide(F.col("mix_tokens").cast("double"), F.col("all")), F.lit(0.0)).alias("actual_share"), "n_docs", "n_copies",
        (F.col("available_tokens") - F.col("used")).alias("unused_tokens"), "at_cap",
    )
    held = spark.createDataFrame([(axis, value, int(n)) for axis in ("lang", "topic") for value, n in _sums(cells, axis)], "axis string, value string, available_tokens long")
    parts = F.explode(F.array(*(F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("value")) for axis in ("lang", "topic"))))
    in_mix = mixed.select((F.col("n_tokens") * F.col("copies")).alias("n"), parts.alias("p")).groupBy("p.axis", "p.value").agg(F.sum("n").alias("mix_tokens"))
    by_axis = Window.partitionBy("axis")  # one row for each language and topic
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(by_axis)), F.lit(0.0))
    marginals = held.join(in_mix, ["axis", "value"], "left").na.fill(0, ["mix_tokens"]).select("axis", "value", "available_tokens", share("available_tokens").alias("target_share"), "mix_tokens", share("mix_tokens").alias("actual_share"))
    return Mix(mixed, report.withColumn("met", F.abs(F.col("actual_share") - F.col("target_share")) <= 0.005), marginals)


def _sums(cells: Sequence, axis: str) -> list[tuple[str, int]]:
    """Tokens of each value of an axis."""
    sums: dict[str, int] = defaultdict(int)
    for c in cells:
        sums[c[axis]] += c["n"]
    return sorted(sums.items())
