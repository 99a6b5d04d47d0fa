"""What the settings of experiments may hold: one declaration of keys, kinds and ranges, and a walker that checks it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from math import inf, isclose, isfinite

ABSENT = object()
Check = Callable[[object], bool]


def whole(least: int = 1) -> Check:
    return lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= least


def real(low: float = -inf, high: float = inf) -> Check:
    return lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and isfinite(x) and low <= x <= high


def flag(x: object) -> bool:
    return isinstance(x, bool)


def just(*allowed: object) -> Check:
    return lambda x: x in allowed


def some(each: Check, distinct: bool = False) -> Check:
    """A list with at least one item, all of which pass; without repetition where ``distinct``."""
    return lambda x: isinstance(x, list) and len(x) > 0 and all(map(each, x)) and not (distinct and any(y in x[:i] for i, y in enumerate(x)))


def sample(x: object) -> bool:
    """``all``, a number of rows, or a number for each label."""
    count = whole()
    return x == "all" or count(x) or (isinstance(x, dict) and {"normal", "anomaly"} <= {*x} and all(map(count, x.values())))


@dataclass(frozen=True)
class Key:
    """A setting: where it stands (keys joined by points; several places if it has several names), what it may be, and
    whether it may be absent."""

    places: tuple[str, ...]
    check: Check
    optional: bool = False

    def found(self, config: Mapping) -> object:
        return next((x for p in self.places if (x := at(config, p)) is not ABSENT), ABSENT)

    def holds(self, config: Mapping) -> bool:
        value = self.found(config)
        return self.optional if value is ABSENT else self.check(value)


def key(places: str, check: Check, optional: bool = False) -> Key:
    return Key(tuple(places.split("|")), check, optional)


def at(config: object, place: str) -> object:
    """What stands at a place, or `ABSENT`."""
    for name in place.split("."):
        if not isinstance(config, Mapping) or name not in config:
            return ABSENT
        config = config[name]
    return config


_PARTS = {"semantic": "cosine", "template": "jaccard", "sequence": "normalized_lcs"}
_HYBRID = "retrieval.structure_aware"
#: Every setting that experiments read.
KEYS = (
    key("models", some(lambda x: isinstance(x, str), distinct=True)),
    key("methods", some(just("m0", "m1", "m2", "m3", "m4", "m5"), distinct=True)),
    key("sampling.seed", whole(least=-(2**63))),
    key("sampling.validation|sampling.validation_size", sample),
    key("sampling.test|sampling.test_size", sample),
    key("knn.feature", just("sequence_ngram_hash")),
    key("knn.k_candidates", some(whole())),
    key("knn.ngram_range", some(whole())),
    key("knn.hash_dim", whole()),
    key("knn.binary", flag, optional=True),
    key("retrieval.semantic.similarity", just("cosine")),
    *(key(f"{_HYBRID}.{part}.similarity", just(kind)) for part, kind in _PARTS.items()),
    *(key(f"{_HYBRID}.{part}.weight", real(0, 1)) for part in _PARTS),
    key(f"{_HYBRID}.semantic.normalization", just("cosine_to_01")),
    key("selection.fixed.contexts_sweep|selection.fixed.contexts", lambda x: whole()(x) or some(whole(), distinct=True)(x)),
    key("selection.adaptive.candidate_pool", whole()),
    key("selection.adaptive.threshold_quantiles", some(real(0, 1))),
)
#: What several settings must satisfy together, by the place that is reported.
TOGETHER: dict[str, Callable[[Mapping], bool]] = {
    "models": lambda c: {*c["models"]} <= {*c.get("model_profiles", {})},
    "knn.ngram_range": lambda c: len(c["knn"]["ngram_range"]) == 2 and c["knn"]["ngram_range"] == sorted(c["knn"]["ngram_range"]),
    _HYBRID: lambda c: isclose(sum(weights(c)), 1),
}


def weights(config: Mapping) -> list[float]:
    """The weights of the parts of structural similarity: semantic, template, sequence."""
    return [at(config, f"{_HYBRID}.{part}.weight") for part in _PARTS]


def problems(config: Mapping) -> list[str]:
    """The places of settings that are missing or wrong, in the order of their declaration; empty for sound ones."""
    wrong = [k.places[0] for k in KEYS if not k.holds(config)]
    joint = [p for p, rule in TOGETHER.items() if not any(w == p or w.startswith(p + ".") for w in wrong) and not rule(config)]
    return wrong + joint
