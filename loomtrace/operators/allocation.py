"""Allocation of whole groups to splits near wanted shares."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np

#: A cycle counts as negative if it lowers the cost by more than this; costs are of the order of 1.
LEAST_GAIN = 1e-13


def allocate(bundles: np.ndarray, counts: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """How many components of each bundle go to each split.

    ``bundles`` has one row per bundle with the size of one of its components by label, ``counts`` the number of its
    components, ``shares`` the wanted share of each split. Every component goes to one split. The cost of a split is
    the squared deviation from its wanted rows, each label's deviation measured against that label's total.

    The integral part of the proportional flow is kept; the remaining components, largest first, take the arc with the
    least growth of the cost. Then negative cycles are cancelled, the most negative of a pair of splits first: a
    component moves from one split to the other, or two of different bundles change places. In the end no such cycle
    lowers the cost. (With components of different sizes the integral optimum is a partition problem; this is an
    optimum against all moves and exchanges.)"""
    share = np.asarray(shares, float) / np.sum(shares)
    size = np.c_[bundles.sum(1), bundles].astype(float)
    total = np.maximum((size * counts[:, None]).sum(0), 1)
    size, splits = size / total, range(len(share))
    flow = np.floor(counts[:, None] * share + 1e-9).astype(np.int64)
    off = flow.T @ size - share[:, None] * np.minimum(size.T @ counts, 1)

    def growth(split: int, change: np.ndarray) -> np.ndarray:
        return (change * (2 * off[split] + change)).sum(-1) / share[split]

    def send(bundle: int, split: int, n: int) -> None:
        flow[bundle, split] += n
        off[split] += n * size[bundle]

    for b in np.argsort(-size[:, 0], kind="stable"):
        for _ in range(int(counts[b] - flow[b].sum())):
            send(b, min(splits, key=lambda k: growth(k, size[b])), 1)
    still = False
    while not still:
        still = True
        for a, b in permutations(splits, 2):
            mine, theirs = np.flatnonzero(flow[:, a] > 0), np.flatnonzero(flow[:, b] > 0)
            if not len(mine):
                continue
            # what a gives to b, against each bundle that b gives back, or nothing
            back = np.r_[np.zeros((1, size.shape[1])), size[theirs]]
            best, cycle = -LEAST_GAIN, None
            for at in range(0, len(mine), 256):
                change = size[mine[at : at + 256], None] - back
                gain = growth(a, -change) + growth(b, change)
                i, j = np.unravel_index(gain.argmin(), gain.shape)
                if gain[i, j] < best:
                    best, cycle = gain[i, j], (mine[at + i], theirs[j - 1] if j else None)
            if cycle:
                still = False
                given, returned = cycle
                send(given, a, -1), send(given, b, 1)
                if returned is not None:
                    send(returned, b, -1), send(returned, a, 1)
    for label in range(bundles.shape[1]):  # every split gets every label, where there are enough components
        for k in splits:
            if not (flow[:, k] @ bundles[:, label]):
                rich = [(size[i, 0], i, a) for i in np.flatnonzero(bundles[:, label]) for a in splits if a != k and flow[i, a] > 0 and flow[:, a] @ (bundles[:, label] > 0) > 1]
                if rich:
                    _, i, a = min(rich)
                    send(i, a, -1), send(i, k, 1)
    return flow
