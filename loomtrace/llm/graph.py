"""A robust-pruned directed graph over unit vectors, and beam search in it, for groups of queries at once.

Points are inserted in batches that double the graph: greedy searches in the graph so far propose neighbours, relaxed
distance pruning keeps those that no kept neighbour is much nearer to (so edges stay diverse), and reverse edges are
added and pruned alike (Subramanya and others, 2019). Distances are 1 - cosine, half the squared Euclidean distance.

Queries are sorted by the pivot they are nearest to and searched in groups that share one frontier: a node that is in
the beam of any query of the group is expanded once, and what its edges lead to is compared with all queries of the
group in one matrix product. A query thus sees all that its own beam search would see and what its neighbours in the
group come across, at a fraction of the time that separate walks take.
"""

from __future__ import annotations

import numpy as np

#: Edges kept by pruning, edges a node may collect before it is pruned again, width of a search while building.
DEGREE, ROOM, BUILD_WIDTH = 20, 28, 16
#: A candidate goes when a kept neighbour is this many times nearer to it than the node is.
RELAXATION = 1.3
#: Queries that share a frontier; points that are linked with each other to begin with; entry points.
GROUP, FIRST, ENTRIES = 192, 256, 24
#: Columns of which the largest value is taken to bound a beam's worst place.
LANES = 64
_FAR = np.float32(-2)


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int = 0):
        """``vectors``: unit rows, float32. Repeated rows are allowed."""
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = self.none = len(vectors)  # the number that stands for no node
        self.edges = np.full((n, ROOM), n, np.int32)
        self.degree = np.zeros(n, np.int32)
        self._seen, self._done, self._mark = (np.zeros(n + 1, bool) for _ in range(3))
        self._done[n] = True
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.pivots = order[: max(min(n, FIRST), n // GROUP)]
        self.entries = order[:ENTRIES]
        place = self._nearest_pivot(self.vectors)
        done = 0
        while done < n:
            batch = order[done : max(FIRST, 2 * done)]
            batch = batch[np.argsort(place[batch], kind="stable")]
            size = len(batch) if not done else GROUP
            for at in range(0, len(batch), size):
                self._insert(batch[at : at + size], done > 0)
            done += len(batch)

    def search(self, queries: np.ndarray, width: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found for each query, best first, and their cosines; -1 where there are fewer.

        ``starts`` gives a node to start from for each query, else the entry points do."""
        queries = np.ascontiguousarray(queries, np.float32)
        ids = np.empty((len(queries), width), np.int32)
        sims = np.empty((len(queries), width), np.float32)
        order = np.argsort(self._nearest_pivot(queries), kind="stable")
        for at in range(0, len(order), GROUP):
            own = order[at : at + GROUP]
            ids[own], sims[own] = self._walk(queries[own], self.entries if starts is None else starts[own], width)
        ids[ids == self.none] = -1
        return ids, sims

    def _nearest_pivot(self, points: np.ndarray) -> np.ndarray:
        if not len(self.pivots) or not len(points):
            return np.zeros(len(points), np.int64)
        pivots = self.vectors[self.pivots].T
        return np.concatenate([(points[at : at + 8192] @ pivots).argmax(1) for at in range(0, len(points), 8192)])

    def _walk(self, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of one group: the best ``width`` nodes of each query, best first, ``none`` where there are fewer."""
        seen, done, mark = self._seen, self._done, self._mark
        ids = np.full((len(queries), width), self.none, np.int32)
        sims = np.full((len(queries), width), _FAR, np.float32)
        near, met = np.unique(starts), []
        while len(near):
            seen[near] = True
            met.append(near)
            ids, sims = _merged(ids, sims, near, queries @ self.vectors.take(near, axis=0).T)
            beams = ids.ravel()
            # nodes of the beams that are not expanded yet; several rounds may lead to nothing new
            while len(fresh := beams[~done.take(beams)]):
                done[fresh] = True
                mark[self.edges.take(fresh, axis=0).ravel()] = True
                mark[self.none] = False
                near = np.flatnonzero(mark & ~seen)
                mark[:] = False
                if len(near):
                    break
            else:
                break
        for nodes in met:
            seen[nodes] = done[nodes] = False
        return ids, sims

    def _insert(self, group: np.ndarray, search: bool) -> None:
        """Link nodes to what searches in the graph propose and to the nearest of their own group."""
        points = self.vectors[group]
        among = points @ points.T
        np.fill_diagonal(among, _FAR)
        if search:
            ids, sims = self._walk(points, self.entries, BUILD_WIDTH)
        else:
            ids, sims = np.full((len(group), BUILD_WIDTH), self.none, np.int32), np.full((len(group), BUILD_WIDTH), _FAR, np.float32)
        ids, sims = _merged(ids, sims, group, among)
        self._link(group, np.where(sims > _FAR, ids, self.none), sims)

    def _prune(self, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray | None = None) -> np.ndarray:
        """Up to ``DEGREE`` diverse candidates for each node, padded by ``none``; candidates may be ``none`` or the node,
        and come best first where their cosines are given."""
        points = self.vectors.take(cand, axis=0, mode="clip")
        if sims is None:
            sims = np.where(cand < self.none, np.matmul(points, self.vectors[nodes][:, :, None])[:, :, 0], _FAR)
            order = np.argsort(-sims, axis=1, kind="stable")
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            points = np.take_along_axis(points, order[:, :, None], 1)
        far = 1 - sims
        between = RELAXATION * (1 - np.matmul(points, points.transpose(0, 2, 1)))
        alive = (cand < self.none) & (cand != nodes[:, None])
        keep = np.zeros(cand.shape, bool)
        count = np.zeros(len(nodes), np.int64)
        for j in range(cand.shape[1]):
            chosen = alive[:, j] & (count < DEGREE)
            keep[:, j] = chosen
            count += chosen
            alive &= ~((between[:, j] <= far) & chosen[:, None])
        kept = np.full((len(nodes), DEGREE), self.none, np.int32)
        row, column = np.nonzero(keep)
        kept[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = cand[row, column]
        return kept

    def _set(self, nodes: np.ndarray, kept: np.ndarray) -> None:
        self.edges[nodes] = self.none
        self.edges[nodes, : kept.shape[1]] = kept
        self.degree[nodes] = (kept < self.none).sum(1)

    def _link(self, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        kept = self._prune(nodes, cand, sims)
        self._set(nodes, kept)
        real = kept.ravel() < self.none
        source, target = np.repeat(nodes, DEGREE)[real], kept.ravel()[real]
        known = (self.edges[target] == source[:, None]).any(1)
        source, target = source[~known], target[~known]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        sizes = np.diff(np.r_[starts, len(target)])
        place = np.arange(len(target)) - np.repeat(starts, sizes)
        slot = self.degree[target] + place
        fits = slot < ROOM
        heads = target[starts]
        full = self.degree[heads] + sizes > ROOM
        over = heads[full]
        if len(over):
            extra = np.full((len(over), int(sizes[full].max())), self.none, np.int32)
            row_of = np.full(self.none, -1, np.int64)
            row_of[over] = np.arange(len(over))
            mine = row_of[target] >= 0
            extra[row_of[target[mine]], place[mine]] = source[mine]
            self._set(over, self._prune(over, np.concatenate([self.edges[over], extra], axis=1)))
            fits &= ~mine
        self.edges[target[fits], slot[fits]] = source[fits]
        np.add.at(self.degree, target[fits], 1)


def _merged(ids: np.ndarray, sims: np.ndarray, nodes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beams (``ids``, ``sims``, best first) after the cosines ``more`` of ``nodes`` with every query."""
    width, lanes = ids.shape[1], max(LANES, 2 * ids.shape[1])
    bound = sims[:, -1]
    steps = more.shape[1] // lanes
    if steps > 1:  # at least ``width`` lanes hold a value as large as this
        largest = more[:, : steps * lanes].reshape(len(more), steps, lanes).max(1)
        bound = np.maximum(bound, np.partition(largest, lanes - width, axis=1)[:, lanes - width] - np.float32(1e-7))
    at = np.flatnonzero(more > bound[:, None])
    row, column = np.divmod(at, more.shape[1])
    count = np.bincount(row, minlength=len(more))
    wide = width + int(count.max(initial=0))
    if wide == width:
        return ids, sims
    all_sims = np.full((len(more), wide), _FAR, np.float32)
    all_ids = np.zeros((len(more), wide), np.int32)
    all_sims[:, :width], all_ids[:, :width] = sims, ids
    slot = width + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    all_sims[row, slot], all_ids[row, slot] = more.ravel()[at], nodes[column]
    best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
