"""A hierarchical navigable small-world graph in numpy, built and searched many points at a time.

Each layer is a graph over the points whose drawn level reaches it (Malkov and Yashunin, 2016). Points enter in batches: all of
a batch descend the layers above, search the layer with a beam, and take neighbours by the diversity rule (one closer to
a chosen neighbour than to the point comes last); each chosen neighbour links back and prunes by the same rule.
"""

from __future__ import annotations

import pickle

import numpy as np

M, M0, BATCH = 24, 48, 512
_FAR = np.float32(-3)


class Layer:
    def __init__(self, ids: np.ndarray, width: int):
        self.ids = ids  # places of its points among all points, those of the layer above first
        self.links = np.full((len(ids), width), -1, np.int32)


def dots(vec: np.ndarray, i: np.ndarray, q: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Similarities of the pairs (vec[i], q[j]), of which 512 KB a side are taken at a time."""
    out = np.empty(len(i), np.float32)
    step = max(1, (1 << 17) // vec.shape[1])
    for a in range(0, len(i), step):
        np.einsum("kd,kd->k", vec[i[a : a + step]], q[j[a : a + step]], out=out[a : a + step])
    return out


def beam(vec: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``ef`` points (places, similarities, falling) found from each query's entry places."""
    n, b, expand = len(vec), len(q), max(3, ef // 8)
    out_ids, out_sims = np.full((b, ef), -1, np.int32), np.full((b, ef), _FAR, np.float32)
    e = np.sort(entry, 1)
    e[:, 1:][e[:, 1:] == e[:, :-1]] = -1
    row, col = np.nonzero(e >= 0)
    start = np.full(e.shape, _FAR, np.float32)
    start[row, col] = dots(vec, e[row, col], q, row)
    seen = np.zeros(b * n, bool)
    seen[row * n + e[row, col]] = True
    k = min(e.shape[1], ef)
    order = np.argsort(-start, 1)[:, :k]
    ids, sims, done = out_ids.copy(), out_sims.copy(), np.zeros((b, ef), bool)
    ids[:, :k], sims[:, :k] = np.take_along_axis(e, order, 1), np.take_along_axis(start, order, 1)
    live = np.arange(b)
    while True:
        fresh = ~done & (ids >= 0)
        some = fresh.any(1)
        if not some.all():
            out_ids[live[~some]], out_sims[live[~some]] = ids[~some], sims[~some]
            live, ids, sims, done, fresh = live[some], ids[some], sims[some], done[some], fresh[some]
        if not len(live):
            return out_ids, out_sims
        pick = fresh & (np.cumsum(fresh, 1) <= expand)
        done |= pick
        row, col = np.nonzero(pick)
        near = links[ids[row, col]]
        row = np.repeat(row, near.shape[1])[near.ravel() >= 0]
        at = live[row] * n + near[near >= 0]  # query and place as one number
        new = ~seen[at]
        row, at = row[new], at[new]
        seen[at] = True
        s = dots(vec, at - live[row] * n, q, live[row])
        better = np.flatnonzero(s > sims[row, -1])
        at, first = np.unique(at[better], return_index=True)
        if not len(at):
            continue
        row, s = row[better][first], s[better][first]
        count = np.bincount(row, minlength=len(live))
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        more = np.full((len(live), int(count.max())), -1, np.int32)
        more_sims = np.full(more.shape, _FAR, np.float32)
        more[row, place], more_sims[row, place] = at - live[row] * n, s
        all_ids, all_sims = np.concatenate([ids, more], 1), np.concatenate([sims, more_sims], 1)
        all_done = np.concatenate([done, np.zeros(more.shape, bool)], 1)
        top = np.argsort(-all_sims, 1, kind="stable")[:, :ef]
        ids, sims, done = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))


def choose(vec: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of each row of candidates the ``width`` to link with: diverse ones first, then the nearest of the others."""
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ids = np.where(sims > _FAR, ids, -1)
    out = np.full((len(ids), width), -1, np.int32)
    step = max(1, min(BATCH, (8 << 20) // max(1, ids.shape[1] * vec.shape[1])))
    for a in range(0, len(ids), step):
        i, s = ids[a : a + step], sims[a : a + step]
        v = vec[i]
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros(i.shape, bool)
        closest = np.full(i.shape, _FAR, np.float32)  # similarity of each candidate to the nearest kept one
        count = np.zeros(len(i), np.int64)
        for j in range(i.shape[1]):
            take = (i[:, j] >= 0) & (s[:, j] > closest[:, j]) & (count < width)
            kept[:, j] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
        rank = np.argsort(np.where(i < 0, 2, np.where(kept, 0, 1)), 1, kind="stable")[:, :width]
        got = np.take_along_axis(i, rank, 1)
        out[a : a + step, : got.shape[1]] = got
    return out


class Graph:
    def __init__(self, vec: np.ndarray, draw: np.ndarray, ef: int = 48):
        """vec: unit rows, float32. draw: uniform numbers in (0, 1], one a row, for the levels."""
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(M)).astype(np.int64)
        order = np.argsort(-level, kind="stable")
        self.vec = np.ascontiguousarray(vec[order], np.float32)  # so that each layer's points are its first rows
        self.layers: list[Layer] = []  # the highest first
        for l in range(int(level.max(initial=0)), -1, -1):
            self._build(Layer(order[: int((level >= l).sum())], M0 if l == 0 else M), ef)

    def _build(self, layer: Layer, ef: int) -> None:
        n, width = layer.links.shape
        vec = self.vec[:n]
        first = min(n, 2 * BATCH)
        if self.layers and len(self.layers[-1].ids) > first:
            first = self._from_above(vec, layer, ef)
        else:
            s = vec[:first] @ vec[:first].T
            np.fill_diagonal(s, _FAR)
            k = min(first, 2 * width)
            near = np.argpartition(-s, min(k, first - 1), 1)[:, :k].astype(np.int32) if first > 1 else np.zeros((first, 1), np.int32)
            layer.links[:first] = choose(vec, near, np.take_along_axis(s, near, 1), width)
        self._back(vec, layer, np.arange(first))
        a = first
        while a < n:
            b = min(n, a + BATCH)
            entry = self._descend(vec[a:b], layer.ids[:a])
            ids, sims = beam(vec[:a], layer.links, vec[a:b], entry, ef)
            own = vec[a:b] @ vec[a:b].T
            np.fill_diagonal(own, _FAR)
            k = min(M, b - a)
            near = np.argpartition(-own, min(k, b - a - 1), 1)[:, :k] if b - a > 1 else np.zeros((1, 1), np.int64)
            ids = np.concatenate([ids, (near + a).astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], 1)
            layer.links[a:b] = choose(vec, ids, np.where(ids >= 0, sims, _FAR), M)[:, :width] if width == M else np.pad(choose(vec, ids, np.where(ids >= 0, sims, _FAR), M), ((0, 0), (0, width - M)), constant_values=-1)
            self._back(vec, layer, np.arange(a, b))
            a = b
        self.layers.append(layer)

    def _from_above(self, vec: np.ndarray, layer: Layer, ef: int) -> int:
        """Links among the points of the layer above, found in its graph, as all of them enter before any other; returns how many they are.
        Places that a descent ends at are then in the layer, however many points the layer above has."""
        above = self.layers[-1]
        known = len(above.ids)
        for a in range(0, known, BATCH):
            b = min(known, a + BATCH)
            ids, sims = beam(vec[:known], above.links, vec[a:b], self._descend(vec[a:b], above.ids), ef)
            sims[ids == np.arange(a, b)[:, None]] = _FAR
            layer.links[a:b, :M] = choose(vec, ids, sims, M)
        return known

    @staticmethod
    def _back(vec: np.ndarray, layer: Layer, new: np.ndarray) -> None:
        """Links back from the chosen neighbours of new points; full lists are chosen again."""
        width = layer.links.shape[1]
        to = layer.links[new]
        at, col = np.nonzero(to >= 0)
        source, target = new[at].astype(np.int32), to[at, col]
        known = (layer.links[target] == source[:, None]).any(1)
        source, target = source[~known], target[~known]
        if not len(source):
            return
        s = dots(vec, source, vec, target)
        order = np.lexsort((-s, target))
        source, target, s = source[order], target[order], s[order]
        start = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        rank = np.arange(len(target)) - np.repeat(start, np.diff(np.append(start, len(target))))
        near = rank < width
        source, target, rank, s = source[near], target[near], rank[near], s[near]
        nodes = target[rank == 0]
        row = np.searchsorted(nodes, target)
        more = np.full((len(nodes), width), -1, np.int32)
        more[row, rank] = source
        both = np.concatenate([layer.links[nodes], more], 1)
        over = (both >= 0).sum(1) > width
        slim = both[~over]
        layer.links[nodes[~over]] = np.take_along_axis(slim, np.argsort(slim < 0, 1, kind="stable"), 1)[:, :width]
        full = nodes[over]
        for a in range(0, len(full), BATCH):
            own, i = full[a : a + BATCH], both[over][a : a + BATCH]
            sims = np.where(i >= 0, dots(vec, i.ravel(), vec, np.repeat(own, i.shape[1])).reshape(i.shape), _FAR)
            layer.links[own] = choose(vec, i, sims, width)

    def _descend(self, q: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Entry places in the layer under those built so far; its first points are the points of the layer above."""
        entry = np.zeros((len(q), 1), np.int64)
        for layer in self.layers if below is not None else self.layers[:-1]:
            ids, _ = beam(self.vec[: len(layer.ids)], layer.links, q, entry, 4)
            entry = np.where(ids >= 0, ids, ids[:, :1]).astype(np.int64)
        return entry

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Places among all points, -1 for none, and similarities, for unit rows q."""
        base = self.layers[-1]
        ids, sims = beam(self.vec, base.links, q, self._descend(q), min(ef, max(1, len(base.ids))))
        return np.where(ids >= 0, base.ids[ids], -1), sims

    def dump(self) -> bytes:
        return pickle.dumps([(x.ids, x.links) for x in self.layers], 5)

    @staticmethod
    def load(raw: bytes, vec: np.ndarray) -> Graph:
        """What dump() wrote of the graph over these rows."""
        g = Graph.__new__(Graph)
        g.layers = []
        for ids, links in pickle.loads(raw):  # noqa: S301  written by dump() in this job
            layer = Layer(ids, 0)
            layer.links = links
            g.layers.append(layer)
        g.vec = np.ascontiguousarray(vec[g.layers[-1].ids], np.float32)
        return g
