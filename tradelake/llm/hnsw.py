"""A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors in lockstep."""

from __future__ import annotations

import numpy as np

#: Links of a node (twice as many on the lowest layer), beam while building, vectors inserted or sought together, nodes of a beam that
#: are followed in one step.
LINKS, BUILD_BEAM, BATCH, STRIDE = 16, 32, 256, 8
_NONE = -1
#: Entries of a beam are numbers that sort as they are wanted, the nearest first: similarity, id, and 1 where the node is still to be followed.
_FREE = np.int64(1 << 62)


def _entry(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (((1 << 30) - ((sims.astype(np.float64) + 2) * (1 << 28)).astype(np.int64)) << 32) | (ids << 1) | 1


def _diverse(near: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidate ids with similarities near (-inf: none): up to most of them, nearest first, leaving
    out a candidate that is nearer to one already chosen; -1 fills up."""
    order = np.argsort(-near, axis=1, kind="stable")
    near, ids = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)
    v = vectors[np.maximum(ids, 0)]
    among = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    worst = np.full(ids.shape, -np.inf, np.float32)  # nearest chosen candidate of each
    count = np.zeros(len(ids), np.int64)
    for j in range(ids.shape[1]):
        take = (near[:, j] > -np.inf) & (near[:, j] > worst[:, j]) & (count < most)
        chosen[:, j] = take
        count += take
        worst = np.where(take[:, None], np.maximum(worst, among[:, j]), worst)
    rest = (near > -np.inf) & ~chosen  # fill up with the nearest that were left out
    spare = np.cumsum(rest, axis=1) <= (most - count)[:, None]
    chosen |= rest & spare
    out = np.full((len(ids), most), _NONE, np.int64)
    rows, cols = np.nonzero(chosen)
    out[rows, (np.cumsum(chosen, axis=1) - 1)[rows, cols]] = ids[rows, cols]
    return out


class Graph:
    def __init__(self, dim: int, seed: int = 7):
        self.vectors = np.zeros((0, dim), np.float32)
        self.level = np.zeros(0, np.int64)
        self.layers: list[np.ndarray] = []  # links of each node, -1 where it has none; all nodes on every layer
        self.entry = _NONE
        self.random = np.random.default_rng(seed)

    def __len__(self) -> int:
        return len(self.vectors)

    def _grow(self, vectors: np.ndarray) -> np.ndarray:
        n, m = len(self), len(vectors)
        level = (-np.log(1 - self.random.random(m)) / np.log(LINKS)).astype(np.int64)
        self.vectors = np.concatenate([self.vectors, vectors])
        self.level = np.concatenate([self.level, level])
        while len(self.layers) <= level.max():
            width = LINKS * (2 if not self.layers else 1)
            self.layers.append(np.full((n, width), _NONE, np.int64))
        self.layers = [np.concatenate([x, np.full((m, x.shape[1]), _NONE, np.int64)]) for x in self.layers]
        return np.arange(n, n + m)

    def _greedy(self, queries: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        """Walk to the nearest node that single steps on a layer reach."""
        best = np.einsum("qd,qd->q", queries, self.vectors[at])
        active = np.arange(len(queries))
        while len(active):
            links = self.layers[layer][at[active]]
            sims = np.einsum("qd,qkd->qk", queries[active], self.vectors[np.maximum(links, 0)])
            sims[links < 0] = -np.inf
            j = sims.argmax(1)
            top = sims[np.arange(len(active)), j]
            moved = top > best[active]
            active = active[moved]
            at[active], best[active] = links[moved, j[moved]], top[moved]
        return at

    def beam(self, queries: np.ndarray, start: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, ids) of the beam around each query, nearest first; -inf where it isn't full. The best STRIDE nodes that
        are still to be followed are followed together, and what they lead to is sorted in once."""
        q, n = len(queries), len(self)
        beams = np.full((q, width), _FREE)
        beams[:, 0] = _entry(np.einsum("qd,qd->q", queries, self.vectors[start]), start)
        seen = np.zeros(q * n, bool)
        seen[np.arange(q) * n + start] = True
        active, place, now = np.arange(q), np.arange(q), beams.copy()
        while len(active):
            waiting = (now & 1).astype(bool)
            live = waiting.any(1)
            if not live.all():
                beams[active[~live]] = now[~live]
                active, now, waiting = active[live], now[live], waiting[live]
                place[active] = np.arange(len(active))
            rows, cols = np.nonzero(waiting & (np.cumsum(waiting, axis=1) <= STRIDE))
            now[rows, cols] ^= 1
            links = self.layers[layer].take((now[rows, cols] >> 1) & 0x7FFFFFFF, axis=0)
            cells = (active[rows, None] * n + links)[links >= 0]
            cells = np.sort(cells[~seen.take(cells)])
            cells = cells[np.append(True, cells[1:] != cells[:-1])] if len(cells) else cells  # a node may be led to twice
            seen[cells] = True
            query = cells // n
            node = cells - query * n
            new, row = _entry(np.einsum("kd,kd->k", queries.take(query, axis=0), self.vectors.take(node, axis=0)), node), place.take(query)
            near = new < now[row, -1]
            new, row = new[near], row[near]
            if len(new):
                count = np.bincount(row, minlength=len(active))
                more = np.full((len(active), int(count.max())), _FREE)
                more[row, np.arange(len(row)) - (np.cumsum(count) - count)[row]] = new
                now = np.sort(np.concatenate([now, more], axis=1), axis=1)[:, :width]
        full = beams < _FREE
        sims = ((1 << 30) - (beams >> 32)) / (1 << 28) - 2
        return np.where(full, sims, -np.inf).astype(np.float32), np.where(full, (beams >> 1) & 0x7FFFFFFF, _NONE)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """beam() on the lowest layer, entered by way of the upper ones."""
        at = np.full(len(queries), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._greedy(queries, at, layer)
        return self.beam(queries, at, min(width, len(self)), 0)

    def add(self, vectors: np.ndarray, near: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Insert up to BATCH vectors: each layer's neighbours come from the graph so far and from the batch itself. near: what
        search() finds for them with BUILD_BEAM, where that is known."""
        old = len(self)
        top = len(self.layers) - 1
        ids = self._grow(vectors.astype(np.float32))
        own = self.vectors[ids]
        level = self.level[ids]
        at = np.full(len(ids), self.entry, np.int64)
        within = own @ own.T
        np.fill_diagonal(within, -np.inf)
        for layer in range(len(self.layers) - 1, -1, -1):
            member = np.nonzero(level >= layer)[0]
            if near is not None and not layer:
                sims, found = near
            elif old and layer <= top:
                sims, found = self.beam(own[member], at[member], min(BUILD_BEAM, old), layer) if len(member) else (np.zeros((0, 1), np.float32), np.zeros((0, 1), np.int64))
                if layer:
                    above = np.nonzero((level < layer) & ((level > 0) | (near is None)))[0]
                    at[above] = self._greedy(own[above], at[above], layer)
                    at[member] = found[:, 0]
            else:
                sims, found = np.full((len(member), 1), -np.inf, np.float32), np.full((len(member), 1), _NONE, np.int64)
            if not len(member):
                continue
            among = within[np.ix_(member, member)]
            k = min(LINKS, len(member))
            best = np.argpartition(-among, k - 1, axis=1)[:, :k]
            sims = np.concatenate([sims, np.take_along_axis(among, best, 1)], axis=1)
            found = np.concatenate([found, ids[member][best]], axis=1)
            width = self.layers[layer].shape[1]
            links = _diverse(sims, found, self.vectors, LINKS)
            self.layers[layer][ids[member], :LINKS] = links
            self._link_back(ids[member], links, layer, width)
        if self.entry == _NONE or self.level[ids].max() > self.level[self.entry]:
            self.entry = int(ids[np.argmax(self.level[ids])])

    def _link_back(self, ids: np.ndarray, links: np.ndarray, layer: int, width: int) -> None:
        rows, cols = np.nonzero(links >= 0)
        to, source = links[rows, cols], ids[rows]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for step in range(0, int(count.max()) if len(count) else 0, width):  # a node may be chosen by much of a batch
            more = np.nonzero(count > step)[0]
            spread = np.full((len(more), min(width, int(count.max()) - step)), _NONE, np.int64)
            for c in range(spread.shape[1]):
                has = count[more] > step + c
                spread[has, c] = source[first[more][has] + step + c]
            old = self.layers[layer][nodes[more]]
            known = (spread[:, :, None] == old[:, None, :]).any(2)
            both = np.concatenate([old, np.where(known, _NONE, spread)], axis=1)
            over = (both >= 0).sum(1) > width  # the others have room for all
            at = nodes[more]
            if not over.all():
                roomy = both[~over]
                self.layers[layer][at[~over]] = np.take_along_axis(roomy, np.argsort(roomy < 0, axis=1, kind="stable")[:, :width], 1)
            at, both = at[over], both[over]
            if len(at):
                sims = np.einsum("qd,qkd->qk", self.vectors[at], self.vectors[np.maximum(both, 0)])
                sims[both < 0] = -np.inf
                self.layers[layer][at] = _diverse(sims, both, self.vectors, width)
