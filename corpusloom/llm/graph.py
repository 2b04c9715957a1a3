"""A robust-pruned directed graph over unit vectors, built and searched in whole batches.

Nodes are inserted block by block.  For each, a greedy search from the medoid
proposes neighbours: the beam it ends with and every node it passed.  Relaxed
pruning keeps a proposal only if no kept one is closer to it, by the factor
`alpha`, than the node itself; edges are added both ways, and overfull nodes are
pruned again, in rounds until every back edge has been proposed.  All queries of
a block take their steps together: a step expands the best open node of each
beam.

A beam is a sorted row of 64-bit numbers: squared distance, node, and whether
the node has been expanded.
"""

from __future__ import annotations

import numpy as np

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_NODE = np.uint64(0x7FFFFFFF)
_ONE, _HALF = np.uint64(1), np.uint64(32)
_EVERY = np.uint64(0xFFFFFFFFFFFFFFFF)  # all bits
_MARKS, _ROWS = 1 << 24, 256  # marks of visited nodes and queries held at once
_CACHED = 1 << 18  # numbers compared at once: they stay in a core's cache
_MORE = 16  # times as many back edges as edges, at most, are pruned at once


class Gather:
    """Rows of a matrix in memory that is used again and again: fresh memory costs more than the rows."""

    def __init__(self, x: np.ndarray):
        self.x, self.room = x, np.empty((0, x.shape[1]), x.dtype)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """x[rows], valid until the next call."""
        if rows.size > len(self.room):
            self.room = np.empty((rows.size, self.x.shape[1]), self.x.dtype)
        out = self.room[: rows.size]
        self.x.take(rows.ravel(), axis=0, mode="wrap", out=out)  # wrap: negative rows count from the end
        return out.reshape(*rows.shape, -1) if rows.size else np.zeros((*rows.shape, self.x.shape[1]), self.x.dtype)


def _nodes(keys: np.ndarray) -> np.ndarray:
    return (keys >> _ONE & _NODE).astype(np.int64)


def _distances(keys: np.ndarray) -> np.ndarray:
    return (keys >> _HALF).astype(np.uint32).view(np.float32)


def _key(cosine: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    cosine *= -2
    cosine += 2
    keys = np.empty((*nodes.shape, 2), "<u4")  # the halves of a number
    keys[..., 0] = nodes
    keys[..., 0] <<= np.uint32(1)
    np.maximum(cosine, np.float32(0), out=keys[..., 1].view("<f4"))
    return keys.view("<u8")[..., 0]


def _unique(keys: np.ndarray) -> np.ndarray:
    """Each row sorted, repeated keys gone, without the columns that are empty in all rows."""
    keys.sort(axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = _NONE
    keys.sort(axis=1)
    return keys[:, : int((keys != _NONE).sum(axis=1).max(initial=0))]


class Graph:
    def __init__(self, x: np.ndarray, degree: int = 24, beam: int = 24, alpha: float = 1.2, wide: int = 24, proposals: int = 32, seed: int = 7):
        """x: unit vectors, one row per node; wide: beam of the searches that propose."""
        n = len(x)
        self.n, self.degree, self.beam, self.alpha, self.wide, self.proposals = n, degree, beam, np.float32(alpha), wide, proposals
        order = np.random.default_rng(seed).permutation(n)
        medoid = int((x @ x.mean(axis=0)).argmax()) if n else 0
        self.order = np.concatenate([order[order == medoid], order[order != medoid]])  # node -> row of the caller
        self.x = np.concatenate([x[self.order], np.zeros((1, x.shape[1]), np.float32)])  # node n stands for none
        self.ones = np.ones(x.shape[1], np.float32)
        self.edges = np.full((n + 1, degree), n, np.int64)
        self.rows, self.mutual, self.asking = Gather(self.x), np.zeros(0, np.float32), np.empty((0, x.shape[1]), np.float32)
        done = min(n, 2 * degree)  # the first block sees itself, later ones the graph so far
        self._insert(np.arange(done), self._others(np.arange(done), np.tile(np.arange(done), (done, 1))))
        while done < n:
            block = np.arange(done, min(n, done + max(done // 2, 32)))
            self._insert(block, self._proposed(block))
            done = block[-1] + 1

    def search(self, q: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances) of the beam of each query, best first; node -1 where it holds fewer.

        own: the query's node: it is never found, and the search sets out from its edges.  Other queries set out from the medoid.
        """
        found = [np.zeros((0, self.beam), np.uint64)]
        for at in self._blocks(len(q)):
            found.append(self._walk(q[at], None if own is None else own[at], self.beam))
        keys = np.concatenate(found)
        return np.where(keys == _NONE, -1, _nodes(keys)), _distances(keys)

    def _keys(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """(squared distance, node, open) of the nodes of each query, as numbers in that order."""
        step = max(1, _CACHED // max(1, nodes.shape[1] * q.shape[1]))
        near = np.empty(nodes.shape, np.float32)
        for i in range(0, len(nodes), step):
            np.matmul(self.rows(nodes[i : i + step]), q[i : i + step, :, None], out=near[i : i + step, :, None])
        return _key(near, nodes)

    def _pairs(self, q: np.ndarray, line: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The same for pairs of a row of q and a node."""
        if len(line) > len(self.asking):
            self.asking = np.empty((len(line), self.x.shape[1]), np.float32)
        asking = q.take(line, axis=0, mode="wrap", out=self.asking[: len(line)])
        near = self.rows(nodes)
        near *= asking
        return _key(near @ self.ones, nodes)

    def _blocks(self, count: int) -> list[slice]:
        size = max(1, min(_ROWS, _MARKS // (self.n + 1)))
        return [slice(i, i + size) for i in range(0, count, size)]

    def _walk(self, q: np.ndarray, own: np.ndarray | None, width: int, passed: list | None = None) -> np.ndarray:
        """The beams of a block of queries; passed gets (queries, keys expanded) of each step."""
        out = np.full((len(q), width), _NONE)
        line = np.arange(len(q))  # the queries still on their way
        unseen = np.ones((len(q), self.n + 1), bool)
        unseen[:, self.n] = False
        nodes = np.zeros(len(q), np.int64) if own is None else own
        unseen[line, nodes] = False
        beam = np.full((len(q), width + self.degree), _NONE, "<u8")  # the last columns take what comes in
        if own is None:
            beam[:, 0] = self._keys(q, nodes[:, None])[:, 0] | _ONE
        unseen = unseen.ravel()
        slot = np.repeat(line, self.degree)  # the row of each place among the edges
        while True:
            new = self.edges.take(nodes, axis=0)
            mark = (new + (line * (self.n + 1))[:, None]).ravel()
            at = np.flatnonzero(unseen.take(mark))  # most edges lead to nodes that were seen: only the others are compared
            unseen[mark.take(at)] = False
            to, row = new.ravel().take(at), slot.take(at)
            beam[:, width:] = _NONE
            beam.reshape(-1)[at + width * (row + 1)] = self._pairs(q, line.take(row), to)
            beam.sort(axis=1)
            free = beam.view(np.uint8)[:, : 8 * width : 8] & 1 == 0  # from the least byte; what is _NONE counts as expanded
            best, rows = free.argmax(axis=1), np.arange(len(line))  # the best open one
            going = free[rows, best]
            if not going.all():
                out[line[~going]] = beam[~going, :width]
                beam, line, best = beam[going], line[going], best[going]
                if not len(line):
                    return out
                rows = np.arange(len(line))
            key = beam[rows, best]
            nodes = _nodes(key)
            beam[rows, best] |= _ONE
            if passed is not None:
                passed.append((line, key))

    def _others(self, block: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Keys of the nodes of each row but none and the row's own, best first."""
        keys = self._keys(self.x[block], nodes)
        keys[(nodes == self.n) | (nodes == block[:, None])] = _NONE
        return _unique(keys)

    def _proposed(self, block: np.ndarray) -> np.ndarray:
        """What greedy searches for the nodes of the block end with and pass, best first."""
        out = np.full((len(block), self.proposals), _NONE)
        for at in self._blocks(len(block)):
            own, passed = block[at], []
            found = self._walk(self.x[own], None, self.wide, passed)
            keys = np.full((len(own), self.wide + len(passed) + 1), _NONE)
            keys[:, : self.wide] = np.where(found == _NONE, _NONE, found & ~_ONE)
            for step, (line, expanded) in enumerate(passed, self.wide):
                keys[line, step] = expanded
            keys[:, -1] = self._keys(self.x[own], np.zeros((len(own), 1), np.int64))[:, 0]  # the medoid
            keys[_nodes(keys) == own[:, None]] = _NONE
            keys = _unique(keys)[:, : self.proposals]
            out[at, : keys.shape[1]] = keys
        return out

    def _apart(self, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Bits, [j, word of 64, node]: of each proposal j and node, the proposals that are not closer to j, by the factor alpha, than to the node."""
        size = ids.shape[1]
        step = max(1, _CACHED // max(1, size * max(size, self.x.shape[1])))
        if step * size * size > len(self.mutual):
            self.mutual = np.empty(step * size * size, np.float32)
        most = 1 - own / (2 * self.alpha**2)  # alpha² (2 - 2 cosine) > own
        bits = np.zeros((len(ids), size, 8 * -(-size // 64)), np.uint8)
        for i in range(0, len(ids), step):
            near = self.rows(ids[i : i + step])
            mutual = np.matmul(near, near.transpose(0, 2, 1), out=self.mutual[: len(near) * size * size].reshape(len(near), size, size))
            bits[i : i + step, :, : -(-size // 8)] = np.packbits(mutual < most[i : i + step, None, :], axis=2, bitorder="little")
        return bits.view("<u8").transpose(1, 2, 0).copy()

    def _prune(self, keys: np.ndarray) -> np.ndarray:
        """The edges kept of each node's proposals, given best first."""
        if len(keys) > _ROWS:
            return np.concatenate([self._prune(keys[i : i + _ROWS]) for i in range(0, len(keys), _ROWS)])
        real = keys != _NONE
        size = int(real.sum(axis=1).max(initial=0))
        keys, real = keys[:, :size], real[:, :size]
        ids = np.where(real, _nodes(keys), self.n)
        apart = self._apart(ids, _distances(keys))
        kept = np.zeros((size, len(ids)), bool)
        alive = np.full(apart.shape[1:], _EVERY)
        for j in range(size):
            take = alive[j // 64] >> np.uint64(j % 64) & _ONE
            kept[j] = take
            take -= _ONE  # all bits where j is not kept
            alive &= apart[j] | take
        kept = kept.T & real
        rank = kept.cumsum(axis=1) - 1
        kept &= rank < self.degree
        out = np.full((len(ids), self.degree), self.n, np.int64)
        line, place = np.nonzero(kept)
        out[line, rank[kept]] = ids[kept]
        return out

    def _insert(self, block: np.ndarray, keys: np.ndarray) -> None:
        """Edges of the nodes of a block to the best of their proposals, and back."""
        self.edges[block] = self._prune(keys)
        to = self.edges[block].ravel()
        come = np.repeat(block, self.degree)[to < self.n]
        to = to[to < self.n]
        order = np.argsort(to, kind="stable")
        to, come = to[order], come[order]
        nodes, head, line, width = np.unique(to, return_index=True, return_inverse=True, return_counts=True)
        place = np.arange(len(to)) - head[line]
        first, more = 0, self.degree
        while first < width.max(initial=0):  # as many back edges as edges at first, then twice as many each time, until all were proposed
            now = (place >= first) & (place < first + more)
            some, at = np.unique(line[now], return_inverse=True)
            every = np.full((len(some), self.degree + more), self.n, np.int64)
            every[:, : self.degree] = self.edges[nodes[some]]
            every[at, self.degree + place[now] - first] = come[now]
            self._add(nodes[some], every)
            first, more = first + more, min(2 * more, _MORE * self.degree)

    def _add(self, nodes: np.ndarray, every: np.ndarray) -> None:
        keys = self._others(nodes, every)
        count = (keys != _NONE).sum(axis=1)
        fits = count <= self.degree
        few = keys[fits, : self.degree]
        self.edges[nodes[fits], : few.shape[1]] = np.where(few == _NONE, self.n, _nodes(few))
        full = np.flatnonzero(~fits)
        if len(full):
            full = full[np.argsort(count[full], kind="stable")]  # those of about as many proposals are pruned together
            self.edges[nodes[full]] = self._prune(keys[full])
