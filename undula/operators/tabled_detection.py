"""Community detection on graphs of few nodes, by tables of all their partitions.

Seven nodes have 877 partitions. What a node does next depends on the partition alone, so for each matrix the
best move of every node out of every partition is worked off at once, with columns for the matrices;
trials then only look up their next partition. The moves, their order and the levels are those of
``packed_detection.communities``; equally good communities are taken in the order of their first nodes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Graphs of up to so many nodes have tables.
TABLED_NODES = 7
#: Matrices whose tables are held at once.
MATRICES = 160
#: Rows of moves worked off at once; few enough to stay in the cache.
ROWS = 512


class Partitions:
    """All partitions of ``n`` nodes, and what leads from one to another.

    ``names`` (partitions, n) holds the first node of each node's community. Node v among the others split in some way is one
    case; its options are their communities and none of them. A row v * 2 ** n + mask of ``sums`` is the weight of v to a set.
    """

    def __init__(self, n: int):
        self.n = n
        labels = [[]]
        for _ in range(n):
            labels = [[*own, c] for own in labels for c in range(max(own, default=-1) + 2)]
        grown = np.array(labels, np.int64).reshape(len(labels), n)
        self.names = (grown[:, :, None] == grown[:, None, :]).argmax(axis=2)
        self.ranks = (grown + 1).astype(np.int16)
        self.count = len(grown)
        self.place = np.full(n**n, -1, np.int16)
        self.place[self._codes(self.names)] = np.arange(self.count)
        cases: dict[tuple, list[tuple[int, int]]] = {}
        masks = np.array([[sum(1 << u for u in range(n) if row[u] == row[v]) for v in range(n)] for row in self.names.tolist()])
        for p in range(self.count):
            for v in range(n):
                others = tuple(sorted({int(m) & ~(1 << v) for u, m in enumerate(masks[p]) if u != v}, key=lambda m: m & -m))
                cases.setdefault((v, others), []).append((p, int(masks[p, v]) & ~(1 << v)))
        ordered = sorted(cases, key=lambda case: -len(case[1]))
        most = max(len(others) for _, others in ordered) + 1
        self.most = max(len(others) for _, others in ordered) + 1
        #: by option, of all cases that have it, those with the most options first: the row of its weight, the partition it leads to, and the row
        #: of that partition's moves of the same node, as it is where the node is in that option already
        self.options = [np.array([v << n | [*others, 0][j] for v, others in ordered if len(others) >= j]) for j in range(self.most)]
        self.leads, self.rows = [], []
        for j in range(self.most):
            to = [({mask: p for p, mask in cases[v, others]}[[*others, 0][j]], v) for v, others in ordered if len(others) >= j]
            self.leads.append(np.array([p for p, _ in to], np.int16))
            self.rows.append(np.array([p * n + v for p, v in to]))

    def _codes(self, names: np.ndarray) -> np.ndarray:
        code = np.zeros(len(names), np.int64)
        for v in range(self.n):
            code = code * self.n + names[:, v]
        return code

    def of(self, labels: np.ndarray) -> np.ndarray:
        """Places of partitions given by any labels."""
        return self.place[self._codes((labels[:, :, None] == labels[:, None, :]).argmax(axis=2))]

    def moves(self, b: np.ndarray, epsilon: float) -> np.ndarray:
        """(partitions * n, matrices): the partition that follows when a node of each partition takes its best option, the same one if it gains nothing."""
        n = self.n
        weights = np.ascontiguousarray(b.transpose(1, 2, 0))
        sums = np.zeros((n, 1 << n, len(b)))
        for u in range(n):
            # a set's weights are added in the order of its nodes
            np.add(sums[:, : 1 << u], weights[:, u, None], out=sums[:, 1 << u : 2 << u])
        sums = sums.reshape(n << n, len(b))
        top = sums.take(self.options[0], axis=0)
        goal = np.repeat(self.leads[0][:, None], len(b), axis=1)
        for options, leads in zip(self.options[1:], self.leads[1:]):
            for lo in range(0, len(options), ROWS):
                part = slice(lo, min(lo + ROWS, len(options)))
                other, now, here = sums.take(options[part], axis=0), top[part], goal[part]
                here += (other > now).astype(np.int16) * (leads[part, None] - here)
                np.maximum(now, other, out=now)
        out = np.empty((self.count * n, len(b)), np.int16)
        for options, leads, rows in zip(self.options, self.leads, self.rows):
            for lo in range(0, len(rows), ROWS):
                part = slice(lo, min(lo + ROWS, len(rows)))
                gain, now = sums.take(options[part], axis=0), leads[part, None]
                np.subtract(top[part], gain, out=gain)
                out[rows[part]] = now + (gain > epsilon).astype(np.int16) * (goal[part] - now)
        return out


@lru_cache
def partitions_of(n: int) -> Partitions:
    return Partitions(n)


def communities(b: np.ndarray, owner: np.ndarray, keys: np.ndarray, orders, epsilon: float, level: int = 0) -> np.ndarray:
    """Place of the partition of each trial; ``orders(level, sweep)`` has a row of nodes for each of the different ``keys`` (their numbers)."""
    n, table = b.shape[1], partitions_of(b.shape[1])
    count, moves = len(b), table.moves(np.where(np.eye(n, dtype=bool), 0.0, b), epsilon)
    settled = (moves.reshape(table.count, n, count) == np.arange(table.count, dtype=np.int16)[:, None, None]).all(axis=1).ravel()
    flat, state = moves.ravel(), np.full(len(owner), table.count - 1)
    going = np.flatnonzero(~settled[state * count + owner])
    sweep = 0
    while len(going):
        own, key = owner[going], keys[going]
        place, at = orders(level, sweep) * count, state[going]
        for p in range(n):
            case = at * (n * count)
            case += own
            case += place[p].take(key)
            at = flat.take(case)
            at = at.astype(np.int64)
        state[going] = at
        going = going[~settled.take(at * count + own)]
        sweep += 1
    # Communities become the nodes, once per partition that trials of a matrix share.
    pair = state * count + owner
    seen = np.zeros(table.count * count, bool)
    seen[pair] = True
    found = np.flatnonzero(seen)
    members = np.eye(n)[table.names[found // count]]
    merged = np.swapaxes(members, 1, 2) @ b[found % count] @ members
    on = (np.where(np.eye(n, dtype=bool), 0.0, merged) > epsilon).any(axis=(1, 2))
    if on.any():
        place = np.full(len(seen), -1)
        place[found[on]] = np.arange(on.sum())
        more = np.flatnonzero(place[pair] >= 0)
        joined = communities(merged[on], place[pair[more]], keys[more], orders, epsilon, level + 1)
        state[more] = table.of(np.take_along_axis(table.names[joined], table.names[state[more]], axis=1))
    return state
