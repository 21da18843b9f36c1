"""Finite automata over arrays: the functions that runs of symbols stand for compose in any grouping, so a scan runs side by side.

The functions that compositions can give are few for small automata; they are numbered and their products tabled, and a
symbol costs one lookup. Where a part's first state isn't known, its function says where each state would lead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LANE = 256


class Automaton:
    """An automaton of few states: step(state, symbol) gives the next state."""

    def __init__(self, step: Callable[[int, int], int], states: int, symbols: int) -> None:
        basic = [tuple(step(s, x) for s in range(states)) for x in range(symbols)]
        known = {tuple(range(states)): 0}
        for f in basic:
            known.setdefault(f, len(known))
        grown = list(known)
        for f in grown:
            for g in basic:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    grown.append(h)
        self.number = np.array([known[f] for f in basic], np.uint16)
        self.product = np.array([[known[tuple(g[x] for x in f)] for g in grown] for f in grown], np.uint16)
        self.applied = np.array(grown, np.uint8)

    def _lanes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(functions up to each symbol within its lane, the function of all lanes up to each lane)."""
        width = -(-len(symbols) // LANE)
        lanes = np.zeros(width * LANE, np.uint16)  # 0 is the identity
        lanes[: len(symbols)] = self.number[symbols]
        lanes = np.ascontiguousarray(lanes.reshape(width, LANE).T)
        for k in range(1, LANE):
            lanes[k] = self.product[lanes[k - 1], lanes[k]]
        totals, reach = lanes[-1].copy(), 1
        while reach < width:
            totals[reach:] = self.product[totals[:-reach], totals[reach:]]
            reach *= 2
        return lanes, totals

    def function(self, symbols: np.ndarray) -> list[int]:
        """Where each state leads."""
        if not len(symbols):
            return list(range(self.applied.shape[1]))
        return self.applied[self._lanes(symbols)[1][-1]].tolist()

    def states(self, symbols: np.ndarray, first: int) -> tuple[np.ndarray, int]:
        """The state before each symbol, and the one behind the last."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.uint8), first
        lanes, totals = self._lanes(symbols)
        heads = np.concatenate([[first], self.applied[totals[:-1], first]]).astype(np.uint8)
        behind = self.applied[lanes, heads].T.reshape(-1)
        return np.concatenate([[first], behind[: n - 1]]).astype(np.uint8), int(behind[n - 1])
