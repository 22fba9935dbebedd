"""Pair merges over many symbol sequences at once, held as ragged numpy arrays."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


class PairTable:
    """Ordered merges of two adjacent symbols into one."""

    def __init__(self, left: np.ndarray, right: np.ndarray, order: np.ndarray, result: np.ndarray, width: int):
        keys = left.astype(np.int64) * width + right
        at = np.argsort(keys)
        self.width, self.keys, self.order, self.result = width, keys[at], order[at].astype(np.int64), result[at]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order (NONE where there is no merge) and result of each pair."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE), self.result[at]


def merge_in_step(symbols: np.ndarray, owner: np.ndarray, table: PairTable, *, together: bool):
    """Merges every sequence to its end and returns (symbols, owner), in order.

    `symbols` are int64 and `owner` says, ascending, which sequence each belongs to. All sequences advance
    together: in each round every sequence takes its first pair in order and merges it in its leftmost place,
    or, with `together`, in all its places (right where no merge precedes the merges that made its parts).
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.full(len(symbols), NONE)
    result = np.zeros(len(symbols), np.int64)

    def look_up(at: np.ndarray) -> None:
        order[at] = NONE
        at = at[at + 1 < len(symbols)]
        at = at[owner[at] == owner[at + 1]]
        order[at], result[at] = table.find(symbols[at], symbols[at + 1])

    look_up(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(order, starts)
        live = lowest != NONE
        if live.sum() * 4 < 3 * len(live):  # set finished sequences aside
            keep = np.repeat(live, sizes)
            done.append((symbols[~keep], owner[~keep]))
            symbols, owner, order, result = symbols[keep], owner[keep], order[keep], result[keep]
            continue
        at = np.flatnonzero((order == np.repeat(lowest, sizes)) & (order != NONE))
        if together:
            first = np.r_[True, np.diff(at) != 1]  # in a run like "aaa" places overlap: take every other one
            at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
        else:
            at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]
        symbols[at] = result[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, owner, order, result = symbols[keep], owner[keep], order[keep], result[keep]
        at -= np.arange(len(at))
        look_up(np.union1d(at, at[at > 0] - 1))
    if not done:
        return symbols, owner
    symbols, owner = (np.concatenate(parts) for parts in zip(*done))
    back = np.argsort(owner, kind="stable")
    return symbols[back], owner[back]
