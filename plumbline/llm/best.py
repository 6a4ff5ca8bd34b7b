"""The first entries of many lists at once, kept while a task goes through its rows."""

from __future__ import annotations

import numpy as np

LOWEST = np.iinfo(np.int64).min
# Entries that wait before the lists are cut again.
PENDING = 1 << 17


class Best:
    """Per list the `top` entries of largest score; equal scores by ascending id, missing ids last.

    Holds at most `top` entries a list and PENDING more. `floor` is the score that a new
    entry of a list must reach.
    """

    def __init__(self, lists: int, top: int) -> None:
        self.top = top
        self.floor = np.full(lists, LOWEST, dtype=np.int64)
        self.kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        self.waiting: list[list[np.ndarray]] = []
        self.n_waiting = 0

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray | None = None) -> None:
        fits = scores >= self.floor[lists]
        gone = missing[fits] if missing is not None else np.zeros(int(fits.sum()), dtype=bool)
        self.waiting.append([lists[fits], scores[fits], ids[fits], gone])
        self.n_waiting += len(gone)
        if self.n_waiting > PENDING:
            self.cut()

    def cut(self) -> None:
        lists, scores, ids, missing = (np.concatenate(x) for x in zip(self.kept, *self.waiting, strict=True))
        order = np.lexsort((ids, missing, -scores, lists))
        lists = lists[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        fine = place < self.top
        self.kept = [lists[fine], scores[order][fine], ids[order][fine], missing[order][fine]]
        full = place == self.top - 1
        self.floor[lists[full]] = scores[order][full]
        self.waiting, self.n_waiting = [], 0

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id, whether the id is missing), in order."""
        self.cut()
        return tuple(self.kept)
