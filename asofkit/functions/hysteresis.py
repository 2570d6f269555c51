"""Smoothing of a label series: keep a state for a while, leave it only when another is confirmed."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

UNKNOWN = "UNKNOWN"


class State(NamedTuple):
    active: str = UNKNOWN
    held: int = 0
    pending: str = UNKNOWN
    count: int = 0


def step(s: State, label: str, hold: int = 12, confirm: int = 3) -> State:
    """The state after one more label. UNKNOWN forgets everything."""
    if label == UNKNOWN:
        return State()
    if s.active == UNKNOWN:
        return State(label, 1)
    if label == s.active or s.held < hold:
        return State(s.active, s.held + 1)
    count = s.count + 1 if label == s.pending else 1
    return State(label, 1) if count >= confirm else State(s.active, s.held + 1, label, count)


def smooth(labels: Iterable[str], hold: int = 12, confirm: int = 3) -> list[str]:
    out, s = [], State()
    for label in labels:
        s = step(s, label, hold, confirm)
        out.append(s.active)
    return out


class Automaton:
    """Smoothing as a finite automaton: beyond ``hold`` it does not matter how long a state was held.

    A chunk of labels is a map from states to states, and such maps compose; so chunks are mapped
    apart from each other, their maps are followed in order, and each chunk is smoothed from its own start.
    """

    def __init__(self, labels: Iterable[str], hold: int = 12, confirm: int = 3):
        self.hold = hold
        self.labels = [UNKNOWN, *sorted(set(labels) - {UNKNOWN})]
        self.states = [self._known(State())]
        number = {self.states[0]: 0}
        rows: list[list[int]] = []
        for state in self.states:  # grows while new states are reached
            row = []
            for label in self.labels:
                after = self._known(step(state, label, hold, confirm))
                if after not in number:
                    number[after] = len(self.states)
                    self.states.append(after)
                row.append(number[after])
            rows.append(row)
        #: State after each label (rows) from each state (columns).
        self.table = np.array(rows, dtype=np.int32).T.copy()
        self.active = [s.active for s in self.states]
        self.code = {label: i for i, label in enumerate(self.labels)}

    def _known(self, s: State) -> State:
        return s._replace(held=min(s.held, self.hold))

    def chunk(self, labels: Iterable[str]) -> np.ndarray:
        """The state after these labels from each state."""
        state = np.arange(len(self.states), dtype=np.int32)
        for label in labels:
            state = self.table[self.code[label]][state]
        return state

    def run(self, labels: Iterable[str], start: int = 0) -> list[str]:
        out, state = [], start
        for label in labels:
            state = int(self.table[self.code[label], state])
            out.append(self.active[state])
        return out
