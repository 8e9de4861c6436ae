"""Cutting-stock patterns by column generation; a bounded problem solved on the driver."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Pattern(NamedTuple):
    """How many pieces of each width one sequence takes, and how many such sequences."""

    counts: dict[int, int]
    times: int


def _price(value: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the highest total value, by dynamic programming."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.flatnonzero(widths <= room)
        best[room] = best[room - 1]
        if len(fits):
            totals = best[room - widths[fits]] + value[fits]
            k = int(np.argmax(totals))
            if totals[k] > best[room] + 1e-12:
                best[room], choice[room] = totals[k], fits[k]
    pattern = np.zeros(len(widths))
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= widths[choice[room]]
    return float(best[capacity]), pattern


def patterns(demand: dict[int, int], capacity: int, most_steps: int = 5000) -> list[Pattern]:
    """Patterns for a histogram {width: pieces}, none taken more often than pieces allow.

    The linear program "fewest sequences that hold all pieces" starts with one width per
    pattern; each step prices a new pattern with the duals and exchanges it into the basis,
    until none improves (or after most_steps, when the basis is still a valid packing). The
    solution is rounded down, then up again where whole patterns still find their pieces.
    """
    widths = np.array(sorted(w for w, n in demand.items() if n > 0), dtype=np.int64)
    if not len(widths):
        return []
    need = np.array([demand[int(w)] for w in widths], dtype=float)
    basis = np.diag(np.floor(capacity / widths))
    cost = np.ones(len(widths))
    level = need / np.diag(basis)
    for _ in range(most_steps):
        dual = np.linalg.solve(basis.T, cost)
        value, column = _price(np.maximum(dual, 0.0), widths, capacity)
        price = 1.0
        if value <= 1 + 1e-9:
            k = int(np.argmin(dual))
            if dual[k] >= -1e-9:
                break
            column, price = np.zeros(len(widths)), 0.0
            column[k] = -1.0
        change = np.linalg.solve(basis, column)
        falling = change > 1e-10
        if not falling.any():
            break
        ratio = np.where(falling, np.maximum(level, 0) / np.where(falling, change, 1), np.inf)
        leaves = int(np.argmin(ratio))
        level = level - ratio[leaves] * change
        level[leaves] = ratio[leaves]
        basis[:, leaves], cost[leaves] = column, price
    columns = [k for k in range(len(widths)) if cost[k] > 0]
    times = {k: max(0, int(np.floor(level[k] + 1e-9))) for k in columns}
    left = need - sum((times[k] * basis[:, k] for k in columns), np.zeros(len(widths)))
    for k in sorted(columns, key=lambda k: (times[k] - level[k], k)):
        while times[k] and (left < -1e-9).any() and (basis[:, k] > 0)[left < -1e-9].any():
            times[k] -= 1
            left = left + basis[:, k]
        if (left >= basis[:, k] - 1e-9).all() and basis[:, k].any():
            times[k] += 1
            left = left - basis[:, k]
    return [
        Pattern({int(w): int(n) for w, n in zip(widths, basis[:, k], strict=True) if n}, times[k])
        for k in columns
        if times[k]
    ]
