"""Least-cost assignment for the small matrices of schema comparison."""

from __future__ import annotations

import numpy as np


def least_cost_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of least total cost, as many as the shorter side has.

    Successive shortest augmenting paths with potentials, O(rows^2 * columns).
    """
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in least_cost_assignment(cost.T))
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        dist = cost[start] - row_price[start] - col_price
        via = np.full(cols, start)
        done = np.zeros(cols, bool)
        prev_col = np.full(cols, -1)
        while True:
            open_cols = np.flatnonzero(~done)
            j = open_cols[np.argmin(dist[open_cols])]
            done[j] = True
            if owner[j] < 0:
                break
            r = owner[j]
            through = dist[j] + cost[r] - row_price[r] - col_price
            better = ~done & (through < dist)
            dist[better], via[better], prev_col[better] = through[better], r, j
        end, reached = j, dist[j]
        for c in np.flatnonzero(done):
            if c != end:
                row_price[owner[c]] += reached - dist[c]
                col_price[c] -= reached - dist[c]
        row_price[start] += reached
        while True:
            owner[j], nxt = via[j], prev_col[j]
            if nxt < 0:
                break
            j = nxt
    return sorted((int(owner[c]), c) for c in range(cols) if owner[c] >= 0)
