"""Viterbi decoding of many label sequences at once in numpy."""

from __future__ import annotations

import numpy as np


def viterbi(scores: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labels of sequences laid end to end. scores: (n, labels); starts: where each sequence begins (none is empty).

    All sequences advance together, one position a step. Before that they are cut where the label is certain: where
    one score leads all others by more than any choice of the two adjoining transitions can make up, every best path has that label,
    so a cut there changes nothing and the steps are as many as the longest stretch without such a position.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    if k == 1:
        return np.zeros(n, np.int64)
    scores = scores.astype(np.float64, copy=True)
    scores[starts] += first
    lead = np.partition(scores, k - 2, axis=1)
    best = scores.argmax(1)
    sure = lead[:, k - 1] - lead[:, k - 2] > 2 * (trans.max() - trans.min()) + 1e-9
    begins = np.zeros(n, bool)
    begins[starts] = True
    scores[sure] = -1e30
    scores[sure, best[sure]] = 0
    cut = begins | sure
    at = np.flatnonzero(cut)
    # A piece runs from a cut to the next; if that is a sure position of the same sequence, it is the piece's last.
    end = np.append(at[1:], n)
    joined = np.append(~begins[at[1:]], False)
    length = end - at + joined
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    live = len(at) - np.searchsorted(length[::-1], np.arange(1, length[0] + 1), side="left")
    table, back = scores[at], np.zeros((n + 1, k), np.uint8)
    rows, final = np.arange(k), np.empty(len(at), np.int64)
    for t in range(1, int(length[0])):
        m = live[t]
        if m < len(table):
            final[m : len(table)] = table[m:].argmax(1)
            table = table[:m]
        step = table[:, :, None] + trans[None]
        come = step.argmax(1)
        back[at[:m] + t] = come
        table = step[np.arange(m)[:, None], come, rows[None]] + scores[at[:m] + t]
    final[: len(table)] = table.argmax(1)
    out, label = np.empty(n, np.int64), final
    for t in range(int(length[0]) - 1, -1, -1):
        m = live[t]
        here = at[:m] + t
        out[here] = label[:m]
        if t:
            label[:m] = back[here, label[:m]]
    return out
