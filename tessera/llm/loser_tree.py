"""Merging sorted runs of byte strings with a loser tree that knows common prefixes.

Every candidate carries the length of its common prefix with the last output.
Of two candidates the one with the longer known prefix is the smaller, so bytes
are compared only where both lengths are equal, and then only from there on;
no byte that is known to be common is looked at again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def front_code(sorted_rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common-prefix lengths of neighbours, and the bytes after them, of rows (n, width) in order."""
    n, width = sorted_rows.shape
    common = np.zeros(n, np.uint8)
    if n > 1:
        differ = sorted_rows[1:] != sorted_rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    column = np.arange(width)
    rest = (column >= common[:, None]) & (column < lengths[:, None])
    return common, sorted_rows[rest].tobytes()


def decode(common: np.ndarray, lengths: np.ndarray, rest: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for c, n in zip(common.tolist(), lengths.tolist()):
        last = last[:c] + rest[at : at + n - c]
        at += n - c
        out.append(last)
    return out


def _common(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix of a and b, known to be at least k."""
    n = min(len(a), len(b))
    while k < n:
        step = 8
        if a[k : k + step] == b[k : k + step]:
            k = min(n, k + step)
            continue
        while k < n and a[k] == b[k]:
            k += 1
        break
    return k


def merge(runs: Sequence[Sequence[bytes]], commons: Sequence[Sequence[int]]) -> tuple[list[int], list[int]]:
    """The run that each output comes from, and its common prefix with the output before it.

    ``commons[r][i]``: common prefix of ``runs[r][i]`` with ``runs[r][i - 1]``. Equal
    strings come out in the order of their runs.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    at = [0] * size
    ends = [len(r) for r in runs] + [0] * (size - k)
    head: list[bytes | None] = [r[0] if len(r) else None for r in runs] + [None] * (size - k)
    known = [0] * size  # common prefix of each head with the last output
    tree = [-1] * size  # losers; tree[0] is the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        n = _common(x, y, ka)
        if n == len(x) and n == len(y):
            w, o = (a, b) if a < b else (b, a)
        elif n == len(x) or (n < len(y) and x[n] < y[n]):
            w, o = a, b
        else:
            w, o = b, a
        known[o] = n
        return w, o

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, o = play(build(2 * node), build(2 * node + 1))
        tree[node] = o
        return w

    order: list[int] = []
    prefix: list[int] = []
    if not k:
        return order, prefix
    winner = build(1) if size > 1 else 0
    for _ in range(sum(ends)):
        order.append(winner)
        prefix.append(known[winner])
        i = at[winner] = at[winner] + 1
        if i < ends[winner]:
            head[winner] = runs[winner][i]
            known[winner] = commons[winner][i]
        else:
            head[winner] = None
        node = (winner + size) >> 1
        while node:
            other = tree[node]
            # the frequent cases of play() in place: one has ended, or prefixes of other lengths
            if head[other] is not None:
                ka, kb = known[winner], known[other]
                if head[winner] is None or kb > ka:
                    tree[node], winner = winner, other
                elif ka == kb:
                    winner, tree[node] = play(winner, other)
            node >>= 1
    return order, prefix
