"""Repeated strings of a given length by interval expansion on a Burrows-Wheeler transform.

A text's suffixes are sorted as far as the given length needs. Starting from the intervals of single bytes, every interval of a string w is
extended backward to those of c w for each byte c that the transform holds in it; an interval whose right border has no
common-prefix value yet sets it, and only then is extended further. Breadth first, values so come out in increasing order, and the
expansion stops at the given length: what is still unset there has a common prefix at least that long. Each border is set
once, so the number of intervals is bounded by the text, not by text times length."""

from __future__ import annotations

import numpy as np

#: Ends a segment; no byte of UTF-8.
END = 0xFF


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text (uint8) in the order of their suffixes, by their first `depth` bytes at least."""
    n = len(text)
    padded = np.concatenate([text, np.full(8, END, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    k = 8
    while True:
        order = np.argsort(key)
        key = key[order]
        new = np.r_[False, key[1:] != key[:-1]]
        del key
        if k >= depth or new[1:].all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        del order
        key = rank << np.uint64(32)
        key[: max(0, n - k)] |= rank[k:]
        key[max(0, n - k) :] |= np.uint64(n)
        k *= 2


def borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row i of the sorted suffixes: whether it has less than `length` bytes in common with row i - 1, as far as neither
    meets an END within that length."""
    n = len(text)
    small = np.int32 if n < 1 << 31 else np.int64
    where = np.empty(n, small)
    where[order] = np.arange(n, dtype=small)
    first, before = text[order], text[order - 1]  # the transform; row of position 0 wraps to an END
    step = where[order - 1]
    open_ = before != END
    seen = np.zeros(n + 1, bool)
    del where
    rows = np.flatnonzero(first != END).astype(small)
    own = np.zeros(len(rows), small)
    for level in range(length):
        if level:
            on = open_[rows]
            rows, own = step[rows[on]], own[on]
            if len(rows) * 8 > n:
                table = np.full(n, -1, small)
                table[rows] = own
                rows = np.flatnonzero(table >= 0).astype(small)
                own = table[rows]
            else:
                o = np.argsort(rows)
                rows, own = rows[o], own[o]
        if not len(rows):
            break
        c = first[rows]
        starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (c[1:] != c[:-1])])
        sizes = np.diff(np.r_[starts, len(rows)])
        right = rows[starts + sizes - 1] + 1
        new = ~seen[right]
        seen[right] = True
        keep = np.repeat(new, sizes)
        rows = rows[keep]
        own = np.repeat(np.arange(int(new.sum()), dtype=small), sizes[new])
    return seen[:n]


def shared_windows(segments: list[bytes], owners: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(segment, offset, count): runs of `count` windows of `length` bytes from offset on, each of which also lies in a segment of a
    smaller owner."""
    if not segments:
        return []
    text = np.frombuffer(bytes([END]).join(segments) + bytes([END]), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    of = np.repeat(np.arange(len(segments)), sizes + 1)
    order = suffix_order(text, length)
    cut = borders(text, order, length)
    valid = (order + length <= (starts + sizes)[of[order]])
    edge = cut | ~valid | ~np.r_[False, valid[:-1]]
    edge[0] = True
    owner = owners[of[order]]
    heads = np.flatnonzero(edge)
    least = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.r_[heads, len(order)]))
    at = np.sort(order[valid & (owner > least)])
    if not len(at):
        return []
    head = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]])])
    count, at = np.diff(np.r_[head, len(at)]), at[head]
    return list(zip(of[at].tolist(), (at - starts[of[at]]).tolist(), count.tolist(), strict=True))
