"""Packing token sequences by vector bin packing with the dot-product heuristic.

Method. A sequence has a residual in three dimensions: tokens, segments, loss-bearing tokens. Among the examples that
fit, the one with the largest dot product of its demand and the residual, both in units of the limits and weighted by
the mean demand of a dimension, is placed next. When none fits, a sequence is closed. For documents, which may be cut,
whole sequences are cut off long ones first, only the remainders are packed, and a sequence that no remainder fits is
filled with the front of the longest; what the last sequence of a task leaves over is laid out as sequences of a power of
two, which need no padding.

Scale. No shuffle: a task packs the documents of its own partition as they stream by, in a pool of POOL remainders.
Sequence ids are numbered within the partition, so a rerun of a lost task gives the same ones.

Defined cases. A null or empty text has the end id alone. Rows that repeat are packed each for itself; null doc_ids are
kept as null. An empty table gives an empty result. Further columns are ignored. Special tokens' strings in a text are
ordinary text. The ids are computed with a second implementation of the same vocabulary (its rank file), which gives the
same ids as the JSON file and several times as fast; `reference_ids` is the plain form that tests compare with, and that takes over for texts
with runs of white space too long for the other (from some 10^5 characters on).
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, trimmed

MAX_TOKENS, MAX_SEGMENTS, END_ID = 2048, 512, 1
#: Remainders that a task holds before it packs half of them.
POOL = 2048

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _PIECE.split(", ")])


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, path: str | None = None, reference: str | None = None) -> np.ndarray:
    """Ids of a text, then END_ID; unsigned 32-bit. path: the rank file, reference: the JSON file."""
    try:
        ids = _encoder(path or _vocabulary("byte_bpe_50k.tiktoken")).encode_to_numpy(text or "", disallowed_special=())
    except ValueError:  # the rank file's implementation gives up on very long runs of white space
        return np.array(reference_ids(text, reference), "<u4")
    return np.append(ids, np.uint32(END_ID)).astype("<u4")


@lru_cache
def _reference(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def reference_ids(text: str | None, path: str | None = None) -> list[int]:
    return [*_reference(path or _vocabulary("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, END_ID]


class Bins:
    """Dot-product vector bin packing over a pool of items with integer demands; one open bin at a time."""

    def __init__(self, limits):
        self.limits = np.asarray(limits, float)
        self.items: list = []
        self.demand = np.empty((0, len(limits)))

    def add(self, items: list, demands: list) -> None:
        self.items += items
        self.demand = np.vstack([self.demand, np.asarray(demands, float).reshape(-1, len(self.limits))])

    def fill(self, cut=None) -> list:
        """Takes the items of the next bin off the pool. cut(item, n): (front of n tokens, rest, demand of each), or None."""
        share = self.demand / self.limits
        weight, residual, chosen = share.mean(axis=0), np.ones(len(self.limits)), []
        alive = np.ones(len(self.items), bool)
        while alive.any():
            fits = alive & (share <= residual + 1e-9).all(axis=1)
            if fits.any():
                score = np.where(fits, share @ (weight * residual), -1.0)
                i = int(score.argmax())
            else:
                room = (residual * self.limits + 0.5).astype(int)
                i = int(np.where(alive, share[:, 0], -1).argmax())
                if cut is None or room.min() < 1 or self.demand[i, 0] <= min(room[0], room[2]):
                    if not chosen:
                        raise ValueError("an item is above the limits and can't be cut")
                    break
                front, rest, used, rest_demand = cut(self.items[i], int(min(room[0], room[2])))
                chosen.append(front)
                residual = residual - np.asarray(used) / self.limits
                self.items[i], self.demand[i] = rest, rest_demand
                break
            chosen.append(self.items[i])
            residual, alive[i] = residual - share[i], False
        keep = np.flatnonzero(alive)
        self.items, self.demand = [self.items[i] for i in keep], self.demand[keep]
        return chosen


def vector_pack(demands, limits) -> list[list[int]]:
    """Bins of item numbers for examples that stay whole, such as instruction data: no bin is above any limit."""
    bins = Bins(limits)
    if len(demands):
        bins.add(list(range(len(demands))), demands)
    out = []
    while bins.items:
        out.append(bins.fill())
    return out


def _cut(piece, n: int):
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total), (n, 1, n), (len(ids) - n, 1, len(ids) - n)


def pack_documents(batches: Iterator[pa.RecordBatch], part: int, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, ids_of=token_ids) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to pieces; every id lies in exactly one."""
    bins, count, out = Bins((max_tokens, max_segments, max_tokens)), part << 40, []

    def lay(pieces) -> None:
        nonlocal count
        offset = 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, count, offset))
            offset += len(ids)
        count += 1

    def close(pieces) -> None:
        """A full sequence as it is; any other as sequences of a power of two, largest first."""
        left = sum(len(p[2]) for p in pieces)
        pieces = list(pieces)[::-1]
        while left:
            room = want = max_tokens if left >= max_tokens else 1 << (left.bit_length() - 1)
            here = []
            while room:
                p = pieces.pop()
                if len(p[2]) > room:
                    p, rest, *_ = _cut(p, room)
                    pieces.append(rest)
                here.append(p)
                room -= len(p[2])
            lay(here)
            left -= want

    def packed() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_ARROW)
            out.clear()

    for batch in batches:
        new = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = ids_of(text)
            whole = len(ids) // max_tokens * max_tokens
            for s in range(0, whole, max_tokens):
                lay([(doc, s, ids[s : s + max_tokens], len(ids))])
            if whole < len(ids):
                new.append((doc, whole, ids[whole:].copy(), len(ids)))
            if len(new) >= POOL // 2:
                bins.add(new, [(len(p[2]), 1, len(p[2])) for p in new])
                new = []
                while len(bins.items) > POOL // 2:
                    close(bins.fill(_cut))
        if new:
            bins.add(new, [(len(p[2]), 1, len(p[2])) for p in new])
        yield from packed()
    while bins.items:
        close(bins.fill(_cut))
    yield from packed()


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def tasks(batches):
        yield from pack_documents(batches, TaskContext.get().partitionId(), max_tokens, max_segments)

    return docs.select("doc_id", "text").mapInArrow(trimmed(tasks), _PIECE)


def pack_examples(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, pool: int = POOL) -> DataFrame:
    """Sequences of whole examples, such as instruction data: example_id, tokens, segments, loss_tokens and sequence_id.

    No sequence is above any of the three limits; an example above one by itself is an error. A null count is 0."""

    def tasks(batches: Iterator[pa.RecordBatch]):
        bins, count, out = Bins((max_tokens, max_segments, max_loss)), TaskContext.get().partitionId() << 40, []

        def close(least: int) -> None:
            nonlocal count
            while len(bins.items) > least:
                out.extend((*e, count) for e in bins.fill())
                count += 1

        def done() -> pa.RecordBatch:
            rows = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names=["example_id", "tokens", "segments", "loss_tokens", "sequence_id"])

        for b in batches:
            rows = [(i, t or 0, n or 0, x or 0) for i, t, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            for at in range(0, len(rows), pool):
                bins.add(rows[at : at + pool], [r[1:] for r in rows[at : at + pool]])
                close(pool)
            if out:
                yield done()
        close(0)
        if out:
            yield done()

    schema = "example_id long, tokens long, segments long, loss_tokens long, sequence_id long"
    return examples.selectExpr("cast(example_id as long)", "cast(tokens as long)", "cast(segments as long)", "cast(loss_tokens as long)").mapInArrow(tasks, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
