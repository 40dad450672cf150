import hashlib

import numpy as np
import pytest

from lodestar.llm import bwt, suffix_dedup
from lodestar.llm.suffix_dedup import op6_suffix_dedup, substring_dedup

from .helpers import DOCUMENTS, documents, key

_NO_ID = 1 << 63


def brute(docs, n=50):
    first = {}
    for d, t in docs:
        b, k = (t or "").encode(), _NO_ID if d is None else d
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(k, first.get(b[i : i + n], k))
    out = []
    for d, t in docs:
        b, k = (t or "").encode(), _NO_ID if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < k:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


SHARED = "a passage of more than fifty bytes that turns up in several documents, cut short or not"
CASES = [
    (1, SHARED),
    (2, "x" + SHARED[:60] + "y"),
    (3, SHARED[:49]),
    (4, "q" * 300),
    (5, "q" * 200 + SHARED[20:] + "q" * 60),
    (6, "é" * 60 + SHARED),
    (6, "the same id with another text " + SHARED * 2),
    (7, None),
    (None, SHARED + "!"),
    (None, "é" * 30),
    (-5, "0123456789" * 4 + SHARED),
    (-(1 << 63), "far below" + SHARED[10:]),
    ((1 << 63) - 1, "of the largest id, " + "0123456789abcdefghij" * 3),
    (None, "of no id, " + "0123456789abcdefghij" * 3),
]


@pytest.mark.parametrize("rows", [[r[:2] for r in DOCUMENTS], CASES, CASES[::-1], []])
@pytest.mark.parametrize("size", [1 << 24, 1 << 9])
def test_small(spark, tmp_path, rows, size):
    docs = documents(spark, tmp_path, [(*r, None, None, None, None, None) for r in rows])
    out = substring_dedup(docs, texts=False, bucket_bytes=size, flush=size)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) for r in out.collect()]
    assert sorted(got, key=key) == brute(rows)


def _hot_rows(n=700):
    """A string of 20 bytes in every document, amid others; one of 40 in a third, with few surroundings; and windows that some share."""
    rng = np.random.default_rng(8)
    word = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    shared = [word(60) + "<twenty bytes, always>" + word(60) for _ in range(9)]
    rows = []
    for i in range(n):
        body = word(70) + (shared[i % 9] if i % 5 == 0 else word(40) + "<twenty bytes, always>" + word(40))
        if i % 3 == 0:
            body += word(10 + i % 7) + "a string of forty bytes that a third has" + word(8) + "ab"[i % 2] * 9
        rows.append((i - n // 2, body))
    return rows


@pytest.mark.parametrize("limit", [40, 10**9])
def test_a_string_in_every_document(spark, tmp_path, limit):
    rows = _hot_rows()
    docs = documents(spark, tmp_path, [(*r, None, None, None, None, None) for r in rows])
    out = substring_dedup(docs, texts=False, bucket_bytes=1 << 14, flush=1 << 14, hot_segments=limit)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) for r in out.collect()), key=key) == brute(rows)


def test_hot_routes_are_parted(spark):
    rows = _hot_rows(2000)
    texts = [t.encode() for _, t in rows]

    def largest(hot):
        *_, route, segment = suffix_dedup.runs(texts, hot=hot)
        pairs = np.unique(np.stack([route, segment]), axis=1)
        return np.unique(pairs[0], return_counts=True)[1].max()

    df = spark.createDataFrame([(t,) for t in texts], "text binary")
    hot = suffix_dedup._hot_routes(df, sum(map(len, texts)), 50)
    assert largest(None) > 500 and largest(hot) < 100


def test_parting_keeps_equal_windows_together():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 99, 400).astype(np.uint8)) + b"x" * 80 + bytes([97 + i % 2]) * 70 for i in range(20)]
    _, _, _, route, _ = suffix_dedup.runs(texts)
    hot = np.unique(route)
    for known in (hot, hot[::2], np.unique(np.concatenate([hot, suffix_dedup.runs(texts, hot=hot)[3]]))):
        seen = {}
        for of, start, count, r, _ in zip(*suffix_dedup.runs(texts, hot=known)):
            for i in range(int(start), int(start + count)):
                assert seen.setdefault(texts[of][i : i + 50], r) == r


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op6_suffix_dedup(spark, sf_dir).collect()), key=key) == brute(docs)


@pytest.mark.parametrize("seed", range(6))
def test_borders_are_those_of_sorted_suffixes(seed):
    rng = np.random.default_rng(seed)
    parts = [bytes(rng.integers(97, 97 + 1 + seed % 3, int(rng.integers(1, 90))).astype(np.uint8)) for _ in range(12)]
    parts += [parts[0] + parts[1], parts[2] * 2]
    owners = rng.integers(0, 5, len(parts))
    n, want = 7, set()
    for i, p in enumerate(parts):
        for at in range(len(p) - n + 1):
            if any(owners[j] < owners[i] and p[at : at + n] in q for j, q in enumerate(parts)):
                want.add((i, at))
    got = {(i, at + k) for i, at, c in bwt.shared_windows(parts, owners, n) for k in range(c)}
    assert got == want


def test_a_bucket_is_transformed_in_pieces_of_whole_routes(monkeypatch):
    """A transform's memory is bounded by a piece and a route, whatever a bucket holds, and what it finds is the same."""
    rows = sorted(_hot_rows(1500))
    texts, sizes = [t.encode() for _, t in rows], []
    of, start, count, *_ = suffix_dedup.runs(texts)
    cut = [texts[i][s : s + c + 49] for i, s, c in zip(of, start, count)]
    doc = of.astype(np.uint64)
    blob = suffix_dedup.packed([doc, doc * 0, start.astype(np.uint64), count.astype(np.uint64)], suffix_dedup._COVER_BYTES)
    batches = list(suffix_dedup._rows([(0, suffix_dedup._ASK, 0, len(cut).to_bytes(4, "little") + blob + b"".join(cut))]))
    whole = suffix_dedup.shared_windows

    def transform(segments, owners, length):
        sizes.append(sum(map(len, segments)))
        return whole(segments, owners, length)

    monkeypatch.setattr(suffix_dedup, "shared_windows", transform)

    def found(hot, piece):
        sizes.clear()
        blobs = [d for b in suffix_dedup._expand(iter(batches), 3, hot, piece) for d in b.column(3).to_pylist()]
        d, _, s, c = suffix_dedup.unpacked(blobs, suffix_dedup._COVER_BYTES)
        return sorted((x, y + k) for x, y, z in zip(d.tolist(), s.tolist(), c.tolist()) for k in range(z))

    none, total = np.empty(0, np.uint64), sum(map(len, cut))
    want = found(none, total)
    assert sizes == [total] and len(want) > 1000
    routes = suffix_dedup.runs(texts)[3]
    largest = max(sum(len(cut[i]) for i in np.flatnonzero(routes == r)) for r in np.unique(routes))
    for piece in (1, 5000):
        assert found(none, piece) == want
        assert sum(sizes) == total and max(sizes) < piece + largest < total
