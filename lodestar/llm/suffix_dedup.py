"""Substring deduplication: removes every byte that a string of LENGTH bytes covers which a document with a smaller doc_id also has.

Method. Windows are compared where they can be equal. The least hash of the K-byte strings within a window routes it; windows in
a row with the same least hash are a run, and a run's text is a segment. Equal windows have equal routes, in whatever documents. In a
bucket of routes, equal segments collapse to their smallest document: the others' whole runs are covered. Different segments of a route may share
some windows: these segments' texts form the bucket's text, whose Burrows-Wheeler transform is expanded interval by
interval up to LENGTH (bwt), and windows whose interval holds a smaller document are covered. A route of a single segment can't share a window, so
only routes with several ever reach the transform. Equality of segments is by two hashes of 48 bits each.

Scale. Three shuffles of bounded rows: hashes of runs (about one run for 17 bytes, packed by byte planes), and the texts, by document, twice:
to cut out the segments that are asked for, and to remove what is covered. A bucket stands for BUCKET_BYTES of text, whatever the table's
size, and a task holds one bucket at a time; of its segments, whole routes of PIECE_BYTES or more at a time are transformed. A run that many documents share is settled in the task that reads them, which passes on only
its smallest document, so a passage in a third of all documents sends one row for each FLUSH_BYTES of text. A string that many documents have
in different surroundings makes a hot route of many segments: such routes are found in a sample and parted by the bytes around the string
(_parted), up to whole windows, so that their segments spread over all buckets. Nothing but at most HOT_ROUTES routes passes through the driver.

Defined cases. A null text is empty. Any long is a doc_id, negative ones too. Documents with the same doc_id don't cover each other, nor do
null doc_ids, which count as larger than all others. Rows that repeat come out as often as they came in. Texts shorter than LENGTH bytes lose nothing.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import shared_windows
from .common import cut, read_table, scope, trimmed

LENGTH, K = 50, 20
#: Text for a bucket, and text after which a task passes on its runs. Windows in a run at most.
BUCKET_BYTES, FLUSH_BYTES, RUN = 8 << 20, 12 << 20, 64
#: Text of a transform, but for its last route; measured, a transform takes 68 bytes of memory for each byte of it.
PIECE_BYTES = 1 << 20
#: A route of more segments is hot, and parted; hot routes are sought in a sample (of so many bytes, or that share); the hottest are parted first.
HOT_SEGMENTS, SAMPLE_BYTES, SAMPLE_SHARE, HOT_ROUTES = 20_000, 16 << 20, 1 / 64, 1 << 16
#: Times that a hot route is halved at most: after that it has one window's text.
LEVELS = 5

#: Documents carry unsigned numbers in the order of their ids; a variant tells texts of one id apart, and has this bit where there is no id.
_SIGN, _NO_ID = 1 << 63, 1 << 31
_CHUNK = 1 << 20
#: Tasks of the transforms at most.
TASKS = 1 << 15
#: Texts, or packed rows, that a Python function gets at a time.
_TEXTS, _BLOBS = 128, 32
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Bytes kept of each number of a packed row: route, segment, document, variant, start, windows.
_RUN_BYTES, _COVER_BYTES = (6, 6, 8, 4, 4, 1), (8, 4, 4, 4)
_REPLY, _RUNS, _ASK, _TEXT = 0, 1, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parted(route: np.ndarray, at: np.ndarray, gram: np.ndarray, hot: np.ndarray, length: int, k: int) -> None:
    """Replaces the routes of windows (at: their starts) that are hot, until they aren't.

    A window's place around its least string is halved LEVELS times. All windows of a place's interval contain certain bytes around
    that string, the more the shorter the interval is; these bytes and the interval are the new route, so it still is a function of the window alone."""
    width = length - k + 1
    for first in range(0, len(at), 1 << 16):
        now = slice(first, first + (1 << 16))
        which = first + np.flatnonzero(_among(route[now], hot))
        if not len(which):
            continue
        begin = at[which]
        place = gram[begin[:, None] + np.arange(width)].argmin(axis=1)
        for level in range(1, LEVELS + 1):
            edges = np.arange((1 << level) + 1) * width >> level
            part = np.searchsorted(edges, place, "right") - 1
            low, size = edges[part], length - (edges[part + 1] - 1 - edges[part])
            start = begin + place - low
            value = gram[start] * _A + (part + (level << 8)).astype(np.uint64)
            for offset in (np.minimum(k, size - k), size - k):
                value = _mixed(value) * _A + gram[start + offset]
            route[which] = _mixed(value * _B) >> np.uint64(16)
            on = _among(route[which], hot)
            which, begin, place = which[on], begin[on], place[on]
            if not len(which):
                break


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the known ones, which are sorted."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def runs(texts: list[bytes], length: int = LENGTH, k: int = K, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, route, segment hash) of all runs of the texts. hot: routes to part, sorted."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    data = np.frombuffer(b"".join(texts) + bytes(RUN + length + 8), np.uint8)
    n = int(sizes.sum())
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    gram = eight[: len(eight) - k + 8] * _A
    for i, m in ((8, _B), (k - 8, _C)):
        gram = _mixed(gram ^ (eight[i : i + len(gram)] * m))
    low, span, width = gram, 1, length - k + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    mark = np.zeros(n + 1, np.int8)
    long = sizes >= length
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, (starts + sizes - length + 1)[long], -1)
    at = np.flatnonzero(np.cumsum(mark[:n], dtype=np.int8))
    of = np.repeat(np.arange(len(texts)), sizes)[at]
    value = _mixed(low[at] * _B) >> np.uint64(16)  # least hashes are small; routes are spread evenly
    if hot is not None and len(hot):
        _parted(value, at, gram, hot, length, k)
    head = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])]) if len(at) else np.empty(0, np.int64)
    count = np.diff(np.r_[head, len(at)])
    parts = -(-count // RUN)  # long runs (of texts that repeat themselves) in pieces
    which = np.repeat(np.arange(len(head)), parts)
    piece = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    head, count = head[which] + piece * RUN, np.minimum(count[which] - piece * RUN, RUN)
    begin = at[head]
    last = begin + count - 1 + length - k
    segment = count.astype(np.uint64)
    for j in range(0, RUN + length, k):
        segment = _mixed(segment * _A + gram[np.minimum(begin + j, last)])
    return of[head], begin - starts[of[head]], count, value[head], segment >> np.uint64(16)


def packed(columns, sizes: tuple[int, ...]) -> bytes:
    """Byte planes of the columns: high bytes, mostly zero, lie together and so compress."""
    return b"".join(np.ascontiguousarray(c).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :s].T.tobytes() for c, s in zip(columns, sizes, strict=True))


def unpacked(blobs: list[bytes], sizes: tuple[int, ...]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in sizes]
    for blob in blobs:
        data, n, at = np.frombuffer(blob, np.uint8), len(blob) // sum(sizes), 0
        for p, s in zip(parts, sizes, strict=True):
            full = np.zeros((n, 8), np.uint8)
            full[:, :s] = data[at : at + n * s].reshape(s, n).T
            p.append(full.view("<u8").ravel())
            at += n * s
    return [np.concatenate(p) if p else np.empty(0, np.uint64) for p in parts]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads and sizes of runs of equal values."""
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return heads, np.diff(np.r_[heads, len(key)])


def _less(doc: np.ndarray, variant: np.ndarray, least: np.ndarray, least_variant: np.ndarray) -> np.ndarray:
    """Whether the second document is smaller: by number, and those without an id are larger than all others."""
    return (least < doc) | ((least == doc) & (least_variant < _NO_ID) & (variant >= _NO_ID))


def _part(doc: np.ndarray, variant: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(doc * _A + variant) % np.uint64(parts)).astype(np.int64)


_ROW = "bucket long, kind int, part long, data binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 512], strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _dealt(key: np.ndarray, columns: list[np.ndarray], sizes: tuple[int, ...]) -> Iterator[tuple[int, bytes]]:
    """The rows of each key, packed."""
    o = np.argsort(key, kind="stable")
    heads, counts = _groups(key[o])
    for h, c in zip(heads.tolist(), counts.tolist(), strict=True):
        at = o[h : h + c]
        yield int(key[at[0]]), packed([x[at] for x in columns], sizes)


def _covered(doc, variant, start, count, parts: int, bucket=None) -> list[tuple]:
    part = _part(doc, variant, parts)
    return [(p if bucket is None else bucket, _REPLY, p, blob) for p, blob in _dealt(part, [doc, variant, start, count], _COVER_BYTES)]


def _numbers(doc) -> np.ndarray:
    return np.asarray(doc, np.int64).view(np.uint64) ^ np.uint64(_SIGN)


def _map(batches: Iterator[pa.RecordBatch], buckets: int, parts: int, flush: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc, variant, text) to runs, by bucket of their route; runs that a smaller document of the same flush has are replies already."""
    held: list[list[np.ndarray]] = []
    texts, docs, variants, size, total = [], [], [], 0, 0

    def chunk() -> None:
        of, start, count, route, segment = runs(texts, hot=hot)
        held.append([route, segment, _numbers(docs)[of], np.array(variants, np.uint64)[of], start.astype(np.uint64), count.astype(np.uint64)])

    def flushed() -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        o = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        route, segment, doc, variant, *_ = cols = [c[o] for c in cols]
        heads = np.flatnonzero(np.r_[True, (route[1:] != route[:-1]) | (segment[1:] != segment[:-1])]) if len(route) else np.empty(0, np.int64)
        least = np.repeat(heads, np.diff(np.r_[heads, len(route)]))
        more = _less(doc, variant, doc[least], variant[least])
        yield from _rows([(p % buckets, k, p, d) for _, k, p, d in _covered(*(c[more] for c in cols[2:]), parts)])
        cols = [c[~more] for c in cols]
        bucket = ((cols[0] >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        yield from _rows([(b, _RUNS, 0, blob) for b, blob in _dealt(bucket, cols, _RUN_BYTES)])

    for b in batches:
        for doc, variant, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            texts.append(text)
            docs.append(doc)
            variants.append(variant)
            size += len(text)
            if size >= _CHUNK:
                chunk()
                total += size
                texts, docs, variants, size = [], [], [], 0
                if total >= flush:
                    total = 0
                    yield from flushed()
    if texts:
        chunk()
    if held:
        yield from flushed()


def _reduce(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A bucket's runs to replies (whole runs that a smaller document has too) and requests (segments that may share windows)."""

    def judged(bucket: int, blobs: list[bytes]) -> list[tuple]:
        cols = unpacked(blobs, _RUN_BYTES)
        o = np.argsort(cols[0], kind="stable")
        cols = [c[o] for c in cols]
        heads, sizes = _groups(cols[0])
        many = np.repeat(sizes > 1, sizes)
        cols = [c[many] for c in cols]
        o = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        route, segment, doc, variant, start, count = [c[o] for c in cols]
        if not len(route):
            return []
        head = np.flatnonzero(np.r_[True, (route[1:] != route[:-1]) | (segment[1:] != segment[:-1])])
        sizes = np.diff(np.r_[head, len(route)])
        least = np.repeat(head, sizes)
        more = _less(doc, variant, doc[least], variant[least])
        rows = _covered(doc[more], variant[more], start[more], count[more], parts, bucket)
        top, width = _groups(route[head])
        unnamed = variant[head] >> np.uint64(31)
        differ = (np.minimum.reduceat(doc[head], top) != np.maximum.reduceat(doc[head], top)) | (np.minimum.reduceat(unnamed, top) != np.maximum.reduceat(unnamed, top))
        ask = np.repeat(np.repeat(differ, width), sizes) & ~more
        part = _part(doc[ask], variant[ask], parts)
        return rows + [(bucket, _ASK, p, blob) for p, blob in _dealt(part, [doc[ask], variant[ask], start[ask], count[ask]], _COVER_BYTES)]

    last, blobs = None, []
    for b in batches:
        passed = []
        for bucket, kind, part, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == _REPLY:
                passed.append((bucket, kind, part, data))
                continue
            if bucket != last:
                if blobs:
                    yield from _rows(judged(last, blobs))
                last, blobs = bucket, []
            blobs.append(data)
        yield from _rows(passed)
    if blobs:
        yield from _rows(judged(last, blobs))


class _ByDocument:
    """What rows that came before its texts say about each document of a part."""

    def __init__(self):
        self.part, self.blobs, self.index = None, [], None

    def add(self, part: int, bucket: int, data: bytes) -> None:
        self.blobs.append((bucket, data))

    def of(self, doc: int, variant: int) -> list[np.ndarray]:
        """Its starts, counts and buckets."""
        if self.index is None:
            cols = unpacked([d for _, d in self.blobs], _COVER_BYTES)
            width = sum(_COVER_BYTES)
            cols.append(np.repeat(np.array([b for b, _ in self.blobs], np.uint64), [len(d) // width for _, d in self.blobs]))
            o = np.lexsort((cols[2], cols[1], cols[0]))
            self.cols = [c[o] for c in cols]
            head = np.flatnonzero(np.r_[True, (np.diff(self.cols[0]) != 0) | (np.diff(self.cols[1]) != 0)]) if len(o) else np.empty(0, np.int64)
            ends = np.append(head[1:], len(o)) if len(o) else head
            self.index = {(d, v): (s, e) for d, v, s, e in zip(self.cols[0][head].tolist(), self.cols[1][head].tolist(), head.tolist(), ends.tolist(), strict=True)}
        s, e = self.index.get((doc, variant), (0, 0))
        return [c[s:e] for c in self.cols[2:]]


def _by_part(batches: Iterator[pa.RecordBatch], kind_of_notes: int):
    """(doc, variant, text, notes) of each text; rows are sorted by part, notes before texts."""
    part, notes = None, _ByDocument()
    for b in batches:
        for p, kind, bucket, doc, variant, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != part:
                part, notes = p, _ByDocument()
            if kind == kind_of_notes:
                notes.add(p, bucket, data)
            else:
                yield doc + _SIGN, variant, data, notes


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and requests to the segments asked for, by bucket."""
    held: dict[int, list] = {}
    size = 0

    def flushed():
        rows = []
        for bucket, found in held.items():
            numbers = [np.array(c, np.uint64) for c in zip(*(f[:4] for f in found), strict=True)]
            blob = packed(numbers, _COVER_BYTES)
            rows.append((bucket, _ASK, 0, len(found).to_bytes(4, "little") + blob + b"".join(f[4] for f in found)))
        held.clear()
        yield from _rows(rows)

    for doc, variant, text, notes in _by_part(batches, _ASK):
        for start, count, bucket in zip(*(c.tolist() for c in notes.of(doc, variant)), strict=True):
            held.setdefault(bucket, []).append((doc, variant, start, count, text[start : start + count + LENGTH - 1]))
            size += count + LENGTH
        if size >= _CHUNK * 4:
            yield from flushed()
            size = 0
    if held:
        yield from flushed()


def _ranks(doc: np.ndarray, variant: np.ndarray) -> np.ndarray:
    """Numbers in the order of the documents, equal for the same one."""
    unnamed = variant >= _NO_ID
    o = np.lexsort((unnamed, doc))
    new = np.r_[False, (doc[o][1:] != doc[o][:-1]) | (unnamed[o][1:] != unnamed[o][:-1])]
    out = np.empty(len(doc), np.int64)
    out[o] = np.cumsum(new)
    return out


def _pieces(texts: list[bytes], hot: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    """Numbers of the texts of whole routes, of so many bytes or more together (the last: of fewer). A segment's first window tells its route."""
    route = np.concatenate([runs([t[:LENGTH] for t in texts[i : i + 8192]], hot=hot)[3] for i in range(0, len(texts), 8192)])
    o = np.argsort(route, kind="stable")
    heads, counts = _groups(route[o])
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64)[o])
    first, before = 0, 0
    for end in (heads + counts).tolist():
        if ends[end - 1] - before >= piece or end == len(o):
            yield o[first:end]
            first, before = end, int(ends[end - 1])


def _expand(batches: Iterator[pa.RecordBatch], parts: int, hot: np.ndarray, piece: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A bucket's segments to replies, by the transforms of their texts."""

    def judged(blobs: list[bytes]) -> list[tuple]:
        numbers, texts, width = [], [], sum(_COVER_BYTES)
        for blob in blobs:
            n = int.from_bytes(blob[:4], "little")
            cols = unpacked([blob[4 : 4 + n * width]], _COVER_BYTES)
            numbers.append(cols)
            at = 4 + n * width
            for c in (cols[3] + np.uint64(LENGTH - 1)).tolist():
                texts.append(blob[at : at + c])
                at += c
        blobs.clear()
        doc, variant, start, _ = (np.concatenate(c) for c in zip(*numbers, strict=True))
        said = []
        for at in _pieces(texts, hot, piece):
            # a document may be cut out twice where its rows repeat
            found = shared_windows([texts[i] for i in at.tolist()], _ranks(doc[at], variant[at]), LENGTH)
            if found:
                which, offset, count = (np.array(c, np.uint64) for c in zip(*found, strict=True))
                i = at[which.astype(np.int64)]
                said.append((doc[i], variant[i], start[i] + offset, count))
        return _covered(*(np.concatenate(c) for c in zip(*said, strict=True)), parts) if said else []

    last, blobs = None, []
    for b in batches:
        for bucket, data in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            if bucket != last:
                if blobs:
                    yield from _rows(judged(blobs))
                last, blobs = bucket, []
            blobs.append(data)
    if blobs:
        yield from _rows(judged(blobs))


def removed_spans(starts: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed runs (begin, end) of runs of windows."""
    out: list[list[int]] = []
    for s, c in sorted(zip(starts.tolist(), counts.tolist(), strict=True)):
        e = s + c + length - 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))])


def _final(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    rows = []
    for doc, variant, text, notes in _by_part(batches, _REPLY):
        starts, counts, _ = notes.of(doc, variant)
        spans = removed_spans(starts, counts)
        kept, at = [], 0
        for s, e in spans:
            kept.append(text[at:s])
            at = e
        rest = b"".join([*kept, text[at:]])
        rows.append((None if variant >= _NO_ID else doc - _SIGN, len(text), len(text) - len(rest), len(spans), rest if texts else hashlib.sha256(rest).digest(), [x for s in spans for x in s]))
        if len(rows) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SPANS, strict=True)], schema=_SPANS)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SPANS, strict=True)], schema=_SPANS)


def _hot_routes(rows: DataFrame, total: int, segments: int) -> np.ndarray:
    """Routes of so many segments or more, and those of their parts that still have as many: found in a sample. Any set of routes gives the same
    result, so a missed one costs time alone; HOT_ROUTES bounds what the driver gets."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(1, total)))
    hot = np.empty(0, np.uint64)
    for _ in range(LEVELS):

        def count(batches: Iterator[pa.RecordBatch], hot=hot):
            for b in batches:
                if b.num_rows:
                    *_, route, segment = runs(b.column(0).to_pylist(), hot=hot)
                    one = np.unique(np.stack([route, segment]), axis=1)[0] if len(route) else route
                    found, n = np.unique(one, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["route", "n"])

        counts = rows.select("text").sample(share, 1).mapInArrow(trimmed(count), "route long, n long").groupBy("route").agg(F.sum("n").alias("n"))
        top = counts.where(F.col("n") >= max(2.0, segments * share)).orderBy(F.desc("n"), "route").limit(HOT_ROUTES).toArrow()
        more = np.setdiff1d(top.column("route").to_numpy().view(np.uint64), hot)
        hot = np.union1d(hot, more)
        if not len(more) or len(hot) >= HOT_ROUTES:
            break
    return hot


def substring_dedup(docs: DataFrame, texts: bool = True, bucket_bytes: int = BUCKET_BYTES, flush: int = FLUSH_BYTES, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; their SHA-256 unless texts), spans (begin
    and end of each removed run, in turn)."""
    with scope(docs.sparkSession) as keep:
        out = _deduplicated(docs, texts, bucket_bytes, flush, hot_segments)
        keep(out)
    return out


def _deduplicated(docs: DataFrame, texts: bool, bucket_bytes: int, flush: int, hot_segments: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    largest = F.lit((1 << 63) - 1)
    doc, unnamed = F.coalesce("doc_id", largest), F.when(F.col("doc_id").isNull(), F.lit(_NO_ID)).otherwise(0).cast("long")
    # rows that share a doc_id but not the text need a second key
    same = docs.select(doc.alias("doc"), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("n")).groupBy("doc").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("n").alias("n"))
    same = cut(same.select("doc", "n", (F.col("lo") != F.col("hi")).alias("split")), "texts")
    total = same.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    split = same.where("split").select("doc")
    rows = docs.select(doc.alias("doc"), unnamed.alias("variant"), text.cast("binary").alias("text"))
    if not split.isEmpty():
        code = F.xxhash64(F.col("text")).bitwiseAND(0x7FFFFFFF)
        rows = rows.join(split.withColumn("is_split", F.lit(True)), "doc", "left").select("doc", (F.col("variant") + F.when(F.col("is_split"), code).otherwise(0)).alias("variant"), "text")
    buckets = parts = max(1, -(-total // bucket_bytes))
    hot = _hot_routes(rows, total, hot_segments)

    def map_(batches):
        yield from _map(batches, buckets, parts, flush, hot)

    def reduce_(batches):
        yield from _reduce(batches, parts)

    def expand_(batches):
        yield from _expand(batches, parts, hot)

    def final_(batches):
        yield from _final(batches, texts)

    @F.pandas_udf("long")
    def part_of(d, v):
        import pandas as pd

        return pd.Series(_part(_numbers(d.to_numpy()), v.to_numpy().astype(np.uint64), parts))

    judged = cut(rows.mapInArrow(trimmed(map_), _ROW).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(reduce_), _ROW), "judged", _BLOBS)
    by_doc = rows.select(part_of("doc", "variant").alias("part"), F.lit(_TEXT).alias("kind"), F.lit(0).cast("long").alias("bucket"), "doc", "variant", F.col("text").alias("data"))

    def met(notes: DataFrame) -> DataFrame:
        said = notes.select("part", "kind", "bucket", F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("variant"), "data")
        return said.union(by_doc).repartition("part").sortWithinPartitions("part", "kind")

    segments = met(judged.where(F.col("kind") == _ASK)).mapInArrow(trimmed(_segments), _ROW)
    more = cut(segments.repartition(min(buckets, TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(expand_), _ROW), "expanded", _TEXTS)
    covered = judged.where(F.col("kind") == _REPLY).union(more)
    return cut(met(covered).mapInArrow(trimmed(final_), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>"), "deduplicated", _TEXTS)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
