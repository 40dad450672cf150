"""Near-duplicate groups by SimHash fingerprints, found with BK-trees.

Method. A document's fingerprint has a bit for each position that is set in over half of its shingles' hashes. Distinct
fingerprints (equal ones are one vertex from here on) are routed to shards; a shard holds a BK-tree, whose children
are keyed by their Hamming distance to the parent, and a search follows only the edges that lie within the radius of the
distance to the node. A shard reports each fingerprint once, linked to the first of its group there, so its output is
linear in its input; connected components over these links give the groups.

Shards. With 64 bits and a small radius r the routes are exact: the bits are split into r + 2 blocks, of which at least
two agree for any two fingerprints within r, and every pair of blocks is a route (`masks`). A shard that is over
SHARD_ROWS refines itself: of its other bits, in r + 1 blocks, at least one agrees too. The third refinement has so
few bits left that a shard can't exceed 2^15 values: a hot group never is one task's. A tree reaches the task that
searches it by the shuffle on the route, not by a broadcast from the driver, since all trees together are the
fingerprints of all documents, which mustn't pass through the driver.

Near copies at a similarity of 0.8 (the pipeline's stage) differ in too many of 64 bits for that. `near_copies` takes WIDE_WORDS x 64 bits of
the set of five-word shingles, and BANDS runs of bits as routes, which two documents miss together with a probability that
`bands_miss` states. A run is so long (`band_bits`) that unrelated documents share a shard with few others in any corpus, and shards that are large all
the same, since they hold copies, are parted by further bits: a shard's search takes time in the square of its rows. Its tree gives each document its
NEAREST nearest ones within WIDE_RADIUS, later ones too, and the nearest of each group that came before it. The Jaccard similarity of these
pairs is checked exactly, in rounds: first each document's nearest, then the nearest that isn't in its group by then, at last all that still
lie in two groups. So few pairs of a large group are ever checked.

Routes, nearest ones and rounds only find most links cheaply; none is lost by them, since the rest is found exactly. Of each set's shingles,
ordered by how common they are in a sample and by hash, those of the prefix are posted: two sets at least as similar as asked share one there, for any
order. Two documents of different groups are met by a shingle if it can be their first common one, and leaves room for the similarity in both sets:
rare shingles come first, so sets that share only common ones aren't met. Of any pairs, those whose prefixes, and then the last 16 bits of whose
shingles, have too little in common are dropped before whole sets are compared. The result thus doesn't depend on BAND, NEAREST, WIDE_RADIUS or the sample; only the work
does. Documents with an equal wide fingerprint count as one.

Defined cases. A null or empty text, or one without a word, has fingerprint 0 and links like any other. Fewer words than
a shingle: the whole sequence is the only shingle. Null doc_ids: they join groups, and component_id is the smallest doc_id
that isn't null, or null if there is none. Rows with the same doc_id are one document, whose fingerprints are all linked; any long is a
doc_id. Repeated rows come out as often as they came in. Empty table: empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import heappush, heappushpop
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import cut, prefiltered, read_table, scope, settle, trimmed
from .components import components
from .suffix_dedup import packed, unpacked

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a shard before it refines itself.
SHARD_ROWS = 4096
#: Routes of wide fingerprints, their bits at least, and unrelated fingerprints in a shard of them at most.
BANDS, BAND, SHARD_STRANGERS = 29, 13, 128

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # high bit first


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; words are lower-cased in A-Z only."""
    words = (text or "").encode().lower().split()  # bytes know only ASCII letters and white space
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    starts, at = [0], 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])], np.uint64)


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash (0: itself), by a finaliser of 64 bits."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 bits a word, big-endian: the majority of each bit; no hashes: zero."""
    if not len(hashes):
        return bytes(8 * words)
    out = b""
    for k in range(words):
        low = _remixed(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.bincount((low + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
        out += np.packbits(counts.ravel() * 2 > len(hashes)).tobytes()
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE, words: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to carry along, and print. Wide prints are those of the set of shingles, without repeats."""
    kept = docs.select("doc_id", *carry)

    def tasks(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            hashes = (shingle_hashes(t, size) for t in b.column("text").to_pylist())
            prints = [fingerprint(h if words == 1 else np.unique(h), words) for h in hashes]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints, pa.binary())], names=[*b.schema.names[1:], "print"])

    schema = StructType([*kept.schema.fields, StructField("print", BinaryType())])
    return docs.select("text", "doc_id", *carry).mapInArrow(trimmed(tasks), schema)


def blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n runs of nearly equal length."""
    edges = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:])]


def masks(radius: int) -> list[list[int]]:
    """Three levels of routes for 64 bits: each level's masks extend the level's before, radius + 1 for each."""
    levels = [[a | b for a, b in combinations(blocks(list(range(64)), radius + 2), 2)]]
    for _ in range(2):
        levels.append([m | part for m in levels[-1] for part in blocks([i for i in range(64) if not m >> i & 1], radius + 1)])
    return levels


def _mixed(value: np.ndarray, which: np.ndarray | int) -> np.ndarray:
    return _remixed(value ^ np.uint64(0x5851F42D4C957F2D), 1) + np.asarray(which, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def band_bits(rows: int) -> int:
    """Bits of a route of wide prints: so many that a shard has SHARD_STRANGERS unrelated fingerprints or fewer, BAND at least."""
    return max(BAND, (max(1, rows) // SHARD_STRANGERS).bit_length())


def band_table(words: int, band: int) -> np.ndarray:
    """The bits of each of BANDS routes: evenly spaced runs, which overlap where they are long."""
    bits = 64 * words
    return (np.arange(BANDS)[:, None] * bits // BANDS + np.arange(band)) % bits


def _routed(prints: DataFrame, level_masks: list[int], fan: int, words: int, band: int = BAND) -> DataFrame:
    """(route, mask, vertex, print) for each mask, or at a deeper level for the fan masks below a row's own. Routes are
    hashes: two that collide share a tree, where distances are still the true ones."""
    wide = words > 1

    def tasks(batches: Iterator[pa.RecordBatch]):
        table = np.array([] if wide else level_masks, np.uint64)
        places = band_table(words, band)
        for b in batches:
            data = b.column("print").to_pylist()
            if not data:
                continue
            if wide:
                bits = np.unpackbits(np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1), axis=1)
                values = (bits[:, places] @ (1 << np.arange(band)[::-1])).astype(np.uint64)
                own = np.broadcast_to(np.arange(BANDS), values.shape)
            else:
                own = np.broadcast_to(np.arange(len(table)), (len(data), len(table))) if fan == 0 else np.asarray(b.column("mask"))[:, None] * fan + np.arange(fan)
                values = np.frombuffer(b"".join(data), ">u8").astype(np.uint64)[:, None] & table[own]
            k = own.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_mixed(values, own).ravel().view(np.int64)),
                    pa.array(own.ravel().astype(np.int32)),
                    pa.array(np.repeat(np.asarray(b.column("vertex")), k)),
                    pa.array(np.repeat(np.array(data, object), k), pa.binary()),
                ],
                names=["route", "mask", "vertex", "print"],
            )

    return prints.mapInArrow(trimmed(tasks), "route long, mask int, vertex long, print binary")


def _heavy(routes: DataFrame, rows: int) -> DataFrame | None:
    """The routes of more than so many rows."""
    found = cut(routes.groupBy("route").count().where(F.col("count") > rows).select("route"), "heavy")
    return None if found.isEmpty() else found


def _refined(routes: DataFrame, words: int, rows: int) -> DataFrame:
    """Shards of wide prints with more than so many rows, parted by 16 more bits at a time. Near copies that so lose sight of each other
    there have the other routes, and the prefixes."""
    done: list[DataFrame] = []
    for k in range(4 * words):
        if (heavy := _heavy(routes, rows)) is None:
            break
        done.append(routes.join(heavy, "route", "left_anti"))
        further = F.expr(f"substring(print, pmod(mask + {k}, {4 * words}) * 2 + 1, 2)")
        routes = cut(routes.join(heavy, "route", "left_semi").withColumn("route", F.xxhash64("route", further)), "refined")
    for d in done:
        routes = routes.unionByName(d)
    return routes


class BKTree:
    """Children keyed by integer Hamming distance to the parent; a search follows edges within the radius only."""

    __slots__ = ("value", "below")

    def __init__(self, value: int):
        self.value, self.below = value, {}

    def add(self, value: int) -> None:
        node = self
        while (d := (node.value ^ value).bit_count()) in node.below:
            node = node.below[d]
        node.below[d] = BKTree(value)

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        """Values within the radius, with their distances."""
        stack = [self]
        while stack:
            node = stack.pop()
            d = (node.value ^ value).bit_count()
            if d <= radius:
                yield node.value, d
            below = node.below
            if len(below) <= 2 * radius + 1:
                stack += [c for k, c in below.items() if d - radius <= k <= d + radius]
            else:
                stack += [below[k] for k in range(d - radius, d + radius + 1) if k in below]


def shard_links(vertices: list[int], prints: list[bytes], radius: int, nearest: int = 0) -> Iterator[tuple[int, ...]]:
    """Links within the radius between a shard's fingerprints: from each but the first of a connected group to that first one; or,
    nearest, with their distance, from each fingerprint to so many nearest ones and to the nearest of each group that came before it."""
    vertex = {int.from_bytes(p, "big"): v for p, v in zip(prints, vertices, strict=True)}
    values = sorted(vertex, key=vertex.get)
    parent: dict[int, int] = {}
    close: dict[int, list[tuple[int, int]]] = {}
    tree = None

    def offer(x: int, d: int, y: int) -> None:
        if len(close[x]) < nearest:
            heappush(close[x], (-d, y))
        else:
            heappushpop(close[x], (-d, y))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in values:
        parent[v], close[v] = v, []
        if tree is None:
            tree = BKTree(v)
            continue
        best: dict[int, tuple[int, int]] = {}
        for near, d in tree.within(v, radius):
            r = root(near)
            best[r] = min(best.get(r, (d, near)), (d, near))
            if nearest:
                offer(v, d, near)
                offer(near, d, v)
        for r, (d, near) in best.items():
            parent[max(r, root(v), key=vertex.get)] = min(r, root(v), key=vertex.get)
            if nearest:
                yield vertex[v], vertex[near], d
        tree.add(v)
    for v in values:
        if nearest:
            yield from ((vertex[v], vertex[near], -d) for d, near in close[v])
        elif (r := root(v)) != v:
            yield vertex[v], vertex[r]


def _searched(routes: DataFrame, radius: int, nearest: int) -> DataFrame:
    """Links of all shards. Rows come sorted by route, so a task holds one shard at a time."""
    names = ["u", "v", "distance"] if nearest else ["u", "v"]

    def linked(out: list[tuple[int, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    def tasks(batches: Iterator[pa.RecordBatch]):
        last, vs, ps = None, [], []
        for b in batches:
            route, out = np.asarray(b.column("route")), []
            starts = np.flatnonzero(np.r_[True, route[1:] != route[:-1]]) if len(route) else np.empty(0, int)
            ends = np.r_[starts[1:], len(route)]
            vertex, prints = b.column("vertex"), b.column("print")
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                edge = i == 0 or i == len(starts) - 1
                if not edge and e - s == 1:
                    continue
                v, p = vertex[s:e].to_pylist(), prints[s:e].to_pylist()
                if route[s] != last:
                    if len(vs) > 1:
                        out += shard_links(vs, ps, radius, nearest)
                    last, vs, ps = route[s], v, p
                else:
                    vs += v
                    ps += p
            if out:
                yield linked(out)
        if len(vs) > 1 and (out := list(shard_links(vs, ps, radius, nearest))):
            yield linked(out)

    return routes.select("route", "vertex", "print").repartition("route").sortWithinPartitions("route").mapInArrow(trimmed(tasks), ", ".join(f"{c} long" for c in names))


def links(prints: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v) between vertices of distinct fingerprints (vertex, print) that lie within the radius; components, not pairs."""
    fan, found, rows, levels = 0, None, prints, masks(radius)
    for k, level in enumerate(levels):
        routes, heavy = _routed(rows, level, fan, 1), None
        if k + 1 < len(levels):
            routes = cut(routes, "routes")
            heavy = _heavy(routes, shard_rows)
        part = _searched(routes if heavy is None else routes.join(heavy, "route", "left_anti"), radius, 0)
        found = part if found is None else found.unionByName(part)
        if heavy is None:
            break
        rows, fan = routes.join(heavy, "route", "left_semi"), radius + 1
    return found


def candidates(prints: DataFrame, radius: int, words: int, shard_rows: int) -> DataFrame:
    """(u, v, distance) between vertices of distinct wide fingerprints (vertex, print): for each the nearest ones of its shards."""
    routes = cut(_routed(prints, [], 0, words, band_bits(prints.count())), "routes")
    return _searched(_refined(routes, words, shard_rows), radius, NEAREST)


def _by_id(prints: DataFrame, distinct: DataFrame) -> DataFrame:
    """(u, v) between the fingerprints of rows that have a doc_id in common."""
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi")
    several = cut(several.select("doc_id", F.col("lo").alias("one")), "several")
    if several.isEmpty():
        return prints.sparkSession.createDataFrame([], "u long, v long")
    rows = prints.join(several, "doc_id").select("print", "one").distinct()
    ends = distinct.select("print", F.col("vertex").alias("u")), distinct.select(F.col("print").alias("one"), F.col("vertex").alias("v"))
    return rows.join(ends[0], "print").join(ends[1], "one").select("u", "v")


def simhash_groups(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, print (bytes) and component_id (the smallest doc_id of its group)."""
    with scope(docs.sparkSession) as keep:
        prints = cut(fingerprints(docs, size), "prints")
        distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least")).select("print", "least", F.monotonically_increasing_id().alias("vertex")), "distinct")
        groups = components(links(distinct, radius).unionByName(_by_id(prints, distinct)))
        labelled = distinct.join(groups.withColumnsRenamed({"u": "vertex", "v": "label"}), "vertex", "left").select("print", "least", F.coalesce("label", "vertex").alias("label"))
        labelled = cut(labelled, "labelled")
        keep(prints, labelled)
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(labelled.join(least, "label").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


#: Bits / 64 and radius: two documents of Jaccard similarity J differ in arccos(2 J / (1 + J)) / pi of the bits, 58 of 384 with a standard
#: deviation of 7 at 0.8; unrelated ones in 192.
WIDE_WORDS, WIDE_SHINGLE, WIDE_RADIUS, SIMILARITY = 6, 5, 80, 0.8
#: Wide prints in a shard before it is parted; candidates of a document there, and rounds in which all are checked.
WIDE_SHARD_ROWS, NEAREST, ROUNDS = 1024, 2, 3
#: Documents among which common shingles are counted (so many, or that share of all), and shingles that are ordered by that.
SAMPLED, SAMPLED_SHARE, COMMON = 16_000, 1 / 32, 1 << 17
#: Shingles that a task holds before it passes them on, and texts, or pairs, that a Python function gets at a time.
FLUSH, TEXTS, PAIRS = 1 << 19, 1000, 500


def _nearest(pairs: DataFrame) -> DataFrame:
    """The nearest pair of each vertex."""
    ends = pairs.select(F.col("u").alias("x"), F.struct("distance", "u", "v").alias("pair")).union(pairs.select("v", F.struct("distance", "u", "v")))
    return ends.groupBy("x").agg(F.min("pair").alias("pair")).select("pair.u", "pair.v").distinct()


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs that lie in two groups (u, v: a vertex and the least of its group)."""
    for c in ("u", "v"):
        pairs = pairs.join(groups.select(F.col("u").alias(c), F.col("v").alias(f"{c}_label")), c, "left")
    return pairs.where(F.coalesce("u_label", "u") != F.coalesce("v_label", "v")).select("u", "v", "distance")


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, sorted, and in how many. They only order shingles: any order gives the same groups."""
    part = docs.select("text").sample(min(1.0, max(SAMPLED_SHARE, SAMPLED / max(1, docs.count()))), SEED)

    def tasks(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(np.unique(shingle_hashes(t, WIDE_SHINGLE)))
                n += len(held[-1])
            if n >= FLUSH:
                yield _repeated(held)
                held, n = [], 0
        if held:
            yield _repeated(held)

    counts = part.mapInArrow(trimmed(tasks), "shingle long, count long").groupBy("shingle").agg(F.sum("count").alias("count"))
    found = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    shingles, n = found.column("shingle").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def _repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
    """The hashes that occur in several sets, and in how many."""
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["shingle", "count"])


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of a set's n sorted hashes, rare ones first: two sets at least this similar share one of theirs."""
    known, counts = common
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]


def _printed(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, file, row, the wide print, the size of the set of shingles and its prefix."""
    kept, common = docs.select("doc_id", "file", "row"), _common(docs)

    def tasks(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, WIDE_SHINGLE)) for t in b.column(0).to_pylist()]
            heads = [prefix(h, common, similarity) for h in sets]
            ends = pa.array(np.cumsum([0, *map(len, heads)]), pa.int32())
            values = pa.array(np.concatenate([np.empty(0, np.uint64), *heads]).view(np.int64))
            made = [pa.array([fingerprint(h, WIDE_WORDS) for h in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.ListArray.from_arrays(ends, values)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*b.schema.names[1:], "print", "size", "prefix"])

    more = StructType.fromDDL("print binary, size int, prefix array<long>")
    made = docs.select("text", "doc_id", "file", "row").mapInArrow(trimmed(tasks), StructType([*kept.schema.fields, *more.fields]))
    return cut(made.select("*", F.monotonically_increasing_id().alias("vertex")), "prints", TEXTS)


def _shared(prints: DataFrame) -> DataFrame:
    """(code): the first 48 bits of shingles that occur in several prefixes. Most occur in one, so only these bits are shuffled, sorted and packed;
    a bucket holds those of a range."""
    total = prints.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    bits = max(0, (total // FLUSH).bit_length())

    def rows(codes: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(codes) >> np.uint64(16), return_counts=True)
        found = np.repeat(found, np.minimum(n, 2))
        edges = np.searchsorted(found >> np.uint64(48 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        full = np.flatnonzero(edges[1:] > edges[:-1])
        return pa.RecordBatch.from_arrays([pa.array(full), pa.array([packed([found[edges[i] : edges[i + 1]]], (6,)) for i in full], pa.binary())], names=["bucket", "data"])

    def dealt(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for b in batches:
            held.append(np.asarray(b.column(0).flatten()).view(np.uint64))
            n += len(held[-1])
            if n >= FLUSH:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    def several(batches: Iterator[pa.RecordBatch]):
        last, blobs = None, []

        def found() -> pa.RecordBatch:
            codes = np.sort(unpacked(blobs, (6,))[0])
            return pa.RecordBatch.from_arrays([pa.array(np.unique(codes[1:][codes[1:] == codes[:-1]]).view(np.int64))], names=["code"])

        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != last and blobs:
                    yield found()
                    blobs = []
                last = bucket
                blobs.append(data)
        if blobs:
            yield found()

    packs = prints.select("prefix").mapInArrow(trimmed(dealt), "bucket long, data binary")
    return cut(packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(several), "code long"), "shared")


def _posts(prints: DataFrame, distinct: DataFrame) -> DataFrame:
    """(vertex, size, at, shingle, before, earlier): the prefixes' shingles that several vertices have, and the last two such ones before each."""
    posts = prints.select("vertex", "size", F.posexplode("prefix").alias("at", "shingle")).withColumn("code", F.shiftrightunsigned("shingle", 16))
    shared = _shared(prints)
    posts = prefiltered(posts, shared, ["code"]).join(shared, "code", "left_semi").drop("code").join(distinct.select("vertex"), "vertex", "left_semi")
    own = Window.partitionBy("vertex").orderBy("at")
    return cut(posts.select("*", F.lag("shingle", 1).over(own).alias("before"), F.lag("shingle", 2).over(own).alias("earlier")), "posts")


def _labelled(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """With the label of each row's group."""
    named = groups.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
    return posts.join(named, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))


def _rest(live: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all pairs of two groups whose first common shingle can be one of theirs: those at a place, in a set of a size, that leaves room
    for the similarity. What comes before the first common one in either set isn't shared, so at most what comes after is. A shingle that one
    of those before it in both sets precedes isn't the first, so few pairs are found by more than that."""
    share = F.lit(similarity / (1 + similarity))
    x, y = (live.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("vertex", "label", "size", "at", "before", "earlier"))) for k in "xy")
    y = y.where(F.expr("size_y - at_y") >= share * 2 * F.col("size_y") - F.lit(1e-6))  # of two sets that of fewer, and it must have room beside one as large
    both = x.join(y, "shingle").where("label_x <> label_y and (size_x > size_y or (size_x = size_y and vertex_x > vertex_y))")
    both = both.where(F.least(F.expr("size_x - at_x"), F.expr("size_y - at_y")) >= share * F.expr("size_x + size_y") - F.lit(1e-6))
    same = [F.coalesce(F.col(f"{a}_x") == F.col(f"{b}_y"), F.lit(False)) for a in ("before", "earlier") for b in ("before", "earlier")]
    both = both.where(~reduce(or_, same))
    return both.select(F.least("vertex_x", "vertex_y").alias("u"), F.greatest("vertex_x", "vertex_y").alias("v")).distinct()


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shard_rows: int = WIDE_SHARD_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text, file, row; the latter two tell rows apart): doc_id, file, row, label of its group.

    Groups are connected by all pairs of at least this Jaccard similarity of their sets of five-word shingles, checked exactly."""
    with scope(docs.sparkSession) as keep:
        out = cut(_near_copies(docs, similarity, shard_rows), "groups")
        keep(out)
    return out


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sorted arrays, repeats included."""
    if len(x) == 0 or len(y) == 0:
        return 0
    both = np.concatenate([x, y])
    if len(x) == len(np.unique(x)) and len(y) == len(np.unique(y)):
        both.sort()
        return int((both[1:] == both[:-1]).sum())
    (a, n), (b, m) = (np.unique(z, return_counts=True) for z in (x, y))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _near_copies(docs: DataFrame, similarity: float, shard_rows: int) -> DataFrame:
    with scope(docs.sparkSession) as keep:
        whole = _printed(docs, similarity)
        prints = cut(whole.drop("prefix"), "prints")
        distinct = cut(prints.groupBy("print").agg(F.min(F.struct("vertex", "file", "row")).alias("first")).select("print", "first.*"), "distinct")
        settle(docs.sparkSession)
        posts = _posts(whole, distinct)
        tokens = cut(posts.groupBy("vertex").agg(F.collect_list("shingle").alias("tokens"), F.first("size").alias("size")), "tokens")
        settle(docs.sparkSession)
        near = candidates(distinct.select("vertex", "print"), WIDE_RADIUS, WIDE_WORDS, shard_rows)
        pairs = cut(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "distance").distinct(), "pairs")
        keep(prints, distinct, posts, tokens, pairs)

    def shingles(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, WIDE_SHINGLE)) for t in b.column(1).to_pylist()]
            made = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in ([np.sort(x.astype(np.uint16)) for x in sets], sets)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["vertex", "codes", "shingles"])

    def check(batches: Iterator[pa.RecordBatch], kind: type):
        """Of the shingles, or of their last 16 bits: these have no less in common, so what they rule out is ruled out."""
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
                both = _in_common(x, y)
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def sets_of(vertices: DataFrame) -> DataFrame:
        members = cut(distinct.join(vertices, "vertex", "left_semi").select("vertex", "file", "row"), "members")
        texts = prefiltered(docs.select("text", "file", "row"), members, ["file", "row"]).join(members, ["file", "row"]).select("vertex", "text")
        return cut(texts.mapInArrow(trimmed(shingles), "vertex long, codes binary, shingles binary"), "shingles", TEXTS)

    def possible(now: DataFrame) -> DataFrame:
        """The pairs that what their prefixes share, and all that comes after the one's that ends first, could make as similar as asked."""
        one, two = (tokens.withColumnsRenamed({"vertex": c, "tokens": f"{c}_tokens", "size": f"{c}_size"}) for c in "uv")
        both = F.size(F.array_intersect("u_tokens", "v_tokens"))
        after = [F.ceil(F.lit(similarity) * F.col(f"{c}_size") - F.lit(1e-6)) - 1 for c in "uv"]
        enough = F.lit(similarity / (1 + similarity)) * (F.col("u_size") + F.col("v_size")) - F.lit(1e-6)
        return now.select("u", "v").join(one, "u").join(two, "v").where(both + F.greatest(*after) >= enough).select("u", "v")

    def checked(now: DataFrame) -> DataFrame:
        nonlocal sets
        now = cut(possible(now), "possible")
        new = now.select(F.col("u").alias("vertex")).union(now.select("v")).distinct()
        if sets is not None:
            new = new.join(sets, "vertex", "left_anti")
        new = cut(new, "new")
        if sets is None or not new.isEmpty():
            more = sets_of(new)
            sets = more if sets is None else sets.union(more)
        for column, kind in (("codes", np.uint16), ("shingles", np.uint64)):
            one, two = (sets.select(F.col("vertex").alias(c), F.col(column).alias(f"{c}_set")) for c in "uv")
            both = now.join(one, "u").join(two, "v").select("u", "v", "u_set", "v_set")
            now = cut(both.mapInArrow(trimmed(lambda batches, kind=kind: check(batches, kind)), "u long, v long"), "checked", PAIRS)
            settled()
        return now

    def settled() -> None:
        settle(docs.sparkSession)

    settled()
    sets = edges = tried = groups = None
    for left in reversed(range(ROUNDS)):
        now = cut(_nearest(pairs), "nearest") if left else pairs
        found = checked(now)
        edges = found if edges is None else edges.union(found)
        tried = now.select("u", "v") if tried is None else tried.union(now.select("u", "v"))
        groups = components(found if groups is None else groups.unionByName(found), settled)
        if left:
            pairs = cut(_apart(pairs.join(now, ["u", "v"], "left_anti"), groups), "pairs")
            if pairs.isEmpty():
                break
    # what shards don't offer: pairs of two groups whose prefixes meet
    now = cut(_rest(_labelled(posts, groups), similarity).join(tried, ["u", "v"], "left_anti"), "met")
    if not now.isEmpty() and not (found := checked(now)).isEmpty():
        groups = components(groups.unionByName(found), settled)
    groups = groups.withColumnsRenamed({"u": "vertex", "v": "label"})
    labelled = distinct.join(groups, "vertex", "left").select("print", F.coalesce("label", "vertex").alias("label"))
    return prints.select("doc_id", "file", "row", "print").join(labelled, "print").select("doc_id", "file", "row", "label")


def bands_miss(jaccard: float, band: int = BAND) -> float:
    """The probability that no band of two documents of this similarity agrees (bits taken as independent)."""
    agree = 1 - np.arccos(2 * jaccard / (1 + jaccard)) / np.pi
    return float((1 - agree**band) ** BANDS)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")
