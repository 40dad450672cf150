import numpy as np
import pytest
import xxhash

from lodestar.llm import common, simhash
from lodestar.llm.components import components

from .helpers import DOCUMENTS, documents, rows_of


def print_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words] if len(words) <= 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [print_of(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if ((prints[i] ^ prints[j]).bit_count() <= 2 or same) and root(i) != root(j):
                label[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((r[0], f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


_IDS = [(5, "one text of some words"), (5, "quite another that shares no word"), (9, "quite another that shares no word"), (-(1 << 63), "far away it lies, alone"), ((1 << 63) - 1, "the last of all longs"), ((1 << 63) - 2, "the last of all longs"), (None, "a b c d")]


def padded(rows):
    return [(*r, None, None, None, None, None) for r in rows]


@pytest.mark.parametrize("rows", [DOCUMENTS, [], [(None, "a b c d", None, None, None, None, None)], padded(_IDS), padded([(1, _IDS[0][1]), *_IDS])])
def test_small(spark, tmp_path, rows):
    documents(spark, tmp_path, rows)
    assert rows_of(simhash.op1_simhash(spark, str(tmp_path))) == brute(rows)


def test_whole_table(spark, oracle_dir):
    docs = spark.read.parquet(f"{oracle_dir}/documents.parquet")
    assert rows_of(simhash.op1_simhash(spark, oracle_dir)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_refined_shards_lose_no_link(spark):
    rng = np.random.default_rng(3)
    values = [0]
    for _ in range(1500):  # a chain of neighbours, and strangers
        v = values[int(rng.integers(len(values)))]
        values.append(v ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    values = sorted(set(values) | {int(x) for x in rng.integers(0, 1 << 63, 50)})
    prints = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(values)], "vertex long, print binary")
    for limit in (1 << 20, 40):
        found = {tuple(r) for r in components(simhash.links(prints, 2, shard_rows=limit)).collect()}
        label = dict(found)
        want = list(range(len(values)))
        for i in range(len(values)):
            for j in range(i):
                if (values[i] ^ values[j]).bit_count() <= 2:
                    a, b = want[i], want[j]
                    if a != b:
                        want = [min(a, b) if x in (a, b) else x for x in want]
        assert [label.get(i, i) for i in range(len(values))] == want


def test_near_copies_by_exact_similarity(spark, tmp_path):
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(10**6)
    rows, base = [], [word() for _ in range(300)]
    rows.append(base)
    for n in (3, 5, 10, 40):
        other = list(base)
        for i in rng.choice(300, n, replace=False):
            other[i] = word()
        rows.append(other)
    rows.append([word() for _ in range(300)])
    docs = documents(spark, tmp_path, [(i, " ".join(r), None, None, None, None, None) for i, r in enumerate(rows)])
    located = docs.selectExpr("doc_id", "text", "_metadata.file_path as file", "_metadata.row_index as row")
    label = {r["doc_id"]: r["label"] for r in simhash.near_copies(located).collect()}
    sets = [{tuple(r[i : i + 5]) for i in range(296)} for r in rows]
    similar = [i for i in range(1, 6) if len(sets[0] & sets[i]) >= 0.8 * len(sets[0] | sets[i])]
    assert {1, 2} <= set(similar) and 5 not in similar
    assert [i for i in range(1, 6) if label[i] == label[0]] == similar


def test_copies_unlike_one_another_find_their_original(spark, tmp_path):
    rng = np.random.default_rng(11)
    base = ["w%d" % x for x in rng.integers(10**6, size=300)]
    rows = []
    for _ in range(150):
        other, at = list(base), int(rng.integers(270))
        other[at : at + 24] = ["w%d" % x for x in rng.integers(10**6, size=24)]
        rows.append(other)
    rows.append(base)
    sets = [{tuple(r[i : i + 5]) for i in range(296)} for r in rows]
    alike = [len(s & sets[-1]) >= 0.8 * len(s | sets[-1]) for s in sets[:-1]]
    assert all(alike) and sum(len(s & sets[0]) < 0.8 * len(s | sets[0]) for s in sets[1:-1]) > 100
    docs = documents(spark, tmp_path, [(i, " ".join(r), None, None, None, None, None) for i, r in enumerate(rows)])
    located = docs.selectExpr("doc_id", "text", "_metadata.file_path as file", "_metadata.row_index as row")
    assert simhash.near_copies(located).select("label").distinct().count() == 1


def _copies(rng, n, changed, agree):
    """A base of 300 words and n copies with so many of its words changed, whose wide print agrees with the base's on a whole band, or on none."""
    base = ["w%d" % x for x in rng.integers(10**6, size=300)]

    def bands(words):
        print_ = simhash.fingerprint(np.unique(simhash.shingle_hashes(" ".join(words), simhash.WIDE_SHINGLE)), simhash.WIDE_WORDS)
        bits = np.unpackbits(np.frombuffer(print_, np.uint8))
        return bits[: len(bits) // simhash.BAND * simhash.BAND].reshape(-1, simhash.BAND)

    own, out = bands(base), []
    while len(out) < n:
        other = list(base)
        for i in rng.choice(np.arange(5, 295, 5), changed, replace=False):
            other[i] = "w%d" % rng.integers(10**6)
        if (bands(other) == own).all(axis=1).any() == agree:
            out.append(other)
    return base, out


def _near_labels(spark, tmp_path, rows):
    docs = documents(spark, tmp_path, [(i, " ".join(r), None, None, None, None, None) for i, r in enumerate(rows)])
    located = docs.selectExpr("doc_id", "text", "_metadata.file_path as file", "_metadata.row_index as row")
    return {r["doc_id"]: r["label"] for r in simhash.near_copies(located).collect()}


def test_thousands_of_copies_all_find_their_original(spark, tmp_path):
    base, copies = _copies(np.random.default_rng(17), 4000, 6, True)
    assert len(set(_near_labels(spark, tmp_path, [*copies, base]).values())) == 1


def test_copies_that_agree_on_no_band_are_found(spark, tmp_path):
    rng, rows = np.random.default_rng(19), []
    for _ in range(5):
        base, copies = _copies(rng, 1, 6, False)
        rows += [base, *copies]
    label = _near_labels(spark, tmp_path, rows)
    assert all(label[i] == label[i + 1] for i in range(0, 10, 2)) and len(set(label.values())) == 5


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(23)
    known = np.sort(rng.choice(1000, 300, replace=False)).astype(np.uint64)
    common = (known, rng.integers(2, 50, 300))
    for _ in range(300):
        x = rng.choice(1000, int(rng.integers(1, 60)), replace=False)
        y = np.r_[x[int(rng.integers(len(x) // 5 + 1)) :], rng.choice(np.arange(1000, 2000), int(rng.integers(len(x) // 5 + 1)), replace=False)]
        if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)):
            a, b = (simhash.prefix(np.unique(z).astype(np.uint64), common, 0.8) for z in (x, y))
            assert set(a.tolist()) & set(b.tolist())


def test_shards_offer_the_nearest_both_ways():
    prints = [(x).to_bytes(8, "big") for x in (0, 0b1, 0b111, 0b11111, 0b11 << 60)]
    found = set(simhash.shard_links(list(range(5)), prints, 4, nearest=1))
    assert {(0, 1, 1), (1, 0, 1), (2, 1, 2), (3, 2, 2), (4, 0, 2)} <= found and all(d <= 4 for *_, d in found)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 300), (5, 5), (300, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 101)}, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bands():
    assert simhash.bands_miss(0.8) < 0.03 and simhash.bands_miss(0.9) < 0.001
    for rows in (0, 1, 10**6, 10**8, 10**10):
        assert rows / 2 ** simhash.band_bits(rows) <= simhash.SHARD_STRANGERS and simhash.band_table(6, simhash.band_bits(rows)).shape[0] == simhash.BANDS


def test_parted_shards_lose_no_group(spark, tmp_path):
    rng = np.random.default_rng(29)
    base, copies = _copies(rng, 600, 6, True)
    other, more = _copies(rng, 300, 5, True)
    docs = documents(spark, tmp_path, [(i, " ".join(r), None, None, None, None, None) for i, r in enumerate([*copies, base, other, *more])])
    located = docs.selectExpr("doc_id", "text", "_metadata.file_path as file", "_metadata.row_index as row")
    label = {r["doc_id"]: r["label"] for r in simhash.near_copies(located, shard_rows=20).collect()}
    assert len({label[i] for i in range(601)}) == 1 and len({label[i] for i in range(601, 902)}) == 1 and len(set(label.values())) == 2


def test_pairs_that_only_share_common_shingles_are_not_checked(spark):
    """Sets of 100 shingles, of which the last 70 of the order are common to all: no two are met."""
    rows = [(v, 100, at, (v * 100 + at if at < 12 else at), v) for v in range(200) for at in range(21)]
    live = spark.createDataFrame(rows, "vertex long, size int, at int, shingle long, label long").selectExpr("*", "cast(null as long) before", "cast(null as long) earlier")
    assert simhash._rest(live, 0.8).count() == 0
    near = [(v, 100, at, (v * 100 + at if at < 11 else at), v) for v in range(3) for at in range(21)]
    assert simhash._rest(spark.createDataFrame([(*r, None, None) for r in near], live.schema), 0.8).count() == 3


def test_the_driver_settles_between_rounds(spark, tmp_path, monkeypatch):
    """The stage of the pipeline with most jobs gives the driver's memory back on its way, not at its end alone; and giving back does."""
    calls = []
    monkeypatch.setattr(simhash, "settle", lambda s: calls.append(s))
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:58], f"end{i}"]), None, None, None, None, None) for i in range(3)]
    docs = documents(spark, tmp_path, rows)
    assert simhash.near_copies(docs.select("doc_id", "text", *common.locator(docs))).select("label").distinct().count() == 1
    assert len(calls) > 5
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    jvm.java.lang.String.valueOf("x" * 10_000_000)
    before = runtime.totalMemory() - runtime.freeMemory()
    common.settle(spark)
    assert runtime.totalMemory() - runtime.freeMemory() < before - 5_000_000
