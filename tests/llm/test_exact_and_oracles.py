import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import queries
from lodestar.llm.common import clear_scratch, cut, scope, shared_dir
from lodestar.llm.exact_dedup import StreamingDedup, exact_dedup, sha256

from .helpers import DOCUMENTS, documents, rows_of, table


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for r, t in zip(rows, norm):
        groups.setdefault(t, []).append(r[0])
    out, stays = [], set()
    for r, t in zip(rows, norm):
        ids = [i for i in groups[t] if i is not None]
        keep = min(ids) if ids else None
        first = r[0] == keep and t not in stays
        if first:
            stays.add(t)
        out.append((r[0], keep, len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("rows", [DOCUMENTS, []])
def test_exact_dedup(spark, tmp_path, rows):
    got = rows_of(exact_dedup(documents(spark, tmp_path, rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = brute(rows)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))]
    assert sum(g[3] for g in got) == len({w[4] for w in want})


def test_colliding_digests_are_split_by_bytes(spark, tmp_path):
    weak = lambda c: F.unhex(F.hex(F.length(c) % 2))
    docs = documents(spark, tmp_path)
    got, strong = exact_dedup(docs, weak), exact_dedup(docs)
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(got, *cols) == rows_of(strong, *cols)


def test_later_arrivals_are_checked_against_the_first_by_their_bytes(spark, tmp_path):
    """Digests that collide only between arrivals: the bytes of earlier ones are found by their locators."""
    parts = [[(9, "ab", 0), (4, "x  y", 0)], [(2, "ab", 0), (3, "cd", 0), (None, "x\ny", 0)], [(1, "cd", 0), (7, "q", 0)]]
    whole = [r for p in parts for r in p]
    for digest in (sha256, lambda c: F.unhex(F.hex(F.length(c) % 2))):
        store = StreamingDedup(spark, str(tmp_path / ("weak" if digest is not sha256 else "strong")), digest)
        for i, rows in enumerate(parts):
            store.ingest(table(spark, tmp_path, f"arrival{i}", rows, "doc_id long, text string, _metadata int"))
            seen = [r for p in parts[: i + 1] for r in p]
            got = rows_of(store.assigned(), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
            assert got == sorted(brute(seen), key=lambda r: tuple((x is not None, str(x)) for x in r))
        assert store.collided().isEmpty() == (digest is sha256)
        assert rows_of(store.groups().select("least.doc_id", "size")) == [(1, 2), (2, 2), (4, 2), (7, 1)]
    again = StreamingDedup(spark, str(tmp_path / "strong"), sha256, store.sources)
    assert again.groups().count() == 4 and len(whole) == again.assigned().count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, oracle_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{oracle_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    got = queries.QUERIES[name](spark, oracle_dir)
    assert sorted(got.columns) == names
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want


def _exists(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def test_scratch_goes(spark):
    with scope(spark) as outer:
        with scope(spark) as keep:
            one, two = cut(spark.range(3), "one"), cut(spark.range(4), "two")
            keep(one)
        assert _exists(spark, one._scratch) and not _exists(spark, two._scratch)
        three = cut(spark.range(5), "three")
        outer(three)
    assert not _exists(spark, one._scratch) and three.count() == 5
    clear_scratch(spark)
    assert not _exists(spark, three._scratch)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
