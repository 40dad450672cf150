import gzip
import hashlib
import re
import time

import pytest

from lodestar.llm import warc

from .helpers import key, rows_of, table

PAGES = [
    (1, "http://a/%41\n", "<p>one</p>", 1),
    (2, None, "<p>one</p>", 1),
    (3, "http://c", None, 1),
    (4, "http://d", "", 1),
    (None, "http://e", "<p>one</p>", 1),
    (None, "http://f", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f", None),
    (5, "http://g", "é" * 100_000, 1),
    (6, "http://h", "twice", 1),
    (6, "http://h", "twice", 1),
]
SCHEMA = "page_id long, url string, html string, sha int"


def brute(rows):
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, u, h, _ in rows:
        data, f = (h or "").encode(), first.get(h or "")
        again = p != f
        out.append((p, len(data), warc.base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None, u))
    return sorted(out, key=key)


@pytest.mark.parametrize("rows", [PAGES, []])
def test_round_trip(spark, tmp_path, rows):
    table(spark, tmp_path, "pages", rows, SCHEMA)
    assert rows_of(warc.op2_warc(spark, str(tmp_path))) == brute(rows)


def test_whole_table_and_payloads(spark, tmp_path, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.write_archives(pages, str(tmp_path / "w"))
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, str(tmp_path / "w")).collect() if r["payload"] is not None}
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert all(html[p] == t for p, t in back.items()) and len(set(html.values())) == len(back)
    part = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    assert gzip.decompress(part.read_bytes()).startswith(b"WARC/1.1\r\n")  # any reader of gzip members can read it


def some(n=5):
    return [warc.record(i, f"http://x/{i}", b"payload %d " % i * 50, None, False) for i in range(n)]


@pytest.mark.parametrize("pack", [bytes, warc.member])
def test_salvage(pack):
    parts = [pack(r) for r in some()]
    whole = b"".join(parts)
    records, gaps = warc.salvage(whole)
    assert [r.page_id for r in records] == list(range(5)) and not gaps
    damaged = bytearray(whole)
    damaged[len(parts[0]) + len(parts[1]) // 2] ^= 0xFF  # within the second record
    records, gaps = warc.salvage(bytes(damaged))
    assert [r.page_id for r in records] == [0, 2, 3, 4] and gaps == [(len(parts[0]), len(parts[1]))]
    records, gaps = warc.salvage(b"junk" + whole[:-9])
    # of the last member only the checksum is lost; its record passes its own checks
    assert [r.page_id for r in records] == ([0, 1, 2, 3] if pack is bytes else [0, 1, 2, 3, 4])
    assert gaps == [(0, 4), (4 + sum(map(len, parts[:4])), len(parts[4]) - 9)]
    assert warc.salvage(b"") == ([], []) and warc.salvage(b"\x1f\x8b\x08\0") == ([], [(0, 4)])


def test_salvage_of_lying_lengths_and_torn_heads():
    good = some(3)
    lying = re.sub(rb"(Content-Length: )\d", rb"\g<1>9", good[1], count=1)
    assert lying != good[1]
    records, gaps = warc.salvage(good[0] + lying + good[2])
    assert [r.page_id for r in records] == [0, 2] and len(gaps) == 1
    records, gaps = warc.salvage(good[0] + good[1][:40] + warc.member(good[2]))
    assert [r.page_id for r in records] == [0, 2] and gaps == [(len(good[0]), 40)]


def test_a_stream_in_one_member_that_breaks():
    good = [warc.record(i, f"http://x/{i}", bytes(str(i * 7919 + k % 89), "ascii") * 400, None, False) for k, i in enumerate(range(40))]
    whole = warc.member(b"".join(good))
    for torn in (whole[: len(whole) // 2], whole[: len(whole) // 2] + b"\xff" * 40 + whole[len(whole) // 2 + 40 :], whole[:-8] + b"\0" * 8):
        records, gaps = warc.salvage(torn + warc.member(some()[3]))
        ids = [r.page_id for r in records]
        assert ids[:-1] == list(range(len(ids) - 1)) and len(ids) > 10 and ids[-1] == 3 and gaps[0] == (0, len(torn)) and len(gaps) == 1


def test_work_is_linear_in_torn_heads():
    tail = b"x" * (2 << 20)

    def took(n):
        began = time.perf_counter()
        records, gaps = warc.salvage(b"WARC/1.1\r\nWARC-Type: response\r\n" * n + tail + b"\r\n\r\n" + some(1)[0])
        assert [r.page_id for r in records] == [0] and len(gaps) == 1
        return time.perf_counter() - began

    took(100)
    assert took(40_000) < 2 and took(4000) < 0.5


def test_read_logs_gaps(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0.gz").write_bytes(warc.member(some()[0])[:-40] + warc.member(some()[1]))
    rows = warc.read_archives(spark, str(tmp_path / "a")).orderBy("offset").collect()
    assert [(r["kind"], r["page_id"]) for r in rows] == [("gap", None), ("response", 1)]
    (tmp_path / "a" / "part-0.gz").write_bytes(warc.member(some()[0])[:-3] + warc.member(some()[1]))
    rows = warc.read_archives(spark, str(tmp_path / "a")).orderBy("offset", "kind").collect()
    assert [(r["kind"], r["page_id"]) for r in rows] == [("gap", None), ("response", 0), ("response", 1)]


def foreign(kind, block, *more):
    head = [f"warc-type:{kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length:  {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers():
    http, hexadecimal = "Content-Type: application/http; msgtype=response", hashlib.sha1(b"body").hexdigest()
    parts = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\nbody", http, f"WARC-Payload-Digest: sha1:{hexadecimal}", "X-Folded: a\r\n b"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n", http, f"WARC-Payload-Digest: sha1:{hexadecimal}"),
        foreign("response", b"dns", "Content-Type: text/dns"),
        foreign("resource", b"", "WARC-Block-Digest: md5:00"),
        foreign("revisit", b"", http),
    ]
    for whole in (b"".join(parts), b"".join(map(warc.member, parts)), warc.member(b"".join(parts))):
        records, gaps = warc.salvage(whole)
        assert not gaps and [r.kind for r in records] == ["warcinfo", "request", "response", "response", "response", "resource", "revisit"]
        assert records[2].payload == b"body" and records[4].payload == b"dns" and records[5].payload == b"" and records[6].payload is None
    broken = [
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\nother", http, f"WARC-Payload-Digest: sha1:{hexadecimal}"),
        foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody", http),
        foreign("resource", b"x", f"WARC-Block-Digest: sha1:{hexadecimal}"),
        foreign("resource", b"x").replace(b"Content-Length:  1", b"Content-Length: -1"),
        foreign("resource", b"x").replace(b"Content-Length:  1", "Content-Length: ²".encode()),
        foreign("", b"x"),
    ]
    for b in broken:
        records, gaps = warc.salvage(parts[0] + b + parts[2])
        assert [r.kind for r in records] == ["warcinfo", "response"] and gaps == [(len(parts[0]), len(b))]


def test_a_broken_record_within_a_sound_member():
    good = some(3)
    torn = warc.member(good[0] + good[1].replace(b"payload", b"paylaod", 1) + good[2])
    records, gaps = warc.salvage(torn + warc.member(some(5)[4]))
    assert [r.page_id for r in records] == [0, 2, 4] and gaps == [(0, len(torn))]
    assert warc.salvage(warc.member(b"junk"))[1] == [(0, len(warc.member(b"junk")))]
    assert warc.salvage(warc.member(b"") + good[0])[1] == []
