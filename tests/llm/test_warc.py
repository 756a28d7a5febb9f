import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quire.llm import warc as W

SCHEMA = "page_id long, url string, html string, path string, offset long, payload string"


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(i, u, h, "p", 1, "q") for i, u, h in rows], SCHEMA).repartition(parts)


def rows():
    big = "<p>é" + "payload " * 300
    out = [(1, "http://a/", "<html>"), (2, "http://a/", "<html>"), (3, None, None), (4, "x\r\nInjected: 1", ""), (5, "u", big), (9, "u", big), (7, "ü ", big),
           (None, "n", big), (20, "r", "y" * 1000), (20, "r", "y" * 1000), (19, "r", "y" * 1000), (30, "s", "z" * 999), (31, "s", "z" * 999),
           (40, "l", "".join(chr(97 + (i * i) % 26) for i in range(400_000))), (41, "magic", "\x1f\x08 \r\n\r\n WARC/1.1" * 200)]
    return out + [(100 + i, f"http://h/{i}", "third " * 250) for i in range(40)]


def expected(data):
    groups = {}
    for i, _, h in data:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in data:
        raw = (h or "").encode()
        keep = max((x for x in groups[h or ""] if x is not None), default=None)
        own = len(raw) < 1000 or keep is None or i == keep
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if own else "revisit", None if own else keep))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    files = W.write_archives(W.with_revisits(pages(spark, rows())), f"file://{folder}", roll_bytes=3000)
    return folder, files


@pytest.mark.parametrize("split", [37, 1000, 1 << 26])
def test_round_trip_at_any_split(spark, archives, split):
    got = W.read_archives(archives[1], split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows())
    html = {(i, u): h for i, u, h in rows()}
    for r in got:
        assert r.intact
        if r.record_type == "response" and r.page_id not in (3, 4, 7):
            assert bytes(r.payload).decode() == html[(r.page_id, r.url)]


def test_members_are_plain_gzip(archives):
    names = [f for f in os.listdir(archives[0])]
    assert len(names) > 3
    text = b"".join(gzip.open(os.path.join(archives[0], f)).read() for f in names)
    assert text.count(b"\r\nWARC-Record-ID: ") == len(rows()) and b"\r\nInjected" not in text


def test_damage_costs_only_the_records_it_touches(spark, archives, tmp_path):
    name = max(os.listdir(archives[0]), key=lambda f: os.path.getsize(os.path.join(archives[0], f)))
    data = bytearray(open(os.path.join(archives[0], name), "rb").read())
    whole = list(W.read_range(os.path.join(archives[0], name), 0, len(data)))
    k = len(data) // 2
    data[k:k + 8] = b"\x1f\x8b\x08garba"
    bad = tmp_path / "bad.warc.gz"
    bad.write_bytes(b"junk\x1f\x8b\x08junk" + bytes(data))
    got = list(W.read_range(str(bad), 0, len(data) + 11))
    assert len(whole) - 2 <= len(got) <= len(whole) and {r[3] for r in got} <= {r[3] for r in whole}


def test_empty_table(spark, tmp_path):
    files = W.write_archives(W.with_revisits(pages(spark, rows()).where("false")), f"file://{tmp_path}")
    assert files.count() == 0 and W.read_archives(files).collect() == []


def test_extra_columns_and_types(spark, archives):
    assert W.with_revisits(pages(spark, rows())).columns == ["page_id", "url", "html", "refers_to"]
    assert archives[1].select(F.sum("size")).first()[0] == sum(os.path.getsize(os.path.join(archives[0], f)) for f in os.listdir(archives[0]))


def test_foreign_headers_do_not_stop_the_reader(tmp_path):
    body = b"hello payload"
    sha = hashlib.sha1(body).hexdigest()

    def member(kind, digest, http, payload=b""):
        block = http + b"\r\n\r\n" + payload
        head = [f"WARC/1.0\r\nWARC-Type: {kind}"] + ([f"WARC-Payload-Digest: {digest}"] if digest is not None else []) + [f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    cases = [("response", f"sha1:{sha}", b"HTTP/1.1 200 OK", body), ("response", f"SHA1:{sha.upper()}", b"HTTP/1.1 200 OK", body),
             ("response", "sha1:not base32!", b"HTTP/1.1 200 OK", body), ("response", "sha256:" + "ab" * 32, b"HTTP/1.1 200 OK", body),
             ("response", None, b"HTTP/1.1 200 OK", body), ("revisit", f"sha1:{sha}", b"HTTP/1.1 200 OK\r\nno separator\r\ncontent-length:13"),
             ("revisit", "x", b"HTTP/1.1 200 OK\r\nContent-Length: many"), ("warcinfo", None, b"software: x"), ("response", f"sha1:{sha}", b"HTTP/1.1 200 OK", body)]
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(b"".join(member(*c) for c in cases))
    got = list(W.read_range(str(path), 0, path.stat().st_size))
    assert [r[2] for r in got] == [c[0] for c in cases]
    assert [r[8] for r in got] == [True, True, False, False, False, True, False, False, True]
    assert [(r[5], r[6]) for r in got[:5]] == [(13, sha)] * 5 and (got[5][5], got[5][6]) == (13, sha) and (got[6][5], got[6][6]) == (None, None)
