import csv
import io
import json
import random

import pyarrow as pa
import pytest

from quire.sources import ranges as R
from quire.sources.readers import read_json_records, read_tsv_corpus
from quire.sources.sinks import write_tsv_corpus

SIZES = [1, 2, 3, 5, 8, 13, 64, 1000, 10 ** 6]


def cut(size, step):
    return [(a, min(a + step, size)) for a in range(0, size, step)]


def table_in_ranges(data, step):
    file, opened, out = pa.BufferReader(data), 0, []
    for a, b in cut(len(data), step):
        out += R.table_records(file, a, b, bool(opened))
        opened ^= R.quote_parity(file, a, b)
    return out


def json_in_ranges(data, step):
    file, opened, depth, out = pa.BufferReader(data), 0, 0, []
    base = int(data.lstrip()[:1] == b"[")
    for a, b in cut(len(data), step):
        out += R.json_records(file, a, b, bool(opened), depth, base)
        flips, outside, inside, _ = R.json_effect(file, a, b)
        depth += inside if opened else outside
        opened ^= flips
    assert not opened and not depth
    return [json.loads(x) for x in out]


def odd_rows(seed, n=40):
    rnd = random.Random(seed)
    alphabet = ['"', "\n", "\t", "a", "é", "漢", " ", "\\", "\r", "{", "]", ",", "''"]
    return [["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 12))) for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 4, R.CHUNK])
@pytest.mark.parametrize("seed", range(4))
def test_table_ranges_give_the_same_records(monkeypatch, chunk, seed):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = odd_rows(seed, 12)
    out = io.StringIO()
    csv.writer(out, delimiter="\t", lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    for text in (out.getvalue(), out.getvalue().rstrip("\n")):
        for step in SIZES:
            assert [R.fields(r) for r in table_in_ranges(text.encode(), step)] == rows


def test_fields():
    assert R.fields(b'a\t"b ""c"" \t d"\t\t""\t') == ["a", 'b "c" \t d', None, "", None]
    assert R.fields(b"x") == ["x"] and R.fields(b'""') == [""] and R.fields(b"\t") == [None, None]
    with pytest.raises(ValueError):
        R.fields(b'"a"b\tc')


@pytest.mark.parametrize("chunk", [1, 3, R.CHUNK])
@pytest.mark.parametrize("seed", range(4))
def test_json_ranges_give_the_same_records(monkeypatch, chunk, seed):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = [{"a": a, "b": {"c": [b, {"d": c}], "e\\": "\\\\"}, "n": i} for i, (a, b, c) in enumerate(odd_rows(seed, 8))]
    lines = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    for text in (json.dumps(rows), " \n" + json.dumps(rows, indent=1, ensure_ascii=False) + "\n", lines, "[]", "[\n]\n" + json.dumps(rows)):
        for step in SIZES:
            assert json_in_ranges(text.encode(), step) == ([] if text == "[]" else rows)


@pytest.mark.parametrize("split_bytes", [7, 100, 10 ** 6])
def test_readers_at_any_split_size(spark, tmpdir_path, split_bytes):
    rows = [(str(i), a, b) for i, (a, b, _) in enumerate(odd_rows(9, 30))] + [("x", None, ""), ("y", "", None)]
    df = spark.createDataFrame(rows, "k string, text string, labels string")
    path = write_tsv_corpus(df.repartition(2), tmpdir_path, "t", "all")
    back = read_tsv_corpus(spark, path, "k string, text string, labels string", split_bytes)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
    records = [{"k": i, "text": a, "deep": {"l": [b, c]}} for i, (a, b, c) in enumerate(odd_rows(8, 30))]
    with open(f"{tmpdir_path}/r.json", "w") as f:
        json.dump(records, f, indent=1)
    read = read_json_records(spark, f"{tmpdir_path}/r.json", split_bytes=split_bytes)
    assert sorted((r.k, r.text, r.deep.l) for r in read.collect()) == [(r["k"], r["text"], r["deep"]["l"]) for r in records]
    read = read_json_records(spark, f"{tmpdir_path}/r.json", "k long, text string", split_bytes)
    assert sorted(map(tuple, read.collect())) == [(r["k"], r["text"]) for r in records]


def test_unbalanced_files_fail(spark, tmpdir_path):
    for name, text in (("a.json", '[{"a": 1}, {"a": '), ("b.tsv", 'text\tlabels\n"open\t1\n')):
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="ends inside"):
        read_json_records(spark, f"{tmpdir_path}/a.json", "a long").collect()
    with pytest.raises(Exception, match="ends inside"):
        read_tsv_corpus(spark, f"{tmpdir_path}/b.tsv").collect()
