import json
import os

import pandas as pd
import pytest

from quire.plans.prepare import label_cases, news_corpus, prepare_cases, prepare_news
from quire.sources.readers import (read_case_json, read_flagged_corpus, read_folder_corpus, read_json_records,
                                   read_paragraph_corpus, read_tsv_corpus)
from quire.sources.sinks import write_report, write_row_files, write_tsv_corpus


def _case_files(d):
    os.makedirs(d)
    cases = [
        {"TEXT": ["p one", "p two"], "VIOLATED_ARTICLES": [], "VIOLATED_PARAGRAPHS": [], "VIOLATED_BULLETPOINTS": []},
        {"TEXT": ["x"], "VIOLATED_ARTICLES": ["3"], "VIOLATED_PARAGRAPHS": [], "VIOLATED_BULLETPOINTS": []},
        {"TEXT": ["y"], "VIOLATED_ARTICLES": ["3"], "VIOLATED_PARAGRAPHS": ["3-1"], "VIOLATED_BULLETPOINTS": []},
        {"TEXT": ["z"], "VIOLATED_ARTICLES": ["6"], "VIOLATED_PARAGRAPHS": ["6-1"], "VIOLATED_BULLETPOINTS": ["a"]},
    ]
    for i, c in enumerate(cases):
        with open(os.path.join(d, f"case{i}.json"), "w") as f:
            json.dump(c, f, indent=2)


def test_case_json_and_labels(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "train")
    _case_files(d)
    df = read_case_json(spark, d)
    assert df.count() == 4
    got = {r.file_name: r.labels for r in label_cases(df).collect()}
    assert got == {"case0.json": 0, "case1.json": 1, "case2.json": 1, "case3.json": 1}
    out = prepare_cases(spark, d, d, d, os.path.join(tmpdir_path, "out"))
    back = read_tsv_corpus(spark, out["train"])
    assert sorted(r.labels for r in back.collect()) == ["0", "1", "1", "1"]
    assert json.loads(back.filter("labels = '0'").first().text) == ["p one", "p two"]


def test_tsv_quotes_and_newlines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c.tsv")
    pd.DataFrame({"text": ['say "hi"', "line\nbreak", "tab\tinside"], "labels": [1, 0, 1]}).to_csv(p, sep="\t", index=False)
    rows = sorted((r.text, r.labels) for r in read_tsv_corpus(spark, p).collect())
    assert rows == sorted([('say "hi"', "1"), ("line\nbreak", "0"), ("tab\tinside", "1")])
    out = write_tsv_corpus(read_tsv_corpus(spark, p), tmpdir_path, "X", "train")
    assert sorted((r.text, r.labels) for r in read_tsv_corpus(spark, out).collect()) == rows


def test_folder_corpus_cp1252(spark, tmpdir_path):
    for label, name, data in [("sci", "a", b"\x93quoted\x94\r\nnext\tcol"), ("rec", "b", b"plain \x80 5"),
                              ("rec", "c", b"bad \x81 byte")]:
        os.makedirs(os.path.join(tmpdir_path, "news", label), exist_ok=True)
        with open(os.path.join(tmpdir_path, "news", label, name), "wb") as f:
            f.write(data)
    df = read_folder_corpus(spark, os.path.join(tmpdir_path, "news"))
    got = {r.path.rsplit("/", 1)[-1]: (r.label, r.text, r.decode_error) for r in df.collect()}
    assert got["a"] == ("sci", "“quoted”\nnext\tcol", False)
    assert got["b"] == ("rec", "plain € 5", False)
    assert got["c"][2] is True
    flat = {r.labels: r.text for r in news_corpus(spark, os.path.join(tmpdir_path, "news")).filter("not decode_error").collect()}
    assert flat["sci"] == "“quoted” next col"
    out = prepare_news(spark, os.path.join(tmpdir_path, "news"), os.path.join(tmpdir_path, "o"), undecodable="drop")
    assert read_tsv_corpus(spark, out).count() == 2


def test_undecodable_files_stop_or_are_flagged(spark, tmpdir_path):
    news = os.path.join(tmpdir_path, "news")
    os.makedirs(os.path.join(news, "rec"))
    for name, data in (("a", b"fine"), ("b", b"bad \x81 byte")):
        with open(os.path.join(news, "rec", name), "wb") as f:
            f.write(data)
    with pytest.raises(Exception, match="not valid Windows-1252"):
        prepare_news(spark, news, os.path.join(tmpdir_path, "x"))
    kept = prepare_news(spark, news, os.path.join(tmpdir_path, "y"), undecodable="flag")
    rows = read_tsv_corpus(spark, kept, "text string, labels string, decode_error boolean").collect()
    assert sorted(r.decode_error for r in rows) == [False, True]
    with pytest.raises(ValueError):
        prepare_news(spark, news, os.path.join(tmpdir_path, "z"), undecodable="ignore")


def test_malformed_case_file_fails(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "train")
    _case_files(d)
    with open(os.path.join(d, "case9.json"), "w") as f:
        f.write('{"TEXT": ["cut off"], "VIOLATED_ARTI')
    with pytest.raises(Exception):
        label_cases(read_case_json(spark, d)).collect()


def test_tsv_round_trip_is_exact(spark, tmpdir_path):
    texts = ["  lead and trail  ", " ", "", None, "a\tb", 'say "hi"', '"', "line\nbreak", "cr\rx", "null", '""', "\\", 'a\\"b', "\\N"]
    df = spark.createDataFrame([(t, str(i)) for i, t in enumerate(texts)], "text string, labels string")
    back = read_tsv_corpus(spark, write_tsv_corpus(df, tmpdir_path, "X", "all"))
    assert {r.labels: r.text for r in back.collect()} == {str(i): t for i, t in enumerate(texts)}


def test_json_list_and_split_corpora(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "train.json")
    with open(p, "w") as f:
        json.dump([{"text": f"t{i}", "label": i % 2, "extra": "x"} for i in range(20)], f)
    assert read_json_records(spark, p).count() == 20
    root = os.path.join(tmpdir_path, "para")
    for split in ("train", "test", "validation"):
        pd.DataFrame({"facts": [["a", "b"], ["c"]], "silver_rationales": [[0], []]}).to_parquet(
            os.path.join(tmpdir_path, f"{split}.parquet"))
        os.makedirs(os.path.join(root, split))
        os.rename(os.path.join(tmpdir_path, f"{split}.parquet"), os.path.join(root, split, "part.parquet"))
    para = read_paragraph_corpus(spark, root)
    assert sorted(r.split for r in para.select("split").distinct().collect()) == ["test", "train", "validation"]
    flagged = os.path.join(tmpdir_path, "flag")
    for split in ("train", "validation"):
        os.makedirs(os.path.join(flagged, split))
        pd.DataFrame({"text": ["a", "b"], "hyperpartisan": [True, False]}).to_parquet(
            os.path.join(flagged, split, "part.parquet"))
    fl = read_flagged_corpus(spark, flagged)
    assert sorted((r.split, r.labels) for r in fl.collect()) == [("test", 0), ("test", 1), ("train", 0), ("train", 1)]
    write_report(fl, os.path.join(tmpdir_path, "report"))


def test_small_files_share_tasks_and_part_files(spark, tmpdir_path):
    news, cases = os.path.join(tmpdir_path, "news"), os.path.join(tmpdir_path, "cases")
    rows = spark.range(120).selectExpr("id", "concat('group=', id % 2) AS folder", "concat('row ', id) AS value")
    assert write_row_files(rows, news) == 120
    told = rows.selectExpr("'train' AS folder", "to_json(struct(array(value) AS TEXT, array('3') AS VIOLATED_ARTICLES)) AS value")
    assert write_row_files(told, cases, ("train", "dev")) == 120
    # as on many files: one a task
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        folder, records = read_folder_corpus(spark, news), read_case_json(spark, f"{cases}/train")
        most = 4 * spark.sparkContext.defaultParallelism
        assert folder.rdd.getNumPartitions() <= most and records.rdd.getNumPartitions() <= most
        assert sorted(r[0] for r in folder.select("text").collect()) == sorted(f"row {i}\n" for i in range(120))
        out = prepare_news(spark, news, os.path.join(tmpdir_path, "out"))
        assert len([f for f in os.listdir(out) if f.startswith("part-")]) <= most
        out = prepare_cases(spark, f"{cases}/train", f"{cases}/dev", f"{cases}/dev", os.path.join(tmpdir_path, "out"))
        assert read_tsv_corpus(spark, out["train"]).where("labels = '1'").count() == 120 and read_tsv_corpus(spark, out["dev"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_files_are_whole_and_replaced_when_written_again(spark, tmpdir_path):
    rows = spark.createDataFrame([("a", "one\ntwo"), ("a", ""), ("b", "three \u20ac")], "folder string, value string").coalesce(1)
    for _ in range(2):
        assert write_row_files(rows, f"file:{tmpdir_path}/raw", ("c",)) == 3
    found = {f: sorted(open(os.path.join(tmpdir_path, "raw", f, n), "rb").read() for n in os.listdir(os.path.join(tmpdir_path, "raw", f))) for f in "abc"}
    assert found == {"a": [b"\n", b"one\ntwo\n"], "b": ["three \u20ac\n".encode()], "c": []}
    assert write_row_files(rows.limit(0), f"{tmpdir_path}/none", ("a",)) == 0 and os.listdir(f"{tmpdir_path}/none") == ["a"]
