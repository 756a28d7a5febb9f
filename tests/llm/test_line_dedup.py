import re

import pytest

from quire.llm import line_dedup as L

SCHEMA = "doc_id long, text string, row string, start int, digest string, words int"
PASSAGE = "this passage of quite a few words is found again in other texts of the table"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "r", 1, None, 2) for i, t in rows], SCHEMA).repartition(parts)


def brute(rows, min_words=1):
    """All units in rank order; the first of each normalised text stays, spans inside removed lines go."""
    def words(s):
        return s.lower().split()

    units = []
    for k, (i, text) in enumerate(rows):
        at = 0
        for line in (text or "").split("\n"):
            units.append((i, k, at, at, at + len(line), line))
            ends = [m.end() for m in re.finditer(r"[.!?]+(?=[ \t])", line)]
            parts = [(a, b) for a, b in zip([0, *ends], [*ends, len(line)]) if line[a:b].strip()]
            if len(parts) > 1:
                for a, b in parts:
                    part = line[a:b]
                    lead = len(part) - len(part.lstrip())
                    units.append((i, k, at, at + a + lead, at + a + len(part.rstrip()), part))
            at += len(line) + 1
    units = [u for u in units if len(words(u[5])) >= min_words]
    units.sort(key=lambda u: (u[0] is None, u[0] or 0, u[1], u[3], -u[4]))
    seen, out = set(), []
    for i, k, line, a, b, s in units:
        key = " ".join(words(s))
        if key in seen:
            out.append((i, k, line, a, b))
        seen.add(key)
    whole = {(k, line): b for _, k, line, a, b in out if a == line}
    return sorted((str(i), a, b) for i, k, line, a, b in out if not (whole.get((k, line), -1) >= b and (a, b) != (line, whole[(k, line)])))


def sample():
    rows = [(5, f"Intro line.\n{PASSAGE}\nEnd of it."), (3, f"{PASSAGE.upper()}"), (9, f"Before it all. {PASSAGE}. After it all"),
            (7, f"Some own words first. This   passage of QUITE a few words is found again in other texts of the table. And own ones."),
            (None, PASSAGE), (8, None), (10, ""), (11, "short line\nshort line\n"), (12, f"{PASSAGE}\nx\n{PASSAGE}"),
            (13, "  \n\t" + PASSAGE + "  \nÄÖ ü ß é à ê î ç Ñ one two three.  "), (14, "ÄÖ ü ß é à ê î ç Ñ one two three."),
            (15, "A b c d e f g h i. J k l m n o p q r. S t u v w x y z a."), (16, "J k l m n o p q r. Other words come here now and then again. A b c d e f g h i.")]
    return rows + [(20 + i, f"Own start {i}.\n" + "the very common line that a third of all documents hold\n" * (1 + i % 3)) for i in range(30)]


def test_repeats_match_brute_force(spark):
    rows = sample()
    got = L.repeats(L.units(frame(spark, rows))).collect()
    assert sorted((str(r.id), r.start, r.stop) for r in got) == brute(rows)
    texts = dict(rows)
    for r in got:
        first = texts[r["first"].id][r["first"].start:-r["first"].end]
        assert first.lower().split() == texts[r.id][r.start:r.stop].lower().split() and len(first.split()) == r.words


def test_repeated_rows_keep_one(spark):
    got = L.repeats(L.units(frame(spark, [(4, PASSAGE)] * 6))).collect()
    assert [(r.id, r.start, r.stop) for r in got] == [(4, 0, len(PASSAGE))] * 5


def test_remove_repeats(spark):
    rows = sample()
    out = L.remove_repeats(frame(spark, rows))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    got = {r.doc_id: r.text for r in out.collect()}
    for i, text in rows:
        want = text
        for _, a, b in sorted((x for x in brute(rows) if x[0] == str(i)), reverse=True):
            want = want[:a] + want[b:]
        assert got[i] == want


def test_empty_and_long(spark):
    assert L.repeats(L.units(frame(spark, [(1, "x")]).where("false"))).collect() == []
    long = "\n".join(f"line number {i % 5000} of a very long text with words" for i in range(20_000))
    assert len(L.repeats(L.units(frame(spark, [(1, long)]))).collect()) == 15_000


def test_query_finds_short_lines(spark, tmpdir_path):
    """Lines of any length, in scripts with and without spaces; list numbers inside a line stay."""
    rows = [(1, "Released under the MIT License.\n\n \nown text\n\u8fd9\u662f\u4e00\u884c\u91cd\u590d\u7684\u6587\u5b57"),
            (2, "first\nreleased under  the mit license.\n\nx"), (3, "\u8fd9\u662f\u4e00\u884c\u91cd\u590d\u7684\u6587\u5b57\nX"),
            (4, "1. Take it home. And now"), (5, "1. Other things. Take it home.  Then")]
    frame(spark, rows).write.parquet(f"{tmpdir_path}/documents.parquet")
    got = {(r.doc_id, r.start, r.end) for r in L.q_line_dedup(spark, tmpdir_path).collect()}
    assert got == {(2, 6, 38), (3, 0, 9), (3, 10, 11), (5, 17, 30)}


def test_query_leaves_out_no_line(spark):
    sf = "/root/testdata/sf0.001"
    seen, want = set(), set()
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        at = 0
        for line in r.text.split("\n"):
            key = " ".join(line.lower().split())
            want |= {(r.doc_id, at, at + len(line))} if key in seen else set()
            seen |= {key} if key else set()
            at += len(line) + 1
    got = {(r.doc_id, r.start, r.end) for r in L.q_line_dedup(spark, sf).collect()}
    assert want and want <= got
