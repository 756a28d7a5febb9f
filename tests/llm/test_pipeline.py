import collections
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline as C
from quire.llm import exact_dedup, mixing, quality_ledger
from quire.llm import shingles as S
from quire.session import cut_lineage, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], table(spark, SF, "documents")
    for name, f in C.STAGES:
        docs = cut_lineage(f(spark, docs, SF))
        out.append([r.asDict() for r in docs.collect()])
    return [[r.asDict() for r in table(spark, SF, "documents").collect()], *out]


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_columns_stay(stages):
    for rows in stages[1:5]:
        assert list(rows[0]) == list(stages[0][0]) and all(r in stages[0] for r in rows)


def good(text):
    w = words(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for k in range(3)}
    chars = sum(map(len, w))
    return not (len(w) < 50 or 100 * len(covered) > 50 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", text)) > len(w)
                or chars < 2 * len(w) or chars > 15 * len(w) or 2 * sum(c.isupper() for c in text) > chars)


def test_quality_stage(stages):
    assert ids(stages[1]) == ids(r for r in stages[0] if good(r["text"]))


def test_exact_stage(stages):
    first = {}
    for r in sorted(stages[1], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r["doc_id"])
    assert ids(stages[2]) == sorted(first.values())


def test_near_stage(stages):
    rows = sorted(stages[2], key=lambda r: r["doc_id"])
    at, elem, count = S.shingles([r["text"].encode() for r in rows])
    cut = np.searchsorted(at, np.arange(len(rows) + 1))
    count = S.weights(count)
    part = [(elem[a:b], count[a:b]) for a, b in zip(cut, cut[1:])]
    top = list(range(len(rows)))

    def find(i):
        return i if top[i] == i else find(top[i])

    for i in range(len(rows)):
        for j in range(i):
            if S.probability_jaccard(*part[i], *part[j]) >= 0.8 - 1e-9:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    assert ids(stages[3]) == sorted(rows[i]["doc_id"] for i in range(len(rows)) if find(i) == i)


def test_mix_stage(stages):
    size, taken, weight = collections.Counter(), collections.Counter(), {}
    for k, s in enumerate(sorted({r["source"] for r in stages[3]})):
        weight[s] = (5, 2, 1)[k % 3]
    for r in stages[3]:
        size[r["source"]] += len(words(r["text"]))
    for r in stages[4]:
        taken[r["source"]] += len(words(r["text"]))
    capped = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in size if s not in capped)
        target = {s: 3 * size[s] if s in capped else weight[s] * left / free for s in size}
        over = {s for s in size if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    longest = max(len(words(r["text"])) for r in stages[3])
    assert all(abs(taken[s] - target[s]) <= longest for s in size)
    assert max(collections.Counter(ids(stages[4])).values()) <= 3 and set(ids(stages[4])) <= set(ids(stages[3]))


def test_pack_stage(stages):
    tokens = collections.Counter()
    for p in stages[5]:
        tokens[p["doc_id"]] += p["length"]
    per_doc = {p["doc_id"]: p["doc_tokens"] for p in stages[5]}
    assert tokens == {i: n * per_doc[i] for i, n in collections.Counter(ids(stages[4])).items()}
    fill = collections.Counter()
    for p in stages[5]:
        fill[p["sequence_id"]] += p["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values()) and max(fill.values()) <= 2048


def test_run_gives_the_stages_rows(spark, stages):
    got = collections.Counter(r.doc_id for r in C.run(spark, SF).select("doc_id", "start").distinct().collect())
    assert set(got) == {p["doc_id"] for p in stages[5]}


ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, run string, row string, size int, label int, copies int, word string"


def odd(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, prose), (5, prose), (5, prose), (5, "  " + prose.replace(" ", "\n")), (6, prose + " more"),
            (7, " ".join(f"w{i}" for i in range(60_000))), (8, "same words " * 400), (9, " ".join(f"x{i}" for i in range(60)))]
    return spark.createDataFrame([(i, t, None, [None, "a", "é"][k % 3], None, "x", None, "y", 1, None, 2, "z") for k, (i, t) in enumerate(rows)], ODD).repartition(3)


def test_odd_rows_go_through_every_stage(spark):
    docs = odd(spark)
    for name, f in C.STAGES[:-1]:
        docs = cut_lineage(f(spark, docs, SF))
        assert docs.columns == odd(spark).columns
    assert {r.doc_id for r in docs.collect()} <= {5, 6, 7, 9}
    assert C.STAGES[-1][1](spark, docs, SF).count() > 0


def test_empty_tables_go_through_every_stage(spark):
    docs = odd(spark).where("false")
    for name, f in C.STAGES:
        docs = cut_lineage(f(spark, docs, SF))
    assert docs.collect() == []


def test_exact_groups_on_odd_rows(spark):
    got = exact_dedup.exact_groups(odd(spark), fan_in=2).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sha].append(r)
    prose = hashlib.sha256(" ".join(f"word{i}" for i in range(80)).encode()).hexdigest()
    assert sorted((str(r.id), r.keep_id, r.group_size) for r in by[prose]) == [("5", 5, 3), ("5", 5, 3), ("None", 5, 3)]
    assert all(sum(r.kept for r in rows) == 1 for rows in by.values())
    assert sorted(str(r.doc_id) for r in exact_dedup.drop_copies(odd(spark)).collect()).count("5") == 2  # the prose and its spaced form
    assert exact_dedup.exact_groups(odd(spark).where("false")).collect() == []


def test_merge_tree_needs_no_particular_fan_in(spark):
    rows = [(i, f"text {i % 37}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    for fan_in in (2, 5, 16):
        got = exact_dedup.exact_groups(df, fan_in=fan_in).collect()
        assert {(r.id, r.keep_id) for r in got} == {(i, i % 37) for i, _ in rows} and sum(r.kept for r in got) == 37


def test_ledger_on_odd_rows(spark):
    led = quality_ledger.ledger(odd(spark))
    got = {r.id: r for r in led.collect() if r.id in (1, 2, 3, 8)}
    assert all(got[i].n_words == 0 and got[i].fail_bits == quality_ledger.BIT["few_words"] for i in (1, 2, 3))
    assert got[8].n_repeat_words == 800
    rows = quality_ledger.ablations(led).collect()
    bits = [r.fail_bits for r in led.collect()]
    for r in rows:
        mask, bit = quality_ledger.POLICIES[r.policy], quality_ledger.BIT[r.rule]
        assert r.documents == len(bits) and r.rejected == sum(b & mask != 0 for b in bits)
        assert r.rejected_without == sum(b & mask & ~bit != 0 for b in bits) and r.only_by_rule == sum(b & mask == bit for b in bits)


def test_repeat_words_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), size=rng.integers(0, 60))) for _ in range(300)]
    got = {r.id: r.n_repeat_words for r in quality_ledger.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        assert got[i] == len({j + k for j, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for k in range(3)})


def test_mix_on_odd_rows(spark):
    got = mixing.mix_sizes(odd(spark)).collect()
    assert len(got) == 11 and all(r.taken == r.copies * r.size and r.copies <= 3 for r in got)
    assert {r.source for r in got} == {None, "a", "é"}
    assert mixing.mix_sizes(odd(spark).where("false")).collect() == []
    assert {r.target for r in mixing.mix_sizes(odd(spark).where("doc_id < 4")).collect()} == {0.0}
