import functools
import hashlib
import itertools
import re

import numpy as np
import pytest

from quire.llm import pii as P

SCHEMA = "doc_id long, text string, spans string, n_email int, base string"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None,
                    "card": 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_base_spans_match_the_patterns():
    rng = np.random.default_rng(0)
    odd = ["a@b@c.d e.f", "x@a.b.", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 001.02.3.4", "+1 (578) 555-6437 4918187128635271", "+1 (826) 555-4081 190.137.2.1",
           "4111 1111 1111 1111-4111", "ü@b.c \U0001f600 k@b-c.de", "+1+2 345 678 9012 3", "1" * 50, "a" * 5000 + "@", "a.b@c.d.e@f.g"]
    odd += ["".join(rng.choice(list("a1@.+- ()5é2\n9"), size=rng.integers(1, 60))) for _ in range(20_000)]
    assert [t for t in odd if P.base_spans(t) != brute(t)] == []


@functools.cache
def sample():
    rng = np.random.default_rng(1)
    words = lambda: " ".join(rng.choice("the and of to in that reads paper see la que und".split(), size=4))
    out = []
    for i in range(480):
        d = "".join(map(str, rng.integers(0, 10, size=15)))
        card = next(d + c for c in "0123456789" if P.luhn(d + c))
        span = [f"{words()[:3]}k.{i}@mail{i % 7}.example.com", f"{i % 256}.2.{i % 99}.7", card, f"+1 ({200 + i}) 555-{1000 + i}"][i % 4]
        left = words() + " "
        out.append((f"{left}{span} {words()}", [s for s in brute(f"{left}{span} {words()}")]))
    return [(z, s) for z, s in out if s]


@functools.cache
def weights():
    return P.fit(sample()[:260])


def test_held_out_accuracy():
    """Rewritten spans beside harmless numbers, in zones that were not trained on."""
    rng = np.random.default_rng(9)
    want = got = both = 0
    for zone, spans in sample()[260:]:
        text, gold = P.examples(zone, spans, rng)
        told = set(P.decode(text, [], weights()))
        want, got, both = want + len(gold), got + len(told), both + len(told & set(gold))
    assert want > 150 and both / want >= 0.85 and both / got >= 0.95, (want, got, both)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    zone, gold = P.examples("see +1 (212) 555-0100 or 10.2.3.4 now", brute("see +1 (212) 555-0100 or 10.2.3.4 now"), rng)
    ends, found = P.segments(zone)
    place = {(ends[i], ends[j]): k for k, (i, j, _) in enumerate(found)}
    hits = np.zeros((len(found), 4))
    for a, kind, b in gold:
        hits[place[a, b], kind] = 1
    x, spans = P.matrix(found), [(i, j) for i, j, _ in found]
    w = rng.normal(size=(4, P.N_FEATURES)) * 0.3
    value, gradient = P.likelihood_step(x, spans, len(ends), hits, w)
    assert value < 0
    for k, f in [(0, 0), (3, 0), (1, found[0][2][1]), (3, found[-1][2][-1]), *itertools.product(range(4), range(P.N_OWN, P.N_FEATURES))]:
        moved = w.copy()
        moved[k, f] += 1e-6
        assert abs((P.likelihood_step(x, spans, len(ends), hits, moved)[0] - value) / 1e-6 - gradient[k, f]) < 1e-3


def test_likelihood_sums_all_segmentations():
    zone = "a 1234567 9876543"
    ends, found = P.segments(zone)
    w = np.random.default_rng(5).normal(size=(4, P.N_FEATURES)) * 0.2

    @functools.cache
    def total(j, state):  # every segmentation of the tokens before j whose last entity is of the state
        if j == 0:
            return float(state == 0)
        into = sum(total(i, s) * np.exp(w[state - 1, [*f, P.N_OWN + s]].sum()) for i, e, f in found if e == j for s in range(5)) if state else 0.0
        return total(j - 1, state) + into

    none = np.zeros((len(found), 4))
    value, _ = P.likelihood_step(P.matrix(found), [(i, j) for i, j, _ in found], len(ends), none, w)
    assert abs(value + np.log(sum(total(len(ends) - 1, s) for s in range(5)))) < 1e-9


def test_held_out_forms_are_found_and_harmless_numbers_left():
    found = {"call (578) 555-6437 now": ["phone"], "ring 578-555-6437 today": ["phone"],
             "pay 4918.1871.2863.5271 with": ["card"], "at 10 . 2 . 33 . 254 there": ["ip"], "the kf.71 [at] mail0.example.com end": ["email"]}
    for text, kinds in found.items():
        assert [P.KINDS[k] for _, k, _ in P.added_spans(text, P.base_spans(text), weights())] == kinds, text
    for text in ["on 2024-05-16 we", "Version 2.0.", "1,234,567 people", "page 123 of 456", "at 12:30:59 then", "CC BY-NC 4.0.", "in 1979-2004 he"]:
        assert P.added_spans(text, [], weights()) == [], text


def test_base_spans_stay_fixed():
    text = "a x.1@mail.example.com b +1 (826) 555-4081 190.137.2.1 c 4111111111111111 d (578) 555-6437"
    base = P.base_spans(text)
    added = P.added_spans(text, base, weights())
    assert added and all(b <= s or e <= a for a, _, b in added for s, _, e in base)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "s", 1, None) for i, t in rows], SCHEMA).repartition(parts)


def test_frames(spark):
    long = "x " * 50_000 + "me@there.example.com " + "1 " * 20_000 + "é 10.0.0.1"
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (4, "a@b.cd"), (4, "a@b.cd"), (5, long), (6, "no data")] + [(10 + i, z) for i, (z, _) in enumerate(sample())]
    got = P.scan(frame(spark, rows)).collect()
    assert sorted(((r.id, hashlib.sha256(r.base.encode()).hexdigest()) for r in got), key=str) == sorted(((i, digest(brute(t))) for i, t in rows), key=str)
    for r in got:
        assert set(r.base.split(",")) <= set(r.spans.split(",")) or not r.base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in r.base.split(",")) for k in P.KINDS]
    assert P.scan(frame(spark, rows).where("false")).collect() == []
    assert {r.spans for r in P.scan(frame(spark, [(1, "no data"), (2, "none 12")])).collect()} == {""}


def test_bounded_sample_is_the_smallest_by_hash(spark):
    from quire.llm.sample import smallest

    df = spark.range(5000).selectExpr("id", "xxhash64(id) AS h")
    want = [r.id for r in df.orderBy("h").limit(50).collect()]
    assert [r.id for r in smallest(df, 50).collect()] == want
    assert len(smallest(df.limit(30), 50).collect()) == 30


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: digest(brute(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.q_pii(spark, sf).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == want
    assert got == P.q_pii(spark, sf).collect()


@pytest.mark.parametrize("at, dot", [("(at)", "(dot)"), (" [at] ", " [dot] "), (" [at] ", "."), (" at ", " dot "), (" @ ", "."), ("@", "(dot)")])
def test_long_written_out_addresses(at, dot):
    """Local parts and hosts of up to 60 characters, whole and nothing beside them."""
    for local in ("user", "x" * 30, "ann.maria" + "bc" * 25, "kf.71", "a" * 60):
        for host in (("department", "university", "edu"), ("mail", "h" * 25, "org"), ("long-" * 5 + "name", "institute" * 2, "ac", "uk"), ("example", "com")):
            span = local + at + dot.join(host)
            for text in (f"the {span} end of it", span, f"so we reach her under {span}"):
                a = text.index(span)
                assert P.added_spans(text, P.base_spans(text), weights()) == [(a, 0, a + len(span))], text


def test_speech_about_dots_is_no_address():
    for text in ("we look at the dot product of both", "he stood at this dot of land", "at noon we met (dot) and", "look at example.com now", "a dot com firm at work"):
        assert P.added_spans(text, [], weights()) == [], text


def test_long_lists_lose_nothing():
    """Every number of a list of many zones' length, as in a short list."""
    rows = [f"({200 + i % 700}) 555-{1000 + i}" for i in range(2_000)]
    text = "\n".join(rows)
    starts = np.cumsum([0, *(len(r) + 1 for r in rows)])
    assert list(P.zones(text)) == [(0, len(text))]
    assert [(a, b) for a, _, b in P.added_spans(text, [], weights())] == [(a, a + len(r)) for a, r in zip(starts, rows)]


def test_search_is_the_best_segmentation():
    """Carried search with states against one over all boundaries and all previous kinds."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        zone = "".join(rng.choice(["12", " ", "-", "(555) ", "123-4567", "a@b", ".", " word ", "[at]"], size=25))
        fixed = sorted((int(a), int(k), int(a) + 5) for a, k in zip(rng.integers(0, len(zone), size=2), rng.integers(0, 4, size=2)))
        w = rng.normal(size=(4, P.N_FEATURES))
        ends, found = P.segments(zone)
        free = [(i, j, f) for i, j, f in found if all(ends[j] <= a or b <= ends[i] for a, _, b in fixed)]
        own = {(ends[i], ends[j]): w[:, f].sum(axis=1) - P.MARGIN for i, j, f in free}

        @functools.cache
        def best(j, state):  # of what stands before the boundary, behind an entity of the state
            if j == 0:
                return 0.0 if state == 0 else -np.inf
            top = best(j - 1, state)
            if state:
                top = max([top] + [best(i, s) + own[ends[i], ends[j]][state - 1] + w[state - 1, P.N_OWN + s] for i, e, _ in free if e == j for s in range(5)])
            scores = None
            for _, kind, b in sorted(fixed, key=lambda x: (x[2], x[0], x[1])):
                if ends[j - 1] < b <= ends[j]:
                    before = scores or [best_open(j, s) for s in range(5)]
                    scores = [-np.inf] * 5
                    scores[kind + 1] = max(x + w[kind, P.N_OWN + s] for s, x in enumerate(before))
            return scores[state] if scores else top

        def best_open(j, state):  # no segment ends where a fixed span does or inside it
            return best(j - 1, state)

        told = [(a, k, b, False) for a, k, b in P.decode(zone, fixed, w)]
        value, state = 0.0, 0
        for a, kind, b, given in sorted([*told, *((a, k, b, True) for a, k, b in fixed if b <= len(zone))], key=lambda x: (x[2], x[0], x[1])):
            value += w[kind, P.N_OWN + state] + (0.0 if given else own[a, b][kind])
            state = kind + 1
        assert abs(value - max(best(len(ends) - 1, s) for s in range(5))) < 1e-9


def test_previous_kind_decides_between_kinds():
    """Segments that look the same take the kind that goes with the entity before them."""
    w = np.zeros((4, P.N_FEATURES))
    w[:, 0] = 3.0
    w[1, P.N_OWN + 1] = w[3, P.N_OWN + 3] = 1.0  # an ip behind an email, a phone behind a card
    w[2, P.N_OWN] = 0.5                          # a card where nothing stands before
    fixed = lambda text, span, kind: [(text.index(span), kind, text.index(span) + len(span))]
    for text, known, kind in [("a@bc.de 1234567", fixed("a@bc.de 1234567", "a@bc.de", 0), 1), ("4111111 1234567", fixed("4111111 1234567", "4111111", 2), 3), ("x 1234567", [], 2)]:
        assert [k for _, k, _ in P.decode(text, known, w)] == [kind], text


def test_kinds_that_follow_each_other_are_learnt():
    """A form that two kinds share, told apart by what goes before it alone."""
    rng = np.random.default_rng(8)
    weights = np.zeros((4, P.N_FEATURES))
    rows = []
    for n in range(200):
        zone = f"{['a@bc.de', '10.2.3.4'][n % 2]} 1{rng.integers(1e6, 9e6)}"
        ends, found = P.segments(zone)
        place = {(ends[i], ends[j]): s for s, (i, j, _) in enumerate(found)}
        cut = zone.index(" ")
        hits = np.zeros((len(found), 4))
        hits[place[0, cut], n % 2] = 1.0
        hits[place[cut + 1, len(zone)], 2 + n % 2] = 1.0
        rows.append((P.matrix(found), [(i, j) for i, j, _ in found], len(ends), hits))
    for _ in range(5):
        for row in rows:
            weights += 0.1 * P.likelihood_step(*row, weights)[1]
    for zone, kinds in [("k@lm.no 17654321", [0, 2]), ("10.9.8.7 17654321", [1, 3])]:
        assert [k for _, k, _ in P.decode(zone, [], weights)] == kinds


# Written by hand in forms of everyday text, not by the module's generator.  [kind|span] marks a span.
HAND = """
Please call me on [phone|212 555 0147] after six.
Our London office: [phone|020 7946 0958], ask for Ms Hall.
tel. [phone|0151/23456789] or by post
Phone: [phone|1-800-555-0199]
Fax [phone|(030) 901820-14] is read once a day.
Reach the desk at [phone|212.555.0182].
mobile [phone|07700 900123], any time
You can text [phone|(415)555-0133] instead.
Her cell is [phone|415-555-0101] and mine [phone|415-555-0102].
Ring [phone|0049 30 901820] from abroad.
Whatsapp [phone|+49/151/23456789] works best.
For help contact [email|support (at) example.org] today.
Write to [email|jane.doe AT example DOT org] please
[email|j.doe{at}example.net] is the maintainer.
mail [email|jane_doe at cs dot example dot edu] with questions
bugs go to [email|dev-list<at>example<dot>org].
[email|info @ example.com] answers within a day
His address, [email|m.lee[at]lab.example.edu], is on the door.
Contact: [email|press(at)museum.example]
The server is [ip|10 . 0 . 0 . 12] behind the router.
ping [ip|192. 168. 0. 1] first
host [ip|172.16.0 .9] is down
We saw logins from [ip|203 .0 .113 .77] at night.
card [card|4111.1111.1111.1111] expires in May
Visa: [card|5500_0000_0000_0004]
charged to [card|4012  8888  8888  1881] yesterday
credit card [card|4111 - 1111 - 1111 - 1111] was used
account card no. [card|6011/1111/1111/1117]
The war lasted from 1914-1918 and cost millions.
ISBN 978-3-16-148410-0 is out of print.
ISSN 2049-3630, volume 12, pages 101-118
The city had 8,804,190 people in 2020.
It cost $1,299.99 plus 8.875 percent tax.
See section 14.3.2 and table 5.1.
Flight 1523 leaves at 10:15:00 on 12/25/2020.
We measured 3.14159265 and 2.71828182.
At 52.5200, 13.4050 you find the tower.
Version 2.10.3 was out on 2021-05-05.
The ratio was 16:9 or 2.35:1 in 1953.
arXiv:2101.00027 describes the corpus.
Zip 90210-1234, room 4-212
In 1066, 1215 and 1688 things changed.
Look at the dots on page 12 of 300.
He was at home, dot com shares fell 12.5 percent.
order 20201225-0001 shipped in 3-5 days
A 100-200-300 split of 600 rows
between 1000 and 2000 men, some 250 horses
the years 2001 2002 2003 and 2004
Temperatures of -12.5 to 30.25 degrees
population density 1,234.5 per km2 (2011)
chapter 3, verse 16-18, lines 1200-1250
""".strip().split("\n")


def hand_rows():
    out = []
    for line in HAND:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone)\|(.*?)\](?=[\s.,;]|$)", line):
            text += line[at:m.start()]
            if m[2]:
                spans.append((len(text), P.KINDS.index(m[1]), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out


def hand_score(weights):
    """(spans marked, spans found, both right, kinds right where any span touches)."""
    want = got = both = touched = 0
    for text, gold in hand_rows():
        base = P.base_spans(text)
        told = base + P.added_spans(text, base, weights)
        want, got, both = want + len(gold), got + len(told), both + len(set(told) & set(gold))
        touched += sum(any(k == kk and a < ee and aa < e for aa, kk, ee in told) for a, k, e in gold)
    return want, got, both, touched


def test_hand_written_set(spark):
    """The field of the given documents: README states the recall.  Clean lines stay clean but for an ISBN."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, got, both, _ = hand_score(P.fit(P.labelled_zones(docs)))
    print("hand-written spans, found, right:", want, got, both)
    assert want == 29 and both >= 18 and got - both <= 2
