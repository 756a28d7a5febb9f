"""Personal data: fixed patterns plus a semi-Markov conditional random field.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  The field adds spans the
patterns miss: numbers without the leading plus, written-out addresses, other separators.  It works on
*zones*, the stretches around a digit, an at sign, a bracketed "at" or "dot" and a written-out address;
outside zones no segment can be an entity.  A zone reaches as far as an entity around its trigger can, and
its context.  A zone's tokens are cut into segments of at most ``MAX_TOKENS`` tokens, but for written-out
addresses, which are segments at any length an address can have; a candidate segment is scored as a whole (digit groups, checksums, separators, neighbours, cue words)
and by the kind of the entity before it in the zone, and dynamic programming with a state per previous kind
picks boundaries and kinds together.  Base spans are fixed segments of that search: they set the state.  A zone is decoded whole,
however long: the search keeps the scores of the boundaries that open segments reach, not of all before.

Training is by conditional likelihood (forward-backward sums over all segmentations) on at most
``MAX_ZONES`` zones labelled by the base patterns - those with the smallest hash over all documents -
where spans are also rewritten in the forms the patterns miss, beside numbers that are no personal data
(dates, versions, amounts, failed checksums), and every second example is two zones, so that kinds follow each other.  The weights, a few hundred numbers, go to the tasks; the
texts are read in place and nothing is shuffled but the bounded sample.

Defined results: null and empty texts have no spans; rows repeated in full are scanned row by row; an
empty table, or one without a labelled zone, trains no field and gives the base spans; long texts are
scanned whole in time linear in their length; only the id and the text are read.  Of segmentations that score
the same with the same last kind, the one whose last segment ends (then starts) earlier is taken; between last
kinds none goes first, then the kinds as listed.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.llm.batches import portions
from quire.llm.sample import smallest
from quire.llm.text import text_of
from quire.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16          # of one entity that is no written-out address
MAX_CHARS = 64
LOCAL_CHARS = 128        # of a local part with its dots written out (64 by the standard)
CONTEXT = 24             # characters on both sides of an entity that its features see
MAX_ZONES = 600
EPOCHS, RATE, DECAY, SEED = 12, 0.2, 1e-4, 11
MARGIN = 2.0             # log-odds a segment must reach against leaving its tokens alone

# ---- base patterns (fixed values) -------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(d) // 5 + 2 * int(d) % 10 for d in digits[-2::-2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, leftmost and non-overlapping per kind, sorted."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        left = at
        while left > last and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


# ---- zones, segments, features ----------------------------------------------------------------
_TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?(?:at|dot)\s?[\])}>]", re.I)
_TOKEN = re.compile(r"[^\W_]+|\s+|[\W_]")
_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]", re.I)
_DOT = re.compile(r"[\[({<]\s?dot\s?[\])}>]", re.I)
_LABEL = r"[^\W_](?:[\w-]{0,61}[^\W_])?(?![^\W_])"
_SAID_DOT = r"(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\s{1,2}dot\s{1,2})"
_HOST = rf"{_LABEL}(?:(?:\s?\.(?=\w)|\s\.\s|{_SAID_DOT}){_LABEL}){{1,126}}"
# An at form and the host behind it; a bare "at" needs a dot that is written out.
_SAID = re.compile(rf"[\[({{<@aA](?i:(?<=@)\s?|(?<=[\[({{<])\s?at\s?[\])}}>]\s?|(?<=\sa)t\s{{1,2}}(?={_LABEL}(?:\.{_LABEL})*{_SAID_DOT}{_LABEL})){_HOST}")
_HOST_ENDS = re.compile(rf"(?<=[^\W_])(?=(?:\s?\.(?=\w)|\s\.\s|{_SAID_DOT}){_LABEL})", re.I)
_DOT_BEFORE = re.compile(rf"{_SAID_DOT}\Z", re.I)
_BARE_AT = re.compile(r"\sat\s", re.I)
_ARTICLE = re.compile(r"\sat\s{1,2}(?:an?|the|this|that|these|those|each|every|some|any|no|one|its|our|your|my|his|her|their)\b", re.I)
_TOP = re.compile(r"(?<![^\W_])(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|dev|app)\Z", re.I)
_CUES = (re.compile(r"mail|contact|write", re.I), re.compile(r"\bip\b|host|server|addr", re.I),
         re.compile(r"card|visa|credit|iban|account", re.I), re.compile(r"phone|tel\b|call|fax|mobile|cell", re.I))
_SHAPES = (r"\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}", r"(?:00|\+)?\d{1,3}[-. /]\(?\d{2,4}\)?(?:[-. /]\d{2,4}){2,3}", r"\d{4}(?:[-. _]{1,2}\d{4}){3}", r"\d{14,19}",
           r"\d{1,3}(?:\.\d{1,3}){3}", r"\d{1,3}(?: ?[.,] ?\d{1,3}){3}", r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", r"\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}",
           r"v?\d+(?:\.\d+){1,2}", r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", r"(?:19|20)\d\d(?:-(?:19|20)?\d\d)?", r"\d{1,2}:\d\d(?::\d\d)?",
           r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", r"[\w.%+-]+\s?\W\s?at\s?\W\s?[\w-]+(?:\s?(?:\.|\W\s?dot\s?\W)\s?[\w-]+)+", r"[\w.%+-]+ @ [\w-]+(?: ?\. ?[\w-]+)+",
           rf"[\w.%+-]+(?:{_SAID_DOT}[\w.%+-]+)*(?:\s?@\s?|\s?[\[({{<]\s?at\s?[\])}}>]\s?|\s{{1,2}}at\s{{1,2}}){_HOST}")
_SHAPES = tuple(re.compile(p, re.I) for p in _SHAPES)
_DIGIT_BINS = (0, 1, 4, 7, 10, 11, 12, 14, 16, 17, 20)
N_OWN = 1 + len(_DIGIT_BINS) + 6 + 9 + len(_SHAPES) + 15
STATES = 1 + len(KINDS)      # no entity before in the zone, or the last one's kind
N_FEATURES = N_OWN + STATES  # the last columns weigh the state before a segment


def addresses(text: str) -> Iterator[tuple[list[int], list[int]]]:
    """(starts, ends) of each written-out address: its local part may begin at each of the starts,
    first the leftmost, and its host may end at each of the ends, last the rightmost."""
    for m in _SAID.finditer(text):
        at = m.start()
        while at > 0 and m.start() - at < 2 and text[at - 1].isspace():
            at -= 1
        starts, low = [], max(0, at - LOCAL_CHARS)
        while True:
            left = at
            while left > low and (text[left - 1].isalnum() or text[left - 1] in "._%+-"):
                left -= 1
            if left == low > 0 and text[left - 1].isalnum() and text[left].isalnum():
                break  # longer than a local part can be
            while left < at and not text[left].isalnum():
                left += 1
            if left == at:
                break
            starts.append(left)
            dot = _DOT_BEFORE.search(text, max(low, left - 9), left)
            if not dot:
                break
            at = dot.start()
        if starts:
            host = re.match(r"@\s?|[\[({<]\s?at\s?[\])}>]\s?|at\s{1,2}", m.group(), re.I).end()
            first = re.compile(_LABEL).match(m.group(), host).end()
            ends = [m.start() + d.start() for d in _HOST_ENDS.finditer(m.group(), first) if d.start() > first]
            yield starts[::-1], [*ends, m.end()]


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint [start, end) stretches around the triggers and the written-out addresses."""
    reach = MAX_CHARS + CONTEXT
    plain = ((max(0, m.start() - reach), min(len(text), m.end() + reach)) for m in _TRIGGER.finditer(text))
    said = ((max(0, starts[0] - CONTEXT), min(len(text), ends[-1] + CONTEXT)) for starts, ends in addresses(text))
    start = end = -1
    for a, b in heapq.merge(plain, said):
        if a > end:
            if end >= 0:
                yield start, end
            start = a
        end = max(end, b)
    if end >= 0:
        yield start, end


def _features(span: str, left: str, right: str) -> list[int]:
    digits = re.sub(r"\D", "", span)
    groups = re.findall(r"\d+", span)
    whole = bool(_TOP.search(span) and _SHAPES[-1].fullmatch(span) and not _ARTICLE.search(span))  # an address up to a known top label
    out, base = [0], 1
    out.append(base + max(i for i, b in enumerate(_DIGIT_BINS) if len(digits) >= b))
    base += len(_DIGIT_BINS)
    out.append(base + min(len(groups), 5))
    base += 6
    out += [base + i for i, c in enumerate(" .-(/+,:@") if c in span and not (whole and c == " ")]
    base += 9
    out += [base + i for i, p in enumerate(_SHAPES) if p.fullmatch(span)]
    base += len(_SHAPES)
    near = left[-1:]
    flags = [14 <= len(digits) <= 19 and luhn(digits), len(groups) == 4 and all(map(_octet, groups)), bool(_AT.search(span)), bool(_DOT.search(span)),
             not digits, any(c.isalpha() for c in span), bool(re.match(r"[\w@.+(/-]", near)), bool(re.match(r"[\w@/-]|[.,:]\w|\s?\.\s?\d|\s?\Wdot\W", right)),
             *(bool(p.search(left)) for p in _CUES), bool(_ARTICLE.search(span)), whole, whole and bool(_BARE_AT.search(span))]
    out += [base + i for i, f in enumerate(flags) if f]
    return out


def boundaries(zone: str) -> array:
    """The token starts and the end."""
    return array("q", itertools.chain([0], (m.end() for m in _TOKEN.finditer(zone))))


def candidates(zone: str, ends: array, fixed: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int, list[int]]]:
    """Candidate segments that touch no fixed span, as (first token, token behind, features), by first token.

    An entity starts with a letter, digit, plus or opening bracket, ends with a letter, digit or closing
    bracket and holds a trigger, or it is a written-out address."""
    taken: list[list[int]] = []  # the fixed spans, overlapping ones as one
    for a, b in sorted(fixed):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    said: dict[int, list[int]] = {}
    for starts, stops in addresses(zone):
        for a in starts:
            said.setdefault(a, []).extend(stops)
    triggers = (m.end() - 1 for m in _TRIGGER.finditer(zone))
    none = len(zone)
    trigger, k = next(triggers, none), 0
    for i in range(len(ends) - 1):
        a = ends[i]
        while trigger < a:
            trigger = next(triggers, none)
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        limit = taken[k][0] if k < len(taken) else none
        if a >= limit or not (zone[a].isalnum() or zone[a] in "+("):
            continue
        told = said.get(a, ())
        for j in range(i + 1, min(len(ends) - 1, i + MAX_TOKENS) + 1):
            b = ends[j]
            if b - a > MAX_CHARS or b > limit:
                break
            if b - a >= 6 and trigger < b and (zone[b - 1].isalnum() or zone[b - 1] == ")") and b not in told:
                span = zone[a:b]
                if sum(c.isdigit() for c in span) >= 4 or "@" in span or _AT.search(span):
                    yield i, j, _features(span, zone[max(0, a - CONTEXT):a], zone[b:b + 6])
        for b in told:
            j = bisect.bisect_left(ends, b, i)
            if ends[j] == b and b <= limit:
                yield i, j, _features(zone[a:b], zone[max(0, a - CONTEXT):a], zone[b:b + 6])


def segments(zone: str) -> tuple[array, list[tuple[int, int, list[int]]]]:
    """(token starts and the end, candidate segments)."""
    ends = boundaries(zone)
    return ends, list(candidates(zone, ends))


def decode(zone: str, fixed: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best segmentation's entities that touch no fixed span (start, kind, end).

    ``best`` and ``path`` are those of the boundary ``at``, one per state; a path is (path before it, entity).
    Open segments wait at the boundary behind them, and no boundary passed is kept.  The first boundary
    behind a fixed span has that span's kind as its only state."""
    ends = boundaries(zone)
    own, follows = weights[:, :N_OWN], weights[:, N_OWN:].tolist()
    best, path, at = [0.0] + [-math.inf] * len(KINDS), [None] * STATES, 0
    waiting: dict[int, list] = {}
    known, f = sorted(fixed, key=lambda x: (x[2], x[0], x[1])), 0

    def entered(kind: int) -> tuple[float, int]:
        """(score, state before) of the best path into an entity of the kind that starts here."""
        score = [b + t for b, t in zip(best, follows[kind])]
        state = max(range(STATES), key=score.__getitem__)
        return score[state], state

    bare = candidates(zone, ends, [(a, b) for a, _, b in fixed])
    for i, j, feats in itertools.chain(bare, [(len(ends) - 1, 0, None)]):
        while at < i:
            at += 1
            for score, kind, through in waiting.pop(at, ()):
                if score > best[kind + 1]:
                    best[kind + 1], path[kind + 1] = score, through
            while f < len(known) and known[f][2] <= ends[at]:
                kind = known[f][1]
                score, state = entered(kind)
                best, path = [-math.inf] * STATES, [path[state] if s == kind + 1 else None for s in range(STATES)]
                best[kind + 1] = score
                f += 1
        if feats is not None:
            scores = own[:, feats].sum(axis=1).tolist()
            here = waiting.setdefault(j, [])
            for kind, score in enumerate(scores):
                before, state = entered(kind)
                here.append((before + score - MARGIN, kind, (path[state], (ends[i], kind, ends[j]))))
    through, out = path[max(range(STATES), key=best.__getitem__)], []
    while through is not None:
        through, entity = through
        out.append(entity)
    return out[::-1]


# ---- training ---------------------------------------------------------------------------------
def _rewritten(span: str, kind: int, rng: np.random.Generator) -> str:
    """The span in a form the patterns miss (or as it is)."""
    digits = re.sub(r"\D", "", span)
    pick = int(rng.integers(8 if kind == 0 else 4))
    if kind == 0:
        user, _, host = span.partition("@")
        if rng.random() < 0.5:  # also without a digit, with hyphens and more labels
            user, host = (re.sub(r"\d", lambda m: "abcdefghij"[int(m.group())], x) for x in (user, host))
        if rng.random() < 0.3:
            host = ["long-name.", "department.", "a-b.c."][int(rng.integers(3))] + host
        return [span, f"{user} [at] {host}", f"{user}(at){host.replace('.', '(dot)')}", f"{user} @ {host}",
                f"{user} at {host.replace('.', ' dot ')}", f"{user} at {host.replace('.', ' dot ')}", f"{user} [at] {host.replace('.', ' [dot] ')}",
                f"{user}@{host.replace('.', '(dot)')}"][pick]
    if kind == 1:
        return [span, span.replace(".", " . "), span, span.replace(".", " .")][pick]
    if kind == 2:
        four = [digits[k:k + 4] for k in range(0, len(digits), 4)]
        return [span, ".".join(four), "  ".join(four), "_".join(four)][pick]
    ten = digits[-10:]
    return [span, f"({ten[:3]}) {ten[3:6]}-{ten[6:]}", f"{ten[:3]}-{ten[3:6]}-{ten[6:]}", f"00{digits[:-10]} {ten[:3]} {ten[3:6]} {ten[6:]}"][pick]


def _harmless(rng: np.random.Generator) -> str:
    """A number that is no personal data."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, size=k)))
    card = n(16)
    if luhn(card):
        card = card[:-1] + str((int(card[-1]) + 1) % 10)
    return [f"20{n(2)}-0{1 + int(rng.integers(9))}-1{n(1)}", f"{1 + int(rng.integers(9))}.{n(1)}.{n(2)}", f"version {n(1)}.{n(1)}.{n(1)}.4{n(3)}", f"{1 + int(rng.integers(9))},{n(3)},{n(3)}", card,
            f"1{n(8)}", f"19{n(2)}-20{n(2)}", f"#{n(6)}", f"{n(4)} {n(4)}", f"id {n(12)}", f"page {n(3)} of {n(3)}", f"{n(2)}:{n(2)}:{n(2)}",
            "look at the dot product", "arrive at this dot pattern"][int(rng.integers(14))]


def examples(zone: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A training zone: spans kept or rewritten, a harmless number put in now and then."""
    out, gold, at = "", [], 0
    for a, kind, b in spans:
        if a < at:
            continue
        out += zone[at:a]
        if rng.random() < 0.4:
            out += _harmless(rng) + " and "
        new = _rewritten(zone[a:b], kind, rng)
        gold.append((len(out), kind, len(out) + len(new)))
        out, at = out + new, b
    out += zone[at:]
    return (out + " " + _harmless(rng), gold) if rng.random() < 0.5 else (out, gold)


def matrix(found) -> np.ndarray:
    """(segment, feature) indicator matrix."""
    x = np.zeros((len(found), N_FEATURES))
    for s, (_, _, feats) in enumerate(found):
        x[s, feats] = 1.0
    return x


def likelihood_step(x: np.ndarray, spans: list[tuple[int, int]], n: int, hits: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold segmentation and its gradient, by forward and backward sums over
    (boundary, state).

    ``spans`` are the segments' token bounds among ``n`` boundaries; ``hits`` (segment, kind) marks the gold."""
    scores = x @ weights.T
    follows = weights[:, N_OWN:].T  # (state before, kind)
    by_end, by_start = {}, {}
    for s, (i, j) in enumerate(spans):
        by_end.setdefault(j, []).append(s)
        by_start.setdefault(i, []).append(s)
    forward, backward = np.full((n, STATES), -np.inf), np.zeros((n, STATES))
    forward[0, 0] = 0.0
    into = np.full((len(spans), len(KINDS)), -np.inf)  # all paths up to and into a segment of a kind
    onward = np.zeros_like(into)                       # and from behind it
    for j in range(n):
        if j:
            forward[j] = forward[j - 1]
            if j in by_end:
                forward[j, 1:] = np.logaddexp.reduce(np.vstack([forward[j, 1:], into[by_end[j]] + scores[by_end[j]]]), axis=0)
        if j in by_start:
            into[by_start[j]] = np.logaddexp.reduce(forward[j][:, None] + follows, axis=0)
    for i in range(n - 1, -1, -1):
        if i < n - 1:
            backward[i] = backward[i + 1]
            if i in by_start:
                found = by_start[i]
                behind = np.logaddexp.reduce(scores[found] + onward[found], axis=0)  # of a kind, over the segments here
                backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(follows + behind, axis=1))
        if i in by_end:
            onward[by_end[i]] = backward[i, 1:]
    total = float(np.logaddexp.reduce(forward[n - 1]))
    gradient = (hits - np.exp(into + scores + onward - total)).T @ x
    starts = np.array([i for i, _ in spans])
    # (segment, state, kind): the share of the segmentations in which the segment follows that state.
    pairs = np.exp(forward[starts][:, :, None] + follows + (scores + onward - total)[:, None, :])
    gradient[:, N_OWN:] -= pairs.sum(axis=0).T
    value, state = -total, 0
    for s, kind in sorted(zip(*map(np.ndarray.tolist, np.nonzero(hits))), key=lambda g: spans[g[0]]):
        value += float(scores[s, kind] + follows[state, kind])
        gradient[kind, N_OWN + state] += 1.0
        state = kind + 1
    return value, gradient


def fit(sample: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray | None:
    """Weights (kind, feature) by stochastic ascent of the conditional likelihood; None without a labelled zone."""
    if not sample:
        return None
    rng = np.random.default_rng(seed)
    data = []
    for zone, spans in sample:
        text, gold = examples(zone, spans, rng)
        if rng.random() < 0.5:
            more, behind = examples(*sample[int(rng.integers(len(sample)))], rng)
            gold += [(len(text) + 1 + a, kind, len(text) + 1 + b) for a, kind, b in behind]
            text += "\n" + more
        ends, found = segments(text)
        at = {e: k for k, e in enumerate(ends)}
        place = {(i, j): s for s, (i, j, _) in enumerate(found)}
        rows = [(place.get((at.get(a), at.get(b))), kind) for a, kind, b in gold]
        if found and all(s is not None for s, _ in rows):
            hits = np.zeros((len(found), len(KINDS)))
            for s, kind in rows:
                hits[s, kind] = 1.0
            data.append((matrix(found), list(place), len(ends), hits))
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -2.0
    squares = np.full_like(weights, 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            _, gradient = likelihood_step(*data[k], weights)
            gradient -= DECAY * weights
            squares += gradient ** 2
            weights += RATE * gradient / np.sqrt(squares)
    return weights


# ---- Spark ------------------------------------------------------------------------------------
def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))


def labelled_zones(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_zones: int = MAX_ZONES) -> list:
    """At most ``max_zones`` (zone, base spans): the zones with the smallest hash over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, spans = [], [], []
            for _, part in portions(batch):
                for text in part:
                    base = base_spans(text) if _TRIGGER.search(text) else []
                    if not base:
                        continue
                    for a, b in zones(text):
                        inside = [(s - a, k, e - a) for s, k, e in base if a <= s and e <= b]
                        # Zones of a bounded length are enough to learn from; scanning has no such bound.
                        if inside and b - a <= 400 and sum(s < b and a < e for s, _, e in base) == len(inside):
                            zone = text[a:b]
                            keys.append(int.from_bytes(hashlib.blake2b(zone.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
                            texts.append(zone)
                            spans.append(",".join(f"{s}:{k}:{e}" for s, k, e in inside))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts), pa.array(spans)], names=["h", "zone", "spans"])

    found = _texts(df, id_col, text_col).mapInArrow(run, "h long, zone string, spans string")
    rows = smallest(cut_lineage(found), max_zones, "h", ("zone", "spans")).collect()
    return [(r.zone, [tuple(map(int, x.split(":"))) for x in r.spans.split(",")]) for r in rows]


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    out, k = [], 0
    for a, b in zones(text):
        fixed = []
        while k < len(base) and base[k][2] <= a:
            k += 1
        i = k
        while i < len(base) and base[i][0] < b:
            fixed.append((base[i][0] - a, base[i][1], base[i][2] - a))
            i += 1
        out += [(a + s, kind, a + e) for s, kind, e in decode(text[a:b], fixed, weights)]
    return out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """One row per input row: id, counts of the base kinds, base and all spans as kind:start:end strings."""
    told = _texts(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            counts, base_text, all_text = [], [], []
            for _, part in portions(batch):
                for text in part:
                    base = base_spans(text) if _TRIGGER.search(text) else []
                    more = added_spans(text, base, weights) if weights is not None else []
                    counts.append([sum(k == n for _, k, _ in base) for n in range(len(KINDS))])
                    base_text.append(join(base))
                    all_text.append(join(sorted(base + more)))
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(base_text), pa.array(all_text)], names=names)

    names = ["id", *(f"n_{k}" for k in KINDS), "base", "spans"]
    schema = StructType([StructField("id", told.schema["id"].dataType), *(StructField(f"n_{k}", LongType()) for k in KINDS),
                         StructField("base", StringType()), StructField("spans", StringType())])
    return told.mapInArrow(run, schema)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_zones: int = MAX_ZONES) -> DataFrame:
    """``find_pii`` with a field trained on the table itself."""
    return find_pii(df, id_col, text_col, fit(labelled_zones(df, id_col, text_col, max_zones)))


def q_pii(spark, sf_dir) -> DataFrame:
    from quire.session import table

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
