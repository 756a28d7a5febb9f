"""Weighted word shingles of many texts at once, as numpy arrays (used inside tasks)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WIDTH = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WHITE = b" \t\n\x0b\x0c\r"


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: uint64 -> uint64, a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)  # one random value per byte
_ODD = mix64(np.arange(1, WIDTH + 1, dtype=np.uint64)) | _U(1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
WINDOW = 1 << 20  # bytes hashed at a time; the tables of powers are as long
_GAP = re.compile(rb"[\x09-\x0d\x20]")


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i <= WINDOW."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(WINDOW + 2, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _window_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of at most ``WINDOW`` bytes: a polynomial over a word's bytes, read
    off running sums of the whole window, before the final mix."""
    word = np.zeros(len(buf) + 1, dtype=np.int8)
    word[:-1] = ~_SPACE[buf]
    edge = np.diff(word, prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers()
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return start, (total[stop] - total[start]) * down[start]


def _long_word(word: bytes) -> np.ndarray:
    """The hash of one word of any length, window by window with the power carried on."""
    total, power = 0, 1
    for at in range(0, len(word), WINDOW):
        part = np.frombuffer(word, dtype=np.uint8, count=min(WINDOW, len(word) - at), offset=at)
        total += int(_window_hashes(part)[1][0]) * power
        power = power * pow(int(_BASE), len(part), 1 << 64) % (1 << 64)
    return np.array([total % (1 << 64)], dtype=np.uint64)


def _cuts(text: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of a long text that end at white space and hold at most ``WINDOW`` bytes or one longer word."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > WINDOW:
            end = max(text.rfind(c, at + 1, at + WINDOW + 1) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if end < 0:  # no white space but perhaps at the very start
                gap = _GAP.search(text, at + 1)
                end = gap.start() if gap else len(text)
        yield at, end
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of every word, in order.

    Short texts are hashed together, a long one in stretches, so beyond the result only a window is held."""
    at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            ends = np.cumsum([len(texts[i]) + 1 for i in held])
            start, h = _window_hashes(np.frombuffer(b" ".join([texts[i] for i in held]), dtype=np.uint8))
            at.append(np.array(held)[np.searchsorted(ends, start, side="right")])
            found.append(h)
        held, size = [], 0

    for i, text in enumerate(texts):
        if size + len(text) + 1 > WINDOW:
            flush()
        if len(text) < WINDOW:
            held.append(i)
            size += len(text) + 1
            continue
        for a, b in _cuts(text):
            part = text[a:b]
            h = _window_hashes(np.frombuffer(part, dtype=np.uint8))[1] if b - a <= WINDOW else _long_word(part.strip(_WHITE))
            at.append(np.full(len(h), i))
            found.append(h)
    flush()
    return np.concatenate(at), mix64(np.concatenate(found))


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count), sorted by text and hash.

    A text of 1 to ``width - 1`` words has one shingle, all its words; one without words has none."""
    doc, h = word_hashes(texts)
    sh = np.zeros(0, dtype=np.uint64)
    at = np.zeros(0, dtype=doc.dtype)
    if len(h) >= width:
        n = len(h) - width + 1
        inside = doc[:n] == doc[width - 1:]
        acc = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            acc += h[k:k + n] * _ODD[k]
        sh, at = mix64(acc[inside]), doc[:n][inside]
    words = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), dtype=np.int64)
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        first = np.searchsorted(doc, short)
        acc = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = words[short] > k
            acc[has] += h[first[has] + k] * _ODD[k]
        sh = np.concatenate([sh, mix64(acc + words[short].astype(np.uint64))])
        at = np.concatenate([at, short])
    if len(texts) == 1:
        sh = np.sort(sh)
    else:
        order = np.lexsort((sh, at))
        sh, at = sh[order], at[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    return at[first], sh[first], np.diff(first, append=len(sh))


def weights(count: np.ndarray) -> np.ndarray:
    """1 + ln(count): a shingle that a text repeats weighs more, but one long run of a repeated word
    cannot make two otherwise different texts similar."""
    return 1.0 + np.log(count)


def probability_jaccard(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets given as sorted unique hashes and weights:
    the sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    common, ia, ib = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    ratio = y / x
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    # Elements of one side only are always the larger: at ratio 0 for x, infinite for y.
    lower = np.cumsum(x) + (wa.sum() - x.sum())
    higher = np.cumsum(y[::-1])[::-1] - y + (wb.sum() - y.sum())
    return float((x / (lower + higher / ratio)).sum())
