"""Packing token sequences by the sum-of-squares online rule.

A document's ids are cut into whole windows of ``window`` tokens and one remainder.  The
remainder is placed online: among the fill levels that have a partially filled window with
enough room, and the empty window, it goes to the one that minimises the sum of squared
counts of partially filled windows per level, tracked in a level array.  Every task packs the
documents it has tokenised, so nothing is shuffled and a hot source is only more rows.

A task keeps at most ``max_open`` partially filled windows.  When more are open, and at the end of the
task, they are closed: each keeps its pieces as placed and its gap is filled with tokens cut from the
emptiest windows.  What is left then, under one window, stays open; at the end of the task it becomes sequences
whose lengths are powers of two, which need no padding.  So memory per task is bounded by ``max_open``
windows whatever the lengths.

Defined results: null and empty texts are one token (the end id); every row is packed, also rows
repeated in full or with a null identifier; an empty table gives no pieces; very long texts are
encoded whole and only occupy their own windows; other columns are not read.
Sequence ids are (partition index << 33) + running number, unique within one result.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import portions
from quire.llm.text import text_of

WINDOW = 2048
END_ID = 1
MAX_OPEN = 4096
PORTION_CHARS = 2_000_000  # of the texts that are split together
# Word pieces kept per Python worker, in two halves (about 200 bytes each).
CACHE_WORDS = 800_000

NAMES = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "stays"]
PIECE_SCHEMA = "id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, stays boolean"

# A space before another white space character (or the end) can lie inside a white-space run,
# where a cut would change the pieces; every other space starts a piece of its own.
_RUN = re.compile("\\x20(?:[\\s\\x1c-\\x1f\\x85\\u180e\\u200b]|\\Z)")


# Letters that every version of the splitting pattern takes for letters.
_LETTERS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)")


def _byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    """Token ids (little-endian uint32 bytes) of texts, by a byte-level ``tokenizers`` file.

    Byte-level pieces never cross from a non-space into a following space, so a text whose
    spaces all stand before a visible character is the concatenation of its space-started
    words; words are encoded once and kept in a bounded two-generation cache.  A word of
    letters, with at most a full stop or comma behind, goes straight to the file's merge model;
    other words, and texts with other white-space runs, are encoded in full."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.half = cache_words // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {"": b"", **dict(zip(".,", self.encode_all([".", ","])))}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def stem(self, letters: str) -> bytes:
        """A space and a word of letters, by the merge model."""
        got = self.young.get(letters) or self.old.get(letters)
        if got is None:
            symbols = self.symbols[32] + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.symbols))
            got = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        self.young[letters] = got
        return got

    def pieces(self, words: list[str]) -> list[bytes]:
        """The ids of a space and each of the (distinct) words: from the cache, by the merge model where that is
        exact, else by the whole tokenizer."""
        young, old, need = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                elif m := _LETTERS.fullmatch(w):
                    letters, mark = m.groups()
                    got = self.stem(letters)
                    if mark:
                        young[w] = got + self.marks[mark]
                else:
                    need.append(w)
        young.update(zip(need, self.encode_all([" " + w for w in need])))
        out = [young[w] for w in words]
        if len(young) > self.half:
            self.old, self.young = young, {}
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of every text.  Arrow splits the texts and numbers their distinct words, so that each is
        looked up once per call; a text is the concatenation of its words' ids."""
        plain = [not _RUN.search(t) for t in texts]
        split = pc.split_pattern(pa.array([t if p else "" for t, p in zip(texts, plain)], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        code, ends = coded.indices.to_numpy(), split.offsets.to_numpy()
        # A text's first word has no space in front; a text that isn't plain is one such head, encoded whole.
        heads = self.encode_all([t[:k] if p and (k := t.find(" ")) >= 0 else t for t, p in zip(texts, plain)])
        ids = self.pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist()).__getitem__
        return [h + b"".join(map(ids, code[a + 1:b].tolist())) for h, a, b in zip(heads, ends, ends[1:])]


class Packer:
    """Sum-of-squares placement of pieces into windows; pieces come out once their place is final.

    Entries are (sequence, offset, piece), a piece is (document, start, ids, stays): ``stays`` is false for what
    was cut off or moved when windows were closed before they were whole."""

    def __init__(self, window: int, max_open: int, first_id: int):
        self.window, self.max_open, self.next_id = window, max_open, first_id
        self.count = np.zeros(window + 1, dtype=np.int64)  # partially filled windows per level; 0 and window stay 0
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]  # open windows by level: lists of pieces
        self.open = 0

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, doc: tuple, start: int, ids: bytes) -> list[tuple]:
        """Place a remainder; returns the entries that became final."""
        w, size = self.window, len(ids) // 4
        piece = (doc, start, ids, True)
        # Change of the sum of squares when a window at level h grows to h + size; a whole window isn't counted.
        have = self.count[: w - size + 1]
        change = 2 * (self.count[size:] - have) + 2
        change[0] = 2 * self.count[size] + 1   # a new window leaves no level
        change[-1] -= 1                        # a window that becomes whole leaves without joining one
        usable = have > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        # Ties go to the fullest window, so that windows close early.
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if best == 0:
            self.put([piece], size)
            return self.drain() if self.open > self.max_open else []
        pieces = self.levels[best].pop()
        self.count[best] -= 1
        self.open -= 1
        pieces.append(piece)
        if best + size < w:
            self.put(pieces, best + size)
            return []
        return self.close(pieces)

    def put(self, pieces: list, level: int) -> None:
        self.levels[level].append(pieces)
        self.count[level] += 1
        self.open += 1

    def close(self, pieces: list) -> list[tuple]:
        seq, out, at = self.new_id(), [], 0
        for p in pieces:
            out.append((seq, at, p))
            at += len(p[2]) // 4
        return out

    def drain(self, last: bool = False) -> list[tuple]:
        """Close the open windows, fullest first, each as it was placed; its gap is filled with tokens cut from
        the emptiest windows.  What is left is under one window: it stays open, or at the end of the task
        becomes sequences whose lengths are powers of two."""
        windows = [pieces for level in self.levels for pieces in level]  # emptiest first
        self.count[:] = 0
        self.levels = [[] for _ in range(self.window + 1)]
        self.open = 0
        out, spare, emptiest = [], [], 0
        while emptiest < len(windows):
            pieces = windows.pop()
            gap = self.window - sum(len(p[2]) for p in pieces) // 4
            while gap and (spare or emptiest < len(windows)):
                if not spare:
                    spare, emptiest = windows[emptiest], emptiest + 1
                doc, start, ids, _ = spare.pop(0)
                pieces.append((doc, start, ids[:4 * gap], False))
                if len(ids) > 4 * gap:
                    spare.insert(0, (doc, start + gap, ids[4 * gap:], False))
                gap -= len(pieces[-1][2]) // 4
            if gap:
                spare = pieces
            else:
                out += self.close(pieces)
        rest = sum(len(p[2]) for p in spare) // 4
        if rest and not last:
            self.put(spare, rest)
        elif rest:
            out += self.powers(spare, rest)
        return out

    def powers(self, pieces: list, rest: int) -> list[tuple]:
        """Sequences of power-of-two lengths that hold the ``rest`` tokens of the pieces."""
        rooms = iter([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1])
        out, room, at, seq = [], 0, 0, 0
        for doc, start, ids, _ in pieces:
            done, n = 0, len(ids) // 4
            while done < n:
                if at == room:
                    room, at, seq = next(rooms), 0, self.new_id()
                take = min(n - done, room - at)
                out.append((seq, at, (doc, start + done, ids[4 * done:4 * (done + take)], False)))
                done += take
                at += take
        return out


_ENCODERS: dict[tuple, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file: workers serve many tasks, so the cache pays off."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
         tokenizer: str | None = None, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, the piece's ids (little-endian
    uint32), and whether it stays where the rule placed it.  ``tokenizer`` is a ``tokenizers`` file present on every
    executor; by default the public byte-level one."""
    docs = df.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer or default_tokenizer())
        packer = Packer(window, max_open, TaskContext.get().partitionId() << 33)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        kind = None

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            long = lambda values: pa.array(values, pa.int64())
            return pa.RecordBatch.from_arrays([
                pa.array([p[0][0] for _, _, p in placed], kind), long([p[1] for _, _, p in placed]),
                long([len(p[2]) // 4 for _, _, p in placed]), long([p[0][1] for _, _, p in placed]),
                long([s for s, _, _ in placed]), long([o for _, o, _ in placed]),
                pa.array([p[2] for _, _, p in placed], pa.binary()), pa.array([p[3] for _, _, p in placed], pa.bool_())], names=NAMES)

        for batch in batches:
            kind = batch.column(0).type
            for ids_of, texts in portions(batch, PORTION_CHARS):
                out: list[tuple] = []
                for doc_id, ids in zip(ids_of, encoder.batch(texts)):
                    ids += end
                    n = len(ids) // 4
                    doc, whole = (doc_id, n), n - n % window
                    for start in range(0, whole, window):
                        out.append((packer.new_id(), 0, (doc, start, ids[4 * start:4 * (start + window)], True)))
                    if n > whole:
                        out += packer.place(doc, whole, ids[4 * whole:])
                if out:
                    yield rows(out)
        if rest := packer.drain(last=True):
            yield rows(rest)

    return docs.mapInArrow(run, PIECE_SCHEMA.format(id=id_type))


def with_crc(pieces: DataFrame) -> DataFrame:
    """The digest columns of the pieces, ids replaced by their unsigned CRC-32."""
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "stays")


def q_packing(spark, sf_dir) -> DataFrame:
    from quire.session import table

    return with_crc(pack(table(spark, sf_dir, "documents")))

