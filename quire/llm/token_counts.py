"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each position of a word; dynamic
programming carries the best score and its number of pieces to each position, nothing else - no
pieces, no back pointers.  Ties follow the unigram model of the ``tokenizers`` library exactly: of
equal scores the piece that starts first wins; a character without a piece of its own may be taken as
unknown at the lowest score less 10; unknown characters count as their UTF-8 bytes (byte fallback),
or, without byte pieces, one token per run.  Words are made as its ``Metaspace`` splitter makes them:
spaces become U+2581, one is put in front of the text, and every one of them starts a word.

The vocabulary's pieces come from a public ``sentencepiece`` file.  That file belongs to a merge
model whose scores are only ranks, so the scores here are Zipf log-probabilities of the ranks; the
file and the scores are parameters.  Nothing is trained.

Counting is narrow: every task counts its own documents with a bounded cache of words, so there is
no shuffle and a hot word costs one look-up wherever it occurs.

Defined results: null and empty texts have 0 tokens; repeated rows are counted row by row; an empty
table gives an empty result; a very long text is split like any other, and a very long word costs time
in proportion to its length; only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quire.llm.batches import portions
from quire.llm.text import text_of

META = "▁"
UNKNOWN = " unknown"      # holds a space, so no word can match it
UNKNOWN_PENALTY = 10.0    # fixed in the tokenizer's rules
CACHE_WORDS = 800_000
# Longer words are counted without being cached.
CACHED_LENGTH = 64
SPAN = 4096  # characters of a word whose states are held at once


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) with the unknown piece first: ln(1 / (rank * H)) over the file's ordinary pieces
    in their order; byte pieces share the lowest score."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    plain = [sp.id_to_piece(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
    scores = [-math.log(r) - total for r in range(1, len(plain) + 1)]
    return [(UNKNOWN, scores[-1]), *((sp.id_to_piece(i), scores[-1]) for i in ids if sp.is_byte(i)), *zip(plain, scores)]


class ViterbiCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], cache_words: int = CACHE_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece != UNKNOWN:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary if p != UNKNOWN), default=1)
        pieces = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.half = cache_words // 2
        self.young: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(number of tokens, score) of one word; U+2581 is already in front."""
        n = len(word)
        # The states of at most ``SPAN`` characters are held, from ``base`` on: a long word's lists are moved on
        # when they are used up, as no piece reaches back further than the longest.
        span, base = min(n, max(SPAN, 2 * self.longest)), 0
        best, count, ends_unknown = [0.0] + [-math.inf] * span, [0] * (span + 1), [False] * (span + 1)
        at, single = 0, False

        def unknown(i: int, char: str) -> None:
            score = best[i] + self.unknown
            if score > best[i + 1]:
                best[i + 1], ends_unknown[i + 1] = score, True
                count[i + 1] = count[i] + (len(char.encode("utf-8", "surrogatepass")) if self.bytes else not ends_unknown[i])

        def move_on() -> int:
            gone = span - self.longest
            best[:] = best[gone:] + [-math.inf] * gone
            count[:] = count[gone:] + [0] * gone
            ends_unknown[:] = ends_unknown[gone:] + [False] * gone
            return base + gone

        for end, (length, score) in self.automaton.iter(word):
            while at < end:
                if not single:
                    unknown(at - base, word[at])
                at, single = at + 1, False
                if at - base == span:
                    base = move_on()
            to = end + 1 - base
            score += best[to - length]
            if score > best[to]:
                best[to], count[to], ends_unknown[to] = score, count[to - length] + 1, False
            single = single or length == 1
        while at < n:
            if not single:
                unknown(at - base, word[at])
            at, single = at + 1, False
            if at - base == span and at < n:
                base = move_on()
        return count[n - base], best[n - base]

    def text(self, text: str) -> tuple[int, int, float]:
        """(tokens, words, score)."""
        if not text:
            return 0, 0, 0.0
        words = text.replace(" ", META).split(META)
        if text[0] in (" ", META):
            del words[0]
        young, tokens, total = self.young, 0, 0.0
        for w in words:
            got = young.get(w)
            if got is None:
                got = self.old.get(w) or self.word(META + w)
                if len(w) <= CACHED_LENGTH:
                    young[w] = got
            tokens += got[0]
            total += got[1]
        if len(young) > self.half:
            self.old, self.young = young, {}
        return tokens, len(words), total


_COUNTERS: dict[str, ViterbiCounter] = {}


def counter(model_file: str) -> ViterbiCounter:
    """One counter per Python worker and file."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = ViterbiCounter(zipf_vocabulary(model_file))
    return _COUNTERS[model_file]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """id, n_tokens, n_words (pre-tokens), log_prob of the best segmentation; one row per input row."""
    told = df.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file or default_model()).text
        for batch in batches:
            found = [count(t) for _, texts in portions(batch) for t in texts]
            if found:
                tokens, words, score = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64()), pa.array(score, pa.float64())],
                    names=["id", "n_tokens", "n_words", "log_prob"])

    return told.mapInArrow(run, StructType([
        StructField("id", told.schema["id"].dataType), StructField("n_tokens", LongType()), StructField("n_words", LongType()),
        StructField("log_prob", DoubleType())]))


def q_token_counts(spark, sf_dir) -> DataFrame:
    from quire.session import table

    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
