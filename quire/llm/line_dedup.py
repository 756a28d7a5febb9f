"""Substring dedup by hashing lines and the sentences inside them.

Units of a text are its lines (split at line feeds) and, where a line has several, its sentences
(ended by ``. ! ?`` before a space or tab).  The query takes every line that holds a word, and every
sentence of at least ``MIN_CHARS`` characters: shorter pieces inside a line are mostly list numbers and
abbreviations.  Callers can set ``min_words`` (lines and sentences) and ``min_chars`` (sentences only).
A unit is normalised (lower case, white space runs to one space) and hashed to 128 bits.  Digests
are grouped globally; the earliest occurrence, by document id and then offset, stays and every
other one is removed.  Lines and sentences share one digest space, so a passage is found whether it
fills a line in one document or stands inside a line in another.  Spans keep their offsets in the
original text (code points, end exclusive); a sentence inside a removed line is not listed again.

Digest groups are reduced with a partial aggregate (smallest occurrence, count) and met again by a
sort-merge join whose hot partitions adaptive execution can split; no group is ever collected.

Defined results: null and empty texts have no units; a null document id ranks after all others;
rows repeated in full rank by their place in the table, so all but one lose their units; an empty
table gives no spans; very long texts are handled whole, one document at a time; only the id and
the text are read, and ``remove_repeats`` returns the input columns whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from quire.llm.batches import portions
from quire.llm.text import WS_CHARS, text_of
from quire.session import cut_lineage

MIN_WORDS = 1            # no line with a word is left out
MIN_CHARS = 12           # of a normalised sentence inside a line, in the query
_STOP = re.compile(r"[.!?]+(?=[ \t])")


def spans_of(text: str, min_words: int = MIN_WORDS, min_chars: int = 0) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(line start, start, end, digest, words) of the units; start == line start and end == line
    end for a line itself.  Spans leave out white space at both ends, except that a line's span
    starts and ends where the line does."""
    at = 0
    for line in text.split("\n"):
        words = _words(line)
        if words and len(words) >= min_words:
            yield at, at, at + len(line), _digest(words), len(words)
        cuts = [m.end() for m in _STOP.finditer(line)]
        if cuts and not line[cuts[-1]:].strip(WS_CHARS):
            cuts.pop()
        if cuts:
            for a, b in zip([0, *cuts], [*cuts, len(line)]):
                part = line[a:b]
                words = _words(part)
                if words and len(words) >= min_words and len(b" ".join(words).decode("utf-8", "surrogatepass")) >= min_chars:
                    lead = len(part) - len(part.lstrip(WS_CHARS))
                    yield at, at + a + lead, at + a + len(part.rstrip(WS_CHARS)), _digest(words), len(words)
        at += len(line) + 1


def _words(text: str) -> list[bytes]:
    """The lower-cased words; bytes split at ``[\x20\x09-\x0D]`` alone, as everywhere in this subpackage."""
    return text.lower().encode("utf-8", "surrogatepass").split()


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
          min_words: int = MIN_WORDS, min_chars: int = 0) -> DataFrame:
    """The stored unit occurrences: id, row (unique per input row), line, start, stop, words, digest."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    told = df.select(F.struct(F.col(id_col).alias("id"), row.alias("row")).alias("key"), text_of(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in portions(batch):
                source, found = [], []
                for i, text in enumerate(texts, at):
                    spans = list(spans_of(text, min_words, min_chars))
                    found += spans
                    source += [i] * len(spans)
                at += len(texts)
                if not found:
                    continue
                line, start, stop, digest, words = zip(*found)
                key = batch.column(0).take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [key.field("id"), key.field("row"), pa.array(line, pa.int32()), pa.array(start, pa.int32()),
                     pa.array(stop, pa.int32()), pa.array(words, pa.int32()), pa.array(digest, pa.binary())],
                    names=["id", "row", "line", "start", "stop", "words", "digest"])

    schema = StructType([StructField("id", told.schema["key"].dataType["id"].dataType), StructField("row", LongType()),
                         *[StructField(c, IntegerType()) for c in ("line", "start", "stop", "words")],
                         StructField("digest", BinaryType())])
    return cut_lineage(told.mapInArrow(run, schema))


def repeats(found: DataFrame) -> DataFrame:
    """The spans to remove: id, row, start, stop, words, digest, and the occurrence that stays
    (first.id, first.row, first.start) - one row per removed span, none inside another."""
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "row", "start", (-F.col("stop")).alias("end"))
    groups = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = found.join(groups, "digest").where((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))
    later = cut_lineage(later.select("id", "row", "line", "start", "stop", "words", "digest", "first", "copies"))
    # A line's own unit comes out of units() only where it is long enough, and ends at the line's end.
    ends = later.groupBy("row", "line").agg(F.max(F.when(F.col("start") == F.col("line"), F.col("stop"))).alias("upto"))
    inside = later.join(ends, ["row", "line"]).where(
        (F.col("start") == F.col("line")) & (F.col("stop") == F.col("upto"))
        | F.col("upto").isNull() | (F.col("stop") > F.col("upto")))
    return inside.select("id", "row", "start", "stop", "words", "digest", "first", "copies")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   min_chars: int = 0) -> DataFrame:
    """``df`` with the repeated spans cut out of the text column; all other columns unchanged.
    A line that was removed whole leaves its line feed."""
    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    stored = cut_lineage(df.select(doc.alias("doc"), F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"),
                                   F.monotonically_increasing_id().alias("row")))
    # A document's spans are bounded by its own length.
    cuts = repeats(units(stored, "id", "text", "row", min_words, min_chars)).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    kept = F.aggregate("cuts", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda a, c: F.struct(
        F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, c["start"] - a["at"])).alias("out"), c["stop"].alias("at")))
    cleaned = F.when(F.col("cuts").isNull(), F.col(f"doc.`{text_col}`")).otherwise(
        F.concat(kept["out"], F.substring(F.col("text"), kept["at"] + 1, F.length("text"))))
    joined = stored.join(cuts, "row", "left")
    return joined.select(*[(cleaned if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in df.columns])


def q_line_dedup(spark, sf_dir) -> DataFrame:
    from quire.session import table

    found = repeats(units(table(spark, sf_dir, "documents"), min_words=1, min_chars=MIN_CHARS))
    return found.select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("end"),
                        F.col("words").cast("long").alias("n_words"), F.col("first.id").alias("first_doc_id"),
                        F.col("first.start").cast("long").alias("first_start"), "copies", F.lower(F.hex("digest")).alias("digest"))
