"""Ranked lexical search: item-vocabulary tiles times document-impact tiles, multiplied in float64.

Terms are the maximal runs of ASCII letters and digits and of all characters from U+0080 on, A-Z lower-cased.
One pass over the documents counts, in each task, the terms that occur in the items; what is stored per
document is its length and its counted item terms, and per task the document frequencies, so the text is
read once and never shuffled.  Document frequencies, the document count and the total length come from those
per-task sums.  Then the stored documents pass in tiles: a tile's impacts (weight times the saturated
frequency, whole numbers) fill a dense matrix over a tile of the items' compact vocabulary, and one BLAS product
with the items' counts gives all partial scores.  Before each product its sums are bounded; below 2 ** 53
they are exact in float64, else the tile is cut in two, down to one term in 64-bit integers.  Partial
scores are added as 64-bit integers.  A task keeps each item's ``k`` best so far (equal scores by smaller
identifier) and emits only those, so what is shuffled is at most k rows per item and task.

Items are taken in parts of about ``PART_BYTES`` of text (or one longer item): a part's vocabulary is the
only thing that the driver sees and the tasks receive, and every part is one pass over the documents.

Defined results: null text has no term; an item or document without a term gets or gives nothing; repeated item
rows are each ranked; repeated documents are documents like any other; identifiers of documents are cast to
long, null ones come last among equal scores; very long texts are counted in stretches; an empty table on
either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import text_of
from quire.session import cut_lineage

K = 20
PART_BYTES = 2_000_000
STRETCH = 1_000_000     # bytes of a text whose terms are in memory at once, about
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 1024, 2048, 256
EXACT = 1 << 52  # half of what float64 holds exactly, as the bound itself is rounded
NO_ID = np.iinfo(np.int64).max

# Term bytes: ASCII digits and letters, and every byte of a character from U+0080 on; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def stretches(raw: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The terms of a text in order, a bounded number at a time (a term is never cut)."""
    flat, at = raw.translate(_FOLD), 0
    while at < len(flat):
        end = flat.find(b" ", at + size)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def counted(text: str) -> tuple[int, Counter]:
    """Number of terms and the count of each."""
    n, counts = 0, Counter()
    for terms in stretches(text.encode("utf-8", "surrogatepass")):
        n += len(terms)
        counts.update(terms)
    return n, counts


class Items:
    """A part of the items: their compact vocabulary and, per item, term numbers and counts."""

    def __init__(self, rows: list[tuple[int, str]], tile: int):
        self.row, self.tile = [r for r, _ in rows], tile
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.counts = [], []
        for _, text in rows:
            found = counted(text)[1]
            self.terms.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found], dtype=np.int64))
            self.counts.append(np.array(list(found.values()), dtype=np.int64))

    def tiles(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first item, items, sorted term numbers, item, column, count) of every tile of items."""
        for first in range(0, len(self.row), self.tile):
            part = self.terms[first:first + self.tile]
            own, column = np.unique(np.concatenate(part), return_inverse=True)
            item = np.repeat(np.arange(len(part)), [len(t) for t in part])
            yield first, len(part), own, item, column, np.concatenate(self.counts[first:first + self.tile])


def count_documents(docs: DataFrame, items: Items) -> DataFrame:
    """Stored rows: per document with an item term (part 0) id, n, idx, tf; per task (part 1)
    n documents with a term, their total length, and the document frequency tf of term idx."""
    vocabulary = items.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(len(vocabulary), np.int64)
        with_terms = length = 0

        def rows(part: int, ids: pa.Array, n: list, total: list, idx: list, tf: list) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, idx)]).astype(np.int32)
            flat = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.zeros(0), kind)
            return pa.RecordBatch.from_arrays([
                pa.array([part] * len(n), pa.int32()), ids, pa.array(n, pa.int64()), pa.array(total, pa.int64()),
                pa.ListArray.from_arrays(ends, flat(idx, pa.int32())), pa.ListArray.from_arrays(ends, flat(tf, pa.int64()))],
                names=["part", "id", "n", "total", "idx", "tf"])

        for batch in batches:
            # A part of the batch ends where its counted terms are many.
            at, n, idx, tf, held = [], [], [], [], 0
            for i in range(batch.num_rows):
                many, counts = counted(batch.column(1)[i].as_py())
                with_terms += many > 0
                length += many
                hit = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                if not hit:
                    continue
                pair = np.array(hit, dtype=np.int64)
                frequency[pair[:, 0]] += 1
                at.append(i)
                n.append(many)
                idx.append(pair[:, 0])
                tf.append(pair[:, 1])
                held += len(hit)
                if held > 1_000_000:
                    yield rows(0, batch.column(0).take(pa.array(at)), n, [0] * len(n), idx, tf)
                    at, n, idx, tf, held = [], [], [], [], 0
            if at:
                yield rows(0, batch.column(0).take(pa.array(at)), n, [0] * len(n), idx, tf)
        seen = np.flatnonzero(frequency)
        yield rows(1, pa.nulls(1, pa.int64()), [with_terms], [length], [seen], [frequency[seen]])

    schema = "part int, id long, n long, total long, idx array<int>, tf array<long>"
    return cut_lineage(docs.mapInArrow(run, schema), partition_by=("part",))


def exact_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right for non-negative whole numbers in float64, as 64-bit integers: one BLAS product
    where every sum is provably below 2 ** 53, else the sum of the products of both halves."""
    if not left.shape[1]:
        return np.zeros((left.shape[0], right.shape[1]), dtype=np.int64)
    if (left @ right.max(axis=1, initial=0.0)).max(initial=0.0) < EXACT:
        return (left @ right).astype(np.int64)
    if left.shape[1] == 1:
        return left.astype(np.int64) * right.astype(np.int64)
    half = left.shape[1] // 2
    return exact_product(left[:, :half], right[:half]) + exact_product(left[:, half:], right[half:])


class Ranking:
    """The ``k`` best documents of every item so far, equal scores by smaller identifier."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * n_items
        self.id = [np.zeros(0, np.int64)] * n_items
        self.known = [np.zeros(0, bool)] * n_items
        self.least = np.ones(n_items, np.int64)  # a score below this changes nothing

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """``scores``: items from ``first`` on by documents of a tile."""
        need = self.least[first:first + len(scores)]
        for i in np.flatnonzero(scores.max(axis=1, initial=0) >= need):
            at = np.flatnonzero(scores[i] >= need[i])
            if len(at) > self.k:  # all that reach the k-th score, ties included
                s = scores[i, at]
                at = at[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
            j = first + i
            score, id = np.concatenate([self.score[j], scores[i, at]]), np.concatenate([self.id[j], ids[at]])
            known_ = np.concatenate([self.known[j], known[at]])
            order = np.lexsort((id, ~known_, -score))[: self.k]
            self.score[j], self.id[j], self.known[j] = score[order], id[order], known_[order]
            if len(order) == self.k:
                self.least[j] = self.score[j][-1]


def rank_documents(stored: DataFrame, items: Items, n_docs: int, total: int, weight: np.ndarray, k: int) -> DataFrame:
    """item (number in ``items``), id, score: the best ``k`` of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Ranking(len(items.row), k)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                tile = batch.slice(start, TILE_DOCS)
                known = tile.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = tile.column(0).fill_null(NO_ID).to_numpy()
                n = tile.column(1).to_numpy()
                many = np.diff(tile.column(2).offsets.to_numpy())
                idx, tf = tile.column(2).flatten().to_numpy().astype(np.int64), tile.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), many)
                norm = 100 - 25 + (25 * n * n_docs) // total
                impact = weight[idx] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[doc]))
                order = np.argsort(idx, kind="stable")
                idx, doc, impact = idx[order], doc[order], impact[order]
                for first, n_items, own, item, column, count in items.tiles():
                    scores = np.zeros((n_items, len(n)), np.int64)
                    here = own[np.isin(own, idx)]  # columns that neither side has are left out
                    place = np.searchsorted(here, own)
                    there = np.isin(own, here)
                    for c in range(0, len(here), TILE_TERMS):
                        cols = here[c:c + TILE_TERMS]
                        a, b = np.searchsorted(idx, cols[0]), np.searchsorted(idx, cols[-1], side="right")
                        at = np.minimum(np.searchsorted(cols, idx[a:b]), len(cols) - 1)
                        mine = cols[at] == idx[a:b]
                        right = np.zeros((len(cols), len(n)))
                        right[at[mine], doc[a:b][mine]] = impact[a:b][mine]
                        left = np.zeros((n_items, len(cols)))
                        p = place[column] - c
                        mine = there[column] & (p >= 0) & (p < len(cols))
                        left[item[mine], p[mine]] = count[mine]
                        scores += exact_product(left, right)
                    best.add(first, scores, ids, known)
        many = [len(s) for s in best.score]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(many)), many)),
            pa.array(np.concatenate(best.id), mask=~np.concatenate(best.known)), pa.array(np.concatenate(best.score))],
            names=["item", "id", "score"])

    return stored.where("part = 0").select("id", "n", "idx", "tf").mapInArrow(run, "item long, id long, score long")


def search(documents: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    asked = cut_lineage(items.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{item_col}`").alias("item_id"),
                                     text_of(F.col(f"`{item_text}`")).alias("text")))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // PART_BYTES + 1
    found = spark.createDataFrame([], "row long, doc_id long, score long")
    for p in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == p).select("row", "text").orderBy("row").collect()
        part = Items([(r["row"], r["text"]) for r in rows], TILE_ITEMS)
        if not part.vocabulary:
            continue
        stored = count_documents(docs, part)
        sums = stored.where("part = 1")
        n_docs, total = sums.agg(F.sum("n"), F.sum("total")).first()
        if not total:
            continue
        weight = np.zeros(len(part.vocabulary), np.int64)
        pairs = sums.select(F.explode(F.arrays_zip("idx", "tf")).alias("e")).groupBy("e.idx").agg(F.sum("e.tf").alias("df"))
        for r in pairs.collect():
            weight[r["idx"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        ranked = rank_documents(stored, part, n_docs, total, weight, k)
        names = spark.createDataFrame([(i, r) for i, r in enumerate(part.row)], "item long, row long")
        found = found.unionByName(ranked.join(F.broadcast(names), "item").select("row", F.col("id").alias("doc_id"), "score"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score"))


def q_lexical_search(spark, sf_dir) -> DataFrame:
    from quire.session import table

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_LEXICAL_SEARCH = r"""
WITH found AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), docs AS (SELECT d, doc_id, terms, len(terms) AS n FROM found WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM docs),
asked AS (
  SELECT r, item_id, term, count(*) AS q FROM (
    SELECT row_number() OVER () AS r, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
  GROUP BY r, item_id, term
), tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term
), impacts AS (
  SELECT tf.d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l))) AS impact
  FROM tf JOIN docs USING (d) JOIN weights USING (term), total
), scores AS (
  SELECT r, item_id, d, doc_id, sum(q * impact)::BIGINT AS score
  FROM asked JOIN impacts USING (term) GROUP BY r, item_id, d, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scores WHERE score > 0)
WHERE rank <= 20
"""
