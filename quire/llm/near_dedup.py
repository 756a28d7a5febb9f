"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text is a weighted set: its five-word shingles, each weighing 1 + ln(occurrences).  The
similarity of two texts is the probability Jaccard of these sets, which is the plain Jaccard
where no shingle repeats.  Texts are linked at 0.8 or more; a class is a connected component.

Signature: every shingle is a Poisson process whose rate is its weight and whose arrivals fall
on random signature positions; a position keeps the shingle that arrives first.  A shingle's
arrivals stop as soon as they are later than the latest first arrival of all positions.  Two
signatures agree in a position with exactly the probability Jaccard as probability.  192
positions make 32 bands of 6; at 0.8 a pair shares no band with probability 6e-5.

Candidates: texts that are equal word for word collapse first; only one row of each enters the
bands.  Every text is first compared with one pivot, the first text (in a fixed random order) of any
bucket it is in, which joins most copies at a cost linear in their number.  Where the classes found
so far still differ within a bucket, its rows are compared in blocks of bounded size, cut within a class
where it is large: one unit of work is a pair of blocks of different classes, and only links that join
classes come out of it, never a list of pairs.  So every pair that shares a bucket and could join two
classes is judged, and a group with a third of all rows is many units of equal size.
Links, labels and members stay in distributed tables, written to the shared folder.

Defined results: null text is empty text; texts without a word are equal to each other; a text
of under five words is one shingle; very long texts are hashed in windows and their shingles arrive in
stretches, so only a few words' worth of numbers per word is held; rows repeated in full are members like any other; the class
id is the smallest identifier in the class (null when it has none); ``kept`` is true for exactly
one row of each class, the one with that identifier; an empty table gives an empty result; the
input columns travel in one struct, so their names never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quire.functions.joins import broadcast_if_small
from quire.llm.batches import portions
from quire.llm.shingles import mix64, probability_jaccard, shingles, weights
from quire.llm.text import text_of
from quire.session import cut_lineage

THRESHOLD = 0.8
EPS = 1e-9  # rounding of a similarity that is exactly at the threshold
BANDS, ROWS = 32, 6
BLOCK_ROWS, BLOCK_BYTES = 512, 16 * 1024 * 1024  # of a bucket's blocks, about
COLUMNS = 8192  # shingles per matrix product
STRETCH = 1 << 17  # shingles whose arrivals are simulated together
PORTION_ROWS = 1024  # texts whose signatures are made together
_U = np.uint64


def prob_minhash(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) signatures: per position the element that arrives first.

    Elements (in the order of their documents) come in stretches; later ones start with the first arrivals
    of the earlier ones, so a long text's processes stop after few arrivals and its arrays stay small."""
    first = np.full(n_docs * k, np.inf)
    sig = np.zeros(n_docs * k, dtype=np.uint64)
    for at in range(0, len(elem), STRETCH):
        part = slice(at, at + STRETCH)
        base = int(doc[at])
        top = int(doc[min(at + STRETCH, len(doc)) - 1]) + 1
        _arrivals(doc[part] - base, elem[part], weight[part], first[base * k:top * k], sig[base * k:top * k], k)
    return sig.reshape(n_docs, k)


def _arrivals(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, first: np.ndarray, sig: np.ndarray, k: int) -> None:
    """Let the elements arrive: ``first`` and ``sig`` (per document and position) are updated in place."""
    live = np.arange(len(elem))
    time = np.zeros(len(elem))
    arrival = 0
    while len(live):
        # Few live elements take several arrivals at once; extra ones are too late to matter.
        many = 1 if len(live) > 20_000 else 8
        steps = (np.arange(arrival, arrival + many, dtype=np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03)
        r = mix64(elem[live][:, None] + steps[None, :])
        gap = -np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / weight[live][:, None]
        at = time[live][:, None] + np.cumsum(gap, axis=1)
        pos = doc[live][:, None] * k + (mix64(r ^ _U(0xA0761D6478BD642F)) % _U(k)).astype(np.int64)
        np.minimum.at(first, pos.ravel(), at.ravel())
        won = first[pos] == at
        sig[pos[won]] = np.broadcast_to(elem[live][:, None], pos.shape)[won]
        latest = first.reshape(-1, k).max(axis=1)
        time[live] = at[:, -1]
        live = live[at[:, -1] < latest[doc[live]]]
        arrival += many


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys; the band number is part of the key."""
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(0xE7037ED1A0B428DB), (len(sig), bands)).copy()
    for r in range(rows):
        acc = mix64(acc + sig[:, r::rows][:, :bands] * _U(2 * r + 3))
    return acc.view(np.int64)


def signatures(df: DataFrame, text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One stored row per input row: row (unique), digest of its words, band keys (null without a word), doc."""
    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    told = df.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc"))
    text_at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, sizes = [], [], []
            # The text is read from the row itself, so it crosses to this worker once.
            told_text = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).field(text_at).cast(pa.string())], names=["row", "text"])
            for _, texts in portions(told_text, max_rows=PORTION_ROWS):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                digests += [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in raw]
                at, elem, count = shingles(raw)
                has = np.bincount(at, minlength=len(raw)) > 0
                dense = np.cumsum(has) - 1
                sig = prob_minhash(dense[at], elem, weights(count), int(has.sum()), bands * rows)
                keys.append(band_keys(sig, bands, rows).ravel())
                sizes.append(has)
            if not sizes:
                continue
            has = np.concatenate(sizes)
            ends = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), lists, batch.column(1)], names=["row", "digest", "bands", "doc"])

    schema = StructType([StructField("row", LongType()), StructField("digest", BinaryType()),
                         StructField("bands", ArrayType(LongType())), StructField("doc", told.schema["doc"].dataType)])
    return cut_lineage(told.mapInArrow(run, schema))


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, sim of the pairs; ``texts`` has row and text."""
    both = (pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                raw = [(t or "").encode("utf-8", "surrogatepass") for c in (2, 3) for t in part.column(c).to_pylist()]
                at, elem, count = shingles(raw)
                cut, heavy = np.searchsorted(at, np.arange(len(raw) + 1)), weights(count)
                n = part.num_rows
                for x in range(n):
                    p, q = slice(cut[x], cut[x + 1]), slice(cut[x + n], cut[x + n + 1])
                    sims.append(probability_jaccard(elem[p], heavy[p], elem[q], heavy[q]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return both.mapInArrow(run, "a long, b long, sim double")


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b); the label is the smallest node it is connected to.

    Smallest labels spread over the edges and along the labels themselves until nothing changes."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("told"))
        spread = cut_lineage(labels.join(told, "node").select("node", F.col("label").alias("old"), F.least("label", "told").alias("label")))
        if spread.where("old <> label").isEmpty():
            return labels
        on = spread.select(F.col("node").alias("via"), F.col("label").alias("on"))
        labels = cut_lineage(spread.join(on, F.col("label") == F.col("via")).select("node", F.least("label", "on").alias("label")))


def linked_pairs(text: list[bytes], bands: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, bucket: int,
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of different labels whose similarity reaches the threshold and whose
    first common band is ``bucket`` (so a pair that shares many buckets is judged in one of them).

    A common shingle adds at most min(x_i / X, y_i / Y) to the similarity; matrix products of the
    weights give that bound for all pairs at once, and only pairs above it are computed exactly."""
    at, elem, count = shingles(text)
    w = weights(count)
    n, total = len(text), np.bincount(at, w, len(text))
    plain = np.bincount(at, count > 1, n) == 0
    _, column = np.unique(elem, return_inverse=True)
    order = np.argsort(column, kind="stable")
    shared_x, shared_y = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    cuts = np.searchsorted(column[order], np.arange(0, column.max(initial=0) + 1 + COLUMNS, COLUMNS))
    for k, (p, q) in enumerate(zip(cuts, cuts[1:])):
        pick = order[p:q]
        heavy = np.zeros((n, COLUMNS), np.float32)
        heavy[at[pick], column[pick] - k * COLUMNS] = w[pick]
        here = (heavy > 0).astype(np.float32)
        shared_x += heavy[left] @ here[right].T
        shared_y += here[left] @ heavy[right].T
    bound = np.minimum(shared_x / total[left][:, None], shared_y / total[right][None, :])
    x, y = np.nonzero((bound >= threshold - 1e-4) & (label[left][:, None] != label[right][None, :]))
    same = bands[left[x]] == bands[right[y]]
    first = bands[left[x], same.argmax(axis=1)] == bucket
    x, y = x[first], y[first]
    # Without repeated shingles the similarity is the Jaccard of two counts.
    simple = plain[left[x]] & plain[right[y]]
    common = shared_x[x, y].astype(np.float64)
    sim = np.where(simple, common / (total[left[x]] + total[right[y]] - common), 0.0)
    cut = np.searchsorted(at, np.arange(n + 1))
    for k in np.flatnonzero(~simple):
        i, j = left[x[k]], right[y[k]]
        p, q = slice(cut[i], cut[i + 1]), slice(cut[j], cut[j + 1])
        sim[k] = probability_jaccard(elem[p], w[p], elem[q], w[q])
    good = sim >= threshold - EPS
    return left[x[good]], right[y[good]]


def joining(x: np.ndarray, y: np.ndarray, label: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (x, y) those that join two classes not yet joined by earlier ones: a spanning
    forest of the classes, so a unit of work gives fewer links than it has classes."""
    up: dict = {}

    def top(c):
        while c in up:
            c = up[c]
        return c

    kept = []
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        a, b = top(label[i]), top(label[j])
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(k)
    return x[kept], y[kept]


def with_blocks(members: DataFrame) -> DataFrame:
    """``members`` (bucket, row, label, size) with block and meets, the blocks that its rows are compared with.

    In every bucket a class of more than a block's rows or bytes has blocks of its own, cut by a hash of
    the row; smaller classes share blocks, cut by a hash of the class.  Blocks of one class never meet,
    so the work is linear in the rows as long as one class holds most of them."""
    n, size = F.count(F.lit(1)), F.sum("size")
    pieces = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    classes = cut_lineage(members.groupBy("bucket", "label").agg(n.alias("n"), size.alias("bytes")).withColumn("pieces", pieces))
    small = classes.where("pieces = 1").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select(
        "bucket", pieces.alias("shared"))
    # Only classes larger than a block are ordered here, so a bucket has few of them.
    before = Window.partitionBy("bucket").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    large = classes.where("pieces > 1").withColumn("from", F.coalesce(F.sum("pieces").over(before), F.lit(0)).cast("int")).select(
        "bucket", "label", "pieces", "from")
    total = large.groupBy("bucket").agg(F.sum("pieces").cast("int").alias("own"))
    told = (members.join(total, "bucket", "left").join(small, "bucket", "left").join(large, ["bucket", "label"], "left")
            .withColumn("shared", F.coalesce("shared", F.lit(0))))
    start = F.col("shared") + F.col("from")
    block = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("label"), F.col("shared"))).otherwise(
        start + F.pmod(F.xxhash64("row"), F.col("pieces"))).cast("int")
    every = F.sequence(F.lit(0), F.col("shared") + F.coalesce("own", F.lit(0)) - 1)
    others = F.filter(every, lambda k: F.col("pieces").isNull() | (k < start) | (k >= start + F.col("pieces")))
    return told.select("bucket", "row", "label", block.alias("block"), others.alias("meets"))


def compare_blocks(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b: the links between rows of different labels in each bucket.  ``members``: bucket, row, label, size;
    ``texts``: row, bands, text.  Every pair of blocks that can hold two classes is one unit of work, read in
    order by ``mapInArrow``; only links that join classes come out."""
    pair = F.transform("meets", lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    rows = with_blocks(members).join(texts, "row").select("bucket", F.explode(pair).alias("m"), "block", "row", "label", "bands", "text")
    rows = rows.select("bucket", "m.i", "m.j", "block", "row", "label", "bands", "text")

    def judge(key: tuple, rows: list[tuple]) -> tuple[list[int], list[int]]:
        bucket, i, j = key
        block, row, label, bands, text = zip(*rows)
        block, row = np.array(block), np.array(row)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        x, y = linked_pairs([t.encode("utf-8", "surrogatepass") for t in text], np.array(bands, dtype=np.int64), np.array(label), left, right,
                            bucket, threshold)
        x, y = joining(x, y, label)
        return np.minimum(row[x], row[y]).tolist(), np.maximum(row[x], row[y]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        a, b = [], []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                for r in zip(*part.values()):
                    if r[:3] != key:
                        if len(held) > 1:
                            x, y = judge(key, held)
                            a, b = a + x, b + y
                        key, held = r[:3], []
                    held.append(r[3:])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if len(held) > 1:
            a, b = judge(key, held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (rows.repartition(F.col("bucket"), F.col("i"), F.col("j")).sortWithinPartitions("bucket", "i", "j")
            .mapInArrow(run, "a long, b long"))


def link_members(members: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, label of the linked rows.  ``members``: bucket, row, size (bytes of its text); ``nodes``: row, bands, text.

    ``u`` is a node's place in the fixed random order that makes pivots."""
    u = F.xxhash64("row")
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(u.alias("u"), "row")).alias("pivot"))
    m = cut_lineage(members.join(size.where("n > 1"), "bucket").select("bucket", "row", "size", "pivot"))
    wanted = cut_lineage(nodes.join(m.select("row").distinct(), "row", "left_semi"))
    # Every row and the earliest pivot of its buckets.
    stars = m.groupBy("row").agg(F.min("pivot").alias("p")).where("p.row <> row").select(F.col("p.row").alias("a"), F.col("row").alias("b"))
    links = cut_lineage(similarities(stars, wanted).where(F.col("sim") >= threshold - EPS).select("a", "b"))
    now = cut_lineage(m.join(components(links).withColumnRenamed("node", "row"), "row", "left").select(
        "bucket", "row", "size", F.coalesce("label", "row").alias("label")))
    # Where a bucket's rows are of several classes, all pairs across classes are compared in blocks.
    mixed = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    open_rows = cut_lineage(now.join(mixed, "bucket").select("bucket", "row", "label", "size"))
    fresh = compare_blocks(open_rows, wanted, threshold)
    return components(cut_lineage(links.unionByName(fresh)))


def near_classes(sigs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``signatures``: row, id, class_id, class_size, kept."""
    first = F.struct(F.col(f"doc.`{id_col}`").isNull().alias("unknown"), F.col(f"doc.`{id_col}`").alias("id"), "row")
    distinct = cut_lineage(sigs.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")))
    nodes = distinct.select(F.col("first.row").alias("row"))
    text = text_of(F.col(f"doc.`{text_col}`"))
    members = (sigs.select("row", "bands", F.octet_length(text).cast("long").alias("size")).join(nodes, "row", "left_semi")
               .select("row", "size", F.explode("bands").alias("bucket")))
    labels = link_members(members, sigs.select("row", "bands", text.alias("text")), threshold)
    told = distinct.join(labels.withColumnRenamed("node", "at"), F.col("first.row") == F.col("at"), "left").select(
        "digest", "first", "n", F.coalesce("label", "first.row").alias("label"))
    classes = told.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    by_digest = told.select("digest", "label").join(classes, "label").select("digest", "first", "class_size")
    return sigs.select("row", "digest", F.col(f"doc.`{id_col}`").alias("id")).join(by_digest, "digest").select(
        "row", "id", F.col("first.id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` (all columns), one of each class.  Only the row numbers that go are joined with
    the stored rows: broadcast where they are measured to be few, else by a shuffle."""
    sigs = signatures(df, text_col)
    gone = cut_lineage(near_classes(sigs, id_col, text_col, threshold).where(~F.col("kept")).select("row"))
    return sigs.join(broadcast_if_small(gone), "row", "left_anti").select(*[F.col(f"doc.`{c}`").alias(c) for c in df.columns])


def q_near_dedup(spark, sf_dir) -> DataFrame:
    from quire.session import table

    found = near_classes(signatures(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
