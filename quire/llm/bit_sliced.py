"""Exact top-k inner products over a bit-sliced index.

Every vector entry becomes x = floor(1024 * c).  Rows are packed into blocks; a block stores, per
attribute, the ``SLICES`` most significant bits of its x (one shift for the whole block) as bitmaps
over the rows: the bit-sliced index.  A query is a weight per attribute.  Its weighted sum over the
quantised attributes is formed for all rows of a block at once with bitmap arithmetic: each weight is
written with digits -1, 0, 1 (no two neighbours set), the shifted slices are added by carry-save
adders, and a negative term is the complement plus a constant.  The k-th largest sum is read from the
most significant slice downward.  The cut-off bits change a score by a known amount at most, so the rows
whose sum lies within that amount of the k-th are the boundary; only they are scored exactly, and
the best of them (with the best of earlier blocks) stay.  Nothing is approximate in the result.

Queries come in tiles, blocks in groups; every (tile, group) is one unit of work that emits at most
k rows per query.  The number of units follows the data; a copied vector only makes more boundary
rows in its own block, which is bounded.  Stored tables are in the shared folder.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite number or one of
2 ** 43 or more take no part; of two vectors the shorter counts as filled up with zeros; a query's own
row is left out, another row with the same identifier is not; rows repeated in full are candidates and
queries like any other; equal scores go to the smaller identifier, null identifiers last (a null one
is no query); scores beyond 64 bits rank by their full value and
are given as the largest or smallest long; an empty table gives no rows; other columns
are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.vectors import matrix, usable_rows
from quire.session import cut_lineage

K = 10
EVERY = 100         # queries are the rows whose identifier is divisible by this
SLICES = 8          # bits kept per attribute, the sign included
BLOCK_ROWS = 8192
TILE_QUERIES = 4096
GROUP_BLOCKS = 4
LIMB = 62           # bits of a score's lower part
NO_ID = np.iinfo(np.int64).max  # sorts null identifiers last

INDEX_SCHEMA = "block long, n int, width int, shift int, queries int, id binary, known binary, row binary, x binary, slices binary"


def bit_slices(x: np.ndarray) -> tuple[int, np.ndarray]:
    """(shift, bitmaps [attribute, slice, word]) of the values' upper bits, offset to be unsigned."""
    n, width = x.shape
    bits = int(np.abs(x).max(initial=0)).bit_length() + 1
    shift = max(0, bits - SLICES)
    u = (np.floor(np.ldexp(x, -shift)) + (1 << (SLICES - 1))).astype(np.uint64)
    words = -(-n // 64)
    on = np.zeros((width, SLICES, words * 64), dtype=np.uint8)
    for s in range(SLICES):
        on[:, s, :n] = ((u >> np.uint64(s)) & np.uint64(1)).T
    return shift, np.packbits(on, axis=2, bitorder="little").view(np.uint64)


def signed_digits(weight: int) -> list[tuple[int, int]]:
    """(power, sign) of a whole number's digits -1, 0, 1 with no two neighbours set."""
    out, power = [], 0
    while weight:
        if weight & 1:
            digit = 2 - (weight & 3)
            out.append((power, digit))
            weight -= digit
        weight >>= 1
        power += 1
    return out


def added(columns: list[list[np.ndarray]]) -> list[np.ndarray | None]:
    """Bitmaps by power of two -> one bitmap per power with the same sum (carry-save adders)."""
    out = []
    for j in range(10 ** 9):
        if j == len(columns):
            return out
        col = columns[j]
        while len(col) > 1:
            if j + 1 == len(columns):
                columns.append([])
            a, b = col.pop(), col.pop()
            half, carry = a ^ b, a & b
            if col:
                c = col.pop()
                carry |= half & c
                half ^= c
            col.append(half)
            columns[j + 1].append(carry)
        out.append(col[0] if col else None)


class Query:
    """A query's weights as signed digits, and the constants of its sums."""

    def __init__(self, q: np.ndarray):
        self.q = q
        whole = [int(v) for v in q]
        self.terms = [(d, p, s) for d, w in enumerate(whole) for p, s in signed_digits(w)]
        self.top = max((p for _, p, _ in self.terms), default=0)
        self.plus, self.minus = sum(w for w in whole if w > 0), sum(w for w in whole if w < 0)
        # A negative digit takes the complement, 2 ** SLICES - 1 - u; the offset of u is 2 ** (SLICES - 1).
        self.constant = sum(((1 << SLICES) - 1) << p for _, p, s in self.terms if s < 0) + (sum(whole) << (SLICES - 1))
        self.most = max((abs(w) for w in whole), default=0)

    def sums(self, slices: np.ndarray, complement: np.ndarray) -> list[np.ndarray]:
        """Slices of the weighted sum of the quantised attributes plus ``constant``."""
        columns: list[list[np.ndarray]] = [[] for _ in range(self.top + 1)]
        for d, p, s in self.terms:
            columns[p].append(slices[d] if s > 0 else complement[d])
        wide = added(columns)
        single: list[list[np.ndarray]] = [[] for _ in range(len(wide) + SLICES)]
        for p, layer in enumerate(wide):
            if layer is not None:
                for s in range(SLICES):
                    single[p + s].append(layer[s])
        zero = np.zeros(slices.shape[2], dtype=np.uint64)
        return [zero if b is None else b for b in added(single)]


def kth_largest(sums: list[np.ndarray], live: np.ndarray, k: int) -> int | None:
    """The k-th largest sum of the live rows, read from the most significant slice downward."""
    if int(np.bitwise_count(live).sum()) < k:
        return None
    value, equal = 0, live
    for i in range(len(sums) - 1, -1, -1):
        hit = equal & sums[i]
        n = int(np.bitwise_count(hit).sum())
        if n >= k:
            value |= 1 << i
            equal = hit
        else:
            k -= n
            equal = equal & ~sums[i]
    return value


def at_least(sums: list[np.ndarray], live: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of the live rows whose sum is ``least`` or more."""
    if least <= 0:
        return live
    if least >> len(sums):
        return np.zeros_like(live)
    above, equal = np.zeros_like(live), live
    for i in range(len(sums) - 1, -1, -1):
        if least >> i & 1:
            equal = equal & sums[i]
        else:
            above |= equal & sums[i]
            equal = equal & ~sums[i]
    return above | equal


def exact_scores(x: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole inner products as (upper, lower ``LIMB`` bits): in doubles or 64-bit integers where these are
    provably exact, else in Python's integers."""
    bound = most * int(np.abs(x).max(initial=0)) * max(1, len(q))
    if bound < 1 << 53:
        score = (x @ q).astype(np.int64)
    elif bound < 1 << 63:
        score = x.astype(np.int64) @ q.astype(np.int64)
    else:
        weight = [int(v) for v in q]
        score = np.array([sum(int(a) * b for a, b in zip(row, weight)) for row in x], dtype=object)
    return (score >> LIMB).astype(np.int64), (score & ((1 << LIMB) - 1)).astype(np.int64)


class Block:
    """One block of the index as a task reads it back."""

    def __init__(self, row: dict):
        n, width = row["n"], row["width"]
        self.n, self.width, self.shift = n, width, row["shift"]
        self.id, self.row = (np.frombuffer(row[c], dtype=np.int64) for c in ("id", "row"))
        self.known = np.frombuffer(row["known"], dtype=bool)
        self.x = np.frombuffer(row["x"], dtype=np.float64 if len(row["x"]) == 8 * n * width else np.int16).reshape(n, width)
        self.slices = np.frombuffer(row["slices"], dtype=np.uint64).reshape(width, SLICES, -1)
        self.complement = ~self.slices
        self.live = np.packbits(np.arange(self.slices.shape[2] * 64) < n, bitorder="little").view(np.uint64)

    def boundary(self, query: Query, own: int, k: int, least: int | None) -> np.ndarray:
        """Positions of the rows that can be among the k best, given the k-th best score so far."""
        live = self.live
        at = np.flatnonzero(self.row == own)
        if len(at):
            live = live.copy()
            live[at[0] // 64] &= ~np.uint64(1 << int(at[0] % 64))
        sums, lost = query.sums(self.slices, self.complement), (1 << self.shift) - 1
        bound = 0
        if (kth := kth_largest(sums, live, k)) is not None:
            bound = kth - ((query.plus - query.minus) * lost >> self.shift)
        if least is not None:
            bound = max(bound, -((query.plus * lost - least) >> self.shift) + query.constant)
        bits = np.unpackbits(at_least(sums, live, bound).view(np.uint8), bitorder="little")
        return np.flatnonzero(bits)


class Best:
    """The k best rows of a query so far: scores in two limbs, identifiers, whether they are known, row numbers."""

    def __init__(self, k: int):
        self.k = k
        self.high = self.low = self.id = self.row = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def least(self) -> int | None:
        return (int(self.high[-1]) << LIMB) + int(self.low[-1]) if len(self.row) == self.k else None

    def add(self, score: tuple[np.ndarray, np.ndarray], id: np.ndarray, known: np.ndarray, row: np.ndarray) -> None:
        new = (*score, id, known, row)
        high, low, id, known, row = (np.concatenate(pair) for pair in zip((self.high, self.low, self.id, self.known, self.row), new))
        order = np.lexsort((row, id, ~known, -low, ~high))[: self.k]
        self.high, self.low, self.id, self.known, self.row = (v[order] for v in (high, low, id, known, row))


def bit_sliced_index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY) -> DataFrame:
    """The stored index: one row per block, with its identifiers, exact values and slices."""
    rows = usable_rows(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = matrix(t["vec"].combine_chunks())
            known = t["id"].is_valid().to_numpy(zero_copy_only=False)
            ids = t["id"].fill_null(NO_ID).to_numpy().astype(np.int64)
            row = t["row"].to_numpy().astype(np.int64)
            shift, slices = bit_slices(x)
            kept = x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x
            return pa.RecordBatch.from_pylist([{
                "block": int(row[0]), "n": len(x), "width": x.shape[1], "shift": shift,
                "queries": int((known & (ids % every == 0)).sum()), "id": ids.tobytes(), "known": known.tobytes(),
                "row": row.tobytes(), "x": np.ascontiguousarray(kept).tobytes(), "slices": slices.tobytes()}],
                schema=pa.schema([("block", pa.int64()), *[(c, pa.int32()) for c in ("n", "width", "shift", "queries")],
                                  *[(c, pa.binary()) for c in ("id", "known", "row", "x", "slices")]]))

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK_ROWS - sum(b.num_rows for b in held))
                held.append(part)
                batch = batch.slice(part.num_rows)
                if sum(b.num_rows for b in held) == BLOCK_ROWS:
                    yield block()
                    held = []
        if held:
            yield block()

    return cut_lineage(rows.mapInArrow(blocks, INDEX_SCHEMA))


def top_k(index: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose identifier is divisible by ``every``
    the ``k`` other rows with the highest inner product."""
    found = index.agg(F.count(F.lit(1)), F.sum("queries")).first()
    n_blocks, n_queries = found[0], found[1] or 0
    tiles, groups = max(1, -(-n_queries // TILE_QUERIES)), max(1, -(-n_blocks // GROUP_BLOCKS))
    every_one = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    # A unit's rows: first the blocks that hold its queries, then the blocks to search.
    tile, group = F.pmod(F.xxhash64("block"), F.lit(tiles)), F.pmod(F.xxhash64("block", F.lit(1)), F.lit(groups))
    asked = index.where("queries > 0").select(
        tile.alias("tile"), every_one(groups).alias("group"), F.lit(0).alias("kind"), "*")
    held = index.select(
        every_one(tiles).alias("tile"), group.alias("group"), F.lit(1).alias("kind"), "*")
    asked = asked.withColumn("slices", F.lit(b""))  # queries need the values only
    units = asked.unionByName(held).repartition(tiles * groups, "tile", "group").sortWithinPartitions("tile", "group", "kind", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, queries = None, []

        def results() -> pa.RecordBatch:
            best = [b for *_, b, _ in queries]
            many = [len(b.row) for b in best]
            cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([q[0] for q in queries], np.int64), many)),
                pa.array(np.repeat(np.array([q[1] for q in queries], np.int64), many)),
                pa.array(cat([b.row for b in best], np.int64)),
                pa.array(cat([b.id for b in best], np.int64), mask=~cat([b.known for b in best], bool)),
                pa.array(cat([b.high for b in best], np.int64)), pa.array(cat([b.low for b in best], np.int64))],
                names=["query_row", "query_id", "row", "vec_id", "high", "low"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (r["tile"], r["group"]) != unit:
                    if queries:
                        yield results()
                    unit, queries = (r["tile"], r["group"]), []
                if r["kind"] == 0:
                    block = Block(r | {"slices": bytes(8 * SLICES * r["width"])})
                    for p in np.flatnonzero(block.known & (block.id % every == 0)):
                        queries.append((int(block.row[p]), int(block.id[p]), block.x[p].astype(np.float64), Best(k), {}))
                    continue
                block = Block(r)
                for own, _, q, best, made in queries:
                    width = min(len(q), block.width)
                    if width not in made:
                        made[width] = Query(q[:width])
                    query = made[width]
                    at = block.boundary(query, own, k, best.least())
                    if len(at):
                        x = block.x[at, :width].astype(np.float64)
                        best.add(exact_scores(x, query.q, query.most), block.id[at], block.known[at], block.row[at])
        if queries:
            yield results()

    local = units.mapInArrow(search, "query_row long, query_id long, row long, vec_id long, high long, low long")
    order = Window.partitionBy("query_row").orderBy(F.desc("high"), F.desc("low"), F.asc_nulls_last("vec_id"), "row")
    top = 1 << (63 - LIMB)  # upper parts from -top to top - 1 are those of 64-bit scores
    score = (F.when(F.col("high") >= top, F.lit(2 ** 63 - 1)).when(F.col("high") < -top, F.expr("-9223372036854775807L - 1L"))
             .otherwise(F.shiftleft("high", LIMB).bitwiseOR(F.col("low"))))
    return (local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", score.alias("score")))


def q_vector_search(spark, sf_dir) -> DataFrame:
    from quire.session import table

    return top_k(bit_sliced_index(table(spark, sf_dir, "embeddings")))


SQL_VECTOR_SEARCH = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, [floor(1024 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
WHERE rank <= 10
"""
