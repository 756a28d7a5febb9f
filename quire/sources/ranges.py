"""Files read by byte range where records may hold line breaks: the state at a range's start is carried to it.

A file is cut into ranges of any size.  One job scans every range and reports what it does to the
parser's state; these effects, a few numbers per range, are composed in file order, so each range learns the
state it starts in.  A second job reads the ranges: a range owns the records that start in it and reads on
past its end until its last record is complete.  So one large file is many tasks, and every split size gives
the same records.

Two kinds of file are known.  Quoted tables: a record ends at a line feed outside quotes, and the state is the
parity of the quotes.  JSON: a record is an object directly in the outermost list (or at the top), and the state is
whether a string is open and how many brackets are; whether a quote is escaped is seen from the bytes before it.
Both look at ASCII bytes only, which UTF-8 never uses inside other characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 32 * 1024 * 1024
CHUNK = 4 * 1024 * 1024
_QUOTE, _LINE, _BACKSLASH = ord('"'), ord("\n"), ord("\\")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Any file system that Arrow knows, and the path in it; ``file:/x``, as Spark writes it, is local."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def open_file(path: str) -> pa.NativeFile:
    system, base = file_system(path)
    return system.open_input_file(base)


def list_ranges(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """path, start, end, size of all ranges of the files under ``path`` (their contents are not read)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))
    return files.select("path", F.explode(starts).alias("start"), "size").select(
        "path", "start", F.least(F.col("start") + split_bytes, "size").alias("end"), "size")


def tasks_for(spark: SparkSession, n: int) -> int:
    """One of ``n`` ranges per task, up to a bounded number of tasks."""
    return min(max(1, n), max(spark.sparkContext.defaultParallelism * 4, n // 16))


def chunks(file: pa.NativeFile, start: int, end: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(position, bytes) of the stretch, a bounded number at a time."""
    file.seek(start)
    at = start
    while end is None or at < end:
        data = file.read(CHUNK if end is None else min(CHUNK, end - at))
        if not data:
            return
        yield at, np.frombuffer(data, dtype=np.uint8)
        at += len(data)


# -- quoted tables ------------------------------------------------------------------------------------------------

def quote_parity(file: pa.NativeFile, start: int, end: int) -> int:
    return sum(int(np.count_nonzero(part == _QUOTE)) for _, part in chunks(file, start, end)) & 1


def table_records(file: pa.NativeFile, start: int, end: int, inside: bool) -> Iterator[bytes]:
    """The records that start in [start, end), without their line feed; ``inside``: a quote is open at ``start``."""
    begin = start  # of the record that is being read; None while it belongs to an earlier range
    if start:
        file.seek(start - 1)
        begin = start if not inside and file.read(1) == b"\n" else None
    held: list[bytes] = []
    open_quote = int(inside)
    for at, part in chunks(file, start, None):
        parity = np.bitwise_and(np.cumsum(part == _QUOTE) + open_quote, 1)
        cut = 0
        for p in np.flatnonzero((part == _LINE) & (parity == 0)):
            if begin is not None:
                yield b"".join([*held, part[cut:p].tobytes()])
            held, cut, begin = [], int(p) + 1, at + int(p) + 1
            if begin >= end:
                return
        if begin is None and at + len(part) >= end:
            return
        if begin is not None:
            held.append(part[cut:].tobytes())
        open_quote = int(parity[-1])
    if begin is not None and any(held):
        yield b"".join(held)


def fields(record: bytes, sep: bytes = b"\t") -> list[str | None]:
    """The fields of a record: quoted ones as they are inside the quotes, an empty bare one is null."""
    out, at = [], 0
    while True:
        if record[at:at + 1] == b'"':
            stop = at + 1
            while (stop := record.find(b'"', stop)) >= 0 and record[stop + 1:stop + 2] == b'"':
                stop += 2
            if stop < 0 or record[stop + 1:stop + 2] not in (b"", sep):
                raise ValueError(f"malformed quoted field: {record[at:at + 60]!r}")
            out.append(record[at + 1:stop].replace(b'""', b'"').decode("utf-8", "replace"))
            at = stop + 1
        else:
            stop = record.find(sep, at)
            stop = len(record) if stop < 0 else stop
            out.append(record[at:stop].decode("utf-8", "replace") or None)
            at = stop
        if at >= len(record):
            return out
        at += 1
        if at == len(record):
            return [*out, None]


# -- JSON ---------------------------------------------------------------------------------------------------------

def backslashes_before(file: pa.NativeFile, at: int) -> int:
    """Length of the run of backslashes that ends just before ``at``."""
    n = 0
    while at > 0:
        step = min(at, 4096)
        file.seek(at - step)
        data = file.read(step)
        run = len(data) - len(data.rstrip(b"\\"))
        n, at = n + run, at - step
        if run < step:
            break
    return n


_SIGN = np.zeros(256, bool)
_SIGN[[_QUOTE, *b"{}[]"]] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


def json_signs(part: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The quotes and brackets of the bytes: (positions, parity of the string quotes up to and including
    each, +1 / -1 per bracket, backslashes at the end of the bytes); ``run``: backslashes just before the bytes.
    Only these positions, and those of backslashes, are held besides the bytes."""
    at = np.flatnonzero(_SIGN[part])
    sign = part[at]
    real = sign == _QUOTE
    slash = np.flatnonzero(part == _BACKSLASH)
    if len(slash):
        order = np.arange(len(slash))
        starts = np.concatenate([[True], np.diff(slash) > 1])
        length = order - np.maximum.accumulate(np.where(starts, order, 0)) + 1  # of the run that ends at each backslash
        length += np.where(slash - length < 0, run, 0)  # a run from the first byte on goes on from before
        before = np.searchsorted(slash, at) - 1  # the last backslash before each sign
        touches = (before >= 0) & (slash[before] == at - 1)
        real &= ~(touches & (length[before] & 1 == 1))
    if run & 1 and len(at) and at[0] == 0:
        real[0] = False
    if len(slash) and slash[-1] == len(part) - 1:
        run = int(length[-1])
    else:
        run = 0
    return at, np.cumsum(real) & 1, _STEP[sign], run


def json_effect(file: pa.NativeFile, start: int, end: int) -> tuple[int, int, int, int]:
    """(string parity, bracket sum if no string is open at the start, if one is, first visible byte or 0)."""
    run, open_string, sums, first = backslashes_before(file, start), 0, [0, 0], 0
    for _, part in chunks(file, start, end):
        at, parity, step, run = json_signs(part, run)
        parity = parity ^ open_string
        sums[0] += int(step[parity == 0].sum())
        sums[1] += int(step[parity == 1].sum())
        if not first and part[seen := int(np.argmax(part > 32))] > 32:
            first = int(part[seen])
        if len(at):
            open_string = int(parity[-1])
    return open_string, sums[0], sums[1], first


def json_records(file: pa.NativeFile, start: int, end: int, inside: bool, depth: int, base: int) -> Iterator[bytes]:
    """The objects whose opening bracket, at depth ``base``, lies in [start, end)."""
    run, open_string = backslashes_before(file, start), int(inside)
    held: list[bytes] | None = None  # of an object that is being read
    for place, part in chunks(file, start, None):
        at, parity, step, run = json_signs(part, run)
        parity = parity ^ open_string
        outside = parity == 0
        level = depth + np.cumsum(np.where(outside, step, 0))  # after each sign
        sign = part[at]
        begins = at[outside & (sign == ord("{")) & (level == base + 1)]
        stops = at[outside & (sign == ord("}")) & (level == base)]
        begins = begins[place + begins < end]
        cut = 0
        if held is not None:
            if not len(stops):
                held.append(part.tobytes())
            else:
                cut = int(stops[0]) + 1
                yield b"".join([*held, part[:cut].tobytes()])
                held = None
        if held is None:
            begins = begins[begins >= cut]
            for b, k in zip(begins, np.searchsorted(stops, begins)):
                if k == len(stops):
                    held = [part[b:].tobytes()]
                    break
                yield part[b:int(stops[k]) + 1].tobytes()
        if held is None and place + len(part) >= end:
            return
        if len(at):
            depth, open_string = int(level[-1]), int(parity[-1])
    if held is not None:
        raise ValueError("the file ends inside a JSON object")


# -- the two jobs -------------------------------------------------------------------------------------------------

EFFECT = "path string, start long, end long, size long, flips int, outside long, inside long, first int"
STATE = "path string, start long, end long, open boolean, depth long, base int"


def start_states(ranges: DataFrame, kind: str, tasks: int) -> DataFrame:
    """STATE of every range: the effects are found in parallel and composed per file, in order."""
    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with open_file(r["path"]) as file:
                    got = json_effect(file, r["start"], r["end"]) if kind == "json" else (quote_parity(file, r["start"], r["end"]), 0, 0, 0)
                rows.append((*r.values(), *got))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in EFFECT.split(", ")])

    def compose(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("start")
        told, opened, depth = [], 0, 0
        visible = found["first"][found["first"] > 0]
        base = int(len(visible) and visible.iloc[0] == ord("["))
        for flips, outside, inside in zip(found["flips"], found["outside"], found["inside"]):
            told.append((bool(opened), depth))
            depth += inside if opened else outside
            opened ^= flips
        if opened or depth:
            raise ValueError(f"{found['path'].iloc[0]} ends inside a quoted field or a bracket")
        return pd.DataFrame({"path": found["path"], "start": found["start"], "end": found["end"], "open": [o for o, _ in told],
                             "depth": [d for _, d in told], "base": base})

    # a number of its own, or adaptive execution lets one task compose all files
    return ranges.repartition(tasks).mapInArrow(effects, EFFECT).repartition(tasks, "path").groupBy("path").applyInPandas(compose, STATE)


def read_records(spark: SparkSession, path: str, kind: str, split_bytes: int = SPLIT_BYTES, skip_first: bool = False, columns: int = 0) -> DataFrame:
    """The records of the files: ``value`` (JSON text), or for ``kind`` "table" the array ``fields``.
    ``skip_first`` leaves out each file's first record; a record with more than ``columns`` fields fails."""
    ranges = list_ranges(spark, path, split_bytes)
    tasks = tasks_for(spark, ranges.count())  # a range has one state, so the states need no count of their own
    states = start_states(ranges, kind, tasks).repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out, size = [], 0
                with open_file(r["path"]) as file:
                    found = (json_records(file, r["start"], r["end"], r["open"], r["depth"], r["base"]) if kind == "json"
                             else table_records(file, r["start"], r["end"], r["open"]))
                    for i, record in enumerate(found):
                        if skip_first and r["start"] == 0 and i == 0:
                            continue
                        if kind == "json":
                            out.append(record.decode("utf-8", "replace"))
                        elif record:
                            out.append(fields(record))
                            if len(out[-1]) > columns:
                                raise ValueError(f"{r['path']}: {len(out[-1])} fields where {columns} are expected")
                        size += len(record)
                        if size > CHUNK:
                            yield batch_of(out)
                            out, size = [], 0
                if out:
                    yield batch_of(out)

    def batch_of(out: list) -> pa.RecordBatch:
        return (pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"]) if kind == "json"
                else pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["fields"]))

    return states.mapInArrow(run, "value string" if kind == "json" else "fields array<string>")
