"""Corpus and report writers (Spark writes a folder of part files per output)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.params import read_params, write_params  # noqa: F401  (parameter tables)
from quire.sources.ranges import file_system


# Shared by writer and reader: nothing is trimmed.  The writer quotes an empty string and leaves a null bare.
TSV_FORMAT = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
              "ignoreTrailingWhiteSpace": False}


def tsv_path(directory: str, prefix: str, split: str) -> str:
    return os.path.join(directory, f"{prefix}_{split}.csv")


def write_tsv_corpus(df: DataFrame, directory: str, prefix: str, split: str, mode: str = "overwrite") -> str:
    """``text, labels`` as tab-separated text with a header.  List columns are
    written as JSON arrays so readers can parse them back."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    path = tsv_path(directory, prefix, split)
    df.select(*cols).write.mode(mode).options(**TSV_FORMAT).csv(path)
    return path


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric tables as JSON lines."""
    df.write.mode(mode).json(path)


def write_row_files(rows: DataFrame, directory: str, folders: tuple[str, ...] = ()) -> int:
    """``(folder, value)``: each row's text and a line feed as a file of its own in ``<directory>/<folder>/``; the number
    of files.  ``folders`` are made in any case.  A file is named by its task and place there and is moved into its
    place whole, so a task that runs again replaces its files."""
    system, base = file_system(directory)
    for folder in ("", *folders):
        system.create_dir(f"{base}/{folder}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(directory)
        task, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for folder, value in zip(batch["folder"].to_pylist(), batch["value"]):
                if folder not in made:
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                # readers pass over names with a leading dot
                draft = f"{base}/{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(value.as_buffer())
                system.move(draft, f"{base}/{folder}/part-{task:05d}-{n}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    told = rows.select("folder", F.concat("value", F.lit("\n")).cast("binary").alias("value")).mapInArrow(write, "n long")
    return told.agg(F.sum("n")).first()[0] or 0
