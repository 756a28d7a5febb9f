"""Arrow batches cut into portions of bounded size for work inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PORTION_CHARS = 1_000_000


def portions(batch: pa.RecordBatch, max_chars: int = PORTION_CHARS, max_rows: int = 1 << 30) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a batch whose first two columns these are, about ``max_chars`` characters and at most
    ``max_rows`` rows at a time (a longer text is a portion of its own), so that what is made from them stays small."""
    ids, texts, size = [], [], 0
    for i in range(batch.num_rows):
        text = batch.column(1)[i].as_py() or ""
        if texts and (size + len(text) > max_chars or len(texts) == max_rows):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(batch.column(0)[i].as_py())
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts
