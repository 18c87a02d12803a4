"""Arrow batches of texts in runs of bounded size, for ``mapInArrow`` operators."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 4 << 20


def byte_lengths(column):
    """UTF-8 bytes of every text; 0 for null."""
    return pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def runs(lengths, limit=RUN_BYTES):
    """``(start, stop)`` of runs of at most ``limit`` bytes; a longer text is a run of its own."""
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def byte_runs(batch, name, limit=RUN_BYTES):
    """``(start, texts)`` of a batch's text column as bytes; null is empty."""
    column = batch.column(name).cast(pa.binary())
    for start, stop in runs(byte_lengths(column), limit):
        yield start, [b"" if x is None else x for x in column[start:stop].to_pylist()]


def text_runs(batch, name, limit=RUN_BYTES):
    """``(start, texts)`` of a batch's text column; null is empty, bytes that are no UTF-8 read as U+FFFD."""
    for start, texts in byte_runs(batch, name, limit):
        yield start, [x.decode("utf-8", "replace") for x in texts]
