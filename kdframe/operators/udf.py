"""User code hooks: row-wise or batched maps that replace the source columns."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


#: Rows, and bytes of text, handed to a user's function at a time.
PIECE_ROWS, PIECE_BYTES = 1000, 1 << 20


def _cutter(rows: int, size: int):
    """Function that cuts a frame, in order, into frames of at most ``rows`` rows that end once their values have ``size`` bytes."""
    def pieces(pdf):
        held = np.zeros(len(pdf), dtype=np.int64)
        for c in pdf.columns[pdf.dtypes == object]:
            held += np.fromiter((len(v) if hasattr(v, "__len__") else 8 for v in pdf[c]), np.int64, len(pdf))
        start, total = 0, 0
        for i, n in enumerate(held.tolist()):
            total += n
            if i + 1 - start == rows or total >= size:
                yield pdf.iloc[start:i + 1].reset_index(drop=True)
                start, total = i + 1, 0
        if start < len(pdf) or not len(pdf):
            yield pdf.iloc[start:].reset_index(drop=True)
    return pieces


def map_rows(df: DataFrame, fn: Callable, schema: str, batched: bool = True, batch_size: int = PIECE_ROWS) -> DataFrame:
    """Apply ``fn`` and keep only what it returns (``map(fn, remove_columns=...)``).

    ``batched``: ``fn(pandas.DataFrame) -> pandas.DataFrame`` for up to ``batch_size`` rows of an Arrow batch, fewer
    where they are long, so what ``fn`` makes of them stays small whatever Spark puts into a batch (the fast path);
    otherwise ``fn(dict) -> dict`` per row, still driven in such batches by ``mapInPandas``.
    """
    pieces = _cutter(batch_size, PIECE_BYTES)
    if batched:
        def run(batches):
            for pdf in batches:
                for piece in pieces(pdf):
                    yield fn(piece)
    else:
        def run(batches):
            for pdf in batches:
                for piece in pieces(pdf):
                    yield pd.DataFrame([fn(r) for r in piece.to_dict("records")])
    return df.mapInPandas(run, schema)
