"""Small runs of an Arrow batch's texts, so that what Python makes of them stays small however long a batch is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Texts of a run at most, and their characters (a longer text is a run of its own).
ROWS, CHARS = 64, 1 << 20


def text_runs(parts: Iterator[pd.Series], rows: int | None = None, chars: int | None = None) -> Iterator[pd.Series]:
    """The texts of all batches in order, a run at a time; an empty batch is an empty run."""
    rows, chars = rows or ROWS, chars or CHARS
    for texts in parts:
        first, held = 0, 0
        for i, t in enumerate(texts):
            size = len(t) if t else 0
            if i > first and (i - first == rows or held + size > chars):
                yield texts.iloc[first:i]
                first, held = i, 0
            held += size
        yield texts.iloc[first:]
