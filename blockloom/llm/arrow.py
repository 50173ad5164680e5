"""Helpers for string columns of Arrow batches as arrays of code points."""

from __future__ import annotations

import numpy as np


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and the offsets of the texts (null counts as empty)."""
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    joined = "".join([t for t in texts if t])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), offsets
