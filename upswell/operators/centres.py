"""Centres of a bounded sample of vectors: what indexes and cells are made from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that centres are fitted on, and how many of them a centre has at least.
SAMPLE, ROWS_PER_CENTRE = 65_536, 16


def count_for(wanted: int, sample: int = SAMPLE) -> int:
    """``wanted`` centres, as far as a sample can tell them apart."""
    return max(1, min(wanted, sample // ROWS_PER_CENTRE))


def sampled(held: DataFrame, sample: int, seed: int) -> pa.Table:
    """``sample`` rows at most: those with the least seeded hashes of their ids."""
    return held.orderBy(F.xxhash64(F.lit(seed), "song_id"), "song_id").limit(sample).toArrow()


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row, in slices that bound the distances held at once."""
    half = (centres * centres).sum(axis=1) / 2
    slices = [(half - rows[at : at + 4096] @ centres.T).argmin(axis=1) for at in range(0, len(rows), 4096)]
    return np.concatenate(slices) if slices else np.zeros(0, np.int64)


def centres_of(rows: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """Lloyd's centres of a bounded sample, started from ``k`` of its rows."""
    centres = rows[draw.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = nearest_centre(rows, centres)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres
