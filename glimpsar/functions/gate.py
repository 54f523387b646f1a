"""The accept predicate: the one place where a verified candidate becomes a match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inliers that are enough by themselves, and the two gates below that.
STRONG_INLIERS, MIN_INLIERS, MIN_FRACTION = 30, 6, 0.45


def inlier_fraction(inliers: Column, matches: Column) -> Column:
    return inliers / F.greatest(matches, F.lit(1))


def accept(inliers: Column, matches: Column, least: int = MIN_INLIERS, fraction: float = MIN_FRACTION) -> Column:
    """Strong consensus, or enough inliers that make up enough of the matches."""
    return (inliers >= STRONG_INLIERS) | ((inliers >= least) & (inlier_fraction(inliers, matches) >= fraction))
