"""Run tables: which artefact a step reads and which run is the latest of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Preference order of the stored stages per step.
STAGE_ORDER = {
    "train": ("labeled_file", "cleaned_file", "original_file"),
    "label": ("cleaned_file", "original_file"),
    "predict": ("cleaned_file", "original_file"),
}


def choose_artefact(step: str) -> Column:
    """Path of the most refined stage a step may read."""
    present = [F.when(F.col(c) != "", F.col(c)) for c in STAGE_ORDER[step]]
    return F.coalesce(*present)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. The maximum is combined before the shuffle, so a hot key is cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(best).select(*keys, "__last.*")
