"""Declarative options for the cleaning run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

NEGATIVE, NEUTRAL, POSITIVE, UNLABELLED = 0, 2, 4, -1


@dataclass(frozen=True)
class TextOptions:
    """Which text steps run on which columns. Every step is on unless it narrows the language."""

    columns: Sequence[str | int] = ()
    retweets: bool = True
    hashtags: bool = True
    mentions: bool = True
    html: bool = True
    contradictory: bool = True
    punctuation: bool = True
    only_french: bool = False
    only_english: bool = False
    spaces: bool = True
    urls: bool = True
    # True removes URLs before punctuation is blanked, so that they go as a whole
    urls_first: bool = False


@dataclass(frozen=True)
class Validation:
    """One row rule: kind is allowed_values, unique_id, date, not_empty or max_length."""

    column: str | int
    kind: str
    allowed: Sequence[int] = ()
    max_length: int | None = None


@dataclass(frozen=True)
class MissingRule:
    """One missing-value rule; no columns means every column."""

    strategy: str
    columns: Sequence[str | int] = ()
    constant: str | None = None


@dataclass(frozen=True)
class CleaningOptions:
    validations: Sequence[Validation] = ()
    remove_duplicates: bool = False
    text: TextOptions | None = None
    missing: Sequence[MissingRule] = ()
    keep: Mapping[int, str] = field(default_factory=dict)
    lenient: bool = False
