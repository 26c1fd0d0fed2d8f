"""textmill: cleaning, labelling, classifying and evaluating tables of texts on Spark."""

from textmill.options import (
    CleaningOptions,
    MissingRule,
    TextOptions,
    Validation,
)
from textmill.plans.cleaning import CleanResult, clean

__all__ = [
    "CleanResult",
    "CleaningOptions",
    "MissingRule",
    "TextOptions",
    "Validation",
    "clean",
]
