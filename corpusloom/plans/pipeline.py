"""Named steps DataFrame -> DataFrame and pipelines of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import citations, lines, normalize, sections, textstats

STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "artefacts": citations.remove_artefacts,
    "citations": citations.remove_citations,
    "validated_citations": citations.remove_validated,
    "lines": lines.clean_lines,
    "captions": lines.clean_captions,
    "sections": sections.remove_sections,
    "symbols": normalize.normalize_symbols,
    "whitespace": normalize.normalize_whitespace,
    "statistics": textstats.with_stats,
    "non_empty": lambda df: df.filter(F.col("text").rlike(r"\S")),
}


def register(name: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a step of the user's own; a name is taken once."""
    if name in STEPS:
        raise ValueError(f"{name} is taken")
    STEPS[name] = step


def run_pipeline(df: DataFrame, steps: Iterable[str]) -> DataFrame:
    """df through the named steps; nothing runs before the result is asked for."""
    return reduce(lambda d, n: STEPS[n](d), steps, df)
