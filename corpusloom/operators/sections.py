"""Appendix sections: a fold over the lines with a confidence for each candidate section; one Arrow stage."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from corpusloom.functions import patterns as P
from corpusloom.runtime import arrow_columns

_START = re.compile(P.SECTION_STARTS.replace("(?i)", ""), re.IGNORECASE)
_SPECIAL, _GENE, _DECIMAL, _SEPARATOR = re.compile(r"[^\w\s]"), re.compile("^[A-Z]{2,}"), re.compile(r"\d+\.\d+"), re.compile("[:\t]")
_WIDE, _CODES, _NUMBERS = re.compile(r"\t|\s{3,}"), re.compile(r"^[A-Z0-9]{2,}\s+[A-Z0-9]{2,}"), re.compile(r"\d+\.\d+|\d+%")


@dataclass(frozen=True)
class LineStats:
    words: int
    special: float
    upper: float

    @classmethod
    def of(cls, line: str) -> LineStats:
        solid = len(line.replace(" ", ""))
        alpha = sum(map(str.isalpha, line))
        return cls(len(line.split()), len(_SPECIAL.findall(line)) / solid if solid else 0.0, sum(map(str.isupper, line)) / alpha if alpha else 0.0)


def section_confidence(lines: list[str]) -> tuple[float, str]:
    """(confidence, type) of a candidate section; the type is the last indicator that fired."""
    solid = [x.strip() for x in lines if x.strip()]
    if not solid:
        return 0.0, "empty"
    n = len(solid)
    stats = [LineStats.of(x) for x in solid]
    mean = lambda values: sum(values) / n
    shares = [mean(s.special for s in stats), mean(s.upper for s in stats), mean(s.words < 5 for s in stats), mean(bool(_WIDE.search(x)) for x in solid), mean(bool(_CODES.search(x)) for x in solid), mean(bool(_NUMBERS.search(x)) for x in solid)]
    indicators = [(share > least, weight, name) for share, (name, least, weight) in zip(shares, P.SECTION_INDICATORS, strict=True)]
    kind = next((name for hit, _, name in reversed(indicators) if hit), "unknown")
    total = sum(weight for hit, weight, _ in indicators if hit) + (0.15 if mean(s.words for s in stats) < 5 else 0.0)
    return min(total, 1.0), kind


def closes(line: str) -> bool:
    """Whether a line is prose that ends a candidate section."""
    s = LineStats.of(line)
    return s.words > 15 and s.special < 0.15 and s.upper < 0.3 and not (_GENE.search(line) or _DECIMAL.search(line) or _SEPARATOR.search(line))


def remove_sections_text(text: str | None, threshold: float = 0.8, debug: bool = False) -> tuple[str | None, int, int, int, list[dict]]:
    """(text, sections, lines, characters removed, samples): candidate sections below the threshold stay.

    With debug a tag stands in each removed section's place and no characters count as removed. samples: the first five
    sections with their lines (from, to, counted from 0, and how many), length, type, confidence and first three lines.
    """
    if text is None:
        return None, 0, 0, 0, []
    kept: list[str] = []
    held: list[str] | None = None
    gone = [0, 0, 0]
    samples: list[dict] = []

    def settle(lines: list[str], first: int, last: bool) -> None:
        confidence, kind = section_confidence(lines)
        if confidence <= threshold:
            kept.extend(lines)
            return
        length = sum(map(len, lines))
        gone[0] += 1
        gone[1] += len(lines)
        gone[2] += 0 if debug else length
        if debug:
            kept.append(f"[DEBUG:appendix{'_end' * last}:{kind}]")
        if len(samples) < 5:
            samples.append({"start_line": first, "end_line": first + len(lines), "lines_count": len(lines), "total_length": length, "section_type": kind, "confidence": confidence, "sample_lines": lines[:3]})

    start = 0
    for i, line in enumerate(text.splitlines()):
        s = line.strip()
        if held is None:
            if s and _START.search(s):
                held, start = [line], i
            else:
                kept.append(line)
        elif s and len(held) >= 5 and closes(s):
            settle(held, start, False)
            held = None
            kept.append(line)
        else:
            held.append(line)
    if held:
        settle(held, start, True)
    return "\n".join(kept), *gone, samples


def remove_sections(df: DataFrame, text: str = "text", threshold: float = 0.8, debug: bool = False) -> DataFrame:
    """text without appendix sections; adds appendix_sections_removed, appendix_lines_removed, appendix_length_reduction and removed_sections (samples)."""
    sample = "array<struct<start_line: int, end_line: int, lines_count: int, total_length: int, section_type: string, confidence: double, sample_lines: array<string>>>"
    return arrow_columns(df, [text], f"`{text}` string, appendix_sections_removed int, appendix_lines_removed int, appendix_length_reduction int, removed_sections {sample}", lambda t: remove_sections_text(t, threshold, debug))
