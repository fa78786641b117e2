"""Problem 5: cutting oversized texts at natural boundaries, with an overlap between consecutive pieces.

Method: all boundaries of a text get a strength (paragraph, line, sentence, word); a sparse table over them answers
"strongest boundary in this window, the rightmost of equals" in constant time; the next piece steps back by the overlap.
Only texts above the limit leave the JVM; each text is independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import pieces

WORD, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4
_BOUNDARY = re.compile(r"(?P<p>[^\S\n]*\n(?:[^\S\n]*\n)+\s*)|(?P<l>[^\S\n]*\n\s*)|(?P<s>[.!?…।॥][\"'”’»)\]]*\s+|[。！？｡]+[」』”’）]*)|(?P<w>\s+)")
_KIND = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "w": WORD}


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, strengths): places where a piece may end, each after the blanks that belong to it."""
    at, strength = [], []
    for m in _BOUNDARY.finditer(text):
        at.append(m.end())
        strength.append(_KIND[m.lastgroup])
    return np.asarray(at, np.int64), np.asarray(strength, np.int64)


class RangeMax:
    """Sparse table: the largest value in any window of up to `widest` entries, in O(1)."""

    def __init__(self, values: np.ndarray, widest: int):
        self.rows = [values]
        step = 1
        while 2 * step <= min(widest, len(values)):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def top(self, lo: int, hi: int) -> int:
        """Largest of values[lo:hi]; hi > lo."""
        k = (hi - lo).bit_length() - 1
        k = min(k, len(self.rows) - 1)
        row = self.rows[k]
        return int(max(row[lo], row[hi - (1 << k)]))


def _whole(text: str, cut: int, least: int) -> int:
    """Moves a cut left so that it doesn't part a letter from its combining marks."""
    while cut > least and (unicodedata.combining(text[cut]) or unicodedata.category(text[cut]) == "Mc" or text[cut] == "‍" or text[cut - 1] == "‍"):
        cut -= 1
    return cut


def split_text(text: str, limit: int = 8000, overlap: int = 400) -> list[tuple[int, int, int]]:
    """[(start, end, strength of the cut)]: pieces of at most limit code points that cover the text.

    A cut is the strongest boundary in the second half of the permissible window, else in all of it behind the overlap,
    else a cut at the limit (strength 0). The next piece begins at the first word start among the last `overlap`
    characters, or exactly that far back where no word starts there. The last piece has strength PARAGRAPH.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be smaller than half the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, PARAGRAPH)]
    at, strength = boundaries(text)
    key = strength * (n + 1) + at  # the strongest, then the rightmost
    table = RangeMax(key, limit + 1) if len(at) else None
    out, start = [], 0
    while n - start > limit:
        cut, got = 0, 0
        for lo in (start + limit // 2, start + overlap + 1):
            i, j = np.searchsorted(at, [lo, start + limit + 1]) if table else (0, 0)
            if j > i:
                got, cut = divmod(table.top(int(i), int(j)), n + 1)
                break
        else:
            cut = _whole(text, start + limit, start + overlap + 1)
        out.append((start, cut, got))
        back = cut - overlap
        if overlap:
            i, j = np.searchsorted(at, [back, cut])
            start = int(at[i]) if j > i else max(_whole(text, back, start + 1), cut - overlap)
        else:
            start = cut
    out.append((start, n, PARAGRAPH))
    return out


def split_oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 8000, overlap: int = 400) -> DataFrame:
    """(key, piece_no, n_pieces, start_pos, end_pos, cut, piece): pieces from 1, positions in code points.

    Texts within the limit are one piece, empty ones too; null texts give no row; repeated rows are cut each on its own.
    The input's other columns are not used.
    """
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    short = base.filter(F.length("text") <= limit).select("key", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start_pos"), F.length("text").cast("long").alias("end_pos"), F.lit(PARAGRAPH).alias("cut"), F.col("text").alias("piece"))
    key_type = base.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows: list[tuple] = []
            source: list[int] = []
            for r, t in enumerate(batch.column("text").to_pylist()):
                cuts = split_text(t, limit, overlap)
                source += [r] * len(cuts)
                rows += [(i, len(cuts), a, b, s, t[a:b]) for i, (a, b, s) in enumerate(cuts, 1)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(source)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True))],
                ["key", "piece_no", "n_pieces", "start_pos", "end_pos", "cut", "piece"],
            )

    long = base.filter(F.length("text") > limit).mapInArrow(run, f"key {key_type}, piece_no int, n_pieces int, start_pos long, end_pos long, cut int, piece string")
    return short.unionByName(long)
