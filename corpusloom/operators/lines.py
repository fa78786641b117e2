"""Line classification: repetition, tables, short lines, metadata, copyright, captions, numeric rows; higher-order functions in one projection."""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators.normalize import strip, word_count
from corpusloom.runtime import arrow_columns

_BREAK = "\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085\u2028\u2029]"
_ENDS = re.compile(_BREAK)


def let(value: Column, body) -> Column:
    """body(value), value evaluated once: the optimiser would otherwise copy it to every place, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_lines(text: Column) -> Column:
    """Lines at every kind of line end; an ending one adds no line. Null for null."""
    return let(F.split(text, _BREAK), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def line_reason(bare: Column, previous: Column, tabular: Column) -> Column:
    """'type:reason' of a line to remove, null of one to keep. bare: the stripped line; previous: the five non-blank lines before."""

    def reason(s: Column) -> Column:
        words = word_count(s)
        out = F.when(s == "", None).when(~s.startswith("[DEBUG:") & F.array_contains(previous, s), "repetition:repeated_line").when(tabular, "tabular:consecutive_tabs")
        for name, pattern in P.SHORT_LINES:
            out = out.when((F.length(s) <= 15) & (words <= 3) & s.rlike(pattern), f"short_line:{name}")
        code = (words <= 8) & s.rlike(P.CODE_START) | s.rlike(P.ALL_CAPS) & (F.length(F.replace(s, F.lit(" "), F.lit(""))) < 8)
        return out.when(s.rlike(P.KEYWORD_LINE), "metadata:keywords_metadata").when(code, "metadata:technical_code_line").when(s.rlike(P.COPYRIGHT), "copyright:copyright_line")

    return let(bare, reason)


def classify_lines(df: DataFrame, text: str = "text", name: str = "line_info") -> DataFrame:
    """Adds name: array of (i, line, reason) over the lines of text.

    The non-blank lines are a list of their own, so that the five before each are a slice of it: the work grows with the
    lines, but for the last step, which sorts them by their numbers.
    """

    def numbered(x: Column) -> Column:
        return F.transform(x, lambda v, i: F.struct((i + 1).alias("i"), v.alias("line"), strip(v).alias("s"), (F.length(v) - F.length(F.replace(v, F.lit("\t"), F.lit(""))) >= 2).alias("t")))

    def parted(x: Column) -> Column:
        solid = F.filter(x, lambda e: e["s"] != "")
        return F.struct(F.transform(x, lambda e: e["t"]).alias("t"), solid.alias("solid"), F.filter(x, lambda e: e["s"] == "").alias("blank"))

    def named(a: Column) -> Column:
        return F.struct(a["t"].alias("t"), a["solid"].alias("solid"), a["blank"].alias("blank"), F.transform(a["solid"], lambda e: e["s"]).alias("bare"))

    def infos(a: Column) -> Column:
        def info(e: Column, k: Column) -> Column:
            previous = F.slice(a["bare"], F.greatest(k - 4, F.lit(1)), F.least(k, F.lit(5)))
            near = F.coalesce(F.try_element_at(a["t"], e["i"] + 1), F.lit(False)) | (e["i"] > 1) & F.coalesce(F.try_element_at(a["t"], F.greatest(e["i"] - 1, F.lit(1))), F.lit(False))
            return F.struct(e["i"].alias("i"), e["line"].alias("line"), line_reason(e["s"], previous, e["t"] & near).alias("reason"))

        blanks = F.transform(a["blank"], lambda e: F.struct(e["i"].alias("i"), e["line"].alias("line"), F.lit(None).cast("string").alias("reason")))
        return F.array_sort(F.concat(F.transform(a["solid"], info), blanks))

    return df.withColumn(name, let(split_lines(F.col(text)), lambda x: let(numbered(x), lambda n: let(parted(n), lambda p: let(named(p), infos)))))


def clean_lines(df: DataFrame, text: str = "text", debug: bool = False) -> DataFrame:
    """text without the classified lines; adds removed_lines (first ten), lines_removed and line_length_reduction by type."""
    out = classify_lines(df, text)
    removed = F.filter("line_info", lambda x: x["reason"].isNotNull())
    shown = F.transform("line_info", lambda x: F.when(x["reason"].isNull(), x["line"]).otherwise(F.concat(F.lit("[DEBUG:"), x["reason"], F.lit("]")))) if debug else F.transform(F.filter("line_info", lambda x: x["reason"].isNull()), lambda x: x["line"])
    of = lambda t: lambda x: x["reason"].startswith(t)  # noqa: E731  (a second parameter would be the index)
    stats = {f"{t}_lines_removed": F.size(F.filter("line_info", of(t))) for t in ("repetition", "tabular", "short_line", "metadata", "copyright")}
    out = out.withColumns(
        {
            "removed_lines": F.slice(F.transform(removed, lambda x: F.struct(F.substring(x["line"], 1, 100).alias("line_content"), x["i"].alias("line_number"), F.length(x["line"]).alias("length"), x["reason"].alias("reason"))), 1, 10),
            "lines_removed": F.size(removed),
            "line_length_reduction": F.aggregate(removed, F.lit(0), lambda a, x: a + F.length(x["line"])),
            **stats,
        }
    )
    return out.withColumn(text, F.array_join(shown, "\n")).drop("line_info")


def kept_line_memory(df: DataFrame, text: str = "text", memory: int = 5) -> DataFrame:
    """The stand-alone repetition cleaner: only the last kept lines are remembered, so each line depends on what became of
    the ones before. One pass over the lines in an Arrow stage."""

    def rows(t: str | None) -> tuple[str | None, int | None]:
        if t is None:
            return None, None
        parts = _ENDS.split(t)
        if parts[-1] == "":
            parts.pop()
        last: deque[str] = deque(maxlen=memory)
        kept = []
        for line in parts:
            bare = line.strip(" \t\n\x0b\f\r")
            if bare and bare in last:
                continue
            kept.append(line)
            if bare:
                last.append(bare)
        return "\n".join(kept), len(parts) - len(kept)

    return arrow_columns(df, [text], f"`{text}` string, repeated_lines_removed int", rows)


def caption_reason(line: Column) -> Column:
    """Reason of a caption line or a numeric row, null of others."""

    def rows(s: Column) -> Column:
        def numbers(words: Column) -> Column:
            n = F.size(words)
            numeric = F.size(F.filter(words, lambda w: w.rlike(P.NUMERIC_WORD)))
            return F.when(n.between(2, 5) & (numeric / n >= 0.6) & ~s.rlike(P.MATH), F.concat(F.lit("numeric_table_data_"), numeric, F.lit("of"), n))

        return F.when(s == "", None).when(s.rlike(P.CAPTION), "figure_table_caption").otherwise(let(F.split(s, r"\s+"), numbers))

    return let(strip(line), rows)


def clean_captions(df: DataFrame, text: str = "text", debug: bool = False) -> DataFrame:
    """text without caption lines and numeric rows; adds figure_lines_removed, figure_length_reduction and removed_figure_lines (the first ten).

    With debug a tag stands in each line's place and no length counts as removed."""
    info = F.transform(split_lines(F.col(text)), lambda x, i: F.struct(x.alias("line"), (i + 1).alias("i"), caption_reason(x).alias("reason")))
    out = df.withColumn("_i", info)
    gone = F.filter("_i", lambda x: x["reason"].isNotNull())
    tagged = F.transform("_i", lambda x: F.when(x["reason"].isNull(), x["line"]).otherwise(F.concat(F.lit("[DEBUG:figure_line:"), x["reason"], F.lit("]"))))
    shown = tagged if debug else F.transform(F.filter("_i", lambda x: x["reason"].isNull()), lambda x: x["line"])
    sample = F.transform(F.slice(gone, 1, 10), lambda x: F.struct(F.substring(strip(x["line"]), 1, 100).alias("line_content"), x["i"].alias("line_number"), F.length(strip(x["line"])).alias("length"), x["reason"].alias("reason")))
    stats = {"figure_lines_removed": F.size(gone), "figure_length_reduction": F.lit(0) if debug else F.aggregate(gone, F.lit(0), lambda a, x: a + F.length(strip(x["line"]))), "removed_figure_lines": sample}
    return out.withColumns(stats).withColumn(text, F.array_join(shown, "\n")).drop("_i")
