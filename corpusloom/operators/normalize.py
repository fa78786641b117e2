"""Symbol and whitespace normalisation, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t]+", " ")


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def sentence_spacing(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(^|\\.) {2,}([A-Z])", "$1 $2"), "(?m)^ +", "")


def normalize_whitespace(df: DataFrame, text: str = "text", meta: bool = True) -> DataFrame:
    """text normalised; with meta: norm_text_changed, norm_length_reduction, norm_word_reduction, norm_changes_made. Null stays null."""
    spaces = df.withColumn("_o", F.col(text)).withColumn(text, collapse_spaces(F.col(text))).withColumn("_spaces", F.col(text) != F.col("_o"))
    lines = spaces.withColumn("_b", F.col(text)).withColumn(text, collapse_newlines(F.col(text))).withColumn("_newlines", F.col(text) != F.col("_b"))
    lead = lines.withColumn("_b", F.col(text)).withColumn(text, sentence_spacing(F.col(text))).withColumn("_sentence", F.col(text) != F.col("_b"))
    out = lead.withColumn("_b", F.col(text)).withColumn(text, strip(F.col(text))).withColumn("_strip", F.col(text) != F.col("_b"))
    if meta:
        out = out.withColumns(
            {
                "norm_text_changed": F.col(text) != F.col("_o"),
                "norm_length_reduction": F.length("_o") - F.length(text),
                "norm_word_reduction": word_count(F.col("_o")) - word_count(F.col(text)),
                "norm_changes_made": F.struct(F.col("_spaces").alias("spaces"), F.col("_newlines").alias("newlines"), F.col("_sentence").alias("sentence_spacing_fixes"), F.col("_strip").alias("strip")),
            }
        )
    return out.drop("_o", "_b", "_spaces", "_newlines", "_sentence", "_strip")


def word_count(text: Column) -> Column:
    """Words between white space; null for null."""
    return F.regexp_count(text, F.lit(r"\S+"))


def _replace_all(text: Column, table: dict[str, str]) -> Column:
    for sign, to in table.items():
        text = F.replace(text, F.lit(sign), F.lit(to))
    return text


def _count_of(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def symbol_steps(multiline: bool = False) -> list[tuple[str, object, object]]:
    """(name, Column -> Column, Column -> count) in the order of application."""
    m = "(?m)" if multiline else ""

    def regex(pattern: str, to: str, near: str = ""):
        """near: what every match holds; a text without it isn't searched."""
        change, number = (lambda c: F.regexp_replace(c, pattern, to)), (lambda c: F.regexp_count(c, F.lit(pattern)))
        return (lambda c: F.when(c.rlike(near), change(c)).otherwise(c), lambda c: F.when(c.rlike(near), number(c)).otherwise(0)) if near else (change, number)

    def table(t: dict[str, str]):
        one = all(len(v) == 1 for v in t.values())
        change = (lambda c: F.translate(c, "".join(t), "".join(t.values()))) if one else (lambda c: _replace_all(c, t))
        return change, lambda c: _count_of(c, "".join(t))

    gone = f"[{P.INVISIBLE}]"
    steps = [("invisible", lambda c: F.regexp_replace(c, gone, ""), lambda c: F.regexp_count(c, F.lit(gone)))]
    steps += [(f"toc_{i}", *regex(m + p, "", near)) for i, (p, near) in enumerate(zip(P.TOC, (r"(?U)[.\s]{5}", "", r"[.\t]{5}"), strict=True))]
    steps += [(f"tabular_{i}", *regex(m + p, "")) for i, p in enumerate(P.TABULAR)]
    steps += [(f"dots_{i}", *regex(p, to)) for i, (p, to) in enumerate(P.DOTS)]
    steps += [("cyrillic", lambda c: F.translate(c, *P.CYRILLIC), lambda c: _count_of(c, P.CYRILLIC[0]))]
    steps += [("dashes", *table(dict.fromkeys(P.DASHES, "-"))), ("quotes", *table(P.QUOTES)), ("bullets", *table(dict.fromkeys(P.BULLETS, "*"))), ("arrows", *table(P.ARROWS)), ("legal", *table(P.LEGAL)), ("primes", *table(P.PRIMES)), ("ellipses", *table(P.ELLIPSES))]
    return steps


def _tables() -> tuple[object, object]:
    """(change, count) of all tables of single signs at once: no table makes a sign of another one, so their order is free."""
    every = dict(zip(*P.CYRILLIC, strict=True)) | dict.fromkeys(P.DASHES, "-") | P.QUOTES | dict.fromkeys(P.BULLETS, "*") | P.ARROWS | P.LEGAL | P.PRIMES | P.ELLIPSES
    one, several = {k: v for k, v in every.items() if len(v) == 1}, {k: v for k, v in every.items() if len(v) > 1}
    return lambda c: _replace_all(F.translate(c, "".join(one), "".join(one.values())), several), lambda c: _count_of(c, "".join(every))


def normalize_symbols(df: DataFrame, text: str = "text", count: bool = True, multiline: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """text with symbols normalised; with count: symbol_text_changed and symbol_normalizations (0 where the text is unchanged)."""
    out = df.withColumn("_o", F.col(text)).withColumn("_n", F.lit(0))
    steps = [x for x in symbol_steps(multiline) if x[0].startswith(only)] if only else [x for x in symbol_steps(multiline) if x[0].startswith(("invisible", "toc", "tabular", "dots"))] + [("tables", *_tables())]
    for _, change, number in steps:
        if count:
            out = out.withColumn("_n", F.col("_n") + number(F.col(text)))
        out = out.withColumn(text, change(F.col(text)))
    if count:
        out = out.withColumn("symbol_text_changed", F.col(text) != F.col("_o")).withColumn("symbol_normalizations", F.when(F.col("symbol_text_changed"), F.col("_n")).otherwise(F.lit(0)))
    return out.drop("_o", "_n")


def normalize_window_text(text: Column) -> Column:
    """One line: no-break spaces, carriage returns and newlines as spaces, runs of white space as one, stripped."""
    return strip(F.regexp_replace(F.translate(text, "\u00a0\r\n", "   "), r"\s+", " "))
