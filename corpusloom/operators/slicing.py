"""Sliding windows over words, their filters, and training samples with masked spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.normalize import normalize_window_text
from corpusloom.operators.textstats import window_quality


def stride(length: int, overlap: float) -> int:
    return length - int(length * overlap)


def window_count(n: Column, length: int, step: int) -> Column:
    """1 up to the length, else 1 and as many steps as cover the rest."""
    return F.when(n <= length, 1).otherwise(1 + F.ceil((n - length) / step)).cast("int")


def legacy_window_count(n: Column, length: int, overlap: int) -> Column:
    return F.greatest(F.lit(1), F.floor((n - overlap) / (length - overlap)).cast("int") + 1)


def window_starts(n: Column, length: int, step: int, min_last: int = 0) -> Column:
    """Starts of all windows; where the last one would be shorter than min_last they are spread evenly, rounding half to even."""
    count = window_count(n, length, step)
    plain = F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i * step).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.bround(i * (n - length) / F.greatest(count - 1, F.lit(1))).cast("int"))
    return F.when((count > 1) & (n - (count - 1) * step < min_last), spread).otherwise(plain) if min_last else plain


def windows(df: DataFrame, key: str = "id", text: str = "text", length: int = 512, overlap: float = 0.5, min_last: int = 0, normalize: bool = True) -> DataFrame:
    """(id, original_doc_id, window_idx, start_pos, end_pos, actual_tokens, original_token_count, original_window_count, text).

    Tokens are words between white space. Texts without words, null ones too, have no window.
    """
    step = stride(length, overlap)
    base = normalize_window_text(F.col(text)) if normalize else F.col(text)
    t = df.select(F.col(key).alias("original_doc_id"), F.filter(F.split(base, r"\s+"), lambda w: w != "").alias("_t")).filter(F.size("_t") > 0)
    n = F.size("_t")
    out = t.select("*", n.alias("original_token_count"), window_count(n, length, step).alias("original_window_count"), F.posexplode(window_starts(n, length, step, min_last)).alias("window_idx", "start_pos"))
    words = F.slice("_t", F.col("start_pos") + 1, F.lit(length))
    out = out.withColumns({"end_pos": F.least(F.col("start_pos") + length, F.col("original_token_count")), "text": F.array_join(words, " ")}).withColumn("actual_tokens", F.col("end_pos") - F.col("start_pos"))
    return out.select(F.concat("original_doc_id", F.lit("_window_"), F.lpad(F.col("window_idx").cast("string"), 4, "0")).alias("id"), "original_doc_id", "window_idx", "start_pos", "end_pos", "actual_tokens", "original_token_count", "original_window_count", "text")


def filter_windows(df: DataFrame, min_tokens: int | None = None, min_chars: int | None = None, max_punct: float | None = None, max_non_alnum: float | None = None, max_upper: float | None = None) -> DataFrame:
    """Drops windows below or above the bounds, strictly; a bound of None is not checked."""
    q = window_quality(F.col("text"))
    for bound, bad in ((min_tokens, lambda b: F.col("actual_tokens") < b), (min_chars, lambda b: F.length("text") < b), (max_punct, lambda b: q["punct_ratio"] > b), (max_non_alnum, lambda b: q["non_alnum_ratio"] > b), (max_upper, lambda b: q["uppercase_ratio"] > b)):
        if bound is not None:
            df = df.filter(~bad(bound))
    return df


def german_windows(df: DataFrame, key: str, text: str, length: int, overlap: float, least: int = 100) -> DataFrame:
    """(id, start_pos, tokens): windows in steps of int(length * (1 - overlap)) while at least `least` words are left."""
    step = int(length * (1 - overlap))
    t = df.select(F.col(key).alias("id"), F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("_t")).filter(F.size("_t") >= least)
    return t.select("id", F.explode(F.sequence(F.lit(0), F.size("_t") - least, F.lit(step))).alias("start_pos"), "_t").select("id", "start_pos", F.size(F.slice("_t", F.col("start_pos") + 1, F.lit(length))).alias("tokens"))


def padded_ids(tokens: Column, length: int, pad: int = 0) -> Column:
    """Token ids filled up to the length."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), length)), 1, length)


def parse_ids(text: Column) -> Column:
    """Ids parted by blanks; what is no number is left out."""
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def expanded_length(inputs: int, noise: float = 0.15, span: float = 3.0) -> tuple[int, int]:
    """(tokens, targets): most raw tokens whose masked input fits, and the length of their targets."""

    def lengths(n: int) -> tuple[int, int]:
        noisy = round(n * noise)
        spans = max(1, round(noisy / span))
        return n - noisy + spans + 1, noisy + spans + 1

    n = inputs
    while lengths(n + 1)[0] <= inputs:
        n += 1
    return n, lengths(n)[1]


def _parts(total: int, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A random division of total into so many parts of at least one."""
    cuts = np.sort(rng.choice(total - 1, parts - 1, replace=False)) + 1 if parts > 1 else np.zeros(0, np.int64)
    return np.diff(np.concatenate(([0], cuts, [total])))


def noise_mask(n: int, seed: int, noise: float = 0.15, span: float = 3.0) -> np.ndarray:
    """Which tokens are masked: an exact number of tokens in an exact number of spans, none of them first."""
    if n < 2:
        return np.zeros(n, bool)
    noisy = min(max(round(n * noise), 1), n - 1)
    spans = min(max(round(noisy / span), 1), noisy, n - noisy)
    rng = np.random.default_rng(seed)
    lengths = np.stack([_parts(n - noisy, spans, rng), _parts(noisy, spans, rng)], 1).ravel()
    return np.repeat(np.tile([False, True], spans), lengths)


def fast_mask(n: int, seed: int, noise: float = 0.15, span: int = 3) -> np.ndarray:
    """Masks spans of fixed length at random starts, which may overlap."""
    mask = np.zeros(n, bool)
    if n > span:
        starts = np.random.default_rng(seed).integers(0, n - span, max(1, int(n * noise / span)))
        mask[(starts[:, None] + np.arange(span)).ravel()] = True
    return mask


def with_sentinels(ids: np.ndarray, mask: np.ndarray, vocab: int, eos: int = 1) -> np.ndarray:
    """ids with each masked span as one sentinel (vocab - 1, vocab - 2, …) and an end sign."""
    first = mask & ~np.concatenate(([False], mask[:-1]))
    out = np.where(first, vocab - np.cumsum(first), ids)
    return np.append(out[~(mask & ~first)], eos)


def span_corruption(df: DataFrame, key: str, ids: str, vocab: int = 32100, noise: float = 0.15, span: float = 3.0, seed: int = 42, fast: bool = False) -> DataFrame:
    """(key, inputs, labels): masked inputs and their targets, seeded by a hash of key and seed. Null id lists have no row."""
    source = df.filter(F.col(ids).isNotNull()).select(F.col(key).alias("key"), F.col(ids).alias("ids"), F.xxhash64(F.col(key), F.lit(seed)).alias("seed"))
    key_type = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inputs, labels = [], []
            for x, s in zip(b["ids"], b["seed"], strict=True):
                a = np.asarray(x, np.int64)
                mask = (fast_mask(len(a), s % 2**32, noise, int(span)) if fast else noise_mask(len(a), s % 2**32, noise, span))
                inputs.append(with_sentinels(a, mask, vocab))
                labels.append(with_sentinels(a, ~mask, vocab))
            yield pd.DataFrame({"key": b["key"], "inputs": inputs, "labels": labels})

    return source.mapInPandas(run, f"key {key_type}, inputs array<long>, labels array<long>")


def model_inputs(labels: Column, inputs: Column, length: int, target: int, pad: int = 0, start: int = 0) -> dict[str, Column]:
    """Cut and filled inputs and labels, with padding as -100 in the labels, the decoder's shifted inputs and the mask."""
    x = padded_ids(F.slice(inputs, 1, length), length, pad)
    y = padded_ids(F.slice(labels, 1, target), target, pad)
    return {"input_ids": x, "attention_mask": F.transform(x, lambda v: (v != pad).cast("int")), "labels": F.transform(y, lambda v: F.when(v == pad, -100).otherwise(v)), "decoder_input_ids": F.concat(F.array(F.lit(start)), F.slice(y, 1, target - 1))}
