"""Windows and counts in the tokens of an existing tokenizer: each text is encoded once, in an Arrow stage; nothing is shuffled.

A tokenizer is named by its file: a SentencePiece model (.model) or a JSON file of the tokenizers library (.json). It is
opened once in each Python worker and never copied or trained. Windows, ids and counts cover whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.normalize import normalize_window_text
from corpusloom.operators.slicing import stride
from corpusloom.runtime import pieces

TOKENIZER = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")

Encode = Callable[[list[str]], list[list[int]]]
Decode = Callable[[list[list[int]]], list[str]]


@cache
def load(path: str) -> tuple[Encode, Decode]:
    """(encode, decode) of a tokenizer's file, for lists of texts; special tokens are neither added nor recognised."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1), lambda ids: model.decode(ids) if ids else []
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)], lambda ids: own.decode_batch(ids)


def window_spans(n: int, length: int, step: int, min_last: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the windows over n tokens; a last one shorter than min_last spreads all of them evenly, rounding half to even."""
    if n <= length:
        return [(0, n)] if n else []
    count = 1 - (length - n) // step
    even = min_last and n - (count - 1) * step < min_last
    starts = [round(i * (n - length) / (count - 1)) if even else i * step for i in range(count)]
    return [(s, min(s + length, n)) for s in starts]


def _stage(df: DataFrame, text: str, keep: list[str], added: str, rows: Callable[[list[str | None], Encode, Decode], list[list[tuple]]], tokenizer: str) -> DataFrame:
    """For each row of df the rows that rows() makes of its text, beside the columns kept; batches are cut by their size."""
    base = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    kept = base.drop("_text").schema
    names = [x.split()[0] for x in added.split(", ")]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = load(tokenizer)
        for batch in pieces(batches, "_text", 2_000_000):
            made = rows(batch.column("_text").to_pylist(), encode, decode)
            source = pa.array([i for i, r in enumerate(made) for _ in r], pa.int32())
            columns = list(zip(*[x for r in made for x in r], strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(source) for f in kept), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*(f.name for f in kept), *names])

    return base.mapInArrow(run, out)


def token_stats(df: DataFrame, key: str = "id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, token_count) of each row; null for a null text, 0 for an empty one."""

    def rows(texts: list[str | None], encode: Encode, decode: Decode) -> list[list[tuple]]:
        return [[(len(ids) if t is not None else None,)] for t, ids in zip(texts, encode([t or "" for t in texts]), strict=True)]

    return _stage(df, text, [key], "token_count long", rows, tokenizer)


def token_windows(df: DataFrame, key: str = "id", text: str = "text", length: int = 512, overlap: float = 0.5, min_last: int = 0, normalize: bool = True, pad: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, key, window_idx, start_pos, end_pos, token_ids, actual_tokens, original_token_count, original_window_count, text).

    The whole text is encoded once and cut at start_pos:end_pos; a window's text is its decoded tokens, normalised again
    if normalize is set, and actual_tokens counts that text's own tokens. With pad, token_ids are filled up to the length.
    Null texts and texts without tokens have no window.
    """
    step = stride(length, overlap)
    base = df.withColumn("_norm", normalize_window_text(F.col(f"`{text}`"))) if normalize else df.withColumn("_norm", F.col(f"`{text}`"))

    def rows(texts: list[str | None], encode: Encode, decode: Decode) -> list[list[tuple]]:
        every = encode([t or "" for t in texts])
        spans = [window_spans(len(ids), length, step, min_last) for ids in every]
        shown = decode([ids[a:b] for ids, s in zip(every, spans, strict=True) for a, b in s])
        shown = [" ".join(x.replace(" ", " ").split()) for x in shown] if normalize else shown
        counts = iter(map(len, encode(shown)))
        texts_ = iter(shown)
        fill = (lambda x: x + [pad] * (length - len(x))) if pad is not None else (lambda x: x)
        return [[(k, a, b, fill(ids[a:b]), next(counts), len(ids), len(s), next(texts_)) for k, (a, b) in enumerate(s)] for ids, s in zip(every, spans, strict=True)]

    out = _stage(base, "_norm", [key], "window_idx int, start_pos int, end_pos int, token_ids array<int>, actual_tokens int, original_token_count int, original_window_count int, text string", rows, tokenizer)
    return out.withColumn("id", F.concat(F.col(key).cast("string"), F.lit("_window_"), F.lpad(F.col("window_idx").cast("string"), 4, "0"))) if key != "id" else out.withColumnRenamed("id", "original_doc_id").withColumn("id", F.concat("original_doc_id", F.lit("_window_"), F.lpad(F.col("window_idx").cast("string"), 4, "0")))


def padded_output(windows: DataFrame) -> DataFrame:
    """windows with token_ids as one string of numbers, as a training file has them."""
    return windows.withColumn("token_ids", F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " "))


def fixed_step_windows(df: DataFrame, key: str = "id", text: str = "text", length: int = 512, overlap: float = 0.5, least: int = 100, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, start_pos, tokens, token_ids): windows in steps of int(length * (1 - overlap)) while at least `least` tokens are left."""
    step = int(length * (1 - overlap))

    def rows(texts: list[str | None], encode: Encode, decode: Decode) -> list[list[tuple]]:
        return [[(p, len(ids[p : p + length]), ids[p : p + length]) for p in range(0, len(ids) - least + 1, step)] for ids in encode([t or "" for t in texts])]

    return _stage(df, text, [key], "start_pos int, tokens int, token_ids array<int>", rows, tokenizer)
