"""Problem 2: how many tokens of an existing tokenizer each document has, and totals by source, language and area.

Method: the vocabulary lies in a double-array trie; a count-only Viterbi walks all new segments of a batch at once and
keeps, for each position, the best path's cost and length. Segments are words with the blanks before them, so a segment
is worked out once per Python worker and a document's count is a sum of looked-up lengths.

A unigram model brings its own log-probabilities. The public vocabulary at hand is a byte-pair one, whose scores are
only merge ranks; there the cost of a piece follows Zipf's law in its rank, and the library's own count of each
segment, worked out beside it, shows how far the estimate is off.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.languages import label_code
from corpusloom.runtime import pieces

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
_SEGMENT = re.compile(r" *[^ \n。，、！？]+[。，、！？]?| *[。，、！？]|\n| +")


@dataclass
class DoubleArray:
    """base/check trie over dense character codes; cost is per node, inf where no piece ends."""

    codes: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    cost: np.ndarray
    byte_cost: float
    longest: int

    @classmethod
    def build(cls, costs: dict[str, float], byte_cost: float) -> DoubleArray:
        names = sorted(costs)
        chars = sorted(set("".join(names)))
        codes = {c: i + 1 for i, c in enumerate(chars)}
        children: list[dict[int, int]] = [{}]
        value = [np.inf]
        for name in names:
            node = 0
            for c in name:
                k = codes[c]
                to = children[node].get(k)
                if to is None:
                    to = len(children)
                    children[node][k] = to
                    children.append({})
                    value.append(np.inf)
                node = to
            value[node] = costs[name]
        size = 8 * len(children) + 4 * len(codes) + 1024
        base, check, cost = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, np.inf)
        used = np.zeros(size, bool)
        used[0] = True
        slot = [0] * len(children)
        start = {}  # by number of children: where the search for a place goes on
        single = 1
        for node in sorted(range(len(children)), key=lambda v: -len(children[v])):
            if not children[node]:
                continue
            keys = np.asarray(sorted(children[node]))
            if len(keys) == 1:  # fits into the next hole
                while used[single] or single <= keys[0]:
                    single += 1
                b = single - int(keys[0])
                used[single] = True
                slot[node] = b
                continue
            b = start.get(len(keys), min(start.values(), default=1))
            while True:
                block = np.arange(b, b + 256)
                fits = ~used[block[:, None] + keys].any(1)
                if fits.any():
                    b = int(block[np.argmax(fits)])
                    break
                b += 256
            start[len(keys)] = b
            used[b + keys] = True
            slot[node] = b
        place = [0] * len(children)
        stack = [0]
        while stack:
            node = stack.pop()
            base[place[node]] = slot[node]
            for k, to in children[node].items():
                at = slot[node] + k
                place[to] = at
                check[at] = place[node]
                cost[at] = value[to]
                stack.append(to)
        return cls(codes, base, check, cost, byte_cost, max(map(len, names), default=1))

    LONG = 2048

    def count(self, segments: list[str]) -> np.ndarray:
        """Number of pieces on the cheapest path of each segment; equal costs take the fewer pieces. Characters no piece has count their bytes.

        Segments up to LONG characters go side by side, those beyond it one by one; the numbers are the same.
        """
        if any(len(s) > self.LONG for s in segments):
            whole = np.zeros(len(segments), np.int64)
            short = [i for i, s in enumerate(segments) if len(s) <= self.LONG]
            whole[short] = self.count([segments[i] for i in short])
            for i, s in enumerate(segments):
                if len(s) > self.LONG:
                    whole[i] = self._walk(s)
            return whole
        out = np.zeros(len(segments), np.int64)
        lengths = np.asarray([len(s) for s in segments], np.int64)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        start = 0
        while start < len(order):
            n = int(lengths[order[start]])
            stop = int(np.searchsorted(lengths[order], max(n + 4, n * 5 // 4), "right"))
            stop = min(stop, start + 200_000)
            part = order[start:stop]
            out[part] = self._count([segments[i] for i in part.tolist()])
            start = stop
        return out

    def _count(self, segments: list[str]) -> np.ndarray:
        n, width = len(segments), max(map(len, segments))
        get = self.codes.get
        grid = np.zeros((width, n), np.int32)
        heavy = np.ones((width, n), np.int16)
        length = np.zeros(n, np.int64)
        for i, s in enumerate(segments):
            grid[: len(s), i] = [get(c, 0) for c in s]
            length[i] = len(s)
        for j, i in zip(*np.nonzero((grid == 0) & (np.arange(width)[:, None] < length)), strict=True):
            heavy[j, i] = len(segments[i][j].encode("utf-8", "surrogatepass"))
        best = np.full((width + 1, n), np.inf)
        number = np.zeros((width + 1, n), np.int64)
        best[0] = 0
        limit = len(self.base) - 1
        for i in range(width):
            rows = np.flatnonzero(length > i)
            node = np.zeros(len(rows), np.int64)
            unknown = True
            for j in range(i, min(width, i + self.longest)):
                code = grid[j, rows]
                to = np.minimum(self.base[node] + code, limit)
                ok = (code > 0) & (self.check[to] == node)
                if j == i and unknown:  # characters that are no piece by themselves
                    lone = ~ok | np.isinf(self.cost[to])
                    r = rows[lone]
                    self._relax(best, number, j + 1, r, best[i, r] + self.byte_cost * heavy[j, r], number[i, r] + heavy[j, r])
                rows, node = rows[ok], to[ok]
                if not len(rows):
                    break
                end = np.isfinite(self.cost[node])
                r = rows[end]
                self._relax(best, number, j + 1, r, best[i, r] + self.cost[node[end]], number[i, r] + 1)
        return number[length, np.arange(n)]

    def _walk(self, segment: str) -> int:
        """The same for one segment of any length, position by position."""
        if not hasattr(self, "_lists"):
            self._lists = (self.base.tolist(), self.check.tolist(), self.cost.tolist())
        base, check, cost = self._lists
        codes = [self.codes.get(c, 0) for c in segment]
        n, limit, inf = len(codes), len(base) - 1, float("inf")
        best, number = [inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, count, node = best[i], number[i], 0
            for j in range(i, min(n, i + self.longest)):
                code = codes[j]
                to = min(base[node] + code, limit)
                ok = code > 0 and check[to] == node
                c = cost[to] if ok else inf
                if j == i and c == inf:  # a character that is no piece by itself
                    heavy = len(segment[j].encode("utf-8", "surrogatepass")) if code == 0 else 1
                    x, m = here + self.byte_cost * heavy, count + heavy
                    if x < best[j + 1] or x == best[j + 1] and m < number[j + 1]:
                        best[j + 1], number[j + 1] = x, m
                if not ok:
                    break
                if c < inf:
                    x = here + c
                    if x < best[j + 1] or x == best[j + 1] and count + 1 < number[j + 1]:
                        best[j + 1], number[j + 1] = x, count + 1
                node = to
        return number[n]

    @staticmethod
    def _relax(best: np.ndarray, number: np.ndarray, j: int, rows: np.ndarray, cost: np.ndarray, count: np.ndarray) -> None:
        better = (cost < best[j, rows]) | ((cost == best[j, rows]) & (count < number[j, rows]))
        rows = rows[better]
        best[j, rows] = cost[better]
        number[j, rows] = count[better]


def load_vocabulary(path: str) -> tuple[dict[str, float], float]:
    """(cost of each piece, cost of a byte). Unigram models give minus their scores; byte-pair models Zipf costs of the rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = [sp.get_score(sp.piece_to_id(x)) for x in names]
    ranks = sorted({-s for s in scores})
    if ranks and all(r == int(r) for r in ranks):
        costs = {x: float(np.log(len(names)) + np.log(8 + max(0.0, -s)) / 4) for x, s in zip(names, scores, strict=True)}
    else:
        costs = {x: -float(s) for x, s in zip(names, scores, strict=True)}
    return costs, 2 * max(costs.values(), default=1.0)


class Counter:
    """Token counts of texts in a Python worker, by segments met so far: (estimate by Viterbi, the library's own)."""

    LIMIT = 500_000

    def __init__(self, trie: DoubleArray | None, model: str | None):
        self.trie, self.sp = trie, None
        if model:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.numbers = np.zeros((2, 4096), np.int32)

    def _add(self, new: list[str]) -> None:
        base, need = len(self.at), len(self.at) + len(new)
        self.at.update(zip(new, range(base, need), strict=True))
        if need > self.numbers.shape[1]:
            self.numbers = np.concatenate((self.numbers, np.zeros((2, max(need, 2 * self.numbers.shape[1]) - self.numbers.shape[1]), np.int32)), 1)
        if self.trie:
            self.numbers[0, base:need] = self.trie.count([s.replace(" ", "▁") for s in new])
        if self.sp:
            # The library puts a blank before each text: a segment gives up its own for it, or comes after a newline, which is two more tokens.
            own = [s[1:] if s[0] == " " and s != " " else "\n" + s for s in new]
            got = self.sp.encode(own, num_threads=1)
            self.numbers[1, base:need] = [len(g) - (2 if o[0] == "\n" and (s[0] != " " or s == " ") else 0) for g, o, s in zip(got, own, new, strict=True)]

    def count(self, texts: list[str]) -> np.ndarray:
        """(2, texts): estimates and exact counts; a text is taken with one blank before it, as the library does."""
        if len(self.at) > self.LIMIT:
            self._clear()
        found = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        flat = [s for f in found for s in f]
        new = [s for s in dict.fromkeys(flat) if s not in self.at]
        if new:
            self._add(new)
        index = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        return np.stack([np.bincount(doc, self.numbers[k][index], len(texts)) for k in (0, 1)]).astype(np.int64)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = "", estimate: bool = True, exact: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, tokens_est, tokens, *keep): Viterbi estimate and the library's count of each row's whole text.

    What isn't asked for is null. Null and empty texts have 0 tokens; repeated rows are counted each on its own.
    """
    path = model or f"{TOKENIZERS}/piece_bpe_32k.model"
    base = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`") for c in keep))
    trie = DoubleArray.build(*load_vocabulary(path)) if estimate else None
    sent = base.sparkSession.sparkContext.broadcast(trie)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    others = [c for c in base.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value, path if exact else None)
        for batch in pieces(batches, "text", 2_000_000):
            est, own = counter.count([t or "" for t in batch.column("text").to_pylist()])
            none = np.ones(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(est, mask=None if estimate else none), pa.array(own, mask=None if exact else none)], [*others, "tokens_est", "tokens"])

    return base.mapInArrow(run, f"{fields}, tokens_est long, tokens long")


def folder_language(raw: DataFrame, id_column: str = "id", language: str = "language") -> DataFrame:
    """(id, language): one language for each trimmed, small-letter id: that of most rows, ties by the code; unknown ones give way.

    Counts are pre-aggregated by (id, language), so an id with a third of all rows is a few rows after the first stage.
    """
    rows = raw.select(F.lower(F.trim(F.col(f"`{id_column}`"))).alias("id"), label_code(F.col(f"`{language}`")).alias("language")).filter("id IS NOT NULL AND language IS NOT NULL")
    counted = rows.groupBy("id", "language").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("id").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"))


def token_budget(docs: DataFrame, raw: DataFrame, model: str = "") -> DataFrame:
    """(source, language, area, docs, tokens_est, tokens): totals of every slice, each document counted once.

    docs: doc_id, id, text, source, subject_area; raw: id, language. Rows of one doc_id count once (the least by id).
    Documents without a usable raw row have language 'unknown', without an area 'unknown'; null sources stay null.
    """
    counted = token_counts(docs, "doc_id", "text", model, keep=("id", "source", "subject_area"))
    once = counted.groupBy("key").agg(F.min(F.struct("id", "source", "subject_area", "tokens_est", "tokens")).alias("r")).select("r.*")
    joined = once.withColumn("id", F.lower(F.trim("id"))).join(folder_language(raw), "id", "left")
    area = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower("subject_area"), r"[\s_\p{Z}-]+", " ")), F.lit("")), F.lit("unknown"))
    return joined.groupBy("source", F.coalesce("language", F.lit("unknown")).alias("language"), area.alias("area")).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens_est").alias("tokens_est"), F.sum("tokens").alias("tokens"))
