"""Problem 8: filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

Method: vector best-fit. Items come in falling order of size; of the open containers that can still take an item under
every capacity (tokens, documents, attention cost) the one is chosen whose residual vector afterwards is shortest, each
residual weighted and divided by its capacity. Rows are dealt by hash into groups of about `group_containers`
containers, one task each; a group leaves at most a few containers part full, so the loss doesn't grow with the data.
The result depends on the rows alone, not on how they are partitioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import token_counts
from corpusloom.runtime import cut


def vector_best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_attention: float, weights: tuple[float, float, float]) -> np.ndarray:
    """Container of each item; sizes must not exceed the capacity. Ties go to the container opened first.

    The attention cost of an item is its size squared. One that alone costs more than a container may is never split for
    it: it has a container of its own.
    """
    order = np.argsort(-sizes, kind="stable")
    full = np.asarray([capacity, max_docs, max_attention], np.float64)
    w = np.asarray(weights) / full
    left = np.empty((64, 3))
    opened = 0
    alive = np.zeros(0, np.int64)
    out = np.full(len(sizes), -1, np.int64)
    smallest = float(sizes[sizes > 0].min()) if (sizes > 0).any() else 1.0
    for i in order.tolist():
        item = np.asarray([sizes[i], 1.0, float(sizes[i]) ** 2])
        at = -1
        if len(alive):
            rest = left[alive] - item
            ok = (rest >= 0).all(1)
            if ok.any():
                norm = np.where(ok, ((rest * w) ** 2).sum(1), np.inf)
                at = int(alive[np.argmin(norm)])
        if at < 0:
            if opened == len(left):
                left = np.concatenate((left, np.empty_like(left)))
            left[opened] = full
            at = opened
            opened += 1
            alive = np.append(alive, at)
        left[at] -= item
        out[i] = at
        if left[at, 0] < smallest or left[at, 1] < 1 or left[at, 2] < smallest**2:
            alive = alive[alive != at]
    return out


def pack(
    df: DataFrame, key: str = "doc_id", text: str = "text", model: str = "", capacity: int = 4096, max_docs: int = 16, max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2), group_containers: int = 1500,
) -> DataFrame:
    """(container, key, piece_no, start_token, tokens): the place of each row's text, or of each of its pieces.

    A container holds at most `capacity` tokens, `max_docs` items and `max_attention` of the squares of their sizes (0.95 of
    the capacity's square if not given; an item above it alone stands alone). Only a text above the capacity is split:
    into pieces of exactly the capacity and a rest, counted in tokens from 0. Null and empty texts have no tokens and no
    row; repeated rows are placed each on its own.
    """
    if max_attention is None:
        max_attention = 0.95 * float(capacity) ** 2
    counted = token_counts(df.withColumn("_digest", F.xxhash64(F.col(f"`{text}`"))), key, text, model, estimate=False, keep=("_digest",)).filter("tokens > 0")
    rows = cut(counted.groupBy("key", "_digest", "tokens").agg(F.count(F.lit(1)).alias("rows")), "sizes")  # equal rows are numbered, so that their places don't depend on partitions
    total = rows.agg(F.sum(F.col("tokens") * F.col("rows"))).first()[0] or 0
    groups = max(1, round(total / (capacity * group_containers)))
    each = rows.select("key", "_digest", "tokens", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("twin"))
    items = each.select(
        "key", F.pmod(F.xxhash64("key", "_digest", "twin"), F.lit(groups)).cast("int").alias("grp"), "_digest", "twin",
        F.explode(F.expr(f"transform(sequence(0, CAST((tokens - 1) DIV {capacity} AS INT)), i -> struct(i + 1 AS piece_no, CAST(i AS BIGINT) * {capacity} AS start_token, least(tokens - CAST(i AS BIGINT) * {capacity}, {capacity}) AS tokens))")).alias("p"),
    ).select("grp", "key", "_digest", "twin", "p.*")
    key_type = rows.schema["key"].dataType.simpleString()

    def place(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "key", "_digest", "twin", "piece_no"], ascending=[False, True, True, True, True], kind="stable")
        at = vector_best_fit(pdf["tokens"].to_numpy(), capacity, max_docs, max_attention, weights)
        return pdf.assign(container=np.int64(group[0]) * (1 << 32) + at)[["container", "key", "piece_no", "start_token", "tokens"]]

    return items.repartition(groups, "grp").groupBy("grp").applyInPandas(place, f"container long, key {key_type}, piece_no int, start_token long, tokens long")


def fill_report(placed: DataFrame, capacity: int = 4096, max_docs: int = 16, max_attention: float | None = None) -> DataFrame:
    """(containers, tokens, unused_share, unused_docs, unused_attention, mean_docs, bound_by_docs, bound_by_attention).

    The mean residual shares under the three capacities, and how many containers have room for tokens but for no further
    item, or for no item of the size of the room; shares are null without any containers.
    """
    if max_attention is None:
        max_attention = 0.95 * float(capacity) ** 2
    t = F.col("tokens")
    each = placed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.sum(t.cast("double") * t).alias("attention"))
    room = F.lit(capacity) - t
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), (1 - F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("unused_share"), (1 - F.avg("docs") / max_docs).alias("unused_docs"),
        (1 - F.avg("attention") / max_attention).alias("unused_attention"), F.avg("docs").alias("mean_docs"), F.count_if((room > 0) & (F.col("docs") >= max_docs)).alias("bound_by_docs"),
        F.count_if((room > 0) & (F.col("docs") < max_docs) & (F.col("attention") + room.cast("double") * room > max_attention)).alias("bound_by_attention"),
    )
