"""Near duplicates: frequent runs in the order of their frequencies, and a shard's trees whether compared in windows or traversed."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import neardup


def test_codes_keep_the_order_of_counts():
    n = np.arange(1, 200_000)
    code = neardup._code(n).astype(int)
    assert (np.diff(code) >= 0).all() and (code[:127] == n[:127]).all() and code.max() < 255
    back = neardup._count(code.astype(np.uint8))
    assert (back <= n).all() and (back * 1.1 >= n).all()
    assert (neardup._code(back) == code).all()
    assert neardup._code(np.asarray([10**7, 10**12])).tolist() == [255, 255]


@pytest.mark.parametrize("order", ["together", "mixed"])
@pytest.mark.parametrize("radix", [256, 8])
def test_frequent_runs_are_ordered_by_frequency(spark, order, radix):
    """Runs of all records come after runs of half of them, whether counted at home or in their range."""
    rng = random.Random(5)
    words = lambda n, tag: [f"{tag}{k}" for k in range(n)]
    texts = [" ".join(words(18, "all") + words(18 * (i < 520), "half") + [f"w{rng.randint(0, 10**9)}" for _ in range(6)]) for i in range(900)]
    if order == "mixed":
        rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string").coalesce(2)
    split = neardup.radices(48, radix)
    spans = [int(np.prod(split[k + 1 :])) for k in range(len(split))]
    blocks = df.mapInArrow(neardup._blocks(split, 5, 4_000_000, 2), neardup._BLOCK)
    if len(split) > 1:
        blocks = blocks.repartition(4, "kind", "bucket", F.expr("grp >> 8")).sortWithinPartitions("kind", "bucket", F.expr("grp >> 8")).mapInArrow(neardup._down(split[1], spans[1]), neardup._BLOCK)
    shared = blocks.repartition(8, F.when(F.col("kind") == neardup.POSTINGS, F.col("bucket")).otherwise(-F.col("grp"))).mapInArrow(neardup._frequencies, neardup._BLOCK)
    if len(split) > 1:
        home = [F.expr(f"CASE WHEN kind = {neardup.POSTINGS} THEN bucket DIV {split[1]} ELSE -1 END"), F.col("grp")]
        shared = shared.repartition(4, *home).sortWithinPartitions(*home).mapInArrow(neardup._up(split[1], spans[1], 1), neardup._BLOCK)
    got = shared.repartition(2, "grp").mapInArrow(neardup._records(0.6, spans[0]), "key long, set_key binary, size int, tokens binary, leading binary, hot int").collect()
    assert len(got) == 900
    count = Counter(t for r in got for t in neardup.unpack_tokens(r.tokens).tolist())
    assert max(count.values()) == 900 and 520 in count.values()
    for r in got:
        leading = np.frombuffer(r.leading, "<u8").tolist()
        rest = set(neardup.unpack_tokens(r.tokens).tolist()) - set(leading)
        assert max(count[t] for t in leading) <= min(count[t] for t in rest)
        assert {count[t] for t in leading} == {520 if "half0" in texts[r.key] else 900} and r.hot == len(leading)


@pytest.mark.parametrize("longest", [1, 20, 4_096])
def test_windows_and_trees_find_the_same(monkeypatch, longest):
    monkeypatch.setattr(neardup, "LONG", longest)
    rng = np.random.default_rng(11)
    order = rng.permutation(np.arange(1, 3_000, dtype=np.uint64) << np.uint64(20))
    sets = []
    for i in range(400):  # subsets of the order, later tokens more often; every other one is an edited earlier one
        if i % 2:
            base = sets[rng.integers(len(sets))]
            sets.append(np.unique(np.append(base[rng.random(len(base)) > rng.choice([0, 0.1, 0.25])], rng.integers(0, 3_000 - 1, 3))))
        else:
            sets.append(np.unique((2_998 * rng.random(rng.integers(20, 200)) ** 0.2).astype(int)))
    rows = []
    for i, s in enumerate(sets):
        size = len(s) + i % 7  # some runs are nobody else's
        lead = len(s) - int(np.ceil(0.6 * size - 1e-9)) + 1
        if lead > 0:
            rows.append({"set_key": i.to_bytes(16, "big"), "size": size, "tokens": neardup.pack_tokens(order[s]), "leading": order[s][:lead].astype("<u8").tobytes(), "hot": int((s[:lead] >= 2_900).sum())})
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 150]) for k in range(0, len(rows), 150)] * 2  # each record twice
    for trees in (1, 5):
        blocks = [b for part in (batches[:3], batches[3:]) for b in neardup._routes(trees, 0.6, records=64)(iter(part))]
        found = Counter()
        for v in range(trees):
            own = [b.filter(pa.compute.equal(b["shard"], v)) for b in blocks]
            pairs = [(a, b) for out in neardup._candidates(0.6)(iter(own)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
            assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
            found.update(pairs)
        size = {r["set_key"]: r["size"] for r in rows}
        own = {r["set_key"]: set(neardup.unpack_tokens(r["tokens"]).tolist()) for r in rows}
        alike = {(a, b) for a in own for b in own if a < b and (both := len(own[a] & own[b])) / (size[a] + size[b] - both) >= 0.6}
        assert len(alike) > 50 and alike <= set(found)


def test_keys_in_several_rows_give_each_pair_once(spark):
    line = " ".join(f"w{k}" for k in range(30))
    rows = [(1, line), (2, line), (2, line + " end"), (3, line + " other"), (1, line), (4, "nothing like any of the other lines here")]
    for several in (rows, rows[1:2] + rows[3:5]):
        df = spark.createDataFrame(several, "doc_id long, text string")
        got = [(r.a, r.b) for r in neardup.near_duplicate_pairs(df).select("a", "b").distinct().collect()]
        assert sorted(got) == [(1, 2), (1, 3), (2, 3)]
    one = [(r.a, r.b) for r in neardup.near_duplicate_pairs(df).collect()]
    assert sorted(one) == [(1, 2), (1, 3), (2, 3)]
