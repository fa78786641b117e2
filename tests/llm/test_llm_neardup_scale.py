"""Near duplicates in many small chunks and ranges, with runs that all records share, and with keys that are no numbers."""

import itertools
import random

import pytest

from corpusloom.llm import neardup

WORDS = "probe season salt rinse limit layer signal phase curve load rate value trial film band".split()


def brute(rows, threshold):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def records(n, head, rng):
    """Each record begins with the same words; every third one is an edited copy of the one before."""
    rows = []
    for i in range(n):
        if i % 3 == 2:
            w = rows[-1][1].split()
            w[-rng.randint(1, 6)] = "edit"
        else:
            w = head + [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(7, 30))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("radix", [4, 8, 256])
def test_rounds_of_ranges_lose_nothing(spark, radix):
    rng = random.Random(radix)
    rows = records(330, [], rng)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.a, r.b) for r in neardup.near_duplicate_pairs(df, radix=radix, chunk_runs=1).collect()}  # a chunk for each record
    assert got == brute(rows, 0.6)
    assert len(neardup.radices(48, radix)) == {4: 3, 8: 2, 256: 1}[radix]


def test_blocks_grow_with_the_data():
    for buckets in (48, 256, 60_000, 10_000_000):
        split = neardup.radices(buckets)
        assert max(split) <= neardup.RADIX + 1 and buckets <= split[0] ** len(split) <= 2 * buckets + neardup.RADIX**2


def test_a_run_in_every_record(spark):
    """The run is counted in each chunk; its postings stay there, and its trees are split by size."""
    rng = random.Random(2)
    rows = records(900, "all of these records begin with the same boilerplate of words".split(), rng)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    expected = brute(rows, 0.6)
    assert {(r.a, r.b) for r in neardup.near_duplicate_pairs(df).collect()} == expected
    blocks = df.selectExpr("doc_id AS key", "text").mapInArrow(neardup._blocks([48], 5, 4_000_000, 2), neardup._BLOCK).selectExpr("kind", "octet_length(hashes) DIV 4 AS n").groupBy("kind").sum("n").collect()
    count = {r.kind: r["sum(n)"] for r in blocks}
    assert count[neardup.KNOWN] >= 900 * 6 - 2 * 6 - 50


def test_verified_pairs_and_keys(spark):
    rng = random.Random(3)
    rows = records(60, [], rng)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.a, r.b): r.similarity for r in neardup.near_duplicate_pairs(df, verify=True).collect()}
    assert set(got) == brute(rows, 0.6) and got == {(r.a, r.b): r.similarity for r in neardup.near_duplicate_pairs(df).collect()}
    with pytest.raises(TypeError):
        neardup.near_duplicate_pairs(df.selectExpr("'k' || doc_id AS doc_id", "text"))
