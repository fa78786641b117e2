"""Problem 6: groups of records whose word runs overlap by a threshold, without comparing all pairs.

Method: signature trees. A node of a tree holds the OR and the AND of its records' token bitmaps and the range of their
sizes; a dual traversal of a tree with itself drops a pair of nodes as soon as the largest overlap they could have is
too small for their sizes, and the records left in the leaves are compared. One tree over everything would have to look
at every pair of leaves once, so there is a forest: a tree for each rare token that two records of a similar pair must
share (in the global order from rare to frequent tokens, both have one among their first ones). An exact intersection
of the tokens follows. No pair above the threshold is lost. A run is known by a hash of 37 bits or more (32 and the hash
range), so two different runs of a pair count as one about once in 10^6 pairs; verify=True compares the pairs' texts.

What moves: the hashed runs of all records once, packed by hash range (frequencies need them all); back from there only
runs that occur in two records or more; then bitmaps of the records for which enough of those are left. Records with
the same set of runs are one class from then on; their pairs come from the class, not from comparisons.

Scale: runs go to their hash ranges, and back, in rounds of at most RADIX ranges each, so that the number of blocks
grows with the data, not with its square. A run that fills a chunk (boilerplate of many records) is counted once a chunk
and its postings stay at home; trees of such runs are split by the records' sizes. With a leading token goes the number of
tokens from it on, the most that two records can share of which it is the first common one; trees of up to LONG records
are compared in the order of sizes, larger ones traversed. Each shard needs the bitmaps of its records, so that shards
are as few as their leading tokens allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import cut, pieces

BITS = 512
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def word_runs(text: str, hashes: dict, length: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `length` words, small letters, words separated by white space."""
    words = text.lower().split()
    if len(words) < length:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - length + 1
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = (out ^ h[k : k + n]) * _MIX[k % len(_MIX)]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def _split(values: np.ndarray) -> bytes:
    """Sorted uint32 as differences, low halves before high ones: the high ones are nearly all small and compress."""
    d = np.diff(values, prepend=np.uint32(0)).astype(np.uint32)
    return (d & np.uint32(0xFFFF)).astype("<u2").tobytes() + (d >> np.uint32(16)).astype("<u2").tobytes()


def _join(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, "<u2").astype(np.uint32)
    n = len(halves) // 2
    return np.cumsum(halves[:n] | (halves[n:] << np.uint32(16)), dtype=np.uint32)


_BLOCK = "kind int, bucket long, grp long, hashes binary, places binary, rest binary, counts binary"
_BLOCK_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("grp", pa.int64()), *((c, pa.binary()) for c in ("hashes", "places", "rest", "counts"))])
#: Blocks: POSTINGS of a hash range in a group of chunks; KNOWN ones, whose frequency no other chunk need tell; a chunk's META data.
POSTINGS, KNOWN, META = range(3)
MANY = 255
RADIX = 2048
_PLACE = np.uint32(0xFFFF)
_ALONE = np.uint32(0xFF00)  # in place of a document, from here on: postings that stayed with their chunk; the lower byte is the code of their number


def _code(count: np.ndarray) -> np.ndarray:
    """Numbers in a byte that keeps their order: below 128 as they are, then in steps of a twelfth, up to 7 million."""
    return np.where(count < 128, count, np.minimum(255, 128 + np.floor(8 * np.log2(np.maximum(count, 128) / 128)))).astype(np.uint8)


def _count(code: np.ndarray) -> np.ndarray:
    return np.where(code < 128, code, np.ceil(128 * 2 ** (np.maximum(code.astype(np.int64) - 128, 0) / 8))).astype(np.int64)


HOT = int(_code(np.asarray(MANY)))


def radices(buckets: int, radix: int = RADIX) -> list[int]:
    """How many ranges each round splits a range into; their product is `buckets` or a little more, three rounds at most."""
    rounds = 1
    while radix**rounds < buckets and rounds < 3:
        rounds += 1
    each = int(np.ceil(buckets ** (1 / rounds) - 1e-9))
    return [max(1, each)] * rounds


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_BLOCK_ARROW.names, r, strict=True)) for r in rows], _BLOCK_ARROW)


def _values(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of sorted values."""
    if not len(values):
        return []
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return list(zip(values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)], strict=True))


def _pack_places(places: np.ndarray) -> bytes:
    """Places (chunk modulo 2^16, document in it) as halves; the chunk's are all alike in a block of one chunk."""
    return (places & np.uint32(0xFFFF)).astype("<u2").tobytes() + (places >> np.uint32(16)).astype("<u2").tobytes()


def _unpack_places(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, "<u2").astype(np.uint32)
    n = len(halves) // 2
    return halves[:n] | (halves[n:] << np.uint32(16))


def _rest(data: bytes, n: int) -> np.ndarray:
    return _join(data).astype(np.int64) if data else np.zeros(n, np.int64)


def _blocks(split: list[int], length: int, chunk_runs: int, parts: int):
    """Map: texts to blocks of hashed runs by the first digit of their hash range, and a chunk's keys, sizes and set digests.

    A run that MANY records of a chunk or more have goes out once, for all of them; those postings are KNOWN.
    """
    buckets = int(np.prod(split))
    span = buckets // split[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        hashes = WordHashes()
        number = 0
        keys: list[int] = []
        sets: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            nonlocal number
            chunk = part + number * parts
            number += 1
            size = np.asarray([len(s) for s in sets], np.int64)
            every = np.concatenate(sets)
            place = np.repeat(np.arange(len(sets)), size).astype(np.uint32) | np.uint32((chunk & 0xFFFF) << 16)
            digest = [np.bitwise_xor.reduce(s * _MIX[0]) ^ np.uint64(len(s)) for s in sets]
            digest2 = [np.add.reduce((s ^ (s >> np.uint64(33))) * _MIX[2]) for s in sets]
            upper = every >> np.uint64(32)
            bucket = (upper % np.uint64(buckets)).astype(np.int64)
            # What the range leaves of the upper half goes into the run's identity by mixing it into the lower half.
            low = every.astype(np.uint32) ^ (upper // np.uint64(buckets)).astype(np.uint32) * np.uint32(0x9E3779B1)
            order = np.lexsort((low, bucket))
            bucket, low, place = bucket[order], low[order], place[order]
            rows: list[tuple] = [(META, 0, chunk, np.asarray(keys, "<i8").tobytes(), size.astype("<i4").tobytes(), np.stack([digest, digest2], 1).astype("<u8").tobytes(), b"")]

            def add(kind: int, which: slice | np.ndarray) -> None:
                b, h, d = bucket[which], low[which], place[which]
                for v, i, j in _values(b // span):
                    rows.append((kind, v, chunk, _split(h[i:j]), _pack_places(d[i:j]), _split((b[i:j] - v * span).astype(np.uint32)) if span > 1 else b"", b""))

            first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1])))
            count = np.diff(np.append(first, len(low)))
            if (count >= MANY).any():
                home = np.repeat(count >= MANY, count)
                add(KNOWN, home)
                told = first[count >= MANY]
                place[told] = (place[told] & ~_PLACE) | _ALONE | _code(count[count >= MANY])
                home[told] = False
                add(POSTINGS, ~home)
            else:
                add(POSTINGS, slice(None))
            keys.clear()
            sets.clear()
            return _batch(rows)

        held = 0
        for batch in pieces(batches, "text"):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                runs = word_runs(text, hashes, length)
                if not len(runs):
                    continue
                keys.append(key)
                sets.append(runs)
                held += len(runs)
                if held >= chunk_runs or len(sets) >= 65_000:
                    yield emit()
                    held = 0
            if len(hashes) > 1_000_000:
                hashes.clear()
        if sets:
            yield emit()

    return run


def _by_key(batches: Iterator[pa.RecordBatch], digits: int = 1, group: int = 0) -> Iterator[tuple[tuple[int, int] | None, list[dict]]]:
    """The postings of each (bucket // digits, grp >> group) of blocks sorted by it; other blocks come alone, with None."""
    at, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] != POSTINGS:
                yield None, [r]
                continue
            key = (r["bucket"] // digits, r["grp"] >> group)
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append(r)
    if held:
        yield at, held


def _down(digits: int, span: int):
    """Reduce: the blocks of a range in a group of chunks, merged and cut into the range's `digits` parts of `span` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, blocks in _by_key(batches, group=8):
            if key is None:
                yield _batch([tuple(r.values()) for r in blocks])
                continue
            low = [_join(r["hashes"]) for r in blocks]
            rest = np.concatenate([_rest(r["rest"], len(h)) for r, h in zip(blocks, low, strict=True)])
            low, place = np.concatenate(low), np.concatenate([_unpack_places(r["places"]) for r in blocks])
            order = np.lexsort((low, rest))
            low, place, rest = low[order], place[order], rest[order]
            yield _batch([(POSTINGS, key[0] * digits + v, key[1], _split(low[i:j]), _pack_places(place[i:j]), _split((rest[i:j] - v * span).astype(np.uint32)) if span > 1 else b"", b"") for v, i, j in _values(rest // span)])

    return run


def _up(digits: int, span: int, level: int):
    """Reduce: the other way: the parts of a range in a group of chunks, merged and cut by the smaller groups of the level below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, blocks in _by_key(batches, digits):
            if key is None:
                yield _batch([tuple(r.values()) for r in blocks])
                continue
            low = [_join(r["hashes"]) for r in blocks]
            rest = np.concatenate([_rest(r["rest"], len(h)) + (r["bucket"] % digits) * span for r, h in zip(blocks, low, strict=True)])
            place = np.concatenate([_unpack_places(r["places"]) for r in blocks])
            count = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in blocks])
            low = np.concatenate(low)
            chunk = ((key[1] << (8 * level)) & ~0xFFFF) | (place >> np.uint32(16)).astype(np.int64)
            group = chunk >> (8 * (level - 1))
            order = np.lexsort((low, rest, group))
            low, place, rest, count, group = low[order], place[order], rest[order], count[order], group[order]
            yield _batch([(POSTINGS, key[0], v, _split(low[i:j]), _pack_places(place[i:j]), _split(rest[i:j].astype(np.uint32)), count[i:j].tobytes()) for v, i, j in _values(group)])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce: all blocks of some hash ranges to blocks of the runs in two records or more, with the code of their frequency."""
    by: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["kind"] != POSTINGS:
                out.append(tuple(r.values()))
            else:
                by.setdefault(r["bucket"], []).append((r["grp"], _join(r["hashes"]), _unpack_places(r["places"])))
        if out:
            yield _batch(out)
    for bucket, blocks in by.items():
        every = np.concatenate([h for _, h, _ in blocks])
        order = np.argsort(every, kind="stable")
        place = np.concatenate([d for _, _, d in blocks]) & _PLACE
        weight = np.where(place >= _ALONE, _count(place & np.uint32(0xFF)), 1)[order]
        every = every[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        count = np.add.reduceat(weight, first)
        shared, count = every[first][count > 1], _code(count[count > 1])
        out = []
        for grp, h, place in blocks:
            at = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
            ok = shared[at] == h if len(shared) else np.zeros(len(h), bool)
            if ok.any():
                out.append((POSTINGS, bucket, grp, _split(h[ok]), _pack_places(place[ok]), b"", count[at[ok]].tobytes()))
        if out:
            yield _batch(out)


def _records(threshold: float, span: int):
    """Reduce: a chunk's blocks to its records that could have a partner: (key, set digest, size, tokens, the leading ones of
    which any partner shares one, how many of these, the last ones, are in MANY records or more)."""
    schema = pa.schema([("key", pa.int64()), ("set_key", pa.binary()), ("size", pa.int32()), ("tokens", pa.binary()), ("leading", pa.binary()), ("hot", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta: dict[int, tuple] = {}
        parts: dict[int, list[tuple]] = {}
        told: dict[int, list[tuple]] = {}  # frequencies of what stayed in the chunk
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == META:
                    meta[r["grp"]] = (np.frombuffer(r["hashes"], "<i8"), np.frombuffer(r["places"], "<i4"), r["rest"])
                else:
                    h = _join(r["hashes"])
                    token, place = ((r["bucket"] * span + _rest(r["rest"], len(h))).astype(np.uint64) << np.uint64(32)) | h.astype(np.uint64), _unpack_places(r["places"]) & _PLACE
                    count = np.frombuffer(r["counts"], np.uint8) if r["kind"] == POSTINGS else np.zeros(len(h), np.uint8)
                    alone = place >= _ALONE
                    if alone.any():
                        told.setdefault(r["grp"], []).append((token[alone], count[alone]))
                        token, place, count = token[~alone], place[~alone], count[~alone]
                    parts.setdefault(r["grp"], []).append((token, place, count))
        for chunk, blocks in parts.items():
            keys, sizes, digests = meta[chunk]
            token, doc, count = (np.concatenate(x) for x in zip(*blocks, strict=True))
            if chunk in told:
                known, often = (np.concatenate(x) for x in zip(*told.pop(chunk), strict=True))
                order = np.argsort(known)
                count[count == 0] = often[order][np.searchsorted(known, token[count == 0], sorter=order)]
            doc = doc.astype(np.int64)
            shared = np.bincount(doc, minlength=len(keys))
            need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
            alive = shared >= np.maximum(need, 1)
            keep = alive[doc]
            order = np.lexsort((token[keep], count[keep], doc[keep]))
            doc, token, count = doc[keep][order], token[keep][order], count[keep][order]
            edge = np.searchsorted(doc, np.arange(len(keys) + 1))
            rows = []
            for i in np.flatnonzero(alive).tolist():
                own = token[edge[i] : edge[i + 1]]  # rare ones first
                lead = int(shared[i] - need[i] + 1)
                rows.append({"key": int(keys[i]), "set_key": digests[16 * i : 16 * i + 16], "size": int(sizes[i]), "tokens": pack_tokens(own), "leading": own[:lead].astype("<u8").tobytes(), "hot": int((count[edge[i] : edge[i] + lead] >= HOT).sum())})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def pack_tokens(tokens: np.ndarray) -> bytes:
    """Sorted tokens, all low halves before all high ones, which are few different values in rows."""
    t = np.sort(tokens)
    return t.astype("<u4").tobytes() + (t >> np.uint64(32)).astype("<u4").tobytes()


def unpack_tokens(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, "<u4").astype(np.uint64)
    n = len(halves) // 2
    return halves[:n] | (halves[n:] << np.uint64(32))


def bitmaps(tokens: np.ndarray, owner: np.ndarray, records: int) -> np.ndarray:
    """A row of uint64 words for each record, a bitmap of BITS bits of its tokens."""
    on = np.zeros((records, BITS), bool)
    on[owner, ((tokens * _MIX[1]) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)] = True
    return np.packbits(on, axis=1, bitorder="little").view("<u8")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    return bitmaps(tokens, np.zeros(len(tokens), np.int64), 1)[0]


_ROUTE = "shard int, set_keys binary, sizes binary, bits binary, owners binary, leading binary, rest binary"


def _routes(trees: int, threshold: float, records: int = 4_000):
    """Map: blocks of records for each shard of the forest that holds some of their leading tokens.

    With each leading token goes `rest`, how many tokens the record has from there on: no more can be common to two
    records of which it is the first common one. Trees of tokens in MANY records or more are one for each band of sizes; a
    record goes into its own band's and the next one's, as the sizes of a similar pair lie in one band or in two that touch.
    """
    width = max(float(np.log(1 / threshold)), 0.05)
    schema = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("set_keys", "sizes", "bits", "owners", "leading", "rest"))])

    def blocks(held: list[tuple]) -> pa.RecordBatch:
        keys, size, tokens, leading, hot = zip(*held, strict=True)
        size, hot = np.asarray(size, np.int64), np.asarray(hot, np.int64)
        every = [unpack_tokens(x) for x in tokens]
        shared = np.asarray([len(x) for x in every])
        bits = bitmaps(np.concatenate(every), np.repeat(np.arange(len(keys)), shared), len(keys))
        many = np.asarray([len(x) // 8 for x in leading])
        token, owner = np.frombuffer(b"".join(leading), "<u8"), np.repeat(np.arange(len(keys)), many)
        place = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)
        rest, often = shared[owner] - place, place >= (many - hot)[owner]
        band = np.floor(np.log(size) / width + 1e-9).astype(np.int64).astype(np.uint64)[owner[often]]
        token = np.concatenate((token[~often], *(token[often] * _MIX[4] ^ (band + np.uint64(k)) * _MIX[5] for k in (1, 2))))
        owner, rest = (np.concatenate((x[~often], x[often], x[often])) for x in (owner, rest))
        shard = ((token * _MIX[3]) >> np.uint64(32)) % np.uint64(trees)
        order = np.lexsort((owner, shard))
        token, owner, rest, shard = token[order], owner[order], rest[order], shard[order]
        digests = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        sizes = np.stack([size, shared], 1).astype("<i4")
        rows = []
        for v, i, j in _values(shard):
            own, at = np.unique(owner[i:j], return_inverse=True)
            rows.append({"shard": v, "set_keys": digests[own].tobytes(), "sizes": sizes[own].tobytes(), "bits": bits[own].tobytes(), "owners": at.astype("<u4").tobytes(), "leading": token[i:j].astype("<u8").tobytes(), "rest": rest[i:j].astype("<i4").tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), []  # copies of a record go on as one
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("set_key", "size", "tokens", "leading", "hot")), strict=True):
                if r[0] not in seen:
                    seen.add(r[0])
                    held.append(r)
                    if len(held) >= records:
                        yield blocks(held)
                        held = []
        if held:
            yield blocks(held)

    return run


class Node:
    """A level of a signature tree as arrays: OR and AND of bitmaps, ranges of sizes, most shared tokens, most of them from the tree's own on; children are ranges of the level below."""

    def __init__(self, any_: np.ndarray, all_: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray, rest: np.ndarray | None = None):
        self.any, self.all, self.low, self.high, self.most, self.rest = any_, all_, low, high, most, most if rest is None else rest

    def up(self, fan: int) -> Node:
        at = np.arange(0, len(self.low), fan)
        return Node(np.bitwise_or.reduceat(self.any, at), np.bitwise_and.reduceat(self.all, at), np.minimum.reduceat(self.low, at), *(np.maximum.reduceat(x, at) for x in (self.high, self.most, self.rest)))


def possible(x: Node, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two nodes of a level can hold a similar pair: sizes near enough, and the largest overlap large enough."""
    need = threshold / (1 + threshold) * (x.low[i] + x.low[j]) - 1e-6
    ok = (x.high[j] >= threshold * x.low[i] - 1e-9) & (x.high[i] >= threshold * x.low[j] - 1e-9) & (np.minimum(x.rest[i], x.rest[j]) >= need)
    at = np.flatnonzero(ok)
    a, b = i[at], j[at]
    over = np.minimum(x.most[a] - np.bitwise_count(x.all[a] & ~x.any[b]).sum(1).astype(np.int64), x.most[b] - np.bitwise_count(x.all[b] & ~x.any[a]).sum(1).astype(np.int64))
    ok[at] = over >= need[at]
    return ok


def dual_traversal(leaf: Node, threshold: float, fan: int = 8, block: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of records (i < j) of one tree that the bitmaps don't rule out. Pairs of nodes are worked on in blocks, depth first."""
    levels = [leaf]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].up(fan))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if len(i) > block:
            stack += [(k, i[s : s + block], j[s : s + block]) for s in range(0, len(i), block)]
            continue
        ok = possible(levels[k], i, j, threshold) | ((i == j) & (k > 0))
        i, j = i[ok], j[ok]
        if not k:
            if len(i):
                yield i, j
            continue
        n = len(levels[k - 1].low)
        a = (i[:, None, None] * fan + np.arange(fan)[None, :, None] + np.zeros((1, 1, fan), np.int64)).ravel()
        b = (j[:, None, None] * fan + np.arange(fan)[None, None, :] + np.zeros((1, fan, 1), np.int64)).ravel()
        keep = (a < n) & (b < n) & ((a < b) if k == 1 else (a <= b))
        if keep.any():
            stack.append((k - 1, a[keep], b[keep]))


def _near(combined: np.ndarray, size: np.ndarray, rest: np.ndarray, threshold: float, block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places p < q of sorted lists (combined: list << 32 | size) that sizes and the tokens from the common one on don't rule out."""
    share = threshold / (1 + threshold)
    high = np.floor(np.minimum(size / threshold + 1e-6, (rest + 1e-6) / share - size + 1e-6)).astype(np.int64)
    last = np.searchsorted(combined, (combined & ~np.int64(0xFFFFFFFF)) | np.clip(high, 0, 0x7FFFFFFF), side="right")
    n = np.maximum(last - np.arange(1, len(size) + 1), 0)
    at = np.flatnonzero(n)
    if not len(at):
        return
    upto = np.cumsum(n[at])
    cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1], block)))
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
        own = n[at[s:e]]
        p = np.repeat(at[s:e], own)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(own) - own, own)
        ok = rest[q] >= share * (size[p] + size[q]) - 1e-6
        yield p[ok], q[ok]


LONG = 4_096


def _candidates(threshold: float):
    """Reduce: a shard's trees, each over the records with one leading token, to pairs of set digests.

    Up to LONG records are compared in the order of their sizes, all trees at once; longer ones are traversed.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {c: [] for c in ("set_keys", "sizes", "bits", "owners", "leading", "rest")}
        records = 0
        for batch in batches:
            for r in batch.to_pylist():
                for c, kind in (("set_keys", "<u8"), ("sizes", "<i4"), ("bits", "<u8"), ("owners", "<u4"), ("leading", "<u8"), ("rest", "<i4")):
                    parts[c].append(np.frombuffer(r[c], kind) + records if c == "owners" else np.frombuffer(r[c], kind))
                records += len(parts["sizes"][-1]) // 2
        if not records:
            return
        keys, words, token, owner, rest = (np.concatenate(parts.pop(c)) for c in ("set_keys", "bits", "leading", "owners", "rest"))
        size, shared = np.concatenate(parts.pop("sizes")).reshape(-1, 2).astype(np.int64).T
        keys, words = keys.reshape(-1, 2), words.reshape(records, -1)
        # Copies of a record become one; records are numbered by size.
        order = np.lexsort((keys[:, 1], keys[:, 0], size))
        new = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(1))
        number = np.empty(records, np.int64)
        number[order] = np.cumsum(new) - 1
        one = order[new]
        keys, words, size, shared, owner = keys[one], words[one], size[one], shared[one], number[owner.astype(np.int64)]
        order = np.lexsort((owner, token))
        token, owner, rest = token[order], owner[order], rest[order].astype(np.int64)
        start = np.append(True, token[1:] != token[:-1])
        once = start | np.append(True, owner[1:] != owner[:-1])
        start, owner, rest = start[once], owner[once], rest[once]
        first = np.flatnonzero(start)
        length = np.diff(np.append(first, len(owner)))
        leaf = Node(words, words, size, size, shared)
        found: list[np.ndarray] = []
        held = 0

        def take(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal held
            found.append(np.unique(np.minimum(i, j) * len(keys) + np.maximum(i, j)))
            held += len(found[-1])
            if held > 4_000_000 + 2 * len(found[0]):
                found[:] = [np.unique(np.concatenate(found))]
                held = len(found[0])

        every = np.repeat(length, length)
        short = (every > 1) & (every <= LONG)
        at, left, own = (np.repeat(np.arange(len(first)), length)[short], rest[short], owner[short])
        for p, q in _near((at << 32) | size[own], size[own], left, threshold):
            i, j = own[p], own[q]
            ok = possible(leaf, i, j, threshold)
            take(i[ok], j[ok])
        for f, n in zip(first[length > LONG].tolist(), length[length > LONG].tolist(), strict=True):
            own = owner[f : f + n]
            for i, j in dual_traversal(Node(words[own], words[own], size[own], size[own], shared[own], rest[f : f + n]), threshold):
                take(own[i], own[j])
        if found:
            pair = np.unique(np.concatenate(found))
            digest = keys.astype("<u8").view(">u8")
            for s in range(0, len(pair), 100_000):
                i, j = np.divmod(pair[s : s + 100_000], len(keys))
                x, y = digest[i], digest[j]
                swap = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1]))
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(16), len(e), [None, pa.py_buffer(keys[e].tobytes())]).cast(pa.binary()) for e in (i, j)], schema=schema)

    return run


def _exact(threshold: float):
    """Map: pairs with both token lists to their exact similarity."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x, y = unpack_tokens(r["tokens_a"]), unpack_tokens(r["tokens_b"])
                both = len(np.intersect1d(x, y, assume_unique=True))
                s = both / (r["size_a"] + r["size_b"] - both)
                if s >= threshold - 1e-12:
                    rows.append({"a": r["a"], "b": r["b"], "similarity": s})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def similar_sets(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.6, length: int = 5, radix: int = RADIX, chunk_runs: int = 4_000_000, range_runs: int = 3_500_000, shard_tokens: int = 2_500_000) -> tuple[DataFrame, DataFrame]:
    """(members: key, set_key; pairs: a, b, similarity) over the sets of word runs; keys are whole numbers.

    members has each row whose set some other record may share in part; rows of one set have one set_key. pairs has the
    sets of at least the threshold, a < b. Null keys, null texts and texts of fewer than `length` words have no row.
    Keys of another type raise: number them first and join the numbers back.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"keys of near duplicates are whole numbers, `{key}` is {df.schema[key].dataType.simpleString()}")
    base = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL AND key IS NOT NULL")
    # About a run for each six characters: everything is sized by runs, so that long texts count for more.
    chars = base.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    split = radices(max(48, chars // 6 // range_runs), radix)
    buckets = int(np.prod(split))
    spans = [int(np.prod(split[k + 1 :])) for k in range(len(split))]
    parts = base.rdd.getNumPartitions()
    blocks = base.mapInArrow(_blocks(split, length, chunk_runs, parts), _BLOCK)
    home = F.when(F.col("kind") == POSTINGS, F.col("bucket"))
    for k in range(1, len(split)):
        there = [F.coalesce(home, F.lit(-1)), F.shiftright(F.col("grp"), 8)]
        blocks = blocks.repartition(buckets, *there).sortWithinPartitions(*there).mapInArrow(_down(split[k], spans[k]), _BLOCK)
    shared = blocks.repartition(buckets, F.pmod(F.coalesce(home, F.col("grp")), F.lit(buckets))).mapInArrow(_frequencies, _BLOCK)
    for k in range(len(split) - 1, 0, -1):
        back = [F.coalesce(F.expr(f"CASE WHEN kind = {POSTINGS} THEN bucket DIV {split[k]} END"), F.lit(-1)), F.col("grp")]
        shared = shared.repartition(buckets, *back).sortWithinPartitions(*back).mapInArrow(_up(split[k], spans[k], k), _BLOCK)
    chunks = max(24, chars // 6 // range_runs)
    alive = cut(shared.repartition(chunks, "grp").mapInArrow(_records(threshold, spans[0]), "key long, set_key binary, size int, tokens binary, leading binary, hot int"), "records")
    # Every shard that holds a leading token of a record gets its bitmap: no more shards than their memory asks for.
    leading = alive.agg(F.coalesce(F.sum(F.octet_length("leading")), F.lit(0))).first()[0] // 8
    shards = max(8, leading // shard_tokens)
    routed = alive.select("set_key", "size", "tokens", "leading", "hot").mapInArrow(_routes(shards, threshold), _ROUTE)
    candidates = cut(routed.repartitionById(shards, "shard").mapInArrow(_candidates(threshold), "a binary, b binary").distinct(), "candidates")
    ends = candidates.select(F.col("a").alias("set_key")).union(candidates.select("b")).distinct()
    sets = alive.join(ends, "set_key", "left_semi").groupBy("set_key").agg(F.first("tokens").alias("tokens"), F.first("size").alias("size"))
    x = sets.select(F.col("set_key").alias("a"), F.col("tokens").alias("tokens_a"), F.col("size").alias("size_a"))
    y = sets.select(F.col("set_key").alias("b"), F.col("tokens").alias("tokens_b"), F.col("size").alias("size_b"))
    pairs = candidates.join(x, "a").join(y, "b").mapInArrow(_exact(threshold), "a binary, b binary, similarity double")
    return alive.select("key", "set_key"), pairs


def near_duplicate_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.6, length: int = 5, verify: bool = False, **sizes: int) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows at least as similar as the threshold, copies included.

    verify: compare the pairs' texts once more, run by run, so that no two runs count as one by their hashes.
    """
    members, pairs = similar_sets(df, key, text, threshold, length, **sizes)
    a, b = members.toDF("a", "sa"), members.toDF("b", "sb")
    sets = cut(pairs, "pairs")
    across = sets.withColumnsRenamed({"a": "sa", "b": "sb"}).join(a, "sa").join(b, "sb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    several = members.groupBy("set_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("set_key")
    m = members.join(several, "set_key", "left_semi")
    within = m.select("set_key", F.col("key").alias("a")).join(m.select("set_key", F.col("key").alias("b")), "set_key").filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    found = across.filter("a < b").unionByName(within)
    if members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):  # only pairs of keys that stand in several rows come twice
        found = found.distinct()
    if not verify:
        return found
    texts = df.select(F.col(f"`{key}`").cast("long").alias("a"), F.col(f"`{text}`").alias("text_a")).filter("text_a IS NOT NULL")
    both = found.join(texts, "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                p, q = ({tuple(w[i : i + length]) for i in range(len(w) - length + 1)} for w in (x.lower().split(), y.lower().split()))
                values.append(len(p & q) / max(1, len(p | q)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(values, pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(compare, "a long, b long, similarity double").filter(F.col("similarity") >= threshold - 1e-12).distinct()


def near_duplicate_groups(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.6, length: int = 5) -> DataFrame:
    """(key, group_id, links): connected groups of near duplicates; one row for each row that has a partner.

    group_id is the least key of the group, links the number of its partners of other wording, copies aside. Labels
    spread by alternating large and small stars over the links of the sets, each round cut; the number of rounds is
    logarithmic in the longest chain.
    """
    members, pairs = similar_sets(df, key, text, threshold, length)
    links = cut(pairs.select("a", "b"), "links")
    edges = links
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        nxt = down.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).distinct()
        nxt = cut(nxt.filter("a <> b"), "stars")
        if not nxt.exceptAll(edges.select("a", "b")).take(1) and not edges.select("a", "b").exceptAll(nxt).take(1):
            break
        edges = nxt
    root = edges.groupBy("a").agg(F.min("b").alias("root"))
    degree = links.union(links.select("b", "a")).toDF("set_key", "other").groupBy("set_key").agg(F.count(F.lit(1)).alias("links"))
    labelled = members.join(root.withColumnRenamed("a", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key")).join(degree, "set_key", "left")
    sizes = labelled.groupBy("root").agg(F.min("key").alias("group_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return labelled.join(sizes, "root").select("key", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
