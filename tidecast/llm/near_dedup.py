"""Near-duplicate documents: SimHash with sharded BK-trees, then an exact join; all pairs of word-shingle Jaccard 0.8 or more.

A document is the set of its shingles of ``words`` ASCII-lower-cased words (a
shorter text is its own single shingle, a wordless one the empty set).  Texts
with equal sets are one node.

SimHash comes first: each set has a fingerprint of 64 bits (a bit is 1 if set in over
half of its shingles' hashes), and sets with equal fingerprints, or with such as the
sharded BK-trees of ``simhash`` link at ``RADIUS`` or fewer bits, are proposed as
pairs.  Proposed pairs are verified exactly, as all others are.

The join then finds the pairs that no radius would.  Its candidates come from prefixes: when every set is sorted by one common order, two
sets with Jaccard t or more share a shingle among the first n - ceil(t * n) + 1
of each.  The order starts with the shingles whose hash lies in the lowest
``REGION`` of all numbers, and of these with those that stand in one set only;
they cannot be shared, so they open no bucket, and a document in which they fill
the prefix has no near copy.  Which of them stand in one set only is told
exactly (but for hashes that agree in about 40 bits, which only make more work):
shingles are dealt by hash, twelve bytes each, to as many tasks as there are
millions of them.  What many sets of a chunk have in common goes as one.  A
SimHash radius has no such bound: at Jaccard 0.8 a tenth to a fifth of the bits
differ, and some pairs differ in more.

Sets are made from the texts again where they are needed and never stored as a
whole, as they are larger than the texts.

Buckets are compared as those of ``line_dedup``: every set with the bucket's
leader, then what is left in different components, in blocks; pairs are verified
exactly.  Shingles and sets are known by 64 bits of hash.

Defined results: a null text is wordless; all wordless texts are one group; a
null id gets its component's smallest id (null if it has none); repeated rows
stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop, lean, small_batches, written
from .line_dedup import _BASE, _mix, _signed, bucket_components, bucket_members
from .simhash import hamming_edges, majority
from .sketch import key_filter, may_hold

WORDS, SIMILARITY, RADIUS = 5, 0.8, 3
REGION = 0x66666666  # of 2**32: the share of the hashes that are counted
_PER_TASK = 1 << 20  # shingles


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    one = np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))
    n = min(words, len(w))
    h = np.zeros(max(len(w) - n + 1, 0) if w else 0, np.uint64)
    for i in range(n):
        h = h * _BASE + _mix(one[i : i + len(h)] + np.uint64(n))
    return np.unique(_mix(h))


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _sets(said: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in said]


def row_hash(doc_id: Column, text: Column) -> Column:
    """What tells rows apart beside their id."""
    return F.xxhash64(doc_id.cast("bigint"), text.cast("string"))


def _rows(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), row_hash(doc_id, text).alias("row"), text.alias("text"))


def _key(h: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(h.tobytes(), 11)


def _in_region(h: np.ndarray) -> int:
    """How many of a sorted set come first in the common order."""
    return int(np.searchsorted(h, np.uint64(REGION << 32)))


def set_sizes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row (hash of id and text), key (hash of the set), n (its size), low (those in the region), fp (SimHash)."""

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, n, low, fp = [], [], [], []
            for x in batch.column(2):
                h = shingle_set(x.as_py(), words)
                keys.append(_key(h))
                n.append(len(h))
                low.append(_in_region(h))
                fp.append(majority(h))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(_signed(keys)), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(_signed(fp))],
                names=["doc_id", "row", "key", "n", "low", "fp"],
            )

    return _rows(docs).mapInArrow(batches, "doc_id long, row long, key long, n long, low long, fp long")


def _dealt(h: np.ndarray, keys: np.ndarray, ranges: int, salt: int) -> Iterator[tuple[int, int, bytes, bytes, bytes | None]]:
    """task, range, 32 bits of each hash, keys, bits of those told: the shingles of a chunk, by ranges of their hash.

    What different sets of the chunk share is told at once, in tasks of its own, and stands in its range once.
    """
    top = (h >> np.uint64(32)).astype(np.int64)
    at = np.where(top < REGION, top * ranges // REGION, ranges + (top - REGION) * ranges // ((1 << 32) - REGION))
    band = at << 32 | ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(band, kind="stable")
    band, keys = band[order], keys[order]
    shared, first = _shared(band, keys)
    for told, some in ((True, shared), (False, ~shared | first)):
        b, k, s = band[some], keys[some], shared[some]
        r = b >> 32
        cuts = np.flatnonzero(np.diff(r)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(b)]):
            if j > i:
                task = int(r[i]) + (2 * ranges * (1 + salt) if told else 0)
                yield task, int(r[i]), b[i:j].astype(np.uint32).tobytes(), k[i:j].tobytes(), None if told else np.packbits(s[i:j]).tobytes()


def _shared(band: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted bands: where more than one key has the band, and where a band begins."""
    first = np.ones(len(band), bool)
    first[1:] = band[1:] != band[:-1]
    if not len(band):
        return first, first
    starts = np.flatnonzero(first)
    sizes = np.diff(starts, append=len(band))
    other = keys != np.repeat(keys[starts], sizes)
    return np.repeat(np.logical_or.reduceat(other, starts), sizes), first


def shared_shingles(docs: DataFrame, one: DataFrame, similarity: float, words: int) -> tuple[DataFrame, int]:
    """key, band: the shingles of the region, and of longer prefixes, that stand in two sets or more; and the first band beyond the region."""
    # Rows whose set another row stands for are left out, but for a few the filter lets pass.
    bits, width = key_filter(one, "row")
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    ranges = one.agg(F.sum("low").alias("n")).first()["n"] or 0
    ranges = ranges // _PER_TASK + 1

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(held: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
            k = np.repeat(_signed(keys), [len(x) for x in held])
            parts = list(zip(*_dealt(np.concatenate(held), k, ranges, keys[0] % 64))) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, kinds)], names=["task", "range", "h", "keys", "told"])

        held, keys, size = [], [], 0
        for batch in it:
            rows = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in np.flatnonzero(may_hold(shared.value, rows, width)):
                h = shingle_set(batch.column(1)[int(i)].as_py(), words)
                if len(h):
                    keys.append(_key(h))
                    held.append(h[: max(_in_region(h), prefix_size(len(h), similarity))])
                    size += len(held[-1])
                if size > _PER_TASK:
                    yield put(held, keys)
                    held, keys, size = [], [], 0
        if held:
            yield put(held, keys)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = [np.frombuffer(x, np.uint32) for x in pdf["h"]]
        band = np.concatenate([x.astype(np.int64) | r << 32 for x, r in zip(h, pdf["range"].tolist())])
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["keys"]])
        if pdf["told"].isna().any():  # all were told by their chunk
            return pd.DataFrame({"key": keys, "band": band})
        told = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(x)) for t, x in zip(pdf["told"], h)]).astype(bool)
        order = np.argsort(band, kind="stable")
        band, keys, told = band[order], keys[order], told[order]
        again, first = _shared(band, keys)
        starts = np.flatnonzero(first)
        again |= np.repeat(np.logical_or.reduceat(told, starts), np.diff(starts, append=len(band)))
        out = again & ~told
        return pd.DataFrame({"key": keys[out], "band": band[out]})

    parts = _rows(docs).select("row", "text").mapInArrow(batches, "task long, range long, h binary, keys binary, told binary")
    out = written(parts.groupBy("task").applyInPandas(merge, "key long, band long"), "shared-shingles")
    shared.destroy()
    return out, ranges << 32


def prefix_buckets(docs: DataFrame, one: DataFrame, similarity: float, words: int) -> DataFrame:
    """key, bands: the shingles of each set's prefix that another set's may hold; a written table."""
    shared, beyond = shared_shingles(docs, one, similarity, words)
    prefix = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    again = shared.groupBy("key").agg(F.count_if(F.col("band") < beyond).alias("again"))
    need = one.join(again, "key").select("key", (prefix - F.col("low") + F.col("again")).cast("int").alias("k")).where("k > 0")
    need = written(need, "set-prefixes")
    bits, width = key_filter(need, "key")
    held = shared.sparkSession.sparkContext.broadcast(bits)

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(may_hold(held.value, batch.column(0).to_numpy().view(np.uint64), width)))

    rows = shared.mapInArrow(batches, "key long, band long").join(need, "key")
    bands = rows.groupBy("key").agg(F.sort_array(F.collect_list("band")).alias("bands"), F.first("k").alias("k"))
    out = written(bands.select("key", F.slice("bands", F.lit(1), F.col("k")).alias("bands")), "set-bands")
    held.destroy()
    drop(shared, need)
    return out


def sets_of(docs: DataFrame, one: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """key, said (the set's hashes) for every key of ``keys`` (key); a written table."""
    bits, width = key_filter(one.join(keys, "key", "left_semi"), "row")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            some = np.flatnonzero(may_hold(shared.value, rows, width)).tolist()
            for at in range(0, len(some), 256):
                sets = [shingle_set(batch.column(1)[i].as_py(), words) for i in some[at : at + 256]]
                k = _signed([_key(h) for h in sets])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([h.tobytes() for h in sets], pa.binary())], names=["key", "said"])

    found = _rows(docs).select("row", "text").mapInArrow(batches, "key long, said binary")
    table = written(found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("said").alias("said")), "set-texts")
    shared.destroy()
    return table


def simhash_pairs(one: DataFrame, radius: int = RADIUS) -> DataFrame:
    """leader, key: pairs of sets whose fingerprints are equal or linked by the BK-trees; a written table.

    Each class of equal fingerprints is led by its smallest key; two classes are linked by their leaders.
    """
    classes = written(one.groupBy("fp").agg(F.min("key").alias("leader")), "set-fingerprints")
    equal = one.join(classes, "fp").where(F.col("key") != F.col("leader")).select("leader", "key")
    side = lambda c, name: classes.select(F.col("fp").alias(c), F.col("leader").alias(name))
    linked = hamming_edges(classes.select("fp"), radius).distinct().join(side("a", "leader"), "a").join(side("b", "key"), "b")
    out = written(equal.unionByName(linked.select("leader", "key")), "simhash-pairs")
    drop(classes)
    return out


def near_components(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, row, root (of the component), component_id: one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    sizes = written(set_sizes(docs, words), "set-sizes")
    one = sizes.where("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("fp").alias("fp"))
    one = written(one, "set-rows")
    bands = prefix_buckets(docs, one, similarity, words)
    members = written(bucket_members(bands), "set-buckets")
    drop(bands)
    proposed = simhash_pairs(one)
    both = members.select("leader", "key").unionByName(proposed)
    keys = both.select("key").union(both.select("leader")).distinct()
    texts = sets_of(docs, one, keys, words)
    roots = bucket_components(members, texts, _sets, similarity, 256, proposed)
    drop(members, proposed, texts, one)
    placed = sizes.select("doc_id", "row", "key").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    placed = written(placed.select("doc_id", "row", F.coalesce("root", "key").alias("root")), "set-roots")
    drop(sizes, roots)
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root").select("doc_id", "row", "root", "component_id")
