"""SimHash near-duplicates found with sharded BK-trees.

Fingerprints: ASCII-lower-cased words, three-word shingles (repeats included),
XXH64 with seed 42, a bit is 1 if set in over half of the hashes.

Search: equal fingerprints form one class, so only distinct ones are compared.
Two fingerprints within radius r agree on at least b - r of b bit blocks, so each
goes to one shard per choice of b - r blocks and their values; no link is lost.
b follows the number of fingerprints (three shards of 21 bits each up to some
millions, ten of 38 or 39 bits up to 10**12), so shards stay small.  Each shard
is held as BK-trees of at most ``tree_size`` nodes whose children are
keyed by their integer Hamming distance to the parent, and a search follows only
edges within the radius.  All trees together hold the fingerprints of all
documents, and a broadcast goes through the driver, so a tree is sent only to the
blocks of its own shard: a shard of more than one tree is worked off as pairs of
blocks.  Every task puts out
star edges of its local union-find, never all pairs; components follow from
``components.connected_components``.

Defined results: a null or wordless text has fingerprint zero and is linked like
any other; a null id gets a fingerprint and its component's smallest id (null
if the component has no id at all); repeated rows stay; texts of any length are
used whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucket_count, drop, lean, small_batches, written
from .components import UnionFind, connected_components

_SEGMENT = 1 << 16


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _SEGMENT):
        bits = np.unpackbits(h[i : i + _SEGMENT].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a whole text."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxh64_intdigest, seed=42), shingles), np.uint64, n)
    return majority(h)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row."""

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1)
            fp = np.fromiter((fingerprint(texts[i].as_py(), words) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(batches, "doc_id long, fp long")


class BkTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.child: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        at, new = 0, len(self.value)
        self.value.append(x)
        self.child.append({})
        while at != new:
            at = self.child[at].setdefault((self.value[at] ^ x).bit_count(), new)

    def near(self, x: int, radius: int) -> list[int]:
        """All values within ``radius`` of ``x``."""
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (self.value[at] ^ x).bit_count()
            if d <= radius:
                found.append(self.value[at])
            for edge, node in self.child[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(node)
        return found


def link_blocks(tree_side: list[int], asked: list[int] | None, radius: int, sets: UnionFind) -> None:
    """Unite what lies within the radius: inside ``tree_side``, or between it and ``asked``."""
    tree = BkTree()
    for x in tree_side:
        if asked is None:
            for y in tree.near(x, radius):
                sets.union(x, y)
        tree.add(x)
    for x in asked or ():
        for y in tree.near(x, radius):
            sets.union(x, y)


def blocks_for(n: int, radius: int, per_shard: int = 4) -> int:
    """Bit blocks (radius + 1 at least) so that ``n`` random fingerprints leave about ``per_shard`` in a shard."""
    for blocks in range(radius + 1, radius + 5):
        if n <= per_shard << (64 * (blocks - radius) // blocks):
            break
    return blocks


def shard_bits(radius: int, blocks: int) -> list[int]:
    """The masks of each choice of ``blocks - radius`` of the bit blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(block, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming_edges(prints: DataFrame, radius: int = 2, tree_size: int = 4096, blocks: int | None = None) -> DataFrame:
    """Star edges (a, b) whose components are those of all distinct ``fp`` within the radius."""
    n = prints.count()
    buckets = max(bucket_count(prints.sparkSession), n >> 16)  # tasks of bounded size
    masks = shard_bits(radius, blocks or blocks_for(n, radius))
    shards = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(shards).alias("s")).select("s.band", "s.part", "fp")
    sizes = rows.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, ["band", "part"])
    trees = F.ceil(F.col("n") / tree_size).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(3)), trees).cast("int")
    other = F.explode(F.sequence(F.lit(0), trees - 1)).alias("other")
    pairs = rows.select("band", "part", "fp", trees.alias("trees"), own.alias("own"), other).select(
        "band", "part", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("asked"),
        # Small shards share a task; a pair of blocks of a large shard has its own.
        F.when(F.col("trees") == 1, F.pmod(F.xxhash64("band", "part"), F.lit(buckets)))
        .otherwise(F.xxhash64("band", "part", F.least("own", "other"), F.greatest("own", "other"))).alias("task"),
    )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["band", "part", "i", "j"], kind="stable")
        keys = pdf[["band", "part", "i", "j"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        values = pdf["fp"].to_numpy().view(np.uint64)
        asked = pdf["asked"].to_numpy()
        sets = UnionFind()
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            if b - a > 1:
                v, q = values[a:b], asked[a:b]
                one_block = keys[a, 2] == keys[a, 3]
                link_blocks(v[~q].tolist(), None if one_block else v[q].tolist(), radius, sets)
        nodes = [x for x in sets.up if sets.find(x) != x]
        a = np.array(nodes, np.uint64).view(np.int64)
        b = np.array([sets.find(x) for x in nodes], np.uint64).view(np.int64)
        return pd.DataFrame({"a": a, "b": b})

    return pairs.groupBy("task").applyInPandas(link, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 2, tree_size: int = 4096, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id: one row per row of ``docs``."""
    prints = written(fingerprints(docs, words=words), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = written(classes, "fingerprint-classes")
    roots = connected_components(hamming_edges(classes.select("fp"), radius, tree_size))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    placed = written(placed, "fingerprint-roots")
    drop(classes, roots)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = placed.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(known, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")
