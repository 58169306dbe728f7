"""Best-fit packing of tokenised documents by large-item matching.

A document is its token ids and one end id; only one longer than the capacity
is cut, into pieces of exactly the capacity and, first, the shorter rest.
Packing depends on piece lengths alone, so it is planned on their histogram
(at most ``capacity`` rows, whatever the corpus): pieces above a third of the
capacity, largest first, pair with the largest such piece that still fits, at
most two to a bin; then smaller pieces, largest first, go to the smallest gap
that holds them.  The plan says for ranges of ranks within a length which bin
and offset they get, and pieces meet it by their rank.  Ranks are counted in
two steps, by (length, salt) and within, with as many salts as a length has
``salt_rows`` pieces, so no length needs one task.

Defined results: a null text is empty and gives the end id alone; repeated rows
are packed as often as they occur; a null id is passed on; an empty table gives
no rows; other columns of the input are not read by ``tokenize_pieces`` and are
passed on by ``pack``, but for any named sequence_id or offset, which it sets.
"""

from __future__ import annotations

import bisect
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, small_batches, written

CAPACITY = 2048
#: Fixed value: the published pattern that byte-level BPE files with ``use_regex`` stand for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHUNK_CHARS = 1 << 22
#: Longer runs of white space are left to ``tokenizers``; ``tiktoken`` overflows its stack at about a million.
_LONG_SPACE = 100_000


def byte_level_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and ids of a byte-level BPE file whose ids are also its merge ranks."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre = said["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or said["normalizer"] or said["model"]["type"] != "BPE" or said["model"].get("ignore_merges"):
        return None
    # Byte-level files write each byte as a printable character: itself, or the next free one from 256.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in said["added_tokens"]}
    vocab = {k: i for k, i in said["model"]["vocab"].items() if k not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
    if [vocab.get("".join(m)) for m in merges] != [*range(256, 256 + len(merges))]:
        return None
    return {bytes(byte_of[c] for c in k): i for k, i in vocab.items()}


@cache
def _encoder(path: str) -> Callable[[str], bytes]:
    """One text to its ids as little-endian 32-bit bytes; text of special tokens is ordinary text.

    A byte-level file is run by the faster of the two libraries that read it; both
    give the same ids, which the tests hold against each other.
    """
    if ranks := byte_level_ranks(path):
        import tiktoken

        e = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: array("I", e.encode_ordinary(text)).tobytes()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: array("I", t.encode(text, add_special_tokens=False).ids).tobytes()


@cache
def _default_encoder(path: str) -> Callable[[str], bytes]:
    """One text to the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.

    Texts that hold an added token (which becomes that token's id) or a very long run
    of white space go to ``tokenizers``, loaded when the first one comes; all others to ``_encoder``.
    """
    fast = _encoder(path)
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]

    @cache
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def ids_of(text: str) -> bytes:
        long_space = len(text) > _LONG_SPACE and any(m.end() - m.start() > _LONG_SPACE for m in re.finditer(r"\s+", text))
        if long_space or any(x in text for x in added):
            return array("I", library().encode(text, add_special_tokens=False).ids).tobytes()
        return fast(text)

    return ids_of


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit)."""
    end = end_id.to_bytes(4, "little")

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _default_encoder(tokenizer_path)
        for batch in it:
            at = 0
            texts = batch.column(1)
            while at < batch.num_rows:
                some, chars, first = [], 0, at
                while at < batch.num_rows and chars < _CHUNK_CHARS:
                    some.append(texts[at].as_py() or "")
                    chars += len(some[-1])
                    at += 1
                rows: list[list] = [[], [], [], [], []]
                for doc, text in zip(batch.column(0).slice(first, at - first).to_pylist(), some):
                    ids = ids_of(text) + end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n % capacity or capacity) if start == 0 else capacity
                        for to, x in zip(rows, (doc, piece, start, length, ids[4 * start : 4 * (start + length)])):
                            to.append(x)
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(batches, "doc_id long, piece int, start long, length long, ids binary")


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, bin, per_bin, offset) over all ranks of all lengths.

    The piece of that length and rank r lies in bin ``bin + (r - rank_from) // per_bin``
    at ``offset + (r - rank_from) % per_bin * length``.
    """
    left = {k: v for k, v in histogram.items() if v}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("a piece is empty or above the capacity")
    plan: list[tuple[int, int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges (first bin, bins)
    open_gaps: list[int] = []
    bins = 0

    def put(length: int, n: int, first: int, per_bin: int, offset: int) -> None:
        plan.append((length, rank[length], rank[length] + n, first, per_bin, offset))
        rank[length] += n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x in left if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            i = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while i >= 0 and not (left[large[i]] - (large[i] == a and left[a] == 1)):
                i -= 1
            b = large[i] if i >= 0 else None
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, bins, 1, 0)
            left[a] -= n
            if b is not None:
                put(b, n, bins, 1, a)
                left[b] -= n
            leave(capacity - a - (b or 0), bins, n)
            bins += n
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect.bisect_left(open_gaps, s)
            if i == len(open_gaps):
                per = capacity // s
                first, count, gap = bins, -(-n // per), capacity
                bins += count
            else:
                gap = open_gaps[i]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(i)
                per = gap // s
            full = min(count, n // per)
            if full:
                put(s, full * per, first, per, capacity - gap)
                leave(gap - per * s, first, full)
                n -= full * per
            if n and full < count:  # one more bin takes the rest
                put(s, n, first + full, n, capacity - gap)
                leave(gap - n * s, first + full, 1)
                full, n = full + 1, 0
            leave(gap, first + full, count - full)
    return plan


def _longs(spark: SparkSession, names: list[str], rows: list[tuple[int, ...]]) -> DataFrame:
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))


def pack(pieces: DataFrame, capacity: int = CAPACITY, salt_rows: int = 1 << 10) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, any more) with sequence_id and offset."""
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    own = F.struct(*[F.col(c) for c in kept]).alias("own")
    hashed = F.xxhash64("doc_id", "piece", F.lit(6)).alias("hash")
    items = written(pieces.select(own, "length", hashed), "pieces")
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Both tables have some rows per length, however many pieces there are.  From Arrow: from
    # lists each executor would start a second Python daemon, with workers that stay.
    salts = _longs(spark, ["of_length", "salts"], [(k, -(-n // salt_rows)) for k, n in histogram.items()])
    plan = _longs(spark, ["of_length", "first", "end", "bin", "per_bin", "at"], plan_bins(histogram, capacity))
    salted = items.join(F.broadcast(salts), F.col("length") == F.col("of_length"))
    salted = salted.select("own", "length", F.pmod("hash", "salts").cast("int").alias("salt"))
    parts = written(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-lengths")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("length").alias("of_length"), F.col("salt").alias("of_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("own.doc_id", "own.piece", "own.start")) - 1
    ranked = salted.withColumn("within", within)
    ranked = ranked.join(offsets, (F.col("length") == F.col("of_length")) & (F.col("salt") == F.col("of_salt")))
    ranked = ranked.select("own", "length", (F.col("within") + F.col("before")).alias("rank"))
    placed = ranked.join(
        F.broadcast(plan), (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    )
    nth = F.col("rank") - F.col("first")
    return placed.select(
        *[F.col("own").getField(c).alias(c) for c in kept],
        (F.col("bin") + F.floor(nth / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + nth % F.col("per_bin") * F.col("length")).cast("bigint").alias("offset"),
    )
