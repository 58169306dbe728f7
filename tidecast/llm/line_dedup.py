"""Fuzzy line deduplication: MinHash, banding, exact Jaccard, distributed union-find.

A line is what stands between line feeds; lines with equal text are one node.
Signatures are MinHashes over shingles of ``shingle`` characters (a shorter line
is its own single shingle).  ``bands`` bands of ``rows`` values find candidates:
lines that agree in a band.  At Jaccard 0.8 the defaults find a pair with
probability 0.995, at 0.9 with 0.99998.

Candidates are verified exactly.  First every line of a bucket is compared with
the bucket's smallest line, which is linear in the bucket; buckets in which that
leaves lines in different components are then compared in full, in blocks if
they are large, so no candidate link is lost.  Components come from the
distributed union-find; of each component the occurrence in the smallest
document, and there the topmost, is kept and every other one is removed.

Defined results: lines of white space only are never removed; a null text stays
null; a null id comes after all ids; rows that are repeated exactly are one
document and fare alike; a document may lose all its lines and then has an
empty text; an empty table gives no rows; other columns are passed on.  A line
is known by 64 bits of hash (seeded XXH64); two different lines would be taken
as one with probability n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucket_count, drop, lean, small_batches, written
from .components import UnionFind, connected_components
from .sketch import key_filter, may_hold

SHINGLE, BANDS, ROWS, SIMILARITY = 8, 10, 4, 0.8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILL = 0x110000  # no character has this number
_CHUNK_CHARS = 1 << 17  # what is made of a chunk stays in a core's cache
_MET = 1 << 17  # keys a task remembers
_LAST = (1 << 63) - 1
Sets = Callable[[list], list[np.ndarray]]  # texts to sorted sets of shingle hashes


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines, and the bounds of each line's own in (start, end) pairs."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    padded = np.maximum(sizes, shingle)
    ends = np.cumsum(padded)
    starts = ends - padded
    if (sizes < shingle).any():
        full = np.full(int(ends[-1]), _FILL, np.uint64)
        full[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(chars))] = chars
        chars = full
    # Horner's rule for all shingles at once, by doubling the block.
    n, done, size, out, block = max(len(chars) - shingle + 1, 0), 0, 1, None, chars
    while done < shingle and n:
        if shingle & size:
            part = block[done : done + n]
            out = part if out is None else out * np.uint64(pow(int(_BASE), size, 1 << 64)) + part
            done += size
        if done < shingle:
            block = block[:-size] * np.uint64(pow(int(_BASE), size, 1 << 64)) + block[size:]
            size *= 2
    return _mix(out) if out is not None else np.zeros(0, np.uint64), np.stack([starts, ends - shingle + 1], 1)


def minhash_bands(lines: list[str], shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit value per line and band."""
    h, bounds = shingle_hashes(lines, shingle)
    cuts = bounds.reshape(-1)
    cuts = cuts[:-1] if cuts[-1] >= len(h) else cuts
    # An odd multiplier permutes the 32-bit numbers; their products need no wider type.
    short = (h >> np.uint64(32)).astype(np.uint32)
    odd = np.random.default_rng(9).integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out, v = np.zeros((len(lines), bands), np.uint64), np.empty_like(short)
    for i, a in enumerate(odd):
        low = np.minimum.reduceat(np.multiply(short, a, out=v), cuts)[::2].astype(np.uint64)
        b = i // rows
        out[:, b] = _mix(out[:, b] * _BASE + low + np.uint64(b + 1))
    return out


def shingle_sets(lines: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Per line the sorted hashes of its different shingles."""
    sets: list[np.ndarray] = []
    at = 0
    while at < len(lines):
        first, size = at, 0
        while at < len(lines) and size < _CHUNK_CHARS:
            size += len(lines[at])
            at += 1
        h, bounds = shingle_hashes(lines[first:at], shingle)
        sets += [sorted_set(h[a:b]) for a, b in bounds.tolist()]
    return sets


def sorted_set(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of hashes."""
    both = np.sort(np.concatenate([a, b]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / max(len(both) - common, 1)


def _keys(lines: list[str]) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 9) for x in lines]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _text_chunks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    at = 0
    while at < len(column):
        first, size, some = at, 0, []
        while at < len(column) and size < _CHUNK_CHARS:
            some.append(column[at].as_py())
            size += len(some[-1] or "")
            at += 1
        yield first, some


def line_occurrences(rows: DataFrame, shingle: int, bands: int, per_band: int) -> DataFrame:
    """key, doc, row, line; and, where a key is first met in a task, its bands."""

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in it:
            for first, texts in _text_chunks(batch.column(2)):
                said = [(first + i, j, x) for i, t in enumerate(texts) if t for j, x in enumerate(t.split("\n")) if x and not x.isspace()]
                if not said:
                    continue
                lines = list(dict.fromkeys(x for _, _, x in said))
                key_of = dict(zip(lines, _signed(_keys(lines)).tolist()))
                fresh = [x for x in lines if key_of[x] not in met]
                sig = dict(zip(fresh, minhash_bands(fresh, shingle, bands, per_band).view(np.int64).tolist())) if fresh else {}
                if len(met) > _MET:  # a line met again has its bands twice, which only makes more work
                    met.clear()
                met.update(map(key_of.__getitem__, fresh))
                at = pa.array([i for i, _, _ in said], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key_of[x] for _, _, x in said], pa.int64()),
                        batch.column(0).take(at), batch.column(1).take(at),
                        pa.array([j for _, j, _ in said], pa.int32()),
                        pa.array([sig.pop(x, None) for _, _, x in said], pa.list_(pa.int64())),
                    ],
                    names=["key", "doc", "row", "line", "bands"],
                )

    return rows.mapInArrow(batches, "key long, doc long, row long, line int, bands array<long>")


def bucket_members(occurrences: DataFrame) -> DataFrame:
    """band, leader (smallest key), key: all members of the buckets of two or more different lines."""

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by band, then key.  Only the open bucket's leader is carried over.
        band = leader = last = None
        for batch in it:
            b, k = (batch.column(i).to_numpy() for i in (0, 1))
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
            if len(b) and (b[0], k[0]) == (band, last):
                new[0] = False
            head = np.ones(len(b), bool)
            head[1:] = b[1:] != b[:-1]
            if len(b) and b[0] == band:
                head[0] = False
            lead = np.where(head, k, 0)
            at = np.maximum.accumulate(np.where(head, np.arange(len(b)), -1))
            lead = np.where(at >= 0, k[np.maximum(at, 0)], leader if leader is not None else 0)
            out = new & (k != lead)
            if len(b):
                band, last, leader = b[-1], k[-1], lead[-1]
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(b[out]), pa.array(lead[out]), pa.array(k[out])], names=["band", "leader", "key"])

    rows = occurrences.where("bands IS NOT NULL").select(F.explode("bands").alias("band"), "key")
    return rows.repartition("band").sortWithinPartitions("band", "key").mapInArrow(batches, "band long, leader long, key long")


def texts_of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, line text for every key of ``keys`` (key), read from ``rows`` again; a written table."""
    bits, width = key_filter(keys, "key")
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, texts in _text_chunks(batch.column(0)):
                lines = list(dict.fromkeys(x for t in texts if t for x in t.split("\n") if x))
                if lines:
                    k = _signed(_keys(lines))
                    at = np.flatnonzero(may_hold(shared.value, k.view(np.uint64), width))
                    yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array([lines[i] for i in at], pa.string())], names=["key", "said"])

    found = rows.select("text").mapInArrow(batches, "key long, said string")
    table = written(found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("said").alias("said")), "line-texts")
    shared.destroy()
    return table


def verified_pairs(pairs: DataFrame, texts: DataFrame, sets_of: Sets, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts have that Jaccard similarity or more."""

    @lean
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                # Rows come sorted by ``a``: the sets of a text met again in the batch are made once.
                said = [batch.column(2).to_pylist(), batch.column(3).to_pylist()]
                number = {x: i for i, x in enumerate(dict.fromkeys([*said[0], *said[1]]))}
                sets = sets_of(list(number))
                good = [i for i, (x, y) in enumerate(zip(*said)) if jaccard(sets[number[x]], sets[number[y]]) >= similarity]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], names=["a", "b"])

    side = lambda c: texts.select(F.col("key").alias(c), F.col("said").alias(f"{c}_said"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_said", "b_said")
    return both.mapInArrow(batches, "a long, b long")


def similar_pairs(sets: list[np.ndarray], similarity: float, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """All i > j with that Jaccard similarity or more, by counting common shingles of all pairs at once."""
    sizes = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    values, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle that one set has is in no pair's intersection.
    shared = times > 1
    row, col = row[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both, width = np.zeros((len(sets), len(sets)), np.float32), int(shared.sum())
    for a in range(0, width, columns):
        lo, hi = np.searchsorted(col, (a, a + columns))
        part = np.zeros((len(sets), min(columns, width - a)), np.float32)
        part[row[lo:hi], col[lo:hi] - a] = 1
        both += part @ part.T
    either = sizes[:, None] + sizes[None, :] - both
    return np.nonzero(np.tril(both / np.maximum(either, 1).astype(np.float64) >= similarity, -1))


def bucket_edges(members: DataFrame, texts: DataFrame, sets_of: Sets, similarity: float, block: int = 512, total: int = 0, task_rows: int = 2048) -> DataFrame:
    """Edges whose components are those of all pairs inside each bucket of ``members`` (bucket, key, root, n; ``total`` rows)."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(4)), blocks).cast("int")
    rows = members.select("bucket", "key", "root", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    few = F.pmod(F.xxhash64("bucket"), F.lit(max(4 * bucket_count(members.sparkSession), -(-total // task_rows))))
    # Small buckets share a task; a pair of blocks of a large bucket has its own.
    task = F.when(F.col("n") <= block, few).otherwise(F.xxhash64("bucket", i, j))
    rows = rows.select("bucket", i.alias("i"), j.alias("j"), "own", "key", "root", task.alias("task")).join(texts, "key")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple[int, int]] = []
        for (_, i, j), g in pdf.groupby(["bucket", "i", "j"], sort=False):
            united = UnionFind()
            keys, own = [int(x) for x in g["key"]], g["own"].tolist()
            for key, root in zip(keys, g["root"]):
                united.union(key, int(root))
            for x, y in zip(*(v.tolist() for v in similar_pairs(sets_of(g["said"].tolist()), similarity))):
                if (i == j or own[x] != own[y]) and united.union(keys[x], keys[y]):
                    made.append((keys[x], keys[y]))
        return pd.DataFrame(made, columns=["a", "b"]).astype("int64")

    return rows.groupBy("task").applyInPandas(link, "a long, b long")


def line_components(rows: DataFrame, occurrences: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, root for every line that is linked to a different one."""
    members = written(bucket_members(occurrences), "line-buckets")
    keys = members.select("key").union(members.select("leader")).distinct()
    texts = texts_of(rows, keys)
    roots = bucket_components(members, texts, partial(shingle_sets, shingle=shingle), similarity)
    drop(members, texts)
    return roots


def bucket_components(members: DataFrame, texts: DataFrame, sets_of: Sets, similarity: float, block: int = 512, proposed: DataFrame | None = None) -> DataFrame:
    """node, root of the similar pairs of every bucket of ``members`` (band, leader, key), and of the pairs ``proposed`` (leader, key); ``texts`` is key, said."""
    pairs = members.select(F.col("leader").alias("a"), F.col("key").alias("b"))
    if proposed is not None:
        pairs = pairs.unionByName(proposed.select(F.col("leader").alias("a"), F.col("key").alias("b")))
    pairs = pairs.distinct()
    roots = connected_components(verified_pairs(pairs, texts, sets_of, similarity))
    # Every line has been held against its bucket's leader.  What is left to compare are
    # the others of a bucket that lie in different components; each set of them once.
    known = roots.select(F.col("node").alias("key"), "root")
    told = members.join(known, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    told = written(told, "line-bucket-roots")
    mixed = told.groupBy("band").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
    ).where("lo < hi")
    once = written(mixed.groupBy("n", "x", "y").agg(F.min("band").alias("bucket")), "line-mixed-buckets")
    left = once.agg(F.sum("n").alias("n")).first()["n"] or 0
    rest = told.join(once.select("bucket", "n"), F.col("band") == F.col("bucket")).select("bucket", "key", "root", "n")
    more = bucket_edges(rest, texts, sets_of, similarity, block, left)
    all_edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    out = connected_components(all_edges)
    drop(told, roots, once)
    return out


def line_dedup(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows_per_band: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the text left after removal, and ``lines_removed``."""
    small_batches(docs.sparkSession)
    doc_id, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    row = F.xxhash64(doc_id, text)
    keyed = docs.select(F.coalesce(doc_id, F.lit(_LAST)).alias("doc"), row.alias("row"), text.alias("text"))
    occurrences = written(line_occurrences(keyed, shingle, bands, rows_per_band), "lines")
    roots = line_components(keyed, occurrences, shingle, similarity)
    # First occurrence of each line, then of each component.
    said = occurrences.select("key", "doc", "row", "line")
    at = F.struct("doc", "line", "row")
    linked = roots.select(F.col("node").alias("key"), "root")
    firsts = said.groupBy("key").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.join(linked, "key", "left").withColumn("root", F.coalesce("root", "key"))
    firsts = written(firsts, "line-firsts")
    drop(roots)
    keepers = firsts.groupBy("root").agg(F.min("at").alias("keeper"), F.sum("n").alias("n")).where("n > 1")
    # Lines that stand once and alone need no look-up of their occurrences.
    repeated = firsts.select("key", "root").join(keepers.select("root", "keeper"), "root").select("key", "keeper")
    # What goes from a row, as one bit a line in numbers of 64; a row of a million lines has an array of 16,000.
    gone = said.join(repeated, "key").where(at != F.col("keeper")).select("row", "line").distinct()
    gone = gone.groupBy("row", F.expr("line DIV 64").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, line % 64)")).alias("bits"))
    gone = gone.groupBy(F.col("row").alias("gone_row")).agg(
        F.collect_list(F.struct("block", "bits")).alias("b"), F.max("block").alias("top"), F.sum(F.bit_count("bits")).alias("n_gone")
    )
    dense = F.expr("transform(sequence(0L, top), k -> coalesce(get(filter(b, x -> x.block = k), 0).bits, 0L))")
    gone = written(gone.select("gone_row", dense.alias("gone"), "n_gone"), "line-gone")
    drop(occurrences, firsts)
    others = [c for c in docs.columns if c != text_col]
    own = docs.select(F.struct(*[F.col(c) for c in others]).alias("own"), text.alias("text"), row.alias("row"))
    # Dealt by row at every size: a broadcast would suit small inputs only.
    joined = own.join(gone.hint("merge"), F.col("row") == F.col("gone_row"), "left")
    left = F.expr(
        "CASE WHEN gone IS NULL THEN text ELSE array_join(filter(split(text, '\\n', -1), "
        "(x, i) -> coalesce(shiftrightunsigned(get(gone, CAST(i DIV 64 AS INT)), i % 64) & 1, 0) = 0), '\\n') END"
    )
    return joined.select(
        *[left.alias(c) if c == text_col else F.col("own").getField(c).alias(c) for c in docs.columns],
        F.coalesce("n_gone", F.lit(0)).cast("bigint").alias("lines_removed"),
    )
