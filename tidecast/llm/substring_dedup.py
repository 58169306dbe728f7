"""Substring deduplication over windows of consecutive words.

Pass one estimates counts in count-min sketches.  What is counted for a window
is its minimizer, the least hash of the 8-word grams inside it, once for a run
of neighbouring windows whose (leftmost) least gram is the same one: equal
windows have equal minimizers and lie in different runs, so the estimate of a
window is never below its true count.  Minimizers are dealt by hash to as many
tasks as the corpus needs for tasks of bounded size, and each holds the sketch
of its own share, merged from those of its batches and eight cells wide for each
run: sketches stay sparse at any size, and nothing is broadcast.  Runs estimated
at one occurrence are left.

Pass two hashes the windows estimated repeated to 96 bits and groups exactly
those.  What a task can tell from its own documents it tells at once: of equal
windows only the earliest goes on to the grouping, so a passage that a third of
all documents share sends one row per chunk of documents.  A window is removed
if its words also start earlier, in a document of smaller id or further up in
the same one.  Words under removed windows go.

Defined results: a null text has no words; a null id comes after all ids; rows
that share an id are not earlier than one another, so repeated rows fare alike;
texts of any length are used whole; an empty table gives no rows; other columns
are not read.  Two windows are held to be equal when 96 bits of hash agree; rows
are told apart by id and 64 bits of hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucket_count, drop, lean, small_batches, written
from .sketch import CountMin, log_width_for

WINDOW = 20
_GRAM = 8
_CHUNK_WORDS = 1 << 18
_PART_ROWS = 1 << 17
_B1, _B2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_LAST = (1 << 63) - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive entries, by doubling, then mixed."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, size, out, block = 0, 1, None, h
    while done < width:
        if width & size:
            part = block[done : done + n]
            out = part if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        if done < width:
            block = block[:-size] * np.uint64(pow(base, size, 1 << 64)) + block[size:]
            size *= 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n, size, block = len(h) - width + 1, 1, h
    while size * 2 <= width:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    return np.minimum(block[:n], block[width - size : width - size + n])


def _chunks(batch: pa.RecordBatch, column: int = 2) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(first row, row after the last, words of each) of some hundred thousand words."""
    texts, at = batch.column(column), 0
    while at < len(texts):
        first, size, docs = at, 0, []
        while at < len(texts) and size < _CHUNK_WORDS:
            docs.append(words_of(texts[at].as_py()))
            size += len(docs[-1])
            at += 1
        yield first, at, docs


def _hashed(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all documents in a row, and the bounds of each."""
    from itertools import chain

    from xxhash import xxh3_64_intdigest

    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    return np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(docs)), np.uint64, int(bounds[-1])), bounds


def _window_starts(bounds: np.ndarray, window: int) -> np.ndarray:
    """True where a window of one document starts."""
    ok = np.zeros(int(bounds[-1]) + 1, np.int32)
    lo, hi = bounds[:-1], np.maximum(bounds[1:] - window + 1, bounds[:-1])
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    return np.cumsum(ok[:-1]) > 0


def _runs(h: np.ndarray, ok: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimizer) of the runs of windows with one leftmost least gram."""
    gram = min(_GRAM, window)
    grams, span = rolling(h, gram, _B1), window - gram + 1
    least = sliding_min(grams, span)
    n = len(least)
    place = np.zeros(n, np.int64)
    for o in range(span - 1, -1, -1):
        place[grams[o : o + n] == least] = o
    place += np.arange(n)
    place[~ok[:n]] = -1
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    first, size = cuts[:-1], np.diff(cuts)
    real = place[first] >= 0
    return first[real], size[real], least[first[real]]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: after all), row key (same for repeated rows), text."""
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    return docs.select(
        doc.alias("doc"), F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )


def _spread(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key that keeps rows of one text together, but not those of a very long one."""
    return row + (start >> 14) * 0x5851F42D4C957F2D


def _lists(rows: DataFrame, column: str) -> DataFrame:
    """of_doc, of_row, column: what ``rows`` (doc, row, start, n) hold of each row, as one list of start, n pairs."""
    one = F.shiftleft(F.col("start").cast("bigint"), 32).bitwiseOR(F.col("n"))
    return rows.groupBy(F.col("doc").alias("of_doc"), F.col("row").alias("of_row")).agg(F.collect_list(one).alias(column))


def _pairs(packed: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    both = packed.values.to_numpy(zero_copy_only=False)
    return both >> 32, both & 0xFFFFFFFF


def candidate_runs(rows: DataFrame, window: int, task_runs: int = 1 << 19) -> DataFrame:
    """doc, row, start, n: the runs of windows whose minimizer is estimated to occur again."""

    @lean
    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first_row, _, docs in _chunks(batch):
                h, bounds = _hashed(docs)
                if len(h) < window:
                    continue
                at, n, m = _runs(h, _window_starts(bounds, window), window)
                doc = np.searchsorted(bounds, at, "right") - 1
                # Minimizers met twice here are known to repeat: their runs need no
                # estimate, and the sketch hears of each by one row without a run.
                values, inverse, times = np.unique(m, return_inverse=True, return_counts=True)
                known, told = times[inverse] > 1, values[times > 1]
                own, start, none = doc + first_row, at - bounds[doc], np.zeros(len(told), np.int64)
                key = np.where(known, _spread(keys[own], start), m.view(np.int64))
                columns = (
                    np.r_[key, told.view(np.int64)], np.r_[ids[own], none], np.r_[keys[own], none],
                    np.r_[start, none].astype(np.int32), np.r_[n, none].astype(np.int32), np.r_[known, none > 0],
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "doc", "row", "start", "n", "known"])

    @lean
    def estimated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, parts = ["doc", "row", "start", "n"], [], []

        def joined() -> None:
            if held:
                parts.append([np.concatenate(x) for x in zip(*held)])
                held.clear()

        for batch in it:
            known = batch.column(5).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(known)) for i in range(1, 5)], names=names)
            held.append([batch.column(i).to_numpy(zero_copy_only=False)[~known] for i in range(5)])
            if sum(len(x[0]) for x in held) >= _PART_ROWS:
                joined()
        joined()
        width = log_width_for(sum(len(x[0]) for x in parts))
        sketch = CountMin(width)
        for key, *_, n in parts:
            h = key.view(np.uint64)
            # A row without a run stands for two.
            sketch.merge(CountMin(width).add(np.r_[h, h[n == 0]]))
        for key, *rest in parts:
            good = sketch.repeated(key.view(np.uint64)) & (rest[3] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in rest], names=names)

    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(bucket_count(rows.sparkSession), -(-(chars // 24) // task_runs))
    found = rows.mapInArrow(runs, "key long, doc long, row long, start int, n int, known boolean")
    return found.repartition(tasks, "key").mapInArrow(estimated, "doc long, row long, start int, n int")


def earliest_only(keys: list[np.ndarray], doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, gone, sent) of windows with equal ``keys``, in the order of keys, doc, row and start.

    gone: the words start earlier among these rows.  sent: rows that others have to be held against.
    """
    order = np.lexsort((start, row, doc, *keys[::-1]))
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    new = np.r_[True, ~same][: len(order)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, r, s = doc[order], row[order], start[order]
    new_row = new | np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])][: len(order)]
    top = np.maximum.accumulate(np.where(new_row, np.arange(len(order)), 0))
    gone = (d > d[head]) | (s > s[top])
    return order, gone, ~gone & new_row


def removed_windows(rows: DataFrame, runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, row, start, n: n windows from start of that row, whose words also start earlier."""

    @lean
    def candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc", "row", "start", "n"]
        for batch in it:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first_row, last_row, docs in _chunks(batch, 2):
                h, bounds = _hashed(docs)
                if len(h) < window:
                    continue
                asked = np.zeros(len(h) + 1, np.int32)
                for i in range(first_row, last_row):
                    at, n = _pairs(batch.column(3)[i])
                    at = at + bounds[i - first_row]
                    np.add.at(asked, at, 1)
                    np.add.at(asked, at + n, -1)
                at = np.flatnonzero(np.cumsum(asked[:-1]) > 0)
                doc = np.searchsorted(bounds, at, "right") - 1
                h1, h2 = rolling(h, window, _B1)[at], rolling(h, window, _B2)[at]
                start, own = at - bounds[doc], doc + first_row
                order, gone, sent = earliest_only([h1, h2], ids[own], keys[own], start)
                told, open_ = np.sort(order[gone]), order[sent]
                # Neighbouring windows that are gone for sure travel as one row.
                cuts = np.flatnonzero(np.r_[True, np.diff(at[told]) != 1, True]) if len(told) else np.zeros(1, np.int64)
                cuts = np.unique(np.r_[cuts, 1 + np.flatnonzero(np.diff(doc[told]))]) if len(told) else cuts
                some, n = told[cuts[:-1]], np.diff(cuts)
                columns = (
                    np.r_[h1[open_].view(np.int64), _spread(keys[own[some]], start[some])],
                    np.r_[h2[open_].astype(np.uint32).view(np.int32), np.zeros(len(some), np.int32)],
                    np.r_[ids[own[open_]], ids[own[some]]], np.r_[keys[own[open_]], keys[own[some]]],
                    np.r_[start[open_], start[some]].astype(np.int32), np.r_[np.zeros(len(open_), np.int64), n].astype(np.int32),
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    @lean
    def grouped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by window, then doc; the smallest doc of the open window is carried over.
        last: tuple[int, int] | None = None
        least = 0
        for batch in it:
            sure = batch.column(5).to_numpy(zero_copy_only=False) > 0
            out = [batch.filter(pa.array(sure)).select(["doc", "row", "start", "n"])]
            h1, h2, doc, row, start, n = (batch.column(i).to_numpy(zero_copy_only=False)[~sure] for i in range(6))
            if len(h1):
                new = np.r_[(h1[0], h2[0]) != last, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
                first = np.where(head >= 0, doc[np.maximum(head, 0)], least)
                last, least = (h1[-1], h2[-1]), first[-1]
                gone = doc > first
                out.append(pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (doc, row, start, n + 1)], names=["doc", "row", "start", "n"]))
            yield from out

    asked = _lists(runs, "runs")
    both = rows.join(asked, (F.col("doc") == F.col("of_doc")) & (F.col("row") == F.col("of_row")))
    found = both.select("doc", "row", "text", "runs").mapInArrow(candidates, "h1 long, h2 int, doc long, row long, start int, n int")
    dealt = found.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc")
    return dealt.mapInArrow(grouped, "doc long, row long, start int, n int")


def covered(n: int, starts: np.ndarray, times: np.ndarray, window: int) -> np.ndarray:
    """Words under any of the windows: ``times`` consecutive ones from each of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + times - 1 + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed: one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    runs = written(candidate_runs(rows, window), "window-runs")
    removed = written(removed_windows(rows, runs, window), "removed-windows")
    drop(runs)
    gone = _lists(removed, "gone")
    joined = rows.join(gone, (F.col("doc") == F.col("of_doc")) & (F.col("row") == F.col("of_row")), "left").select("doc", "text", "gone")

    @lean
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                words = kept = words_of(batch.column(1)[i].as_py())
                n = len(words)
                if batch.column(2)[i].is_valid:
                    under = covered(n, *_pairs(batch.column(2)[i]), window)
                    kept = [words[j] for j in np.flatnonzero(~under)]
                for to, x in zip(out, (b" ".join(kept).decode("utf-8", "surrogatepass"), n, n - len(kept))):
                    to.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                names=["doc", "text", "n_words", "n_removed"],
            )

    done = joined.mapInArrow(cut, "doc long, text string, n_words long, n_removed long")
    return done.select(
        F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "text", "n_words", "n_removed"
    )
