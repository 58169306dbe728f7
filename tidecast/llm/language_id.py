"""Language identification by prediction by partial matching.

Per language a byte context tree of depth ``order`` is learned.  Statistics are
then frozen and a text is scored by its exact code length in bits: method C
escape probabilities with exclusion, from the longest context down to a uniform
choice among the bytes not yet excluded.  The language with the shortest code
wins (ties: first in alphabetical order) and ``score`` is its posterior
probability under equal priors.

Bytes that no training text holds share all statistics, so they share one
symbol; with ``k`` symbols a tree of depth ``order`` is a table of
``k ** (order + 1)`` code lengths per language, at most 58 MB at depth two
(valid UTF-8 has fewer than 244 byte values).  That table is what is broadcast.

Training takes at most ``docs_per_lang`` labelled documents of each language,
picked by hash over the whole table; each is read whole.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if there is nothing to learn from; a null id counts as the
empty text for the held-out remainder; repeated rows are scored alike; texts of
any length are scored whole, in bounded segments; an empty table gives no rows;
of the input's columns only lang_pred and score are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import give_back, map_rows, small_batches

_LETTER = re.compile(r"[^\W\d_]")
_SEGMENT = 1 << 19
UNKNOWN = "und"


@dataclass(frozen=True)
class PpmModel:
    """``bits[l, code]``: code length of a symbol after its ``order`` symbols of context."""

    langs: tuple[str, ...]
    classes: bytes  # symbol of each byte; 0: never seen in training
    order: int
    bits: np.ndarray


def _symbols(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def context_counts(rows: DataFrame, order: int) -> DataFrame:
    """lang, depth, gram (big-endian bytes as a number), n: how often each gram occurs."""

    def work(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "depth": [], "gram": [], "n": []}
        for lang, text in zip(cols["lang"], cols["text"]):
            data = np.frombuffer(_symbols(text), np.uint8).astype(np.int64)
            code = np.zeros(len(data), np.int64)
            for depth in range(order + 1):
                if len(data) <= depth:
                    break
                code = code[:-1] * 256 + data[depth:] if depth else data
                gram, n = np.unique(code, return_counts=True)
                out["lang"] += [lang] * len(gram)
                out["depth"] += [depth] * len(gram)
                out["gram"] += gram.tolist()
                out["n"] += n.tolist()
        return out

    counted = map_rows(rows.select("lang", "text"), "lang string, depth int, gram long, n long", work)
    return counted.groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))


def frozen_bits(counts: list[np.ndarray], alphabet: int = 256) -> np.ndarray:
    """Code lengths for one language; ``counts[d]`` has shape ``(k,) * (d + 1)``.

    The last axis is the symbol, the others its context, nearest byte last.
    """
    order, k = len(counts) - 1, counts[0].shape[0]
    shape = (k,) * (order + 1)
    cost = np.zeros(shape)
    coded = np.zeros(shape, bool)  # symbols whose code length is settled: excluded below
    escape = np.zeros(shape[:-1] + (1,))
    for depth in range(order, -1, -1):
        c = np.broadcast_to(counts[depth], shape)
        here = np.where(coded, 0, c)
        total = here.sum(-1, keepdims=True, dtype=np.float64)
        kinds = (here > 0).sum(-1, keepdims=True)
        seen = here > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            own = escape + np.log2(total + kinds) - np.log2(here)
            cost = np.where(seen, own, cost)
            down = np.log2(total + kinds) - np.log2(kinds)
        escape = escape + np.where(kinds > 0, down, 0.0)
        coded = coded | seen
    # symbol 0 stands for any one of the bytes that training never saw
    left = np.maximum(alphabet - coded.sum(-1, keepdims=True), 1)
    return np.where(coded, cost, escape + np.log2(left)).astype(np.float32)


def training_rows(docs: DataFrame, docs_per_lang: int) -> DataFrame:
    """At most ``docs_per_lang`` labelled rows (doc_id, lang, text) per language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return labelled.select("lang", "text").limit(0)
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 2.0 * docs_per_lang / n)])
    few = labelled.withColumn("pick", pick).where(F.col("pick") < share[F.col("lang")])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "doc_id", F.xxhash64("text")))
    return few.withColumn("nth", nth).where(F.col("nth") <= docs_per_lang).select("lang", "text")


def fit_ppm(docs: DataFrame, order: int = 2, docs_per_lang: int = 400) -> PpmModel:
    """Learn from ``docs`` (doc_id, text, lang)."""
    rows = context_counts(training_rows(docs, docs_per_lang), order).collect()
    langs = tuple(sorted({r["lang"] for r in rows}))
    seen = sorted({r["gram"] for r in rows if r["depth"] == 0})
    symbol = {b: i + 1 for i, b in enumerate(seen)}
    k = len(seen) + 1
    counts = {lang: [np.zeros((k,) * (d + 1), np.int64) for d in range(order + 1)] for lang in langs}
    for r in rows:
        at = tuple(symbol[b] for b in r["gram"].to_bytes(r["depth"] + 1, "big"))
        counts[r["lang"]][r["depth"]][at] = r["n"]
    bits = np.stack([frozen_bits(counts[lang]).reshape(-1) for lang in langs]) if langs else np.zeros((0, 1), np.float32)
    return PpmModel(langs, bytes(symbol.get(b, 0) for b in range(256)), order, bits)


def code_lengths(model: PpmModel, texts: list[str]) -> np.ndarray:
    """Bits of each whole text in each language."""
    k, pad = max(model.classes) + 1, bytes(model.order)
    parts = [_symbols(t).translate(model.classes) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    cls = np.frombuffer(pad + pad.join(parts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + model.order)]) + model.order
    ends = starts + sizes
    out = np.zeros((len(texts), len(model.langs)))
    for a in range(model.order, len(cls), _SEGMENT):
        b = min(a + _SEGMENT, len(cls))
        code = cls[a - model.order : b - model.order].astype(np.int32)
        for d in range(model.order - 1, -1, -1):
            code = code * k + cls[a - d : b - d]
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        own = np.arange(lo, hi)[sizes[lo:hi] > 0]
        if not len(own):
            continue
        s, e = np.maximum(starts[own], a) - a, np.minimum(ends[own], b) - a
        cuts = np.stack([s, e], 1).reshape(-1)
        cuts = cuts[:-1] if cuts[-1] == b - a else cuts
        for i in range(len(model.langs)):
            out[own, i] += np.add.reduceat(model.bits[i][code], cuts, dtype=np.float64)[::2]
    return out


def predict_texts(model: PpmModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model.langs else []
    at = 0
    while at < len(known):
        upto, size = at, 0
        while upto < len(known) and size < 4 * _SEGMENT:
            size += len(texts[known[upto]])
            upto += 1
        bits = code_lengths(model, [texts[i] for i in known[at:upto]])
        best = bits.argmin(1)
        odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        for i, b, o in zip(known[at:upto], best, odds):
            lang[i], score[i] = model.langs[b], float(1 / o)
        at = upto
    return lang, score


def predict_language(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def predicted(text: pd.Series) -> pd.DataFrame:
        lang, score = predict_texts(shared.value, text.tolist())
        give_back()
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return (
        docs.withColumn("_ppm", predicted(F.col(text_col).cast("string")))
        .withColumns({"lang_pred": F.col("_ppm.lang_pred"), "score": F.col("_ppm.score")})
        .drop("_ppm")
    )


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3
