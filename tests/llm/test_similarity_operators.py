"""SimHash, neighbours, substring and line dedup, mixing and the pipeline against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidecast.llm import ann, components, line_dedup, mixing, simhash, sketch, substring_dedup
from tidecast.llm._common import written
from tidecast.llm.components import UnionFind, connected_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_docs(spark):
    long = " ".join(f"word{i % 700}" for i in range(4000))
    texts = ["", None, " ", "one", "one two", "A b C", "a B c", long, long, long + " tail", "\n\n\n", "x\ny\nx", "same line of text here\nother line of text there"]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(7, long, "en", "s", 1), (None, long, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).withColumn("fp", F.lit("clash")).withColumn("row", F.lit("clash"))


# Components.


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    uf = UnionFind()
    for a, b in edges:
        uf.union(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in {v for e in edges for v in e}:
        assert got.get(x, x) == uf.find(x)


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_components_hold_one_python_worker_a_task(spark, monkeypatch):
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(components, "written", noted)
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b").mapInArrow(lambda it: it, "a long, b long")
    assert {r["root"] for r in connected_components(edges).collect()} == {0}
    assert max(p.count("MapInArrow") for p in plans) == 1


# SimHash.


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tree_size", [4096, 2])
def test_simhash_components(spark, tree_size):
    docs = documents(spark).select(*DOC.replace(" long", "").replace(" string", "").split(", ")).unionByName(odd_docs(spark).drop("fp", "row"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    uf = UnionFind()
    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                uf.union(a, b)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[uf.find(p)] = min(d, least.get(uf.find(p), d))
    want = Counter((d, p, least.get(uf.find(p))) for (d, _), p in zip(rows, prints))
    got = simhash.simhash_components(docs, tree_size=tree_size).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert simhash.simhash_components(odd_docs(spark).limit(0)).count() == 0


def test_links_of_close_prints(spark):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    near = base + [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (6, 2))]
    near += [near[-1] ^ (1 << i) for i in range(64)]
    signed = [x - 2**64 if x >= 2**63 else x for x in dict.fromkeys(near)]
    for size, blocks in ((4096, None), (5, 3), (4096, 4), (5, 5)):
        edges = simhash.hamming_edges(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, size, blocks)
        got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
        uf = UnionFind()
        for i, a in enumerate(signed):
            for b in signed[:i]:
                if ((a ^ b) % 2**64).bit_count() <= 2:
                    uf.union(a, b)
        assert all(got.get(x, x) == uf.find(x) for x in signed)


def test_shards_stay_small():
    assert [simhash.blocks_for(n, 2) for n in (0, 1 << 20, 1 << 30, 1 << 38)] == [3, 3, 4, 5]
    for blocks, masks in ((3, 3), (4, 6), (5, 10)):
        bits = simhash.shard_bits(2, blocks)
        assert len(bits) == masks and all(any((a | b) & m == 0 for m in bits) for a in map(lambda i: 1 << i, range(64)) for b in map(lambda i: 1 << i, range(64)))


def test_bk_tree_follows_only_near_edges():
    t, rng = simhash.BkTree(), np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 2**63, 300)]
    for v in values:
        t.add(v)
    q = values[7] ^ 3
    assert sorted(t.near(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)
    assert all((t.value[i] ^ t.value[c]).bit_count() == d for i, kids in enumerate(t.child) for d, c in kids.items())


# Nearest neighbours.


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    hit = total = 0
    got = defaultdict(list)
    for r in ann.nearest_by_partitions(table, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    at = {int(i): k for k, i in enumerate(ids)}
    for q in ids[ids % 20 == 0]:
        found = sorted(got[int(q)])
        assert [r for r, *_ in found] == list(range(1, 21))
        for _, v, s in found:
            assert s == pytest.approx(float(x[at[int(q)]] @ x[at[v]]), abs=1e-12)
        s = x @ x[at[int(q)]]
        s[at[int(q)]] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        hit, total = hit + len(best & {v for _, v, _ in found}), total + 20
    assert hit >= 0.9 * total


def test_vectors_that_take_no_part(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)] + [(20, None), (21, [0.0, 0.0]), (22, [None, 1.0]), (23, [float("nan"), 1.0]), (24, [float("inf"), 1.0]), (None, [1.0, 1.0]), (25, []), (0, [5.0, 5.0]), (26, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", F.lit("clash")).withColumn("part", F.lit(0))
    out = ann.nearest_by_partitions(df, F.col("vec_id") % 2 == 0, k=20).collect()
    assert {r["query_id"] for r in out} == {0, 2, 4, 6, 8, 10} and {r["vec_id"] for r in out} == set(range(12))
    one = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == 2)
    assert len(one) == 11 and [(-s, v) for _, v, s in one] == sorted((-s, v) for _, v, s in one)
    assert ann.nearest_by_partitions(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_hot_ties_are_cut_by_id():
    rows = [(i, [1.0, 0.0]) for i in range(3000)] + [(5000, [0.5, 0.5])]
    out = ann.best_in_block(np.arange(300), np.ones((300, 2)) * [1, 0], np.array([i for i, _ in rows]), np.array([v for _, v in rows]), 3)
    assert len(out) == 900 and out[out["query_id"] == 1]["vec_id"].tolist() == [0, 2, 3]


def test_structured_vectors_need_few_partitions():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(32, 16))
    x = centres[rng.integers(0, 32, 2000)] + 0.05 * rng.normal(size=(2000, 16))
    _, probes = ann.fit_router(x, 16, 0.95)
    assert probes <= 5
    _, probes = ann.fit_router(rng.normal(size=(2000, 64)), 16, 0.95)
    assert probes > 8


def test_partitions_are_balanced():
    x = np.random.default_rng(0).normal(size=(600, 8))
    part = ann.balanced_partition(x, ann.neighbour_graph(x, 8), 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(1.1 * 100)


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    run = lambda **o: sorted(map(tuple, ann.nearest_by_partitions(df, F.col("vec_id") % 10 == 0, 5, parts=3, probes=3, **o).collect()))
    assert run() == run(block_rows=20, query_rows=4)


# Substring dedup.


def brute_substring(rows, window):
    seen, out = {}, []
    docs = sorted([((d is None, d or 0), d, (t or "").encode().split()) for d, t in rows], key=lambda r: r[0])
    first = {}
    for key, _, w in docs:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (key, i))
            if first[tuple(w[i : i + window])][0] == key:
                first[tuple(w[i : i + window])] = min(first[tuple(w[i : i + window])], (key, i))
    for key, d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (key, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        out.append((d, kept, len(w), len(gone)))
    del seen
    return Counter(out)


@pytest.mark.parametrize("window", [5, 20])
def test_substring_dedup(spark, window):
    docs = documents(spark).select("doc_id", "text").unionByName(odd_docs(spark).where("doc_id >= 0 OR doc_id IS NULL").select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    got = substring_dedup.substring_dedup(docs, window).collect()
    want = brute_substring([(r["doc_id"], r["text"]) for r in docs.collect()], window)
    assert Counter((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in got) == want
    assert substring_dedup.substring_dedup(docs.limit(0), window).count() == 0


def test_rolling_hash_and_minimum():
    h = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    r = substring_dedup.rolling(np.concatenate([h, h]), 20, 0x9E3779B97F4A7C15)
    assert (r[:181] == r[200:381]).all() and len(set(r[:181].tolist())) == 181
    m = substring_dedup.sliding_min(h, 9)
    assert (m == np.array([h[i : i + 9].min() for i in range(192)])).all()


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**62, 3000)
    values = np.concatenate([values, values[:500]])
    df = spark.createDataFrame([(int(v),) for v in values], "k long").repartition(5)
    hashes = lambda b: iter([b.column(0).to_numpy().view(np.uint64)])
    for log_width in (9, 16):  # crowded and roomy
        bits = sketch.merged_sketch(df, hashes, log_width)
        told = sketch.may_hold(bits, values.view(np.uint64), log_width)
        assert told[:500].all() and told[3000:].all()
    assert told[500:3000].mean() < 0.1
    bits, width = sketch.key_filter(df, "k")
    assert sketch.may_hold(bits, values.view(np.uint64), width).all()


@pytest.mark.parametrize("cells", [[], [0], [255], [0, 1, 254, 255, 256, 765, 766, 10_000], list(range(0, 5000, 3))])
def test_packed_cells_come_back(cells):
    assert sketch.unpacked_cells(sketch.packed_cells(np.array(cells, np.int64))).tolist() == cells


def test_merged_sketch_in_memory():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    parts = np.array_split(np.concatenate([h, h[:700], h[:10]]), 6)
    for log_width in (8, 15):
        s = sketch.CountMin(log_width)
        for p in parts:
            s.merge(sketch.CountMin(log_width).add(p))
        whole = sketch.CountMin(log_width).add(np.concatenate(parts))
        assert (s.again == whole.again).all() and s.repeated(h[:700]).all()
    assert s.repeated(h[700:]).mean() < 0.1


def test_tiny_sketches_and_chunks_lose_no_window(spark, monkeypatch):
    """Crowded sketches only pass more; chunks of a few words leave all to the grouping."""
    docs = documents(spark).select("doc_id", "text").where("doc_id < 60")
    want = brute_substring([(r["doc_id"], r["text"]) for r in docs.collect()], 20)
    for name, value in (("log_width_for", lambda n: 6), ("_CHUNK_WORDS", 1), ("_PART_ROWS", 5)):
        monkeypatch.setattr(substring_dedup, name, value)
    got = substring_dedup.substring_dedup(docs, 20).collect()
    assert Counter((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in got) == want


@pytest.mark.parametrize("chunk", [1, 1 << 18])
def test_substring_dedup_of_repeats_within_and_between(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "_CHUNK_WORDS", chunk)
    loop, own = "a b c d e " * 12, " ".join(f"z{i}" for i in range(30))
    rows = [(1, loop), (2, own + " " + loop), (3, own), (3, own + " tail"), (3, own), (None, own), (None, "q " + own), (0, "x " * 300), (5, "x " * 40), (4, loop + own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.substring_dedup(docs, 6).collect()
    assert Counter((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in got) == brute_substring(rows, 6)


# Line dedup.


def plain_shingles(line, n=8):
    return frozenset(line[i : i + n] for i in range(max(1, len(line) - n + 1)))


def plain_jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_lines(rows, similarity=0.8):
    lines = sorted(((d is None, d or 0), j, i, x) for i, (d, t) in enumerate(rows) if t for j, x in enumerate(t.split("\n")) if x and not x.isspace())
    distinct = list(dict.fromkeys(x for *_, x in lines))
    grams, uf = [plain_shingles(x) for x in distinct], UnionFind()
    held = defaultdict(list)
    for i, g in enumerate(grams):
        common = Counter(j for s in g for j in held[s])
        for s in g:
            held[s].append(i)
        for j, n in common.items():
            if n / (len(g) + len(grams[j]) - n) >= similarity:
                uf.union(i, j)
    number, keeper, gone = {x: i for i, x in enumerate(distinct)}, {}, defaultdict(set)
    for key, j, i, x in lines:
        first = keeper.setdefault(uf.find(number[x]), (key, j, rows[i][1]))
        if first != (key, j, rows[i][1]):
            gone[i].add(j)
    return [(d, t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]), len(gone[i])) for i, (d, t) in enumerate(rows)]


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here number "
    extra = [(9000 + i, base + str(i), None, None, 0) for i in range(6)] + [(9100, "   \n" + base + "77\n\n   ", None, None, 0)]
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, DOC))
    docs = docs.unionByName(odd_docs(spark).select((F.col("doc_id") + 5000).alias("doc_id"), "text", "lang", "source", "n_chars"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in line_dedup.line_dedup(docs).collect())
    want = Counter(brute_lines(rows))
    assert sum((got & want).values()) >= 0.99 * len(rows)  # banding may miss a pair at the threshold
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most,times", [(1 << 17, 1), (0, 3)])
def test_a_line_met_again_in_a_task_has_its_bands_once(spark, monkeypatch, most, times):
    monkeypatch.setattr(line_dedup, "_CHUNK_CHARS", 10)
    monkeypatch.setattr(line_dedup, "_MET", most)
    text = "the same line in every row"
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate([text, "another line", text, "a third line of text", text])], "doc long, row long, text string")
    work = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, f, schema: work.update(f=f))
    line_dedup.line_occurrences(rows, 8, 10, 4)
    (batch,) = rows.coalesce(1).toArrow().combine_chunks().to_batches()
    out = [r for b in work["f"](iter([batch.select(["doc", "row", "text"])])) for r in b.to_pylist()]
    assert [r["doc"] for r in out] == [0, 1, 2, 3, 4] and len({r["key"] for r in out}) == 3
    assert sum(r["bands"] is not None for r in out if r["doc"] % 2 == 0) == times


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(2)
    words = [f"w{i:04d}" for i in range(400)]
    a = " ".join(rng.choice(words, 200))
    b = " ".join(x if rng.random() > 0.03 else "zzzzz" for x in a.split())
    sig = line_dedup.minhash_bands([a, b, "ab", "ab", "abc"], bands=400, rows=1)
    assert abs((sig[0] == sig[1]).mean() - plain_jaccard(plain_shingles(a), plain_shingles(b))) < 0.08
    assert (sig[2] == sig[3]).all() and not (sig[2] == sig[4]).any()


def test_similar_pairs_match_plain_jaccard():
    rng = np.random.default_rng(4)
    lines = ["".join(rng.choice(list("ab "), 40)) for _ in range(40)]
    lines += [x[:-1] + "z" for x in lines]
    lines += ["", "a", "ab ", lines[0]]
    g = [plain_shingles(x) for x in lines]
    want = {(i, j) for i in range(len(g)) for j in range(i) if plain_jaccard(g[i], g[j]) >= 0.8}
    sets = line_dedup.shingle_sets(lines)
    assert set(zip(*(v.tolist() for v in line_dedup.similar_pairs(sets, 0.8, columns=50)))) == want
    assert {(i, j) for i in range(len(g)) for j in range(i) if line_dedup.jaccard(sets[i], sets[j]) >= 0.8} == want


# Mixing.


def test_weights_meet_the_goal(spark):
    totals = {"a": 9000, "b": 500, "c": 400, "d": 100}
    df = spark.createDataFrame(list(totals.items()), "source string, tokens long")
    got = {r["source"]: r for r in mixing.source_weights(df, max_repeats=3.0).collect()}
    reps = {s: got[s]["weight"] / totals[s] for s in totals}
    assert max(reps.values()) / min(reps.values()) == pytest.approx(3.0, rel=1e-6)
    assert sum(r["weight"] for r in got.values()) == pytest.approx(1)
    w = [r["weight"] for r in mixing.source_weights(df, entropy_target=1.2).collect()]
    assert -sum(x * np.log(x) for x in w) == pytest.approx(1.2, abs=1e-6)
    even = mixing.source_weights(df, max_repeats=1e9).collect()
    assert {round(r["weight"], 6) for r in even} == {0.25}
    as_is = {r["source"]: r["weight"] for r in mixing.source_weights(df, max_repeats=1.0).collect()}
    assert as_is["a"] == pytest.approx(0.9)


def test_mixture_is_whole_and_within_budget(spark):
    docs = documents(spark).select("doc_id", "text", "source").unionByName(
        spark.createDataFrame([(900, None, "src0"), (901, "", None), (901, "", None), (None, "a b c", "rare")], "doc_id long, text string, source string")
    )
    rows = docs.collect()
    out = mixing.mix_sources(docs.withColumn("_hash", F.lit(0)), max_repeats=2.0, block_tokens=2000).collect()
    words = lambda t: max(len((t or "").encode().split()), 1)
    first = Counter((r["doc_id"], r["source"]) for r in out if r["mix_epoch"] == 0)
    assert first == Counter((r["doc_id"], r["source"]) for r in rows)  # every row once
    held, used = Counter(), Counter()
    for r in rows:
        held[r["source"]] += words(r["text"])
    for r in out:
        assert r["mix_tokens"] == words(r["text"])
        used[r["source"]] += r["mix_tokens"]
    longest = max(words(r["text"]) for r in rows)
    assert all(held[s] <= used[s] <= 2.0 * held[s] + longest for s in held)
    assert used["rare"] > held["rare"]
    assert mixing.mix_sources(docs.limit(0), max_repeats=2.0).count() == 0


def test_mixture_budget_downsamples(spark):
    docs = documents(spark).select("doc_id", "text", "source")
    total = docs.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    out = mixing.mix_sources(docs, max_repeats=1.0, budget_tokens=total // 2, block_tokens=500).agg(F.sum("mix_tokens")).first()[0]
    assert total // 2 * 0.98 <= out <= total // 2 + 20 * 20000


# Pipeline.


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "packing"] and p.ORACLE_SQL is None
    docs = documents(spark).unionByName(odd_docs(spark).drop("fp", "row"))
    rows = docs.collect()
    told = p.known_language(spark, docs, SF)
    assert Counter(r["text"] for r in told.collect()) == Counter(r["text"] for r in rows if any(c.isalpha() for c in r["text"] or ""))
    lines = p.without_repeated_lines(spark, told, SF)
    assert lines.count() == told.count() and lines.columns == list(p.COLUMNS)
    kept = p.one_of_each_group(spark, lines, SF)
    left = lines.collect()  # ids are not unique here: rows are told apart by their place
    groups = brute_near_groups([(i, r["text"]) for i, r in enumerate(left)])
    assert kept.count() == len(groups) and kept.where("doc_id IS NOT NULL").count() == sum(any(left[i]["doc_id"] is not None for i in g) for g in groups)
    mixed = p.mixed(spark, kept, SF)
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in kept.collect()}
    packed = p.packed(spark, mixed, SF)
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.where("octet_length(ids) <> 4 * length").count() == 0 and packed.where("piece = 0 AND start <> 0").count() == 0


# Near-duplicate stage.


def brute_near_groups(rows, words=5, similarity=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    uf = UnionFind()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= similarity * (len(a) + len(sets[j]) - both) - 1e-9:
                uf.union(i, j)
    groups = defaultdict(set)
    for i, (d, _) in enumerate(rows):
        groups[uf.find(i)].add(d)
    return {frozenset(g) for g in groups.values()}


def test_near_groups_are_those_of_brute_force_jaccard(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(4)
    rows = []
    for size in (5, 9, 40, 120, 400):
        for _ in range(6):
            base = [f"w{v}" for v in rng.integers(0, 5000, size)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                new = list(base)
                for at in rng.integers(0, size, edits):
                    new[at] = f"edit{rng.integers(1 << 30)}"
                rows.append((len(rows), " ".join(new)))
    # A passage that most of these have, and texts next to the bound (0.8 exactly, and just under it).
    passage = " ".join(f"common{i}" for i in range(30))
    rows += [(len(rows) + i, " ".join(f"own{i}x{j}" for j in range(20)) + " " + passage) for i in range(60)]
    long = [f"z{i}" for i in range(94)]  # 90 shingles
    rows += [(1000, " ".join(long)), (1001, " ".join(long[:76])), (1002, " ".join(long[:75])), (1003, ""), (1004, " \n")]
    rows += [(2000 + r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    want = brute_near_groups(rows)
    kept = {r["doc_id"] for r in p.one_of_each_group(spark, docs, SF).collect()}
    assert kept == {min(g) for g in want}


def test_different_documents_open_no_bucket_however_many_shingles(spark, monkeypatch):
    from tidecast.llm import near_dedup, sketch

    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 1 << 40, 200)) for _ in range(300)]  # 58,800 shingles
    texts += [texts[0] + " more", texts[1] + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(sketch, "MOST_LOG_WIDTH", 13)  # a bounded sketch is full
    buckets, members = [], near_dedup.bucket_members

    def spy(rows):
        buckets.extend(r["key"] for r in rows.collect() if r["bands"])
        return members(rows)

    monkeypatch.setattr(near_dedup, "bucket_members", spy)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs).collect()}
    assert got == {i: i for i in range(300)} | {300: 0, 301: 1} and len(buckets) == 4


def test_shared_shingles_are_told_in_small_ranges(spark, monkeypatch):
    import corpus_pipeline as p
    from tidecast.llm import near_dedup

    monkeypatch.setattr(near_dedup, "_PER_TASK", 50)  # many chunks and ranges
    test_near_groups_are_those_of_brute_force_jaccard(spark)
    again = [(i % 3, f"one two three four five six seven {i % 3}", "en", "s", 1) for i in range(9)] + [(None, "a b", "en", "s", 1)] * 2
    docs = spark.createDataFrame(again, DOC)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in p.one_of_each_group(spark, docs, SF).collect()) == [(False, 0), (False, 1), (False, 2), (True, 0)]


def test_near_duplicate_stage_goes_by_simhash(spark, monkeypatch):
    import corpus_pipeline as p
    from tidecast.llm import near_dedup, simhash

    rng = np.random.default_rng(6)
    base = [[f"w{v}" for v in rng.integers(0, 1 << 40, 400)] for _ in range(30)]
    texts = [" ".join(w) for w in base] + [" ".join([*w, "end"]) for w in base]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    fp = [simhash.majority(near_dedup.shingle_set(t)) for t in texts]
    near = {i for i in range(30) if (fp[i] ^ fp[i + 30]).bit_count() <= near_dedup.RADIUS}
    assert len(near) > 15
    # Without the join that follows, what SimHash links is found, and nothing else.
    buckets = near_dedup.prefix_buckets
    monkeypatch.setattr(near_dedup, "prefix_buckets", lambda *a: near_dedup.written(buckets(*a).where("false"), "none"))
    kept = {r["doc_id"] for r in p.one_of_each_group(spark, docs, SF).collect()}
    assert kept == set(range(60)) - {i + 30 for i in near}
