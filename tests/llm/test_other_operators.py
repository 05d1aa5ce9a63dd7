"""Top-k, packing, components and the pipeline, against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from procmetrics.llm import packing, secrets, topk
from procmetrics.llm.common import shared_dir
from procmetrics.llm.components import connected_components


def plain_top(rows, queries, k):
    ints = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in queries:
        if q not in ints:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q])))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_topk_brute_force(spark, block):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, float("nan"), 0.0, 0.0]), (62, [1.0, None, 0.0, 0.0]), (63, [float("inf")] * 4), (64, [1.0, 2.0]), (65, []), (66, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, block int")
    queries = [0, 7, 20, 40, 60, 61, 64, 65]
    got = {tuple(r) for r in topk.search(df, df.where(F.col("vec_id").isin(queries)), block=block, batch=4).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain_top(rows, queries, 5)


def test_topk_prunes_where_vectors_cluster_by_id(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 2, (20, 8))
    rows = [(i, [float(x) for x in centres[i // 100] + rng.normal(0, 0.05, 8)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = list(range(0, 2000, 50))
    asked = df.where(F.col("vec_id") % 50 == 0)
    got = {tuple(r) for r in topk.search(df, asked, block=50).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain_top(rows, queries, 5)
    work = topk.search_work(df, asked, block=50).groupBy("query_id", "batch").agg(F.sum_distinct("blocks").alias("blocks"), F.max("scored").alias("scored")).agg(F.avg(F.col("scored") / F.col("blocks"))).first()[0]
    assert work < 0.5


def test_topk_ships_only_groups_that_can_matter(spark, monkeypatch):
    """Vectors that lie near each other by id: most groups stay where they are, for each lot of queries, and results are whole."""
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "TOGETHER", 1)
    shipped = []
    real = topk.worth_searching

    def spy(pairs, asked, ends):
        kept = real(pairs, asked, ends)
        shipped.append((kept.count(), pairs.count()))
        return kept

    monkeypatch.setattr(topk, "worth_searching", spy)
    rng = np.random.default_rng(8)
    centres = np.eye(20) * 40
    rows = [(i, [float(x) for x in centres[i // 100] + rng.normal(0, 0.05, 20)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = list(range(0, 2000, 25))
    got = {tuple(r) for r in topk.search(df, df.where(F.col("vec_id") % 25 == 0), block=20, batch=4).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain_top(rows, queries, 5)
    kept, every = shipped[0]
    assert every > 300 and kept < 0.3 * every


def test_topk_stops_at_the_kth_score():
    ids = [np.arange(10) + 10 * b for b in range(6)]
    found = [(i, np.full((10, 2), 6 - b)) for b, i in enumerate(ids)]
    best, scored = topk.search_blocks(np.array([-1, 3]), np.array([[1, 1], [1, 0]]), np.array([topk.LEAST, 1000]), found, 5)
    assert best.ids[0].tolist() == [0, 1, 2, 3, 4] and scored.tolist() == [1, 0]


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df).count() == 0


def one_by_one(lengths, capacity):
    """Best-fit decreasing, item by item."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_best_fit_on_histograms():
    rng = random.Random(2)
    lengths = [rng.randint(1, 60) for _ in range(3000)]
    groups = packing.best_fit({x: lengths.count(x) for x in set(lengths)}, (64,))
    assert all(sum(g.lengths) <= g.capacity for g in groups)
    held = sorted(x for g in groups for x in g.lengths for _ in range(g.count))
    assert held == sorted(lengths)
    assert sum(g.count for g in groups) <= 1.02 * one_by_one(lengths, 64)
    several = packing.best_fit({x: lengths.count(x) for x in set(lengths)}, (16, 32, 64, 128))
    cost = lambda gs, c: sum(g.count * (g.capacity + 0) for g in gs) + c * sum(g.count for g in gs)
    assert cost(several, packing.OVERHEAD) <= cost(groups, packing.OVERHEAD)
    assert all(sum(g.lengths) > max((c for c in (16, 32, 64, 128) if c < g.capacity), default=0) for g in several)


@pytest.mark.parametrize("capacities", [(16, 64), (8,)])
def test_packing_writes_every_id_once(spark, capacities):
    def toy_tokens():
        """A text of a number n has n ids that depend on where they stand."""
        return lambda texts: [np.arange(int(t or 0), dtype=np.uint32) * 7 % 70001 for t in texts]

    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 5, 5, 5, 30, 64, 65, 200, 1000]) for _ in range(300)] + [None, 100_000]
    rows = [(k % 290, None if n is None else str(n), "x", 9) for k, n in enumerate(sizes)]  # some ids repeat
    df = spark.createDataFrame(rows, "doc_id long, text string, bin_id string, part int")
    path = shared_dir(spark, "packing")
    packing.pack(df, path, capacities, tokens=toy_tokens)
    got = packing.read_pieces(spark, path).toPandas()
    want = {}
    for d, n, *_ in rows:
        want[d] = want.get(d, 0) + int(n or 0)
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == want
    full = got[got["n_tokens"] > 0].sort_values(["bin_id", "bin_offset"])
    assert got[got["n_tokens"] == 0]["bin_id"].isna().all() and full["bin_id"].notna().all()
    for _, part in full.groupby("bin_id"):
        size = part["bin_size"].iloc[0]
        assert part["bin_size"].nunique() == 1 and size in capacities and part["n_tokens"].sum() <= size and all(part["n_tokens"].sum() > c for c in capacities if c < size)
        assert (part["bin_offset"].to_numpy() == np.concatenate([[0], part["n_tokens"].cumsum().to_numpy()[:-1]])).all()
    for r in full.itertuples():
        ids = (np.arange(r.first, r.first + r.n_tokens, dtype="<u4") * 7 % 70001).astype("<u4")
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
    bins = packing.read_bins(spark, path).toPandas()
    assert bins["bin_id"].is_unique and sum(len(i) for i in bins["ids"]) == sum(want.values())
    empty = shared_dir(spark, "packing")
    packing.pack(df.limit(0), empty, tokens=toy_tokens)
    assert packing.read_pieces(spark, empty).count() == 0


def test_bins_are_written_as_bytes_and_new_words_encoded_in_parts(spark, monkeypatch):
    import public_tokenizers

    from procmetrics.llm import token_store

    docs = spark.createDataFrame([(k, f"some words of text {k} here " * (k % 7)) for k in range(50)], "doc_id long, text string")
    path = shared_dir(spark, "packing")
    packing.pack(docs, path)
    written = spark.read.parquet(f"{path}/bins")
    assert written.schema["ids"].dataType.simpleString() == "binary"
    sizes = {r["bin_id"]: len(r["ids"]) for r in written.collect()}
    assert sizes == {r["bin_id"]: 2 * len(r["ids"]) for r in packing.read_bins(spark, path).collect()}
    texts, file = [" ".join(f"{a}{b}" for a in "abcdef" for b in "ghij"), "abc"], public_tokenizers.path("word_bpe_49k.json")
    whole = token_store.WordEncoder(file).encode(texts)
    monkeypatch.setattr(token_store, "LEARN_WORDS", 5)
    assert [i.tolist() for i in token_store.WordEncoder(file).encode(texts)] == [i.tolist() for i in whole]


def test_packing_stage_takes_smaller_slices(spark, monkeypatch):
    import corpus_pipeline

    took = []
    monkeypatch.setattr(packing, "pack", lambda df, path, **rest: took.append(rest["slice_bytes"]))
    monkeypatch.setattr(packing, "read_pieces", lambda spark, path: spark.range(1))
    corpus_pipeline.packing_stage(spark, spark.range(1), "")
    assert took == [1 << 20]


def least_cost(lengths, capacities, overhead):
    """Least cost of all ways to share the lengths out over bins, each of the smallest capacity that holds it."""
    best = [float("inf")]

    def cost(bins):
        return sum(next(c for c in sorted(capacities) if c >= b) + overhead for b in bins)

    def place(rest, bins):
        if not rest:
            best[0] = min(best[0], cost(bins))
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= max(capacities):
                place(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(lengths, [])
    return best[0]


def test_variable_capacity_against_all_ways_to_pack():
    rng = random.Random(9)
    capacities, total, least, single = (8, 16, 32), 0, 0, 0
    cost = lambda groups: sum(g.count * (g.capacity + 4) for g in groups)
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        groups = packing.best_fit(histogram, capacities, 4)
        assert sorted(x for g in groups for x in g.lengths for _ in range(g.count)) == sorted(lengths)
        mine, best = cost(groups), least_cost(lengths, capacities, 4)
        assert best <= mine <= 1.8 * best
        total, least, single = total + mine, least + best, single + sum(g.count * (32 + 4) for g in packing.best_fit(histogram, (32,), 4))
    assert total <= 1.15 * least and total <= single


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_near_kept(rows):
    """Ids of the least document of each component of texts whose five-word shingle sets are alike by 0.8 or more."""
    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [k for k, s in enumerate(sets) if not s]
    pairs = {(a, b) for h in holders.values() if len(h) > 1 for n, a in enumerate(h) for b in h[n + 1 :]} | set(zip(empty, empty[1:], strict=False))
    for a, b in pairs:
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    kept = {}
    for k, (d, _) in enumerate(rows):
        kept[find(k)] = min(d, kept.get(find(k), d))
    return set(kept.values())


def test_pipeline_against_brute_force(spark):
    """The registered query, stage by stage and as a whole."""
    import re

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = corpus_pipeline.language_stage(spark, docs, sf)
    assert known.columns == docs.columns
    lettered = {r["doc_id"]: r["text"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert {r["doc_id"] for r in known.collect()} == set(lettered)
    want = {}
    for d, t in lettered.items():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        want[key] = max(want.get(key, -1), d)
    exact = corpus_pipeline.exact_stage(spark, known, sf)
    assert {r["doc_id"] for r in exact.collect()} == set(want.values())
    kept = plain_near_kept(sorted((d, lettered[d]) for d in want.values()))
    near = corpus_pipeline.near_stage(spark, exact, sf)
    assert {r["doc_id"] for r in near.collect()} == kept and len(kept) < len(want)
    clean = corpus_pipeline.secrets_stage(spark, near, sf)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == kept
    for r in clean.collect():
        spans, text, at, out = secrets.find_secrets(lettered[r["doc_id"]]), lettered[r["doc_id"]], 0, ""
        for s in spans:
            if s["start"] >= at:
                out += text[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["text"] == out + text[at:] and r["n_chars"] == (len(r["text"]) if spans else r["n_chars"])
    got = corpus_pipeline.run(spark, sf).toPandas()
    ids = packing.word_ids()([r["text"] for r in clean.orderBy("doc_id").collect()])
    sizes = {r["doc_id"]: len(i) for r, i in zip(clean.orderBy("doc_id").collect(), ids, strict=True)}
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
    assert all(part["n_tokens"].sum() <= part["bin_size"].iloc[0] for _, part in got.groupby("bin_id"))


CLASHES = ["blob", "spans", "findings", "keep", "sha", "keep_id", "verdict_key", "row", "id", "h", "node", "root", "key", "fp", "own_id", "own_sha", "gone_id", "part", "len", "prefix"]


@pytest.mark.parametrize("stage", ["language_stage", "exact_stage", "near_stage", "secrets_stage", "packing_stage"])
def test_stages_with_nulls_repeats_long_texts_and_clashing_columns(spark, stage):
    import corpus_pipeline

    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(150_000))  # about a megabyte
    rows = [(1, "plain words of one text here", "en", "s", 28), (1, "plain words of one text here", "en", "s", 28), (2, None, None, None, None), (3, "", "en", None, 0), (4, long, "en", "s", len(long)), (None, "no id but words", None, "s", None)]
    rows += [(1, "the same id with another text", "en", "s", 29), (7, "12 34", "en", "s", 5), (8, "secret = abcdefgh1 in a text", "en", "s", 28), (9, "PLAIN words of one text here", "en", "s", 28)]
    full = [(*r, *(f"{c}-{k}" for c in CLASHES)) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    out = getattr(corpus_pipeline, stage)(spark, docs, "")
    empty = getattr(corpus_pipeline, stage)(spark, docs.limit(0), "")
    assert empty.count() == 0 and empty.columns == out.columns
    if stage == "packing_stage":
        got = out.toPandas()
        assert got["doc_id"].isna().sum() == 1 and set(got["doc_id"].dropna()) == {1, 2, 3, 4, 7, 8, 9}
        return
    assert out.columns == docs.columns
    got = out.collect()
    source = {r[5]: r for r in full}
    for r in got:  # every column as it came, but for redacted texts
        before = source[r["blob"]]
        changed = stage == "secrets_stage" and before[0] == 8
        assert tuple(r)[5:] == before[5:] and (changed or tuple(r)[:5] == before[:5])
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:9]) for r in got)
    every = sorted((str(d), (t or "")[:9]) for d, t, *_ in rows)
    if stage == "language_stage":
        assert kept == [x for x in every if x[0] not in ("2", "3", "7")]
    elif stage == "exact_stage":
        assert kept == [x for x in every if x[0] != "2" and x[1] != "plain wor"]  # of null and empty, and of the copies, the largest id
    elif stage == "near_stage":
        assert kept == [x for x in every if x[0] not in ("3", "9")]
    else:
        assert len(got) == len(rows) and {r["text"] for r in got if r["doc_id"] == 8} == {"[SECRET] in a text"}


def test_near_stage_links_every_pair_at_least_080_alike(spark, monkeypatch):
    import corpus_pipeline

    from procmetrics.llm import near_copies

    rng = random.Random(5)
    common = " ".join(f"same{k}" for k in range(30))
    texts = [None, "", "one", "ONE", "a b c d e", "a b c d f"]
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 200]))]
        for edits in (0, 1, 1, 2, 3, 5, 8):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(copy) + (f" {common}" if rng.random() < 0.5 else ""))

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for sample in (1, 16):  # all texts and few tell which shingles are common
        monkeypatch.setattr(near_copies, "SAMPLE", sample)
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == sorted(set(root))
    assert len(set(root)) > 30
    assert corpus_pipeline.near_stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_near_stage_links_pairs_whose_common_shingles_come_late_in_one_text_only(spark, seed):
    """B inside A at exactly 0.8; some of B's shingles are common, and so may come late in A and early in B."""
    from procmetrics.llm import near_copies

    rng = random.Random(seed)
    names = iter(rng.sample(range(10**9), 10**5))
    texts, want = [], []
    for size, shared in ((30, 4), (30, 8), (60, 10), (90, 16)):
        words = [f"w{next(names)}" for _ in range(size)]
        part = rng.sample(words, size * 4 // 5)
        want.append((len(texts), len(texts) + 1))
        texts += [words, part]
        common = rng.sample(part, shared)
        for k in range(60):  # other texts that share some of these words, and are unlike
            some = rng.sample(common, rng.randrange(1, shared + 1))
            texts.append(some + [f"w{next(names)}" for _ in range(rng.choice([20, 40]))])
    sets = [set(t) for t in texts]
    root = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            if 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]):
                root = [min(root[x], root[y]) if r in (root[x], root[y]) else r for r in root]
    assert all(root[x] == root[y] for x, y in want)
    keyed = spark.createDataFrame([(k, k, " ".join(t)) for k, t in enumerate(texts)], "id long, h long, text string")
    path = shared_dir(spark, "near-test")
    rows = near_copies.cut(near_copies.prefixes(keyed, (np.empty(0, np.int64), np.empty(0, np.int64)), 1, 80), f"{path}/rows")
    linked = {r["node"]: r["root"] for r in near_copies.near_components(keyed, rows, path, shingle=1).collect()}
    node = {r["id"]: r["node"] for r in rows.collect()}
    got = {}
    for k in range(len(texts)):
        got.setdefault(linked.get(node[k], node[k]), []).append(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(k for k in range(len(texts)) if root[k] == r) for r in set(root))


def test_near_stage_makes_no_hash_tables_of_nodes_and_no_empty_rounds(spark, monkeypatch):
    from procmetrics.llm import near_copies

    cut, components, plans, calls = near_copies.cut, near_copies.connected_components, {}, []

    def seen(df, path, *also):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, path, *also)

    monkeypatch.setattr(near_copies, "cut", seen)
    monkeypatch.setattr(near_copies, "connected_components", lambda links: calls.append(1) or components(links))
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame([*enumerate(texts), (20, texts[4] + " end")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == list(range(20))
    assert "SortMergeJoin" in plans["first"] and not [k for k in ("first", "first_texts") if "Broadcast" in plans[k]]
    assert len(calls) == 1 and "second_pairs" in plans and "second_sets" not in plans and "round0_sets" not in plans


def test_near_stage_narrows_what_is_shared_and_finds_components_thrice_at_most(spark, monkeypatch):
    """Texts with a common passage that stay apart, pairs linked by the pivots or only at the end, and chance repeats."""
    from procmetrics.llm import near_copies

    cut, components, tables, calls = near_copies.cut, near_copies.connected_components, {}, []

    def seen(df, path, *also):
        out = cut(df, path, *also)
        if path.rsplit("/", 2)[1] == "met":
            tables[path.rsplit("/", 1)[1]] = [(r["key"], r["node"]) for r in out.collect()]
        return out

    monkeypatch.setattr(near_copies, "cut", seen)
    monkeypatch.setattr(near_copies, "connected_components", lambda links: calls.append(1) or components(links))
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(30)
    texts = [[*passage, *fresh(60)] for _ in range(40)]
    texts += [[*t[:k], "changed", *t[k + 1 :]] for k, t in zip(range(40, 80, 2), texts[:20], strict=True)]
    texts += [[*words, *fresh(5)] for words in [fresh(5) for _ in range(10)] for _ in range(2)]  # pairs with one shingle in common
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect())
    assert kept == sorted(plain_near_kept([(k, " ".join(t)) for k, t in enumerate(texts)])) == [*range(40), *range(60, 80)]
    assert len(calls) <= 3 and {"all", "rich", "first"} <= set(tables)
    assert len(set(tables["all"]) - set(tables["rich"])) >= 20 and set(tables["first"]) <= set(tables["rich"])


def test_parities_never_differ_in_more_bits_than_the_sets_in_shingles():
    from procmetrics.llm import near_copies

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-(2**63), 2**63, n)) for n in (1, 40, 150, 150, 2000)]
    sets += [np.unique(np.concatenate([s[k:], rng.integers(-(2**63), 2**63, k)])) for s in sets for k in (0, 1, 16, 90)] + [np.empty(0, np.int64)]
    bits = [np.unpackbits(np.array(p, np.int64).view(np.uint8)) for p in near_copies._parities(sets).to_pylist()]
    assert len(bits) == len(sets) and all(len(b) == 64 * near_copies.LONGS for b in bits)
    far = 0
    for a, x in zip(sets, bits, strict=True):
        for b, y in zip(sets, bits, strict=True):
            assert (x != y).sum() <= len(np.setxor1d(a, b))
            far += (x != y).sum() > 40
    assert far > 100 and near_copies._parities([]).to_pylist() == []


def test_near_stage_tells_a_large_group_of_unlike_texts_apart_before_sets_are_made(spark):
    """Copies of one text that are 0.66 to 0.76 alike, but for a few pairs: of some 30000 pairs that share early shingles few are compared by their sets."""
    from procmetrics.llm import near_copies

    rng = random.Random(4)
    words, texts = [f"w{k}" for k in range(150)], []
    for k in range(240):
        copy = list(words)
        for at in rng.sample(range(10, 140, 5), 3):
            copy[at] = f"own{k}-{at}"
        texts.append(" ".join(copy))
        if k % 40 == 0:
            texts.append(texts[-1] + " and more")
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.col("id").alias("h"), "text")
    path = shared_dir(spark, "near-test")
    rows = near_copies.cut(near_copies.prefixes(keyed, near_copies.common_shingles(keyed.select("text")), 5, 80), f"{path}/rows")
    roots = {r["node"]: r["root"] for r in near_copies.near_components(keyed, rows, path).collect()}
    least = {}
    for r in rows.collect():
        root = roots.get(r["node"], r["node"])
        least[root] = min(r["id"], least.get(root, r["id"]))
    assert set(least.values()) == plain_near_kept(list(enumerate(texts))) and 200 < len(least) <= 240
    assert spark.read.parquet(f"{path}/second_pairs").count() < 3000
