"""Sharding, Merkle manifests and fill-in-the-middle, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from procmetrics.llm import fill_middle, merkle, sharding
from procmetrics.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\t", "a", "a ", " a", "x" * 9000, "word " * 3000, "  word" * 5000 + " ", "tie tie tie", "tie tie tie", "日本語 テスト ein Wort", "é" * 5000 + " " + "ß" * 4000, "has <P> inside", "a<S", "P> <", "<"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, extra=("row", "id", "tie", "size", "shard", "part", "place", "tree", "leaf", "digest", "chunk", "output", "form", "by", "claim")):
    """Rows (doc_id, text) with the columns of documents and others whose names the operators use inside."""
    full = [(i, t, (None, "en", "de", "fr", "zh")[k % 5], (None, "web")[k % 2], None if k % 4 == 0 else len(t or ""), *(f"{c}{k}" for c in extra)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))


# 11
def plain_shards(rows, n):
    """Of rows of unlike ids: the shard of each, by the middle of its bytes in the order of ids."""
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    total, at, out = sum(size.values()), 0, {}
    for i in sorted(size, key=lambda x: (x is not None, x or 0)):
        out[i] = min(n - 1, (2 * at + size[i]) * n // (2 * total))
        at += size[i]
    return out


@pytest.mark.parametrize("ranges", [(64, 32), (4, 2)])
def test_shards_of_unlike_ids(spark, monkeypatch, ranges):
    rng = random.Random(2)
    monkeypatch.setattr(sharding, "LEAST_RANGES", ranges[0])
    monkeypatch.setattr(sharding, "DRAWS", ranges[1])
    rows = [(i, " ".join("word" for _ in range(int(rng.paretovariate(0.8))))) for i in rng.sample(range(-5000, 5000), 900)] + [(None, "no id"), (6000, None), (6001, "")]
    path = shared_dir(spark, "shards")
    df = frame(spark, rows)
    sharding.write_shards(df, path, 7)
    got = sharding.read_shards(spark, path).collect()
    assert sorted(tuple(r["row"]) for r in got if r["row"]["doc_id"] is not None) == sorted(tuple(r) for r in df.collect() if r["doc_id"] is not None) and len(got) == len(rows)
    assert {r["row"]["doc_id"]: r["shard"] for r in got} == plain_shards(rows, 7)
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append((r["slot"], r["row"]["doc_id"]))
    for found in places.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found)))
        ids = [-(10**6) if i is None else i for _, i in found]
        assert ids == sorted(ids)
    assert sharding.read_manifest(spark, path).agg(F.sum("rows")).first()[0] == len(rows)


def test_shards_split_hot_ids_and_copies(spark):
    rng = random.Random(3)
    rows = [(5, "the very same text of a copy")] * 3000 + [(9, f"text number {k} " + "w " * rng.randrange(40)) for k in range(3000)] + [(k, "w " * rng.randrange(60)) for k in range(10, 3000)]
    path = shared_dir(spark, "shards")
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path)
    got = sharding.read_shards(spark, path).select("shard", "slot", "row.doc_id", "row.text").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    size = Counter()
    slots = defaultdict(set)
    for r in got:
        size[r["shard"]] += len(r["text"]) + 1
        slots[r["shard"]].add(r["slot"])
    assert set(size) == set(range(16)) and max(size.values()) < 1.1 * min(size.values())
    assert all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)
    plan = sharding.make_plan(spark.read.parquet(f"{path}/keys"), 16)
    assert [d["id"] for d in plan.hot] == [5] and sum(r.bytes > 3 * plan.bytes / 64 for r in plan.ranges) == 1  # that of the copies


def test_overfull_ranges_are_subdivided(spark):
    """Bounds come from bytes alone, so many small records beside few large ones make no range of too many bytes; a skewed first sample is mended."""
    groups = spark.range(20_000).select("id", F.lit(0).cast("long").alias("tie"), F.lit(1).cast("long").alias("n"), F.when(F.col("id") < 100, 5000).otherwise(10).cast("long").alias("bytes"))
    plan = sharding.make_plan(groups, 4)
    assert sum(r.bytes for r in plan.ranges) == plan.bytes == 100 * 5000 + 19_900 * 10
    assert max(r.bytes for r in plan.ranges if r.keys > 1) <= 3 * plan.bytes / sharding.LEAST_RANGES


@pytest.mark.parametrize("rows", [[], [(1, "one")], [(1, "one"), (1, "one")], [(None, None)]])
def test_shards_of_few_rows(spark, rows):
    path = shared_dir(spark, "shards")
    sharding.write_shards(frame(spark, rows), path)
    got = sharding.read_shards(spark, path).select("shard", "slot").collect()
    assert len(got) == len(set(got)) == len(rows)


def test_op11(spark):
    got = sharding.op11_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    shard = plain_shards(list(docs.items()), 16)
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", shard[i], None) for i, t in docs.items()}
    for k in range(16):
        mine = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == k)
        assert mine == list(enumerate(sorted(i for i in shard if shard[i] == k)))


# 12
def plain_leaf(r, more=0):
    fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return levels


def plain_path(levels, k):
    """Siblings with their side, from the node up."""
    out = []
    for level in levels[:-1]:
        out.append((level[k ^ 1] if k ^ 1 < len(level) else "", k & 1))
        k >>= 1
    return out


def plain_proofs(rows, claimed):
    """doc_id, leaf, subroot, root, proof hash, folded root of every row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), claimed(r), r["doc_id"]))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: (g, plain_tree([x[2] for x in g])) for lang, g in ((lang, sorted(groups[lang], key=lambda x: x[:3])) for lang in langs)}
    top = plain_tree([trees[lang][1][-1][0] for lang in langs])
    out = Counter()
    for n, lang in enumerate(langs):
        group, levels = trees[lang]
        for k, (_, _, leaf, claim, doc_id) in enumerate(group):
            path = plain_path(levels, k) + plain_path(top, n)
            folded = claim
            for sibling, left in path:
                folded = h(sibling + folded if left else folded + sibling)
            out[doc_id, leaf, levels[-1][0], top[-1][0], h("".join(s for s, _ in path)), folded] += 1
    return out


@pytest.mark.parametrize("bits", [2, 12])
def test_manifest_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rng = random.Random(4)
    rows = [(rng.randrange(60), t) for t in ODD] + [(k, f"text {k}") for k in range(100)] + [(None, "no id"), (None, "no id")] + [(3, "again and again")] * 30
    df = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 99, "aa").otherwise(F.col("lang")))
    path = shared_dir(spark, "manifest")
    odd_ids = F.col("doc_id") % 5 == 0
    fields = [F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    merkle.write_manifest(df, path, claim=F.when(odd_ids, merkle.leaf_hash(fields)))
    got = merkle.prove(spark, path).collect()
    claimed = lambda r: plain_leaf(r, 1 if r["doc_id"] is not None and r["doc_id"] % 5 == 0 else 0)
    assert Counter((r["id"], r["leaf"], r["subroot"], r["root"], h(r["proof"]), r["folded_root"]) for r in got) == plain_proofs(df.collect(), claimed)
    for r in got:
        assert r["verified"] == (r["folded_root"] == r["root"])
        siblings = iter(re.findall(".{64}", r["proof"]))
        path_ = [("" if s == "-" else next(siblings), s == "L") for s in r["sides"]]
        assert merkle.fold(r["leaf"], path_) == r["root"]
    some = merkle.prove(spark, path, F.col("id").isin(3, 50, 51)).collect()
    assert sorted(some) == sorted(r for r in got if r["id"] in (3, 50, 51))
    lost = spark.read.parquet(f"{path}/leaves").where("id IS NOT NULL")
    lost.write.parquet(f"{path}/fewer")
    monkeypatch.setattr(merkle, "_nodes", lambda s, p, kind="nodes", leaves="leaves", real=merkle._nodes: real(s, p, kind, "fewer" if leaves == "leaves" else leaves))
    with pytest.raises(Exception, match="is lost"):
        merkle.prove(spark, path, F.col("id").isNotNull()).collect()


def test_fewest_nodes():
    rng = random.Random(6)
    for size in (1, 2, 3, 5, 8, 13, 64, 77):
        for _ in range(10):
            some = np.array(rng.sample(range(size), rng.randrange(1, size + 1)))
            levels = plain_tree([h(str(k)) for k in range(size)])
            need = merkle.missing(some, size)
            branches = merkle.Branches(size, {**{(lv, k): levels[lv][k] for lv, k in need}, **{(0, k): levels[0][k] for k in some.tolist()}}, some)
            assert branches.root == levels[-1][0]
            for k in some.tolist():
                assert [(s, int(left)) for s, left in branches.proof(0, k)] == [(s, left) for s, left in plain_path(levels, k)]
            singles = {(lv, k ^ 1) for i in some.tolist() for lv, k in ((lv, i >> lv) for lv in range(len(levels) - 1)) if k ^ 1 < len(levels[lv])}
            own = {(lv, i >> lv) for i in some.tolist() for lv in range(len(levels))}
            assert set(need) == singles - own and len(need) == len(set(need))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, n):
    path = shared_dir(spark, "manifest")
    df = frame(spark, [(k, f"t{k}") for k in range(n)])
    merkle.write_manifest(df, path)
    got = merkle.prove(spark, path).collect()
    assert Counter((r["id"], r["leaf"], r["subroot"], r["root"], h(r["proof"]), r["folded_root"]) for r in got) == plain_proofs(df.collect(), plain_leaf)
    assert (merkle.read_root(spark, path) is None) == (n == 0)


def test_op12(spark):
    got = merkle.op12_merkle_manifest(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    claimed = lambda r: plain_leaf(r, int(zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got) == plain_proofs(docs, claimed)
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 4


# 13
def plain_middle(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    x = h(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_fill_middle_brute_force(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice(["word", "é", " ", "  ", "\n", "日本", "x" * 40]) for _ in range(900)) for _ in range(4)]
    texts = ODD + ["".join(rng.choice(passages) for _ in range(rng.randrange(1, 9))) for _ in range(200)] + ["w" * 200_000 + " " + "v" * 100_000, " " * 50_000 + "end"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id but a few words"), (7, "one id twice"), (7, "one id twice")]
    for rate in (50, 100):
        got = fill_middle.fill_middle(frame(spark, rows), rate=rate).withColumn("again", fill_middle.restore("output", "form")).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter((i, *plain_middle(i, t, rate)) for i, t in rows)
        assert Counter((r["doc_id"], r["again"]) for r in got) == Counter((i, t or "") for i, t in rows)


def test_chunks_are_summed_once_each():
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000)).encode()
    summaries = fill_middle.Summaries()
    for head in (b"", b"another head ", b"and a third, longer one "):
        text = head + passage
        cuts = fill_middle.Cuts(text, summaries)
        words = re.findall(rb"\s*\S+", text)
        assert cuts.n == len(words)
        ends = np.cumsum([0, *map(len, words)])
        assert all(cuts.end_of(k)[0] == ends[k] for k in rng.sample(range(len(words) + 1), 300))
        few = summaries.made
    assert few < 1.1 * len(cuts.chunks)  # of the three texts, only what stands at the heads differs
    small_cache = fill_middle.Summaries(1000)
    assert fill_middle.Cuts(passage, small_cache).n == 20_000 and len(small_cache.young) < 20


def test_fill_middle_empty(spark):
    assert fill_middle.fill_middle(frame(spark, [])).count() == 0


def test_op13(spark):
    got = fill_middle.op13_fill_middle(spark, SF).collect()
    want = {r["doc_id"]: (*(p := plain_middle(r["doc_id"], r["text"]))[:4], h(p[4]), h(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and {r["form"] for r in got} == {"plain", "psm", "spm"}


# all
@pytest.mark.parametrize("empty", [False, True])
def test_registered_queries_on_odd_tables(spark, empty):
    """Nulls in every column, repeated rows, a text of about a megabyte, and extra columns of names that operators use inside; or no row at all."""
    from procmetrics.llm.entry import QUERIES

    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(150_000))
    rows = [(1, "plain words of one text here"), (1, "plain words of one text here"), (2, None), (3, ""), (4, long), (None, "no id but words"), (5, "secret = abcdefgh1 in a text"), (7, "7 8"), (8, "PLAIN words of one text here")]
    names = ("row", "id", "tie", "size", "shard", "part", "place", "node", "leaf", "key", "chunk", "output", "form", "by", "claim", "blob", "path", "word", "fp", "h", "score", "label", "rid", "norm", "held_out", "n_tokens", "start", "at")
    docs = frame(spark, [] if empty else rows, names)
    base = shared_dir(spark, "odd")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, 1, 0), (4, None, 1), (5, 0, 1), (7, 0, 0), (None, None, None)], "doc_id long, quality long, toxic long").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([] if empty else [(50, [1.0, 2.0], "x"), (51, [0.5, None], "x"), (100, None, "x"), (None, [1.0, 1.0], "x"), (52, [3.0, 1.0], "x")], "vec_id long, embedding array<float>, id string").write.parquet(f"{base}/embeddings.parquet")
    for name, query in QUERIES.items():
        got = query(spark, base).collect()
        if empty:
            assert got == [], name
        elif name == "op4_topk":
            assert [tuple(r) for r in got] == [(50, 1, 52, 256 * 256 * 5)], name
        elif name == "op9_packing":
            assert {r["doc_id"] for r in got} == {None, 1, 2, 3, 4, 5, 7, 8}, name
        else:
            assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows), name
