"""Operators on texts, against plain Python or the libraries themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from procmetrics.llm import byte_bpe, exact_dedup, language_id, ngram_lm, secrets, simhash, token_store, toxicity
from procmetrics.llm.common import shared_dir
from procmetrics.llm.hash_store import short_counts, whole_counts

ODD = ["", None, " ", "\n\t", "a", "A", "ÉÀ é", "x" * 9000, "word " * 3000, "tie tie tie", "tie tie tie", "it's 42 — “ok”", "日本語 テスト", "\x1c a\x85b\xa0c", "password = hunter2hunter2"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def frame(spark, texts):
    """Texts with ids from 0, and columns whose names the operators use inside."""
    rows = [(k, t, "z", "z", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, name string, h long, fp long")


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# 1
def plain_secrets(text):
    out = []
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for kind, pattern, ok in (("assign", rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_secrets_brute_force(spark, docs):
    texts = [r["text"] for r in docs.collect()] + ODD + ["token=ab token: 'abcdef' api_key:xyz123", "AKIA" + "Z9" * 8, "f" * 24 + " " + "e" * 23, "ſecret=abcdefgh", "toKen=abcdefgh"]
    got = secrets.scan(frame(spark, texts), f"{shared_dir(spark, 'ledger')}/l").withColumn("spans", secrets.spans_text(F.col("findings"))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [s for s in r["spans"].split(",") if s and s.split(":")[0] in ("assign", "access", "hex")] == plain_secrets(texts[r["path"]])


def test_ledger_scans_each_blob_and_version_once(spark):
    ledger = f"{shared_dir(spark, 'ledger')}/l"
    secrets.update_ledger(frame(spark, ["one", "one", "two"]), ledger)
    assert secrets.open_ledger(spark, ledger).count() == 2
    secrets.update_ledger(frame(spark, ["one", "three", None]), ledger)
    assert secrets.open_ledger(spark, ledger).count() == 4
    secrets.update_ledger(frame(spark, ["one"]), ledger, version="rules-2")
    assert secrets.open_ledger(spark, ledger).count() == 5


def test_ledger_fetches_texts_of_new_blobs_only(spark, monkeypatch):
    """Two runs: the second holds addresses against the ledger first, whichever way new texts are then fetched."""
    old = [f"old text {k} token = abcdef{k}" for k in range(30)]
    for few in (1 << 20, 0):
        monkeypatch.setattr(secrets, "FEW_BYTES", few)
        ledger, packed = f"{shared_dir(spark, 'ledger')}/l", []
        real = secrets._bodies
        monkeypatch.setattr(secrets, "_bodies", lambda df, col, real=real: packed.append(df.count()) or real(df, col))
        secrets.update_ledger(frame(spark, old), ledger)
        got = secrets.scan(frame(spark, [*old, "new secret=zzzzzzzz", "new secret=zzzzzzzz", "nothing"]), ledger)
        assert sorted((r["path"], len(r["findings"])) for r in got.collect()) == sorted([(k, 1) for k in range(32)] + [(32, 0)])
        assert secrets.open_ledger(spark, ledger).count() == 32
        assert packed == ([30, 3] if few else [30, 33])  # rows whose texts are packed
        monkeypatch.setattr(secrets, "_bodies", real)
    assert secrets.scan(nothing(spark), f"{shared_dir(spark, 'ledger')}/e").count() == 0
    assert secrets.redact(nothing(spark)).count() == 0
    twice = spark.createDataFrame([(1, "token=abcdefg"), (1, "token=abcdefg"), (None, "x")], "doc_id long, text string")
    assert secrets.scan(twice, f"{shared_dir(spark, 'ledger')}/t").count() == 3


def test_redact(spark):
    text = "é token=abcdefgh and AKIA" + "A" * 16 + " end"
    rows = [(1, text, "en", "s", len(text)), (2, "clean", "en", "s", 5), (3, None, None, None, None), (2, "clean", "en", "s", 5)]
    out = {(r["doc_id"], r["text"], r["n_chars"]) for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert out == {(1, "é [SECRET] and [SECRET] end", 27), (2, "clean", 5), (3, None, None)}


# 2
def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    m = docs.merge(labels, on="doc_id")
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in m["doc_id"]])
    train = m[fold != 1].groupby("toxic").head(toxicity.PER_LABEL)
    model = toxicity.train(list(zip(train["text"], train["toxic"], strict=True)))
    test = m[fold == 1]
    score = toxicity.score_slice(model, pa.array(test["text"].tolist()))
    bad = test["toxic"].to_numpy() == 1
    assert (score[bad] >= 0.7).mean() > 0.9 and (score[~bad] >= 0.7).mean() < 0.02
    assert np.all((score >= 0) & (score <= 1))


def test_toxicity_unseen_spelling_and_edges(spark):
    sample = [(f"you are an idiot number {k} indeed", 1) for k in range(40)] + [(f"the weather of day {k} was fine indeed", 0) for k in range(40)]
    model = toxicity.train(sample)
    score = toxicity.score_slice(model, pa.array(["such an idiott here", "such a nice day here", "", None]))
    assert score[0] > score[1] and score[2] == score[3]
    assert toxicity.score(frame(spark, ODD), model).count() == len(ODD)
    assert toxicity.score(nothing(spark), model).count() == 0
    one = toxicity.train([("only", 1)])
    assert toxicity.score_slice(one, pa.array(["only"]))[0] < 0.7


# 3
def test_token_store_round_trip(spark, docs):
    import public_tokenizers

    path, store = public_tokenizers.path("word_bpe_49k.json"), f"{shared_dir(spark, 'store')}/s"
    texts = [r["text"] for r in docs.limit(60).collect()] + ODD
    token_store.write_store(frame(spark, texts), store, path)
    want = token_store.whole_text_ids(path, [t or "" for t in texts])
    ids = {r["id"]: r["ids"] for r in token_store.read_ids(spark, store).collect()}
    start = 0
    for r in token_store.read_back(spark, store).orderBy("id").collect():
        own = np.array([*want[r["id"]], 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (start, len(own), zlib.crc32(own.tobytes()), True)
        assert ids[r["id"]] == own.tolist()
        start += len(own)


def test_token_store_special_tokens_as_the_library_has_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, store = public_tokenizers.path("word_bpe_49k.json"), f"{shared_dir(spark, 'store')}/s"
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "A <|ENDOFTEXT|> b <|StartOfText|>", "a <|endoftext| > b"]
    token_store.write_store(frame(spark, texts), store, path)
    ids = {r["id"]: r["ids"] for r in token_store.read_ids(spark, store).collect()}
    library = Tokenizer.from_file(path)
    assert [ids[k][:-1] for k in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in ids[0][:-1] and ids[1][0] == 49406


def test_token_store_notices_what_is_lost_or_changed(spark):
    import shutil

    import public_tokenizers

    path, store = public_tokenizers.path("word_bpe_49k.json"), f"{shared_dir(spark, 'store')}/s"
    token_store.write_store(frame(spark, [f"text number {k} of a store" for k in range(20)]), store, path)
    plain = store.removeprefix("file://")
    chunks = spark.read.parquet(f"{store}/chunks")
    spoilt = {
        "lost": chunks.limit(chunks.count() - 1),
        "changed": chunks.withColumn("body", F.lit(bytearray(token_store.pack(np.array([5, 6, 7]))))),
    }
    for what, less in spoilt.items():
        shutil.copytree(plain, f"{plain}-{what}")
        less.write.mode("overwrite").parquet(f"{store}-{what}/chunks")
        assert token_store.read_back(spark, f"{store}-{what}").where("NOT verified").count() >= 1
        with pytest.raises(Exception, match=what):
            token_store.read_ids(spark, f"{store}-{what}").collect()
    shutil.copytree(plain, f"{plain}-recipes")
    recipes = spark.read.parquet(f"{store}/recipes")
    recipes.where("id <> 3").write.mode("overwrite").parquet(f"{store}-recipes/recipes")  # a document is gone, the others' own roots are right
    assert token_store.read_back(spark, f"{store}-recipes").where("verified").count() == 0
    with pytest.raises(Exception, match="manifests"):
        token_store.read_ids(spark, f"{store}-recipes").collect()
    assert token_store.read_back(spark, store).where("NOT verified").count() == 0


def test_word_encoder_equals_the_untouched_library_on_random_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_store.WordEncoder(path)
    rng = np.random.default_rng(11)
    bits = [*map(chr, range(0x00, 0x180)), *"\u0301\u0345ſKİıßẞ", *"日本語テスト\U0001F600\u2028\u3000", "<|endoftext|>", "<|startoftext|>", "'s", "'re", "'LL", " ", " ", "the", "And"]
    texts = ["".join(rng.choice(np.array(bits, object), rng.integers(0, 40)).tolist()) for _ in range(6000)]
    got = own.encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_token_store_repeats_and_null_ids(spark):
    import public_tokenizers

    store = f"{shared_dir(spark, 'store')}/s"
    rows = spark.createDataFrame([(5, "same"), (5, "same"), (None, "first"), (1, None)], "doc_id long, text string")
    token_store.write_store(rows, store, public_tokenizers.path("word_bpe_49k.json"))
    got = token_store.read_back(spark, store).orderBy("start").collect()
    assert [r["id"] for r in got] == [None, 1, 5, 5] and [r["start"] for r in got] == list(np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1])


def test_token_store_chunks_are_shared(spark):
    import public_tokenizers

    path, store = public_tokenizers.path("word_bpe_49k.json"), f"{shared_dir(spark, 'store')}/s"
    body = " ".join(f"w{k % 997} item{k}" for k in range(8000))
    token_store.write_store(frame(spark, [body, "new first words " + body, body]), store, path)
    chunks, used = spark.read.parquet(f"{store}/chunks").count(), token_store.read_recipes(spark, store).select(F.sum(F.size("addresses"))).first()[0]
    assert chunks < 0.6 * used
    empty = f"{shared_dir(spark, 'store')}/e"
    token_store.write_store(nothing(spark), empty, path)
    assert token_store.read_back(spark, empty).count() == 0


# 5
def test_exact_dedup_brute_force(spark):
    texts = ODD + ["Same Text"] * 3 + ["same text", "y" * 20000, "y" * 20000, "y" * 19999 + "z", "Ä", "ä"]
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(k)
    got = exact_dedup.exact_duplicates(frame(spark, texts), block=64).collect()
    assert len(got) == len(texts)
    for r in got:
        g = groups[lower(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(g), len(g), r["doc_id"] == max(g), hashlib.sha256(lower(texts[r["doc_id"]]).encode()).hexdigest())


def test_exact_dedup_by_text_when_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    got = exact_dedup.exact_duplicates(frame(spark, ["abcd" * 5, "abce" * 5, "abcd" * 5, "q"]), block=4).toPandas()
    assert got.set_index("doc_id")["keep_id"].to_dict() == {0: 2, 1: 1, 2: 2, 3: 3}


def test_exact_dedup_repeated_ids_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "b")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert got["kept"].sum() == 2 and len(got) == 4
    assert exact_dedup.exact_duplicates(nothing(spark)).count() == 0
    full = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "A", "en", "s", 1)], nothing(spark).schema)
    assert [r["doc_id"] for r in exact_dedup.drop_duplicates(full).collect()] == [2]


# 6
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in docs["doc_id"]])
    train = docs[fold != 2].groupby("lang").head(60)
    model = language_id.train(list(zip(train["text"], train["lang"], strict=True)), chains=1500)
    test = docs[fold == 2]
    share, _, _ = language_id.predict_slice(model, pa.array(test["text"].tolist()))
    assert (np.array(model.labels)[share.argmax(axis=1)] == test["lang"].to_numpy()).mean() > 0.93


def test_forward_backward_brute_force():
    rng = np.random.default_rng(0)
    scores, switch, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    marginal = language_id.forward_backward(scores, np.array([4]), switch, start)[0][0]
    want, total = np.zeros((4, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        w = math.exp(start[path[0]] + sum(scores[0, t, s] for t, s in enumerate(path)) + sum(switch[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, s in enumerate(path):
            want[t, s] += w
    assert np.allclose(marginal, want / total)


def test_language_edges(spark):
    model = language_id.train([("le chat noir dort", "fr"), ("the black cat sleeps", "en")] * 3, chains=200)
    got = {r["doc_id"]: r for r in language_id.predict(frame(spark, ODD), model).collect()}
    assert len(got) == len(ODD)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (0, 1, 2, 3))
    assert got[4]["lang_pred"] in ("fr", "en")
    assert language_id.predict(frame(spark, ["x"]), language_id.train([])).first()["lang_pred"] == "und"
    assert language_id.keep_known(nothing(spark)).count() == 0


def test_words_of_mixed_texts_are_labelled_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in docs["doc_id"]])
    train, test = docs[fold != 2].groupby("lang").head(60), docs[fold == 2]
    model = language_id.train(list(zip(train["text"], train["lang"], strict=True)), chains=1500)
    by = {lang: [t.split() for t in part["text"]] for lang, part in test.groupby("lang")}
    names, texts, truth = sorted(by), [], []
    for k in range(30):  # runs of 15 words of two languages by turns
        pair = [names[k % len(names)], names[(k + 1) % len(names)]]
        runs = [(n, by[n][(k + j) % len(by[n])][:15]) for j, n in enumerate(pair * 2)]
        texts.append(" ".join(w for _, r in runs for w in r))
        truth.append([n for n, r in runs for _ in r])
    rows = {r["doc_id"]: r["words"] for r in language_id.label_words(frame(spark, [*texts, None, "", "12 ab 34"]), model).collect()}
    right = [w["label"] == y for k, ys in enumerate(truth) for w, y in zip(rows[k], ys, strict=True) if w["label"]]
    assert np.mean(right) > 0.85
    assert rows[30] == rows[31] == [] and [w["label"] is None for w in rows[32]] == [True, False, True]
    got = {r["doc_id"]: r for r in language_id.predict(frame(spark, texts), model).collect()}
    assert all(got[k]["n_switches"] >= 2 for k in range(30))
    assert all(w["label"] is None for w in language_id.label_words(frame(spark, ["a b"]), language_id.train([])).first()["words"])
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert language_id.predict(twice, model).count() == 3 and language_id.predict(nothing(spark), model).count() == 0


def test_sample_is_the_least_hashes_of_each_label_within_its_bytes(spark):
    from procmetrics.llm.subwords import labelled_sample

    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 7 > 0, "often").alias("lang"))
    got = labelled_sample(docs, docs, "doc_id", "text", "lang", 120)
    rows = docs.withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).where("lang IS NOT NULL").toPandas()
    want = {(r.text, r.lang) for _, part in rows.groupby("lang") for r in part.sort_values("u").head(120).itertuples()}
    assert set(got) == want and len(got) == 220
    less = labelled_sample(docs, docs, "doc_id", "text", "lang", 120, max_bytes=2000)
    assert {y for _, y in less} == {"rare", "often"} and sum(len(t) for t, _ in less) <= 2000 and set(less) < want
    assert labelled_sample(docs.limit(0), docs, "doc_id", "text", "lang", 5) == []


def test_keep_known_without_labels_and_with_mixed_texts(spark):
    import corpus_pipeline

    kind = nothing(spark).schema
    ids = {held: [k for k in range(60) if (zlib.crc32(str(k).encode()) % 4 == 2) == held] for held in (True, False)}
    odd = [(None, "no id", None, None, None), (100, None, "en", "s", 1), (101, "", "en", "s", 1), (102, "12 -- 3", "en", "s", 1), (103, "été 7", None, "s", None)]
    unlabelled = [(k, f"text {k}", None, "s", 1) for k in ids[False][:4]]
    only_held_out = [(k, f"text {k}", "en", "s", 1) for k in ids[True][:4]]
    for rows in (unlabelled, only_held_out, unlabelled + only_held_out):
        got = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows + odd, kind), "").collect()
        assert sorted(r["text"] for r in got) == sorted([r[1] for r in rows] + ["no id", "été 7"])

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 200 and 2000").toPandas()
    by = {lang: [t.split() for t in part["text"].head(40)] for lang, part in docs.groupby("lang")}
    assert len(by) >= 3
    names, mixed = sorted(by), []
    for k in range(40):  # passages of 12 words, of three and more languages by turns
        used = names if k % 2 else [n for j, n in enumerate(names) if j != k // 2 % len(names)]
        mixed.append(" ".join(" ".join(by[n][k % len(by[n])][:12]) for n in used))
    start = int(docs["doc_id"].max()) + 1
    rows = [(int(r.doc_id), r.text, r.lang, "s", 1) for r in docs.groupby("lang").head(40).itertuples()] + [(start + k, t, None, None, None) for k, t in enumerate(mixed)]
    got = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, kind), "")
    assert got.where(F.col("doc_id") >= start).count() == len(mixed)


def test_long_texts_are_labelled_in_parts(monkeypatch):
    model = language_id.train([("der die das und nicht ein", "de"), ("the and of to in is", "en")] * 5, chains=200)
    texts = pa.array(["the and der die " * 400, None, "", "12 34", "of to nicht ein " * 90])
    whole = language_id.word_marginals(model, texts)[3]
    monkeypatch.setattr(language_id, "LOT", 3)
    assert np.array_equal(whole, language_id.word_marginals(model, texts)[3]) and len(whole) == 1600 + 2 + 360


# 7
def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps, distance=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_simhash_brute_force(spark, docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()] + ODD
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(fps)
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["fp"] % (1 << 64), r["component_id"]) == (fps[r["doc_id"]], want[r["doc_id"]])


def test_close_pairs_find_every_link(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    values = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(sorted((r["u"] % (1 << 64), r["v"] % (1 << 64)))) for r in simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}


def test_simhash_edges(spark):
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == 3 and set(got["component_id"]) == {5}


# 8
def plain_language_model(train):
    """Interpolated modified Kneser-Ney of order 3 over dictionaries: word lists to (tokens, words, probability of a word after two)."""
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    uni, triples = Counter(), Counter()
    for t in train:
        w = words(t)
        uni.update(w)
        triples.update(zip([0, 0, *w], [0, *w], w, strict=False))
    pairs = Counter((b, c) for _, b, c in triples)
    before = Counter(c for _, c in pairs)
    cut = lambda c, d: (0, *d)[min(c, 3)]
    d3, d2, d1 = (ngram_lm.discounts([sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)]) for counts in (triples, pairs, before))
    after3, after2 = {}, {}
    for (a, b, _), c in triples.items():
        after3.setdefault((a, b), []).append(c)
    for (b, _), c in pairs.items():
        after2.setdefault(b, []).append(c)
    spare = sum(cut(c, d1) for c in before.values()) / max(1, len(pairs)) if pairs else 1.0

    def step(count, seen, d, lower):
        return (count - cut(count, d)) / sum(seen) + sum(cut(c, d) for c in seen) / sum(seen) * lower if seen else lower

    def p(a, b, c):
        low = (before[c] - cut(before[c], d1)) / max(1, len(pairs)) + spare / (len(uni) + 1)
        return step(triples[a, b, c], after3.get((a, b)), d3, step(pairs[b, c], after2.get(b), d2, low))

    return uni, words, p


@pytest.mark.parametrize("small", [False, True])
def test_language_model_brute_force(spark, docs, monkeypatch, small):
    if small:  # many shards, and triples sent on in small lots
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 300)
        monkeypatch.setattr(ngram_lm, "PENDING", 500)
        monkeypatch.setattr(ngram_lm, "SLICE", 4000)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ["", None, "new unseen words", "the the the", "x y " * 400, "x y z"]
    train = texts[:40] + ["x y " * 400, "x y z", None]
    uni, words, p = plain_language_model(train)
    n, v = sum(uni.values()), len(uni)
    for a, b in ((0, 0), (b"x", b"y"), (b"the", b"the"), (b"?", b"?")):
        assert abs(sum(p(a, b, c) for c in uni) + p(a, b, b"?!") - 1) < 1e-9
    model = ngram_lm.train(frame(spark, train), shared_dir(spark, "lm"))
    assert (model.tokens, model.words) == (n, v)
    for r in ngram_lm.score(frame(spark, texts), model).collect():
        w = words(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(uni[x] > 0 for x in w))
        assert math.isclose(r["base_score"], sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b, c)) for a, b, c in zip([0, 0, *w], [0, *w], w, strict=False)), rel_tol=1e-9)


def test_language_model_edges(spark):
    model = ngram_lm.train(nothing(spark), shared_dir(spark, "lm"))
    got = ngram_lm.score(frame(spark, ["a b", None]), model).collect()
    assert model.tokens == 0 and all(math.isfinite(r["score"]) for r in got)
    assert ngram_lm.score(nothing(spark), model).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    assert ngram_lm.score(twice, ngram_lm.train(twice, shared_dir(spark, "lm"))).count() == 3
    big = np.array([0, 3, 254, 255, 256, 1 << 40], np.uint64)
    assert ngram_lm._unsqueeze_counts(ngram_lm._squeeze_counts(big[::-1].copy())).tolist() == big[::-1].tolist()
    assert whole_counts(short_counts("c", big), "c", np.array([5, 0, 3])).tolist() == [1 << 40, 0, 255]


def test_language_model_misses_a_lost_shard_and_survives_a_hash_clash(spark, monkeypatch):
    import os

    path = shared_dir(spark, "lm")
    texts = ["a b c d e f g h"] * 3
    model = ngram_lm.train(frame(spark, texts), path)
    want = [r["score"] for r in ngram_lm.score(frame(spark, texts), model).collect()]
    os.rename(f"{path.removeprefix('file://')}/contexts", f"{path.removeprefix('file://')}/gone")
    with pytest.raises(Exception, match="FileNotFoundError"):
        ngram_lm.score(frame(spark, texts), model).collect()
    calls = []
    real = ngram_lm._count_words

    def clash_once(*args):
        calls.append(args[-1])
        if len(calls) == 1:
            raise ngram_lm.HashClash
        return real(*args)

    monkeypatch.setattr(ngram_lm, "_count_words", clash_once)
    again = ngram_lm.train(frame(spark, texts), shared_dir(spark, "lm"))
    assert calls == [42, 44] and again.seed == 44
    assert np.allclose([r["score"] for r in ngram_lm.score(frame(spark, texts), again).collect()], want)


# 10
def own_bpe():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("long", [512, 4])
def test_byte_bpe_like_the_library(spark, docs, monkeypatch, long):
    monkeypatch.setattr(byte_bpe, "LONG", long)  # of more bytes: by the heap
    ranks, pattern, own = own_bpe()
    rng = np.random.default_rng(1)
    noise = ["".join(map(chr, rng.choice([*range(97, 105), 32, 233, 0x4E2D, 0x1F600], 60))) for _ in range(40)]
    texts = [r["text"] for r in docs.limit(30).collect()] + ODD + noise + ["a" * 700, "  \n\n x", "½²3 ×÷", "<|endoftext|>", "ab" * 100_000, "".join(map(chr, rng.integers(97, 123, 200_000)))]
    words = byte_bpe.build_words(frame(spark, texts), ranks, pattern, f"{shared_dir(spark, 'bpe')}/w")
    got = byte_bpe.encode(frame(spark, texts), words).join(byte_bpe.digests(frame(spark, texts), words, ranks), "doc_id").toPandas().set_index("doc_id")
    for k, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert list(got.loc[k, "ids"]) == ids, k
        assert got.loc[k, "n_tokens"] == len(ids) and got.loc[k, "ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.loc[k, "decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_byte_bpe_edges(spark, monkeypatch):
    ranks, pattern, own = own_bpe()
    empty = byte_bpe.build_words(nothing(spark), ranks, pattern, f"{shared_dir(spark, 'bpe')}/w")
    assert byte_bpe.digests(nothing(spark), empty, ranks).count() == 0
    rows = spark.createDataFrame([(1, "same"), (1, "same"), (None, "other")], "doc_id long, text string")
    assert byte_bpe.encode(rows, byte_bpe.build_words(rows, ranks, pattern, f"{shared_dir(spark, 'bpe')}/w")).count() == 3
    with pytest.raises(Exception, match="missing from the word table"):
        byte_bpe.encode(rows, empty).collect()


def test_byte_bpe_heap_equals_the_library_on_random_words():
    ranks, _, own = own_bpe()
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 100, 3000):
        for alphabet in (b"ab", b"etaoin", bytes(range(256))):
            word = bytes(rng.choice(list(alphabet), n).tolist())
            assert byte_bpe.merge_long(word, ranks) == own._encode_single_piece(word)


SF = "/root/testdata/sf0.001"


def registered(spark, name):
    from procmetrics.llm.entry import QUERIES

    return QUERIES[name](spark, SF).toPandas()


def test_registered_queries_against_brute_force(spark, docs):
    """The queries as registered: whole tables, production parameters, against the libraries and plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts)
    got = registered(spark, "op1_secrets").set_index("doc_id")
    assert all(got.loc[d, "base_sha256"] == hashlib.sha256(",".join(plain_secrets(t)).encode()).hexdigest() for d, t in texts.items()) and len(got) == len(texts)

    library, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = registered(spark, "op3_token_store").set_index("doc_id")
    packed = registered(spark, "op9_packing")
    sizes = packed.groupby("doc_id")["n_tokens"].sum()
    for d in order:
        own = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got.loc[d, ["start", "n_tokens", "ids_crc32", "verified"]]) == (start, len(own), zlib.crc32(own.tobytes()), True) and sizes[d] == len(own)
        for r in packed[packed["doc_id"] == d].itertuples():
            assert r.ids_crc32 == zlib.crc32(own[r.first : r.first + r.n_tokens].tobytes())
        start += len(own)

    fps = [plain_fingerprint(texts[d]) for d in order]
    roots = plain_components(fps)
    got = registered(spark, "op7_simhash").set_index("doc_id")
    assert all(tuple(got.loc[d, ["fingerprint", "component_id"]]) == (f"{fps[k]:016x}", order[roots[k]]) for k, d in enumerate(order))

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in order}
    uni, words, p = plain_language_model([texts[d] for d in order if not held[d]])
    n, v = sum(uni.values()), len(uni)
    got = registered(spark, "op8_ngram_lm").set_index("doc_id")
    for d in order:
        w, r = words(texts[d]), got.loc[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b, c)) for a, b, c in zip([0, 0, *w], [0, *w], w, strict=False)), rel_tol=1e-9)

    _, _, own = own_bpe()
    got = registered(spark, "op10_byte_bpe").set_index("doc_id")
    for d in order:
        ids = own.encode_ordinary(texts[d] or "")
        assert tuple(got.loc[d, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[d] or "").encode()).hexdigest())


def test_registered_queries_beside_their_sql(spark):
    from oracle import connect, differences

    from procmetrics.llm.entry import ORACLE, QUERIES

    con = connect(SF)
    for name, sql in ORACLE.items():
        assert differences(spark, con, name, QUERIES[name], sql, SF) is None


def test_registered_classifiers_on_held_out_rows(spark):
    from procmetrics.llm.entry import QUERIES

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas().set_index("doc_id") for t in ("documents", "labels"))
    got = QUERIES["op6_language_id"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and list(got["held_out"]) == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.index]
    mine = got[got["held_out"]]
    assert (mine["lang_pred"] == docs.loc[mine.index, "lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    got = QUERIES["op2_toxicity"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and list(got["held_out"]) == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.index]
    mine = got[got["held_out"]].join(labels["toxic"], how="inner")
    assert (mine.loc[mine["toxic"] == 0, "predicted"]).mean() < 0.03 and (mine.loc[mine["toxic"] == 1, "predicted"]).mean() > 0.5


def test_word_shards_follow_the_input(spark, docs, monkeypatch):
    from procmetrics.llm import common

    assert common.word_shards(docs) == common.word_shards(frame(spark, ODD)) == 8
    monkeypatch.setattr(common, "SHARD_BYTES", 1 << 12)
    assert common.word_shards(docs) > 30
