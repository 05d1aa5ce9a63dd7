"""Token-ID output to a content-addressed store (operator 3)."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.llm.common import cut, documents, offsets_of, shared_dir, split_words, text_slices

#: Of the cache of encoded words in each worker: two generations of so many words at most.
CACHE_WORDS = 200_000
#: New words that the library encodes at once.
LEARN_WORDS = 16384
#: Chunk edges: a cut after an id whose rolling hash over the last WINDOW ids has its low MASK_BITS bits zero; lengths between MIN and MAX.
WINDOW, MASK_BITS, MIN_CHUNK, MAX_CHUNK = 16, 10, 256, 8192
#: A node of the tree over the documents has 2^FAN_BITS children at most.
FAN_BITS = 12


def _byte_alphabet() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_ALPHABET = _byte_alphabet()


class WordEncoder:
    """Encodes with a tokenizers file whose model sees one piece at a time, remembering the pieces it has seen.

    The normaliser (NFC, white space to one space, lower case) and the splitting pattern are those of word_bpe_49k.json. Texts with
    only characters up to U+017F take a plain pattern for the same pieces; other texts go through the library whole.
    """

    _PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ſ0-9²³¹¼-¾]+")
    _WIDE = re.compile(r"[^\x00-įı-ſ]")
    _ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|startoftext|>", "<|endoftext|>")  # other white space here than there; special tokens

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        """Ids of one word between white space, piece by piece. Pieces that are themselves known words aren't encoded again."""
        found = b""
        for piece in self._PLAIN.findall(word):
            known = self.young.get(piece) if piece != word else None
            if known is None:  # the model is asked in its byte alphabet
                written = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTE_ALPHABET)
                known = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
                if len(piece) > 1:
                    self.young[piece] = known
            found += known
        return found

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word, all of them different. New words of plain letters go to the library in texts of LEARN_WORDS, as it takes some hundred bytes for each byte of a text; each ends with an id that ends words."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out: list = [young.get(word) or old.get(word) for word in words]
        fresh = []
        for k, (word, known) in enumerate(zip(words, out, strict=True)):
            if known is None:
                if word.isascii() and word.isalpha():
                    fresh.append(k)
                    continue
                known = out[k] = self._ids(word)
            young[word] = known
        for lo in range(0, len(fresh), LEARN_WORDS):
            some = fresh[lo : lo + LEARN_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[k] for k in some])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't end each word with an id of its own")
            raw, begin = ids.tobytes(), 0
            for k, end in zip(some, (4 * ends).tolist(), strict=True):
                young[words[k]] = out[k] = raw[begin:end]
                begin = end
        return out

    def _is_plain(self, text: str) -> bool:
        if any(c in text for c in self._ODD):
            return False
        return text.isascii() or not self._WIDE.search(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Distinct words are encoded once a call at most; texts are then put together by array look-ups."""
        out: list = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if self._is_plain(text):
                plain.append((k, (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()))
            else:
                out[k] = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if plain:
            words, counts = split_words(pa.array([low for _, low in plain], pa.string()))
            coded = words.dictionary_encode()
            known = self._learn(coded.dictionary.to_pylist())
            sizes = np.array(list(map(len, known)), np.int64) // 4
            table = np.frombuffer(b"".join(known), np.uint32)
            codes = coded.indices.to_numpy()
            each = sizes[codes]
            ends = offsets_of(each)
            ids = table[np.arange(ends[-1]) + np.repeat(offsets_of(sizes)[codes] - ends[:-1], each)]
            edge = ends[offsets_of(counts)]
            for n, (k, _) in enumerate(plain):
                out[k] = ids[edge[n] : edge[n + 1]]
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker: its tasks needn't read the file again, and go on with the words that earlier ones have met."""
    return WordEncoder(path)


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of an id stream, chosen by content: an insertion moves only the edges near it.

    The rolling hash is a windowed sum of mixed ids, taken from a running sum; so it costs a few vector operations. Runs longer than
    MAX_CHUNK are cut at that length.
    """
    if len(ids) <= MIN_CHUNK:
        return np.array([len(ids)])
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.cumsum(mixed * np.uint64(0xBF58476D1CE4E5B9))
    window = total.copy()
    window[WINDOW:] -= total[:-WINDOW]
    edges = np.flatnonzero((window >> np.uint64(64 - MASK_BITS)) == 0) + 1
    out, last = [], 0
    for edge in edges.tolist():
        if edge - last >= MIN_CHUNK:
            while edge - last > MAX_CHUNK:
                last += MAX_CHUNK
                out.append(last)
            out.append(edge)
            last = edge
    while len(ids) - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    if last < len(ids):
        out.append(len(ids))
    return np.array(out)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over the chunk addresses of a document; of none: the hash of nothing. Leaves and inner nodes hash under different tags."""
    level = [hashlib.sha256(b"\x00" + leaf).digest() for leaf in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[k : k + 2])).digest() for k in range(0, len(level), 2)]
    return level[0]


def pack(ids: np.ndarray) -> bytes:
    """A chunk's body: ids as little-endian 16-bit integers if they fit, else 32-bit, after a byte that says which; compressed."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return zstandard.ZstdCompressor(level=1).compress(bytes([2 if small else 4]) + ids.astype("<u2" if small else "<u4").tobytes())


def unpack(body: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body)
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype("<u4")


def write_store(df: DataFrame, store: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store: chunks (address, body; each once), recipes (id, n_tokens, address list) and manifests.

    Recipes lie in files by ascending id, ties by text; each has the Merkle root over its chunks, and the manifests go on from there: a tree
    over the documents of each file, and over the files. The address is the SHA-256 of the ids as 32-bit integers. Null texts count as
    empty and have only end_id. Repeated rows stay repeated. Rows of a null id come first. An empty table gives an empty store. Other
    columns are not read. One pass encodes; texts are never shuffled.
    """
    spark = df.sparkSession

    def run(batches):
        encoder = word_encoder(tokenizer)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for part in text_slices(batches, "text"):
            n_tokens, addresses, roots, bodies = [], [], [], []
            for ids in encoder.encode([t or "" for t in part.column("text").to_pylist()]):
                ids = np.concatenate([ids, tail]).astype("<u4")
                ends = cut_points(ids).tolist() if len(ids) else []
                chunks = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                leaves = [hashlib.sha256(c.tobytes()).digest() for c in chunks]
                n_tokens.append(len(ids))
                addresses.append(leaves)
                roots.append(merkle_root(leaves))
                bodies.append([pack(c) for c in chunks])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n_tokens, pa.int64()), pa.array(addresses, pa.list_(pa.binary())), pa.array(roots, pa.binary()), pa.array(bodies, pa.list_(pa.binary()))],
                names=["id", "n_tokens", "addresses", "root", "bodies"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    staged = rows.mapInArrow(run, f"id {kind}, n_tokens long, addresses array<binary>, root binary, bodies array<binary>")
    staged.write.option("compression", "none").parquet(f"{store}/staged")
    staged = spark.read.schema(staged.schema).parquet(f"{store}/staged")
    chunks = staged.select(F.explode(F.arrays_zip("addresses", "bodies")).alias("c")).select(F.col("c.addresses").alias("address"), F.col("c.bodies").alias("body"))
    chunks.groupBy("address").agg(F.first("body").alias("body")).write.option("compression", "none").parquet(f"{store}/chunks")
    ordered = staged.select("id", "n_tokens", "addresses", "root").repartitionByRange("id", "root").sortWithinPartitions("id", "root")
    ordered = ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    ordered.write.option("compression", "zstd").parquet(f"{store}/recipes")
    leaves = cut(_leaves(read_recipes(spark, store)), f"{store}/leaves")
    _upper(leaves).write.option("compression", "zstd").parquet(f"{store}/manifests")


def read_recipes(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/recipes")


def _node(order: str):
    """The hash of a node of the manifests' tree: of its children's hashes in order, under a tag of their own."""
    children = F.transform(F.array_sort(F.collect_list(F.struct(order, "root"))), lambda r: F.hex(r["root"]))
    return F.unhex(F.sha2(F.unhex(F.concat(F.lit("02"), F.array_join(children, ""))), 256)).alias("root")


def _leaves(recipes: DataFrame) -> DataFrame:
    """(part, leaf, n_tokens, documents, root): FAN documents at most, in order, of each file of recipes."""
    leaf = F.shiftright(F.col("place").bitwiseAND((1 << 33) - 1), FAN_BITS).alias("leaf")
    return recipes.groupBy("part", leaf).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("documents"), _node("place"))


def _upper(leaves: DataFrame) -> DataFrame:
    """(level, part, n_tokens, documents, root) above the leaves: a node for each FAN leaves of a file, one for each file, and one for the store.

    A node has FAN children at most, but for the store's, which has one for each file of recipes; files are as many as the tasks that wrote them.
    """
    total = (F.sum("n_tokens").alias("n_tokens"), F.sum("documents").alias("documents"))
    inner = leaves.groupBy("part", F.shiftright("leaf", FAN_BITS).alias("leaf")).agg(*total, _node("leaf"))
    files = inner.groupBy("part").agg(*total, _node("leaf"))
    whole = files.groupBy().agg(*total, _node("part"))
    return files.select(F.lit("file").alias("level"), "part", "n_tokens", "documents", "root").unionByName(whole.select(F.lit("store").alias("level"), F.lit(-1).alias("part"), "n_tokens", "documents", "root"))


def _starts(spark: SparkSession, store: str) -> DataFrame:
    """Recipes with start, the ids of all documents before, and sound: that the tree over the recipes as read is the manifests'.

    Sums run within leaves, over the leaves of a file and over the files, of which each has one row.
    """
    from pyspark.sql import Window

    recipes = read_recipes(spark, store).withColumn("leaf", F.shiftright(F.col("place").bitwiseAND((1 << 33) - 1), FAN_BITS))
    leaves, manifests = spark.read.parquet(f"{store}/leaves"), spark.read.parquet(f"{store}/manifests")
    again = _leaves(recipes.drop("leaf")).select("part", "leaf", F.col("root").alias("found"))
    upper = _upper(leaves).select("level", "part", F.col("root").alias("found"))
    agreed = manifests.join(upper, ["level", "part"], "full").agg(F.coalesce(F.min(F.col("root").eqNullSafe(F.col("found"))), F.lit(True)).alias("upper_sound"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifests.where("level = 'file'").select("part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("of_files"))
    of_leaves = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("leaf")) - F.col("n_tokens")
    before = leaves.select("part", "leaf", "root", of_leaves.alias("of_leaves")).join(files, "part").join(again, ["part", "leaf"], "left")
    before = before.crossJoin(F.broadcast(agreed)).select("part", "leaf", (F.col("of_files") + F.col("of_leaves")).alias("before"), (F.col("upper_sound") & F.coalesce(F.col("root") == F.col("found"), F.lit(False))).alias("sound"))
    within = F.sum("n_tokens").over(Window.partitionBy("part", "leaf").orderBy("place")) - F.col("n_tokens")
    return recipes.withColumn("within", within).join(before, ["part", "leaf"], "left").select("id", "n_tokens", "addresses", "root", "part", "place", (F.col("before") + F.col("within")).alias("start"), F.coalesce("sound", F.lit(False)).alias("sound"))


def _zero_bytes(power: int, _made: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006
    """Four tables of 256 that carry a CRC-32 over 2^power zero bytes: its bytes are looked up and joined by exclusive or."""
    one_byte = np.arange(256, dtype=np.uint32)
    if not _made:
        low = one_byte.copy()
        for _ in range(8):
            low = np.where(low & 1, (low >> 1) ^ np.uint32(0xEDB88320), low >> 1).astype(np.uint32)
        _made.append(np.stack([low, *(one_byte << np.uint32(8 * k) for k in range(3))]))
    while len(_made) <= power:
        _made.append(np.stack([_carried(_made[-1], row) for row in _made[-1]]))
    return _made[power]


def _carried(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def crc32_joined(crc: np.ndarray, then: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of texts from those of their first parts and of the rest, which has n_bytes; for many texts at once."""
    crc = crc.astype(np.uint32)
    for power in range(int(n_bytes.max(initial=0)).bit_length()):
        mine = (n_bytes >> power & 1).astype(bool)
        crc[mine] = _carried(_zero_bytes(power), crc[mine])
    return crc ^ then.astype(np.uint32)


def read_chunks(spark: SparkSession, store: str) -> DataFrame:
    """(address, n, crc, intact) of every chunk, from its body as read; intact if the body hashes to its address."""

    def run(batches):
        for batch in batches:
            addresses = batch.column("address").to_pylist()
            raw = [unpack(b).tobytes() for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("address"), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).digest() == a for r, a in zip(raw, addresses, strict=True)])],
                names=["address", "n", "crc", "intact"],
            )

    return spark.read.parquet(f"{store}/chunks").mapInArrow(run, "address binary, n long, crc long, intact boolean")


def read_back(spark: SparkSession, store: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, verified) of every document from the files.

    Chunks are read and hashed once where they lie; documents gather only the lengths and checksums of their chunks, which combine
    exactly. verified: all chunks are intact, the Merkle root over their addresses is the recipe's, and the tree over the recipes is the
    manifests'. Repeated rows stay repeated; an empty store gives none.
    """
    recipes = _starts(spark, store)
    used = recipes.select("part", "place", F.posexplode("addresses").alias("pos", "address"))
    facts = used.join(read_chunks(spark, store), "address", "left")
    lists = facts.groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc", "intact"))).alias("chunks"))

    def run(batches):
        for batch in batches:
            lists = batch.column("chunks")
            edge = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            chunks = lists.flatten()
            n, part, intact = (pc.fill_null(chunks.field(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in ("n", "crc", "intact"))
            size, crc = np.diff(edge), np.zeros(batch.num_rows, np.uint32)
            for k in range(int(size.max(initial=0))):
                on = np.flatnonzero(size > k)
                at = edge[on] + k
                crc[on] = crc32_joined(crc[on], part[at], 4 * n[at])
            total = offsets_of(n)
            whole = offsets_of(intact)
            roots = zip(batch.column("root").to_pylist(), batch.column("addresses").to_pylist(), strict=True)
            sound = batch.column("sound").to_numpy(zero_copy_only=False)
            good = sound & np.array([merkle_root(leaves) == root for root, leaves in roots], bool) & (whole[edge[1:]] - whole[edge[:-1]] == size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), pa.array(total[edge[1:]] - total[edge[:-1]]), pa.array(crc.astype(np.int64)), pa.array(good)], names=["id", "start", "n_tokens", "ids_crc32", "verified"])

    kind = recipes.schema["id"].dataType.simpleString()
    joined = recipes.join(lists, ["part", "place"], "left").select("id", "start", "root", "addresses", "chunks", "sound")
    return joined.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """(id, start, ids array<int>): whole documents rebuilt from recipes and chunks. A chunk that is lost or changed raises an error, as do recipes that the manifests don't know."""

    def run(batches):
        for batch in batches:
            ids = []
            for chunks in batch.column("chunks").to_pylist():
                parts = [np.array([], "<u4")]
                for c in chunks:
                    if c["body"] is None:
                        raise ValueError(f"chunk {c['address'].hex()} is lost")
                    part = unpack(c["body"])
                    if hashlib.sha256(part.tobytes()).digest() != c["address"]:
                        raise ValueError(f"chunk {c['address'].hex()} has changed")
                    parts.append(part)
                ids.append(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("place"), pa.array(ids, pa.list_(pa.int32()))], names=["part", "place", "ids"])

    recipes = _starts(spark, store)
    bodies = recipes.select("part", "place", F.posexplode("addresses").alias("pos", "address")).join(spark.read.parquet(f"{store}/chunks"), "address", "left")
    lists = bodies.groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("pos", "address", "body"))).alias("chunks"))
    ids = lists.mapInArrow(run, "part int, place long, ids array<int>")
    start = F.when(F.col("sound"), F.col("start")).otherwise(F.raise_error(F.lit("the recipes are not those of the manifests")).cast("long"))
    return recipes.select("part", "place", "id", start.alias("start")).join(ids, ["part", "place"], "left").select("id", "start", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written to the store and read back."""
    import public_tokenizers

    store = f"{shared_dir(spark, 'token-store')}/store"
    write_store(documents(spark, sf_dir), store, public_tokenizers.path("word_bpe_49k.json"))
    sound = F.when(F.col("verified"), F.lit(True)).otherwise(F.raise_error(F.lit("a document of the store is not what was written")).cast("boolean"))
    return read_back(spark, store).withColumnRenamed("id", "doc_id").withColumn("verified", sound)


def whole_text_ids(path: str, texts: Iterator[str]) -> list[list[int]]:
    """The library's own encoding of whole texts, to hold the piecewise one against."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


__all__ = ["WordEncoder", "cut_points", "op3_token_store", "read_back", "read_ids", "whole_text_ids", "write_store"]
