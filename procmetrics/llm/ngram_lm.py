"""Interpolated modified Kneser-Ney language model over words in the context of two words (operator 8).

Counts are made and merged by Spark; the model is sorted arrays in the shared folder that workers memory-map. Words stand for their
64-bit hash, then for a number, smaller for more frequent words; so pairs of words are exact 64-bit keys and triples are a pair and a
word. Pairs are dealt to shards by a mix of both words, so no word's or context's rows meet in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.llm.common import cut, documents, fold, offsets_of, shared_dir, split_words, text_slices, word_shards
from procmetrics.llm.hash_store import HashArrays, by_shard, edges_of, find, find_between, least, load_arrays, save_arrays, shard_of, short_counts, whole_counts

SLICE = 4 << 20
PENDING = 4_000_000  # tokens held by a task before their triples are sorted and sent on
SHARD_TOKENS = 1_500_000  # of the training texts, for each shard of pairs and triples
END = b"\n"  # no word holds white space
BEGIN = np.uint64(0xFFFFFFFF)  # stands before a text's first word, twice
LOW = np.uint64(0xFFFFFFFF)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ROW = "shard int, keys binary, v0 binary, v1 binary, v2 binary, v3 binary, v4 binary, info array<long>"
_ROW = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("keys", "v0", "v1", "v2", "v3", "v4")), ("info", pa.list_(pa.int64()))])


class HashClash(ValueError):
    """Two words share a 64-bit hash under the seed in use."""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (xor-shifts and odd factors)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes; of 64-bit ones, which must ascend, the differences."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    wide = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, wide).T)
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    wide, raw = blob[0], zstandard.ZstdDecompressor().decompress(blob[1:])
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(f"<u{wide}").ravel()
    return np.cumsum(values, dtype=np.uint64) if wide == 8 else values


def _squeeze_counts(counts: np.ndarray) -> bytes:
    top = int(counts.max()) if len(counts) else 0
    return squeeze(least(counts) if top < 1 << 32 else np.cumsum(counts, dtype=np.uint64))  # sums ascend


def _unsqueeze_counts(blob: bytes) -> np.ndarray:
    values = unsqueeze(blob)
    return np.diff(values, prepend=np.uint64(0)) if blob[0] == 8 else values.astype(np.uint64)


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.array([], np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys ascending, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _firsts(keys)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


def grouped(pairs: np.ndarray, words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples: pairs ascending, how many words follow each, those words ascending in each, and the summed counts."""
    distinct, place = np.unique(pairs, return_inverse=True)
    keys = place.astype(np.uint64) << np.uint64(32) | words.astype(np.uint64)
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
    else:
        keys, counts = summed(keys, counts)
    return distinct, np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(distinct)), (keys & LOW).astype(np.uint32), counts.astype(np.uint64)


def _rows(shard: list, columns: list[list], info: list[list] | None = None) -> pa.RecordBatch:
    """Rows of the schema that all steps share; columns that a step lacks are null."""
    blank = [[None] * len(shard)] * (6 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(pa.array(c, pa.binary()) for c in [*columns, *blank]), pa.array(info or [None] * len(shard), pa.list_(pa.int64()))], schema=_ROW)


def _keyed_rows(keys: np.ndarray, shard: np.ndarray, shards: int, *values: np.ndarray) -> pa.RecordBatch:
    """A row for each shard with its keys (ascending) and their values."""
    order, edge = by_shard(shard, shards)
    full = np.flatnonzero(np.diff(edge))
    columns = [[f(v[order[edge[k] : edge[k + 1]]]) for k in full] for f, v in [(squeeze, keys), *((_squeeze_counts, v) for v in values)]]
    return _rows(full, columns)


def _triple_rows(pairs: np.ndarray, runs: np.ndarray, words: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """A row for each shard with the triples of its pairs."""
    order, edge = by_shard(shard_of(mix(pairs), shards), shards)
    start, out, full = offsets_of(runs), [[], [], [], []], np.flatnonzero(np.diff(edge))
    for k in full:
        mine = order[edge[k] : edge[k + 1]]
        n = runs[mine]
        ends = offsets_of(n)
        at = np.arange(ends[-1]) + np.repeat(start[mine] - ends[:-1], n)
        for column, blob in zip(out, (squeeze(pairs[mine]), _squeeze_counts(n), squeeze(words[at]), _squeeze_counts(counts[at])), strict=True):
            column.append(blob)
    return _rows(full, out)


def _merge(parts, join, size) -> tuple | None:
    """Parts are merged as they come, in pairs of like size, so memory stays near the result's size."""
    stack: list[tuple] = []
    for part in parts:
        stack.append(part)
        while len(stack) > 1 and size(stack[-2]) <= 2 * size(stack[-1]):
            b, a = stack.pop(), stack.pop()
            stack.append(join(a, b))
    while len(stack) > 1:
        b, a = stack.pop(), stack.pop()
        stack.append(join(a, b))
    return stack[0] if stack else None


def _merged(table: pa.Table, values: int) -> tuple[np.ndarray, ...]:
    """Distinct keys of a shard's rows with the sums of their values."""
    parts = ((unsqueeze(r["keys"]), *(_unsqueeze_counts(r[f"v{n}"]) for n in range(values))) for batch in table.to_batches() for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist())
    return _merge(parts, lambda a, b: summed(*(np.concatenate(x) for x in zip(a, b, strict=True))), lambda p: len(p[0]))


def _merged_triples(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = (
        (unsqueeze(r["keys"]), _unsqueeze_counts(r["v0"]).astype(np.int64), unsqueeze(r["v1"]), _unsqueeze_counts(r["v2"]))
        for batch in table.to_batches() for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()
    )
    return _merge(parts, lambda a, b: grouped(*(np.concatenate(x) for x in ((np.repeat(a[0], a[1]), np.repeat(b[0], b[1])), (a[2], b[2]), (a[3], b[3])))), lambda p: len(p[2]))


def _hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _coded(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A slice's distinct words, the end last; code of each word; words of each text."""
    words, counts = split_words(part.column("text"))
    coded = words.cast(pa.binary()).dictionary_encode()
    return [*coded.dictionary.to_pylist(), END], coded.indices.to_numpy().astype(np.int64), counts


def _with_ends(codes: np.ndarray, counts: np.ndarray, end: int, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens (each text's words and its end), of the tokens two and one before each, and the first token of each text."""
    edge = offsets_of(counts + 1)
    tokens = np.full(edge[-1], end, np.int64)
    is_word = np.ones(edge[-1], bool)
    is_word[edge[1:] - 1] = False
    tokens[is_word] = codes
    one = np.concatenate([[begin], tokens[:-1]])
    one[edge[:-1]] = begin
    two = np.concatenate([[begin], one[:-1]])
    two[edge[:-1]] = begin
    return tokens, two, one, edge[:-1]


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and over 2."""
    n = np.bincount(np.minimum(counts.astype(np.int64), 5), minlength=6)
    return [*n[1:5].tolist(), int(n[3:].sum())]


def _octave(counts: np.ndarray) -> np.ndarray:
    """The binary logarithm of counts, whole."""
    return np.frexp(counts.astype(np.float64))[1] - 1


class Vocabulary:
    """Word hashes to numbers and counts. Numbers run over octaves of counts from the highest, in each over the shards; from the size on they are unknown."""

    def __init__(self, path: str, sizes: list[int], bases: np.ndarray):
        self.shards, self.bases, self.size = HashArrays(path, sizes), bases, sum(sizes)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes)
        ids, counts = np.full(len(hashes), self.size, np.uint64), np.zeros(len(hashes), np.int64)
        edge = edges_of(hashes[order], len(self.shards))
        for k in range(len(self.shards)):
            mine = order[edge[k] : edge[k + 1]]
            if len(mine) and self.shards[k]:
                at, there = find(self.shards[k]["key"], hashes[mine])
                at, mine = at[there], mine[there]
                counts[mine] = whole_counts(self.shards[k], "count", at)
                ids[mine] = self.bases[_octave(counts[mine]), k] + self.shards[k]["place"][at]
        return ids, counts


@dataclass
class Model:
    """What a worker needs to open the model: paths, shard sizes and a few numbers."""

    path: str
    seed: int
    sizes: list[int]  # words of each shard
    bases: np.ndarray
    tokens: int
    contexts: list[int]  # pairs of each shard that words follow
    pairs: list[int]  # pairs of each shard that are a context's last word and its follower
    known: list[int]  # words of each shard with figures as context or follower
    discounts: tuple  # of triples, of pairs, of words
    spare: float

    @property
    def words(self) -> int:
        return sum(self.sizes)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many things were seen 1, 2, 3 and 4 times (Chen and Goodman).

    Where one of these is zero, as in a few texts, the formula has no value and 0.5, 1 and 1.5 stand in.
    """
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05 * k), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _count_words(texts: DataFrame, path: str, shards: int, seed: int) -> tuple[list[int], np.ndarray, int]:
    """Merges the words of all texts; sizes of the shards, the numbers at which octaves begin in each, and the number of tokens."""

    def count(batches):
        for part in text_slices(batches, "text", SLICE):
            words, codes, counts = _coded(part)
            seen = np.bincount(codes, minlength=len(words)).astype(np.uint64)
            seen[-1] += np.uint64(len(counts))
            keys, other = _hashes(words, seed), _hashes(words, seed + 1)
            order = np.argsort(keys)
            yield _keyed_rows(keys[order], shard_of(keys[order], shards), shards, seen[order], other[order] >> np.uint64(32))

    def join(a, b):
        keys, counts, other = (np.concatenate(x) for x in zip(a, b, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, other = keys[order], other[order]
        first = _firsts(keys)
        if len(keys) > 1 and ((keys[1:] == keys[:-1]) & (other[1:] != other[:-1])).any():
            raise HashClash("two words share a hash")
        return keys[first], np.add.reduceat(counts[order], first), other[first]

    def merge(key, table):
        shard = key[0].as_py()
        info = [shard, 0, 0] + [0] * 64
        parts = ((unsqueeze(r["keys"]), _unsqueeze_counts(r["v0"]), _unsqueeze_counts(r["v1"])) for batch in table.to_batches() for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist())
        try:
            keys, counts, _ = _merge(parts, join, lambda p: len(p[0]))
        except HashClash:
            info[1] = -1
            return pa.Table.from_batches([_rows([shard], [], [info])])
        octave = _octave(counts)
        order = np.argsort(octave, kind="stable")
        place = np.empty(len(keys), np.uint32)
        size = np.bincount(octave, minlength=64)
        place[order] = np.arange(len(keys)) - np.repeat(offsets_of(size)[:-1], size)
        save_arrays(f"{path}/words", str(shard), {"key": keys, "place": place, **short_counts("count", counts)})
        return pa.Table.from_batches([_rows([shard], [], [[shard, len(keys), int(counts.sum()), *size.tolist()]])])

    merged = cut(texts.mapInArrow(count, ROW).groupBy("shard").applyInArrow(merge, ROW), f"{path}/word_sizes")
    rows = {r["info"][0]: r["info"][1:] for r in merged.select("info").collect()}
    if any(r[0] < 0 for r in rows.values()):
        raise HashClash("two words share a hash")
    octaves = np.array([rows[k][2:] if k in rows else [0] * 64 for k in range(shards)], np.int64).T[::-1]
    bases = offsets_of(octaves.ravel())[:-1].reshape(64, shards)[::-1].astype(np.uint64)
    return [rows[k][0] if k in rows else 0 for k in range(shards)], bases, sum(r[1] for r in rows.values())


def train(df: DataFrame, path: str, text_col: str = "text", seed: int = 42) -> Model:
    """Counts df's texts and writes the model below path. Null texts count as empty: their end alone is a token. An empty table gives a model without words.

    Four shuffles of compressed sorted keys: words; triples; pairs with how many words stand before them; words with what the pairs
    say of them. Where two words share a hash the words are counted again under the next seed.
    """
    spark = df.sparkSession
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    words_shards = word_shards(df)
    try:
        sizes, bases, tokens = _count_words(texts, path, words_shards, seed)
    except HashClash:
        return train(df, f"{path}-{seed + 2}", text_col, seed + 2)
    if sum(sizes) >= int(BEGIN):
        raise ValueError("over 2^32 distinct words: word numbers no longer fit half a key")
    shards = max(8, -(-tokens // SHARD_TOKENS))

    def count_triples(batches):
        vocabulary, held, size = Vocabulary(f"{path}/words", sizes, bases), [], 0

        def flush():
            pairs, words = (np.concatenate(x) for x in zip(*held, strict=True))
            return _triple_rows(*grouped(pairs, words), shards)

        for part in text_slices(batches, "text", SLICE):
            words, codes, counts = _coded(part)
            ids = np.concatenate([vocabulary.look_up(_hashes(words, seed))[0], [BEGIN]])
            tokens_, two, one, _ = _with_ends(codes, counts, len(words) - 1, len(words))
            held.append((ids[two] << np.uint64(32) | ids[one], ids[tokens_].astype(np.uint32)))
            size += len(tokens_)
            if size >= PENDING:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def merge_triples(key, table):
        shard = key[0].as_py()
        pairs, runs, words, counts = _merged_triples(table)
        start = offsets_of(runs)
        alone, several = runs == 1, runs > 1
        only = start[:-1][alone]
        context = np.repeat(np.arange(int(several.sum())), runs[several])
        inner = np.repeat(several, runs)
        own = counts[inner]
        times = lambda n: least(np.bincount(context[own == n], minlength=int(several.sum())))
        save_arrays(
            f"{path}/contexts",
            str(shard),
            {
                "single": pairs[alone], "single_word": words[only], **short_counts("single_count", counts[only]),
                "several": pairs[several], "start": least(offsets_of(runs[several])), "total": least(np.bincount(context, weights=own, minlength=int(several.sum())).astype(np.uint64)), "once": times(1), "twice": times(2),
                "word": words[inner], **short_counts("count", own),
            },
        )
        followed = np.repeat(pairs, runs) << np.uint64(32) | words
        found, before = np.unique(followed, return_counts=True)
        data = _keyed_rows(found, shard_of(mix(found), shards), shards, before.astype(np.uint64))
        return pa.Table.from_batches([data, _rows([-1], [], [[3, shard, len(pairs), *_of_counts(counts)]])])

    def merge_pairs(key, table):
        shard = key[0].as_py()
        if shard < 0:
            return table
        keys, before = _merged(table, 1)
        try:
            contexts = load_arrays(f"{path}/contexts", str(shard))
        except FileNotFoundError:  # no pair of this shard has followers
            contexts = {"single": keys[:0], "several": keys[:0]}
        arrays, left = {}, np.ones(len(keys), bool)
        for name in ("single", "several"):
            at, there = find(keys, contexts[name])
            arrays |= short_counts(f"{name}_before", np.where(there, before[at], 0).astype(np.uint64) if len(keys) else np.zeros(len(at), np.uint64))
            left[at[there]] = False
        save_arrays(f"{path}/pairs", str(shard), {**arrays, "other": keys[left], **short_counts("other_before", before[left])})
        first, last = keys >> np.uint64(32), keys & LOW
        zero, one = np.zeros(len(keys), np.uint64), np.ones(len(keys), np.uint64)
        said = [np.concatenate([v, zero]) for v in (before, (before == 1).astype(np.uint64), (before == 2).astype(np.uint64), (before > 2).astype(np.uint64))]
        found = summed(np.concatenate([first, last]), *said, np.concatenate([zero, one]))
        data = _keyed_rows(found[0], shard_of(mix(found[0]), words_shards), words_shards, *found[1:])
        return pa.Table.from_batches([data, _rows([-1], [], [[2, shard, len(keys), *_of_counts(before)]])])

    def merge_words(key, table):
        shard = key[0].as_py()
        if shard < 0:
            return table
        ids, total, once, twice, more, before = _merged(table, 5)
        save_arrays(f"{path}/figures", str(shard), {"key": least(ids), **{name: least(v) for name, v in zip(("total", "once", "twice", "more", "before"), (total, once, twice, more, before), strict=True)}})
        return pa.Table.from_batches([_rows([-1], [], [[1, shard, len(ids), *_of_counts(before)]])])

    rows = texts.mapInArrow(count_triples, ROW)
    for step in (merge_triples, merge_pairs, merge_words):
        rows = rows.groupBy("shard").applyInArrow(step, ROW)
    info = [r["info"] for r in cut(rows.select("info"), f"{path}/info").where("info IS NOT NULL").collect()]
    size, n = {3: [0] * shards, 2: [0] * shards, 1: [0] * words_shards}, {k: np.zeros(5, np.int64) for k in (1, 2, 3)}
    for level, shard, rows_, *counted in info:
        size[level][shard] = rows_
        n[level] += counted
    found = {k: discounts(n[k][:4].tolist()) for k in n}
    d, distinct = found[1], sum(size[2])
    spare = float(d[0] * n[1][0] + d[1] * n[1][1] + d[2] * n[1][4]) / distinct if distinct else 1.0
    return Model(path, seed, sizes, bases, tokens, size[3], size[2], size[1], (found[3], found[2], found[1]), spare)


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discount."""
    return counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary(f"{model.path}/words", model.sizes, model.bases)
        self.contexts, self.pairs, self.figures = (HashArrays(f"{model.path}/{name}", sizes) for name, sizes in (("contexts", model.contexts), ("pairs", model.pairs), ("figures", model.known)))

    def _triples(self, pairs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of each triple, total of its context, and the discounted share of that; total 0 for a context never seen. pairs ascend."""
        d = np.array(self.model.discounts[0])
        count, total, share = np.zeros(len(pairs), np.int64), np.zeros(len(pairs)), np.ones(len(pairs))
        order, edge = by_shard(shard_of(mix(pairs), len(self.contexts)), len(self.contexts))
        for k in range(len(self.contexts)):
            mine = order[edge[k] : edge[k + 1]]
            shard = self.contexts[k] if len(mine) else None
            if shard is None:
                continue
            at, there = find(shard["single"], pairs[mine])
            at, here = at[there], mine[there]
            c = whole_counts(shard, "single_count", at)
            total[here], share[here] = c, d[np.minimum(c, 3) - 1] / c
            count[here] = np.where(shard["single_word"][at] == words[here], c, 0)
            mine = mine[~there]
            at, there = find(shard["several"], pairs[mine])
            at, here = at[there], mine[there]
            low, high = shard["start"][at].astype(np.int64), shard["start"][at + 1].astype(np.int64)
            once, twice = shard["once"][at].astype(np.int64), shard["twice"][at].astype(np.int64)
            total[here] = shard["total"][at]
            share[here] = (d[0] * once + d[1] * twice + d[2] * (high - low - once - twice)) / total[here]
            place, there = find_between(shard["word"], low, high, words[here])
            count[here[there]] = whole_counts(shard, "count", place[there])
        return count, total, share

    def _before(self, pairs: np.ndarray) -> np.ndarray:
        """How many different words stand before each pair; pairs ascend."""
        out = np.zeros(len(pairs), np.int64)
        order, edge = by_shard(shard_of(mix(pairs), len(self.pairs)), len(self.pairs))
        for k in range(len(self.pairs)):
            mine = order[edge[k] : edge[k + 1]]
            shard = self.pairs[k] if len(mine) else None
            if shard is None:
                continue
            for name, keys in (("single", self.contexts[k]), ("several", self.contexts[k]), ("other", shard)):
                if keys is not None and len(mine):
                    at, there = find(keys[name], pairs[mine])
                    out[mine[there]] = whole_counts(shard, f"{name}_before", at[there])
                    mine = mine[~there]
        return out

    def _words(self, ids: np.ndarray) -> list[np.ndarray]:
        """Of each word the total, once, twice and more of the pairs that it begins, and the words before it."""
        out = [np.zeros(len(ids)) for _ in range(5)]
        order, edge = by_shard(shard_of(mix(ids), len(self.figures)), len(self.figures))
        for k in range(len(self.figures)):
            mine = order[edge[k] : edge[k + 1]]
            shard = self.figures[k] if len(mine) else None
            if shard is not None:
                mine = mine[np.argsort(ids[mine])]
                at, there = find(shard["key"], ids[mine])
                for values, name in zip(out, ("total", "once", "twice", "more", "before"), strict=True):
                    values[mine[there]] = shard[name][at[there]]
        return out

    def score(self, part: pa.RecordBatch):
        """(n_tokens, n_known, base_score, score) of each text of a slice."""
        model = self.model
        words, codes, counts = _coded(part)
        ids, seen = self.vocabulary.look_up(_hashes(words, model.seed))
        tokens, two, one, first = _with_ends(codes, counts, len(words) - 1, len(words))
        base = np.log10((seen + 1) / (model.tokens + 1 * (model.words + 1)))
        known = ids < model.words
        ids = np.concatenate([ids, [BEGIN]])
        of_triples, of_pairs, of_words = model.discounts

        total, once, twice, more, preceding = self._words(ids)
        share = np.divide(of_pairs[0] * once + of_pairs[1] * twice + of_pairs[2] * more, total, out=np.ones(len(ids)), where=total > 0)
        alone = model.spare / (model.words + 1) + _less(preceding, of_words) / max(1, sum(model.pairs))

        ends, at_end = np.unique(ids[one] << np.uint64(32) | ids[tokens], return_inverse=True)
        before = self._before(ends)[at_end]
        lower = share[one] * alone[tokens] + np.divide(_less(before, of_pairs), total[one], out=np.zeros(len(tokens)), where=total[one] > 0)

        pairs, place = np.unique(ids[two] << np.uint64(32) | ids[one], return_inverse=True)
        triples, where = np.unique(place.astype(np.uint64) << np.uint64(32) | ids[tokens], return_inverse=True)
        count, above, left = (x[where] for x in self._triples(pairs[(triples >> np.uint64(32)).astype(np.int64)], (triples & LOW).astype(np.uint32)))
        p = left * lower + np.divide(_less(count, of_triples), above, out=np.zeros(len(tokens)), where=above > 0)
        over = lambda x: np.add.reduceat(x, first) if len(first) else np.array([])
        return counts + 1, over(known[tokens].astype(np.int64)), over(base[tokens]), over(np.log10(p))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) of every row. Null texts count as empty; repeated rows stay repeated; an empty table gives none.

    A shard of the model that is gone raises an error. Other columns are not read.
    """

    def run(batches):
        scorer = Scorer(model)
        for part in text_slices(batches, "text", SLICE):
            n, known, base, own = scorer.score(part)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the documents outside fold 2 of 7, scores of all documents."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(True))
    model = train(docs.where(~held_out), shared_dir(spark, "ngram-lm"))
    out = score(docs, model).withColumn("held_out", held_out).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
