"""A Merkle manifest of a dataset, proved by octopus multiproofs (operator 12).

Rows are leaves of one binary tree for each value of a column, and the roots of those trees are leaves of a tree on top. A partition of
leaves asks for its proofs at once: going up from all of its leaves together, it lists the siblings that it can't derive itself, fetches
each of them once, derives the nodes that its leaves share, and lays out the proof of each leaf from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procmetrics.llm.common import cut, documents, shared_dir, sql_crc32
from procmetrics.operators.transforms import small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: 2^BITS leaves are one task's group, both where nodes are made and where proofs are.
BITS = 12
#: The tree over the roots of the others, which count from 1.
TOP = 0


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of the fields, each as its length in bytes, a colon and its text; a dash if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _ranked(df: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """Rows in files in that order, nulls first, with their file and place in it. A salt comes last, so equal rows may be split."""
    salted = df.withColumn("salt", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt")
    return cut(ordered.select(*df.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), path)


def _grow(level0: DataFrame, path: str) -> None:
    """Writes all nodes above (tree, idx, size, digest) below path/up=N: size is that of the tree. Each round makes BITS levels, block by block."""

    def run(key, table):
        tree, block, level, size = key[0].as_py(), key[1].as_py(), key[2].as_py(), key[3].as_py()
        order = np.argsort(table["idx"].to_numpy(), kind="stable")
        row = [d.hex() for d in table["digest"].take(pa.array(order)).to_pylist()]
        out = []
        for up in range(1, BITS + 1):
            if (size - 1) >> (level + up - 1) == 0:  # the tree has one node by now
                break
            row = [_h("".join(row[k : k + 2])) for k in range(0, len(row), 2)]
            out += [(level + up, (block << (BITS - up)) + k, bytes.fromhex(d)) for k, d in enumerate(row)]
        levels, idx, digests = zip(*out, strict=True) if out else ((), (), ())
        n = len(out)
        return pa.table({"tree": pa.array([tree] * n, pa.int64()), "level": pa.array(levels, pa.int32()), "idx": pa.array(idx, pa.int64()), "size": pa.array([size] * n, pa.int64()), "digest": pa.array(digests, pa.binary())})

    schema = "tree long, level int, idx long, size long, digest binary"
    current, turn = level0.select("tree", F.lit(0).alias("level"), "idx", "size", "digest"), 0
    depth = max(0, (level0.agg(F.max("size")).first()[0] or 1) - 1).bit_length()
    while turn == 0 or turn * BITS < depth:
        made = current.groupBy("tree", F.shiftright("idx", BITS).alias("block"), "level", "size").applyInArrow(run, schema)
        made.write.option("compression", "none").parquet(f"{path}/up={turn}")
        turn += 1
        current = level0.sparkSession.read.schema(schema).parquet(f"{path}/up={turn - 1}").where(F.col("level") == turn * BITS).where(F.expr(f"shiftright(size - 1, {turn * BITS}) > 0"))


def _single(tree: str = "size") -> Column:
    """The level of a tree's root: how many times its nodes are halved."""
    return F.when(F.col(tree) <= 1, 0).otherwise(F.length(F.bin(F.col(tree) - 1))).cast("int")


def write_manifest(df: DataFrame, path: str, fields: Sequence[str] = FIELDS, by: str = "lang", id_col: str = "doc_id", claim: Column | None = None) -> None:
    """Writes leaves, nodes of all trees, and roots below path.

    Leaves of a value of by ascend by id (null first), those of equal ids by their hash. Two neighbouring nodes become one, the last of an
    odd count alone; the root of one leaf is the leaf. Trees are ordered by value, null first, bytewise. claim may give another leaf hash
    for a row, which is checked against the manifest in place of its own; null stands for its own. Repeated rows are leaves of their own;
    other columns are not read; texts are hashed once where they lie and never shuffled. An empty table gives a manifest without a root.
    """
    spark = df.sparkSession
    claimed = F.lit(None).cast("string") if claim is None else claim
    hashed = df.select(F.col(by).cast("string").alias("by"), F.col(id_col).alias("id"), F.unhex(leaf_hash([F.col(f) for f in fields])).alias("leaf"), F.unhex(claimed).alias("claim"))
    rows = _ranked(cut(hashed, f"{path}/hashed"), ["by", "id", "leaf"], f"{path}/ranked")
    runs = cut(rows.groupBy("by", "part").agg(F.count("*").alias("n"), F.min("place").alias("first")), f"{path}/runs")
    trees = _ranked(runs.groupBy("by").agg(F.sum("n").alias("size")), ["by"], f"{path}/values")
    files = trees.groupBy("part").agg(F.count("*").alias("n"))
    earlier = files.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # a row for each file
    trees = cut(trees.join(earlier, "part").select("by", "size", (F.col("earlier") + F.col("place") + 1).alias("tree")), f"{path}/trees")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = runs.withColumn("before", before).join(trees.withColumnRenamed("by", "of"), F.col("by").eqNullSafe(F.col("of"))).select(F.col("by").alias("of"), F.col("part").alias("of_part"), "tree", "size", (F.col("before") - F.col("first")).alias("shift"))
    numbered = rows.join(small(at), F.col("by").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    leaves = cut(numbered.select("tree", "size", (F.col("place") + F.col("shift")).alias("idx"), "id", F.col("leaf").alias("digest"), "claim", "part", "place"), f"{path}/leaves")
    _grow(leaves, f"{path}/nodes")
    roots = _nodes(spark, path).where(F.col("level") == _single()).select("tree", "digest")
    top = cut(roots.crossJoin(F.broadcast(trees.agg(F.count("*").alias("size")))).select(F.lit(TOP).cast("long").alias("tree"), (F.col("tree") - 1).alias("idx"), "size", "digest"), f"{path}/subroots")
    _grow(top, f"{path}/top")


def _nodes(spark: SparkSession, path: str, kind: str = "nodes", leaves: str = "leaves") -> DataFrame:
    """(tree, level, idx, size, digest) of all nodes, leaves included."""
    made = spark.read.schema("tree long, level int, idx long, size long, digest binary").parquet(f"{path}/{kind}").drop("up")
    return made.unionByName(spark.read.parquet(f"{path}/{leaves}").select("tree", F.lit(0).alias("level"), "idx", "size", "digest"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tree, level, idx, size, digest) of all nodes of all trees; tree TOP holds the others' roots."""
    return _nodes(spark, path).unionByName(_nodes(spark, path, "top", "subroots"))


def read_root(spark: SparkSession, path: str) -> str | None:
    """The root of all, in hexadecimal; None for an empty table."""
    row = _nodes(spark, path, "top", "subroots").where(F.col("level") == _single()).first()
    return row and row["digest"].hex()


def missing(indexes: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(level, index) of the fewest nodes of a tree of that size from which, with these leaves, the root follows and each leaf's proof."""
    out, level, at = [], 0, np.unique(indexes)
    while size > 1:
        siblings = at ^ 1
        out += [(level, int(k)) for k in siblings[(siblings < size) & ~np.isin(siblings, at, assume_unique=True)]]
        at, level, size = np.unique(at >> 1), level + 1, (size + 1) >> 1
    return out


class Branches:
    """What a partition knows of one tree: its leaves and the fetched nodes, the nodes derived from them, and the proofs."""

    def __init__(self, size: int, known: dict[tuple[int, int], str], leaves: np.ndarray):
        self.known = known
        self.sizes = [size]
        at, level = np.unique(leaves), 0
        while self.sizes[-1] > 1:
            at = np.unique(at >> 1)
            for k in at.tolist():
                if (level + 1, k) not in known:
                    pair = [(level, c) for c in (2 * k, 2 * k + 1) if c < self.sizes[-1]]
                    if lost := [c for c in pair if c not in known]:
                        raise ValueError(f"node {lost[0][1]} of level {lost[0][0]} is lost")
                    known[level + 1, k] = _h("".join(known[c] for c in pair))
            self.sizes.append((self.sizes[-1] + 1) >> 1)
            level += 1
        self.root = known[level, 0]
        self._above: dict[tuple[int, int], list[tuple[str, bool]]] = {(level, 0): []}

    def proof(self, level: int, k: int) -> list[tuple[str, bool]]:
        """(sibling, whether it stands left) from the node up; an empty sibling where there is none. What lies above is shared."""
        found = self._above.get((level, k))
        if found is None:
            sibling = self.known[level, k ^ 1] if k ^ 1 < self.sizes[level] else ""
            found = [(sibling, bool(k & 1)), *self.proof(level + 1, k >> 1)]
            if level:
                self._above[level, k] = found
        return found


def fold(leaf: str, proof: Sequence[tuple[str, bool]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for sibling, left in proof:
        leaf = _h(sibling + leaf if left else leaf + sibling)
    return leaf


def prove(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof, sides, folded_root, verified) of every leaf of the manifest, or of those wanted (a condition on id).

    proof are the siblings from leaf to root, as one text of hexadecimal digests; sides says of each level whether the sibling stands left
    (L), right (R) or is none (-). folded_root follows from the claimed leaf (its own, if none was claimed) and these siblings alone.
    Proofs are made for 2^BITS leaves of a file at a time. Repeated rows have proofs of their own; an empty manifest gives none. A node
    that isn't there raises an error.
    """
    root = read_root(spark, path)
    leaves = spark.read.parquet(f"{path}/leaves").withColumn("chunk", F.shiftright("place", BITS))
    leaves = leaves if wanted is None else leaves.where(wanted)
    trees = spark.read.parquet(f"{path}/subroots").count() if root else 0

    def ask(key, table):
        tree, size, idx = (table[c].to_numpy() for c in ("tree", "size", "idx"))
        need = [(TOP, *c) for c in missing(np.unique(tree) - 1, trees)]
        for t in np.unique(tree):
            need += [(int(t), *c) for c in missing(idx[tree == t], int(size[tree == t][0]))]
        of, level, at = zip(*need, strict=True) if need else ((), (), ())
        n = len(need)
        return pa.table({"part": pa.array([key[0].as_py()] * n, pa.int32()), "chunk": pa.array([key[1].as_py()] * n, pa.int64()), "tree": pa.array(of, pa.int64()), "level": pa.array(level, pa.int32()), "idx": pa.array(at, pa.int64())})

    groups = leaves.select("part", "chunk", "tree", "size", "idx").groupBy("part", "chunk")
    asked = cut(groups.applyInArrow(ask, "part int, chunk long, tree long, level int, idx long"), f"{shared_dir(spark, 'proofs')}/asked")
    answers = read_nodes(spark, path).select("tree", "level", "idx", "digest").join(small(asked), ["tree", "level", "idx"])

    def expand(key, table, fetched):
        known: dict[int, dict[tuple[int, int], str]] = {}
        for t, level, k, digest in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "idx", "digest")), strict=True):
            known.setdefault(t, {})[level, k] = digest.hex()
        tree, size, idx = (table[c].to_numpy() for c in ("tree", "size", "idx"))
        own, claims = [d.hex() for d in table["digest"].to_pylist()], [d and d.hex() for d in table["claim"].to_pylist()]
        branches: dict[int, Branches] = {}
        for t in np.unique(tree).tolist():
            mine, nodes = np.flatnonzero(tree == t), known.setdefault(t, {})
            nodes.update({(0, int(idx[k])): own[k] for k in mine})
            branches[t] = Branches(int(size[mine[0]]), nodes, idx[mine])
        above = known.setdefault(TOP, {})
        above.update({(0, t - 1): b.root for t, b in branches.items()})
        over = Branches(trees, above, np.array([t - 1 for t in branches], np.int64))
        proofs = [[*branches[t].proof(0, k), *over.proof(0, t - 1)] for t, k in zip(tree.tolist(), idx.tolist(), strict=True)]
        folded = [fold(c or o, p) for o, c, p in zip(own, claims, proofs, strict=True)]
        n = len(own)
        return pa.table(
            {
                "id": table["id"], "leaf": own, "subroot": [branches[t].root for t in tree.tolist()], "root": [root] * n, "proof": ["".join(s for s, _ in p) for p in proofs],
                "sides": ["".join("-" if not s else "L" if left else "R" for s, left in p) for p in proofs], "folded_root": folded, "verified": [f == root for f in folded],
            }
        )

    kind = leaves.schema["id"].dataType.simpleString()
    rows = leaves.select("part", "chunk", "tree", "size", "idx", "id", "digest", "claim").groupBy("part", "chunk")
    return rows.cogroup(answers.groupBy("part", "chunk")).applyInArrow(expand, f"id {kind}, leaf string, subroot string, root string, proof string, sides string, folded_root string, verified boolean")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and the proof of each against it, some of them tampered with."""
    path = shared_dir(spark, "manifest")
    fields = [F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_hash(fields))
    write_manifest(documents(spark, sf_dir), path, claim=tampered)
    return prove(spark, path).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _sql_leaf(n_chars: str) -> str:
    columns = [n_chars if f == "n_chars" else f for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


def _sql_tree(name: str, leaves: str, by: str = "") -> str:
    return f"{name} AS ({leaves} UNION ALL SELECT {by}lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY {by}lv, i // 2, n)"


def _sql_climb(name: str, start: str, tree: str, same: str) -> str:
    """From each leaf up: the siblings so far, and what follows from them."""
    return f"""{name} AS ({start} UNION ALL SELECT p.k, p.lang, p.lv + 1, p.i // 2, (p.n + 1) // 2, p.proof || coalesce(s.h, ''), sha256(CASE WHEN p.i % 2 = 1 THEN s.h || p.f ELSE p.f || coalesce(s.h, '') END)
    FROM {name} p LEFT JOIN {tree} s ON {same} AND s.lv = p.lv AND s.i = xor(p.i, 1) WHERE p.n > 1)"""


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, CASE WHEN {sql_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_sql_leaf("n_chars + 1")} END AS claim FROM documents),
l AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_sql_tree("nodes", "SELECT lang, 0 AS lv, i, n, leaf AS h FROM l", "lang, ")},
roots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_sql_tree("top", "SELECT 0 AS lv, i, n, h FROM roots")},
{_sql_climb("paths", "SELECT k, lang, 0 AS lv, i, n, '' AS proof, coalesce(claim, leaf) AS f FROM l", "nodes", "s.lang IS NOT DISTINCT FROM p.lang")},
{_sql_climb("tops", "SELECT p.k, p.lang, 0 AS lv, r.i, r.n, p.proof, p.f FROM paths p JOIN roots r ON r.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1", "top", "true")}
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified
FROM l JOIN (SELECT * FROM tops WHERE n = 1) c USING (k) JOIN roots r ON r.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""
