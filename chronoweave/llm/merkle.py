"""A Merkle manifest of a data set: an external-memory node store in Parquet, a folder for each level, made by streaming
sorted runs upwards; proofs are extracted by merging the levels' nodes with the leaves in the order of their coordinates.

A node's coordinate is (k, level, at): the key whose tree it belongs to, its
height over the leaves, and its place on that level. The children of (k, l, i)
are (k, l - 1, 2i) and, if there is one, (k, l - 1, 2i + 1).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.llm.runs import placed, sorted_runs
from chronoweave.llm.staging import few, read_table, shared_dir, stage

#: Levels that one scan adds: nodes under one node so many levels up are a block of 2 ** SPAN at most, all that a task holds.
SPAN = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
EVERY = 7
PATH = pa.list_(pa.string())


def digest(*parts: str) -> str:
    """H: the hexadecimal SHA-256 of the parts, one after the other."""
    return sha256("".join(parts).encode()).hexdigest()


def canonical(value: Column) -> Column:
    """A value as a leaf takes it: its UTF-8 length, a colon and its text; - if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[canonical(v) for v in values]), 256)


@dataclass
class Tree:
    """store: the folder of the nodes of all levels. leaves: (k, at, digest, n, ..), in sorted runs. sizes: (k, n, height), a row a key."""

    store: str
    leaves: DataFrame
    sizes: DataFrame
    height: int
    span: int

    def nodes(self, *levels: int) -> DataFrame:
        """(k, level, at, digest, n) of these levels over the leaves; levels that have none are left out."""
        schema, spark = "k string, level int, at long, digest string, n long", self.leaves.sparkSession
        if not self.height:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.store).where(F.col("level").isin(*levels)).select("k", "level", "at", "digest", "n")

    def tops(self) -> DataFrame:
        """(k, digest): the root of each key's tree, a lone leaf itself."""
        levels = self.nodes(*range(1, self.height + 1)).unionByName(self.leaves.where("n = 1").select("k", F.lit(0).alias("level"), "at", "digest", "n"))
        return levels.where((F.col("at") == 0) & (F.col("level") == height_of(F.col("n")))).select("k", "digest")


def height_of(n: Column) -> Column:
    """Levels over n leaves until one node remains."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[str]]]:
    """(k, block, n, digests) of rows in the order of k, block and at; a block is gathered over batches' borders."""
    now, nodes = None, []
    for batch in batches:
        for k, block, n, x in zip(*(batch.column(c).to_pylist() for c in ("k", "block", "n", "digest")), strict=True):
            if now != (k, block, n):
                if nodes:
                    yield *now, nodes
                now, nodes = (k, block, n), []
            nodes.append(x)
    if nodes:
        yield *now, nodes


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 1024)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def _climb(base: int, span: int):
    """Streams nodes of one level into those of the span levels over it, as far as the key's tree goes."""

    schema = pa.schema([("k", pa.string()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, block, n, nodes in _blocks(batches):
            level, first = base, block << span
            while level < base + span and (n - 1) >> level:
                nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
                level, first = level + 1, first >> 1
                for i, x in enumerate(nodes):
                    yield k, level, first + i, x, n

    return lambda batches: _packed(rows(batches), schema)


def _merged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt out by block, each block's in order."""
    return rows.repartition("k", "block").sortWithinPartitions("k", "block", *order)


def build(leaves: DataFrame, order: Sequence[str], name: str = "merkle", span: int = SPAN) -> Tree:
    """The tree of each key k over leaves (k, digest, and further columns) in the given order, in a new folder, which stays.

    Leaves become sorted runs and get their coordinates from the runs' sizes.
    Then each scan reads the topmost level written so far and streams its
    blocks into the levels over it, until all keys have one node.
    """
    spark = leaves.sparkSession
    store = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    runs = sorted_runs(leaves, ["k", *order], f"{name}-leaves")
    sizes = stage(runs.groupBy("k").agg(F.count("*").alias("n")).withColumn("height", height_of(F.col("n"))), "sizes")
    height = sizes.agg(F.max("height")).first()[0] or 0
    tree = Tree(store, placed(runs, "k", "at").join(few(sizes.select("k", "n")), "k"), sizes, height, span)
    for base in range(0, height, span):
        rows = tree.leaves if base == 0 else tree.nodes(base)
        rows = rows.where(F.col("n") > F.lit(1 << base)).select("k", F.shiftright("at", span).alias("block"), "at", "digest", "n")
        made = _merged(rows, "at").mapInArrow(_climb(base, span), "k string, level int, at long, digest string, n long")
        made.write.mode("append").option("compression", "zstd").partitionBy("level").parquet(store)
    return tree


def _flush(held: list[tuple], above: dict, upper: list[str], base: int, top: int) -> Iterator[tuple[tuple, list[str]]]:
    for row in held:
        at, n, path = row[1], row[2], []
        for level in range(base, top):
            if not (n - 1) >> level:
                break
            sibling = above.get((level, at ^ 1))
            path.append("-" if sibling is None else ("L" if at & 1 else "R") + sibling)
            at >>= 1
        yield row, path + upper


def _descend(base: int, span: int):
    """Of nodes at base with those over them in their block, and the block's path: (row, path) for each node at base, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
        now, above, upper, held = None, {}, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("k", "block", "level", "at", "n", "digest", "path")]
            more = list(zip(*(batch.column(c).to_pylist() for c in batch.schema.names[7:]), strict=True)) or [()] * batch.num_rows
            for k, block, level, at, n, x, path, rest in zip(*columns, more, strict=True):
                if now != (k, block):
                    yield from _flush(held, above, upper, base, base + span)
                    now, above, upper, held = (k, block), {}, [], []
                if path is not None:
                    upper = path
                    continue
                above[level, at] = x
                if level == base:
                    held.append((k, at, n, x, *rest))
        yield from _flush(held, above, upper, base, base + span)

    return run


def _paths_of(base: int, span: int):
    return lambda batches: _packed(((row[0], row[1], path) for row, path in _descend(base, span)(batches)), pa.schema([("k", pa.string()), ("at", pa.int64()), ("path", PATH)]))


def _scan(tree: Tree, base: int, upper: DataFrame, *more: str) -> DataFrame:
    """The rows of a merge scan: nodes at base and over it, by block, and upper (k, at, path), the paths of the blocks' own nodes."""
    blank = lambda df: df.withColumns({c: F.lit(None).cast(dict(tree.leaves.dtypes)[c]) for c in more})
    columns = ["k", "block", "level", "at", "n", "digest", "path", *more]
    none = F.lit(None).cast("array<string>")
    own = tree.leaves.withColumn("level", F.lit(0)) if base == 0 else blank(tree.nodes(base)).where(F.col("n") > F.lit(1 << base))
    nodes = own.select(*[c for c in columns if c not in ("block", "path")]).unionByName(blank(tree.nodes(*range(base + 1, base + tree.span))))
    nodes = nodes.withColumn("block", F.expr(f"shiftright(at, {base + tree.span} - level)")).withColumn("path", none).select(*columns)
    heads = blank(upper.select("k", F.col("at").alias("block"), F.lit(base + tree.span).alias("level"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "path")).select(*columns)
    return _merged(nodes.unionByName(heads), F.desc("level"), "at")


def block_paths(tree: Tree, upper: DataFrame) -> DataFrame:
    """(k, at, path): the paths of the nodes span levels over the leaves, or of a lower tree's only node, from upper (k, path), those of the keys' roots."""
    bases = list(range(0, tree.height, tree.span)) or [0]
    root = upper.join(few(tree.sizes.select("k", "n")), "k").select("k", F.lit(0).cast("long").alias("at"), "path", "n")
    paths = root.where(F.col("n") <= F.lit(1 << (bases[-1] + tree.span))).select("k", "at", "path")
    for base in reversed(bases[1:]):
        lower = root.where(F.col("n") <= F.lit(1 << base)).select("k", "at", "path")
        paths = stage(_scan(tree, base, paths.join(tree.sizes.where(F.col("n") > F.lit(1 << base)), "k", "left_semi")).mapInArrow(_paths_of(base, tree.span), "k string, at long, path array<string>").unionByName(lower), "paths")
    return paths


def fold(x: str, path: Sequence[str]) -> str:
    """The root that a digest and its path lead to."""
    for step in path:
        x = digest(x) if step == "-" else digest(step[1:], x) if step[0] == "L" else digest(x, step[1:])
    return x


def proof_digest(path: Sequence[str]) -> str:
    return digest(*[s[1:] for s in path if s != "-"])


def _verified(root: str, span: int):
    schema = pa.schema([("k", pa.string()), ("key", pa.int64()), ("leaf", pa.string()), ("changed", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (k, _, _, x, key, changed), path in _descend(0, span)(batches):
            folded = fold(x if changed is None else changed, path)
            yield k, key, x, changed, proof_digest(path), folded, folded == root

    return lambda batches: _packed(rows(batches), schema)


@dataclass
class Manifest:
    """tree: a tree for each key over its leaves. top: the tree of the keys' roots, in the order of the keys. root: its root, null without leaves."""

    tree: Tree
    top: Tree
    subroots: DataFrame
    root: str | None

    def _upper(self) -> DataFrame:
        """(k, path): the path of each key's root to the root."""
        none = F.array().cast("array<string>")
        paths = block_paths(self.top, self.top.sizes.select("k", none.alias("path")))
        out = _scan(self.top, 0, paths, "of").mapInArrow(_named(self.top.span), "k string, path array<string>")
        return stage(out, "upper")

    def proofs(self) -> DataFrame:
        """(k, at, path): each leaf's path to the root, the lowest sibling first."""
        return _scan(self.tree, 0, block_paths(self.tree, self._upper())).mapInArrow(_paths_of(0, self.tree.span), "k string, at long, path array<string>")

    def verify(self, key: str, changed: str) -> DataFrame:
        """(k, key, leaf, changed, proof_sha256, folded_root, verified), a row a leaf: its digest, or where there is one that
        in the column changed, folded along its path in the store. key: a leaf column of type long."""
        return _scan(self.tree, 0, block_paths(self.tree, self._upper()), key, changed).mapInArrow(_verified(self.root, self.tree.span), "k string, key long, leaf string, changed string, proof_sha256 string, folded_root string, verified boolean")


def _named(span: int):
    return lambda batches: _packed(((row[4], path) for row, path in _descend(0, span)(batches)), pa.schema([("k", pa.string()), ("path", PATH)]))


def manifest(leaves: DataFrame, order: Sequence[str], span: int = SPAN) -> Manifest:
    """The manifest of leaves (k, digest, further columns): a tree for each k, its leaves in the given order, and over their
    roots, in the order of k by bytes, the tree whose root names the data set. A scan adds span levels.

    Rows with all the same values are leaves each; of ties in the order the
    digest decides. An empty table has no root. A key may have any share of
    the leaves: blocks of 2 ** span leaves are dealt out, not keys.
    """
    tree = build(leaves, [*order, "digest"], span=span)
    subroots = stage(tree.tops(), "subroots")
    top = build(subroots.select(F.lit("").alias("k"), F.col("k").alias("of"), "digest"), ["of"], "merkle-top", span)
    root = top.tops().first()
    return Manifest(tree, top, subroots, root.digest if root else None)


def document_leaves(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(k, doc_id, digest, changed): k puts the null language first and the others in the order of their bytes; changed is the
    leaf of the row with one character more told, where every divides crc32 of its doc_id, if that makes a difference."""
    source = docs.select(*COLUMNS)
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    told = (F.crc32(F.col("doc_id").cast("string")) % every == 0) & F.col("n_chars").isNotNull()
    k = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    return source.select(k.alias("k"), "doc_id", leaf(*[F.col(c) for c in COLUMNS]).alias("digest"), F.when(told, leaf(*more)).alias("changed"))


def audit(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each document's leaf against the manifest of all, a
    seventh of them tampered with.

    Any column may be null, which a leaf tells from empty text; null doc_ids
    come first and are never tampered with; very long texts are hashed whole;
    of repeated doc_ids the smaller leaf comes first; an empty table gives no
    rows; other columns are ignored. The node store is a new folder, which
    stays.
    """
    m = manifest(document_leaves(docs), ["doc_id"], span)
    out = m.verify("doc_id", "changed").join(few(m.subroots.withColumnRenamed("digest", "subroot")), "k")
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(m.root).alias("root"), "proof_sha256", "folded_root", "verified")


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))
