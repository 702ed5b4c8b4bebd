"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Documents are sets of 5-word shingles; two link at a Jaccard similarity of
0.75 or more. A link implies that the prefixes (the first n - ceil(0.75 n) + 1
shingles in one order for all documents) share a shingle.

1. Documents with the same prefix and the same size form one group, so copies
   cost one group however many there are.
2. Groups that share a prefix shingle gather under the first of them: rows
   (leader, group), as many as there are prefix entries at most, never pairs.
   The order puts frequent shingles last, so that passages in many documents
   hardly reach prefixes. Frequencies come from a counting sketch of all
   shingles of fixed size; its errors change speed, never results.
3. Pairs of sets under a leader are filtered by size and by parity bitmaps,
   whose differing bits never outnumber the shingles in which two sets differ.
4. Groups expand to those of their distinct sets that are left, which are
   verified against each other on whole sets, in blocks of bounded size.
   A task gives a spanning forest of the links it finds. Under a leader of
   several blocks all sets meet its first set, the pivot, and two sets that
   both link with it need not meet: they are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from chronoweave.llm.components import components
from chronoweave.llm.staging import read_table, spare, stage
from chronoweave.llm.textops import U, mix, sub_batches, windows, words_of

SHINGLE, PERCENT = 5, 75
SKETCH_BITS, SKETCH_PARTS = 20, 16
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: A prefix shingle that the sketch counts more often is dealt to so many more tasks.
SALTED = 4096


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    w = words_of(column, lower=True)
    h = w.hashes()
    codes, at = windows(h, w.first, SHINGLE)
    bounds = np.searchsorted(at, w.first)
    out = []
    for d, n in enumerate(w.counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(codes[bounds[d] : bounds[d + 1]]))
        elif n:
            x = np.array([n], U)
            for v in h[w.first[d] : w.first[d + 1]]:
                x = mix(x * U(31) + v)
            out.append(x)
        else:
            out.append(np.empty(0, U))
    return out


def _cell(codes: np.ndarray) -> np.ndarray:
    return (codes >> U(64 - SKETCH_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in sub_batches(batches):
        sets = shingle_sets(batch.column("text"))
        if sets:
            total += np.bincount(_cell(np.concatenate(sets)), minlength=len(total))
    if total.any():
        parts = [x.astype("<i8").tobytes() for x in np.split(total, SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """By sketch cell, a quarter-octave level (uint8) of how often its shingles occur in all documents: 1 MB, whatever the input."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_count, "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary").collect()
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        size = len(total) // SKETCH_PARTS
        total[r.part * size : (r.part + 1) * size] = np.frombuffer(r.counts, "<i8")
    return np.minimum(255, 4 * np.log2(total + 1)).astype(np.uint8)


def _prefix(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A set's prefix, the levels of its shingles, and the key of its group."""
    n = len(x)
    level = table[_cell(x)]
    take = np.argsort(level, kind="stable")[: n - -(-PERCENT * n // 100) + 1]
    return x[take], level[take], int.from_bytes(xxhash.xxh3_64_digest(x[take].tobytes() + n.to_bytes(8, "little")), "big", signed=True)


def _signer(levels):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in sub_batches(batches):
            found = shingle_sets(batch.column("text"))
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]
            groups = [_prefix(x, table)[2] if len(x) else None for x in found]
            bits = [parity(x) if len(x) else None for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array([len(x) for x in found], pa.int64()), pa.array(keys, pa.binary()), pa.array(groups, pa.int64()), pa.array(bits, pa.binary())],
                names=["doc_id", "version", "n", "s", "g", "bits"],
            )

    return sign


def _prefixer(levels):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        hot_from = int(np.median(table)) + 6
        seen: set[int] = set()
        for batch in sub_batches(batches):
            sizes, groups, rare, hot, salts = [], [], [], [], []
            for x in shingle_sets(batch.column("text")):
                if not len(x):
                    continue
                prefix, level, group = _prefix(x, table)
                if group in seen:
                    continue
                if len(seen) < 200_000:  # only saves rows; what is sent twice meets in its group again
                    seen.add(group)
                often = level >= hot_from
                sizes.append(len(x)), groups.append(group)
                rare.append(prefix[~often].view(np.int64))
                hot.append(prefix[often].view(np.int64))
                salts.append(np.ceil(2.0 ** (level[often] / 4) / SALTED).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(groups, pa.int64()), _lists(rare), _lists(hot), _lists(salts)], names=["n", "g", "rare", "hot", "salts"])

    return cut


def parity(codes: np.ndarray) -> bytes:
    """A bitmap of about as many bits as shingles: whether a shingle hash's low bits occur an odd number of times."""
    size = 256
    while size < len(codes) * 4 // 5 and size < 1 << 16:
        size *= 2
    return np.packbits((np.bincount((codes & U(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def may_link(sizes: list[int], bitmaps: list[bytes]) -> list[int]:
    """The sets that may link with another of the list; a set left out can't.

    A bitmap folds to half its size by XOR. Two sets that link differ in a
    seventh of their summed sizes at most, and in as many bits.
    """
    order = np.argsort(np.array(sizes), kind="stable")
    n = np.array(sizes)[order]
    words = [np.frombuffer(bitmaps[i], U) for i in order]
    ok = np.zeros(len(n), bool)
    folded: dict[int, np.ndarray] = {}
    width = np.array([len(w) for w in words])
    for i in range(len(n) - 1):
        last = int(np.searchsorted(n, n[i] * 100 // PERCENT, side="right"))
        if last <= i + 1:
            continue
        k = int(width[i])
        if k not in folded:
            folded = {k: np.stack([w.reshape(-1, k) if len(w) < k else np.bitwise_xor.reduce(w.reshape(-1, k), axis=0) for w in words[i:]])}
            base = i
        near = folded[k][i - base + 1 : last - base]
        differ = np.bitwise_count(near ^ folded[k][i - base]).sum(1, dtype=np.int64)
        hit = (100 + PERCENT) * differ <= (100 - PERCENT) * (n[i] + n[i + 1 : last])
        if hit.any():
            ok[i] = True
            ok[i + 1 : last] |= hit
    return order[ok].tolist()


def _filter(table: pa.Table) -> pa.Table:
    keep = may_link(table.column("n").to_pylist(), table.column("bits").to_pylist()) if table.num_rows > 1 else []
    return table.select(["leader", "s"]).take(pa.array(keep, pa.int64()))


def _lists(parts: list) -> pa.Array:
    offsets = np.cumsum([0, *(0 if p is None else len(p) for p in parts)]).astype(np.int32)
    values = np.concatenate([p for p in parts if p is not None] or [np.empty(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.large_binary())], names=["s", "codes"])


def links_within(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets, by whole overlaps."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(flat)]]))
    overlap = np.zeros((m, m), np.float32)
    for c in range(2, 17):
        at = starts[counts == c]
        if len(at):
            own = owner[at[:, None] + np.arange(c)]
            for i in range(c):
                for j in range(i + 1, c):
                    overlap += np.bincount(own[:, i] * m + own[:, j], minlength=m * m).reshape(m, m) if m <= 64 else _sparse(own[:, i], own[:, j], m)
    many = np.flatnonzero(counts > 16)
    for begin in range(0, len(many), 4096):
        part = many[begin : begin + 4096]
        x = np.zeros((m, len(part)), np.float32)
        for k, p in enumerate(part):
            x[owner[starts[p] : starts[p] + counts[p]], k] = 1
        overlap += np.triu(x @ x.T, 1)
    overlap = overlap + overlap.T
    linked = (100 + PERCENT) * np.rint(overlap).astype(np.int64) >= PERCENT * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    out, fresh = [], np.ones(m, bool)
    for root in range(m):
        if fresh[root]:
            fresh[root], todo = False, [root]
            while todo:
                a = todo.pop()
                near = np.flatnonzero(linked[a] & fresh)
                fresh[near] = False
                out += [(a, int(b)) for b in near]
                todo += near.tolist()
    return out


def _sparse(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((m, m), np.float32)
    np.add.at(out, (a, b), 1)
    return out


def _verify(table: pa.Table) -> pa.Table:
    keys = table.column("s").to_pylist()
    sets = [np.frombuffer(x, U) for x in table.column("codes").to_pylist()]
    found = links_within(sets) if len(sets) > 1 else []
    return pa.table({"a": pa.array([keys[a] for a, _ in found], pa.binary()), "b": pa.array([keys[b] for _, b in found], pa.binary())})


def signatures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, n, s, g, bits) of each row, written: set size, key of the set, key of its group, bitmap; and (n, g, rare, hot, salts) of
    groups, most of them once: prefix shingles, and to how many tasks the frequent ones are dealt.

    Prefixes are larger than all the rest and read once, so they are cut from the texts again and never written.
    """
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string").alias("text")
    signed = docs.select("doc_id", text, F.xxhash64("text").alias("version")).mapInArrow(_signer(levels), f"doc_id {kind}, version long, n long, s binary, g long, bits binary")
    return stage(signed, "signatures"), docs.select(text).mapInArrow(_prefixer(levels), "n long, g long, rare array<long>, hot array<long>, salts array<long>")


def leaders(prefixes: DataFrame) -> DataFrame:
    """(leader, g), some of them repeated: each group under the first group, by size and key, of each prefix shingle that it shares.

    Where sizes in a bucket leap by more than the similarity allows, no pair
    across can link, and the larger ones get a leader of their own.

    Shingles the sketch calls frequent are dealt to several tasks first, as many as their count there calls for.
    """
    # one pass over the texts for both kinds: rare shingles go to task 0
    each = F.concat(F.transform("rare", lambda t: F.struct(t.alias("t"), F.lit(0).cast("long").alias("k"))), F.arrays_zip(F.col("hot").alias("t"), F.col("salts").alias("k")))
    rows = prefixes.select(F.inline(each), "n", "g")
    rows = rows.select("t", F.when(F.col("k") == 0, 0).otherwise(F.lit(1) + F.pmod(F.xxhash64("g"), F.col("k"))).cast("int").alias("salt"), "n", "g")
    bucket = Window.partitionBy("t", "salt").orderBy("n", "g")
    upto = bucket.rowsBetween(Window.unboundedPreceding, 0)
    leap = lambda before, after: before.isNull() | after.isNull() | (after * PERCENT > before * 100)
    rows = rows.withColumn("opens", leap(F.lag("n").over(bucket), F.col("n"))).withColumn("closes", leap(F.col("n"), F.lead("n").over(bucket)))
    rows = rows.withColumn("first", F.when(F.col("salt") > 0, F.first(F.struct("n", "g")).over(upto)).otherwise(F.last(F.when(F.col("opens"), F.struct("n", "g")), ignorenulls=True).over(upto)))
    rows = rows.where("salt > 0 OR NOT (opens AND closes)").select("t", "salt", "first", "g").distinct()
    # only frequent shingles are looked at again
    often = F.col("salt") > 0
    rows = stage(rows.select(F.when(often, F.col("t")).alias("t"), F.when(often, F.col("first.n")).alias("n"), F.col("first.g").alias("leader"), "g"), "shared")
    common = rows.where("t IS NOT NULL")
    top = common.groupBy("t").agg(F.min(F.struct("n", "leader")).alias("top"))
    return rows.where("t IS NULL").select("leader", "g").unionAll(common.join(top, "t").select(F.col("top.leader").alias("leader"), "g"))


def linked_sets(docs: DataFrame, signed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(s, component) of the sets that link with another set."""
    sets = signed.where("n > 0").groupBy("g", "s").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"))
    sets = stage(sets, "sets")
    own = sets.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(F.col("g").alias("leader"), "g")
    members = leaders(prefixes).unionAll(own).distinct().join(sets.select("g", "s", "n", "bits"), "g").dropDuplicates(["leader", "s"])
    members = _sized(stage(members.select("leader", "s", "n", "bits"), "members"))
    near = stage(_with_pivots(members, "bits").mapInArrow(_near_by_bits, "leader long, s binary, pivot binary"), "near")
    pairs = _pairs_of_blocks(members, near, ["n", "bits"])
    kept = pairs.groupBy("leader", "i", "j").applyInArrow(_filter, "leader long, s binary").unionAll(near.select("leader", "s")).unionAll(near.select("leader", F.col("pivot").alias("s"))).distinct()
    kept = stage(kept.join(sets.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "s"), "kept")
    wanted = kept.select("doc_id").distinct()
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    codes = text.select("text").mapInArrow(_read_sets, "s binary, codes binary").join(kept.select("s").distinct(), "s", "left_semi").dropDuplicates(["s"])
    codes = stage(codes, "codes")
    kept = _sized(kept.select("leader", "s", "n"))
    linked = stage(_with_pivots(kept.where("blocks > 1").join(codes, "s"), "codes").mapInArrow(_linked, "leader long, s binary, pivot binary"), "linked")
    edges = _pairs_of_blocks(kept, linked).join(codes, "s").groupBy("leader", "i", "j").applyInArrow(_verify, "a binary, b binary")
    return components(edges.unionAll(linked.select(F.col("pivot").alias("a"), F.col("s").alias("b")))).withColumnRenamed("node", "s")


def _sized(members: DataFrame) -> DataFrame:
    """members of leaders that have several, with blocks: into how many blocks of bounded size the leader's fit."""
    size = members.groupBy("leader").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("k > 1")
    return members.join(size.select("leader", _n_blocks().alias("blocks")), "leader")


def _n_blocks():
    return F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")


def _with_pivots(members: DataFrame, what: str) -> DataFrame:
    """Members of leaders with several blocks, each with the leader's pivot: its first set, in the order of keys."""
    many = members.where("blocks > 1")
    pivot = many.groupBy("leader").agg(F.min_by(F.struct("s", "n", what), "s").alias("p"))
    pivot = pivot.select("leader", F.col("p.s").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col(f"p.{what}").alias("pivot_what"))
    return many.select("leader", "s", "n", F.col(what).alias("what")).join(pivot, "leader").where("s <> pivot")


def _pivotal(test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "what", "pivot_n", "pivot_what")), strict=True)
            yield batch.select(["leader", "s", "pivot"]).take(pa.array([i for i, r in enumerate(rows) if test(*r)], pa.int64()))

    return run


def _overlap_links(n: int, codes: bytes, m: int, other: bytes) -> bool:
    both = len(np.intersect1d(np.frombuffer(codes, U), np.frombuffer(other, U), assume_unique=True))
    return (100 + PERCENT) * both >= PERCENT * (n + m)


#: Of members with their pivot, those that may link with it, by bitmaps, and those that do, by whole sets.
_near_by_bits = _pivotal(lambda n, bits, m, other: len(may_link([n, m], [bits, other])) == 2)
_linked = _pivotal(_overlap_links)


def _pairs_of_blocks(members: DataFrame, near: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """(leader, s, i, j) and more columns of members gathered in tasks (i, j) so that any two of a leader meet, unless both are near its pivot.

    Members near the pivot are with it in any case, so a leader of a million
    variants of one text costs one comparison each; only the others, block j,
    meet all blocks i. A leader that fits in one block is one task.
    """
    own = ["leader", "s", *more]
    one = members.where("blocks = 1").select(*own, F.lit(0).alias("i"), F.lit(0).alias("j"))
    many = members.where("blocks > 1").select(*dict.fromkeys([*own, "n", "blocks"])).join(near.select("leader", "s", F.lit(True).alias("near")), ["leader", "s"], "left")
    far = many.where("near IS NULL").groupBy("leader").agg(F.count("*").alias("k"), F.sum("n").alias("total")).select("leader", _n_blocks().alias("apart"))
    many = many.join(far, "leader")
    place = lambda of: F.pmod(F.xxhash64("s"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    met = many.select(*own, place("blocks").alias("i"), every("apart").alias("j"))
    met = met.unionAll(many.where("near IS NULL").select(*own, every("blocks").alias("i"), place("apart").alias("j")))
    return one.unionAll(met.dropDuplicates(["leader", "s", "i", "j"]))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_shingles, component_id, label), a row for each row of docs; label keys the component.

    component_id is the least doc_id reachable by links. Rows without words
    link with nothing: their component_id is their doc_id and label is null.
    Null and empty texts have no words. Null ids are skipped by the minimum;
    repeated rows count each and link; a similarity of exactly 75 percent (a
    tie) links; very long texts are sets like others; other columns are
    ignored; an empty table gives no rows.
    """
    signed, prefixes = signatures(docs)
    rows = signed.select("doc_id", "version", "n", "s").join(linked_sets(docs, signed, prefixes), "s", "left").withColumn("label", F.coalesce("component", "s"))
    rows = stage(rows.select("doc_id", "version", F.col("n").alias("n_shingles"), "label"), "labels")
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "label", "left")
    return out.select("doc_id", "version", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "label")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least (doc_id, text hash), null ids last. Rows without words stay."""
    found = stage(classes(docs), "classes")
    pick = found.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("p"))
    pick = pick.select(F.col("p.doc_id").alias("doc_id"), F.col("p.version").alias("version")).unionAll(found.where("label IS NULL").select("doc_id", "version")).distinct()
    own = spare(docs, "version")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{own}") == F.col("k.version"))
    kept = docs.withColumn(own, F.xxhash64("text")).alias("d").join(pick.alias("k"), same, "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)


def op4(spark, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) ON x = w.doc_id
"""
