"""Document fingerprints: byte windows ranked by how rare their entropy is in the corpus, the locally rarest put into chained
Bloom filters, which are compared by their overlap beyond chance."""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronoweave.llm.staging import read_table, stage
from chronoweave.llm.textops import U, mix, powers

#: Bytes of a feature; features in a row of which the rarest is favoured; how often a feature must be favoured to be selected.
WIDTH, REACH, FAVOURED = 64, 64, 16
#: Bits of a filter, bits that a feature sets, features after which the next filter of the chain begins.
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Steps of entropy from none to the most; windows under step WEAK are chosen only where there is no other.
STEPS, WEAK = 1000, 100
#: Bytes worked on at once, so that the arrays of counts stay in a core's cache; texts of more are worked on alone.
BLOCK = 1 << 18
#: Ranges of ids that a shuffle partition gets on average.
RANGES = 4

_SHIFT = (BITS - 1).bit_length()
_TOTAL = np.round(10_000 * np.concatenate([[0.0], np.arange(1, WIDTH + 1) * np.log2(np.arange(1, WIDTH + 1))])).astype(np.int64)
_GAIN = np.concatenate([[0], np.diff(_TOTAL)])


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """The step of the entropy of each window of WIDTH bytes.

    The sum of c * log2 c over a window's byte counts c changes by what the
    byte that leaves and the one that enters take away and add, each of which
    follows from how often it stands in the window before and in the next.
    """
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ahead, behind = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, WIDTH):
        same = (data[:-d] == data[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    entered, left = np.cumsum(_GAIN[behind]), np.cumsum(_GAIN[ahead])
    total = entered[WIDTH - 1 :].copy()
    total[1:] -= left[: n - 1]
    return (_TOTAL[-1] - total) * STEPS // (_TOTAL[-1] + 1)


def _blocks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of BLOCK bytes or one text."""
    begin, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > BLOCK:
            yield begin, i
            begin, size = i, 0
        size += len(x)
    if begin < len(texts):
        yield begin, len(texts)


def _joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _inside(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places begin a stretch of width bytes within one text."""
    begins = offsets[:-1]
    ends = np.maximum(begins, offsets[1:] - width + 1)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.minimum(begins, n), 1)
    np.add.at(delta, np.minimum(ends, n), -1)
    return np.cumsum(delta)[:n] > 0


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of keys, from minima up to and from the edges of blocks of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.int64).max)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).reshape(-1)
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def _selected(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of the features that are selected, in order; texts of under WIDTH bytes have one, all of them."""
    sizes = np.diff(offsets)
    places, owners = [], []
    steps = entropy_steps(data)
    if len(steps):
        mask = (1 << len(steps).bit_length()) - 1
        keys = ranks[steps] * (mask + 1) + np.arange(len(steps))
        if len(keys) >= REACH:
            wins = _lowest(keys, REACH)
            wins = np.bincount(wins[_inside(offsets, WIDTH + REACH - 1, len(wins))] & mask, minlength=len(keys))
            at = np.flatnonzero(wins)
            doc = np.searchsorted(offsets, at, "right") - 1
            kept = wins[at] >= np.minimum(FAVOURED, sizes[doc] - WIDTH - REACH + 2)
            places.append(at[kept]), owners.append(doc[kept])
    bare = sizes > 0
    if owners:
        bare[owners[0]] = False
    for d in np.flatnonzero(bare):
        m = max(1, int(sizes[d]) - WIDTH + 1)
        places.append(offsets[d : d + 1] + (int(keys[offsets[d] : offsets[d] + m].argmin()) if sizes[d] >= WIDTH else 0)), owners.append(np.array([d]))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place, owner = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(place, kind="stable")
    return place[order], owner[order]


def _hashes(data: np.ndarray, place: np.ndarray, width: np.ndarray) -> np.ndarray:
    power = powers(WIDTH)[0][:WIDTH]
    inside = np.arange(WIDTH) < width[:, None]
    own = data[np.where(inside, place[:, None] + np.arange(WIDTH), 0)].astype(U) + U(1)
    return mix((np.where(inside, own, U(0)) * power).sum(1) + width.astype(U))


def _filters(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[bytes]:
    n = len(offsets) - 1
    place, owner = _selected(data, offsets, ranks)
    if not len(place):
        return [b""] * n
    code = _hashes(data, place, np.minimum(WIDTH, np.diff(offsets)[owner]))
    # of equal features of a text the first stays
    order = np.lexsort((place, code, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (code[order][1:] != code[order][:-1])
    keep = np.sort(order[first])
    owner, code = owner[keep], code[keep]
    count = np.bincount(owner, minlength=n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    chained = -(-count // PER_FILTER)
    base = np.cumsum(chained) - chained
    spot = (base[owner] + nth // PER_FILTER) << _SHIFT
    bits = np.zeros(int(chained.sum()) << _SHIFT, bool)
    for j in range(HASHES):
        bits[spot + ((code >> U(j * _SHIFT)) & U(BITS - 1)).astype(np.int64)] = True
    packed, size = np.packbits(bits).tobytes(), BITS // 8
    return [packed[b * size : (b + c) * size] for b, c in zip(base.tolist(), chained.tolist(), strict=True)]


def filters(texts: Sequence[bytes], ranks: np.ndarray) -> list[bytes]:
    """The chain of filters of each text, one after the other; none for an empty text."""
    out: list[bytes] = []
    for i, j in _blocks(texts):
        out += _filters(*_joined(texts[i:j]), ranks)
    return out


def likeness(a: bytes, b: bytes) -> float:
    """From 0 to 1: for each filter of the shorter chain the most that it overlaps one of the other beyond what chance gives,
    as a share of the most possible, averaged by bits. Equal chains: 1; an empty one and another: 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(v, np.uint64).reshape(-1, BITS // 64) for v in (a, b))
    n, m = (np.bitwise_count(v).sum(1).astype(np.int64) for v in (x, y))
    if (len(x), n.sum(), a) > (len(y), m.sum(), b):
        x, y, n, m = y, x, m, n
    total = 0.0
    for own, k in zip(x, n.tolist(), strict=True):
        common = np.bitwise_count(own & y).sum(1)
        chance, most = k * m / BITS, np.minimum(k, m)
        room = most - chance
        total += k * float(np.where(room > 0, (common - chance) / np.where(room > 0, room, 1), common == most).clip(0, 1).max())
    return total / int(n.sum())


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(STEPS, np.int64)
    for batch in batches:
        texts = _bytes_of(batch.column("text"))
        for i, j in _blocks(texts):
            data, offsets = _joined(texts[i:j])
            steps = entropy_steps(data)
            total += np.bincount(steps[_inside(offsets, WIDTH, len(steps))], minlength=STEPS)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["step", "n"])


def learn(docs: DataFrame) -> np.ndarray:
    """The rank of each step of entropy, 0 the rarest in the windows of all texts, weak steps last: STEPS numbers from sums that each task makes."""
    rows = docs.select("text").mapInArrow(_census, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(STEPS, np.int64)
    for r in rows:
        n[r.step] = r.n
    order = np.lexsort((np.arange(STEPS), n, np.arange(STEPS) < WEAK))
    ranks = np.empty(STEPS, np.int64)
    ranks[order] = np.arange(STEPS)
    return ranks


def _encoded(x: bytes) -> str:
    return b64encode(x).decode()


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """docs with fingerprint (text), under the ranks that learn gave, by default for docs themselves.

    Null and empty texts have an empty fingerprint, shorter ones than a window
    are one feature; very long texts get as many filters as their features
    need; of ties in rank the leftmost window counts; rows with equal texts
    have equal fingerprints; an empty table gives no rows; a column
    fingerprint of docs is replaced.
    """
    from pyspark.sql import types as T

    known = docs.sparkSession.sparkContext.broadcast(learn(docs) if ranks is None else ranks)
    df = docs.drop("fingerprint").withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([_encoded(x) for x in filters(_bytes_of(batch.column("text")), known.value)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "fingerprint"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("fingerprint", T.StringType())]))


def compare(pairs: DataFrame, a: str, b: str, to: str = "likeness") -> DataFrame:
    """pairs with the likeness of the fingerprints in two columns; null counts as empty."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(c).fill_null("").to_pylist() for c in (a, b)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([likeness(b64decode(x), b64decode(y)) for x, y in both], pa.float64())], names=[*batch.schema.names, to])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField(to, T.DoubleType())]))


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as much of the beginning of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edits(known):
    """Of texts in order, those of a range followed by the first of the next (head), each with its edit and its neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, last = known.value, None  # last: (bucket, doc_id, text, filters), whose neighbour is still to come
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "doc_id")]
            whole = batch.column("text").fill_null("").to_pylist()
            coded = [x.encode() for x in whole]
            for i, j in _blocks(coded):
                rows = [*([last] if last else []), *zip(*(c[i:j] for c in columns), whole[i:j], filters(coded[i:j], ranks), strict=True)]
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0]]
                last = rows[-1]
                if not pairs:
                    continue
                texts = [edited(x[2], y[2]).encode() for x, y in pairs]
                marks = filters(texts, ranks)
                made = [(x[1], len(x[2]), sha256(t).hexdigest(), _encoded(x[3]), _encoded(e), likeness(x[3], e), likeness(x[3], y[3])) for (x, y), t, e in zip(pairs, texts, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), OUT.types, strict=True)], schema=OUT)

    return run


def _bucket(bounds: list, value):
    """How many bounds are not above value, by halving; 0 for null."""
    have = F.array(*[F.lit(b) for b in bounds])
    steps = [F.lit(1 << i) for i in reversed(range(max(1, len(bounds).bit_length())))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when(F.get(have, at + step - 1) <= value, at + step).otherwise(at)) if bounds else F.lit(0)


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs:
    what its fingerprint tells of an edit that gives the document the beginning of the next one for its last half.

    doc_id is an integer. Texts are dealt out once, by ranges of doc_id, each
    range with the first text of the next one, so that a task reads its texts
    in order. Null doc_ids come first; of equal ones the hash of the text
    decides, and repeated rows follow each other; a single row follows itself.
    Null text counts as empty; see fingerprints for empty, short and very long
    texts. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = own.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)])).first()[0] or []
    rows = own.withColumn("bucket", _bucket(sorted(set(bounds)), F.col("doc_id"))).withColumn("tie", F.xxhash64("text"))
    first = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    # one row a range: which range's last text is followed by this first one
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    first = stage(first.withColumn("before", before), "first")
    head = rows.join(F.broadcast(first), "bucket").where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")))
    head = head.dropDuplicates(["bucket"]).select("doc_id", "text", F.col("before").alias("bucket"), "tie", F.lit(1).alias("head"))
    ranks = spark.sparkContext.broadcast(learn(own))
    both = rows.withColumn("head", F.lit(0)).unionByName(head).repartition("bucket").sortWithinPartitions("bucket", "head", "doc_id", "tie")
    return both.select("bucket", "doc_id", "text").mapInArrow(_edits(ranks), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op13(spark, sf_dir: str) -> DataFrame:
    return edits(read_table(spark, sf_dir, "documents"))
