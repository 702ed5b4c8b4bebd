"""Katz backoff n-gram model: Good-Turing discounts, exactly normalised backoff weights, counts in partitioned tables.

P(w | h) = c*(h w) / c(h) if h w was seen in training, else alpha(h) P(w | h')
where h' is h without its first word, and so on down to single words:
P(w) = c*(w) / N if w was seen, else the mass that discounting set free.
c* is c less its Good-Turing discount (r - (r + 1) n[r + 1] / n[r] up to r = 5,
that of 5 above), held within LEAST and MOST so that every history keeps mass
for unseen words; alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of P(w | h')
over the same words), which makes every history's probabilities sum to 1. A
history never seen has alpha 1. Texts begin with START as often as needed.

1. Documents are read once, into chunks: rows of whole documents as word
   numbers, their ids with them, written as a table. All that follows reads
   that table, so results don't depend on the order in which docs is read.
2. For each order, from 1 up: a chunk sends its distinct n-grams, packed, to
   the bucket of their history; a bucket adds counts up (the model's table of
   that order, written) and answers each chunk with the counts of the n-grams
   it sent, and, where one of them was never seen, the sums that alpha needs.
   N-grams whose history no other chunk has, or that training never saw, stay:
   the chunk knows their counts already. Histories of great share are dealt
   to several buckets by the next word; their sums are put together again.
3. Each chunk evaluates its documents' tokens recursively.

What is shuffled is in proportion to the input: packed n-grams of chunks and
their counts, never a value for each document and bucket. The buckets' number
follows the number of tokens.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chronoweave.llm import textops
from chronoweave.llm.language import fold
from chronoweave.llm.staging import read_table, release, stage
from chronoweave.llm.textops import U, mix, words_of

#: Words of the longest n-gram. Any order works; see the README for what order 3 costs.
ORDER = 2
#: Words and histories are known by so many bits of their hash.
HASH_BITS = 56
END = U(0xE0E0E0E0E0E0E0)
CUT, LEAST, MOST = 5, 0.1, 0.95
CHUNK_BYTES = 8 << 20
BUCKET_TOKENS = 1 << 21
#: At most so many parts of histories are put together again on the driver, whatever the input.
PARTS = 1 << 16
FOLDS = 10
_STEP = U(0xD1342543DE82EF95)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, so that high bytes, mostly alike, compress well."""
    head = b"".join(struct.pack("<BI", a.itemsize | (128 if a.dtype.kind == "f" else 0), len(a)) for a in arrays)
    body = [a.tobytes() if a.itemsize == 1 else np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([bytes([len(arrays)]), head, *body]))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1 + 5 * data[0], []
    for i in range(data[0]):
        kind, n = struct.unpack_from("<BI", data, 1 + 5 * i)
        size = kind & 127
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<f{size}" if kind & 128 else f"<u{size}"))
        at += n * size
    return out


def small(x: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds it."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def discounts(n: np.ndarray) -> np.ndarray:
    """What each count r = 0 .. CUT + 1 loses, the last for all above CUT, from the numbers n[r] of n-grams seen r times."""
    out = np.zeros(CUT + 2)
    for r in range(1, CUT + 1):
        out[r] = r - (r + 1) * n[r + 1] / n[r] if n[r] else LEAST
    out[1:] = np.clip(out[1:], LEAST, MOST)
    out[CUT + 1] = out[CUT]
    return out


def less(c: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """c*, of counts."""
    return c - lost[np.minimum(c, CUT + 1)]


def _seen_times(counts: np.ndarray) -> np.ndarray:
    """The number of n-grams seen r = 0 .. CUT + 1 times, and more often."""
    return np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _by_size(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole documents of about that many bytes, across batches."""
    held, total = [], 0
    for batch in batches:
        for piece in textops.sub_batches(iter([batch])):
            held.append(piece)
            total += piece.nbytes
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token codes (words, then END, of each document) and the number of each document's."""
    codes, counts = [], []
    for piece in textops.sub_batches(iter([batch])):
        w = words_of(piece.column("text"), lower=True)
        out = np.full(int(w.counts.sum()) + piece.num_rows, END, U)
        out[np.arange(len(w.starts)) + w.doc()] = w.hashes() >> U(64 - HASH_BITS)
        codes.append(out), counts.append(w.counts + 1)
    return np.concatenate(codes), np.concatenate(counts)


def _chunk(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(_by_size(batches, size)):
            tokens, sizes = _tokens(batch)
            words, at, often = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            one = lambda x, t: pa.array([x], t)
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c))
            yield pa.RecordBatch.from_arrays(
                [one((part << 24) + i, pa.int64()), whole("doc_id"), whole("held_out"), one(len(tokens), pa.int64()), one(int(train.sum()), pa.int64()), one(int(sizes[train].sum()), pa.int64()), one(pack(words[order], small(rank[at]), small(sizes)), pa.binary())],
                names=["chunk", "ids", "held", "tokens", "train", "train_tokens", "blob"],
            )

    return run


@dataclass
class Learnt:
    """What all chunks know. total, docs: training tokens and documents. buckets: of each order. most: training tokens of a
    part of a history. free: what words never seen share. By order: lost, discounts; places, the number of distinct n-grams
    in all buckets before each; splits, the histories that have several parts, with how many n-grams each saw 1 .. CUT + 1
    times and the sum of their words' lower probabilities."""

    total: int
    docs: int
    buckets: int
    most: int
    free: float = 1.0
    lost: list[np.ndarray] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


def _sums(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=size).astype(np.float64)


class _Grams:
    """The distinct n-grams of a chunk, of one order.

    of: the n-gram at each token. hist, word, below: numbers of its history
    (that of START after all others), its last word, and the n-gram without
    its first word. own: training count in the chunk. known: training count of
    the history. Once answered, count: training count; sole: whether no other
    chunk has it; number: its place among all n-grams of the order, if it was
    sent; p: the probability of the last word after the history. Words stand
    in the order of their hashes, which is that of their numbers too.
    """

    def __init__(self, lower: _Grams | None, tokens: np.ndarray, words: np.ndarray, first: np.ndarray, train: np.ndarray, learnt: Learnt):
        self.lower, self.words, self.one = lower, words, self if lower is None else lower.one
        if lower is None:
            self.of, self.word, self.hist = tokens, np.arange(len(words), dtype=np.int32), np.zeros(len(words), np.int32)
            self.known = np.full(len(words), learnt.total)
        else:
            before = np.empty(len(tokens), np.int64)
            before[1:] = lower.of[:-1]
            before[first] = len(lower.count)
            before *= len(words)
            before += tokens
            keys, of = np.unique(before, return_inverse=True)
            del before
            self.of = of.astype(np.int32)
            self.hist, self.word = (x.astype(np.int32) for x in np.divmod(keys, len(words)))
            del keys, of
            self.below = np.empty(len(self.hist), np.int32)
            self.below[self.of] = lower.of
            self.known = np.append(lower.count, learnt.docs)[self.hist]
        self.own = np.bincount(self.of[train], minlength=len(self.hist))

    def route(self, order: int, learnt: Learnt) -> None:
        """Which n-grams are sent, and where.

        stays: n-grams of histories that no other chunk has or training never
        saw. Of the others those of which the n-gram without its first word is
        in this chunk alone can't be elsewhere either; where they are unseen or
        seen once, a bucket is told their number (ones) and whether there are
        unseen ones (wants). The others are sent, by bucket and history: the
        histories' numbers (names), first n-grams (leaders), how many of their
        n-grams are sent (lengths), whether they are dealt to several buckets
        (split); edges and runs: where each bucket begins among sent and names.
        """
        buckets = learnt.buckets
        if self.lower is None:
            self.stays, self.parts = np.zeros(len(self.words), bool), np.ones(len(self.words), np.int64)
            self.sent = np.arange(len(self.words))
            self.edges = np.searchsorted((self.words >> U(HASH_BITS - 32)) * U(buckets) >> U(32), np.arange(buckets + 1).astype(U))
            return
        self.stays = (self.known == 0) | np.append(self.lower.sole, False)[self.hist]
        self.parts = np.maximum(-(-self.known // learnt.most), 1)
        held = np.flatnonzero(~self.stays)
        name = np.append(self.lower.number, learnt.places[order - 1][-1])[self.hist[held]]
        part = mix(self.words[self.word[held]]) % self.parts[held].astype(U)
        key = (mix(name.astype(U) ^ (part * _STEP)) % U(buckets)).astype(np.int64) << 44 | name
        order = np.argsort(key, kind="stable")
        held, key = held[order], key[order]
        begins = _starts(key)
        seen = self.lower.count[self.below[held]]
        here = self.lower.sole[self.below[held]] & (seen < 2) & (self.own[held] == seen)
        add = lambda x: np.add.reduceat(x, begins, dtype=np.int64) if len(begins) else np.empty(0, np.int64)
        self.leaders, self.names = held[begins], key[begins] & (1 << 44) - 1
        self.split = self.parts[self.leaders] > 1
        self.sent, self.lengths = held[~here], add(~here)
        self.ones, self.wants = add(here & (self.own[held] > 0)), add(here & (self.own[held] == 0)) > 0
        self.runs = np.searchsorted(key[begins] >> 44, np.arange(buckets + 1))
        self.edges = np.concatenate([[0], np.cumsum(self.lengths)])[self.runs]

    def requests(self, order: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob): the n-grams' own counts and, of words, their hashes; else also their words and the lower counts of what
        they mean without the first word, and, of histories, names, lengths, ones, bits (1: split, 2: wants) and lower counts."""
        own = self.own[self.sent]
        if self.lower is None:
            for b in np.flatnonzero(np.diff(self.edges)).tolist():
                mine = slice(self.edges[b], self.edges[b + 1])
                yield b, pack(small(own[mine]), gaps(self.words[mine]))
            return
        bits = self.split.astype(np.uint8) + 2 * self.wants.astype(np.uint8)
        word = self.word[self.sent]
        if order > 2:
            under, over = np.where(own > 0, self.lower.count[self.below[self.sent]], 0), self.lower.known[self.below[self.leaders]]
        for b in np.flatnonzero(np.diff(self.runs)).tolist():
            mine, runs = slice(self.edges[b], self.edges[b + 1]), slice(self.runs[b], self.runs[b + 1])
            words, at = np.unique(word[mine], return_inverse=True)
            lower = (self.one.count[words], np.zeros(0, np.int64)) if order == 2 else (under[mine], over[runs])
            yield b, pack(small(own[mine]), small(gaps(self.one.number[words])), small(at), small(lower[0]), small(gaps(self.names[runs])), small(self.lengths[runs]), small(self.ones[runs]), bits[runs], small(lower[1]))

    def unsent(self) -> np.ndarray:
        """How many of the training n-grams that are not sent stand how often."""
        own = self.own.copy()
        own[self.sent] = 0
        return _seen_times(own)

    def answered(self, answers: dict[int, bytes], order: int, learnt: Learnt) -> None:
        self.count, self.sole, self.number = self.own.copy(), self.known > 0, np.full(len(self.own), -1)
        lost = learnt.lost[order]
        got = [(b, unpack(answers[b])) for b in sorted(answers)]
        if got:
            self.count[self.sent] = np.concatenate([x[0] for _, x in got])
            if any(len(x[1]) for _, x in got):
                self.sole[self.sent] = np.concatenate([x[1] for _, x in got]).astype(bool)
                self.number[self.sent] = np.concatenate([np.cumsum(x[2], dtype=np.int64) + learnt.places[order][b] for b, x in got])
        seen = self.count > 0
        self.p = np.where(seen, less(self.count, lost) / np.maximum(self.known, 1), learnt.free)
        if self.lower is None:
            return
        low = self.lower.p[self.below]
        asks = ~seen & (self.known > 0)
        self.p[~seen] = low[~seen]
        if asks.any():
            size = len(self.lower.count) + 1
            stay = self.stays & seen
            freed, taken = (_sums(self.hist[stay], x[stay], size) for x in (lost[np.minimum(self.count, CUT + 1)], low))
            for b, x in got:
                mine = self.hist[self.leaders[x[3].astype(np.int64) + self.runs[b]]]
                freed[mine] = sum(x[3 + r] * lost[r] for r in range(1, CUT + 2))
                taken[mine] = x[CUT + 5]
            many = np.unique(self.hist[asks & (self.parts > 1)])
            if len(many):
                names, times, sums = learnt.splits[order]
                at = np.searchsorted(names, np.append(self.lower.number, learnt.places[order - 1][-1])[many])
                freed[many], taken[many] = times[at] @ lost[1:], sums[at]
            at = self.hist[asks]
            self.p[asks] *= freed[at] / self.known[asks] / np.maximum(1 - taken[at], 1e-300)
        for name in ("stays", "parts", "leaders", "names", "split", "sent", "lengths", "ones", "wants"):
            self.__dict__.pop(name, None)


def _climb(chunk: pa.Table, answers: pa.Table | None, order: int, learnt: Learnt) -> tuple[np.ndarray, list[_Grams]]:
    """Each document's first token, and the chunk's n-grams of all orders up to that one."""
    words, tokens, sizes = unpack(chunk.column("blob")[0].as_py())
    by_hash = np.argsort(words)
    rank = np.empty(len(words), np.int32)
    rank[by_hash] = np.arange(len(words))
    words, tokens, sizes = words[by_hash], rank[tokens], sizes.astype(np.int64)
    first = np.cumsum(sizes) - sizes
    train = np.repeat(~chunk.column("held")[0].values.to_numpy(zero_copy_only=False).astype(bool), sizes)
    rows = [] if answers is None else list(zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "blob")), strict=True))
    found: list[_Grams] = []
    for k in range(1, order + 1):
        grams = _Grams(found[-1] if found else None, tokens, words, first, train, learnt)
        grams.route(k, learnt)
        found.append(grams)
        if k < len(learnt.lost):
            grams.answered({p: b for kind, p, b in rows if kind == k}, k, learnt)
    return first, found


REQUESTS = "bucket int, chunk long, blob binary, n array<long>"
ANSWERS = "chunk long, kind int, part int, blob binary, types long, n array<long>, split array<struct<name:long,n:array<long>,low:double>>"


def _ask(order: int, learnt):
    def ask(chunk: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        s: Learnt = learnt.value
        name = chunk.column("chunk")[0].as_py()
        grams = _climb(chunk, answers, order, s)[1][-1]
        rows = [*grams.requests(order), (-1 - name % s.buckets, None)]
        return pa.table({
            "bucket": pa.array([b for b, _ in rows], pa.int32()), "chunk": pa.array([name] * len(rows), pa.int64()),
            "blob": pa.array([x for _, x in rows], pa.binary()), "n": pa.array([None] * (len(rows) - 1) + [grams.unsent().tolist()], pa.list_(pa.int64())),
        })

    return ask


def _ask_first(learnt):
    ask = _ask(1, learnt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from ask(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    return run


def _joint(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of some arrays, and the places of each array's among them."""
    names, at = np.unique(np.concatenate(parts), return_inverse=True)
    return names, np.split(at.astype(np.int32), np.cumsum([len(x) for x in parts])[:-1])


def _add_up(order: int, last: bool, learnt):
    """Counts of a bucket's n-grams, answered to its chunks; a last row with the numbers of n-grams, also by count, and the split histories' sums."""

    def answer(rows: list[dict]) -> pa.Table:
        part = pa.struct([("name", pa.int64()), ("n", pa.list_(pa.int64())), ("low", pa.float64())])
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()), ("types", pa.int64()), ("n", pa.list_(pa.int64())), ("split", pa.list_(part))])
        return pa.Table.from_pylist(rows, schema=schema)

    def run(table: pa.Table) -> pa.Table:
        s: Learnt = learnt.value
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return answer([{"kind": order, "part": bucket, "types": 0, "n": np.sum(table.column("n").to_pylist(), axis=0).tolist(), "split": []}])
        chunks, parts = table.column("chunk").to_pylist(), [unpack(x) for x in table.column("blob").to_pylist()]
        words, word = _joint([np.cumsum(p[1], dtype=U) for p in parts])
        own = np.concatenate([p[0] for p in parts]).astype(np.int64)
        if order == 1:
            types, at = words, np.concatenate(word)
        else:
            names, run_at = _joint([np.cumsum(p[4], dtype=np.int64) for p in parts])
            lengths = [p[5].astype(np.int64) for p in parts]
            key = np.concatenate([np.repeat(r, n) for r, n in zip(run_at, lengths, strict=True)]).astype(np.int64) * max(1, len(words))
            key += np.concatenate([w[p[2]] for w, p in zip(word, parts, strict=True)])
            types, at = np.unique(key, return_inverse=True)
            del key
        count, many = np.bincount(at, weights=own, minlength=len(types)).astype(np.int64), np.bincount(at, minlength=len(types))
        split: list[dict] = []
        if order > 1:
            history, lost = types // max(1, len(words)), s.lost[order - 1]
            over, ones, low = np.full(len(names), s.total if order == 2 else 1), np.zeros(len(names), np.int64), np.zeros(len(types), np.int64)
            np.maximum.at(low, at, np.concatenate([p[3][p[2]] if order == 2 else p[3] for p in parts]).astype(np.int64))
            for p, r in zip(parts, run_at, strict=True):
                ones[r] += p[6]
                if order > 2:
                    over[r] = np.maximum(p[8], 1)
            times = np.stack([np.bincount(history[np.minimum(count, CUT + 1) == r], minlength=len(names)) for r in range(1, CUT + 2)])
            times[0] += ones
            sums = _sums(history, np.where(count > 0, less(low, lost), 0) / over[history], len(names)) + ones * (1 - lost[1]) / over
            several = np.unique(np.concatenate([r[p[7] & 1 > 0] for r, p in zip(run_at, parts, strict=True)]))
            split = [{"name": int(x), "n": t, "low": y} for x, t, y in zip(names[several].tolist(), times[:, several].T.tolist(), sums[several].tolist(), strict=True)]
        out, begin, none = [], 0, 0 if last else None  # the longest n-grams are no histories, so nobody asks for these two
        for i, p in enumerate(parts):
            mine = at[begin : begin + len(p[0])]
            begin += len(mine)
            c, more = count[mine], ()
            if order > 1:
                unseen = (np.bincount(np.repeat(np.arange(len(lengths[i])), lengths[i])[c == 0], minlength=len(lengths[i])) > 0) | (p[7] & 2 > 0)
                asked = np.flatnonzero(unseen & (p[7] & 1 == 0))
                more = (small(asked), *(small(x) for x in times[:, run_at[i][asked]]), sums[run_at[i][asked]])
            out.append({"chunk": chunks[i], "kind": order, "part": bucket, "blob": pack(small(c), (many[mine] == 1).view(np.uint8)[:none], small(gaps(mine.astype(np.int64)))[:none], *more)})
        out.append({"kind": order, "part": bucket, "types": len(types), "n": _seen_times(count).tolist(), "split": split})
        return answer(out)

    return run


def _evaluate(order: int, types: int, learnt):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        s: Learnt = learnt.value
        first, found = _climb(chunk, answers, order, s)
        one, last = found[0], found[-1]
        total = lambda x, g: np.add.reduceat(x[g.of], first)
        base = np.log10((one.count + 0.1) / (s.total + 0.1 * (types + 1)))
        return pa.table({
            "doc_id": chunk.column("ids")[0].values, "held_out": chunk.column("held")[0].values, "n_tokens": pa.array(np.diff(np.append(first, len(one.of)))), "n_known": pa.array(total((one.count > 0).astype(np.int64), one)),
            "train_tokens": pa.array(np.full(len(first), s.total, np.int64)), "base_score": pa.array(total(base, one)), "score": pa.array(total(np.log10(last.p), last)),
        })

    return run


def score(docs: DataFrame, held_out=None, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Learns from the rows that are not held out (by default a tenth is, by
    CRC-32 of doc_id) and scores all. order: words in the longest n-gram. A
    chunk holds chunk_bytes of text or one longer document, and a bucket the
    n-grams of bucket_tokens tokens: both bound a task's memory, and grow with
    it on large clusters, so that a chunk still sends long runs to each bucket.

    Null text is empty: its one token is the end. With nothing to learn from,
    every token has the whole mass: score 0. Null ids hash as empty; repeated
    rows count each; ties can't occur; a very long text is a chunk of its own;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = (fold("doc_id", FOLDS) == 0) if held_out is None else held_out
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held_out"))
    chunks = text.mapInArrow(_chunk(chunk_bytes), f"chunk long, ids array<{kind}>, held array<boolean>, tokens long, train long, train_tokens long, blob binary")
    chunks = stage(chunks, "chunks", "chunk")
    size = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train", "train_tokens")]).first()
    buckets = max(sc.defaultParallelism, -(-size.tokens // bucket_tokens))
    learnt = Learnt(size.train_tokens, size.train, buckets, max(bucket_tokens // 8, size.train_tokens // PARTS, 1), lost=[np.zeros(CUT + 2)], places=[None], splits=[None])
    own, answers, types = chunks.select("chunk", "ids", "held", "blob"), None, 0
    for k in range(1, order + 1):
        now = sc.broadcast(learnt)
        asked = own.mapInArrow(_ask_first(now), REQUESTS) if k == 1 else _with(own, answers).applyInArrow(_ask(k, now), REQUESTS)
        counts = stage(asked.groupBy("bucket").applyInArrow(_add_up(k, k == order, now), ANSWERS), "ngrams")
        del asked
        facts = counts.where("blob IS NULL")
        n = np.zeros(CUT + 3, np.int64)
        for r in facts.select(F.posexplode("n").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect():
            n[r.r] = r.n
        lost, sizes = discounts(n), np.zeros(buckets, np.int64)
        for r in facts.where("part >= 0").select("part", "types").collect():
            sizes[r.part] = r.types
        if k == 1:
            types = int(n[1:].sum())
            learnt.free = float((n[1 : CUT + 2] * lost[1:]).sum() + n[CUT + 2] * lost[CUT + 1]) / learnt.total if learnt.total else 1.0
        learnt = replace(learnt, lost=[*learnt.lost, lost], places=[*learnt.places, np.concatenate([[0], np.cumsum(sizes)])], splits=[*learnt.splits, _splits(facts)])
        counts = counts.where("blob IS NOT NULL").select("chunk", "kind", "part", "blob")
        answers = counts if answers is None else answers.unionAll(counts)
        release(spark)
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with(own, answers).applyInArrow(_evaluate(order, types, sc.broadcast(learnt)), out)


def _splits(facts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, counts and sums of the histories that several buckets have, of all buckets together: 2 * PARTS rows at most."""
    found: dict[int, tuple[np.ndarray, float]] = {}
    for r in facts.select(F.inline("split")).collect():
        n, low = found.get(r.name, (0, 0.0))
        found[r.name] = (n + np.array(r.n), low + r.low)
    names = sorted(found)
    return np.array(names, np.int64), np.array([found[x][0] for x in names], np.float64).reshape(-1, CUT + 1), np.array([found[x][1] for x in names], np.float64)


def _with(chunks: DataFrame, answers: DataFrame):
    """Each chunk with the answers to it. The chunks' table is bucketed by chunk, so only the answers move."""
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))


def op7(spark, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
