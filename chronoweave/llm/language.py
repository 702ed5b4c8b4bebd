"""Language ID by cross-parsing: the language whose suffix automaton parses a text into the fewest phrases wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.llm.staging import read_table, spare
from chronoweave.llm.textops import sub_batches

#: Bounds of the labelled sample that a language learns from: so many slices of so many characters.
SLICES, SLICE_CHARS = 64, 256
#: Texts are parsed in blocks of so many symbols at a time, and phrases go on from block to block.
BLOCK = 512
LITERAL = 256
#: A label is held to be wrong if another language's normalised phrases are this share fewer.
CONFIDENT = 0.35
UNKNOWN = "und"
_CODES = 0x110000


def fold(doc_id: str, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


@dataclass
class Model:
    """languages: names by code point. symbol: symbol of each code point, 0 for what is no letter, 1 for letters that no
    language showed, however many others there are. Of each language: moves, the automaton's transitions, row by row in
    one vector, a state being the place where its row begins: state s goes on with symbol c to the low half of
    moves[s + c] if the high half is s; first: where its start goes on with each symbol. 0 is no state. learnt: the
    number of symbols that the language learnt from."""

    languages: list[str]
    symbol: np.ndarray
    moves: list[np.ndarray]
    first: list[np.ndarray]
    learnt: np.ndarray


def automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence of symbols, by state; state 0 is the start."""
    link, length, last = [-1], [0], 0
    nxt: list[dict[int, int]] = [{}]
    for c in text:
        new = len(nxt)
        nxt.append({}), length.append(length[last] + 1), link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q])), length.append(length[p] + 1), link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nxt


def lay_out(found: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """moves and first of a Model, from an automaton: rows of transitions laid over each other where they leave gaps, the
    fullest first, no two at one place. States that go nowhere are all state 1."""
    rows = sorted((s for s, own in enumerate(found) if own), key=lambda s: (-len(found[s]), s))
    used = bytearray(sum(map(len, found)) + 2 * symbols + 2)
    place, taken, free, size, hint = [1] * len(found), {0, 1}, symbols, 0, 0
    for state in rows:
        codes = sorted(found[state])
        while free < len(used) and used[free]:
            free += 1
        spot = free if len(codes) != size else max(free, hint)  # rows of one size follow each other
        while True:
            while spot + symbols >= len(used):
                used += bytearray(len(used))
            if not used[spot] and spot - codes[0] not in taken and not any(used[spot - codes[0] + c] for c in codes):
                break
            spot += 1
        size, hint, place[state] = len(codes), spot, spot - codes[0]
        taken.add(place[state])
        for c in codes:
            used[place[state] + c] = 1
    moves = np.full(max(place) + symbols, -1, np.int64)
    for state in rows:
        for c, to in found[state].items():
            moves[place[state] + c] = place[state] << 32 | place[to]
    first = np.zeros(symbols, np.int64)
    for c, to in found[0].items():
        first[c] = place[to]
    return moves, first


def learn(docs: DataFrame) -> Model:
    """Learns from a bounded sample of rows with lang and text: SLICES rows a language, in the order of a hash of
    doc_id, and a slice of SLICE_CHARS characters from a hashed place in each."""
    turn = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("turn"))
    df = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text", turn.alias("turn"))
    begin = (F.lit(1) + F.pmod(F.col("turn"), F.greatest(F.length("text") - SLICE_CHARS, F.lit(1)))).cast("int")
    df = df.select("lang", "turn", F.substring("text", begin, F.lit(SLICE_CHARS)).alias("piece"))
    best = Window.partitionBy("lang").orderBy("turn", "piece")
    rows = df.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= SLICES).collect()
    pieces: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.nth)):
        pieces.setdefault(r.lang, []).append(r.piece)
    return model_of({name: "\n".join(own) for name, own in pieces.items()})


def model_of(texts: dict[str, str]) -> Model:
    """From a text of each language."""
    languages = sorted(texts)
    letters = {x: i + 2 for i, x in enumerate(sorted({_folded(x) for t in texts.values() for x in set(t) if x.isalpha()}))}
    symbol = np.zeros(_CODES, np.uint16 if len(letters) < 65534 else np.int32)
    for code in range(_CODES):
        x = chr(code)
        if x.isalpha():
            symbol[code] = letters.get(_folded(x), 1)
    learnt = [symbols_of(texts[name], symbol)[0].tolist() for name in languages]
    laid = [lay_out(automaton(x), len(letters) + 2) for x in learnt]
    return Model(languages, symbol, [x for x, _ in laid], [x for _, x in laid], np.array([len(x) for x in learnt], np.int64))


def _folded(x: str) -> str:
    return x.lower()[:1]


def symbols_of(text: str, symbol: np.ndarray) -> tuple[np.ndarray, bool]:
    """Letters as symbols, runs of anything else as one 0; whether there is a letter."""
    out = symbol[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = out > 0
    has = bool(keep.any())
    keep[1:] |= out[:-1] > 0
    return out[keep], has


def phrases(texts: list[np.ndarray], m: Model) -> np.ndarray:
    """The number of phrases of each text (rows) in each language.

    A phrase is the longest match from where the last one ended, or one symbol
    that the language never showed. All blocks of all texts are first parsed in
    step, each as if a phrase began with it. Then, block by block of each text,
    the phrase that comes from the block before is carried on until it ends
    where the block's own parse ends one; from there on both are the same.
    """
    out = np.zeros((len(texts), len(m.languages)), np.int64)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
    if not len(owner):
        return out
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    lengths = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
    order = np.argsort(-lengths, kind="stable")
    owner, nth, lengths = owner[order], nth[order], lengths[order]
    grid = np.zeros((int(lengths[0]), len(owner)), np.int64)
    for col, (d, k, n) in enumerate(zip(owner.tolist(), nth.tolist(), lengths.tolist(), strict=True)):
        grid[:n, col] = texts[d][k * BLOCK : k * BLOCK + n]
    before = np.full(len(owner), -1)
    if nth.any():
        place = {(d, k): col for col, (d, k) in enumerate(zip(owner.tolist(), nth.tolist(), strict=True))}
        before = np.array([place.get((d, k - 1), -1) for d, k in zip(owner.tolist(), nth.tolist(), strict=True)])
    for i in range(len(m.languages)):
        np.add.at(out[:, i], owner, _parse(grid, lengths, nth, before, m.moves[i], m.first[i]))
    return out


def _parse(grid: np.ndarray, lengths: np.ndarray, nth: np.ndarray, before: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The phrases that begin in each block; lengths fall, nth is a block's place in its text, before the block before it."""

    def step(state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins."""
        move = moves.take(state + c)
        begins = move >> 32 != state
        return np.where(begins, first.take(c), move & 0xFFFFFFFF), begins

    state = np.zeros(len(lengths), np.int64)
    marks = np.zeros(grid.shape, bool)
    for i, n in enumerate(np.searchsorted(-lengths, -np.arange(len(grid)), side="left").tolist()):
        state[:n], marks[i, :n] = step(state[:n], grid[i, :n])
    total = marks.sum(0)
    for k in range(1, int(nth.max()) + 1):
        cols, i = np.flatnonzero(nth == k), 0
        carried = state[before[cols]]
        while len(cols) and i < len(grid):
            open_ = lengths[cols] > i  # the others' last phrase goes on
            if not open_.all():
                state[cols[~open_]] = carried[~open_]
                cols, carried = cols[open_], carried[open_]
                continue
            carried, begins = step(carried, grid[i, cols])
            total[cols] += begins.astype(np.int64) - marks[i, cols]
            apart = ~(begins & marks[i, cols])
            cols, carried, i = cols[apart], carried[apart], i + 1
        state[cols] = carried
    return total


def normalised(counts: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """Phrases by the bits that one costs, which says where among so many symbols it is: a language that learnt from little
    has short matches, and cheaper ones. LITERAL places more are single symbols."""
    return counts * np.log2(learnt + float(LITERAL))


def _identifier(model, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        names = np.array(m.languages, object)
        for batch in sub_batches(batches):
            found = [symbols_of(t or "", m.symbol) for t in batch.column("text").to_pylist()]
            costs = normalised(phrases([x for x, _ in found], m), m.learnt)
            pred, score = [], []
            for (_, letters), c in zip(found, costs, strict=True):
                if not letters or not len(names):
                    pred.append(UNKNOWN), score.append(0.0)
                    continue
                order = np.argsort(c, kind="stable")
                pred.append(names[order[0]])
                score.append(1.0 if len(c) == 1 else float(1 - c[order[0]] / max(1e-9, c[order[1]])))
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *added])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns for the predicted language and its score at the end, under names that docs hasn't (spare()).

    The prediction reads text alone, whole, however long. The fewest phrases
    win, each weighed by log2 of the symbols that the language learnt from;
    ties go to the language first by code point. score: 1 less the ratio of
    the least cost to the next. Null text and text without a letter is 'und'
    with score 0, as is everything if nothing was learnt. Repeated rows, null
    ids and other columns pass; an empty table gives no rows.
    """
    from pyspark.sql import types as T

    names = [spare(docs, "lang_pred"), spare(docs, "score")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(_identifier(docs.sparkSession.sparkContext.broadcast(model), names), schema)


def predict(docs: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs; learns from rows of the two other thirds."""
    held_out = fold("doc_id", 3) == 1
    model = learn(docs.where(~held_out if learn_from is None else learn_from))
    found = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """docs without the rows whose language is 'und', and without those whose label is a learnt language other than the
    predicted one while the prediction's score reaches confident."""
    model = learn(docs.where(fold("doc_id", 3) != 1))
    pred, score = (F.col(f"`{spare(docs, c)}`") for c in ("lang_pred", "score"))
    wrong = F.col("lang").isin(model.languages) & (F.col("lang") != pred) & (score >= confident)
    return identify(docs, model).where((pred != UNKNOWN) & ~F.coalesce(wrong, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8(spark, sf_dir: str) -> DataFrame:
    return predict(read_table(spark, sf_dir, "documents"))
