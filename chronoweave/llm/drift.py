"""Rewriting Parquet files whose schema has drifted: each file's footer tells by field ids which of four transforms it needs,
and its task streams Arrow batches through those, composed, into one file of the evolved schema."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from chronoweave.llm.runs import placed, sorted_runs
from chronoweave.llm.staging import read_table, shared_dir, stage

FIELD_ID, MARK = b"PARQUET:field_id", b"rewritten_by"
RENAME, REORDER, ADD, WIDEN = 1, 2, 4, 8
#: The table of the query: its columns, how its starting files differ from the evolved schema, and about how many files it has.
COLUMNS = ("client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance")
DEFAULTS = {"nation_id": -1, "segment": "none"}
EVOLVED = {"nation_id": pa.int64()}
NARROW = {"nation_id": pa.int32(), "balance": pa.float32()}
SWAPPED = ("name", "email")
FILES, SALT, VERSIONS, DRIFTS = 250, "19:", 24, 16
SCALE = 1 << 20


def with_ids(names: Sequence[str], types: Sequence[pa.DataType]) -> pa.Schema:
    """A schema of nullable fields with the ids 1, 2, and so on."""
    return pa.schema([pa.field(n, t, True, {FIELD_ID: str(i).encode()}) for i, (n, t) in enumerate(zip(names, types, strict=True), 1)])


def ids_of(schema: pa.Schema) -> list[int]:
    found = [(f.metadata or {}).get(FIELD_ID) for f in schema]
    if None in found or len(set(found)) < len(found):
        raise ValueError(f"fields without an id of their own: {schema.names}")
    return [int(x) for x in found]


@dataclass(frozen=True)
class Target:
    """The evolved schema, with field ids, and what a column takes where a file lacks it (by name; null for others)."""

    schema: pa.Schema
    defaults: tuple[tuple[str, object], ...] = ()

    def places(self) -> dict[int, int]:
        return {x: i for i, x in enumerate(ids_of(self.schema))}


def drift_of(schema: pa.Schema, target: Target) -> int:
    """The transforms that a file of this schema needs, a bit each, by its fields' ids."""
    place = target.places()
    own = ids_of(schema)
    if unknown := [x for x in own if x not in place]:
        raise ValueError(f"field ids that the evolved schema lacks: {unknown}")
    at = [place[x] for x in own]
    wanted = [target.schema.field(i) for i in at]
    bits = RENAME * any(f.name != w.name for f, w in zip(schema, wanted, strict=True))
    bits |= REORDER * (at != sorted(at)) | ADD * (len(own) < len(place))
    return bits | WIDEN * any(f.type != w.type for f, w in zip(schema, wanted, strict=True))


def _batch(columns: list[pa.Array], fields: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))


def widen(batch: pa.RecordBatch, target: Target) -> pa.RecordBatch:
    """Each column in the type of the evolved field of its id."""
    place = target.places()
    types = [target.schema.field(place[x]).type for x in ids_of(batch.schema)]
    return _batch([c.cast(t) for c, t in zip(batch.columns, types, strict=True)], [f.with_type(t) for f, t in zip(batch.schema, types, strict=True)])


def add(batch: pa.RecordBatch, target: Target) -> pa.RecordBatch:
    """The evolved fields that the batch lacks, filled with their defaults, each at its place in the evolved schema."""
    columns, fields = list(batch.columns), list(batch.schema)
    have, default = set(ids_of(batch.schema)), dict(target.defaults)
    for x, i in target.places().items():
        if x not in have:
            field = target.schema.field(i)
            columns.insert(i, pa.repeat(pa.scalar(default.get(field.name), field.type), batch.num_rows))
            fields.insert(i, field)
    return _batch(columns, fields)


def reorder(batch: pa.RecordBatch, target: Target) -> pa.RecordBatch:
    """The columns in the order of the evolved schema."""
    place, own = target.places(), ids_of(batch.schema)
    order = sorted(range(len(own)), key=lambda i: place[own[i]])
    return _batch([batch.column(i) for i in order], [batch.schema.field(i) for i in order])


def rename(batch: pa.RecordBatch, target: Target) -> pa.RecordBatch:
    """Each column under the evolved name of its id."""
    place = target.places()
    return _batch(list(batch.columns), [f.with_name(target.schema.field(place[x]).name) for f, x in zip(batch.schema, ids_of(batch.schema), strict=True)])


#: In the order in which a chain applies them.
STEPS = {WIDEN: widen, ADD: add, REORDER: reorder, RENAME: rename}


def chain(version: int, target: Target) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The transforms of a version's bits as one, applied to each batch as it is read; version 0 passes batches on."""
    steps = [f for bit, f in STEPS.items() if version & bit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in steps:
                batch = f(batch, target)
            yield batch

    return run


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class _Output:
    """A Parquet file that appears under its name only when it is whole, so that a task that is lost or runs twice leaves no half
    of one: it is written in the folder attempts beside the table and then moved."""

    def __init__(self, root: str, name: str, schema: pa.Schema) -> None:
        self.fs, base = _filesystem(root)
        self.fs.create_dir(f"{base}/attempts"), self.fs.create_dir(f"{base}/table")
        self.part, self.final, self.schema = f"{base}/attempts/{uuid.uuid4().hex}", f"{base}/table/{name}", schema
        self.writer = pq.ParquetWriter(self.part, schema, filesystem=self.fs, compression="zstd")

    def write(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch.cast(self.schema))

    def close(self) -> None:
        self.writer.close()
        try:
            self.fs.move(self.part, self.final)
        except OSError:  # file systems where a move does not replace
            self.fs.delete_file(self.final)
            self.fs.move(self.part, self.final)


class _Digests:
    """What the report tells of a file's rows, gathered batch by batch."""

    def __init__(self) -> None:
        self.rows = self.nulls = 0
        self.ids, self.text = sha256(), sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        between = [b"," if self.rows else b"", b"\n" if self.rows else b""]
        self.rows += batch.num_rows
        self.nulls += sum(c.null_count for c in batch.columns)
        columns = [_text(c) for c in batch.columns]
        self.ids.update(between[0] + ",".join(columns[0].fill_null("?").to_pylist()).encode())
        lines = pc.binary_join_element_wise(*columns, "|", null_handling="replace", null_replacement="?")
        self.text.update(between[1] + "\n".join(lines.to_pylist()).encode())


def _text(column: pa.Array) -> pa.Array:
    """Values as the rows' digest takes them: times as microseconds, fractions as whole 2 ** -20ths, rounded down."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz), safe=False).cast(pa.int64())
    elif pa.types.is_floating(column.type):
        values = column.cast(pa.float64()).to_pylist()
        return pa.array([None if v is None else str(v) if v != v or v in (float("inf"), float("-inf")) else str(int(v * SCALE // 1)) for v in values], pa.string())
    return column.cast(pa.string())


REPORT = pa.schema(
    [("file_no", pa.int64()), ("version", pa.int64()), ("n_rows", pa.int64()), ("n_nulls", pa.int64()), ("ids_sha256", pa.string()), ("rows_sha256", pa.string())]
    + [("start_columns", pa.string()), ("columns", pa.string()), ("path", pa.string()), ("rewritten", pa.bool_())]
)
REPORT_DDL = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"


def migrate_file(root: str, name: str, target: Target, run: str) -> tuple:
    """Rewrites one file of root's table if its footer tells of drift, and (version, rows, nulls, digests, columns, rewritten) of what it is now.

    A file that this run (a name of its own) has rewritten before, in a task
    that was lost, says so in its footer and is only read.
    """
    fs, base = _filesystem(root)
    made = _Digests()
    with fs.open_input_file(f"{base}/table/{name}") as source:
        file = pq.ParquetFile(source)
        schema = file.schema_arrow
        version, start = drift_of(schema, target), schema.names
        told = json.loads((schema.metadata or {}).get(MARK, b"{}"))
        if version == 0:
            for batch in file.iter_batches():
                made.add(batch)
            rewritten = told.get("run") == run
            if rewritten:
                version, start = told["version"], told["start"]
        else:
            mark = json.dumps({"run": run, "version": version, "start": start}).encode()
            out, rewritten = _Output(root, name, target.schema.with_metadata({MARK: mark})), True
            for batch in chain(version, target)(file.iter_batches()):
                made.add(batch)
                out.write(batch)
            out.close()
    return version, made.rows, made.nulls, made.ids.hexdigest(), made.text.hexdigest(), ",".join(start), ",".join(schema.names if not rewritten else target.schema.names), rewritten


def rewrite(files: DataFrame, root: str, target: Target) -> DataFrame:
    """(file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns, path, rewritten) of files (file_no,
    name) in the folder table of root, once each of them has the evolved schema.

    Files without drift are read, not written. Each file is one task's, which
    holds a batch of it. The work is done when this returns; the report is a
    staged table.
    """
    run, n = uuid.uuid4().hex, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, name in zip(*(batch.column(c).to_pylist() for c in ("file_no", "name")), strict=True):
                version, rows, nulls, ids, text, start, columns, rewritten = migrate_file(root, name, target, run)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((no, version, rows, nulls, ids, text, start, columns, f"{root}/table/{name}", rewritten), REPORT.types, strict=True)], schema=REPORT)

    return stage(files.select("file_no", "name").repartition(n, "file_no").mapInArrow(work, REPORT_DDL), "rewritten")


def table_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_no, name) of the files in the folder table of root, as rewrite takes them; numbers are of no meaning."""
    listed = spark.read.format("binaryFile").load(f"{root}/table").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return listed.select(F.xxhash64("name").alias("file_no"), "name")


def version_of(file_no: int) -> int:
    """The drift that the query's starting file of that number has."""
    import zlib

    found = zlib.crc32(f"{SALT}{file_no}".encode()) % VERSIONS
    return found if found < DRIFTS else 0


def drifted(schema: pa.Schema, version: int) -> tuple[pa.Schema, list[int]]:
    """The schema of a starting file, and the columns of the evolved one that it has, in its order."""
    at = list(range(len(schema)))
    if version & ADD:
        at = [i for i in at if schema.field(i).name not in DEFAULTS]
    if version & REORDER:
        at = at[:1] + at[:0:-1]
    fields = [schema.field(i) for i in at]
    if version & WIDEN:
        fields = [f.with_type(NARROW.get(f.name, f.type)) for f in fields]
    if version & RENAME:
        swap = dict(zip(SWAPPED, SWAPPED[::-1], strict=True))
        fields = [f.with_name(swap.get(f.name, f.name)) for f in fields]
    return pa.schema(fields), at


def start_files(rows: DataFrame, root: str, target: Target) -> DataFrame:
    """(file_no, name): the drifted files of rows (file_no, place, the evolved columns), written to the folder table of root, each by one task as a stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, at, names = None, None, [], []
        for batch in batches:
            numbers = batch.column("file_no").to_numpy()
            begin = 0
            while begin < len(numbers):
                no = int(numbers[begin])
                end = begin + int((numbers[begin:] == no).argmin() or len(numbers) - begin)
                if no != now:
                    if out is not None:
                        out.close()
                    schema, at = drifted(target.schema, version_of(no))
                    now, out = no, _Output(root, f"file-{no:05d}.parquet", schema)
                    names.append(no)
                part = batch.slice(begin, end - begin)
                columns = [part.column(target.schema.field(i).name).cast(f.type, safe=False) for i, f in zip(at, out.schema, strict=True)]
                out.write(pa.RecordBatch.from_arrays(columns, schema=out.schema))
                begin = end
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([f"file-{x:05d}.parquet" for x in names], pa.string())], names=["file_no", "name"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "file_no").sortWithinPartitions("file_no", "place")
    return stage(dealt.mapInArrow(work, "file_no long, name string"), "started")


def client_target(clients: DataFrame) -> Target:
    types = to_arrow_schema(clients.select(*COLUMNS).schema).types
    return Target(with_ids(COLUMNS, [EVOLVED.get(c, t) for c, t in zip(COLUMNS, types, strict=True)]), tuple(DEFAULTS.items()))


def numbered(clients: DataFrame) -> DataFrame:
    """(file_no, place, the columns): all rows in the order of crc32 and client_id, cut into FILES files of equal length, at most."""
    crc = F.crc32(F.col("client_id").cast("string"))
    runs = sorted_runs(clients.select(crc.alias("crc"), *COLUMNS), ["crc", *COLUMNS], "clients")
    length = 1 + runs.count() // FILES
    return placed(runs).select(F.floor(F.col("place") / length).alias("file_no"), "place", *COLUMNS)


def rewrite_clients(clients: DataFrame, root: str) -> DataFrame:
    """The report of rewrite over clients, which it first writes as drifted files to the folder table of root.

    Any column may be null; a null client_id stands first. Rows with the same
    client_id follow each other in the order of their other columns; repeated
    rows stay. An empty table gives no file. Very long texts are streamed like
    others. Other columns are left out.
    """
    target = client_target(clients)
    return rewrite(start_files(numbered(clients), root, target), root, target)


def op11(spark, sf_dir: str) -> DataFrame:
    return rewrite_clients(read_table(spark, sf_dir, "clients"), f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}")
