"""The rewrite of drifted files against plain Python over the same rows."""

import hashlib
import itertools
import math
import os
import tempfile
import zlib
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronoweave.llm import drift
from chronoweave.llm.staging import read_table
from tests.oracle import SMALL

NAMES = list(drift.COLUMNS)
ROW = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(v):
    if v is None:
        return "?"
    if isinstance(v, datetime):
        return str(round((v - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + v.microsecond)
    return str(math.floor(v * 1048576)) if isinstance(v, float) else str(v)


def plain(rows):
    """file_no -> (version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, rewritten), of distinct client_ids."""
    crc = lambda x: zlib.crc32(str(x).encode())
    rows = sorted(rows, key=lambda r: (r[0] is not None, crc(r[0]), r[0] or 0))
    length = 1 + len(rows) // 250
    out = {}
    for no in range(math.ceil(len(rows) / length)):
        version = crc(f"19:{no}") % 24
        version = 0 if version > 15 else version
        own = []
        for r in rows[no * length : (no + 1) * length]:
            r = list(r)
            if version & 8 and r[9] is not None:
                r[9] = pa.array([r[9]]).cast(pa.float32(), safe=False)[0].as_py()
            if version & 4:
                r[7:9] = [-1, "none"]
            own.append(r)
        start = [c for c in NAMES if not version & 4 or c not in ("nation_id", "segment")]
        start = start[:1] + start[1:][::-1] if version & 2 else start
        start = [{"name": "email", "email": "name"}.get(c, c) for c in start] if version & 1 else start
        lines = "\n".join("|".join(map(told, r)) for r in own)
        out[no] = (version, len(own), sum(v is None for r in own for v in r), sha(",".join(told(r[0]) for r in own)), sha(lines), ",".join(start), version != 0)
    return out


def same(report, rows):
    report = report.collect()
    got = {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.rewritten) for r in report}
    assert len(got) == len(report) and got == plain(rows)
    for r in report:
        assert r.columns == ",".join(NAMES)
    if not report:
        return
    folder = os.path.dirname(report[0].path.removeprefix("file://"))
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(r.path) for r in report)
    for r in report:
        file = pq.ParquetFile(r.path.removeprefix("file://"))
        schema = file.schema_arrow
        assert schema.names == NAMES and drift.ids_of(schema) == list(range(1, 11)) and all(f.nullable for f in schema)
        assert schema.field("nation_id").type == pa.int64() and schema.field("balance").type == pa.float64()
        lines = "\n".join("|".join(map(told, x.values())) for x in file.read().to_pylist())
        assert sha(lines) == r.rows_sha256


def test_whole_query(spark):
    rows = [tuple(r) for r in read_table(spark, SMALL, "clients").select(*NAMES).collect()]
    report = drift.op11(spark, SMALL)
    same(report, rows)
    assert {r.version for r in report.collect()} == set(range(16))


def odd(n):
    at = datetime(1969, 12, 31, 23, 59, 59, 250_000)
    return [(i * 7, None if i % 3 else i, "a|b" if i % 2 else None, at if i % 4 else None, f"n\n{i}", None if i % 5 else "", "é" * (i % 3), None if i % 6 == 0 else i, None if i % 7 == 0 else "x", None if i % 8 == 0 else -i / 3) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 249, 510])
def test_odd_rows(spark, n):
    rows = odd(n)
    rows += [(None, *rows[0][1:])] if rows else []
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], ROW + ", place int, file_no string")
    same(drift.rewrite_clients(df, "file://" + tempfile.mkdtemp()), rows)


def test_one_client(spark):
    """Repeated rows, most of them of one client, stay, and files have equal length."""
    rows = odd(40) + [odd(2)[1]] * 960
    report = drift.rewrite_clients(spark.createDataFrame(rows, ROW), "file://" + tempfile.mkdtemp()).collect()
    assert sorted(r.n_rows for r in report) == [5] * 200
    assert sum(r.n_rows for r in report) == 1000


def test_untouched_and_again(spark):
    """Files without drift keep their bytes; a second attempt of a run tells the same, a second run finds nothing to do."""
    root = "file://" + tempfile.mkdtemp()
    df = spark.createDataFrame(odd(500), ROW)
    target = drift.client_target(df)
    files = drift.start_files(drift.numbered(df), root, target)
    names = [r.name for r in files.collect()]
    read = lambda: {x: open(f"{root[7:]}/table/{x}", "rb").read() for x in names}
    before = read()
    first = [drift.migrate_file(root, x, target, "run") for x in names]
    after = read()
    assert {x for x, f in zip(names, first, strict=True) if f[-1]} == {x for x in names if before[x] != after[x]}
    assert [drift.migrate_file(root, x, target, "run") for x in names] == first
    again = drift.rewrite(drift.table_files(spark, root), root, target).collect()
    assert len(again) == len(names) and not any(r.rewritten or r.version for r in again) and read() == after


def test_chain_is_composed_of_single_bits():
    """Each version's footer tells its bits; what the transforms give does not depend on their order, nor on the batches' sizes."""
    schema = drift.with_ids(NAMES, [pa.int64(), pa.int64(), pa.string(), pa.timestamp("us"), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64()])
    target = drift.Target(schema, tuple(drift.DEFAULTS.items()))
    table = pa.Table.from_pylist([dict(zip(NAMES, r, strict=True)) for r in odd(30)], schema=schema)
    for version in range(16):
        own, at = drift.drifted(schema, version)
        start = pa.table([table.column(i).cast(f.type, safe=False) for i, f in zip(at, own, strict=True)], schema=own)
        assert drift.drift_of(own, target) == version
        want = None
        steps = [f for bit, f in drift.STEPS.items() if version & bit]
        results = [pa.Table.from_batches(drift.chain(version, target)(iter(start.to_batches(k)))) for k in (1000, 7)]
        for order in itertools.permutations(steps):
            batch = start.combine_chunks().to_batches()[0]
            for f in order:
                batch = f(batch, target)
            results.append(pa.Table.from_batches([batch]))
        for r in results:
            assert r.schema.equals(schema) and drift.ids_of(r.schema) == list(range(1, 11))
            want = r if want is None else want
            assert r.equals(want)


def test_unknown_fields():
    schema = drift.with_ids(["a", "b"], [pa.int64(), pa.string()])
    with pytest.raises(ValueError):
        drift.drift_of(drift.with_ids(["a", "b", "c"], [pa.int64()] * 3), drift.Target(schema))
    with pytest.raises(ValueError):
        drift.drift_of(pa.schema([("a", pa.int64())]), drift.Target(schema))
