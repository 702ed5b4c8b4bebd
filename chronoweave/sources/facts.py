"""Facts: (subject, predicate, object_raw, time, pos) with typed readings of the object and the time's window.

pos is the input order, which decides ties. Objects keep their raw text;
object_num reads numbers and booleans, object_bool booleans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronoweave.functions.timewin import time_end, time_start

NUMBER = r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
RAW = "subject string, predicate string, object string, time string, unit string, note string, source string, is_supported boolean, reason string"


def to_number(raw: Column) -> Column:
    """A number's or boolean's value, null for any other text."""
    return F.when(raw.rlike(NUMBER), F.trim(raw).try_cast("double")).when(raw == "true", 1.0).when(raw == "false", 0.0)


def typed(df: DataFrame) -> DataFrame:
    """Adds object_num, object_bool, t_start and t_end to rows with object_raw and time."""
    return df.withColumns(
        {
            "object_num": to_number(F.col("object_raw")),
            "object_bool": F.when(F.col("object_raw").isin("true", "false"), F.col("object_raw") == "true"),
            "t_start": time_start(F.col("time")),
            "t_end": time_end(F.col("time")),
        }
    )


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of facts. The file is one document, read whole, so that pos is the place in the array."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':') for c in RAW.split(', '))}>>")).alias("pos", "f"))
    return typed(rows.select(F.col("pos").cast("long"), "f.*").withColumnRenamed("object", "object_raw"))


def read_questions(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """A JSON array of questions, in file order by pos; of the given ids, or all. value, fields and ground_truth (value, else
    fields, else empty) are JSON text."""
    text = spark.read.text(path, wholetext=True)
    spec = "struct<kind:string,value:variant,fields:variant>"
    rows = text.select(F.posexplode(F.from_json("value", f"array<struct<id:int,question:string,answer_spec:{spec},entities:array<string>,type:string>>")).alias("pos", "q"))
    part = lambda name: F.to_json(F.col(f"q.answer_spec.{name}"))
    out = rows.select("q.id", "q.question", F.col("q.answer_spec.kind").alias("kind"), part("value").alias("value"), part("fields").alias("fields"), "q.entities", "q.type", F.col("pos").cast("long").alias("pos"))
    out = out.withColumn("ground_truth", F.coalesce("value", "fields", F.lit("")))
    return out if ids is None else out.where(F.col("id").isin(list(ids)))


def row_by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The first row with that key; an error when it is read if there is none."""
    one = df.where(F.col(key) == F.lit(value)).limit(1).withColumn("_hit", F.lit(True))
    missing = F.raise_error(F.lit(f"no row with {key} {value}")).cast("boolean")
    out = df.sparkSession.range(1).select().join(one, F.lit(True), "left")
    return out.where(F.when(F.col("_hit").isNull(), missing).otherwise(F.lit(True))).drop("_hit")


def _line_order() -> Column:
    """Where a line stands: its file by path, its split of the file, and its row there. Row numbers alone follow the order in
    which splits are packed into partitions, the larger ones first."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def read_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """JSON lines, blank ones skipped; with a key the last line of each counts, in the order of the files' paths and their lines. A missing
    file has no rows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).withColumn("_pos", _line_order()).where(F.trim("value") != "")
    out = lines.select("_pos", F.from_json("value", schema).alias("r")).select("_pos", "r.*")
    return (out if key is None else keyed_lines(out, key, "_pos")).drop("_pos")


def record_json(df: DataFrame, *columns: str) -> Column:
    """The columns of df as one JSON object, fractions rounded to four places, null ones kept."""
    kinds = dict(df.dtypes)
    columns = [F.round(c, 4).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def facts_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Facts from (subject, predicate, object text, time) tuples, in their order."""
    return typed(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, subject string, predicate string, object_raw string, time string"))


def facts_from_orders(orders: DataFrame) -> DataFrame:
    """Orders as facts of customers: by o_orderkey, times of three grains and some without."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.substring(day, 1, 7)).otherwise(F.substring(day, 1, 4))
    return typed(
        orders.select(
            F.col("o_orderkey").alias("pos"),
            F.col("o_custkey").cast("string").alias("subject"),
            F.col("o_orderpriority").alias("predicate"),
            F.col("o_totalprice").cast("string").alias("object_raw"),
            time.alias("time"),
        )
    )


def keyed_lines(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row a key, the last by pos, as a keyed JSONL file is read."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pos)))).where("_n = 1").drop("_n")


def with_manifest_defaults(df: DataFrame) -> DataFrame:
    """Source manifests: a missing domain is astronomy, a missing trust level reference, missing lists are empty."""
    fill = {"domain": F.lit("astronomy"), "trust_level": F.lit("reference"), "target_questions": F.array().cast("array<int>"), "needed_evidence": F.array().cast("array<string>")}
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in fill.items()})


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results by id; rows whose id is no integer go, and the last of an id counts, in the order of the files' paths and their lines."""
    df = spark.read.csv(path, header=True)
    if "id" not in df.columns:
        return df.where("false")
    df = df.withColumn("_pos", _line_order())
    return keyed_lines(df.withColumn("id", F.col("id").try_cast("int")).where("id IS NOT NULL"), "id", "_pos").drop("_pos")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Results as Parquet, JSON lines or CSV with a header; nested columns become JSON text in CSV. With mode append, parts of a
    run that may fail are kept as they come."""
    if fmt == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    df.write.mode(mode).option("header", fmt == "csv").format(fmt).save(path)
