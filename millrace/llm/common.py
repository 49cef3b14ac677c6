"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of the Arrow batches that go to Python and come back.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, as in tests, a temporary one for a local master; an error for others."""
    set_to = spark.conf.get("spark.checkpoint.dir", "")
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to


def free(columns: list[str], name: str) -> str:
    """``name``, with underscores before it while ``columns`` has a column that starts like it, in either case."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = f"_{name}"
    return name


def named(columns: list[str]) -> list[Column]:
    """``columns`` as they are, dots and blanks in their names included."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` over batches of about BATCH_BYTES, so that a task's memory holds few texts at once.

    The size is a setting of the session, made where the session has none; a text longer than it is a batch of its own.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def judged(docs: DataFrame, function, name: str, kind: str) -> DataFrame:
    """``docs`` with a last column ``name`` of type ``kind``: ``function`` of Arrow arrays of texts. The other columns pass by their places."""
    plain, at = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), docs.columns.index("text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, function(b.column(at))], [*b.schema.names, "found"])

    found = map_batches(plain, per_batch, T.StructType([*plain.schema, *T.StructType.fromDDL(f"found {kind}")]))
    return found.toDF(*docs.columns, name)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], name: str, total: int, per_block: int = 50_000) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... without gaps within each value of ``keys``.

    Rows of one key are spread over hashed blocks that are numbered on their
    own; block sizes (a small aggregate) give each block its first number. So a
    key with a third of all rows is still numbered by many tasks. Rows that
    agree in ``order`` are interchangeable. ``total`` is the number of rows.
    """
    blocks = max(16, -(-total // per_block))
    blocked = df.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(blocks)))
    by = [*keys, "_block"]
    first = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return blocked.withColumn("_inner", inner).join(bases, by).withColumn(name, F.col("_base") + F.col("_inner") - 1).drop("_block", "_base", "_inner")
