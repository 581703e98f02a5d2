"""What several of these operators share: lineage cuts, folds, Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python operator holds in its work arrays.
CHUNK_BYTES = 4 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset (local tests, one machine) a temporary folder is
    made and set.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if conf is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster a folder that all executors share is needed")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="covenant-"))
        current = sc._jsc.sc().getCheckpointDir()
    return conf or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage.

    A reliable checkpoint: it survives the loss of any executor, and Spark's
    cleaner removes the files once nothing refers to them.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffles, checkpoints and broadcasts that nothing refers to any more.

    It acts once the driver's JVM has collected garbage, which a large heap puts off. Frames
    that Python holds in cycles go first; what the JVM hears of late goes the next time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def text_chunks(
    batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts stay near ``limit`` bytes each.

    A single longer text makes a slice of its own; no text is cut.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += (n or 0) + 64
        if start < batch.num_rows:
            yield batch.slice(start)


def bounded_sample(df: DataFrame, id_column: str, rows: int, salt: str) -> DataFrame:
    """At most ``rows`` rows in the order of a salted hash of their ids.

    The same rows at any partitioning; ``rows`` is the bound that callers
    document. Ties of the hash go by id.
    """
    order = F.xxhash64(F.lit(salt), F.col(id_column).cast("string"))
    return df.orderBy(order, F.col(id_column)).limit(rows)
