"""Bounded training samples, the only rows of a corpus that reach the driver."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def by_class(
    rows: DataFrame, id_column: str, class_column: str, per_class: int, most: int, salt: str
) -> DataFrame:
    """About ``per_class`` ids of each class, ``most`` in all: ``(id, class)``, once an id.

    A row is taken if the salted hash of its id lies under its class's share, so a
    class that holds most of the table is thinned where it is read; nothing is
    gathered by class. Classes are counted over all rows. An id of several classes
    stands for the least of those it is taken in.
    """
    counts = rows.groupBy(class_column).agg(F.count(F.lit(1)).alias("_n"))
    counts = F.broadcast(counts.orderBy(F.col("_n").desc(), class_column).limit(most))
    order = F.xxhash64(F.lit(salt), F.col(id_column).cast("string"))
    share = F.lit(float(per_class)) / F.col("_n")
    return (
        rows.join(counts, class_column)
        .withColumn("_order", order)
        .where(F.col("_order") / F.lit(float(1 << 64)) + 0.5 < share)
        .groupBy("_order", id_column)
        .agg(F.min(class_column).alias(class_column))
        .orderBy("_order", id_column, class_column)
        .limit(most)
        .select(id_column, class_column)
    )


def gather(
    docs: DataFrame, ids: DataFrame, keys: list[str], columns: list[str], text_column: str,
    class_column: str, max_bytes: int, salt: str,
) -> list[tuple]:
    """The sampled documents' ``columns``, on the driver, at most ``max_bytes`` of text.

    ``ids`` is a bounded table, so it is broadcast; it is joined on ``keys``, the id
    first. Of an id's rows one is taken, the one of the shortest text that is not null
    (ties: the least). If not all fits, the classes take turns, each in the order of
    the salted hash of its ids, and only a row that doesn't fit is left out, so that
    no class and no range of ids is lost to the bound; a row stays whole.
    """
    key = columns[0]
    rest = [c for c in columns[1:] if c != text_column]
    found = docs.join(F.broadcast(ids), keys, "inner").select(
        key, F.struct(F.col(text_column).isNull().alias("_null"), F.octet_length(text_column).alias("_n"), text_column, *rest).alias("_row")
    )
    found = cut(found.groupBy(key).agg(F.min("_row").alias("_row")).select(key, "_row.*").withColumnRenamed("_n", "_bytes"))
    order = F.xxhash64(F.lit(salt), F.col(key).cast("string"))
    sizes = found.select(key, class_column, order, F.coalesce("_bytes", F.lit(0))).collect()
    kept = within([tuple(r) for r in sizes], max_bytes)
    if len(kept) < len(sizes):
        kind = found.select(key).schema
        found = found.join(F.broadcast(found.sparkSession.createDataFrame([(k,) for k in kept], kind)), key, "left_semi")
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=lambda r: tuple(map(str, r)))


def within(sizes: list[tuple], most: int) -> list:
    """The ids of ``(id, class, order, bytes)`` rows that fit in ``most`` bytes, classes taking turns."""
    turns, seen = [], Counter()
    for key, of, order, n in sorted(sizes, key=lambda r: (r[2], str(r[0]))):
        turns.append((seen[of], str(of), key, n))
        seen[of] += 1
    kept = []
    for _, _, key, n in sorted(turns, key=lambda t: t[:2]):
        if n <= most:
            most -= n
            kept.append(key)
    return kept
