"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint has 64 bits: each word shingle of a text votes with its XXH64, and
a bit is 1 where more than half of the votes are. Two fingerprints link if they
differ in at most ``max_bits`` bits. Those lie in at most ``max_bits`` of the
eight bytes, so linked fingerprints agree in at least ``8 - max_bits`` positional
bytes: the guaranteed minimum number of matches.

The inverted index posts every fingerprint under its positional bytes. A list of
one byte at one position would hold a 256th of everything, so bytes are posted
together: the eight positions fall into ``max_bits + 2`` blocks, of which a linked
pair agrees in two at least, and a list stands for two blocks and their bytes. Within
a list every pair's shared positional bytes are tallied; pairs of fewer than the
guaranteed minimum are dropped; the others are verified on all bits. A pair that
meets in several lists is taken in the first.

Lists are counted before they are gathered. The fingerprints of a list longer than
``LONGEST_LIST`` are posted again under every set of as many positions as the
guaranteed minimum (28 sets of six, for two bits), so that the free bytes bound a
list at 65,536 fingerprints, whatever the corpus. There a tally is reached by all,
and partners are looked up by the few admissible changes of the free bytes.

Equal fingerprints are one node with a count, so copies cost nothing, and the
components come from the links between different fingerprints.

Defined results: a null or empty text, or one without words, has fingerprint
zero and links like any other; with fewer words than a shingle the whole sequence
is the only shingle; a null id takes part but never names a component (null if no
other id is there); repeated rows give repeated rows; further columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_chunks, unused
from .components import connected_components

#: The production parameters.
WIDTH = 3
SEED = 42
MAX_BITS = 2
#: Lists of up to so many fingerprints are tallied pair by pair.
LONGEST_LIST = 512


def fingerprint_of(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), seed)
    if n < 200:
        hashes = [xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(n)]
    else:
        joined = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        hashes = [xxh64_intdigest(joined[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :].tolist())]
    return majority(np.asarray(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # work arrays of a megabyte, for texts of any length
        part = hashes[at : at + (1 << 14)]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, width: int = WIDTH, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            found = [fingerprint_of(t, width, seed) for t in b.column(1).to_pylist()]
            fp = np.asarray(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, fp long")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """The sets of byte positions that a linked pair shares at least one of."""
    return list(combinations(range(8), 8 - max_bits))


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def block_sets(max_bits: int) -> list[tuple[int, ...]]:
    """The positions of each two blocks, of ``max_bits + 2`` that the eight positions fall into."""
    blocks = [tuple(x.tolist()) for x in np.array_split(np.arange(8), max_bits + 2)]
    return [x + y for x, y in combinations(blocks, 2)]


def postings(prints: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """``(set_id, bytes, fp)``: each fingerprint under each set of positions."""
    each = [F.struct(F.lit(i).cast("byte").alias("set_id"), F.lit(_mask(s)).alias("mask")) for i, s in enumerate(sets)]
    return prints.select("fp", F.explode(F.array(*each)).alias("s")).select(
        F.col("s.set_id").alias("set_id"), F.col("fp").bitwiseAND(F.col("s.mask")).alias("bytes"), "fp"
    )


def shared_bytes(changed: np.ndarray) -> np.ndarray:
    """Which positional bytes pairs share, by their exclusive-or: a row of eight flags each."""
    return np.ascontiguousarray(changed).view(np.uint8).reshape(*changed.shape, 8) == 0


def tallied_links(
    prints: np.ndarray, sizes: np.ndarray, which: np.ndarray, sets: list[tuple[int, ...]], max_bits: int = MAX_BITS
) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (a < b, unsigned) of many lists, one after another in ``prints``.

    ``sizes`` are the lists' lengths, ``which`` their sets. Pairs are tallied, held to
    the guaranteed minimum, verified, and taken only in the first of the lists they
    meet in.
    """
    first, second = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    heads = np.cumsum(sizes) - sizes
    # positions are told from the lowest byte, as masks are
    members = np.zeros((len(sets), 8), dtype=bool)
    for i, s in enumerate(sets):
        members[i, list(s)] = True
    for m in np.unique(sizes):
        lists = np.flatnonzero(sizes == m)
        i, j = np.triu_indices(m, 1)
        step = max(1, (1 << 18) // max(1, len(i)))
        for at in range(0, len(lists), step):
            some = lists[at : at + step]
            table = prints[heads[some][:, None] + np.arange(m)]
            x, y = table[:, i], table[:, j]
            changed = (x ^ y).astype("<u8")
            tally = shared_bytes(changed).sum(axis=2)
            near = np.nonzero(tally >= 8 - max_bits)
            near = tuple(c[np.bitwise_count(changed[near]) <= max_bits] for c in near)
            shared = shared_bytes(changed[near])
            met = (shared[:, None, :] | ~members[None]).all(axis=2)  # the sets whose bytes a pair shares
            here = np.argmax(met, axis=1) == which[some][near[0]]
            x, y = x[near][here], y[near][here]
            first.append(np.minimum(x, y))
            second.append(np.maximum(x, y))
    return np.concatenate(first), np.concatenate(second)


def _changes(positions: tuple[int, ...], max_bits: int) -> np.ndarray:
    """All patterns of at most ``max_bits`` bits within the positions' complement, but none."""
    free = [8 * p + k for p in range(8) if p not in positions for k in range(8)]
    found = [sum(1 << x for x in c) for n in range(1, max_bits + 1) for c in combinations(free, n)]
    return np.asarray(found, dtype=np.uint64)


def list_links(prints: np.ndarray, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (a < b, unsigned) within one long list, by ``changes`` of its free bytes."""
    prints = np.unique(prints)
    first, second = [], []
    for change in changes:
        other = prints ^ change
        at = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
        found = (prints[at] == other) & (prints < other)
        first.append(prints[found])
        second.append(other[found])
    return np.concatenate(first), np.concatenate(second)


def links(prints: DataFrame, max_bits: int = MAX_BITS, longest_list: int = LONGEST_LIST) -> DataFrame:
    """``(a, b)``: all pairs of different fingerprints that link, once each.

    ``prints`` holds each fingerprint once (column ``fp``).
    """
    sets, bounded = block_sets(max_bits), position_sets(max_bits)
    list_key = ["set_id", "bytes"]
    posted = postings(prints, sets)
    long = cut(posted.groupBy(*list_key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > longest_list).select(*list_key))
    gathered = posted.join(long, list_key, "left_anti").groupBy(*list_key).agg(F.collect_list("fp").alias("fps"))
    again = postings(posted.join(long, list_key, "left_semi").select("fp").distinct(), bounded)
    crowded = again.groupBy(*list_key).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    changes = [_changes(s, max_bits) for s in bounded]

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(1)
            sizes = np.diff(fps.offsets.to_numpy())
            yield pairs(*tallied_links(fps.flatten().to_numpy().view(np.uint64), sizes, b.column(0).to_numpy(), sets, max_bits))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for which, fps in zip(b.column(0).to_pylist(), b.column(1)):
                yield pairs(*list_links(fps.values.to_numpy().view(np.uint64), changes[which]))

    schema = "a long, b long"
    found = gathered.where(F.size("fps") > 1).select("set_id", "fps").mapInArrow(tallied, schema)
    return found.union(crowded.select("set_id", "fps").mapInArrow(looked_up, schema)).distinct()


def spread(prints: DataFrame) -> DataFrame:
    """The fingerprints dealt out evenly: what follows makes many rows of each."""
    spark = prints.sparkSession
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return prints.select("fp").repartition(most)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, seed: int = SEED, max_bits: int = MAX_BITS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``(doc_id, fingerprint, component_id, n_links)`` of every document.

    ``n_links`` counts the different fingerprints linked to a document's own.
    """
    own = cut(fingerprints(docs, width, seed, id_column, text_column))
    prints = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = cut(links(spread(prints), max_bits))
    component = connected_components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(
        prints.join(component, prints.fp == component.node, "left")
        .join(degree.withColumnRenamed("node", "at"), F.col("fp") == F.col("at"), "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("root"), F.coalesce("n", F.lit(0)).alias("n_links"))
    )
    least = cut(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(placed.join(least, "root").select("fp", "component_id", "n_links"))
    return own.join(named, "fp").select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "n_links"
    )


def representatives(
    docs: DataFrame, width: int = WIDTH, seed: int = SEED, max_bits: int = MAX_BITS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One document, all columns, of each near-duplicate component.

    It is the one of the least id, nulls last, and of those the one of the least row
    key (two hashes of id and text); of rows equal in both, one stays. Rows are told
    by their keys, so texts are moved once at most, and rows that are there only once
    are not gathered to be told apart.
    """
    keys = [F.xxhash64(F.lit(salt), id_column, F.col(id_column).isNull(), text_column, F.col(text_column).isNull()) for salt in (1, 2)]
    names = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), keys[0].alias("key"), keys[1].alias("other"))
    rows = docs.select(names.alias("name"), F.col(text_column).alias("text"))
    own = fingerprints(rows, width, seed, "name", "text").withColumnRenamed("doc_id", "name")
    counted = own.groupBy("fp", "name").agg(F.count(F.lit(1)).alias("n"))
    prints = cut(counted.groupBy("fp").agg(F.min(F.struct("name", "n")).alias("first")))
    component = connected_components(cut(links(spread(prints), max_bits)))
    placed = prints.join(component, prints.fp == component.node, "left")
    keep = cut(placed.groupBy(F.coalesce("component", "fp").alias("root")).agg(F.min("first").alias("first")))
    by = [unused(docs, "key"), unused(docs, "other")]
    keep = keep.select(F.col("first.name.key").alias(by[0]), F.col("first.name.other").alias(by[1]), F.col("first.n").alias("n"))
    keyed = docs.withColumns(dict(zip(by, keys)))
    single = keyed.join(keep.where("n = 1").drop("n"), by, "left_semi")
    repeated = keyed.join(keep.where("n > 1").drop("n"), by, "left_semi").dropDuplicates(by)
    return single.unionByName(repeated).drop(*by)
