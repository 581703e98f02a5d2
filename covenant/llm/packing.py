"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces of at most ``capacity`` tokens. A piece longer than half a
sequence opens one of its own; the free ends of sequences are the gap table. The rest
is packed in bulk-synchronous rounds over two distributed tables, waiting pieces and
gaps, of a few numbers a row:

* Both are range-sorted together, from the largest down, and swept: a piece's successor
  is the smallest gap before it that no longer piece has taken. Read downwards, gaps
  are opening brackets and pieces closing ones, so a sweep is a matching of brackets.
  Conflicts are resolved by rank: longer pieces first, then by row.
* Each partition matches its own rows in array operations; what is left over are pieces
  that its gaps can't serve, then gaps. Their numbers, two a partition, go to the
  driver, which matches the partitions' left-overs as runs; the rows meet by an
  equi-join on their place in a run.
* Matched gaps shrink, and the next round begins. When hardly any gap can serve, new
  sequences are opened, as many as the waiting tokens fill, and the longest pieces are
  dealt out to them by rank, back and forth, a few fewer a sequence than surely fit.

Rounds go by how many pieces a sequence takes, not by rows. No partition holds more
than its share of a common length. When a round has no more than ``ONE_TASK`` rows, it
and the later ones are done by one task, which sorts, sweeps and opens sequences alike:
shuffles of so few rows would cost tasks by the number of partitions, not by rows.

Defined results: a null text is packed as an empty one (only the end token);
repeated rows are packed once for each row; documents of equal length go by id,
piece and row, null ids first; further columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut, text_chunks, unused

CAPACITY = 1024
END_ID = 2
#: Matches of a round, as a share of the pieces still waiting, at which new sequences are opened.
RARE = 0.02
#: Rows of a round, waiting pieces and gaps, up to which one task does what is left.
ONE_TASK = 1 << 17


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what is over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document."""
    path = path or bpe.default_path()
    end = np.asarray([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.vocabulary(path)
        for b in text_chunks(batches):
            owner, rows, ids = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                tokens = np.concatenate([words.encode(text or ""), end]).astype("<u4")
                raw = tokens.tobytes()
                for k, (s, n) in enumerate(piece_bounds(len(tokens), capacity)):
                    owner.append(i)
                    rows.append((k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])))
                    if with_ids:
                        ids.append(tokens[s : s + n])
            piece, start, length, crc = (np.asarray(x, dtype=np.int64) for x in zip(*rows))
            arrays = [
                b.column(0).take(pa.array(owner)),
                pa.array(piece.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.array(crc),
            ]
            if with_ids:
                arrays.append(pa.array(ids, type=pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_column].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


PAIR, PIECE, GAP, SUMMARY = 0, 1, 2, 3
SWEPT = "what byte, id long, size int, seq long, free int, part int, idx long, summary array<long>"


def brackets(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matched ``(pieces, gaps)`` of a sorted row of gaps and pieces, by their places.

    A gap opens a bracket and a piece closes the last open one. On each level of the
    running sum openings and closings take turns, so partners are neighbours there.
    """
    steps = np.where(is_gap, 1, -1)
    level = np.cumsum(steps) + ~is_gap  # after an opening, before a closing
    order = np.argsort(level, kind="stable")
    opens = is_gap[order[:-1]] & (level[order[:-1]] == level[order[1:]]) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(opens)
    return order[at + 1], order[at]


def swept(items: DataFrame) -> DataFrame:
    """One sweep within each partition of the range-sorted ``(size, what, id)`` rows.

    Gives ``SWEPT`` rows: pairs, the pieces and gaps left over, numbered in order, and
    for each partition a summary: pairs, pieces and gaps left over, tokens of the pieces,
    the least and the longest piece, the largest gap now.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        size, what, key = (np.concatenate(c) for c in zip(*held))
        part = TaskContext.get().partitionId()
        pieces, gaps = brackets(what == GAP)
        left = np.ones(len(size), dtype=bool)
        left[pieces] = left[gaps] = False
        rest_pieces, rest_gaps = (np.flatnonzero(left & (what == x)) for x in (PIECE, GAP))
        at = np.concatenate([pieces, rest_pieces, rest_gaps])
        seq, free = np.full(len(at), -1, dtype=np.int64), np.zeros(len(at), dtype=np.int32)
        seq[: len(pieces)], free[: len(pieces)] = key[gaps], size[gaps]
        kinds = np.repeat(np.asarray([PAIR, PIECE, GAP], dtype=np.int8), [len(pieces), len(rest_pieces), len(rest_gaps)])
        idx = np.concatenate([np.zeros(len(pieces), dtype=np.int64), np.arange(len(rest_pieces)), np.arange(len(rest_gaps))])
        columns = [kinds, key[at], size[at].astype(np.int32), seq, free, np.full(len(at), part, dtype=np.int32), idx]
        for s in range(0, len(at), 1 << 16):
            some = [pa.array(c[s : s + (1 << 16)]) for c in columns]
            yield pa.RecordBatch.from_arrays([*some, pa.nulls(len(some[0]), pa.list_(pa.int64()))], names=names)
        sizes = size[rest_pieces]
        gap = max(size[rest_gaps].max(initial=0), (size[gaps] - size[pieces]).max(initial=0))
        summary = [len(pieces), len(rest_pieces), len(rest_gaps), sizes.sum(), sizes.min(initial=1 << 30), sizes.max(initial=0), gap]
        row = [[SUMMARY], [-1], [0], [-1], [0], [part], [-1], [[int(x) for x in summary]]]
        kinds = [pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=names)

    names = [x.split()[0] for x in SWEPT.split(", ")]
    order = [F.col("size").desc(), F.col("what").desc(), F.col("id")]  # a gap comes before a piece that fills it
    ranged = items.select("size", "what", "id").repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.mapInArrow(sweep, SWEPT))


def matched_runs(parts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Left-overs of ``(part, pieces, gaps)`` rows, matched across partitions.

    Runs ``(part of the pieces, first piece, part of the gaps, last gap, count)``: one
    piece after another takes one gap before another. Also, how many pieces of each
    partition are matched, the first ones.
    """
    runs, stack, served = [], [], {}
    for part, pieces, gaps in sorted(parts):
        first = 0
        while first < pieces and stack:
            of, free = stack.pop()
            k = min(free, pieces - first)
            runs.append((part, first, of, free - 1, k))
            first += k
            if free > k:
                stack.append((of, free - k))
        if first:
            served[part] = first
        if gaps:
            stack.append((part, gaps))
    return runs, served


def told(found: DataFrame, runs: list[tuple[int, int, int, int, int]], ranks: dict[int, int]) -> DataFrame:
    """``(what, id, size, pair, rank)`` of the rows left over.

    ``pair`` is a row's place in the runs, ``rank`` a waiting piece's place; -1 for none.

    ``ranks`` has the rank that the first piece of each partition would have. What is
    broadcast are a few numbers for each partition.
    """
    table = np.asarray(runs, dtype=np.int64).reshape(-1, 5)
    base = np.cumsum(table[:, 4]) - table[:, 4]
    part = np.asarray(sorted(ranks), dtype=np.int64)
    rank = np.asarray([ranks[p] for p in sorted(ranks)], dtype=np.int64)
    of_pieces = (table[:, 0], table[:, 1], table[:, 4], base)
    of_gaps = (table[:, 2], table[:, 3] - table[:, 4] + 1, table[:, 4], base)
    sent = found.sparkSession.sparkContext.broadcast((of_pieces, of_gaps, part, rank))

    def places(held: tuple, part: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run of each row, and its place from the run's start; run -1 for none."""
        order = np.lexsort((held[1], held[0]))
        of, first, count = (c[order] for c in held[:3])
        if not len(of):
            return np.full(len(idx), -1), idx
        at = np.searchsorted((of << 40) + first, (part << 40) + idx, side="right") - 1
        place = idx - first[at]
        return np.where((at >= 0) & (of[at] == part) & (place < count[at]), order[at], -1), place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_pieces, of_gaps, parts, firsts = sent.value
        for b in batches:
            what, part, idx = (b.column(i).to_numpy().astype(np.int64) for i in (0, 3, 4))
            pair = np.full(len(what), -1, dtype=np.int64)
            for kind, held in ((PIECE, of_pieces), (GAP, of_gaps)):
                mine = np.flatnonzero(what == kind)
                at, place = places(held, part[mine], idx[mine])
                hit = at >= 0
                mine, at, place = mine[hit], at[hit], place[hit]
                # pieces go up a run as gaps go down
                pair[mine] = held[3][at] + (place if kind == PIECE else held[2][at] - 1 - place)
            waits = (what == PIECE) & (pair < 0)
            rank = np.full(len(what), -1, dtype=np.int64)
            rank[waits] = firsts[np.searchsorted(parts, part[waits])] + idx[waits]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(pair), pa.array(rank)], names=["what", "id", "size", "pair", "rank"])

    left = found.where(F.col("what").isin(PIECE, GAP)).select("what", "id", "size", "part", "idx")
    return cut(left.mapInArrow(run, "what byte, id long, size int, pair long, rank long"))


def dealt(waiting: DataFrame, sequences: int, each: int, first: int) -> DataFrame:
    """``(id, size, seq, offset)``: the longest waiting pieces, by ``rank``, on new sequences back and forth."""
    turn, at = F.expr(f"rank div {sequences}"), F.col("rank") % sequences
    place = F.when(turn % 2 == 0, at).otherwise(sequences - 1 - at)
    before = Window.partitionBy("seq").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return cut(
        waiting.where(F.col("rank") < sequences * each)
        .select("id", "size", (-1 - first - place).alias("seq"), turn.alias("turn"))
        .withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .drop("turn")
    )


def dealt_here(key: np.ndarray, size: np.ndarray, sequences: int, each: int, first: int) -> tuple[np.ndarray, ...]:
    """As ``dealt``, of ranked pieces in arrays: ids, sequences, offsets, and the sequences' ids and tokens."""
    n = min(len(size), sequences * each)
    rank = np.arange(n)
    turn, at = np.divmod(rank, sequences)
    place = np.where(turn % 2 == 0, at, sequences - 1 - at)
    grid = np.zeros((-(-n // sequences), sequences), dtype=np.int64)
    grid[turn, place] = size[:n]
    total = grid.cumsum(axis=0)
    return key[:n], -1 - first - place, total[turn, place] - size[:n], -1 - first - np.arange(sequences), total[-1]


def rounds_here(size: np.ndarray, what: np.ndarray, key: np.ndarray, capacity: int, opened: int) -> tuple[np.ndarray, ...]:
    """``(id, seq, offset)`` of all waiting pieces: the rounds of ``best_fit`` over rows in arrays."""
    out: list[tuple] = [(np.zeros(0, dtype=np.int64),) * 3]
    while True:
        order = np.lexsort((key, -what, -size))  # as ``swept`` sorts
        size, what, key = size[order], what[order], key[order]
        pieces, gaps = brackets(what == GAP)
        out.append((key[pieces], key[gaps], capacity - size[gaps]))
        left = np.ones(len(size), dtype=bool)
        left[pieces] = left[gaps] = False
        rest, free = np.flatnonzero(left & (what == PIECE)), np.flatnonzero(left & (what == GAP))
        if not len(rest):
            return tuple(np.concatenate(c) for c in zip(*out))
        ids, sizes = key[rest], size[rest]
        seq, room = np.concatenate([key[free], key[gaps]]), np.concatenate([size[free], size[gaps] - size[pieces]])
        if len(pieces) <= RARE * len(rest) or room.max(initial=0) < sizes[-1]:
            sequences, each = int(-(-sizes.sum() // capacity)), int(max(1, capacity // sizes[0] - 2))
            *new, more, total = dealt_here(ids, sizes, sequences, each, opened)
            out.append(tuple(new))
            opened += sequences
            ids, sizes = ids[len(new[0]) :], sizes[len(new[0]) :]
            seq, room = np.concatenate([seq, more]), np.concatenate([room, capacity - total])
        serves = room >= max(1, sizes[-1] if len(sizes) else capacity)
        size, key = np.concatenate([sizes, room[serves]]), np.concatenate([ids, seq[serves]])
        what = np.repeat(np.asarray([PIECE, GAP]), [len(sizes), int(serves.sum())])


def finished(items: DataFrame, capacity: int, opened: int) -> DataFrame:
    """``(id, seq, offset)`` of all waiting pieces, from one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns] for b in batches if b.num_rows]
        if held:
            found = rounds_here(*(np.concatenate(c) for c in zip(*held)), capacity, opened)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "seq", "offset"])

    return cut(items.select("size", "what", "id").repartition(1).mapInArrow(run, "id long, seq long, offset long"))


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, length_column: str = "length") -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``.

    Sent to the driver, and back as a broadcast: a few numbers for each range partition
    of a round.
    """
    row, seq, offset = (unused(pieces, x) for x in ("_row", "_seq", "_offset"))
    keyed = cut(pieces.withColumn(row, F.monotonically_increasing_id()))
    n = F.col(length_column)
    opener = 2 * n > capacity
    empty = keyed.sparkSession.createDataFrame([], "id long, seq long, offset long")
    gaps = keyed.where(opener & (n < capacity)).select(F.col(row).alias("id"), (capacity - n).cast("int").alias("size"))
    waiting = keyed.where(~opener).select(F.col(row).alias("id"), n.cast("int").alias("size"))
    placed, opened = [empty], 0
    count = keyed.where(~opener | (n < capacity)).count()
    while True:
        if count <= ONE_TASK:
            placed.append(finished(_items(waiting, gaps), capacity, opened))
            break
        found = swept(_items(waiting, gaps))
        seen = {r.part: r.summary for r in found.where(F.col("what") == SUMMARY).select("part", "summary").collect()}
        runs, served = matched_runs([(part, x[1], x[2]) for part, x in seen.items()])
        ranks, left = {}, 0
        for part in sorted(seen):
            ranks[part] = left - served.get(part, 0)
            left += seen[part][1] - served.get(part, 0)
        rows = told(found, runs, ranks)
        pairs = found.where(F.col("what") == PAIR).select("id", "size", "seq", "free")
        across = rows.where("pair >= 0")
        these = across.where(F.col("what") == PIECE).select("pair", "id", "size")
        those = across.where(F.col("what") == GAP).select("pair", F.col("id").alias("seq"), F.col("size").alias("free"))
        if runs:
            pairs = pairs.union(cut(these.join(those, "pair").drop("pair")))
        placed.append(pairs.select("id", "seq", (capacity - F.col("free")).cast("long")))
        if not left:
            break
        # the first pieces of a partition are served, so its least one waits if any does
        holds = [x for part, x in seen.items() if x[1] > served.get(part, 0)]
        least, longest = min(x[4] for x in holds), max(x[5] for x in holds)
        ranked = rows.where("rank >= 0")
        gaps = rows.where((F.col("what") == GAP) & (F.col("pair") < 0)).select("id", "size")
        gaps = gaps.union(pairs.select("seq", (F.col("free") - F.col("size")).cast("int"))).where(F.col("size") >= least)
        waiting = ranked
        n_pairs = sum(x[0] for x in seen.values()) + sum(r[-1] for r in runs)
        # (nearly) no gap serves any more: as good as all that are left are too small
        if n_pairs <= RARE * left or max(x[6] for x in seen.values()) < least:
            tokens = ranked.agg(F.sum("size")).first()[0] if runs else sum(x[3] for x in holds)
            sequences, each = -(-tokens // capacity), max(1, capacity // longest - 2)
            new = dealt(ranked, sequences, each, opened)
            opened += sequences
            placed.append(new.select("id", "seq", "offset"))
            used = new.groupBy("seq").agg((capacity - F.sum("size")).cast("int").alias("size")).where("size > 0")
            gaps = gaps.union(used.select(F.col("seq").alias("id"), "size"))
            waiting = ranked.where(F.col("rank") >= sequences * each)
        waiting, gaps = waiting.select("id", "size"), gaps.select("id", "size")
        count = _items(waiting, gaps).count()
    own = keyed.where(opener).withColumns({seq: F.col(row), offset: F.lit(0).cast("long")})
    rest = reduce(DataFrame.union, placed).toDF(row, seq, offset)
    rest = keyed.where(~opener).join(rest, row)
    columns = [F.col(c) for c in pieces.columns]
    return own.unionByName(rest).select(*columns, F.col(seq).alias("sequence_id"), F.col(offset).alias("offset"))


def _items(waiting: DataFrame, gaps: DataFrame) -> DataFrame:
    what = lambda df, kind: df.withColumn("what", F.lit(kind).cast("byte"))
    return what(waiting, PIECE).unionByName(what(gaps, GAP))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, **columns) -> DataFrame:
    """Pieces of all documents with their place in packed sequences."""
    return best_fit(token_pieces(docs, path, capacity, **columns), capacity)
