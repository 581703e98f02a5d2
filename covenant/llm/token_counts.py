"""Token counts by prefix dynamic programming.

For a byte-level BPE vocabulary, the encoding of a string's first ``i`` bytes
ends in exactly one token ``t`` such that the encoding of the bytes before it
ends in a token compatible with ``t``: the library would leave the two side by
side. So ``count[i] = count[i - len(t)] + 1``, and one pass fills a table with
the exact count of every prefix. Tables are kept per pre-token; a text's table is
their running sum. Budget and truncation questions are then lookups: the longest
prefix within a budget is sought in the running sum of the pre-tokens, and then in the
table of the few characters where the budget runs out.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
give repeated rows; only the id and text columns are read, so further columns,
whatever their names, change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import text_chunks

#: Remembered tables, last entries alone, and pairs of neighbouring tokens, per worker.
TABLES = 50_000
TOTALS = 800_000
PAIRS = 400_000
CONTRACTIONS = {"'re", "'ve", "'ll"}


class PrefixCounter:
    """Exact token counts of all prefixes, from the merges of a vocabulary."""

    def __init__(self, path: str):
        self.words = bpe.vocabulary(path)
        if not self.words.byte_level:
            raise ValueError("prefix tables need a byte-level vocabulary")
        self.ids, self.joins = self.words.ids, self.words.joins
        #: of each merged token, the two tokens that its last merge joined
        self.halves = {i: pair for pair, i in self.joins.items()}
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.tables: dict[str, list[int]] = {}
        self.totals: dict[str, int] = {}

    def beside(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of two tokens is those two tokens.

        It isn't if some merge across the border comes before one that either
        token still needs. Ids are in merge order, so both tokens are undone from
        their latest merge backwards, the border's neighbours followed, and each
        merge across the border compared with the one just undone.
        """
        joins, halves = self.joins, self.halves
        undone = 1 << 40
        while True:
            across = joins.get((a, b))
            if across is not None and across < undone:
                return False
            # a merge of the right token ties with one across it: the left one goes first
            if a in halves and (a > b or b not in halves):
                undone, a = a, halves[a][1]
            elif b in halves:
                undone, b = b + 1, halves[b][0]
            else:
                return True

    def byte_table(self, word: bytes) -> list[int]:
        """Counts of the prefixes of 0, 1, ... bytes of one pre-token."""
        counts, last = [0], [-1]
        ids, pairs, longest = self.ids, self.pairs, self.longest
        for i in range(1, len(word) + 1):
            for j in range(i - 1, max(i - longest, 0) - 1, -1):  # one token fits; short ones are likelier
                t = ids.get(word[j:i])
                if t is None:
                    continue
                if j:
                    key = (last[j], t)
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.beside(*key)
                    if not fits:
                        continue
                counts.append(counts[j] + 1)
                last.append(t)
                break
        return counts

    def table(self, piece: str) -> list[int]:
        """Counts of the prefixes of 0, 1, ... characters of one pre-token."""
        found = self.tables.get(piece)
        if found is None:
            counts = self.byte_table(bpe.utf8(piece))
            found = counts
            if not piece.isascii():
                at, found = 0, [0]
                for c in piece:
                    at += len(bpe.utf8(c))
                    found.append(counts[at])
            if len(piece) <= bpe.LONG:
                if len(self.tables) >= TABLES:
                    self.tables.clear()
                self.tables[piece] = found
        return found

    def total(self, piece: str) -> int:
        """The last entry of a pre-token's table; only that is remembered."""
        found = self.totals.get(piece)
        if found is None:
            found = self.byte_table(bpe.utf8(piece))[-1]
            if len(piece) <= bpe.LONG:
                if len(self.totals) >= TOTALS:
                    self.totals.clear()
                self.totals[piece] = found
        return found

    def _totals(self, part: str) -> tuple[list[str], list[int]]:
        """Pre-tokens of a segment without special strings, and their counts."""
        pieces, get = bpe.split(part), self.totals.get
        found = [get(x) for x in pieces]
        if None in found:
            found = [self.total(x) if f is None else f for x, f in zip(pieces, found)]
        return pieces, found

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(1 if x in self.words.special else sum(self._totals(x)[1]) for x in self.words.segments(text))

    def answers(self, text: str, budget: int) -> tuple[int, int, int]:
        """Tokens of the text, characters of its longest prefix within the budget, and its tokens."""
        segments = self.words.segments(text)
        if len(segments) > 1 or segments[0] in self.words.special:
            counts = self.prefixes(text)
            n = int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0
            return int(counts[-1]), n, int(counts[n])
        pieces, found = self._totals(text)
        total = sum(found)
        if total <= budget:
            return total, len(text), total
        if budget < 0:
            return total, 0, 0
        sums = np.cumsum(found)
        over = int(np.searchsorted(sums, budget, side="right"))
        # a prefix that ends in a pre-token without spaces counts as the table says; from one to the next
        # such end, both borders included, the few characters between are looked at one by one
        first = over
        while first and pieces[first - 1][-1] in bpe.SPACES:
            first -= 1
        last = over
        while last + 1 < len(pieces) and pieces[last][-1] in bpe.SPACES:
            last += 1
        base = int(sums[first - 1]) if first else 0
        counts = base + self.prefixes("".join(pieces[first : last + 1]))
        n = int(np.flatnonzero(counts <= budget)[-1])
        return total, sum(map(len, pieces[:first])) + n, int(counts[n])

    def _tail(self, tail: str) -> int:
        return sum(self.table(x)[-1] for x in bpe.split(tail))

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ... characters of a text.

        A prefix that ends inside a run of white space, or inside a contraction,
        splits otherwise than the whole text does there; those few tails are
        split anew. A prefix that ends inside a special string is too, from the
        segment's start.
        """
        out, base, at = [0], 0, 0
        segments = self.words.segments(text)
        for k, part in enumerate(segments):
            if part in self.words.special:
                before = segments[k - 1] if k and segments[k - 1] not in self.words.special else ""
                known = base - self.count(before)
                out += [known + self.count(before + part[:j]) for j in range(1, len(part))]
                base += 1
                out.append(base)
                continue
            pieces, i = bpe.split(part), 0
            while i < len(pieces):
                piece = pieces[i]
                if piece[0] in bpe.SPACES and piece[-1] in bpe.SPACES:
                    run = []
                    while i < len(pieces) and pieces[i][-1] in bpe.SPACES:
                        run.append(pieces[i])
                        i += 1
                    joined = "".join(run)
                    # a following word takes the last space of the run with it
                    lead = i < len(pieces) and pieces[i][0] == " "
                    inner = self._space_table(joined + " " if lead else joined)
                    out += [base + c for c in inner[1 : len(joined) + 1]]
                    base += sum(self.table(x)[-1] for x in run)
                    if lead:
                        word = self.table(pieces[i])
                        out.append(base - sum(self.table(x)[-1] for x in run) + inner[len(joined) + 1])
                        out += [base + c for c in word[2:]]
                        base += word[-1]
                        i += 1
                    continue
                if piece in CONTRACTIONS:
                    out += [base + self._tail(piece[:j]) for j in range(1, len(piece) + 1)]
                else:
                    out += [base + c for c in self.table(piece)[1:]]
                base += self.table(piece)[-1]
                i += 1
            at += len(part)
        return np.asarray(out, dtype=np.int32)

    def _space_table(self, run: str) -> list[int]:
        """Counts of the prefixes of white space, each of which is one pre-token."""
        return self.table(run)

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return self.answers(text, budget)[1] if text else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    budget: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, fit_chars, fit_tokens)`` of every whole text.

    The last two are the characters of the longest prefix within the budget and its
    tokens; null for vocabularies without prefix tables.
    """
    path = path or bpe.default_path()
    byte_level = bpe.vocabulary(path).byte_level if path.endswith(".json") else False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if byte_level:
            table = counter(path)
            answer = lambda t: table.answers(t, budget) if t else (0, 0, 0)
        else:
            count = _library_count(path)
            answer = lambda t: (count(t) if t else 0, None, None)
        for b in text_chunks(batches):
            texts = b.column(1).to_pylist()
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            counts, chars, tokens = zip(*map(answer, texts)) if texts else ((), (), ())
            counts = np.asarray(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), sizes, pa.array(counts), pa.array(counts > budget), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())],
                names=["id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "fit_tokens"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return (
        docs.select(F.col(id_column), F.col(text_column))
        .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, fit_tokens long")
        .withColumnRenamed("id", id_column)
    )


def _library_count(path: str):
    """Counts for vocabularies that have no byte-level merges."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    words = bpe.vocabulary(path)
    return lambda text: len(words.encode(text))


def prefix_tables(
    docs: DataFrame,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, counts array<int>)``: the count of every prefix, by characters.

    Element ``i`` is the number of tokens of the first ``i`` characters.
    """
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for b in text_chunks(batches, limit=1 << 19):
            rows = [table.prefixes(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows, type=pa.list_(pa.int32()))], names=["id", "counts"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return (
        docs.select(F.col(id_column), F.col(text_column))
        .mapInArrow(run, f"id {kind}, counts array<int>")
        .withColumnRenamed("id", id_column)
    )


def truncated(
    docs: DataFrame,
    budget: int,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, text, n_tokens)``: the longest prefix within the budget."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for b in text_chunks(batches, limit=1 << 20):
            texts, counts = [], []
            for t in b.column(1).to_pylist():
                _, n, tokens = table.answers(t, budget) if t else (0, 0, 0)
                texts.append((t or "")[:n])
                counts.append(tokens)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                names=["id", "text", "n_tokens"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return (
        docs.select(F.col(id_column), F.col(text_column))
        .mapInArrow(run, f"id {kind}, text string, n_tokens long")
        .withColumnRenamed("id", id_column)
    )
