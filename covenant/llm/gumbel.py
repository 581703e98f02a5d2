"""SentencePiece segmentations sampled without replacement by Gumbel top-k.

All segmentations of a text form a lattice over its characters, and each has a
probability: the product of its pieces' weights, divided by the sum over the
lattice. Adding independent Gumbel noise to all log-probabilities and keeping the
``k`` highest is sampling ``k`` different segmentations without replacement. A
perturbed A-star search finds them without listing any: a forward pass gives the
exact mass behind every partial segmentation, which is its heuristic; the highest
perturbed value below a node is Gumbel distributed about the log of its mass, cut
off at its parent's; the child that holds the parent's maximum inherits it. So the
search walks straight down to the first sample, and all it leaves beside the path
are branches (the same prefix, another piece here), whose maxima are drawn at once.
The highest of them is where the next sample leaves the earlier ones, and so on.

Pieces never span certain borders (between words, around characters that occur in
no longer piece), so the lattice of a text is a chain of small lattices. Those are
kept in a cache, forward pass included, and the walks of all texts of a batch go
in step as array operations.

Each sample carries its log-probability, its perturbed value, and its inclusion
score: the logarithm of the chance that its value passes the ``k+1``-th, which is
what unbiased estimates over the samples divide by. All noise is a hash of the
row's key, the seed and a counter, so a row has the same samples in any partition.

Weights: a unigram model's own scores; a BPE model has ranks for scores, and a
piece of rank r then weighs 1 / (r + ``RANK_SHIFT``) (Zipf's law). ``alpha``
multiplies log-weights. A character without a piece is its bytes (or the unknown
piece), at a weight below all others.

Defined results: a null or empty text has one sample without pieces; a text with
fewer than k segmentations has as many samples as there are, and then inclusion
scores of 0 (certain); repeated rows give repeated rows; equal keys with equal
texts have equal samples; further columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path
from .common import text_chunks

#: The production parameters.
K, ALPHA, SEED = 2, 1.0, 17
RANK_SHIFT = 10.0
#: Log-weight of a character without a piece, below that of the last piece.
UNKNOWN_PENALTY = 5.0
#: Small lattices that a worker remembers, and the longest that are made together.
CACHE, SHORT = 220_000, 40
#: Branches of less mass than this are summed edge by edge, as 1 - p would lose digits.
THIN = 1e-6
#: Steps after which a walk takes a new random number.
FRESH = 10
MODEL = "piece_bpe_32k.model"

#: Kinds of characters: in longer pieces, the word mark, in no longer piece.
INNER, SPACE, ALONE = 0, 1, 2

_M1, _M2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit counters (splitmix)."""
    x = x * _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def uniform(key: np.ndarray, stream: int, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) for keys (unsigned 64 bits), a stream and counters."""
    with np.errstate(over="ignore"):
        at = mixed(key + np.uint64(stream) * _M2) + counter.astype(np.uint64)
        return ((mixed(at) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Starts:
    """Start states by the two hashes of a chunk, in a table that arrays are looked up in."""

    def __init__(self, most: int):
        self.slots = 1 << (2 * most).bit_length()
        self.clear()

    def clear(self) -> None:
        self.key, self.check = (np.zeros(self.slots, dtype=np.uint64) for _ in range(2))
        self.state = np.full(self.slots, -1, dtype=np.int32)
        self.held = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * _GOLD) >> np.uint64(32)).astype(np.int64) & (self.slots - 1)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The states; -1 for a chunk that isn't there."""
        at = self._slot(key)
        out = self.state[at]
        on = np.flatnonzero((out >= 0) & ((self.key[at] != key) | (self.check[at] != check)))
        while len(on):
            at[on] = (at[on] + 1) & (self.slots - 1)
            here = at[on]
            out[on] = self.state[here]
            on = on[(out[on] >= 0) & ((self.key[here] != key[on]) | (self.check[here] != check[on]))]
        return out

    def put(self, key: np.ndarray, check: np.ndarray, state: np.ndarray) -> None:
        """Keys that aren't there, each once."""
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.state[at[left]] < 0]
            self.state[at[free]] = state[free]  # of several for one slot the last stays
            done = free[self.state[at[free]] == state[free]]
            self.key[at[done]], self.check[at[done]] = key[done], check[done]
            left = np.setdiff1d(left, done, assume_unique=True)
            at[left] = (at[left] + 1) & (self.slots - 1)
        self.held += len(key)


@dataclass
class Chunks:
    """The chunks of a batch of texts, as places in its characters."""

    chars: np.ndarray
    heads: np.ndarray
    lengths: np.ndarray
    #: how many chunks each text has
    of_text: np.ndarray

    def text(self, i: int) -> str:
        return "".join(map(chr, self.chars[self.heads[i] : self.heads[i] + self.lengths[i]].tolist()))


class Lattices:
    """The small lattices of a model, in arrays that walks index.

    A state is a place in a chunk's lattice, reached from its end; its edges are the
    pieces that may end there, each with its probability, the state before it and its
    id. A chunk's start is a state without edges.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        scores = [m.get_score(i) for i in plain]
        by_rank = all(s == round(s) for s in scores)  # BPE keeps ranks
        low = min((s for s in scores if s > -1e8), default=0.0)
        log = lambda s: -math.log(RANK_SHIFT - max(s, low)) if by_rank else s
        weights = {m.id_to_piece(i): log(s) * alpha for i, s in zip(plain, scores)}
        self.unknown = math.exp(min(weights.values(), default=0.0) - UNKNOWN_PENALTY)
        self.pieces = {p: (math.exp(w), m.piece_to_id(p)) for p, w in weights.items()}
        self.longest = max(map(len, self.pieces), default=1)
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(m.is_byte(i) for i in self.bytes)
        spanning = re.compile("[^▁]▁")
        joined = {c for p in self.pieces if len(p) > 1 for c in p} - {"▁"}
        #: no border is safe if a piece goes on after its word's end
        self.whole = any(spanning.search(p) for p in self.pieces)
        self.kind = np.full(0x110000, ALONE, dtype=np.uint8)
        self.kind[[ord(c) for c in joined]] = INNER
        self.kind[ord("▁")] = SPACE if joined else ALONE
        self._plant()
        self._known = Starts(CACHE)
        #: several ids for one character, known by negative numbers
        self.groups: list[tuple[int, ...]] = []
        self.group_of: dict[str, int] = {}
        self.clear()

    def _plant(self) -> None:
        """The pieces as a trie: children in a hash table that arrays are looked up in."""
        node_of, weight, ids = {"": 0}, [0.0], [-1]
        for p in self.pieces:
            for n in range(1, len(p) + 1):
                if p[:n] not in node_of:
                    node_of[p[:n]] = len(weight)
                    w, i = self.pieces.get(p[:n], (0.0, -1))
                    weight.append(w)
                    ids.append(i)
        self.node_weight, self.node_id = np.asarray(weight), np.asarray(ids, dtype=np.int32)
        keys = np.asarray([node_of[p[:-1]] << 21 | ord(p[-1]) for p in node_of if p], dtype=np.int64)
        children = np.asarray([n for p, n in node_of.items() if p], dtype=np.int32)
        self.slots = 1 << (4 * max(len(keys), 1)).bit_length()
        self.slot_key, self.slot_child = np.full(self.slots, -1, dtype=np.int64), np.zeros(self.slots, dtype=np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_key[at[left]] < 0
            put = left[free]
            self.slot_key[at[put]] = keys[put]  # of several for one slot the last stays
            done = self.slot_key[at[left]] == keys[left]
            self.slot_child[at[left[done]]] = children[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & (self.slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _GOLD) >> np.uint64(40)).astype(np.int64) & (self.slots - 1)

    def _child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Children by characters; 0 for none."""
        key = node.astype(np.int64) << 21 | char
        at = self._slot(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_child[at], 0)
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (self.slots - 1)
            held = self.slot_key[at[on]]
            hit = held == key[on]
            out[on[hit]] = self.slot_child[at[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out

    def clear(self) -> None:
        self._known.clear()
        self.q = np.zeros(1 << 16)
        self.before = np.zeros(1 << 16, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        #: of each state its first edge; the next state's first edge ends them
        self.first = np.zeros(1 << 15, dtype=np.int32)
        self.n_edges = self.n_states = 0
        self.mark: tuple[int, int] | None = None

    def _spelled(self, c: str) -> int:
        """The id of a character's single token, or the number of its group of ids."""
        if c not in self.group_of:
            raw = c.encode("utf-8", "replace")
            ids = tuple(self.bytes[b] for b in raw) if self.has_bytes else (self.model.unk_id(),)
            if len(ids) == 1:
                self.group_of[c] = ids[0]
            else:
                self.groups.append(ids)
                self.group_of[c] = -len(self.groups)
        return self.group_of[c]

    def _add(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The forward passes of many chunks, all of them a character further at a time.

        ``chars`` are their characters, chunk by chunk. Returns their start states.
        """
        chars = chars.astype(np.int64)
        total, start = len(chars), np.cumsum(sizes) - sizes
        room = np.repeat(start + sizes, sizes) - np.arange(total)  # characters up to the chunk's end
        # edges: pieces walked down the trie from every place at once
        begins, lengths, weights, ids = [], [], [], []
        at, node = np.arange(total), np.zeros(total, dtype=np.int32)
        for n in range(1, self.longest + 1):
            node = self._child(node, chars[at + n - 1])
            on = np.flatnonzero(node)
            if n == 1:
                lone = np.setdiff1d(at, at[on[self.node_id[node[on]] >= 0]], assume_unique=True)
                if len(lone):  # characters without a piece
                    begins.append(lone)
                    lengths.append(np.ones(len(lone), dtype=np.int64))
                    weights.append(np.full(len(lone), self.unknown))
                    ids.append(np.asarray([self._spelled(chr(c)) for c in chars[lone].tolist()], dtype=np.int32))
            at, node = at[on], node[on]
            ends = np.flatnonzero(self.node_id[node] >= 0)
            begins.append(at[ends])
            lengths.append(np.full(len(ends), n))
            weights.append(self.node_weight[node[ends]])
            ids.append(self.node_id[node[ends]])
            on = np.flatnonzero(room[at] > n)
            at, node = at[on], node[on]
            if not len(at):
                break
        # longest first: a state's likeliest edges come early
        begin, length, weight, id_ = (np.concatenate(x[::-1]) for x in (begins, lengths, weights, ids))
        end = begin + length
        # a state for each place of a chunk, from its start (no edge) to its end
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        shift = chunk[begin]
        begin, end = begin + shift, end + shift
        depth = end - (start + np.arange(len(sizes)))[shift]
        order = np.argsort(depth * np.int64(total + len(sizes)) + end, kind="stable")
        begin, end, weight, depth = begin[order], end[order], weight[order], depth[order]
        heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        mass = np.ones(total + len(sizes))
        levels = np.searchsorted(depth, np.arange(1, int(sizes.max()) + 2))
        scale = weight.copy()
        for lo, hi in zip(levels, levels[1:]):
            scale[lo:hi] *= mass[begin[lo:hi]]
            own = heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)]
            mass[end[own]] = np.add.reduceat(scale[lo:hi], own - lo)
        q = scale / mass[end]
        count = np.diff(np.append(heads, len(end)))
        q[np.repeat(count, count) == 1] = 1.0
        # edges in the order of their states
        by_state = np.argsort(end, kind="stable")
        n_edges = np.bincount(end, minlength=total + len(sizes))
        self._put(q[by_state], begin[by_state], id_[order][by_state], n_edges)
        ends = start + sizes + np.arange(len(sizes))
        base = self.n_states - total - len(sizes)
        return (ends + base).astype(np.int32)

    def _add_long(self, chunk: str) -> int:
        """The forward pass of one long chunk, place by place.

        Masses are kept relative to a place nearby, as they'd leave the range of doubles.
        """
        n, get, longest = len(chunk), self.pieces.get, self.longest
        mass, q, before, ids, counts = [1.0], [], [], [], [0]
        for i in range(1, n + 1):
            found = []
            for j in range(i - longest if i > longest else 0, i):
                hit = get(chunk[j:i])
                if hit is not None:
                    found.append((mass[j] * hit[0], j, hit[1]))
            if chunk[i - 1] not in self.pieces:
                found.append((mass[i - 1] * self.unknown, i - 1, self._spelled(chunk[i - 1])))
            total = sum(f[0] for f in found)
            q += [f[0] / total for f in found] if len(found) > 1 else [1.0]
            before += [f[1] for f in found]
            ids += [f[2] for f in found]
            counts.append(len(found))
            mass.append(total)
            if total < 1e-200:  # only the last ``longest`` places are looked at again
                low = max(0, i + 1 - longest)
                mass[low:] = [x / total for x in mass[low:]]
        self._put(np.asarray(q), np.asarray(before), np.asarray(ids, dtype=np.int32), np.asarray(counts))
        return self.n_states - 1

    def _put(self, q: np.ndarray, before: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Appends states with ``counts`` edges; ``before`` counts from the first of them."""

        def put(array: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
            if at + len(new) > len(array):
                array = np.concatenate([array, np.zeros(max(len(array) // 2, at + len(new) - len(array)), array.dtype)])
            array[at : at + len(new)] = new
            return array

        e, s = self.n_edges, self.n_states
        self.q, self.before, self.ids = put(self.q, e, q), put(self.before, e, before + s), put(self.ids, e, ids)
        self.n_edges, self.n_states = e + len(q), s + len(counts)
        self.first = put(self.first, s, np.concatenate([[e], e + np.cumsum(counts)]))

    def chunks(self, texts: list[str | None]) -> Chunks:
        """All texts cut at the borders that no piece spans."""
        normal = [self.model.normalize(t) if t else "" for t in texts]
        chars = np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.asarray([len(t) for t in normal], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        if self.whole:
            new = np.zeros(len(chars), dtype=bool)
        else:
            # runs of word marks lead a run of inner characters; all else stands alone
            kind = self.kind[chars]
            new = kind == ALONE
            new[1:] |= (kind[:-1] == ALONE) | ((kind[1:] == SPACE) & (kind[:-1] != SPACE))
        new[first[sizes > 0]] = True
        heads = np.flatnonzero(new)
        of_text = np.searchsorted(heads, first + sizes) - np.searchsorted(heads, first)
        return Chunks(chars, heads, np.diff(np.append(heads, len(chars))), of_text)

    def starts(self, found: Chunks) -> np.ndarray:
        """Start states of all chunks; new ones are added.

        What no longer fits in the cache is made for this batch alone, and forgotten
        by :meth:`forget`.
        """
        if not len(found.heads):
            return np.zeros(0, dtype=np.int32)
        place = np.arange(len(found.chars)) - np.repeat(found.heads, found.lengths)
        most = int(found.lengths.max())
        chars = found.chars.astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            key, check = (
                np.add.reduceat(chars * mixed(np.arange(most, dtype=np.uint64) + np.uint64(salt))[place], found.heads)
                for salt in (1 << 32, 1 << 33)
            )
        state = self._known.find(key, check)
        missing = np.flatnonzero(state < 0)
        if not len(missing):
            return state
        _, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
        if self._known.held + len(first) > CACHE and 2 * len(missing) > len(state):
            # other texts than those that filled the cache
            self.clear()
            missing = np.arange(len(state))
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
        keep = self._known.held + len(first) <= CACHE
        state[missing] = self._made(found, key, check, missing[first], keep)[back]
        return state

    def _made(self, found: Chunks, key: np.ndarray, check: np.ndarray, new: np.ndarray, keep: bool) -> np.ndarray:
        """Start states of the chunks of the numbers ``new``, which aren't there yet."""
        mark = self.n_edges, self.n_states
        order = np.argsort(found.lengths[new], kind="stable")
        lengths = found.lengths[new[order]]
        out = np.empty(len(new), dtype=np.int32)
        n = int(np.searchsorted(lengths, SHORT, side="right"))
        if n:
            sizes = lengths[:n]
            shift = np.repeat(found.heads[new[order[:n]]] - (np.cumsum(sizes) - sizes), sizes)
            out[order[:n]] = self._add(found.chars[np.arange(len(shift)) + shift], sizes)
        for i in order[n:].tolist():
            out[i] = self._add_long(found.text(int(new[i])))
        if keep:
            self._known.put(key[new], check[new], out)
        else:
            self.mark = mark
        return out

    def forget(self) -> None:
        """Drops what was made for one batch alone."""
        if self.mark is not None:
            self.n_edges, self.n_states = self.mark
            self.mark = None

    def walk(self, state: np.ndarray, key: np.ndarray, stream: int, counter: np.ndarray):
        """Steps from the states to their chunks' starts, by random choice.

        Returns the walks' numbers, states and edges, ordered by walk, then step.
        """
        who, states, edges, step = [], [], [], 0
        at = np.arange(len(state))
        rest = None
        while len(at):
            if step % FRESH == 0:
                rest = uniform(key[at], stream, counter[at] * np.uint64(1 << 16) + np.uint64(step // FRESH))
            e, last = self.first[state], self.first[state + 1] - 1
            p = self.q[e]
            go = np.flatnonzero((rest >= p) & (e < last))
            while len(go):
                rest[go] -= p[go]
                e[go] += 1
                p[go] = self.q[e[go]]
                go = go[(rest[go] >= p[go]) & (e[go] < last[go])]
            who.append(at)
            states.append(state)
            edges.append(e)
            rest = np.minimum(rest / p, 1 - 2.0**-53)
            state = self.before[e]
            on = np.flatnonzero(self.first[state] < self.first[state + 1])
            at, state, rest = at[on], state[on], rest[on]
            step += 1
        if not who:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        # every walk's steps are put side by side: those still going at a step are fewer each time
        sizes = np.zeros(len(who[0]), dtype=np.int64)
        for at in who:
            sizes[at] += 1
        head = np.cumsum(sizes) - sizes
        out_states, out_edges = np.empty(int(sizes.sum()), dtype=np.int32), np.empty(int(sizes.sum()), dtype=np.int32)
        for step, (at, state, e) in enumerate(zip(who, states, edges)):
            out_states[head[at] + step] = state
            out_edges[head[at] + step] = e
        return np.repeat(np.arange(len(sizes)), sizes), out_states, out_edges

    def tokens(self, edges: list[np.ndarray], chunks: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of many walks in the order of their texts; ``chunks`` tell the edges' chunks, ascending."""
        sizes = np.asarray([len(e) for e in edges])
        if not sizes.sum():
            return [np.zeros(0, dtype="<u4") for _ in edges]
        ids, chunk = self.ids[np.concatenate(edges)], np.concatenate(chunks)
        new = np.concatenate([[True], chunk[1:] != chunk[:-1]])
        new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(ids)) - 1
        ids = ids[np.repeat(heads + tails, tails - heads + 1) - np.arange(len(ids))]  # a walk goes from a chunk's end
        ends = np.cumsum(sizes)
        negative = np.flatnonzero(ids < 0)
        if len(negative):
            wide = np.ones(len(ids), dtype=np.int64)
            groups = [self.groups[-i - 1] for i in ids[negative].tolist()]
            wide[negative] = [len(g) for g in groups]
            at = np.cumsum(wide)
            spread = np.repeat(ids, wide)
            for last, g in zip(at[negative], groups):
                spread[last - len(g) : last] = g
            ends = np.concatenate([[0], at])[ends]
            ids = spread
        return np.split(ids.astype("<u4"), ends[:-1])


class Sample:
    """One segmentation of a text: its steps, and what the search knows of it."""

    __slots__ = ("states", "edges", "chunk", "value", "branches", "fixed")

    def __init__(self, states, edges, chunk, value, branches, fixed):
        self.states, self.edges, self.chunk = states, edges, chunk
        self.value = value  # the perturbed log-probability
        self.branches = branches  # perturbed maxima beside each step
        self.fixed = fixed  # step: edges taken there by this and earlier samples


def _beside(lattices: Lattices, states: np.ndarray, edges: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The mass of a state's other edges, for each step; thin ones summed edge by edge."""
    beside = 1.0 - p
    thin = np.flatnonzero((beside < THIN) & (p < 1.0))
    if len(thin):
        first = lattices.first[states[thin]]
        count = lattices.first[states[thin] + 1] - first
        heads = np.cumsum(count) - count
        all_edges = np.arange(int(count.sum())) + np.repeat(first - heads, count)
        q = np.where(all_edges == np.repeat(edges[thin], count), 0.0, lattices.q[all_edges])
        beside[thin] = np.add.reduceat(q, heads)
    return beside


def _branch_values(lattices, states, edges, owner, heads, key, stream, limit, floor, left):
    """Perturbed maxima of what lies beside each step.

    ``owner`` numbers the texts, ``heads`` are their first steps, ``limit`` their
    perturbed values; steps before ``floor`` belong to earlier samples. ``left`` is
    the mass that no sample has used yet at the first open step, negative if that's all.
    """
    n = len(edges)
    p = lattices.q[edges]
    log_p = np.log(p)
    before = np.empty(n)
    for s, e in zip(heads, [*heads[1:], n]):  # a text's sums don't depend on its neighbours in the batch
        np.cumsum(log_p[s:e], out=before[s:e])
    before -= log_p
    beside = _beside(lattices, states, edges, p)
    held = np.flatnonzero(left >= 0)
    at = heads[held] + floor[held]
    beside[at] = left[held]
    if floor.any():
        place = np.arange(n) - heads[owner]
        beside[place < floor[owner]] = 0.0
    else:
        place = np.arange(n) - heads[owner]
    on = np.flatnonzero(beside)  # most steps have no other edge
    own = owner[on]
    phi = before[on] + np.log(beside[on])
    e = -np.log(uniform(key[own], stream, place[on]))
    value = np.full(n, -np.inf)
    value[on] = phi - np.log(np.exp(np.minimum(phi - limit[own], 700)) + e)
    return value


def sample_batch(lattices: Lattices, texts: list[str | None], keys: np.ndarray, k: int = K) -> list[list[tuple]]:
    """For each text its samples: ``(ids, log_prob, perturbed, log_inclusion)``."""
    cut = lattices.chunks(texts)
    sizes = cut.of_text
    ends = np.cumsum(sizes)
    starts = lattices.starts(cut)
    n = len(texts)
    gumbel = -np.log(-np.log(uniform(keys, 0, np.zeros(n))))
    found: list[list[Sample]] = [[] for _ in range(n)]
    # where each text's next sample leaves an earlier one: sample, step, fixed edges, mass left there
    leaves: list[tuple] = [()] * n
    live = np.arange(n)
    value = gumbel.copy()
    for r in range(k):
        if not len(live):
            break
        if r == 0:
            state, owner = starts, np.repeat(live, sizes)
            chunk = np.arange(len(starts)) - np.repeat(ends - sizes, sizes)
        else:
            state, owner, chunk = _tails(lattices, live, leaves, starts, sizes, ends)
        who, states, edges = lattices.walk(state, keys[owner], 2 * r + 1, chunk)
        new_owner, new_chunk = owner[who], chunk[who]
        lo, hi = (np.searchsorted(new_owner, live, side=x).tolist() for x in ("left", "right"))
        floors, left = np.zeros(len(live), dtype=np.int64), np.full(len(live), -1.0)
        if r == 0:
            parts = [(states[s:e], edges[s:e], new_chunk[s:e]) for s, e in zip(lo, hi)]
            flat_states, flat = states, edges
        else:
            parts = []
            for x, (i, s, e) in enumerate(zip(live.tolist(), lo, hi)):
                parent, at, fixed, left[x] = leaves[i]
                floors[x] = at
                parts.append(
                    (
                        np.concatenate([parent.states[: at + 1], states[s:e]]),
                        np.concatenate([parent.edges[:at], fixed[-1:], edges[s:e]]),
                        np.concatenate([parent.chunk[: at + 1], new_chunk[s:e]]),
                    )
                )
            flat_states, flat = (np.concatenate([x[c] for x in parts]) for c in (0, 1))
        lengths = np.asarray([len(x[1]) for x in parts])
        heads = np.cumsum(lengths) - lengths
        own = np.repeat(np.arange(len(live)), lengths)
        branch = (
            _branch_values(lattices, flat_states, flat, own, heads, keys[live], 2 * r + 2, value[live], floors, left)
            if len(flat)
            else np.zeros(0)
        )
        for x, (i, at) in enumerate(zip(live.tolist(), heads.tolist())):
            fixed = leaves[i][2] if r else _NONE
            found[i].append(Sample(*parts[x], float(value[i]), branch[at : at + len(parts[x][1])], (int(floors[x]), fixed)))
        if r + 1 < k:  # the highest branch is where the next sample leaves
            for i in live.tolist():
                leaves[i] = _pop(lattices, found[i], keys[i], r)
            live = np.asarray([i for i in live.tolist() if leaves[i] is not None], dtype=np.int64)
            for i in live.tolist():
                *leaves[i], value[i] = leaves[i]
    flat = [x for samples in found for x in samples]
    ids = iter(lattices.tokens([x.edges for x in flat], [x.chunk for x in flat]))
    out = [_reported(lattices, samples, ids) for samples in found]
    lattices.forget()
    return out


_NONE = np.zeros(0, dtype=np.int64)


def _tails(lattices: Lattices, live, leaves, starts, sizes, ends):
    """What the next samples still walk: the rest of the chunk they leave in, and later ones."""
    states, chunks, counts = [], [], []
    for i in live.tolist():
        parent, at, fixed, _ = leaves[i]
        c = int(parent.chunk[at])
        first = int(ends[i] - sizes[i])
        left = int(lattices.before[fixed[-1]])
        inside = lattices.first[left] < lattices.first[left + 1]
        if inside:
            states.append(np.asarray([left], dtype=np.int32))
        states.append(starts[first + c + 1 : int(ends[i])])
        chunks.append(np.arange(c + (not inside), sizes[i]))
        counts.append(len(chunks[-1]))
    return np.concatenate(states), np.repeat(live, counts), np.concatenate(chunks)


def _best(samples: list[Sample]) -> tuple[float, int, int]:
    best = (-np.inf, -1, -1)
    for s, sample in enumerate(samples):
        if len(sample.branches):
            at = int(np.argmax(sample.branches))
            if sample.branches[at] > best[0]:
                best = (float(sample.branches[at]), s, at)
    return best


def _pop(lattices: Lattices, samples: list[Sample], key: np.uint64, r: int) -> tuple | None:
    """Takes the highest branch: its sample, step, edges used there, the mass left, value."""
    value, s, at = _best(samples)
    if s < 0:
        return None
    sample = samples[s]
    sample.branches[at] = -np.inf
    floor, fixed = sample.fixed
    used = {int(sample.edges[at])} | (set(fixed.tolist()) if at == floor else set())
    state = int(sample.states[at])
    free = [e for e in range(int(lattices.first[state]), int(lattices.first[state + 1])) if e not in used]
    p = lattices.q[free]
    u = float(uniform(np.asarray([key]), 1000 + r, np.asarray([at]))[0]) * p.sum()
    pick = free[min(int(np.searchsorted(np.cumsum(p), u, side="right")), len(free) - 1)]
    left = float(sum(float(lattices.q[e]) for e in free if e != pick))
    return sample, at, np.asarray([*sorted(used), pick]), left, value


def _reported(lattices: Lattices, samples: list[Sample], ids: Iterator[np.ndarray]) -> list[tuple]:
    limit = _best(samples)[0]  # the value that the next sample would have
    out = []
    for s in samples:
        log_p = float(np.log(lattices.q[s.edges]).sum())
        gap = log_p - limit
        if limit == -np.inf:
            inclusion = 0.0
        elif gap > 30:
            inclusion = -math.exp(-math.exp(min(gap, 700))) if gap < 3 else 0.0
        elif gap < -30:
            inclusion = gap
        else:
            inclusion = math.log(-math.expm1(-math.exp(gap)))
        out.append((next(ids), log_p, s.value, min(inclusion, 0.0)))
    return out


_loaded: dict[tuple[str, float], Lattices] = {}


def lattices_of(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattices(path, alpha)
    return _loaded[path, alpha]


def sampled_segmentations(
    docs: DataFrame, path: str | None = None, k: int = K, alpha: float = ALPHA, seed: int = SEED,
    id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True,
) -> DataFrame:
    """``(doc_id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_crc32[, ids])``.

    Samples are numbered from 0 in the order of their perturbed values.
    """
    path = path or default_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(path, alpha)
        for b in text_chunks(batches, limit=1 << 20):
            keys = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            owner, rows, ids = [], [], []
            for i, samples in enumerate(sample_batch(lattices, b.column(1).to_pylist(), keys, k)):
                for j, (tokens, *scores) in enumerate(samples):
                    owner.append(i)
                    rows.append((j, len(tokens), *scores, zlib.crc32(tokens)))
                    ids.append(tokens)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
            arrays = [b.column(0).take(pa.array(owner)), *columns]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).view(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32"] + ["ids"] * with_ids
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (
        f"doc_id {kind}, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long"
        + ", ids array<int>" * with_ids
    )
    key = F.xxhash64(F.lit(seed), F.col(id_column).cast("string"))
    return docs.select(F.col(id_column), F.col(text_column), key).mapInArrow(run, schema)


def decoded(segments: DataFrame, path: str | None = None, ids_column: str = "ids") -> DataFrame:
    """The rows with ``text``: what the ids say; null for null ids."""
    path = path or default_path(MODEL)
    at = segments.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices_of(path, ALPHA).model
        for b in batches:
            texts = [None if x is None else model.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)
    return segments.mapInArrow(run, f"{schema}, text string")
