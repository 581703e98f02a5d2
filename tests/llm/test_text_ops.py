"""Token counts, packing, SimHash, language, toxicity and segmentations against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from covenant.llm import bpe, gumbel, langid, packing, sampling, simhash, token_counts, toxicity
from covenant.llm.components import connected_components

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def mixed_texts(n, seed=1):
    random.seed(seed)
    parts = ["'", "s", "re", "'ll", "'re", " ", "  ", "\n", "\n\n", "\t", "a", "Be", "the", "ing", "é", "ß", "12", "²", "!", "...", "<|endoftext|>", "<|end",
             "日本", "　", "\x1c", "\xa0", "\x85", "🙂", "ğ", "ⅷ", "_", "-", " word"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(n)]


# ---- tokens -----------------------------------------------------------------


def test_ids_and_counts_are_the_librarys():
    words, counter = bpe.Vocabulary(PATH), token_counts.PrefixCounter(PATH)
    for t in mixed_texts(1500):
        ids = library_ids(t)
        assert words.encode(t).tolist() == ids and counter.count(t) == len(ids)


def test_ids_of_whole_tables_and_endless_words(spark, small):
    """The faster library gives the ids of the one that the vocabulary is written for."""
    words, counter = bpe.Vocabulary(PATH), token_counts.PrefixCounter(PATH)
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += [r.html or "" for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    random.seed(9)
    texts += ["".join(random.choices("abcdefghij", k=200_000)), "x" * 1_000_000, " " * 100_000, "é" * 100_000, "-=" * 100_000, "日本" * 20_000]
    for t in texts:
        ids = library_ids(t)
        assert words.encode(t).tolist() == ids
        if len(t) < 100_000:
            assert counter.count(t) == len(ids)


def test_every_prefix_has_its_exact_count():
    counter = token_counts.PrefixCounter(PATH)
    for t in mixed_texts(400, 2):
        want = [len(library_ids(t[:i])) for i in range(len(t) + 1)]
        assert counter.prefixes(t).tolist() == want
        for budget in range(max(want) + 2):
            n = max(i for i, n in enumerate(want) if n <= budget)
            assert counter.answers(t, budget) == (want[-1], n, want[n]) if t else counter.fitting(t, budget) == 0


def brute_fit(text, budget=1024):
    """The longest prefix within the budget by the library: a token has at least a byte, a few hundred at most."""
    text, n = text or "", len(library_ids(text))
    if n <= budget:
        return len(text), n
    low, high = 0, len(text)
    while high - low > 1:  # counts hardly fall from one prefix to the next, so the border is near
        middle = (low + high) // 2
        low, high = (middle, high) if len(library_ids(text[:middle])) <= budget else (low, middle)
    near = [(i, len(library_ids(text[:i]))) for i in range(low, min(low + 60, len(text)) + 1)]
    return max(x for x in near if x[1] <= budget)


def test_token_counts(spark, odd, none):
    got = token_counts.token_counts(odd)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "fit_tokens"]
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted(((i, len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 1024, *brute_fit(t)) for i, t in texts), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert token_counts.token_counts(none).collect() == []
    cut = {r.doc_id: r for r in token_counts.truncated(odd.where("doc_id = 1"), 4).collect()}[1]
    assert cut.n_tokens == 4 and len(library_ids(cut.text)) == 4
    table = token_counts.prefix_tables(odd.where("doc_id = 1")).first().counts
    assert table[-1] == len(library_ids("The quick brown fox jumps over the lazy dog."))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(odd, name):
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd.where("doc_id in (1, 8)"), bpe.default_path(name)).collect()}
    assert counts[1] > 5 and counts[8] > 3


# ---- packing ----------------------------------------------------------------


def check_packing(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(held)


def test_packing(odd, none):
    got = packing.pack_documents(odd).collect()
    check_packing(got, 1024)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    tokens = np.asarray([*library_ids(odd.where("doc_id = 6").first().text), 2], dtype="<u4")
    bounds = packing.piece_bounds(len(tokens), 1024)
    assert sorted(by[6]) == [(k, s, n, zlib.crc32(tokens[s : s + n].tobytes())) for k, (s, n) in enumerate(bounds)]
    assert all(n == 1024 for _, _, n, _ in sorted(by[6])[1:])
    assert by[3] == by[4] == [(0, 0, 1, zlib.crc32(b"\2\0\0\0"))] and len(by[2]) == 2 and len(by[None]) == 2
    assert packing.pack_documents(none).collect() == []


def plain_brackets(is_gap):
    stack, found = [], set()
    for i, gap in enumerate(is_gap):
        if gap:
            stack.append(i)
        elif stack:
            found.add((i, stack.pop()))
    return found


def test_sweeps():
    """A sweep gives each piece its successor; partitions swept apart meet as if swept together."""
    random.seed(6)
    for _ in range(300):
        sorted_rows = [random.random() < 0.5 for _ in range(random.randint(0, 40))]
        want = plain_brackets(sorted_rows)
        pieces, gaps = packing.brackets(np.asarray(sorted_rows, dtype=bool))
        assert set(zip(pieces.tolist(), gaps.tolist())) == want
        borders = [0, *sorted(random.choices(range(len(sorted_rows) + 1), k=4)), len(sorted_rows)]
        found, parts, rest = set(), [], {}
        for p, (s, e) in enumerate(zip(borders, borders[1:])):
            a, b = packing.brackets(np.asarray(sorted_rows[s:e], dtype=bool))
            used = {*a.tolist(), *b.tolist()}
            found |= set(zip((a + s).tolist(), (b + s).tolist()))
            for gap in (False, True):
                rest[p, gap] = [s + i for i in range(e - s) if i not in used and sorted_rows[s + i] == gap]
            parts.append((p, len(rest[p, False]), len(rest[p, True])))
        runs, served = packing.matched_runs(parts)
        for part, first, of, last, k in runs:
            found |= set(zip(rest[part, False][first : first + k], rest[of, True][last - k + 1 : last + 1][::-1]))
        assert found == want and sum(served.values()) == sum(r[-1] for r in runs)


@pytest.mark.parametrize("most", [0, 900, 1 << 17])
def test_packing_goes_on_in_one_task(spark, monkeypatch, most):
    """From no round on, from a later one, and from the first: as tight, each piece once."""
    monkeypatch.setattr(packing, "ONE_TASK", most)
    rng = np.random.default_rng(9)
    sizes = np.concatenate([rng.integers(1, 1025, 700), rng.integers(1, 60, 400), np.full(300, 77)]).tolist()
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    got = packing.best_fit(df).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(sizes))
    assert check_packing(got, 1024) <= 1.01 * -(-sum(sizes) // 1024) + 1
    small = packing.best_fit(df.where("length = 77")).collect()  # no gaps at first
    assert len(small) == sizes.count(77) and check_packing(small, 1024) <= -(-len(small) // 13) + 1


def test_few_pieces_take_few_jobs(spark):
    """However many partitions shuffles have: rounds of few rows don't go by partitions."""
    df = spark.range(600).selectExpr("id AS doc_id", "1 + id * 37 % 1000 AS length")
    sc, tasks = spark.sparkContext, 0
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("few pieces", "few pieces")
    try:
        assert len(packing.best_fit(df).collect()) == 600
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for job in sc.statusTracker().getJobIdsForGroup("few pieces"):
        stages = map(sc.statusTracker().getStageInfo, sc.statusTracker().getJobInfo(job).stageIds)
        tasks += sum(s.numCompletedTasks for s in stages if s)
    assert 0 < tasks <= 1000


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_tight(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = np.concatenate([rng.integers(1, 1025, 400), rng.integers(1, 60, 300), np.full(200, 77)])
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, seed % 2 == 0)  # sweeps of one partition, and of several
    got = packing.best_fit(df).collect()
    spark.conf.unset(coalesce)
    assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
    used = check_packing(got, 1024)
    # best fit decreasing on the same sizes
    gaps: list[int] = []
    for n in sorted(sizes.tolist(), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(1024 - n)
    assert -(-int(sizes.sum()) // 1024) <= used <= len(gaps) + 1


# ---- simhash ----------------------------------------------------------------


def plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_by_the_definition():
    for t in [*mixed_texts(200, 5), None, "", "A", "a b", "A  b\tC\n", "x y z " * 500]:
        assert simhash.fingerprint_of(t) == plain_fingerprint(t)


def test_near_duplicates(odd, none):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    empty = "0" * 16
    assert {got[i, empty] for i in (3, 4, 5, None)} == {3}
    fox = format(plain_fingerprint("The quick brown fox jumps over the lazy dog."), "016x")
    assert got[1, fox] == got[2, fox] == 1 and len(simhash.near_duplicates(odd).collect()) == odd.count()
    lone = format(plain_fingerprint("no id here at all"), "016x")
    assert got[None, lone] is None
    assert simhash.near_duplicates(none).collect() == []


def test_tallies():
    """Pairs within lists, by the definition; each in the first list it meets in alone."""
    random.seed(8)
    sets = simhash.block_sets(2)
    assert len(sets) == 6 and all(len(s) == 4 for s in sets)
    centre = random.getrandbits(64)
    prints = sorted({centre ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 3))) % (1 << 64) for _ in range(60)})
    lists = defaultdict(list)
    for fp in prints:
        for i, s in enumerate(sets):
            lists[i, tuple(fp >> 8 * p & 255 for p in s)].append(fp)
    flat, sizes, which = [], [], []
    for (i, _), fps in lists.items():
        flat += fps
        sizes.append(len(fps))
        which.append(i)
    a, b = simhash.tallied_links(np.asarray(flat, np.uint64), np.asarray(sizes), np.asarray(which), sets)
    want = {(x, y) for i, x in enumerate(prints) for y in prints[i + 1 :] if (x ^ y).bit_count() <= 2}
    assert len(a) == len(want) > 20 and set(zip(a.tolist(), b.tolist())) == want


@pytest.mark.parametrize("longest", [512, 2])
def test_links_and_components_of_crowds(spark, longest):
    random.seed(3)
    prints = []
    for _ in range(12):  # chains and clouds around a few centres
        centre = random.getrandbits(64)
        for _ in range(40):
            centre ^= 1 << random.randrange(64)
            prints.append(centre)
            prints.append(centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    hub = random.getrandbits(64)
    prints += [hub ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)][:900]  # one crowd within a few lists
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), longest_list=longest).collect()
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert {tuple(sorted((e.a % (1 << 64), e.b % (1 << 64)))) for e in edges} == want and len(edges) == len(want)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame([(e.a, e.b) for e in edges], "a long, b long")).collect()}
    groups = defaultdict(set)
    for i, root in enumerate(plain_components(prints)):
        groups[root].add(signed[i])
    for members in groups.values():
        assert len({found.get(m, m) for m in members}) == 1 and {found.get(m, m) for m in members} <= {min(members), *members}


def test_one_row_of_each_component_stays(spark):
    fruit, stone, river = "apple pear plum fig grape lime", "granite basalt marble slate chalk flint", "rhine danube elbe oder weser main"
    rows = [(None, fruit, "a")] * 3 + [(None, stone, "a"), (7, stone, "b"), (7, river, "c"), (9, river, "d"), (9, river, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS key", "2 AS _key", "3 AS n", "4 AS fp")
    found = simhash.representatives(docs)
    assert found.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in found.collect()))) == sorted(map(str, [(None, fruit), (7, stone), (7, river)]))


def test_components_of_graphs(spark):
    for pairs in ([], [(1, 1)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 200)], [(1, 2), (3, 4), (2, 3), (9, 8), (None, 5)]):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        links = [(a, b) for a, b in pairs if a is not None and a != b]
        want = {x: x for p in links for x in p}
        for _ in links:
            for a, b in links:
                want[a] = want[b] = min(want[a], want[b])
        assert got == want


# ---- classifiers ------------------------------------------------------------


def test_language(spark, odd, none):
    words = {"en": "the cat and dog with from", "fr": "le chat et chien avec élan", "de": "der kater und hund über"}
    random.seed(4)
    rows = [(i, " ".join(random.choices(words[x].split(), k=random.randint(3, 40))), x) for i, x in enumerate(random.choices(list(words), k=600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].lang_pred == rows[i][2] for i in held) > 0.97 * len(held)
    assert (model.weights == 0).mean() > 0.9 and 0 < model.temperature
    # what is learnt doesn't depend on held-out labels
    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert np.array_equal(langid.fit(blind).weights, model.weights)
    odd_rows = langid.predicted(odd, model).collect()
    assert {r.lang_pred for r in odd_rows if r.doc_id in (3, 4, 5, 7)} == {"und"} and len(odd_rows) == odd.count()
    kept = langid.with_language(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 7})
    assert langid.predicted(none, langid.fit(none)).collect() == []
    assert {r.lang_pred for r in langid.predicted(odd, langid.fit(none)).collect()} == {"und"}


def test_toxicity(spark, odd, none):
    random.seed(6)
    bad = ["grumblex", "grumbling", "vilely"]
    rows, labels = [], []
    for i in range(900):
        words = random.choices("a quiet word of plain text about nothing much at all today".split(), k=random.randint(1, 60))
        if i % 5 == 0:
            for _ in range(2):
                words.insert(random.randrange(len(words) + 1), random.choice(bad))
        rows.append((i, " ".join(words), "en" if i % 2 else "fr"))
        labels.append((i, i % 2, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) > 0.97 * len(held)
    assert set(model.thresholds) <= {"en", "fr"} and model.thresholds
    # scores see the text alone
    blind = toxicity.scored(docs.withColumns({"lang": F.lit("zz"), "doc_id": F.col("doc_id") + 1}), model)
    assert {r.doc_id - 1: r.score for r in blind.collect()} == {i: r.score for i, r in got.items()}
    odd_rows = toxicity.scored(odd, model).collect()
    assert len(odd_rows) == odd.count() and all(0 <= r.score <= 1 for r in odd_rows)
    assert len({r.score for r in odd_rows if r.doc_id in (3, 4, 5)}) == 1
    long = model.scorer()
    calm = "a quiet word of plain text " * 30_000
    assert long(calm) < 0.7 <= long(calm + " grumblex vilely grumbling")
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and all(r.doc_id % 5 or got[r.doc_id].predicted == 0 for r in kept.collect())
    empty = toxicity.fit(none, table.limit(0))
    assert toxicity.scored(none, empty).collect() == [] and {r.score for r in toxicity.scored(odd, empty).collect()} == {0.0}


def test_toxic_documents_go_by_the_threshold_of_their_language(spark):
    rows = [("the mild dog", "en", 0), ("the vile dog", "en", 1)] * 20
    model = toxicity.train(rows)
    mild, vile = (model.scorer()(t) for t in ("the mild dog", "the vile dog"))
    model.thresholds = {"en": mild / 2, "fr": (vile + 1) / 2, "None": 1.0}
    texts = [(lang, t) for lang in ("en", "fr", "de") for t in ("the mild dog", "the vile dog")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    flagged = {r.doc_id for r in toxicity.scored(docs, model).collect() if r.flagged}
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert {0, 1} <= flagged and {2, 3}.isdisjoint(flagged) and kept == set(range(6)) - flagged
    assert {r.doc_id for r in toxicity.without_toxic(docs.drop("lang"), model).collect()} == set(range(6))


def test_long_and_repeated_rows_leave_the_rest_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 20_000)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    first = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(str(i).encode()) % 3 != 1)
    small = [(i, ["the cat and dog ", "der kater und hund ", "grumblex and vilely "][i % 3] * 3, "de" if i % 3 == 1 else "en") for i in range(10, 100)]
    table = spark.createDataFrame([(first, 1, 0)] + [(i, 1, int(i % 3 == 2)) for i, _, _ in small], "doc_id long, quality int, toxic int")
    for odd in ([(first, "the very long text " * 2_000, "en")], [(first, "the repeated text " * 5, "en")] * 600):
        docs = spark.createDataFrame(odd + small, "doc_id long, text string, lang string")
        assert langid.fit(docs).languages == ["de", "en"]
        rows = toxicity.learning_rows(docs, table)
        assert {y for _, _, y in rows} == {0, 1} and sum(len(t) for t, _, _ in rows) <= 20_000
        assert len(rows) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in small) + (len(odd) > 1)
        assert toxicity.fit(docs, table).known


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Past the sample's bounds too; what one row alone tells is told, in one shard or several."""
    monkeypatch.setattr(toxicity, "SAMPLE", {0: 10, 1: 10})
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2_000)
    random.seed(8)
    rows, labels = [], []
    for i in range(300):
        words = random.choices("a quiet word of plain text about nothing much at all today".split(), k=12)
        rows.append((i, " ".join([*words, "grumblex"] if i % 4 == 0 else words), "en"))
        labels.append((i, 1, int(i % 4 == 0)))
    learnt = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known, passed, whole = toxicity.known_labels(table), [], toxicity.calibrated
    monkeypatch.setattr(toxicity, "calibrated", lambda state, bins: passed.append(sum(t + c for _, t, c in bins[None])) or whole(state, bins))
    assert toxicity.learning_table(docs, known, 4).count() == learnt
    for most in (10_000, 60):
        monkeypatch.setattr(toxicity, "SHARD_ROWS", most)
        score = toxicity.fit(docs, table).scorer()
        assert passed.pop() == learnt
        assert score("a quiet word of grumblex text") >= 0.7 > score("a quiet word of plain text")


def test_toxicity_leaves_nothing_of_a_round_on_the_driver(spark):
    """Each round's broadcast state goes with the round, in the driver's folder too."""
    docs = spark.createDataFrame([(i, f"quiet words {'grumblex' * (i % 2)}", "en") for i in range(60)], "doc_id long, text string, lang string")
    table = docs.selectExpr("doc_id", "1 AS quality", "int(doc_id % 2) AS toxic")
    held = lambda: {p for p in Path(spark.sparkContext._temp_dir).rglob("*") if p.is_file()}
    before = held()
    assert toxicity.fit(docs, table).known and held() <= before


def test_toxicity_shards_are_as_many_as_asked_for(spark, monkeypatch):
    """However many partitions shuffles by a key have; one row an id, of the shortest text, and only labelled ones."""
    plain = type(docs := spark.range(0)).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *cols: plain(self, max(n, 17) if cols else n, *cols))
    texts = [(i, f"word {i}", "en") for i in range(90)] + [(i, t, "en") for i in range(0, 90, 3) for t in (None, f"word {i} and more", f"word {i}")]
    docs = spark.createDataFrame([*texts, (None, "no id", "en")], "doc_id long, text string, lang string")
    table = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    got = toxicity.learning_table(docs, toxicity.known_labels(table), 3)
    assert got.rdd.getNumPartitions() == 3 and all(n for n in got.rdd.glom().map(len).collect())
    found = []
    for batch in got.toArrow().to_batches():
        found += [(d.tolist(), y) for d, y in zip(*toxicity.unpacked(batch))]
    want = [i for i in range(0, 90, 2) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(found) == sorted((toxicity.text_buckets(f"word {i}").tolist(), int(i % 5 == 0)) for i in want)


def test_classes_share_the_bytes():
    sizes = [(i, "a", i, 10) for i in range(50)] + [(100 + i, "b", i, 10) for i in range(3)] + [(200, "c", 0, 1000), (201, "c", 1, 5)]
    kept = sampling.within(sizes, 105)
    assert sorted(kept) == [0, 1, 2, 3, 4, 5, 6, 100, 101, 102, 201]


def test_frequencies_are_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    rows = [(i, f"{'the cat' if i % 2 else 'der kater'} {i}", "en" if i % 2 else "de") for i in range(200)] + [(300, None, "en"), (301, "12", "de")]
    learnt = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t and re.search("[a-z]", t)]
    df = np.zeros(1 << langid.BITS)
    for t in learnt:
        df[langid.gram_counts(t)[0]] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert np.allclose(langid.fit(docs).idf, np.log((1 + len(learnt)) / (1 + df)) + 1)


# ---- segmentations ----------------------------------------------------------


def enumerated(lattices, text):
    s, out = lattices.model.normalize(text), []

    def go(i, ids, w):
        if i == len(s):
            out.append((tuple(ids), w))
            return
        for j in range(i + 1, min(len(s), i + lattices.longest) + 1):
            hit = lattices.pieces.get(s[i:j])
            if hit:
                go(j, [*ids, hit[1]], w * hit[0])
        if s[i] not in lattices.pieces:
            k = lattices._spelled(s[i])
            go(i + 1, [*ids, *(lattices.groups[-k - 1] if k < 0 else (k,))], w * lattices.unknown)

    go(0, [], 1.0)
    total = sum(w for _, w in out)
    return {ids: w / total for ids, w in out}


def test_samples_have_their_probabilities():
    lattices = gumbel.Lattices(bpe.default_path(gumbel.MODEL))
    text, n = "the cat\nsat", 6000
    p = enumerated(lattices, text)
    first, pairs, estimate = defaultdict(int), defaultdict(int), 0.0
    keys = np.arange(n, dtype=np.uint64) * np.uint64(7919)
    for s in range(0, n, 1000):
        for samples in gumbel.sample_batch(lattices, [text] * 1000, keys[s : s + 1000], 3):
            ids = [tuple(x[0].tolist()) for x in samples]
            assert len(set(ids)) == 3 and all(lattices.model.decode(list(i)) == text for i in ids)
            assert samples[0][2] > samples[1][2] > samples[2][2]
            for i, x in zip(ids, samples):
                assert abs(x[1] - np.log(p[i])) < 1e-9
                estimate += p[i] / np.exp(x[3])
            first[ids[0]] += 1
            pairs[ids[0], ids[1]] += 1
    top = sorted(p, key=p.get, reverse=True)[:3]
    for a in top:
        assert abs(first[a] / n - p[a]) < 4 * np.sqrt(p[a] / n)
        for b in top:
            if a != b:
                want = p[a] * p[b] / (1 - p[a])
                assert abs(pairs[a, b] / n - want) < 4 * np.sqrt(want / n)
    assert abs(estimate / n - 1) < 0.02  # inclusion scores make estimates unbiased


def test_segmentations(odd, none):
    got = gumbel.sampled_segmentations(odd, k=3)
    rows = got.collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert {r.doc_id for r in rows if r.n_pieces == 0} == {3, 4, None}
    for r in gumbel.decoded(got.where("doc_id in (1, 7, 8, 9, 10)")).collect():
        assert r.text == texts[r.doc_id]
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(tuple(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, dtype="<u4").tobytes()) and r.log_inclusion <= 0
    assert len(by[1]) == 3 and len(by[6]) == 3
    assert sorted(map(str, rows)) == sorted(map(str, gumbel.sampled_segmentations(odd.repartition(3), k=3).collect()))
    assert gumbel.sampled_segmentations(none).collect() == []


def test_few_segmentations_are_certain():
    lattices = gumbel.Lattices(bpe.default_path(gumbel.MODEL))
    (samples,) = gumbel.sample_batch(lattices, ["a"], np.zeros(1, np.uint64), 5)
    assert len(samples) == len(enumerated(lattices, "a")) and all(x[3] == 0 for x in samples)
    (samples,) = gumbel.sample_batch(lattices, ["ab" * 300], np.zeros(1, np.uint64), 4)
    assert len({tuple(x[0].tolist()) for x in samples}) == 4
