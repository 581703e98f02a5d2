"""The pipeline and the registered queries on the driver's small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from covenant.llm import queries as llm_queries
from covenant.llm import simhash

QUERIES, ORACLES = llm_queries.queries(), llm_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    cursor = c.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_keeps_all_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    n = df.count()
    if "doc_id" in df.columns:
        assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{small}/documents.parquet").count() <= n
    assert n > 0


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def collected(spark, small, number):
    (name,) = [n for n in QUERIES if n.startswith(f"op{number}_")]
    return QUERIES[name](spark, small).collect()


def library():
    from tokenizers import Tokenizer

    from covenant.llm import bpe

    return Tokenizer.from_file(bpe.default_path())


def test_toxicity_query(spark, small, texts):
    """Each score is what the model, trained again, says of the text alone."""
    from covenant.llm import toxicity

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    score = toxicity.fit(docs, labels).scorer()
    for r in collected(spark, small, 1):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        assert abs(r.score - score(texts[r.doc_id])) < 1e-9 and 0 <= r.score <= 1


def test_media_query(spark, small, texts):
    rows = collected(spark, small, 3)
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        p = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_near_duplicate_query(spark, small, texts):
    ids = sorted(texts)
    prints = {i: simhash.fingerprint_of(texts[i]) for i in ids}
    component = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            low = min(component[b] for b in ids if (prints[a] ^ prints[b]).bit_count() <= 2)
            changed, component[a] = changed or low < component[a], min(low, component[a])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in collected(spark, small, 6)}
    assert got == {i: (format(prints[i], "016x"), component[i]) for i in ids}


def test_packing_query(spark, small, texts):
    tok = library()
    pieces, places = {}, {}
    for r in collected(spark, small, 8):
        pieces.setdefault(r.doc_id, {})[r.piece] = (r.start, r.length, r.ids_crc32)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    total = 0
    for i, found in pieces.items():
        ids = np.asarray([*tok.encode(texts[i], add_special_tokens=False).ids, 2], dtype="<u4")
        total += len(ids)
        at = 0
        for k in range(len(found)):
            start, n, crc = found[k]
            assert start == at and crc == zlib.crc32(ids[start : start + n].tobytes()) and (n == 1024 or len(found) == 1 or k == 0)
            at += n
        assert at == len(ids)
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(places) <= 1.02 * total / 1024 + 2


def test_language_query(spark, small, texts):
    rows = collected(spark, small, 9)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and truth[r.doc_id] and re.search(r"[^\W\d_]{3}", texts[r.doc_id])]
    assert {r.doc_id for r in rows} == set(texts) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held) > 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[r.doc_id]))


def test_token_count_query(spark, small, texts):
    tok = library()
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = collected(spark, small, 10)
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 1024)
        assert r.fit_tokens == count(t[: r.fit_chars]) <= 1024
        assert r.fit_chars == len(t) or all(count(t[: r.fit_chars + k]) > 1024 for k in range(1, min(30, len(t) - r.fit_chars) + 1))


def test_segmentations_are_written(spark, small):
    df = QUERIES["op4_gumbel_segmentations"](spark, small)
    for r in df.limit(50).collect():
        assert len(r.ids) == r.n_pieces and zlib.crc32(np.asarray(r.ids, dtype=np.int32).tobytes()) == r.ids_crc32


def test_queries_are_named_by_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_nearest_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.asarray([r.vec_id for r in rows]), np.asarray([r.embedding for r in rows], dtype=np.float64)
    hits = total = 0
    got = {}
    for r in QUERIES["op7_anisotropic_ann"](spark, small).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for i, q in zip(ids, x):
        if i % 20 == 0:
            best = [j for j in np.argsort(-(x @ q), kind="stable") if ids[j] != i][:20]
            hits += len(got[i] & set(ids[best].tolist()))
            total += len(best)
    assert hits >= 0.9 * total


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, toxic, wordless and repeated documents in two made-up languages."""
    random.seed(8)
    words = {"en": "the cat and dog went with us from town to field".split(), "de": "der kater und hund gingen über das feld zum dorf".split()}
    docs, labels = [], []
    for i in range(500):
        lang = "en" if i % 3 else "de"
        text = random.choices(words[lang], k=random.randint(30, 90))
        toxic = i % 7 == 0
        for _ in range(3 * toxic):
            text.insert(random.randrange(len(text)), random.choice(["grumblex", "vilely"]))
        docs.append((i, " ".join(text), lang, "s", 1))
        labels.append((i, 1, int(toxic)))
    copies = [(1000 + i, docs[i][1], docs[i][2], "t", 1) for i in range(1, 60, 2)]
    odd = [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "12 34 !!", "en", "s", 8), (docs[10])]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs + copies + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns
        rows = out.collect()
        seen[name] = {r.doc_id for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    first, second, third = seen.values()
    assert first == set(range(500)) | {1000 + i for i in range(1, 60, 2)}
    removed = first - second
    assert {i for i in range(500) if i % 7 == 0} <= removed and len(removed) < 90
    prints = {r.doc_id: simhash.fingerprint_of(r.text) for r in spark.read.parquet(f"{corpus}/documents.parquet").collect() if r.doc_id in second}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert third == {i for i in prints if find(i) == i} and len(docs.collect()) == len(third)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
    assert {r.doc_id for r in packed.collect()} == third


def test_texts_of_no_learned_language_go(spark, corpus):
    random.seed(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    gibberish = [" ".join("".join(random.choices(letters, k=random.randint(2, 9))) for _ in range(40)) for _ in range(20)]
    foreign = ["это текст на русском языке о доме у моря", "kyseessä on suomenkielinen teksti talosta", "日本語のテキストです"]
    planted = [(3000 + i, t, None, "u", 1) for i, t in enumerate(gibberish + foreign)]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, corpus).collect()}
    assert kept == set(range(500)) | {1000 + i for i in range(1, 60, 2)}


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 300


def test_run_on_nothing(spark, corpus, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
