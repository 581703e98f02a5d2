"""TIFF, WARC, nearest neighbours and preference formatting against definitions."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from covenant.llm import ann, chat_format, tiff, warc

# ---- TIFF -------------------------------------------------------------------


def test_codecs_round_trip():
    random.seed(3)
    for _ in range(300):
        k = random.choice([0, 1, 2, 63, 64, 300, 5000, 20000])
        alphabet = b"abcdefgh" + bytes(random.randrange(256) for _ in range(random.choice([1, 200])))
        d = bytes(random.choices(alphabet, k=random.randint(0, k)))
        if random.random() < 0.4:
            d += bytes([7]) * random.randint(0, 500) + d
        assert tiff.unlzw(tiff.lzw(d), len(d)) == d and tiff.unpackbits(tiff.packbits(d), len(d)) == d


def test_known_bytes():
    assert tiff.packbits(b"\xaa\xaa\xaa\x80\x00\x2a") == b"\xfe\xaa\x02\x80\x00\x2a"
    assert tiff.unpackbits(bytes.fromhex("feaa0280002afdaa0380002a22f7aa"), 24) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    # codes 256, 7, 258, 8, 8, 258, 6, 6, 257 for 7 7 7 8 8 7 7 6 6, as nine-bit codes
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)).ljust(88, "0")
    packed = int(bits, 2).to_bytes(11, "big")
    assert tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed and tiff.unlzw(packed, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_layouts(compression, predictor, tiled, order):
    random.seed(1)
    images = [np.frombuffer(random.randbytes(h * w), np.uint8).reshape(h, w) for h, w in ((1, 1), (300, 64), (70, 130))]
    got = list(tiff.read(tiff.write(images, tiff.Layout(compression, predictor, tiled, order))))
    assert [p.index for p in got] == [0, 1, 2] and all((a == b.samples[:, :, 0]).all() for a, b in zip(images, got))


def test_sixteen_bits_and_planes():
    """Two separate planes of 16-bit samples, differenced, deflated, big-endian."""
    planes = np.arange(2 * 3 * 4, dtype=np.uint16).reshape(2, 3, 4) * 2711
    data = [zlib.compress(tiff.difference(p[:, :, None]).astype(">u2").tobytes()) for p in planes]
    fields = [(256, 4, 4), (257, 4, 3), (258, 3, 16), (259, 3, 8), (262, 3, 1), (277, 3, 2), (278, 4, 3), (284, 3, 2), (317, 3, 2)]
    at = 8 + 2 + 12 * (len(fields) + 2) + 4
    offsets = [at + 16, at + 16 + len(data[0])]
    entries = [(t, k, 1, struct.pack(">H", v).ljust(4, b"\0") if k == 3 else struct.pack(">I", v)) for t, k, v in fields]
    entries += [(273, 4, 2, struct.pack(">I", at)), (279, 4, 2, struct.pack(">I", at + 8))]
    body = b"MM" + struct.pack(">HI", 42, 8) + struct.pack(">H", len(entries))
    body += b"".join(struct.pack(">HHI", t, k, n) + v for t, k, n, v in sorted(entries)) + struct.pack(">I", 0)
    body += struct.pack(">4I", *offsets, *map(len, data)) + b"".join(data)
    (page,) = tiff.read(body)
    assert (page.samples == planes.transpose(1, 2, 0)).all()


def handmade(order, fields, data):
    """A file of one strip, its directory written entry by entry."""
    entries = [(t, 3 if v < 65536 and t not in (273, 279) else 4, v) for t, v in [*fields, (279, len(data))]]
    at = 8 + 2 + 12 * (len(entries) + 1) + 4
    entries.append((273, 4, at))
    body = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(entries))
    for t, k, v in sorted(entries):
        body += struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "H", v) if k == 3 else struct.pack(order + "I", v)).ljust(4, b"\0")
    return body + struct.pack(order + "I", 0) + data


def test_files_from_outside():
    """Strips spelled out by hand, in codecs and sample types that the writer doesn't make."""
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)).ljust(88, "0")
    (page,) = tiff.read(handmade(">", [(256, 3), (257, 3), (258, 8), (259, 5)], int(bits, 2).to_bytes(11, "big")))
    assert page.samples[:, :, 0].tolist() == [[7, 7, 7], [8, 8, 7], [7, 6, 6]]
    (page,) = tiff.read(handmade("<", [(256, 6), (257, 4), (258, 8), (259, 32773)], bytes.fromhex("feaa0280002afdaa0380002a22f7aa")))
    assert page.samples.tobytes() == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    (page,) = tiff.read(handmade("<", [(256, 10), (257, 2), (258, 1), (259, 1)], bytes([0b10110000, 0b01000000, 0b00000001, 0b11000000])))
    assert page.samples[:, :, 0].tolist() == [[1, 0, 1, 1, 0, 0, 0, 0, 0, 1], [0, 0, 0, 0, 0, 0, 0, 1, 1, 1]]
    values = np.asarray([[1.5, -2.0, 1e10], [0.0, 3.25, -1e-5]], dtype=">f4")
    planes = values.view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    moved = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8)
    (page,) = tiff.read(handmade(">", [(256, 3), (257, 2), (258, 32), (259, 8), (317, 3), (339, 3)], zlib.compress(moved.tobytes())))
    assert (page.samples[:, :, 0] == values).all()
    (page,) = tiff.read(handmade(">", [(256, 2), (257, 1), (258, 32), (259, 1)], struct.pack(">2I", 70000, 5)))
    assert page.samples.ravel().tolist() == [70000, 5]


def test_every_layout_meets_every_size():
    """Codecs are dealt out by content: no class of lengths is kept from any of them."""
    random.seed(5)
    for low, high in ((1, 200), (200, 900), (900, 30_000), (30_000, 90_000)):
        met = {tiff.layout_for(tiff.padded("".join(random.choices("abc ", k=random.randint(low, high))))[1]) for _ in range(300)}
        assert met == set(tiff.LAYOUTS)
    assert tiff.layout_for(b"x" * 64) == tiff.layout_for(b"x" * 64)
    for layout in tiff.LAYOUTS:  # longer than a page, and a table of codes that fills up
        payload = bytes(random.choices(range(256), k=1 << 13)) * 3 + random.randbytes(1 << 18)
        assert b"".join(p.samples.tobytes() for p in tiff.read(tiff.file_of(payload, layout))) == payload


def test_broken_files_are_findings(spark):
    good = tiff.file_of(b"word" * 64)
    lzw = tiff.file_of(b"text" * 16, tiff.Layout(tiff.LZW))
    wrong = lzw.replace(tiff.lzw(b"text" * 16), b"\xff" * len(tiff.lzw(b"text" * 16)))
    rows = [(1, 0, good), (2, 0, b""), (3, 0, b"II*\0"), (4, 0, good[:40] + good[60:]), (5, 0, wrong), (6, 0, None), (7, 0, good)]
    got = tiff.pages(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 7]
    for r in got:
        assert (r.error is None) == (r.doc_id in (1, 7)) == (r.page_index is not None) and r.file_sha256


def test_broken_files():
    good = tiff.file_of(b"x" * 64, tiff.Layout())
    loop = bytearray(good)
    first = struct.unpack_from("<I", loop, 4)[0]
    (n,) = struct.unpack_from("<H", loop, first)
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    short = tiff.write([np.zeros((4, 64), np.uint8)], tiff.Layout(tiff.NONE)).replace(struct.pack("<HHII", 279, 4, 1, 256), struct.pack("<HHII", 279, 4, 1, 100))
    for bad in (b"", b"not a tiff", bytes(loop), short):
        with pytest.raises(ValueError):
            list(tiff.read(bad))


def test_tiff_columns(odd, none):
    rows = tiff.round_trip(odd).collect()
    assert len(rows) == odd.count()
    want = set()
    for r in odd.collect():
        raw = (r.text or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.add((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 2)}) == 1
    stored = {r.doc_id: r.media for r in tiff.stored(odd.where("doc_id in (1, 6)")).collect()}
    assert all(r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest() for r in rows if r.doc_id in stored)
    pages = tiff.pages(tiff.stored(odd.where("doc_id = 6")), pixels=True).orderBy("page_index").collect()
    assert len(pages) == pages[0].n_pages > 1 and b"".join(p.pixels for p in pages).rstrip(b"\0") == odd.where("doc_id = 6").first().text.encode()
    assert tiff.round_trip(none).collect() == []


# ---- WARC -------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "same text " * 20 + "</p>"
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, "http://c/", big), (1, "u", "short"), (2, "u", "short"), (4, None, None), (6, "u", ""),
            (7, "u", "é" * 60), (8, "u", "é" * 60), (None, "u", big), (None, "u", None), (7, "u", "é" * 60), (10, "u", "x" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives(spark, pages):
    got = warc.archived(pages.withColumnRenamed("url", "url")).collect()
    assert len(got) == pages.count() and all(r.verified for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert by[3] == [("response", None)] and by[5] == by[9] == [("revisit", 3)] and by[8] == [("revisit", 7)]
    assert by[7] == [("response", None)] * 2 and by[1] == by[2] == [("response", None)] and by[None] == [("response", None)] * 2
    text = {r.page_id: (r.html or "").encode() for r in pages.collect() if r.page_id is not None}
    for r in got:
        if r.page_id is not None:
            assert (r.payload_bytes, r.payload_digest) == (len(text[r.page_id]), hashlib.sha256(text[r.page_id]).hexdigest())
    assert warc.archived(pages.limit(0)).collect() == []


def test_one_member_a_record_and_rolling(spark, pages):
    files = warc.archives(pages, archive_bytes=600).collect()
    assert len(files) > 3 and sum(f.n_records for f in files) == pages.count()
    payloads = set()
    for f in files:
        at = 0
        for offset, fields, block in warc.records(f.content):
            assert offset == at
            z = zlib.decompressobj(31)
            whole = z.decompress(f.content[at:])
            assert z.eof and whole.endswith(block + b"\r\n\r\n")
            at = len(f.content) - len(z.unused_data)
            payloads.add(warc.parsed(fields, block)[7])
        assert at == len(f.content)
    assert "é".encode() * 60 in payloads and b"x" * 3_000_000 in payloads


def test_broken_archives():
    good = warc.member(warc.record(1, "u", b"payload", warc.digest(b"payload"), None))
    (_, fields, block), = warc.records(good)
    assert warc.parsed(fields, block)[6]
    wrong = warc.member(warc.record(1, "u", b"payload", warc.digest(b"other"), None))
    (_, fields, block), = warc.records(wrong)
    assert not warc.parsed(fields, block)[6]
    lies = warc.member(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")
    for bad in (good[:-9], lies, warc.member(b"no header"), warc.member(b"HTTP/1.1 200\r\nContent-Length: 0\r\n\r\n\r\n\r\n")):
        with pytest.raises(warc.Malformed):
            list(warc.records(bad))


def test_broken_archives_are_findings(spark, tmp_path):
    good = [warc.member(warc.record(i, "u", b"payload", warc.digest(b"payload"), None)) for i in (1, 2, 3)]
    odd = [warc.member(b"WARC/1.1\r\nContent-Length: many\r\n\r\nx\r\n\r\n"), warc.member(b"no header"), warc.member(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n")]
    content = {"a": good[0] + odd[0] + good[1] + odd[1] + odd[2] + good[2], "b": good[0] + good[1][:-9], "c": b"not gzip at all", "d": b""}
    rows = []
    for n, c in content.items():
        (tmp_path / n).write_bytes(c)
        rows.append((str(tmp_path / n), bytearray(c)))
    cells = spark.createDataFrame(rows, "path string, content binary")
    for files in (cells, cells.select("path")):
        got = warc.read(files).collect()
        seen = {n: sorted((r.offset, r.page_id, r.record_type, r.verified, r.error is None) for r in got if r.path.endswith("/" + n)) for n in content}
        assert [x[1:] for x in seen["a"]] == [(1, "response", True, True), (None, "malformed", False, False), (2, "response", True, True), *[(None, "malformed", False, False)] * 2, (3, "response", True, True)]
        assert [x[1] for x in seen["b"]] == [1, None] and len(seen["c"]) == 1 and seen["d"] == []
    assert warc.local_path("file:///x/y") == warc.local_path("/x/y") == "/x/y" and warc.local_path("viewfs://a/b") is None


def test_archives_are_files(spark, pages, tmp_path):
    got = warc.archived(pages, str(tmp_path / "w")).collect()
    names = list((tmp_path / "w" / "files").glob("*.warc.gz"))
    assert names and {r.path for r in got} <= {str(n) for n in names} and len(got) == pages.count()
    import gzip

    assert sum(gzip.decompress(n.read_bytes()).count(b"WARC-Type: ") for n in names) == pages.count()


def test_revisits_are_held_to_their_responses(spark):
    a, b = b"payload", b"another"
    found = [
        warc.record(1, "u", a, warc.digest(a), None), warc.record(2, "u", a, warc.digest(a), 1), warc.record(3, "u", b, warc.digest(b), 1),
        warc.record(4, "u", a, warc.digest(a), 99), warc.record(5, "u", a + a, warc.digest(a), 1),
        warc.record(6, "u", b, warc.digest(a), None), warc.record(7, "u", b, warc.digest(a), 6),
    ]
    content = b"".join(map(warc.member, found))
    files = spark.createDataFrame([("x", bytearray(content))], "path string, content binary")
    for payloads in (False, True):
        got = {r.page_id: r.verified for r in warc.read(files, payloads).collect()}
        assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}


def test_files_read_by_spark(spark, pages, tmp_path):
    for f in warc.archives(pages, 600).collect():
        (tmp_path / f.path).write_bytes(f.content)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(str(tmp_path))
    assert warc.read(files).count() == pages.count()


# ---- nearest neighbours -----------------------------------------------------


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0) for i, row in zip(ids, x)], "vec_id long, embedding array<float>, label int")


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1500, 24)), rng.normal(size=(1, 24)) * 2 + rng.normal(size=(700, 24)) * 0.01]).astype(np.float32).astype(np.float64)
    ids = rng.permutation(len(x) * 3)[: len(x)]
    want = brute(ids, x, 20, 20)
    got = {}
    for r in ann.nearest(frame(spark, ids, x)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    hits = sum(len({v[0] for v in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    by = dict(zip(ids.tolist(), x))
    for q, found in got.items():
        ordered = [found[r] for r in sorted(found)]
        assert all(s == (by[q] * by[v]).sum() for v, s in ordered) and ordered == sorted(ordered, key=lambda p: (-p[1], p[0]))


def test_parallel_error_is_penalised():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def parallel(books):
        back = books.centres[np.arange(16), books.encode(x)].reshape(len(x), -1)
        return np.abs(((x - back) * x).sum(axis=1)).mean()

    centres = ann.fit(x).centres
    even, aware, strict = (parallel(ann.Codebooks(centres, eta)) for eta in (1.0, ann.weight(64), 20.0))
    assert ann.weight(64) > 2 and even > aware > strict


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (20, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 2.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 1.0]),
            (6, [inf, 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, [1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (40, [0.0, 0.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2.0 AS score", "'x' AS v")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.nearest(df.limit(0)).collect() == [] and ann.nearest(df.where("vec_id = 0")).collect() == []


# ---- preference formatting --------------------------------------------------


def test_preferences(spark):
    same = [(0, "system", "be kind"), (1, "user", "hi <|im_end|>")]
    sides = {
        (1, "chosen"): [*same, (2, "assistant", "good"), (3, "user", "more")], (1, "rejected"): [*same, (2, "assistant", "bad")],
        (2, "chosen"): [(0, "user", "x")], (2, "rejected"): [(5, "user", "x")],  # turn numbers don't matter, order does
        (3, "chosen"): [(0, None, None), (1, "assistant", "é")], (4, "rejected"): [(0, "user", "alone")],
        (None, "chosen"): [(0, "user", "q")],
    }
    rows = [(p, s, t, r, x) for (p, s), turns in sides.items() for t, r, x in [*turns, turns[0]]]  # with a repeated row
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "1 AS c", "2 AS n")
    got = {r.pair_id: r for r in chat_format.preference_examples(turns).collect()}
    one = got[1]
    assert one.n_common == 2 and not one.identical
    assert one.prompt == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi <|​im_end|><|im_end|>\n"
    assert one.chosen == "<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert one.rejected == "<|im_start|>assistant\nbad<|im_end|>\n"
    at, trained = 0, []
    for run in one.chosen_mask:
        trained += [one.chosen[at : at + run.length]] if run.train else []
        at += run.length
    assert at == len(one.chosen) and trained == ["good<|im_end|>\n"]
    assert got[2].identical and got[2].chosen == "" and got[2].n_common == 1
    assert got[3].n_common == 0 and got[3].rejected == "" and [r.train for r in got[3].chosen_mask] == [False, False, False, True]
    assert got[4].prompt == "" and got[4].chosen == "" and "alone" in got[4].rejected
    assert None in got and chat_format.preference_examples(turns.limit(0)).collect() == []


def test_negatives(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "A"), (1, 0, "user", "b"), (1, 1, "assistant", "B"), (2, 0, "user", "c"), (2, 1, "assistant", "C"), (4, 0, "user", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat_format.preference_examples(chat_format.swapped_answers(df)).collect()}
    assert "B<|" in got[0].rejected and "A<|" in got[1].rejected and got[2].rejected == "<|im_start|>assistant\n<|im_end|>\n" and got[4].identical
    plan = chat_format.preference_examples(chat_format.swapped_answers(df))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
