"""WARC archives and media columns: round trips and brute force."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import media, warc
from orderloom.llm.common import scratch_path

PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (None, "http://a/3", "same"), (2, "http://a/2b", "same"), (4, None, None), (5, "http://b/\n", ""), (6, "http://b/6", "é\r\n\r\n" * 3000), (None, "http://c", "lone"), (None, "http://c", "lone")]


@pytest.fixture(scope="module")
def archive(spark):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, record_type string")
    path = scratch_path(spark, "test-warc")
    warc.write_pages(df, path)
    return path


def test_round_trip(spark, archive):
    rows = warc.read_archive(spark, archive, verify=True).collect()
    assert len(rows) == len(PAGES)
    kinds = defaultdict(list)
    for r in rows:
        kinds[r["page_id"]].append((r["record_type"], r["refers_to"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"]).decode()))
    assert kinds[1] == [("revisit", 2, 4, None)] and kinds[2] == [("response", None, 4, "same")] * 2
    assert sorted(kinds[None], key=str) == sorted([("revisit", 2, 4, None), ("response", None, 4, "lone"), ("response", None, 4, "lone")], key=str)
    assert kinds[4] == [("revisit", 5, 0, None)] and kinds[5] == [("response", None, 0, "")] and kinds[6] == [("response", None, 18_000, PAGES[6][2])]
    assert {r["payload_digest"] for r in rows if r["page_id"] == 1} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}


def test_min_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc")
    warc.write_pages(df, path, min_bytes=1)
    assert {r["record_type"] for r in warc.read_archive(spark, path).collect()} == {"response"}
    path = scratch_path(spark, "test-warc")
    warc.write_pages(df.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_predicates(spark, archive):
    where = lambda *w: warc.read_archive(spark, archive, where=list(w))
    assert where(("record_type", "=", "revisit")).count() == 3
    assert where(("record_type", "in", ["response"]), ("content_length", ">", 1000)).count() == 1
    assert where(("target_uri", "prefix", "http://a/")).count() == 4 and where(("target_uri", "not null", None)).count() == 8
    assert warc.read_archive(spark, archive, pushdown=True).filter("record_type = 'revisit' AND payload IS NULL").count() == 3
    assert warc.read_archive(spark, archive, payload=False).filter("payload IS NOT NULL").count() == 0


def test_foreign_archives():
    """Plain records, gzip members without the length field and one member after another."""
    one = warc.record([("WARC-Type", "response"), ("A", "1")], b"x" * 100_000)
    two = warc.record([("WARC-Type", "request")], b"\r\n\r\nabc")
    for make in (lambda r: r, lambda r: gzip.compress(r), warc.member):
        data = b"".join(make(r) for r in (one, two, one))
        got = [(h["warc-type"], b) for h, b in warc.records(io.BytesIO(data), lambda h: True)]
        assert got == [("response", b"x" * 100_000), ("request", b"\r\n\r\nabc"), ("response", b"x" * 100_000)]
        assert [b for _, b in warc.records(io.BytesIO(data), lambda h: h["warc-type"] == "request")] == [b"\r\n\r\nabc"]
    assert gzip.decompress(warc.member(one)) == one
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"not an archive at all"), lambda h: True))


def test_damage_is_found(spark, archive, tmp_path):
    bad = warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)], b"HTTP/1.1 200 OK\r\n\r\nbody")
    (tmp_path / "x.warc.gz").write_bytes(warc.member(bad))
    with pytest.raises(Exception):
        warc.read_archive(spark, str(tmp_path), verify=True).collect()


def test_op4_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in warc.op4_warc(spark, sf).collect()}
    top = defaultdict(int)
    for p in pages:
        top[p["html"] or ""] = max(top[p["html"] or ""], p["page_id"])
    for p in pages:
        data, t = (p["html"] or "").encode(), top[p["html"] or ""]
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if t == p["page_id"] else "revisit", None if t == p["page_id"] else t)
        r = got[p["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want


def test_formats():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (4, 3, 3), (1, 1), (6, 24)):
        image = rng.integers(0, 256, shape, "u1")
        assert (media.decode(media.encode_pgm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    assert media.decode(b"P2 # c\n2 1\n255\n7 9").tolist() == [[7, 9]]
    assert media.decode(b"P1\n3 2\n101\n0 1 0").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P4\n10 1\n\xff\x40").tolist() == [[1] * 8 + [0, 1]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (48, 64), "u1")
    assert np.allclose(media.area_resize(image, 16, 16), image.reshape(16, 3, 16, 4).mean(axis=(1, 3)))
    small = rng.integers(0, 256, (3, 5), "u1")
    up = np.repeat(np.repeat(small, 7, axis=0), 4, axis=1)  # 21 by 20
    assert np.allclose(media.area_resize(small, 7, 4), up.reshape(7, 3, 4, 5).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(small, 9, 8).mean(), small.mean())
    tile = np.load(io.BytesIO(media.npy_tile(image)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8
    assert media.difference_hash(np.tile(np.arange(9, dtype="u1") * 20, (8, 1))) == "f" * 16


def test_op9_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in media.op9_media(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        data = (d["text"] or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        form = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())


def test_media_odd_rows(odd, empty, spark):
    for form in ("pgm", "bmp"):
        out = media.media_features(media.text_media(odd, form=form))
        rows = out.collect()
        assert len(rows) == odd.count() and media.media_features(media.text_media(empty, form=form)).count() == 0
        assert {r["payload_bytes"] for r in rows if r["n_bytes"] == 0} == {576}
        assert len({r["dhash"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert media.media_features(spark.createDataFrame([(None,)], "media binary")).first()["dhash"] is None


def _shares(n, k):
    """By cell of k equal ones over n places: what of each place lies in it, in k-ths."""
    return [[max(0, min((i + 1) * k, (c + 1) * n) - max(i * k, c * n)) for i in range(n)] for c in range(k)]


def _means(image, height, width):
    """Exact means over equal areas, as (numerator, denominator)."""
    rows, cols = np.array(_shares(image.shape[0], height), object), np.array(_shares(image.shape[1], width), object)
    return rows @ image.astype(object) @ cols.T, image.shape[0] * image.shape[1]


def test_features_equal_exact_means(spark, sf):
    """Difference hash and tile of every text of a table against whole-number arithmetic; a tie may round either way."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in media.write_tiles(media.text_media(docs)).collect():
        image = media.bytes_image(texts[r["doc_id"]])
        num, den = _means(image, 8, 9)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r["dhash"]), "u1")).reshape(8, 8)
        for y in range(8):
            for x in range(8):
                gap = num[y, x + 1] - num[y, x]
                assert abs(gap) * 1_000_000 <= 2 * den or bits[y, x] == (gap > 0)
        num, den = _means(image, media.TILE, media.TILE)
        tile = media.read_tile(bytes(r["tile"]))
        for got, n in zip(tile.ravel().tolist(), num.ravel().tolist(), strict=True):
            assert abs(2 * (got * den - n)) <= den + den // 1_000_000 + 1


def test_blocks_that_are_not_needed_are_stepped_over(spark, tmp_path):
    """Headers alone, by plain records, members of known and of unknown length; payload lengths come from the headers."""
    import gzip

    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 200_000
    plain = warc.record([("WARC-Type", "response"), ("X-Payload-Length", "200000")], block)
    for data in (plain, warc.member(plain), gzip.compress(plain)):
        for need, want in ((True, block), (False, None)):
            got = list(warc.records(io.BytesIO(data * 3), lambda h: True, lambda h, need=need: need))
            assert [b for _, b in got] == [want] * 3 and all(h["x-payload-length"] == "200000" for h, _ in got)
        assert list(warc.records(io.BytesIO(data), lambda h: False)) == []
    (tmp_path / "a.warc.gz").write_bytes(warc.member(plain) + gzip.compress(plain))
    read = lambda **how: [tuple(r) for r in warc.read_archive(spark, f"file://{tmp_path}", **how).select("record_type", "payload_bytes", F.octet_length("payload")).collect()]
    assert read(payload=False) == [("response", 200_000, None)] * 2 and read() == [("response", 200_000, 200_000)] * 2


def test_broken_images_are_their_rows_faults(spark):
    whole = media.encode_bmp(np.arange(576, dtype="u1").reshape(24, 24))
    broken = [b"", b"P5", b"P5\n3 3\n255\n12", b"P2\n2 2\n255\n1 x", b"BM", whole[:60], b"GIF89a", b"P5\n0 0\n255\n", b"P9 1 1"]
    rows = media.media_features(spark.createDataFrame([(i, b) for i, b in enumerate([whole, *broken])], "i int, media binary")).orderBy("i").collect()
    assert rows[0]["fault"] is None and rows[0]["payload_bytes"] == 576
    assert all(r["fault"] and r["dhash"] is None and r["tile"] is None for r in rows[1:])
