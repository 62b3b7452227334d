"""Archives and vectors against brute force."""

import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from vectide.llm import embedding_dedup, warc
from vectide.llm.common import new_path

PAGES = [
    (0, "http://a.example/", "<html>" + "x" * 200 + "</html>", "r"),
    (1, "http://a.example/ü\r\nX: y", "<html>" + "x" * 200 + "</html>", "r"),
    (2, None, "<p>short</p>", "r"),
    (3, "http://b.example/", "<p>short</p>", "r"),
    (4, "http://c.example/", None, "r"),
    (5, "http://c.example/", "", "r"),
    (6, "http://d.example/", "é\U0001f600\r\n\r\nWARC/1.1\r\n" * 4000, "r"),
    (7, "http://d.example/", "é\U0001f600\r\n\r\nWARC/1.1\r\n" * 4000, "r"),
    (7, "http://d.example/", "é\U0001f600\r\n\r\nWARC/1.1\r\n" * 4000, "r"),  # a repeated row
    (None, "http://e.example/", "<html>" + "x" * 200 + "</html>", "r"),
]


def wanted(pages):
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            k = h or ""
            first[k] = min(first.get(k, i), i)
    out = []
    for i, _, h, _ in pages:
        b = (h or "").encode()
        again = len(b) >= 100 and i is not None and first[h or ""] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archives(spark):
    path = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string").repartition(3), path)
    return path


def test_archives_round_trip(spark, archives):
    got = warc.read_archives(spark, archives)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr) == wanted(PAGES)
    for r in got.where("record_type = 'response'").collect():
        assert r.payload.decode() in [h or "" for i, _, h, _ in PAGES if i == r.page_id]


def test_every_record_is_a_frame_behind_the_dictionary(spark, archives):
    for f in spark.read.format("binaryFile").load(archives).where("length > 0").collect():
        data = bytes(f.content)
        assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY
        for place, raw in warc.records(data):
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
            assert data[place : place + 4] == struct.pack("<I", warc.FRAME)


def archive(*records, dictionary=b"a dictionary of words", **options):
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), **options)
    return struct.pack("<II", warc.DICTIONARY, len(dictionary)) + dictionary + b"".join(c.compress(r) for r in records)


@pytest.mark.parametrize("options", [{}, {"write_checksum": True}, {"write_content_size": False}, {"level": 19}, {"write_dict_id": False}])
def test_frames_of_all_kinds(options):
    rs = [b"", b"x", b"y" * 300000, random.Random(1).randbytes(200000), b"text " * 70]
    data = archive(*rs, **options)
    assert [r for _, r in warc.records(data)] == rs
    assert [r for _, r in warc.records(data + struct.pack("<II", 0x184D2A53, 3) + b"abc")] == rs


def test_broken_archives_are_errors():
    good = warc.record(1, "http://a/", b"payload" * 50, hashlib.sha256(b"payload" * 50).hexdigest(), None)
    data = archive(good)
    assert warc.parse(next(warc.records(data))[1])["payload"] == b"payload" * 50
    for bad in (data[:-1], data[8:], data + b"?", data + b"12345678", archive(good)[:-3] + b"\xff\xff\xff"):
        with pytest.raises(warc.ArchiveError):
            list(warc.records(bad))
    for raw in (good.replace(b"Content-Length: 4", b"Content-Length: 5", 1), good[:-2], good.replace(b"WARC-Date: ", b"X-Date: "), good.replace(b"payloadpay", b"PAYLOADPAY", 1), b"nothing"):
        with pytest.raises(ValueError):
            warc.parse(raw)


def test_no_pages(spark):
    path = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def clusters(seed, n=700, dim=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for i in range(0, n // 2, 7):
        x[i + 1 : i + 5] = x[i] + r.normal(size=(4, dim)) * r.choice([0.001, 0.05, 0.1, 0.2])
    x[40] = x[3] * 7.5  # scaled
    x[41] = x[3]
    return x.astype(np.float32)


@pytest.mark.parametrize("block, leaf, tile", [(4096, 16, 16), (37, 8, 2), (50, 7, 4), (37, 256, 1)])
def test_vectors(spark, monkeypatch, block, leaf, tile):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    x = clusters(1)
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [None] + [1.0] * 15, 0), (1004, [float("nan")] + [1.0] * 15, 0), (None, x[3].tolist(), 0), (1006, [1.0, 0.0], 0), (1007, [2.0, 0.0], 0), (1008, [float("inf")] + [1.0] * 15, 0), (3, x[3].tolist(), 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    y = np.vstack([x, x[3:4]]).astype(np.float64)
    ids = np.append(np.arange(len(x)), 3)
    u = y / np.linalg.norm(y, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    label = ids.copy()
    while True:
        new = np.array([min(label[i], label[hit[i]].min(initial=label[i])) for i in range(len(y))])
        if (new == label).all():
            break
        label = new
    want = sorted(list(zip(ids.tolist(), hit.sum(1).tolist(), label.tolist())) + [(i, 0, i) for i in (1000, 1001, 1002, 1003, 1004, 1008)] + [(1006, 1, 1006), (1007, 1, 1006), (None, 0, None)], key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


@pytest.mark.parametrize("n", [3000, 12000])
def test_distant_leaves_are_skipped(spark, monkeypatch, n):
    """Of vectors in clusters few pairs are compared; of unclustered ones of 64 dimensions nothing can be ruled out."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 512)
    r = np.random.default_rng(2)
    centres = r.normal(size=(n // 60, 24))
    x = (centres[r.integers(0, len(centres), n)] + r.normal(size=(n, 24)) * 0.04).astype(np.float32)
    near, told = embedding_dedup.joined(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    rows, compared = told.first()
    assert rows == n and compared < 0.2 * n * (n + 1) / 2, compared / (n * (n + 1) / 2)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = [(int((u @ u[i] >= 0.95).sum()) - 1) for i in range(0, n, 50)]
    got = {q.vec_id: q.n_links for q in near.collect()}
    assert [got[i] for i in range(0, n, 50)] == links
    near, told = embedding_dedup.joined(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(2000, 64)))], "vec_id long, embedding array<double>"))
    assert told.first().compared <= 2000 * 2000 / 2 + 2000 * 512


def test_no_vectors(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(e).count() == 0


def test_pages_and_vectors_of_the_test_data(spark, sf):
    from vectide.llm import queries

    pages = [(r.page_id, r.url, r.html, "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = queries.op9_warc_zstd(spark, sf)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == wanted(pages)
    near = queries.op10_epsilon_grid_join(spark, sf)
    assert near.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert near.where(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).count() == 0
