"""Exact top-k, URL filters, media columns and language ID."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from solfa.llm import bit_sliced, language, media, registry, url_filter
from tests.conftest import SF_DIR

# top-k


def brute_top(vectors: dict[int, list[int]], queries: list[int], k: int):
    out = set()
    for q in queries:
        scores = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("block, query_block", [(16_384, 128), (70, 5)])
def test_top(spark, block, query_block):
    own = np.random.default_rng(1)
    vectors = {i: own.integers(-300, 300, 8).tolist() for i in range(300)}
    vectors |= {i: vectors[i % 7] for i in range(300, 360)}  # ties
    vectors |= {360: [0] * 8, 361: [1, 2], 362: [3, 4], 363: [7] * 3}
    rows = spark.createDataFrame(list(vectors.items()), "id long, v array<long>")
    asked = [i for i in vectors if i % 10 == 0 or i > 360]
    found = bit_sliced.top_k(rows, rows.filter("id % 10 = 0 or id > 360"), 5, block, query_block).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == brute_top(vectors, asked, 5)


def test_no_row_on_the_way_holds_a_block(spark):
    own = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, own.integers(-9, 9, 4).tolist()) for i in range(500)] + [(7, [1] * 4), (600, [1, 2])], "id long, v array<long>")
    met = bit_sliced.units(rows, rows.filter("id % 10 = 0"), 100, 20)
    assert dict(met.dtypes)["v"] == "array<bigint>"  # a row is a vector, whatever the size of a block
    found = met.withColumn("task", F.spark_partition_id()).groupBy("unit").agg(F.count_if(~F.col("asks")).alias("held"), F.count_if("asks").alias("asked"), F.count_distinct("task").alias("tasks"))
    found = {r["unit"]: r for r in found.collect()}
    parts = len(found) // 6
    assert len(found) == 6 * parts and all(r["tasks"] == 1 and r["held"] <= 108 for r in found.values())
    assert sum(r["held"] for r in found.values()) == 502 * parts and sum(r["asked"] for r in found.values()) == 51 * 6


def test_vectors_that_take_no_part(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (6, [1.0, 2.0])]
    kept = bit_sliced.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["id"]: r["v"] for r in kept} == {0: [128, -1], 6: [256, 512]}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, v array<long>")
    assert bit_sliced.top_k(none, none, 5).count() == 0


# urls


def brute_url(url: str | None):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[1:]) if fits else (None, "allow"))


URLS = [
    None, "", "x", "http://", "http://net/", "http://net", "http://NET/?q", "http://a.net/x", "http://xnet/", "https://Example.NET/en/", "http://www.example.net/en/a?b#c",
    "http://example.net/en", "http://example.com/de/", "http://a.b.example.com/de/x", "http://example.com/fr/", "http://org/fr/", "http://x.org/fr/y", "http://x.org/de/",
    "a://b://net/", "http://É.net/é", "http://net\n/x", "http://.net/", "http://net./", "http://u@net:80/", "http://www.example.com?/de/", "http://" + "a." * 300 + "net/", "//net/",
]


def test_urls(spark):
    rows = [(i, u, "r", None) for i, u in enumerate([*URLS, *URLS])]
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string, host string"), url_filter.RULES).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == {i: brute_url(u) for i, u, _, _ in rows}


def test_cascade_is_exact(spark):
    listed = spark.range(0, 400).selectExpr("concat('k', id * 7) as key")
    universe = spark.range(0, 20_000).selectExpr("concat('k', id) as key")
    cascade = url_filter.Cascade(listed, universe, 20_000)
    assert len(cascade.levels) > 1
    inside = {r["key"] for r in universe.filter(cascade.has(universe["key"])).collect()}
    assert inside == {f"k{7 * i}" for i in range(400)}


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.RULES).count() == 0
    assert url_filter.judge(none, []).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.ORACLES[name])


# media

RAWS = [b"", b"a", b"a", b"\0\xff" * 96, bytes(range(256)) * 30, "é日🙂".encode() * 500, np.random.default_rng(4).bytes(70_000)]


@pytest.mark.parametrize("raw", RAWS)
def test_payload_comes_back(raw):
    payload = media.padded_payload(raw)
    assert len(payload) % 192 == 0 and len(payload) >= max(192, len(raw)) and payload[: len(raw)] == raw
    planes, factors, width, height, length = media.coefficients(media.encode(payload))
    assert media.payload_of(planes, length) == payload
    tensor = media.tensor(media.encode(payload))
    assert tensor.shape == (height, width, 3) and tensor.dtype == np.uint8
    assert media.feature(planes, factors, width, height) == media.feature(planes, factors, width, height)


def test_strips_are_as_the_whole():
    planes, factors, width, height, _ = media.coefficients(media.encode(media.padded_payload(np.random.default_rng(8).bytes(2_000_000))))
    strips = list(media.rgb_strips(planes, factors, width, height))
    assert len(strips) > 1 and sum(len(x) for x in strips) == height


def test_media_columns(spark):
    texts = [None, "", "x", "x", "long text " * 5000, "é" * 100]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, media string")
    found = {r["doc_id"]: r for r in media.digests(rows).collect()}
    for i, text in enumerate(texts):
        payload = media.padded_payload((text or "").encode())
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert [found[2][c] for c in found[2].asDict() if c != "doc_id"] == [found[3][c] for c in found[3].asDict() if c != "doc_id"]
    back = {r["doc_id"]: r for r in media.read(media.store(rows)).collect()}
    assert all(bytes(back[i]["payload"]) == media.padded_payload((t or "").encode()) for i, t in enumerate(texts))
    assert all(len(r["tensor"]) == 3 * r["height"] * r["width"] for r in back.values())
    assert media.digests(rows.limit(0)).count() == 0


# languages


def test_held_out_accuracy(spark):
    rows = language.op1_language_id(spark, SF_DIR).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.85


def test_texts_without_a_language(spark):
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog " * 20, "en"), ("le chat et le chien " * 20, "fr")] * 10)]
    docs += [(20, None, "en"), (21, "", None), (22, "123 !?", None), (23, "the dog", None), (24, "le chien " * 30_000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame, language.trained(frame)).collect()}
    assert [found[i] for i in (20, 21, 22)] == [("und", 0.0)] * 3
    assert (found[23][0], found[24][0]) == ("en", "fr")
    nothing = language.trained(frame.filter("lang = 'xx'"))
    assert {r["lang_pred"] for r in language.identify(frame, nothing).collect()} == {"und"}
    assert language.identify(frame.limit(0), nothing).count() == 0
