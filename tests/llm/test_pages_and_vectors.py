"""Revisit resolution and vector search against brute force."""

import math
import random

import pytest

from stardeck.llm import rotated_codes, warc_revisits

RECORD = "record_id long, ts long, url string, kind string, headers map<string,string>, status string, refers_to long"


def record(i, ts, url, kind, **headers):
    return (i, ts, url, kind, {k.replace("_", "-"): v for k, v in headers.items()}, "clash", None)


def resolved(spark, rows, **how):
    return {r["record_id"]: r for r in warc_revisits.resolve(spark.createDataFrame(rows, RECORD), **how).collect()}


def test_revisits(spark):
    rows = [
        record(1, 10, "http://www.A.com:80/x/?b=2&utm_s=1&a=1#f", "response", etag='"1"', content_length="9", cache_control="old"),
        record(2, 20, "https://a.com/x?a=1&b=2", "response", etag='"2"', last_modified="d1"),
        record(3, 20, "https://a.com/x?a=1&b=2", "response", etag='"3"', last_modified="d2"),
        record(10, 15, "http://a.com/x?a=1&b=2", "revisit", etag='W/"1"', cache_control="new", content_length="0"),
        record(11, 20, "http://a.com/x?a=1&b=2", "revisit", etag='"1"'),
        record(12, 30, "http://a.com/x?a=1&b=2", "revisit", etag='"2"'),
        record(13, 31, "http://a.com/x?a=1&b=2", "revisit", last_modified="d2"),
        record(14, 32, "http://a.com/x?a=1&b=2", "revisit", expires="never"),
        record(15, 5, "http://a.com/x?a=1&b=2", "revisit", etag='"1"'),
        record(16, 40, "http://b.com/", "revisit", etag=None),
        (17, None, "http://a.com/x?a=1&b=2", "revisit", None, None, None),
        (18, 50, None, "revisit", {"etag": '"1"'}, None, None),
        (19, 50, None, "response", {"etag": '"1"'}, None, None),
    ]
    got = resolved(spark, rows, spans=3)
    assert {i: (r["status"], r["refers_to"]) for i, r in got.items()} == {
        10: ("merged", 1), 11: ("merged", 1), 12: ("mismatch", 3), 13: ("merged", 3), 14: ("unchecked", 3),
        15: ("missing", None), 16: ("missing", None), 17: ("missing", None), 18: ("missing", None),
    }
    assert got[10]["headers"] == {"etag": 'W/"1"', "content-length": "9", "cache-control": "new"}


@pytest.mark.parametrize("spans", [1, 7, 64])
def test_revisits_of_a_hot_url(spark, spans):
    rnd = random.Random(spans)
    rows = [record(i, rnd.randrange(60), "http://hot.org/" if i % 3 else f"http://h{i % 5}.org/", rnd.choice(["response", "revisit"]), etag='"e"') for i in range(300)]
    got = resolved(spark, rows, spans=spans)
    for i, ts, url, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, t, u, k, *_ in rows if k == "response" and u == url and t < ts]
            assert got[i]["refers_to"] == (max(earlier)[1] if earlier else None)


def test_responses_of_one_id(spark):
    """In any order of the rows the greatest sorted headers count."""
    rows = [
        record(1, 10, "http://a.com/", "response", etag='"1"', x="a"), record(1, 10, "http://a.com/", "response", etag='"1"', x="b"),
        record(1, 10, "http://a.com/", "response", etag='"1"', a="z"), (1, 10, "http://a.com/", "response", None, None, None),
        record(2, 20, "http://a.com/", "revisit", etag='"1"'), record(2, 20, "http://a.com/", "revisit", etag='"1"'),
    ]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = warc_revisits.resolve(spark.createDataFrame(order, RECORD)).collect()
        assert [(r["status"], r["headers"]) for r in got] == [("merged", {"etag": '"1"', "x": "b"})] * 2


def test_revisits_of_nothing(spark):
    assert resolved(spark, []) == {}
    pages = spark.createDataFrame([(None, None, None), (1, "http://a.org/", None)], "page_id long, url string, html string")
    assert warc_revisits.resolve(warc_revisits.crawls(pages)).count() == 4


def test_crawls_interleave(spark):
    """The query's records ask for an as-of join: all outcomes occur, and a URL's last response is often not the one that is meant."""
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.org/", f"page {i}") for i in range(200)], "page_id long, url string, html string")
    rows = [tuple(r) for r in warc_revisits.crawls(pages).collect()]
    got = {r["record_id"]: r for r in warc_revisits.resolve(warc_revisits.crawls(pages), spans=5).collect()}
    assert {r["status"] for r in got.values()} == {"merged", "mismatch", "unchecked", "missing"}
    late = 0
    for i, ts, url, kind, _ in rows:
        if kind == "revisit":
            of = [(t, j) for j, t, u, k, _ in rows if k == "response" and u == url.removesuffix("#again")]
            earlier = [x for x in of if x[0] < ts]
            assert got[i]["refers_to"] == (max(earlier)[1] if earlier else None)
            late += bool(earlier) and max(of) != max(earlier)
    assert late > 100


def test_kinds_of_records(spark):
    rows = [
        ("revisit", "http://netpreserve.org/warc/1.1/revisit/server-not-modified", None, "revisit"), ("Revisit ", None, 304, "revisit"),
        ("revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", 200, None), ("revisit", None, None, None),
        ("response", None, 200, "response"), ("response", None, None, "response"), ("response", None, 404, None), ("request", None, None, None), (None, None, 304, None),
    ]
    made = spark.createDataFrame(rows, "t string, p string, s int, want string")
    kind = warc_revisits.record_kind(*[made[c] for c in "tps"])
    assert made.where(~kind.eqNullSafe(made["want"])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")


def exact(rows, wanted, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if wanted(q):
            near = sorted({(math.dist(a, b), i) for i, b in good if i != q and len(a) == len(b)})[:k]
            out[q] = [(i, round(d, 6)) for d, i in near]
    return out


def test_search(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(12)]) for i in range(400)]
    rows += [(400 + i, rows[8][1]) for i in range(30)] + [rows[3], rows[3]]
    rows += [(500, None), (501, []), (502, [0.0] * 12), (503, [float("nan")] * 12), (504, [1.0, None] * 6), (505, [float("inf")] * 12), (None, rows[1][1]), (508, [1.0, 2.0]), (512, [1.0, 3.0])]
    table = vectors(spark, rows)
    for how in ({}, {"shard": 50, "block": 7}):
        got = {}
        for r in rotated_codes.search(table, table.where("vec_id % 4 = 0"), k=5, eps=4.0, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
        want = exact(rows, lambda i: i % 4 == 0, 5)
        hits = sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items())
        assert hits >= 0.98 * sum(map(len, want.values()))
        assert got[8] == want[8] and got[508] == want[508]


def found(table, queries, **how):
    got = {}
    for r in rotated_codes.search(table, queries, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
    return got


@pytest.mark.parametrize("shard", [8192, 60])
def test_search_among_repeated_rows(spark, shard):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(12)]) for i in range(300)]
    once, thrice = vectors(spark, rows), vectors(spark, rows * 3)
    # with a bound that leaves nothing out the neighbours are those of brute force
    asked = once.where("vec_id % 10 = 0")
    assert found(thrice, thrice.where("vec_id % 10 = 0"), eps=1e6, shard=shard) == exact(rows, lambda i: i % 10 == 0, 10)
    # and at the parameters of the query repeats change nothing
    assert found(thrice, asked, shard=shard) == found(once, asked, shard=shard)


def test_search_where_a_near_row_is_repeated(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16)]) for i in range(200)]
    rows += [(7, rows[7][1])] * 11 + [(8, [x + 0.001 for x in rows[0][1]])] * 12
    table = vectors(spark, rows)
    for shard in (8192, 50):
        got = found(table, table.where("vec_id % 100 = 0"), eps=1e6, shard=shard)
        assert got == exact(rows, lambda i: i % 100 == 0, 10) and {len(x) for x in got.values()} == {10}
        assert all(len(x) == 10 for x in found(table, table.where("vec_id % 100 = 0"), shard=shard).values())


def test_search_of_an_id_with_vectors_at_one_distance(spark):
    mirrored = [(1, [1.0, 0.0]), (1, [-1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, -1.0]), (2, [1.5, 0.0]), (3, [0.0, 2.0]), (4, [5.0, 5.0])]
    rows = [*mirrored, (0, [1e-30, 0.0])]
    table = vectors(spark, rows)
    assert found(table, table.where("vec_id = 0"), k=3, eps=1e6) == {0: [(1, 1.0), (2, 1.5), (3, 2.0)]}


def test_search_of_nothing(spark):
    none = vectors(spark, [])
    assert rotated_codes.search(none, none).count() == 0
    one = vectors(spark, [(0, [1.0, 2.0])])
    assert rotated_codes.search(one, one).count() == 0


def test_estimates_lie_within_their_bounds():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 64))
    turn, centre = rotation = (rotated_codes.rotation(64, 7), x.mean(axis=0))
    assert np.allclose(rotation[0] @ rotation[0].T, np.eye(64))
    codes, norm, corr = rotated_codes.encode(x, centre, turn)
    q = (rng.standard_normal(64) - centre) @ turn
    inner = sum(rotated_codes._tables(q, 8)[b][codes[:, b]] for b in range(8)) / 8 / corr
    truth = ((x - centre) @ turn) @ q / norm
    bound = 3 * np.sqrt(1 - corr**2) / corr / np.sqrt(63) * np.linalg.norm(q)
    assert (np.abs(inner - truth) <= bound).mean() > 0.99
