"""Centroid clusters, url rules and periodic runs against plain Python, on odd rows and empty tables too."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import centroids, periodic, url_filter

from . import brute

COLUMNS = "vec_id long, embedding array<float>, cluster int, distance string, coefficients int, components string"


def plain_clusters(rows, k, rounds):
    """rows: (vec_id, vector) -> Counter of (vec_id, cluster, distance), and the centroids."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in vector):
            kept.append((vec_id, [math.floor(256 * float(x)) for x in vector]))
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            centres[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), centres


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    some = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(60)]
    exact = lambda v: [float(np.float32(x)) for x in v]
    rows = [(n, exact(v)) for n, v in enumerate(some)]
    rows += [rows[3], rows[3], (7, rows[9][1]), (None, exact(some[4])), (None, exact(some[5])), (100, None), (101, []), (102, [0.5] * 63), (103, [None] + [0.0] * 63)]
    rows += [(104, [math.nan] + [0.0] * 63), (105, [math.inf] + [0.0] * 63), (106, [0.0] * 64), (107, [-0.001] * 64), (108, [400_000.0] * 64), (109, [-500_000.0] * 64), (110, [1e30] * 64)]
    # Two centres at one distance, and one vector over and over.
    return rows + [(200 + n, [1.0 if n % 2 else -1.0] + [0.0] * 63) for n in range(6)] + [(300 + n, [0.25] * 64) for n in range(40)]


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (3, 2), (500, 1)])
def test_clusters(spark, vectors, k, rounds):
    table = spark.createDataFrame([(i, v, 1, "d", 2, "c") for i, v in vectors], COLUMNS).repartition(3)
    found, centres = centroids.clustered(table, k, rounds)
    want, plain = plain_clusters(vectors, k, rounds)
    assert Counter(map(tuple, found.collect())) == want
    assert centres.tolist() == plain


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None, 1, "d", 2, "c")]):
        found, centres = centroids.clustered(spark.createDataFrame(rows, COLUMNS))
        assert found.count() == 0 and len(centres) == 0 and found.columns == ["vec_id", "cluster", "distance"]


def test_transform_is_exact_and_search_stops_early():
    rng = np.random.default_rng(2)
    rows = rng.integers(-200, 200, (500, 64))
    signs = np.array([[(-1) ** (i & j).bit_count() for j in range(64)] for i in range(64)])
    assert (centroids.transform(rows) == rows @ signs[:, centroids.ORDER]).all()
    assert (np.diff((np.diff(signs[centroids.ORDER], axis=1) != 0).sum(1)) >= 0).all()
    assert (centroids.restored(centroids.transform(rows)) == rows).all()
    # Smooth vectors have their differences in the first coefficients.
    smooth = np.cumsum(rng.integers(-20, 20, (500, 64)), 1)
    best, distance, taken = centroids.nearest(centroids.transform(smooth), centroids.transform(smooth[:40]))
    whole = np.square(smooth[:, None] - smooth[None, :40]).sum(2)
    assert (best == whole.argmin(1)).all() and (distance == whole.min(1)).all()
    assert taken < 0.5 * whole.size * 64


def plain_verdict(url, rules, default="allow"):
    behind = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([behind.find(x) for x in "/?#" if x in behind], default=len(behind))
    host = behind[:cut].translate(brute.LOWER)
    rest = behind[cut:]
    path = rest[: min([rest.find(x) for x in "?#" if x in rest], default=len(rest))]
    fits = [(len(h + p), a == "block", h + p, a) for a, h, p in rules if h and p is not None and a and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme/en/", "http://", "http://NET/", "http://net", "http://net?x=/", "https://a.b.NET/x#://org/fr/", "http://example.net/en", "http://example.net/en/", "http://m.Example.Net/en/1?q",
    "http://notexample.net/en/1", "http://example.net/fr/1", "http://example.com/de/", "http://www.example.com/de/9", "http://example.com/en/de/", "http://example.com.de/de/", "http://x.org/fr/1", "http://org/fr/", "http://org/fr",
    "http://example.net:80/en/", "http://u@example.net/en/", "http://net./", "http://.net/", "http://a..net//en//", "ftp://x://net/", "http://éé.net/ü/", "http://" + "a." * 3000 + "net/" + "en/" * 3000, "http://e.org/a/bc/d", "http://e.org/a/b\nc/",
]
MORE = [*url_filter.RULES, ("block", "E.org", "/a/b"), ("allow", "e.org", "/a/b"), ("allow", "e.org", "/a/"), ("allow", "e.org", "/a/bc/"), ("block", "e.org", ""), ("block", "", "/"), ("block", None, "/"), ("block", "org", None)]


@pytest.mark.parametrize("rules", [list(url_filter.RULES), MORE, []])
@pytest.mark.parametrize("most_rules", [100, -1])
def test_urls(spark, rules, most_rules):
    rows = [*enumerate(URLS), (None, URLS[7]), (5, URLS[5]), (5, URLS[5]), (None, None)]
    pages = spark.createDataFrame([(i, u, "h", "p", "r", 1, "t") for i, u in rows], "page_id long, url string, host string, path string, rule string, one int, task string").repartition(3)
    table = spark.createDataFrame(rules, "action string, host string, path string")
    lowered = [(a, h and h.translate(brute.LOWER), p) for a, h, p in rules]
    got = Counter(map(tuple, url_filter.with_verdicts(pages, table, most_rules=most_rules).collect()))
    assert got == Counter((i, *plain_verdict(u, lowered)) for i, u in rows)
    assert url_filter.with_verdicts(pages.filter("false"), table, most_rules=most_rules).count() == 0


def test_repeated_pages_come_back_in_parts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "AT_ONCE", 3)
    pages = spark.createDataFrame([(1, "http://a.net/")] * 10 + [(2, "http://a.com/")] * 3, "page_id long, url string").repartition(2)
    rules = spark.createDataFrame(list(url_filter.RULES), "action string, host string, path string")
    assert Counter(r["page_id"] for r in url_filter.with_verdicts(pages, rules).collect()) == {1: 10, 2: 3}


def plain_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(least, times * q) and all(any(words[j] != words[j + p] for j in range(start, start + size - p)) for p in range(1, q)):
                out.append((start, size, q))
            i += i == start
    return sorted(out)


words_of = st.lists(st.integers(0, 3), max_size=9)


@settings(max_examples=400, deadline=None)
@given(words_of, st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 60), words_of)
def test_runs_of_short_texts(before, phrase, size, after):
    words = before + (phrase * 60)[:size] + after
    assert periodic.runs_of(words) == plain_runs(words)


def test_regions_hold_every_run():
    rng = random.Random(8)
    for _ in range(60):
        texts = []
        for _ in range(4):
            words = [rng.randrange(rng.choice([2, 30, 3000])) for _ in range(rng.randint(0, 90))]
            phrase = [rng.randrange(3000) for _ in range(rng.choice([1, 2, 4, 5, 8, 9, 32, 33, 34, 70]))]
            texts.append(words + (phrase * 6)[: rng.randint(1, 6 * len(phrase))] + words[: rng.randint(0, 20)])
        edges = np.cumsum([0, *map(len, texts)])
        hashes = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)[np.concatenate(texts).astype(int)]
        found: list = [[] for _ in texts]
        for start, end in zip(*map(np.ndarray.tolist, periodic.regions(hashes, edges)), strict=True):
            row = int(np.searchsorted(edges, start, "right")) - 1
            assert end <= edges[row + 1]
            found[row] += [(s + start - int(edges[row]), size, q) for s, size, q in periodic.runs_of(hashes[start:end].tolist())]
        assert [sorted(f) for f in found] == [plain_runs(w) for w in texts]


def plain_rows(rows, numbered):
    out = []
    for doc_id, text in rows:
        words = brute.space_words(text)
        h = zlib.crc32(str(doc_id).encode())
        if numbered and doc_id is not None and words and h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if len(words) < 3000 else periodic.runs_of(words)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        out.append((doc_id, len(words), tuple(runs), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("numbered", [False, True])
def test_runs(spark, edges, edge_rows, empty, numbered):
    more = [(n, " ".join(["eins zwei drei"] * (n % 9) + [f"w{n}", "und"] * (n % 5)) + "\tEnde \n") for n in range(100, 180)]
    rows = [(r[0], r[1]) for r in edge_rows] + more
    table = edges.select("doc_id", "text", "run").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = periodic.find_runs(table, numbered=numbered).collect()
    assert Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in got) == plain_rows(rows, numbered)
    assert periodic.find_runs(empty, numbered=numbered).count() == 0


def test_runs_query(spark, tmp_path):
    rows = [(n, " ".join(f"w{(i * i) % 17}" for i in range(n % 60))) for n in range(300)] + [(None, "a a a a a a"), (1, None), (2, "b c " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for (doc_id, _, runs, kept), n in plain_rows(rows, True).items():
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        told = "".join(f"{s},{size},{q}\n" for s, size, q in sorted(runs, key=lambda r: (r[0], r[2])))
        want += [(doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), brute.sha(told), brute.sha(kept))] * n
    assert Counter(map(tuple, periodic.op13_periodic_runs(spark, str(tmp_path)).collect())) == Counter(want)
    assert any(r[1] for r in want)
