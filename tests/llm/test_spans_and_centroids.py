"""Benchmark decontamination, periodic runs and centroid clustering against plain Python."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest
from cases import SCHEMA, doubled, edge, none, prose  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import centroids, decontamination, periodic_runs
from riskframe.llm.queries import looped

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PLAIN.findall((text or "").translate(brute.LOW))


# ---- decontamination

def leaks(docs, items):
    """docs: (key, text), items: (id, text) -> {key: (words, hit places, sorted items)}"""
    phrases = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            phrases.setdefault(tuple(w[i:i + 10]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = {}
    for key, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[tuple(w[i:i + n])]
        out[key] = (len(w), hit, sorted(x for x in found if x is not None))
    return out


def places(row):
    return {k for s in row.spans for k in range(s.start, s.end)}


ITEMS = [("7", prose(2, 70)), ("10", prose(2, 70)), ("2", prose(2, 12)), (None, "spam spam spam spam spam spam spam spam spam spam"),
         ("s", "ONE two"), ("e", ""), ("n", None), ("p", "... !!!"), ("7", "a B c-d"), ("u", "Σσς é ü ñ"), ("x", prose(99, 40)),
         ("r", "spam " * 30), ("é", "日本語 😀")]


@pytest.mark.parametrize("shard,block", [(1 << 20, 200_000), (50, 80)])
def test_leaks_equal_brute_force(spark, edge, none, doubled, monkeypatch, shard, block):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontamination, "PIECE", 10 if block == 80 else 1000)
    items = spark.createDataFrame([(i, t, 1, "s") for i, t in ITEMS], "item_id string, text string, spans int, items string")
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    expected = leaks(rows, ITEMS)
    out = decontamination.contaminated_words(edge, items, block=block)
    assert out.columns == ["doc_id", "n_words", "n_hit", "spans", "items"]
    got = out.collect()
    assert len(got) == len(rows) and sum(r.n_hit > 0 for r in got) > 5
    for r in got:
        n, hit, found = expected[r.doc_id]
        assert (r.n_words, r.n_hit, places(r), r["items"]) == (n, len(hit), hit, found), r.doc_id
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert decontamination.contaminated_words(none, items).count() == 0
    clean = decontamination.contaminated_words(edge, items.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.n_hit or r.spans or r["items"] for r in clean)
    twice = decontamination.contaminated_words(doubled, items).collect()
    assert len(twice) == doubled.count()
    assert all((r.n_hit, r["items"]) == (len(expected[r.doc_id][1]), expected[r.doc_id][2]) for r in twice if r.doc_id is not None)


@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=6),
       st.lists(st.integers(1, 4), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_index_locates_every_occurrence(stretches, phrase):
    flat = np.array([x for s in stretches for x in s], dtype=np.uint64)
    lengths = np.array([len(s) for s in stretches])
    index = decontamination.ShardIndex(flat, lengths, rate=3)
    found = sorted(p for _, place in index.occurrences(np.array([phrase], dtype=np.uint64)) for p in place.tolist())
    first, m = index.first.tolist(), len(phrase)
    assert found == sorted(first[k] + i for k, s in enumerate(stretches) for i in range(len(s) - m + 1) if s[i:i + m] == phrase)


def test_copies_of_one_passage_in_every_document(spark):
    passage = prose(5, 30)
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('k', id, ' ', '{passage}', ' ', id) AS text")
    out = decontamination.contaminated_words(docs, spark.createDataFrame([("a", passage)], "item_id string, text string"))
    n = len(plain_words(passage))
    assert {(r.n_hit, tuple(r["items"]), r.spans[0].start) for r in out.collect()} == {(n, ("a",), 1)}


# ---- periodic runs

def runs_of(words):
    """Every lag, every stretch; a stretch's smallest lag is its period."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def found_runs(*texts):
    flat = np.array([w for t in texts for w in t], dtype=np.int64)
    ends = np.cumsum([len(t) for t in texts])
    return [tuple(r) for r in periodic_runs.scan_lags(flat, *periodic_runs.split_segments(flat, ends - [len(t) for t in texts], ends)).tolist()]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [[], [1] * 23, [1] * 24, [1] * 500, thue_morse(5000), fibonacci(900), [1, 2] * 60 + [3] + [1, 2] * 60,
                                   [1, 2, 1, 1, 2, 1] * 30, (list(range(40)) * 4)[:119], (list(range(40)) * 4)[:120], list(range(300)) * 3 + [7],
                                   [5] + [1] * 30 + [2] + [1] * 30 + [5], ([1] * 25 + [2]) * 7])
def test_runs_of_known_sequences(words):
    assert found_runs(words) == runs_of(words)


@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.integers(1, 9)), max_size=5), min_size=1, max_size=3))
@settings(max_examples=200, deadline=None)
def test_runs_of_drawn_sequences(parts):
    texts = [[w for piece, times in t for w in piece * times] for t in parts]
    at, expected = 0, []
    for t in texts:
        expected += [(at + s, n, q) for s, n, q in runs_of(t)]
        at += len(t)
    assert found_runs(*texts) == expected


def test_rare_words_split_until_stable():
    # 9 stands three times, but 8 cuts one of them off; then 9 is rare in the rest and cuts it too
    words = np.array([9, 8] + [1] * 26 + [9] + [2] * 24 + [9] + [3] * 10)
    starts, ends = periodic_runs.split_segments(words, np.array([0]), np.array([len(words)]))
    assert list(zip(starts.tolist(), ends.tolist())) == [(2, 28), (29, 53)]


def test_periodic_runs_of_documents(spark, edge, none, doubled):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    out = periodic_runs.periodic_runs(edge)
    assert out.columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and any(r.runs for r in got.values())
    for i, text in rows:
        w = brute.words(text)
        if len(w) > 5000:
            continue                        # the plain version is quadratic
        expected = runs_of(w)
        assert [tuple(r) for r in got[i].runs] == expected and got[i].n_words == len(w)
        gone = {k for s, n, q in expected for k in range(s + q, s + n)}
        assert got[i].collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)
        best = max(expected, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if expected else None
        assert (tuple(got[i].strongest) if got[i].strongest else None) == best
    assert periodic_runs.periodic_runs(none).count() == 0
    again = periodic_runs.periodic_runs(doubled).collect()
    assert len(again) == doubled.count() and all(r.runs == got[r.doc_id].runs for r in again if r.doc_id is not None)


def test_looped_texts_and_digests(spark, edge):
    import __spark_entry__ as entry
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts = {r.doc_id: r.text for r in looped(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    got = {r.doc_id: r for r in entry.queries()["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        w, h = brute.words(text), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        assert brute.words(texts[i]) == w
        if n < 1500:
            expected = runs_of(w)
            assert got[i].n_runs == len(expected)
            assert got[i].runs_sha256 == brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in expected))
    rows = looped(edge.select("doc_id", "text")).collect()
    assert len(rows) == edge.count()


# ---- centroids

def lloyd(rows, clusters, rounds, size, scale, seed):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centres = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, g in groups.items():
            centres[k] = [sum(c) // len(g) for c in zip(*g)]
    return sorted(((i, *reversed(nearest(v))) for i, v in kept), key=repr), centres


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    rows = [(k, (r.normal(size=4) * 0.3 + (k % 5)).tolist()) for k in range(300)]
    rows += [(400 + k, [0.25, -0.25, 1.0, 2.0]) for k in range(150)]                    # one vector, many times
    rows += [(400, [0.25, -0.25, 1.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0]), (600, None), (601, []), (602, [1.0, 2.0, 3.0]),
             (603, [1.0, None, 2.0, 3.0]), (604, [1.0, float("nan"), 0.0, 0.0]), (605, [1.0, float("inf"), 0.0, 0.0]),
             (606, [1.0] * 5), (607, [100.0, -100.0, 0.0, 0.0])]
    return rows, spark.createDataFrame([(*x, 1, 0.5) for x in rows], "vec_id long, embedding array<double>, cluster int, distance double")


@pytest.mark.parametrize("clusters,group", [(7, 3), (12, 5), (1, 10), (1000, 10)])
def test_clusters_equal_full_scans(spark, vectors, clusters, group):
    rows, frame = vectors
    expected, centres = lloyd(rows, clusters, 4, 4, 16.0, 2)
    got, final = centroids.cluster(frame, clusters=clusters, rounds=4, size=4, scale=16.0, group=group)
    assert got.columns == ["vec_id", "cluster", "distance"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected and final.tolist() == centres


def test_clusters_of_nothing(spark, vectors):
    none, final = centroids.cluster(vectors[1].limit(0), size=4)
    assert none.count() == 0 and len(final) == 0
    too_large = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(too_large, size=2)


def test_bounds_spare_distances_and_stay_exact():
    r = np.random.default_rng(1)
    x = (r.normal(size=(4000, 16)) * 20 + r.integers(0, 12, 4000)[:, None] * 60).astype(np.int64)
    history, state, counts = [x[:24].copy()], None, []
    for _ in range(8):
        state = centroids.assign(x, state, history, 6, counts)
        d = ((x[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        history.append(np.stack([x[state[0] == k].sum(axis=0) // max((state[0] == k).sum(), 1) if (state[0] == k).any()
                                 else history[-1][k] for k in range(24)]))
    assert counts[-1] < counts[0] / 4


def test_displacement_is_total_not_summed():
    """A centroid that goes away and comes back leaves the bound as it was: no distance is evaluated."""
    x = np.array([[0, 0]] * 50)
    near, far = [0, 1], [90, 90]
    history, counts = [np.array([near, far])], []
    state = centroids.assign(x, None, history, 1, counts)
    history += [np.array([near, [0, 2]]), np.array([near, far])]
    centroids.assign(x, state, history, 1, counts)
    assert counts[1] == 0


def test_large_components_stay_exact():
    r = np.random.default_rng(5)
    x, c = r.integers(-centroids.LARGEST, centroids.LARGEST, (50, 8)), r.integers(-centroids.LARGEST, centroids.LARGEST, (6, 8))
    expected = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
    assert centroids.squared(x, c).tolist() == expected
    assert centroids.to_own(x, c[np.zeros(50, dtype=int)]).tolist() == [e[0] for e in expected]
