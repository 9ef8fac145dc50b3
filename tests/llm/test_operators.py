"""The operators against plain Python, on edge cases: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import re

import brute
import pytest
from cases import doubled, edge, edge_rows, none  # noqa: F401
from pyspark.sql import functions as F

from riskframe.llm import (
    bpe, cotraining, fingerprint, language_id, minhash_dedup, mixing, quality_rules, secrets, substring_dedup, url_filter,
)
from riskframe.llm.components import connected_components
from riskframe.llm.bpe import word_bpe_file


# ---- URL filter

URLS = [None, "", "no address", "HTTP://WWW.Example.NET/EN/x?y", "http://a.org", "http://a.example.net/en/1#/x", "x://net/",
        "http://É.org/fr/", "https://b.example.com/de/", "https://b.example.com/de", "http://org/fr/a?b://c", "a://b://c",
        "http://x.cheap-pills.example.com/en/1"] + [
        f"http://www.site{k % 7}.example.com/en/{k}" for k in range(60)] + [
        f"http://casino{k % 5}.example.net/fr/{k}" for k in range(40)] + [
        f"https://casino{k % 5}.example.com/en/{k}" for k in range(20)] + ["http://h.org/" + "p" * 30000]


def host_path_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    host, best = m[1].translate(brute.LOW), None
    for rule, verdict in url_filter.RULES.items():
        name, _, path = rule.partition("/")
        if (host == name or host.endswith("." + name)) and m[2].startswith("/" + path) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return (host, m[2], *(best or (None, None)))


def test_url_rules_and_models(spark):
    pages = spark.createDataFrame([(k, u, "h", "p", "r") for k, u in enumerate(URLS)],
                                  "page_id long, url string, host string, path string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host, path, rule, verdict = host_path_rule(u)
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        if rule is None and host.startswith("www.site"):
            assert r.verdict == "allow"
    assert got[0].verdict == "block"
    assert sum(r.verdict == "block" for r in got.values() if r.host.startswith("casino") and r.rule is None) >= 18
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert url_filter.judge(pages.unionByName(pages)).count() == 2 * len(URLS)
    only_good = pages.filter("url like '%site%'")
    assert {r.verdict for r in url_filter.judge(only_good).collect()} == {"allow"}


def test_url_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    plans, write = {}, url_filter.materialize

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)
    monkeypatch.setattr(url_filter, "materialize", seen)
    out = url_filter.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"))
    plans["out"] = out._jdf.queryExecution().executedPlan().toString()
    broadcast = {label: len(re.findall(r"- BroadcastHashJoin|BroadcastNestedLoopJoin", plan)) for label, plan in plans.items()}
    assert broadcast == {"urls": 0, "grams": 0, "model": 0, "scored": 2, "out": 0}        # the runs that are frequent, twice


# ---- BPE

def test_bpe_equals_the_library(spark, edge, none, doubled):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_bpe_file())
    out = {r.doc_id: r for r in bpe.encode(edge, word_bpe_file(), with_text=True).collect()}
    again = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(edge, word_bpe_file()), word_bpe_file()).collect()}
    for r in edge.select("doc_id", "text").collect():
        x = tok.encode(r.text or "", add_special_tokens=False)
        assert out[r.doc_id].ids == x.ids
        assert out[r.doc_id].decoded == again[r.doc_id] == tok.decode(x.ids, skip_special_tokens=False)
    assert bpe.encode(none, word_bpe_file()).count() == 0
    assert bpe.encode(doubled, word_bpe_file()).count() == doubled.count()


def test_bpe_known_pieces_are_bounded_by_bytes(monkeypatch):
    """Whatever the pieces, the tables stay within their bytes, and the ids stay the same."""
    import random
    r = random.Random(4)
    text = " ".join("".join(r.choice("abcXYZ019+/é") for _ in range(r.choice([3, 20, 64, 65, 4000]))) for _ in range(600))
    free, tight = bpe.load_tables(word_bpe_file()), bpe.load_tables(word_bpe_file())
    expected = bpe.encode_text(text, free)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    assert bpe.encode_text(text, tight) == bpe.encode_text(text, tight) == expected
    for table in ("words", "chunks"):
        assert max(map(len, free[table])) <= bpe.LONGEST_KNOWN and 0 < tight["used"][table] <= 20_000
        assert tight["used"][table] == sum(bpe.getsizeof(k) + bpe.getsizeof(v) + bpe._ENTRY for k, v in tight[table].items())


def test_bpe_words_of_the_vocabulary():
    import random

    import numpy as np
    from tokenizers import Tokenizer
    tok, tables = Tokenizer.from_file(word_bpe_file()), bpe.load_tables(word_bpe_file())
    r = random.Random(9)
    names = [k.replace("</w>", "") for k in tok.get_vocab()]
    texts = ["".join(r.choices(names, k=r.randint(1, 6))) for _ in range(3000)]
    for text, x in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(bpe.encode_text(text, tables), np.int32).tolist() == x.ids, text


# ---- quality classifier

def test_cotraining_finds_junk(spark, none, doubled):
    import random
    r = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        bad = k % 3 == 0
        text = " ".join(("$$$ %d ###" % r.randrange(99)) if bad else f"plain{r.randrange(50)} word." for _ in range(60))
        rows.append((k, text, "en", "farm" if bad and k % 2 else f"s{k % 5}", len(text)))
        if k < 240:
            labels.append((k, 0 if bad else 1))
    rows.append((None, None, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    marks = spark.createDataFrame(labels + [(None, 1), (9999, 1), (5, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in cotraining.classify(docs, marks).collect()}
    assert len(got) == 401
    assert sum(got[k].kept == (k % 3 != 0) for k in range(240, 400)) >= 155     # documents never labelled
    assert all(0 <= x.score <= 1 for x in got.values())
    assert cotraining.classify(none, marks).count() == 0
    flat = cotraining.classify(doubled, marks.filter("quality = 1")).collect()
    assert len(flat) == doubled.count() and {x.score for x in flat} == {1.0}
    assert {x.score for x in cotraining.classify(doubled, marks.limit(0)).collect()} == {0.5}


def test_cotraining_learns_from_every_unlabelled_document(spark):
    """A kind of junk among the 1,000 of 21,000 unlabelled documents with the largest hashes of their ids."""
    last = {x.id for x in spark.range(1000, 22000).orderBy(F.xxhash64("id", F.lit(1)).desc()).limit(1000).collect()}
    rows, labels = [], []
    for k in range(22000):
        rare, bad = k in last and k % 5 == 0, k % 3 == 0
        text = f"plain word{k % 7} text" if not bad else f"$$$ {k % 9} ###"
        rows.append((k, "zorp zorp zorp" if rare else text, "en", "farm" if rare or bad else f"s{k % 5}", 300))
        if k < 1000:
            labels.append((k, 0 if bad else 1))
    rows += [(30000, "zorp", "en", "s1", 300), (30001, "blen", "en", "s1", 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x.doc_id: x for x in cotraining.classify(docs, marks).filter("doc_id >= 30000").collect()}
    assert got[30000].text_score < got[30001].text_score


# ---- language identification

SENTENCES = {"en": "the house and the garden are with that of this", "de": "der garten und das haus sind mit einer die ich",
             "fr": "le jardin et la maison sont avec une que nous", "es": "el jardin y la casa son con una que los"}


def test_language_evidence(spark, none, doubled):
    import random
    r = random.Random(4)
    rows = []
    for k in range(400):
        lang = list(SENTENCES)[k % 4]
        text = " ".join(r.choices(SENTENCES[lang].split(), k=40))
        rows.append((k, text, "de" if k % 40 == 1 else lang, f"{lang}.host.example", lang))
    rows += [(900, "", "en", "en.host.example", "en"), (901, None, None, None, None), (902, "12345 !!! 67", "en", None, None),
             (903, "la casa", None, "es.host.example", None), (904, "\U0001f600" * 50, "zz", "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string, host string, tld string").repartition(3)
    got = {x.doc_id: x for x in language_id.identify(docs, "doc_id", "text", F.col("tag"), F.col("host"), F.col("tld")).collect()}
    assert all(got[k].language == list(SENTENCES)[k % 4] and got[k].kept for k in range(400))
    assert [got[k].kept for k in (900, 901, 902)] == [False] * 3 and got[903].language == "es"
    assert language_id.identify_documents(none).count() == 0
    assert language_id.identify_documents(doubled).count() == doubled.count()


def test_page_evidence(spark):
    html = ["<html lang='fr'><head><style>x{}</style></head><body>le jardin et la maison</body></html>", None, "<p>x"]
    pages = spark.createDataFrame([(k, "http://A.b.example.fr:80/x" if k else None, h) for k, h in enumerate(html)],
                                  "page_id long, url string, html string")
    assert language_id.identify_pages(pages).count() == 3
    got = pages.select(language_id.markup_language(F.col("html")).alias("m"), language_id.host_of(F.col("url")).alias("h"),
                       language_id.markup_text(F.col("html")).alias("t")).collect()
    assert [g.m for g in got] == ["fr", None, None] and got[1].h == "a.b.example.fr:80" and "x{}" not in got[0].t


# ---- mixing

def test_mixing_budgets(spark, none, doubled):
    t = mixing.Targets(sources_of={"d1": ("a", "b"), "d2": ("c",)}, domains={"d1": 50, "d2": 50}, languages={"en": 60, "de": 40})
    leaves = spark.createDataFrame([("d1", "en", "a", 100), ("d1", "en", "b", 5), ("d1", "de", "a", 1000), ("d2", "en", "c", 20)],
                                   "domain string, language string, source string, tokens long")
    got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(leaves, 300, t, 1).collect()}
    # d2 can use 20 only, so d1 gets 280; its en can use 105 of 168, so de gets 175
    assert got == {("d2", "en", "c"): 20, ("d1", "en", "a"): 100, ("d1", "en", "b"): 5, ("d1", "de", "a"): 175}
    got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(leaves, 100, t, 1).collect()}
    assert got == {("d2", "en", "c"): 20, ("d1", "en", "a"): 43, ("d1", "en", "b"): 5, ("d1", "de", "a"): 32}
    assert mixing.mix(mixing.documents_of(none, t), 1.0, t).count() == 0
    rows = mixing.mix(mixing.documents_of(doubled, t), 1.0, t).collect()
    assert len(rows) == doubled.count() and all(r.copies == 0 for r in rows if r.n_tokens == 0)
    twice = {}
    for r in rows:
        assert twice.setdefault(r.doc_id, r.copies) == r.copies


def test_mixing_prefix(spark):
    """A hot leaf: whole epochs, then the longest prefix of the seeded order within the budget."""
    import hashlib
    rows = [(k, "d", "en", "s", 1 + k % 9) for k in range(3000)] + [(5000 + k, "d", "en", "t", 3) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, language string, source string, n_tokens long").repartition(4)
    t = mixing.Targets(sources_of={}, domains={}, languages={})
    got = {r.doc_id: r.copies for r in mixing.mix(docs, 0.6, t, max_epochs=2, seed=3).collect()}
    total = sum(r[4] for r in rows)
    budget = int(total * 0.6) - 120                          # leaf t takes its two epochs of 60 tokens
    order = sorted(range(3000), key=lambda k: hashlib.md5(f"3:1:{k}".encode()).hexdigest())
    used, expected = 0, set()
    for k in order:
        if used + 1 + k % 9 > budget:
            break
        used += 1 + k % 9
        expected.add(k)
    assert {k for k in range(3000) if got[k]} == expected and all(got[5000 + k] == 2 for k in range(20))


# ---- near duplicates

def test_near_duplicates(spark, edge, edge_rows, none, doubled):
    expected = brute.near_groups([r[:2] for r in edge_rows])
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(edge).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == expected
    assert all(r.kept == (k == r.component_id) for k, r in got.items())
    twice = minhash_dedup.near_duplicates(doubled).collect()
    assert len(twice) == doubled.count()
    assert {(r.doc_id, r.component_id) for r in twice if r.doc_id is not None} == {(k, c) for k, (_, c) in expected.items()}
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_near_copies_at_the_edge(spark):
    """Chains of edits, many copies, and pairs just at, above and below 0.75."""
    import random
    r, rows = random.Random(8), []
    base = [f"t{r.randrange(5000)}" for _ in range(260)]
    for k in range(180):
        w = list(base)
        for _ in range(r.choice([0, 0, 1, 2, 4, 6, 8, 12, 20])):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        rows.append((k, " ".join(w)))
    for k in range(40):                                      # 100 shingles, some shared
        a = [f"q{k}_{i}" for i in range(104)]
        rows += [(1000 + 2 * k, " ".join(a)), (1001 + 2 * k, " ".join(a[:96 - k % 12] + [f"z{k}_{i}" for i in range(8 + k % 12)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.near_duplicates(docs).collect()}
    assert got == brute.near_groups(rows)


def test_template_pages(spark, monkeypatch):
    """Pages that share more than half of their words link to nothing; four times the pages
    make about four times the rows that tasks compare, and near copies among them are found."""
    def pages(n):
        own = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.concat(
            F.lit("w"), F.when((F.col("id") % 500 == 1) & (k > 10), F.col("id") - 1).otherwise(F.col("id")).cast("string"),
            F.lit("x"), k.cast("string")))
        text = F.array_join(F.concat(F.array(*[F.lit(f"t{k}") for k in range(130)]), own), " ")
        return spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"))

    compared, plain = [], minhash_dedup._by_task

    def counted(roles, facts):
        compared.append(roles.count())
        return plain(roles, facts)
    monkeypatch.setattr(minhash_dedup, "_by_task", counted)
    sizes = []
    for n in (1500, 6000):
        compared.clear()
        got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(pages(n)).collect()}
        assert got == {k: k - (k % 500 == 1) for k in range(n)}
        sizes.append(list(compared))
    assert sum(sizes[1]) <= 5 * sum(sizes[0]), sizes


def test_components(spark):
    import random
    r = random.Random(2)
    pairs = [(k, k + 1) for k in range(300, 340)] + [(7, k) for k in range(1000, 1300)] + [
        (r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    links = spark.createDataFrame(pairs, "u long, v long")
    got = {x.id: x.component for x in connected_components(links).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(links.limit(0)).count() == 0


# ---- fingerprints

def test_fingerprints(spark, edge, edge_rows, none, doubled):
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(edge).collect()}
    order = sorted(edge_rows, reverse=True, key=lambda r: r[0])
    errors, prints = [], {}
    for k, (i, text, *_) in enumerate(order):
        t, after = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited, r = t[:len(t) - m] + after[:m], got[i]
        assert (r.n_chars, r.edited) == (len(t), edited)
        a, b, c = brute.shingles(t), brute.shingles(edited), brute.shingles(after)
        for likeness, x, y in ((r.near_edited, a, b), (r.near_next, a, c)):
            errors.append(abs(likeness - (len(x & y) / len(x | y) if x | y else 1.0)))
        assert prints.setdefault(tuple(sorted(a)), r.fingerprint) == r.fingerprint
        assert len(r.fingerprint) == (fingerprint.BINS if a else 0)
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.05
    assert fingerprint.edited_fingerprints(none).count() == 0
    assert fingerprint.edited_fingerprints(doubled).count() == doubled.count()
    one = fingerprint.edited_fingerprints(edge.filter("doc_id = 83")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# ---- substring dedup

def test_substring_dedup(spark, edge, edge_rows, none, doubled):
    expected = brute.without_repeats([r[:2] for r in edge_rows])
    for hot in (substring_dedup.HOT, 0, 1):                  # 0 and 1: anchors taken window by window
        got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(edge, hot=hot).collect()}
        assert got == expected
    twice = substring_dedup.remove_repeats(doubled).collect()
    assert len(twice) == doubled.count()
    assert {tuple(r) for r in twice if r.doc_id is not None} == {(k, *v) for k, v in expected.items()}
    assert substring_dedup.remove_repeats(none).count() == 0


def test_fm_index_counts():
    import numpy as np

    from riskframe.llm.fm_index import FMIndex, WaveletMatrix
    r = np.random.default_rng(1)
    text = r.integers(0, 37, 1000)
    matrix = WaveletMatrix(text, 37)
    at, c = r.integers(0, 1001, 300), r.integers(0, 37, 300)
    assert matrix.rank(c, at).tolist() == [int((text[:a] == x).sum()) for a, x in zip(at, c)]
    sequences = [r.integers(0, 4, n).astype(np.uint64) for n in (30, 6, 5, 80, 4, 41)]
    index = FMIndex(sequences, 5)
    least = index.least(np.arange(6))
    for which, place, group in index.matches():
        for w, p, g in zip(which, place, group):
            if p + 5 <= len(sequences[w]):
                gram = sequences[w][p:p + 5].tolist()
                holders = [k for k, s in enumerate(sequences) for x in range(len(s) - 4) if s[x:x + 5].tolist() == gram]
                assert least[g] == min(holders)
                assert index.starts[g + 1] - index.starts[g] == len(holders)


# ---- secrets

def test_secret_spans(spark, edge, edge_rows, none, doubled):
    got = {r.doc_id: r for r in secrets.by_document(*secrets.scan(edge, owner=F.col("source"))).collect()}
    expected = brute.secret_spans([(i, t, s or "") for i, t, s, _ in edge_rows])
    for i, text, *_ in edge_rows:
        base = brute.base_spans(text)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.base_sha256 == brute.sha(brute.listed([s[:3] for s in base]))
        assert r.spans == brute.listed(expected[i])
    clean = {r.doc_id: r.text for r in secrets.redact(edge, owner=F.col("source")).collect()}
    assert clean == {i: t and brute.redacted(t, expected[i]) for i, t, *_ in edge_rows}
    assert secrets.redact(edge).columns == edge.columns
    assert secrets.by_document(*secrets.scan(none)).count() == 0 and secrets.redact(none).count() == 0
    assert secrets.by_document(*secrets.scan(doubled)).count() == secrets.redact(doubled).count() == doubled.count()


def test_widely_held_values_are_examples(spark):
    key = "Zx9abcdefGHIJKLMNOP0123456789qr"
    docs = spark.createDataFrame([(k, f"use {key} here" if k < 9 else f"mine {key}x{k} ok", f"o{k}") for k in range(12)],
                                 "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in secrets.by_document(*secrets.scan(docs, owner=F.col("source"))).collect()}
    assert all(got[k] == "" for k in range(9)) and all(got[k].startswith("key:5:") for k in range(9, 12))


def test_one_owner_with_many_repositories(spark):
    """A value in 40 repositories of one owner is a template's; one in 10 repositories looks live."""
    often, seldom = "Zx9abcdefGHIJKLMNOP0123456789qr", "Qw7abcdefGHIJKLMNOP0123456789zz"
    docs = spark.createDataFrame([(k, f"use {often if k < 400 else seldom} here", "o", f"r{k % (40 if k < 400 else 10)}")
                                  for k in range(500)], "doc_id long, text string, source string, repo string")
    got = {r.doc_id: r.spans for r in secrets.by_document(
        *secrets.scan(docs, owner=F.col("source"), repository=F.col("repo"))).collect()}
    assert all((got[k] == "") == (k < 400) for k in range(500))


# ---- quality rules

def test_quality_rules(spark, edge, edge_rows, none, doubled):
    got = {r.doc_id: r for r in quality_rules.judge(edge).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for i, text, *_ in edge_rows:
        assert tuple(got[i][c] for c in names) == brute.quality_counts(text)
        assert not (got[i].base_failed and got[i].kept)
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.judge(doubled).count() == doubled.count()


def drawn_votes(share, n=20000):
    """Votes of documents of which ``share`` are good, from known rates."""
    import random
    from collections import Counter
    r, seen, truth = random.Random(5), Counter(), []
    for _ in range(n):
        good = r.random() < share
        v = tuple([r.choice([1, 1, 1, 0]) if good else r.choice([1, 0, 0])]
                  + [-1 if r.random() < (0.005 if good else 0.5) else 0 for _ in range(4)])
        seen[v] += 1
        truth.append((v, good))
    return seen, truth


@pytest.mark.parametrize("share,error", [(0.85, 0.03), (0.5, 0.03), (0.3, 0.06)])
def test_vote_estimation(share, error):
    """The estimated share follows the votes, and the classes are told apart."""
    seen, truth = drawn_votes(share)
    found = quality_rules.fit(list(seen.items()), 5)
    right = sum((found.posterior(v) >= 0.5) == g for v, g in truth)
    assert abs(found.shares[0] - share) < error and abs(sum(found.shares) - 1) < 1e-9
    assert right / len(truth) > 0.93 and all(found.accuracy(j) > 0.5 for j in range(5))
    assert quality_rules.fit([], 5).shares[0] == quality_rules.START_GOOD


def test_quality_posterior_equals_a_plain_estimation(spark):
    """EM by loops over the given documents; and no round lowers the (anchored) likelihood."""
    import math
    from collections import Counter
    out = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    names = [c for c in out.columns if c.startswith("vote_")]
    rows = out.collect()
    seen = Counter(tuple(r[n] for n in names) for r in rows)
    m = len(names)
    first = quality_rules.start(m, {j for j in range(m) if not any(v[j] == 1 for v in seen)})
    shares, rates, last = first.shares, first.rates, -math.inf
    for _ in range(quality_rules.ROUNDS):
        weights = [quality_rules.ANCHOR * len(rows) * s for s in first.shares]
        level = sum(w * (math.log(s) + sum(first.rates[k][j][x] * math.log(rates[k][j][x]) for j in range(m) for x in (-1, 0, 1)))
                    for k, (w, s) in enumerate(zip(weights, shares)))
        votes = [[{x: w * p for x, p in rule.items()} for rule in kind] for w, kind in zip(weights, first.rates)]
        for v, c in seen.items():
            like = [s * math.prod(kind[j][x] for j, x in enumerate(v)) for s, kind in zip(shares, rates)]
            level += c * math.log(sum(like))
            for k, p in enumerate(like):
                weights[k] += c * p / sum(like)
                for j, x in enumerate(v):
                    votes[k][j][x] += c * p / sum(like)
        assert level >= last - 1e-7
        last = level
        shares = [w / sum(weights) for w in weights]
        rates = [[{x: n / w for x, n in rule.items()} for rule in kind] for w, kind in zip(weights, votes)]
    for r in rows:
        like = [s * math.prod(kind[j][r[n]] for j, n in enumerate(names)) for s, kind in zip(shares, rates)]
        p = like[0] / sum(like)
        assert abs(r.posterior - p) < 1e-6
        assert r.kept == (not r.base_failed and p >= 0.5) or abs(p - 0.5) < 1e-6


def test_quality_verdicts_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge(docs).filter("not base_failed").join(labels.withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i"))
    assert {(r.quality, r.kept) for r in got.select("quality", "kept").distinct().collect()} == {(1, True), (0, False)}
