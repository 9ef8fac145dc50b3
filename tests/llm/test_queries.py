"""The registered queries on the given tables: SQL where there is any, else plain Python; and the pipeline."""

import brute
import pytest
from cases import none  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet").collect()


def rows_of(spark, name):
    out = entry.queries()[name](spark, SF0001).collect()
    return {r[0]: r for r in out}, len(out)


def test_every_operator_is_registered():
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_mixing_equals_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF0001}/documents.parquet'")
    sql = con.sql(entry.oracle_sql()["op5_mix_sources"])
    expected = sorted(tuple(r) for r in sql.fetchall())
    got = entry.queries()["op5_mix_sources"](spark, SF0001).select(*sql.columns)
    assert sorted(map(tuple, got.collect())) == expected


def test_contract_columns(spark, docs):
    texts = [(d.doc_id, d.text) for d in docs]
    near, n = rows_of(spark, "op6_minhash_near_dedup")
    assert n == len(docs) and {k: (r.n_shingles, r.component_id) for k, r in near.items()} == brute.near_groups(texts)
    rest, n = rows_of(spark, "op8_substring_dedup")
    expected = brute.without_repeats(texts)
    assert n == len(docs)
    assert all(tuple(rest[k])[1:4] == (v[0], v[1], brute.sha(v[2])) for k, v in expected.items())
    rules, n = rows_of(spark, "op10_quality_rules")
    assert n == len(docs) and all(tuple(rules[i])[1:7] == brute.quality_counts(t) for i, t in texts)
    found, n = rows_of(spark, "op9_secret_scan")
    spans = brute.secret_spans([(d.doc_id, d.text, d.source) for d in docs])
    assert n == len(docs) and all(found[k].spans == brute.listed(s) for k, s in spans.items())


def test_round_trip_digests(spark, docs):
    from riskframe.llm.bpe import word_bpe_file
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_bpe_file())
    got, n = rows_of(spark, "op2_bpe_round_trip")
    assert n == len(docs)
    for d in docs:
        ids = tok.encode(d.text or "", add_special_tokens=False).ids
        assert tuple(got[d.doc_id])[1:4] == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(tok.decode(ids, skip_special_tokens=False)))


def test_pipeline(spark, docs):
    import duckdb
    import pyarrow as pa
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from riskframe.llm import mixing
    from riskframe.llm.bpe import word_bpe_file
    from riskframe.llm.queries import mixing_sql
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5
    # every document of the tables has letters and a language
    near = brute.near_groups([(d.doc_id, d.text) for d in docs])
    left = [d for d in docs if near[d.doc_id][1] == d.doc_id]
    spans = brute.secret_spans([(d.doc_id, d.text, d.source) for d in left])
    clean = {d.doc_id: brute.redacted(d.text, spans[d.doc_id]) for d in left}
    con = duckdb.connect()
    documents = pa.table({"doc_id": [d.doc_id for d in left], "text": [clean[d.doc_id] for d in left],  # noqa: F841
                          "lang": [d.lang for d in left], "source": [d.source for d in left]})
    sql = mixing_sql(cp.BUDGET_SHARE, mixing.PRODUCTION, 1)
    chosen = {r[0] for r in con.sql(f"SELECT doc_id FROM ({sql}) WHERE copies > 0").fetchall()}
    tok = Tokenizer.from_file(word_bpe_file())
    got = {r.doc_id: r for r in cp.run(spark, SF0001).collect()}
    assert set(got) == chosen and 0 < len(chosen) < len(left)
    for i in chosen:
        assert got[i].ids == tok.encode(clean[i], add_special_tokens=False).ids


def test_pipeline_stages_keep_columns(spark, none):
    import corpus_pipeline as cp
    given = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, given, SF0001).columns == given.columns, name
    some = spark.createDataFrame([(1, "the garden and the house " * 20, "en", "src1", 500), (1, "other " * 60, "en", None, 360),
                                  (None, "the garden " * 30, "en", "src2", 300), (4, None, None, None, None)], given.schema)
    docs = some
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF0001)
    assert {r.doc_id for r in docs.collect()} <= {1}
    assert docs.filter(F.col("doc_id").isNull()).count() == 0
