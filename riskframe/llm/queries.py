"""Queries of this package: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (
    bpe, centroids, cotraining, decontamination, fingerprint, language_id, mixing, periodic_runs, quality_rules, secrets,
    substring_dedup, url_filter,
)
from riskframe.llm.common import materialize, table, words
from riskframe.llm.minhash_dedup import near_duplicates


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the address of every page: the longest rule's, else the language models'."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Ids of every whole document text and the text they decode to, as digests."""
    out = bpe.encode(table(spark, sf_dir, "documents"), tokenizer or bpe.word_bpe_file(), with_text=True)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two co-trained views: doc_id, scores, kept."""
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, language, declared, posterior, kept."""
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, with markup, address suffix and host as evidence."""
    return language_id.identify_pages(table(spark, sf_dir, "pages"))


MIX_SHARE = 1.0         # of all tokens


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is read under the target weights: doc_id, its leaf, n_tokens, copies."""
    rows = mixing.documents_of(table(spark, sf_dir, "documents"), mixing.PRODUCTION)
    return mixing.mix(rows, MIX_SHARE)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    rows = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that a document with a smaller id has."""
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source owns its documents, its languages are its repositories."""
    docs = table(spark, sf_dir, "documents")
    return secrets.by_document(*secrets.scan(
        docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakly supervised quality verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "posterior")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a benchmark phrase, and the items the phrases come from."""
    rows = decontamination.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents repeat a stretch of words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    w, n, g = F.col("w"), F.size("w"), F.floor(F.col("h") / 10)
    split = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    cut = split.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn(
        "p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice(w, F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    again = F.concat_ws(" ", F.concat(F.slice(w, F.lit(1), F.col("a")), F.slice(tail, F.lit(1), n - F.col("a"))))
    return cut.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, after ``looped``."""
    rows = periodic_runs.periodic_runs(looped(table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding, its squared distance, the inertias and the centroid's digest."""
    assigned, final = centroids.cluster(table(spark, sf_dir, "embeddings"))
    assigned = materialize(assigned, "assigned")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    by_number = F.array(*[F.struct(F.lit(sums.get(c, 0)).cast("long").alias("s"), F.lit(centroids.centroid_digest(v)).alias("d"))
                          for c, v in enumerate(final)]) if len(final) else F.lit(None).cast("array<struct<s:bigint,d:string>>")
    own = F.get(by_number, F.col("cluster"))
    return assigned.select("vec_id", "cluster", "distance", own["s"].alias("cluster_inertia"),
                           F.lit(sum(sums.values())).cast("long").alias("inertia"), own["d"].alias("centroid_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_language_id": op4_language_id,
        "language_id_pages": language_id_pages,
        "op5_mix_sources": op5_mix_sources,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_fingerprints": op7_fingerprints,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_quality_rules": op10_quality_rules,
        "op11_benchmark_decontamination": op11_benchmark_decontamination,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_centroid_clusters": op13_centroid_clusters,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": mixing_sql(), "op11_benchmark_decontamination": DECONTAMINATION_SQL,
            "op13_centroid_clusters": clusters_sql()}


def _case(column: str, values: dict[str, int], default: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END" \
        if values else str(default)


def mixing_sql(share: float = MIX_SHARE, targets: mixing.Targets = mixing.PRODUCTION,
               max_epochs: int = mixing.MAX_EPOCHS, seed: int = 7) -> str:
    """The mix of the documents table in SQL: the same closed form, with a plain window over each leaf."""
    domain = "CASE " + " ".join(
        "WHEN source IN (" + ", ".join(f"'{x}'" for x in xs) + f") THEN '{d}'"
        for d, xs in targets.sources_of.items()) + " ELSE 'other' END"
    weight = {"domain": _case("domain", targets.domains, targets.default),
              "language": _case("language", targets.languages, targets.default),
              "source": _case("source", targets.sources, targets.default)}
    sql = f"""
WITH docs AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, language, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
l0 AS (SELECT CAST(floor(sum(tokens) * {share}) AS BIGINT) AS budget FROM leaves)"""
    keys: list[str] = []
    for depth, name in enumerate(mixing.LEVELS):
        above, keys = list(keys), [*keys, name]
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        using = f"JOIN l{depth} USING ({', '.join(above)})" if above else "CROSS JOIN l0"
        order = f"{part} ORDER BY cap / weight, {name}"
        sql += f""",
n{depth} AS (SELECT {', '.join(keys)}, sum(tokens) * {max_epochs} AS cap, {weight[name]} AS weight
  FROM leaves WHERE tokens > 0 GROUP BY {', '.join(keys)}),
s{depth} AS (SELECT {', '.join('n' + str(depth) + '.' + k for k in keys)}, cap, weight,
    row_number() OVER ({order}) AS pos,
    budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
    sum(weight) OVER ({part}) - coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM n{depth} {using}),
t{depth} AS (SELECT *, min(CASE WHEN remains >= 0 AND cap::HUGEINT * weights::HUGEINT <= remains::HUGEINT * weight
    THEN NULL ELSE pos END) OVER ({part}) AS stop FROM s{depth}),
l{depth + 1} AS (SELECT {', '.join(keys)}, CAST(CASE WHEN stop IS NULL OR pos < stop THEN cap ELSE
    (max(CASE WHEN pos = stop THEN remains END) OVER ({part}))::HUGEINT * weight
    // (max(CASE WHEN pos = stop THEN weights END) OVER ({part}))::HUGEINT END AS BIGINT) AS budget FROM t{depth})"""
    return sql + f""",
placed AS (SELECT docs.*, budget // tokens AS whole, budget % tokens AS rest
  FROM docs LEFT JOIN leaves USING (domain, language, source) LEFT JOIN l3 USING (domain, language, source)),
runs AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source
    ORDER BY md5(concat('{seed}:', whole + 1, ':', doc_id)), doc_id) AS run FROM placed)
SELECT doc_id, domain, language, source, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(CASE WHEN n_tokens > 0 THEN coalesce(whole + CASE WHEN run <= rest THEN 1 ELSE 0 END, 0) ELSE 0 END AS BIGINT) AS copies
FROM runs"""


DECONTAMINATION_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
phrases AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT r, i, p.n, p.item FROM windows v JOIN phrases p ON v.n = p.n AND v.phrase = p.phrase),
hit AS (SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)"""


def clusters_sql(clusters: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> str:
    """Lloyd's rounds in SQL: every distance, every round."""
    sql = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS cv FROM kept WHERE vec_id IS NOT NULL
  ORDER BY h, v LIMIT {clusters})"""
    for t in range(rounds + 1):
        sql += f""",
d{t} AS (SELECT r, vec_id, v, c, list_sum(list_transform(list_zip(v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM kept CROSS JOIN c{t}),
a{t} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if t < rounds:
            sql += f""",
m{t} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT c, unnest(range(1, {size + 1})) AS i, unnest(v) AS x FROM a{t}) GROUP BY c, i),
c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(nv, cv) AS cv FROM c{t} LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS nv FROM m{t} GROUP BY c) x ON x.c = c{t}.c)"""
    return sql + f"""
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""
