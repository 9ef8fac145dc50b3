"""Language identification by Bayesian fusion of four kinds of evidence.

For each document and language l the log posterior is the sum of

* the text's log likelihood: letter trigrams (bytes; A-Z lower-cased, other ASCII
  taken as gaps) hashed to BUCKETS, with P(bucket | l) counted over *all* texts that
  declare l; neighbouring trigrams overlap, so each counts a third;
* log P(declared tag | l) and log P(address suffix | l), counted over all documents
  against the language their text speaks for most;
* the log prior of l on the document's host: counts of the host smoothed towards
  those of its domain (last two labels), these towards the whole corpus, without
  the document itself.

A further class, noise, has a uniform distribution over buckets. Counts come from
grouped aggregations; only the trigram model (languages x BUCKETS numbers) and the
tag table (languages x tags) pass through the driver, both of a size fixed by the
parameters. Host, domain and suffix counts are joined, never collected.

Defined cases: a text without a letter trigram (null, empty, digits or signs only)
has no language and is not kept; a null or unknown declared tag counts as "none"; a
null host or suffix adds no evidence (its prior is that of the corpus); repeated rows give
repeated results; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize, ship
from riskframe.llm.hashing import CHUNK, text_buffer

LANGUAGES = ("en", "de", "fr", "es")
BUCKETS = 1 << 13
MIN_POSTERIOR = 0.5
HOST_WEIGHT, DOMAIN_WEIGHT = 10.0, 50.0     # documents that a smoothed prior counts as
NOISE_PRIOR = 0.001

_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigrams(buf: np.ndarray, offsets: np.ndarray):
    """Yield (first document, bucket of each trigram, trigrams of each document) over
    groups of documents of about CHUNK bytes; of a longer document, piece by piece."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(max(int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1, i + 1), n)
        lo, hi = int(offsets[i]), int(offsets[j])
        for at in range(lo, max(hi, lo + 1), CHUNK):
            end = hi if j > i + 1 else min(at + CHUNK + 2, hi)
            b = _LETTER[buf[at:end]]
            ends = np.maximum(np.minimum(offsets[i + 1:j + 1], end) - at, 0)
            owner_start = np.zeros(len(b) + 1, dtype=bool)
            owner_start[ends] = True
            keep = b != 0
            if len(b):
                keep[1:] |= b[:-1] != 0         # of a run of gaps the first stays
            keep |= owner_start[:-1]
            pos = np.flatnonzero(keep)
            c = b[pos].astype(np.uint32)
            cut = np.searchsorted(pos, ends)    # kept bytes up to each document's end
            if len(c) >= 3:
                code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
                good = (c[1:-1] != 0) & ((c[:-2] != 0) | (c[2:] != 0))
                edge = np.concatenate([cut[:-1] - 1, cut[:-1] - 2])
                edge = edge[(edge >= 0) & (edge < len(good))]
                good[edge] = False              # none crosses from one document to the next
                bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
                at_good = np.flatnonzero(good)
                upto = np.searchsorted(at_good, cut)
                yield i, bucket[at_good], np.diff(np.concatenate([[0], upto]))
            if j > i + 1:
                break
        i = j


def _count(n_lang: int):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(n_lang * BUCKETS, dtype=np.int64)
        for batch in batches:
            tag = np.array(batch.column(0).fill_null(-1), dtype=np.int64)
            buf, offsets = text_buffer(batch.column(1))
            for first, bucket, counts in _trigrams(buf, offsets):
                who = np.repeat(tag[first:first + len(counts)], counts)
                ok = who >= 0
                total += np.bincount(who[ok] * BUCKETS + bucket[ok], minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            part = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])
    return run


def _likelihoods(model: np.ndarray):
    """model: languages x BUCKETS log probabilities."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            n = batch.num_rows
            grams = np.zeros(n, dtype=np.int64)
            ll = np.zeros((n, len(model)))
            for first, bucket, counts in _trigrams(buf, offsets):
                has = np.flatnonzero(counts)
                if len(has):
                    at = (np.cumsum(counts) - counts)[has]
                    grams[first + has] += counts[has]
                    for k, row in enumerate(model):
                        ll[first + has, k] += np.add.reduceat(row[bucket], at)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * len(model)), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(grams), lists], names=["id", "declared", "host", "suffix", "grams", "ll"])
    return run


def trigram_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """log P(bucket | language) from the texts that declare each language."""
    tag = F.array_position(F.array(*map(F.lit, languages)), F.col("declared")) - 1
    cells = (rows.filter(F.col("declared").isin(*languages)).select(tag.cast("long").alias("tag"), "text")
             .mapInArrow(_count(len(languages)), "cell bigint, n bigint")
             .groupBy("cell").agg(F.sum("n").alias("n")).collect())      # languages x BUCKETS rows at most
    counts = np.zeros(len(languages) * BUCKETS)
    for c in cells:
        counts[c.cell] = c.n
    counts = counts.reshape(len(languages), BUCKETS) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _per_language(rows: DataFrame, key: list[str], n: int, name: str) -> DataFrame:
    """Counts of each language's documents as an array, by ``key``."""
    return rows.groupBy(*key).agg(F.array(*[
        F.sum(F.when(F.col("best") == k, 1.0).otherwise(0.0)) for k in range(n)]).alias(name))


def domain_of(host: Column) -> Column:
    """The last two labels of a host (a host of fewer labels as it is)."""
    return F.substring_index(host, ".", -2)


def identify(docs: DataFrame, id_col: str, text_col: str, declared: Column | None = None,
             host: Column | None = None, suffix: Column | None = None,
             languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """id, language (null if none), declared, posterior, kept (a language with a
    posterior of MIN_POSTERIOR or more)."""
    ship(__name__)
    n = len(languages)
    null = F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.lower(declared if declared is not None else null).alias("declared"),
        (host if host is not None else null).alias("host"), (suffix if suffix is not None else null).alias("suffix"))
    model = trigram_model(rows, languages)
    scored = rows.select("text", "id", "declared", "host", "suffix").mapInArrow(
        _likelihoods(model), "id bigint, declared string, host string, suffix string, grams bigint, ll array<double>")
    best = F.when(F.col("grams") > 0, F.array_position(F.col("ll"), F.array_max("ll")) - 1).cast("int")
    scored = materialize(scored.withColumn("best", best).withColumn("domain", domain_of(F.col("host"))), "evidence")
    voting = scored.filter("best is not null")

    # declared tags: a table of languages x (languages + none)
    known = F.coalesce(F.array_position(F.array(*map(F.lit, languages)), F.col("declared")) - 1, F.lit(n)).cast("int")
    tag = F.when(known < 0, n).otherwise(known)
    seen = np.ones((n, n + 1))
    corpus = np.ones(n)
    for r in voting.groupBy("best", tag.alias("tag")).count().collect():        # n (n + 1) rows at most
        seen[r["best"], r["tag"]] += r["count"]
        corpus[r["best"]] += r["count"]
    log_tag = np.log(seen / seen.sum(axis=1, keepdims=True))
    corpus = corpus / corpus.sum()

    of_host = _per_language(voting.filter("host is not null"), ["host"], n, "n_host")
    of_domain = _per_language(voting.filter("domain is not null"), ["domain"], n, "n_domain")
    of_suffix = _per_language(voting.filter("suffix is not null"), ["suffix"], n, "n_suffix")
    per_lang = voting.groupBy().agg(*[F.sum(F.when(F.col("best") == k, 1.0).otherwise(0.0)).alias(f"c{k}")
                                      for k in range(n)]).first()
    n_lang = [max(per_lang[f"c{k}"] or 0.0, 0.0) for k in range(n)]

    wide = scored.withColumn("tag", tag).join(of_host, "host", "left").join(of_domain, "domain", "left") \
        .join(of_suffix, "suffix", "left")
    zero = F.array(*[F.lit(0.0)] * n)

    def own(k):                                  # the document's own vote is left out of its prior
        return F.when(F.col("best") == k, 1.0).otherwise(0.0)

    def at(col, k):
        return F.greatest(F.coalesce(F.col(col), zero)[k] - own(k), F.lit(0.0))

    def total(col):
        votes = F.aggregate(F.coalesce(F.col(col), zero), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(votes - F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0), F.lit(0.0))

    logs = []
    for k in range(n):
        up = (at("n_domain", k) + DOMAIN_WEIGHT * float(corpus[k])) / (total("n_domain") + DOMAIN_WEIGHT)
        prior = (at("n_host", k) + HOST_WEIGHT * up) / (total("n_host") + HOST_WEIGHT)
        end = F.when(F.col("suffix").isNull(), 0.0).otherwise(
            F.log((at("n_suffix", k) + 1.0) / (F.lit(n_lang[k]) + 2.0)))
        by_tag = F.array(*[F.lit(float(x)) for x in log_tag[k]])[F.col("tag")]
        logs.append(F.col("ll")[k] / 3.0 + F.log(prior) + end + by_tag)
    noise = F.col("grams") * float(np.log(1.0 / BUCKETS)) / 3.0 + float(np.log(NOISE_PRIOR)) \
        + float(np.log(1.0 / (n + 1))) + F.when(F.col("suffix").isNull(), 0.0).otherwise(float(np.log(0.5)))
    out = wide.select("id", "declared", "grams", F.array(*logs, noise).alias("logs")) \
        .withColumn("top", F.array_max("logs"))
    z = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    which = (F.array_position("logs", F.col("top")) - 1).cast("int")
    language = F.when((F.col("grams") > 0) & (which < n), F.array(*map(F.lit, languages))[F.least(which, F.lit(n - 1))])
    out = out.select(F.col("id"), language.alias("language"), "declared", (1.0 / z).alias("posterior"))
    return out.withColumn("kept", F.col("language").isNotNull() & (F.col("posterior") >= MIN_POSTERIOR)) \
        .withColumnRenamed("id", id_col)


def host_of(url: Column) -> Column:
    """The host of an address in lower case (null without one)."""
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))
    return F.when(h != "", h)


def markup_language(html: Column) -> Column:
    """The two-letter language a page's root element declares (null if none)."""
    tag = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), "(?i)<html[^>]*?\\slang\\s*=\\s*[\"']?([a-z]{2})", 1))
    return F.when(tag != "", tag)


def markup_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags become blanks."""
    bare = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, "<[^>]*>", " ")


def identify_documents(docs: DataFrame) -> DataFrame:
    """The documents table: its lang column is the declared tag, its source the host."""
    return identify(docs, "doc_id", "text", F.col("lang"), F.col("source"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """The pages table: markup declaration, host and address suffix from url and html."""
    host = host_of(F.col("url"))
    rows = pages.select("page_id", markup_text(F.col("html")).alias("text"),
                        markup_language(F.col("html")).alias("declared"), host.alias("host"))
    return identify(rows, "page_id", "text", F.col("declared"), F.col("host"), F.substring_index("host", ".", -1))
