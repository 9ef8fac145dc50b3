"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in the whole text by fixed patterns. The digest of each candidate's
secret part is counted over the corpus by distinct owners and repositories (first per
owner, then over owners, so that a value copied a million times is a partial count
before it moves). A value that few owners hold in few repositories looks live; one that
many owners hold, or that one owner repeats in many repositories, is an example from
documentation or a template. Base kinds are always reported; the wider patterns of the
method (ADDED) only where the value looks live: owner-specific, with at least
MIN_DISTINCT different characters, a digit and a letter.

Positions: splitting a text at a pattern gives the pieces between the matches, so a
match starts at the summed lengths of all before it; the running sum is a window over
the matches of one document. Starts and ends count code points; ends are exclusive.

Defined cases: a null text counts as empty and has no spans; a null owner or
repository counts as one owner or repository of its own; rows that repeat an id
give a result each; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import materialize

MAX_OWNERS = 3          # owners of a value that still looks live
MAX_REPOSITORIES = 10   # repositories, of all its owners, of a value that still looks live
MIN_DISTINCT = 8        # different characters of an added value at least

# Fixed patterns of the base kinds: pattern, group of the secret part, its least length.
BASE = {
    "assign": ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),        # runs are maximal, so shorter ones need not match
}
# The method's own kinds.
ADDED = {
    "prefixed": ("(?:gh[pousr]_|xox[abprs]-|sk-|glpat-|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20),
    "key": ("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+", 0, 24),
}
KINDS = BASE | ADDED
ORDER = list(KINDS)


def _hits(text: Column) -> Column:
    """Matches of every kind in order: kind, number, length of the piece before and of the match, secret part."""
    found = []
    for k, (pattern, group, _) in enumerate(KINDS.values()):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        rows = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), whole.alias("whole"), part.alias("part"))
        rows = F.transform(F.filter(rows, lambda r: r["whole"].isNotNull()), lambda r, i: F.struct(
            F.lit(k).alias("kind"), i.alias("i"), F.length(r["piece"]).alias("gap"),
            F.length(r["whole"]).alias("size"), r["part"].alias("part")))
        found.append(F.when(text.rlike(pattern), rows))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,part:string>>")
    return F.concat(*[F.coalesce(f, none) for f in found])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
         repository: Column | None = None, max_owners: int = MAX_OWNERS,
         max_repositories: int = MAX_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: row, id, text_key of every input row. spans: row, id,
    text_key, kind, start, end, base, owners, repositories, live; added spans that
    don't look live are left out."""
    null = F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text).alias("text_key"),
        F.coalesce(owner if owner is not None else null, F.lit("")).alias("owner"),
        F.coalesce(repository if repository is not None else null, F.lit("")).alias("repository"),
        _hits(text).alias("hits"))
    slim = materialize(slim, "hits")
    hits = slim.filter(F.size("hits") > 0).select("row", "id", "text_key", "owner", "repository", F.inline("hits"))
    before = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    least = F.array(*[F.lit(v[2]) for v in KINDS.values()])[F.col("kind")]
    hits = hits.select("*", (end - F.col("size")).alias("start"), end.alias("end")) \
        .filter(F.length("part") >= least)
    hits = materialize(hits.select("row", "id", "text_key", "owner", "repository", "kind", "start", "end",
                                   F.sha2("part", 256).alias("value"), _mixed(F.col("part")).alias("mixed")), "spans")
    held = hits.groupBy("value", "owner").agg(F.countDistinct("repository").alias("r")) \
        .groupBy("value").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    spans = hits.join(held, "value").withColumn("base", F.col("kind") < len(BASE)) \
        .withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories) & F.col("mixed")) \
        .filter(F.col("base") | F.col("live"))
    return slim.select("row", "id", "text_key"), spans.drop("owner", "repository", "mixed", "value")


def _mixed(part: Column) -> Column:
    """Looks random: enough different characters, a digit and a letter."""
    return (F.size(F.array_distinct(F.split(part, ""))) >= MIN_DISTINCT) \
        & part.rlike("[0-9]") & part.rlike("[A-Za-z]")


def span_list(entries: Column) -> Column:
    """kind:start:end by start, then kind in its order, joined by commas."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(F.array_sort(entries), lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_document(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each input row: counts of base kinds, the base spans' digest, all spans."""
    entry = F.struct("start", "kind", "end")
    found = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == ORDER.index(k), 1)).alias(f"n_{k}") for k in BASE],
        F.collect_list(F.when(F.col("base"), entry)).alias("own"), F.collect_list(entry).alias("all"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"))
    out = rows.join(found, "row", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in
            (*[f"n_{k}" for k in BASE], "n_live", "n_example")}
    none = F.lit("")
    return out.select(
        F.col("id").alias("doc_id"), *[zero[f"n_{k}"] for k in BASE],
        F.sha2(F.coalesce(span_list(F.col("own")), none), 256).alias("base_sha256"),
        F.coalesce(span_list(F.col("all")), none).alias("spans"), zero["n_live"], zero["n_example"])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
           repository: Column | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; overlapping
    spans become one. Only documents with spans are shuffled."""
    _, spans = scan(docs, id_col, text_col, owner, repository)
    found = materialize(spans.groupBy("id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_found")), "found")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    any_hit = text.rlike("|".join(f"(?:{v[0]})" for v in KINDS.values()))
    names = docs.columns
    hit = docs.filter(any_hit).withColumn("_key", F.xxhash64(text))
    found = found.select(F.col("id").alias("_id"), F.col("text_key").alias("_text_key"), "_found")
    hit = hit.join(found, (F.col(id_col).cast("long").eqNullSafe(F.col("_id"))) & (F.col("_key") == F.col("_text_key")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):                   # what lies before the span, then the mark unless the span touches the last one
        gap = F.col(text_col).substr(acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(more.alias("out"), F.greatest(acc["at"], s["end"].cast("long")).alias("at"))

    cleaned = F.aggregate("_found", start, step, lambda a: F.concat(
        a["out"], F.col(text_col).substr(a["at"].cast("int") + 1, F.length(F.col(text_col)))))
    hit = hit.withColumn(text_col, F.when(F.size("_found") > 0, cleaned).otherwise(F.col(text_col))).select(*names)
    return docs.filter(~any_hit).unionByName(hit)
