"""URL filter: a list of host and path rules, and for every other address the ratio of
two character language models, in DataFrame functions only.

Models: smoothed variable-order Markov models over the characters of host and path, one
of accepted and one of rejected addresses. The probability of a character after a
context of k characters is mixed with that after the context's last k - 1 (Witten-Bell:
the more different characters followed a context, the more weight the shorter one has);
contexts seen less than MIN_CONTEXT times are passed over, so the order varies up to ORDER.

Training addresses: rejected are those that a rule blocks or whose host holds a
seed term; accepted are all others (allowed by a rule, or without rule and term). Each distinct address counts
once. One fold in FOLDS is left out of training and calibrates: the two classes'
means and the common variance of the length-normalised log-likelihood difference give
a logistic curve (linear discriminant), and an address is blocked from a probability of BLOCK_FROM on.

Every address's every character is scored. Counts, contexts and scores exist per
distinct run of ORDER + 1 characters; runs that make up one part in HEAVY_PARTS or
more of all positions (HEAVY_PARTS at most) are broadcast, the others joined by shuffle,
so no run that is in every address lands in one task. Nothing else passes through the driver: what
grows with the addresses is joined by shuffle even where its file is small (``_shuffled``).

Defined cases: a null address or one without "://" has an empty host and path and is
blocked by the method; without accepted or without rejected training addresses, or if the
held-out rejected ones don't score above the accepted ones on average (the models tell nothing),
nothing else is blocked; a probability of exactly BLOCK_FROM blocks; addresses of any length are
scored whole; repeated rows give repeated results; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize

ORDER = 5
MIN_CONTEXT = 2
ALPHABET = 256.0
FOLDS = 5
HEAVY_PARTS = 1000
BLOCK_FROM = 0.5
START, STOP = "\x02", "\x03"

# Fixed rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# Seed terms: hosts with one of these are training addresses of the rejected model.
SEED_TERMS = ("adult", "bets", "casino", "payday", "pills", "poker", "porn", "replica", "viagra", "warez", "xxx")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with its path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):       # the longest is asked first
        name, _, path_start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + path_start)
        out = F.when(fits, rule).otherwise(out)
    return out


def _grams(urls: DataFrame, *more: str) -> DataFrame:
    """A row for each character: ``gram``, the ORDER characters before it and itself."""
    chars = F.split(F.concat(F.lit(START * ORDER), "host", "path", F.lit(STOP)), "")
    rows = urls.select(*more, F.filter(chars, lambda c: c != "").alias("c"))
    c = F.col("c")
    grams = F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*[c[i + k] for k in range(ORDER + 1)]))
    return rows.select(*more, F.explode(grams).alias("gram"))


def _shuffled(df: DataFrame) -> DataFrame:
    """For a join by sorted shuffle: Spark would broadcast a file of 10 MB, many times that in the driver's memory."""
    return df.hint("merge")


def _probabilities(grams: DataFrame) -> DataFrame:
    """gram, log ratio: log P(rejected) - log P(accepted) of the gram's last character."""
    low = {x: F.lit(1.0 / ALPHABET) for x in ("acc", "rej")}
    shorter = None
    for k in range(ORDER + 1):
        key = F.substring("gram", -(k + 1), k + 1)
        level = grams.groupBy(key.alias("key")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
        level = level.withColumn("ctx", F.expr(f"substring(key, 1, {k})"))
        context = level.groupBy("ctx").agg(*[
            e for x in ("acc", "rej") for e in (F.sum(x).alias(f"n_{x}"), F.count(F.when(F.col(x) > 0, 1)).alias(f"t_{x}"))])
        rows = level.join(_shuffled(context), "ctx")
        if shorter is not None:
            rows = rows.withColumn("tail", F.expr(f"substring(key, 2, {k})")).join(_shuffled(shorter), "tail")
            low = {x: F.col(f"p_{x}") for x in low}
        p = {}
        for x in low:
            n, t = F.col(f"n_{x}"), F.col(f"t_{x}")
            p[x] = F.when(n >= MIN_CONTEXT, (F.col(x) + t * low[x]) / (n + t)).otherwise(low[x])
        level = rows.select("key", p["acc"].alias("q_acc"), p["rej"].alias("q_rej"))
        shorter = level.select(F.col("key").alias("tail"), F.col("q_acc").alias("p_acc"), F.col("q_rej").alias("p_rej"))
    return shorter.select(F.col("tail").alias("gram"), (F.log("p_rej") - F.log("p_acc")).alias("ratio"))


def score(urls: DataFrame) -> DataFrame:
    """urls: uid, host, path, rejected (boolean), held_out. Adds ``ratio``: the
    log-likelihood difference per character (positive: rather rejected)."""
    one = {"acc": ~F.col("rejected") & ~F.col("held_out"), "rej": F.col("rejected") & ~F.col("held_out")}
    counts = materialize(
        _grams(urls, "rejected", "held_out").groupBy("gram").agg(
            *[F.sum(F.when(c, 1).otherwise(0)).alias(x) for x, c in one.items()], F.count("*").alias("n")), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    model = materialize(_probabilities(counts).join(_shuffled(counts.select("gram", "n")), "gram"), "model")
    heavy = F.broadcast(model.filter(F.col("n") * HEAVY_PARTS >= total).select("gram", "ratio"))
    light = model.filter(F.col("n") * HEAVY_PARTS < total).select("gram", "ratio")
    places = _grams(urls, "uid")
    often = places.join(heavy, "gram").groupBy("uid").agg(F.sum("ratio").alias("s"), F.count("*").alias("k"))
    seldom = places.join(heavy, "gram", "left_anti").join(_shuffled(light), "gram") \
        .groupBy("uid").agg(F.sum("ratio").alias("s"), F.count("*").alias("k"))
    sums = often.unionAll(seldom).groupBy("uid").agg((F.sum("s") / F.sum("k")).alias("ratio"))
    return urls.join(_shuffled(sums), "uid")


def calibrate(scored: DataFrame) -> tuple[float, float] | None:
    """(slope, middle) of the logistic curve from the held-out fold; None if a class is empty in it."""
    got = {r["rejected"]: r for r in scored.filter("held_out").groupBy("rejected").agg(
        F.count("*").alias("n"), F.avg("ratio").alias("m"), F.var_pop("ratio").alias("v")).collect()}
    if set(got) != {True, False}:
        return None
    a, r = got[False], got[True]
    spread = (a["n"] * a["v"] + r["n"] * r["v"]) / (a["n"] + r["n"])
    if r["m"] <= a["m"]:
        return None
    return (r["m"] - a["m"]) / max(spread, 1e-6), (r["m"] + a["m"]) / 2


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES,
          seed_terms: tuple[str, ...] = SEED_TERMS, block_from: float = BLOCK_FROM) -> DataFrame:
    """id, host, path, rule, verdict, block_probability (null where a rule or an empty host decides)."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    says = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        says = F.when(F.col("rule") == rule, verdict).otherwise(says)
    rows = rows.withColumn("says", says)
    seeded = F.lit(False)
    for term in seed_terms:
        seeded = seeded | F.contains("host", F.lit(term))
    rejected = F.when(F.col("says").isNotNull(), F.col("says") == "block").otherwise(seeded)
    fold = F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)) == 0
    urls = materialize(
        rows.filter("host != ''").groupBy("host", "path", "says").agg(F.lit(0).alias("x")).select(
            F.monotonically_increasing_id().alias("uid"), "host", "path", "says",
            rejected.alias("rejected"), fold.alias("held_out")), "urls")
    scored = materialize(score(urls), "scored")
    curve = calibrate(scored)
    if curve is None:
        block = F.lit(0.0)
    else:
        slope, middle = curve
        block = 1 / (1 + F.exp(-F.least(F.greatest((F.col("ratio") - middle) * slope, F.lit(-50.0)), F.lit(50.0))))
    judged = scored.filter("says is null").select(
        F.col("host").alias("h"), F.col("path").alias("p"), block.alias("block_probability"))
    out = rows.join(_shuffled(judged), F.col("says").isNull() & (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    method = F.when((F.col("host") == "") | (F.col("block_probability") >= block_from), "block").otherwise("allow")
    return out.select(F.col("page_id"), "host", "path", "rule", F.coalesce("says", method).alias("verdict"),
                      "block_probability").withColumnRenamed("page_id", id_col)
