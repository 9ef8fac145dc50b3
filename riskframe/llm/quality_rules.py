"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Votes are counted by
their pattern (at most 3 ** rules patterns, however many documents there are), and
expectation-maximisation over the pattern counts estimates the share of good documents and
how each rule votes on them and on bad ones (its accuracy follows). Bad documents come in kinds,
one for each rule, since junk that one rule knows is seldom junk that another knows too: a
pattern's likelihood is a mixture of the good class and the kinds, in each of which rules vote
or abstain independently with probabilities of their own. Both steps use the likelihood of all three outcomes,
so no round lowers it. Nothing bounds the share of good documents or a rule's rates;
the classes keep their meaning by one prior: the starting values count as ANCHOR of all
documents. A document's posterior is the probability of the good class given its votes; it
replaces the usual "every rule must pass". The base
rules of fixed thresholds (``base_failed``) still reject.

Repeats inside a text are found without comparing all pairs: each text's three-word
windows are hashed to 64 bits; where the number of different hashes shows a repeat,
(hash, place) pairs are sorted inside the row and neighbours compared.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; rules that need
words abstain without them; repeated rows give repeated results; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize, words

MIN_WORDS = 50                  # base: fewer fail
MAX_REPEAT_PERCENT = 50         # base: a larger share of words in repeated windows fails
MIN_POSTERIOR = 0.5
START_GOOD = 0.8
# where the estimation starts: probability of each vote among good documents, among bad ones of
# the rule's own kind and among other bad ones; for rules that vote both ways and for detectors
START = ({1: 0.60, 0: 0.38, -1: 0.02}, {1: 0.05, 0: 0.15, -1: 0.80}, {1: 0.50, 0: 0.45, -1: 0.05})
START_DETECTOR = ({1: 0.005, 0: 0.990, -1: 0.005}, {1: 0.005, 0: 0.195, -1: 0.800}, {1: 0.005, 0: 0.895, -1: 0.100})
ANCHOR = 0.01                   # share of documents that the start counts as
ROUNDS = 400
VOTES = (-1, 0, 1)

SYMBOLS = "#*$%&|<>"
_GAPS = " \t\n\x0b\x0c\r"


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(w: Column) -> Column:
    """Words inside a three-word window that occurs twice or more in the array of words."""
    n = F.size(w)
    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def among(p):
            last = F.size(p) - 1
            again = F.filter(p, lambda x, i: (p[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]) & (i > 0)
                             | (p[F.least(i + 1, last)]["h"] == x["h"]) & (i < last))
            at = F.array_sort(F.transform(again, lambda x: x["i"]))
            # windows that start less than three words apart overlap
            return _let(at, lambda a: F.aggregate(
                F.transform(a, lambda x, i: F.when(i + 1 < F.size(a), F.least(F.lit(3), a[F.least(i + 1, F.size(a) - 1)] - x))
                            .otherwise(F.lit(3))), F.lit(0).cast("long"), lambda s, x: s + x))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(pairs, among)).otherwise(F.lit(0).cast("long"))

    return F.when(n >= 4, _let(hashes, covered)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, _GAPS, "")) > 0)
    bare = F.translate("text", _GAPS, "")
    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "0123456789", ""))).cast("long").alias("n_digits"),
        (F.length("text") - F.length(F.translate("text", ".!?", ""))).cast("long").alias("n_stops"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_shouts"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: each a vote on the counts of ``measures``."""
    n, chars = F.col("n_words"), F.col("word_chars")
    some = n > 0

    def share(c, of):
        return F.col(c) / F.greatest(of, F.lit(1))
    mean = chars / F.greatest(n, F.lit(1))
    never = F.lit(False)
    return {
        "length": _vote(n >= 100, n < 20),
        "word_length": _vote(some & mean.between(3, 9), some & ~mean.between(2.5, 14)),
        "stops": _vote((n >= 20) & share("n_stops", n).between(0.01, 0.3), (n >= 100) & (F.col("n_stops") == 0)),
        # detectors: they know bad signs and abstain otherwise
        "symbols": _vote(never, some & (share("n_symbols", n) > 0.3)),
        "dup_lines": _vote(never, (F.col("n_dup_lines") >= 3) & (share("n_dup_lines", F.col("n_lines")) > 0.4)),
        "repeats": _vote(never, share("n_repeat_words", n) > 0.5),
        "upper": _vote(never, some & (share("n_upper", chars) > 0.4)),
        "digits": _vote(never, some & (share("n_digits", chars) > 0.3)),
        "shouts": _vote(never, some & (share("n_shouts", n) > 0.5)),
    }


class Estimate(NamedTuple):
    """shares: of the good class and of each kind of bad documents; rates[class][rule][vote]."""
    shares: list[float]
    rates: list[list[dict[int, float]]]

    def accuracy(self, rule: int) -> float:
        """Share of a rule's votes that are right."""
        right = self.shares[0] * self.rates[0][rule][1]
        wrong = self.shares[0] * self.rates[0][rule][-1]
        for s, r in zip(self.shares[1:], self.rates[1:]):
            right, wrong = right + s * r[rule][-1], wrong + s * r[rule][1]
        return right / (right + wrong)

    def posterior(self, votes) -> float:
        """Probability that a document with these votes is good."""
        logs = [math.log(s) + sum(math.log(r[j][x]) for j, x in enumerate(votes)) for s, r in zip(self.shares, self.rates)]
        return 1 / sum(math.exp(min(x - logs[0], 700)) for x in logs)


def start(n_rules: int, detectors: set[int]) -> Estimate:
    kinds = [[(START_DETECTOR if j in detectors else START)[0 if k == 0 else 1 if k - 1 == j else 2] for j in range(n_rules)]
             for k in range(n_rules + 1)]
    return Estimate([START_GOOD] + [(1 - START_GOOD) / n_rules] * n_rules, kinds)


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> Estimate:
    """Estimate from counted vote patterns. A rule that never votes good is a detector."""
    first = start(n_rules, {j for j in range(n_rules) if not any(v[j] == 1 for v, _ in patterns)})
    total = sum(c for _, c in patterns)
    if not total:
        return first
    patterns = sorted(patterns)
    counts = np.array([c for _, c in patterns], dtype=np.float64)
    cast = np.array([[[x == y for y in VOTES] for x in v] for v, _ in patterns], dtype=np.float64)
    mass0 = ANCHOR * total * np.array(first.shares)
    rates0 = np.array([[[r[x] for x in VOTES] for r in kind] for kind in first.rates])
    shares, rates = np.array(first.shares), rates0
    for _ in range(ROUNDS):
        logs = np.log(shares) + np.einsum("pjx,kjx->pk", cast, np.log(rates))
        weight = np.exp(logs - logs.max(axis=1, keepdims=True))
        weight *= (counts / weight.sum(axis=1))[:, None]
        mass = weight.sum(axis=0) + mass0
        rates = (np.einsum("pk,pjx->kjx", weight, cast) + mass0[:, None, None] * rates0) / mass[:, None, None]
        shares = mass / mass.sum()
    return Estimate(shares.tolist(), [[dict(zip(VOTES, r)) for r in kind] for kind in rates.tolist()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, each rule's vote, posterior, kept."""
    rules = votes()
    names = [f"vote_{r}" for r in rules]
    rows = materialize(measures(docs, id_col, text_col).select(
        "*", *[v.alias(f"vote_{r}") for r, v in rules.items()]), "votes")
    counted = rows.groupBy(*names).count().collect()        # at most 3 ** rules rows
    found = fit([(tuple(r[n] for n in names), r["count"]) for r in counted], len(names))

    def likelihood(k):
        """Log likelihood of the row's votes in class k, less that in the good class."""
        z = F.lit(math.log(found.shares[k] / found.shares[0]))
        for j, name in enumerate(names):
            gain = {x: math.log(found.rates[k][j][x] / found.rates[0][j][x]) for x in VOTES}
            z = z + F.when(F.col(name) > 0, gain[1]).when(F.col(name) < 0, gain[-1]).otherwise(gain[0])
        return F.exp(F.least(z, F.lit(700.0)))
    others = F.lit(0.0)
    for k in range(1, len(found.shares)):
        others = others + likelihood(k)
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return rows.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + others)) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= MIN_POSTERIOR))
