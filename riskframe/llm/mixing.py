"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

A leaf is a (domain, language, source); its capacity is its tokens times MAX_EPOCHS.
The token budget flows down the tree: at each node children get shares by weight; a
child whose subtree can't use its share gets its capacity and the shortage goes to its
siblings by weight, so only what a whole subtree can't use reaches the siblings of its
ancestors. In closed form, children are taken by capacity per weight: while
capacity_i * (weights not yet served) <= (budget left) * weight_i child i is filled;
the rest share what is left by weight (rounded down, integers throughout).

A leaf reads its documents in epochs, each in an order of its own (MD5 of seed, epoch
and id): whole epochs first, then the longest prefix of the next epoch whose tokens
stay within the budget. The running sum never sorts a leaf in one task: tokens are
summed by (leaf, first PREFIX hex digits of the order key); only documents of the one
group in which the leaf's budget ends are put in order.

Weights are whole numbers. Domains, languages and sources that are not listed weigh
``default``. Defined cases: a null or unlisted source belongs to the domain "other";
null languages and sources form leaves of their own ("" in the result); a null or
empty text has no tokens and is in no epoch; rows with the same id in a leaf are
taken or left together; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import WORD, materialize

MAX_EPOCHS = 4
PREFIX = 3              # hex digits of the order key: 16 ** PREFIX groups of a leaf
LEVELS = ["domain", "language", "source"]


@dataclass(frozen=True)
class Targets:
    """Weights of the tree. ``sources_of`` names each domain's sources."""
    sources_of: dict[str, tuple[str, ...]]
    domains: dict[str, int]
    languages: dict[str, int]
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 10


PRODUCTION = Targets(
    sources_of={"crawl": ("src0",), "reference": tuple(f"src{k}" for k in range(1, 8)),
                "books": tuple(f"src{k}" for k in range(8, 14))},
    domains={"crawl": 40, "reference": 30, "books": 20, "other": 10},
    languages={"en": 55, "de": 15, "fr": 15, "es": 15})


def _lookup(key: Column, values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, weight in values.items():
        out = F.when(key == name, weight).otherwise(out)
    return out


def _domain(source: Column, targets: Targets) -> Column:
    out = F.lit("other")
    for name, sources in targets.sources_of.items():
        out = F.when(source.isin(*sources), name).otherwise(out)
    return out


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to children (columns name, cap, weight and the parent's budget
    as ``above``) of each parent."""
    big = lambda c: F.col(c).cast("decimal(20,0)")
    group = Window.partitionBy(*parents)
    order = group.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = nodes.withColumns({
        "at": F.row_number().over(order),
        "left": F.col("above") - F.coalesce(F.sum("cap").over(before), zero),
        "weights": F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), zero)})
    full = (F.col("left") >= 0) & (big("cap") * big("weights") <= big("left") * big("weight"))
    rows = rows.withColumn("stop", F.min(F.when(~full, F.col("at"))).over(group))
    rest = {c: F.max(F.when(F.col("at") == F.col("stop"), F.col(c))).over(group) for c in ("left", "weights")}
    rows = rows.withColumns({"left_s": rest["left"], "weights_s": rest["weights"]})
    rounded = F.expr("cast(cast(left_s as decimal(20,0)) * cast(weight as decimal(18,0)) div weights_s as bigint)")
    return rows.withColumn("budget", F.when(F.col("stop").isNull() | (F.col("at") < F.col("stop")), F.col("cap"))
                           .otherwise(rounded)).drop("at", "left", "weights", "stop", "left_s", "weights_s")


def leaf_budgets(leaves: DataFrame, budget: int, targets: Targets, max_epochs: int) -> DataFrame:
    """domain, language, source, tokens -> the same with ``budget`` tokens for each leaf."""
    caps = leaves.filter("tokens > 0").withColumn("cap", F.col("tokens") * max_epochs)
    weights = {
        "domain": _lookup(F.col("domain"), targets.domains, targets.default),
        "language": _lookup(F.col("language"), targets.languages, targets.default),
        "source": _lookup(F.col("source"), targets.sources, targets.default)}
    above = None
    for depth, name in enumerate(LEVELS):
        keys = LEVELS[:depth + 1]
        nodes = caps.groupBy(*keys).agg(F.sum("cap").cast("long").alias("cap")) \
            .withColumn("weight", weights[name].cast("long"))
        if above is None:
            # the root has one row per domain, a list the targets fix
            nodes = nodes.withColumn("above", F.lit(budget).cast("long"))
            above = _share(nodes, [F.lit(0)], name)
        else:
            parent = above.select(*LEVELS[:depth], F.col("budget").alias("above"))
            above = _share(nodes.join(parent, LEVELS[:depth]), LEVELS[:depth], name)
    return leaves.join(above.select(*LEVELS, "budget"), LEVELS)


def documents_of(docs: DataFrame, targets: Targets) -> DataFrame:
    """The documents table's leaves and tokens (words): doc_id, domain, language, source, n_tokens."""
    none = F.lit("")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _domain(F.coalesce("source", none), targets).alias("domain"), F.coalesce("lang", none).alias("language"),
        F.coalesce("source", none).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def mix(rows: DataFrame, share: float, targets: Targets = PRODUCTION, max_epochs: int = MAX_EPOCHS,
        seed: int = 7) -> DataFrame:
    """rows: doc_id, domain, language, source, n_tokens. Adds ``copies``: how often the
    document is read when the budget is ``share`` of all tokens."""
    rows = materialize(rows, "tokens")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, int(total * share), targets, max_epochs) \
        .withColumn("whole", F.expr("budget div tokens")) \
        .withColumn("rest", F.expr("budget - whole * tokens")).select(*LEVELS, "whole", "rest")
    plan = materialize(plan, "plan")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.col("doc_id").cast("string")))
    keyed = rows.join(plan, LEVELS, "left").withColumn("key", key).withColumn("part", F.substring("key", 1, PREFIX))
    # the group of keys in which each leaf's budget ends
    sums = keyed.filter("rest > 0").groupBy(*LEVELS, "part", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("part"))
    last = sums.withColumn("upto", upto).filter("upto > rest") \
        .groupBy(*LEVELS).agg(F.min(F.struct("part", (F.col("upto") - F.col("t")).alias("before"))).alias("end")) \
        .select(*LEVELS, F.col("end.part").alias("end_part"), F.col("end.before").alias("before"))
    placed = materialize(keyed.join(last, LEVELS, "left"), "placed")
    inside = F.col("end_part").isNotNull() & (F.col("part") == F.col("end_part"))
    inside = F.coalesce(inside, F.lit(False))
    run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "doc_id"))
    at_end = placed.filter(inside).withColumn("more", F.col("before") + run <= F.col("rest"))
    clear = placed.filter(~inside).withColumn(
        "more", F.coalesce((F.col("rest") > 0) & (F.col("part") < F.col("end_part")), F.lit(False)))
    copies = F.coalesce("whole", F.lit(0).cast("long")) + F.col("more").cast("long")
    copies = F.when(F.col("n_tokens") > 0, copies).otherwise(0)
    return clear.unionByName(at_end).select("doc_id", *LEVELS, "n_tokens", copies.cast("long").alias("copies"))
