"""Quality classifier by co-training of two views of a document.

The *text* view sees the content: hashed word counts and measures of form. The *page* view sees
metadata only: source, declared language and recorded length. Each is a logistic
regression. In each of ROUNDS rounds both are fitted, score every unlabelled
document, and each hands its most confident labels (the GROW share of the unlabelled
documents for a class, GROW_LEAST at least, from CONFIDENT on) to the other's training set. In the end
each view is calibrated on labelled rows held out from training (Platt's logistic curve), and the
calibrated log odds are added, less the prior they share, into the score of every document.

The labelled rows are bounded: MAX_LABELLED, those with the smallest hashes of their
ids; this list (16 bytes a row) is what is broadcast. The unlabelled ones are not: the views
of all documents are written once, a round finds the log odds where the share ends from counts
in steps of 1/STEPS (rows in the last step are all taken), and a row's label follows from
the models and edges of the rounds so far, so that a fit reads its rows in a pass without
a join or a shuffle.

Defined cases: null or empty texts have zero features, null metadata is a value of
its own; a label row with a null id or label, or without a document, is not used; of clashing
labels of one id good wins; texts of any length are read whole; rows
that repeat an id are scored each; without labels of both classes (in training and
held out) every score is the share of good labels (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize, words

MAX_LABELLED = 20_000
ROUNDS, GROW, GROW_LEAST, CONFIDENT = 3, 0.05, 500, 0.95
STEPS, MAX_ODDS = 100, 100      # steps of log odds, and from where on they count as one
TEXT_BUCKETS, PAGE_BUCKETS = 1 << 12, 1 << 10
KEEP_FROM = 0.5
HELD_OUT = 5                    # one labelled row in so many calibrates


def _share(part: Column, of: Column) -> Column:
    return part / F.greatest(of, F.lit(1))


def featurize(docs: DataFrame) -> DataFrame:
    """docs: id, text, source, lang, length. Adds the vectors text_view and page_view."""
    low = F.lower("text")
    rows = docs.withColumn("w", words(low)).withColumn("chars", F.length("text"))

    def without(signs):
        return F.length("text") - F.length(F.translate("text", signs, ""))
    n, chars = F.size("w"), F.col("chars")
    lines = F.split("text", "\n", -1)
    form = {
        "f_len": F.log1p(n), "f_word": _share(chars, n) / 10, "f_upper": _share(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars),
        "f_digit": _share(without("0123456789"), chars), "f_sign": _share(without("#*$%&|<>{}[]=~^_"), chars),
        "f_shout": _share(without("!"), chars), "f_stop": _share(without(".?"), chars),
        "f_lines": F.log1p(F.size(lines)), "f_new": _share(F.size(F.array_distinct("w")), n),
        "f_new_lines": _share(F.size(F.array_distinct(lines)), F.size(lines))}
    size = F.coalesce(F.col("length"), F.lit(-1))
    page = F.array(
        F.concat(F.lit("source="), F.coalesce("source", F.lit("?"))), F.concat(F.lit("lang="), F.coalesce("lang", F.lit("?"))),
        F.concat(F.lit("size="), F.floor(2 * F.log2(F.greatest(size, F.lit(0)) + 1)).cast("string")))
    rows = rows.withColumns({k: v.cast("double") for k, v in form.items()}).withColumn("page", page)
    rows = rows.withColumn("w", F.when(n > 0, F.col("w")).otherwise(F.array(F.lit("")))).drop("chars")
    rows = HashingTF(numFeatures=TEXT_BUCKETS, inputCol="w", outputCol="counts", binary=True).transform(rows)
    rows = HashingTF(numFeatures=PAGE_BUCKETS, inputCol="page", outputCol="page_view", binary=True).transform(rows)
    rows = VectorAssembler(inputCols=[*form, "counts"], outputCol="text_view").transform(rows)
    return rows.select(*[c for c in docs.columns if c != "text"], "text_view", "page_view")


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    """Classes weigh the same; columns view and label."""
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(n.values())
    weight = F.when(F.col("label") == 1, total / (2 * n[1])).otherwise(total / (2 * n[0]))
    return LogisticRegression(featuresCol=view, labelCol="label", weightCol="weight", regParam=0.01, maxIter=25) \
        .fit(rows.withColumn("weight", weight))


def _log_odds(model: LogisticRegressionModel, rows: DataFrame, view: str, name: str) -> DataFrame:
    """Adds the model's log odds of good."""
    model = model.copy()
    model.setFeaturesCol(view).setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
    return model.transform(rows).withColumn(name, vector_to_array("_raw")[1]).drop("_raw")


def _platt(rows: DataFrame, name: str) -> tuple[float, float]:
    """(slope, offset) of calibrated log odds of good from a view's log odds."""
    one = VectorAssembler(inputCols=[name], outputCol="v").transform(rows)
    fit = LogisticRegression(featuresCol="v", labelCol="label", regParam=0.001, maxIter=50).fit(one)
    return max(float(fit.coefficients[0]), 0.0), float(fit.intercept)


def _edges(rows: DataFrame, given: dict[str, str], n: int) -> dict[tuple[str, int], int]:
    """By view and label: the step of the log odds from which on the view's n surest rows of that label lie.
    given: by view the column of the labels it has handed over; those rows do not count."""
    sides = F.array(*[
        F.when(F.col(column).isNull() & _sure(name, label), F.struct(
            F.lit(name).alias("name"), F.lit(label).alias("label"), _step(name, label).alias("step")))
        for name, column in given.items() for label in (1, 0)])
    counts = rows.select(F.explode(sides).alias("x")).filter("x is not null").groupBy("x").count().collect()
    edges: dict[tuple[str, int], int] = {}
    have: dict[tuple[str, int], int] = {}
    for (name, label, step), count in sorted(((tuple(r["x"]), r["count"]) for r in counts), key=lambda x: -x[0][2]):
        if have.get((name, label), 0) < n:
            edges[name, label] = step
            have[name, label] = have.get((name, label), 0) + count
    return edges


def _strength(name: str, label: int) -> Column:
    return F.col(name) if label else -F.col(name)


def _sure(name: str, label: int) -> Column:
    return _strength(name, label) >= math.log(CONFIDENT / (1 - CONFIDENT))


def _step(name: str, label: int) -> Column:
    return F.floor(F.least(_strength(name, label), F.lit(float(MAX_ODDS))) * STEPS).cast("int")


def _handed(name: str, edges: dict[tuple[str, int], int]) -> Column:
    """The label a view hands over for a row, or null."""
    out = F.lit(None).cast("int")
    for label in (1, 0):
        if (name, label) in edges:
            out = F.when(_sure(name, label) & (_step(name, label) >= edges[name, label]), label).otherwise(out)
    return out


def train(docs: DataFrame, labels: DataFrame):
    """docs: id, text, source, lang, length; labels: id, label (1 good, 0 bad). Returns
    ({view: (model, slope, offset)}, log odds of the prior), or (None, share of good labels),
    and the documents with their views."""
    labels = labels.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    chosen = labels.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    rows = featurize(docs.join(F.broadcast(chosen), "id", "left")).drop("source", "lang", "length")       # MAX_LABELLED ids
    rows = materialize(rows, "views")
    held = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(HELD_OUT)) == 0
    known = materialize(rows.filter("label is not null"), "labelled")
    seen = {(r["held"], r["label"]): r["count"] for r in known.groupBy(held.alias("held"), "label").count().collect()}
    good, total = sum(n for (_, x), n in seen.items() if x == 1), sum(seen.values())
    if len(seen) < 4:
        return None, good / total if total else 0.5, rows
    learn, check, unlabelled = known.filter(~held), known.filter(held), rows.filter("label is null").drop("label")
    n = max(GROW_LEAST, math.ceil(GROW * unlabelled.count()))
    views = {"text": "text_view", "page": "page_view"}
    given = {"text": "for_page", "page": "for_text"}       # what one is sure of the other learns
    unlabelled = unlabelled.withColumns({c: F.lit(None).cast("int") for c in given.values()})
    models = {}
    for r in range(ROUNDS + 1):
        for name, view in views.items():
            rows_now = learn.select("label", view)
            if r:
                more = unlabelled.withColumn("label", F.col(f"for_{name}")).filter("label is not null")
                rows_now = rows_now.unionByName(more.select("label", view))
            models[name] = _fit(rows_now, view)
        if r == ROUNDS:
            break
        scored = unlabelled
        for name, view in views.items():
            scored = _log_odds(models[name], scored, view, name)
        edges = _edges(scored, given, n)
        unlabelled = scored.withColumns(
            {c: F.coalesce(F.col(c), _handed(name, edges)) for name, c in given.items()}).drop(*views)
    for name, view in views.items():
        check = _log_odds(models[name], check, view, name)
    check = materialize(check.select("label", *views), "check")
    odds = math.log(good / (total - good))
    return {name: (models[name], *_platt(check, name)) for name in views}, odds, rows


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source: str = "source", lang: str = "lang", length: str = "n_chars", label: str = "quality") -> DataFrame:
    """id, text_score, page_score (calibrated probabilities of good), score (both views), kept."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(length).cast("long").alias("length"))
    views, prior, out = train(rows, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")))
    if views is None:
        out = out.select(F.col("id"), *[F.lit(float(prior)).alias(c) for c in ("text_score", "page_score", "score")])
    else:
        for name, (model, slope, offset) in views.items():
            out = _log_odds(model, out, f"{name}_view", name).withColumn(name, F.col(name) * slope + offset)
        chance = {c: 1 / (1 + F.exp(-x)) for c, x in (
            ("text_score", F.col("text")), ("page_score", F.col("page")), ("score", F.col("text") + F.col("page") - prior))}
        out = out.select("id", *[v.alias(c) for c, v in chance.items()])
    return out.withColumn("kept", F.col("score") >= KEEP_FROM).withColumnRenamed("id", id_col)
