"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's shingles (five words, A-Z lower-cased; of a shorter text the whole sequence)
are hashed once. The hash's leading bits choose one of BINS bins, each bin keeps its
smallest hash. An empty bin takes the value of an occupied one by optimal densification:
every bin has a random order of all bins of its own (given by a hash of the two bin
numbers), and the first occupied bin in that order gives its value. The lowest BITS
bits of each value are stored, as one hex digit a bin. Two fingerprints agree by chance in
one bin of 2 ** BITS, so the likeness is (agreeing share - c) / (1 - c) with
c = 2 ** -BITS, kept within 0 and 1.

``with_neighbours`` also needs the next document by descending id. Documents are dealt
by ranges of their id whose upper ends are ids of the table; the document at an upper
end is also sent, marked, to the range above it (that with the largest id to the lowest
range), where it is the successor of the last document. One shuffle, and no task gets
more than a range.

Defined cases: a null text counts as empty; a text without words has the empty
fingerprint, which is like itself (1.0) and unlike all others (0.0); a null id sorts
below all others; rows with the same id follow each other in order of their text's
hash; the only document of a table is its own successor; an empty table gives an
empty result; only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import words

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 4
RANGE_ROWS = 20_000             # documents of a range, about

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text: BINS hex digits, or empty without words."""
    def of_words(w):
        n = F.size(w)
        whole = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))),
                            lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)]))
        hashes = F.when(n >= SHINGLE, whole).when(n > 0, F.array(F.xxhash64(w)))
        return _let(F.sort_array(hashes), least_of_bins)

    def least_of_bins(s):
        # sorted hashes of a bin stand together, the smallest first
        first = F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(s[F.greatest(i - 1, F.lit(0))])))
        return _let(first, lambda m: _let(F.transform(m, _bin), lambda b: digits(m, b)))

    def digits(mins, bins):
        def value(j):
            at = F.array_position(bins, j)
            own = mins[F.greatest(at.cast("int") - 1, F.lit(0))]
            lent = F.array_min(F.transform(mins, lambda h: F.struct(F.xxhash64(_bin(h), j).alias("o"), h.alias("h"))))
            return F.lower(F.hex(F.when(at > 0, own).otherwise(lent["h"]).bitwiseAND(F.lit((1 << BITS) - 1))))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value), "")

    # words() of no text is empty, and nothing of it reaches the hashing
    w = words(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(_let(w, lambda x: F.when(F.size(x) > 0, of_words(x))), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the shingle sets of two fingerprints."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda z: z))
    chance = 2.0 ** -BITS
    share = same / F.lit(float(BINS))
    estimate = F.least(F.greatest((share - chance) / (1 - chance), F.lit(0.0)), F.lit(1.0))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(estimate)


def _range_of(key: Column, ends: list[int]) -> Column:
    """Number of the first range whose upper end is not below the key (binary search)."""
    table = F.array(*[F.lit(e).cast("long") for e in ends])

    def of(t):
        steps = F.sequence(F.lit(1), F.lit(max(len(ends).bit_length(), 1)))
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(ends) - 1).alias("hi"))

        def halve(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            below = t[mid] < key
            return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(
                F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"),
                F.when(below, acc["hi"]).otherwise(mid).alias("hi")))
        return F.aggregate(steps, start, halve, lambda acc: acc["lo"])
    return of(table)


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, fingerprint and those of the next document by descending id."""
    low = -(1 << 63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(low))
    spark = docs.sparkSession
    n = docs.count()
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 64, n // RANGE_ROWS)
    shares = [k / parts for k in range(1, parts + 1)]
    ends = sorted(set(docs.select(key.alias("k")).agg(
        F.percentile_approx("k", shares, 10 * parts).alias("e"), F.max("k").alias("m")).select(
        F.array_distinct(F.concat("e", F.array("m")))).first()[0] or [])) if n else [0]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("k"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("own", _range_of(F.col("k"), ends))
    ends_at = F.array(*[F.lit(e).cast("long") for e in ends])[F.col("own")]
    above = F.pmod(F.col("own") + 1, F.lit(len(ends)))
    places = F.when(F.col("k") == ends_at, F.array(
        F.struct(F.col("own").alias("range"), F.lit(False).alias("extra")),
        F.struct(above.alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(
            F.struct(F.col("own").alias("range"), F.lit(False).alias("extra"))))
    rows = rows.select("doc_id", "k", "text", "fingerprint", F.inline(places))
    order = Window.partitionBy("range").orderBy("extra", F.desc("k"), F.xxhash64("text"))
    return rows.withColumn("next_text", F.lead("text").over(order)) \
        .withColumn("next_fingerprint", F.lead("fingerprint").over(order)) \
        .filter(~F.col("extra")).select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text: the last third (rounded down) replaced by
    as many first code points of the next document, or all of it if it has fewer."""
    rows = with_neighbours(docs, id_col, text_col)
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - m), F.col("next_text").substr(F.lit(1), m))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
