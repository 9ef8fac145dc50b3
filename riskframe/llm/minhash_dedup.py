"""MinHash near-duplicate groups: many universal hash minima, banding, signature
verification, confirmation on full shingle sets, and connected components.

Jobs (nothing of the documents but digests is shuffled except where said):

1. One pass over the texts gives each document's distinct shingle count, a
   128-bit digest of its shingle set, HASHES universal minima cut into BANDS band
   keys, and one byte of each minimum.
2. Documents with the same set collapse to one representative (its smallest id),
   so thousands of exact copies cost one row afterwards.
3. Representatives that share a band key are a bucket; each links to the bucket's
   smallest id (a star: rows, not pairs) and is compared with the one document it
   shares most buckets with. Components of the confirmed links are *groups*.
4. Buckets that hold two groups or more are searched: documents outside a bucket's
   largest group meet all of the bucket, signatures first, in blocks of SIG_BLOCK;
   a pair counts in the first bucket it shares only. Documents with a signature
   match in another group meet again with their full sets, in blocks of BLOCK. A
   task holds two blocks, however large a bucket is, and returns links of a
   spanning forest of groups only, never pairs of a group. Pages that share a
   template but not their text end at the signatures, a few hundred bytes each.
5. Connected components of the confirmed links, mapped back through step 2.

A pair at similarity exactly 0.75 shares no band with probability 2e-5, and a
signature below SIG_FLOOR with about 5e-6; both fall steeply above 0.75.

Defined cases: a null or wordless text has no shingles and is linked with
nothing; with fewer than five words the whole sequence is one shingle; rows that
repeat a doc_id count as that document's copies and give one result row each;
rows with a null doc_id keep a row with a null component; an empty table gives an
empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize, ship
from riskframe.llm.components import connected_components
from riskframe.llm.hashing import doc_words, mix64, odd_multipliers, shingle_hashes, text_buffer

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
SHINGLE = 5
BLOCK = 256                 # documents of a block with full sets; a task compares two blocks
SIG_BLOCK = 4096            # documents of a block with signatures only
BLOCK_SHINGLES = 1 << 20    # shingles of a block: long documents make smaller blocks
SIG_FLOOR = 0.61            # 0.75 less 4.5 standard deviations of a 200-minima estimate
_MULT = odd_multipliers(101, HASHES)
_ADD = odd_multipliers(202, HASHES)
_BAND_MULT = odd_multipliers(303, ROWS)
_BAND_ADD = odd_multipliers(404, BANDS)

_SIG_SCHEMA = ("doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, "
               "bands array<bigint>, sig binary")
_TILE = 1 << 16


def _minima(sh: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """HASHES x documents: minima of (a x + b) mod 2^64 over each document's shingles
    (every document here has one at least)."""
    out = np.full((HASHES, len(counts)), np.iinfo(np.uint64).max, dtype=np.uint64)
    ends = np.cumsum(counts)
    d = 0
    while d < len(counts):                      # tiles that stay in the CPU's cache
        lo = int(ends[d] - counts[d])
        e = max(int(np.searchsorted(ends, lo + _TILE, side="right")), d + 1)
        part = sh[lo:int(ends[e - 1])]
        at = (ends[d:e] - counts[d:e] - lo).astype(np.int64)
        buf = np.empty_like(part)
        for k in range(HASHES):
            np.multiply(part, _MULT[k], out=buf)
            np.add(buf, _ADD[k], out=buf)
            out[k, d:e] = np.minimum.reduceat(buf, at)
        d = e
    return out


def _signatures(batches):
    import pyarrow as pa

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        buf, offsets = text_buffer(texts)
        n = len(ids)
        count, set_a, set_b = (np.zeros(n, dtype=t) for t in (np.int64, np.uint64, np.uint64))
        bands = np.zeros((n, BANDS), dtype=np.uint64)
        sig = np.zeros((n, HASHES), dtype=np.uint8)
        for first, h, per_doc in doc_words(buf, offsets, lower=True):
            sh, k = shingle_hashes(h, per_doc, SHINGLE)
            has = np.flatnonzero(k > 0)
            if not len(has):
                continue
            m = _minima(sh, k[has])
            rows = first + has
            sig[rows] = (m >> np.uint64(40)).astype(np.uint8).T
            high = m >> np.uint64(20)
            bands[rows] = np.stack([
                mix64((high[b * ROWS:(b + 1) * ROWS] * _BAND_MULT[:, None]).sum(axis=0)
                             + _BAND_ADD[b]) for b in range(BANDS)], axis=1)
            ends = np.cumsum(k)
            for d in has:
                u = np.unique(sh[ends[d] - k[d]:ends[d]])
                count[first + d] = len(u)
                set_a[first + d] = u.sum()
                set_b[first + d] = mix64(u ^ np.uint64(0xA0761D6478BD642F)).sum()
        flat = pa.array(bands.view(np.int64).ravel())
        yield pa.RecordBatch.from_arrays([
            ids.cast(pa.int64()), pa.array(count), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), flat),
            pa.array([x.tobytes() for x in sig], type=pa.binary())],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sig"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set digest, band keys and byte signature of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(_signatures, _SIG_SCHEMA)


def _sets(batches):
    """Each row's sorted distinct shingle hashes, in place of its text."""
    import pyarrow as pa

    for batch in batches:
        buf, offsets = text_buffer(batch.column("text"))
        sets = []
        for _, h, per_doc in doc_words(buf, offsets, lower=True):
            sh, k = shingle_hashes(h, per_doc, SHINGLE)
            ends = np.cumsum(k)
            sets += [np.unique(sh[e - c:e]).tobytes() for e, c in zip(ends, k)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sig"), pa.array(sets, type=pa.binary())],
            names=["id", "sig", "shingles"])


def _tasks(batches):
    """The rows of one task (c, x, y) after the other, from batches sorted by task."""
    import pyarrow as pa

    held, at = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in ("c", "x", "y")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), n]
        for start, end in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[:, start].tolist())
            if held and key != at:
                yield at[0], pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(start, end - start))
    if held:
        yield at[0], pa.Table.from_batches(held)


def _numbers(rows, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _byte_matrix(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)


def _sizes_allow(a, b, threshold: float):
    return 100 * np.minimum(a, b) >= 100 * threshold * np.maximum(a, b)


def _forest(rows, threshold: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the groups that similar pairs (left x right) join,
    found by signature verification and confirmed on the full sets."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    links = []
    left = np.array(rows.column("side").to_pylist()) == "l"
    group, sig = _numbers(rows, "g").tolist(), _byte_matrix(rows)
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    right = np.flatnonzero(~left)
    for i in np.flatnonzero(left):
        agree = (sig[right] == sig[i]).sum(axis=1)
        may = np.flatnonzero((agree >= SIG_FLOOR * HASHES) & _sizes_allow(size[right], size[i], threshold))
        for j in right[may[np.argsort(-agree[may], kind="stable")]]:
            a, b = root(group[i]), root(group[j])
            if a == b:
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            if 100 * inter >= round(100 * threshold) * (len(both) - inter):
                parent[a] = b
                links.append((group[i], group[j]))
    return links


def _confirm(threshold: float):
    def run(batches):
        import pyarrow as pa

        for _, rows in _tasks(batches):
            found = _forest(rows, threshold)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
    return run


def _verify(threshold: float):
    """Documents of a bucket that have a signature match in another group of it."""
    def run(batches):
        import pyarrow as pa

        for bucket, rows in _tasks(batches):
            side = np.array(rows.column("side").to_pylist()) == "l"
            left, right = np.flatnonzero(side), np.flatnonzero(~side)
            ids, group, size = (_numbers(rows, c) for c in ("id", "g", "n_shingles"))
            outside = np.array(rows.column("outside").to_pylist())
            bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sig, hit = _byte_matrix(rows), np.zeros(len(ids), dtype=bool)
            for i in left:
                # two documents outside the largest group meet twice: once is enough
                may = right[(group[right] != group[i]) & ~(outside[right] & (ids[right] < ids[i]))
                            & _sizes_allow(size[right], size[i], threshold)]
                may = may[(sig[may] == sig[i]).sum(axis=1) >= SIG_FLOOR * HASHES]
                first = (bands[may] == bands[i]).argmax(axis=1)     # the pair's first common bucket
                may = may[bands[i][first] == bucket]
                hit[may] = True
                hit[i] |= len(may) > 0
            at = np.flatnonzero(hit)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), bucket, dtype=np.int64)), *(pa.array(x[at]) for x in (ids, group, size)),
                     pa.array(outside[at])], names=["band", "id", "g", "n_shingles", "outside"])
    return run


def _by_task(roles: DataFrame, facts: DataFrame) -> DataFrame:
    """roles: id, side (l or r), task (c, x, y) and more; facts of each id join them."""
    return roles.join(facts, "id").repartition("c", "x", "y").sortWithinPartitions("c", "x", "y")


def _opposed(placed: DataFrame, *more: str) -> DataFrame:
    """Roles of a bucket's rows: each block of those outside its largest group (n_l
    blocks, number bl) against each block of all (n_r blocks, number br)."""
    def each(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    band = F.col("band").alias("c")
    left = placed.filter("outside").select("id", *more, F.lit("l").alias("side"), band, F.col("bl").alias("x"), each("n_r").alias("y"))
    right = placed.select("id", *more, F.lit("r").alias("side"), band, each("n_l").alias("x"), F.col("br").alias("y"))
    return left.unionAll(right)


def _block_number(n: str, seed: int) -> F.Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), n)


def _blocks(rows, n_shingles) -> F.Column:
    """How many blocks so many documents with so many shingles in all make."""
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(n_shingles / BLOCK_SHINGLES)).cast("long")


def _between_groups(members: DataFrame, state: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) between groups. members: band, id; state: id, g (group), n_shingles, sig, bands."""
    inside = members.join(state.select("id", "g"), "id")
    open_ = inside.groupBy("band", "g").agg(F.count("*").alias("m")) \
        .groupBy("band").agg(F.sum("m").alias("rows"), F.max(F.struct("m", "g")).alias("top"), F.count("*").alias("groups")) \
        .filter("groups > 1").select(
            "band", F.col("top.g").alias("top"), F.ceil((F.col("rows") - F.col("top.m")) / SIG_BLOCK).alias("n_l"),
            F.ceil(F.col("rows") / SIG_BLOCK).alias("n_r"))
    placed = inside.join(open_, "band").select(
        "band", "id", "n_l", "n_r", (F.col("g") != F.col("top")).alias("outside"),
        _block_number("n_l", 0).alias("bl"), _block_number("n_r", 1).alias("br"))
    matched = materialize(
        _by_task(_opposed(materialize(placed, "placed"), "outside"), state)
        .select("c", "x", "y", "side", "id", "g", "n_shingles", "outside", "sig", "bands")
        .mapInArrow(_verify(threshold), "band bigint, id bigint, g bigint, n_shingles bigint, outside boolean")
        .distinct(), "matched")

    size = matched.groupBy("band").agg(
        _blocks(F.sum(F.col("outside").cast("long")), F.sum(F.when(F.col("outside"), F.col("n_shingles")))).alias("n_l"),
        _blocks(F.count("*"), F.sum("n_shingles")).alias("n_r"))
    placed = matched.join(size, "band").select(
        "band", "id", "g", "n_l", "n_r", "outside", _block_number("n_l", 2).alias("bl"), _block_number("n_r", 3).alias("br"))
    return _by_task(_opposed(placed, "g"), sets).select("c", "x", "y", "side", "id", "g", "sig", "shingles") \
        .mapInArrow(_confirm(threshold), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of
    similarity ``threshold`` or more, at least 0.75), kept (doc_id = component_id)."""
    if threshold < 0.75:
        raise ValueError("the banding is laid out for similarities of 0.75 and more")
    ship(__name__)
    sig = materialize(signatures(docs, id_col, text_col), "signatures")
    real = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(real.groupBy("set_a", "set_b", "n_shingles").agg(
        F.min(F.struct("doc_id", "bands", "sig")).alias("rep")), "classes")
    reps = classes.select("rep.*")

    # buckets of two or more, each with its smallest id; only ids and keys move
    banded = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")) \
        .filter("hub != last").select("band", "hub")
    members = materialize(banded.join(buckets, "band"), "members")
    best = members.filter("id != hub").groupBy("id", "hub").agg(F.count("*").alias("n")) \
        .groupBy("id").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("b")) \
        .select("id", (-F.col("b.hub")).alias("hub"))

    # the full sets of the documents in buckets, once
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    need = materialize(members.select("id").distinct().join(
        classes.select(F.col("rep.doc_id").alias("id"), "n_shingles", "rep.sig", "rep.bands"), "id"), "need")
    sets = materialize(text.join(need.select("id", "sig"), "id").select(F.col("id").alias("doc_id"), "sig", "text")
                       .mapInArrow(_sets, "id bigint, sig binary, shingles binary"), "sets")

    # each document against the hub it shares most buckets with
    best = best.join(need.select("id", "n_shingles"), "id")
    slots = best.groupBy("hub").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("slots"))
    zero, group = F.lit(0).cast("long").alias("y"), F.col("id").alias("g")
    mine = best.join(slots, "hub").select("id", group, F.lit("l").alias("side"), F.col("hub").alias("c"),
                                          _block_number("slots", 0).alias("x"), zero)
    hubs = slots.select(F.col("hub").alias("id"), F.col("hub").alias("g"), F.lit("r").alias("side"), F.col("hub").alias("c"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("x"), zero)
    first = _by_task(mine.unionAll(hubs), sets).select("c", "x", "y", "side", "id", "g", "sig", "shingles") \
        .mapInArrow(_confirm(threshold), "u bigint, v bigint")
    groups = connected_components(materialize(first, "links-1"), "groups")
    state = materialize(need.join(groups, "id", "left").withColumn("g", F.coalesce("component", "id"))
                        .select("id", "g", "n_shingles", "sig", "bands"), "state")

    # then the groups of each bucket against each other; a group's name is its smallest id
    second = materialize(_between_groups(members.select("band", "id"), state, sets, threshold), "links-2")
    joined = connected_components(second, "final").select(F.col("id").alias("g"), F.col("component").alias("whole"))
    final = state.select("id", "g").join(joined, "g", "left").select("id", F.coalesce("whole", "g").alias("component"))

    of_class = classes.select("set_a", "set_b", "n_shingles", F.col("rep.doc_id").alias("id")) \
        .join(final, "id", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("c"))
    slim = sig.select("doc_id", "n_shingles", "set_a", "set_b")
    out = slim.join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      (F.col("doc_id") == component).alias("kept"))
