"""Exact substring dedup: words inside a window of WINDOW words that also starts in a
document with a smaller id are removed. Found with an FM-index per shard.

1. One pass over the texts cuts each document into segments: runs of windows (at most
   RUN of them) with the same anchor, the least hash of all GRAM-word sequences in
   the window. Equal windows have equal anchors, so a window can only recur in a segment with its anchor.
   A segment is kept as anchor, digest of its words (64 bits each) and place; no text moves.
2. Anchors that occur in one document only are dropped. Equal segments collapse to one
   with the smallest id that has it (a partial minimum before the shuffle), so a passage
   copied into a third of all documents is one row.
3. Where an anchor has more than one distinct segment, their words are cut from their
   documents and dealt by anchor to shards. A shard's index (SHARD_WORDS words, at anchor borders) is a wavelet matrix of the segments' Burrows-Wheeler
   transform; the shard's segments are streamed through it by backward search, one step
   a place, and each place whose WINDOW words also start in a segment of a smaller id
   is reported, as intervals.
4. Every document takes the intervals of its segments: a segment that a smaller id has
   as a whole is covered in full, else the reported intervals are.

An anchor with more than HOT distinct segments is not indexed as one group: its
segments are taken window by window, each window's digest grouped with the
smallest id that has it, which is exact and spreads over all tasks.

Windows are judged on the input. Defined cases: a null text has no words; fewer than
WINDOW words lose none; rows that share an id never remove each other's words; rows
with a null id neither remove nor lose words; an empty table gives an empty result;
only the id and the text are read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import fm_index
from riskframe.llm.common import materialize, ship, ship_by_value
from riskframe.llm.fm_index import FMIndex
from riskframe.llm.hashing import doc_words, mix64, text_buffer

WINDOW = 50
GRAM = 8
RUN = 64
SHARD_WORDS = 1 << 20
HOT = 20_000

_Q = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _rolling(h: np.ndarray, size: int, q: np.uint64) -> np.ndarray:
    out = np.zeros(max(len(h) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        if len(out):
            out = out * q + h[k:k + len(out)]
    return mix64(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, n = 1, len(x) - width + 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have:width - have + n])


def segments_of(h: np.ndarray):
    """(anchor, first window, windows) of a document's segments, from its words' hashes."""
    none = np.empty(0, np.int64)
    if len(h) < WINDOW:
        return none.astype(np.uint64), none, none
    anchor = _sliding_min(_rolling(h, GRAM, _Q[0]), WINDOW - GRAM + 1)
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    length = np.diff(np.append(cut, len(anchor)))
    pieces = -(-length // RUN)
    start = np.repeat(cut, pieces) + RUN * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(start + RUN, np.repeat(cut + length, pieces))
    return anchor[start], start, end - start


def _digests(h: np.ndarray, start: np.ndarray, words: np.ndarray, which=_Q):
    """A 64-bit digest of the word runs for each of the multipliers."""
    out = []
    for q in which:
        up = np.full(len(h) + 1, q, dtype=np.uint64)
        up[0] = 1
        up = np.multiply.accumulate(up)
        down = np.full(len(h) + 1, pow(int(q), -1, 1 << 64), dtype=np.uint64)
        down[0] = 1
        down = np.multiply.accumulate(down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ q) * up[:-1], dtype=np.uint64)])
        out.append(mix64((sums[start + words] - sums[start]) * down[start] + words.astype(np.uint64)))
    return out


def _segments(batches):
    import pyarrow as pa

    def column(parts, kind):
        return pa.array(np.concatenate([np.asarray(p).view(np.int64) if kind == "h" else p for p in parts])
                        if parts else np.empty(0, np.int64), pa.int64())

    for batch in batches:
        ids, keys = (np.array(batch.column(k), dtype=np.int64) for k in (0, 1))
        buf, offsets = text_buffer(batch.column(2))
        out = {k: [] for k in ("doc_id", "text_key", "anchor", "a", "start", "n")}
        for first, h, counts in doc_words(buf, offsets, lower=False):
            ends = np.cumsum(counts)
            for d in np.flatnonzero(counts >= WINDOW):
                words = h[ends[d] - counts[d]:ends[d]]
                anchor, start, n = segments_of(words)
                a, = _digests(words, start, n + WINDOW - 1, _Q[1:])
                for k, v in zip(out, (np.full(len(n), ids[first + d]), np.full(len(n), keys[first + d]),
                                      anchor, a, start, n)):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [column(v, "h" if k in ("anchor", "a") else "") for k, v in out.items()], names=list(out))


def _cut(batches):
    """Words of the listed segments of each text: whole segments, or (hot) each window's digest."""
    import pyarrow as pa

    for batch in batches:
        buf, offsets = text_buffer(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for first, h, counts in doc_words(buf, offsets, lower=False):
            rows, ends = [], np.cumsum(counts)
            lists = batch.column("segments").slice(first, len(counts)).to_pylist()
            for d in range(len(counts)):
                words = h[ends[d] - counts[d]:ends[d]]
                for s in lists[d] or ():
                    part = words[s["start"]:s["start"] + s["n"] + WINDOW - 1]
                    if s["hot"]:
                        at = np.arange(s["n"])
                        wa, wb = _digests(part, at, np.full(len(at), WINDOW))
                        rows += [(ids[first + d], s["anchor"], s["a"], int(i), None, x, y) for i, x, y in zip(
                            at, wa.view(np.int64).tolist(), wb.view(np.int64).tolist())]
                    else:
                        rows.append((ids[first + d], s["anchor"], s["a"], None, _packed(part), None, None))
            yield _cut_batch(pa, rows)              # groups of documents of about a MB


def _packed(words: np.ndarray) -> bytes:
    """48 bits of each word's hash; 50 of them make a window."""
    return words.view(np.uint16).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 4), dtype=np.uint16)
    out[:, :3] = np.frombuffer(data, np.uint16).reshape(-1, 3)
    return out.view(np.uint64).ravel()


def _cut_batch(pa, rows):
    kinds = (("least", pa.int64()), ("anchor", pa.int64()), ("a", pa.int64()), ("at", pa.int64()),
             ("words", pa.binary()), ("wa", pa.int64()), ("wb", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)],
                                      names=[n for n, _ in kinds])


def _search(batches):
    """Rows come in order of anchor; shards end at anchor borders. Gives the intervals
    found; single windows (hot anchors) go through as they are."""
    import pyarrow as pa

    names = ("least", "anchor", "a", "from", "to", "wa", "wb")

    def found(rows, single):
        out = list(single)
        if len(rows) > 1:
            least = np.array([r[0] for r in rows], dtype=np.int64)
            index = FMIndex([_unpacked(r[4]) for r in rows], WINDOW)
            smallest = index.least(least)
            hits = [(which[m], place[m]) for which, place, group in index.matches()
                    if (m := smallest[group] < least[which]).any()]
            if hits:
                who, place = np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])
                order = np.lexsort((place, who))
                who, place = who[order], place[order]
                cut = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1)]))
                last = np.append(cut[1:], len(who)) - 1
                out += [(*rows[w][:3], int(x), int(y) + 1, None, None) for w, x, y in zip(who[cut], place[cut], place[last])]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(7)], names=names)

    rows, size, anchor, single = [], 0, None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("least", "anchor", "a", "at", "words", "wa", "wb"))):
            if row[4] is None:
                single.append((*row[:4], row[3] + 1, *row[5:]))
                continue
            if row[1] != anchor and size >= SHARD_WORDS:
                yield found(rows, [])
                rows, size = [], 0
            anchor = row[1]
            rows.append(row)
            size += len(row[4]) // 6
        if single:
            yield found([], single)
            single = []
    yield found(rows, [])


def _apply(batches):
    """Removes the words of covered windows from each text."""
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("text")
        buf, offsets = text_buffer(texts)
        raw = memoryview(buf)
        n_words, n_removed, kept = [], [], []
        for d, spans in enumerate(batch.column("spans").to_pylist()):
            words = _WORD.findall(raw[offsets[d]:offsets[d + 1]])
            n_words.append(len(words))
            if spans:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans:
                    edge[s["from"]] += 1
                    edge[s["to"] + WINDOW - 1] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                n_removed.append(int(len(words) - stay.sum()))
                words = [words[i] for i in np.flatnonzero(stay)]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"])


def repeated_windows(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """rows: doc_id, text_key, text. doc_id, text_key, spans: intervals (from, to) of windows
    that also start in a document with a smaller id; only rows that have some."""
    segments = materialize(rows.filter("doc_id is not null").select("doc_id", "text_key", "text").mapInArrow(
        _segments, "doc_id bigint, text_key bigint, anchor bigint, a bigint, start bigint, n bigint"), "segments")
    shared = segments.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")) \
        .filter("x < y").select("anchor")
    segments = materialize(segments.join(shared, "anchor"), "shared")
    key = ["anchor", "a"]           # a: digest of the segment's words, beside that of its anchor
    distinct = segments.groupBy(*key).agg(F.min(F.struct("doc_id", "text_key", "start", "n")).alias("first"))
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"))
    distinct = materialize(distinct.join(kinds, "anchor").select(*key, "first.*", "kinds"), "distinct")
    # where all segments of an anchor are equal none of its windows stands in another one
    listed = distinct.filter("kinds > 1").groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct(*key, "start", "n", (F.col("kinds") > hot).alias("hot"))).alias("segments"))
    cut = rows.join(listed, ["doc_id", "text_key"]).select("doc_id", "text", "segments").mapInArrow(
        _cut, "least bigint, anchor bigint, a bigint, at bigint, words binary, wa bigint, wb bigint")
    # whole segments meet by anchor, single windows are spread by place as well
    found = materialize(cut.repartition("anchor", "at").sortWithinPartitions("anchor").mapInArrow(
        _search, "least bigint, anchor bigint, a bigint, from bigint, to bigint, wa bigint, wb bigint"), "found")
    # hot anchors: the smallest id of each window
    single = found.filter("wa is not null")
    smallest = single.groupBy("wa", "wb").agg(F.min("least").alias("smallest"))
    by_window = single.join(smallest, ["wa", "wb"]).filter("smallest < least").select(*key, "from", "to")
    inside = found.filter("wa is null").select(*key, "from", "to").unionByName(by_window).groupBy(*key).agg(
        F.collect_list(F.struct("from", "to")).alias("inside"))
    owners = distinct.select(*key, F.col("doc_id").alias("least")).join(inside, key, "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n").alias("to")))
    spans = segments.join(owners, key).withColumn(
        "span", F.explode(F.when(F.col("doc_id") > F.col("least"), whole).otherwise(F.col("inside"))))
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("span.from")).alias("from"), (F.col("start") + F.col("span.to")).alias("to"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of every row."""
    ship(__name__)
    ship_by_value(fm_index)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    spans = materialize(repeated_windows(rows, hot), "spans")
    return rows.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans") \
        .mapInArrow(_apply, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
