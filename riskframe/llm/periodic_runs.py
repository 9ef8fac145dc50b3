"""Periodic runs of words: found by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q (words q apart are identical), at
least MIN_WORDS words and MIN_TIMES times q long, that no neighbouring word extends.

1. A task numbers the words of its texts (equal words, equal numbers; no hashes).
2. Splitting: in a run of MIN_TIMES periods every word stands MIN_TIMES times or more, so a word that
   occurs less often within the current segment can't be in a run of it: its places split the
   segment. Pieces shorter than MIN_WORDS go; pieces that changed are counted again, until
   none changes. All segments of a group of texts are counted by one sort a round.
3. Lag scan of the segments that are left. For lags of one octave, [B, 2B), the places that are
   multiples of B are compared at each lag by the number of their B words (equal words,
   equal numbers, made by doubling): a run of three periods holds such a block. Blocks that
   follow one another at one lag are one stretch, whose ends are found by halving steps. So a
   segment of n words costs about n comparisons an octave, not n for each lag.
4. Of the lags that give the same stretch the smallest is its period.

Only the text is read; each row is judged for itself, so copies, hot sources and repeated
or null ids need nothing, and nothing is shuffled. Defined cases: a null, empty or blank
text has no words, no runs and an empty collapsed text; an empty table gives an empty result. Very
long texts are held whole in their task; memory grows with their words.
"""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import ship

MIN_WORDS = 24
MIN_TIMES = 3
GROUP_WORDS = 1 << 19           # words of a task's texts that are taken together
FIRST = 8                       # block of the first octave, which takes all lags below 2 * FIRST

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split_segments(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words: numbers of words; segments [start, end) in order. The segments in which every word
    occurs MIN_TIMES or more, after recursive splitting."""
    done_start, done_end = [], []
    long = ends - starts >= MIN_WORDS
    starts, ends = starts[long], ends[long]
    while len(starts):
        size = ends - starts
        segment = np.repeat(np.arange(len(starts)), size)
        place = np.arange(int(size.sum())) + np.repeat(starts - np.cumsum(size) + size, size)
        _, key, count = np.unique(segment * (int(words.max()) + 1) + words[place], return_inverse=True, return_counts=True)
        common = count[key.ravel()] >= MIN_TIMES
        stable = np.bincount(segment, weights=~common, minlength=len(starts)) == 0
        done_start.append(starts[stable])
        done_end.append(ends[stable])
        inside = np.zeros(int(place[-1]) + 1 if len(place) else 0, dtype=bool)
        inside[place[common & ~stable[segment]]] = True
        cut = np.zeros(len(inside) + 1, dtype=bool)         # segments that touch stay apart
        cut[starts[starts < len(inside)]] = True
        edge = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
        stop = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        long = stop - edge >= MIN_WORDS
        starts, ends = edge[long], stop[long]
    if not done_start:
        return starts, ends
    starts, ends = np.concatenate(done_start), np.concatenate(done_end)
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def scan_lags(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Runs within the segments: rows of start, length, period, by start and period. In the first
    octave a run leaves a lag at least 2 * FIRST - 1 equal words, in the others twice the block:
    either way one whole block at a multiple of its size."""
    size = ends - starts
    if not len(size):
        return np.empty((0, 3), dtype=np.int64)
    first = np.cumsum(size + 1) - size - 1                  # place of each segment in the joined text
    n = int((size + 1).sum())
    source = np.repeat(starts - first, size + 1) + np.arange(n)
    border = first + size
    source[border] = 0
    _, text = np.unique(words[source], return_inverse=True)
    text = text.ravel().astype(np.int64)
    text[border] = n + np.arange(len(border))               # no two borders are equal
    names = {1: text}                                       # names[b][i]: number of the b words at i

    def double(b: int, places: np.ndarray) -> np.ndarray:
        """Numbers of the 2b words at the given places; elsewhere one of their own."""
        half, beyond = names[b], places + b
        right = np.where(beyond < n, half[np.minimum(beyond, n - 1)], -1 - places)
        right = np.unique(right, return_inverse=True)[1].ravel()
        left = np.unique(half[places], return_inverse=True)[1].ravel()
        out = n + np.arange(n, dtype=np.int64)
        out[places] = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].ravel()
        return out

    def equal(b, x, y):
        ok = (x >= 0) & (y >= 0) & (x < n) & (y < n)
        return ok & (names[b][np.where(ok, x, 0)] == names[b][np.where(ok, y, 0)])

    found = []
    b = 1
    while b < FIRST:
        names[2 * b] = double(b, np.arange(n))
        b *= 2
    while True:
        lags = np.arange(1, 2 * b) if b == FIRST else np.arange(b, 2 * b)
        able = size >= max(MIN_WORDS, MIN_TIMES * int(lags[0]))
        if not able.any():
            break
        places = np.arange(n)[np.repeat(able, size + 1)]
        blocks = places[places % b == 0]
        step = max((1 << 22) // len(lags), 1)
        at, lag = [], []
        for part in np.array_split(blocks, -(-len(blocks) // step)) if len(blocks) else []:
            other = part[:, None] + lags[None, :]
            same = (names[b][part][:, None] == names[b][np.minimum(other, n - 1)]) & (other < n)
            x, y = np.nonzero(same)
            at.append(part[x])
            lag.append(lags[y])
        if at:
            at, lag = np.concatenate(at), np.concatenate(lag)
            order = np.lexsort((at, lag))
            at, lag = at[order], lag[order]
            new = np.concatenate([[True], (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + b)])[:len(at)]
            lo, q = at[new], lag[new]
            hi = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + b if len(at) else at
            for s in (x for x in sorted(names, reverse=True) if x <= b):    # fewer than b more words at either end
                more = equal(s, hi, hi + q)
                hi = hi + s * more
                more = equal(s, lo - s, lo - s + q)
                lo = lo - s * more
            length = hi - lo + q
            good = length >= np.maximum(MIN_WORDS, MIN_TIMES * q)
            found.append(np.stack([lo[good], length[good], q[good]], axis=1))
        able = size >= MIN_TIMES * 2 * b
        if not able.any():
            break
        names[2 * b] = double(b, np.arange(n)[np.repeat(able, size + 1)])
        b *= 2
    runs = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    smallest = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])[:len(runs)]
    runs = runs[smallest]
    runs[:, 0] = source[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _runs(batches):
    import pyarrow as pa

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def strength(r):
        return Fraction(r["length"], r["period"]), -r["start"], -r["period"]

    def rows(ids, texts):
        number: dict[bytes, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for t in texts for w in t], dtype=np.int64)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        found = scan_lags(flat, *split_segments(flat, starts, ends))
        owner = np.searchsorted(ends, found[:, 0], side="right")
        of = {}
        for d, (start, length, period) in zip(owner.tolist(), found.tolist()):
            of.setdefault(d, []).append({"start": start - int(starts[d]), "length": length, "period": period})
        kept = []
        for d, t in enumerate(texts):
            if d in of:
                edge = np.zeros(len(t) + 1, dtype=np.int64)
                for r in of[d]:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                t = [t[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            kept.append(b" ".join(t))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([of.get(d, []) for d in range(len(texts))], pa.list_(run)),
             pa.array([max(of[d], key=strength) if d in of else None for d in range(len(texts))], run),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    for batch in batches:
        texts, size, first = [], 0, 0
        for k, text in enumerate(batch.column(1)):
            texts.append(_WORD.findall(text.as_buffer()) if text.is_valid else [])
            size += len(texts[-1])
            if size >= GROUP_WORDS or k == len(batch.column(1)) - 1:
                yield rows([batch.column(0).slice(first, len(texts))], texts)
                texts, size, first = [], 0, k + 1


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period in word numbers, by
    start and period), strongest (the run with the greatest length / period, then the smallest
    start and period; null without runs) and collapsed (the words that no run contains after
    its first period, joined by one space)."""
    ship(__name__)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _runs, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, strongest {RUN}, collapsed string")
