"""Benchmark decontamination: benchmark phrases searched in an FM-index per training shard.

1. The benchmark's texts become phrases: each run of WINDOW words, or the whole text where
   it has fewer. Equal phrases collapse; each keeps the list of its items. Phrases are dealt
   to blocks of at most BLOCK, which are read and broadcast one by one, and a word table of
   fixed size (2 ** TABLE_BITS flags) says which words can stand in a phrase at all.
2. A task reads its documents once and gathers them to shards of SHARD_WORDS indexed words.
   The alphabet of a shard's index is the words with a flag; all others are separators, and a
   stretch between separators with fewer words than the shortest phrase holds no occurrence
   and is left out. A flag set by chance only adds a word to the index.
3. The index: suffixes in full order (prefix doubling that sorts open groups only), the
   Burrows-Wheeler transform as a wavelet matrix, and sampled suffix positions (each stretch's
   first word and every RATE-th). All phrases of a block are searched backward in step; each
   place of their intervals is walked back to the next sampled one.
4. The occurrences' words are merged to spans per document, and the items are listed.

Documents never leave their task and nothing is shuffled. A passage that a third of the
documents share costs its occurrences, wherever they are.

Words are maximal runs of characters outside the class of the ASCII characters that are
neither digits nor letters, A-Z lower-cased. They are compared by 64-bit hashes. Defined
cases: a null or empty text has no words, neither as a document nor as an item; items that
share an id are one item with the phrases of all; a phrase of an item without an id marks words, but is not listed; repeated rows
and rows with a null id are judged each for itself; an empty benchmark marks nothing; an
empty table gives an empty result; only the id and the text are read, from either table.
Very long texts: a document is held whole in its task and may exceed SHARD_WORDS alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import fm_index
from riskframe.llm.common import materialize, ship, ship_by_value
from riskframe.llm.fm_index import BitVector, WaveletMatrix
from riskframe.llm.hashing import doc_words, text_buffer

WINDOW = 10
SHARD_WORDS = 1 << 20
SHARD_DOCS = 100_000
RATE = 8                    # every RATE-th suffix position of a stretch is kept
BLOCK = 200_000             # phrases broadcast at a time
PIECE = 1000                # windows of an item that stay together
TABLE_BITS = 22
OCCURRENCES = 1 << 20       # located at a time

# byte -> byte: A-Z lower-cased, other ASCII characters but digits and a-z to a space
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32


def _suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order. No two suffixes may be equal up to their end."""
    n = len(symbols)

    def joined(ranks, at, step, count, bits):
        key = np.zeros(len(at), dtype=np.int64)
        for k in range(count):
            place = at + k * step
            inside = place < n
            key = (key << bits) | np.where(inside, ranks[np.where(inside, place, 0)] + 1, 0)
        return key

    def regroup(slots, key):
        """Places in order within their slots, ranks and open slots brought up to date."""
        by_key = np.argsort(key, kind="stable")
        order[slots] = order[slots][by_key]
        key = key[by_key]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        rank[order[slots]] = slots[np.flatnonzero(new)][group]
        return slots[np.bincount(group)[group] > 1]

    order, rank = np.arange(n), symbols.astype(np.int64)
    bits = int(rank.max(initial=0) + 1).bit_length()
    reach = 63 // bits
    slots = regroup(np.arange(n), joined(rank.copy(), order, 1, reach, bits))
    bits = n.bit_length()
    while len(slots):
        slots = regroup(slots, joined(rank, order[slots], reach, 63 // bits, bits))
        reach *= 63 // bits
    return order


class ShardIndex:
    """An FM-index over stretches of words, with sampled suffix positions."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, rate: int = RATE):
        """words: hashes of all stretches, one after the other; a place is a word's index in
        the text in which each stretch is followed by a separator."""
        stretches = len(lengths)
        self.first = np.cumsum(lengths) - lengths + np.arange(stretches)
        self.alphabet, symbol = np.unique(words, return_inverse=True)
        n = len(words) + stretches
        text = np.zeros(n, dtype=np.int64)                          # 0: a separator
        text[np.arange(len(words)) + np.repeat(np.arange(stretches), lengths)] = symbol.ravel() + 1
        distinct = text + stretches - 1                             # separators differ by place
        distinct[self.first + lengths] = np.arange(stretches)
        order = _suffix_order(distinct)
        sigma = len(self.alphabet) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        since = np.arange(n) - np.repeat(self.first, lengths + 1)
        sampled = (since % rate == 0)[order]
        self.sampled = BitVector(sampled.astype(np.uint8))
        self.positions = order[sampled]
        self.size = n

    def search(self, phrases: np.ndarray):
        """phrases: one row of word hashes each. The rows that occur, and their intervals."""
        at = np.minimum(np.searchsorted(self.alphabet, phrases), len(self.alphabet) - 1)
        found = np.flatnonzero((self.alphabet[at] == phrases).all(axis=1))
        symbols = at[found] + 1
        lo = np.zeros(len(found), dtype=np.int64)
        hi = np.full(len(found), self.size, dtype=np.int64)
        for t in range(phrases.shape[1] - 1, -1, -1):
            c = symbols[:, t]
            lo, hi = (self.less[c] + self.bwt.rank(c, x) for x in (lo, hi))
            live = lo < hi
            found, symbols, lo, hi = found[live], symbols[live], lo[live], hi[live]
        return found, lo, hi

    def _back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer: symbol and rank by one walk down the matrix."""
        at, symbol = rows, np.zeros(len(rows), dtype=np.int64)
        for level, zeros in zip(self.bwt.levels, self.bwt.zeros):
            bit = (level.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = level.rank(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            symbol = (symbol << 1) | bit.astype(np.int64)
        return self.less[symbol] + at - self.bwt.start[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row's suffix."""
        out, steps = np.zeros(len(rows), dtype=np.int64), 0
        open_ = np.arange(len(rows))
        while len(rows):
            bit = (self.sampled.words[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
            here = bit == 1
            out[open_[here]] = self.positions[self.sampled.rank(rows[here])] + steps
            open_, rows, steps = open_[~here], self._back(rows[~here]), steps + 1
        return out

    def occurrences(self, phrases: np.ndarray):
        """Yields (phrase, place) arrays; about OCCURRENCES of them at a time."""
        found, lo, hi = self.search(phrases)
        upto = np.cumsum(hi - lo)
        cuts = np.flatnonzero(np.diff(upto // OCCURRENCES, prepend=0)) if len(upto) else []
        for some in np.split(np.arange(len(found)), cuts):
            if len(some):
                n = hi[some] - lo[some]
                rows = np.arange(int(n.sum())) + np.repeat(lo[some] - np.cumsum(n) + n, n)
                yield np.repeat(found[some], n), self.locate(rows)


# ---- the benchmark's phrases

def _pieces(batches):
    """Items cut into pieces of at most PIECE windows, as packed word hashes."""
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0).to_pylist()
        buf, offsets = text_buffer(batch.column(1))
        rows = []
        for first, h, counts in doc_words(_FOLD[buf], offsets, lower=False):
            ends = np.cumsum(counts)
            for d in np.flatnonzero(counts):
                words = h[ends[d] - counts[d]:ends[d]]
                for a in range(0, max(len(words) - WINDOW + 1, 1), PIECE):
                    part = words[a:a + PIECE + WINDOW - 1]
                    rows.append((ids[first + d], a, max(len(part) - WINDOW + 1, 1), part.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))],
            names=["item", "at", "windows", "words"])


def _phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int):
    """Yields the phrases of a block: {length: (phrases, offsets into the items, items)}, item ids."""
    pieces = materialize(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
                         .mapInArrow(_pieces, "item string, at bigint, windows bigint, words binary").distinct(), "phrases")
    total = int(pieces.agg(F.sum("windows")).first()[0] or 0)
    number, largest = max(-(-total // block), 1), total
    while largest > max(block, PIECE):              # pieces are small, so a few more blocks settle it
        number *= 2
        part = F.pmod(F.xxhash64("item", "at", "words"), F.lit(number))
        largest = int(pieces.groupBy(part.alias("part")).agg(F.sum("windows").alias("n")).agg(F.max("n")).first()[0])
    for k in range(number):
        some = pieces if number == 1 else pieces.filter(F.pmod(F.xxhash64("item", "at", "words"), F.lit(number)) == k)
        rows = some.select("item", "words").collect()
        if rows:
            yield _phrases([(r["item"], np.frombuffer(r["words"], np.uint64)) for r in rows])


def _phrases(pieces: list[tuple[str | None, np.ndarray]]):
    ids = sorted({i for i, _ in pieces if i is not None})
    number = {i: k for k, i in enumerate(ids)} | {None: -1}
    by_length: dict[int, tuple[list, list]] = {}
    for item, words in pieces:
        size = min(WINDOW, len(words))
        rows = np.lib.stride_tricks.sliding_window_view(words, size)
        texts, items = by_length.setdefault(size, ([], []))
        texts.append(rows)
        items.append(np.full(len(rows), number[item], dtype=np.int64))
    out = {}
    for size, (texts, items) in by_length.items():
        phrases, which = np.unique(np.concatenate(texts), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(items)]), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        out[size] = (phrases, np.searchsorted(pairs[0], np.arange(len(phrases) + 1)), pairs[1])
    return out, ids


# ---- the training shards

class _Shard:
    """Documents gathered by a task until there are enough words for an index."""

    def __init__(self, table: np.ndarray, shortest: int):
        self.table, self.shortest = table, shortest
        self.ids, self.counts, self.words, self.runs, self.docs, self.size = [], [], [], [], 0, 0

    def add(self, h: np.ndarray, counts: np.ndarray) -> None:
        if len(h):
            ends = np.cumsum(counts)
            inside = self.table[h >> np.uint64(64 - TABLE_BITS)]
            before = np.concatenate([[False], inside[:-1]])
            before[(ends - counts)[counts > 0]] = False
            after = np.concatenate([inside[1:], [False]])
            after[ends[counts > 0] - 1] = False
            start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            long = end - start >= self.shortest
            start, end = start[long], end[long]
            doc = np.searchsorted(ends, start, side="right")
            keep = np.zeros(len(h) + 1, dtype=np.int8)
            keep[start] = 1
            keep[end] -= 1
            self.words.append(h[np.cumsum(keep[:-1]) > 0])
            self.runs.append(np.stack([doc + self.docs, start - (ends - counts)[doc], end - start]))
            self.size += int((end - start).sum())
        self.counts.append(counts)
        self.docs += len(counts)

    def spans(self, blocks):
        """(spans, items) of the documents that have any: {document: ([start, end) pairs, item ids)}."""
        if not self.size:
            return {}
        doc, begin, lengths = np.concatenate(self.runs, axis=1)
        index = ShardIndex(np.concatenate(self.words), lengths)
        edge, items = np.zeros(index.size + 1, dtype=np.int64), {}
        for block in blocks:
            by_length, ids = block.value
            for size, (phrases, offsets, listed) in by_length.items():
                pairs = []
                for phrase, place in index.occurrences(phrases):
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + size, -1)
                    owner = doc[np.searchsorted(index.first, place, side="right") - 1]
                    pairs.append(np.unique(owner * len(phrases) + phrase))
                for key in np.unique(np.concatenate(pairs)) if pairs else ():
                    d, p = divmod(int(key), len(phrases))
                    items.setdefault(d, set()).update(listed[offsets[p]:offsets[p + 1]].tolist())
            for d, found in items.items():
                items[d] = {ids[k] if isinstance(k, int) else k for k in found}
        covered = np.cumsum(edge[:-1]) > 0
        start = np.flatnonzero(covered & ~np.concatenate([[False], covered[:-1]]))
        end = np.flatnonzero(covered & ~np.concatenate([covered[1:], [False]])) + 1
        run = np.searchsorted(index.first, start, side="right") - 1
        out = {}
        for d, a, b in zip(doc[run].tolist(), (begin[run] + start - index.first[run]).tolist(),
                           (begin[run] + end - index.first[run]).tolist()):
            out.setdefault(d, ([], sorted(items.get(d, ()))))[0].append((a, b))
        return out

    def rows(self, blocks):
        import pyarrow as pa

        found = self.spans(blocks)
        counts = np.concatenate(self.counts)
        spans = [[{"start": a, "end": b} for a, b in found[d][0]] if d in found else [] for d in range(self.docs)]
        items = [found[d][1] if d in found else [] for d in range(self.docs)]
        hit = [sum(s["end"] - s["start"] for s in x) for x in spans]
        ids = pa.chunked_array(self.ids).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64()), pa.array(hit, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "spans", "items"])


def contaminated_words(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurrence), spans (merged
    [start, end) word numbers) and items (sorted ids of the items with an occurring phrase)."""
    ship(__name__)
    ship_by_value(fm_index)
    sc = docs.sparkSession.sparkContext
    table, shortest, blocks = np.zeros(1 << TABLE_BITS, dtype=bool), WINDOW, []
    for phrases in _phrase_blocks(benchmark, item_col, item_text_col, block):
        for size, (rows, _, _) in phrases[0].items():
            table[rows.ravel() >> np.uint64(64 - TABLE_BITS)] = True
            shortest = min(shortest, size)
        blocks.append(sc.broadcast(phrases))
    flags = sc.broadcast(table)

    def search(batches):
        shard = _Shard(flags.value, shortest)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for first, h, counts in doc_words(_FOLD[buf], offsets, lower=False):
                shard.ids.append(batch.column(0).slice(first, len(counts)))
                shard.add(h, counts)
                if shard.size >= SHARD_WORDS or shard.docs >= SHARD_DOCS:
                    yield shard.rows(blocks)
                    shard = _Shard(flags.value, shortest)
        if shard.docs:
            yield shard.rows(blocks)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        search, f"doc_id {kind}, n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")
