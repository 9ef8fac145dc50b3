"""Byte-pair encoding and decoding with a public vocabulary file.

Encoder: the vocabulary's tokens are found in a word by one Aho-Corasick scan that
leaves the longest token starting at each place. Going left to right, the longest
token is taken if it may stand after the token before it; else the next shorter
prefix token is tried, and if none fits the last token is given back (places that
led nowhere are remembered, so the work stays linear). Two tokens may stand side
by side if merging their text in rank order would leave exactly these two; that is
decided once for each pair from the merge table and kept in a compatibility table.
The result is that of applying all merges in rank order. Tokens whose own text is
not merged into them are left out of the automaton.

Decoder: one buffer holds the text of all tokens, an offset table where each begins;
a batch of ids is decoded by one gather.

The merge tables (size: the vocabulary) are read on the driver from the path given
and broadcast. Words seen before are looked up, in a table that is emptied when it
holds CACHE_BYTES; words over LONGEST_KNOWN characters are not kept. That affects
time only, and a worker's memory doesn't grow with long distinct words.

Defined cases: a null text counts as empty, and an empty one has no ids and decodes
to an empty text; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import json
from array import array
from sys import getsizeof

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import ship
from riskframe.llm.hashing import text_buffer

CACHE_BYTES = 128 << 20     # of each of the two tables of known pieces
LONGEST_KNOWN = 64          # characters; longer pieces are encoded anew each time
_ENTRY = 104                # bytes of a dict entry beside its key and value
GROUP_BYTES = 1 << 21               # text handled at a time in a task
END = "</w>"                        # marks a symbol that ends a word in the file
_SHIFT = 0x1000                     # such a symbol is moved to a character of its own

# Fixed values of the vocabulary file's format: the characters that stand for bytes,
# and the white space of its normaliser.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPACES = "[\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def word_bpe_file() -> str:
    """The public vocabulary used by default."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte."""
    out = {b: chr(b) for b in _PLAIN}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


def load_tables(path: str) -> dict:
    """Plain tables from a tokenizer file: token symbols, splits, pairs, the automaton."""
    import ahocorasick

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")

    symbols: dict[str, str] = {}            # token as in the file -> one character a symbol
    for token in vocab:
        if len(token) == 1:
            symbols[token] = token
        elif len(token) == 1 + len(END) and token.endswith(END):
            symbols[token] = chr(ord(token[0]) + _SHIFT)
    order = {s: k for k, s in enumerate(symbols.values())}
    base = len(order)
    ids = [vocab[t] for t in symbols]
    left, right, pair, text = list(range(base)), list(range(base)), {}, list(symbols.values())
    for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges):
        s = symbols[a] + symbols[b]
        symbols[a + b] = s
        order[s] = k = len(text)
        text.append(s)
        ids.append(vocab[a + b])
        x, y = order[symbols[a]], order[symbols[b]]
        left.append(x)
        right.append(y)
        pair[x << 20 | y] = k
    names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    spoken = [names.get(i, "") for i in range(max(names) + 1)]
    prefix = []
    for s in text:
        n = len(s) - 1
        while n and s[:n] not in order:
            n -= 1
        prefix.append(order[s[:n]] if n else -1)
    tables = {
        "pattern": pattern, "base": base, "ids": ids, "left": left, "right": right, "pair": pair,
        "length": [len(s) for s in text], "prefix": prefix,
        "special": {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]},
        "spoken": spoken, "fits": {}, "words": {}, "chunks": {}, "used": {"words": 0, "chunks": 0},
    }
    whole = [_reached(s, k, tables) for k, s in enumerate(text)]
    automaton = ahocorasick.Automaton()
    for k, s in enumerate(text):
        if whole[k]:
            automaton.add_word(s, k)
    automaton.make_automaton()
    tables["automaton"] = automaton
    for k in range(len(prefix)):            # skip tokens that never come about
        while prefix[k] >= 0 and not whole[prefix[k]]:
            prefix[k] = prefix[prefix[k]]
    return tables


def _reached(s: str, k: int, t: dict) -> bool:
    """Whether the text of token k, merged in rank order, becomes k: its two parts must
    come about on their own and be left side by side until their merge's turn."""
    base = t["base"]
    if k < base:
        return True
    reached = t.setdefault("reached", {})
    a, b = t["left"][k], t["right"][k]
    ok = (a < base or reached[a]) and (b < base or reached[b]) and _fits(a, b, t, k)
    reached[k] = ok
    return ok


def _fits(x: int, y: int, t: dict, below: int | None = None) -> bool:
    """Whether no merge across the border of x and y comes before those that make them
    (with ``below``: none before the merge of that rank)."""
    left, right, pair, base = t["left"], t["right"], t["pair"], t["base"]
    limit = len(left) if below is None else below
    while True:
        k = pair.get(x << 20 | y)
        if k is not None and k < limit:
            return False
        # undo the later of the two merges; its rank bounds what may still cross
        if x >= base and (x > y or y < base):
            limit, x = min(limit, x), right[x]
        elif y >= base:
            limit, y = min(limit, y + 1), left[y]
        else:
            return True


def encode_word(word: str, t: dict) -> list[int]:
    """Token orders of a word given as symbols."""
    n, length, prefix, fits = len(word), t["length"], t["prefix"], t["fits"]
    longest = [0] * n
    for end, k in t["automaton"].iter(word):
        at = end + 1 - length[k]
        longest[at] = k                 # longer matches of a place end later
    out: list[int] = []
    dead: set[int] = set()
    at = 0
    token = longest[0]
    while True:
        end = at + length[token]
        ok = end not in dead
        if ok and out:
            key = out[-1] << 20 | token
            ok = fits.get(key)
            if ok is None:
                if len(fits) > 2_000_000:
                    fits.clear()
                ok = fits[key] = _fits(out[-1], token, t)
        if ok:
            out.append(token)
            at = end
            if at == n:
                return out
            token = longest[at]
        elif prefix[token] >= 0:
            token = prefix[token]
        else:
            dead.add(at)
            token = out.pop()
            at -= length[token]


def _remember(t: dict, table: str, piece: str, ids: bytes) -> None:
    """Keep a short piece's ids; a table whose entries reach CACHE_BYTES starts again empty."""
    if len(piece) > LONGEST_KNOWN:
        return
    size = getsizeof(piece) + getsizeof(ids) + _ENTRY
    if t["used"][table] + size > CACHE_BYTES:
        t[table].clear()
        t["used"][table] = 0
    t[table][piece] = ids
    t["used"][table] += size


def encode_chunk(chunk: str, t: dict) -> bytes:
    """Ids (packed 32-bit) of a piece of text without white space."""
    import unicodedata

    import regex

    split = t.get("split")
    if split is None:
        split = t["split"] = regex.compile(t["pattern"])
        t["bytes"] = {b: c for b, c in byte_characters().items()}
    if chunk.isascii():
        text = chunk.lower()
    else:
        text = unicodedata.normalize("NFC", chunk)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    words, ids = t["words"], t["ids"]
    parts = []
    for word in split.findall(text):
        got = words.get(word)
        if got is None:
            s = word.encode().decode("latin-1").translate(t["bytes"])
            s = s[:-1] + chr(ord(s[-1]) + _SHIFT)
            got = array("i", [ids[k] for k in encode_word(s, t)]).tobytes()
            _remember(t, "words", word, got)
        parts.append(got)
    return b"".join(parts)


def encode_text(text: str, t: dict) -> bytes:
    """Ids (packed 32-bit) of a whole text; special tokens' strings count as these tokens."""
    import regex

    if any(s in text for s in t["special"]):
        names = sorted(t["special"], key=len, reverse=True)
        parts = []
        for piece in regex.split("(" + "|".join(map(regex.escape, names)) + ")", text):
            if piece in t["special"]:
                parts.append(np.array([t["special"][piece]], dtype=np.int32).tobytes())
            else:
                parts.append(encode_text(piece, t))
        return b"".join(parts)
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):       # split() takes these for white space
        chunks = [c for c in regex.split(_SPACES, text) if c]
    else:
        chunks = text.split()
    known = t["chunks"]
    parts = []
    for c in chunks:
        got = known.get(c)
        if got is None:
            got = encode_chunk(c, t)
            _remember(t, "chunks", c, got)
        parts.append(got)
    return b"".join(parts)


def decode_flat(ids: np.ndarray, counts: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of consecutive lists of ids: tokens joined by one space."""
    if "offsets" not in t:
        spoken = [s.encode() + b" " for s in t["spoken"]]
        t["offsets"] = np.concatenate([[0], np.cumsum([len(s) for s in spoken])]).astype(np.int64)
        t["buffer"] = np.frombuffer(b"".join(spoken), dtype=np.uint8)
    offsets = t["offsets"]
    size = (offsets[ids + 1] - offsets[ids]).astype(np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    size[last] -= 1                                     # no space after a text's last token
    ends = np.cumsum(size)
    out = t["buffer"][np.arange(int(size.sum())) + np.repeat(offsets[ids] - (ends - size), size)]
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return out, at


def _groups(offsets: np.ndarray):
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _encoder(tables, with_text: bool):
    def run(batches):
        import pyarrow as pa

        t = tables.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            _, offsets = text_buffer(texts)
            for i, j in _groups(offsets):
                packed = [encode_text(x or "", t) for x in texts.slice(i, j - i).to_pylist()]
                counts = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                flat = np.frombuffer(b"".join(packed), dtype=np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
                columns = [ids.slice(i, j - i), lists]
                if with_text:
                    columns.append(_strings(*decode_flat(flat, counts, t)))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][:len(columns)])
    return run


def _strings(data: np.ndarray, offsets: np.ndarray):
    import pyarrow as pa

    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _decoder(tables):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            counts = np.array(lists.value_lengths().fill_null(0), dtype=np.int64)
            flat = np.array(lists.flatten(), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _strings(*decode_flat(flat, counts, tables.value))], names=["id", "decoded"])
    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           with_text: bool = False) -> DataFrame:
    """id, ids (array of token ids of the whole text) and, if asked for, ``decoded``:
    the ids decoded again, special tokens included."""
    ship(__name__)
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(load_tables(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id bigint, ids array<int>" + ", decoded string" * with_text
    return rows.mapInArrow(_encoder(tables, with_text), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded: the tokens of ``ids`` joined by one space (null or no ids: empty)."""
    ship(__name__)
    tables = encoded.sparkSession.sparkContext.broadcast(load_tables(tokenizer))
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoder(tables), "id bigint, decoded string").withColumnRenamed("id", id_col)
