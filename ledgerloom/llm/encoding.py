"""Encoding of a corpus with a public byte-level BPE tokenizer, by monoid tree reduction.

A text is halved until its parts are short; each leaf is encoded; neighbours are joined by encoding a window around their seam
again. The window grows fourfold on either side until its ends are stable and are ends of tokens in both halves, so that the
tokens outside provably stay. A stable position is one where the tokenizer's pattern splits whatever surrounds it, and merges
never cross a split: no piece goes on into white space (so white space after anything else is a split), a letter run ends at a
digit, and so on for other changes of class between ASCII characters, but for what may be a contraction. A stretch without
stable position cannot be divided: it is a leaf, however long. Decoding concatenates the bytes up the same tree.

Defined cases: empty and null texts give an empty list; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import ast
import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf; longer texts are halved.
LEAF = 4_096
#: First window on either side of a seam, in characters; it grows fourfold.
SEAM = 16

#: Positions where the pattern splits in any context, after what is matched before them.
_STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])")


def pattern_of(folder: str) -> str:
    """The splitting pattern that the tokenizers' folder publishes as PATTERN, read as a literal; nothing there is run."""
    with open(f"{folder}/__init__.py", encoding="utf-8") as f:
        for node in ast.parse(f.read()).body:
            if isinstance(node, ast.Assign) and getattr(node.targets[0], "id", None) == "PATTERN":
                return ast.literal_eval(node.value)
    raise ValueError(f"no PATTERN in {folder}")


@lru_cache
def tokenizer(name: str, folder: str):
    """The tiktoken encoding of ranks file ``folder/name.tiktoken``, with the pattern published beside it."""
    import tiktoken

    pattern = pattern_of(folder)
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def leaf_ids(enc, text: str) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32) if hasattr(enc._core_bpe, "encode_to_tiktoken_buffer") else np.array(enc.encode_ordinary(text), np.uint32)


def _last_stable(text: str, at: int, least: int) -> int:
    """The last stable position in (least, at], else least."""
    span = SEAM
    while at > least:
        lo = max(least + 1, at - span)
        found = -1
        for m in _STABLE.finditer(text, lo, min(at + 1, len(text))):
            if m.start() <= at:
                found = m.start()
        if found >= 0:
            return found
        at, span = lo - 1, span * 4
    return least


def _next_stable(text: str, at: int, most: int) -> int:
    """The first stable position in [at, most), else most."""
    m = _STABLE.search(text, at, most)
    return m.start() if m else most


@lru_cache
def token_sizes(enc) -> np.ndarray:
    """Bytes of each token."""
    sizes = np.zeros(enc.n_vocab, np.int64)
    for i in enc._mergeable_ranks.values():
        sizes[i] = len(enc.decode_single_token_bytes(i))
    return sizes


def _tokens_of(sizes: np.ndarray, n_bytes: int) -> int:
    """How many of the first tokens hold exactly n_bytes bytes, -1 if that lies inside a token."""
    if not n_bytes:
        return 0
    total = np.cumsum(sizes)
    k = int(np.searchsorted(total, n_bytes))
    return k + 1 if total[k] == n_bytes else -1


def encode(enc, text: str, leaf: int | None = None) -> np.ndarray:
    """Ids of the whole text."""
    leaf = leaf or LEAF
    sizes = token_sizes(enc)
    n_bytes = lambda lo, hi: len(text[lo:hi].encode("utf-8"))

    def join(lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        span = SEAM
        while True:
            a, b = _last_stable(text, max(mid - span, lo), lo), _next_stable(text, min(mid + span, hi), hi)
            n_left, n_right = n_bytes(a, mid), n_bytes(mid, b)
            drop, skip = _tokens_of(sizes[left[::-1][:n_left]], n_left), _tokens_of(sizes[right[:n_right]], n_right)
            if drop >= 0 and skip >= 0:
                return np.concatenate([left[: len(left) - drop], leaf_ids(enc, text[a:b]), right[skip:]])
            span *= 4

    def part(lo: int, hi: int) -> np.ndarray:
        if hi - lo <= leaf or _next_stable(text, lo + 1, hi) == hi:
            return leaf_ids(enc, text[lo:hi])
        mid = (lo + hi) // 2
        return join(lo, mid, hi, part(lo, mid), part(mid, hi))

    return part(0, len(text))


def decode(enc, ids: list[int]) -> bytes:
    """Bytes of the ids, concatenated up a tree."""
    if len(ids) <= 4096:
        return enc.decode_bytes(ids)
    mid = len(ids) // 2
    return decode(enc, ids[:mid]) + decode(enc, ids[mid:])


def _encoding(name: str, folder: str):
    def run(batches):
        enc = tokenizer(name, folder)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                ids = [encode(enc, t) if t else np.zeros(0, np.uint32) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "ids"])

    return run


def encode_corpus(docs: DataFrame, folder: str, name: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): one row per row of docs. A map without shuffle; whole texts, whatever their length."""
    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_encoding(name, folder), f"id {kind}, ids array<int>")


def _decoding(name: str, folder: str):
    def run(batches):
        enc = tokenizer(name, folder)
        for b in batches:
            texts = [decode(enc, x or []).decode("utf-8") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode_corpus(encoded: DataFrame, folder: str, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, text) of what encode_corpus gives; null texts come back empty."""
    return encoded.select("id", "ids").mapInArrow(_decoding(name, folder), f"id {encoded.select('id').dtypes[0][1]}, text string")
