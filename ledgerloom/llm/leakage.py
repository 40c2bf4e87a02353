"""Evaluation texts leaking into training text.

1. The n-grams of words that the test items have are counted over all documents.
2. In each window of ``min_run`` words of an item its rarest n-gram becomes a seed. Any run of min_run words that a document
   shares with the item holds that seed, so the seeds lose no such run, and common phrases are seeds nowhere. Edited copies
   may have no such run, nor a document the rarest n-gram of another; for them every n-gram of ``SEED`` words that a document
   has is a seed, and so are those of ``SHORT`` words where a document has a share of them (``SHORT_SHARE``) of one item.
3. Seeds found in documents mark passages, wide enough for every alignment of positive score through the seed; each is aligned
   with its item by Smith-Waterman on words, which scores copies that were paraphrased or edited, and the longest run of equal
   words is measured on the words themselves. Passages whose words cannot reach the score asked for are not aligned.

The items are the stated query set; they are taken in blocks of bounded size, and every block meets all documents in a map
over whole texts, once to count and once to align. Words are the maximal runs of Unicode letters and digits of the lower-cased text.

Defined cases: null and empty texts have no words; items of fewer than ``SEED`` words (``SHORT`` for edited copies) have no seed
and are found nowhere; rows without id are dropped; repeated rows of one id count once, with their best alignment.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import code_points, prefix, windows

SEED = 5
#: Short seeds of edited copies: their words, and the part of an item's n-grams of that length that a document must have, two
#: at least. A copy with one word in four changed keeps a quarter of them.
SHORT, SHORT_SHARE = 3, 1 / 8
#: Characters of test items that one pass over the documents takes.
BLOCK_CHARS = 4_000_000
SLICE = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


@lru_cache
def _word_table() -> np.ndarray:
    t = np.zeros(sys.maxunicode + 2, bool)
    t[1:] = [unicodedata.category(chr(i))[0] in "LN" for i in range(sys.maxunicode + 1)]
    return t


class Words:
    """The words of several texts, as spans of one joined lower-case text, with their hashes and their n-grams' hashes."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").lower() for t in texts]
        self.text = "\n".join(parts)
        points = code_points([self.text])
        word = np.r_[False, _word_table()[points.astype(np.int64)], False]
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        length = np.array([len(p) + 1 for p in parts])
        self.doc = np.searchsorted(np.cumsum(length), self.start, side="right")
        self.hash = windows(prefix(points), self.start, self.end - self.start) if len(self.start) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.doc, np.arange(len(parts) + 1))

    def grams(self, n: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the n-grams inside one text; those of other lengths than SEED hash apart."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        h = windows(prefix(self.hash), at, n)
        return at, h if n == SEED else h * np.uint64(2 * n + 1)

    def words(self, lo: int, hi: int) -> list[str]:
        return [self.text[s:e] for s, e in zip(self.start[lo:hi], self.end[lo:hi])]


class Member:
    """Membership of hashes in a set, by a table over 20 bits first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are members, and each one's number among the sorted members."""
        at = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], k[hit]


def _slices(batches):
    """(ids, Words) of bounded numbers of characters; a text is never cut."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        lo = n = 0
        for i, t in enumerate(texts):
            n += len(t or "")
            if n >= SLICE or i == len(texts) - 1:
                yield ids[lo : i + 1], Words(texts[lo : i + 1])
                lo, n = i + 1, 0


def _counting(keys: np.ndarray, lengths: list[int]):
    def run(batches):
        member, total = Member(keys), defaultdict(int)
        for _, w in _slices(batches):
            for length in lengths:
                _, h = w.grams(length)
                found, n = np.unique(h[member.find(h)[0]], return_counts=True)
                for k, c in zip(found.tolist(), n.tolist()):
                    total[k] += c
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.uint64).view(np.int64)), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    return run


def smith_waterman(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment, the span being of doc. Row by row over the item; gaps in the doc come as
    a running maximum, so each row is a few vector operations."""
    n = len(doc)
    best, span = 0, (0, 0)
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1) * -GAP
    for w in item:
        diag = score[:-1] + np.where(doc == w, MATCH, MISMATCH)
        up = score[1:] + GAP
        now, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        now[1:] = np.maximum(np.maximum(diag, up), 0)
        origin[1:] = np.where(now[1:] == 0, np.arange(1, n + 1), np.where(diag >= up, begin[:-1], begin[1:]))
        lifted = now + ramp
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, np.arange(n + 1), 0))
        score, begin = run - ramp, origin[source]
        k = int(score.argmax())
        if score[k] > best:
            best, span = int(score[k]), (int(begin[k]), k)
    return best, *span


def _passages(found: list[tuple[int, int, int]], n: int, first: int, last: int) -> list[tuple[int, int]]:
    """Spans of the document's words [first, last) that hold every alignment with an item of n words through a seed (i, j, words).

    Before the seed at most j words match, so an alignment that scores there has fewer than 2 j gaps; the same holds after it.
    """
    out: list[tuple[int, int]] = []
    reach = 1 + MATCH // -GAP
    for lo, hi in sorted((max(first, i - reach * j), min(last, i + k + reach * (n - j - k))) for i, j, k in found):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _ceiling(item: np.ndarray, doc: np.ndarray) -> int:
    """No alignment scores more: the best stretch of doc if each word that the item has matched, and all others were gaps."""
    total = np.r_[0, np.cumsum(np.where(np.isin(doc, item), MATCH, GAP))]
    return int((total - np.minimum.accumulate(total)).max())


FOUND = "item_id bigint, score int, n_words int, longest_run int, start_word int, end_word int"


class Seeds:
    """Seeds by hash, each with its places (item, word) in the items."""

    def __init__(self, seeds: dict[int, set[tuple[int, int]]]):
        keys = np.sort(np.fromiter(seeds, np.uint64, len(seeds)))
        flat = [sorted(seeds[k]) for k in keys.tolist()]
        self.member = Member(keys)
        self.start = np.cumsum([0, *map(len, flat)])
        places = np.array([x for xs in flat for x in xs], np.int64).reshape(-1, 2)
        self.item, self.word = places[:, 0], places[:, 1]

    def hits(self, w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, document's word, item's word) of all seeds found."""
        at, h = w.grams(length)
        found, k = self.member.find(h)
        n = self.start[k + 1] - self.start[k]
        flat = np.repeat(self.start[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        i = np.repeat(at[found], n)
        return w.doc[i], self.item[flat], i, self.word[flat]


def _candidates(w: Words, seeds: dict[int, Seeds], wanted: np.ndarray):
    """(document, item, [(document's word, item's word, words)]) of the pairs to align; wanted: distinct short seeds by item."""
    parts = []
    for length, known in seeds.items():
        doc, item, i, j = known.hits(w, length)
        pair = doc * len(wanted) + item
        if length != SEED and len(pair):
            place = np.unique(np.stack([pair, j]), axis=1)
            own, n = np.unique(place[0], return_counts=True)
            keep = np.isin(pair, own[n >= wanted[own % len(wanted)]])
            pair, i, j = pair[keep], i[keep], j[keep]
        parts.append((pair, i, j, np.full(len(pair), length)))
    pair, i, j, length = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((j, i, pair))
    pair, places = pair[order], np.stack([i, j, length], axis=1)[order]
    edges = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True]) if len(pair) else []
    for s, e in zip(edges, edges[1:]):
        yield int(pair[s]) // len(wanted), int(pair[s]) % len(wanted), places[s:e].tolist()


def _aligning(by_length: dict[int, dict[int, set[tuple[int, int]]]], items: list[tuple[int, list[str], np.ndarray]], id_type: pa.DataType, min_run: int, edited: bool):
    def run(batches):
        seeds = {n: Seeds(x) for n, x in by_length.items()}
        wanted_short = np.array([max(2, int((len(words) - SHORT + 1) * SHORT_SHARE)) for _, words, _ in items])
        for ids, w in _slices(batches):
            rows = []
            for d, item, found in _candidates(w, seeds, wanted_short):
                if ids[d] is None:
                    continue
                item_id, words, hashes = items[item]
                first, last = int(w.first[d]), int(w.first[d + 1])
                longest, best = 0, (0, 0, 0)
                done: dict[int, int] = {}
                for i, j, _ in found:
                    if done.get(i - j, -1) < i:  # longest run of equal words on this diagonal
                        lo, hi = i, i
                        while lo > first and j - (i - lo) > 0 and w.text[w.start[lo - 1] : w.end[lo - 1]] == words[j - (i - lo) - 1]:
                            lo -= 1
                        while hi < last and j + hi - i < len(words) and w.text[w.start[hi] : w.end[hi]] == words[j + hi - i]:
                            hi += 1
                        done[i - j] = hi
                        longest = max(longest, hi - lo)
                wanted = len(words) if edited and longest < min_run else 0
                for lo, hi in _passages(found, len(words), first, last):
                    if _ceiling(hashes, w.hash[lo:hi]) >= max(wanted, best[0]):
                        score, s, e = smith_waterman(hashes, w.hash[lo:hi])
                        best = max(best, (score, lo + s - first, lo + e - first))
                if best[0] < wanted:
                    continue
                rows.append((ids[d], item_id, best[0], len(words), longest, best[1], best[2]))
            if rows:
                kinds = (id_type, pa.int64(), *[pa.int32()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "item_id", "score", "n_words", "longest_run", "start_word", "end_word"])

    return run


def _seeds_of(own: dict[int, int], rarity: dict[int, int], min_run: int, edited: bool) -> set[int]:
    """Places of an item's n-grams (by place: their hash) that are seeds, all of which some document has."""
    if not edited:
        per_window = max(1, min(min_run, len(own) + SEED - 1) - SEED + 1)
        own_rarest = {min(range(s, s + per_window), key=lambda x: (rarity.get(own[x], 0), own[x])) for s in range(len(own) - per_window + 1)}
        return {j for j in own_rarest if own[j] in rarity}
    return {j for j in own if own[j] in rarity}


def leaked(docs: DataFrame, items: DataFrame, min_run: int = 12, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", edited: bool = False) -> DataFrame:
    """(id, item_id, score, n_words, longest_run, start_word, end_word): one row per document and item that share a seed.

    score is the Smith-Waterman score of the best passage (2 a word, -1 a mismatch or gap), which spans words
    [start_word, end_word) of the document; n_words are the item's words. Every pair with min_run equal consecutive words is there.
    With ``edited`` there is also every pair that shares ``SEED`` consecutive words, or enough n-grams of ``SHORT`` words, and
    whose score reaches n_words, half of the item's best score, and no other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")
    kind = rows.dtypes[0][1]
    queries = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    chars = queries.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    out = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        w = Words([r["text"] for r in block])
        lengths = [SEED, SHORT] if edited else [SEED]
        grams = {n: w.grams(n) for n in lengths}
        # bounded by the block: at most one row per n-gram of its items
        counting = _counting(np.unique(np.concatenate([h for _, h in grams.values()])), lengths)
        counted = rows.mapInArrow(counting, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        rarity = {r["gram"] & (1 << 64) - 1: r["n"] for r in counted}
        seeds: dict[int, dict[int, set[tuple[int, int]]]] = {n: defaultdict(set) for n in lengths}
        for n, (at, h) in grams.items():
            by_item: dict[int, dict[int, int]] = defaultdict(dict)
            for i, k in zip(at.tolist(), h.tolist()):
                d = int(w.doc[i])
                by_item[d][i - int(w.first[d])] = k
            for d, own in by_item.items():
                for j in _seeds_of(own, rarity, min_run, edited):
                    seeds[n][own[j]].add((d, j))
        known = [(r["item_id"], w.words(int(w.first[d]), int(w.first[d + 1])), w.hash[w.first[d] : w.first[d + 1]]) for d, r in enumerate(block)]
        part = rows.mapInArrow(_aligning(seeds, known, pa.int64() if kind == "bigint" else pa.string(), min_run, edited), f"id {kind}, {FOUND}")
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("score", "n_words", F.col("start_word"), "end_word"))
    return out.groupBy("id", "item_id").agg(best.alias("x"), F.max("longest_run").alias("longest_run")).select("id", "item_id", "x.score", "x.n_words", "longest_run", "x.start_word", "x.end_word")
