"""Long exact spans shared between records, by difference-cover anchors.

A difference cover D of period v holds, for any two positions, an offset that brings both onto cover positions at once. So two
texts that share ``min_length`` characters share a window of w = min_length - v + 1 characters at a cover position of both:
hashing the windows at cover positions alone (a tenth of all) finds every such pair. As w >= v, two neighbouring aligned
anchors overlap; a chain of matching anchors on one diagonal that spans ``min_length`` proves the shared span, and only pairs
with shorter chains are extended on their texts.

Sizes: records with one text are one class, so copies cost nothing and pairs are between classes. Anchors travel as packed
binary columns of about 8 bytes an anchor. A window that more than ``HOT`` places have makes no pairs; its places go through
``_hot_pairs``, which hashes all windows of ``min_length`` around them and pairs records only where these agree, at the left
end of each shared span, so boilerplate shorter than ``min_length`` yields no pair however common it is. A window that is hot
within one batch of a map task is known to be so at once: one marked place stands for it in its bucket, and the others are
spread over all buckets, so that the task of a window which a third of all records have does not grow with them.

Defined cases: null texts, and texts shorter than ``min_length``, share nothing; lengths count code points; nothing is
normalised; records without id are dropped, repeated rows of one id and text are one record.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, parallelism
from .rolling import BASE, SECOND, code_points, prefix, windows

#: Places of one window up to which all their pairs are tried.
HOT = 32
#: Characters hashed at once, and anchors packed at once.
SLICE, PACK = 2_000_000, 1_500_000
#: Anchors that one bucket, and so one task, should hold.
BUCKET = 2_000_000
#: Ids up to which a set of needed classes is broadcast (16 bytes each); beyond, the texts are shuffled.
BROADCAST_IDS = 100_000


@lru_cache
def difference_cover(min_length: int) -> tuple[int, np.ndarray]:
    """(v, D): the largest perfect difference set of period v = q*q + q + 1, q prime, with 2 * v <= min_length.

    q is a multiplier of such a set, so some translate is a union of orbits of x -> q * x modulo v.
    """
    best = (1, [0])
    for q in (2, 3, 5, 7, 11, 13):
        v = q * q + q + 1
        if 2 * v > min_length:
            break
        orbits, seen = [], set()
        for x in range(v):
            if x not in seen:
                orbit = []
                while x not in seen:
                    seen.add(x)
                    orbit.append(x)
                    x = x * q % v
                orbits.append(orbit)

        def search(i: int, chosen: list[int]) -> list[int] | None:
            if len(chosen) == q + 1:  # noqa: B023
                return sorted(chosen) if len({(a - b) % v for a in chosen for b in chosen}) == v else None  # noqa: B023
            if i == len(orbits) or len(chosen) > q + 1:  # noqa: B023
                return None
            return search(i + 1, chosen + orbits[i]) or search(i + 1, chosen)  # noqa: B023

        if found := search(0, []):
            best = (v, found)
    return best[0], np.array(best[1])


def text_class(text: Column) -> Column:
    """16 bytes that stand for a text; records with one text share them."""
    return F.unhex(F.md5(F.encode(text, "utf-8")))


def _pieces(texts: list[str], v: int, width: int) -> list[tuple[int, int, str]]:
    """(text, offset, piece): long texts in pieces that start on multiples of v and overlap by a window."""
    step = max(1, SLICE // v) * v
    out = []
    for i, t in enumerate(texts):
        if len(t) <= step + width:
            out.append((i, 0, t))
        else:
            out += [(i, s, t[s : s + step + width - 1]) for s in range(0, len(t) - width + 1, step)]
    return out


def anchors(texts: list[str], v: int, cover: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the windows at cover positions, ordered by text and position."""
    docs, places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    group: list[tuple[int, int, str]] = []
    held = 0
    for piece in chain(_pieces(texts, v, width), [None]):
        if group and (piece is None or held + len(piece[2]) > SLICE):
            length = np.array([len(x[2]) for x in group])
            base = np.cumsum(length) - length
            p = prefix(code_points([x[2] for x in group]))
            n = length - width + 1
            periods = np.maximum(0, -(-n // v))
            own = np.repeat(np.arange(len(group)), periods)
            k = np.arange(len(own)) - np.repeat(np.cumsum(periods) - periods, periods)
            at = k[:, None] * v + cover[None, :]
            fits = at < n[own][:, None]
            own = np.broadcast_to(own[:, None], at.shape)[fits]
            at = at[fits]
            hashes.append(windows(p, at + base[own], width))
            docs.append(np.array([x[0] for x in group])[own])
            places.append(at + np.array([x[1] for x in group])[own])
            group, held = [], 0
        if piece is not None:
            group.append(piece)
            held += len(piece[2])
    return np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)


BLOB = "bucket int, blob binary"
#: In a place: its window is hot, and other places of it are elsewhere. In a blob's count: all its places are of hot windows.
MARK = 1 << 31


def _pack(classes: np.ndarray, doc: np.ndarray, pos: np.ndarray, h: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket of the hash: the classes with their counts, then the hash, position and extra planes."""
    b = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    b, doc, pos, h = b[order], doc[order], pos[order], h[order]
    starts = np.searchsorted(b, np.arange(buckets + 1))
    rows: tuple[list, list] = ([], [])
    for i in range(buckets):
        s, e = starts[i], starts[i + 1]
        if s == e:
            continue
        d = doc[s:e]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        count = np.diff(np.r_[first, e - s]).astype("<u4")
        x, p = h[s:e], pos[s:e]
        planes = [np.array([e - s, len(first)], "<u4"), classes[d[first]], count, x.astype("<u4"), (x >> np.uint64(32)).astype("u1"), p.astype("<u2"), (p >> 16).astype("<u2")]
        if extra is not None:
            planes.append(extra[order][s:e])
        rows[0].append(i)
        rows[1].append(b"".join(np.ascontiguousarray(a).tobytes() for a in planes))
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], ["bucket", "blob"])


def _pack_hot(classes: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places of hot windows as one marked row, in a bucket that does not depend on the windows."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    once = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
    doc, pos = doc[once], pos[once]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    planes = [np.array([len(doc) | MARK, len(first)], "<u4"), classes[doc[first]], np.diff(np.r_[first, len(doc)]).astype("<u4"), pos.astype("<u4")]
    blob = b"".join(np.ascontiguousarray(a).tobytes() for a in planes)
    bucket = int.from_bytes(hashlib.blake2b(blob[:4096], digest_size=8).digest(), "big") % buckets
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def _unpack_hot(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, and per place its class number and position."""
    n, m = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    n -= MARK
    at = 8 + 16 * m
    return np.frombuffer(blob, "V16", m, 8), np.repeat(np.arange(m), np.frombuffer(blob, "<u4", m, at)), np.frombuffer(blob, "<u4", n, at + 4 * m).astype(np.int64)


def _split_hot(doc: np.ndarray, pos: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places to send to their buckets, places to send anywhere) of one batch; the former marked where they stand for others."""
    order = np.lexsort((pos, doc, h))
    start, size = _groups(h[order])
    hot = size > HOT
    hot[hot] = doc[order[start[hot]]] != doc[order[start[hot] + size[hot] - 1]]
    if not hot.any():
        return pos, np.zeros(0, np.int64)
    stands, others = np.zeros(len(h), bool), np.zeros(len(h), bool)
    others[order[np.repeat(hot, size)]] = True
    stands[order[start[hot]]] = True
    pos = np.where(stands, pos | MARK, pos)
    pos[others & ~stands] = -1
    return pos, np.flatnonzero(others & ~stands)


def _unpack(blobs: list[tuple[int, bytes]], extra: np.dtype | None = None):
    """Classes (V16 each), and per anchor its class number, position and hash with the bucket above bit 40."""
    classes, owner, pos, h, more = [], [], [], [], []
    base = 0
    for bucket, blob in blobs:
        n, m = np.frombuffer(blob, "<u4", 2)
        n, m, at = int(n), int(m), 8

        def take(kind, k):
            nonlocal at
            a = np.frombuffer(blob, kind, k, at)  # noqa: B023
            at += a.nbytes
            return a

        classes.append(take("V16", m))
        owner.append(np.repeat(np.arange(m) + base, take("<u4", m)))
        base += m
        low, high = take("<u4", n).astype(np.uint64), take("u1", n).astype(np.uint64)
        h.append(low | high << np.uint64(32) | np.uint64(bucket) << np.uint64(40))
        pos.append(take("<u2", n).astype(np.int64) | take("<u2", n).astype(np.int64) << 16)
        if extra is not None:
            more.append(take(extra, n))
    return np.concatenate(classes), np.concatenate(owner), np.concatenate(pos), np.concatenate(h), np.concatenate(more) if more else None


def _dense(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct classes in byte order, and each one's number."""
    raw = classes.view(">u8").reshape(-1, 2)
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    r = raw[order]
    new = np.r_[True, (r[1:] != r[:-1]).any(axis=1)] if len(r) else np.zeros(0, bool)
    number = np.empty(len(r), np.int64)
    number[order] = np.cumsum(new) - 1
    return classes[order][new], number


def _anchoring(min_length: int, buckets: int):
    def run(batches):
        v, cover = difference_cover(min_length)
        width = min_length - v + 1
        held: list[tuple] = []
        n = 0

        def flush():
            cls, number = _dense(np.concatenate([x[0] for x in held]))  # copies of a class in one batch are one
            base = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
            doc, pos, h = (np.concatenate(x) for x in ([number[x[1] + b] for x, b in zip(held, base)], [x[2] for x in held], [x[3] for x in held]))
            marked, hot = _split_hot(doc, pos, h)
            if len(hot):
                yield _pack_hot(cls, doc[hot], pos[hot], buckets)
            here = np.flatnonzero(marked >= 0)
            here = here[np.argsort(doc[here], kind="stable")]
            yield _pack(cls, doc[here], marked[here], h[here], buckets)

        for b in batches:
            cls, text = b.column(0), b.column(1)
            for s in range(0, b.num_rows, 500):
                part = dict(zip(cls.slice(s, 500).to_pylist(), text.slice(s, 500).to_pylist()))  # copies nearby need one pass
                d, p, h = anchors(list(part.values()), v, cover, width)
                if len(d):
                    held.append((np.frombuffer(b"".join(part), "V16"), d, p, h))
                    n += len(d)
                if n > PACK:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return run


MATCH = "a binary, b binary, pa int, pb int"


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


def _blobs(batches) -> list[tuple[int, bytes]]:
    return [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]


def _matches(table: np.ndarray, a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> pa.RecordBatch:
    names = pa.array(table.tolist(), pa.binary()) if len(table) else pa.array([], pa.binary())
    cols = [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(pa_.astype(np.int32)), pa.array(pb.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "pa", "pb"])


def _pairs_within(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions inside groups of a sorted array, the first always the later one."""
    idx = np.arange(size.sum())
    rank = idx - np.repeat(np.cumsum(size) - size, size)
    member = np.repeat(start, size) + rank
    later = np.repeat(member, rank)
    back = np.arange(len(later)) - np.repeat(np.cumsum(rank) - rank, rank)
    return later, np.repeat(np.repeat(start, size), rank) + back


def _hot_rows(table: np.ndarray, who: np.ndarray, pos: np.ndarray):
    for s in range(0, len(who), 200_000):
        w, p = who[s : s + 200_000], pos[s : s + 200_000]
        batch = _matches(table, w, w, p, p)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(len(w), pa.binary()), batch.column(2), batch.column(3)], ["a", "b", "pa", "pb"])


def _matching(batches):
    """Pairs of places with one window, a < b; places of hot windows as rows with b null."""
    blobs = []
    for bucket, blob in _blobs(batches):
        if int.from_bytes(blob[:4], "little") & MARK:
            yield from _hot_rows(*_unpack_hot(blob))
        else:
            blobs.append((bucket, blob))
    if not blobs:
        return
    classes, owner, pos, h, _ = _unpack(blobs)
    blobs.clear()
    table, number = _dense(classes)
    who = number[owner]
    marked, pos = pos >= MARK, pos & (MARK - 1)
    order = np.argsort(h, kind="stable")
    h, who, pos, marked = h[order], who[order], pos[order], marked[order]
    start, size = _groups(h)
    keep = np.repeat((size > 1) | np.logical_or.reduceat(marked, start), size) if len(h) else np.zeros(0, bool)
    h, who, pos, marked = h[keep], who[keep], pos[keep], marked[keep]
    order = np.lexsort((~marked, pos, who, h))
    h, who, pos, marked = h[order], who[order], pos[order], marked[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (who[1:] != who[:-1]) | (pos[1:] != pos[:-1])] if len(h) else np.zeros(0, bool)
    h, who, pos, marked = h[once], who[once], pos[once], marked[once]  # copies of one class in several tasks
    start, size = _groups(h)
    mixed_ = who[start] != who[start + size - 1] if len(start) else np.zeros(0, bool)
    known = np.logical_or.reduceat(marked, start) if len(start) else mixed_
    few = mixed_ & (size <= HOT) & ~known
    many = mixed_ & (size > HOT) | known
    j, i = _pairs_within(start[few], size[few])
    apart = who[i] != who[j]
    i, j = i[apart], j[apart]
    for s in range(0, len(i), 200_000):
        a, b = i[s : s + 200_000], j[s : s + 200_000]
        yield _matches(table, who[a], who[b], pos[a], pos[b])
    hot = np.repeat(many, size)
    yield from _hot_rows(table, who[hot], pos[hot])


def _matched(texts: DataFrame, min_length: int, keep_all: bool) -> DataFrame:
    """(a, b, proven, at) per pair of classes with a common window; at: [(diagonal, place in a)], null once proven unless keep_all.

    Rows with b null hold the hot places of class a.
    """
    v, cover = difference_cover(min_length)
    width = min_length - v + 1
    chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    buckets = max(parallelism(texts.sparkSession), 1 + chars * len(cover) // v // BUCKET)
    blobs = texts.select("class", "text").mapInArrow(_anchoring(min_length, buckets), BLOB)
    places = blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(_matching, MATCH)
    grouped = places.groupBy("a", "b").agg(F.array_sort(F.collect_set(F.struct((F.col("pb") - F.col("pa")).alias("diag"), "pa"))).alias("at"))
    none = F.struct(F.lit(None).cast("int").alias("diag"), F.lit(0).alias("start"), F.lit(0).alias("last"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        start = F.when((s["diag"] == x["diag"]) & (x["pa"] - s["last"] <= width), s["start"]).otherwise(x["pa"])
        return F.struct(x["diag"].alias("diag"), start.alias("start"), x["pa"].alias("last"), F.greatest(s["best"], x["pa"] + width - start).alias("best"))

    span = F.when(F.col("b").isNotNull(), F.aggregate("at", none, step)["best"]).otherwise(0)
    out = grouped.withColumn("proven", span >= min_length)
    return out if keep_all else out.withColumn("at", F.when(~F.col("proven"), F.col("at")))


def _texts_of(texts: DataFrame, need: DataFrame) -> DataFrame:
    """(class, text), once each, of the classes in ``need``: a broadcast of checked size filters the scan, else a shuffle does."""
    small = need.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(need) if small else need, "class").groupBy("class").agg(F.any_value("text").alias("text"))


def common_run(a: str, i: int, b: str, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:], by doubling slices and then halving them."""
    most = min(len(a) - i, len(b) - j)
    done, step = 0, 64
    while done < most:
        n = min(step, most - done)
        if a[i + done : i + done + n] == b[j + done : j + done + n]:
            done += n
            step *= 2
        elif n == 1:
            break
        else:
            step = n // 2 if n <= step else step // 2
            most = done + n - 1
    return done


def common_back(a: str, i: int, b: str, j: int) -> int:
    """Length of the longest common suffix of a[:i] and b[:j]."""
    lo, hi = 0, min(i, j)
    step = 64
    while lo < hi:
        n = min(step, hi - lo)
        if a[i - lo - n : i - lo] == b[j - lo - n : j - lo]:
            lo += n
            step *= 2
        else:
            hi = lo + n - 1
            step = max(1, n // 2)
    return lo


def runs(a: str, b: str, at: list[dict], min_length: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the maximal common runs of at least min_length through the places ``at``."""
    out, diag, end = [], None, 0
    for x in at:
        if x["diag"] == diag and x["pa"] < end:
            continue
        i, j = x["pa"], x["pa"] + x["diag"]
        back, on = common_back(a, i, b, j), common_run(a, i, b, j)
        diag, end = x["diag"], i + on
        if back + on >= min_length:
            out.append((i - back, j - back, back + on))
    return out


def _extending(min_length: int):
    def run(batches):
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            rows = [(x, y, *r) for x, y, at, s, t in zip(c["a"], c["b"], c["at"], c["ta"], c["tb"]) for r in runs(s, t, at, min_length)]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["a", "b", "start_a", "start_b", "length"])

    return run


def _extend(pairs: DataFrame, texts: DataFrame, min_length: int) -> DataFrame:
    """(a, b, start_a, start_b, length): the runs of pairs (a, b, at), found on their texts."""
    with_a = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "at", "ta", "tb").mapInArrow(_extending(min_length), "a binary, b binary, start_a int, start_b int, length int")


#: Of each window around hot places: a second hash, and the character before it plus one, 0 where the window before was not hashed.
AROUND = np.dtype([("second", "<u8"), ("before", "<u4")])


def _around(min_length: int, buckets: int):
    def run(batches):
        v, _ = difference_cover(min_length)
        held: list[tuple] = []
        n = 0

        def flush():
            base = np.arange(len(held))
            doc = np.repeat(base, [len(x[1]) for x in held])
            return _pack(np.array([x[0] for x in held]), doc, *(np.concatenate([x[k] for x in held]) for k in (1, 2)), buckets, np.concatenate([x[3] for x in held]))

        for b in batches:
            for cls, text, at in zip(*(b.column(i).to_pylist() for i in range(3))):
                place = np.array([x["pa"] for x in at])
                start = np.unique((place[:, None] - np.arange(v)[None, :]).ravel())
                start = start[(start >= 0) & (start <= len(text) - min_length)]
                if not len(start):
                    continue
                points = code_points([text])
                extra = np.zeros(len(start), AROUND)
                extra["second"] = windows(prefix(points, SECOND), start, min_length, SECOND)
                follows = np.r_[False, start[1:] == start[:-1] + 1]
                extra["before"][follows] = points[start[follows] - 1]
                held.append((np.frombuffer(cls, "V16")[0], start, windows(prefix(points, BASE), start, min_length), extra))
                n += len(start)
                if n > PACK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def _alike(batches):
    """Windows around hot places in order of content, then left neighbour, class and place, with the groups of equal ones."""
    blobs = _blobs(batches)
    if not blobs:
        return None
    classes, owner, pos, h, extra = _unpack(blobs, AROUND)
    table, number = _dense(classes)
    who = number[owner]
    order = np.lexsort((pos, who, extra["before"], extra["second"], h))
    h, second, before, who, pos = h[order], extra["second"][order], extra["before"][order], who[order], pos[order]
    same = (h[1:] == h[:-1]) & (second[1:] == second[:-1])
    start = np.flatnonzero(np.r_[True, ~same])
    return table, before, who, pos, start, np.diff(np.r_[start, len(h)])


def _in_several(batches):
    """(class, place) of all windows around hot places that another class has too."""
    if (found := _alike(batches)) is None:
        return
    table, _, who, pos, start, size = found
    shared = np.flatnonzero(np.repeat(np.minimum.reduceat(who, start) != np.maximum.reduceat(who, start), size))
    for s in range(0, len(shared), 200_000):
        x = shared[s : s + 200_000]
        batch = _matches(table, who[x], who[x], pos[x], pos[x])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["class", "s"])


def _left_ends(batches):
    """Pairs of classes with one window, at the left end of the stretch they share."""
    if (found := _alike(batches)) is None:
        return
    table, before, who, pos, start, size = found
    out, n = [], 0
    for s, k in zip(start[size > 1], size[size > 1]):
        w, l, p = who[s : s + k], before[s : s + k], pos[s : s + k]  # noqa: E741
        once = np.r_[True, (w[1:] != w[:-1]) | (l[1:] != l[:-1])]
        w, l, p = w[once], l[once], p[once]  # noqa: E741
        if w.min() == w.max():
            continue
        nxt = np.searchsorted(l, l, side="right")
        for x in range(len(w)):
            y = np.arange(x + 1 if l[x] == 0 else nxt[x], len(w))
            y = y[w[y] != w[x]]
            if len(y):
                up = w[y] > w[x]
                out.append((np.where(up, w[x], w[y]), np.where(up, w[y], w[x]), np.where(up, p[x], p[y]), np.where(up, p[y], p[x])))
                n += len(y)
            if n > 200_000:
                yield _matches(table, *(np.concatenate(c) for c in zip(*out)))
                out, n = [], 0
    if out:
        yield _matches(table, *(np.concatenate(c) for c in zip(*out)))


def _hot_blobs(hot: DataFrame, texts: DataFrame, min_length: int) -> DataFrame:
    """The windows of ``min_length`` characters around hot places, by bucket of their hash."""
    places = hot.agg(F.sum(F.size("at"))).first()[0] or 0
    buckets = max(parallelism(hot.sparkSession), 1 + places * difference_cover(min_length)[0] // BUCKET)
    rows = hot.select(F.col("a").alias("class"), "at").join(texts, "class").select("class", "text", "at")
    return rows.mapInArrow(_around(min_length, buckets), BLOB).repartitionById(buckets, F.col("bucket"))


def _hot_pairs(hot: DataFrame, texts: DataFrame, min_length: int) -> DataFrame:
    """(a, b, at): pairs that share ``min_length`` characters around hot places, with the left ends of their shared stretches."""
    ends = _hot_blobs(hot, texts, min_length).mapInArrow(_left_ends, MATCH)
    return ends.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct((F.col("pb") - F.col("pa")).alias("diag"), "pa"))).alias("at"))


def _classified(docs: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.char_length("text") >= min_length))
    return rows.withColumn("class", text_class(F.col("text")))


def shared_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 320) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records whose texts share at least ``min_length`` consecutive characters.

    Records with one text share it whole. The pairs between classes are expanded to records last.
    """
    rows = _classified(docs, id_col, text_col, min_length)
    matched = cut(_matched(rows, min_length, keep_all=False))
    hot, doubtful = matched.filter("b IS NULL"), matched.filter("b IS NOT NULL AND NOT proven")
    need = cut(doubtful.select(F.explode(F.array("a", "b")).alias("class")).unionByName(hot.select(F.col("a").alias("class"))).distinct())
    texts = _texts_of(rows.select("class", "text"), need)
    pairs = matched.filter("proven").select("a", "b").unionByName(_extend(doubtful, texts, min_length).select("a", "b"))
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(hot, texts, min_length).select("a", "b"))
    pairs = pairs.distinct()
    members = rows.select("class", "id").distinct()
    across = pairs.join(members.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("class").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    copied = members.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class")
    copies = members.join(copied, "class").withColumnRenamed("id", "x")
    within = copies.join(copies.withColumnRenamed("x", "y"), "class").filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def shared_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 320) -> DataFrame:
    """One row (id, n_chars, shared_chars, n_links) per record: how much of its text lies in stretches of at least ``min_length``
    characters that another record has too, and how many records those are. Copies share all; null texts have n_chars 0."""
    rows = _classified(docs, id_col, text_col, min_length)
    matched = cut(_matched(rows, min_length, keep_all=True))
    hot, found = matched.filter("b IS NULL"), matched.filter("b IS NOT NULL").select("a", "b", "at")
    need = cut(matched.select(F.explode(F.array("a", "b")).alias("class")).filter("class IS NOT NULL").distinct())
    texts = _texts_of(rows.select("class", "text"), need)
    any_hot = not hot.isEmpty()
    if any_hot:
        found = found.unionByName(_hot_pairs(hot, texts, min_length))
        found = found.groupBy("a", "b").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    spans = cut(_extend(found, texts, min_length))
    sides = spans.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("other"), F.col("start_a").alias("s"), "length"), F.struct(F.col("b").alias("class"), F.col("a").alias("other"), F.col("start_b").alias("s"), "length"))).alias("x")).select("x.*")
    pieces = sides.select("class", F.struct("s", (F.col("s") + F.col("length")).alias("e")).alias("r"))
    if any_hot:
        alike = _hot_blobs(hot, texts, min_length).mapInArrow(_in_several, "class binary, s int")
        pieces = pieces.unionByName(alike.select("class", F.struct("s", (F.col("s") + min_length).alias("e")).alias("r")))
    stretches = pieces.distinct().groupBy("class").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    merge = lambda s, r: F.struct(F.greatest(s["end"], r["e"]).alias("end"), (s["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(s["end"], r["s"]))).alias("n"))
    covered = stretches.select("class", F.aggregate("rs", state, merge)["n"].alias("covered"))
    members = rows.select("class", "id").distinct()
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    links = sides.select("class", "other").distinct().join(sizes.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("n").alias("links"))
    per_class = sizes.join(covered, "class", "left").join(links, "class", "left")
    per_id = members.join(per_class, "class").select("id", F.when(F.col("n") > 1, F.lit(-1)).otherwise(F.coalesce("covered", F.lit(0))).alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).alias("n_chars")).filter("id IS NOT NULL").distinct().join(per_id, "id", "left")
    return out.select("id", "n_chars", F.when(F.col("c") == -1, F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0))).alias("shared_chars"), F.coalesce("links", F.lit(0)).alias("n_links"))
