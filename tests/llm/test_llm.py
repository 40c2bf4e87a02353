import os
import random
from pathlib import Path

import pytest

from ledgerloom.llm import encoding, leakage, rolling
from ledgerloom.llm import shared_spans as ss

TOKENIZERS = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")
needs_files = pytest.mark.skipif(not Path(TOKENIZERS).exists(), reason="no tokenizer files")


@pytest.mark.parametrize("length", [20, 64, 114, 182, 266, 320, 1000])
def test_difference_cover(length):
    v, cover = ss.difference_cover(length)
    assert {(int(a) - int(b)) % v for a in cover for b in cover} == set(range(v))
    assert 2 * v <= length


def test_window_hashes_depend_on_content_alone():
    p = rolling.prefix(rolling.code_points(["abcabc", "xabc"]))
    import numpy as np

    h = rolling.windows(p, np.array([0, 3, 7, 1]), 3)
    assert h[0] == h[1] == h[2] != h[3]


def test_common_runs():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(400))) for _ in range(2))
        k = r.randrange(1, 300)
        a, b = a + "c" * k + a, b + "c" * k + a[: r.randrange(len(a) + 1)]
        i, j = a.find("c"), b.find("c")
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        m = 0
        while m < min(i, j) and a[i - m - 1] == b[j - m - 1]:
            m += 1
        assert ss.common_run(a, i, b, j) == n and ss.common_back(a, i, b, j) == m


def corpus(seed, n=60):
    r = random.Random(seed)
    make = lambda k: "".join(r.choice("abcdefgh é漢😀 ") for _ in range(k))
    shared = [make(k) for k in (39, 40, 41, 60, 200)]
    texts = [make(r.randrange(80)) + r.choice(shared) + make(r.randrange(80)) for _ in range(n)]
    texts += [texts[0], texts[0], "", None, "z" * 300, "z" * 90, "y" + "z" * 39, "y" + "z" * 40]
    return list(enumerate(texts))


def shares(a, b, n):
    return a is not None and b is not None and bool({a[i : i + n] for i in range(len(a) - n + 1)} & {b[i : i + n] for i in range(len(b) - n + 1)})


@pytest.mark.parametrize("extra", [0, 40])
def test_shared_pairs_equal_brute_force(spark, extra):
    """Forty more records with one stretch make its windows hot."""
    rows = corpus(extra)
    if extra:
        r = random.Random(9)
        block = "".join(r.choice("klmnopq") for _ in range(70))
        short = "".join(r.choice("rstuvwx") for _ in range(36))  # hot, but too short to count
        rows += [(1000 + i, f"{i:03d}" * 5 + block[: 70 - i % 30] + f"<{i:04d}>" + short + f"{i:03d}") for i in range(extra)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows] + [(None, rows[0][1], "", 1), (*rows[0], "again", 2)], "doc_id long, text string, class string, id int")
    got = [tuple(r) for r in ss.shared_pairs(df, min_length=40).collect()]
    want = {(i, j) for i, a in rows for j, b in rows if i < j and shares(a, b, 40)}
    assert len(got) == len(set(got)) and set(got) == want
    cover = {r["id"]: r for r in ss.shared_coverage(df, min_length=40).collect()}
    assert len(cover) == len(rows)
    for i, t in rows:
        others = [b for j, b in rows if j != i and b is not None]
        mark = set()
        for k in range(len(t or "") - 39):
            if any(t[k : k + 40] in b for b in others):
                mark |= set(range(k, k + 40))
        assert (cover[i]["n_chars"], cover[i]["shared_chars"], cover[i]["n_links"]) == (len(t or ""), len(mark), sum((min(i, j), max(i, j)) in want for j, _ in rows if j != i)), i


@pytest.mark.parametrize("slices", [2, 6])
def test_one_window_in_many_records_does_not_fill_its_bucket(monkeypatch, slices):
    """A stretch that every record has: its bucket gets one place a batch, whatever the number of records."""
    import pyarrow as pa

    monkeypatch.setattr(ss, "PACK", 40_000)
    block = "".join(random.Random(1).choice("klmnopq") for _ in range(60))
    buckets, rows = 16, slices * 3000
    texts = [f"{i:06d}" + block for i in range(rows)]
    classes = [i.to_bytes(16, "big") for i in range(rows)]
    batches = [pa.record_batch([pa.array(classes[i : i + 1000]), pa.array(texts[i : i + 1000])], ["class", "text"]) for i in range(0, rows, 1000)]
    out = [x for b in ss._anchoring(40, buckets)(batches) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    own = [len(ss._unpack([x])[1]) for x in out if not int.from_bytes(x[1][:4], "little") & ss.MARK]
    spread = [x for x in out if int.from_bytes(x[1][:4], "little") & ss.MARK]
    v, cover = ss.difference_cover(40)
    assert len(spread) >= slices - 1 and sum(own) < 0.6 * rows * len(ss.anchors(texts[:1], v, cover, 41 - v)[0])
    rows_out = [r for b in ss._matching([pa.record_batch([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["bucket", "blob"])]) for r in b.to_pylist()]
    hot = {(r["a"], r["pa"]) for r in rows_out if r["b"] is None}
    want = {(c, int(p)) for c, t in zip(classes, texts) for p in ss.anchors([t], v, cover, 41 - v)[1] if p >= 6}
    assert want <= hot and all(r["b"] is None or r["pa"] < 6 for r in rows_out)


def test_shared_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ss.shared_pairs(df).collect() == [] and ss.shared_coverage(df).collect() == []


def test_long_texts_go_in_pieces(monkeypatch):
    r = random.Random(3)
    t = "".join(r.choice("abc ") for _ in range(5000))
    v, cover = ss.difference_cover(40)
    whole = ss.anchors([t], v, cover, 41 - v)
    monkeypatch.setattr(ss, "SLICE", 300)
    cut = ss.anchors([t], v, cover, 41 - v)
    assert all((a == b).all() for a, b in zip(whole, cut)) and len(whole[0]) > 100


@needs_files
def test_tree_encoding_is_exact():
    enc = encoding.tokenizer("byte_bpe_50k", TOKENIZERS)
    r = random.Random(5)
    bits = ["a", "the", " ", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "漢", "!", "\x1c", "\x85", "　", "\r\n", "ing", "<|endoftext|>", "😀"]
    for k in range(400):
        t = "".join(r.choice(bits) for _ in range(r.randrange(150)))
        for leaf in (1, 7, 40):
            assert encoding.encode(enc, t, leaf).tolist() == enc.encode_ordinary(t), repr(t)
        assert encoding.decode(enc, enc.encode_ordinary(t)).decode() == t
    t = "x" * 5000 + " " + "漢" * 3000
    assert encoding.encode(enc, t, 100).tolist() == enc.encode_ordinary(t)


@needs_files
def test_long_texts_are_joined_over_growing_windows(monkeypatch):
    enc = encoding.tokenizer("byte_bpe_50k", TOKENIZERS)
    direct = []
    monkeypatch.setattr(encoding, "leaf_ids", lambda e, t, f=encoding.leaf_ids: (direct.append(len(t)), f(e, t))[1])
    run, lines = "漢字" * 35_000, ("漢字仮名、" * 30 + "\n") * 450  # 200 kB each in UTF-8, without and with places to cut
    for t in (run, lines, run + " " + lines, "it's 'x're" * 3000, lines + run + lines):
        direct.clear()
        assert encoding.encode(enc, t).tolist() == enc.encode_ordinary(t)
        assert sum(direct) < 3 * len(t)  # an indivisible run is not encoded again on every level
    direct.clear()
    encoding.encode(enc, "word " * 10_000)
    assert max(direct) <= encoding.LEAF and len(direct) > 20


@needs_files
def test_encoding_a_table(spark):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, "", 0), (3, None, 0), (4, "a " * 100_000, 0), (None, "x", 0)], "doc_id long, text string, ids int")
    coded = encoding.encode_corpus(df, TOKENIZERS)
    got = {r["id"]: r["ids"] for r in coded.collect()}
    assert got[1] == [15496, 995] and got[2] == got[3] == [] and len(got) == 5
    back = {r["id"]: r["text"] for r in encoding.decode_corpus(coded, TOKENIZERS).collect()}
    assert back[4] == "a " * 100_000 and back[3] == ""
    assert encoding.encode_corpus(df.limit(0), TOKENIZERS).collect() == []


def test_alignment():
    import numpy as np

    def brute(x, y):
        best, h = 0, [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x[i - 1] == y[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    r = random.Random(7)
    for _ in range(60):
        x, y = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        assert leakage.smith_waterman(np.array(x), np.array(y))[0] == brute(x, y)
    assert leakage.smith_waterman(np.array([1, 2, 3]), np.array([9, 1, 2, 3, 9])) == (6, 1, 4)


def test_leaks(spark):
    r = random.Random(11)
    word = lambda: r.choice(["Alpha", "beta", "GAMMA", "x1", "délta", "ε", "zeta", "eta", "theta"])
    items = [(i, " ".join(word() for _ in range(r.randrange(3, 40)))) for i in range(12)]
    docs = []
    for k in range(80):
        w = r.choice(items)[1].split()
        a = r.randrange(len(w))
        piece = w[a : a + r.randrange(6, 20)]
        docs.append((k, " ".join(word() for _ in range(20)) + ", " + "… \n".join(piece).upper() + "; " + " ".join(word() for _ in range(5))))
    docs += [(900, None), (901, ""), (902, "!?"), (903, items[5][1])]
    rows = spark.createDataFrame([(*d, "clash", 1) for d in docs] + [(*docs[0], "again", 2), (None, docs[0][1], "", 0)], "doc_id long, text string, item_id string, score int")
    got = leakage.leaked(rows, spark.createDataFrame([*items, (50, None), (51, ""), (None, "a b c d e f")], "item_id long, text string")).collect()
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    grams = lambda t: {tuple(words(t)[i : i + 12]) for i in range(len(words(t)) - 11)}
    want = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    assert len(got) == len({(g["id"], g["item_id"]) for g in got})
    assert {(g["id"], g["item_id"]) for g in got if g["longest_run"] >= 12} == want
    assert leakage.leaked(rows.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert leakage.leaked(rows, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_edited_copies_are_aligned(spark, tmp_path):
    """Copies with every eighth word changed, of items that other documents have whole or not at all, against brute force."""
    import numpy as np

    from ledgerloom.llm import catalogue

    r = random.Random(13)
    make = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    items = [(i, make(r.randrange(16, 60))) for i in range(12)]
    docs = [(i, make(30) + w + make(30)) for i, w in items[:6]]
    docs += [(100 + i, make(30) + w[5:10] + make(8) + [x if k % 8 else "new" for k, x in enumerate(w)] + make(30)) for i, w in items]
    docs += [(150 + i, make(20) + [x if k % 4 else "new" for k, x in enumerate(w)] + make(30)) for i, w in items]
    docs += [(200 + i, make(30) + [y for k, x in enumerate(w) for y in ([x] if k % 6 else [x, "more", "words"])]) for i, w in items]
    docs += [(300 + i, make(30) + w[: len(w) // 3]) for i, w in items]
    spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    code: dict[str, int] = {}
    ids = lambda w: np.array([code.setdefault(x, len(code)) for x in w])
    score = {(d, i): leakage.smith_waterman(ids(w), ids(t))[0] for d, t in docs for i, w in items}
    run = lambda a, b: any(a[k : k + 12] == b[m : m + 12] for k in range(len(a) - 11) for m in range(len(b) - 11))
    want = {(d, i): score[d, i] for d, t in docs for i, w in items if score[d, i] >= len(w) or run(w, t)}
    assert len(want) > 28
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in catalogue.p7_alignments(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("every", range(4, 11))
def test_recall_of_planted_edits(spark, every):
    """Copies with one word in four to ten changed, among documents of common words: nine in ten or more are found."""
    r = random.Random(every)
    common = [f"c{i}" for i in range(60)]
    make = lambda n: [r.choice(common) if r.random() < 0.7 else f"w{r.randrange(500)}" for _ in range(n)]
    items = [(i, make(r.randrange(15, 60))) for i in range(60)]
    docs = [(i, make(40) + [x if (k + i) % every else f"e{r.randrange(10**6)}" for k, x in enumerate(w)] + make(40)) for i, w in items]
    docs += [(1000 + i, make(20) + w + make(20)) for i, w in items[::2]]  # whole copies elsewhere make every n-gram occur
    docs += [(5000 + k, make(200)) for k in range(200)]
    text = lambda rows, c: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{c} long, text string")
    got = {(x["id"], x["item_id"]) for x in leakage.leaked(text(docs, "doc_id"), text(items, "item_id"), edited=True).collect()}
    assert sum((i, i) in got for i, _ in items) >= 0.9 * len(items)
