"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, cotraining, jaccard, mixing, packing, pii, quality, repeats, sharding, suffix_dedup, vectors, window_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["über", "naïve", "don't", "A1b2", "x@y.example.com"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(80)
    rows = [(i, text(rng.randrange(0, 120))) for i in range(30)]
    rows += [(30 + i, text(20) + " " + shared + "\n" + text(rng.randrange(0, 30))) for i in range(12)]
    base = text(150).split()
    for i in range(12):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
        rows.append((50 + i, " ".join(copy)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (2, rows[3][1]), (72, None), (73, ""), (74, " \n\t "), (None, shared), (75, "a" * 700), (76, "one two"), (77, "ONE two"), (78, text(4000)), (79, text(5) + "\x0b" + text(5))]
    a, b = thue_morse()
    rows += [(80, f"one two three {a}"), (81, f"one two three {b}"), (82, f"{a} " * 14), (83, f"{b} " * 14), (84, f"{a} {b}")]
    return rows + [rows[5], rows[5]]


def thue_morse(n=1024):
    """Two words that polynomial hashes modulo 2**64 take for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def docs(spark, rows=None, **more):
    df = spark.createDataFrame(corpus() if rows is None else rows, "doc_id long, text string")
    df = df.withColumn("source", F.when(F.col("doc_id") % 5 < 3, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))))
    # columns whose names clash with those that the operators make
    return df.withColumns({c: F.lit("clash") for c in ("key", "h", "owner", "n", "seg", "first_id", "copies", "size", "target", "kept", "slot")})


EMPTY = []


# --- suffix order ---------------------------------------------------------------------------------------------------
def brute_suffix(rows, length):
    seen = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(b), int(gone.sum()), int((runs == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("most", [2000, 3])
def test_suffix_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_RUNS", most)
    rows, cut = suffix_dedup.dedup(docs(spark), keep_first=False)
    got = rows.join(cut, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == brute_suffix(corpus(), 200)


@pytest.mark.parametrize("most", [2000, 3])
def test_suffix_dedup_keeps_first(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_RUNS", most)
    first = "the first text of some length " + "".join(random.Random(8).choices("abcdefgh", k=260))
    rows, cut = suffix_dedup.dedup(docs(spark, [(1, first), (2, "head " + first + " tail")]))
    got = {r["doc_id"]: r["n_removed"] for r in rows.join(cut, "key").collect()}
    assert got[1] + got[2] == len(first) and 0 in got.values()


def test_previous_factors():
    rng = random.Random(4)
    for text, most in (("banana", 3), ("aaaaaaaaaaaaaa", 9), ("x", 1), ("".join(rng.choice("ab") for _ in range(300)), 19), ("".join(rng.choice("ab") for _ in range(200)), 8)):
        data = text.encode()
        at = range(len(data) - most + 1)
        want = [max([0, *(next((n for n in range(most, 0, -1) if data[i : i + n] == data[j : j + n]), 0) for j in range(i))]) for i in at]
        factor, before, after = suffix_dedup.previous_factors(suffix_dedup.rank_tables(np.frombuffer(data, np.uint8), most), np.array(at))
        assert factor.tolist() == want
        for i, n in enumerate(want):  # one of the two neighbours is where the factor stands earlier
            assert not n or any(0 <= j < i and data[i : i + n] == data[j : j + n] for j in (before[i], after[i]))


def test_word_hashes_tell_words_apart():
    a, b = thue_morse()
    words = [a, b, "x", "y", "xy", "yx", "a" * 8, "a" * 9, "a" * 16, "12345678abcdefgh", "abcdefgh12345678", *(chr(97 + i) * (i + 1) for i in range(1, 26))]
    raw = np.frombuffer(" ".join([*words, *words]).encode(), np.uint8)
    starts, ends = common.words_of(raw)
    h = common.word_hashes(raw, starts, ends)
    assert (h[: len(words)] == h[len(words) :]).all() and len(set(h.tolist())) == len(words)


def test_minimisers_do_not_depend_on_the_slice():
    rng = np.random.default_rng(3)
    window = rng.integers(0, 3, 30).astype(np.uint8)
    seen = set()
    for size in (30, 300, 70_000):
        values = rng.integers(0, 3, size).astype(np.uint8)
        values[size - 30 :] = window
        h, row, first, windows = repeats.runs(values, np.array([0, size]), 30, 6)
        seen.add((h[-1], len(window)))
    assert len(seen) == 1
    values = rng.integers(0, 40, 500).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 13):
        assert common.slide_argmin(values, w).tolist() == [i + int(values[i : i + w].argmin()) for i in range(500 - w + 1)]


# --- word windows -----------------------------------------------------------------------------------------------------
def brute_windows(rows, n):
    words = [(common.NO_ID if i is None else i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(i, least.get(key, i))
    out = []
    for (i, w), (doc_id, _) in zip(words, rows):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("gather", [1, 24 << 20])
def test_hot_windows_of_repeating_texts(spark, monkeypatch, tmp_path, gather):
    """Texts that repeat one window many times, equal and null ids among them, all through the path for hot minimisers."""
    monkeypatch.setattr(repeats, "MOST_RUNS", 0)
    monkeypatch.setattr(repeats, "GATHER_BYTES", gather)
    monkeypatch.setattr(window_dedup, "CHUNK", 500)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    line = "all rights of this and that are kept by those who have them now "
    rows = [(5, line * 30), (3, "x " + line * 9), (3, "y " + line * 7), (None, line * 3 + "end"), (None, "z " + line * 2), (9, line[:-20]), (1, "other words " * 40)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, window_dedup.query(spark, str(tmp_path)).collect())) == brute_windows(rows, 13)
    assert Counter(map(tuple, suffix_dedup.query(spark, str(tmp_path)).collect())) == brute_suffix(rows, 200)


@pytest.mark.parametrize("most", [2000, 3])
def test_window_dedup(spark, monkeypatch, most, tmp_path):
    monkeypatch.setattr(repeats, "MOST_RUNS", most)
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = window_dedup.query(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == brute_windows(corpus(), 13)


# --- n-gram Jaccard -----------------------------------------------------------------------------------------------------
def brute_components(rows, percent=85):
    sets, groups = [], []
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
        groups.append(len(groups))

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                groups[max(x, y)] = min(x, y)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    return Counter((i, len(sets[k]), i if not sets[k] else min([x for x in ids[root(k)] if x is not None], default=None)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block,elements", [(1024, 4_000_000), (3, 4_000_000), (1024, 500)])
def test_jaccard(spark, monkeypatch, block, elements):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", elements)
    got = jaccard.classes(docs(spark)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(corpus())


def test_group_pairs_lose_no_link_and_leave_pairs_out():
    rng = random.Random(21)
    universe = [rng.getrandbits(64) for _ in range(3000)]
    sets = []
    for _ in range(12):
        base = rng.sample(universe, rng.randrange(40, 120))
        sets += [sorted({*base[: len(base) - k], *rng.sample(universe, k)}) for k in (0, 1, 3, 8, 20)]
    often = Counter(x for s in sets for x in s)
    zones, prefixes, share = [], [], []
    for s in sets:
        need = -(-85 * len(s) // 100)
        l = max(1, need // jaccard.ZONE)
        zone = sorted((x for x in s[: len(s) - need + max(1, len(s) // jaccard.ZONE)]), key=lambda x: (often[x], x))
        zones.append(len(zone))
        share.append(l)
        prefixes.append(np.array(zone[: len(zone) - l + 1], np.uint64))
    full, grp = [np.array(s, np.uint64) for s in sets], np.arange(len(sets))
    pairs = jaccard.GroupPairs(prefixes, np.array([len(s) for s in sets]), grp, np.array(zones), np.array(share), 85)
    near = np.stack([pairs.near(i) for i in range(len(sets))])
    similar = np.array([[100 * len({*a} & {*b}) >= 85 * len({*a} | {*b}) for b in sets] for a in sets])
    assert not (similar & ~near).any() and near.sum() < 0.3 * near.size and similar.sum() > len(sets)
    u, v = jaccard.linked(full, pairs, grp, 85)
    root = list(range(len(sets)))
    for a, b in zip(u, v):
        root = [root[a] if r == root[b] else r for r in root]
    assert similar[u, v].all() and all(root[a] == root[b] for a, b in zip(*np.nonzero(similar)))


def test_jaccard_keeps_one(spark):
    df = docs(spark)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    roots = brute_roots(corpus(), 4, 85)
    rows = kept.collect()
    assert len([r for r in rows if r["text"] and r["text"].strip()]) == len(set(roots) - {None})
    assert {72, 73, 74} <= {r["doc_id"] for r in rows}


def brute_roots(rows, shingle, percent):
    """Component number of each row, None for rows without words."""
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0 and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    return [r if s else None for r, s in zip(root, sets)]


def test_jaccard_keeps_one_of_each_component(spark):
    rng = random.Random(11)
    text = lambda n=40: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    near = text(120)
    rows = [(None, text()) for _ in range(6)] + [(5, text()), (5, text()), (5, text())]
    rows += [(None, near), (None, near + " end"), (8, near + " stop"), (9, near), (8, text()), rows[0], rows[6]]
    rows += [(None, None), (None, None), (None, " "), (5, ""), (5, "")]
    got = jaccard.keep_one(docs(spark, rows)).collect()
    roots = brute_roots(rows, 4, 85)
    of = {t: r for (_, t), r in zip(rows, roots)}
    assert Counter(of[r["text"]] for r in got if of[r["text"]] is not None) == Counter(set(roots) - {None})
    assert sum(of[r["text"]] is None for r in got) == 5
    assert [r["doc_id"] for r in got if of[r["text"]] == of[near]] == [8]


def test_near_duplicate_stage(spark):
    import corpus_pipeline

    rng = random.Random(12)
    words = lambda n: [f"u{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(8):
        base = words(200)
        # added words around 196 / 245 = 0.8, the least similarity that links
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + words(46 + k)))]
    for k in range(6):
        base = words(200)
        edited = [f"x{i}" if i % 40 == 20 and i < 40 * k else w for i, w in enumerate(base)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(edited))]
    rows += [(len(rows) + i, t) for i, t in enumerate(["one two three four", "One two three four", "one two three five", None, ""])]
    roots = brute_roots(rows, 5, 80)
    assert len(set(brute_roots(rows, 4, 85))) > len(set(roots))
    want = {min(i for (i, _), r in zip(rows, roots) if r == root) for root in set(roots) - {None}} | {i for (i, _), r in zip(rows, roots) if r is None}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(spark, rows), "").collect()} == want


# --- quality --------------------------------------------------------------------------------------------------------
def test_quality_statistics(spark):
    rows = corpus() + [(90, "a b c a b c x"), (91, "l one\nl one\n\nl two $# a|b")]
    got = quality.measured(docs(spark, rows), "doc_id").collect()
    want = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, covered = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter(want)


def test_quality_long_texts_take_linear_time(spark):
    """A megabyte that is one word of capitals and a small letter, one of short lines, and one of words in capitals."""
    rows = [(1, "A" * 1_000_000 + "b"), (2, "ab\n" * 350_000), (3, "AB$$ " * 200_000), (4, "#" * 1_000_000)]
    start = time.time()
    got = {r["doc_id"]: (r["n_words"], r["n_upper"], r["n_marked"], r["n_symbols"]) for r in quality.judge(docs(spark, rows)).collect()}
    assert got == {1: (1, 0, 0, 0), 2: (350_000, 0, 0, 0), 3: (200_000, 200_000, 200_000, 400_000), 4: (1, 0, 1, 1_000_000)}
    assert time.time() - start < 40  # a pattern that is quadratic in the word takes hours


def test_quality_verdicts(spark):
    rng = random.Random(2)
    plain = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(120))
    junk = lambda: " ".join("".join(rng.choice("ABC") for _ in range(5)) + "$$$" for _ in range(120))
    rows = [(i, plain()) for i in range(60)] + [(100 + i, junk()) for i in range(15)] + [(200, None), (201, "short")]
    df = docs(spark, rows)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df).select("doc_id", "kept").collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(15)) and not got[200] and not got[201]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 60


def test_quality_query_against_brute_force(spark, tmp_path):
    """The query's columns and verdicts, by a plain loop over documents: statistics, votes, and rounds of estimation."""
    rng = random.Random(19)
    plain = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    junk = lambda: "\n".join(rng.choice(["BUY NOW!!", "$$$ WIN||", "same line here"]) for _ in range(60))
    rows = corpus() + [(200 + i, plain(rng.randrange(20, 200))) for i in range(60)] + [(300 + i, junk()) for i in range(25)] + [(400 + i, plain(40) + " " + junk()) for i in range(10)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    stats, votes = [], []
    for _, t in rows:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen, covered = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        n, chars, symbols, again, repeats_ = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
        upper = sum(bool(re.search("[A-Z]{2}", x)) and not re.search("[a-z]", x) for x in w)
        marked = sum(bool(re.search(r"[#*$%&|<>!]{2}$", x)) for x in w)
        stats.append((n, chars, symbols, again, repeats_))
        m, vote = max(n, 1), lambda bad, good: -1 if bad else 1 if good else 0
        votes.append((
            vote(symbols > 0.5 * m, symbols < 0.1 * m), vote(marked > 0.3 * m, marked < 0.05 * m), vote(upper > 0.4 * m, upper < 0.1 * m), vote(again > 0.3 * len(lines), again < 0.1 * len(lines)),
            vote(100 * repeats_ > 30 * m, 100 * repeats_ < 10 * m), vote(n < 50, n >= 100), vote(chars > 12 * m or chars < 2.5 * m, 3.5 * m <= chars <= 9 * m),
        ))
    v = np.array(votes)
    good, on_good, on_bad = 0.9, np.full(7, 0.98), np.full(7, 0.4)

    def posterior():
        odds = np.log(good / (1 - good)) + np.where(v == 1, np.log(on_good / (1 - on_bad)), np.where(v == -1, np.log((1 - on_good) / on_bad), 0)).sum(1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(12):
        p = posterior()[:, None]
        good = (p.sum() + 18) / (len(v) + 20)
        on_good = np.clip(((p * (v == 1)).sum(0) + 0.98 * 20) / ((p * (v != 0)).sum(0) + 20), 0.9, 0.995)
        on_bad = np.minimum(np.maximum((((1 - p) * (v == -1)).sum(0) + 0.4 * 20) / (((1 - p) * (v != 0)).sum(0) + 20), 1 - on_good), 0.995)
    failed = [n < 50 or 100 * r > 50 * n for n, _, _, _, r in stats]
    want = Counter((i, *x, f, bool(not f and p >= 0.5)) for (i, _), x, f, p in zip(rows, stats, failed, posterior()))
    got = quality.query(spark, str(tmp_path)).drop("p_good").collect()
    assert Counter(map(tuple, got)) == want and len({r["kept"] for r in got}) == 2
    kept = quality.keep_good(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_, k in want.elements() if k)


# --- personal data ----------------------------------------------------------------------------------------------------
def test_pii_base_spans():
    text = "mail a.b@c.example.com, @x a@b 1.2.3.4 300.1.1.1 1.2.3.4.5 or 4539 1488 0343 6467 or 4539148803436468 or +1 (555) 010-9999 +12 x@y.z@q.org"
    kinds = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert kinds == [("email", "a.b@c.example.com"), ("email", "x@y.z"), ("ip", "1.2.3.4"), ("ip", "1.2.3.4"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (555) 010-9999")]
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("a.@-9 é") for _ in range(40))
        assert [(a, b) for k, a, b in pii.base_spans(t) if k == "email"] == [m.span() for m in pattern.finditer(t)]
    assert pii.base_spans("1." + "0" * 5000 + "7.1.1") and not pii.base_spans("9" * 5000 + ".1.1.1") and pii.base_spans("") == []


def test_pii_field_adds_repeats(spark):
    number, plain = "4539148803436467", "words and more words "
    rows = [(i, plain + f"card {number} end") for i in range(30)] + [(100, f"{number} {number}"), (101, "version 3.0 of 2024"), (102, None), (103, "1234567890123456")]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    assert [tuple(s) for s in got[100]["spans"]] == [("card", 0, 16), ("card", 17, 33)] and not got[100]["base"]
    assert not got[101]["spans"] and not got[102]["spans"] and not got[103]["spans"]
    df = docs(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    masked = {r["doc_id"]: r for r in pii.masked(df).collect()}
    assert masked[100]["text"] == "<CARD> <CARD>" and masked[100]["n_chars"] == 13 and masked[102]["text"] is None


def test_pii_match_reaches_all_repeats(spark):
    number, alike = "4539148803436467", "4024000063436467"  # the last seven digits are the same
    far = f"card {number} end. " + " ".join(f"word {number if k < 29 else alike} 7 then" for k in range(30))  # the pattern takes the 7 too, and fails
    rows = [(i, f"the card {number} of it") for i in range(30)] + [(100, far)]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    assert [s["kind"] for s in got[100]["base"]] == ["card"]
    assert [(s["kind"], s["start"], s["end"]) for s in got[100]["spans"]] == [("card", *m.span()) for m in re.finditer("[0-9]{16}", far)]
    assert len(got[100]["spans"]) == 31


def test_pii_skip_potentials_enforce_consistency(spark):
    number = "4539148803436467"
    plain = [(i, f"the card {number} of it and 10.0 more") for i in range(20)] + [(20 + i, f"call +44 20 7946 {1000 + i} or write") for i in range(20)]
    split = "card 4539 1488 0343 6467 was paid. Many words on, 4539.1488.0343.6467 came back, as did 4539/1488/0343/6467."
    phone = "ring +44 20 7946 0958 at noon; the office says 020 7946 0958 and 02079460958, room 12 34"
    rows = [*plain, (100, split), (101, phone), (102, "4539.1488.0343.6460 alone and 020 7946 0999 alone")]
    found = pii.analysed(docs(spark, rows))
    field = pii.fit(found)
    documents = {r["doc_id"]: ([tuple(x) for x in r["base"]], [tuple(x) for x in r["tokens"]]) for r in found.collect()}
    texts = dict(rows)
    marked = lambda i: [(k, texts[i][a:b]) for k, a, b in pii.spans_of([documents[i]], field)[0]]
    assert marked(100) == [("card", "4539 1488 0343 6467"), ("card", "4539.1488.0343.6467"), ("card", "4539/1488/0343/6467")]
    assert marked(101) == [("phone", "+44 20 7946 0958"), ("phone", "020 7946 0958"), ("phone", "02079460958")]
    assert marked(102) == []
    field.skip[:] = 0  # without them each mention stands alone
    assert marked(100) == [("card", "4539 1488 0343 6467")] and marked(101) == [("phone", "+44 20 7946 0958")]


def test_pii_digests_are_no_numbers():
    for text in ("cf1d64a9cf1d64a9cf1d64a9cf1d64a9cf1d64a9", "2100a600b1234567890123456", "550e8400-e29b-41d4-a716-446655440000"):
        assert all(t[7] == 1 for t in pii.tokens_of(text, []))


def test_pii_query_against_patterns(spark, tmp_path):
    rng = random.Random(9)
    bits = ["a.b@c.de", "@", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.255", "4539 1488 0343 6467", "4539148803436467", "+1 (555) 010-9999", "+12", "7" * 30, "x", "é", "\n", " ", "-", ".", "+44 20 7946 0958"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", " and "]) for _ in range(rng.randrange(0, 12)))) for i in range(300)] + [(None, None), (5, ""), (5, "a@b.cc")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    want = Counter()
    for i, t in rows:
        t, out = t or "", []
        out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in out).encode()).hexdigest()
        want[(i, *(sum(k == kind for k, _, _ in out) for kind in pii.KINDS), digest)] += 1
    got = pii.query(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:  # base spans stay
        assert sum(x.startswith("ip:") for x in r["spans"].split(",")) >= r["n_ip"]


def test_pii_long_texts_take_linear_time():
    import time

    began = time.time()
    for text in ("7" * 400_000, "1." * 200_000, "+" + "1 " * 200_000, "a" * 400_000 + "@", "x@" * 100_000, "12 " * 100_000):
        pii.tokens_of(text, pii.base_spans(text))
    assert time.time() - began < 20


def test_pii_documents_do_not_touch():
    texts = ["card 4539148803436467 ok", " ".join(["4539148803436467 7 and"] * 40), "no number", " ".join(f"{k} {k % 3}" for k in range(200)), "", "a@b.example.com a@b.example.com"]
    known = [(b := pii.base_spans(t), pii.tokens_of(t, b)) for t in texts]
    rng = np.random.default_rng(2)
    field = pii.Field(rng.integers(0, 9, (pii.SHAPES, pii.LABELS)), rng.integers(0, 50, (pii.LABELS, pii.LABELS)), rng.integers(0, 50, (pii.LABELS, pii.LABELS)))
    assert pii.spans_of(known, field) == [pii.spans_of([d], field)[0] for d in known]


# --- mixing -------------------------------------------------------------------------------------------------------------
def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 150
    left = 1160 - 180
    assert got["c"] == pytest.approx(min(300, left / 3)) and got["b"] + got["c"] == pytest.approx(left)


def test_mixing_takes(spark):
    rows = [(i, "w " * (i % 17)) for i in range(600)] + [(None, "x y")] * 3
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"] and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 17
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix_documents(df).columns == df.columns
    assert mixing.mix_documents(df).select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in got)


def brute_targets(sizes):
    """Words wanted of each source: shares by weight, what is above three times a source's size shared again."""
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    stopped, total = {}, sum(sizes.values())
    while True:
        left = total - sum(stopped.values())
        rest = [k for k in names if k not in stopped]
        share = {k: left * weight[k] / sum(weight[r] for r in rest) for k in rest}
        over = [k for k in rest if share[k] > 3 * sizes[k]]
        if not over:
            return {**stopped, **share}
        stopped |= {k: 3.0 * sizes[k] for k in over}


def test_mixing_query_against_brute_force(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "B", "é", None, "z" * 9])) for i in range(900)]
    rows += [(900, "q " * 700, "big"), (901, None, "empty"), (902, "one", "tiny"), (5, "five", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.query(spark, str(tmp_path)).collect()
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    want = brute_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, n) for (i, _, _), n in zip(rows, size))
    of = {}
    for r in got:
        of.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
    assert set(of) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for s in sizes:
        own = of[sizes[s], round(want[s], 6)]
        widest = max(r["size"] for r in own)
        assert all(r["taken"] in range(0, 3 * r["size"] + 1, max(1, r["size"])) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(1, widest / 2 + 1)


# --- packing --------------------------------------------------------------------------------------------------------------
def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    rows = corpus() + [(95, "don't I'LL 12a3 $5.00 é é 漢字 <|endoftext|> x")]
    t = Tokenizer.from_file(path)
    out = packing.pack(common.materialise(packing.tokenised(docs(spark, rows), path, with_ids=True), "t")).collect()
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            data = np.array(ids[k : k + 4096], "<u4").tobytes()
            want[(i, k // 4096, k, len(data) // 4, zlib.crc32(data))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for runs in places.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in out)
    assert len(places) <= -(-total // 4096) + 1
    whole = packing.sequences(spark.createDataFrame(out)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * total


def test_packing_plan_is_exact():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 3000):
        counts = np.bincount(rng.integers(1, 101, n), minlength=101)
        plan = packing.plan(counts, 100)
        held = np.zeros(101, int)
        for key, times in plan:
            assert sum(key) <= 100
            for x in key:
                held[x] += times
        assert (held == counts).all()


def test_packing_places_most_pieces_by_the_rounded_programme():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(5.6, 1.1, 3000).astype(int) + 1, 4096)
    counts = np.bincount(lengths, minlength=4097) * 500
    held = np.zeros(4097)
    for key, share in packing.configurations(counts, 4096):
        assert sum(key) <= 4096
        for n in key:
            held[n] += share
    assert np.allclose(held, counts)  # a cover, and no more
    assert packing.rounded(counts).counts.sum() <= 0.2 * counts.sum()
    sequences = sum(times for _, times in packing.plan(counts))
    assert sequences <= 1.002 * (counts * np.arange(4097)).sum() / 4096


# --- sharding, classifier, vectors --------------------------------------------------------------------------------------------
def test_sharding(spark):
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    counts = Counter(table)
    assert len(table) == 101 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 40
    got = sharding.place(docs(spark), ["doc_id"], names, 101).select("doc_id", "shard").distinct()
    assert got.count() == got.select("doc_id").distinct().count()
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_sharding_query_against_brute_force(spark, tmp_path):
    """Slots by Spark's hash; owners by walking the permutations one slot at a time."""
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    names = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]

    def walk(name):
        at, skip = (int.from_bytes(hashlib.md5(f"{k}:{name}".encode()).digest()[:8], "big") for k in ("offset", "skip"))
        while True:
            yield at % sharding.SLOTS
            at += skip % (sharding.SLOTS - 1) + 1

    walks, free, owner = [walk(n) for n in names], set(range(sharding.SLOTS)), {}
    turn = 0
    while free:
        slot = next(x for x in walks[turn % len(walks)] if x in free)
        free.remove(slot)
        owner[slot] = names[turn % len(walks)]
        turn += 1
    got = sharding.query(spark, str(tmp_path)).collect()
    slots = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.SLOTS)).alias("slot")).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in got) == Counter((r["doc_id"], owner[r["slot"]]) for r in slots)


def test_cotraining_held_out(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["river", "stone", "garden", "letter", "window"]) for _ in range(60))
    bad = lambda: "\n".join(rng.choice(["BUY!!", "$$$", "WIN||"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(None, good()), (500, None)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(7, None)], "doc_id long, quality int")
    rows = cotraining.score(df, labels).collect()
    got = {r["doc_id"]: r["p_quality"] for r in rows}
    # calibrated: of 134 good in 200, mean probabilities are near that share
    assert abs(np.mean([r["p_text"] for r in rows if r["doc_id"] is not None and 200 <= r["doc_id"] < 400]) - 2 / 3) < 0.05
    assert len(got) == 402
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in range(200, 400)]) >= 0.95
    none = cotraining.score(df, labels.limit(0)).collect()
    assert {r["p_quality"] for r in none} == {0.5}


def test_cotraining_sample_and_repeated_rows(spark):
    labels = spark.createDataFrame([(i % 500, i % 2) for i in range(1000)] + [(None, 1), (3, 5)], "doc_id long, quality int")
    first = cotraining.labelled_sample(labels, 100).collect()
    again = cotraining.labelled_sample(labels.repartition(5), 100).collect()
    assert len(first) == 100 and Counter(first) == Counter(again)
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "garden"]) for _ in range(30))
    rows = [(i, good() if i % 2 else "$$$ WIN!! " * 20) for i in range(120)] + [(1, good())] * 400
    df = docs(spark, rows)
    got = cotraining.score(df, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")).collect()
    assert len(got) == 520
    assert np.mean([(r["p_quality"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] >= 80]) > 0.9


def test_cotraining_page_view_does_not_read_the_text(spark):
    rows = [(i, "x " * i) for i in range(20)]
    df = docs(spark, rows).withColumn("n_chars", F.lit(100).cast("long"))
    other = df.withColumn("text", F.lit("quite\nanother"))
    pages = lambda d: Counter((r["doc_id"], bytes(r["page_view"])) for r in cotraining.views(d).collect())
    assert pages(df) == pages(other)


@pytest.mark.parametrize("block", [512, 4])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.1, np.repeat(base[:1], 12, 0), base[1] + rng.normal(size=(15, 16)) * 0.08])
    rows = [(i, [float(v) for v in r], i % 2 if i < 60 else 0) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [1.0] * 16, None), (904, [None] + [1.0] * 15, 1), (905, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("class", F.lit(1))
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[: len(x)]])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.98 * near.sum() <= found <= near.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))


def test_vectors_repeated_ids_and_labels(spark):
    one, two, far = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5], [-1.0, 1.0, 0.0]
    rows = [(7, one, 1), (7, far, 1), (7, two, 1), (9, one, 1), (3, two, 2), (None, one, 1), (8, far, 1), (5, [2.0, 0.0, 1.0], 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = [(7, 4, 5, False), (7, 1, 7, True), (7, 4, 5, False), (9, 4, 5, False), (3, 0, 3, True), (None, 4, 5, True), (8, 1, 7, False), (5, 4, 5, True)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_vectors_recall(spark):
    """Queries are the rows whose id is divisible by 50, against all rows: links found and missed, by brute force."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 48))
    near = base[rng.integers(0, 3000, 2000)] + rng.normal(size=(2000, 48)) * rng.uniform(0.05, 0.2, (2000, 1))
    x = np.concatenate([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    queries = range(0, len(x), 50)
    want = {q: int((unit @ unit[q] >= 0.98).sum()) - 1 for q in queries}
    assert all(got[q] <= want[q] for q in queries)
    assert sum(want.values()) > 20 and sum(got[q] for q in queries) >= 0.99 * sum(want.values())


# --- empty tables -------------------------------------------------------------------------------------------------------------
def test_empty_tables(spark):
    df = docs(spark, EMPTY)
    for rows, cut in (suffix_dedup.dedup(df), window_dedup.dedup(df)):
        assert rows.join(cut, "key").count() == 0
    assert jaccard.classes(df).count() == 0 and jaccard.keep_one(df).count() == 0
    assert quality.judge(df).count() == 0 and quality.keep_good(df).count() == 0
    assert pii.find(df).count() == 0 and pii.masked(df).count() == 0
    assert mixing.mix(df).count() == 0 and mixing.mix_documents(df).count() == 0
    assert packing.pack_documents(df).count() == 0
    assert sharding.place(df, ["doc_id"], ["a", "b"], 101).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert cotraining.score(df, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert common.components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long"), "c").collect()))
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == 0 and got[201] == 200 and 5 in got


def test_pipeline_run(spark, tmp_path):
    """The whole run: what each stage decides shows in the pieces, what operators wrote on their way is gone, clashing
    columns and repeated rows do no harm, and an empty table gives no rows."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(16)
    plain = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(120))
    rows = [(i, plain()) for i in range(40)] + [(40, plain() + " mail a.b@c.example.com")]
    rows += [(50, rows[0][1]), (51, rows[1][1] + " end"), rows[2], (60, None), (61, ""), (62, "too short"), (None, plain())]
    rows += [(70 + i, " ".join("ABC$$$ BUY||" for _ in range(60))) for i in range(8)]
    df = docs(spark, rows).withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "__row": F.lit(1), "passes": F.lit(2)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    before = common.written()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert common.written() == before
    assert {r["doc_id"] for r in out} == {*range(41), None}  # one source: its target is its size, so that all stay
    encode = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)).encode
    texts = dict(rows[:41]) | {40: rows[40][1].replace("a.b@c.example.com", "<EMAIL>")}
    for r in out:
        if r["doc_id"] is not None:
            ids = np.array([*encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
            assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["length"] == len(ids)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randrange(300)) for _ in range(90))
    rows = [(i, text()) for i in range(30)]
    rows += [(100, rows[0][1]), (101, "tiny"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")), "n_chars": F.length("text").cast("long")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs_ = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 1:
            assert {r["doc_id"] for r in docs_.collect()} == set(range(30))
    assert docs_.count() > 0


def test_hot_windows_are_joined_once_for_each_text(spark, monkeypatch):
    """Runs of hot windows meet the texts' keys as one row for each text, however many runs there are."""
    monkeypatch.setattr(repeats, "MOST_RUNS", 0)
    seen, by_key = [], window_dedup.by_key
    monkeypatch.setattr(window_dedup, "by_key", lambda texts, found: seen.append((found, found.columns)) or by_key(texts, found))
    line = "all rights of this and that are kept by those who have them now "
    rows = [(i, " ".join(f"{line}{k}x{i}" for k in range(6))) for i in range(1, 5)]
    _, cut = window_dedup.dedup(docs(spark, rows))
    assert {r["first_id"]: r["n_removed"] for r in cut.collect()} == {i: n for i, _, n, _ in brute_windows(rows, 13)}
    found = next(f for f, columns in seen if "start" in columns or "runs" in columns)
    assert found.count() == found.select("owner").distinct().count() > 0
