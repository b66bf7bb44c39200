"""Curve packing, periodic runs and simplex clustering against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import corpus, docs
from tidemark.llm import common, curve_packing, periodic_runs, simplex_clusters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- curve packing --------------------------------------------------------------------------------------------------
TRICKY = [
    (95, "don't I'LL they'd've 12a3 $5.00 é é 漢字 <|endoftext|> x"),
    (96, "a  b\t c \n\n d\n e  f  g　 h\x1c i\x1f\x1f j \n"),
    (97, "<|endoftext|>"),
    (98, "end. 'quoted' \"'s\" it's 5's $'d x_y a-b… \U0001f600\U0001f600 naïve"),
    (99, " leading\nline\n\nline \r\n x"),
    (None, "no id"),
    (None, "no id"),
]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(curve_packing.VOCABULARY))


def test_parts_have_the_tokenizers_ids(tokenizer):
    import public_tokenizers

    rng = random.Random(5)
    signs = [*"aZé9'.$ \t\n\r\x0b\x1c\u0085  　漢", "'s", "'ll", "  ", "word", " the", "́", "²", "\U0001f600"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)] + [t or "" for _, t in corpus() + TRICKY]
    ids, bounds = curve_packing._Parts(public_tokenizers.path(curve_packing.VOCABULARY)).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], repr(t)


@pytest.mark.parametrize("capacity", [2048, 100])
def test_curve_packing(spark, tokenizer, capacity):
    rows = corpus() + TRICKY
    out = curve_packing.pack_documents(docs(spark, rows), capacity=capacity, with_ids=True).collect()
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    held, sequences, pieces = Counter(), defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["doc_tokens"], tuple(ids.tolist()), r["sequence_id"]))
    for doc_id, own in pieces.items():  # rows that share doc_id have pieces that are alike or follow on one another
        for whole in [w for i, w in want if i == doc_id]:
            parts = [p for p in own if p[1] == len(whole) and p[2] == whole[p[0] : p[0] + len(p[2])]]
            seen = np.zeros(len(whole), int)
            for start, _, ids, _ in parts:
                seen[start : start + len(ids)] += 1
            assert (seen == want[(doc_id, whole)]).all()
        held[doc_id] = sum(len(p[2]) for p in own)
    total = sum(len(w) * n for (_, w), n in want.items())
    assert sum(held.values()) == total
    padding = 0
    for runs in sequences.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0 or capacity & (capacity - 1)
    assert sorted(sequences) == list(range(len(sequences)))
    whole = curve_packing.sequences(spark.createDataFrame(out)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * total


def test_hilbert_key_is_a_path():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), axis=-1).reshape(-1, n)
        keys = curve_packing.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()  # each step goes to a neighbouring cell


def test_neighbours_on_the_curve_are_alike(spark):
    rng = random.Random(3)
    topics = [[f"{chr(97 + k)}{i}word" for i in range(40)] for k in range(8)]
    rows = [(i, " ".join(rng.choices(topics[i % 8], k=120))) for i in range(400)]
    laid = curve_packing.pack_documents(docs(spark, rows)).select("doc_id", "key").distinct().orderBy("key", "doc_id").collect()
    same = sum(a["doc_id"] % 8 == b["doc_id"] % 8 for a, b in zip(laid, laid[1:]))
    assert same > 0.6 * len(laid)  # of topics in any order, one in eight


def test_curve_packing_long_text_and_empty_table(spark, tokenizer):
    rows = [(1, "x" * 300_000 + " " + "lorem ipsum " * 60_000), (2, None)]
    out = curve_packing.pack_documents(docs(spark, rows)).collect()
    n = len(tokenizer.encode(rows[0][1], add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == n
    assert [(r["length"], r["doc_tokens"]) for r in out if r["doc_id"] == 2] == [(1, 1)]
    assert curve_packing.pack_documents(docs(spark, [])).count() == 0


# --- periodic runs ----------------------------------------------------------------------------------------------------
def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            run = words[start : start + length]
            if length >= max(6, 4 * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_texts():
    rng = random.Random(9)
    out = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            base = [rng.choice("abcde") for _ in range(rng.randrange(1, 8))]
            parts += base * rng.randrange(1, 9) + base[: rng.randrange(len(base))]
            parts += [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 6))]
        out.append(parts)
    out += [["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3, (["a"] * 6 + ["b"]) * 5, [], ["é"] * 40, (["a"] * 6 + ["b"] * 6) * 9]
    return out


def test_surviving_segments_and_lag_scan():
    texts = run_texts()
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    words = np.array([number[w] for t in texts for w in t])
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = defaultdict(list)
    for a, b in periodic_runs.surviving(words, bounds):
        i = int(np.searchsorted(bounds, a, side="right")) - 1
        assert b <= bounds[i + 1] and min(Counter(words[a:b].tolist()).values()) >= 4
        got[i] += [(a + s - int(bounds[i]), n, q) for s, n, q in periodic_runs.lag_scan(words[a:b])]
    for i, t in enumerate(texts):
        assert got[i] == brute_runs(t), t


def test_lag_scan_in_small_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 7)
    for t in run_texts():
        words = np.array([ord(w[0]) * 100 + len(w) for w in t] or [0])[: len(t)]
        assert periodic_runs.lag_scan(words) == brute_runs(words.tolist())


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(13)
    rows = corpus() + [(1000 + i, " ".join(t)) for i, t in enumerate(run_texts())]
    rows += [(2000 + i, " ".join(rng.choice("abc") + rng.choice(["", "x", "\n"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want, changed = Counter(), 0
    for i, t in rows:
        words = WORD.findall(t or "")
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a, changed = g % n, changed + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else (None,) * 3
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
        want[(i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)] += 1
    got = periodic_runs.query(spark, str(tmp_path)).collect()
    assert changed > 20 and Counter(map(tuple, got)) == want


def test_periodic_runs_long_texts(spark):
    """Texts of a megabyte: one word over and over, runs of runs, a period of 50,000 words, and words in no order."""
    rng = random.Random(1)
    base = [f"v{rng.randrange(9000)}" for _ in range(50_000)]
    rows = [(1, "a " * 500_000), (2, ("a " * 6 + "b " * 6) * 40_000), (3, " ".join(base * 4)), (4, " ".join(rng.choice("abcdefgh") for _ in range(400_000)))]
    start = time.time()
    got = {r["doc_id"]: r["runs"] for r in periodic_runs.runs(docs(spark, rows)).collect()}
    assert [tuple(r) for r in got[1]] == [(0, 500_000, 1)]
    assert len(got[2]) == 80_001 and tuple(max(got[2], key=lambda r: r["length"])) == (0, 480_000, 12)
    assert [tuple(r) for r in got[3]] == [(0, 200_000, 50_000)]
    assert time.time() - start < 90
    assert periodic_runs.runs(docs(spark, [])).count() == 0


# --- simplex clusters ---------------------------------------------------------------------------------------------------
def brute_clusters(rows):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    named += sorted(("~", v) for i, v in kept if i is None)
    centroids = [v for _, v in named[:40]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(5):
        of = [assign(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *assign(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in out:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in out)


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (12, 64))
    out = [(i, (centres[i % 12] + rng.normal(0, 0.05, 64)).astype(np.float32).tolist()) for i in range(n)]
    out += [(n, None), (n + 1, []), (n + 2, [0.5] * 63), (n + 3, [0.5] * 63 + [None]), (n + 4, [float("nan")] * 64), (n + 5, [float("inf")] + [0.0] * 63), (n + 6, [0.0] * 64)]
    return out + [out[3], out[3], (7, out[5][1]), (None, out[9][1]), (None, out[10][1]), (n + 7, [100000.0, -100000.0] * 32)]


@pytest.mark.parametrize("n", [300, 12, 0])
def test_simplex_clusters(spark, tmp_path, n):
    rows = vectors(n) if n else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "cluster": F.lit("clash"), "v": F.lit("clash")})
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = simplex_clusters.query(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == brute_clusters(rows)


def test_simplex_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 40, (20, 64))
    vectors_ = np.rint(centres[rng.integers(0, 20, 3000)] + rng.normal(0, 10, (3000, 64))).astype(np.int64)
    for centroids in (vectors_[:40], np.repeat(vectors_[:2], 20, axis=0), np.zeros((5, 64), np.int64)):
        simplex = simplex_clusters.Simplex(centroids)
        apexes = simplex.apexes(simplex.distances(vectors_))
        lower, upper = simplex_clusters.bounds(apexes, simplex.apexes(simplex.distances(centroids)))
        exact = ((vectors_[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (lower <= exact).all() and (exact <= upper).all()
        cluster, distance, compared = simplex_clusters.nearest(vectors_, apexes, centroids, simplex)
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        if len(np.unique(centroids, axis=0)) == 40:
            assert compared < 0.5 * exact.size  # most are never compared in full
