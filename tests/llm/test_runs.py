import hashlib
import random
import zlib

import numpy as np

from tandem.llm import runs


def all_runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def sequence(rng):
    n, kind = rng.randrange(0, 150), rng.randrange(5)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:  # Fibonacci words are rich in runs
        a, b = "0", "01"
        while len(b) < n:
            a, b = b, b + a
        return [int(x) for x in b[:n]]
    if kind == 2:  # squares whose halves have a short period of their own
        half = [0, 1] * rng.randrange(1, 25) + [0]
        return [5] * rng.randrange(3) + half + half + [rng.randrange(2) for _ in range(5)]
    unit = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
    return (unit * 8)[:n] if kind == 3 else [0] * n


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        texts = [sequence(rng) for _ in range(rng.randrange(1, 5))]
        words = np.array([w + 10 * i for i, t in enumerate(texts) for w in t], np.int64)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        start, end, period = runs.find_runs(words, first)
        got = sorted(zip(start.tolist(), (end - start).tolist(), period.tolist()))
        assert got == sorted((s + f, n, q) for t, f in zip(texts, first.tolist()) for s, n, q in all_runs(t))


def test_wavelet_matrix_order_statistics():
    rng = np.random.default_rng(2)
    for size in (1, 2, 63, 64, 65, 300):
        values = rng.permutation(size)
        tree = runs.WaveletMatrix(values)
        low = rng.integers(0, size, 50)
        high = np.array([rng.integers(x, size) + 1 for x in low])
        bound = rng.integers(0, size + 3, 50)
        below = [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound)]
        assert tree.below(low, high, bound).tolist() == below
        place = np.array([rng.integers(0, b - a) for a, b in zip(low, high)])
        assert tree.smallest(low, high, place).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(low, high, place)]


def expected(key, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = all_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        key, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_rows_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(runs, "SLICE_BYTES", 2000)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}é" for x in sequence(rng)), 1, "s") for i in range(80)]
    rows += [(i, " ".join(str(rng.randrange(50)) for _ in range(rng.randrange(300))), 1, "s") for i in range(80, 160)]
    rows += [(1, rows[1][1], 1, "s"), (None, "a " * 20, 1, "s"), (201, None, None, None), (202, "", 1, ""), (203, "  x\x85" * 3, 1, "")]
    rows += [(204, "\t\n\x0b\x0c\r ", 1, ""), (205, "a b " * 3000, 1, ""), (206, "x" * 100_000, 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string")
    got = runs.collapse_runs(df, edit=runs.repeat_tail).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(k, t) for k, t, *_ in rows), key=repr)
    full = runs.collapse_runs(df.where("doc_id = 205"), with_texts=True).head()
    assert full.collapsed == "a b" and [tuple(r) for r in full.runs] == [(0, 6000, 2)]
    assert runs.collapse_runs(df.limit(0)).count() == 0
