import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tandem.llm import exact, setsketch, sharding, suffixes


def documents(spark, rows):
    """(doc_id, text) with columns whose names the operators use inside."""
    schema = "doc_id long, text string, key string, digest string, n long, rep long, marks string, size long"
    return spark.createDataFrame([(i, t, "k", "d", 1, 2, "m", 3) for i, t in rows], schema)


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


# --- exact copies ---------------------------------------------------------------------------


def test_exact_groups(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "a b", "ab", "a\tb ", "x\xa0y", "xy", "long " * 4000, "b a"]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    by_content = defaultdict(list)
    for i, t in rows:
        by_content[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    got = {r.doc_id: r for r in exact.exact_groups(documents(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    for content, members in by_content.items():
        keep = min(members)[1]
        for _, i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(members), i == keep)
            assert r.text_sha256 == hashlib.sha256(content.encode()).hexdigest()


def test_exact_groups_of_odd_tables(spark):
    assert exact.exact_groups(documents(spark, [])).count() == 0
    rows = exact.exact_groups(documents(spark, [(7, "a"), (7, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in rows) == [
        (-1, -1, 1, True), (-1, 7, 3, False), (7, 7, 3, True), (7, 7, 3, True)]


# --- shards ---------------------------------------------------------------------------------


def test_shards_are_minimax(spark):
    rng = random.Random(2)
    texts = [None, "", *["x" * rng.randrange(1, 400) for _ in range(60)], *["y" * rng.randrange(1, 9) for _ in range(200)]]
    rows = [(rng.randrange(10**9) * 2 + i % 2, rng.choice(texts)) for i in range(700)]
    rows = list({i: t for i, t in rows}.items())
    out = sharding.shard_documents(documents(spark, rows), shards=7).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    shards, slots, content_shard = defaultdict(int), defaultdict(list), defaultdict(set)
    for i, t in rows:
        raw, r = (t or "").encode(), got[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        shards[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        content_shard[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in content_shard.values())
    groups = defaultdict(lambda: [10**18, 0])
    for i, t in rows:
        group = groups[t or ""]
        group[0], group[1] = min(group[0], i), group[1] + len((t or "").encode()) + 8
    sizes = [size for _, size in sorted(groups.values())]
    assert max(shards.values()) == sharding._smallest_capacity(sizes, 7)


def test_shards_of_odd_tables(spark):
    assert sharding.shard_documents(documents(spark, [])).count() == 0
    rows = sharding.shard_documents(documents(spark, [(3, "a"), (3, "a"), (None, None), (5, "")]), shards=4).collect()
    assert len(rows) == 4 and {r.text_crc32 for r in rows if r.doc_id != 3} == {0}
    assert len({r.shard for r in rows if r.doc_id != 3}) == 1


# --- near copies ----------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets[i] = set(zip(*[found[j:] for j in range(k)])) if len(found) >= k else ({tuple(found)} if found else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, monkeypatch, k, percent):
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    rng = random.Random(k)
    rows, n = [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE two"), (1004, "one")], 0
    for _ in range(12):
        base = words(rng, rng.randrange(4, 120))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                copy[rng.randrange(len(copy))] = "".join(rng.choice("uvwxyz") for _ in range(4))
            rows.append((n, " ".join(copy)))
            n += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(documents(spark, rows), k=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_chains_are_followed_in_every_bucket(spark, monkeypatch):
    """Neighbours in the chain are alike enough, its ends are not."""
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    rng = random.Random(9)
    line = words(rng, 700)
    rows = [(i, " ".join(line[8 * i : 8 * i + 200])) for i in range(40)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(documents(spark, rows), k=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_of_odd_tables(spark):
    assert setsketch.near_duplicates(documents(spark, [])).count() == 0
    rows = setsketch.near_duplicates(documents(spark, [(1, None), (2, ""), (None, "a b c"), (4, "a b c"), (4, "a b c")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in rows) == [
        (-1, 1, -1, True), (1, 0, 1, True), (2, 0, 2, True), (4, 1, 4, True), (4, 1, 4, True)]


def test_joint_estimate_is_close_to_the_similarity():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (0, 500, 1500, 1900):
        a, b = values[:2000], np.concatenate([values[:shared], values[2000 : 4000 - shared]])
        registers = setsketch.sketches([np.unique(a), np.unique(b)], 1024).astype(int)
        signs = np.sign(registers[0] - registers[1])
        counts = [np.array([(signs == s).sum()]) for s in (1, -1, 0)]
        found = setsketch.joint_estimate(*counts, np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(found - shared / len(np.union1d(a, b))) < 0.06


# --- repeated passages ----------------------------------------------------------------------


def brute_removed(rows, length):
    first, out = {}, {}
    ordered = sorted((i, (t or "").encode()) for i, t in rows)
    for i, raw in ordered:
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], (i, p))
    for i, raw in ordered:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] != (i, p):
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), gone.count(1), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed, hot", [(1, 20_000), (2, 1), (3, 2)])
def test_repeats_go(spark, monkeypatch, seed, hot):
    rng = random.Random(seed)
    monkeypatch.setattr(suffixes, "_WINDOWS", 256)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randrange(60, 300))) for _ in range(5)]
    rows = [(100, None), (101, ""), (102, "short"), (103, "z" * 700), (104, "z" * 650), (105, "xyz" * 200)]
    for i in range(50):
        parts = [rng.choice([rng.choice(passages), rng.choice(passages)[: rng.randrange(250)], rng.choice(passages)[rng.randrange(200) :],
                             "".join(rng.choice("mnopq") for _ in range(rng.randrange(50)))]) for _ in range(rng.randrange(5))]
        rows.append((i, "".join(parts)))
    spans = suffixes.repeated_spans(documents(spark, rows).repartition(3), hot=hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           suffixes._cut(spans.drop("row"), 100, "key").withColumnRenamed("key", "doc_id").collect()}
    assert got == brute_removed(rows, 100)


def test_repeats_of_odd_tables(spark):
    assert suffixes.without_repeats(documents(spark, [])).count() == 0
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(90))
    rows = suffixes.without_repeats(documents(spark, [(None, text), (5, text), (5, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (5, len(text)), (5, len(text))]
    kept = suffixes.kept_texts(documents(spark, [(1, None), (2, text), (3, "é" + text)])).orderBy("doc_id").collect()
    assert [r.text for r in kept] == [None, text, "é"] and kept[2].digest == "d" and kept[2].marks == "m"


def test_merge_gives_order_and_common_prefixes():
    rng = random.Random(4)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 30))) for _ in range(7)]
    merged = list(suffixes.merge_runs([suffixes.front_coded(r) for r in runs]))
    assert [m[2] for m in merged] == sorted(s for r in runs for s in r)
    for before, after in zip(merged, merged[1:]):
        shared = 0
        while shared < min(len(before[2]), len(after[2])) and before[2][shared] == after[2][shared]:
            shared += 1
        assert after[3] == shared
