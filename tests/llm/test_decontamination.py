import hashlib
import random
import re

from pyspark.sql import functions as F

from tandem.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        words = words_of(text)
        hit, ids = set(), set()
        for win, who in windows.items():
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    ids |= {str(w) for w in who if w is not None}
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Béta", "g4mma", "délta", "x", "語", "omega", "Pi"]

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(i, prose(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(30)]
    items += [(7, prose(12)), (None, prose(14)), (90, None), (91, ""), (92, "?!"), (93, "x " * 40)]
    docs = []
    for i in range(120):
        text = prose(rng.randrange(0, 40))
        if i % 3 == 0:
            text += " " + (rng.choice(items)[1] or "").upper() + "; " + prose(5)
        docs.append((i, text))
    docs += [(3, docs[0][1]), (None, items[4][1]), (500, None), (501, ""), (502, "z" * 300_000 + " " + items[6][1])]
    docs += [(600 + i, "x " * 60) for i in range(40)]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "a") for r in docs], "doc_id long, text string, row long, hash string")
    i = spark.createDataFrame([(*r, 1.0) for r in items], "item_id long, text string, window double")
    return d, i


def test_equals_brute_force_with_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SALT_ROWS", 16)
    docs, items = corpus()
    assert rows(decontamination.contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_a_filter_that_lets_everything_through_changes_nothing(spark, monkeypatch):
    docs, items = corpus(6)
    monkeypatch.setattr(decontamination, "FILTER_LIMIT", 64)
    assert rows(decontamination.contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(7)
    d, i = frames(spark, docs, items)
    assert decontamination.contamination(d.limit(0), i).count() == 0
    clean = decontamination.contamination(d, i.limit(0))
    assert clean.where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert clean.count() == len(docs)
    named = decontamination.contamination(d, i).where("n_items > 0").select(F.explode("items")).distinct()
    assert {r[0] for r in named.collect()} <= {str(k) for k, _ in items}
