import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import quality, syncmers, toxicity, warc
from tandem.session import scratch_path


def held_out(i, divisor, remainder):
    return zlib.crc32(str(i).encode()) % divisor == remainder


def corpus(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 60))]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if toxic:
            words.insert(rng.randrange(len(words)), "blorgfiend" if i % 2 else "bl0rgf1end")
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "en", "s", 0.5))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 1.0), (n + 2, "x" * 100_000, "en", "s", 1.0), (n + 2, "x" * 100_000, "en", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, words double")
    return docs, spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def auc(pairs):
    positive, negative = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > q) + 0.5 * (p == q) for p in positive for q in negative])


def check(rows, labels, column, divisor, remainder, threshold):
    known = {r.doc_id: r[column] for r in labels.collect()}
    for r in rows:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= threshold)
        assert r.held_out == held_out(r.doc_id, divisor, remainder)
    return auc([(r.score, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id) is not None])


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert check(rows, labels, "quality", 4, 2, 0.7) > 0.97
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    accepted = {r.doc_id for r in rows if r.predicted}
    assert {r.doc_id for r in kept.collect()} == accepted


def test_quality_rules_compile_to_columns(spark):
    rule = quality.Rule((("capitals", 0.2, float("inf")), ("words", float("-inf"), 5.0)))
    df = spark.createDataFrame([(0.3, 4.0), (0.2, 4.0), (0.3, 6.0)], "capitals double, words double")
    assert [r[0] for r in df.select(rule.column()).collect()] == [True, False, False]


def test_all_rules_row_by_row(spark):
    """Scores of the compiled columns equal a plain evaluation of every rule of the ensemble."""
    docs, labels = corpus(spark, 200)
    known = quality.with_statistics(docs).join(labels.select("doc_id", "quality").withColumnRenamed("doc_id", "key"), "key")
    ensemble = quality.fit(known.withColumnRenamed("quality", "label"))
    assert ensemble.weights
    for row in quality.with_statistics(docs).withColumn("score", ensemble.score()).collect():
        total = ensemble.intercept
        for rule, weight in ensemble.weights:
            if all(low < row[name] <= high for name, low, high in rule.bounds):
                total += weight
        assert row.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    text = "Some WORDS, and 12 of them!\nA line | more | WORDS WORDS."
    got = dict(zip(quality.STATISTICS, quality.statistics(text)))
    assert (got["characters"], got["words"], got["distinct_lines"], got["longest_word"]) == (len(text), 13.0, 1.0, 6.0)
    assert got["repeated_neighbours"] == 0.0 and got["bars"] == 2 / len(text) and got["digits"] == 2 / len(text)


@pytest.mark.parametrize("classify, column", [(quality.classify, "quality"), (toxicity.classify, "toxic")])
def test_scores_without_labels_or_with_one_kind(spark, classify, column):
    docs, labels = corpus(spark, 20)
    rows = classify(docs, labels.limit(0)).collect()
    assert {r.score for r in rows} == {0.5}
    ones = labels.withColumn(column, F.lit(1))
    assert len({r.score for r in classify(docs, ones).collect()}) == 1
    assert classify(docs.limit(0), labels).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert check(rows, labels, "toxic", 5, 0, 0.5) > 0.97


def test_disguised_words_are_restored():
    plain = ["the idiot was a stupid loser and pathetic trash", "idiot stupid loser worthless clown"] * 50
    model = toxicity.CharacterModel(toxicity.count_sequences(plain, toxicity._fold_table()))
    for seen, word in (("1d10t", "idiot"), ("st*u*p*i*d", "stupid"), ("looooser", "loser"), ("tr@sh", "trash"), ("ÍD1OT", "idiot")):
        assert toxicity.is_disguised(seen) and toxicity.restore(seen, model) == word
    reader = toxicity.Reader(model)
    assert "=idiot" in reader.terms("an i d i o t here") and "=idiot" not in reader.terms("an idea here")
    assert reader.terms("") == set()


def test_long_disguised_tokens_are_read_to_their_end():
    plain = ["the idiot was a stupid loser and pathetic trash", "idiot stupid loser worthless clown"] * 50
    model = toxicity.CharacterModel(toxicity.count_sequences(plain, toxicity._fold_table()))
    for separator in "-*":
        assert toxicity.restore(separator.join("worthless" * 8 + "idiot"), model).replace(" ", "") == "worthless" * 8 + "idiot"
    assert toxicity.restore("worthless" * 12 + "1d10t", model).endswith("idiot")
    assert len(toxicity.restore("a-b" * 20_000, model).replace(" ", "")) == 40_000


def test_viterbi_equals_the_best_of_all_paths():
    import itertools

    plain = ["you are a bad moron", "the idiot was a stupid loser", "clown bill silly toll"] * 20
    model = toxicity.CharacterModel(toxicity.count_sequences(plain, toxicity._fold_table()))

    def score(letters, cost):
        total, at = -cost, (0, 0, 0)
        for letter in letters:
            symbol = toxicity.LETTERS.find(letter) + 1
            if letter == " " and at[2] == 0:
                return None
            total += model[(*at, symbol)]
            at = (at[1], at[2], symbol)
        return total + (model[(*at, 0)] if at[2] else 0.0)

    rng = random.Random(12)
    tokens = ["1d10t", "b!ll", "m0r-0n", "s!!!ly", "70ll", "-a-", "88", "xx@xx"]
    tokens += ["".join(rng.choice("abdlo0178!-@") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    for token in tokens:
        paths = itertools.product(*toxicity.lattice(toxicity.folded(token)))
        scores = [(score("".join(x for x, _ in p), sum(c for _, c in p)), "".join(x for x, _ in p)) for p in paths]
        best = max(x for x, _ in scores if x is not None)
        read = toxicity.restore(token, model)
        assert any(text == read and x is not None and abs(x - best) < 1e-5 for x, text in scores)


def test_long_words_take_linear_time(spark):
    import time

    for token in ("x" * 2_000_000, "é" * 1_000_000 + "!", "9" * 1_000_000, "ab-" * 300_000, "中" * 1_000_000, "(-" * 500_000):
        started = time.perf_counter()
        toxicity.is_disguised(token)
        assert time.perf_counter() - started < 5
    docs, labels = corpus(spark, 60)
    long = spark.createDataFrame([(900, "中" * 1_000_000), (901, "ab" * 500_000), (902, "a b " * 200_000)], "doc_id long, text string")
    rows = toxicity.classify(docs.select("doc_id", "text").unionByName(long), labels).collect()
    assert len(rows) == docs.count() + 3 and all(0.0 <= r.score <= 1.0 for r in rows)


def test_a_cache_of_few_letters_changes_nothing(monkeypatch):
    plain = ["the idiot was a stupid loser"] * 50
    model = toxicity.CharacterModel(toxicity.count_sequences(plain, toxicity._fold_table()))
    texts = ["an 1d10t and a l0ser", "st*upid " * 30, "plain words only"]
    expected = [toxicity.Reader(model).terms(t) for t in texts]
    monkeypatch.setattr(toxicity, "CACHED_LETTERS", 10)
    reader = toxicity.Reader(model)
    assert [reader.terms(t) for t in texts] == expected and reader.letters <= 10 + toxicity.CACHED_LENGTH


@pytest.mark.parametrize("text, word", [
    ("an i d ! o t here", "idiot"), ("i  d  i  o  t", "idiot"), ("i\td\ti\to\tt", "idiot"), ("$ t u p 1 d", "stupid"), ("! d i o t", "idiot"),
    ("he is b a d", "bad"), ("stu.pid", "stupid"), ("id-iot", "idiot"), ("mo*ron", "moron"), ("st_up_id", "stupid"), ("stu/pid", "stupid"),
    ("y o u m o r o n", "moron"), ("y o u   a r e   a   s t u p i d   i d i o t", "stupid"), (" ".join("worthless" * 8 + "moron"), "moron"),
])
def test_disguised_forms_reach_the_lattice(text, word):
    plain = ["you are a bad moron", "the idiot was a stupid loser and he is bad", "idiot stupid moron worthless clown you"] * 50
    model = toxicity.CharacterModel(toxicity.count_sequences(plain, toxicity._fold_table()))
    assert "=" + word in toxicity.Reader(model).terms(text)


# --- fingerprints ---------------------------------------------------------------------------


def brute_closed(words, k, s, hash_of):
    runs = [hash_of(words[i : i + s]) for i in range(len(words) - s + 1)]
    inner = k - s + 1
    return [i for i in range(len(words) - k + 1) if min(runs[i], runs[i + inner - 1]) <= min(runs[i + 1 : i + inner - 1])]


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(150)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    for k, s in ((syncmers.K, syncmers.S), (6, 2)):
        found = df.select(syncmers.anchors(F.col("text"), k, s, sample=10_000)).head()[0]
        hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
        runs = [tuple(hashes[w] for w in words[i : i + s]) for i in range(len(words) - s + 1)]
        columns = [f"c{j}" for j in range(s)]
        of_run = {tuple(r)[:s]: r.h for r in spark.createDataFrame(list(set(runs)), ", ".join(f"{c} long" for c in columns)).withColumn("h", F.xxhash64(*columns)).collect()}
        expected = brute_closed(words, k, s, lambda run: of_run[tuple(hashes[w] for w in run)])
        assert sorted(x.p for x in found) == expected
        assert len(expected) > 150 / k


def brute_likeness(one, other):
    """The likeness from two returned fingerprints, in plain Python."""
    def signed(h):
        value = int(h, 16)
        return value - (1 << 64) if value >> 63 else value

    a, b = ({signed(h): int(p, 16) for h, p in (x.split("@") for x in f.split(" ") if x)} for f in (one, other))
    if not a and not b:
        return 1.0
    if not a.keys() & b.keys():
        return 0.0
    union = sorted(a.keys() | b.keys())[: syncmers.SAMPLE]
    shifts = sorted(a[h] - b[h] for h in a.keys() & b.keys() if h <= union[-1])
    middle = shifts[len(shifts) // 2] if shifts else 0
    return sum(abs(d - middle) <= syncmers.SLACK for d in shifts) / len(union)


def test_edited_fingerprints(spark):
    rng = random.Random(2)
    texts = {i * 7: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(60, 400))) for i in range(120)}
    texts |= {841: None, 842: "", 843: "kurz", 844: "é" * 900, 845: texts[7], 10**15: "the last one " * 3}
    rows = [(i, t, "x", "y") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, fp string")
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(df.repartition(4), block_rows=16).collect()}
    import hashlib

    ids = sorted(texts)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, nxt, r = texts[i] or "", texts[after] or "", got[i]
        moved = len(text) // 4
        edited = text[: len(text) - moved] + nxt[:moved]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0.0 <= r.near_edited <= 1.0 and 0.0 <= r.near_next <= 1.0
        if len(text) > 300 and i < 800:
            assert r.near_edited > 0.3 and r.near_next < 0.2
    assert got[845].fingerprint == got[7].fingerprint != got[14].fingerprint
    assert got[841].near_edited == 1.0 and got[841].fingerprint == ""
    assert syncmers.edited_fingerprints(df.limit(0)).count() == 0
    one = syncmers.edited_fingerprints(df.where("doc_id = 7")).head()
    assert one.n_chars == len(texts[7]) and one.near_next == 1.0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d")], "doc_id long, text string")
    assert syncmers.edited_fingerprints(twice).count() == 3


def test_likeness_is_that_of_the_returned_fingerprints(spark):
    rng = random.Random(4)

    def text(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    texts = [text(rng.choice([1, 2, 3, 5, 9, 42, 44, 50, 300])) for _ in range(80)]
    texts = [" ".join((texts[i - 1].split() + t.split())) if i % 3 == 0 else t for i, t in enumerate(texts)]
    # The edited form of the first is the text of another row, on either side of former limits.
    moved = len(texts[5]) // 4
    texts.append(texts[5][: len(texts[5]) - moved] + texts[6][:moved])
    texts += ["", "x" * 5000, "x" * 3000 + "y" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(syncmers.edited_fingerprints(df, block_rows=8).collect())
    for r, after in zip(got, got[1:] + got[:1]):
        assert r.near_edited == pytest.approx(brute_likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(brute_likeness(r.fingerprint, after.fingerprint))
    assert got[5].edited_fingerprint == got[80].fingerprint


def test_blocks_follow_the_rows_not_the_ids(spark):
    rng = random.Random(9)
    ids = [*range(3000), 10**15, -(2**63), 2**63 - 1, *(10**12 + rng.randrange(500) for _ in range(700))]
    rows = [(i, str(i)) for i in set(ids)] + [(None, f"null {i}") for i in range(900)] + [(5, f"five {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "key long, text string").withColumn("digest", F.xxhash64("text"))
    placed, names, width = syncmers._in_blocks(df, 16)
    assert names == ["block", "part"] and syncmers._in_blocks(df, 10_000)[1] == ["block"]
    blocks = placed.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r.n for r in blocks) <= 128 and sum(r.n for r in blocks) == len(rows)
    ordered = placed.orderBy(F.col("key").asc_nulls_first(), "digest").select("block", "part").collect()
    seen = [k for k, _ in __import__("itertools").groupby(tuple(r) for r in ordered)]
    assert len(seen) == len(set(seen)) == len(blocks)
    links = {tuple(r.here): tuple(r.following) for r in syncmers._block_links(placed.select(*names).distinct(), names, width).collect()}
    assert links == dict(zip(seen, seen[1:] + seen[:1]))
    out = syncmers.edited_fingerprints(df.select(F.col("key").alias("doc_id"), "text"), block_rows=16)
    assert out.count() == len(rows)


# --- archives -------------------------------------------------------------------------------


def test_records_round_trip(spark):
    import hashlib

    page = "<html>" + "x" * 200 + "</html>"
    rows = [(5, "http://a/\r\nb", page), (3, None, page), (9, "http://c", "ü" * 60), (8, "d", "ü" * 60), (1, "e", "short"),
            (2, "f", "short"), (7, "g", None), (6, "h", ""), (4, "i", "\r\n\r\nWARC/1.1\r\n" * 50), (11, "j", "z" * 400_000)]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "page_id long, url string, html string, file string, offset long")
    got = {r.page_id: r for r in warc.round_trip(df.repartition(3)).collect()}
    assert len(got) == len(rows)
    firsts = {}
    for i, _, html in sorted(rows):
        firsts.setdefault(html or "", i)
    for i, _, html in rows:
        raw, r = (html or "").encode(), got[i]
        first = firsts[html or ""] if len(raw) >= 100 else i
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if first != i else ("response", None))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_index_selects_and_ids_may_be_missing(spark):
    rows = [(i, f"http://p/{i}", f"page {i} " * 40) for i in range(50)] + [(None, "n", "nobody " * 40), (3, "http://p/3", "page 3 " * 40)]
    folder = scratch_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    chosen = warc.read_records(index.where("page_id % 10 = 3 or page_id is null"), folder).collect()
    assert sorted((r.page_id if r.page_id is not None else -1, r.record_type) for r in chosen) == [
        (-1, "response"), (3, "response"), (3, "response"), *[(i, "response") for i in (13, 23, 33, 43)]]
    assert {r.url for r in chosen if r.page_id == 13} == {"http://p/13"}


def test_reads_are_coalesced_over_small_gaps():
    ranges = [(0, 10), (12, 10), (100, 5), (105, 5), (1000, 50)]
    assert warc.coalesced(ranges, gap=10, most=1000) == [[0, 1], [2, 3], [4]]
    assert warc.coalesced(ranges, gap=100, most=60) == [[0, 1], [2, 3], [4]]
    assert warc.coalesced(ranges, gap=5000, most=5000) == [[0, 1, 2, 3, 4]]
