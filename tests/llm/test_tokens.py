import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tandem.llm import bpe, packing

TEXTS = [
    None, "", " ", "a", "Hello,  world!\n\n it's 12345 o'clock", "ein Straßenbahnwagen\tfährt", "中文没有空格的文本",
    "x" * 3000, " 　\x85 odd\x1cspace \xa0", "ab" * 700 + " cd " * 50, "the the the", "the the the",
]


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(pairs):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def documents(spark, texts, extra=", key string, part long"):
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


def test_encoding_equals_the_library(pairs, reference):
    rng = random.Random(5)
    made = ["".join(rng.choice("ab etr 1\n\t'sé中\xa0.,") for _ in range(rng.randrange(80))) for _ in range(2000)]
    long_runs = ["".join(rng.choice("abeht") for _ in range(rng.randrange(50, 500))) for _ in range(60)]
    for text in [*filter(None, TEXTS), *made, *long_runs]:
        ids = np.frombuffer(pairs.packed(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text)
        assert pairs.decoded(ids) == text.encode()


def test_joining_halves_is_the_encoding_of_the_whole(pairs):
    rng = random.Random(6)
    for _ in range(400):
        whole = "".join(rng.choice("aehnrst") for _ in range(rng.randrange(2, 60))).encode()
        cut = rng.randrange(1, len(whole))
        assert pairs.joined(pairs.merged(whole[:cut]), pairs.merged(whole[cut:])) == pairs.merged(whole)


def test_round_trip_query(spark, pairs, reference):
    got = {r.doc_id: r for r in bpe.round_trip(documents(spark, TEXTS), pairs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(documents(spark, []), pairs).count() == 0


def test_ids_and_bytes_as_columns(spark, pairs):
    out = bpe.decode(bpe.encode(documents(spark, TEXTS), pairs), pairs).collect()
    assert {r.doc_id: bytes(r.decoded) for r in out} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_windows_hold_every_id_once_and_are_full():
    rng = random.Random(7)
    for _ in range(60):
        lengths = [rng.randrange(1, 2049) for _ in range(rng.randrange(0, 200))]
        windows = packing.pack(lengths)
        seen = {}
        for window in windows:
            for item, start, n in window:
                seen.setdefault(item, []).append((start, n))
        for item, length in enumerate(lengths):
            at = 0
            for start, n in sorted(seen[item]):
                assert start == at and n > 0
                at += n
            assert at == length
        sizes = [sum(n for *_, n in w) for w in windows]
        assert sum(s not in packing.TIERS for s in sizes) <= 1


def test_steps_hold_equal_budgets():
    sizes = [2048] * 5 + [1024] * 7 + [256] * 9
    budgets = {}
    for size, step in zip(sizes, packing.steps(sizes, 4096)):
        budgets[step] = budgets.get(step, 0) + size
    assert sorted(budgets.values())[1:] == [4096] * (len(budgets) - 1)


def test_word_ids_equal_the_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(8)
    alphabet = "abcdeèéÜß'sS.,!?0123 \t\n中İΣ\xa0-_<>|`~@x\x1cć"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["don't we'll 's 'S x'LL", "é" * 100 + " " + "a" * 500, "<|endoftext|><|endoftext|>x", "the " * 50 + "cat sat on mats"]
    tokens = packing.WordTokens(packing.read_tokenizer(path))
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for room in (packing.CACHED_WORDS, 40):  # with a cache that has to be emptied, too
        monkeypatch.setattr(packing, "CACHED_WORDS", room)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in tokens.packed(texts)] == expected


def test_packed_pieces(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = TEXTS + ["word " * 5000, "Ünïcode İΣ, 中! x's don't", "say <|endoftext|> now", "a<|startoftext|>b<|endoftext|>"]
    expected = {
        i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(texts)
    }
    tokens = packing.read_tokenizer(path)
    rows = packing.pack_documents(documents(spark, texts), tokens, group_documents=5, with_ids=True).collect()
    covered = {}
    for r in rows:
        piece = expected[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(expected[r.doc_id])
        assert bytes(r.ids) == piece.tobytes()
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, ids in expected.items():
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at
            at += length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.window))
    for pieces in sequences.values():
        at = 0
        for offset, length, window in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window <= 2048
    assert packing.pack_documents(documents(spark, []), tokens).count() == 0
