"""Encoding by folds against the library, over words of every kind, and exact round trips."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from sievegrid.llm import bpe_fold
from tests.llm import corpus

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def wanted(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def texts():
    rng = random.Random(11)
    letters = "abcdeéßñ漢字仮名абв123  \n\t.,!?'-_\u00a0\u3000\u0870\U0001ccf0\U00010570😀\u0000"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    made += ["x" * n for n in (2, 511, 512, 513, 700)] + ["".join(rng.choice("acgt") for _ in range(n)) for n in (500, 600, 3000)]
    made += [" " * 600 + "a", "\n" * 514, "漢" * 400 + " b " + "字" * 171, "it's we'll 'S 're", "<|endoftext|> a", None, "", " ", "a"]
    return made


def test_encoding_equals_the_library(spark):
    made = texts()
    rows = [(i, t, "clash", [1]) for i, t in enumerate(made)] + [(0, made[0], "clash", [1]), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids array<int>")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_fold.round_trip(docs, PATH).collect())
    assert got == Counter((r[0], *wanted(r[1])) for r in rows)


def test_awkward_corpus_and_empty_table(spark):
    docs = spark.createDataFrame(corpus.rows(), corpus.SCHEMA)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_fold.round_trip(docs, PATH).collect())
    assert got == Counter((r[0], *wanted(r[1])) for r in corpus.rows())
    assert bpe_fold.round_trip(docs.limit(0), PATH).count() == 0


def test_a_megabyte_in_one_word_and_in_many(spark):
    rng = random.Random(4)
    made = ["ab" * 600_000, " ".join("".join(rng.choice("etaoin") for _ in range(6)) for _ in range(180_000))]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_fold.round_trip(docs, PATH).collect()} == set(map(wanted, made))


def test_heap_merges_like_the_library():
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice("abcdé漢 ") for _ in range(rng.randrange(1, 200))).encode()
        assert bpe_fold.merged(word, RANKS) == LIBRARY._encode_single_piece(word)


def test_ids_out_of_the_vocabulary_decode_to_null(spark):
    vocabulary = bpe_fold.Vocabulary(spark, PATH)
    rows = spark.createDataFrame([(1, [0, 1]), (2, [-1]), (3, [10**6]), (4, []), (5, None)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe_fold.decoded(rows, vocabulary).collect()}
    assert got[2] is None and got[3] is None and got[5] is None
    assert bytes(got[1]) == LIBRARY.decode_bytes([0, 1]) and bytes(got[4]) == b""


def test_every_pair_has_its_slot():
    pairs = bpe_fold.pair_ranks(RANKS)
    cells, moves = bpe_fold.in_slots(pairs)
    assert sorted(c for c in cells.tolist() if c >= 0) == sorted((a << 2 * bpe_fold.ID_BITS) | (b << bpe_fold.ID_BITS) | r for (a, b), r in pairs.items())


def test_folds_equal_the_heap(spark):
    vocabulary, rng = bpe_fold.Vocabulary(spark, PATH), random.Random(5)
    words = ["".join(rng.choice("abcdetonéß漢 仮") for _ in range(rng.randrange(1, 30))) for _ in range(400)] + ["x" * 300, "a"]
    rows = spark.createDataFrame([(w,) for w in words], "word string").withColumn("t", vocabulary.merges)
    made = rows.select("word", bpe_fold.let(F.col("t"), lambda t: bpe_fold.folded(t, F.col("word"))).alias("ids")).collect()
    assert all(list(r.ids) == bpe_fold.merged(r.word.encode(), RANKS) == LIBRARY._encode_single_piece(r.word) for r in made)


@pytest.mark.parametrize("cut", [0, 40])
def test_what_table_and_cache_hold_changes_nothing(spark, monkeypatch, cut):
    monkeypatch.setattr(bpe_fold, "FREQUENT", cut or 1)
    monkeypatch.setattr(bpe_fold, "SUMMARY", 30)
    monkeypatch.setattr(bpe_fold, "CACHE_BYTES", 3000)
    docs = spark.createDataFrame(corpus.rows(), corpus.SCHEMA)
    vocabulary = bpe_fold.Vocabulary(spark, PATH)
    assert len(bpe_fold.frequent_words(vocabulary, docs.select("text"))) <= max(cut, 1)
    made = bpe_fold.decoded(bpe_fold.encoded(docs, vocabulary), vocabulary).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in made) == Counter((r[0], tuple(LIBRARY.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in corpus.rows())


def test_words_of_every_code_point():
    find = regex.compile(bpe_fold.split_pattern()).findall
    codec = bpe_fold.Codec(RANKS, {})
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}1{chr(code)}{chr(code)} {chr(code)}!"
            assert "".join(find(text)) == text
            if code % 7 == 0 or code < 0x3100:
                assert codec.encode(text).tolist() == LIBRARY.encode_ordinary(text), hex(code)


@pytest.mark.parametrize("name", ["L", "N"])
def test_character_classes_equal_the_library(name):
    mine = regex.compile(rf"(?V1)[\p{{{name}}}--[{bpe_fold.NEWER}]]")
    library = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    assert all(bool(mine.fullmatch(chr(c))) == bool(library.encode_ordinary(chr(c))) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
