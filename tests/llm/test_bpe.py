"""The splitter here gives the library's pre-tokens for every code point that it is trusted with."""

import public_tokenizers

from sievegrid.llm.bpe import PreTokens


def test_pre_tokens_of_every_code_point():
    pre = PreTokens(public_tokenizers.path("byte_bpe_50k.json"))
    split = pre.library.pre_tokenizer.pre_tokenize_str
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        text = f"a{c}1{c}{c} {c}!"
        if pre.plain(text):
            assert pre.split(text) == [text[a:b] for _, (a, b) in split(text)], hex(code)


def test_contractions_and_spaces():
    pre = PreTokens(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("it's  we'll\n\n x  \t y'd'S ", " ", "  a", "\u00a0\u2003 b \x1c\x85c", "x" * 300, "12 3a b4'", "".join(map(chr, range(1, 0x557)))):
        assert pre.ids(text) == b"".join(i.to_bytes(4, "little") for i in pre.whole(text))


def test_words_between_spaces():
    import random

    pre, rng = PreTokens(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    pieces = ["a", "don't", "'s", "12", "x1", "!", " ", "  ", "\n", "\t", "é", "\u00a0", "\u3000", ".", "_", "word", " ", " "]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pre.ids(text) == b"".join(i.to_bytes(4, "little") for i in pre.whole(text)), repr(text)


def test_letters_are_letters_of_the_split_pattern():
    pre = PreTokens(public_tokenizers.path("byte_bpe_50k.json"))
    for c in map(chr, range(0x110000)):
        if c.isalpha() and pre.plain(c):
            assert pre.split(f"a{c}{c}") == [f"a{c}{c}"], hex(ord(c))


def test_words_with_marks():
    import random
    import string

    pre, rng = PreTokens(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    letters = ["dog", "Zürich", "s", "d", "ll", "ß", "naïve", "мир", "日本", "ªº", "x1", "'", "\n", "9", "€"]
    for _ in range(4000):
        words = ("".join(rng.choice(letters) for _ in range(rng.randrange(3))) + "".join(rng.choice(string.punctuation) for _ in range(rng.randrange(4))) for _ in range(5))
        text = " ".join(words)
        assert pre.ids(text) == b"".join(i.to_bytes(4, "little") for i in pre.whole(text)), repr(text)


def test_words_met_once_are_held_once():
    pre = PreTokens(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(3)) for n in range(1000)]
    text = " " + " ".join(w + "," for w in words)
    once = pre.ids(text)
    assert len(pre.words) + len(pre.cache) <= len(words) + 1
    assert pre.ids(text) == pre.ids(text) == once == b"".join(i.to_bytes(4, "little") for i in pre.whole(text))
    assert all(w + "," in pre.words for w in words)
