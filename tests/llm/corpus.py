"""A small table of documents with awkward rows, made from a seed."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, rank int, size string"
WORDS = [f"{a}{b}" for a in ("tor", "men", "al", "vi", "sen", "ka", "lo") for b in ("a", "en", "is", "ut", "ow", "er", "ing", "oth")]


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) for _ in range(n)]
    return "".join(w + (".\n" if i % 11 == 10 else " ") for i, w in enumerate(words)).strip()


def near(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def rows(seed: int = 3, n: int = 60, near_group: int = 25, copies: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.choice([3, 4, 5, 6, 40, 80, 200])) for _ in range(n)]
    base = prose(rng, 160)
    texts += [near(rng, base, rng.choice([1, 2, 4, 6, 8])) for _ in range(near_group)]
    texts += [base.upper()] * copies
    texts += [None, "", "   \n\t ", "a", "ab", "a b c", "É ü ß ñ 漢字 emoji 😀 <|endoftext|> tail", "x" * 5000, ("long words here again " * 150).strip(), "A\x00b \x1c c\u00a0d\u2003e"]
    out = []
    for i, t in enumerate(texts):
        lang = rng.choice(["en", "de", None])
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b.org", None, "é"])
        out.append((i * 7 + 1, t, lang, source, len(t or ""), "clash", i % 2, i, "s"))
    out += [(out[5][0], *out[5][1:]), (None, "no id here at all today", "en", "a", 5, None, None, None, None), (-4, None, None, None, None, None, None, None, None)]
    return out
