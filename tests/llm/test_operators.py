"""Each operator against a brute-force version, over awkward rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievegrid.llm import fingerprints, language_id, mixing, near_dup, packing, quality, quality_rules, sharding, token_counts, url_rules
from sievegrid.sources.scratch import materialize
from tests.llm import corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = corpus.rows()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(ROWS, corpus.SCHEMA), "fixture")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    marked = [(r[0], int(len(r[1] or "") > 300), 0) for r in ROWS if r[0] is not None]
    return spark.createDataFrame([*marked, *marked[:3], (marked[0][0], None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def ids_of():
    library = Tokenizer.from_file(PATH)
    return [library.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS]


def test_token_counts(docs, empty):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, PATH).collect())
    want = Counter((r[0], len((r[1] or "").encode()), len(i), len(i) > 512) for r, i in zip(ROWS, ids_of(), strict=True))
    assert got == want
    assert token_counts.token_counts(empty, PATH).count() == 0


@pytest.mark.parametrize("size", [16, 1024])
def test_packing(docs, empty, size):
    rows = packing.pack(docs, PATH, size).collect()
    want = Counter()
    for r, ids in zip(ROWS, ids_of(), strict=True):
        ids = [*ids, 2]
        cuts = [0] if len(ids) <= size else sorted({0, *range(len(ids) % size, len(ids), size)})
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want[r[0], k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) <= sum(r.length for r in rows) / size * 1.15 + 2
    assert packing.pack(empty, PATH, size).count() == 0


def test_packing_plan_replaces_the_smallest_by_two():
    # greedy: 6 + 3 leaves 1; 2 + 2 fill what 3 gives back
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)
    counts = {k: 37 * k % 91 + 1 for k in range(1, 65)}
    made = packing.plan(counts, 64)
    used = Counter()
    for lengths, times in made:
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert used == counts


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 7).collect()
    assert len(rows) == len(ROWS)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    text = {r[0]: r[1] or "" for r in ROWS}
    together = defaultdict(set)
    slots = defaultdict(list)
    for r in rows:
        together[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(x) == 1 for x in together.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(empty).count() == 0


def loads_of(counts, shards):
    """Loads of a schedule, from the shard of each rank."""
    loads = Counter()
    for size, turns in sharding.schedule(counts, shards).items():
        assert turns[0][0] == 0
        for rank in range(counts[size]):
            first, order = next(t for t in reversed(turns) if t[0] <= rank)
            loads[order[(rank - first) % len(order)]] += size
    return loads


def test_schedule_is_longest_first():
    import heapq

    assert sorted(loads_of({5: 1, 4: 1, 3: 3}, 2).values()) == [8, 10]
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.choice([3, 10, 100, 1000]) * rng.randrange(1, 40): rng.choice([1, 1, 2, 7, 90]) for _ in range(rng.randrange(1, 40))}
        shards = rng.choice([1, 2, 5, 40])
        heap = [0] * shards
        for size in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            heapq.heapreplace(heap, heap[0] + size)
        made = loads_of(counts, shards)
        assert sorted(heap) == sorted(made.get(s, 0) for s in range(shards))
    # many alike behind one that is very large: no step for each group
    many = sharding.schedule({10**12: 1, 7: 10**9}, 40)
    assert len(many[7]) < 100


def test_sharding_balances_small_and_hot_groups(spark):
    rng = random.Random(5)
    texts = ["hot " * 50] * 900 + [corpus.prose(rng, rng.choice([1, 2, 3, 20, 60])) for _ in range(2000)] + [None, ""]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 11).collect()
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 16
    loads, want = Counter(), loads_of(Counter(groups.values()), 11)
    for r in rows:
        loads[r.shard] += r.size
    assert sorted(loads.values()) == sorted(want.values())
    for t in ("hot " * 50, ""):
        assert len({r.shard for r in rows if (texts[r.doc_id] or "") == t}) == 1


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    sizes = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in ROWS)
    assert Counter((r.doc_id, r["size"]) for r in rows) == sizes
    source = {(r[0], len(WORD.findall(r[1] or ""))): r[3] for r in ROWS}
    total, taken, goal = Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id, r["size"]]
        total[s] += r["size"]
        taken[s] += r.taken
        goal[s] = r.target
        assert r.taken in ((0, r["size"], 2 * r["size"]) if r["size"] else (0,))
    for r in rows:
        assert r.source_size == total[source[r.doc_id, r["size"]]]
    assert sum(goal.values()) == pytest.approx(min(1.5, 2) * sum(total.values()))
    for s, t in goal.items():
        assert t <= 2 * total[s] + 1e-6
        assert abs(taken[s] - t) <= max(0.02 * t, 30), (s, taken[s], t)
    assert sorted(mixing.mix(docs).collect(), key=str) == sorted(rows, key=str)
    drawn = Counter(r.doc_id for r in mixing.drawn(docs).collect())
    assert drawn == Counter({k: n for k, n in Counter(i for r in rows for i in [r.doc_id] * (r.taken // max(r["size"], 1))).items() if n})
    assert mixing.drawn(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_mixing_counts_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(None if i % 6 else i, corpus.prose(rng, 15), "a" if i % 2 else "b", "clash", i) for i in range(60)]
    rows += [(7, "the same row of seven words here", "c", "clash", k) for k in range(40)] + [(None, "x y", None, "", 0), (None, None, None, "", 0), (1, "", "a", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, cut long")
    made = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in made) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    all_ = Counter()
    for r in rows:
        all_[r[2]] += len((r[1] or "").split())
    goal, taken, drawn = mixing.targets(list(all_.items())), Counter(), Counter()
    of = {(n, goal[s]): s for s, n in all_.items()}
    for r in made:
        taken[of[r.source_size, r.target]] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    picked = mixing.drawn(docs)
    assert picked.columns == docs.columns
    known = Counter(rows)
    for r, n in Counter(tuple(x) for x in picked.collect()).items():
        assert r in known
        drawn[r[2]] += n * len(r[1].split())
    assert drawn == +taken
    for s, t in goal.items():
        assert abs(taken[s] - t) <= 15, (s, taken[s], t)


def test_targets_reshare_what_is_above():
    got = mixing.targets([("a", 10), ("b", 100), ("c", 100), (None, 5)])
    assert got["a"] == 20 and got[None] == 10
    assert got["b"] + got["c"] == pytest.approx(1.5 * 215 - 30)
    assert got["c"] == pytest.approx(2 * got["b"]) or got["c"] == 200


def test_fit_is_exact_where_sums_allow():
    counts = {3: 5, 7: 4, 50: 10, 1: 1}
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    for budget in range(0, 560, 13):
        took = mixing.fit(counts, budget)
        assert all(0 <= took.get(x, 0) <= n for x, n in counts.items())
        assert sum(x * n for x, n in took.items()) == max(s for s in sums if s <= budget)
    many = {x: 1000 for x in range(5, 400)}
    assert sum(x * n for x, n in mixing.fit(many, 1_234_567).items()) == 1_234_567


def naive_measure(text):
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_fit_looks_over_the_whole_budget_where_lengths_are_long():
    made = lambda counts, budget: sum(x * n for x, n in mixing.fit(counts, budget).items())
    assert made({30000: 1, 16000: 1, 2000: 1}, 17000) == 16000
    assert made({300000: 1, 160000: 1, 20000: 1}, 170000) == 160000
    assert made({300001: 1, 160003: 1, 20000: 1}, 170000) == 160003
    rng = random.Random(1)
    for _ in range(20):
        counts = {rng.randrange(1000, 400_000): rng.choice([1, 1, 2]) for _ in range(6)}
        budget = rng.randrange(sum(x * n for x, n in counts.items()))
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        taken = mixing.fit(counts, budget)
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= budget)
        assert all(0 <= n <= counts[x] for x, n in taken.items())


def test_quality_rules(docs, empty):
    rows = quality_rules.judge(docs).collect()
    want = Counter()
    for r in ROWS:
        m = naive_measure(r[1] or "")
        want[r[0], *m, m[0] < 50 or 100 * m[4] > 50 * m[0]] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept for r in rows if r.base_failed)
    plain = [r for r in rows if not r.base_failed and r.doc_id and r.doc_id < 60 * 7]
    assert sum(r.kept for r in plain) >= 0.95 * len(plain)
    assert quality_rules.judge(empty).count() == 0


def naive_bounds(measures, pairs):
    """Whether each of ``measures`` passes the bounds, with exact quantiles; and the bounds of pairs, languages and corpus."""
    import math

    ratios = {"word_length": (1, 0), "symbol_ratio": (2, 1), "dup_line_ratio": (3, 0), "repeat_ratio": (4, 0)}
    passed = [i for i, m in enumerate(measures) if not (m[0] < 50 or 100 * m[4] > 50 * m[0])]
    ratio = lambda m, part, whole: m[part] / m[whole] if m[whole] and (part == 1 or m[part] >= 16) else 0.0
    stepped = lambda x: 1.02 ** (math.floor(math.log(x) / math.log(1.02)) + 1) if x else 0.0
    quantile = lambda xs, k: xs[max(0, -(-k * len(xs) // 100) - 1)]

    def bound(rows, part, whole):
        xs = sorted(stepped(ratio(measures[i], part, whole)) for i in rows)
        told = [x for x in xs if x]
        if 2 * (len(xs) - len(told)) >= len(xs):
            if not told:
                return 0, 0
            walk, low, n = [0.0, *(quantile(told, k) for k in range(1, 100))], 0, len(told)
        else:
            walk, n = [quantile(xs, k) for k in range(50, 100)], len(xs)
            low = max(walk[0] - quantile(xs, 25), walk[0] * (1.02**2 - 1))
        gaps = [y - x for x, y in zip(walk, walk[1:], strict=False)]
        for x, gap in zip(walk, gaps, strict=False):
            if 3 * gap >= max(gaps) and gap > 3 * max(x - walk[0], low):
                return x + gap / 3, n
        return walk[0] + 3 * max(walk[-1] - walk[0], low), n

    made = {}
    for name, (part, whole) in ratios.items():
        of_all, n_all = bound(passed, part, whole)
        if not n_all:  # nothing tells: no row can pass the bound
            of_all = math.inf
        else:
            of_all *= 1 + 20 / n_all
        shrunk = lambda b, under: under if not b[1] else (b[1] * b[0] + 200 * under) / (b[1] + 200)
        for lang, source in {pairs[i] for i in passed}:
            of_lang = [i for i in passed if pairs[i][0] == lang]
            of_pair = [i for i in of_lang if pairs[i][1] == source]
            lang_bound = shrunk(bound(of_lang, part, whole), of_all)
            made[name, lang, source] = min(shrunk(bound(of_pair, part, whole), lang_bound), 2 * lang_bound), lang_bound
    fits = lambda i, k: all(ratio(measures[i], *ratios[n]) <= made[n, *pairs[i]][k] for n in ratios)
    return [i in set(passed) and fits(i, 0) for i in range(len(measures))], [i in set(passed) and fits(i, 1) for i in range(len(measures))], made


def test_quality_rules_bounds_are_those_of_exact_quantiles(spark):
    rng, rows = random.Random(21), []
    for source in ("a", "b", "long", None):
        for i in range(150 if source == "b" else 70):
            words = corpus.prose(rng, rng.choice([60, 90, 150])).split(" ")
            if source == "long":
                words = [w * 2 if rng.random() < 0.7 else w for w in words]
            every = rng.choice([2, 3, 4, 9, 30]) if source != "b" else 200
            text = " ".join(f"{w} #" if k % every == 1 else w for k, w in enumerate(words))
            if i % 9 == 0:
                text += "\n" + "\n".join(["one line that is there again"] * rng.choice([1, 2, 3]))
            rows.append((len(rows), text, "en" if i % 4 else None, source, "clash"))
    between = None  # a text between the bound of its pair and that of its language, which it moves itself
    for _ in range(9):
        tried = [*rows, *([between] if between else [])]
        bounds = naive_bounds([naive_measure(r[1]) for r in tried], [(r[2], r[3]) for r in tried])[2]
        (_, lang, source), (most, of_language) = max(((k, v) for k, v in bounds.items() if k[0] == "symbol_ratio"), key=lambda x: abs(x[1][0] - x[1][1]))
        words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(3000)]
        words[0] += "#" * round(9000 * (most + of_language) / 2)
        between = (len(rows), " ".join(words), lang, source, "clash")
    rows.append(between)
    rows += [(1000, "w" * 30 + " word" * 200, "en", "a", ""), (1001, None, None, None, None), (1002, "", "xx", "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n string")
    measures, pairs = [naive_measure(r[1] or "") for r in rows], [(r[2], r[3]) for r in rows]
    kept, by_language, made = naive_bounds(measures, pairs)
    limits = {(r.lang, r.source): r for r in quality_rules.thresholds(materialize(quality_rules.measured(docs), "m")).collect()}
    for (name, lang, source), (most, _) in made.items():
        found = limits[lang, source][f"most_{name}"]
        assert (float("inf") if found is None else found) == pytest.approx(most), (name, lang, source)
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()} == {r[0]: k for r, k in zip(rows, kept, strict=True)}
    assert sum(a != b for a, b in zip(kept, by_language, strict=True)) == 1  # the bound of the pair changes its verdict


def test_quality_rules_move_with_a_source_and_agree_on_reruns(spark):
    rng = random.Random(12)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(100)) for _ in range(1500)]
    marked = lambda text, n: "#" * n + text[n:]  # noqa: E731  of the same length

    def verdicts(usual):
        rows = [(i, marked(t, usual[i % len(usual)] if i < 700 else 60 if i < 800 else 0), "en", "a" if i < 700 else "b") for i, t in enumerate(lines)]
        rows.append((9999, marked(lines[0], 40), "en", "a"))
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        first, second = ({tuple(r) for r in quality_rules.thresholds(materialize(quality_rules.measured(docs.repartition(n)), "m")).collect()} for n in (3, 7))
        assert first == second
        return {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}

    rare, common = verdicts([0, 0, 0, 1, 2]), verdicts([18, 20, 25, 30, 36])
    assert not rare[9999] and common[9999]
    assert sum(rare.values()) == 1400 and not any(rare[i] for i in range(700, 800))


def test_quality_rules_tell_junk_from_a_natural_difference(spark):
    rng, rows, kinds = random.Random(8), [], {}
    symbols = lambda t, every: " ".join(f"{w} |" if i % every == 0 else w for i, w in enumerate(t.split(" ")))
    for source in ("clean", "other", "natural", "third", "junk", "small"):
        for i in range(20 if source == "small" else 300):
            text = corpus.prose(rng, rng.choice([80, 200, 400]))
            junk = source in ("junk", "small") or source == "third" and i % 3 == 0
            if source == "natural":  # longer words, and some symbols in every text
                text = symbols("".join(c * 2 if c in "aeiou" else c for c in text), 17)
            kinds[len(rows)] = source, junk
            rows.append((len(rows), symbols(text, rng.choice([2, 3])) if junk else text, "en", source))
    made = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept, all_ = Counter(kinds[r.doc_id] for r in made if r.kept), Counter(kinds[r.doc_id] for r in made if not r.base_failed)
    for kind, n in all_.items():
        assert kept[kind] <= 0.02 * n if kind[1] else kept[kind] >= 0.98 * n, (kind, kept[kind], n)
    assert len(all_) == 7


def naive_parse(text):
    """All names of a text's parse, symbol by symbol."""
    mask, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        return x ^ (x >> 32)

    def toss(values):
        out = []
        for i, v in enumerate(values):
            left = values[i - 1] if i else None
            bit = 0 if left is None else ((v ^ left) & -(v ^ left)).bit_length() - 1
            out.append(2 * bit + (v >> bit & 1))
        return out

    names, found = [mixed((ord(c) + odd) & mask) for c in text], set()
    while names:
        runs = []
        for v in names:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        names = [v if n == 1 else mixed(v ^ (n * odd & mask)) for v, n in runs]
        label = names
        for _ in range(4):
            label = toss(label)
        begins = [0] + [i for i in range(2, len(names) - 1) if label[i] < label[i - 1] and label[i] < label[i + 1]]
        parts = [names[a:b] for a, b in zip(begins, [*begins[1:], len(names)], strict=True)]
        names = [mixed((sum(v * pow(odd, k & 63, 1 << 64) for k, v in enumerate(p)) & mask) ^ (len(p) * odd & mask)) for p in parts]
        found |= {v >> 32 for v in names}
        if len(names) == 1:
            break
    return sorted(found)[:64]


def naive_likeness(a, b):
    least = sorted({*a, *b})[:64]
    return sum(x in a and x in b for x in least) / len(least) if a and b else float(a == b)


@pytest.mark.parametrize("ranges", [None, 1, 500])
def test_fingerprints(docs, empty, ranges):
    import xxhash

    def tie(t):
        h = xxhash.xxh64_intdigest(t.encode(), seed=42)
        return (h - (1 << 64) if h >> 63 else h) >> 1

    rows = fingerprints.fingerprints(docs, ranges).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1] or "")))
    text = [r[1] or "" for r in order]
    hex_ = lambda names: b"".join(x.to_bytes(4, "big") for x in names).hex()
    want = Counter()
    for i, t in enumerate(text):
        n, after = len(t) // 4, text[(i + 1) % len(text)]
        edited = t[: len(t) - n] + after[:n]
        own, other, nxt = naive_parse(t), naive_parse(edited), naive_parse(after)
        want[order[i][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), hex_(own), hex_(other), naive_likeness(own, other), naive_likeness(own, nxt)] += 1
    assert Counter(tuple(r) for r in rows) == want
    long = [r for r in rows if r.n_chars > 400 and r.doc_id and r.doc_id < 60 * 7]
    assert min(r.near_edited for r in long) > 0.25
    assert sum(r.near_next for r in long) / len(long) < 0.3
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprints_of_rows_without_ids(spark):
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else i // 5, corpus.prose(rng, rng.choice([2, 30, 90]))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fingerprints.fingerprints(docs, 60).collect()
    assert Counter((r.doc_id, r.n_chars) for r in made) == Counter((i, len(t)) for i, t in rows)
    assert max(r["n"] for r in fingerprints.successors(docs, 60).groupBy("_sg_cell").agg(F.count("*").alias("n")).collect()) < 40


def test_interiors_agree_whatever_the_offset():


    text = corpus.prose(random.Random(5), 400)
    alone, after = fingerprints.sketches([text, "zz" + text])
    assert fingerprints.likeness(alone, after) > 0.9
    assert fingerprints.likeness(*fingerprints.sketches(["", ""])) == 1.0
    # a batch doesn't change what its texts get
    assert fingerprints.fingerprint(fingerprints.sketches(["aaa", text, "b"])[1]) == fingerprints.fingerprint(alone)


def brute_groups(rows):
    def items(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [items(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)) if r[0] is not None else None) for i, r in enumerate(rows))


@pytest.mark.parametrize("seed", [3, 8])
def test_near_dup(spark, empty, seed):
    rows = corpus.rows(seed, near_group=40)
    docs = materialize(spark.createDataFrame(rows, corpus.SCHEMA), "fixture")
    got = near_dup.groups(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns
    stay = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in kept.collect()} == stay
    assert near_dup.groups(empty).count() == 0


def test_near_dup_links_texts_of_one_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (6, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dup.groups(docs).collect()} == {(1, 1), (2, 1), (5, 1), (6, 6)}


@pytest.mark.parametrize("block", [1024, 7])
def test_crowded_regions_lose_no_link(spark, monkeypatch, block):
    """Without any link of the forest's, the blocks of crowded regions find the components of a large group."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(11)
    bases = [corpus.prose(rng, 160)]
    bases.append(corpus.near(rng, bases[0], 12))
    rows = [(i, corpus.near(rng, bases[i % 2], rng.choice([1, 2, 3, 4, 5, 6])), *[None] * 7) for i in range(150)]
    docs = materialize(spark.createDataFrame(rows, corpus.SCHEMA), "fixture")
    classes = near_dup.signed(docs).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    inside = materialize(near_dup.crowded(classes), "inside")
    alone = spark.createDataFrame([], "node long, root long")
    sets = materialize(near_dup.sets_of(inside.select("rep"), docs), "sets")
    found = near_dup.components(materialize(near_dup.across(inside, alone, sets), "links"))
    got = {r.node: r.root for r in found.collect()}
    regions, size = defaultdict(set), Counter()
    for r in near_dup.prefixes(classes, near_dup.FIRST).collect():
        regions[r.rep].add((r.tree, bytes(r.prefix)))
        size[r.tree, bytes(r.prefix)] += 1
    words = {r[0]: r[1].lower().split() for r in rows}
    items = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    want = {i: i for i in regions}
    for i in regions:
        for j in regions:
            shared = regions[i] & regions[j] if i < j else ()  # where the first one is small, the forest itself has the pair
            if shared and want[i] != want[j] and size[min(shared)] > near_dup.SMALL and 100 * len(items[i] & items[j]) >= 75 * len(items[i] | items[j]):
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert len(want) > 100 and len(set(want.values())) > 1
    assert {i: got.get(i, i) for i in want} == want
    assert {r.doc_id: r.component_id for r in near_dup.groups(docs).collect()} == {i: root for i, _, root in brute_groups(rows)}


def test_partitions_of_few_rows_hide_no_pair(spark):
    rng = random.Random(12)
    bases = [corpus.prose(rng, 120) for _ in range(3)]
    rows = [(i, corpus.near(rng, bases[i % 3], rng.choice([1, 3, 6])), *[None] * 7) for i in range(45)]
    signed = near_dup.signed(spark.createDataFrame(rows, corpus.SCHEMA))
    classes = materialize(signed.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    pairs = lambda width: {tuple(r) for r in near_dup.candidates(classes, width).collect()}
    alone = pairs(1)
    assert len(alone) > 100 and pairs(150) == alone and pairs(13) == alone


def test_no_link_of_documents_is_lost(spark):
    """Recall on the corpus, against all pairs that share a shingle."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    holders, size = defaultdict(list), {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        items = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        size[i] = len(items)
        for x in items:
            holders[x].append(i)
    shared = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    root = {i: i for i in size}
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (size[a] + size[b] - n)]
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        if low != high:
            root = {k: low if v == high else v for k, v in root.items()}
    assert len(links) > 50
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (size[i], root[i]) for i in size}


def test_neighbours_take_whole_small_regions():
    import numpy as np

    i, j = near_dup.neighbours(np.array([3, 4, 0, 3]), small=4, near=1)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(0, 1), (1, 2), (0, 2), (3, 4)}
    crowded = np.full(40, 3)
    i, j = near_dup.neighbours(crowded, small=4, near=2)
    assert set((j - i).tolist()) == {1, 2} and len(i) == 40 + 39


def test_quality(docs, empty, labels):
    rows = quality.score(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert quality.score(empty, labels).count() == 0
    none = quality.score(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns


def test_quality_scores_are_those_of_a_plain_discriminant(docs, labels):
    import numpy as np

    marked = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality in (0, 1)}
    symbols, points = set("#*$%&<>@^~=+_\\{}[]`"), set(".,;:?'\"-()")

    def statistics(text):
        kinds, lines, words = Counter(), [x for x in text.split("\n") if x and not x.isspace()], text.split()
        for c in text:
            if ord(c) >= 0x3000:
                kinds["lower"] += 1
                continue
            kind = "line_end" if c == "\n" else "space" if c in " \t\v\f\r" else "symbol" if c in symbols else "pipe" if c == "|" else "exclaim" if c == "!" else "point" if c in points else None
            kinds[kind or ("digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else "other")] += 1
        triples = list(zip(words, words[1:], words[2:], strict=False)) if len(words) > 3 else []
        return dict(kinds) | {"chars": len(text), "words": len(words), "distinct": len(set(words)), "adjacent": sum(a == b for a, b in zip(words, words[1:], strict=False)), "lines": len(lines), "dup_lines": len(lines) - len(set(lines)), "triples": len(triples) - len(set(triples))}

    rows = [(r[0], statistics(r[1] or "")) for r in ROWS]
    fold = [(s, marked[i]) for i, s in rows if i in marked and zlib.crc32(str(i).encode()) % 4 != 2]
    mean = Counter()
    for s, y in fold:
        if y == 1:
            mean.update(s)
    letters = lambda s: s.get("upper", 0) + s.get("lower", 0) + s.get("other", 0)

    def features(s):
        out = []
        for part, whole, w in quality.RATIOS:
            share = mean[part] / max(mean[whole], 1)
            out.append(np.arcsin(np.sqrt(min(1, (s.get(part, 0) + w * share) / (s[whole] + w)))))
        return np.array([*out, np.log((letters(s) + 60 * letters(mean) / max(mean["words"], 1)) / (s["words"] + 60)), np.log((s["distinct"] + 20) / (s["words"] + 20) ** 0.8)])

    x, y = np.array([features(s) for s, _ in fold]), np.array([k for _, k in fold])
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * np.diag(cov[c]) for c in (0, 1))
    floor = np.maximum(pooled, 1e-3 * pooled.max())
    density = []
    for c in (0, 1):
        sigma = 0.9 * cov[c] + 0.1 * np.diag(floor) + 1e-3 * np.diag(floor)
        inverse, (_, log_det) = np.linalg.inv(sigma), np.linalg.slogdet(sigma)
        density.append(lambda v, m=x[y == c].mean(0), i=inverse, d=log_det: -0.5 * (v - m) @ i @ (v - m) - 0.5 * d)
    share = (y.sum() + 1) / (len(y) + 2)
    got = defaultdict(list)
    for r in quality.score(docs, labels).collect():
        got[r.doc_id].append(r.score)
    want = defaultdict(list)
    for i, s in rows:
        v = features(s)
        logit = np.log(share / (1 - share)) + 0.5 * (density[1](v) - density[0](v))
        want[i].append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    assert got.keys() == want.keys()
    for i, scores in want.items():
        assert sorted(got[i]) == pytest.approx(sorted(scores), abs=1e-6), i


def test_quality_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    bad = [r for r in rows if r.quality == 0]
    assert right >= 0.97 and sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad)


def test_language(docs, empty, spark):
    rows = language_id.identify(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    by = {r[0]: r[1] for r in ROWS}
    assert all(not r.kept for r in rows if not any(map(str.isalpha, by[r.doc_id] or "")))
    assert language_id.identify(empty).count() == 0
    assert language_id.accepted(docs).columns == docs.columns


def naive_language(rows):
    """(language, posterior) of each (text, declared, host), by plain loops."""
    import math

    def buckets(text):
        d, out = (" " + text.lower() + " ").encode(), []
        for x, y, z in zip(d, d[1:], d[2:], strict=False):
            h = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) & 0xFFFFFFFF
            out.append((((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 19)
        return out

    said = [(m[1].lower() if (m := re.match(r"([A-Za-z]{2,3})(?:[^A-Za-z]|$)", d or "")) else "") for _, d, _ in rows]
    langs, n = sorted({s for s in said if s}), Counter()
    grams = [buckets(t or "") for t, _, _ in rows]
    for s, g in zip(said, grams, strict=True):
        if s:
            for x in g:
                n[s, x] += 1
    all_ = {lang: sum(v for (s, _), v in n.items() if s == lang) for lang in langs}
    logs = {lang: [math.log((n[lang, x] + 0.5) / (all_[lang] + 0.5 * 8192)) for x in range(8192)] for lang in langs}
    likely, votes = [], []
    for (t, _, _), g in zip(rows, grams, strict=True):
        worth = min(1.0, 300 / max(len(g), 1))
        ll = [worth * sum(logs[lang][x] for x in g) for lang in langs] + [-worth * len(g) * math.log(8192)]
        likely.append(ll if any(map(str.isalpha, t or "")) else None)
        votes.append(None if likely[-1] is None or max(ll) == ll[-1] > max(ll[:-1]) else ll.index(max(ll)))
    host = [h or "" for _, _, h in rows]
    end = [h.rsplit(".", 1)[1] if re.search(r"\.[^.]+$", h) else "" for h in host]
    agreed = sum(v is not None and langs[v] == s for v, s in zip(votes, said, strict=True))
    trust = min(0.99, (agreed + 1) / (sum(v is not None and s != "" for v, s in zip(votes, said, strict=True)) + 2))
    out = []
    for i, ll in enumerate(likely):
        if ll is None:
            out.append(("und", 1.0))
            continue
        rest = [(v, host[k], end[k]) for k, v in enumerate(votes) if v is not None and k != i]
        some = lambda fits: [sum(v == k for v, *at in rest if fits(*at)) for k in range(len(langs))]  # noqa: E731, B023
        of_all, of_end, of_host = some(lambda *_: True), some(lambda _, e: e == end[i]), some(lambda h, _: h == host[i])  # noqa: B023
        scores = []
        for k, lang in enumerate(langs):
            base = (of_all[k] + 1) / (len(rest) + len(langs))
            suffix = (of_end[k] + 20 * base) / (sum(of_end) + 20)
            prior = (of_host[k] + 10 * suffix) / (sum(of_host) + 10)
            told = 0 if said[i] not in langs else math.log(trust) if said[i] == lang else math.log((1 - trust) / max(len(langs) - 1, 1) + 1e-9)
            scores.append(ll[k] + math.log(prior) + told)
        scores.append(ll[-1] + math.log(1e-4) + (math.log(1 / len(langs)) if said[i] in langs else 0))
        best = scores.index(max(scores))
        out.append(([*langs, "und"][best], 1 / sum(math.exp(x - max(scores)) for x in scores)))
    return out


def test_language_posteriors(spark):
    rng = random.Random(14)
    voices = {"en": corpus.WORDS[:28], "de-DE": corpus.WORDS[20:], "FR": [w[::-1] for w in corpus.WORDS], "english": corpus.WORDS[:28], None: corpus.WORDS, "": ["zz", "qq"]}
    rows = []
    for i in range(90):
        said = rng.choice(list(voices))
        text = " ".join(rng.choice(voices[said]) for _ in range(rng.choice([1, 2, 5, 40])))
        rows.append((i, text, said if rng.random() < 0.8 else rng.choice(list(voices)), rng.choice(["a.com", "b.com", "c.org", "d", None, "a."])))
    rows += [(91, None, "en", "a.com"), (92, "", None, None), (93, "12 ...", "FR", "new.com"), (94, "x" * 2_000_000, "en", "a.com"), (94, "tora", None, None), (None, "tora mena", "en", "new.net")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"predicted": F.lit(1), "n": F.lit("clash")})
    made, want = defaultdict(list), defaultdict(list)
    for r in language_id.identify(docs).collect():
        assert r.kept == (r.predicted != "und")
        made[r.doc_id].append((r.predicted, r.confidence))
    for r, best in zip(rows, naive_language([r[1:] for r in rows]), strict=True):
        want[r[0]].append(best)
    assert {k: sorted(x[0] for x in v) for k, v in made.items()} == {k: sorted(x[0] for x in v) for k, v in want.items()}
    for k, v in want.items():
        assert sorted(x[1] for x in made[k]) == pytest.approx(sorted(x[1] for x in v), rel=1e-3), k
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, v in want.items() for x in v if x[0] != "und")


def test_language_accuracy_on_documents_and_pages(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    from pyspark.sql import functions as F

    hidden = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    rows = language_id.identify(hidden).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("doc_id % 2 = 1").collect()
    assert sum(r.predicted == r.truth for r in rows) >= 0.98 * len(rows)
    assert sum(r.kept for r in rows) >= 0.995 * len(rows)
    pages = language_id.identify_pages(spark.read.parquet(f"{base}/pages.parquet")).collect()
    assert sum(r.predicted == r.declared for r in pages) >= 0.95 * len(pages)


PAGES = [
    (1, "http://WWW.Example.com/en/x?q#f"), (2, "https://example.com/en/"), (3, "https://example.com/en"), (4, "http://a.b.example.net/fr/1"), (5, "http://example.net"), (6, None), (7, "no scheme"),
    (8, "http://com/x"), (9, "http://xcom/"), (10, "http://.com/"), (11, "a://b://c.net/es/"), (12, "http://net/es/"), (13, ""), (1, "http://WWW.Example.com/en/x?q#f"), (None, "http://m.www.example.com/en/é"),
]


def naive_judge(url, rules):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count("."), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


RULE_COLUMNS = "host string, path string, verdict string"


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_url_rules(spark, ranges):
    rules = [*url_rules.RULES, ("b.example.net", "", "allow"), ("example.net", "/fr/", "block"), ("EXAMPLE.net", "/fr/1", "block"), ("example.net", "/fr/1", "allow")]
    unsound = [(None, "/", "block"), ("", "/", "block"), ("example.com", None, "block"), ("example.com", "/", None)]
    pages = spark.createDataFrame(PAGES, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("rule", "key", "cell", "tie", "host", "path", "verdict")})
    made = url_rules.judge(pages, spark.createDataFrame(rules + unsound, RULE_COLUMNS), ranges=ranges)
    want = Counter()
    for i, u in PAGES:
        host, path, rule, verdict = naive_judge(u, [(h.lower(), p, v) for h, p, v in rules])
        want[i, host, path, rule, verdict or "allow"] += 1
    assert Counter(tuple(r) for r in made.collect()) == want
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(rules, RULE_COLUMNS), ranges=ranges).count() == 0
    none = url_rules.judge(pages, spark.createDataFrame([], RULE_COLUMNS), default="block").collect()
    assert len(none) == len(PAGES) and {(r.rule, r.verdict) for r in none} == {(None, "block")}


def test_url_rules_many_rules_and_a_hot_host(spark):
    rng = random.Random(4)
    rules = [(f"h{i % 20_000}.{rng.choice(['com', 'org', 'co.uk'])}", rng.choice(["", "/", "/a/", "/a/b"]), rng.choice(["allow", "block"])) for i in range(60_000)]
    rules = [(h, p, v) for (h, p), v in {(h, p): v for h, p, v in rules}.items()] + [("hot.com", "/a/", "block"), ("com", "/a", "allow"), ("hot.com", "/a/b/7", "allow")]
    hosts = ["hot.com", "x.hot.com", *(f"{rng.choice(['', 'www.', 'a.b.'])}h{rng.randrange(21_000)}.{rng.choice(['com', 'org', 'co.uk'])}" for _ in range(1500))]
    urls = [f"http://{rng.choice(hosts[:2]) if i % 3 == 0 else rng.choice(hosts)}{rng.choice(['', '/', '/a/b/c', f'/a/{i}', f'/a/b/{i}'])}" for i in range(3000)]
    made = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, RULE_COLUMNS), ranges=37)
    of_host = defaultdict(list)
    for h, p, v in rules:
        of_host[h].append((h, p, v))
    want = {}
    for i, u in enumerate(urls):
        labels = u.split("://")[1].split("/")[0].split(".")
        near = [r for k in range(len(labels)) for r in of_host[".".join(labels[k:])]]
        want[i] = naive_judge(u, near)[2:]
    assert {r.page_id: (r.rule, r.verdict if r.rule else None) for r in made.collect()} == want
    assert sum(v[0] is not None for v in want.values()) > 500


def test_texts_of_over_a_megabyte_are_read_whole(spark, labels):
    rng = random.Random(17)
    long = corpus.prose(rng, 300_000)
    docs = materialize(spark.createDataFrame([(1, long, "en", "a"), (2, long[:-40] + " another end", "en", "a"), (3, None, None, None), (4, "short text", "en", "b")], "doc_id long, text string, lang string, source string"), "long")
    by = lambda df: {r.doc_id: r for r in df.collect()}
    assert len(long) > 1 << 20
    words = len(long.split())
    assert by(quality_rules.judge(docs))[1].n_words == words
    assert by(mixing.mix(docs))[1]["size"] == words
    groups = by(near_dup.groups(docs))
    assert groups[1].n_shingles > 100_000 and groups[2].component_id == 1 and groups[3].n_shingles == 0
    marks = by(fingerprints.fingerprints(docs))
    assert marks[1].n_chars == len(long) and marks[1].near_next > 0.9 and 0.3 < marks[2].near_edited < 1
    counts = by(token_counts.token_counts(docs, PATH))
    assert counts[1].n_tokens == len(Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids)
    packed = Counter()
    for r in packing.pack(docs, PATH).collect():
        packed[r.doc_id] += r.length
    assert packed == {i: c.n_tokens + 1 for i, c in counts.items()}
    assert by(sharding.shard(docs))[1].text_crc32 == zlib.crc32(long.encode())
    assert 0 <= by(quality.score(docs, labels))[1].score <= 1
    assert by(language_id.identify(docs))[1].predicted == "en"
    url = "http://a.example.com/" + "x" * 2_000_000
    assert by(url_rules.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), spark.createDataFrame(url_rules.RULES, RULE_COLUMNS)).withColumnRenamed("page_id", "doc_id"))[1].rule == "com/"
