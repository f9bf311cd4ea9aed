"""Quality rules whose thresholds come from the corpus.

Four ratios are measured for each document. Mergeable sketches hold the distribution of each
ratio for each pair of language and source, for each language and for the corpus: counts on a
fixed grid of GRID steps, which merge exactly, so reruns agree. A bound comes from quantiles
of the ratio's own sketch alone: they are walked upwards from the median, or, where most
values are zero, from zero over the quantiles of the others. The walk ends at the first gap
between neighbours that is at least a third of the widest one and wider than SPREAD times
the reach so far; the bound lies a third into that gap, and what is above is detached. Without such
a gap the bound is SPREAD times the whole reach. A document with fewer than EVIDENCE of what is counted
has a ratio of zero, since so few can be chance. Bounds are shrunk by the numbers of values that
tell (all, or those that aren't zero) towards the language and the corpus, and a pair's is
at most LIMIT times its language's, so that a source of junk alone doesn't excuse itself.
Documents are then joined with their bounds, and kept if no ratio passes its bound. Junk that
makes up half of a language, or that passes into the bulk without a gap, is not told from it.

Null texts count as empty and fail the base rule. Null languages and sources are
groups of their own. Repeated rows count each. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.llm.arrow import map_slices, texts
from sievegrid.operators.ranking import same
from sievegrid.sources.scratch import materialize

#: Values that a bound is worth to the level below, reach of a bulk, a pair's most over its language, and the steps of the grid.
WORTH, SPREAD, LIMIT, GRID = 200, 3.0, 2.0, 1.02
#: What a document must have of what is counted before its ratio counts as more than zero, and values below which the corpus tells little.
EVIDENCE, FEW = 16, 20
#: The ratios and what they are shares of: characters a word, symbols a character, doubled lines a word, repeated words a word.
RATIOS = {"word_length": "n_words", "symbol_ratio": "word_chars", "dup_line_ratio": "n_words", "repeat_ratio": "n_words"}

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    data = text.encode()
    words = data.split()  # bytes.split() parts at exactly space and \t to \r
    n = len(words)
    chars = len(_SPACES.sub("", text))
    symbols = len(_SYMBOLS.findall(text))
    lines = Counter(line for line in data.split(b"\n") if line.split())
    dup = sum(lines.values()) - len(lines)
    repeat = 0
    if n > 3:
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
        m = len(names)
        if m < 1 << 21:  # three numbers of words in 63 bits
            windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
            _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
            often = count[back] > 1
        else:
            triples = list(zip(words, words[1:], words[2:], strict=False))
            seen = Counter(triples)
            often = np.fromiter((seen[t] > 1 for t in triples), bool, n - 2)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= often
        repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts and the four ratios of every row."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            rows = [measure(t) for t in texts(part, "text")]
            return [list(c) for c in zip(*rows, strict=True)]

        return work

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    counts = map_slices(rows, "text", make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long", drop=("text",))
    per = lambda a, b: F.when((F.col(b) > 0) & (F.lit(a == "word_chars") | (F.col(a) >= EVIDENCE)), F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns({"word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_words"), "repeat_ratio": per("n_repeat_words", "n_words")})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketched(rows: DataFrame) -> DataFrame:
    """lang, source, ratio, step (null for zero) and n: how many rows that pass the base rule have a value in a step of the grid."""
    step = lambda x: F.when(x > 0, F.floor(F.log(x) / F.log(F.lit(GRID))).cast("int"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("ratio"), step(F.col(m)).alias("step")) for m in RATIOS)))
    return rows.where(~base_failed()).select("lang", "source", each.alias("r")).groupBy("lang", "source", "r.ratio", "r.step").agg(F.count("*").alias("n"))


def bounds(sketch: DataFrame, by: list[str], tag: str) -> DataFrame:
    """by, ratio, {tag}_bound and {tag}_n (values that tell) from a sketch; a group has at most one row for each step of the grid."""
    group = Window.partitionBy(*by, "ratio")
    known = F.col("step").isNotNull()
    sums = sketch.withColumns({"all": F.sum("n").over(group), "told": F.sum(F.when(known, F.col("n")).otherwise(0)).over(group), "upto": F.sum("n").over(group.orderBy(F.asc_nulls_first("step")))})
    sums = sums.withColumn("mostly_zero", 2 * (F.col("all") - F.col("told")) >= F.col("all"))
    place = F.col("upto") - F.when(F.col("mostly_zero"), F.col("all") - F.col("told")).otherwise(0)
    total = F.when(F.col("mostly_zero"), F.col("told")).otherwise(F.col("all"))
    value = F.when(known, F.pow(F.lit(GRID), F.col("step") + 1)).otherwise(F.lit(0.0))  # a step's upper end
    reached = lambda k: F.min(F.when((known | ~F.col("mostly_zero")) & (100 * place >= k * total), value))
    made = sums.groupBy(*by, "ratio").agg(F.array(*(reached(k) for k in range(1, 100))).alias("at"), F.first("mostly_zero").alias("mostly_zero"), F.max(total).alias(f"{tag}_n"))
    walk = F.when(F.col("mostly_zero"), F.concat(F.array(F.lit(0.0)), "at")).otherwise(F.slice("at", 50, 50))
    low = F.when(F.col("mostly_zero"), 0.0).otherwise(F.greatest(F.get("at", F.lit(49)) - F.get("at", F.lit(24)), F.get("at", F.lit(49)) * (GRID**2 - 1)))
    made = made.withColumns({"walk": walk, "low": low}).withColumn("gaps", F.zip_with(F.slice("walk", 2, 100), F.slice("walk", F.lit(1), F.size("walk") - 1), lambda x, y: x - y))
    first, widest = F.get("walk", F.lit(0)), F.array_max("gaps")
    reach = lambda x: F.greatest(x - first, F.col("low"))
    torn = F.filter(F.zip_with("gaps", F.slice("walk", F.lit(1), F.size("walk") - 1), lambda g, x: F.struct(x.alias("x"), g.alias("gap"))), lambda s: (3 * s["gap"] >= widest) & (s["gap"] > SPREAD * reach(s["x"])))
    cut = F.get(torn, F.lit(0))
    bound = F.coalesce(cut["x"] + cut["gap"] / 3, first + SPREAD * reach(F.element_at("walk", -1)))
    return made.select(*by, "ratio", F.when(F.col(f"{tag}_n") > 0, bound).alias(f"{tag}_bound"), f"{tag}_n")


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source and a bound for each ratio (null where nothing tells), from the sketches of rows that pass the base rule."""
    pairs = materialize(sketched(rows), "sketches")
    langs = materialize(pairs.groupBy("lang", "ratio", "step").agg(F.sum("n").alias("n")), "sketches")
    corpus = langs.groupBy("ratio", "step").agg(F.sum("n").alias("n"))
    a, b, c = bounds(pairs, ["lang", "source"], "pair"), bounds(langs, ["lang"], "lang").withColumnsRenamed({"lang": "_sg_lang", "ratio": "_sg_ratio"}), bounds(corpus, [], "all")
    joined = a.join(b, same(a, b, [("lang", "_sg_lang"), ("ratio", "_sg_ratio")]), "left").join(F.broadcast(c), "ratio", "left")  # a row for each ratio
    shrunk = lambda tag, under: F.coalesce((F.col(f"{tag}_n") * F.col(f"{tag}_bound") + WORTH * under) / (F.col(f"{tag}_n") + WORTH), under)
    lang = shrunk("lang", F.col("all_bound") * (1 + FEW / F.col("all_n")))
    most = joined.select("lang", "source", "ratio", F.least(shrunk("pair", lang), LIMIT * lang).alias("most"))
    return most.groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == m, F.col("most"))).alias(f"most_{m}") for m in RATIOS))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row of ``docs``."""
    rows = materialize(measured(docs), "measures")
    limits = materialize(thresholds(rows), "thresholds")
    right = limits.withColumnsRenamed({"lang": "_sg_lang", "source": "_sg_source"})
    joined = rows.join(right, same(rows, right, [("lang", "_sg_lang"), ("source", "_sg_source")]), "left")
    odd = F.lit(False)
    for m in RATIOS:
        odd = odd | F.coalesce(F.col(m) > F.col(f"most_{m}"), F.lit(False))
    failed = base_failed()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"))
