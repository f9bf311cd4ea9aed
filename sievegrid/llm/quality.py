"""Quality by a regularised quadratic discriminant over document statistics.

Each document is counted once: characters of several classes, words, repeated
and doubled ones, lines. Ratios of the counts, drawn towards the labelled mean
where a text is short, are transformed to be closer to normal. For each class
the mean and the covariance of the labelled rows are summed up in Spark; the
covariance is shrunk towards the pooled diagonal, and its Cholesky factor is kept.
The score is the logistic of the difference of the two log densities, from
Mahalanobis distances by those factors, and of the class shares.

Labels come only from rows that aren't held out. Null and empty texts get the
score of the labelled mean text. Labels that are null or not 0 or 1 are ignored;
repeated equal labels count once. With one class or none, every score is the
smoothed share of class 1. Null doc_ids are scored and never held out. Repeated
rows are scored each, and one whose doc_id is labelled with both classes counts
for both. An empty table gives an empty result. Other columns, whatever their
names, pass through ``accepted`` and are left out by ``score``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.arrow import map_slices, texts
from sievegrid.sources.scratch import materialize

THRESHOLD, SHRINKAGE, RIDGE, TEMPER = 0.7, 0.1, 1e-3, 0.5
#: Counts of a text; kinds of characters first.
KINDS = ("upper", "lower", "digit", "symbol", "pipe", "exclaim", "point", "other", "space", "line_end")
COUNTS = (*KINDS, "words", "distinct", "adjacent", "lines", "dup_lines", "triples")
#: Ratio features: count, what it is a share of, and so many of the latter of the mean text that every text is thought to have besides.
RATIOS = (("upper", "chars", 150), ("symbol", "chars", 150), ("pipe", "chars", 150), ("exclaim", "chars", 150), ("point", "chars", 150), ("digit", "chars", 150), ("other", "chars", 150), ("adjacent", "words", 30), ("triples", "words", 30), ("dup_lines", "lines", 5), ("line_end", "chars", 400), ("space", "chars", 150))


def _kind_table() -> np.ndarray:
    table = np.full(0x3000, KINDS.index("other"), np.uint8)
    for code in range(len(table)):
        c = chr(code)
        if c == "\n":
            kind = "line_end"
        elif c in " \t\v\f\r":
            kind = "space"
        elif c in "#*$%&<>@^~=+_\\{}[]`":
            kind = "symbol"
        elif c == "|":
            kind = "pipe"
        elif c == "!":
            kind = "exclaim"
        elif c in ".,;:?'\"-()":
            kind = "point"
        elif c.isdigit():
            kind = "digit"
        elif c.isupper():
            kind = "upper"
        elif c.isalpha():
            kind = "lower"
        else:
            continue
        table[code] = KINDS.index(kind)
    return table


_KIND = _kind_table()


def count(docs: list[str]) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = np.zeros((len(docs), len(COUNTS)))
    lengths = np.array([len(t) for t in docs])
    codes = np.frombuffer("".join(docs).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(codes < len(_KIND), _KIND[np.minimum(codes, len(_KIND) - 1)], KINDS.index("lower"))
    owner = np.repeat(np.arange(len(docs)), lengths)
    n = len(KINDS)
    out[:, :n] = np.bincount(owner * n + kind, minlength=len(docs) * n).reshape(-1, n)
    for i, text in enumerate(docs):
        words = text.split()
        lines = Counter(x for x in text.split("\n") if x and not x.isspace())
        names: dict[str, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
        triples = 0
        if len(words) > 3:
            windows = (ids[:-2] * 1_000_003 + ids[1:-1]) * 1_000_003 + ids[2:]
            triples = len(windows) - len(np.unique(windows))
        out[i, n:] = len(words), len(names), (ids[1:] == ids[:-1]).sum(), sum(lines.values()), sum(lines.values()) - len(lines), triples
    return out


def counted(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (all columns but ``drop``) with the array _sg_counts."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            return [pa.array(list(count(texts(part, "text"))), pa.list_(pa.float64()))]

        return work

    return map_slices(docs, "text", make, "_sg_counts array<double>", drop)


class Discriminant:
    """Means, Cholesky factors and shares of two classes, over transformed counts."""

    def __init__(self, mean_ratio: np.ndarray) -> None:
        self.mean_ratio, self.share = mean_ratio, 0.5
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []

    def transform(self, counts: np.ndarray) -> np.ndarray:
        return transform(counts, self.mean_ratio)

    def fit(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        """n, sums and sums of outer products of the transformed rows of class 0 and 1."""
        self.share = float((n[1] + 1) / (n.sum() + 2))
        if n.min() < 2:
            return
        means = sums / n[:, None]
        within = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.einsum("c,cii->i", n / n.sum(), within)
        floor = np.maximum(pooled, RIDGE * max(pooled.max(), 1e-12))
        for mean, cov in zip(means, within, strict=True):
            shrunk = (1 - SHRINKAGE) * cov + SHRINKAGE * np.diag(floor)
            factor = np.linalg.cholesky(shrunk + RIDGE * np.diag(floor))
            self.classes.append((mean, factor, float(np.log(np.diag(factor)).sum())))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        logit = np.full(len(counts), np.log(self.share / (1 - self.share)))
        if self.classes:
            x = self.transform(counts)
            dense = []
            for mean, factor, log_det in self.classes:
                z = np.linalg.solve(factor, (x - mean).T)
                dense.append(-0.5 * (z * z).sum(0) - log_det)
            logit = logit + TEMPER * (dense[1] - dense[0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _bases(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = {c: counts[:, i] for i, c in enumerate(COUNTS)} | {"chars": counts[:, : len(KINDS)].sum(1)}
    return np.stack([at[a] for a, _, _ in RATIOS], 1), np.stack([at[b] for _, b, _ in RATIOS], 1)


def transform(counts: np.ndarray, mean_ratio: np.ndarray) -> np.ndarray:
    """Features of counted texts: arcsines of roots of the ratios, and logs of word length and of variety."""
    part, whole = _bases(counts)
    weight = np.array([w for _, _, w in RATIOS])
    ratio = np.clip((part + weight * mean_ratio[: len(RATIOS)]) / (whole + weight), 0, 1)
    at = {c: counts[:, i] for i, c in enumerate(COUNTS)}
    letters = at["upper"] + at["lower"] + at["other"]
    length = np.log((letters + 60 * mean_ratio[-1]) / (at["words"] + 60))
    # Types follow about the 0.8th power of tokens, so variety is compared with that
    variety = np.log((at["distinct"] + 20) / (at["words"] + 20) ** 0.8)
    return np.column_stack([np.arcsin(np.sqrt(ratio)), length, variety])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 modulo 4; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits on the counted ``rows`` that ``labels`` marks and that aren't held out; covers all of them.

    Only sums over each class go to the driver.
    """
    marked = labels.select(F.col("doc_id").alias("_sg_id"), F.col("quality").cast("int").alias("_sg_class")).where("_sg_class in (0, 1)").distinct()
    seen = rows.where(~held_out(F.col("doc_id"))).select("doc_id", "_sg_counts")
    fold = materialize(seen.join(marked, seen["doc_id"] == marked["_sg_id"]).select("_sg_class", "_sg_counts"), "labelled")
    sums = [F.sum(F.col("_sg_counts")[i]).alias(c) for i, c in enumerate(COUNTS)]
    total = np.array([[x or 0.0 for x in fold.where("_sg_class = 1").agg(*sums).first()]])  # the mean text is a good one
    part, whole = _bases(total)
    at = dict(zip(COUNTS, total[0], strict=True))
    mean_ratio = np.append((part / np.maximum(whole, 1))[0], (at["upper"] + at["lower"] + at["other"]) / max(at["words"], 1))
    model = Discriminant(mean_ratio)
    d = len(RATIOS) + 2

    def moments(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            cls = batch.column("_sg_class").to_numpy(zero_copy_only=False)
            x = transform(np.array(batch.column("_sg_counts").to_pylist(), float).reshape(-1, len(COUNTS)), mean_ratio)
            for c in (0, 1):
                y = x[cls == c]
                n[c] += len(y)
                s[c] += y.sum(0)
                q[c] += y.T @ y
        flat = np.concatenate([n, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["at", "value"])

    got = fold.mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in got:
        flat[r["at"]] = r["value"]
    model.fit(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d))
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= THRESHOLD) of every row of ``docs``."""
    rows = materialize(counted(docs.select("doc_id", F.col("text").cast("string").alias("text")), ("text",)), "statistics")
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, labels))

    def make():
        def work(part: pa.RecordBatch) -> list:
            return [sent.value.scores(np.array(part.column("_sg_counts").to_pylist(), float).reshape(-1, len(COUNTS)))]

        return work

    # the slicer measures a text column; these rows have none
    out = map_slices(rows.withColumn("_sg_text", F.lit(None).cast("string")), "_sg_text", make, "_sg_score double", ("_sg_text", "_sg_counts"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_sg_score").alias("score"), (F.col("_sg_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches THRESHOLD, with their columns.

    Rows are counted once for the fit, where counts alone are joined with labels,
    and once more where they are scored, so that texts aren't shuffled.
    """
    rows = counted(docs.select("doc_id", F.col("text").cast("string").alias("text")), ("text",))
    sent = docs.sparkSession.sparkContext.broadcast(train(materialize(rows, "statistics"), labels))

    def make():
        return lambda part: [sent.value.scores(count(texts(part, "text")))]

    return map_slices(docs, "text", make, "_sg_score double").where(F.col("_sg_score") >= THRESHOLD).drop("_sg_score")
