"""Language identification by Bayesian evidence fusion.

Three kinds of evidence are put together as log probabilities:

* the text: byte trigrams of the lower-cased text under each language's smoothed
  counts, and under an unknown language that has all trigrams alike;
* the declared language (a markup's lang, a column), as reliable as it is over
  the corpus;
* the address: a prior of its host, smoothed towards that of its suffix, and that
  towards the corpus, from grouped counts of what the texts alone say. A row's
  own text is left out of the counts that it is judged by.

The trigram counts are learned from all rows that declare one of the languages
told apart: those of two or three letters, at most LANGUAGES of them, the ones
declared most often. Another declaration is no evidence. Evidence of long texts is
limited to TEXT_WORTH trigrams. A row whose best guess is the unknown language, or
that has no letters, is rejected: predicted is "und". Where two languages score
alike the one that is first by its code counts.

Null texts count as empty and are rejected. A null declared language is no
evidence. Rows of a null host share one host, the empty name, with its own prior. Repeated rows count each. An empty table gives an empty result.
Other columns, whatever their names, pass through ``accepted`` and are left out
elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.arrow import map_slices, texts
from sievegrid.llm.url_rules import host_of
from sievegrid.sources.scratch import materialize

BUCKETS, TEXT_WORTH, UNKNOWN, LANGUAGES = 1 << 13, 300, "und", 200
#: Prior of the unknown language, rows that a suffix's and a host's prior are worth to the level below, and the most that a declaration is trusted.
UNKNOWN_PRIOR, SUFFIX_WORTH, HOST_WORTH, MOST_TRUST = 1e-4, 20.0, 10.0, 0.99


def trigrams(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts in turn, and where each text's begin (one more than texts)."""
    data = [(" " + t.lower() + " ").encode("utf-8", "surrogatepass") for t in docs]
    starts = np.concatenate(([0], np.cumsum([len(d) - 2 for d in data]))).astype(np.int64)
    a = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    h = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)) if len(a) > 2 else np.empty(0, np.uint32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = h >> np.uint32(32 - 13)
    inside = np.ones(len(h), bool)  # trigrams over the seam of two texts are left out
    seams = np.cumsum([len(d) for d in data])[:-1]
    inside[np.concatenate([seams - 2, seams - 1]).astype(np.int64)] = False
    return h[inside], starts


def declared_language(said: Column) -> Column:
    """Primary subtag of a declared language, in lower case; empty where there is none of two or three letters."""
    return F.lower(F.regexp_extract(F.coalesce(said.cast("string"), F.lit("")), "^([A-Za-z]{2,3})(?:[^A-Za-z]|$)", 1))


def learn(rows: DataFrame, text: str) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each bucket under each, from rows with one of them as _sg_declared.

    What goes to the driver is BUCKETS counts for each of at most LANGUAGES languages.
    """
    said = rows.where("_sg_declared <> ''").groupBy("_sg_declared").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_sg_declared").limit(LANGUAGES)
    langs = sorted(r["_sg_declared"] for r in said.collect())
    known = frozenset(langs)

    def make_counts(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                declared = part.column("_sg_declared").to_pylist()
                h, starts = trigrams(texts(part, text))
                for i, lang in enumerate(declared):
                    if lang in known:
                        seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                        seen[lang] += np.bincount(h[starts[i] : starts[i + 1]], minlength=BUCKETS)
        for lang, n in seen.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(n[some])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(make_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    place = {lang: i for i, lang in enumerate(langs)}
    table = np.full((len(langs), BUCKETS), 0.5)
    for r in counts:
        table[place[r["lang"]], r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _with_text_evidence(df: DataFrame, text: str, langs: list[str], table: np.ndarray, drop: tuple[str, ...]) -> DataFrame:
    """Adds _sg_ll: the text's log likelihood under each language and, last, the unknown one; null without letters."""
    sent = df.sparkSession.sparkContext.broadcast(table)
    flat = -float(np.log(BUCKETS))

    def make():
        model = sent.value

        def work(part: pa.RecordBatch) -> list:
            docs = texts(part, text)
            h, starts = trigrams(docs)
            n = np.diff(starts)
            out = np.empty((len(docs), len(model) + 1))
            for k, row in enumerate(model):
                total = np.concatenate(([0.0], np.cumsum(row[h], dtype=np.float64)))
                out[:, k] = total[starts[1:]] - total[starts[:-1]]
            out[:, -1] = flat * n
            out *= np.minimum(1.0, TEXT_WORTH / np.maximum(n, 1))[:, None]
            rows = [o.tolist() if any(map(str.isalpha, t)) else None for t, o in zip(docs, out, strict=True)]
            return [pa.array(rows, pa.list_(pa.float64()))]

        return work

    return map_slices(df, text, make, "_sg_ll array<double>", drop)


def _best(scores: Column) -> Column:
    """0-based index of the largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


class Evidence:
    """What the corpus says: languages, their trigram tables, how far declarations are trusted, and counts of hosts."""

    def __init__(self, rows: DataFrame, text: str) -> None:
        self.langs, self.table = learn(rows.select(text, "_sg_declared"), text)
        self.count = len(self.langs)
        self.names = F.array(*map(F.lit, self.langs)) if self.langs else F.array().cast("array<string>")

    def told(self, rows: DataFrame, text: str, drop: tuple[str, ...]) -> DataFrame:
        """``rows`` with _sg_ll and _sg_vote, the 0-based language that the text alone speaks for (null: none of them)."""
        df = _with_text_evidence(rows, text, self.langs, self.table, drop)
        guess = _best(F.col("_sg_ll"))
        return df.withColumn("_sg_vote", F.when(guess < self.count, guess))

    def count_hosts(self, told: DataFrame) -> None:
        """Counts votes by host, suffix and in all; sets ``hosts``: _sg_site and an array of counts for it and for its suffix."""
        votes = told.where("_sg_vote is not null")
        agreed = F.count_if(F.col("_sg_declared") == F.get(self.names, F.col("_sg_vote")))
        cells = materialize(votes.groupBy("_sg_host", "_sg_suffix", "_sg_vote").agg(F.count("*").alias("n"), F.count_if(F.col("_sg_declared") != "").alias("said"), agreed.alias("agreed")), "votes")
        of_all = {r["_sg_vote"]: r for r in cells.groupBy("_sg_vote").agg(*(F.sum(c).alias(c) for c in ("n", "said", "agreed"))).collect()}  # a row for each language
        self.all = [of_all[i]["n"] if i in of_all else 0 for i in range(self.count)]
        said, agreed = (sum(r[c] for r in of_all.values()) for c in ("said", "agreed"))
        self.trust = min(MOST_TRUST, (agreed + 1) / (said + 2))
        counts = F.map_from_entries(F.collect_list(F.struct("_sg_vote", "n")))  # at most LANGUAGES entries
        dense = F.transform(F.sequence(F.lit(0), F.lit(self.count - 1)), lambda i: F.coalesce(F.element_at("_sg_map", i), F.lit(0)))

        def by(key: str, out: str) -> DataFrame:
            sums = cells.groupBy(key, "_sg_vote").agg(F.sum("n").alias("n"), F.min("_sg_suffix").alias("_sg_of"))
            return sums.groupBy(key).agg(counts.alias("_sg_map"), F.min("_sg_of").alias("_sg_of")).select(F.col(key).alias(f"_sg_{out}"), "_sg_of", dense.alias(f"_sg_n_{out}"))

        sites, ends = by("_sg_host", "site"), by("_sg_suffix", "end").drop("_sg_of")
        hosts = sites.join(ends, sites["_sg_of"] == ends["_sg_end"]).select("_sg_site", "_sg_n_site", "_sg_n_end")
        self.hosts = materialize(hosts, "hosts")  # its size is known then, and the join is planned by it

    def fused(self, told: DataFrame) -> DataFrame:
        """``told`` with _sg_predicted and _sg_confidence."""
        joined = told.join(self.hosts, told["_sg_host"] == self.hosts["_sg_site"], "left")
        own = lambda i: F.when(F.col("_sg_vote") == i, 1).otherwise(0)
        voted = F.when(F.col("_sg_vote").isNotNull(), 1).otherwise(0)
        all_ = F.array(*(F.lit(n) for n in self.all))
        sum_of = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0))
        many = lambda c, i: F.coalesce(F.get(c, i), F.lit(0)) - own(i)
        totals = {c: sum_of(F.col(c)) for c in ("_sg_n_site", "_sg_n_end")}
        joined = joined.withColumns({f"{c}_sum": F.greatest(n - voted, F.lit(0)) for c, n in totals.items()})
        least = lambda x: F.greatest(x, F.lit(0))  # noqa: E731  a host without counts has no vote to leave out

        def prior(i: Column) -> Column:
            base = (many(all_, i) + 1) / (F.lit(sum(self.all)) - voted + self.count)
            end = (least(many(F.col("_sg_n_end"), i)) + SUFFIX_WORTH * base) / (F.col("_sg_n_end_sum") + SUFFIX_WORTH)
            return (least(many(F.col("_sg_n_site"), i)) + HOST_WORTH * end) / (F.col("_sg_n_site_sum") + HOST_WORTH)

        known = F.array_contains(self.names, F.col("_sg_declared"))
        other = float(np.log((1 - self.trust) / max(self.count - 1, 1) + 1e-9))
        said = lambda i: F.when(~known, 0.0).when(F.get(self.names, i) == F.col("_sg_declared"), float(np.log(self.trust))).otherwise(other)
        scores = F.transform(F.sequence(F.lit(0), F.lit(self.count - 1)), lambda i: F.get("_sg_ll", i) + F.log(prior(i)) + said(i))
        unknown = F.get("_sg_ll", F.lit(self.count)) + float(np.log(UNKNOWN_PRIOR)) + F.when(known, float(np.log(1 / self.count))).otherwise(0.0)
        scored = joined.withColumn("_sg_scores", F.concat(scores, F.array(unknown)))
        most = F.array_max("_sg_scores")
        share = 1.0 / F.aggregate("_sg_scores", F.lit(0.0), lambda acc, x: acc + F.exp(x - most))
        best = F.get(F.concat(self.names, F.array(F.lit(UNKNOWN))), _best(F.col("_sg_scores")))
        none = F.col("_sg_ll").isNull()
        return scored.withColumns({"_sg_predicted": F.when(none, UNKNOWN).otherwise(best), "_sg_confidence": F.when(none, 1.0).otherwise(share)})


def _with_keys(df: DataFrame, declared: Column, host: Column) -> DataFrame:
    site = F.coalesce(host.cast("string"), F.lit(""))
    return df.withColumns({"_sg_declared": declared_language(declared), "_sg_host": site, "_sg_suffix": F.regexp_extract(site, r"\.([^.]+)$", 1)})


def identified(df: DataFrame, text: str, declared: Column, host: Column) -> DataFrame:
    """``df`` without ``text``, with _sg_predicted (a language or "und") and _sg_confidence (its posterior).

    Texts are read twice, to learn and to be told by; what they say is written, and meets the counts of hosts without them.
    """
    rows = _with_keys(df, declared, host)
    seen = Evidence(rows, text)
    if not seen.count:
        return df.drop(text).withColumns({"_sg_predicted": F.lit(UNKNOWN), "_sg_confidence": F.lit(1.0)})
    told = materialize(seen.told(rows, text, (text,)), "told")
    seen.count_hosts(told)
    return seen.fused(told).select(*(c for c in df.columns if c != text), "_sg_predicted", "_sg_confidence")


def _verdicts(done: DataFrame, *columns: str | Column) -> DataFrame:
    return done.select(*columns, F.col("_sg_predicted").alias("predicted"), F.col("_sg_confidence").alias("confidence"), (F.col("_sg_predicted") != UNKNOWN).alias("kept"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, lang (declared), predicted, confidence and kept (predicted isn't "und") of every row of ``docs``.

    The declared language is ``lang``; the source is taken as host.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source")
    return _verdicts(identified(rows, "text", F.col("lang"), F.col("source")), "doc_id", "lang")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a known language, with their columns.

    Texts are read a third time to be judged where they are, so that they aren't shuffled unless the counts of hosts are
    too many to be broadcast.
    """
    rows = _with_keys(docs, F.col("lang"), F.col("source"))
    narrow = rows.select(F.col("text").cast("string").alias("text"), "_sg_declared", "_sg_host", "_sg_suffix")
    seen = Evidence(narrow, "text")
    if not seen.count:
        return docs.limit(0)
    seen.count_hosts(seen.told(narrow, "text", ("text",)))
    return seen.fused(seen.told(rows, "text", ())).where(F.col("_sg_predicted") != UNKNOWN).select(*docs.columns)


def identify_pages(pages: DataFrame) -> DataFrame:
    """page_id, declared, predicted, confidence and kept of web pages (page_id, url, html).

    The declared language is the markup's lang attribute, the host and its suffix are the url's.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    lang = F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    rows = pages.select("page_id", text.alias("text"), lang.alias("declared"), host_of(F.col("url")).alias("host"))
    return _verdicts(identified(rows, "text", F.col("declared"), F.col("host")), "page_id", "declared")
