"""The pipeline's stages against brute force, each on what the stage before it kept."""

import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from sievegrid.llm import language_id, mixing, quality
from sievegrid.sources.scratch import materialize
from tests.llm.test_operators import PATH, Tokenizer, WORD, brute_groups

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents and what each stage kept of them, in order."""
    docs = [spark.read.parquet(f"{BASE}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], BASE), name))
    return docs


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages_keep_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dup", "mixing", "packing"]
    for df in kept[1:-1]:
        assert df.columns == kept[0].columns and df.count() > 0


def test_filters_keep_what_their_operators_accept(spark, kept):
    known = {r.doc_id for r in language_id.identify(kept[0]).collect() if r.kept}
    assert rows(kept[1]) == Counter({k: n for k, n in rows(kept[0]).items() if k[0] in known})
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    good = {r.doc_id for r in quality.score(kept[1], labels).collect() if r.predicted == 1}
    assert rows(kept[2]) == Counter({k: n for k, n in rows(kept[1]).items() if k[0] in good})


def test_one_document_of_each_group_stays(kept):
    before = [tuple(r) for r in kept[2].select("doc_id", "text").collect()]
    stay = {i for i, _, root in brute_groups(before) if i == root}
    assert {k[0] for k in rows(kept[3])} == stay


def test_the_mix_repeats_documents(kept):
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in kept[3].collect()}
    goal = mixing.targets([(s, sum(sizes[r.doc_id] for r in rs)) for s, rs in _by_source(kept[3]).items()])
    got = Counter()
    for (doc, _, _, source, _), n in rows(kept[4]).items():
        assert n <= 2
        got[source] += n * sizes[doc]
    assert set(rows(kept[4])) <= set(rows(kept[3]))
    for s, t in goal.items():
        assert abs(got[s] - t) <= max(0.05 * t, 60)


def _by_source(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.source].append(r)
    return out


def test_all_tokens_of_the_mix_are_packed(spark, kept):
    library, want = Tokenizer.from_file(PATH), Counter()
    for (doc, text, *_), n in rows(kept[4]).items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0] if len(ids) <= 1024 else sorted({0, *range(len(ids) % 1024, len(ids), 1024)})
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want[doc, k, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += n
    packed = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert packed(kept[5]) == want
    assert packed(corpus_pipeline.run(spark, BASE)) == want
    filled = defaultdict(int)
    for r in kept[5].collect():
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and len(filled) <= sum(filled.values()) / 1024 * 1.05 + 2
