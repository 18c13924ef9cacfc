"""The pipeline's rows against its stages by brute force."""

import hashlib
import random

import corpus_pipeline
from conftest_llm import docs
from test_text_operators import LANGS, brute_best, brute_components, brute_fingerprint, prose

from swathe.llm import pieces


def corpus():
    r = random.Random(12)
    texts = [" ".join(r.choices(LANGS[lang].split(), k=60)) + f" {i}" for i, lang in enumerate(list(LANGS) * 20)]
    out = [(i, t, list(LANGS)[i % 3], f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    out += [(100, None, "en", "src1", 0), (101, " !? ", "en", "src1", 4), (102, texts[3], "en", "src2", 1), (2, texts[4], "fr", "src2", 1), (5, texts[5], "fr", "src1", 1)]
    out += [(110, "the house " + prose(70, 20) + " and the water", "en", "src3", 1), (111, "the house and the water of token = abcdefghijkl0123 this morning", "en", "src3", 1)]
    return out, [(1, prose(70, 20)), (2, prose(71, 20))]


def test_pipeline(spark, tables):
    documents, items = corpus()
    folder = tables(documents=documents, benchmark=items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    rows = [d for d in documents if d[0] not in (100, 101)]
    comp = brute_components([d[0] for d in rows], [brute_fingerprint(d[1]) for d in rows])
    left = {}
    for k, d in enumerate(rows):
        left.setdefault(comp[k], []).append(d)
    kept = [min(own, key=lambda d: d[0]) for own in left.values()]
    kept = [d for d in kept if not any(brute_best(t, d[1]) <= len(t) * 0.06 for _, t in items)]
    assert sorted(got) == sorted({d[0] for d in kept}) and len(got) == len(kept)
    seg = pieces.Segmenter(pieces.load())
    for i, text, *_ in kept:
        text = text.replace("token = abcdefghijkl0123", "[SECRET]")
        lists, found = seg.encode(text)
        if i not in (2, 5):  # two texts share these ids
            assert got[i].sha256 == hashlib.sha256(seg.ids(lists, {})).hexdigest() and got[i].decoded
            assert seg.decode(b"".join(x.to_bytes(4, "little") for x in got[i].ids)) == text


def test_stages_keep_columns_and_bear_empty_tables(spark, tables):
    folder = tables(documents=[], benchmark=[])
    read = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, folder)
        assert out.columns == read.columns and out.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_clashing_columns_pass_through(spark, tables):
    folder = tables(True, documents=docs([prose(1, 30), prose(2, 30)]), benchmark=[(1, prose(1, 30))])
    read = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        read = stage(spark, read, folder)
        assert read.filter("id = 'x' AND score = 'x' AND root = 'x'").count() == read.count()
    assert read.count() == 1


def test_near_copies_go_by_similarity(spark):
    r = random.Random(5)
    base = [prose(300 + s, 120).split() for s in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for changes in (1, 2, 3, 4, 6):
            words = list(b)
            for at in r.sample(range(len(words)), changes):
                words[at] = f"other{at}"
            texts.append(" ".join(words))
    texts += [texts[0], texts[20], "", " ", "one two", "ONE  two"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(min(len(w), 1), len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = {min(k for k in range(len(texts)) if group[k] == g) for g in group}
    read = spark.createDataFrame(docs(texts), "doc_id long, text string, lang string, source string, n_chars long")
    got = [row.doc_id for row in corpus_pipeline.near_duplicates(spark, read, "").collect()]
    assert sorted(got) == sorted(want) and len(want) < 60
