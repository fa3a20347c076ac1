"""The pipeline on a small corpus with known junk, copies, passages and secrets."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm import brute


def corpus():
    draw = random.Random(11)
    text = lambda n: " ".join("word%d" % draw.randrange(4000) for _ in range(n))
    rows = {i: text(draw.randrange(80, 400)) for i in range(120)}
    rows[200], rows[201] = rows[5], rows[6] + " end"            # copies, exact and near
    passage = text(70)
    rows[210], rows[211] = f"{text(60)} {passage} {text(90)}", f"{text(100)} {passage} {text(60)}"
    rows[220] = f"{text(80)} token=abcdef123456 {text(20)} AKIA{'A1' * 8} {text(9)}"
    rows[230], rows[231], rows[232], rows[233] = None, "", text(30), "same words again " * 60
    rows[234] = "### $$$ %%% " * 40 + text(80)
    return rows, passage


def test_stages(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(5)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    columns = docs.columns
    texts = {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == columns
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert set(rows) - set(texts["quality rules"]) == {230, 231, 232, 233, 234}
    assert set(texts["quality rules"]) - set(texts["near-dedup"]) == {200, 201}
    assert texts["near-dedup"] == {i: rows[i] for i in texts["near-dedup"]}
    later = texts["substring dedup"]
    assert set(later) == set(texts["near-dedup"]) and {i for i in later if later[i] != rows[i]} == {211}
    assert passage in later[210] and later[211].split() == rows[211].replace(passage, "").split()
    final = texts["secret scans"]
    assert {i for i in final if final[i] != later[i]} == {220} and "[assign]" in final[220] and "[access]" in final[220]
    model = Tokenizer.from_file(C.TOKENIZER)
    pieces = {}
    for r in C.STAGES[-1][1](spark, docs, "").collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    for i, t in final.items():
        assert [x for _, p in sorted(pieces[i]) for x in p] == [*model.encode(t, add_special_tokens=False).ids, 0]
    assert set(pieces) == set(final)


def test_run_equals_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    out = C.run(spark, sf)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    packed = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    good = {i for i, t in docs.items() if (c := brute.quality(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert packed <= good and len(packed) > 0.6 * len(docs)


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_odd_and_empty_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, _doc int"
    rows = [(i, t, None, None, None, "x", "y", 1) for i, t in enumerate(brute.ODD)] * 2 + [(None,) * 8]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, "")
    assert out.count() >= 0
    if stage is not C.pack:
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), "").count() == 0
