"""Encoding against a plain search for the best segmentation; decoding is exact."""

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from trustweave.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ENCODER = pieces.Encoder(pieces.Vocabulary(MODEL))
BY_TEXT = {text: (i, score) for i, (text, score) in ENCODER.vocabulary.pieces.items()}
LONGEST = max(map(len, BY_TEXT))


def best_score(text):
    best = [0.0]
    for end in range(1, len(text) + 1):
        best.append(max([best[end - 1] + ENCODER.unknown] + [
            best[s] + BY_TEXT[text[s:end]][1] for s in range(max(0, end - LONGEST), end) if text[s:end] in BY_TEXT]))
    return best[-1]


def score(ids):
    total, i, raw = 0.0, 0, ENCODER.vocabulary.pieces
    while i < len(ids):
        if ids[i] in raw:
            total += raw[ids[i]][1]
            i += 1
        else:
            first = ENCODER.vocabulary.raw[ids[i]][0]
            i += 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
            total += ENCODER.unknown
    return total


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text("the interna\n▁ of  é", max_size=40)))
def test_best_segmentation_and_exact_decoding(text):
    ids = ENCODER.encode(text)
    assert pieces.decode_ids(ENCODER.vocabulary, ids) == text
    if text:
        assert abs(score(ids) - best_score(" " + text)) < 1e-3 and score(ids) == score(ENCODER.viterbi(" " + text))


def test_table_round_trip(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t, "clash") for i, t in enumerate(brute.ODD + real)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    texts = {i: t for i, t, _ in rows}
    assert len(out) == len(rows) and all(r.decoded == r.text == texts[r.doc_id] for r in out)
    assert {r.doc_id for r in out if r.ids is None} == {0} and [r.ids for r in out if r.doc_id == 1] == [[]]
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def test_ids_are_those_of_sentencepiece(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert ENCODER.vocabulary.merges
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    # sentencepiece cannot tell its own sign for a space from a space
    texts = [t for t in [" und das", "  two  spaces ", "kkkkkkkkk", *brute.ODD, *real] if t and pieces.SPACE not in t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    differ = [r.text for r in pieces.encode(df, MODEL).collect() if r.ids != sp.encode(r.text)]
    assert differ == []


MERGER, LIBRARY = pieces.Merger(ENCODER.vocabulary), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(
    st.text(max_size=40), st.text("the internaliz\n of  é", max_size=60), st.lists(st.sampled_from(sorted(BY_TEXT)), max_size=8).map("".join),
    st.tuples(st.text("a=-#x0", min_size=1, max_size=4), st.integers(1, 200)).map(lambda t: t[0] * t[1])))
def test_one_pass_merges_like_sentencepiece(text):
    text = text.replace(pieces.SPACE, "")
    assert MERGER.encode(text) == LIBRARY.encode(text)


def test_units_forget_and_gather():
    units = pieces.Units(ENCODER.vocabulary, lambda words: [MERGER.cut(w) for w in words], 20)
    texts = [f"some words {i} and  {i % 7}" for i in range(100)] + ["", "x"]
    for at in range(0, len(texts), 9):
        ids, start = units.of(texts[at:at + 9])
        assert [ids[a:b].tolist() for a, b in zip(start, start[1:])] == [LIBRARY.encode(t) for t in texts[at:at + 9]]
    ids, start = units.of([])
    assert len(ids) == 0 and start.tolist() == [0]


def test_ids_that_spell_no_text(spark):
    by_byte = ENCODER.vocabulary.bytes
    rows = [(0, [by_byte[0x20], by_byte[0xC3], by_byte[0x41]]), (1, None), (2, []), (3, LIBRARY.encode("é x"))]
    out = pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), MODEL).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["\ufffdA", None, "", "é x"]
