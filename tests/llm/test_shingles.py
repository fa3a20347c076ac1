"""Word and shingle hashes against plain words."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from trustweave.llm.shingles import WordHashes, shingle_set, windows

HASHES = WordHashes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aAbBé \t\n\x0b\x0c\r\x1c\xa0İ", max_size=40), min_size=1, max_size=4))
def test_equal_words_have_equal_hashes(texts):
    seen = {}
    for text in texts:
        words = brute.words("".join(c.lower() if c in "AB" else c for c in text))
        hashes = HASHES.of(text)
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes.tolist()):
            assert seen.setdefault(w, h) == h
        assert len(shingle_set(text, HASHES)) == len(brute.shingles(text))
    assert len(set(seen.values())) == len(seen)


def test_odd_texts():
    for text in brute.ODD:
        assert len(windows(HASHES.of(text))) == (max(1, len(brute.words(text)) - 4) if brute.words(text) else 0)
        assert len(shingle_set(text, HASHES)) == len(brute.shingles(text))
    assert (HASHES.of("x " * 30000 + "tail")[-1] == HASHES.of("tail")).all()
