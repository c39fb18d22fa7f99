import pyarrow as pa
import pytest
from llm_cases import alphanumeric, spaced

from blotter.llm import tokens

TEXTS = ["Über the X1-y", None, "", "a  A\tb", "日本 x", " ", "w" * 70_000 + " z", "a b c d e f g"]


@pytest.mark.parametrize("separators, words", [(tokens.SPACES, spaced), (tokens.NOT_ALPHANUMERIC, alphanumeric)])
@pytest.mark.parametrize("size", [16, 1 << 20])
def test_words_have_one_number_each(monkeypatch, separators, words, size):
    monkeypatch.setattr(tokens, "PIECE_BYTES", size)
    numbers, seen = {}, 0
    for piece in tokens.pieces(pa.array(["skipped", *TEXTS]).slice(1), separators):
        for i in range(len(piece)):
            own = piece.words[piece.offsets[i] : piece.offsets[i + 1]].tolist()
            expected = words(TEXTS[piece.first + i])
            assert len(own) == len(expected)
            for word, number in zip(expected, own):
                assert numbers.setdefault(word, number) == number
            seen += 1
    assert seen == len(TEXTS) and len(set(numbers.values())) == len(numbers)


def test_shingles_of_short_rows():
    piece = next(tokens.pieces(pa.array(["a b c d e f", "a b", "", "a b", "b a"]), tokens.SPACES))
    found = [s.tolist() for s in tokens.shingles(piece, 5)]
    assert [len(s) for s in found] == [2, 1, 0, 1, 1]
    assert found[1] == found[3] != found[4]
