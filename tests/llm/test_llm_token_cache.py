"""op8's encoder: new pieces by the tokenizer's model, and one cache for a worker's tasks."""

import numpy as np

from segrank.llm import token_orc


def test_pieces_by_the_model_are_those_of_the_library():
    encoder = token_orc.worker_encoder(token_orc.tokenizer_path(), token_orc.END_ID)
    texts = ["The quick, BROWN fox's 3.14 naïve¿ façade ÿ÷×", "don't 'll ½ ²³ ¼x µm ªº Straße", "a\tb\r\nc\x0bd", "", None, "x\x1cy ﬁ"]
    for t, packed in zip(texts, encoder.encode(texts)):
        want = encoder.tokenizer.encode(t, add_special_tokens=False).ids if t else []
        assert np.frombuffer(packed, "<u4").tolist() == [*want, token_orc.END_ID], t
    assert encoder.direct
    pieces = list(encoder.known)
    assert dict(encoder.by_model(pieces)) == dict(encoder.pieces(pieces))
    assert token_orc.worker_encoder(token_orc.tokenizer_path(), token_orc.END_ID) is encoder


def test_words_of_one_piece_are_not_split_again(monkeypatch):
    """A word is looked up whole; punctuation, contractions and a cache that overflows change nothing."""
    monkeypatch.setattr(token_orc, "CACHE_PIECES", 6)
    encoder = token_orc.Encoder(token_orc.tokenizer_path(), token_orc.END_ID)
    texts = ["One, two; THREE's four-five. " * 3, "a1b2!?'s'll ! 's s' s! ..., 7, x². µ'", "x" * 100 + ".. \x0b\x0cone, two;", " ".join(f"w{k}'re" for k in range(30))]
    for t, packed in zip(texts * 2, encoder.encode(texts * 2)):
        assert np.frombuffer(packed, "<u4").tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, token_orc.END_ID], t
    assert len(encoder.known) <= 6
    encoder.known.clear()
    split = []
    monkeypatch.setattr(token_orc, "PIECES", type("Pieces", (), {"findall": lambda self, w: split.append(w) or [w]})())
    list(encoder.encode(["one , two one, TWO two, two.. two.."]))
    assert split == [",", "two.."]
