"""Words on which sums of powers modulo 2**64 agree: every operator must tell them apart."""

import numpy as np
import pyarrow as pa
import pytest

from wordtide.llm import chosen_path, fertility, latent, licences, pieces, toxicity, wavelet
from wordtide.llm.textvec import chunks


def pair(n):
    return tuple("".join("ab"[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1))


@pytest.mark.parametrize("n", [1024, 2048])
def test_ids_and_pieces_are_those_of_the_library(n):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = list(pair(n))
    t, m = Tokenizer.from_file(wavelet.VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    got = [x.tolist() for ids, k in wavelet.encode(pa.array(texts), wavelet.NAME, 1) for x in np.split(ids, np.cumsum(k)[:-1])]
    assert got == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]
    assert [r["ids"] for r in pieces._encode(pa.array(texts), pieces.NAME).to_pylist()] == [m.encode(x) for x in texts]
    measured = fertility._measure(pa.array(texts), pa.array(["en", "en"]), fertility.Rules()).to_pylist()
    assert [r["n_tokens"] for r in measured] == [len(m.encode(x)) for x in texts]


def test_sets_weights_terms_and_cues():
    a, b = pair(1024)
    one, two = chosen_path.shingle_sets(pa.array([f"x y {a} z", f"x y {b} z"]))
    assert len(np.intersect1d(one, two)) == 0
    twice = fertility._measure(pa.array([f"{a} x y {b} x y"]), pa.array(["en"]), fertility.Rules()).to_pylist()[0]
    assert twice["n_repeat_words"] == 0
    found = toxicity._score(pa.array([a, b]), toxicity.Model({a + "$": 5.0, b + "$": -5.0})).to_pylist()
    assert [len(r["passages"]) for r in found] == [1, 0]
    (c,) = chunks(pa.array([f"{a} {b}"]))
    assert latent.Terms([a, b]).features(c.words()).tolist() == [0, 1]
    model = licences.Model([], {}, np.zeros(2), 1.0, frozenset([b.encode()]), licences.Scan())
    flat, start, _, word = licences._cues(model).of(c.words())
    assert flat[start][word].tolist() == [False, True]
