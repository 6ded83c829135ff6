import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F

from wordtide.llm import pieces, wavelet
from wordtide.llm.common import Scratch

EDGES = ["", " ", "  a", "a  b   c ", "\n", "\n\n a\n b", "ab\tcd", "日本語 😀😀 x", "▁a ▁▁b", "aaa aaaa aaaaa", "<s> </s> <unk> <0x0A>", "é é", "don't stop!!! %%% ###", "<|endoftext|> x<|ENDOFTEXT|>", "ΣΑΣ. İx CAN'T, a.b.c 12,5 É. ß. × a× Straße; œuvre, 한국어 x\x1cy\x85z 9. .. !"]


def some(n=600, seed=7):
    rnd = random.Random(seed)
    return EDGES + ["".join(rnd.choice("aabbeinorst  \n.,AéÉ😀1<|>'") for _ in range(rnd.randint(1, 40))) for _ in range(n)]


def test_pieces_are_those_of_the_library(documents):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    texts = some() + [r.text for r in documents.limit(60).collect()]
    got = pieces._encode(pa.array(texts), pieces.VOCABULARY).to_pylist()
    for t, g in zip(texts, got):
        assert g["ids"] == m.encode(t) and g["n_pieces"] == len(g["ids"])
        assert g["ids_crc32"] == zlib.crc32(np.array(g["ids"], "<i4").tobytes()) and g["decoded_ok"]


def test_decoding(spark):
    texts = [(i, t) for i, t in enumerate(some(50))] + [(999, None)]
    df = spark.createDataFrame(texts, "i int, text string").withColumn("e", pieces.encoded(F.col("text")))
    got = {r.i: r.d for r in df.select("i", pieces.decoded(F.col("e.ids")).alias("d")).collect()}
    assert got == {i: (t or "").replace("▁", " ") for i, t in texts}
    assert spark.createDataFrame([(None,)], "i array<int>").select(pieces.decoded(F.col("i")).alias("d")).first().d is None


@pytest.mark.parametrize("seed", range(5))
def test_unigram_viterbi_is_best(seed):
    """Against all segmentations, with words that share prefixes."""
    rnd = random.Random(seed)
    names = ["<unk>", "▁"] + sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(14)} | {"a", "b", "c", "▁a", "▁ab"})
    v = pieces.Vocabulary(names, [0.0] + [-rnd.random() * 9 for _ in names[1:]], pieces.UNIGRAM, [], 0, [False] + [True] * (len(names) - 1))

    def score(w):
        best = [(0.0)] + [None] * len(w)
        for i in range(1, len(w) + 1):
            best[i] = max([best[j] + v.scores[v.id_of[w[j:i]]] for j in range(i) if w[j:i] in v.id_of] + [best[i - 1] + v.worst])
        return best[-1]

    words = sorted({"▁" + "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 9))) for _ in range(200)})
    for w, ids in zip(words, v.encode_sorted(words)):
        assert "".join(v.pieces[i] if i else "" for i in ids) == w.replace("d", "")
        assert abs(sum(v.scores[i] for i in ids if i) + w.count("d") * v.worst - score(w)) < 1e-9


def test_bpe_equals_the_merge_procedure():
    v = pieces.vocabulary(pieces.VOCABULARY)[0]
    rnd = random.Random(2)
    words = sorted({"▁" + "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 12))) for _ in range(300)} | {"▁" * 7 + "x", "aaaaaaa", "▁▁"})
    for w, ids in zip(words, v.encode_sorted(words)):
        assert [v.pieces[i] for i in ids] == [p for p, _ in v.merge(w)]


def test_pieces_odd_rows(odd, none):
    got = odd.select("doc_id", pieces.encoded(F.col("text")).alias("e")).collect()
    assert len(got) == odd.count() and {r.e.n_pieces for r in got if r.doc_id in (1, 2)} == {0}
    assert none.select(pieces.encoded(F.col("text")).alias("e")).count() == 0


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(wavelet.VOCABULARY)
    texts = some()
    got = [x for ids, n in wavelet.encode(pa.array(texts), wavelet.VOCABULARY, 1) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("n,alphabet", [(0, 5), (1, 1), (7, 1), (8, 2), (1000, 3), (70_000, 50), (200_000, 49_408), (5000, 100_000)])
def test_wavelet_file(n, alphabet):
    rng = np.random.default_rng(n + alphabet)
    tokens = (rng.zipf(1.3, n) % alphabet).astype(np.uint32)
    w = wavelet.WaveletFile(wavelet.build(tokens, np.array([3, 9]), np.array([n // 2, n - n // 2])))
    assert (w.tokens() == tokens).all() and w.doc_ids.tolist() == [3, 9] and w.lengths.sum() == n
    for i in rng.integers(0, max(n, 1), 25) if n else []:
        t = int(tokens[i])
        assert w.access(int(i)) == t and w.rank(t, int(i)) == int((tokens[:i] == t).sum()) and w.count(t) == int((tokens == t).sum())
        k = w.rank(t, int(i))
        assert w.select(t, k) == i and w.select(t, w.count(t)) == -1
    assert w.count(99_999_999) == 0 and w.select(99_999_999, 0) == -1 and w.rank(99_999_999, 5) == 0
    with pytest.raises(IndexError):
        w.access(n)


def brute(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(wavelet.VOCABULARY)
    start, out = 0, []
    for i, x in sorted(docs, key=lambda d: -(2**63) if d[0] is None else d[0]):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize("layout", [wavelet.Layout(), wavelet.Layout(file_tokens=3000, range_bytes=40_000)])
def test_files(spark, documents, layout):
    docs = documents.select("doc_id", "text").limit(150)
    m = wavelet.write(spark, docs, Scratch(spark, "t"), layout)
    assert rows(wavelet.read(spark, m)) == brute([tuple(r) for r in docs.collect()])
    assert m.agg(F.sum("n_docs")).first()[0] == 150 and (layout.file_tokens > 3000 or m.count() > 5)


def test_files_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text")
    assert rows(wavelet.read(spark, wavelet.write(spark, odd, Scratch(spark, "t")))) == brute([tuple(r) for r in docs.collect()])
    assert wavelet.read(spark, wavelet.write(spark, none, Scratch(spark, "t"))).count() == 0
