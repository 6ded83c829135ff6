import random

import numpy as np
import pyarrow as pa

from wordtide.llm.textvec import WordTable, chunks, gather, windows3


def texts(n=300, seed=1):
    rnd = random.Random(seed)
    return [None if rnd.random() < 0.05 else "".join(rnd.choice("ab é\t\n\r\x0b\x0c\x1c 日") for _ in range(rnd.randrange(40))) for _ in range(n)]


def split(t):
    return (t or "").encode().split()


def test_words_are_runs_of_non_space():
    ts = texts()
    for most in (7, 100, 10**6):
        got = []
        for c in chunks(pa.array(ts, pa.string()), most):
            u = c.words()
            words = u.bytes_at(np.arange(len(u.hash)))
            got += [[w for w, d in zip(words, u.doc.tolist()) if d == i] for i in range(c.texts)]
        assert got == [split(t) for t in ts]


def test_hash_names_the_bytes():
    ts = texts(500, 2)
    seen = {}
    for lower in (False, True):
        for c in chunks(pa.array(ts, pa.string()), 64):
            u = c.words(lower)
            for w, h in zip(u.bytes_at(np.arange(len(u.hash))), u.hash.tolist()):
                assert seen.setdefault((lower, w), h) == h
    for lower in (False, True):
        mine = [h for (k, _), h in seen.items() if k == lower]
        assert len(set(mine)) == len({w.lower() if lower else w for k, w in seen if k == lower})
    (c,) = chunks(pa.array(["Ab aB É é"]))
    h = c.words(lower=True).hash
    assert h[0] == h[1] and h[2] != h[3]  # only ASCII is folded


def test_slices_and_types():
    a = pa.array(["x", "a b", None, "c"]).slice(1)
    for column in (a, a.cast(pa.large_string()), pa.chunked_array([a, a.slice(0, 0)])):
        assert [c.words().counts().tolist() for c in chunks(column)] == [[2, 0, 1]]
    assert list(chunks(pa.array([], pa.string()))) == []


def test_windows():
    (c,) = chunks(pa.array(["a b c d", "a b", "b c d"]))
    at, h = windows3(c.words())
    assert at.tolist() == [0, 1, 6] and h[1] == h[2] != h[0]


def test_table_forgets_but_never_errs():
    calls = []

    def compute(ws):
        calls.append(len(ws))
        return np.array([b for w in ws for b in w], np.int32), np.array([len(w) for w in ws])

    for limit in (3, 50, 10**6):
        t = WordTable(compute, limit)
        for c in chunks(pa.array(texts(200, 3), pa.string()), 60):
            u = c.words()
            flat, start, length, word = t.of(u)
            assert bytes(gather(flat, start[word], length[word]).tolist()) == b"".join(u.bytes_at(np.arange(len(u.hash))))
    assert gather(np.arange(5), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def thue_morse(n, turned=0):
    return "".join("ab"[(i.bit_count() + turned) % 2] for i in range(n))


def test_words_of_one_linear_hash_have_names_of_their_own():
    """Thue-Morse words and their complements, on which sums of powers modulo 2**64 agree."""
    for n in (16, 32, 64, 1024, 2048):
        (c,) = chunks(pa.array([f"{thue_morse(n)} {thue_morse(n, 1)} {thue_morse(n)}"]))
        u = c.words()
        assert u.hash[0] == u.hash[2] != u.hash[1] and u.check[0] == u.check[2] != u.check[1]


def test_every_byte_of_a_word_counts():
    for n in (*range(1, 70), 200):
        words = {bytes(97 + (j == i) for j in range(n)) for i in range(n)} | {b"a" * n, b"a" * (n + 1), b"a" * n + b"\x01"}
        (c,) = chunks(pa.array([b" ".join(sorted(words)).decode()]))
        u = c.words()
        assert len(set(u.hash.tolist())) == len(words) == len(set(u.check.tolist()))


def test_table_tells_words_of_one_hash_apart():
    seen = []

    def compute(ws):
        seen.extend(ws)
        return np.array([w[0] for w in ws], np.int32), np.ones(len(ws), np.int32)

    (c,) = chunks(pa.array(["a b c a", "b"]))
    t = WordTable(compute)
    t.of(c.words())
    for clash in (c.words(), c.words()):
        clash.hash[:] = 7
        flat, start, _, word = t.of(clash)
        assert flat[start][word].tolist() == [97, 98, 99, 97, 98]
    later = WordTable(compute)
    for k, text in enumerate(("a", "b", "a b")):
        (c,) = chunks(pa.array([text]))
        u = c.words()
        u.hash[:] = 7
        flat, start, _, word = later.of(u)
        assert flat[start][word].tolist() == [ord(x) for x in text.split()], k
