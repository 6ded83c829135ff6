"""SentencePiece encoding and decoding by a Viterbi search that words with a common beginning share.

A text falls into marked words (a run of spaces, shown as U+2581, and what follows; a line feed is
a word of its own), and no piece of a public vocabulary spans two of them.  Of a batch only the
distinct marked words are segmented.  They are sorted, which lays their trie out in depth-first
order, and walked with one stack of forward states: a word starts from the states of the prefix it
shares with the word before and computes only the rest.

The forward state of a prefix depends on the model:

* unigram: the best score of any segmentation, and its last piece;
* BPE: the last piece of the one segmentation that the merges yield.  A piece may follow another
  exactly if the merges leave the two apart when they stand alone, so the state of a prefix follows
  from the states of shorter prefixes here too, and the result is that of the merge procedure.

Characters without a piece fall back to byte pieces, or to the unknown piece.  One pass, no shuffle.

Defined results: null and empty texts have no pieces and decode to an empty text; repeated rows
encode alike; very long texts are whole; other columns stay.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtide.llm.common import table, vocabulary_file
from wordtide.llm.textvec import Chunk, Units, WordTable, cached, chunks, gather, mix

NAME = "piece_bpe_32k.model"  # a public vocabulary, looked up on the machine that uses it
VOCABULARY = vocabulary_file(NAME)
MARK = "▁"
UNIGRAM, BPE = 1, 2
_NONE = -1


def _fields(buf: bytes):
    """(number, value) of a protocol buffer's fields; only varints, fixed and length-delimited ones."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = s = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << s
            s += 7
            if b < 128:
                return x

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, buf[i : i + n]
            i += n


@dataclass
class Vocabulary:
    """Pieces with scores, and what segmentation needs of them."""

    pieces: list[str]
    scores: list[float]
    kind: int  # UNIGRAM or BPE
    bytes_of: list[int]  # piece id of each byte value, or empty
    unknown: int
    usable: list[bool]  # may stand in a segmentation
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind, dummy = UNIGRAM, True
        for number, value in _fields(m.serialized_model_proto()):
            if number == 2:
                kind = next((v for k, v in _fields(value) if k == 3), UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                dummy = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only vocabularies without a normaliser and with white space kept are supported")
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
        to_byte = {m.id_to_piece(i): i for i in range(n) if m.is_byte(i)}
        return cls(pieces, [m.get_score(i) for i in range(n)], kind, [to_byte[f"<0x{b:02X}>"] for b in range(256)] if len(to_byte) == 256 else [], m.unk_id(), plain, dummy)

    def __post_init__(self) -> None:
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.usable[i]}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece spans marked words")
        self.longest = max(map(len, self.id_of), default=1)
        self.bytes_flat = np.frombuffer(b"".join(self.decoded(i) for i in range(len(self.pieces))), np.uint8)
        self.bytes_len = np.array([len(self.decoded(i)) for i in range(len(self.pieces))], np.int32)
        self.bytes_start = np.cumsum(self.bytes_len, dtype=np.int64) - self.bytes_len
        self.worst = min((self.scores[i] for i in self.id_of.values()), default=0.0) - 10.0
        self._apart: dict[int, bool] = {}
        if self.kind == BPE:
            order = sorted(self.id_of.values(), key=lambda i: (-self.scores[i], i))
            self.rank = {i: r for r, i in enumerate(order)}
            self.halves: dict[int, tuple[int, int]] = {}
            self.id_of = {p: i for p, i in self.id_of.items() if len(p) == 1 or self._find_halves(p, i)}

    def decoded(self, i: int) -> bytes:
        if self.bytes_of and self.bytes_of[0] <= i <= self.bytes_of[255] and self.pieces[i].startswith("<0x"):
            return bytes([int(self.pieces[i][3:5], 16)])
        if i == self.unknown:
            return " ⁇ ".encode()
        return self.pieces[i].replace(MARK, " ").encode() if self.usable[i] else b""

    def merge(self, s: str) -> list[tuple[str, tuple[str, str] | None]]:
        """The merge procedure on a short string: (piece, the two that it was merged of)."""
        parts: list[tuple[str, tuple[str, str] | None]] = [(c, None) for c in s]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k][0] + parts[k + 1][0])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                break
            a, b = parts[at][0], parts[at + 1][0]
            parts[at : at + 2] = [(a + b, (a, b))]
        return parts

    def _find_halves(self, p: str, i: int) -> bool:
        parts = self.merge(p)
        if len(parts) > 1:
            return False  # no merges lead to it
        a, b = parts[0][1]
        self.halves[i] = (self.id_of.get(a, _NONE), self.id_of.get(b, _NONE))
        return True

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges keep piece a and a following piece b apart."""
        key = a << 32 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            known = self._apart[key] = self._keeps_apart(a, b)
        return known

    def _keeps_apart(self, a: int, b: int) -> bool:
        # Undo the later merge of the two again and again; were the pieces that met at the seam then
        # to merge before the merge just undone, a and b could not both arise. Ties go to the left.
        pieces, rank, halves, id_of = self.pieces, self.rank, self.halves, self.id_of
        limit = len(pieces) + 1  # merges of a rank below limit happen in this state
        while True:
            joint = id_of.get(pieces[a] + pieces[b])
            if joint is not None and rank[joint] < limit:
                return False
            ha, hb = halves.get(a), halves.get(b)
            if ha is None and hb is None:
                return True
            if hb is None or (ha is not None and rank[a] > rank[b]):
                limit, a = rank[a], ha[1]
            else:
                limit, b = rank[b] + 1, hb[0]

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each marked word of a sorted list."""
        return self._walk(words, self._extend_bpe if self.kind == BPE else self._extend_unigram)

    def _walk(self, words: list[str], extend) -> list[list[int]]:
        out, last = [], ""
        self._from, self._piece, self._best = [0], [_NONE], [0.0]  # forward states of the prefixes of `last`
        for w in words:
            shared, most = 0, min(len(w), len(last))
            while shared < most and w[shared] == last[shared]:
                shared += 1
            del self._from[shared + 1 :], self._piece[shared + 1 :], self._best[shared + 1 :]
            extend(w, shared)
            last, ids, i = w, [], len(w)
            while i:
                p, j = self._piece[i], self._from[i]
                if p != _NONE:
                    ids.append(p)
                elif self.bytes_of:
                    ids += [self.bytes_of[b] for b in reversed(w[j:i].encode())]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)  # a run of unknown characters is one piece
                i = j
            ids.reverse()
            out.append(ids)
        return out

    def _extend_bpe(self, w: str, shared: int) -> None:
        get, apart, known = self.id_of.get, self._apart, self._piece
        for i in range(shared + 1, len(w) + 1):
            for j in range(max(0, i - self.longest), i):
                t = get(w[j:i])
                if t is None:
                    continue
                before = known[j]
                if before == _NONE:
                    break
                ok = apart.get(before << 32 | t)
                if ok or (ok is None and self.apart(before, t)):
                    break
            else:
                t, j = _NONE, i - 1
            self._from.append(j)
            known.append(t)

    def _extend_unigram(self, w: str, shared: int) -> None:
        for i in range(shared + 1, len(w) + 1):
            best, where, piece = self._best[i - 1] + self.worst, i - 1, _NONE
            for j in range(max(0, i - self.longest), i):
                t = self.id_of.get(w[j:i])
                if t is not None and self._best[j] + self.scores[t] > best:
                    best, where, piece = self._best[j] + self.scores[t], j, t
            self._best.append(best)
            self._from.append(where)
            self._piece.append(piece)


def vocabulary(path: str) -> tuple[Vocabulary, WordTable]:
    def make() -> tuple[Vocabulary, WordTable]:
        v = Vocabulary.load(vocabulary_file(path))

        def compute(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            texts = [w.decode().replace(" ", MARK) for w in words]
            order = sorted(range(len(texts)), key=texts.__getitem__)
            ids: list[list[int]] = [[]] * len(texts)
            for i, x in zip(order, v.encode_sorted([texts[i] for i in order])):
                ids[i] = x
            return np.array([p for x in ids for p in x], np.int32), np.array([len(x) for x in ids], np.int32)

        return v, WordTable(compute)

    return cached(("pieces", path), make)


class _Marked(Units):
    """Units some of which have a space before them that is not in the text."""

    opens: np.ndarray

    def bytes_at(self, which: np.ndarray) -> list[bytes]:
        return [b" " + w if o else w for w, o in zip(super().bytes_at(which), self.opens[which].tolist())]


def marked_words(c: Chunk, dummy_prefix: bool) -> Units:
    n = len(c.data)
    space, line = c.data == 32, c.data == 10
    start = line.copy()
    start[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    firsts = c.offsets[:-1][c.offsets[:-1] < c.offsets[1:]]
    start[firsts] = True
    starts = np.flatnonzero(start)
    u = c.units(starts, np.append(starts[1:], n))
    opens = np.isin(starts, firsts) & dummy_prefix
    u = _Marked(c, u.starts, u.ends, u.doc, np.where(opens, mix(u.hash ^ np.uint64(0x7E5)), u.hash), np.where(opens, ~u.check, u.check))
    u.opens = opens
    return u


TYPE = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_ok", T.BooleanType())])


def _encode(text: pa.Array, path: str) -> pa.Array:
    v, known = vocabulary(path)
    if pc.any(pc.match_substring(text, MARK)).as_py():
        text = pc.replace_substring(text, MARK, " ")  # the model takes both for the same
    ids_out, counts, crc, same = [], [], [], []
    for c in chunks(text):
        u = marked_words(c, v.dummy_prefix)
        flat, start, length, word = known.of(u)
        each = length[word]
        ids = gather(flat, start[word], each)
        n = np.bincount(u.doc, weights=each, minlength=c.texts).astype(np.int64)
        ids_out.append(ids)
        counts.append(n)
        cut = np.concatenate(([0], np.cumsum(n)))
        raw = ids.astype("<i4").tobytes()
        crc += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        same += [a == b for a, b in zip(_decode(v, ids, cut), (c.data[a:b].tobytes() for a, b in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist())))]
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    values = np.concatenate(ids_out) if ids_out else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int32()))
    return pa.StructArray.from_arrays([lists, pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=[f.name for f in TYPE.fields])


def _decode(v: Vocabulary, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """UTF-8 of texts whose pieces lie end to end in ids."""
    size = v.bytes_len[ids]
    raw = gather(v.bytes_flat, v.bytes_start[ids], size).tobytes()
    at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[cut].tolist()
    drop = int(v.dummy_prefix)
    return [raw[a + drop if b > a and raw[a : a + drop] == b" " else a : b] for a, b in zip(at[:-1], at[1:])]


def encoded(text: Column, path: str = NAME) -> Column:
    """A struct (ids, n_pieces, ids_crc32, decoded_ok) for each text; decoded_ok: decoding gives the text,
    with U+2581 in it as the space that the model takes it for."""

    @F.arrow_udf(TYPE)
    def pieces(text: pa.Array) -> pa.Array:
        return _encode(text, path)

    return pieces.asNondeterministic()(text)


def decoded(ids: Column, path: str = NAME) -> Column:
    """The text of each array of piece ids; null for null. Bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        v, _ = vocabulary(path)
        values, n = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        out = [x.decode("utf-8", "replace") for x in _decode(v, values, np.concatenate(([0], np.cumsum(n))))]
        return pc.if_else(ids.is_valid(), pa.array(out, pa.string()), pa.scalar(None, pa.string()))

    return text(ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", encoded(F.col("text")).alias("e")).select("doc_id", "e.*")
