"""Token ids as one compressed, indexed file for each shard: a wavelet matrix.

The distinct ids of a file are ranked by frequency and each token's rank is spread over bit
planes, most significant first; before each next plane the tokens are stably parted by the bit
just written.  Planes are cut into blocks, each stored plain or zstd-compressed (frequent ids have
small ranks, so upper planes are nearly all zero), with the number of ones before each block.
From the file alone follow, without unpacking it: `access` (token at a position), `rank` and
`count` (how often an id occurs before a position, in all), `select` (where the k-th occurrence
is) and `documents`; `tokens` unpacks everything.

Writing: ids are encoded and written once, parted by ranges of (doc_id, checksum), sorted within a
range and streamed into files of at most `file_tokens` tokens, so a task's memory does not depend
on the range.  Ranges are Spark's own, of a sample of bounded size; rows that share a doc_id are
parted too, so a hot id is no hot task.  A file is written under another name and then renamed; a
task that is run again writes the same bytes.  A manifest row for each file makes the set of files
complete.

Defined results: null and empty texts are the end id alone; rows that repeat a doc_id follow each
other in the order of their ids' checksum; a null doc_id sorts first and is stored as such; a very
long document is one document of one file, of whatever size; no rows give no files; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtide.llm.common import Scratch, table, vocabulary_file
from wordtide.llm.textvec import Chunk, Units, WordTable, cached, chunks, gather, mix

NAME = "word_bpe_49k.json"  # a public vocabulary, looked up on the machine that uses it
VOCABULARY = vocabulary_file(NAME)
END_ID = 1
MAGIC = b"WVMX0001"
BLOCK = 8192  # bytes of a plane's block
NULL_ID = -(2**63)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class Layout:
    vocabulary: str = NAME
    end_id: int = END_ID
    file_tokens: int = 4_000_000
    range_bytes: int = 12_000_000  # encoded ids of a range of doc_ids, about; one task each


# ---------------------------------------------------------------- the file


def _blocks(raw: bytes) -> tuple[list[bytes], list[int]]:
    pack, out, sizes = zstandard.ZstdCompressor(level=1), [], []
    for i in range(0, len(raw), BLOCK):
        plain = raw[i : i + BLOCK]
        small = pack.compress(plain)
        out.append(small if len(small) < 0.95 * len(plain) else plain)
        sizes.append(len(out[-1]) if out[-1] is not plain else -len(plain))
    return out, sizes


def build(tokens: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of some documents: their tokens end to end (below 2**32), ids and token counts."""
    n = len(tokens)
    counts = np.bincount(tokens) if n else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(counts)
    order = np.lexsort((alphabet, -counts[alphabet]))
    wide = np.uint16 if len(alphabet) <= 65536 else np.uint32
    place = np.zeros(len(counts), wide)
    place[alphabet[order]] = np.arange(len(order), dtype=wide)
    seq = place[tokens]
    levels = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
    body: list[bytes] = []
    planes = []
    for level in range(levels):
        bit = (seq >> wide(levels - 1 - level)) & wide(1) != 0
        packed = np.packbits(bit)
        ones = np.add.reduceat(_ONES[packed].astype(np.int64), np.arange(0, len(packed), BLOCK))
        blocks, sizes = _blocks(packed.tobytes())
        body += blocks
        planes.append({"zeros": n - int(ones.sum()), "sizes": sizes, "ones": np.concatenate(([0], np.cumsum(ones)[:-1])).tolist()})
        if level < levels - 1:
            seq = np.concatenate((seq[np.flatnonzero(~bit)], seq[np.flatnonzero(bit)]))  # twice as fast as by mask
    extra = [np.ascontiguousarray(x, t).tobytes() for x, t in ((alphabet[order], "<u4"), (doc_ids, "<i8"), (lengths, "<i8"))]
    extra = [zstandard.ZstdCompressor(level=3).compress(x) for x in extra]
    head = zstandard.ZstdCompressor(level=3).compress(json.dumps({"n": n, "docs": len(doc_ids), "levels": levels, "planes": planes, "extra": [len(x) for x in extra]}).encode())
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *extra, *body])


class WaveletFile:
    """Reads a file made by `build`; `raw` is its bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        unpack = zstandard.ZstdDecompressor().decompress
        size = int.from_bytes(raw[8:16], "little")
        h = json.loads(unpack(raw[16 : 16 + size]))
        at = 16 + size
        parts = []
        for x in h["extra"]:
            parts.append(unpack(raw[at : at + x]) if x else b"")
            at += x
        self.n, self.levels, self._raw = h["n"], h["levels"], raw
        self.alphabet, self.doc_ids, self.lengths = np.frombuffer(parts[0], "<u4"), np.frombuffer(parts[1], "<i8"), np.frombuffer(parts[2], "<i8")
        self.zeros = [p["zeros"] for p in h["planes"]]
        self._ones = [np.array(p["ones"], np.int64) for p in h["planes"]]
        self._where = []
        for p in h["planes"]:
            where = []
            for s in p["sizes"]:
                where.append((at, abs(s), s < 0))
                at += abs(s)
            self._where.append(where)
        self._place: dict[int, int] | None = None
        self._seen: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, k: int) -> np.ndarray:
        key = (level, k)
        if key not in self._seen:
            if len(self._seen) > 256:
                self._seen.clear()
            at, size, plain = self._where[level][k]
            raw = self._raw[at : at + size]
            self._seen[key] = np.frombuffer(raw if plain else zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        return self._seen[key]

    def _bit_rank(self, level: int, i: int) -> tuple[int, int]:
        """(bit at i, ones before i) of a plane; the bit is 0 at the end."""
        if i >= self.n:
            return 0, self.n - self.zeros[level]
        k, off = divmod(i, BLOCK * 8)
        block = self._block(level, k)
        byte, bit = divmod(off, 8)
        v = int(block[byte])
        return v >> (7 - bit) & 1, int(self._ones[level][k]) + int(_ONES[block[:byte]].sum()) + bin(v >> (8 - bit)).count("1")

    def _rank_of(self, token: int) -> int | None:
        if self._place is None:
            self._place = {int(a): i for i, a in enumerate(self.alphabet)}
        return self._place.get(token)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        r = 0
        for level in range(self.levels):
            bit, ones = self._bit_rank(level, i)
            r = r << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[r])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token in [0, i)."""
        r = self._rank_of(token)
        if r is None or not self.n:
            return 0
        a, b = 0, min(max(i, 0), self.n)
        for level in range(self.levels):
            x, y = self._bit_rank(level, a)[1], self._bit_rank(level, b)[1]
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if r >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), or -1."""
        r = self._rank_of(token)
        if r is None or k < 0 or k >= self.count(token):
            return -1
        a = 0
        for level in range(self.levels):
            x = self._bit_rank(level, a)[1]
            a = self.zeros[level] + x if r >> (self.levels - 1 - level) & 1 else a - x
        i = a + k
        for level in reversed(range(self.levels)):
            one = r >> (self.levels - 1 - level) & 1
            i = self._bit_select(level, one, i - self.zeros[level] if one else i)
        return i

    def _bit_select(self, level: int, bit: int, k: int) -> int:
        start = np.arange(len(self._ones[level]), dtype=np.int64) * (BLOCK * 8)
        before = self._ones[level] if bit else start - self._ones[level]
        b = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, b)) == bit
        return int(start[b]) + int(np.flatnonzero(bits)[k - int(before[b])])

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the partings from the last plane up."""
        values = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 65536 else np.uint32)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(np.concatenate([self._block(level, k) for k in range(len(self._where[level]))]), count=self.n).view(bool)
            back = np.empty_like(values)
            back[np.flatnonzero(~bit)] = values[: self.zeros[level]]
            back[np.flatnonzero(bit)] = values[self.zeros[level] :] | values.dtype.type(1 << (self.levels - 1 - level))
            values = back
        return self.alphabet[values]


# ---------------------------------------------------------------- encoding

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,!?;:")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary shows each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(plain, map(chr, plain)))
    shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return shown


class _Encoder:
    """Token ids of words by the tokenizers library.

    Words of Latin letters alone need none of the vocabulary's normaliser and splitting; many of
    them go to its merge model in one call. All other words take the whole way, one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        self.dtype = np.uint16 if self.model.get_vocab_size() <= 65536 else np.uint32
        steps = spec.get("normalizer") or {}
        self.folds = "Lowercase" in [s.get("type") for s in steps.get("normalizers", [steps])]
        suffix = spec["model"].get("end_of_word_suffix")
        self.bare = None
        if self.folds and suffix:
            spec |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(spec))
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.closes = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.closes[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            shown = _byte_letters()
            self.shown = {i: "".join(shown[b] for b in chr(i).encode()) for i in range(128, 256)}
            tests = ["the", "straße", "élève", "zzyzx", "naïveté", "abcdefghijklmnop"]
            flat, lens = self._letters(tests)
            if [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] != [e.ids for e in self.model.encode_batch_fast(tests, add_special_tokens=False)]:
                self.bare = None

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        lines = [t if t.isascii() else t.translate(self.shown) for t in lines]
        flat = np.array([i for e in self.bare.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], self.dtype)
        return flat, np.diff(np.flatnonzero(self.closes[flat]), prepend=-1)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [(w.lower() if self.folds and b"<" not in w else w).decode("utf-8", "replace") for w in words]
        quick = [self.bare is not None and t.isalpha() and (t.isascii() or max(t) <= "\xff") for t in texts]
        easy = [t.lower() for t, q in zip(texts, quick) if q]
        flat, lens = self._letters(easy) if easy else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        if len(lens) != len(easy):  # a word that the merge model did not close: take the whole way
            quick, flat, lens = [False] * len(texts), flat[:0], lens[:0]
        rest = [e.ids for e in self.model.encode_batch_fast([t for t, q in zip(texts, quick) if not q], add_special_tokens=False)]
        flat = np.concatenate((flat, np.array([i for x in rest for i in x], self.dtype)))
        lens = np.concatenate((lens, np.array([len(x) for x in rest], np.int64)))
        q = np.array(quick, bool)
        order = np.empty(len(texts), np.int64)
        order[q], order[~q] = np.arange(q.sum()), np.arange(q.sum(), len(texts))
        start = np.cumsum(lens) - lens
        return gather(flat, start[order], lens[order]), lens[order]


def _word_ids(path: str) -> tuple[_Encoder, WordTable]:
    return cached(("ids", path), lambda: (e := _Encoder(vocabulary_file(path)), WordTable(e, 1_200_000)))


def _units(c: Chunk, folds: bool) -> Units:
    """Words, cut at ASCII white space, across which no token reaches. Where the vocabulary folds case,
    one entry serves all cases, and a mark after Latin letters, which it splits off, is a unit of its own."""
    u = c.words()
    if not folds or not len(u.starts):
        return u
    d = c.data
    letter = _LETTER[d]
    if len(d) > 1:
        two = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] != 0x97) & (d[1:] != 0xB7)
        letter[:-1] |= two
        letter[1:] |= two
    sums = np.concatenate(([0], np.cumsum(letter)))
    last = u.ends - 1
    cut = (last > u.starts) & _PUNCTUATION[d[last]] & (sums[last] - sums[u.starts] == last - u.starts)
    again = np.repeat(np.arange(len(cut)), 1 + cut)
    second = np.concatenate(([False], again[1:] == again[:-1]))
    starts = np.where(second, u.ends[again] - 1, u.starts[again])
    ends = np.where(cut[again] & ~second, u.ends[again] - 1, u.ends[again])
    lower = c.units(starts, ends, lower=True)
    open_ = np.concatenate(([0], np.cumsum(d == 60)))
    special = np.flatnonzero(open_[ends] > open_[starts])  # may hold special tokens, which are told apart by case
    if len(special):
        exact = c.units(starts[special], ends[special])
        lower.hash[special], lower.check[special] = mix(exact.hash ^ np.uint64(0x3C3C)), exact.check
    return lower


def encode(text: pa.Array, path: str, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids end to end, number of ids of each text with its end id), in order."""
    encoder, known = _word_ids(path)
    for c in chunks(text):
        u = _units(c, encoder.folds)
        flat, start, length, word = known.of(u)
        each = length[word].astype(np.int64)
        n = np.bincount(u.doc, weights=each, minlength=c.texts).astype(np.int64)
        ends = np.cumsum(n + 1) - 1
        ids = np.full(int(n.sum()) + c.texts, end_id, encoder.dtype)
        inner = np.ones(len(ids), bool)
        inner[ends] = False
        ids[inner] = gather(flat, start[word], each)
        yield ids, n + 1


def _encoded(text: Column, layout: Layout) -> Column:
    @F.arrow_udf(T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("crc", T.LongType())]))
    def ids_of(text: pa.Array) -> pa.Array:
        out, crc = [], []
        for ids, n in encode(text, layout.vocabulary, layout.end_id):
            raw, cut = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(n))).tolist()
            short = ids.astype("<u2").tobytes() if ids.dtype == np.uint16 else None
            for a, b in zip(cut[:-1], cut[1:]):
                crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                out.append(b"\x02" + short[2 * a : 2 * b] if short is not None else b"\x04" + raw[4 * a : 4 * b])
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(crc, pa.int64())], names=["ids", "crc"])

    return ids_of.asNondeterministic()(text)


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1)


def _write(folder: str):
    def put(path: str, raw: bytes, token: int) -> None:
        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(at), recursive=True)
        with store.open_output_stream(f"{at}.{token}.tmp") as f:
            f.write(raw)
        try:
            store.move(f"{at}.{token}.tmp", at)
        except OSError:  # some file systems do not replace: an earlier attempt wrote the same bytes
            if store.get_file_info(at).size != len(raw):
                raise
            store.delete_file(f"{at}.{token}.tmp")

    def run(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, part = TaskContext.get().taskAttemptId(), TaskContext.get().partitionId()
        k, held, ids, tokens = 0, 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal k, held
            if not ids:
                return
            name = f"{folder}/{part:08d}-{k:05d}.wvm"
            lengths = np.array([len(t) for t in tokens], np.int64)
            put(name, build(np.concatenate(tokens), np.array(ids, np.int64), lengths), attempt)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(lengths)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], names=["path", "range", "file", "n_docs", "n_tokens"])
            k, held = k + 1, 0
            ids.clear()
            tokens.clear()

        for b in batches:
            for doc, raw in zip(b.column("doc_id").fill_null(NULL_ID).to_pylist(), b.column("ids")):
                mine = _ids(raw.as_py())
                if held and held + len(mine) > most:
                    yield from flush()
                ids.append(doc)
                tokens.append(mine)
                held += len(mine)
        yield from flush()

    return run


def write(spark: SparkSession, docs: DataFrame, scratch: Scratch, layout: Layout = Layout()) -> DataFrame:
    """Writes docs (doc_id, text) and returns the manifest (path, range, file, n_docs, n_tokens), written."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = scratch.keep(docs.select("doc_id", _encoded(F.col("text"), layout).alias("e")).select("doc_id", "e.ids", "e.crc"), "encoded")
    size = int(encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0)
    folder = scratch.path("ids")
    # equal rows of one id may lie in any range: their order does not tell
    rows = encoded.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-size // layout.range_bytes)), "doc_id", "crc", "row")
    rows = rows.sortWithinPartitions("doc_id", "crc", "ids").select("doc_id", "ids")
    run, most = _write(folder), layout.file_tokens
    out = scratch.keep(rows.mapInArrow(lambda batches: run(batches, most), "path string, range int, file int, n_docs long, n_tokens long"), "manifest")
    scratch.drop(encoded)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_stream(at) as f:
                w = WaveletFile(f.read())
            raw, cut = w.tokens().astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(w.lengths)))
            crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(w.doc_ids, mask=w.doc_ids == NULL_ID), pa.array(base + cut[:-1]), pa.array(w.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # ranges are as many as tasks wrote files, so one task adds them up; files within a range are added up apart
    ranges = manifest.groupBy("range").agg(F.sum("n_tokens").alias("n_tokens")).select("range", before(Window.orderBy("range")).alias("first"))
    files = manifest.withColumn("within", before(Window.partitionBy("range").orderBy("file"))).join(ranges, "range").withColumn("base", F.col("first") + F.col("within"))
    n = max(1, manifest.count())
    return files.select("path", "base").repartition(min(n, 4096)).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(spark, table(spark, sf_dir, "documents"), Scratch(spark, "ids")))
