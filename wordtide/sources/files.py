"""Text files as rows (S1-S5): listing a folder by mask, decoding, tokens by file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtide.cluster import ship
from wordtide.functions.text import Tokenizer, matches, path_key, space_tokens, text_tokens

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("length", T.LongType()), T.StructField("mtime", T.LongType())])

#: Files beyond so many bytes, and compressed ones, whose size tells nothing, are read piece by piece.
LARGE = 16 << 20
PACKED = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}
_BLOCK = 1 << 20
_ROWS = 20_000


def _local(path: str) -> str | None:
    """The plain path of a local file, of one with the scheme file too; None on other file systems."""
    path = re.sub("^file:/+", "/", path)
    return None if re.match(r"[A-Za-z][\w+.-]*://", path) else os.path.abspath(path)


def _hidden(name: str) -> bool:
    """What Spark's readers leave out: names that begin with . or _ (but for x=y), unfinished copies."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def list_folder(folder: str) -> list[tuple[str, str, int, int, int]]:
    """S4 on the driver: (path, name, length, mtime in ns, file number) of the files directly in a folder; [] on any error."""
    try:
        with os.scandir(folder) as entries:
            out = []
            for e in entries:
                try:
                    if e.is_file():
                        s = e.stat()
                        out.append((os.path.join(os.path.abspath(folder), e.name), e.name, s.st_size, s.st_mtime_ns, s.st_ino))
                except OSError:
                    continue
            return sorted(out)
    except OSError:
        return []


def listed(spark: SparkSession, folder: str, mask: str | None = None) -> DataFrame:
    """FILES of a folder, empty ones too; not recursive. A local folder (or one mounted on all machines) is listed by
    one task that holds a batch of names; on other file systems Spark lists it, on the driver. Hidden names are left out."""
    local = _local(folder)
    if local is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)  # content is not read
        found = found.coalesce(spark.sparkContext.defaultParallelism)  # else a task for a few files each
        rows = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.unix_micros("modificationTime").alias("mtime"))
    else:

        def look(batches):
            import pyarrow as pa

            for _ in batches:
                pass
            out = []
            with os.scandir(local) as entries:
                for e in entries:
                    try:
                        if _hidden(e.name) or not e.is_file():
                            continue
                        e.name.encode()
                        s = e.stat()
                    except (OSError, UnicodeEncodeError):  # gone meanwhile; no name that a string can hold
                        continue
                    out.append((os.path.join(local, e.name), e.name, s.st_size, s.st_mtime_ns // 1_000_000 * 1000))
                    if len(out) == _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=FILES.names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=FILES.names)

        ship(spark)
        rows = spark.range(0, 1, 1, 1).mapInArrow(look, FILES)
    return rows.filter(matches(F.col("name"), [mask]))


def _relation(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """(path), each once, spread over tasks."""
    ship(spark)
    if isinstance(paths, DataFrame):
        return paths.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").dropDuplicates(["path"])
    return spark.createDataFrame([(_local(p) or p,) for p in dict.fromkeys(paths)], "path string")


def _open(path: str):
    """A stream of a file's bytes; files with the endings of PACKED are unpacked."""
    from pyarrow import fs

    store, at = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    return store.open_input_stream(at, compression=PACKED.get(path.rpartition(".")[2]))


def _pieces(path: str) -> Iterator[str]:
    """The text of a file, lines parted by \\n, in pieces of whole lines without the end of their last; as far as it can be read."""
    import codecs
    import io

    rest: list[str] = []
    try:
        with _open(path) as f:
            block = f.read(_BLOCK)
            marked = block[:2] in (b"\xff\xfe", b"\xfe\xff")
            plain = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-16" if marked else "utf-8")("replace"), True)
            block = block.removeprefix(codecs.BOM_UTF8) or f.read(_BLOCK)
            while block:
                text = plain.decode(block)
                cut = text.rfind("\n")
                if cut >= 0:
                    yield "".join([*rest, text[:cut]])
                    rest = []
                rest.append(text[cut + 1 :])
                block = f.read(_BLOCK)
            rest.append(plain.decode(b"", True))
    except OSError:
        pass
    if last := "".join(rest):
        yield last.removesuffix("\n")


def _texts(files: DataFrame, whole: bool, but: frozenset[str] = frozenset()) -> DataFrame:
    """(path, text) of files (path): a row for each file, or one for each of its pieces. Files of but are left out."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            paths, texts, held = [], [], 0
            for p in b.column("path").to_pylist():
                if p in but or _hidden(p.rsplit("/", 1)[1]):
                    continue
                for text in ["\n".join(found)] if whole and (found := [*_pieces(p)]) else () if whole else _pieces(p):
                    paths.append(p)
                    texts.append(text)
                    held += len(text)
                    if held > 4 * _BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])
                        paths, texts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])

    return files.mapInArrow(read, "path string, text string")


def lines(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """(path, line) of text files, given as a list or a relation (path); \\n, \\r and \\r\\n end lines, a UTF-8 mark
    is stripped, bad bytes become U+FFFD. UTF-16 files with a byte-order mark are decoded as such. Files that vanished or
    cannot be read give no rows. Each file is opened once, on an executor, and read piece by piece."""
    return _texts(_relation(spark, paths), False).select("path", F.explode(F.split("text", "\n", -1)).alias("line"))


def _large(files: DataFrame) -> list[str]:
    """Of files (path) those that are too large for a row, or compressed; looked at on the executors."""

    def look(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            found = []
            for p in b.column("path").to_pylist():
                try:
                    if p.startswith("/"):
                        size = os.stat(p).st_size
                    else:
                        store, at = fs.FileSystem.from_uri(p)
                        size = store.get_file_info(at).size or 0
                except OSError:
                    continue
                if size > LARGE or p.rpartition(".")[2] in PACKED:
                    found.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    return [r.path for r in files.mapInArrow(look, "path string").collect()]


def tokens(spark: SparkSession, paths: list[str] | DataFrame, tokenizer: Tokenizer = space_tokens) -> DataFrame:
    """(path, token), each token of a file once; the tokenizer sees single lines.

    Files split at spaces are tokenised as a whole, which needs no shuffle; the large ones, and all files of other
    tokenizers, line by line, and their tokens are made distinct by a shuffle.
    """

    def by_line(some: list[str] | DataFrame) -> DataFrame:
        return lines(spark, some).select("path", F.explode(F.array_distinct(tokenizer(F.col("line")))).alias("token")).distinct()

    if tokenizer is not space_tokens:
        return by_line(paths)
    files = _relation(spark, paths)
    large = _large(files)  # as the files are now: each is read in one of the two ways, even if it grows
    found = _texts(files, True, frozenset(large)).select("path", F.explode(text_tokens(F.col("text"))).alias("token"))
    return found.unionByName(by_line(large)) if large else found


def keyed(files: DataFrame) -> DataFrame:
    """Files with their path keys."""
    return files.withColumn("path_key", path_key(F.col("path")))
