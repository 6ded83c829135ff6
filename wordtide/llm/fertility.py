"""Quality rules by tokeniser fertility.

How a public sub-word vocabulary takes a text apart says whether it looks like the prose the
vocabulary was made for: *characters per token* (low for shouting, codes and tables), *byte
fallback share* (high for scripts or symbols that the vocabulary lacks) and *token entropy* (low
where few tokens recur: tables, symbol stuffing, templates).  Entropy rises with length, so its
floor is a curve over log2(tokens), one for each language.

One pass over the documents, no shuffle: an Arrow UDF measures a batch of whole texts with array
arithmetic; the sub-word vocabulary sees each distinct word of a batch once, and not even that if
the worker still knows it.

Defined results: null and empty texts have zero counts and fail the base rule; a language without
a band gets the band of its script, an unknown script the widest band; repeated rows are judged
alike; very long texts are measured whole (about 60 bytes of memory a byte of the longest); other
columns of the input, whatever their names, are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordtide.llm.common import clear_name, table, vocabulary_file
from wordtide.llm.textvec import SPACE, Chunk, Units, WordTable, cached, chunks, gather, mix, windows3

NAME = "piece_bpe_32k.model"  # a public vocabulary, looked up on the machine that uses it
VOCABULARY = vocabulary_file(NAME)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What a text may measure. The entropy floor is a + b*x + c*x*x less `slack`, x = log2(tokens)."""

    chars_per_token: tuple[float, float] = (1.2, 8.0)
    max_byte_share: float = 0.25
    entropy: tuple[float, float, float] = (1.9, 0.75, -0.03)
    slack: float = 1.2


#: Of prose in these languages under the vocabulary named above: medians fitted once on texts that
#: `labels` calls good; slack lies beyond the least of them.
LANGUAGES = {
    "en": Band((1.70, 6.0), 0.15, (1.657, 0.849, -0.034), 0.42),
    "fr": Band((1.62, 6.0), 0.15, (2.783, 0.615, -0.024), 0.42),
    "de": Band((1.75, 6.0), 0.15, (2.239, 0.722, -0.028), 0.42),
    "es": Band((1.62, 6.0), 0.15, (1.882, 0.790, -0.031), 0.42),
}
#: For languages not listed, by the script of most letters: Latin, other two-byte scripts (Greek,
#: Cyrillic, Arabic and so on), three-byte scripts (Indic, CJK and so on), where fallback is usual.
SCRIPTS = {"latin": Band(), "two_byte": Band((0.8, 8.0), 0.6), "three_byte": Band((0.2, 8.0), 1.0, (0.0, 0.5, -0.02), 1.5)}


@dataclass(frozen=True)
class Rules:
    vocabulary: str = NAME
    languages: dict[str, Band] = field(default_factory=lambda: LANGUAGES)
    scripts: dict[str, Band] = field(default_factory=lambda: SCRIPTS)


FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()),
    ("reason", pa.string()), ("kept", pa.bool_()),
]
_SPARK = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType()}
TYPE = T.StructType([T.StructField(n, _SPARK[t]) for n, t in FIELDS])


class _Pieces:
    """Token ids of words under a SentencePiece vocabulary, many words to a call."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.opens = np.array([self.model.id_to_piece(i).startswith("▁") for i in range(n)])
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        texts = [w.decode("utf-8", "replace") for w in words]
        if all("▁" not in t for t in texts):
            ids = np.array(self.model.encode(" ".join(texts), num_threads=1), np.int32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(texts):
                return ids, np.diff(np.append(at, len(ids)))
        each = self.model.encode(texts, num_threads=1)
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int32)


def _vocabulary(path: str) -> tuple[_Pieces, WordTable]:
    return cached(("fertility", path), lambda: (p := _Pieces(vocabulary_file(path)), WordTable(p)))


def base_counts(c: Chunk, u: Units) -> dict[str, np.ndarray]:
    """The counts of the base rule, for each text of a chunk."""
    lead = (c.data & 0xC0) != 0x80
    out = {"n_words": u.counts(), "word_chars": c.sums(lead & ~SPACE[c.data]), "n_symbols": c.sums(np.isin(c.data, np.frombuffer(SYMBOLS, np.uint8)))}
    # lines with a word: from a text's start or a newline to the next
    cuts = np.unique(np.concatenate((c.offsets[:-1], np.flatnonzero(c.data == 10) + 1)))
    cuts = cuts[cuts < len(c.data)] if len(c.data) else cuts[:0]
    ends = np.append(cuts[1:], len(c.data)) if len(cuts) else cuts
    ends = ends - ((ends > cuts) & (c.data[np.maximum(ends - 1, 0)] == 10)) if len(cuts) else ends
    ink = np.concatenate(([0], np.cumsum(~SPACE[c.data])))
    worded = ink[ends] > ink[cuts]
    lines = c.units(cuts[worded], ends[worded])
    key = mix(lines.hash ^ mix(lines.doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(lines.doc[same], minlength=c.texts)
    at, h = windows3(u)
    h = mix(h ^ mix(u.doc[at].astype(np.uint64)))
    order = np.argsort(h)
    h = h[order]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[:-1] |= again[1:]
    covered = np.zeros(len(u.hash) + 2, bool)
    at = at[order[again]]
    covered[at] = covered[at + 1] = covered[at + 2] = True
    out["n_repeat_words"] = np.bincount(u.doc[covered[: len(u.hash)]], minlength=c.texts)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out


def _measure(text: pa.Array, lang: pa.Array, rules: Rules) -> pa.Array:
    pieces, known = _vocabulary(rules.vocabulary)
    langs = lang.to_pylist()
    parts: dict[str, list] = {n: [] for n, _ in FIELDS}
    for c in chunks(text):
        u = c.words()
        out = base_counts(c, u)
        flat, start, length, word = known.of(u)
        each = length[word]
        ids, doc = gather(flat, start[word], each), np.repeat(u.doc, each)
        n = np.bincount(doc, minlength=c.texts)
        some = np.maximum(n, 1)
        key = np.sort(doc.astype(np.int64) << 32 | ids)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        runs = np.diff(np.append(first, len(key)))
        spread = np.bincount(key[first] >> 32, weights=runs * np.log2(runs), minlength=c.texts)
        out |= {"n_tokens": n, "chars_per_token": out["word_chars"] / some, "byte_share": np.bincount(doc[pieces.is_byte[ids]], minlength=c.texts) / some, "token_entropy": np.maximum(np.log2(some) - spread / some, 0.0)}
        letters = [c.sums(m) for m in ((c.data & 0xDF > 64) & (c.data & 0xDF < 91) | (c.data == 0xC3) | (c.data == 0xC4) | (c.data == 0xC5), (c.data >= 0xC6) & (c.data < 0xE0), c.data >= 0xE0)]
        script = np.argmax(np.stack(letters), axis=0)
        names = list(rules.scripts)
        bands = [rules.languages.get(langs[c.first + i] or "") or rules.scripts[names[script[i]]] for i in range(c.texts)]
        low, high = (np.array([b.chars_per_token[k] for b in bands]) for k in (0, 1))
        a, b1, b2 = (np.array([b.entropy[k] for b in bands]) for k in (0, 1, 2))
        x = np.clip(np.log2(some), 5.0, 16.0)
        checks = [
            (out["base_failed"], "base"),
            ((out["chars_per_token"] < low) | (out["chars_per_token"] > high), "chars_per_token"),
            (out["byte_share"] > np.array([b.max_byte_share for b in bands]), "byte_share"),
            (out["token_entropy"] < a + b1 * x + b2 * x * x - np.array([b.slack for b in bands]), "token_entropy"),
        ]
        reason = np.full(c.texts, None, object)
        for bad, why in reversed(checks):
            reason[bad] = why
        out |= {"reason": reason, "kept": np.array([r is None for r in reason], bool)}
        for name, _ in FIELDS:
            parts[name].append(out[name])
    arrays = [pa.array(np.concatenate(parts[n]) if parts[n] else [], t) for n, t in FIELDS]
    return pa.StructArray.from_arrays(arrays, names=[n for n, _ in FIELDS])


def measures(text: Column, lang: Column, rules: Rules = Rules()) -> Column:
    """A struct of FIELDS for each text."""

    @F.arrow_udf(TYPE)
    def fertility(text: pa.Array, lang: pa.Array) -> pa.Array:
        return _measure(text, lang, rules)

    return fertility.asNondeterministic()(text, lang)  # else a filter on a field runs it twice


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with a struct column `fertility` (another name if docs has that one already)."""
    return docs.withColumn(clear_name(docs, "fertility"), measures(F.col(text), F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string"), rules))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    name = clear_name(docs, "fertility")
    return quality_rules(docs, rules).filter(F.col(f"{name}.kept")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs).select("doc_id", "fertility.*")
