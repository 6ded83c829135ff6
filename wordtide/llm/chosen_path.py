"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its distinct 3-word shingles (ASCII lower case).  Two documents are
linked if 100 * |A and B| >= 85 * |A or B|, confirmed on the full sets.  How pairs are found:

* Equal sets are one class at once (a group-by on a 128-bit hash of the set), so any number of
  copies is one node of the join.
* *Paths.* In each of `trees` trees a class walks `depth` steps: the path so far chooses a
  coordinate among the tree's own POOL minwise values, the class's token there extends the path.
  No tree uses a value of another, so they are independent: two classes of similarity J share a
  path of one tree with probability J**depth, and at J = 0.85 a pair is lost by all trees with
  probability (1 - 0.85**depth)**trees: 7.7e-7 by default.
* *Stars first.* Every node ties its members to its least member; the pairs whose signatures allow
  it are verified and the links contracted to components.  That is linear in the members, so a
  node of a million near copies is no quadratic task.
* *Small nodes exhaustively.* Only pairs of members in different components can still matter.
  Nodes of at most `leaf` members compare all of those.  A larger one branches, `branches` children
  for each member, down to `deepest`, as long as its children have fewer pairs than it has itself.
  If they have not, its members are so alike that each level would only multiply them; such a node,
  and one that is still large at `deepest`, is compared in blocks, all of it.

Two filters stand before the full sets.  A signature only rules out: a pair at J >= 0.85 that agrees
in fewer than `agree` of 192 minwise values has probability below 1e-7.  A bitmap of the set (8 to 16
bits a shingle) gives a lower bound of the symmetric difference, which loses nothing.  What passes
both is confirmed on the full sets.  All groups are pre-aggregated or written to the shared folder; no
group is collected into one task beyond `leaf` members, or two blocks of `block`.

Defined results: null texts and texts without a word have no shingle and are linked with nothing;
texts of one or two words are linked with equal ones only; very long texts are whole sets (about 60
bytes of memory a byte of the longest); rows with a null doc_id are kept, unlinked, with a null
component; rows that repeat a doc_id with another text are judged each by its own text, so a row
goes only if its own text is near another's; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm.common import Scratch, among, clear_name, table
from wordtide.llm.components import components
from wordtide.llm.textvec import chunks, mix, windows3

POOL = 8  # minwise values of each tree
SLOTS = 24 * POOL
BITS = (512, 65536)  # of a bitmap, least and most
_U = np.uint64
_SLOT_XOR = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, SLOTS, dtype=np.uint64)
_SLOT_MUL = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, SLOTS, dtype=np.uint64) | _U(1)


@dataclass(frozen=True)
class Join:
    percent: int = 85
    trees: int = 24
    depth: int = 5
    branches: int = 2
    deepest: int = 12
    leaf: int = 200
    block: int = 2000
    agree: int = 135

    def __post_init__(self) -> None:
        if self.trees * POOL > SLOTS or self.depth > POOL:
            raise ValueError(f"at most {SLOTS // POOL} trees of depth {POOL} have minwise values of their own")

    @property
    def least_set(self) -> int:
        """Smaller sets are linked only if equal: k of k + 1 shingles is too little."""
        k = 1
        while 100 * k < self.percent * (k + 1):
            k += 1
        return k


def shingle_sets(text: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text."""
    for c in chunks(text):
        u = c.words(lower=True)
        at, h = windows3(u)
        n = u.counts()
        first = np.concatenate(([0], np.cumsum(n)))
        cut = np.searchsorted(u.doc[at], np.arange(c.texts + 1))
        for i in range(c.texts):
            if n[i] >= 3:
                s = np.sort(h[cut[i] : cut[i + 1]])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif n[i]:
                w = u.hash[first[i] : first[i + 1]]
                yield mix(w[:1] ^ _U(0xA5A5) if n[i] == 1 else mix(w[:1] * _U(3) + w[1:]) ^ _U(0x5A5A))
            else:
                yield np.zeros(0, np.uint64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    a = mix(s ^ _U(0x1234567)).sum(dtype=np.uint64) + _U(len(s))
    b = (mix(s * _U(0x9E3779B97F4A7C15)) | _U(1)).sum(dtype=np.uint64) ^ mix(np.array([a]))[0]
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signature(s: np.ndarray) -> bytes:
    """16 bits of the minwise shingle in each slot, then a bitmap of the set."""
    out = np.empty(SLOTS, np.uint64)
    for i in range(0, len(s), 8192):
        part = ((s[None, i : i + 8192] ^ _SLOT_XOR[:, None]) * _SLOT_MUL[:, None]).min(axis=1)
        out = part if i == 0 else np.minimum(out, part)
    return (mix(out) >> _U(48)).astype(np.uint16).tobytes() + bitmap(s)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle by its hash modulo a power of two: folding one half over the other gives the shorter bitmap."""
    bits = min(max(1 << (8 * len(s) - 1).bit_length(), BITS[0]), BITS[1])
    seen = np.zeros(bits, bool)
    seen[(mix(s ^ _U(0xB17)) & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(seen).tobytes()


class Bitmaps:
    """The bitmaps of some signatures, for lower bounds of symmetric differences."""

    def __init__(self, signed: list[bytes]):
        raw = [np.frombuffer(x, np.uint64, offset=2 * SLOTS) for x in signed]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.row = np.zeros(len(raw), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.row[at] = np.arange(len(at))
            self.of[size] = np.stack([raw[i] for i in at.tolist()])

    def _at(self, i: np.ndarray, size: int, own: int) -> np.ndarray:
        m = self.of[own][self.row[i]]
        while m.shape[1] > size:
            m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
        return m

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of each pair a number that its symmetric difference reaches at least."""
        out = np.zeros(len(i), np.int64)
        a, b = self.size[i], self.size[j]
        for x, y in {*zip(a.tolist(), b.tolist())}:
            at = np.flatnonzero((a == x) & (b == y))
            out[at] = np.bitwise_count(self._at(i[at], min(x, y), x) ^ self._at(j[at], min(x, y), y)).sum(axis=1)
        return out


def _may(differ: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes may be similar: 100 * shared >= percent * union, in terms of their difference."""
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def _prints(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for s in shingle_sets(b.column("text")):
                n.append(len(s))
                x, y = set_hash(s) if len(s) else (None, None)
                h1.append(x)
                h2.append(y)
                sig.append(signature(s) if len(s) >= least else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])

    return run


def _signatures(column: pa.Array | list[bytes]) -> np.ndarray:
    every = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(x[: 2 * SLOTS] for x in every), np.uint16).reshape(-1, SLOTS)


def _step(path: np.ndarray, sig: np.ndarray, used: np.ndarray, turn: int) -> np.ndarray:
    """One step of each path: the path chooses an unused slot, the token there extends it."""
    slots = used.shape[1]
    slot = (mix(path + _U(turn * 7919 + 1)) % _U(slots)).astype(np.int64)
    rows = np.arange(len(path))
    while (taken := used[rows, slot]).any():
        slot[taken] = (slot[taken] + 1) % slots
    used[rows, slot] = True
    return mix(path ^ (slot.astype(np.uint64) << _U(20)) ^ sig[rows, slot].astype(np.uint64))


def _paths(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig, rep = _signatures(b.column("sig")), b.column("rep").to_numpy(zero_copy_only=False)
            for t in range(trees):
                path = mix(np.full(len(sig), t + 1, np.uint64))
                own, used = sig[:, t * POOL : (t + 1) * POOL], np.zeros((len(sig), POOL), bool)
                for _ in range(depth):
                    path = _step(path, own, used, 0)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(rep)], names=["node", "rep"])

    return run


def _branch(branches: int):
    """Children of the members of nodes that are still large; parent: the node they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig, node = _signatures(b.column("sig")), b.column("node").to_numpy().view(np.uint64)
            for k in range(branches):
                child = _step(node, sig, np.zeros((len(sig), SLOTS), bool), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("node"), b.column("rep"), b.column("component")], names=["node", "parent", "rep", "component"])

    return run


def _promising(percent: int, agree: int):
    """Pairs whose sizes, signatures and bitmaps allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            sa, sb = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            ok &= (_signatures(sa) == _signatures(sb)).sum(axis=1) >= agree
            i = np.flatnonzero(ok)
            ok[i] = _may(Bitmaps(sa + sb).differ(i, i + len(sa)), na[i], nb[i], percent)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _across(percent: int, agree: int):
    """Of groups (members: rep, component, n, sig; side), all promising pairs across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_out, b_out = [], []
            flat, cut = batch.column("members").flatten(), batch.column("members").offsets.to_numpy()
            cut = cut - cut[0] if len(cut) else cut
            every = [flat.field(k).to_numpy() for k in ("rep", "component", "n", "side")]
            raw = flat.field("sig").to_pylist()
            signed = _signatures(raw)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                rep, comp, n, side = (x[lo:hi] for x in every)
                sig = signed[lo:hi]
                first, second = [], []
                for i in range(hi - lo - 1):
                    r = slice(i + 1, None)
                    ok = (comp[r] != comp[i]) & (100 * np.minimum(n[r], n[i]) >= percent * np.maximum(n[r], n[i])) & ((side[r] != side[i]) | (side[i] == 2))
                    if ok.any():
                        j = np.flatnonzero(ok) + i + 1
                        j = j[(sig[j] == sig[i]).sum(axis=1) >= agree]
                        first.append(np.full(len(j), i))
                        second.append(j)
                if first and (i := np.concatenate(first)).size:
                    j, maps = np.concatenate(second), Bitmaps(raw[lo:hi])
                    for k in range(0, len(i), 4096):
                        x, y = i[k : k + 4096], j[k : k + 4096]
                        ok = _may(maps.differ(x, y), n[x], n[y], percent)
                        a_out.append(np.minimum(rep[x[ok]], rep[y[ok]]))
                        b_out.append(np.maximum(rep[x[ok]], rep[y[ok]]))
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, shingles) of each text."""
    for b in batches:
        h1, h2, sets = [], [], []
        for s in shingle_sets(b.column("text")):
            x, y = set_hash(s)
            h1.append(x)
            h2.append(y)
            sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sets, pa.binary())], names=["h1", "h2", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            pairs = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                if a != last:
                    last, x = a, np.frombuffer(batch.column("sa")[i].as_py(), np.uint64)
                y = np.frombuffer(batch.column("sb")[i].as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    pairs.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return run


def _verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, scratch: Scratch, join: Join) -> DataFrame:
    """The pairs (a, b), written, whose full shingle sets are similar enough."""
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ids")
    n = ids.count()
    if not n:
        return pairs
    need = scratch.keep(among(reps.select("rep", "first", "h1", "h2"), ids, "rep", "left_semi", n), "need")
    some = among(docs, need.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi", n).select("text")
    # by their hashes, not by doc_id, which may have many texts; one row for each class
    sets = some.mapInArrow(_sets, "h1 long, h2 long, shingles binary").groupBy("h1", "h2").agg(F.min("shingles").alias("shingles"))
    sets = scratch.keep(among(sets.withColumn("h", F.struct("h1", "h2")), need.select(F.struct("h1", "h2").alias("h"), "rep"), "h", "inner", n).select("rep", "shingles"), "sets", 250)
    a, b = (sets.select(F.col("rep").alias(k), F.col("shingles").alias("s" + k)) for k in "ab")
    found = pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb")
    links = scratch.keep(found.mapInArrow(_confirm(join.percent), "a long, b long"), "links", 250)
    scratch.drop(ids, need, sets)
    return links


def _mixed(members: DataFrame) -> DataFrame:
    """Members (node, rep, component, ...) of nodes that hold more than one component, with the size."""
    live = members.groupBy("node").agg(F.count("*").alias("size"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("node", "size")
    return members.join(live, "node")


def _signed(members: DataFrame, signed: DataFrame, scratch: Scratch) -> DataFrame:
    """Members with n and sig, written; only the signatures of classes that are members somewhere move."""
    ids = scratch.keep(members.select("rep").distinct(), "signed-ids")
    out = scratch.keep(members.join(among(signed, ids, "rep", "left_semi"), "rep").select("node", "rep", "component", "n", "sig", "size"), "signed")
    scratch.drop(ids)
    return out


def _children(large: DataFrame, scratch: Scratch, join: Join) -> tuple[DataFrame, DataFrame]:
    """(parent nodes whose children have fewer pairs than they have, written; children of all, written without signatures)."""
    born = scratch.keep(large.select("node", "rep", "component", "sig").mapInArrow(_branch(join.branches), "node long, parent long, rep long, component long"), "born")
    pairs = lambda n: F.col(n).cast("double") * (F.col(n) - 1)
    after = born.groupBy("parent", "node").agg(F.count("*").alias("k")).groupBy("parent").agg(F.sum(pairs("k")).alias("pairs"), (F.sum("k") / join.branches).alias("size"))
    return scratch.keep(after.filter(F.col("pairs") < pairs("size")).select(F.col("parent").alias("node")), "split"), born


def _judged(spark: SparkSession, docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, component_id, kept) for each row of docs (doc_id, text)."""
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = scratch.keep(docs.mapInArrow(_prints(join.least_set), "doc_id long, n long, h1 long, h2 long, sig binary"), "prints")
    # a class of equal sets is a number of its own: a doc_id with several texts is in several classes
    reps = scratch.keep(
        prints.filter("h1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("m"))
        .select("h1", "h2", F.monotonically_increasing_id().alias("rep"), F.col("m.doc_id").alias("first"), F.col("m.n").alias("n"), F.col("m.sig").alias("sig")), "reps",
    )
    signed = reps.filter("sig IS NOT NULL").select("rep", "n", "sig")
    paths = signed.select("rep", "sig").mapInArrow(_paths(join.trees, join.depth), "node long, rep long")
    shared = paths.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("least")).filter("size > 1").select("node", "least")
    members = scratch.keep(paths.join(shared, "node"), "members")

    met = scratch.keep(members.select("rep").distinct(), "met")
    some = scratch.keep(among(signed, met, "rep", "left_semi"), "some")  # a class alone in all of its nodes meets nobody
    a, b = (some.select(F.col("rep").alias(k), F.col("n").alias("n" + k), F.col("sig").alias("s" + k)) for k in "ab")
    stars = members.filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct().join(b, "b").join(a, "a")
    stars = scratch.keep(stars.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_promising(join.percent, join.agree), "a long, b long"), "stars")
    links = _verify(docs, reps, stars, scratch, join)
    comps = components(links, scratch)

    told = members.select("node", "rep").join(comps, members["rep"] == comps["node"], "left").select(members["node"], "rep", F.coalesce("component", "rep").alias("component"))
    mixed = scratch.keep(_mixed(told), "mixed-nodes")
    live = _signed(mixed, some, scratch)
    made, found = [met, some, mixed, live], []
    for _ in range(join.depth, join.deepest):
        found.append(_pairs(live.filter(F.col("size") <= join.leaf).drop("size"), ["node"], join))
        large = live.filter(F.col("size") > join.leaf)
        if large.isEmpty():
            live = None
            break
        # signatures hold SLOTS tokens, so a node that is still large here has many classes in common slots
        split, born = _children(large, scratch, join)
        found.append(_blocks(among(large, split, "node", "left_anti"), join))
        deeper = scratch.keep(_mixed(among(born.withColumnRenamed("node", "child"), split.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node"), "rep", "component")), "deeper-nodes")
        live = _signed(deeper, some, scratch)
        made += [split, born, deeper, live]
    if live is not None:
        found.append(_pairs(live.filter(F.col("size") <= join.leaf).drop("size"), ["node"], join))
        found.append(_blocks(live.filter(F.col("size") > join.leaf), join))
    across = found[0]
    for f in found[1:]:
        across = across.unionByName(f)
    across = scratch.keep(across.distinct(), "across", 250)
    scratch.drop(members, stars, *made)
    if not across.isEmpty():
        more = _verify(docs, reps, across, scratch, join)
        if not more.isEmpty():
            comps = components(links.unionByName(more), scratch)
    scratch.drop(across, links)
    firsts = comps.join(reps.select(F.col("rep").alias("node"), "first"), "node")
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    linked = firsts.join(least, "component").select(F.col("node").alias("rep"), "least")
    classes = reps.select("h1", "h2", "rep", "first").join(linked, "rep", "left").select("h1", "h2", F.coalesce("least", "first").alias("component_id"))
    out = prints.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(classes, ["h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def groups(spark: SparkSession, docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    return _judged(spark, docs, join).select("doc_id", "n_shingles", "component_id", "kept")


def _pairs(members: DataFrame, keys: list[str], join: Join) -> DataFrame:
    side = F.col("side") if "side" in members.columns else F.lit(2)
    boxed = members.groupBy(*keys).agg(F.collect_list(F.struct("rep", "component", "n", "sig", side.cast("byte").alias("side"))).alias("members"))
    return boxed.select("members").mapInArrow(_across(join.percent, join.agree), "a long, b long")


def _blocks(members: DataFrame, join: Join) -> DataFrame:
    """All pairs of large nodes, block against block: no task holds more than about two blocks."""
    k = F.ceil(F.col("size") / join.block).cast("int")
    m = members.withColumn("k", k).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    m = m.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    m = m.withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("mine") == F.col("i"), 0).otherwise(1))
    return _pairs(m.select("node", "i", "j", "rep", "component", "n", "sig", "side"), ["node", "i", "j"], join)


def keep_first(spark: SparkSession, docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One document of each group of near copies, with the columns of docs: that of the least doc_id.

    A row goes only if its own text is near one that stays: of a doc_id with several texts those stay
    that are near no other's, and rows that repeat a doc_id with the same text stay or go together.
    """
    scratch = Scratch(spark, "near-gone")
    judged = scratch.keep(_judged(spark, docs, join).select("doc_id", "h1", "h2", "kept"), "judged")
    gone = judged.filter(~F.col("kept")).groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("sets"))
    # ids that stay with one text and go with another: only of these is the text looked at
    both = scratch.keep(judged.filter("kept").join(gone, "doc_id", "left_semi").select("doc_id").distinct(), "both")
    ids = judged.filter(~F.col("kept")).select("doc_id").distinct()
    n = both.count()
    if not n:
        return among(docs, scratch.keep(ids, "gone"), "doc_id", "left_anti").select(*docs.columns)
    plain = among(docs, scratch.keep(among(ids, both, "doc_id", "left_anti", n), "gone"), "doc_id", "left_anti")
    name = clear_name(docs, "gone_sets")
    told = plain.join(gone.join(both, "doc_id", "left_semi").withColumnRenamed("sets", name), "doc_id", "left")

    @F.arrow_udf("boolean")
    def goes(text: pa.Array, sets: pa.Array) -> pa.Array:
        out = []
        for s, own in zip(shingle_sets(text), sets.to_pylist()):
            h1, h2 = set_hash(s)
            out.append(bool(own and len(s)) and {"h1": h1, "h2": h2} in own)
        return pa.array(out, pa.bool_())

    return told.filter(~goes("text", name)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, table(spark, sf_dir, "documents"))


#: The same by brute force: all pairs of texts that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), reps AS (
  SELECT sh_key, min(doc_id) AS rep, any_value(len(sh)) AS n, any_value(sh) AS sh
  FROM (SELECT doc_id, sh, array_to_string(list_sort(sh), chr(10)) AS sh_key FROM s WHERE len(sh) > 0) GROUP BY sh_key
), e AS (SELECT rep, n, unnest(sh) AS x FROM reps),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
reach(a, c) AS (
  SELECT rep, rep FROM reps UNION SELECT y.b, r.c FROM reach r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) y ON y.a = r.a WHERE r.c <= y.b
), comp AS (SELECT a AS rep, min(c) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id, s.doc_id = coalesce(comp.c, s.doc_id) AS kept
FROM s LEFT JOIN reps ON reps.sh_key = array_to_string(list_sort(s.sh), chr(10)) AND len(s.sh) > 0 LEFT JOIN comp ON comp.rep = reps.rep
"""
