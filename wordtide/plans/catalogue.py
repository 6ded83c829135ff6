"""The query catalogue of the text index, each with the SQL that says the same.

A file is a row of `documents`: its text is the content, its source the folder, its language the
extension.  The operation log is `events` in the order of event_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.functions import sets
from wordtide.functions.text import matches, parent_key, path_key, space_tokens, text_tokens
from wordtide.operators import indexer, multimap, replay, subscriptions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexer.postings(_documents(spark, sf_dir))


def _name() -> Column:
    return F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("."), F.col("lang"))


def _path() -> Column:
    return F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), _name())


# SQL shared by the oracles: p is the postings of documents, f its files
_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \r\n]+'), lambda x: x <> ''))"
_P = f"p AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents)"
_F = "f AS (SELECT doc_id, source, lang, 'doc_' || doc_id || '.' || lang AS name, upper('/corpus/' || source || '/doc_' || doc_id || '.' || lang) AS path_key FROM documents)"


# ---------------------------------------------------------------- tokenizer, paths


@_query(r"SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \r\n]+'), lambda x: x <> '')) AS token FROM documents")
def tokenize_documents(spark, sf_dir):
    """Every token occurrence, line by line."""
    lines = _documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    return lines.select("doc_id", F.explode(space_tokens(F.col("line"))).alias("token"))


@_query(
    r"""SELECT id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, '|') AS tokens FROM (
    SELECT id, list_filter(regexp_split_to_array(coalesce(s, ''), ' '), lambda x: x <> '') AS t
    FROM (VALUES (1, NULL), (2, ''), (3, 'aaa'), (4, 'aaa.'), (5, 'a. b'), (6, 'a . b'), (7, '  x  y '), (8, 'A a'), (9, 'p' || chr(9) || 'q')) v(id, s))"""
)
def tokenize_golden(spark, sf_dir):
    """T1, T2 on literal lines: null, empty, runs of spaces, case, tabs."""
    rows = [(1, None), (2, ""), (3, "aaa"), (4, "aaa."), (5, "a. b"), (6, "a . b"), (7, "  x  y "), (8, "A a"), (9, "p\tq")]
    t = space_tokens(F.col("s"))
    return spark.createDataFrame(rows, "id int, s string").select("id", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("tokens"))


@_query(f"WITH {_F} SELECT doc_id, path_key, upper('/corpus/' || source) AS folder_key FROM f")
def path_keys(spark, sf_dir):
    """P1, P2."""
    key = path_key(F.concat(_path(), F.lit("//")))
    return _documents(spark, sf_dir).select("doc_id", key.alias("path_key"), parent_key(key).alias("folder_key"))


# ---------------------------------------------------------------- postings, search


@_query(f"WITH {_P} SELECT token, doc_id FROM p")
def postings_distinct(spark, sf_dir):
    """The index."""
    return _postings(spark, sf_dir)


@_query(f"WITH {_P} SELECT doc_id FROM p WHERE token = 'the'")
def search_word(spark, sf_dir):
    """Q1 without an index: a substring test comes first, then exact tokens."""
    return indexer.search_text(_documents(spark, sf_dir), "the").select("doc_id")


@_query(f"WITH {_P}, {_F} SELECT DISTINCT path_key FROM p JOIN f USING (doc_id) WHERE token = 'the'")
def search_paths(spark, sf_dir):
    """Q1 over postings and names."""
    docs = _documents(spark, sf_dir).select("doc_id", path_key(_path()).alias("path_key"))
    return indexer.search(_postings(spark, sf_dir), docs, "the")


@_query(f"WITH {_P} SELECT doc_id FROM p WHERE token = 'The'")
def search_case_variant(spark, sf_dir):
    """Q1: words are case-sensitive."""
    return indexer.search_text(_documents(spark, sf_dir), "The").select("doc_id")


@_query("SELECT doc_id FROM documents WHERE false")
def search_missing(spark, sf_dir):
    """Q1: a query with a space is no token, so it finds nothing."""
    return indexer.search_text(_documents(spark, sf_dir), "the and").select("doc_id")


@_query("SELECT doc_id FROM documents WHERE false")
def search_null(spark, sf_dir):
    """Q1: null finds nothing."""
    return indexer.inverted(_postings(spark, sf_dir), None)


@_query(f"WITH {_P} SELECT token, doc_id FROM p WHERE token IN ('the', 'The', 'la', 'nope9')")
def search_many(spark, sf_dir):
    """Q1 of several words at once."""
    return indexer.search_many(_postings(spark, sf_dir), spark.createDataFrame([("the",), ("The",), ("la",), ("nope9",), (None,)], "token string")).select("token", "doc_id")


@_query(r"SELECT DISTINCT page_id FROM (SELECT page_id, unnest(list_filter(regexp_split_to_array(html, '[ \r\n]+'), lambda x: x <> '')) AS token FROM pages) WHERE token = 'the'")
def search_pages(spark, sf_dir):
    return indexer.search_text(_table(spark, sf_dir, "pages"), "the", "html").select("page_id")


@_query(r"SELECT DISTINCT conv_id FROM (SELECT conv_id, unnest(list_filter(regexp_split_to_array(text, '[ \r\n]+'), lambda x: x <> '')) AS token FROM conversations) WHERE token = 'the'")
def search_conversations(spark, sf_dir):
    return indexer.search_text(_table(spark, sf_dir, "conversations"), "the").select("conv_id").distinct()


@_query(f"WITH {_P} SELECT token FROM p WHERE doc_id = 7")
def forward_get(spark, sf_dir):
    """The tokens of one document; the filter reaches the scan."""
    return indexer.postings(_documents(spark, sf_dir).filter("doc_id = 7")).select("token")


@_query(f"WITH {_P} SELECT key, EXISTS (SELECT 1 FROM p WHERE token = key) AS hit FROM (VALUES ('the'), ('The'), ('nope9')) v(key)")
def contains_keys(spark, sf_dir):
    """I1 of several keys."""
    m = _postings(spark, sf_dir).select(F.col("token").alias("key"))
    return multimap.contains_all(m, spark.createDataFrame([("the",), ("The",), ("nope9",)], "key string"))


@_query(f"WITH {_P} SELECT token, count(*) AS n_docs FROM p GROUP BY token")
def inverted_sizes(spark, sf_dir):
    """The inverted side, as the size of every key's set."""
    return _postings(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n_docs"))


@_query(f"WITH {_P} SELECT doc_id, count(*) AS n_tokens FROM p GROUP BY doc_id")
def forward_sizes(spark, sf_dir):
    """The forward side: no shuffle, a document's tokens are in its row."""
    return _documents(spark, sf_dir).select("doc_id", F.size(text_tokens(F.col("text"))).cast("long").alias("n_tokens")).filter("n_tokens > 0")


# ---------------------------------------------------------------- maintenance


@_query(f"WITH {_P} SELECT token, doc_id FROM p")
def add_idempotent(spark, sf_dir):
    """Adding what is there changes nothing."""
    p = _postings(spark, sf_dir)
    return indexer.add(p, p)


@_query(f"WITH {_P} SELECT token, doc_id FROM p WHERE NOT (doc_id % 2 = 0 AND token IN ('the', 'of'))")
def remove_values(spark, sf_dir):
    """I5, I6, X3."""
    p = _postings(spark, sf_dir)
    gone = p.filter((F.col("doc_id") % 2 == 0) & F.col("token").isin("the", "of"))
    return indexer.remove_tokens(p, gone)


@_query(f"WITH {_P} SELECT token, doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def remove_document(spark, sf_dir):
    """Without the documents of one folder."""
    gone = _documents(spark, sf_dir).filter("source = 'src3'").select("doc_id")
    return indexer.remove_documents(_postings(spark, sf_dir), gone)


@_query("SELECT doc_id, text AS token FROM documents WHERE false")
def flush(spark, sf_dir):
    """I8."""
    return multimap.flush(_postings(spark, sf_dir)).select("doc_id", "token")


def _versions(spark, sf_dir):
    """The documents, and a later version of some: every one with the text of the next, each seventh emptied."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    new = docs.select((F.col("doc_id") - 1).alias("doc_id"), "text").join(docs.select("doc_id"), "doc_id", "left_semi")
    return docs, new.withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")).otherwise(""))


_C = "c AS (SELECT d.doc_id - 1 AS doc_id, CASE WHEN (d.doc_id - 1) % 7 <> 0 THEN d.text ELSE '' END AS text FROM documents d SEMI JOIN documents e ON e.doc_id = d.doc_id - 1)"
_N = f"{_C}, n AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM c)"


@_query(f"WITH {_P}, {_N} SELECT token, doc_id FROM n EXCEPT SELECT token, doc_id FROM p")
def update_added(spark, sf_dir):
    """What an update adds."""
    return indexer.diff_texts(*_versions(spark, sf_dir))[1]


@_query(f"WITH {_P}, {_N} SELECT token, doc_id FROM p WHERE doc_id IN (SELECT doc_id FROM c) EXCEPT SELECT token, doc_id FROM n")
def update_removed(spark, sf_dir):
    """What an update removes; an emptied document loses all."""
    return indexer.diff_texts(*_versions(spark, sf_dir))[0]


@_query(f"WITH {_P}, {_N} SELECT token, doc_id FROM n UNION ALL SELECT token, doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM c)")
def update_apply(spark, sf_dir):
    """The state after the update."""
    docs, new = _versions(spark, sf_dir)
    return indexer.update(indexer.postings(docs), indexer.postings(new), new)


@_query(f"WITH {_P} SELECT token, CASE WHEN doc_id % 2 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents) THEN doc_id + 1 WHEN doc_id % 2 = 1 THEN doc_id - 1 ELSE doc_id END AS shown_as FROM p")
def switch_documents(spark, sf_dir):
    """Documents 2k and 2k + 1 exchange names; postings stay."""
    docs = _documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("path_key"))
    even = docs.filter("doc_id % 2 = 0").select(F.col("path_key").alias("who"), (F.col("doc_id") + 1).cast("string").alias("with"))
    swaps = even.join(docs.select(F.col("path_key").alias("with")), "with", "left_semi")
    named = indexer.switch(docs, swaps)
    return _postings(spark, sf_dir).join(named, "doc_id").select("token", F.col("path_key").cast("long").alias("shown_as"))


# ---------------------------------------------------------------- operation log


def _oplog(spark, sf_dir):
    op = F.expr("CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'add' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'remove' WHEN 'error' THEN 'remove_all' END")
    tokens = F.expr("array_distinct(array(concat('t', event_id % 7), concat('t', event_id % 11)))")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), op.alias("op"), tokens.alias("tokens"))


_O = """o AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'add' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'remove'
    WHEN 'error' THEN 'remove_all' END AS op, list_distinct(['t' || (event_id % 7), 't' || (event_id % 11)]) AS tokens FROM events)"""


@_query(
    f"""WITH {_O}, e AS (SELECT seq, key, op, unnest(tokens) AS token FROM o WHERE op <> 'remove_all'),
    l AS (SELECT key, token, max(CASE WHEN op <> 'remove' THEN seq END) AS a, max(CASE WHEN op = 'remove' THEN seq END) AS r FROM e GROUP BY ALL),
    t AS (SELECT key, max(seq) AS t FROM o WHERE op IN ('update', 'remove_all') GROUP BY key)
    SELECT l.key, l.token FROM l LEFT JOIN t USING (key) WHERE a IS NOT NULL AND a > coalesce(r, -1) AND a >= coalesce(t, -1)"""
)
def oplog_replay(spark, sf_dir):
    """I3-I7, X1-X4, B1, B3."""
    return replay.replay(_oplog(spark, sf_dir))


@_query(
    f"""WITH {_O}, m AS (SELECT seq, key, op, unnest(tokens) AS token FROM o WHERE op <> 'remove_all'),
    -- of each operation the state before it: every token whose last mention put it in, after the last reset
    l AS (SELECT o.seq, o.key, m.token, max(m.seq) AS put FROM o JOIN m ON m.key = o.key AND m.seq < o.seq GROUP BY ALL),
    r AS (SELECT o.seq, max(x.seq) AS reset FROM o JOIN o x ON x.key = o.key AND x.seq < o.seq AND x.op IN ('update', 'remove_all') GROUP BY o.seq),
    s AS (SELECT l.seq, l.token FROM l JOIN o p ON p.seq = l.put LEFT JOIN r ON r.seq = l.seq WHERE p.op <> 'remove' AND l.put >= coalesce(r.reset, -1)),
    old AS (SELECT o.seq, o.key, o.op, o.tokens, coalesce(list(s.token) FILTER (s.token IS NOT NULL), []) AS was FROM o LEFT JOIN s USING (seq) GROUP BY ALL),
    e AS (
      SELECT seq, 'added' AS kind, key, CASE op WHEN 'add' THEN tokens ELSE list_filter(tokens, lambda x: NOT list_contains(was, x)) END AS v FROM old WHERE op IN ('add', 'update')
      UNION ALL SELECT seq, 'removed', key, CASE op WHEN 'remove' THEN tokens WHEN 'remove_all' THEN was ELSE list_filter(was, lambda x: NOT list_contains(tokens, x)) END FROM old WHERE op <> 'add' AND len(was) > 0)
    SELECT seq, kind, key, CAST(len(v) AS BIGINT) AS n_values, array_to_string(list_sort(v), '|') AS payload FROM e WHERE len(v) > 0"""
)
def event_feed(spark, sf_dir):
    """The events of the log with their payloads: a removal tells only of keys that are there."""
    return replay.events(_oplog(spark, sf_dir)).select("seq", "kind", "key", F.size("values").cast("long").alias("n_values"), F.array_join("values", "|").alias("payload"))


@_query(f"WITH {_O}, t AS (SELECT key, max(seq) AS t FROM o WHERE op IN ('update', 'remove_all') GROUP BY key) SELECT seq, o.key, op FROM o LEFT JOIN t USING (key) WHERE t IS NULL OR seq >= t")
def oplog_latest(spark, sf_dir):
    """Operations that later ones do not make void."""
    return replay.latest(_oplog(spark, sf_dir)).select("seq", "key", "op")


# ---------------------------------------------------------------- listings, subscriptions


@_query(
    """WITH a AS (SELECT doc_id, n_chars FROM documents WHERE source <> 'src1'), b AS (SELECT doc_id, n_chars + CASE WHEN source = 'src2' THEN 1 ELSE 0 END AS n_chars FROM documents WHERE source <> 'src4')
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'created' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS op
    FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.n_chars <> b.n_chars"""
)
def snapshot_diff(spark, sf_dir):
    """S6, E1-E3 as relations: two listings of the corpus compared by name and length."""
    docs = _documents(spark, sf_dir)
    a = docs.filter("source <> 'src1'").select(F.col("doc_id").alias("a"), F.col("n_chars").alias("x"))
    b = docs.filter("source <> 'src4'").select(F.col("doc_id").alias("b"), (F.col("n_chars") + F.when(F.col("source") == "src2", 1).otherwise(0)).alias("y"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    op = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("x") != F.col("y"), "changed")
    return both.select(F.coalesce("a", "b").alias("doc_id"), op.alias("op")).filter("op IS NOT NULL")


def _files(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.col("source").alias("folder_key"), _name().alias("name"), path_key(_path()).alias("path_key"))


@_query(f"WITH {_F} SELECT doc_id, path_key FROM f WHERE name LIKE '%.en'")
def subscribe_mask(spark, sf_dir):
    """A mask in another case."""
    return _files(spark, sf_dir).filter(matches(F.col("name"), ["*.EN"])).select("doc_id", "path_key")


@_query(f"WITH {_F} SELECT doc_id, path_key FROM f WHERE name LIKE '%.en' OR name LIKE '%.fr' OR name LIKE 'doc\\__.de' ESCAPE '\\'")
def subscribe_multi_mask(spark, sf_dir):
    """A file that two masks cover is there once; ? is one character."""
    return _files(spark, sf_dir).filter(matches(F.col("name"), ["*.en", "*.fr", "doc_?.de", "*n"])).select("doc_id", "path_key")


@_query(f"WITH {_F} SELECT doc_id, path_key FROM f WHERE name = 'doc_7.en'")
def subscribe_file(spark, sf_dir):
    """U4: a mask that is a file name."""
    return _files(spark, sf_dir).filter(matches(F.col("name"), ["DOC_7.en"])).select("doc_id", "path_key")


@_query(f"WITH {_P} SELECT token, doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en')")
def unsubscribe_mask(spark, sf_dir):
    """U2 with a mask."""
    files = _files(spark, sf_dir)
    gone = subscriptions.select(files, F.lit("src3"), ["*.en"])
    return indexer.remove_documents(_postings(spark, sf_dir), gone)


@_query(f"WITH {_P} SELECT token, doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def unsubscribe_folder(spark, sf_dir):
    """U2 without a mask."""
    keep = subscriptions.deselect(_files(spark, sf_dir), F.lit("src3"), [None])
    return _postings(spark, sf_dir).join(keep.select("doc_id"), "doc_id", "left_semi").select("token", "doc_id")


@_query("SELECT upper('/corpus/' || source) AS folder_key, upper('/corpus/' || source) || '/' || string_agg(DISTINCT '*.' || lang, '|' ORDER BY '*.' || lang) AS subscription FROM documents GROUP BY source")
def list_subscriptions(spark, sf_dir):
    """Q4."""
    folder = path_key(F.concat(F.lit("/corpus/"), F.col("source")))
    subs = _documents(spark, sf_dir).groupBy(folder.alias("folder_key")).agg(F.collect_set(F.concat(F.lit("*."), F.col("lang"))).alias("filters"))
    return subscriptions.listing(subs)


# ---------------------------------------------------------------- set algebra


def _two(spark, sf_dir):
    """The token sets of consecutive documents."""
    docs = _documents(spark, sf_dir).select("doc_id", text_tokens(F.col("text")).alias("a"))
    return docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")


_S = f"s AS (SELECT doc_id, {_TOKENS} AS a FROM documents), t AS (SELECT s.doc_id, s.a, z.a AS b FROM s JOIN s z ON z.doc_id = s.doc_id + 1)"


@_query(f"WITH {_S} SELECT doc_id, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n FROM t")
def set_union(spark, sf_dir):
    """A5."""
    return _two(spark, sf_dir).select("doc_id", sets.size(sets.union(F.col("a"), F.col("b"))).cast("long").alias("n"))


@_query(f"WITH {_S} SELECT doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS n FROM t")
def set_intersect(spark, sf_dir):
    """A6."""
    return _two(spark, sf_dir).select("doc_id", sets.size(sets.intersect(F.col("a"), F.col("b"))).cast("long").alias("n"))


@_query(f"WITH {_S} SELECT doc_id, CAST(len(a) - len(list_intersect(a, b)) AS BIGINT) AS n FROM t")
def set_except(spark, sf_dir):
    """A7."""
    return _two(spark, sf_dir).select("doc_id", sets.size(sets.minus(F.col("a"), F.col("b"))).cast("long").alias("n"))


@_query(
    f"""WITH {_S} SELECT doc_id, len(list_intersect(a, c)) = len(a) AS subset, len(list_intersect(a, c)) = len(c) AS superset,
    len(list_intersect(a, c)) = len(c) AND len(c) < len(a) AS proper_superset, len(list_intersect(a, c)) = len(a) AND len(a) < len(c) AS proper_subset,
    len(list_intersect(a, b)) > 0 AS overlaps, len(list_intersect(a, c)) = len(a) AND len(a) = len(c) AS equal, list_contains(a, 'the') AS has_the
    FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN list_distinct(list_concat(a, b)) WHEN 1 THEN list_intersect(a, b) ELSE a END AS c FROM t)"""
)
def set_predicates(spark, sf_dir):
    """A9-A15, on a set and its union, intersection or copy."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    made = F.when(F.col("doc_id") % 3 == 0, sets.union(a, b)).when(F.col("doc_id") % 3 == 1, sets.intersect(a, b)).otherwise(a)
    return _two(spark, sf_dir).withColumn("c", made).select(
        "doc_id", sets.is_subset(a, c).alias("subset"), sets.is_superset(a, c).alias("superset"), sets.is_proper_superset(a, c).alias("proper_superset"),
        sets.is_proper_subset(a, c).alias("proper_subset"), sets.overlaps(a, b).alias("overlaps"), sets.equals(a, c).alias("equal"), sets.contains(a, F.lit("the")).alias("has_the"),
    )


@_query(f"WITH {_S} SELECT doc_id, CAST(len(a) + CASE WHEN list_contains(a, 'zzz') THEN 0 ELSE 1 END AS BIGINT) AS added, NOT list_contains(a, 'the') AS new, CAST(len(a) - CASE WHEN list_contains(a, 'the') THEN 1 ELSE 0 END AS BIGINT) AS removed FROM s")
def set_members(spark, sf_dir):
    """A1, A3, A16, A17."""
    docs = _documents(spark, sf_dir).select("doc_id", sets.construct(text_tokens(F.col("text"))).alias("a"))
    a = F.col("a")
    return docs.select("doc_id", sets.size(sets.add(a, F.lit("zzz"))).cast("long").alias("added"), sets.try_add(a, F.lit("the")).alias("new"), sets.size(sets.remove(a, F.lit("the"))).cast("long").alias("removed"))


@_query(f"WITH {_S} SELECT doc_id, CASE WHEN list_contains(a, 'the') THEN CAST(len(a) AS BIGINT) ELSE CAST(len(a) + 1 AS BIGINT) END AS strict, CAST(0 AS BIGINT) AS cleared FROM s")
def set_strict(spark, sf_dir):
    """A2, A4: a strict add where the member is new; a cleared set."""
    docs = _documents(spark, sf_dir).select("doc_id", sets.construct(text_tokens(F.col("text"))).alias("a"))
    a, the = F.col("a"), F.lit("the")
    strict = F.when(sets.contains(a, the), a).otherwise(sets.add_strict(a, the))
    return docs.select("doc_id", sets.size(strict).cast("long").alias("strict"), sets.size(sets.cleared()).cast("long").alias("cleared"))


def _relations(spark, sf_dir):
    p = _postings(spark, sf_dir).join(_documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return p.filter("lang = 'en'").select("token").distinct(), p.filter("lang = 'fr'").select("token").distinct()


_R = f"{_P}, e AS (SELECT DISTINCT token FROM p JOIN documents USING (doc_id) WHERE lang = 'en'), g AS (SELECT DISTINCT token FROM p JOIN documents USING (doc_id) WHERE lang = 'fr')"


@_query(f"WITH {_R} SELECT token FROM e UNION SELECT token FROM g")
def relation_union(spark, sf_dir):
    """A5 of relations."""
    return sets.relation_union(*_relations(spark, sf_dir))


@_query(f"WITH {_R} SELECT token FROM e INTERSECT SELECT token FROM g")
def relation_intersect(spark, sf_dir):
    """A6 of relations."""
    return sets.relation_intersect(*_relations(spark, sf_dir))


@_query(f"WITH {_R} SELECT token FROM e EXCEPT SELECT token FROM g")
def relation_except(spark, sf_dir):
    """A7 of relations."""
    return sets.relation_minus(*_relations(spark, sf_dir))


# ---------------------------------------------------------------- the persisted index


def _folder(spark, sf_dir) -> str:
    """The documents as files of one folder, named by doc_id: one line-split text file for each."""
    import uuid

    from wordtide.cluster import shared_dir

    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex[:12]}"

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root)
        store.create_dir(at, recursive=True)
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = (text or "").encode("utf-16" if i % 10 == 0 else "utf-8-sig" if i % 10 == 1 else "utf-8")
                with store.open_output_stream(f"{at}/doc_{i}.{'md' if i % 4 == 3 else 'txt'}") as f:
                    f.write(raw)
            yield pa.RecordBatch.from_arrays([b.column("doc_id")], names=["doc_id"])

    _documents(spark, sf_dir).select("doc_id", "text").mapInArrow(put, "doc_id long").write.format("noop").mode("overwrite").save()
    return root


@_query("SELECT doc_id, 'doc_' || doc_id || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 10 > 1")
def list_files(spark, sf_dir):
    """The files of a folder under a mask, with their lengths (of the plain UTF-8 ones)."""
    from wordtide.sources import files

    listed = files.listed(spark, _folder(spark, sf_dir), "*.TXT").withColumn("doc_id", F.regexp_extract("name", r"doc_(\d+)", 1).cast("long"))
    return listed.filter("doc_id % 10 > 1").select("doc_id", "name", "length")


@_query(f"WITH {_P} SELECT doc_id, token FROM p")
def scan_files(spark, sf_dir):
    """The tokens of text files in UTF-8, with and without a mark, and UTF-16."""
    from wordtide.sources import files

    return files.tokens(spark, files.listed(spark, _folder(spark, sf_dir))).select(F.regexp_extract("path", r"doc_(\d+)", 1).cast("long").alias("doc_id"), "token")


@_query("SELECT source AS key, lang AS value FROM documents WHERE false")
def dispose(spark, sf_dir):
    """A disposed multimap holds nothing."""
    m = multimap.Multimap(spark, _documents(spark, sf_dir).select(F.col("source").alias("key"), F.col("lang").alias("value")).distinct())
    m.dispose()
    return m.relation


@_query(f"WITH {_P}, {_F} SELECT DISTINCT path_key FROM p JOIN f USING (doc_id) WHERE token = 'the'")
def store_search(spark, sf_dir):
    """Q1 over the persisted index: one bucket's files, pushed-down token filter, live revisions."""
    import uuid

    from wordtide.cluster import shared_dir
    from wordtide.plans.store import Store

    store = Store(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}")
    docs = _documents(spark, sf_dir)
    rev = F.concat(F.lit("r"), F.col("doc_id"))
    key = path_key(_path())
    names = docs.select(key.alias("path_key"), _path().alias("path"), parent_key(key).alias("folder_key"), _name().alias("name"), rev.alias("rev"), F.lit(1).cast("long").alias("seq"), F.lit(True).alias("live"))
    store.append(indexer.postings(docs.withColumn("rev", rev), doc_id="rev").select("token", F.col("doc_id").alias("rev")), names, 1)
    return store.search("the")
