import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F

from wordtide.llm import html_text, latent, licences
from wordtide.llm.common import Scratch

PAGES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"),
    ("<div class=cookie-notice>x</div><main><h1>T</h1><p>a &amp; b&nbsp;c</p><ul><li>1<li>2</ul></main>", "T\na & b c\n1\n2"),
    ('<article><header><h1>Title</h1></header><p>x<br>y</p><div class="comments"><p>c</p></div><aside>s</aside><form><input>f</form><table><tr><td>1<td>2<tr><td>3</table></article><footer>f</footer>', "Title\nx y\n1 2\n3"),
    ('<body><div id="header">h</div><div class="content"><p>Hello <b>bold</b>world</p><pre>a\n  b</pre></div><div id="sidebar"><a href=x>l</a></div></body>', "Hello boldworld\na b"),
    ('<p>x</p><script>var a="<p>no</p>"</script><!-- c <p> --><p>y &lt;b&gt; &#233; &eacute</p><textarea><p>no</textarea>z < 3 > 2', "x\ny <b> é é\nz < 3 > 2"),
    ('<article><section class="reader-comments">z</section><p>keep</p></article>', "keep"), ('<div class="has-sidebar"><article><p>t</p></article></div>', "t"),
    ("<b><p>deep</b>er</p>" + "<div>" * 3000 + "x", "deeper\nx"), ('<div hidden>h</div><p style="display:none">n</p><p>v</p>', "v"), ("<article><p>one</article><article><p>two</article>", "one\ntwo"),
    ("<title>no</title><p>a <a title='x>y'>link</a></p><style>p{}</style><noscript>n</noscript>", "a link"), ("<p>a</p><p", "a"),
]


@pytest.mark.parametrize("source,text", PAGES)
def test_extract(source, text):
    assert html_text.extract(source) == text


def test_template_subtrees_go(spark):
    promo = "<div><p>Join our club today</p></div>"
    pages = [(i, f"http://h{i % 2}.example.com/{i}", f"<div id=c><div><p>Story {i} begins here and goes on for quite a while</p><p>The same moral.</p></div></div>{promo if i % 2 else ''}") for i in range(12)]
    pages += [(100, "http://lone.example.com/", f"<div><p>Body text of some length here</p></div>{promo}"), (101, None, None), (None, "x", "<p>n</p>"), (5, "http://h1.example.com/5", "<p>same id</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.main_text(spark, df, Scratch(spark, "t")).collect()]
    assert len(got) == len(pages) and all(n == len(t) for *_, t, n in got)
    texts = {(i, u): t for i, u, t, _ in got if t != "same id"}
    for i in range(12):
        assert texts[(i, f"http://h{i % 2}.example.com/{i}")] == f"Story {i} begins here and goes on for quite a while\nThe same moral."
    assert "club" in texts[(100, "http://lone.example.com/")] and texts[(101, None)] == "" and texts[(None, "x")] == "n"
    assert html_text.main_text(spark, df.limit(0), Scratch(spark, "t")).count() == 0


def test_copies_of_an_article_are_no_template(spark):
    """An article on three pages keeps its lists; an unnamed promo longer than the story goes."""
    article = "<article><p>The steps are these, told at some length</p><ul><li>one</li><li>two</li></ul></article>"
    plain = "<div><p>A story that stands on three pages of the host</p><ul><li>three</li></ul></div>"
    promo = "<div><p>" + "Join our club today. " * 9 + "</p></div>"
    pages = [(i, f"http://a.com/{i}", f"<p>Page {i}</p>{article}") for i in range(3)] + [(i, f"http://b.com/{i}", plain) for i in range(10, 13)]
    pages += [(i, f"http://c.com/{i}", f"<div><p>Short story {i}</p></div>{promo}") for i in range(20, 26)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(spark, df, Scratch(spark, "t")).collect()}
    assert all(got[i] == "The steps are these, told at some length\none\ntwo" for i in range(3))
    assert all(got[i].endswith("three") for i in range(10, 13)) and all(got[i] == f"Short story {i}" for i in range(20, 26))


def test_pages_give_their_articles(spark, sf):
    """Pages are made of documents: the article is a title and a document's lines."""
    flat = lambda t: "\n".join(x for x in (" ".join(y.split()) for y in t.split("\n")) if x)
    have = {flat(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} | {flat(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = html_text.query(spark, sf).collect()
    assert sum(r.text.split("\n", 1)[-1] in have for r in got) >= 0.9 * len(got)


def counted_by_hand(pages, site):
    """page -> hashes: the template of each host, from plain dictionaries."""
    trees, bodies, where = {}, {}, {}
    for i, (host, source) in enumerate(pages):
        if source:
            root = html_text.parse(source)
            html_text.measure(root)
            trees[i] = html_text.candidates(root)
            bodies[i] = html_text._text(root, frozenset(), html_text.Site())
            for h, part in trees[i].items():
                where.setdefault((host, h), {}).setdefault(bodies[i], []).append(part)
    size = {}
    for i in trees:
        size.setdefault(pages[i][0], set()).add(bodies[i])
    out = {}
    for i in trees:
        host = pages[i][0]
        least = max(site.least_pages, min(site.enough_pages, -(-len(size[host]) * 2 // 10)))
        out[i] = {h for h in trees[i] if len(where[host, h]) >= least and sum(map(max, where[host, h].values())) / len(where[host, h]) <= site.most_text}
    return out


def made_pages(seed=12):
    """Pages of four hosts with menus, notices, adverts and footers of random words under names that say nothing."""
    rnd = random.Random(seed)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    pages, want = [], []
    for i in range(80):
        menu = "<div class=q1><ul>" + "".join(f"<li><a href=/{k}>{text(1)}</a></li>" for k in range(rnd.randint(3, 8))) + "</ul></div>"
        bar = f"<div class=q2>{text(rnd.randint(4, 9))} <b>{text(1)}</b></div>" if i % 3 else ""
        foot = f"<section class=q3><p>{text(5)}</p></section>"
        parts = [text(rnd.randint(20, 60)) for _ in range(rnd.randint(2, 6))]
        story = "".join(f"<p>{x}</p>" for x in parts[:-1]) + f'<div class="side-effects"><p>{parts[-1]}</p></div>'
        pages.append((i, f"http://h{i % 4}.com/{i}", f"<body>{menu}{bar}<div class=z{i % 2}>{story}</div>{foot}</body>"))
        want.append("\n".join(parts))
    return pages, want


def test_templates_are_those_counted_by_hand(spark):
    pages, want = made_pages()
    pages += [(200 + i, p[1], p[2]) for i, p in enumerate(pages[:5])] + [(300, None, None), (301, "http://h1.com/x", "")]
    site = html_text.Site(names=False, articles=False)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(spark, df, Scratch(spark, "t"), site).collect()}
    hosts = [((p[1] or "").split("/")[2] if p[1] else "", p[2]) for p in pages]
    hand = counted_by_hand(hosts, site)
    assert got == {p[0]: html_text.extract(p[2], frozenset(hand.get(i, ())), site) for i, p in enumerate(pages)}
    assert [got[i] for i in range(80)] == want


def test_templates_alone_find_the_articles(spark):
    """Without names, and without article elements, at least 90 % of the pages give the same text."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    whole, alone = ({r.page_id: r.text for r in html_text.main_text(spark, df, Scratch(spark, "t"), s).collect()} for s in (html_text.Site(), html_text.Site(names=False, articles=False)))
    assert sum(alone[k] == t for k, t in whole.items()) >= 0.9 * len(whole)


def test_names_inside_an_article_are_its_topic():
    for name in ("side-effects", "legal-history", "popular-culture", "form-of-life"):
        assert html_text.extract(f'<article><p>a</p><div class="{name}"><p>b</p></div><section id="{name}">c</section></article>') == "a\nb\nc"
    for name in ("ad", "ad-300x250", "reader-comments", "shareButtons", "cookie_notice", "related-posts"):
        assert html_text.extract(f'<article><p>a</p><div class="{name}"><p>b</p></div></article>') == "a"


def test_lcs():
    rnd = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, 30))] for _ in range(2))
        assert latent.lcs(a, b) == slow(a, b)


def leak_fixture(seed=3):
    rnd = random.Random(seed)
    words = ["the", "of", "and", "to", "in"] * 40 + ["w" + "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(1500)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(rnd.randint(18, 60)) + ". " + text(8)) for i in range(30)]
    docs, want = [], set()
    for i in range(300):
        body = text(rnd.randint(5, 400)).split()
        if i % 5 == 0:
            k = rnd.randrange(30)
            leak = items[k][1].split()
            if i % 10 == 0:  # a paraphrase: words replaced
                for j in rnd.sample(range(len(leak)), len(leak) // 8):
                    leak[j] = "other" + str(j)
            at = rnd.randrange(len(body))
            body[at:at] = [w.upper() + "!" if i % 3 == 0 else w for w in leak]
            want.add((i, k))
        docs.append((i, " ".join(body)))
    return docs, items, want


def test_leaks_against_brute_force(spark):
    docs, items, want = leak_fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent.leaks(spark, df, bench, Scratch(spark, "t")).collect()}
    brute = set()
    for d, t in docs:
        w = latent.words_of(t)
        for k, x in items:
            item = latent.words_of(x)
            if any(latent.lcs(item, w[i : i + 2 * len(item)]) >= 0.8 * len(item) for i in range(0, len(w), len(item) // 2)):
                brute.add((d, k))
    assert want <= brute and len(got & brute) >= 0.97 * len(brute) and got <= brute
    kept = latent.keep_unleaked(spark, df.withColumn("kind", F.lit(1)), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got} and kept.columns == ["doc_id", "text", "kind"]


def test_leaks_are_found_whole(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, x in items if x in r.text}
    assert {(r.doc_id, r.item_id) for r in latent.query(spark, sf).collect()} == want and want


def test_answer_check():
    s = latent.Search()
    item = [f"i{k}" for k in range(20)]
    near = item[:13] + ["z"] * 5
    assert latent.check(item, item, ["i18", "i19"], near + ["i18", "i19"], s)[1] == "paraphrase"
    assert latent.check(item, item, ["i18", "i19"], near, s)[1] is None
    assert latent.check(item, item, [], item[:16], s)[1] == "verbatim"
    assert latent.answer_of("A b c. The answer is four.") == ["the", "answer", "is", "four"] and latent.answer_of("q", "Forty two") == ["forty", "two"] and latent.answer_of(None) == []


def paraphrase_fixture(seed=8):
    """Items of one sentence (even ids) and with an answer (odd); documents with paraphrases that keep 50 to 80 % of the words."""
    rnd = random.Random(seed)
    words = ["the", "of", "and", "to", "in"] * 1000 + ["w" + "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(15_000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(rnd.randint(18, 60)) + (". " + text(8) if i % 2 else ".")) for i in range(40)]
    docs, want = [], {}
    for i in range(600):
        body = text(rnd.randint(5, 400)).split()
        if i % 2 == 0:
            k = rnd.randrange(40)
            leak = latent.words_of(items[k][1])
            telling = [j for j, w in enumerate(leak) if w[0] == "w"]
            gone = set(rnd.sample(range(len(leak)), int(len(leak) * rnd.uniform(0.2, 0.5))))
            answer = [j for j in telling if j >= len(leak) - 8] if k % 2 else []
            share = 1 - len(gone) / len(leak)
            if sum(j not in gone for j in telling) >= 0.55 * len(telling) and sum(j not in gone for j in answer) >= 0.65 * len(answer):
                want[i, k] = share
            at = rnd.randrange(len(body))
            body[at:at] = [f"other{i}x{j}" if j in gone else w for j, w in enumerate(leak)]
        docs.append((i, " ".join(body)))
    return docs, items, want


def test_paraphrases_that_keep_half_of_the_words(spark):
    docs, items, want = paraphrase_fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent.leaks(spark, df, bench, Scratch(spark, "t")).collect()}
    for odd in (0, 1):
        for low, least in ((0.5, 0.7), (0.6, 0.75), (0.7, 0.9)):
            band = {p for p, x in want.items() if low <= x < low + 0.1 and p[1] % 2 == odd}
            assert len(band & got) >= least * len(band)
    assert all(d % 2 == 0 for d, _ in got)


def replaced_fixture(share, seed, n_words):
    """Documents a quarter of which hold an item of which this share of the words is replaced, but for its answer."""
    rnd = random.Random(seed)
    words = ["the", "of", "and", "to", "in"] * (n_words // 15) + ["w" + "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n_words)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items, docs = [(i, text(rnd.randint(18, 60)) + ". " + text(8)) for i in range(40)], []
    for i in range(240):
        body = text(rnd.randint(5, 400)).split()
        if i % 4 == 0:
            leak = latent.words_of(items[i // 4 % 40][1])
            gone = set(rnd.sample(range(len(leak) - 8), min(len(leak) - 8, round(share * len(leak)))))
            at = rnd.randrange(len(body))
            body[at:at] = [f"other{i}x{j}" if j in gone else w for j, w in enumerate(leak)]
        docs.append((i, " ".join(body)))
    return docs, items


@pytest.mark.parametrize("n_words", [1500, 12_000])
def test_candidates_of_paraphrases_against_all_windows(spark, n_words):
    """Of what the exact checks find in every window of every document, the latent search finds at least 0.9."""
    for share in (0.25, 0.35, 0.45):
        docs, items = replaced_fixture(share, 1000 + n_words + round(100 * share), n_words)
        df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        find = lambda s: {(r.doc_id, r.item_id) for r in latent.leaks(spark, df, bench, Scratch(spark, "t"), s).collect()}
        got, every = find(latent.Search()), find(latent.Search(cosine=-2.0, ease=-2.0))
        assert got <= every and len(got) >= 0.9 * len(every) and len(every) >= 25


class Looked(frozenset):
    """Telling features of an item that count how often a region is looked at for them."""

    times = 0

    def intersection(self, *others):
        Looked.times += 1
        return super().intersection(*others)


@pytest.mark.parametrize("slab", [512, 7])
def test_few_candidates_are_looked_at_one_by_one(spark, monkeypatch, slab):
    """The bound of telling words leaves few candidates to look at, and loses none that the checks pass."""
    monkeypatch.setattr(latent, "SLAB", slab, raising=False)
    docs, rows_, want = leak_fixture(5)
    docs, s = docs + [(300, None), (301, ""), (302, rows_[0][1])], latent.Search(cosine=0.05, ease=0.05)
    rows_ = [{"item_id": i, "text": x} for i, x in rows_]
    own = [latent.words_of(r["text"]) for r in rows_]
    terms = latent.Terms(sorted({w for x in own for w in x}))
    space = latent.fit(spark, spark.createDataFrame(docs, "doc_id long, text string").select("text"), terms, own, Scratch(spark, "t"), s)
    items = latent._items(rows_, space, s)
    candidates, best = 0, {}
    for d, text in docs:
        w = [latent.normal(x) for x in (text or "").split()]
        f = np.array([terms.of.get(x, terms.n) for x in w], np.int64)
        for i in range(0, len(w), s.block):
            window = f[i : i + 2 * s.block]
            v = space.weights[window].sum(axis=0)
            cos = items.vectors @ v / np.sqrt(v @ v + s.outside * space.mean * (window == terms.n).sum() + 1e-12)
            for q in np.flatnonzero(cos >= items.least):
                k, candidates = int(items.vector_of[q]), candidates + 1
                pad = max(s.block, len(items.words[k]))
                lo, hi = max(0, i - pad), min(len(w), i + 2 * s.block + pad)
                if 2 * len(items.features[k] & set(f[lo:hi].tolist())) >= len(items.features[k]):
                    share, kind = latent.check(items.words[k], items.telling[k], items.answers[k], w[lo:hi], s)
                    if kind and share > best.get((d, k), (0, None))[0]:
                        best[d, k] = share, kind
    items.features, Looked.times = [Looked(x) for x in items.features], 0

    class Shared:
        value = (space, items)

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], names=["doc_id", "text"])
    got = [r for b in latent._search(Shared, s)(iter([batch])) for r in b.to_pylist()]
    assert {(r["doc_id"], r["item_id"]): (r["share"], r["kind"]) for r in got} == best and len(got) == len(best) >= 0.9 * len(want)
    assert len(best) <= Looked.times <= candidates / 8


def test_items_in_blocks_are_found_alike(spark):
    docs, items, want = leak_fixture(5)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for s in (latent.Search(item_block=7), latent.Search(most_terms=100)):
        got = {(r.doc_id, r.item_id) for r in latent.leaks(spark, df, bench, Scratch(spark, "t"), s).collect()}
        assert want <= got
    assert [len(b) for b, _ in latent._blocks_of(iter([{"text": "a b"}, {"text": "..."}, {"text": "c d e"}, {"text": "c"}]), latent.Search(most_terms=2))] == [1, 1, 1]


def test_copies_of_a_passage_take_one_place_in_the_fit(spark):
    counted = spark.createDataFrame([(1, bytearray(b"hot"))] * 50 + [(k, bytearray(b"p%d" % k)) for k in range(2, 6)] + [(None, None)], "key long, passage binary")
    assert sorted(bytes(r.passage) for r in latent._distinct_passages(counted, latent.Search(fit_passages=4)).collect()) == [b"hot", b"p2", b"p3", b"p4"]


def test_the_fit_takes_every_passage(spark):
    """The space is that of the whole corpus: against a dense fit of all of more passages than 120,000 / 20 documents had places."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(90)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [text(40) for _ in range(6)]
    docs = [text(rnd.randint(1, 70)) for _ in range(7000)]
    docs += docs[:500]  # copies take one place
    own = [latent.words_of(x) for x in items]
    terms = latent.Terms(sorted({w for x in own for w in x}))
    s = latent.Search(stop=0.2, corpus_weight=5000)
    space = latent.fit(spark, spark.createDataFrame([(t,) for t in docs], "text string").repartition(3), terms, own, Scratch(spark, "t"), s)
    blocks = [w[i : i + s.block] for w in map(str.split, docs) for i in range(0, len(w), s.block)]
    df = np.zeros(terms.n)
    for b in blocks:
        df[[terms.of[w] for w in set(b) if w in terms.of]] += 1
    assert (space.live[:-1] == (df <= s.stop * len(blocks))).all() and space.live.sum() > 60
    idf = np.where(space.live[:-1], np.log((len(blocks) + 1) / (df + 1)), 0)
    count = lambda p: np.bincount([terms.of[w] for w in p if w in terms.of], minlength=terms.n) * idf
    a = np.array([count(p) for p in {tuple(sorted(w[i : i + 2 * s.block])): 0 for w in map(str.split, dict.fromkeys(docs)) for i in range(0, len(w), 2 * s.block)}])
    mine = np.array([count(x[i : i + 2 * s.block]) for x in own for i in latent._pieces(x, s)])
    gram = a.T @ a * min(1, s.corpus_weight / len(a)) + s.item_weight * mine.T @ mine
    live = space.live[:-1]
    want = idf[live, None] * np.linalg.inv(gram[np.ix_(live, live)]) * idf[live]
    got = (space.weights[:-1] @ space.weights[:-1].T)[np.ix_(live, live)]
    assert len(a) > 7000 and np.abs(got - want).max() <= 2e-3 * np.abs(want).max()


def test_no_passage_is_left_out_by_their_number(spark):
    """The pipeline's search has no bound of passages: of 130,000 different ones all are in the fit."""
    counted = spark.range(130_000).selectExpr("id AS key", "CAST(CAST(id AS string) AS binary) AS passage")
    assert latent._distinct_passages(counted.unionByName(counted.limit(50)), latent.Search()).count() == 130_000


def test_without_an_answer_all_words_decide():
    s = latent.Search()
    item = [f"i{k}" for k in range(20)]
    assert latent.check(item, item, [], item[:13] + ["z"] * 5, s)[1] == "paraphrase"
    assert latent.check(item, item[:10], [], item[8:], s)[1] is None  # too few telling words


def test_leaks_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "one two three"), (5, " ".join(f"word{i % 977}x{i}" for i in range(100, 140))), (None, "repeated row")], "item_id long, text string")
    got = rows(latent.leaks(spark, odd, bench, Scratch(spark, "t")), "doc_id", "item_id")
    assert {(4, 5), (5, 5)} <= set(got) and not {d for d, _ in got} & {1, 2, 3, 6}
    assert latent.leaks(spark, odd, bench.limit(0), Scratch(spark, "t")).count() == 0 == latent.leaks(spark, none, bench, Scratch(spark, "t")).count()
    assert latent.keep_unleaked(spark, none, bench).count() == 0


def test_licences(spark, odd, none):
    texts = [(1, "A story.\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, "x\n\nThis work is licensed under the GNU General Public License, version 3.\ny"), (4, "Licensed under the Apache License, Version 2.0."), (5, "Licensed under the Bar Community Licence 3.0."),
             (6, "He renewed his driving license on Monday and drove home."), (7, "RELEASED UNDER THE MIT LICENSE.\nReleased under the MIT License."), (8, None), (9, "")]
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    got = licences.scan(spark, spark.createDataFrame(texts, "doc_id long, text string").union(prose))
    mine = {(r.doc_id, r.first_line, r.last_line, r.label) for r in got.filter("doc_id < 1000").collect()}
    assert mine == {(1, 1, 1, "mit"), (2, 0, 0, "cc-by-nc"), (3, 2, 2, "gpl"), (4, 0, 0, "apache"), (5, 0, 0, "unknown"), (7, 0, 1, "mit")}
    assert licences.scan(spark, none).count() == 0 and licences.scan(spark, odd).filter("label <> 'unknown'").count() == 0


def test_licences_of_the_corpus(spark):
    """Every line that the corpus plants is found, by a plain search of those lines."""
    sf = "/root/testdata/sf0.01"
    plain = {"Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache"}
    want = {(r.doc_id, i, plain[x]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, x in enumerate(r.text.split("\n")) if x in plain}
    got = {(r.doc_id, r.first_line, r.label) for r in licences.query(spark, sf).collect() if r.label in plain.values()}
    assert want == got


def test_a_frequent_notice_is_still_found():
    """Notices in a share of all paragraphs keep their cue words and teach no ordinary text."""
    rnd = random.Random(2)
    prose = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(12)) for _ in range(3000)]
    lines = {"All rights reserved.": "all-rights-reserved", "This is free and unencumbered software released into the public domain.": "unlicense", licences.NOTICES["gpl"][6]: "gpl"}
    m = licences.train(prose + [x for x in lines for _ in range(300)])
    for line, label in lines.items():
        assert m.cues & {w.encode() for w in licences.words_of(line)} and licences.classify(line, m)[0] == label
    for notices in (*licences.NOTICES.values(), licences.OTHERS):
        assert all(m.cues & {w.encode() for w in licences.words_of(n)} for n in notices)


def test_licence_accuracy_on_unseen_variants():
    m = licences.train(["plain words of some story"] * 50)
    rnd = random.Random(77)
    right = total = 0
    for f, notices in licences.NOTICES.items():
        for n in notices:
            for _ in range(3):
                total += 1
                right += licences.classify(licences._variant(n, rnd), m)[0] == f
    assert right >= 0.85 * total
    assert sum(licences.classify(n, m)[0] not in ("none", "unknown") for n in licences.PROSE) == 0


def test_notices_and_families_that_training_never_saw():
    """Notices held out of training, each third of a family: most are still a licence, few that of a sibling family. Families held out: hardly another one."""
    for part in range(3):
        left = {f: tuple(n for i, n in enumerate(ns) if i % 3 != part) for f, ns in licences.NOTICES.items()}
        m = licences.train(["plain words of some story"] * 50, licences.Scan(), left)
        held = [(f, n) for f, ns in licences.NOTICES.items() for i, n in enumerate(ns) if i % 3 == part]
        got = [(f, licences.classify(n, m)[0]) for f, n in held]
        assert sum(y != "none" for _, y in got) >= 0.7 * len(got) and sum(y not in (f, "none", "unknown") for f, y in got) <= 0.2 * len(got)
    for gone in ("boost", "epl", "cc0"):
        m = licences.train(["plain words of some story"] * 50, licences.Scan(), {f: ns for f, ns in licences.NOTICES.items() if f != gone})
        assert sum(licences.classify(n, m)[0] not in ("none", "unknown") for n in licences.NOTICES[gone]) <= 1


def test_a_model_is_trained_once():
    a = licences.trained(["one line", "another"])
    assert licences.trained(["one line", "another"]) is a and licences.trained(["one line"]) is not a
