import io
import re
import threading
import time

import pytest
from helpers import rows

from wordtide import repl
from wordtide.functions.text import path_key_of
from wordtide.plans.store import Conflict, Store
from wordtide.sources import files, live
from wordtide.streaming.engine import Engine
from wordtide.streaming.tasks import TaskQueue, ignore_errors


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    yield e
    e.dispose()


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "Docs"
    d.mkdir()
    (d / "a.txt").write_text("one two\ntwo three")
    (d / "B.TXT").write_text("two The\r\nfour\rfive six")
    (d / "c.md").write_text("two")
    (d / "sub").mkdir()
    (d / "sub" / "deep.txt").write_text("two")
    return d


def key(p):
    return path_key_of(str(p))


def test_files(spark, folder):
    assert [n for _, n, *_ in files.list_folder(str(folder))] == ["B.TXT", "a.txt", "c.md"]
    assert files.list_folder("/no/such/folder") == []
    assert rows(files.listed(spark, str(folder), "*.txt"), "name") == [("B.TXT",), ("a.txt",)]
    (folder / "u16.txt").write_bytes("nine ten\nnine".encode("utf-16"))
    (folder / "bom.txt").write_bytes(b"\xef\xbb\xbfeleven")
    (folder / "odd +name %41.txt").write_text("twelve")
    (folder / "bad.txt").write_bytes(b"x\xff y")
    found = rows(files.tokens(spark, [str(folder / n) for n in ("B.TXT", "u16.txt", "bom.txt", "odd +name %41.txt", "bad.txt")]))
    assert [(p.rsplit("/", 1)[1], t) for p, t in found] == sorted([("B.TXT", t) for t in ("The", "five", "four", "six", "two")] + [("u16.txt", "nine"), ("u16.txt", "ten"), ("bom.txt", "eleven"), ("odd +name %41.txt", "twelve"), ("bad.txt", "x\ufffd"), ("bad.txt", "y")])


def test_subscribe_search_unsubscribe(engine, folder):
    assert engine.subscribe(str(folder), "*.txt") and not engine.subscribe(str(folder), "*.TXT")
    assert not engine.subscribe(str(folder / "missing"))
    assert sorted(engine.search("two")) == sorted([key(folder / "a.txt"), key(folder / "B.TXT")])
    assert engine.search("the") == [] and engine.search("The") == [key(folder / "B.TXT")] and engine.search(None) == [] and engine.search("one two") == []
    engine.subscribe(str(folder), "*.md")
    assert len(engine.search("two")) == 3
    assert engine.subscriptions == [f"{key(folder)}/*.txt|*.md"]
    assert engine.unsubscribe(str(folder), "*.md") and len(engine.search("two")) == 2
    assert not engine.unsubscribe(str(folder), "*.pdf")
    assert engine.unsubscribe(str(folder)) and engine.search("two") == [] and engine.subscriptions == []
    assert engine.subscribe(str(folder)) and len(engine.search("two")) == 3


def test_changes(engine, folder):
    engine.subscribe(str(folder))
    (folder / "a.txt").write_text("seven seven one")
    (folder / "new.txt").write_text("two")
    (folder / "c.md").unlink()
    assert engine.search("seven") == []  # as indexed now
    assert engine.search("seven", wait=True) == [key(folder / "a.txt")]
    assert engine.search("three") == [] and sorted(engine.search("two")) == sorted([key(folder / "B.TXT"), key(folder / "new.txt")])
    before = engine.store.version()
    engine.refresh()
    assert engine.store.version() == before  # nothing new, no version
    engine.store.compact()
    assert engine.search("one") == [key(folder / "a.txt")]


def test_rename_and_single_file_masks(engine, folder):
    engine.subscribe(str(folder), "a.txt")
    (folder / "a.txt").rename(folder / "z.txt")
    engine.rename(str(folder / "a.txt"), str(folder / "z.txt"))
    assert engine.subscriptions == [f"{key(folder)}/z.txt"] and engine.search("one") == [key(folder / "z.txt")]
    assert engine.search("one", wait=True) == [key(folder / "z.txt")]
    (folder / "z.txt").unlink()
    assert engine.search("one", wait=True) == [] and engine.subscriptions == []


def test_rename_exchanges(engine, folder):
    engine.subscribe(str(folder))
    engine.rename(str(folder / "a.txt"), str(folder / "c.md"))
    assert engine.search("three") == [key(folder / "c.md")] and key(folder / "a.txt") in engine.search("two")


def test_stream(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "live")).start()
    try:
        e.subscribe(str(folder), "*.txt")
        assert sorted(e.search("two", wait=True)) == sorted([key(folder / "a.txt"), key(folder / "B.TXT")])
        (folder / "a.txt").write_text("eight")
        (folder / "n.txt").write_text("eight")
        (folder / "B.TXT").unlink()
        assert sorted(e.search("eight", wait=True)) == sorted([key(folder / "a.txt"), key(folder / "n.txt")])
        assert e.search("two") == []
        for _ in range(100):
            if not e.is_indexing:
                break
            time.sleep(0.05)
        assert not e.is_indexing
    finally:
        e.dispose()


def test_listing_changes():
    old = {"A": ("/a", 1, 1), "B": ("/b", 1, 1), "C": ("/c", 1, 1)}
    new = {"A": ("/a", 1, 1), "B": ("/b", 2, 1), "D": ("/d", 1, 1)}
    assert live.changes(old, new) == [("deleted", "C", "/c"), ("created", "D", "/d"), ("changed", "B", "/b")]


def test_reader_repeats_a_batch(tmp_path, folder):
    (tmp_path / "f.json").write_text(f'{{"{folder}": ["*"]}}')
    r = live.FolderReader(str(tmp_path / "f.json"), str(tmp_path / "state"))
    rows_, end = r.read(r.initialOffset())
    rows_ = list(rows_)
    assert len(rows_) == 3 and list(r.readBetweenOffsets(r.initialOffset(), end)) == rows_
    assert r.read(end)[1] == end
    r.commit(end)


@pytest.fixture
def running(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "live")).start()
    yield e
    e.dispose()


def within(seconds, work):
    """The result of work, which may not take longer."""
    from concurrent.futures import ThreadPoolExecutor

    return ThreadPoolExecutor(1).submit(work).result(seconds)


def test_unsubscribe_under_the_stream(running, folder):
    running.subscribe(str(folder), "*.txt")
    running.subscribe(str(folder), "*.md")
    assert within(60, lambda: running.unsubscribe(str(folder), "*.md")) and key(folder / "c.md") not in running.search("two", wait=True)
    (folder / "a.txt").write_text("later")
    assert running.search("later", wait=True) == [key(folder / "a.txt")]
    assert within(60, lambda: running.unsubscribe(str(folder))) and running.search("later", wait=True) == []


@pytest.mark.parametrize("which", ["engine", "running"])
def test_subscribing_again_indexes_again(request, which, folder):
    """A mask that overlaps another and was unsubscribed finds its files again, which the listing never lost."""
    e = request.getfixturevalue(which)
    e.subscribe(str(folder), "*.txt")
    e.subscribe(str(folder), "a*")
    e.unsubscribe(str(folder), "*.txt")
    assert e.search("one", wait=True) == []
    assert within(60, lambda: e.subscribe(str(folder), "*.txt")) and e.search("one", wait=True) == [key(folder / "a.txt")]


@pytest.mark.parametrize("which", ["engine", "running"])
def test_renames_on_disk_are_followed(request, which, folder):
    e = request.getfixturevalue(which)
    e.subscribe(str(folder), "a.txt")
    (folder / "a.txt").rename(folder / "z.txt")
    assert e.search("one", wait=True) == [key(folder / "z.txt")] and e.subscriptions == [f"{key(folder)}/z.txt"]
    revs = e.store.names().filter("rev IS NOT NULL").select("rev").distinct().count()
    assert revs == 1  # the content was not read again
    (folder / "z.txt").write_text("one more")
    assert e.search("more", wait=True) == [key(folder / "z.txt")]
    e.subscribe(str(folder), "*.md")
    (folder / "c.md").rename(folder / "c.rst")  # no mask covers it, none names it
    assert e.search("two", wait=True) == []


def test_many_renames_in_a_row(engine, folder):
    engine.subscribe(str(folder))
    (folder / "a.txt").rename(folder / "t")
    (folder / "c.md").rename(folder / "a.txt")
    (folder / "t").rename(folder / "c.md")  # exchanged
    assert engine.search("one", wait=True) == [key(folder / "c.md")]
    (folder / "c.md").rename(folder / "new.md")
    (folder / "c.md").write_text("one")
    assert sorted(engine.search("one", wait=True)) == [key(folder / "c.md"), key(folder / "new.md")]


def test_unreadable_files_are_offered_again(engine, folder, monkeypatch):
    import os

    locked, access = {str(folder / "a.txt"), str(folder / "new.txt")}, os.access
    engine.subscribe(str(folder))
    monkeypatch.setattr(os, "access", lambda p, mode: p not in locked and access(p, mode))
    (folder / "a.txt").write_text("changed text")
    (folder / "new.txt").write_text("changed too")
    assert engine.search("changed", wait=True) == [] and engine.search("one") == [key(folder / "a.txt")]  # left as it is
    locked.clear()
    assert sorted(engine.search("changed", wait=True)) == [key(folder / "a.txt"), key(folder / "new.txt")] and engine.search("one") == []


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 2)
    seen = s.version()
    assert s.publish(s.manifest() | {"seq": 1}, seen) == 1
    with pytest.raises(Conflict):
        s.publish(s.manifest() | {"seq": 2}, seen)
    assert s.manifest()["seq"] == 1


def test_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 2)
    name = lambda p, rev, seq: spark.createDataFrame([(p, p, "F", p, rev, seq, True)], "path_key string, path string, folder_key string, name string, rev string, seq long, live boolean")
    for i in range(3):
        s.append(spark.createDataFrame([("x", f"r{i}")], "token string, rev string"), name(f"P{i}", f"r{i}", i), i)
    s.compact()
    assert len(s.vacuum()) == 3 + 6 and s.vacuum() == []
    assert rows(s.search("x")) == [("P0",), ("P1",), ("P2",)] and s.version() == 4


def test_two_pausers():
    q, order = TaskQueue(), []

    def pauser(i):
        with q.pause():
            q.queue(f"k{i}", lambda: order.append(i)).result(5)
            time.sleep(0.05)

    threads = [threading.Thread(target=pauser, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(10)
    assert sorted(order) == [0, 1] and not any(t.is_alive() for t in threads)
    q.dispose()


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 2)
    assert s.version() == 0 and s.search("x").count() == 0
    name = lambda p, rev, seq, ok: spark.createDataFrame([(p, p, "F", p, rev, seq, ok)], "path_key string, path string, folder_key string, name string, rev string, seq long, live boolean")
    post = lambda *t: spark.createDataFrame(list(t), "token string, rev string")
    s.append(post(("x", "r1"), ("y", "r1")), name("P", "r1", 1, True), 1)
    s.append(post(("y", "r2")), name("P", "r2", 2, True), 2)
    assert rows(s.search("x")) == [] and rows(s.search("y")) == [("P",)] and rows(s.search("x", 1)) == [("P",)]
    plan = s.search("y")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,y)" in plan and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    s.append(None, name("P", None, 3, False), 3)
    assert rows(s.search("y")) == [] and s.documents().count() == 0 and s.live_postings().count() == 0
    s.compact()
    assert rows(s.search("y")) == []


def test_queue_order_cancel_pause():
    q, seen = TaskQueue(), []
    for i, delay in enumerate((0.1, 0.02, 0.0)):
        q.queue("k", lambda i=i, d=delay: (time.sleep(d), seen.append(i)))
    q.queue("other", lambda: seen.append("o"))
    with q.pause():
        assert q.is_empty and [x for x in seen if x != "o"] == [0, 1, 2]
    gate = threading.Event()
    q.queue("k", gate.wait)
    dropped = [q.queue("k", lambda: seen.append("no"), "c") for _ in range(2)]
    kept = q.queue("k", lambda: "yes", "d")
    q.cancel("c")
    later = q.queue("k", lambda: "later", "c")
    gate.set()
    assert kept.result(5) == "yes" and later.result(5) == "later" and "no" not in seen and all(f.cancelled() for f in dropped)
    begun = threading.Event()
    running = q.queue("t", lambda token: begun.set() or token.wait(5), "run", with_token=True)
    assert begun.wait(5)
    q.cancel("run")
    assert running.result(5)
    failed = q.queue("k", lambda: 1 / 0)
    assert isinstance(failed.exception(5), ZeroDivisionError) and q.queue("k", lambda: 7).result(5) == 7
    assert ignore_errors(lambda: 1 / 0)() is None
    q.dispose()


def test_repl(engine, folder):
    out = io.StringIO()
    repl.run(engine, ["", "nonsense", "q", f"sub '{folder}' *.txt", "qw two", "sub?", f"unsub '{folder}' *.txt", "q two", "index?", "exit", "q two"], out)
    got = [x for x in out.getvalue().split("\n") if x]
    assert sorted(got[:2]) == sorted([key(folder / "a.txt"), key(folder / "B.TXT")]) and got[2] == f"{key(folder)}/*.txt" and got[3] == "False" and len(got) == 4
