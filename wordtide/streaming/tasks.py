"""Execution control (B1-B8): work in order by key, cancellation, a barrier.

Only driver-side control passes through here; the data work of a task is a Spark job.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager

_log = logging.getLogger("wordtide")


class TaskQueue:
    """Tasks of one key run one after another, in the order of queueing; keys run side by side."""

    def __init__(self, workers: int = 8):
        self._pool = ThreadPoolExecutor(workers, thread_name_prefix="wordtide")
        self._lock = threading.Condition(threading.RLock())
        self._last: dict[str, Future] = {}
        self._cancel: dict[str, threading.Event] = {}
        self._pending = 0
        self._owners: list[int] = []  # threads that pause, one entry for each pause

    def queue(self, key: str, work: Callable[..., object], cancellation_key: str | None = None, with_token: bool = False) -> Future:
        """B1; B2 with_token: work gets an event that is set on cancellation. Waits while paused."""
        done: Future = Future()
        with self._lock:
            while self._owners and threading.get_ident() not in self._owners:
                self._lock.wait()
            token = self._cancel.setdefault(cancellation_key, threading.Event()) if cancellation_key is not None else threading.Event()
            before = self._last.get(key)
            self._last[key] = done
            self._pending += 1

        def run(_: object = None) -> None:
            try:
                if token.is_set():
                    done.cancel()
                    done.set_running_or_notify_cancel()
                else:
                    done.set_running_or_notify_cancel()
                    done.set_result(work(token) if with_token else work())
            except BaseException as e:  # the future carries it
                done.set_exception(e)
            finally:
                with self._lock:
                    self._pending -= 1
                    if self._last.get(key) is done:
                        del self._last[key]  # B6
                    self._lock.notify_all()

        if before is None:
            self._pool.submit(run)
        else:
            before.add_done_callback(lambda _: self._pool.submit(run))
        return done

    def cancel(self, cancellation_key: str) -> None:
        """Work with this key that has not begun will not; what is queued later runs."""
        with self._lock:
            event = self._cancel.pop(cancellation_key, None)
        if event is not None:
            event.set()

    @property
    def is_empty(self) -> bool:
        """B5."""
        with self._lock:
            return self._pending == 0

    @contextmanager
    def pause(self) -> Iterator[None]:
        """Nothing new is queued until the block ends; it begins when all queued work is done."""
        with self._lock:
            self._owners.append(threading.get_ident())
            while self._pending:
                self._lock.wait()
        try:
            yield
        finally:
            with self._lock:
                self._owners.remove(threading.get_ident())
                self._lock.notify_all()

    def dispose(self) -> None:
        self._pool.shutdown(wait=True)


def ignore_errors(work: Callable[[], object]) -> Callable[[], object | None]:
    """The work with its errors logged instead of raised."""

    def run() -> object | None:
        try:
            return work()
        except Exception:
            _log.warning("ignored", exc_info=True)
            return None

    return run
