"""The console (C1-C8): q, qw, sub, unsub, index?, sub?, exit."""

from __future__ import annotations

import shlex
import sys
from collections.abc import Iterable

from wordtide.streaming.engine import Engine

HELP = "q WORD | qw WORD | sub FOLDER [MASK] | unsub FOLDER [MASK] | index? | sub? | exit"


def run(engine: Engine, lines: Iterable[str], out=sys.stdout) -> None:
    """Carries out each line; blank, incomplete and unknown ones do nothing."""
    for line in lines:
        try:
            parts = shlex.split(line)
        except ValueError:
            continue
        match parts:
            case ["q", word, *_]:
                print(*engine.search(word), sep="\n", file=out)
            case ["qw", word, *_]:
                print(*engine.search(word, wait=True), sep="\n", file=out)
            case ["sub", folder, *rest]:
                engine.subscribe(folder, rest[0] if rest else None, wait=False)
            case ["unsub", folder, *rest]:
                engine.unsubscribe(folder, rest[0] if rest else None)
            case ["index?", *_]:
                print(engine.is_indexing, file=out)
            case ["sub?", *_]:
                print(*engine.subscriptions, sep="\n", file=out)
            case ["exit", *_]:
                return


def main() -> None:
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.appName("wordtide").getOrCreate()).start()
    print(HELP)
    try:
        run(engine, sys.stdin)
    finally:
        engine.dispose()


if __name__ == "__main__":
    main()
