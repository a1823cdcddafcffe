"""python -m tessera.repl [DIR]: commands from standard input, replies to standard output."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import SparkSession

from tessera.engine import Engine
from tessera.server import reply


def loop(engine, lines: Iterable[str], out: TextIO) -> None:
    for line in lines:
        text = line.strip()
        if text.lower() in ("exit", "quit"):
            break
        if text:
            print(reply(engine, text), file=out, flush=True)


def main() -> None:
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    loop(Engine(spark, sys.argv[1] if len(sys.argv) > 1 else "data"), sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
