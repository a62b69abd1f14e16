"""Runs SQL from the command line: python -m millrace.cli --root DIR (-q SQL | -f FILE)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from .engine import Engine
from .session import session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--root", required=True, help="folder of the catalog and its tables")
    parser.add_argument("-q", "--query", help="one or more statements")
    parser.add_argument("-f", "--file", help="script; statements end with ; or a line GO")
    own = parser.parse_args(args)
    sql = own.query or open(own.file, encoding="utf-8").read()
    for found in Engine(session("millrace-cli"), own.root).script(sql):
        if isinstance(found, DataFrame):
            found.show(truncate=False)
        else:
            print(found)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
