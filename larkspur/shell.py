"""python -m larkspur.shell [--small] [--empty] [--rows N] [script ...]: a prompt, or scripts, for the dialect."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine, Result
from .errors import EngineError
from .plans.syntax import parse
from .sources import demo


def table(names: list[str], rows: list[tuple], most: int) -> str:
    """Rows as text, the first `most` of them."""
    cells = [["NULL" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r] for r in rows[:most]]
    widths = [max(map(len, column)) for column in zip(names, *cells, strict=True)]
    line = lambda row: "| " + " | ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)) + " |"
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    more = [f"({len(rows) - most} more rows)"] if len(rows) > most else []
    return "\n".join([rule, line(names), rule, *map(line, cells), rule, *more, f"{len(rows)} rows"])


def show(result: Result, seconds: float, most: int) -> None:
    if result.plan:
        print("\n".join(result.plan))
    elif result.frame is not None:
        print(table(result.frame.columns, [tuple(r) for r in result.rows()], most))
        print(f"{seconds:.3f} s")
    else:
        print(result.message)


def run(engine: Engine, text: str, most: int, echo: bool) -> None:
    """Runs statements one after the other; an error in one does not stop the rest."""
    try:
        statements = parse(text)
    except EngineError as e:
        print(f"error: {e}")
        return
    for s in statements:
        if echo:
            print(f"> {s.text}")
        try:
            began = time.perf_counter()
            result = engine.run(s)
            if result.frame is not None and not result.plan:
                result.rows()
            show(result, time.perf_counter() - began, most)
        except EngineError as e:
            print(f"error: {e}")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--small", action="store_true")
    args.add_argument("--empty", action="store_true")
    args.add_argument("--rows", type=int, default=20)
    args.add_argument("scripts", nargs="*")
    given = args.parse_args()
    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    engine = Engine(spark)
    if not given.empty:
        demo.load(engine, large=not given.small, skewed=not given.small)
    for script in given.scripts:
        run(engine, Path(script).read_text(), given.rows, True)
    waiting = ""
    while not given.scripts:
        try:
            line = input("larkspur> " if not waiting else "       -> ")
        except EOFError:
            break
        if not waiting and line.strip().lower() in ("\\q", "quit", "exit"):
            break
        waiting += line + "\n"
        if line.rstrip().endswith(";"):
            run(engine, waiting, given.rows, False)
            waiting = ""


if __name__ == "__main__":
    sys.exit(main())
