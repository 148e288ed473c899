"""A prompt for statements: python -m millrace [folder of Parquet tables]. Statements end with a semicolon."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from millrace.plans.engine import Engine


def loop(engine: Engine, lines, out=print) -> None:
    """Runs statements as they are completed; .tables and .quit are commands. An error ends its statement only."""
    text = ""
    for line in lines:
        if not text and line.strip() in (".quit", ".exit"):
            return
        if not text and line.strip() == ".tables":
            out("\n".join(sorted({*engine.tables, *engine.views})))
            continue
        text += line if line.endswith("\n") else line + "\n"
        if not text.rstrip().endswith(";"):
            continue
        try:
            for result in engine.execute_batch(text):
                out(result.to_table_string())
        except (PySparkException, ValueError, KeyError) as error:
            out(f"error: {str(error).splitlines()[0]}")
        text = ""


def main() -> None:
    engine = Engine(SparkSession.builder.appName("millrace").getOrCreate())
    if len(sys.argv) > 1:
        engine.attach(sys.argv[1], tuple(p.stem for p in Path(sys.argv[1]).glob("*.parquet")))
    loop(engine, sys.stdin)


if __name__ == "__main__":
    main()
