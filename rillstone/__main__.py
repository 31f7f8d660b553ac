"""python -m rillstone script|schema --context module:function [--output file]: exports of a context, made by a function of
the session."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession


def main(given: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rillstone", description="Exports of a context.")
    parser.add_argument("what", choices=["script", "schema"])
    parser.add_argument("--context", "-c", required=True, help="module:function; the function takes a session and gives a StreamContext")
    parser.add_argument("--output", "-o", help="a file; standard output if left out")
    args = parser.parse_args(given)
    module, _, function = args.context.partition(":")
    sys.path.insert(0, str(Path.cwd()))
    context = getattr(importlib.import_module(module), function or "context")(SparkSession.builder.getOrCreate())
    text = context.script() if args.what == "script" else json.dumps({k: json.loads(v) for k, v in context.schemas().items()}, indent=2)
    if args.output:
        Path(args.output).write_text(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
