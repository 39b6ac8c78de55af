"""python -m lodestone DIRECTORY "SQL" [--out DIR] [--parts] [--explain]"""

from __future__ import annotations

import argparse
import sys
import time

from lodestone.session import Engine, build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone", description="Run one SQL query over a directory of typed CSV or parquet tables.")
    p.add_argument("directory")
    p.add_argument("sql", help="a query, or @FILE")
    p.add_argument("--out", default="output", help="folder for result.csv")
    p.add_argument("--parts", action="store_true", help="write a folder of parts, result, instead of result.csv")
    p.add_argument("--explain", action="store_true", help="print the physical plan first")
    a = p.parse_args(argv)
    began = time.time()
    try:
        engine = Engine(build_session())
        engine.load_dir(a.directory)
        text = open(a.sql[1:], encoding="utf-8").read() if a.sql.startswith("@") else a.sql
        if a.explain:
            print(engine.explain(text))
        print(engine.write_result(engine.sql(text), f"{a.out}/result" + ".csv" * (not a.parts)))
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{time.time() - began:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
