"""Summarise the physical plans of registered queries (before AQE re-planning).

usage: python tests/plan_report.py SF_DIR name [name ...]
Counts exchanges, join strategies, windows and sorts, and lists each scan's
pushed filters and read schema.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(text: str) -> dict:
    ops = re.findall(r"^\(\d+\) (\w[\w ]*?)(?: \[codegen id : \d+\])?$", text, flags=re.M)
    count = {}
    for o in ops:
        o = o.strip()
        count[o] = count.get(o, 0) + 1
    scans = re.findall(r"Location: \w+ \[file:[^\]]*/([\w.]+)\]\n(?:PushedFilters: (\[.*?\])\n)?ReadSchema: struct<(.*?)>", text)
    return {"ops": count, "scans": [(t, f or "[]", len(s.split(","))) for t, f, s in scans]}


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    from kharif.session import build_session
    import __spark_entry__ as entry

    spark = build_session()
    for n in names:
        df = entry.queries()[n](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        s = summarise(buf.getvalue())
        keep = {k: v for k, v in s["ops"].items() if any(w in k for w in ("Exchange", "Join", "Window", "Sort", "Aggregate", "Scan", "Limit"))}
        print(f"{n}: {keep}")
        for t, f, ncols in s["scans"]:
            print(f"    scan {t}: {ncols} columns, pushed {f}")
    spark.stop()


if __name__ == "__main__":
    main()
