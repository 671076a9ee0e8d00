"""Which tables and columns a result rests on, read from its plan, and whether a contract lists them."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame

active = False


@contextlib.contextmanager
def tracing():
    """Within it, tables that are written and read again on the way are traced to what they were made from."""
    global active
    before, active = active, True
    try:
        yield
    finally:
        active = before


def columns_read(df: DataFrame) -> set[tuple[str, str]]:
    """(table, column) of every file scan of df's physical plan, a table by the name of its file or folder."""
    from factweave.sources.files import WRITTEN

    out: set[tuple[str, str]] = set()
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        roots = leaf.relation().location().rootPaths()
        for k in range(roots.size()):
            path = roots.apply(k).toString()
            made = next((columns for at, columns in WRITTEN.items() if path.rstrip("/").endswith(at.split("://")[-1].removeprefix("file:"))), None)
            if made is not None:
                out |= made
            else:
                out |= {(path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet"), c) for c in leaf.requiredSchema().fieldNames()}
    return out


def untraced(found: set[tuple[str, str]], declared: dict[str, str]) -> tuple[list[str], list[str]]:
    """(columns read but not declared, columns declared but not read), as table.column; declared: table -> its columns,
    parted by spaces."""
    listed = {(t, c) for t, columns in declared.items() for c in columns.split()}
    name = lambda s: sorted(f"{t}.{c}" for t, c in s)
    return name(found - listed), name(listed - found)
