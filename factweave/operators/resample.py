"""Bootstrap intervals of any statistic of weighted sums, and intervals of capture-recapture estimates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A row's weights in the draws are a multiplicative generator's numbers, started from a hash of its id.
PRIME, STEP, FIRST = (1 << 31) - 1, 48271, 69621
KEYS = 4096  # keys whose sums a task holds before it passes them on


def thresholds() -> list[int]:
    """Of a number below PRIME how many of these it reaches is distributed as Poisson with mean 1."""
    p, below, out = float(np.exp(-1.0)), 0.0, []
    for k in range(1, 13):
        below, p = below + p, p / k
        out.append(int(below * PRIME))
    return out


def steps(draws: int, seed: int) -> list[int]:
    """By draw what a row's start is multiplied by, modulo PRIME."""
    at, out = pow(FIRST, 1 + seed, PRIME), []
    for _ in range(draws):
        at = at * STEP % PRIME
        out.append(at)
    return out


def start_of(*id: str) -> Column:
    """A number in 1..PRIME - 1 from the text of the id columns (null: empty)."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long") % (PRIME - 1) + 1


def _partial(draws: int, seed: int, names: Sequence[str], kind):
    def rows(batches):
        up, cuts, held = np.array(steps(draws, seed)), np.array(thresholds()), {}

        def emit():
            keys = [k for k in held for _ in range(draws + 1)]
            cells = np.concatenate([*held.values()]) if held else np.zeros((0, len(names)))
            columns = [pa.array(keys, kind), pa.array(np.tile(np.arange(draws + 1, dtype=np.int32), len(held)))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(cells[:, j]) for j in range(len(names)))], names=["key", "draw", *names])

        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                start = part.column(1).to_numpy()
                weight = np.ones((part.num_rows, draws + 1))  # draw 0 is the rows as they are
                weight[:, 1:] = np.searchsorted(cuts, start[:, None] * up % PRIME, "right")
                values = np.stack([part.column(2 + j).to_numpy(zero_copy_only=False) for j in range(len(names))], 1).astype(np.float64)
                coded = part.column(0).dictionary_encode("encode")
                code = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                for k, rows_ in zip(coded.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))[:-1]), strict=True):
                    sums = weight[rows_].T @ values[rows_]
                    held[k] = held[k] + sums if k in held else sums
                if len(held) >= KEYS:
                    yield emit()
                    held = {}
        yield emit()

    return rows


def bootstrap(rows: DataFrame, key: str, measures: dict[str, Column], statistic: Callable[[dict[str, Column]], Column], id: Sequence[str], draws: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(key, estimate, lower, upper): a statistic of each key's rows and the central level of its values over Poisson
    resamples of the rows.

    measures are columns over rows, whose weighted sums by name (and n, the sum of weights) statistic gets and combines.
    A measure that is null counts as 0 (say n_x = value is not null where it shouldn't).  A row's weights come from a hash
    of its id columns and the seed, so the result is the same however rows are dealt out, but for the order in which
    floating-point sums are added.  A task turns its rows into one row of sums for each key and draw; nothing else moves.
    Draws in which the statistic is null are passed over; a key without any other has null bounds.
    """
    if not 0 < level < 1 or draws < 100:
        raise ValueError("a level lies between zero and one, and at least 100 draws are needed")
    named = {**measures, "n": F.lit(1)}
    field = rows.schema[key]
    given = rows.select(F.col(key).alias("key"), start_of(*id).alias("start"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in named.items()))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"key {field.dataType.simpleString()}, draw int, " + ", ".join(f"`{n}` double" for n in named)
    sums = given.mapInArrow(_partial(draws, seed, list(named), to_arrow_type(field.dataType)), schema).groupBy("key", "draw").agg(*(F.sum(n).alias(n) for n in named))
    each = sums.select("key", "draw", statistic({n: F.col(n) for n in named}).alias("s"))
    again = F.when(F.col("draw") > 0, F.col("s"))
    return each.groupBy("key").agg(F.max(F.when(F.col("draw") == 0, F.col("s"))).alias("estimate"), F.percentile(again, (1 - level) / 2).alias("lower"), F.percentile(again, (1 + level) / 2).alias("upper")).withColumnRenamed("key", key)


def draws_sql(table: str, key: str, id: Sequence[str], measures: dict[str, str], draws: int, seed: int = 0) -> str:
    """The weighted sums by key and draw in the oracle's SQL, as a common table expression's body."""
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in id)
    ups = f"[{', '.join(map(str, steps(draws, seed)))}]"
    weight = " + ".join(f"CASE WHEN r >= {t} THEN 1 ELSE 0 END" for t in thresholds())
    named = ", ".join(f"{e} AS {n}" for n, e in {**measures, "n": "1.0"}.items())
    sums = ", ".join(f"sum(w * coalesce({n}, 0)) AS {n}" for n in [*measures, "n"])
    return f"""SELECT key, draw, {sums} FROM (SELECT *, CASE WHEN draw = 0 THEN 1 ELSE {weight} END AS w FROM (SELECT *, CASE WHEN draw > 0 THEN start * {ups}[draw] % {PRIME} ELSE 0 END AS r
      FROM (SELECT {key} AS key, {named}, CAST('0x' || substr(sha256({text}), 1, 12) AS BIGINT) % {PRIME - 1} + 1 AS start FROM {table}), range({draws + 1}) AS d(draw))) GROUP BY key, draw"""


def capture_interval(counts: DataFrame, draws: int = 2000, seed: int = 0, level: float = 0.95, violations: Sequence[str] = ()) -> DataFrame:
    """counts (a, b, m) with estimate, lower, upper and violations: Chapman's estimate of the population two captures of a
    and b share m of, and the central level of estimates from hypergeometric draws of the overlap at that population.

    Without overlap there is no estimate and a violation says so; counts that can't be are a violation too.  Independence
    can't be seen in the counts: what is known against it goes into violations, beside which no interval is a bound on
    the population.  Populations of 10**9 and more, which the generator doesn't take, get the normal approximation.
    """
    if not 0 < level < 1 or draws < 100:
        raise ValueError("a level lies between zero and one, and at least 100 draws are needed")
    ends = [(1 - level) / 2, (1 + level) / 2]

    def one(a: int, b: int, m: int):
        if min(a, b, m) < 0 or m > min(a, b):
            return None, None, None, [*violations, "Counts that can't be"]
        if m == 0:
            return None, None, None, [*violations, "Zero overlap: no finite population estimate reported"]
        estimate = (a + 1) * (b + 1) / (m + 1) - 1
        total = max(a + b - m, round(estimate))
        rng = np.random.default_rng(seed)
        if total < 10**9:
            overlap = rng.hypergeometric(a, total - a, b, size=draws)
        else:
            spread = np.sqrt(a * (b / total) * (1 - a / total) * (1 - b / total) * total / (total - 1))
            overlap = np.clip(np.rint(rng.normal(a * (b / total), spread, draws)), max(0, a + b - total), min(a, b))
        lower, upper = np.quantile((a + 1) * (b + 1) / (overlap + 1) - 1, ends)
        return estimate, float(lower), float(upper), list(violations)

    def part(frames):
        for f in frames:
            found = [one(*(int(x) for x in r)) if not any(pd.isna(x) for x in r) else (None, None, None, [*violations, "Counts that can't be"]) for r in zip(f.a, f.b, f.m, strict=True)]
            out = pd.DataFrame(found, columns=["estimate", "lower", "upper", "violations"], index=f.index)
            yield pd.concat([f, out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)
    return counts.mapInPandas(part, f"{fields}, estimate double, lower double, upper double, violations array<string>")


def ratio(top: str, bottom: str) -> Callable[[dict[str, Column]], Column]:
    """The statistic that divides one measure's sum by another's; null where that is 0."""
    return lambda s: F.try_divide(s[top], s[bottom])
