"""Values that depend on all rows before, over series of any length: no series, long or single, passes through one task.

A series is cut into chunks of days. What a chunk does to a state that comes in is summed up in one row; these rows, one
for some hundreds of bars, are put in order and folded, which gives each chunk the state that it begins with; then every
chunk is finished by itself. A series may have one row a day at most, so a chunk holds `days` rows at most. Rows without a date or
without a key belong to no series and go.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAYS = 512
#: Rows of a block in which rolling frames are evaluated.
BLOCK = 2048


def chunk_of(date: Column, days: int = DAYS) -> Column:
    return F.floor(F.unix_date(F.to_date(date)) / days).cast("long")


def struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in fields.items()) + ")"


def let(name: str, value: str, then: str) -> str:
    """The expression `then`, in which a name stands for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def carried(chunks: DataFrame, keys: list[str], init: str, step: Callable[[str, str], str], kind: str) -> DataFrame:
    """keys, _chunk and _carry: the state with which each chunk begins. chunks has keys, _chunk and a struct _sum; `kind` is
    the type of a state, `step` gives the SQL of the state after a chunk from that of the state and of _sum. Only the rows
    of chunks meet here."""
    ordered = F.sort_array(F.collect_list(F.struct("_chunk", "_sum"))).alias("_all")
    zero = struct({"now": f"CAST({init} AS {kind})", "out": f"CAST(array() AS array<struct<_chunk: bigint, _carry: {kind}>>)"})
    out = "array_append(acc.out, named_struct('_chunk', c._chunk, '_carry', acc.now))"
    fold = f"aggregate(_all, {zero}, (acc, c) -> {let('then', step('acc.now', 'c._sum'), struct({'now': 'then', 'out': out}))}, acc -> acc.out)"
    rows = chunks.groupBy(*keys).agg(ordered).select(*keys, F.explode(F.expr(fold)).alias("_x"))
    return rows.select(*keys, "_x._chunk", "_x._carry")


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(carry, [*keys, "_chunk"])


def fill_forward(rows: DataFrame, columns: list[str], by: list[str], keys: tuple[str, ...] = (), days: int = DAYS) -> DataFrame:
    """rows with nulls of the columns replaced by the last value before, in the order of `by`, whose first column is a date."""
    keys, order = list(keys), F.struct(*by)
    rows = rows.withColumn("_chunk", chunk_of(F.col(by[0]), days))
    last = F.struct(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])
    kind = "struct<" + ", ".join(f"`{c}`: {rows.schema[c].dataType.simpleString()}" for c in columns) + ">"
    then = lambda now, s: struct({c: f"coalesce({s}.`{c}`, {now}.`{c}`)" for c in columns})
    ends = carried(rows.groupBy(*keys, "_chunk").agg(last.alias("_sum")), keys, struct(dict.fromkeys(columns, "NULL")), then, kind)
    w = W.partitionBy(*keys, "_chunk").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    out = _with_carry(rows, ends, keys)
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col("_carry")[c]) for c in columns}).drop("_chunk", "_carry")


def numbered(rows: DataFrame, by: str, keys: tuple[str, ...] = (), name: str = "_pos", days: int = DAYS) -> DataFrame:
    """rows with their place in the series, from 0."""
    keys = list(keys)
    rows = rows.withColumn("_chunk", chunk_of(F.col(by), days))
    counts = carried(rows.groupBy(*keys, "_chunk").agg(F.struct(F.count("*").alias("n")).alias("_sum")), keys, "0", lambda now, s: f"{now} + {s}.n", "bigint")
    n = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(by))
    return _with_carry(rows, counts, keys).withColumn(name, F.col("_carry") + n - 1).drop("_chunk", "_carry")


def in_blocks(rows: DataFrame, by: str, back: int, then: Callable[[DataFrame, WindowSpec], DataFrame], keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """then(rows, window) for frames that look at most `back` rows back: rows meet in blocks, each with the `back` rows
    before it, and a block gives out its own rows."""
    if back > block:
        raise ValueError("a frame may look back over one block at most")
    rows = numbered(rows, by, keys)
    own = F.floor(F.col("_pos") / block)
    blocks = F.when(F.pmod("_pos", F.lit(block)) >= block - back, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_block", F.explode(blocks))
    out = then(rows, W.partitionBy(*keys, "_block").orderBy("_pos"))
    return out.where(own == F.col("_block")).drop("_pos", "_block")


# --- exponential weights ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weighted:
    """An exponentially weighted mean, with decay q = 1 - alpha, of SQL over a row `r` and the one before it `p` (null for none).

    adjusted: the sum of q**k x over the sum of q**k, for the k-th row back. Otherwise e = x at first, then (1 - alpha) e +
    alpha x. A missing x leaves the value as it is but ages what came before it. Missing before `least` values.

    A run of rows is summed up in a struct. Adjusted: its rows and values, and both sums as from nothing. Otherwise: the
    first value and how many rows stand before it, the map y -> a y + b of what follows, and how much the last value aged.
    """

    of: str
    alpha: float
    adjusted: bool = False
    least: int = 0

    def __post_init__(self):
        if not 0 < 1 - self.alpha < 1:
            raise ValueError("the decay must lie between 0 and 1")

    @property
    def q(self) -> float:
        return 1 - self.alpha

    def so_far(self, x: Column, rn: Column, run: WindowSpec, before: WindowSpec, name: str) -> list[dict[str, Column]]:
        """Columns, in steps, that end in the struct `name` of the chunk's rows up to each one."""
        known = x.isNotNull()
        if self.adjusted:
            total = lambda v: F.coalesce(F.sum(v * F.pow(F.lit(self.q), -rn)).over(run) * F.pow(F.lit(self.q), rn), F.lit(0.0))
            return [{name: F.struct(rn.cast("long").alias("rows"), total(x).alias("num"), total(F.when(known, 1.0)).alias("den"), F.count(x).over(run).alias("n"))}]
        last = F.max(F.when(known, rn))
        past = F.pow(F.lit(self.q), rn - F.col(f"{name}_last"))
        return [
            {f"{name}_last": last.over(before)},
            {f"{name}_a": F.when(known, F.ln(past / (past + self.alpha))), f"{name}_b": F.when(known, self.alpha * x / (past + self.alpha))},
            {f"{name}_log": F.coalesce(F.sum(f"{name}_a").over(run), F.lit(0.0))},
            {name: F.struct(
                F.coalesce(F.min(F.when(known, rn)).over(run) - 1, rn).cast("long").alias("ahead"), F.first(x, ignorenulls=True).over(run).alias("first"), F.exp(f"{name}_log").alias("a"),
                (F.exp(f"{name}_log") * F.coalesce(F.sum(F.col(f"{name}_b") * F.exp(-F.col(f"{name}_log"))).over(run), F.lit(0.0))).alias("b"),
                F.pow(F.lit(self.q), rn - F.coalesce(last.over(run), rn)).alias("w"), F.count(x).over(run).alias("n"),
            )},
        ]

    @property
    def kind(self) -> str:
        return "struct<rows: bigint, num: double, den: double, n: bigint>" if self.adjusted else "struct<ahead: bigint, first: double, a: double, b: double, w: double, n: bigint>"

    def joined(self, old: str, new: str) -> str:
        """The struct of two runs in turn; old may be null."""
        q, a, n = f"{self.q!r}D", f"{self.alpha!r}D", f"{old}.n + {new}.n"
        if self.adjusted:
            made = {"rows": f"{old}.rows + {new}.rows", "num": f"{old}.num * pow({q}, {new}.rows) + {new}.num", "den": f"{old}.den * pow({q}, {new}.rows) + {new}.den", "n": n}
        else:
            past = f"({old}.w * pow({q}, {new}.ahead + 1))"
            pick = lambda none, first, both: f"CASE WHEN {new}.n = 0 THEN {none} WHEN {old}.n = 0 THEN {first} ELSE {both} END"
            made = {
                "ahead": f"CASE WHEN {old}.n = 0 THEN {old}.ahead + {new}.ahead ELSE {old}.ahead END", "first": f"coalesce({old}.first, {new}.first)",
                "a": pick(f"{old}.a", f"{new}.a", f"{new}.a * {past} / ({past} + {a}) * {old}.a"), "b": pick(f"{old}.b", f"{new}.b", f"{new}.a * ({past} * {old}.b + {a} * {new}.first) / ({past} + {a}) + {new}.b"),
                "w": pick(f"CASE WHEN {old}.n = 0 THEN 1D ELSE {old}.w * pow({q}, {new}.ahead) END", f"{new}.w", f"{new}.w"), "n": n,
            }
        return f"CASE WHEN {old} IS NULL THEN {new} ELSE {struct(made)} END"

    def value(self, run: str) -> Column:
        y = f"{run}.num / {run}.den" if self.adjusted else f"{run}.a * {run}.first + {run}.b"
        return F.expr(f"CASE WHEN {run}.n >= {max(self.least, 1)} THEN {y} END")


def weighted(rows: DataFrame, by: str, keys: tuple[str, ...], means: dict[str, Weighted], days: int = DAYS) -> DataFrame:
    """rows with a column for each of the means. Inside a chunk weights are powers of the decay, which must not run out of
    a double's range over its days."""
    if any(days * -math.log(m.q) > 690 for m in means.values()):
        raise ValueError("the decay is too strong for chunks of so many days")
    keys, columns = list(keys), [c for c in rows.columns if c not in keys]
    rows = rows.withColumn("_chunk", chunk_of(F.col(by), days))
    part = W.partitionBy(*keys, "_chunk").orderBy(by)
    run, before = part.rowsBetween(W.unboundedPreceding, 0), part.rowsBetween(W.unboundedPreceding, -1)
    chunks = W.partitionBy(*keys).orderBy("_chunk")
    if any(re.search(r"\bp\.", m.of) for m in means.values()):
        row = F.struct(*columns)
        ends = rows.groupBy(*keys, "_chunk").agg(F.max_by(row, by).alias("_last"))
        rows = rows.join(ends.select(*keys, "_chunk", F.lag("_last").over(chunks).alias("_ahead")), [*keys, "_chunk"])
        rows = rows.withColumn("_p", F.coalesce(F.lag(row).over(part), "_ahead")).drop("_ahead")
    of = {c: re.sub(r"\br\.", "", re.sub(r"\bp\.", "_p.", m.of)) for c, m in means.items()}
    rows = rows.withColumns({"_rn": F.row_number().over(part), **{f"_x_{c}": F.expr(e).cast("double") for c, e in of.items()}})
    steps = [m.so_far(F.col(f"_x_{c}"), F.col("_rn"), run, before, f"_s_{c}") for c, m in means.items()]
    for n in range(max(map(len, steps))):
        rows = rows.withColumns({k: v for s in steps if n < len(s) for k, v in s[n].items()})
    kept = [f"_s_{c}" for c in means]
    rows = rows.select(*keys, "_chunk", *columns, *kept)
    sums = rows.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*kept), by).alias("_sum"))
    kind = "struct<" + ", ".join(f"_s_{c}: {m.kind}" for c, m in means.items()) + ">"
    past = carried(sums, keys, "NULL", lambda now, s: struct({f"_s_{c}": m.joined(f"{now}._s_{c}", f"{s}._s_{c}") for c, m in means.items()}), kind)
    rows = rows.join(past, [*keys, "_chunk"]).withColumns({f"_s_{c}": F.expr(m.joined(f"_carry._s_{c}", f"_s_{c}")) for c, m in means.items()})
    return rows.select(*keys, *columns, *[m.value(f"_s_{c}").alias(c) for c, m in means.items()])
