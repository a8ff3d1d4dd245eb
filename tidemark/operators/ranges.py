"""Order-dependent work where one key may hold most rows: rows are dealt by key and order, states carried from range to range.

A window over a key puts all rows of the key in one task. Here rows are range-partitioned by (key, order), so a hot key
spreads over as many tasks as its share of the rows asks for. Each range is scanned by itself, as if nothing preceded it;
the state at its end (one row for each range) is folded over the ranges, and what a range lacks is added to its first key.
That takes an associative `combine`: counts, sums, the last value that isn't null, affine maps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..sources.durable import written

#: One batch; where a key's rows begin; the state to go on from (None: none yet). Gives the new columns.
Local = Callable[[pa.Table, np.ndarray, dict | None], dict]


@dataclass(frozen=True)
class State:
    """What a scan computes: running columns, how a batch gets them, how ranges combine, how what was carried is added, columns that only serve that."""

    fields: StructType
    local: Local
    combine: Callable[[dict, dict], dict]
    finish: Callable[[Callable[[str], Column]], dict[str, Column]]
    hidden: tuple[str, ...] = ()


def last_seen(valid: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row the position of the last valid row of its key up to it, -1 if there is none in this batch."""
    at = np.maximum.accumulate(np.where(valid, np.arange(len(valid)), -1)) if len(valid) else np.zeros(0, int)
    return np.where(at >= run_start(starts), at, -1)


def run_start(starts: np.ndarray) -> np.ndarray:
    """For each row the position where its key's rows begin in this batch."""
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0)) if len(starts) else np.zeros(0, int)


def values(table: pa.Table, name: str) -> np.ndarray:
    """A column as numpy: whole numbers without nulls keep their type, doubles have NaN for null, others are objects."""
    return table.column(name).to_numpy()


def first_run(starts: np.ndarray) -> int:
    """Rows of a batch before its second key."""
    later = np.flatnonzero(starts[1:])
    return int(later[0]) + 1 if len(later) else len(starts)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row's key differs from the row's before it; the first row's entry is True."""
    out = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        out[1:] = False
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
            out[1:] |= codes[1:] != codes[:-1]
    return out


def scan(df: DataFrame, keys: list[str], order: list, *states: State, name: str = "ranges", ranges: int | None = None) -> DataFrame:
    """df with the columns of the states, each a running value of its key in the given order; one pass serves them all.

    `local` computes them over a batch (rows in order, several keys); it is given the state of the row before, where the
    batch goes on with that row's key. `combine(a, b)` is the state after b's rows where a's came before. `finish(carried)`
    gives the expressions that add what was carried (null: nothing) to the columns of a range's first key.

    Rows with equal key and order come in any order; nulls of a key are a key, nulls of an order come first. The number of
    ranges is `spark.sql.shuffle.partitions` unless given. One exchange, one table in the shared folder, one row for each
    range on the driver. df is evaluated twice (once to choose the bounds), so let it be cheap or a table.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    fields = StructType([f for x in states for f in x.fields])
    state = [f.name for f in fields]
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id())
    marks = StructType([*dealt.schema.fields, *fields.fields, StructField("_head", BooleanType()), StructField("_tail", BooleanType())])

    def scanned(batches):
        held, head, before, key = None, True, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            starts = _changes(table, keys)
            first = tuple(table.column(k)[0].as_py() for k in keys)
            on = before is not None and first == key
            starts[0] = not on
            new = {c: v for x in states for c, v in x.local(table, starts, before if on else None).items()}
            heads = np.zeros(table.num_rows, bool)
            if head:
                cut = np.flatnonzero(starts[(0 if on else 1) :])
                stop = cut[0] + (0 if on else 1) if len(cut) else table.num_rows
                if on or before is None:
                    heads[:stop] = True
                head = heads.all()
            for f in fields:
                table = table.append_column(f.name, _as(new[f.name], f))
            table = table.append_column("_head", pa.array(heads))
            before = {c: table.column(c)[-1].as_py() for c in state}
            key = tuple(table.column(k)[-1].as_py() for k in keys)
            if held is not None:
                yield from _marked(held, False)
            held = table
        if held is not None:
            yield from _marked(held, True)

    table = written(dealt.mapInArrow(scanned, marks), name)
    tails = sorted(table.filter("_tail").select("_range", "_head", *keys, *state).collect(), key=lambda r: r["_range"])
    carried, at, sofar = [], None, None
    for r, after in zip(tails, [*tails[1:], None], strict=False):
        k, own = tuple(r[c] for c in keys), {c: r[c] for c in state}
        sofar = {c: v for x in states for c, v in x.combine(sofar, own).items()} if r["_head"] and at == k and sofar is not None else own
        at = k
        if after is not None:
            carried.append((after["_range"], *k, *(sofar[c] for c in state)))
    schema = StructType([StructField("_to", IntegerType()), *(StructField(f"_k_{k}", df.schema[k].dataType) for k in keys), *(StructField(f"_c_{f.name}", f.dataType) for f in fields)])
    same = (F.col("_range") == F.col("_to")) & F.col("_head")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = table.join(F.broadcast(spark.createDataFrame(carried, schema)), same, "left")  # one row for each range
    done = {c: v for x in states for c, v in x.finish(lambda c: F.col(f"_c_{c}")).items()}
    hidden = {c for x in states for c in x.hidden}
    return out.select(*df.columns, *(done.get(c, F.col(c)).alias(c) for c in state if c not in hidden))


def _as(column, field: StructField) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column if isinstance(column, pa.Array) else pa.array(column, from_pandas=True)
    return column if pa.types.is_nested(column.type) else column.cast(to_arrow_type(field.dataType))  # taken from a column of the input as it is


def _marked(table: pa.Table, last: bool):
    tail = np.zeros(table.num_rows, bool)
    tail[-1] = last
    yield from table.append_column("_tail", pa.array(tail)).to_batches()


def last_where(schema: StructType, valid: str, what: dict[str, str], strictly: bool = False) -> State:
    """Values of the last row of the key at which a boolean column holds, the row itself included unless `strictly`.

    `what` gives {new column: its source in the schema}; new columns are null where no such row came yet.
    """
    seen, names = f"_{valid}_seen", list(what)
    held = {n: f"_held_{n}" for n in what}
    kind = {n: schema[c].dataType for n, c in what.items()}
    fields = StructType([StructField(seen, LongType()), *(StructField(held[n], kind[n]) for n in what), StructField(f"{seen}_before", LongType()), *(StructField(n, kind[n]) for n in what)])

    def local(table, starts, state):
        on = first_run(starts) if state and not starts[0] else 0
        at = last_seen(values(table, valid).astype(bool), starts)
        rest, rows = np.arange(len(at)) < on, np.arange(len(at))
        until = at if not strictly else np.where(starts | (rows == 0), -1, np.r_[-1, at[:-1]] if len(at) else at)
        out = {}
        for where, flag, new in ((at, seen, held), (until, f"{seen}_before", {n: n for n in names})):
            none = where < 0
            taken = pa.array(np.where(none, 0, where), mask=none)
            out[flag] = np.where(none, np.where(rest, state[seen], 0) if on else 0, 1)
            for n, column in new.items():
                got = table.column(what[n]).combine_chunks().take(taken)
                out[column] = pc.if_else(pa.array(none & rest), pa.scalar(state[held[n]], got.type), got) if on else got
        return out

    def combine(a, b):
        last = b if b[seen] else a
        return {c: last[c] for c in (seen, *held.values())} | {c: b[c] for c in (f"{seen}_before", *names)}

    def finish(c):
        return {n: F.when(F.col(f"{seen}_before") == 1, F.col(n)).otherwise(c(held[n])) for n in names}

    return State(fields, local, combine, finish, (seen, f"{seen}_before", *held.values()))


def lagged(schema: StructType, what: dict[str, str]) -> State:
    """Values of the row before in its key; `what` gives {new column: its source}. The first row of a key has nulls."""
    kind = {n: schema[c].dataType for n, c in what.items()}
    fields = StructType([StructField("_row", LongType()), *(f for n in what for f in (StructField(f"_own_{n}", kind[n]), StructField(n, kind[n])))])

    def local(table, starts, state):
        on = bool(state) and not starts[0]
        row = np.arange(len(starts)) - run_start(starts) + 1
        if on:
            row[: first_run(starts)] += state["_row"]
        out, before = {"_row": row}, np.arange(len(starts)) - 1
        taken = pa.array(np.maximum(before, 0), mask=starts | (before < 0))
        for n, c in what.items():
            own = table.column(c).combine_chunks()
            out[f"_own_{n}"], out[n] = own, own.take(taken)
            if on:
                out[n] = pa.concat_arrays([pa.array([state[f"_own_{n}"]], own.type), out[n][1:]])
        return out

    # Only the first row of a range lacks the row before it.
    combine = lambda a, b: {**b, "_row": a["_row"] + b["_row"]}
    finish = lambda c: {n: F.when(F.col("_row") == 1, c(f"_own_{n}")).otherwise(F.col(n)) for n in what}
    return State(fields, local, combine, finish, ("_row", *(f"_own_{n}" for n in what)))


def streak(schema: StructType, value: str, out: str = "streak") -> State:
    """The number of rows right before a row that have its value (0: another value, or null)."""
    fields = StructType([StructField(out, LongType()), StructField("_last", schema[value].dataType), StructField("_whole", LongType())])

    def local(table, starts, state):
        column = table.column(value).combine_chunks()
        same = np.zeros(len(starts), bool)
        if len(column) > 1:
            same[1:] = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        on = bool(state) and not starts[0]
        same &= ~starts
        if on:
            same[0] = column[0].as_py() is not None and column[0].as_py() == state["_last"]
        broken = np.maximum.accumulate(np.where(same, -1, np.arange(len(same)))) if len(same) else np.zeros(0, int)
        length = np.arange(len(same)) - broken
        whole = broken == run_start(starts)  # all rows of the run so far are alike
        if on:
            rest = np.arange(len(same)) < first_run(starts)
            going = rest & (broken < 0)
            length = np.where(going, np.arange(len(same)) + 1 + state[out], length)
            whole = np.where(rest, going & bool(state["_whole"]), whole)
        return {out: length, "_last": column, "_whole": whole.astype(np.int64)}

    def combine(a, b):
        alike = bool(b["_whole"]) and a["_last"] is not None and a["_last"] == b["_last"]
        return {out: b[out] + a[out] + 1 if alike else b[out], "_last": b["_last"], "_whole": a["_whole"] if alike else 0}

    def finish(c):
        return {out: F.col(out) + F.when((F.col("_whole") == 1) & (F.col("_last") == c("_last")), c(out) + 1).otherwise(0)}

    return State(fields, local, combine, finish, ("_last", "_whole"))


def decayed_means(alphas: dict[str, tuple[str, float]]) -> State:
    """Exponential means {new column: (source, alpha)} and, as new column + "_n", how many values each rests on.

    A mean is an affine map of the one before: m = (w m + alpha x) / (w + alpha), w = (1 - alpha) ^ rows since the last
    value; rows with a null leave it. A range starts with its first value as the mean and keeps the factor that the mean
    before it has in every row, so that what was carried is added by one multiplication: ranges are independent.
    """
    parts = [("", DoubleType()), ("_n", LongType()), ("_factor", DoubleType()), ("_first", DoubleType()), ("_lead", LongType()), ("_gap", LongType())]
    fields = StructType([StructField(f"{n}{p}", kind) for n in alphas for p, kind in parts])

    def local(table, starts, state):
        out = {}
        for n, (c, alpha) in alphas.items():
            rows, now = [], (None, 0, 1.0, None, 0, 0)
            if state and not starts[0]:
                now = tuple(state[f"{n}{p}"] for p, _ in parts)
            mean, seen, factor, first, lead, gap = now
            for x, start in zip(table.column(c).cast(pa.float64()).to_pylist(), starts.tolist(), strict=True):
                if start:
                    mean, seen, factor, first, lead, gap = None, 0, 1.0, None, 0, 0
                gap += 1
                if x is not None and x == x:
                    if seen:
                        w = (1 - alpha) ** gap
                        mean, factor = (w * mean + alpha * x) / (w + alpha), factor * w / (w + alpha)
                    else:
                        mean = first = x
                        lead = gap
                    seen, gap = seen + 1, 0
                rows.append((mean, seen, factor, first, lead, gap))
            out |= {f"{n}{p}": pa.array(v, to_arrow_type(kind)) for (p, kind), v in zip(parts, zip(*rows, strict=True), strict=True)}
        return out

    def combine(a, b):
        out = {}
        for n, (_, alpha) in alphas.items():
            (am, an, af, a1, al, ag), (bm, bn, bf, b1, bl, bg) = ([x[f"{n}{p}"] for p, _ in parts] for x in (a, b))
            if not bn:
                new = (am, an, af, a1, al, ag + bg)
            elif not an:
                new = (bm, bn, bf, b1, ag + bl, bg)
            else:
                w = (1 - alpha) ** (ag + bl)
                new = (bm + bf * (w * am + alpha * b1) / (w + alpha) - bf * b1, an + bn, af * w / (w + alpha) * bf, a1, al, bg)
            out |= {f"{n}{p}": v for (p, _), v in zip(parts, new, strict=True)}
        return out

    def finish(c):
        out = {}
        for n, (_, alpha) in alphas.items():
            w = F.pow(F.lit(1 - alpha), c(f"{n}_gap") + F.col(f"{n}_lead"))
            first = F.col(f"{n}_first")
            moved = F.col(n) + F.col(f"{n}_factor") * (w * (c(n) - first) / (w + alpha))
            out |= {n: F.when(F.coalesce(c(f"{n}_n"), F.lit(0)) == 0, F.col(n)).when(F.col(f"{n}_n") == 0, c(n)).otherwise(moved), f"{n}_n": F.col(f"{n}_n") + F.coalesce(c(f"{n}_n"), F.lit(0))}
        return out

    return State(fields, local, combine, finish, tuple(f"{n}{p}" for n in alphas for p, _ in parts[2:]))


def running_max(value: str, out: str) -> State:
    """The greatest value (a whole number) of the key up to the row, null as long as there is none."""

    def local(table, starts, state):
        x = table.column(value).combine_chunks()
        codes = np.where(x.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(x, 0).cast(pa.int64()).to_numpy(zero_copy_only=False), np.iinfo(np.int64).min)
        cuts = [*np.flatnonzero(starts | (np.arange(len(starts)) == 0)), len(starts)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            codes[a:b] = np.maximum.accumulate(codes[a:b])
            if i == 0 and state and not starts[0] and state[out] is not None:
                codes[a:b] = np.maximum(codes[a:b], state[out])
        return {out: pa.array(codes, mask=codes == np.iinfo(np.int64).min)}

    def combine(a, b):
        known = [x[out] for x in (a, b) if x[out] is not None]
        return {out: max(known) if known else None}

    return State(StructType([StructField(out, LongType())]), local, combine, lambda c: {out: F.greatest(out, c(out))})
