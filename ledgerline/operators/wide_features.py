"""Customer features of very wide statement tables.

The same features as ``customer_features``, for tables with far more numeric columns than an aggregation's generated code carries.
Tasks reduce Arrow batches to one mergeable state per customer and column (count, sum, squared deviations, extremes, first
and last present value with their order keys); Spark shuffles these states by customer, and the categorical block,
aggregated by customer as well, meets them without another exchange. A customer whose rows follow each other leaves one state
per task however many rows it has, so no customer's rows gather anywhere.

NULL and NaN are missing. First and last need an integer order key (see ``Roles.order_key``). Whole numbers pass through
doubles, exact up to 2^53. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.literals import quoted
from ledgerline.operators.features import (
    CATEGORICAL_STATS, DATE_FEATURES, NUMERIC_STATS, TREND_STATS, categorical_aggregates, feature_names,
)
from ledgerline.roles import Roles

# rows of a state: seven doubles and two order keys (kept as their bits) per column, then three whole numbers for dates
FIELDS = ("n", "sum", "m2", "min", "max", "first", "last", "first_at", "last_at")
DATES = 3
_FAR = np.iinfo(np.int64).max


def state_of(columns: Sequence[np.ndarray], order: np.ndarray, dates: np.ndarray, dated: np.ndarray, code: np.ndarray, groups: int) -> np.ndarray:
    """One state row per group from rows in any order; ``order`` is ``_FAR`` where a row has no place."""
    by = np.lexsort((order, code))
    code, order = code[by], order[by]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    width = len(columns)
    out = np.empty((groups, len(FIELDS) * width + DATES))
    whole = out.view(np.int64)
    number, placed = np.arange(len(code)), order != _FAR
    for i, column in enumerate(columns):
        v = column[by]
        ok = ~np.isnan(v)
        n = np.add.reduceat(ok.astype(float), starts)
        total = np.add.reduceat(np.where(ok, v, 0.0), starts)
        apart = np.where(ok, v - (total / n)[code], 0.0)
        first = np.minimum.reduceat(np.where(ok & placed, number, len(code)), starts)
        last = np.maximum.reduceat(np.where(ok & placed, number, -1), starts)
        none = last < 0
        first[none] = last[none] = 0
        found = (n, total, np.add.reduceat(apart * apart, starts), np.fmin.reduceat(v, starts), np.fmax.reduceat(v, starts),
                 np.where(none, np.nan, v[first]), np.where(none, np.nan, v[last]))
        for k, x in enumerate(found):
            out[:, k * width + i] = x
        whole[:, 7 * width + i] = np.where(none, _FAR, order[first])
        whole[:, 8 * width + i] = np.where(none, -_FAR, order[last])
    d, ok = dates[by], dated[by]
    whole[:, -3] = np.add.reduceat(ok.astype(np.int64), starts)
    whole[:, -2] = np.minimum.reduceat(np.where(ok, d, _FAR), starts)
    whole[:, -1] = np.maximum.reduceat(np.where(ok, d, -_FAR), starts)
    return out


def merged(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """States of the same customers put together, row by row."""
    out = np.empty_like(a)
    cut = {f: slice(k * width, (k + 1) * width) for k, f in enumerate(FIELDS)}
    n, m = a[:, cut["n"]], b[:, cut["n"]]
    both = (n > 0) & (m > 0)
    step = np.divide(b[:, cut["sum"]], m, out=np.zeros_like(m), where=both) - np.divide(a[:, cut["sum"]], n, out=np.zeros_like(n), where=both)
    out[:, cut["n"]] = n + m
    out[:, cut["sum"]] = a[:, cut["sum"]] + b[:, cut["sum"]]
    out[:, cut["m2"]] = a[:, cut["m2"]] + b[:, cut["m2"]] + step * step * n * np.divide(m, n + m, out=np.zeros_like(m), where=both)
    out[:, cut["min"]] = np.fmin(a[:, cut["min"]], b[:, cut["min"]])
    out[:, cut["max"]] = np.fmax(a[:, cut["max"]], b[:, cut["max"]])
    x, y, z = (v.view(np.int64) for v in (a, b, out))
    for value, at, keep in (("first", "first_at", np.less_equal), ("last", "last_at", np.greater_equal)):
        mine = keep(x[:, cut[at]], y[:, cut[at]])
        out[:, cut[value]] = np.where(mine, a[:, cut[value]], b[:, cut[value]])
        z[:, cut[at]] = np.where(mine, x[:, cut[at]], y[:, cut[at]])
    z[:, -3] = x[:, -3] + y[:, -3]
    z[:, -2] = np.minimum(x[:, -2], y[:, -2])
    z[:, -1] = np.maximum(x[:, -1], y[:, -1])
    return out


def partial_states(df: DataFrame, roles: Roles, numeric: Sequence[str]) -> DataFrame:
    """key, state: one row per customer and batch, one per task for a customer that fills batches."""
    key_type = df.schema[roles.key].dataType
    width = len(numeric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the customer of the last row, which may go on

        def rows(keys: pa.Array, states: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array([s.tobytes() for s in states], pa.binary())], [roles.key, "state"])

        with np.errstate(all="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                coded = batch.column(0).dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)
                order = batch.column(1).fill_null(_FAR).to_numpy()
                dated = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
                columns = [batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(width)]
                states = state_of(columns, order, batch.column(2).fill_null(0).to_numpy(), dated, code, len(coded.dictionary))
                last = int(code[-1])
                keys = coded.dictionary
                if held is not None:
                    # a key can only be told apart by its value here
                    at = keys.index(held[0]).as_py()
                    if at >= 0:
                        states[at] = merged(held[1], states[at : at + 1], width)[0]
                    else:
                        yield rows(pa.array([held[0]], keys.type), held[1])
                held = (keys[last], states[last : last + 1].copy())
                rest = np.flatnonzero(np.arange(len(keys)) != last)
                if len(rest):
                    yield rows(keys.take(pa.array(rest)), states[rest])
            if held is not None:
                yield rows(pa.array([held[0]], held[0].type), held[1])

    micros = F.unix_micros(F.col(roles.date).cast("timestamp"))
    read = df.select(roles.key, roles.order_key(df).alias("_ord"), micros.alias("_date"), *[F.col(quoted(c)).cast("double").alias(c) for c in numeric])
    if not isinstance(read.schema["_ord"].dataType, T.LongType):
        raise ValueError("the order of statements must fit one BIGINT; see Roles.order_key")
    schema = T.StructType([T.StructField(roles.key, key_type), T.StructField("state", T.BinaryType())])
    return read.mapInArrow(run, schema)


def features_of(states: np.ndarray, width: int, wanted: Sequence[tuple[str, int]]) -> list[pa.Array]:
    """The wanted (statistic, column) pairs, or (date feature, -1)."""
    f = {name: states[:, k * width : (k + 1) * width] for k, name in enumerate(FIELDS)}
    count, low, high = states.view(np.int64)[:, -DATES:].T
    made = {
        "mean": lambda i: np.divide(f["sum"][:, i], f["n"][:, i], out=np.full(len(states), np.nan), where=f["n"][:, i] > 0),
        "std": lambda i: np.sqrt(np.divide(f["m2"][:, i], f["n"][:, i] - 1, out=np.full(len(states), np.nan), where=f["n"][:, i] > 1)),
        "last_mean_diff": lambda i: f["last"][:, i] - made["mean"](i),
        "last_first_diff": lambda i: f["last"][:, i] - f["first"][:, i],
        "range": lambda i: f["max"][:, i] - f["min"][:, i],
    }
    out = []
    for name, i in wanted:
        if name == "statement_count":
            out.append(pa.array(np.ascontiguousarray(count)))
        elif name == "history_days":
            days = np.where(count > 0, (high - np.where(count > 0, low, 0)) // 86_400_000_000, 0)
            out.append(pa.array(days, mask=count == 0))
        else:
            x = made[name](i) if name in made else f[name][:, i]
            out.append(pa.array(np.ascontiguousarray(x), from_pandas=True))
    return out


def wide_features(df: DataFrame, roles: Roles, only: Sequence[str] | None = None) -> DataFrame:
    """All features of ``customer_features``, in the same columns and types; or ``only`` some, by name.

    Python code is opaque to column pruning, so what a model does not use is best left out here.
    """
    numeric, categorical = roles.numeric_columns(df), roles.categorical_columns(df)
    names = feature_names(numeric, categorical)
    if only is not None:
        chosen = set(only)
        names = [n for n in names if n in chosen]
        numeric = [c for c in numeric if any(f"{c}_{s}" in chosen for s in (*NUMERIC_STATS, *TREND_STATS))]
        categorical = [c for c in categorical if any(f"{c}_{s}" in chosen for s in CATEGORICAL_STATS)]
    # rows of many customers in turn would leave a state per customer and batch, each far wider than a row
    df = df.where(F.col(roles.key).isNotNull()).sortWithinPartitions(roles.key)
    states = partial_states(df, roles, numeric).groupBy(roles.key).agg(F.collect_list("state").alias("_states"))
    if categorical:
        states = states.join(categorical_aggregates(df, roles, categorical), roles.key, "left")
    carried = [c for c in states.columns if c != "_states"]
    width = len(numeric)
    by_name = {f"{c}_{s}": (s, i) for i, c in enumerate(numeric) for s in (*NUMERIC_STATS, *TREND_STATS)}
    by_name |= {d: (d, -1) for d in DATE_FEATURES}
    ours = [n for n in names if n in by_name]
    wanted = [by_name[n] for n in ours]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_states")
            for low in range(0, batch.num_rows, 1_000):
                part = lists.slice(low, 1_000)
                sizes = part.value_lengths().to_numpy()
                if not len(sizes):
                    continue
                flat = np.frombuffer(b"".join(part.flatten().to_pylist()), np.float64).reshape(-1, len(FIELDS) * width + DATES)
                at = np.cumsum(sizes) - sizes
                whole = flat[at]
                with np.errstate(all="ignore"):
                    for k in range(1, int(sizes.max())):
                        more = np.flatnonzero(sizes > k)
                        whole[more] = merged(whole[more], flat[at[more] + k], width)
                    found = features_of(whole, width, wanted)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, 1_000) for c in carried), *found], [*carried, *ours])

    fields = [f for f in states.schema.fields if f.name != "_states"]
    fields += [T.StructField(c, T.LongType() if c in DATE_FEATURES else T.DoubleType()) for c in ours]
    made = states.mapInArrow(run, T.StructType(fields))
    # value features keep their column's type, as aggregates do
    narrow = {
        f"{c}_{s}": t for c, t in df.dtypes if c in set(numeric) and t != "double"
        for s in ("min", "max", "first", "last", "last_first_diff", "range")}
    return made.select(
        roles.key, *[F.col(quoted(c)).cast(narrow[c]).alias(c) if c in narrow else F.col(quoted(c)) for c in names])
