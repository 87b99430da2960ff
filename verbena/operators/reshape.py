"""Long and wide forms, nesting, completion and splitting of columns.

Verbs whose result columns depend on data (``spread``, ``pivot_wider``, ``separate(convert=True)``) run one small
aggregate for the names; all else is a lazy plan.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena import expr as E
from verbena.table import Tbl, verb
from verbena.tidyselect import select_names
from verbena.translate import hidden_name, quoted

#: Most distinct names that a wide form may have, as Spark's own pivot.
MAX_WIDE = 10_000


def common_type(df: DataFrame, names: list[str]) -> T.DataType:
    """One type for the values of several columns."""
    kinds = {f.dataType.simpleString(): f.dataType for f in df.schema if f.name in names}
    if len(kinds) == 1:
        return next(iter(kinds.values()))
    if all(isinstance(k, T.NumericType) for k in kinds.values()):
        whole = all(isinstance(k, T.IntegralType) for k in kinds.values())
        return T.LongType() if whole else T.DoubleType()
    return T.StringType()


@verb
def gather(t: Tbl, /, key: str = "key", value: str = "value", *args: Any, drop_na: bool = False, convert: bool = False) -> Tbl:
    """Wide to long: the selected columns (all without any) as key and value."""
    if convert:
        raise NotImplementedError("gather: convert is not supported")
    names = select_names(t.df, *args) if args else t.columns
    if not names:
        return t
    ids = [c for c in t.columns if c not in names]
    kind = common_type(t.df, names)
    df = t.df.select(*map(quoted, ids), *[quoted(c).cast(kind).alias(c) for c in names]).unpivot([quoted(i) for i in ids], [quoted(c) for c in names], key, value)
    if drop_na:
        df = df.filter(quoted(value).isNotNull())
    return Tbl(df, tuple(g for g in t.group_by if g in ids))


def distinct_values(df: DataFrame, cols: list[str]) -> list[tuple]:
    """The distinct combinations in order, at most ``MAX_WIDE``."""
    grouped = df.select(*map(quoted, cols)).distinct().orderBy(*[quoted(c).asc_nulls_last() for c in cols])
    rows = grouped.limit(MAX_WIDE + 1).collect()
    if len(rows) > MAX_WIDE:
        raise ValueError(f"over {MAX_WIDE} distinct values for column names")
    return [tuple(r[c] for c in cols) for r in rows]


@verb
def spread(t: Tbl, /, key: Any, value: Any, fill: Any = None, reset_index: bool = True) -> Tbl:
    """Long to wide: a column for each key, in key order; repeated keys of one row raise at run time."""
    k, v = (select_names(t.df, x) for x in (key, value))
    if len(k) != 1 or len(v) != 1:
        raise ValueError("spread takes one key and one value column")
    k, v = k[0], v[0]
    ids = [c for c in t.columns if c not in (k, v)]
    names = [x[0] for x in distinct_values(t.df, [k]) if x[0] is not None]
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("spread: more than one value for a key in one row"))).otherwise(F.first(quoted(v)))
    cells = t.df.groupBy(*map(quoted, [*ids, k])).agg(once.alias(v))
    out = [F.first(F.when(quoted(k) == F.lit(x), quoted(v)), ignorenulls=True).alias(str(x)) for x in names]
    df = cells.groupBy(*map(quoted, ids)).agg(*out) if ids else cells.agg(*out)
    if fill is not None:
        df = df.select(*map(quoted, ids), *[F.coalesce(quoted(str(x)), F.lit(fill)).alias(str(x)) for x in names])
    return Tbl(df, tuple(g for g in t.group_by if g in ids))


@verb
def nest(t: Tbl, /, *args: Any, key: str = "data") -> Tbl:
    """The selected columns (without any: all but the groups) as an array of structs for each combination of the rest.
    A group's rows come together in one array, so each group must fit in memory."""
    names = select_names(t.df, *args) if args else [c for c in t.columns if c not in t.group_by]
    rest = [c for c in t.columns if c not in names]
    df = t.df.groupBy(*map(quoted, rest)).agg(F.collect_list(F.struct(*map(quoted, names))).alias(key))
    return Tbl(df)


@verb
def unnest(t: Tbl, /, key: Any = "data") -> Tbl:
    """A row for each element of an array; structs become columns. Empty arrays vanish."""
    name = E.simple_name(key)
    rest = [c for c in t.columns if c != name]
    kind = t.df.schema[name].dataType
    df = t.df.select(*map(quoted, rest), F.explode(quoted(name)).alias(name))
    if isinstance(kind.elementType, T.StructType):
        df = df.select(*map(quoted, rest), f"`{name}`.*")
    return Tbl(df, tuple(g for g in t.group_by if g in rest))


def expanded(t: Tbl, names: list[str]) -> DataFrame:
    """All combinations of the columns' distinct values, nulls too."""
    df = None
    for n in names:
        own = t.df.select(quoted(n)).distinct()
        df = own if df is None else df.crossJoin(own)  # the product of distinct values is what is asked for
    return df


@verb
def expand(t: Tbl, /, *args: Any, fill: Any = None) -> Tbl:
    """Every combination of the distinct values of the columns."""
    if fill is not None:
        raise NotImplementedError("expand: fill is not supported")
    return Tbl(expanded(t, select_names(t.df, *args)))


@verb
def complete(t: Tbl, /, *args: Any, fill: dict | None = None, explicit: bool = True) -> Tbl:
    """``expand`` with the present rows joined to it; ``fill`` replaces missing values (``explicit=False``: only in new rows)."""
    names = select_names(t.df, *args)
    mark = hidden_name()
    keys = {n: hidden_name() for n in names}
    grid = expanded(t, names).select(*[quoted(n).alias(h) for n, h in keys.items()])
    condition = None
    for n, h in keys.items():
        same = F.col(h).eqNullSafe(quoted(n))
        condition = same if condition is None else condition & same
    df = grid.join(t.to_spark().withColumn(mark, F.lit(True)), condition, "left")
    cols = [F.col(h).alias(n) for n, h in keys.items()]
    for c in (c for c in t.columns if c not in names):
        col = quoted(c)
        if fill and c in fill:
            col = F.coalesce(col, F.lit(fill[c])) if explicit else F.when(F.col(mark).isNull(), F.lit(fill[c])).otherwise(col)
        cols.append(col.alias(c))
    return Tbl(df.select(*cols))


def converted(df: DataFrame, names: list[str]) -> DataFrame:
    """String columns as numbers where all their values are numbers; one aggregate finds out."""
    tests = []
    for n in names:
        for kind in ("bigint", "double"):
            ok = quoted(n).try_cast(kind).isNotNull() | quoted(n).isNull()
            tests.append(F.bool_and(ok).alias(f"{n}:{kind}"))
    got = df.agg(*tests).first()
    cols = []
    for c in df.columns:
        kind = next((k for k in ("bigint", "double") if c in names and got[f"{c}:{k}"]), None)
        cols.append(quoted(c).try_cast(kind).alias(c) if kind else quoted(c))
    return df.select(*cols)


def placed(t: Tbl, source: str, made: dict[str, Column], remove: bool, keep_if_named: bool) -> DataFrame:
    """The table with the made columns (overwriting those of their name), and the source taken out."""
    names = [c for c in t.columns if not (remove and c == source and not (keep_if_named and source in made))]
    cols = [made[c].alias(c) if c in made else quoted(c) for c in names]
    return t.df.select(*cols, *[v.alias(k) for k, v in made.items() if k not in names])


@verb
def separate(t: Tbl, /, col: Any, into: list[str], sep: str | int = r"[^a-zA-Z0-9]", remove: bool = True, convert: bool = False, extra: str = "warn", fill: str = "warn") -> Tbl:
    """Split a string column at a regex (or a position) into several columns.

    ``extra``: surplus parts are dropped, or with ``merge`` stay in the last column. ``fill``: missing parts are null on the right,
    or with ``left`` on the left.
    """
    name = select_names(t.df, col)[0]
    n = len(into)
    if isinstance(sep, int):
        x = quoted(name)
        parts = F.array(F.substring(x, 1, sep), F.substring(x, sep + 1, 1 << 30)) if sep >= 0 else F.array(F.left(x, F.length(x) + sep), F.right(x, F.lit(-sep)))
    else:
        parts = F.split(quoted(name), sep, n if extra == "merge" else -1)
    if extra not in ("warn", "drop", "merge"):
        raise ValueError(f"extra {extra!r}")
    h = hidden_name()
    src = t.with_(t.df.withColumn(h, parts))
    if not isinstance(sep, int) and fill == "warn" and extra != "merge":
        most = src.df.agg(F.max(F.size(h))).first()[0]  # the reference's check of too few parts needs the data
        if most is not None and most < n:
            raise ValueError(f"separate: {n} columns asked for, at most {most} parts found")
    if fill == "left":
        made = {c: F.get(F.col(h), F.size(h) - n + i) for i, c in enumerate(into)}
        made = {c: F.when(F.size(h) - n + i >= 0, v) for i, (c, v) in enumerate(made.items())}
    else:
        made = {c: F.get(F.col(h), F.lit(i)) for i, c in enumerate(into)}
    df = placed(src.with_(src.df), name, {c: v for c, v in made.items() if c is not None}, remove, True)
    if convert:
        df = converted(df, [c for c in into if c is not None])
    return Tbl(df, t.group_by)


def java_regex(pattern: str) -> str:
    """Python's named groups in Java's form."""
    return pattern.replace("(?P<", "(?<")


@verb
def extract(t: Tbl, /, col: Any, into: list[str], regex: str = r"(\w+)", remove: bool = True, convert: bool = False, flags: int = 0) -> Tbl:
    """A column for each capture group; null where the regex does not match."""
    name = select_names(t.df, col)[0]
    if re.compile(regex).groups != len(into):
        raise ValueError(f"extract: {len(into)} columns but {re.compile(regex).groups} groups in the regex")
    pattern = ("(?i)" if flags & re.I else "") + java_regex(regex)
    x = quoted(name)
    made = {c: F.when(F.rlike(x, F.lit(pattern)), F.regexp_extract(x, pattern, i + 1)) for i, c in enumerate(into)}
    df = placed(t, name, made, remove and name not in into, False)
    if convert:
        df = converted(df, into)
    return Tbl(df, t.group_by)


@verb
def unite(t: Tbl, /, col: str, *args: Any, sep: str = "_", remove: bool = True) -> Tbl:
    """Join columns to one string; null if one is null."""
    target = E.simple_name(col)
    names = [E.simple_name(a) for a in args]
    lost = [n for n in names if n not in t.columns]
    if lost:
        raise ValueError(f"no columns {', '.join(map(str, lost))}")
    if target in t.columns and target not in names:
        raise ValueError(f"column {target!r} exists")
    parts: list[Column] = []
    for n in names:
        parts += [F.lit(sep), quoted(n).cast("string")] if parts else [quoted(n).cast("string")]
    out: list[Column] = []
    for c in t.columns:
        if c == names[0]:
            out.append(F.concat(*parts).alias(target))
            if remove:
                continue
        if c in names and remove or c == target:
            continue
        out.append(quoted(c))
    return Tbl(t.df.select(*out), tuple(g for g in t.group_by if not (remove and g in names)))


# --- names ---------------------------------------------------------------------------------------

def vec_as_names(names: list[str], repair: str | Callable = "check_unique") -> list[str]:
    """Repair column names: ``unique`` adds ``___place`` to repeats, ``check_unique`` refuses them, or any function."""
    if callable(repair):
        return list(repair(names))
    repeats = {n for n in names if names.count(n) > 1}
    if repair in ("check_unique", "minimal"):  # Spark can't use columns that share a name
        if repeats:
            raise ValueError(f"names must be unique: {', '.join(sorted(repeats))}")
        return names
    if repair == "unique":
        return [f"{n}___{i}" if n in repeats or not n else n for i, n in enumerate(names)]
    raise ValueError(f"names_repair {repair!r}")


# --- pivot_longer ----------------------------------------------------------------------------------

def build_longer_spec(data: Any, *cols: Any, names_to: str | list[str] = "name", names_prefix: str | None = None, names_sep: str | None = None, names_pattern: str | None = None, names_ptypes: dict | None = None, names_transform: dict | None = None, values_to: str = "value") -> list[dict[str, str]]:
    """One row for each column: ``.name``, the value column ``.value``, and the parts of its name."""
    df = data.df if isinstance(data, Tbl) else data
    to = [names_to] if isinstance(names_to, str) else list(names_to)
    names = select_names(df, *cols)
    if names_sep is not None and names_pattern is not None:
        raise ValueError("give names_sep or names_pattern, not both")
    if len(to) > 1 and names_sep is None and names_pattern is None:
        raise ValueError("several names_to need names_sep or names_pattern")
    spec = []
    for n in names:
        part = re.sub(f"^(?:{names_prefix})", "", n) if names_prefix else n
        if names_sep is not None:
            parts = re.split(names_sep, part)
            if len(parts) != len(to):
                raise ValueError(f"{n!r} has {len(parts)} parts, names_to {len(to)}")
        elif names_pattern is not None:
            m = re.search(names_pattern, part)
            parts = list(m.groups()) if m else [None] * len(to)
            if len(parts) != len(to):
                raise ValueError(f"names_pattern has {len(parts)} groups, names_to {len(to)}")
        else:
            parts = [part]
        row = {".name": n, ".value": values_to}
        row.update({k: p for k, p in zip(to, parts, strict=True) if k is not None and k != "_"})
        for k, f in (names_transform or {}).items():
            row[k] = f(row[k])
        for k, kind in (names_ptypes or {}).items():
            row[k] = kind(row[k])
        spec.append(row)
    return spec


def pivot_longer_spec(data: Any, spec: list[dict[str, Any]], names_repair: str | Callable = "check_unique", values_drop_na: bool = False, values_ptypes: dict | None = None, values_transform: dict | None = None) -> Tbl:
    """Wide to long by a spec: one pass, an array of structs exploded; no union and no shuffle."""
    t = data if isinstance(data, Tbl) else Tbl(data)
    used = [r[".name"] for r in spec]
    ids = [c for c in t.columns if c not in used]
    values = list(dict.fromkeys(r[".value"] for r in spec))
    keys = [k for k in spec[0] if k not in (".name", ".value")] if spec else []
    rows: dict[tuple, dict[str, str]] = {}
    for r in spec:
        rows.setdefault(tuple(r[k] for k in keys), {})[r[".value"]] = r[".name"]
    kinds = {v: common_type(t.df, [r[".name"] for r in spec if r[".value"] == v]) for v in values}
    structs = []
    for key, cols in rows.items():
        parts = [F.lit(k).alias(f"k{i}") for i, k in enumerate(key)]
        for i, v in enumerate(values):
            x = quoted(cols[v]) if v in cols else F.lit(None)
            parts.append(x.cast(kinds[v]).alias(f"v{i}"))
        structs.append(F.struct(*parts))
    h = hidden_name()
    df = t.df.select(*map(quoted, ids), F.explode(F.array(*structs)).alias(h))
    made = []
    for i, v in enumerate(values):
        x = F.col(f"{h}.v{i}")
        if values_transform and v in values_transform:
            x = values_transform[v](x)
        if values_ptypes and v in values_ptypes:
            x = x.cast(values_ptypes[v])
        made.append(x)
    names = vec_as_names([*ids, *keys, *values], names_repair)
    cols = [*map(quoted, ids), *[F.col(f"{h}.k{i}") for i in range(len(keys))], *made]
    df = df.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)])
    if values_drop_na:  # a row goes if all its values are missing
        some = F.lit(False)
        for n in names[len(ids) + len(keys) :]:
            some = some | quoted(n).isNotNull()
        df = df.filter(some)
    return Tbl(df, tuple(g for g in t.group_by if g in ids))


@verb
def pivot_longer(t: Tbl, /, *args: Any, names_to: str | list[str] = "name", names_prefix: str | None = None, names_sep: str | None = None, names_pattern: str | None = None, names_ptypes: dict | None = None, names_transform: dict | None = None, names_repair: str | Callable = "check_unique", values_to: str = "value", values_drop_na: bool = False, values_ptypes: dict | None = None, values_transform: dict | None = None) -> Tbl:
    """Wide to long; ``.value`` in ``names_to`` makes several value columns."""
    spec = build_longer_spec(t, *args, names_to=names_to, names_prefix=names_prefix, names_sep=names_sep, names_pattern=names_pattern, names_ptypes=names_ptypes, names_transform=names_transform, values_to=values_to)
    return pivot_longer_spec(t, spec, names_repair, values_drop_na, values_ptypes, values_transform)


# --- pivot_wider -----------------------------------------------------------------------------------

def build_wider_spec(data: Any, names_from: Any = "name", values_from: Any = "value", names_prefix: str = "", names_sep: str = "_", names_glue: str | None = None, names_sort: bool = False, names_vary: str = "fastest", names_expand: bool = False) -> list[dict[str, Any]]:
    """One row for each new column: ``.name``, the value column ``.value`` and the names' values.

    Names come in the order in which the table is arranged, else sorted (Spark rows have no first-seen order).
    """
    t = data if isinstance(data, Tbl) else Tbl(data)
    names, values = select_names(t.df, names_from), select_names(t.df, values_from)
    if names_expand:
        combos = list(itertools.product(*[[v[0] for v in distinct_values(t.df, [n])] for n in names]))
    elif t.order_by and not names_sort:
        # the least arrange place of each combination; only the distinct combinations are ordered
        first = [F.max(quoted(k.name)).alias(f"__o{i}") if k.descending else F.min(quoted(k.name)).alias(f"__o{i}") for i, k in enumerate(t.order_by)]
        best = t.df.groupBy(*map(quoted, names)).agg(*first)
        rows = best.orderBy(*[F.col(f"__o{i}").desc_nulls_last() if k.descending else F.col(f"__o{i}").asc_nulls_last() for i, k in enumerate(t.order_by)]).limit(MAX_WIDE + 1).collect()
        if len(rows) > MAX_WIDE:
            raise ValueError(f"over {MAX_WIDE} distinct values for column names")
        combos = [tuple(r[n] for n in names) for r in rows]
    else:
        combos = distinct_values(t.df, names)
    pairs = [(v, c) for v in values for c in combos] if names_vary == "fastest" else [(v, c) for c in combos for v in values]
    spec = []
    for v, c in pairs:
        parts = [str(x) for x in c]
        if names_glue:
            name = names_glue.format(**dict(zip(names, parts, strict=True)), **{".value": v, "_value": v})
        else:
            name = names_prefix + names_sep.join([v, *parts] if len(values) > 1 else parts)
        spec.append({".name": name, ".value": v, **dict(zip(names, c, strict=True))})
    return spec


#: Aggregates by name for ``values_fn``.
VALUE_FUNCTIONS: dict[str, Callable[[Column], Column]] = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "first": F.first, "list": F.collect_list, "median": F.median}


def value_function(fn: Any, value: str) -> Callable[[Column], Column]:
    fn = fn.get(value, "max") if isinstance(fn, dict) else fn
    if fn is None:
        fn = "max"
    if isinstance(fn, str):
        return VALUE_FUNCTIONS[fn]
    return fn


def pivot_wider_spec(data: Any, spec: list[dict[str, Any]], names_repair: str | Callable = "check_unique", id_cols: Any = None, id_expand: bool = False, values_fill: Any = None, values_fn: Any = None, unused_fn: Any = None) -> Tbl:
    """Long to wide by a spec: one conditional aggregate for each new column, one shuffle in all."""
    t = data if isinstance(data, Tbl) else Tbl(data)
    names = [k for k in spec[0] if k not in (".name", ".value")] if spec else []
    values = list(dict.fromkeys(r[".value"] for r in spec))
    others = [c for c in t.columns if c not in names and c not in values]
    ids = select_names(t.df, *(id_cols if isinstance(id_cols, (list, tuple)) else [id_cols])) if id_cols is not None else others
    repaired = vec_as_names([*ids, *[r[".name"] for r in spec]], names_repair)
    aggs: list[Column] = []
    for r, name in zip(spec, repaired[len(ids) :], strict=True):
        match = F.lit(True)
        for n in names:
            match = match & quoted(n).eqNullSafe(F.lit(r[n]))
        x = value_function(values_fn, r[".value"])(F.when(match, quoted(r[".value"])))
        fill = values_fill.get(r[".value"]) if isinstance(values_fill, dict) else values_fill
        if fill is not None:
            x = F.when(F.count(F.when(match, F.lit(1))) == 0, F.lit(fill)).otherwise(x)
        aggs.append(x.alias(name))
    unused = []
    if unused_fn is not None:
        for c in (c for c in others if c not in ids):
            aggs.append(value_function(unused_fn, c)(quoted(c)).alias(c))
            unused.append(c)
    df = t.df.groupBy(*map(quoted, ids)).agg(*aggs) if ids else t.df.agg(*aggs)
    if id_expand and ids:
        grid = {i: hidden_name() for i in ids}
        all_ids = expanded(t, ids).select(*[quoted(i).alias(h) for i, h in grid.items()])
        same = None
        for i, h in grid.items():
            s = F.col(h).eqNullSafe(quoted(i))
            same = s if same is None else same & s
        wide = all_ids.join(df, same, "left")
        fills = {n: (values_fill.get(r[".value"]) if isinstance(values_fill, dict) else values_fill) for r, n in zip(spec, repaired[len(ids) :], strict=True)}
        df = wide.select(*[F.col(h).alias(i) for i, h in grid.items()], *[(F.coalesce(quoted(c), F.lit(fills[c])) if fills.get(c) is not None else quoted(c)).alias(c) for c in [*repaired[len(ids) :], *unused]])
    return Tbl(df, tuple(g for g in t.group_by if g in ids))


@verb
def pivot_wider(t: Tbl, /, id_cols: Any = None, id_expand: bool = False, names_from: Any = "name", names_prefix: str = "", names_sep: str = "_", names_glue: str | None = None, names_sort: bool = False, names_vary: str = "fastest", names_expand: bool = False, names_repair: str | Callable = "check_unique", values_from: Any = "value", values_fill: Any = None, values_fn: Any = None, unused_fn: Any = None) -> Tbl:
    """Long to wide: a column for each combination of names and values; ``values_fn`` (default max) for repeats."""
    spec = build_wider_spec(t, names_from, values_from, names_prefix, names_sep, names_glue, names_sort, names_vary, names_expand)
    return pivot_wider_spec(t, spec, names_repair, id_cols, id_expand, values_fill, values_fn, unused_fn)
