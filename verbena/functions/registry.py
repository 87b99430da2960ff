"""Every operation on a column by name: kind, and how it becomes Spark columns.

An implementation takes the context and the columns or plain values of its arguments. Kinds: ``elwise`` row by row,
``agg`` one value for a group, ``window`` a value for each row that depends on others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Table:
    def __repr__(self) -> str:
        return "_"


#: Stands for the table itself, as in ``n(_)``.
TABLE = _Table()


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str
    impl: Callable[..., Any]
    is_property: bool = False
    #: It uses its arguments several times: windows in them are staged, so that each is computed once.
    repeats: bool = False


OPS: dict[str, Spec] = {}


def lit(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def add(kind: str, names: str, impl: Callable[..., Any], is_property: bool = False, repeats: bool = False) -> None:
    for name in names.split():
        OPS[name] = Spec(name, kind, impl, is_property, repeats)


def elwise(names: str, is_property: bool = False) -> Callable:
    return lambda f: add("elwise", names, f, is_property) or f


def agg(names: str, is_property: bool = False) -> Callable:
    return lambda f: add("agg", names, f, is_property) or f


def window(names: str, is_property: bool = False) -> Callable:
    return lambda f: add("window", names, f, is_property) or f


def plain(x: Any, what: str, kind: type | tuple = str) -> Any:
    """An argument that must be a plain value."""
    if isinstance(x, bool) and kind is int or not isinstance(x, kind):
        raise TypeError(f"{what} must be a plain {kind.__name__ if isinstance(kind, type) else 'value'}")
    return x


# --- operators -----------------------------------------------------------------------------------

@elwise("__add__ add")
def _add(c, x, y):
    return F.concat(lit(x), lit(y)) if c.is_string(x) or c.is_string(y) else lit(x) + lit(y)


def divide(x: Any, y: Any) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN, never an error."""
    a, b = lit(x).cast("double"), lit(y).cast("double")
    if isinstance(y, (int, float)) and y:
        return a / b
    zero = F.when(a > 0, math.inf).when(a < 0, -math.inf).otherwise(math.nan)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(F.try_divide(a, b))


def integral(c: Any, *values: Any) -> bool:
    return all(isinstance(v, int) and not isinstance(v, bool) if not isinstance(v, Column) else is_integral(c.dtype(v)) for v in values)


def floor_div(c: Any, x: Any, y: Any) -> Column:
    """Python's floor division, exact for whole numbers; null for a zero divisor."""
    a, b = lit(x), lit(y)
    if not integral(c, x, y):
        return F.floor(F.try_divide(a, b))
    toward_zero = F.call_function("div", a, b)
    return F.when(b != 0, toward_zero - F.when((a % b != 0) & ((a < 0) != (b < 0)), 1).otherwise(0))


def modulo(c: Any, x: Any, y: Any) -> Column:
    """Python's modulo, with the sign of the divisor; null for a zero divisor."""
    a, b = lit(x), lit(y)
    if not integral(c, x, y):
        return a - b * floor_div(c, x, y)
    rest = a % b
    return F.when(b != 0, rest + F.when((rest != 0) & ((a < 0) != (b < 0)), b).otherwise(0))


def logical(both: Callable, bits: Callable) -> Callable:
    return lambda c, x, y: both(lit(x), lit(y)) if c.is_bool(x) or c.is_bool(y) else bits(lit(x), lit(y))


def flip(f: Callable) -> Callable:
    return lambda c, x, y: f(c, y, x)


_ARITHMETIC = {
    "__sub__ sub subtract": lambda c, x, y: lit(x) - lit(y),
    "__mul__ mul multiply": lambda c, x, y: lit(x) * lit(y),
    "__truediv__ truediv div divide": lambda c, x, y: divide(x, y),
    "__floordiv__ floordiv": lambda c, x, y: floor_div(c, x, y),
    "__mod__ mod": lambda c, x, y: modulo(c, x, y),
    "__pow__ pow": lambda c, x, y: F.pow(lit(x), lit(y)),
    "__and__": logical(lambda a, b: a & b, lambda a, b: a.bitwiseAND(b)),
    "__or__": logical(lambda a, b: a | b, lambda a, b: a.bitwiseOR(b)),
    "__xor__": logical(lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b)),
    "__eq__ eq": lambda c, x, y: lit(x) == lit(y),
    "__ne__ ne": lambda c, x, y: lit(x) != lit(y),
    "__lt__ lt": lambda c, x, y: lit(x) < lit(y),
    "__le__ le": lambda c, x, y: lit(x) <= lit(y),
    "__gt__ gt": lambda c, x, y: lit(x) > lit(y),
    "__ge__ ge": lambda c, x, y: lit(x) >= lit(y),
}
for _names, _impl in _ARITHMETIC.items():
    add("elwise", _names, _impl)
for _r, _of in {"__radd__ radd": "__add__", "__rsub__ rsub": "__sub__", "__rmul__ rmul": "__mul__", "__rtruediv__ rtruediv rdiv": "__truediv__", "__rfloordiv__ rfloordiv": "__floordiv__", "__rmod__ rmod": "__mod__", "__rpow__ rpow": "__pow__", "__rand__": "__and__", "__ror__": "__or__", "__rxor__": "__xor__"}.items():
    add("elwise", _r, flip(OPS[_of].impl))
add("elwise", "__invert__", lambda c, x: ~lit(x) if c.is_bool(x) else F.bitwise_not(lit(x)))
add("elwise", "__neg__", lambda c, x: -lit(x))
add("elwise", "__pos__", lambda c, x: lit(x))


def rounded(c: Any, x: Any, decimals: Any = 0) -> Column:
    """Half away from zero. A double is scaled, rounded to a whole number and scaled back, as in SQL and numpy; Spark's
    own ``round`` takes the shortest decimal that stands for it, which can be a tie where the double is below or above."""
    if not isinstance(x, Column) or not isinstance(decimals, int) or abs(decimals) > 300 or not isinstance(c.dtype(x), T.DoubleType):
        return F.round(lit(x), decimals)
    by = 10.0 ** abs(decimals)
    scaled = x * by if decimals >= 0 else x / by
    whole = F.when(F.abs(scaled - F.rint(scaled)) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(F.rint(scaled))
    return F.when(F.abs(scaled) < math.inf, whole / by if decimals >= 0 else whole * by).otherwise(x)  # no overflow; NaN stays


add("elwise", "__round__ round", rounded, repeats=True)

# --- row by row ----------------------------------------------------------------------------------

add("elwise", "abs __abs__", lambda c, x: F.abs(x))
add("elwise", "between", lambda c, x, left, right: lit(x).between(lit(left), lit(right)))
add("elwise", "isin", lambda c, x, values: lit(x).isin(*values) if values else F.when(lit(x).isNotNull(), False))
add("elwise", "copy", lambda c, x: x)
add("elwise", "combine_first fillna", lambda c, x, other: F.coalesce(lit(x), lit(other)))
add("elwise", "where", lambda c, x, cond, other=None: F.when(cond, lit(x)).otherwise(lit(other)))
add("elwise", "mask", lambda c, x, cond, other=None: F.when(cond, lit(other)).otherwise(lit(x)))
add("elwise", "isna isnull", lambda c, x: missing(c, x))
add("elwise", "notna notnull", lambda c, x: ~missing(c, x))


def missing(c: Any, x: Any) -> Column:
    """Null, and NaN in floats."""
    return lit(x).isNull() | F.isnan(lit(x)) if c.is_float(x) else lit(x).isNull()


@elwise("clip")
def _clip(c, x, lower=None, upper=None):
    out = lit(x)
    if lower is not None:
        out = F.greatest(out, lit(lower))
    if upper is not None:
        out = F.least(out, lit(upper))
    return F.when(lit(x).isNotNull(), out)


@elwise("replace")
def _replace(c, x, to_replace, value=None):
    if isinstance(to_replace, dict):
        out = None
        for k, v in to_replace.items():
            out = (F if out is None else out).when(lit(x) == lit(k), lit(v))
        return lit(x) if out is None else out.otherwise(lit(x))
    if isinstance(to_replace, list) and isinstance(value, list):
        if len(to_replace) != len(value):
            raise ValueError("replace needs as many values as it replaces")
        return _replace(c, x, dict(zip(to_replace, value, strict=True)))
    many = to_replace if isinstance(to_replace, list) else [to_replace]
    return F.when(lit(x).isin(*many), lit(value)).otherwise(lit(x))


#: Cast targets; others are refused.
CASTS = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}


@elwise("astype")
def _astype(c, x, dtype):
    name = dtype if isinstance(dtype, str) else getattr(dtype, "__name__", str(dtype))
    name = {"int64": "int", "float64": "float", "object": "str"}.get(name, name)
    if name not in CASTS:
        raise ValueError(f"astype to {name!r} is not supported; use one of {', '.join(CASTS)}")
    if name == "int" and c.is_float(x):
        return F.when(~F.isnan(lit(x)), lit(x)).cast("bigint")
    return lit(x).cast(CASTS[name])


item = Spec("item", "elwise", lambda c, x, key: F.get(lit(x), lit(key)) if isinstance(key, int) and key >= 0 else F.try_element_at(lit(x), lit(key)))

# --- aggregates ----------------------------------------------------------------------------------

def number(c: Any, x: Any) -> Column:
    """Booleans count as 0 and 1."""
    return lit(x).cast("int") if c.is_bool(x) else lit(x)


def simple(names: str, f: Callable[..., Column], as_number: bool = True) -> None:
    add("agg", names, lambda c, x, *a, **k: c.agg(f(number(c, x) if as_number else lit(x), *a, **k)))


simple("mean", F.avg)
simple("sum", F.sum)
simple("min", F.min, False)
simple("max", F.max, False)
simple("count", F.count, False)
simple("median", F.median)
simple("quantile", lambda x, q=0.5: F.percentile(x, F.lit(float(q))))
simple("prod product", F.product)
simple("all", F.bool_and, False)
simple("any", F.bool_or, False)
simple("mode", F.mode, False)
simple("first item bool", lambda x: F.first(x, ignorenulls=False), False)
simple("last", lambda x: F.last(x, ignorenulls=False), False)
add("agg", "corr", lambda c, x, y: c.agg(F.corr(lit(x), lit(y))))
add("agg", "cov", lambda c, x, y: c.agg(F.covar_samp(lit(x), lit(y))))
add("agg", "dot __matmul__", lambda c, x, y: c.agg(F.sum(lit(x) * lit(y))))
add("agg", "sem", lambda c, x: c.agg(F.stddev_samp(x)) / F.sqrt(c.agg(F.count(x))))
add("agg", "size", lambda c, x: c.agg(F.count(F.lit(1))), True)
add("agg", "empty", lambda c, x: c.agg(F.count(F.lit(1))) == 0, True)
add("agg", "hasnans", lambda c, x: c.agg(F.bool_or(missing(c, x))), True)
add("agg", "equals", lambda c, x, y: c.agg(F.bool_and(lit(x).eqNullSafe(lit(y)))))


@agg("var")
def _var(c, x, ddof=1):
    if ddof in (0, 1):
        return c.agg((F.var_samp if ddof else F.var_pop)(number(c, x)))
    n = c.agg(F.count(lit(x))).cast("double")
    return F.when(n > ddof, c.agg(F.var_pop(number(c, x))) * n / F.nullif(n - ddof, F.lit(0.0)))


add("agg", "std", lambda c, x, ddof=1: F.sqrt(_var(c, x, ddof)))


@agg("skew")
def _skew(c, x):
    n = c.agg(F.count(x)).cast("double")
    return F.when(n > 2, c.agg(F.skewness(x)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


@agg("kurt kurtosis")
def _kurt(c, x):
    n = c.agg(F.count(x)).cast("double")
    return F.when(n > 3, F.try_divide(((n + 1) * c.agg(F.kurtosis(x)) + 6) * (n - 1), (n - 2) * (n - 3)))


@agg("mad")
def _mad(c, x):
    return c.agg(F.avg(F.abs(lit(x) - c.stage(c.over_group(F.avg(x))))))


def distinct_count(c: Any, x: Any) -> Column:
    """Distinct values; on rows as the greatest dense rank, so no group's values are gathered in one array."""
    if c.aggregating or not c.groups:
        return c.agg(F.count_distinct(lit(x)))
    rank = c.stage(c.over_order(F.dense_rank(), own_order=[lit(x).asc_nulls_last()]))
    return F.coalesce(c.over_group(F.max(F.when(lit(x).isNotNull(), rank))), F.lit(0)).cast("bigint")


add("agg", "nunique", distinct_count)
add("agg", "is_unique", lambda c, x: distinct_count(c, x) + F.least(c.agg(F.count(F.lit(1))) - c.agg(F.count(lit(x))), F.lit(1)) == c.agg(F.count(F.lit(1))), True)


def place(c: Any) -> Column:
    """A row's 0-based place in arrange order."""
    return c.stage(c.over_order(F.row_number()) - 1)


def extreme_place(c: Any, x: Any, most: bool) -> Column:
    """The first place of the greatest or least value."""
    p = place(c)
    key = F.when(lit(x).isNotNull(), F.struct(lit(x).alias("x"), (-p if most else p).alias("p")))
    return c.agg((F.max_by if most else F.min_by)(p, key))


add("agg", "idxmax", lambda c, x: extreme_place(c, x, True))
add("agg", "idxmin", lambda c, x: extreme_place(c, x, False))


def edge_index(f: Callable) -> Callable:
    def impl(c, x):
        p = place(c)
        return c.agg(f(F.when(~missing(c, x), p)))

    return impl


add("agg", "first_valid_index", edge_index(F.min))
add("agg", "last_valid_index", edge_index(F.max))


def monotonic(grows: bool) -> Callable:
    def impl(c, x):
        before = c.stage(c.over_order(F.lag(lit(x), 1)))
        return c.agg(F.coalesce(F.bool_and(lit(x) >= before if grows else lit(x) <= before), F.lit(True)))

    return impl


add("agg", "is_monotonic is_monotonic_increasing", monotonic(True), True)
add("agg", "is_monotonic_decreasing", monotonic(False), True)
add("agg", "autocorr", lambda c, x, lag=1: c.agg(F.corr(lit(x), c.stage(c.over_order(F.lag(lit(x), lag))))))

# --- windows in arrange order ----------------------------------------------------------------------

UP_TO_HERE, FROM_HERE = (-(1 << 63), 0), (0, (1 << 63) - 1)


def running(names: str, f: Callable, as_number: bool = True) -> None:
    add("window", names, lambda c, x: c.over_order(f(number(c, x) if as_number else lit(x)), UP_TO_HERE))


running("cumsum", F.sum)
running("cumprod", F.product)
running("cummax", F.max, False)
running("cummin", F.min, False)


def shifted(c: Any, x: Any, n: int, fill: Any = None) -> Column:
    if n == 0:
        return lit(x)
    return c.over_order(F.lag(lit(x), n, fill) if n > 0 else F.lead(lit(x), -n, fill))


add("window", "shift", lambda c, x, periods=1, fill_value=None: shifted(c, x, periods, fill_value))
add("window", "pct_change", lambda c, x, periods=1: divide(x, shifted(c, x, periods)) - 1)
add("window", "ffill", lambda c, x: c.over_order(F.last(lit(x), ignorenulls=True), UP_TO_HERE))
add("window", "bfill", lambda c, x: c.over_order(F.first(lit(x), ignorenulls=True), FROM_HERE))


@window("duplicated")
def _duplicated(c, x, keep="first"):
    if keep not in ("first", "last", False):
        raise ValueError(f"duplicated: keep {keep!r}")
    if keep is False:
        return c.over_order(F.count(F.lit(1)), frame=(UP_TO_HERE[0], FROM_HERE[1]), partition=(lit(x),), own_order=by_value(x)) > 1
    if keep == "last" and not c.order:
        raise c.error("duplicated(keep='last') needs arrange()")
    order = [F.col(f"`{k.name}`").asc_nulls_first() if k.descending else F.col(f"`{k.name}`").desc_nulls_first() for k in c.order] if keep == "last" else None
    return c.over_order(F.row_number(), partition=(lit(x),), own_order=order) > 1


@window("diff")
def _diff(c, x, periods=1):
    if periods == 0:
        raise ValueError("diff needs periods other than 0")
    return lit(x) - shifted(c, x, periods)


@window("interpolate")
def _interpolate(c, x):
    """Linear between the neighbours that are there; after the last one its value."""
    p = place(c)
    known = F.when(~missing(c, x), p)
    before, after = c.over_order(F.last(known, True), UP_TO_HERE), c.over_order(F.first(known, True), FROM_HERE)
    low, high = c.over_order(F.last(lit(x), True), UP_TO_HERE), c.over_order(F.first(lit(x), True), FROM_HERE)
    return F.when(before == after, low).when(after.isNull(), low).otherwise(low + (high - low) * F.try_divide(p - before, after - before))


def by_value(x: Any, ascending: bool = True) -> list[Column]:
    return [lit(x).asc_nulls_last() if ascending else lit(x).desc_nulls_last()]


@window("rank")
def _rank(c, x, method="average", ascending=True, na_option="keep", pct=False):
    own = dict(partition=(lit(x).isNull(),), own_order=by_value(x, ascending))
    low = c.over_order(F.rank(), **own)
    same = c.over_order(F.count(F.lit(1)), frame=(-(1 << 63), (1 << 63) - 1), partition=(lit(x),), own_order=by_value(x))
    forms = {"average": low + (same - 1) / 2.0, "min": low.cast("double"), "max": (low + same - 1).cast("double"), "first": c.over_order(F.row_number(), **own).cast("double"), "dense": c.over_order(F.dense_rank(), **own).cast("double")}
    if method not in forms:
        raise ValueError(f"rank method {method!r}")
    out = forms[method]
    if pct:
        out = out / c.over_group(F.count(lit(x)))
    return F.when(lit(x).isNotNull(), out)


@window("factorize")
def _factorize(c, x):
    p = place(c)
    first = c.stage(c.over_order(F.min(p), frame=(-(1 << 63), (1 << 63) - 1), partition=(lit(x),), own_order=by_value(x)))
    code = c.over_order(F.dense_rank(), own_order=[F.when(lit(x).isNotNull(), first).asc_nulls_last()])
    return F.when(lit(x).isNotNull(), code - 1).otherwise(-1)


# --- what has no column form ------------------------------------------------------------------------

#: Names that exist for in-memory series only; each gives a translation error.
UNSUPPORTED: dict[str, str] = {}


def refuse(reason: str, names: str) -> None:
    UNSUPPORTED.update(dict.fromkeys(names.split(), reason))


refuse("it gives a tuple", "divmod rdivmod")
refuse("it was removed upstream", "compound tshift slice_shift get_values")
refuse("it works on row labels, which Spark rows don't have", "asfreq between_time asof at_time resample add_prefix add_suffix align at drop droplevel filter get iat iloc items iteritems loc pop reindex reindex_like rename rename_axis reset_index set_axis take truncate xs keys index sort_index swaplevel reorder_levels unstack")
refuse("it takes a Python function; use a column function or a verb", "agg aggregate apply ewm expanding groupby map pipe rolling transform combine")
refuse("it is a property of an object in memory", "T array attrs axes base data dtypes flags ftype ftypes itemsize put strides transpose values memory_usage nbytes view ravel squeeze swapaxes swaplevel argmax argmin argsort searchsorted __array__")
refuse("it changes rows; use a verb (bind_rows)", "append update")
refuse("it brings data to the driver; use collect()", "to_list to_numpy tolist to_clipboard to_dict to_excel to_hdf to_latex to_markdown to_msgpack to_pickle to_xarray to_dense to_string")
refuse("it writes; use write_table()", "to_csv to_json to_sql")
refuse("there are no periods", "to_period to_timestamp dt.qyear dt.to_period dt.to_timestamp dt.end_time dt.start_time")
refuse("it guesses types from data", "convert_dtypes infer_objects")
refuse("it gives several columns; use a verb", "str.extractall str.get_dummies str.partition str.rpartition dt.components to_frame")
refuse("it raises on rows without a match; use find", "str.index str.rindex")
refuse("Spark has no function for it", "str.wrap str.normalize dt.timetz")
refuse("it gives Python objects", "dt.to_pydatetime dt.to_pytimedelta")
refuse("it is index metadata", "dt.freq dt.tz")
refuse("there are no sparse columns", "sparse.density sparse.fill_value sparse.from_coo sparse.npoints sparse.sp_values sparse.to_coo sparse.to_dense")
for _name, _verb in {"describe": "summary", "nlargest": "top_n", "nsmallest": "top_n", "unique": "distinct", "value_counts": "count", "dropna": "drop_missing", "drop_duplicates": "distinct", "head": "head", "tail": "tail", "sample": "sample_rows", "explode": "unnest", "repeat": "repeat_rows", "sort_values": "arrange"}.items():
    refuse(f"it changes the number of rows; use the verb {_verb}()", _name)

add("elwise", "name", lambda c, x: F.lit(None), True)
add("elwise", "ndim", lambda c, x: F.lit(1), True)
add("elwise", "dtype", lambda c, x: F.lit(c.dtype(x).simpleString()), True)
add("agg", "shape", lambda c, x: F.array(c.agg(F.count(F.lit(1)))), True)

#: NumPy functions of one column.
NUMPY = {"sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log2": F.log2, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1, "absolute": F.abs, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "sign": F.signum, "cbrt": F.cbrt, "radians": F.radians, "degrees": F.degrees, "rint": F.rint, "isnan": F.isnan, "square": lambda x: x * x, "negative": lambda x: -x}
for _name, _f in NUMPY.items():
    add("elwise", f"numpy.{_name}", lambda c, x, f=_f: f(lit(x)))
for _name, _op in {"add": "__add__", "subtract": "__sub__", "multiply": "__mul__", "true_divide": "__truediv__", "divide": "__truediv__", "power": "__pow__", "maximum": None, "minimum": None}.items():
    if _op:
        OPS[f"numpy.{_name}"] = OPS[_op]
add("elwise", "numpy.maximum", lambda c, x, y: F.greatest(lit(x), lit(y)))
add("elwise", "numpy.minimum", lambda c, x, y: F.least(lit(x), lit(y)))


def find(name: str, context: Any) -> Spec:
    from verbena.functions import dates, strings  # noqa: F401  they fill the registry

    if name in OPS:
        return OPS[name]
    if name in UNSUPPORTED:
        raise context.error(f"{name}: {UNSUPPORTED[name]}")
    raise context.error(f"no operation named {name!r}")


# --- column functions ---------------------------------------------------------------------------------

class ColumnFunction:
    """A function over expressions, such as ``lead(_.x)``; its ``kind`` is as in the registry."""

    def __init__(self, impl: Callable[..., Any], kind: str):
        self.impl, self.kind = impl, kind
        self.__name__, self.__doc__ = impl.__name__.strip("_"), impl.__doc__
        self.is_property = False

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        from verbena.expr import Func, Symbolic, strip

        return Symbolic(Func(self, strip(args), strip(kwargs)))


def column_function(kind: str = "elwise") -> Callable[[Callable], ColumnFunction]:
    """Define a column function: it gets the context and columns or plain values, and returns a column."""
    if kind not in ("elwise", "agg", "window"):
        raise ValueError(f"kind {kind!r}")
    return lambda f: ColumnFunction(f, kind)


def regex_quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


# --- factors (levels in the column's metadata) ----------------------------------------------------------

def factor_levels(c: Any, x: Any) -> list:
    name = c.df.select(lit(x)).columns[0]
    field = c.df.select(lit(x)).schema[0]
    own = field.metadata.get("levels")
    if own is None:
        raise c.error(f"{name} has no levels; use a fct_ function first")
    return own


@elwise("cat.codes", True)
def _codes(c, x):
    at = F.array_position(F.array(*map(F.lit, factor_levels(c, x))), lit(x))
    return F.coalesce(at - 1, F.lit(-1))


add("elwise", "cat.categories", lambda c, x: F.array(*map(F.lit, factor_levels(c, x))), True)
add("elwise", "cat.ordered", lambda c, x: F.lit(bool(c.df.select(lit(x)).schema[0].metadata.get("ordered"))), True)


def releveled(x: Any, new: list, ordered: bool = False) -> Column:
    return F.when(lit(x).isin(*new), lit(x)).alias("x", metadata={"levels": list(new), "ordered": ordered})


add("elwise", "cat.as_ordered", lambda c, x: releveled(x, factor_levels(c, x), True))
add("elwise", "cat.as_unordered", lambda c, x: releveled(x, factor_levels(c, x)))
add("elwise", "cat.set_categories", lambda c, x, new: releveled(x, new))
add("elwise", "cat.reorder_categories", lambda c, x, new: releveled(x, new))
add("elwise", "cat.add_categories", lambda c, x, new: releveled(x, [*factor_levels(c, x), *([new] if isinstance(new, str) else new)]))
add("elwise", "cat.remove_categories", lambda c, x, gone: releveled(x, [v for v in factor_levels(c, x) if v not in ([gone] if isinstance(gone, str) else gone)]))


@elwise("cat.rename_categories")
def _rename_categories(c, x, new):
    own = factor_levels(c, x)
    pairs = new if isinstance(new, dict) else dict(zip(own, new, strict=True))
    out = None
    for k, v in pairs.items():
        out = (F if out is None else out).when(lit(x) == F.lit(k), F.lit(v))
    return out.otherwise(lit(x)).alias("x", metadata={"levels": list(dict.fromkeys(pairs.get(v, v) for v in own))})


@elwise("cat.remove_unused_categories")
def _remove_unused(c, x):
    own = factor_levels(c, x)
    seen = {r[0] for r in c.df.select(lit(x).alias("x")).filter(F.col("x").isin(*own)).distinct().collect()}  # a row for each level
    return releveled(x, [v for v in own if v in seen])
