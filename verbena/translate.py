"""From expression trees to columns: one rule for each kind of operation and kind of verb.

* row-level operations compose;
* aggregates become group aggregates in ``summarize`` and whole-group windows elsewhere;
* ranks and running functions become windows;
* a window or aggregate over something that holds a window is staged: the inner one becomes a hidden column first.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena import expr as E

HIDDEN = "__verbena_"
ACCESSORS = ("str", "dt", "cat", "sparse")


class TranslationError(NotImplementedError):
    """An expression that has no column form here; names the verb and argument."""


@dataclass
class Term:
    """A translated part: the column (or a plain value), and whether it holds windows or aggregates."""

    value: Any
    windowed: bool = False
    aggregated: bool = False
    #: Refers to single rows outside any aggregate.
    rows: bool = False

    @property
    def col(self) -> Column:
        return self.value if isinstance(self.value, Column) else F.lit(self.value)


@dataclass
class Key:
    """One ``arrange`` key: a column of the table."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        c = quoted(self.name)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]


_counter = iter(range(1, 1 << 62))


def hidden_name() -> str:
    return f"{HIDDEN}{next(_counter)}"


@dataclass
class Context:
    """Where an expression is translated; ``df`` gains hidden columns as parts are staged."""

    df: DataFrame
    groups: tuple[str, ...] = ()
    order: tuple[Key, ...] = ()
    aggregating: bool = False
    current: str | None = None  # the column of an across
    where: str = ""
    #: In ``summarize``: results named so far, which expressions can't use.
    siblings: tuple[str, ...] = ()
    used_windows: bool = field(default=False, init=False)
    #: Whole-table aggregates so far: the table they are over, the aggregates, and the table with them joined.
    pool: tuple[DataFrame, list[Column], DataFrame] | None = field(default=None, init=False)

    # --- building blocks for operations ---

    def stage(self, col: Column) -> Column:
        """``col`` as a hidden column."""
        name = hidden_name()
        self.df = self.df.withColumn(name, col)
        return F.col(name)

    def group_window(self) -> Any:
        return Window.partitionBy(*map(quoted, self.groups))

    def agg(self, col: Column) -> Column:
        """An aggregate as this verb needs it."""
        return col if self.aggregating else self.over_group(col)

    def over_group(self, col: Column) -> Column:
        """An aggregate on every row of its group. The whole table as a group is one aggregated row, joined back
        by broadcast, so no window ever gathers all rows in one task; all such aggregates over one table share the row."""
        if self.groups:
            self.used_windows = True
            return col.over(self.group_window())
        name = hidden_name()
        base, cols = (self.pool[0], self.pool[1]) if self.pool is not None and self.pool[2] is self.df else (self.df, [])
        cols = [*cols, col.alias(name)]
        try:
            one = base.agg(*cols)
        except AnalysisException:  # it uses an earlier aggregate: over the table that has it
            base, cols = self.df, cols[-1:]
            one = base.agg(*cols)
        self.df = base.join(F.broadcast(one))  # one row
        self.pool = (base, cols, self.df)
        return F.col(name)

    def over_order(self, col: Column, frame: tuple[int, int] | None = None, partition: tuple[Column, ...] = (), own_order: list[Column] | None = None) -> Column:
        """A window in ``arrange`` order, or in ``own_order``."""
        if own_order is None:
            if self.order:
                own_order = [k.column() for k in self.order]
            else:
                warnings.warn(f"{self.where or 'expression'}: the result depends on row order; use arrange() first", RuntimeWarning, stacklevel=2)
                own_order = [self.stage(F.monotonically_increasing_id())]
        w = Window.partitionBy(*map(quoted, self.groups), *partition).orderBy(*own_order)
        self.used_windows = True
        return col.over(w.rowsBetween(*frame) if frame else w)

    def dtype(self, x: Any) -> T.DataType:
        return self.df.select((x if isinstance(x, Column) else F.lit(x)).alias("x")).schema[0].dataType

    def is_string(self, x: Any) -> bool:
        return isinstance(x, str) if not isinstance(x, Column) else isinstance(self.dtype(x), T.StringType)

    def is_float(self, x: Any) -> bool:
        return isinstance(x, float) if not isinstance(x, Column) else isinstance(self.dtype(x), (T.DoubleType, T.FloatType))

    def is_bool(self, x: Any) -> bool:
        return isinstance(x, bool) if not isinstance(x, Column) else isinstance(self.dtype(x), T.BooleanType)

    # --- translation ---

    def error(self, text: str) -> TranslationError:
        return TranslationError(f"{self.where}: {text}" if self.where else text)

    def column(self, name: str) -> Term:
        if name not in self.df.columns:
            if name in self.siblings:
                raise self.error(f"{name!r} is a result of the same summarize; use a mutate after it")
            raise AttributeError(f"no column {name!r} in table; columns: {', '.join(visible(self.df))}" + (f" ({self.where})" if self.where else ""))
        return Term(quoted(name), rows=True)

    def term(self, x: Any) -> Term:
        from verbena.functions import registry

        x = E.node_of(x)
        if isinstance(x, Column):
            return Term(x, rows=True)
        if not isinstance(x, E.Node):
            if callable(x) and not isinstance(x, type):
                return self.term(x(E.Symbolic()))
            return Term(x)
        match x:
            case E.Root(kind="Fx"):
                if self.current is None:
                    raise self.error("Fx has a meaning only inside across()")
                return self.column(self.current)
            case E.Root():
                return Term(registry.TABLE)
            case E.Raw():
                return Term(F.expr(x.text), aggregated=self.aggregating, rows=not self.aggregating)  # in summarize Spark checks the text
            case E.Attr(obj=E.Root(kind="_"), name=name):
                return self.column(name)
            case E.Item(obj=E.Root(kind="_"), key=str(name)):
                return self.column(name)
            case E.Attr():
                return self.operation(*self.method(x), (), {}, property_only=True)
            case E.Call(func=E.Attr()):
                name, obj = self.method(x.func)
                return self.operation(name, obj, x.args, x.kwargs)
            case E.Op():
                return self.apply(registry.find(x.name, self), x.args, {})
            case E.Func():
                return self.apply(x.fn, x.args, x.kwargs)
            case E.Cases():
                return self.cases(x)
            case E.Item():
                return self.apply(registry.item, (x.obj, x.key), {})
        raise self.error(f"can't translate {E.show(x)}")

    def method(self, x: E.Attr) -> tuple[str, Any]:
        """The registry name and object of ``obj.name`` or ``obj.str.name``."""
        obj = x.obj
        if isinstance(obj, E.Attr) and obj.name in ACCESSORS and not (isinstance(obj.obj, E.Root) and obj.obj.kind == "_"):
            return f"{obj.name}.{x.name}", obj.obj
        return x.name, obj

    def operation(self, name: str, obj: Any, args: tuple, kwargs: dict, property_only: bool = False) -> Term:
        from verbena.functions import registry

        spec = registry.find(name, self)
        if property_only and not spec.is_property:
            raise self.error(f"{name} is a method; call it")
        return self.apply(spec, (obj, *args), kwargs)

    def value_of(self, t: Term, stage: bool) -> Any:
        if stage and t.windowed and isinstance(t.value, Column):
            return self.stage(t.value)
        return t.value

    def apply(self, spec: Any, args: tuple, kwargs: dict) -> Term:
        """Translate the arguments as the operation needs them, then the operation."""
        inner_rows = spec.kind in ("agg", "window")
        was = self.aggregating
        if spec.kind == "window" and was:
            # illegal over groups as it is: computed on rows first; an aggregate around it will find it staged
            raise self.error(f"{getattr(spec, 'name', None) or spec.__name__} gives a value for each row; summarize needs an aggregate around it")
        if inner_rows:
            self.aggregating = False
        try:
            terms = [self.term(a) for a in args]
            named = {k: self.term(v) for k, v in kwargs.items()}
        finally:
            self.aggregating = was
        parts = [*terms, *named.values()]
        stage = inner_rows or getattr(spec, "repeats", False)
        values = [self.value_of(t, stage) for t in terms]
        keywords = {k: self.value_of(t, stage) for k, t in named.items()}
        before = self.df
        # an aggregate over the whole table is a joined column, not a window
        out = spec.impl(self, *values, **keywords)
        if spec.kind == "elwise":
            return Term(out, any(t.windowed for t in parts), any(t.aggregated for t in parts), any(t.rows for t in parts))
        if spec.kind == "agg" and self.aggregating:
            return Term(out, aggregated=True)
        if spec.kind == "agg" and not self.groups and before is not self.df:
            return Term(out, rows=True)
        return Term(out, windowed=True, rows=True)

    def cases(self, x: E.Cases) -> Term:
        terms = [(self.term(a), self.term(b)) for a, b in x.cases]
        values = [b for _, b in terms]
        kind = self.common_type([b.value for b in values if b.value is not None])
        out = None
        for a, b in terms:
            value = b.col if kind is None or b.value is None else b.col.cast(kind)
            if a.value is True:
                out = out.otherwise(value) if out is not None else value
                break
            out = F.when(a.col, value) if out is None else out.when(a.col, value)
        parts = [t for pair in terms for t in pair]
        return Term(F.lit(None) if out is None else out, any(t.windowed for t in parts), any(t.aggregated for t in parts), any(t.rows for t in parts))

    def common_type(self, values: list) -> T.DataType | None:
        """The one type for all branches: ANSI mode would fail on a mix of numbers and strings."""
        kinds = [self.dtype(v) for v in values]
        if len({k.simpleString() for k in kinds}) < 2:
            return None
        if all(isinstance(k, T.NumericType) for k in kinds):
            return None
        return T.StringType()

    def expression(self, x: Any) -> Column:
        """The final column for a verb's argument."""
        from verbena.functions.registry import TABLE

        t = self.term(x)
        if t.value is TABLE:
            raise self.error("the table itself is no column")
        if self.aggregating and t.rows:
            raise self.error("summarize needs one value for each group; wrap the column in an aggregate")
        return t.col
