"""The lazy table: a DataFrame with grouping and arrange state, and the pipe."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from verbena import expr as E
from verbena.translate import Context, Key, quoted, visible


@dataclass(frozen=True, eq=False)
class Tbl:
    """An immutable query: the plan so far, the group columns and the order that running functions follow."""

    df: DataFrame
    group_by: tuple[str, ...] = ()
    order_by: tuple[Key, ...] = ()

    def __rshift__(self, other: Any) -> Any:
        return other.run(self) if isinstance(other, Pipe) else NotImplemented

    @property
    def columns(self) -> list[str]:
        return visible(self.df)

    def with_(self, df: DataFrame | None = None, **state: Any) -> Tbl:
        return replace(self, **({"df": df} if df is not None else {}), **state)

    def context(self, where: str, **more: Any) -> Context:
        return Context(self.df, self.group_by, self.order_by, where=where, **more)

    def settle(self, df: DataFrame, columns: list[str] | None = None, **state: Any) -> Tbl:
        """The table without hidden columns, but those that ``order_by`` needs."""
        order = state.get("order_by", self.order_by)
        keep = list(columns if columns is not None else visible(df))
        keep += [k.name for k in order if k.name not in keep and k.name in df.columns]
        if keep != df.columns:
            df = df.select(*map(quoted, keep))
        return self.with_(df, **state)

    def to_spark(self) -> DataFrame:
        """The plain DataFrame."""
        return self.df if len(self.columns) == len(self.df.columns) else self.df.select(*map(quoted, self.columns))

    def __repr__(self) -> str:
        head = self.to_spark().limit(5).toPandas()
        return ("(grouped data frame)\n" if self.group_by else "") + f"{head}"

    def _repr_html_(self) -> str:
        head = self.to_spark().limit(5).toPandas().to_html()
        return (f"<p>(grouped by {', '.join(self.group_by)})</p>" if self.group_by else "") + head


class Pipe:
    """Steps without data yet: ``data >> pipe`` runs them, ``pipe >> pipe`` joins them."""

    def __init__(self, *steps: Callable[[Any], Any]):
        self.steps = steps

    def run(self, data: Any) -> Any:
        for step in self.steps:
            data = step(data)
        return data

    def __rshift__(self, other: Any) -> Pipe:
        return Pipe(*self.steps, *other.steps) if isinstance(other, Pipe) else NotImplemented

    def __rrshift__(self, data: Any) -> Any:
        return self.run(data)

    def __call__(self, data: Any) -> Any:
        return self.run(data)


def as_tbl(data: Any) -> Tbl:
    if isinstance(data, Tbl):
        return data
    if isinstance(data, DataFrame):
        return Tbl(data)
    raise TypeError(f"no verb for {type(data).__name__}; give a Tbl or a Spark DataFrame")


def verb(f: Callable) -> Callable:
    """Define a verb: with a table first it runs at once, else it makes a pipe step."""

    @functools.wraps(f)
    def call(*args: Any, **kwargs: Any) -> Any:
        if args and isinstance(args[0], (Tbl, DataFrame)):
            return f(as_tbl(args[0]), *args[1:], **kwargs)
        if args and type(args[0]).__module__.startswith("pandas"):
            raise TypeError("verbs take Spark tables; use spark.createDataFrame first")
        if args and isinstance(args[0], E.Symbolic) and isinstance(E.node_of(args[0]), E.Root):
            args = args[1:]
        return Pipe(lambda data: f(as_tbl(data), *args, **kwargs))

    call.verb = f
    return call


def two_table_verb(f: Callable) -> Callable:
    """A verb of two tables: with both first it runs at once; with one, or ``_`` in the first's place, it makes a step."""
    one = verb(f)

    @functools.wraps(f)
    def call(*args: Any, **kwargs: Any) -> Any:
        tables = [isinstance(a, (Tbl, DataFrame)) for a in args[:2]]
        if tables[:1] == [True] and tables != [True, True] and "right" not in kwargs:
            return Pipe(lambda data: f(as_tbl(data), *args, **kwargs))
        return one(*args, **kwargs)

    return call


def pipe(data: Any, *funcs: Callable) -> Any:
    """Run ``data`` through functions and steps; without data, a pipe."""
    if isinstance(data, (Tbl, DataFrame)):
        return Pipe(*funcs).run(data)
    return Pipe(data, *funcs)


def call(func: Callable, *args: Any, **kwargs: Any) -> Pipe:
    """Any function as a step; ``_`` among its arguments stands for the data, which else comes first."""

    def is_data(x: Any) -> bool:
        return isinstance(x, E.Symbolic) and isinstance(E.node_of(x), E.Root)

    def step(data: Any) -> Any:
        if any(map(is_data, (*args, *kwargs.values()))):
            return func(*[data if is_data(a) else a for a in args], **{k: data if is_data(v) else v for k, v in kwargs.items()})
        return func(data, *args, **kwargs)

    return Pipe(step)


def tbl(source: Any, name: Any = None, columns: list[str] | None = None) -> Tbl:
    """A lazy table: of a DataFrame, or of a session and a table name, a path or a pandas frame."""
    if isinstance(source, (Tbl, DataFrame)):
        return as_tbl(source)
    if isinstance(source, SparkSession):
        if isinstance(name, str):
            df = source.read.parquet(name) if "/" in name else source.table(name)
        elif name is not None and type(name).__module__.startswith("pandas"):
            df = source.createDataFrame(name)
        else:
            raise NotImplementedError("tbl(spark, ...) takes a table name, a path or a pandas frame")
        return Tbl(df.select(*columns) if columns else df)
    raise NotImplementedError(f"no table of {type(source).__name__}")
