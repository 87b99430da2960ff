"""Column selection: names, positions, ranges, negation, predicates and renames over a list of column names."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verbena import expr as E
from verbena.translate import visible

#: Name predicates, as on pandas' string accessor.
PREDICATES: dict[str, Callable[..., bool]] = {
    "startswith": lambda s, pat: s.startswith(pat),
    "endswith": lambda s, pat: s.endswith(pat),
    "contains": lambda s, pat, case=True, regex=True: bool(_search(s, pat, case, regex)),
    "match": lambda s, pat: bool(_search(s, f"^(?:{pat})", True, True)),
    "isupper": lambda s: s.isupper(),
    "islower": lambda s: s.islower(),
}


def _search(s: str, pat: str, case: bool, regex: bool) -> Any:
    import re

    return re.search(pat if regex else re.escape(pat), s, 0 if case else re.I)


class Where:
    """Columns whose type passes a test."""

    def __init__(self, test: Any):
        self.test = test

    def holds(self, kind: T.DataType) -> bool:
        if isinstance(self.test, str):
            return {"number": isinstance(kind, T.NumericType), "numeric": isinstance(kind, T.NumericType), "string": isinstance(kind, T.StringType), "bool": isinstance(kind, T.BooleanType), "datetime": isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))}.get(self.test, kind.simpleString() == self.test)
        out = self.test(kind)
        if not isinstance(out, bool):
            raise TypeError("where() needs a predicate that gives True or False")
        return out


def where(test: Any) -> Where:
    """Columns by type: a name such as ``"number"``, or a function of the Spark type."""
    return Where(test)


class Selection:
    """An ordered choice: old name to new name."""

    def __init__(self, df: DataFrame):
        self.df, self.names = df, visible(df)

    def place(self, x: Any) -> int:
        name = E.simple_name(x)
        if name is not None:
            if name not in self.names:
                raise KeyError(f"no column {name!r}; columns: {', '.join(self.names)}")
            return self.names.index(name)
        if isinstance(x, int) and not isinstance(x, bool):
            if not -len(self.names) <= x < len(self.names):
                raise IndexError(f"no column at {x}")
            return x % len(self.names)
        raise TypeError(f"can't select by {E.show(x)}")

    def span(self, s: slice) -> list[str]:
        """By name both ends are in; by position the end is out."""
        a = 0 if s.start is None else self.place(s.start)
        if s.stop is None:
            b = len(self.names)
        elif isinstance(E.node_of(s.stop), int):
            b = s.stop if s.stop >= 0 else len(self.names) + s.stop
        else:
            b = self.place(s.stop) + 1
        return self.names[a:b]

    def resolve(self, x: Any) -> tuple[list[tuple[str, str]], bool]:
        """([(old, new)], whether these are taken out)."""
        x = E.node_of(x)
        match x:
            case E.Op(name="__neg__" | "__invert__"):
                inner, out = self.resolve(x.args[0])
                return inner, not out
            case E.Op(name="__eq__"):
                new, old = E.simple_name(x.args[0]), x.args[1]
                if new is None:
                    raise ValueError(f"the new name in {E.show(x)} must be simple")
                return [(self.names[self.place(old)], new)], False
            case E.Op(name="__and__" | "__or__"):
                (a, na), (b, nb) = map(self.resolve, x.args)
                left, right = ({n for n in self.names if (n in {o for o, _ in p}) != inv} for p, inv in ((a, na), (b, nb)))
                both = left & right if x.name == "__and__" else left | right
                return [(n, n) for n in self.names if n in both], False
            case E.Call(func=E.Attr(obj=E.Root(), name=name)) if name in PREDICATES:
                return [(n, n) for n in self.names if PREDICATES[name](n, *x.args, **x.kwargs)], False
            case E.Item(obj=E.Root(), key=slice() as s):
                return [(n, n) for n in self.span(s)], False
            case E.Item(obj=E.Root(), key=tuple() | list() as keys):
                out: list[tuple[str, str]] = []
                for k in keys:
                    found = [(n, n) for n in self.span(k)] if isinstance(k, slice) else self.resolve(k)[0]
                    out += [f for f in found if f not in out]
                return out, False
            case E.Item(obj=E.Root(), key=int() as i):
                return [(self.names[self.place(i)],) * 2], False
            case Where():
                return [(f.name, f.name) for f in self.df.schema if f.name in self.names and x.holds(f.dataType)], False
            case slice():
                return [(n, n) for n in self.span(x)], False
            case list() | tuple():
                return [(n, m) for n, m in select(self.df, *x)], False
            case int() if not isinstance(x, bool):
                return [(self.names[self.place(x)],) * 2], False
        if callable(x) and not isinstance(x, E.Node):
            return [(n, n) for n in self.names if x(n)], False
        name = self.names[self.place(x)]
        return [(name, name)], False


def select(df: DataFrame, *args: Any) -> list[tuple[str, str]]:
    """[(old name, new name)] in order; a leading negation starts from all columns."""
    s = Selection(df)
    chosen: dict[str, str] = {}
    for i, arg in enumerate(args):
        found, out = s.resolve(arg)
        if out:
            if i == 0:
                chosen = {n: n for n in s.names}
            for old, _ in found:
                chosen.pop(old, None)
        else:
            for old, new in found:
                if old not in chosen or new != old:
                    chosen[old] = new
    return list(chosen.items())


def select_names(df: DataFrame, *args: Any) -> list[str]:
    return [old for old, _ in select(df, *args)]
