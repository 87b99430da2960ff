"""``across``: one or more functions over many columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from verbena import expr as E
from verbena.functions.registry import ColumnFunction
from verbena.tidyselect import select
from verbena.translate import Context


@dataclass
class Across:
    selection: Any
    functions: Any
    names: str | None = None

    def expand(self, df: Any) -> list[tuple[str, str, Any]]:
        """[(result name, source column, expression)], columns first."""
        if isinstance(self.functions, (list, tuple)):
            raise TypeError("across takes one function or a dict of functions, not a list")
        many = isinstance(self.functions, dict)
        functions = self.functions if many else {"fn": self.functions}
        template = self.names or ("{col}_{fn}" if many else "{col}")
        out = []
        for old, new in select(df, *(self.selection if isinstance(self.selection, (list, tuple)) else (self.selection,))):
            for name, f in functions.items():
                out.append((template.format(col=new, fn=name), old, self.body(f)))
        return out

    @staticmethod
    def body(f: Any) -> Any:
        if isinstance(f, E.Symbolic):
            return f
        if isinstance(f, ColumnFunction) or callable(f):
            return f(E.Symbolic(E.Root("Fx")))
        if isinstance(f, str):
            return E.Symbolic(E.Call(E.Attr(E.Root("Fx"), f), (), {}))
        raise TypeError(f"across can't apply {f!r}")


def across(cols: Any, fns: Any, names: str | None = None) -> Across:
    """Functions over the selected columns; results are named by ``names`` ({col}, {fn})."""
    return Across(cols, fns, names)


def named_expressions(df: Any, args: tuple, kwargs: dict) -> list[tuple[str, str | None, Any]]:
    """[(name, current column, expression)] of a verb's arguments; simple names as they are."""
    out: list[tuple[str, str | None, Any]] = []
    for a in args:
        if isinstance(a, Across):
            out += a.expand(df)
        else:
            name = E.simple_name(a)
            if name is None:
                raise ValueError(f"only simple columns and across() go without a name, not {E.show(a)}")
            out.append((name, None, a))
    for name, value in kwargs.items():
        if isinstance(value, Across):
            raise TypeError("across() goes without a name")
        out.append((name, None, value))
    return out


def translate_named(c: Context, current: str | None, x: Any) -> Any:
    c.current = current
    return c.expression(x)
