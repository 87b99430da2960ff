"""Lazy column expressions: what ``_.price * _.qty`` builds before any table is known."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any


class Node:
    """A part of an expression tree."""

    def children(self) -> Iterator[Node]:
        yield from ()


@dataclass(frozen=True, eq=False)
class Root(Node):
    """The table (``_``) or the current column of an ``across`` (``Fx``)."""

    kind: str = "_"


@dataclass(frozen=True, eq=False)
class Attr(Node):
    obj: Node
    name: str

    def children(self) -> Iterator[Node]:
        yield self.obj


@dataclass(frozen=True, eq=False)
class Item(Node):
    obj: Node
    key: Any

    def children(self) -> Iterator[Node]:
        yield self.obj
        yield from nodes_in(self.key)


@dataclass(frozen=True, eq=False)
class Call(Node):
    """A method call on an expression."""

    func: Node
    args: tuple
    kwargs: dict

    def children(self) -> Iterator[Node]:
        yield self.func
        yield from nodes_in((self.args, self.kwargs))


@dataclass(frozen=True, eq=False)
class Op(Node):
    """An operator by its registry name, such as ``__add__``."""

    name: str
    args: tuple

    def children(self) -> Iterator[Node]:
        yield from nodes_in(self.args)


@dataclass(frozen=True, eq=False)
class Func(Node):
    """A column function applied to expressions."""

    fn: Any
    args: tuple
    kwargs: dict

    def children(self) -> Iterator[Node]:
        yield from nodes_in((self.args, self.kwargs))


@dataclass(frozen=True, eq=False)
class Cases(Node):
    cases: tuple

    def children(self) -> Iterator[Node]:
        yield from nodes_in(self.cases)


@dataclass(frozen=True, eq=False)
class Raw(Node):
    """A column written in SQL."""

    text: str


def nodes_in(x: Any) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
    elif isinstance(x, Symbolic):
        yield node_of(x)
    elif isinstance(x, slice):
        yield from nodes_in((x.start, x.stop, x.step))
    elif isinstance(x, dict):
        yield from nodes_in(tuple(x.values()))
    elif isinstance(x, (tuple, list)):
        for y in x:
            yield from nodes_in(y)


#: Python's binary operators by their registry name.
BINARY = ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "and", "or", "xor", "eq", "ne", "lt", "le", "gt", "ge")
REFLECTED = ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "and", "or", "xor")


class Symbolic:
    """What users handle: every attribute, index, call and operator extends the tree."""

    __slots__ = ("_verbena_node",)

    def __init__(self, node: Node | None = None):
        object.__setattr__(self, "_verbena_node", node or Root())

    def __getattr__(self, name: str) -> Symbolic:
        if name.startswith("__") and name not in OPERATOR_METHODS or name.startswith(("_repr_", "_ipython", "_verbena")):
            raise AttributeError(name)
        return Symbolic(Attr(node_of(self), name))

    def __getitem__(self, key: Any) -> Symbolic:
        return Symbolic(Item(node_of(self), key))

    def __call__(self, *args: Any, **kwargs: Any) -> Symbolic:
        return Symbolic(Call(node_of(self), args, kwargs))

    def __bool__(self) -> bool:
        raise TypeError("a lazy expression has no truth value: join conditions with & and |, in parentheses")

    def __iter__(self):
        raise TypeError("a lazy expression can't be iterated")

    def __neg__(self) -> Symbolic:
        return Symbolic(Op("__neg__", (node_of(self),)))

    def __pos__(self) -> Symbolic:
        return Symbolic(Op("__pos__", (node_of(self),)))

    def __invert__(self) -> Symbolic:
        node = node_of(self)
        if isinstance(node, Op) and node.name == "__invert__":
            return Symbolic(node.args[0])
        return Symbolic(Op("__invert__", (node,)))

    def __abs__(self) -> Symbolic:
        return Symbolic(Op("__abs__", (node_of(self),)))

    def __matmul__(self, other: Any) -> Symbolic:
        return Symbolic(Op("__matmul__", (node_of(self), other)))

    def __round__(self, n: int = 0) -> Symbolic:
        return Symbolic(Op("__round__", (node_of(self), n)))

    def __array_ufunc__(self, ufunc: Any, method: str, *inputs: Any, **kwargs: Any) -> Symbolic:
        if method != "__call__" or kwargs:
            return NotImplemented
        return Symbolic(Op(f"numpy.{ufunc.__name__}", inputs))

    def __repr__(self) -> str:
        return show(node_of(self))

    __hash__ = object.__hash__


#: Operators that pandas users also call by their dunder names.
OPERATOR_METHODS = frozenset(f"__{x}__" for x in BINARY) | frozenset(f"__r{x}__" for x in REFLECTED) | {"__neg__", "__pos__", "__invert__", "__round__", "__abs__", "__matmul__", "__array__"}


def _binary(name: str, swap: bool) -> Callable:
    def method(self: Symbolic, other: Any) -> Symbolic:
        return Symbolic(Op(f"__{name}__", (other, node_of(self)) if swap else (node_of(self), other)))

    return method


for _name in BINARY:
    setattr(Symbolic, f"__{_name}__", _binary(_name, False))
for _name in REFLECTED:
    setattr(Symbolic, f"__r{_name}__", _binary(_name, True))


def node_of(x: Any) -> Any:
    """The tree of an expression; anything else as it is."""
    return object.__getattribute__(x, "_verbena_node") if isinstance(x, Symbolic) else x


def strip(x: Any) -> Any:
    """``x`` with the trees in place of all symbolic parts."""
    x = node_of(x)
    if isinstance(x, tuple):
        return tuple(map(strip, x))
    if isinstance(x, list):
        return [strip(y) for y in x]
    if isinstance(x, dict):
        return {k: strip(v) for k, v in x.items()}
    return x


def walk(x: Any) -> Iterator[Node]:
    for node in nodes_in(x):
        yield node
        for child in node.children():
            yield from walk(child)


def simple_name(x: Any) -> str | None:
    """The column that ``_.x``, ``_["x"]`` or ``"x"`` names, else None."""
    x = node_of(x)
    if isinstance(x, str):
        return x
    if isinstance(x, Attr) and isinstance(x.obj, Root):
        return x.name
    if isinstance(x, Item) and isinstance(x.obj, Root) and isinstance(x.key, str):
        return x.key
    return None


def columns_used(x: Any) -> set[str]:
    return {name for node in walk(x) if (name := simple_name(node)) is not None}


def show(x: Any) -> str:
    """One-line text of a tree."""
    x = node_of(x)
    match x:
        case Root():
            return x.kind
        case Attr():
            return f"{show(x.obj)}.{x.name}"
        case Item():
            return f"{show(x.obj)}[{show(x.key)}]"
        case Call() | Func():
            name = show(x.func) if isinstance(x, Call) else x.fn.__name__
            inner = [*map(show, x.args), *(f"{k}={show(v)}" for k, v in x.kwargs.items())]
            return f"{name}({', '.join(inner)})"
        case Op():
            return f"{x.name}({', '.join(map(show, x.args))})"
        case Cases():
            return "case_when(" + ", ".join(f"{show(a)}: {show(b)}" for a, b in x.cases) + ")"
        case Raw():
            return f"sql_raw({x.text!r})"
    return repr(x)


def explain(x: Any) -> None:
    """Print an expression's tree."""

    def lines(x: Any, depth: int) -> Iterator[str]:
        x = node_of(x)
        name = type(x).__name__ if isinstance(x, Node) else "value"
        detail = getattr(x, "name", None) or getattr(x, "kind", None) or ("" if isinstance(x, Node) else repr(x))
        yield "  " * depth + f"{name} {detail}".rstrip()
        if isinstance(x, Node):
            for child in x.children():
                yield from lines(child, depth + 1)

    print("\n".join(lines(x, 0)))


def sql_raw(text: str) -> Symbolic:
    """A column in SQL text."""
    return Symbolic(Raw(text))


_ = Symbolic()
Fx = Symbolic(Root("Fx"))
