"""String operations (the ``.str`` accessor) and ``str_c``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbena.functions.registry import OPS, add, column_function, elwise, lit, plain, regex_quote

SPACE = " \t\n\x0b\x0c\r"


def each(names: str, f: Any) -> None:
    add("elwise", names, lambda c, x, *a, **k: f(lit(x), *a, **k))


each("str.lower", F.lower)
each("str.casefold", lambda x: F.replace(F.lower(x), F.lit("ß"), F.lit("ss")))
each("str.upper", F.upper)
each("str.len", F.length)
each("str.capitalize", lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30))))


def title(x: Column) -> Column:
    """Every run of letters with a capital first and small letters after."""
    runs = F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def swapcase(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, ""), lambda a: F.when(a == F.lower(a), F.upper(a)).otherwise(F.lower(a))), "")


#: Letters that have a case.
CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"

each("str.title", title)
each("str.swapcase", swapcase)
each("str.strip", lambda x, to_strip=SPACE: F.btrim(x, F.lit(to_strip)))
each("str.lstrip", lambda x, to_strip=SPACE: F.ltrim(x, F.lit(to_strip)))
each("str.rstrip", lambda x, to_strip=SPACE: F.rtrim(x, F.lit(to_strip)))
each("str.startswith", lambda x, pat: F.startswith(x, lit(pat)))
each("str.endswith", lambda x, pat: F.endswith(x, lit(pat)))
each("str.count", lambda x, pat: F.regexp_count(x, lit(pat)))
each("str.match", lambda x, pat, case=True: F.rlike(x, F.lit(("" if case else "(?i)") + f"^(?:{plain(pat, 'pat')})")))
each("str.fullmatch", lambda x, pat, case=True: F.rlike(x, F.lit(("" if case else "(?i)") + f"^(?:{plain(pat, 'pat')})$")))
each("str.find", lambda x, sub: F.instr(x, sub) - 1)
each("str.repeat", lambda x, repeats: F.repeat(x, lit(repeats)))
each("str.encode", lambda x, encoding: F.encode(x, encoding))
each("str.decode", lambda x, encoding: F.decode(x, encoding))
each("str.translate", lambda x, table: F.translate(x, "".join(map(chr, [k for k, v in table.items() if v is not None])) + "".join(chr(k) for k, v in table.items() if v is None), "".join(v if isinstance(v, str) else chr(v) for v in table.values() if v is not None)))
each("str.get", lambda x, i: F.get(x, lit(i)) if i >= 0 else F.try_element_at(x, lit(i)))
each("str.join", lambda x, sep: F.array_join(x, sep))
for _name, _pattern in {"isalnum": r"^[\p{L}\p{N}]+$", "isalpha": r"^\p{L}+$", "isdecimal": r"^\p{Nd}+$", "isdigit": r"^\p{Nd}+$", "isnumeric": r"^\p{N}+$", "isspace": r"^\s+$"}.items():
    each(f"str.{_name}", lambda x, p=_pattern: F.rlike(x, F.lit(p)))
each("str.islower", lambda x: (x == F.lower(x)) & F.rlike(x, F.lit(CASED)))
each("str.isupper", lambda x: (x == F.upper(x)) & F.rlike(x, F.lit(CASED)))
each("str.istitle", lambda x: (x == title(x)) & F.rlike(x, F.lit(CASED)))


@elwise("str.rfind")
def _rfind(c, x, sub):
    at = F.instr(F.reverse(lit(x)), plain(sub, "sub")[::-1])
    return F.when(at == 0, -1).otherwise(F.length(lit(x)) - at - len(sub) + 1)


@elwise("str.contains")
def _contains(c, x, pat, case=True, regex=True):
    if not regex and case:
        return F.contains(lit(x), lit(pat))
    if isinstance(pat, Column):
        return F.rlike(lit(x), pat)
    return F.rlike(lit(x), F.lit(("" if case else "(?i)") + (pat if regex else regex_quote(pat))))


@elwise("str.replace")
def _replace(c, x, pat, repl, n=-1, case=True, regex=True):
    if not regex:
        return F.replace(lit(x), lit(pat), lit(repl))
    return F.regexp_replace(lit(x), lit(pat if case else f"(?i){pat}"), lit(java_groups(repl) if isinstance(repl, str) else repl))


def java_groups(repl: str) -> str:
    r"""Python's ``\1`` and ``\g<name>`` as Java's ``$1`` and ``${name}``."""
    import re

    return re.sub(r"\\g<(\w+)>|\\(\d)", lambda m: f"${{{m[1]}}}" if m[1] else f"${m[2]}", repl.replace("$", r"\$"))


def padded(x: Column, width: int, side: str, fillchar: str = " ") -> Column:
    """Never shorter than ``x``."""
    lacks = F.greatest(F.lit(width) - F.length(x), F.lit(0))
    if side == "both":
        left = F.floor(lacks / 2) + F.when((lacks % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
    else:
        left = lacks if side == "left" else F.lit(0)
    left = left.cast("int")
    return F.concat(F.repeat(F.lit(fillchar), left), x, F.repeat(F.lit(fillchar), (lacks - left).cast("int")))


each("str.pad", lambda x, width, side="left", fillchar=" ": padded(x, width, side, fillchar))
each("str.center", lambda x, width, fillchar=" ": padded(x, width, "both", fillchar))
each("str.ljust", lambda x, width, fillchar=" ": padded(x, width, "right", fillchar))
each("str.rjust", lambda x, width, fillchar=" ": padded(x, width, "left", fillchar))
each("str.zfill", lambda x, width: F.when(F.rlike(x, F.lit("^[+-]")), F.concat(F.substring(x, 1, 1), padded(F.substring(x, 2, 1 << 30), width - 1, "left", "0"))).otherwise(padded(x, width, "left", "0")))


@elwise("str.slice")
def _slice(c, x, start=None, stop=None, step=None):
    x, n = lit(x), F.length(lit(x))

    def at(v: int | None, default: Column) -> Column:
        if v is None:
            return default
        return F.least(F.lit(v), n) if v >= 0 else F.greatest(n + v, F.lit(0))

    if step not in (None, 1):
        if step < 1 or (start or 0) < 0 or (stop or 0) < 0:
            raise c.error("str.slice with a step needs positive numbers")
        letters = F.filter(F.split(F.substring(x, (start or 0) + 1, (1 << 30) if stop is None else max(0, stop - (start or 0))), ""), lambda s, i: i % step == 0)
        return F.array_join(letters, "")
    a, b = at(start, F.lit(0)), at(stop, n)
    return F.substring(x, a + 1, F.greatest(b - a, F.lit(0)))


@elwise("str.slice_replace")
def _slice_replace(c, x, start=None, stop=None, repl=""):
    left = OPS["str.slice"].impl(c, x, 0, start or 0)
    right = OPS["str.slice"].impl(c, x, stop, None) if stop is not None else F.lit("")
    return F.concat(left, lit(repl), right)


@elwise("str.split")
def _split(c, x, pat=None, n=-1, regex=None):
    if pat is None:
        return F.split(F.btrim(lit(x), F.lit(SPACE)), r"\s+", n + 1 if n > 0 else -1)
    literal = regex is False or regex is None and len(pat) == 1
    return F.split(lit(x), regex_quote(pat) if literal else pat, n + 1 if n > 0 else -1)


@elwise("str.rsplit")
def _rsplit(c, x, pat=None, n=-1):
    parts = _split(c, x, pat)
    if n <= 0:
        return parts
    head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), pat if pat is not None else " ")
    return F.when(F.size(parts) > n + 1, F.concat(F.array(head), F.slice(parts, F.size(parts) - n + 1, F.lit(n)))).otherwise(parts)


@elwise("str.findall")
def _findall(c, x, pat):
    """All matches; those of the group if the pattern has one."""
    import re

    groups = re.compile(plain(pat, "pat")).groups
    if groups > 1:
        raise c.error("str.findall takes one group at most; Spark has no lists of tuples")
    return F.regexp_extract_all(lit(x), F.lit(pat), F.lit(groups))


@elwise("str.cat")
def _cat(c, x, others=None, sep=None, na_rep=None, join=None):
    """Join with one or more other columns; a missing part makes the result missing unless ``na_rep`` stands for it."""
    if others is None:
        raise c.error("str.cat needs other columns; joining all rows to one string is no column operation")
    parts = [lit(p) for p in (x, *(others if isinstance(others, (list, tuple)) else (others,)))]
    if na_rep is not None:
        parts = [F.coalesce(p, F.lit(na_rep)) for p in parts]
    return F.concat(*[q for p in parts for q in (F.lit(sep or ""), p)][1:])


@elwise("str.extract")
def _extract(c, x, pat, flags=0, expand=False):
    return F.when(F.rlike(lit(x), lit(pat)), F.regexp_extract(lit(x), pat, 1))


@column_function("elwise")
def str_c(c, x, *args, sep="", collapse=None):
    """Join strings row by row; null if one is null."""
    if collapse is not None:
        raise c.error("str_c: collapse is not supported")
    parts = [lit(x).cast("string")]
    for a in args:
        parts += [F.lit(sep), lit(a).cast("string")] if sep else [lit(a).cast("string")]
    return F.concat(*parts)
