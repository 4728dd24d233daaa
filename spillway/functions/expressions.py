"""SQL expressions as Spark columns, with the few functions whose meaning differs here from Spark's.

The rewrite works on the text's tokens, so strings, quoted names and comments are never touched, and leaves every
optimisation to Catalyst. What differs:

  TRIM(s)                  strips all Unicode white space, not only spaces
  SUBSTRING(s, from, n)    a start below 1 counts as 1
  REGEXP_EXTRACT(s, p, g)  NULL without a match, not an empty string
  decimal literals         are doubles
  a / b                    with integer_division: between integers an integer, truncated
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
      | (?P<quoted>`(?:[^`]|``)*`)
      | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?[A-Za-z]*)
      | (?P<name>[^\W\d]\w*)
      | (?P<mark><=>|<>|!=|<=|>=|\|\||->|.)""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Dialect:
    """compat: the meanings listed above. integer_division: also that of ``/``."""

    compat: bool = True
    integer_division: bool = False


def tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup or "mark", m[0]) for m in TOKEN.finditer(text)]


def arguments(items: list[tuple[str, str]], at: int) -> tuple[list[list[tuple[str, str]]], int]:
    """Arguments of the call whose opening bracket is at ``at``, and the place after its closing one."""
    parts: list[list[tuple[str, str]]] = [[]]
    depth, k = 1, at + 1
    while k < len(items):
        kind, text = items[k]
        if kind == "mark" and text in "([":
            depth += 1
        elif kind == "mark" and text in ")]":
            depth -= 1
            if not depth:
                return parts, k + 1
        if kind == "mark" and text == "," and depth == 1:
            parts.append([])
        else:
            parts[-1].append(items[k])
        k += 1
    raise ValueError("a bracket is not closed")


def trim(s: str) -> str:
    return f"regexp_replace({s}, '(?U)^\\\\s+|\\\\s+$', '')"


def substring(s: str, start: str, *size: str) -> str:
    return f"substring({', '.join((s, f'greatest({start}, 1)', *size))})"


def regexp_extract(s: str, pattern: str, group: str = "1") -> str:
    return f"CASE WHEN ({s}) RLIKE ({pattern}) THEN regexp_extract({s}, {pattern}, {group}) END"


CALLS = {("TRIM", 1): trim, ("SUBSTRING", 2): substring, ("SUBSTRING", 3): substring, ("SUBSTR", 2): substring, ("SUBSTR", 3): substring, ("REGEXP_EXTRACT", 2): regexp_extract, ("REGEXP_EXTRACT", 3): regexp_extract}


def render(items: list[tuple[str, str]], dialect: Dialect) -> str:
    out, k = [], 0
    while k < len(items):
        kind, text = items[k]
        after = next((j for j in range(k + 1, len(items)) if items[j][0] != "space"), len(items))
        if kind == "name" and after < len(items) and items[after][1] == "(":
            parts, end = arguments(items, after)
            words = {t.upper() for p in parts for kind, t in p if kind == "name"}
            call = CALLS.get((text.upper(), len(parts)))
            # TRIM(LEADING x FROM y) and SUBSTRING(x FROM 2) keep their SQL meaning
            if call and not words & {"FROM"}:
                out.append(call(*[render(p, dialect).strip() for p in parts]))
            else:
                out.append(f"{text}({','.join(render(p, dialect) for p in parts)})")
            k = end
            continue
        if kind == "number" and re.fullmatch(r"\d*\.\d*", text) and text != ".":
            out.append(f"{text}D")
        else:
            out.append(text)
        k += 1
    return "".join(out)


def rewrite(text: str, dialect: Dialect = Dialect()) -> str:
    """The expression as Spark SQL."""
    return render(tokens(text), dialect) if dialect.compat else text


INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def divided(text: str, df: DataFrame, dialect: Dialect) -> str:
    """Slashes between operands that are integers over df become DIV; an operand is a name, number, call or bracket."""
    items = tokens(text)

    def operand(k: int, step: int) -> tuple[int, int] | None:
        """Borders of the operand next to the slash at k."""
        j = k + step
        while 0 <= j < len(items) and items[j][0] == "space":
            j += step
        if not 0 <= j < len(items):
            return None
        first, opening, closing = j, *("()" if step > 0 else ")(")
        if step > 0 and items[j][0] == "name" and j + 1 < len(items) and items[j + 1][1] == "(":
            j += 1
        if items[j][1] == opening:
            depth = 0
            while 0 <= j < len(items):
                depth += {opening: 1, closing: -1}.get(items[j][1], 0)
                if not depth:
                    break
                j += step
            if step < 0 and j > 0 and items[j - 1][0] == "name":
                j -= 1
        while step < 0 and j > 1 and items[j - 1][1] == "." or step > 0 and j + 2 < len(items) and items[j + 1][1] == ".":
            j += 2 * step
        return (first, j + 1) if step > 0 else (j, first + 1)

    def integral(span: tuple[int, int] | None) -> bool:
        if not span:
            return False
        try:
            part = render(items[span[0] : span[1]], dialect)
            return df.select(F.expr(part).alias("x")).dtypes[0][1] in INTEGERS
        except Exception:  # not an expression by itself
            return False

    for k, (_, t) in enumerate(items):
        if t == "/" and integral(operand(k, -1)) and integral(operand(k, 1)):
            items[k] = ("name", " div ")
    return "".join(t for _, t in items)


def column(text: str, dialect: Dialect = Dialect(), over: DataFrame | None = None) -> Column:
    """The expression as a column. Integer division needs the frame that the expression is over."""
    if dialect.integer_division and over is not None and "/" in text:
        text = divided(text, over, dialect)
    return F.expr(rewrite(text, dialect))


def condition(df: DataFrame, text: str, dialect: Dialect = Dialect()) -> Column:
    """A boolean expression over df; any other type is an error."""
    found = column(text, dialect, df)
    kind = df.select(found.alias("x")).dtypes[0][1]
    if kind not in ("boolean", "void"):
        raise TypeError(f"condition {text!r} is {kind}, not boolean")
    return found
