"""Row-pattern matching: a regular expression over rows of a partition, in order.

Patterns have variables, sequence, alternation (|), groups, and the quantifiers ? * + {n} {n,} {n,m}, greedy, or
reluctant with a further ?. Conditions and measures are Spark SQL over the current row; PREV(col), NEXT(col) and, of
rows matched so far, FIRST(A.col), LAST(A.col), A.col, COUNT(A.col), SUM, AVG, MIN, MAX (A.col).

What a condition says of the row and its neighbours alone is evaluated by Catalyst before the match, for all variables
at once; only conditions that look at earlier matches are evaluated row by row. Matching runs per partition in Python,
one partition at a time, on its rows in order. Where rows decide all variables, a row is one character, which says what
variables it fits, and a compiled regular expression finds the matches; only their rows become Python values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import Dialect, rewrite
from ..functions.expressions import arguments, tokens
from .grouping import ordering

AFTER = ("MATCH_RECOGNIZED", "NEXT_ROW")


# ---- patterns

@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Rep:
    part: object
    low: int
    high: int | None
    greedy: bool = True


PATTERN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<quant>[?*+]|\{\s*\d*\s*(?:,\s*\d*\s*)?\})|(?P<mark>[()|]))")


def parse_pattern(text: str):
    items, at = [], 0
    while at < len(text.rstrip()):
        m = PATTERN.match(text, at)
        if not m:
            raise ValueError(f"pattern {text!r}: nothing fits at {at}")
        items.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    place = 0

    def peek():
        return items[place] if place < len(items) else (None, None)

    def alternatives():
        nonlocal place
        parts = [sequence()]
        while peek() == ("mark", "|"):
            place += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def sequence():
        nonlocal place
        parts = []
        while peek()[0] == "name" or peek() == ("mark", "("):
            kind, value = peek()
            place += 1
            if kind == "name":
                part = Var(value)
            else:
                part = alternatives()
                if peek() != ("mark", ")"):
                    raise ValueError(f"pattern {text!r}: a group is not closed")
                place += 1
            if peek()[0] == "quant":
                quant = peek()[1]
                place += 1
                greedy = peek() != ("quant", "?")
                place += not greedy
                if quant in "?*+":
                    low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[quant]
                else:
                    a, comma, b = quant[1:-1].partition(",")
                    low = int(a) if a.strip() else 0
                    high = (int(b) if b.strip() else None) if comma else low
                part = Rep(part, low, high, greedy)
            parts.append(part)
        if not parts:
            raise ValueError(f"pattern {text!r} has an empty part")
        return parts[0] if len(parts) == 1 else Seq(tuple(parts))

    out = alternatives()
    if place != len(items):
        raise ValueError(f"pattern {text!r}: {items[place][1]!r} is out of place")
    return out


def variables(node) -> set[str]:
    if isinstance(node, Var):
        return {node.name}
    if isinstance(node, Rep):
        return variables(node.part)
    return set().union(*(variables(p) for p in node.parts))


# ---- automaton: states are numbers; split states list their ways in order of preference

def compile_pattern(node) -> list[tuple]:
    """("var", name, next), ("split", ways) and ("end",)."""
    states: list[list] = []

    def add(*state) -> int:
        states.append(list(state))
        return len(states) - 1

    def build(node, then: int) -> int:
        if isinstance(node, Var):
            return add("var", node.name, then)
        if isinstance(node, Seq):
            for part in reversed(node.parts):
                then = build(part, then)
            return then
        if isinstance(node, Alt):
            return add("split", [build(p, then) for p in node.parts])
        if node.high is None:
            loop = add("split", [])
            body = build(node.part, loop)
            states[loop][1] = [body, then] if node.greedy else [then, body]
            then = loop
        else:
            for _ in range(node.high - node.low):
                body = build(node.part, then)
                then = add("split", [body, then] if node.greedy else [then, body])
        for _ in range(node.low):
            then = build(node.part, then)
        return then

    end = add("end")
    start = build(node, end)
    return [tuple(s) for s in states], start


# ---- expressions over matched rows

AGGREGATES = {"COUNT": len, "SUM": lambda v: sum(v) if v else None, "AVG": lambda v: sum(v) / len(v) if v else None, "MIN": lambda v: min(v, default=None), "MAX": lambda v: max(v, default=None)}


class Matched:
    """An expression split in what Catalyst evaluates per row and what depends on rows matched so far.

    References to matched rows become columns of their own name; such an expression is evaluated in Python, by a small
    evaluator of comparison, arithmetic and logic with SQL's rules for null.
    """

    def __init__(self, text: str, names: set[str]):
        self.text, self.refs = text, {}
        items, out, k = tokens(text), [], 0
        while k < len(items):
            kind, t = items[k]
            nxt = items[k + 1][1] if k + 1 < len(items) else ""
            if kind == "name" and nxt == "(" and t.upper() in ("FIRST", "LAST", *AGGREGATES):
                parts, end = arguments(items, k + 1)
                inside = "".join(x for _, x in parts[0]).strip()
                m = re.fullmatch(r"([A-Za-z_]\w*)\.(\w+|\*)", inside)
                if m and m[1] in names or t.upper() in AGGREGATES or not m:
                    skip = int("".join(x for _, x in parts[1])) if len(parts) > 1 else 0
                    var, col = (m[1], m[2]) if m else (None, inside)
                    out.append(self.ref(t.upper(), var, col, skip))
                    k = end
                    continue
            if kind == "name" and nxt == "." and t in names and k + 2 < len(items):
                out.append(self.ref("LAST", t, items[k + 2][1], 0))
                k += 3
                continue
            out.append(t)
            k += 1
        self.sql = "".join(out)

    def ref(self, func: str, var: str | None, col: str, skip: int) -> str:
        name = f"__m{len(self.refs)}"
        self.refs[name] = (func, var, col, skip)
        return name

    def value(self, name: str, rows: list[dict], labels: list[tuple[int, str]]):
        func, var, col, skip = self.refs[name]
        found = [rows[k] for k, v in labels if var is None or v == var]
        if func in ("FIRST", "LAST"):
            if skip >= len(found):
                return None
            return (found[skip] if func == "FIRST" else found[-1 - skip]).get(col)
        if col == "*":
            return len(found)
        return AGGREGATES[func]([r[col] for r in found if r[col] is not None])


def neighbours(text: str) -> tuple[str, dict[str, tuple[str, str, int]]]:
    """PREV(col[, n]) and NEXT(col[, n]) as columns that lag and lead give."""
    items, out, refs, k = tokens(text), [], {}, 0
    while k < len(items):
        kind, t = items[k]
        if kind == "name" and t.upper() in ("PREV", "NEXT") and k + 1 < len(items) and items[k + 1][1] == "(":
            parts, k = arguments(items, k + 1)
            col = "".join(x for _, x in parts[0]).strip().split(".")[-1]
            n = int("".join(x for _, x in parts[1])) if len(parts) > 1 else 1
            name = f"__{'lag' if t.upper() == 'PREV' else 'lead'}_{n}_{col}"
            refs[name] = ("lag" if t.upper() == "PREV" else "lead", col, n)
            out.append(name)
            continue
        out.append(t)
        k += 1
    return "".join(out), refs


OPS = {"OR": 1, "AND": 2, "NOT": 3, "=": 4, "==": 4, "<>": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "IS": 4, "BETWEEN": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


def evaluator(sql: str):
    """A function of a dictionary of values, for comparison, arithmetic and three-valued logic."""
    items = [(k, t) for k, t in tokens(sql) if k != "space"]
    at = 0

    def peek() -> str:
        return items[at][1].upper() if at < len(items) else ""

    def atom():
        nonlocal at
        if at >= len(items):
            raise ValueError(f"expression {sql!r} ends early")
        kind, text = items[at]
        at += 1
        if text == "(":
            inner = parse(0)
            if peek() != ")":
                raise ValueError(f"a bracket is not closed in {sql!r}")
            at += 1
            return inner
        if text == "-":
            inner = parse(7)
            return lambda v: None if (x := inner(v)) is None else -x
        if text.upper() == "NOT":
            inner = parse(3)
            return lambda v: None if (x := inner(v)) is None else not x
        if kind == "number":
            number = float(text) if re.search(r"[.eE]", text) else int(text)
            return lambda v: number
        if kind == "string":
            said = text[1:-1].replace("''", "'")
            return lambda v: said
        word = {"TRUE": True, "FALSE": False, "NULL": None}
        if text.upper() in word:
            constant = word[text.upper()]
            return lambda v: constant
        if kind in ("name", "quoted") and peek() != "(":
            name = text.strip("`")
            if peek() == ".":
                at += 1
                name = items[at][1].strip("`")
                at += 1
            return lambda v: v[name]
        raise ValueError(f"{text!r} can't be used with matched rows, in {sql!r}")

    def both(op: str, a, b):
        if op == "AND":
            return lambda v: False if (x := a(v)) is False or (y := b(v)) is False else None if x is None or y is None else True
        if op == "OR":
            return lambda v: True if (x := a(v)) is True or (y := b(v)) is True else None if x is None or y is None else False
        work = {
            "=": lambda x, y: x == y, "==": lambda x, y: x == y, "<>": lambda x, y: x != y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
            "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y if y else None, "%": lambda x, y: x % y if y else None,
        }[op]
        return lambda v: None if (x := a(v)) is None or (y := b(v)) is None else work(x, y)

    def parse(least: int):
        nonlocal at
        left = atom()
        while (op := peek()) in OPS and OPS[op] > least and op != "NOT":
            at += 1
            if op == "IS":
                negated = peek() == "NOT"
                at += 1 + negated
                left = (lambda a, n: lambda v: (a(v) is not None) if n else a(v) is None)(left, negated)
            elif op == "BETWEEN":
                low = parse(4)
                at += 1
                high = parse(4)
                left = both("AND", both(">=", left, low), both("<=", left, high))
            else:
                left = both(op, left, parse(OPS[op]))
        return left

    out = parse(0)
    if at != len(items):
        raise ValueError(f"{items[at][1]!r} is out of place in {sql!r}")
    return out


def match_rows(rows: list[dict], states: list[tuple], start: int, flags: dict[str, str], dynamic: dict[str, tuple], after: str) -> Iterator[list[tuple[int, str]]]:
    """Matches in order, as (row number, variable). Depth first in order of preference, without recursion; where all
    conditions are decided by the row, a (state, row) that failed once isn't tried again."""
    pure = not dynamic
    begin = 0
    while begin < len(rows):
        failed: set[tuple[int, int]] = set()
        # choices still open: state, row, and the labels up to there as a linked list
        stack: list[tuple[int, int, tuple | None]] = [(start, begin, None)]
        found = None
        while stack:
            state, k, labels = stack.pop()
            if pure and (state, k) in failed:
                continue
            kind = states[state][0]
            if kind == "end":
                if labels is not None:
                    found = labels
                    break
            elif kind == "split":
                for way in reversed(states[state][1]):
                    stack.append((way, k, labels))
            elif k < len(rows):
                _, var, then = states[state]
                now = (k, var, labels)
                if var in dynamic:
                    expression, work = dynamic[var]
                    said = unlinked(now)
                    values = rows[k] | {name: expression.value(name, rows, said) for name in expression.refs}
                    fits = work(values) is True
                else:
                    fits = var not in flags or rows[k][flags[var]] is True
                if fits:
                    stack.append((then, k + 1, now))
            if pure:
                failed.add((state, k))
        if found is None:
            begin += 1
            continue
        said = unlinked(found)
        yield said
        begin = begin + 1 if after == "NEXT_ROW" else said[-1][0] + 1


def unlinked(labels) -> list[tuple[int, str]]:
    out = []
    while labels is not None:
        out.append((labels[0], labels[1]))
        labels = labels[2]
    return out[::-1]


def nullable(node) -> bool:
    if isinstance(node, Var):
        return False
    if isinstance(node, Rep):
        return node.low == 0 or nullable(node.part)
    return (all if isinstance(node, Seq) else any)(nullable(p) for p in node.parts)


def repeats_repeat(node, within: bool = False) -> bool:
    """Whether a quantifier stands within another, which can make a regular expression try ways without end."""
    if isinstance(node, Var):
        return False
    if isinstance(node, Rep):
        return within or repeats_repeat(node.part, True)
    return any(repeats_repeat(p, within) for p in node.parts)


FIRST_LETTER = 0x100


def letters_of(node, bits: dict[str, int]) -> str:
    """The pattern over letters: that of a row is FIRST_LETTER plus the bits of the variables whose conditions it meets."""
    if isinstance(node, Var):
        if node.name not in bits:
            return "."
        return "[" + "".join(chr(FIRST_LETTER + m) for m in range(1 << len(bits)) if m >> bits[node.name] & 1) + "]"
    if isinstance(node, Rep):
        return f"(?:{letters_of(node.part, bits)}){{{node.low},{'' if node.high is None else node.high}}}{'' if node.greedy else '?'}"
    said = [letters_of(p, bits) for p in node.parts]
    return "".join(said) if isinstance(node, Seq) else f"(?:{'|'.join(said)})"


def plain(value):
    """A Python value of a cell; what is missing is None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


class Frame(dict):
    """Rows of a frame as dictionaries, made when they are asked for."""

    def __init__(self, pdf: pd.DataFrame):
        super().__init__()
        self.columns = {c: pdf[c].array for c in pdf.columns}
        self.size = len(pdf)

    def __missing__(self, k: int) -> dict:
        self[k] = {c: plain(values[k]) for c, values in self.columns.items()}
        return self[k]

    def __len__(self) -> int:
        return self.size


def match_letters(pdf: pd.DataFrame, rows: Frame, regex: re.Pattern, bits: dict[str, int], program: tuple, flags: dict[str, str], after: str) -> Iterator[list[tuple[int, str]]]:
    """What match_rows gives where rows decide all variables: the expression finds a match, the automaton names its rows."""
    masks = np.zeros(len(pdf), np.int64)
    for var, bit in bits.items():
        masks |= pdf[flags[var]].eq(True).to_numpy(bool).astype(np.int64) << bit
    text = "".join(map(chr, (masks + FIRST_LETTER).tolist()))
    begin = 0
    while m := regex.search(text, begin):
        span = [rows[k] for k in range(m.start(), m.end())]
        said = [(k + m.start(), var) for k, var in next(match_rows(span, *program, flags, {}, after))]
        yield said
        begin = m.start() + 1 if after == "NEXT_ROW" else said[-1][0] + 1


#: Variables with conditions that letters are made of at most: a letter stands for a set of them.
MOST_BITS = 8


def match_recognize(df: DataFrame, pattern: str, define: dict[str, str], measures: dict[str, str], partition_by: list[str] | None = None, order_by: dict[str, str] | str | None = None, after: str = "MATCH_RECOGNIZED", types: dict[str, T.DataType] | None = None, dialect: Dialect = Dialect()) -> DataFrame:
    """One row per match: the partition's columns and the measures.

    A variable without a condition fits any row. ``after`` says where the search goes on: behind the last row of a
    match, or at the row after its first. Measures have the type of their column, bigint for COUNT, double for AVG and
    for arithmetic; ``types`` overrides. Rows of a partition are sorted by order_by, then by all orderable columns.
    Without partition_by all rows are one partition. Null partition values are a partition.
    """
    if after not in AFTER:
        raise ValueError(f"after is one of {', '.join(AFTER)}")
    if not define or not measures or not pattern.strip():
        raise ValueError("pattern, define and measures are needed")
    partition_by = list(partition_by or [])
    tree = parse_pattern(pattern)
    names = variables(tree)
    if unknown := set(define) - names:
        raise ValueError(f"define has {sorted(unknown)}, which the pattern lacks")
    states, start = compile_pattern(tree)

    # per row: neighbours, then flags of conditions that the row decides
    texts, refs = {}, {}
    for var, text in define.items():
        texts[var], more = neighbours(text)
        refs |= more
    ties = [F.col(c).asc() for c, t in df.dtypes if not t.startswith(("map", "struct", "array", "binary")) and c not in partition_by]
    window = Window.partitionBy(*(partition_by or [F.lit(0)])).orderBy(*[*(ordering(order_by) if order_by else []), *ties] or [F.lit(0)])
    rows = df.withColumns({name: getattr(F, how)(F.col(col), n).over(window) for name, (how, col, n) in refs.items()}) if refs else df
    flags, dynamic = {}, {}
    for var, text in texts.items():
        own = re.sub(rf"\b{re.escape(var)}\.(?=\w)", "", text) if not re.search(r"\b(FIRST|LAST|COUNT|SUM|AVG|MIN|MAX)\s*\(", text, re.IGNORECASE) else text
        # a variable's own name in its condition is the current row
        expression = Matched(own, names)
        if expression.refs:
            dynamic[var] = (expression, None)
        else:
            flags[var] = f"__is_{var}"
            rows = rows.withColumn(flags[var], F.expr(rewrite(expression.sql, dialect)))
    said = {name: Matched(text, names) for name, text in measures.items()}

    base = {f.name: f.dataType for f in df.schema.fields}
    out = [T.StructField(c, base[c]) for c in partition_by]
    for name, expression in said.items():
        out.append(T.StructField(name, (types or {}).get(name) or measure_type(expression, base)))
    schema = T.StructType(out)
    columns = [f.name for f in out]
    ordered = rows.withColumn("__n", F.row_number().over(window))
    # only columns that conditions and measures name go to Python
    used = {c for e in [*[d[0] for d in dynamic.values()], *said.values()] for _, _, c, _ in e.refs.values()} | {t for e in [*[d[0] for d in dynamic.values()], *said.values()] for _, t in tokens(e.sql)}
    kept = [c for c in ordered.columns if c in used or c in partition_by or c == "__n" or c in flags.values()]
    programs = {name: e.sql for name, e in said.items()}

    bits = {var: k for k, var in enumerate(flags)}
    by_letters = not dynamic and len(bits) <= MOST_BITS and not nullable(tree) and not repeats_repeat(tree)
    pattern_text = letters_of(tree, bits) if by_letters else ""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n")
        data = Frame(pdf)
        works = {var: (e, evaluator(e.sql)) for var, (e, _) in dynamic.items()}
        measure = {name: evaluator(sql) for name, sql in programs.items()}
        result = []
        if by_letters:
            found = match_letters(pdf, data, re.compile(pattern_text, re.DOTALL), bits, (states, start), flags, after)
        else:
            found = match_rows(data, states, start, flags, works, after)
        for labels in found:
            last = data[labels[-1][0]]
            row = {c: data[labels[0][0]][c] for c in partition_by}
            for name, e in said.items():
                row[name] = measure[name](last | {ref: e.value(ref, data, labels) for ref in e.refs})
            result.append(row)
        return pd.DataFrame(result, columns=columns)

    groups = ordered.select(*kept).groupBy(*partition_by) if partition_by else ordered.select(*kept).groupBy()
    return groups.applyInPandas(run, schema)


def measure_type(expression: Matched, base: dict[str, T.DataType]) -> T.DataType:
    m = re.fullmatch(r"\s*(__m\d+)\s*", expression.sql)
    if m:
        func, _, col, _ = expression.refs[m[1]]
        if func == "COUNT":
            return T.LongType()
        if func == "AVG":
            return T.DoubleType()
        kind = base[col]
        return T.LongType() if func == "SUM" and isinstance(kind, T.IntegralType) else kind
    name = expression.sql.strip(" `")
    return base.get(name, T.DoubleType())
