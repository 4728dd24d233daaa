"""SQL: raw statements over named inputs, structured queries, and the window calls that Spark spells otherwise."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import Dialect, column, condition
from ..functions.expressions import arguments, tokens
from .grouping import ordering


class SqlError(ValueError):
    """A statement that can't be run; the message has line and column where they are known."""


WINDOWS = {"TUMBLE": "window", "HOP": "window", "SESSION": "session_window"}


def literal(text: str) -> str:
    """INTERVAL '5' MINUTE as a string that Spark's windows take."""
    m = re.fullmatch(r"\s*INTERVAL\s+'?(\d+)'?\s+(\w+)\s*", text, re.IGNORECASE)
    return f"'{m[1]} {m[2].lower()}'" if m else text.strip()


def window_calls(sql: str) -> str:
    """TUMBLE(ts, size), HOP(ts, slide, size) and SESSION(ts, gap) in GROUP BY, and TUMBLE_START and the like."""
    items, out, k = tokens(sql), [], 0
    while k < len(items):
        kind, text = items[k]
        name, _, part = text.upper().partition("_")
        opens = k + 1 < len(items) and items[k + 1][1] == "("
        if kind == "name" and opens and name in WINDOWS and part in ("", "START", "END"):
            parts, end = arguments(items, k + 1)
            args = ["".join(t for _, t in p).strip() for p in parts]
            # in HOP the slide comes before the size
            times = [literal(a) for a in ([args[0], args[2], args[1]] if name == "HOP" else args)[1:]]
            call = f"{WINDOWS[name]}({', '.join([args[0], *times])})"
            out.append(f"{call}.{part.lower()}" if part else call)
            k = end
            continue
        out.append(text)
        k += 1
    return "".join(out)


def qualify(sql: str) -> str:
    """A trailing QUALIFY becomes a filter around the statement; the columns that it names must be selected."""
    items = tokens(sql.rstrip().rstrip(";"))
    depth = 0
    for k, (kind, text) in enumerate(items):
        depth += {"(": 1, ")": -1}.get(text, 0) if kind == "mark" else 0
        if kind == "name" and text.upper() == "QUALIFY" and not depth:
            before, after = ("".join(t for _, t in part) for part in (items[:k], items[k + 1 :]))
            if re.search(r"\bover\b", after, re.IGNORECASE):
                call, _, rest = re.match(r"\s*(.*\))(\s*)((?:<=|>=|<>|!=|=|<|>).*)$", after, re.DOTALL).groups()
                inner = re.sub(r"(?is)^(\s*select\b)", rf"\1 {call} AS __qualified, ", before, count=1)
                return f"SELECT * EXCEPT (__qualified) FROM ({inner}) WHERE __qualified {rest}"
            return f"SELECT * FROM ({before}) WHERE {after}"
    return sql


def located(error: Exception) -> SqlError:
    """Catalyst's words for an unknown name, with its place."""
    text = str(error)
    at = re.search(r"line (\d+),? pos(?:ition)? (\d+)", text)
    where = f" at line {at[1]}, column {int(at[2]) + 1}" if at else ""
    name = re.search(r"\[UNRESOLVED_COLUMN[^\]]*\].*?with name `?([^`]+(?:`\.`[^`]+)*)`", text) or re.search(r"\[TABLE_OR_VIEW_NOT_FOUND\].*?`([^`]+)`", text)
    if name:
        return SqlError(f"Unknown {'table' if 'TABLE_OR_VIEW' in text else 'column'} '{name[1].replace('`.`', '.')}'{where}")
    return SqlError(text.split("\n")[0] + where)


def run(spark: SparkSession, sql: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """The statement over these tables. Each call has views of its own, whose names replace the given ones in the text
    as tokens, so that calls don't disturb each other; the result is lazy."""
    from pyspark.errors import AnalysisException, ParseException

    own = {name: f"__{name}_{uuid.uuid4().hex[:8]}" for name in inputs}
    for name, df in inputs.items():
        df.createOrReplaceTempView(own[name])
    items, out, k = tokens(window_calls(qualify(sql))), [], 0
    while k < len(items):
        kind, text = items[k]
        before = next((t.upper() for kd, t in reversed(items[:k]) if kd != "space"), "")
        bare = text.strip("`")
        if kind in ("name", "quoted") and bare in own and before in ("FROM", "JOIN", ",") and not (k + 1 < len(items) and items[k + 1][1] in ("(", ".")) and table_place(items, k):
            after = [t for kd, t in items[k + 1 :] if kd != "space"][:1]
            named = after and (after[0].upper() == "AS" or re.fullmatch(r"[A-Za-z_]\w*|`[^`]+`", after[0]) and after[0].upper() not in STOP)
            out.append(own[bare] if named else f"{own[bare]} AS `{bare}`")
        else:
            out.append(text)
        k += 1
    try:
        return spark.sql("".join(out))
    except (AnalysisException, ParseException) as e:
        raise located(e) from e


STOP = {"WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ON", "USING", "UNION", "EXCEPT", "INTERSECT", "MINUS", "NATURAL", "SEMI", "ANTI", "LATERAL", "WINDOW", "TABLESAMPLE", "QUALIFY", "PIVOT", "UNPIVOT", "CLUSTER", "DISTRIBUTE", "SORT", "OFFSET"}


def table_place(items: list[tuple[str, str]], k: int) -> bool:
    """After a comma a name is a table only inside a FROM list: the last clause word on its level says so."""
    depth = 0
    for kind, text in reversed(items[:k]):
        if kind == "mark" and text == ")":
            depth += 1
        elif kind == "mark" and text == "(":
            if not depth:
                return False
            depth -= 1
        elif kind == "name" and not depth and text.upper() in ("FROM", "JOIN"):
            return True
        elif kind == "name" and not depth and text.upper() in ("SELECT", "WHERE", "BY", "ON", "HAVING"):
            return False
    return False


@dataclass(frozen=True)
class Call:
    """A window function in a select list: its name, arguments, and a window by name or in place."""

    func: str
    args: tuple[str, ...] = ()
    over: WindowSpec | None = None
    window: str | None = None


@dataclass(frozen=True)
class WindowSpec:
    """Partition and order; optionally a frame of rows or of a range, as (start, end) with None for unbounded."""

    partition_by: tuple[str, ...] = ()
    order_by: dict[str, str] = field(default_factory=dict)
    rows: tuple[int | None, int | None] | None = None
    range: tuple[int | None, int | None] | None = None

    def build(self):
        w = Window.partitionBy(*self.partition_by)
        if self.order_by:
            w = w.orderBy(*ordering(self.order_by))
        for frame, set_frame in ((self.rows, "rowsBetween"), (self.range, "rangeBetween")):
            if frame:
                low = Window.unboundedPreceding if frame[0] is None else frame[0]
                high = Window.unboundedFollowing if frame[1] is None else frame[1]
                w = getattr(w, set_frame)(low, high)
        return w


def query(df: DataFrame, select: dict[str, str | Call], where: str | None = None, group_by: list[str] | None = None, having: str | None = None, order_by: dict[str, str] | None = None, windows: dict[str, WindowSpec] | None = None, dialect: Dialect = Dialect()) -> DataFrame:
    """Clauses in SQL's order: where, group, having, window functions, order. ``having`` needs a grouping and may use
    outputs' names as well as aggregates."""
    if having and not group_by:
        raise ValueError("having needs group_by")
    if not select:
        raise ValueError("nothing is selected")
    if where:
        df = df.where(condition(df, where, dialect))
    plain = {n: e for n, e in select.items() if isinstance(e, str)}
    calls = {n: e for n, e in select.items() if not isinstance(e, str)}
    if group_by:
        keys = {n: e for n, e in plain.items() if e.strip("` ") in group_by}
        made = [column(e, dialect, df).alias(n) for n, e in plain.items() if n not in keys]
        extra = [F.expr(having).alias("__having")] if having and "(" in having else []
        out = df.groupBy(*group_by).agg(*[*made, *extra] or [F.count("*").alias("__n")])
        if having:
            out = out.where(F.col("__having")) if extra else out.where(having)
        for name, call in calls.items():
            out = out.withColumn(name, window_call(call, windows or {}, dialect))
        df = out.select(*[F.col(f"`{e.strip('` ')}`").alias(n) if n in keys else F.col(f"`{n}`") for n, e in select.items()])
    else:
        df = df.select(*[(column(e, dialect, df) if isinstance(e, str) else window_call(e, windows or {}, dialect)).alias(n) for n, e in select.items()])
    return df.orderBy(*ordering(order_by)) if order_by else df


def window_call(call: Call, windows: dict[str, WindowSpec], dialect: Dialect):
    if call.window is not None and call.window not in windows:
        raise ValueError(f"no window {call.window!r}")
    spec = windows[call.window] if call.window is not None else call.over
    found = column(f"{call.func}({', '.join(call.args)})", dialect)
    return found.over(spec.build()) if spec is not None else found
