"""Joins: equi and general, interval, temporal (as of a version), lookup, and within windows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Dialect, rewrite
from ..schema import duration_ms
from .grouping import END, START

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def kind_of(kind: str, allowed=tuple(KINDS)) -> str:
    if kind not in allowed:
        raise ValueError(f"join type {kind!r}; one of {', '.join(allowed)}")
    return KINDS[kind]


def aliased(left: DataFrame, right: DataFrame, aliases: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    if aliases[0] == aliases[1]:
        raise ValueError("both sides have one alias")
    return left.alias(aliases[0]), right.alias(aliases[1])


def merged(joined: DataFrame, left: DataFrame, right: DataFrame, aliases: tuple[str, str], kind: str) -> DataFrame:
    """Columns of both sides; of names that both have, the right one's gets its alias for a prefix."""
    if kind in ("left_semi", "left_anti"):
        return joined.select(*[F.col(f"{aliases[0]}.`{c}`") for c in left.columns])
    twice = set(left.columns) & set(right.columns)
    return joined.select(
        *[F.col(f"{aliases[0]}.`{c}`").alias(c) for c in left.columns],
        *[F.col(f"{aliases[1]}.`{c}`").alias(f"{aliases[1]}_{c}" if c in twice else c) for c in right.columns],
    )


def join(left: DataFrame, right: DataFrame, on: str, kind: str = "inner", aliases: tuple[str, str] = ("l", "r"), broadcast: str | None = None, extra: Column | None = None, dialect: Dialect = Dialect()) -> DataFrame:
    """Rows that meet a condition over both sides' aliases. ``broadcast`` ("left" or "right") is the caller's word that
    the side is small; without it Catalyst decides by size, and adaptive execution splits skewed keys.

    On streams an anti join, which Spark lacks there, is a left join whose right side stays null.
    """
    how = kind_of(kind)
    a, b = aliased(left, right, aliases)
    if broadcast == "left":
        a = F.broadcast(a)
    elif broadcast == "right":
        b = F.broadcast(b)
    elif broadcast:
        raise ValueError(f"broadcast {broadcast!r}")
    said = F.expr(rewrite(on, dialect))
    if extra is not None:
        said = said & extra
    if how == "left_anti" and left.isStreaming and right.isStreaming:
        marked = right.withColumn("__seen", F.lit(True)).alias(aliases[1])
        return merged(a.join(marked, said, "left").where(F.col(f"{aliases[1]}.__seen").isNull()), left, right, aliases, how)
    return merged(a.join(b, said, how), left, right, aliases, how)


TERM = re.compile(r"""^\s*(?P<base>(?!INTERVAL\b)[A-Za-z_`][\w.`]*)?\s*(?:(?P<sign>[+-])\s*)?(?P<rest>(?:INTERVAL\s+)?'?[+-]?\d+'?\s*[A-Za-z]+)?\s*$""", re.IGNORECASE)


def bound_ms(bound: str | int) -> int:
    """Milliseconds that a bound lies after the left event time. A duration ("-1 MINUTE"), milliseconds, or the
    column itself with an interval added or taken ("a.ts + INTERVAL '1' HOUR")."""
    if isinstance(bound, int):
        return bound
    m = TERM.match(bound)
    if not m or not (m["base"] or m["rest"]):
        raise ValueError(f"interval bound {bound!r}")
    if m["base"] and not m["rest"]:
        return 0
    ms = duration_ms(m["rest"])
    return -ms if m["sign"] == "-" else ms


def interval_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, lower: str | int, upper: str | int, kind: str = "inner", aliases: tuple[str, str] = ("l", "r"), dialect: Dialect = Dialect()) -> DataFrame:
    """Pairs whose right event time is from lower to upper after the left one, both ends included.

    An equality in ``on`` makes this a hash or sort-merge join; the bounds are checked in it. On streams with
    watermarks they also bound the state.
    """
    kind_of(kind, ("inner", "left", "right", "full"))
    low, high = bound_ms(lower), bound_ms(upper)
    if low > high:
        raise ValueError(f"the lower bound {lower!r} is above the upper one {upper!r}")

    def shifted(ms: int) -> str:
        return f"{aliases[0]}.`{left_ts}` + INTERVAL '{ms}' MILLISECOND" if ms % 1000 else f"{aliases[0]}.`{left_ts}` + INTERVAL '{ms // 1000}' SECOND"

    extra = F.expr(f"{aliases[1]}.`{right_ts}` >= {shifted(low)} AND {aliases[1]}.`{right_ts}` <= {shifted(high)}".replace("MILLISECOND", "MILLISECONDS"))
    return join(left, right, on, kind, aliases, extra=extra, dialect=dialect)


OP = "op"


def temporal_join(facts: DataFrame, versions: DataFrame, keys: dict[str, str] | list[str], fact_ts: str, version_ts: str, kind: str = "inner", changelog: str | None = None, aliases: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Each fact with the newest version of its key that isn't newer than the fact.

    Facts and versions are one table, ordered by key and time; a version is carried forward to the facts after it. That
    is one shuffle and no pairs, whatever the number of versions of a key. Of versions of one time the last in order of
    all columns holds. ``changelog`` names a column of versions with INSERT, UPDATE or DELETE: from a deletion on there
    is no version. Versions with a null key or time match nothing. kind: inner or left.
    """
    kind_of(kind, ("inner", "left"))
    pairs = list(keys.items()) if isinstance(keys, dict) else [(k, k) for k in keys]
    f_keys, v_keys = [F.col(f"`{a}`") for a, _ in pairs], [F.col(f"`{b}`") for _, b in pairs]
    names = [f"__k{k}" for k in range(len(pairs))]
    fact, version = F.struct(*[F.col(f"`{c}`") for c in facts.columns]), F.struct(*[F.col(f"`{c}`") for c in versions.columns])
    fact_type, version_type = facts.schema.simpleString(), versions.schema.simpleString()
    left = facts.select(*[k.alias(n) for k, n in zip(f_keys, names, strict=True)], F.col(f"`{fact_ts}`").alias("__ts"), F.lit(1).alias("__side"), fact.alias("__fact"), F.lit(None).cast(version_type).alias("__version"))
    right = versions.select(*[k.alias(n) for k, n in zip(v_keys, names, strict=True)], F.col(f"`{version_ts}`").alias("__ts"), F.lit(0).alias("__side"), F.lit(None).cast(fact_type).alias("__fact"), version.alias("__version"))
    for n in [*names, "__ts"]:
        right = right.where(F.col(n).isNotNull())
    window = Window.partitionBy(*names).orderBy("__ts", "__side", "__version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # facts sort after versions of their time, so that these count
    seen = left.unionByName(right).withColumn("__version", F.last("__version", ignorenulls=True).over(window)).where("__side = 1")
    known = F.col("__version").isNotNull() & F.col("__ts").isNotNull()
    for n in names:
        known = known & F.col(n).isNotNull()
    if changelog:
        known = known & (F.upper(F.col(f"__version.`{changelog}`")) != "DELETE")
    if kind == "inner":
        seen = seen.where(known)
    twice = set(facts.columns) & set(versions.columns)
    return seen.select(
        *[F.col(f"__fact.`{c}`").alias(c) for c in facts.columns],
        *[F.when(known, F.col(f"__version.`{c}`")).alias(f"{aliases[1]}_{c}" if c in twice else c) for c in versions.columns if c != changelog],
    )


def lookup_join(rows: DataFrame, table: Callable[[], DataFrame], on: str, select: list[str] | None = None, kind: str = "left", aliases: tuple[str, str] = ("l", "r"), dialect: Dialect = Dialect()) -> DataFrame:
    """Rows enriched from an external table as it is when this is called; Catalyst broadcasts it while it is small. A
    stream joined directly keeps the files that the table had then; pipelines call this for each micro-batch instead."""
    kind_of(kind, ("inner", "left"))
    side = table()
    if select:
        wanted = set(select) | set(re.findall(rf"\b{aliases[1]}\.`?(\w+)`?", on))
        side = side.select(*[c for c in side.columns if c in wanted])
    out = join(rows, side, on, kind, aliases, dialect=dialect)
    if select:
        hidden = [f"{aliases[1]}_{c}" if c in rows.columns else c for c in side.columns if c not in select]
        out = out.drop(*hidden)
    return out


def windowed_join(left: DataFrame, right: DataFrame, on: str, kind: str = "inner", aliases: tuple[str, str] = ("l", "r"), dialect: Dialect = Dialect()) -> DataFrame:
    """Rows of one window: both sides have window_start and window_end, which are equal in a pair and appear once."""
    how = kind_of(kind)
    same = (F.col(f"{aliases[0]}.{START}") == F.col(f"{aliases[1]}.{START}")) & (F.col(f"{aliases[0]}.{END}") == F.col(f"{aliases[1]}.{END}"))
    out = join(left, right, on, kind, aliases, extra=same, dialect=dialect)
    if how in ("left_semi", "left_anti"):
        return out
    bounds = {c: F.coalesce(F.col(c), F.col(f"{aliases[1]}_{c}")) for c in (START, END)}
    return out.withColumns(bounds).drop(*[f"{aliases[1]}_{c}" for c in (START, END)])
