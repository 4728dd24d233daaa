"""URL filters: host and path rules first, then gradient-boosted trees on lexical features, trained from labelled URLs."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Labelled rows that a fit takes at most (those with the least hashed urls), trees, their depth, and the step.
FIT_ROWS, TREES, DEPTH, STEP = 20_000, 30, 3, 0.2
DIGITS = re.compile("[0-9]+")
NUMERIC = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "percents", "longest_digits", "tld_rate", "suffix_rate")


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null without one; of equally long ones, the first in the list.

    A rule fits its host and all subdomains, and paths that start with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def split_url(url: str) -> tuple[str, str, str]:
    """Host, path and query, by the rules of host_of and path_of."""
    _, _, rest = url.partition("://")
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    before, _, _ = rest.partition("#")
    path, _, query = before.partition("?")
    return host.translate({c: c + 32 for c in range(65, 91)}), path, query


def lexical(urls: list[str | None]) -> np.ndarray:
    """All numeric features but the two rates, one row for each url; a null is an empty url."""
    out = np.zeros((len(urls), len(NUMERIC) - 2))
    for k, url in enumerate(urls):
        url = url or ""
        host, path, query = split_url(url)
        data = np.frombuffer(url.encode("utf-8", "replace"), np.uint8)
        p = np.bincount(data, minlength=1) / max(1, len(data))
        p = p[p > 0]
        runs = [len(r) for r in DIGITS.findall(url)]
        parameters = len([x for x in query.split("&") if x])
        out[k] = (len(url), len(host), len(path), len([x for x in path.split("/") if x]), host.count(".") + 1, sum(runs) / max(1, len(url)), -(p * np.log2(p)).sum(), parameters, host.count("-"), url.count("%"), max(runs, default=0))
    return out


def suffixes(url: str | None) -> tuple[str, str]:
    parts = split_url(url or "")[0].split(".")
    return parts[-1], ".".join(parts[-2:])


class Trees:
    """Boosted regression trees for the logistic loss, grown on quantile bins. Small: the sample and it are bounded."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, step: float = STEP, least: int = 20):
        self.sizes, self.trees = (trees, depth, step, least), []
        self.start, self.tld, self.suffix, self.rate = 0.0, {}, {}, 0.5

    def features(self, urls: list[str | None]) -> np.ndarray:
        ends = [suffixes(u) for u in urls]
        rates = np.array([[self.tld.get(a, self.rate), self.suffix.get(b, self.rate)] for a, b in ends]).reshape(len(urls), 2)
        return np.hstack([lexical(urls), rates])

    def fit(self, urls: list[str | None], y: np.ndarray) -> Trees:
        trees, depth, step, least = self.sizes
        y = np.asarray(y, float)
        self.rate = float(y.mean())
        for place, table in ((0, self.tld), (1, self.suffix)):
            frame = pd.DataFrame({"s": [suffixes(u)[place] for u in urls], "y": y}).groupby("s").y.agg(["sum", "count"])
            # shrunk towards the mean as if 20 more rows had it
            table.update(((frame["sum"] + 20 * self.rate) / (frame["count"] + 20)).to_dict())
        x = self.features(urls)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        p = min(max(self.rate, 1e-4), 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)

            def grow(rows: np.ndarray, left: int):
                value = step * g[rows].sum() / (h[rows].sum() + 1.0)
                if not left or len(rows) < 2 * least:
                    return value
                best = (1e-6, None, None)
                gs, hs = g[rows].sum(), h[rows].sum()
                for c, e in enumerate(edges):
                    if not len(e):
                        continue
                    n, ga, ha = (np.cumsum(np.bincount(binned[rows, c], w, len(e) + 1))[:-1] for w in (None, g[rows], h[rows]))
                    gain = ga**2 / (ha + 1) + (gs - ga) ** 2 / (hs - ha + 1) - gs**2 / (hs + 1)
                    gain[(n < least) | (len(rows) - n < least)] = -1
                    if (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                        best = (gain[k], c, k)
                if best[1] is None:
                    return value
                low = binned[rows, best[1]] <= best[2]
                return (best[1], float(edges[best[1]][best[2]]), grow(rows[low], left - 1), grow(rows[~low], left - 1))

            tree = grow(np.arange(len(y)), depth)
            self.trees.append(tree)
            f += self.leaves(tree, x)
        return self

    def leaves(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        column, edge, low, high = tree
        return np.where(x[:, column] <= edge, self.leaves(low, x), self.leaves(high, x))

    def probability(self, urls: list[str | None]) -> np.ndarray:
        x = self.features(urls)
        return 1 / (1 + np.exp(-(self.start + sum((self.leaves(t, x) for t in self.trees), np.zeros(len(x))))))


def fit(labelled: DataFrame, rows: int = FIT_ROWS, url_col: str = "url", label_col: str = "label") -> Trees | None:
    """Trees from at most ``rows`` labelled urls (label true: block), those with the least hashed urls; distinct pairs
    only. Rows with a null url or label teach nothing. None where a label is missing altogether."""
    known = sample(labelled, rows, url_col, label_col)
    return Trees().fit(known.url.tolist(), known.label.to_numpy()) if known.label.nunique() == 2 else None


def sample(labelled: DataFrame, rows: int, url_col: str, label_col: str) -> pd.DataFrame:
    """url, label of at most ``rows`` distinct pairs, in order of hashed urls."""
    pairs = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("boolean").alias("label")).dropna().distinct()
    return pairs.orderBy(F.xxhash64("url"), "url", "label").limit(rows).toPandas()


def held_out_auc(labelled: DataFrame, rows: int = FIT_ROWS, url_col: str = "url", label_col: str = "label", parts: int = 5) -> float | None:
    """How often the trees put a blocked url above an allowed one, each fifth of the sample scored by trees fitted on the
    rest; 0.5 is chance. None where a label is missing."""
    known = sample(labelled, rows, url_col, label_col)
    y, p = known.label.to_numpy(bool), np.zeros(len(known))
    if not 0 < y.sum() < len(y):
        return None
    part = np.arange(len(y)) % parts
    for k in range(parts):
        if 0 < y[part != k].sum() < (part != k).sum():
            p[part == k] = Trees().fit(known.url[part != k].tolist(), y[part != k]).probability(known.url[part == k].tolist())
    rank = pd.Series(p).rank().to_numpy()
    blocked = y.sum()
    return float((rank[y].sum() - blocked * (blocked + 1) / 2) / (blocked * (len(y) - blocked)))


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], model: Trees | None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, probability (of block, by the trees).

    A rule decides; without one, the trees block from ``threshold`` on. Without a model the probability is null and the
    verdict allow. A null url, or one without ://, has an empty host and path, fits no rule and is judged by the trees.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))

    @F.pandas_udf("double")
    def chance(urls: pd.Series) -> pd.Series:
        # repeated urls of a batch are judged once
        codes, distinct = pd.factorize(urls, use_na_sentinel=False)
        said = model.probability([None if pd.isna(u) else u for u in distinct]) if len(distinct) else np.empty(0)
        return pd.Series(said[codes])

    p = chance("url") if model is not None else F.lit(None).cast("double")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.select("page_id", host.alias("host"), path.alias("path"), p.alias("probability"))
    by_trees = F.when(F.coalesce("probability", F.lit(0.0)) >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_trees).alias("verdict"), "probability")
