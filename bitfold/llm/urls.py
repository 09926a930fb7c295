"""URL filter: explicit host and path rules first, gradient-boosted trees for everything else.

The trees see lexical features of a URL only: lengths, depth, digit ratio, entropy, parameter
counts, and for each of its host's suffixes how often labelled URLs with that suffix were bad.  Those
shares are counted over all distinct labelled URLs, first by host and then by suffix, and return
to the pages with a join on the host.  The trees are trained in NumPy on the driver from a bounded
sample of labelled URLs, each label weighted back to its number in the corpus, and applied to Arrow
batches.

Defined results: host and path of a null url, or one without ``://``, are empty; such a url is
judged by the trees like any other.  Without labelled URLs of both kinds, what no rule covers is
allowed.  Rows are judged one by one; other columns stay, and existing columns with the names
of the results are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitfold.session import materialize

# fixed values: the rules of the contract, verdict first, then host and path
RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")
# fixed values: words in host names that mark a labelled URL as bad
BAD_WORDS = ("adult", "ads", "bets", "casino", "cheap", "pills", "poker", "spam", "torrent", "warez")
RESULTS = ("host", "path", "rule", "verdict", "block_score")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FOLDS = 4
MOST_LABELS = 3  # suffixes of a host have one to so many labels


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null when none fits; of equals the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for line in sorted(rules, key=lambda r: len(r.split(" ", 1)[1]), reverse=True)[::-1]:
        what, pattern = line.split(" ", 1)
        name, slash, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffixes(host: str, most: int = MOST_LABELS) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in range(1, most + 1)]


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path and what follows."""
    rest = (url or "").partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut].translate(LOWERED), rest[cut:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return host, tail[:end], tail[end:]


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def lexical(url: str | None) -> list[float]:
    host, path, query = split_url(url)
    name = host.split(".")
    size = max(1, len(url or ""))
    return [
        len(url or ""), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url or "") / size,
        entropy(host), entropy(path), query.count("=") + query.count("&"), len(name), host.count("-"),
        max(map(len, name)), sum(c in "aeiou" for c in host) / max(1, len(host)), float("#" in query),
    ]


@dataclass
class SuffixRates:
    """Smoothed share of bad labels per host suffix; unseen suffixes get the overall share.

    ``counts(suffix, bad, seen)`` is a table over all labelled URLs; ``bad`` and ``seen`` hold one
    number for each fold.
    """

    overall: float
    counts: DataFrame
    weight: float = 5.0

    def share(self, bad, seen):
        return (bad + self.weight * self.overall) / (seen + self.weight)

    def of_hosts(self, hosts: DataFrame) -> DataFrame:
        """``(host, rates)`` for ``hosts(host)``."""
        asked = hosts.distinct().select("host", F.posexplode(suffix_columns(F.col("host"))).alias("k", "suffix"))
        total = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0))
        known = asked.join(self.counts, "suffix", "left").select("host", "k", self.share(total("bad"), total("seen")).alias("rate"))
        at = [F.max(F.when(F.col("k") == k, F.col("rate"))) for k in range(MOST_LABELS)]
        # written, so that the join with the pages sees its size and can split a host with very many pages
        return materialize(known.groupBy("host").agg(F.array(*at).alias("rates")), "host-rates")

    def lookup(self, hosts: list[str], folds: list[int] | None = None) -> list[list[float]]:
        """Rates for a bounded list of hosts, without the labels of each one's own fold if folds are given."""
        wanted = sorted({(s,) for h in hosts for s in suffixes(h)})
        if not wanted:
            return []
        asked = self.counts.sparkSession.createDataFrame(wanted, "suffix string")
        counts = {r["suffix"]: (r["bad"], r["seen"]) for r in self.counts.join(asked, "suffix").collect()}
        none = [0] * FOLDS
        out = []
        for i, host in enumerate(hosts):
            own = folds[i] if folds else None
            pairs = [counts.get(s, (none, none)) for s in suffixes(host)]
            bad, seen = ([sum(p[side]) - (p[side][own] if folds else 0) for p in pairs] for side in (0, 1))
            out.append([self.share(x, n) for x, n in zip(bad, seen)])
        return out


def suffix_columns(host: Column) -> Column:
    return F.array(*[F.substring_index(host, ".", -k) for k in range(1, MOST_LABELS + 1)])


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(7)), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """``(suffix, bad, seen)`` from distinct ``labelled(url, label)``, a URL once for each of its suffixes."""
    sums = lambda x, y: [F.sum(F.when(F.col("fold") == k, F.col(x)).otherwise(0)).alias(f"{y}_{k}") for k in range(FOLDS)]
    read = labelled.select(host_of(F.col("url")).alias("host"), fold_of(F.col("url")).alias("fold"), F.col("label").cast("bigint"), F.lit(1).alias("one"))
    # one row per host before suffixes multiply the rows
    hosts = read.groupBy("host").agg(*sums("label", "bad"), *sums("one", "seen"))
    each = hosts.withColumn("suffix", F.explode(F.array_distinct(suffix_columns(F.col("host")))))
    names = [f"{y}_{k}" for y in ("bad", "seen") for k in range(FOLDS)]
    summed = each.groupBy("suffix").agg(*[F.sum(c).alias(c) for c in names])
    return summed.select("suffix", *[F.array(*[f"{y}_{k}" for k in range(FOLDS)]).alias(y) for y in ("bad", "seen")])


@dataclass
class Boosted:
    """Trees of fixed depth as arrays ``(trees, nodes)``; leaves hold log-odds."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32
) -> Boosted:
    """Logistic boosting: every split maximises the gain of the second-order loss over quantile cuts.

    A row counts ``weight`` times.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    mean = np.clip(np.average(y, weights=weight), 1e-9, 1 - 1e-9)
    base = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), base)
    n_nodes = 2**depth - 1
    feature = np.zeros((trees, n_nodes), np.int64)
    cut = np.full((trees, n_nodes), np.inf)
    leaf = np.zeros((trees, n_nodes + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for k in range(n_nodes):
            here = np.flatnonzero(node == k)
            best = (1e-9, 0, None)
            for j, c in enumerate(cuts):
                if not len(here) or not len(c):
                    continue
                gs = np.bincount(binned[here, j], g[here], len(c) + 1).cumsum()
                hs = np.bincount(binned[here, j], h[here], len(c) + 1).cumsum()
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], j, c[at])
            if best[2] is not None:
                feature[t, k], cut[t, k] = best[1], best[2]
            node[here] = 2 * k + 1 + (x[here, feature[t, k]] > cut[t, k])
        spot = node - n_nodes
        gs, hs = np.bincount(spot, g, n_nodes + 1), np.bincount(spot, h, n_nodes + 1)
        leaf[t] = -rate * gs / (hs + 1)
        total += leaf[t][spot]
    return Boosted(base, feature, cut, leaf)


@dataclass
class UrlModel:
    rates: SuffixRates
    trees: Boosted

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Scores of a bounded list, on the driver."""
        return score(self.trees, urls, self.rates.lookup([split_url(u)[0] for u in urls]))


def score(trees: Boosted, urls: list[str | None], rates: list[list[float]]) -> np.ndarray:
    x = np.array([lexical(u) + list(r) for u, r in zip(urls, rates)], float).reshape(len(urls), -1)
    return trees.score(x)


def fit(labelled: DataFrame, max_rows: int = 4_000) -> UrlModel | None:
    """Train on ``labelled(url, label)``.

    Suffix rates come from all distinct rows, the trees from at most ``max_rows`` of each label in
    url-hash order.  A sampled row stands for as many rows as its label has for each one sampled, so
    base and threshold mean the same at every size.  Suffix rates of a training URL come from the
    other folds, so they do not give its label away.
    """
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).select("url", "label").distinct()
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    counts = materialize(suffix_counts(known), "suffix-counts")
    rates = SuffixRates(sizes[1] / (sizes[0] + sizes[1]), counts)
    rows = []
    for label in (0, 1):
        part = known.where(F.col("label") == label).withColumn("fold", fold_of(F.col("url")))
        rows += part.orderBy(F.xxhash64("url"), "url").limit(max_rows).collect()
    urls, y = [r["url"] for r in rows], np.array([r["label"] for r in rows], float)
    drawn = {label: max(1, int((y == label).sum())) for label in (0, 1)}
    weight = np.array([sizes[r["label"]] / drawn[r["label"]] for r in rows])
    near = rates.lookup([split_url(u)[0] for u in urls], [r["fold"] for r in rows])
    x = np.array([lexical(u) + r for u, r in zip(urls, near)], float)
    return UrlModel(rates, boost(x, y, weight))


def scorer(trees: Boosted):
    @F.arrow_udf("double")
    def scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, rates in batches:
            yield pa.array(score(trees, urls.to_pylist(), rates.to_pylist()), pa.float64())

    return scores


def judge(pages: DataFrame, model: UrlModel | None, url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``RESULTS``."""
    kept = pages.drop(*[c for c in RESULTS if c in pages.columns])
    read = kept.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if model:
        rates = model.rates.of_hosts(read.select("host")).withColumnsRenamed({"host": "_host", "rates": "_rates"})
        joined = read.join(rates, F.col("host") == F.col("_host")).drop("_host")
        read = joined.withColumn("block_score", scorer(model.trees)(F.col(url), F.col("_rates"))).drop("_rates")
    else:
        read = read.withColumn("block_score", F.lit(0.0))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    guess = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return read.withColumns({"rule": rule, "verdict": F.coalesce(verdict, guess)})


def weakly_labelled(pages: DataFrame) -> DataFrame:
    """``(url, label)``: bad when a host label is made up with one of ``BAD_WORDS``."""
    bad = host_of(F.col("url")).rlike(r"(^|[.-])(" + "|".join(BAD_WORDS) + r")([.-]|$)")
    return pages.where(F.col("url").isNotNull()).select("url", bad.cast("int").alias("label"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = fit(weakly_labelled(pages))
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "block_score")
