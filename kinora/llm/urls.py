"""URL filters: suffix and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Rules are native column expressions; the longest that fits a url's host and path decides.  Urls that a rule decides are
the labelled ones: a bounded sample of them, in the order of a hash, trains a logistic gradient boosting of shallow
histogram trees on the driver.  Features: lengths, depth, digit ratio, entropy, parameter counts, separators and
smoothed block rates of the host's last one and two labels.  The trees (a fixed size) are broadcast and score all urls.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the trees
like any other; without labelled urls the method allows everything; repeated rows and ids each keep their row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled urls learned from, at most.
SAMPLE_ROWS = 20_000
#: Host endings that get a block rate of their own, the most frequent ones of the sample.
SUFFIXES = 2_000
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, as text, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are outermost, so win
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "parameters", "hyphens", "https", "fragment", "one_label", "two_labels")
_PARTS = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?")


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.fromiter(Counter(text).values(), dtype=float) / len(text)
    return float(-(n * np.log2(n)).sum())


def _suffixes(name: str) -> tuple[str, str]:
    parts = name.split(".")
    return parts[-1], ".".join(parts[-2:])


def _digits(text: str) -> float:
    return sum("0" <= c <= "9" for c in text) / len(text) if text else 0.0


@dataclass
class Lexical:
    """Turns urls into features; knows the block rates of host endings."""

    rates: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0

    @classmethod
    def fit(cls, urls: list[str], labels: np.ndarray, weight: float = 20.0) -> Lexical:
        prior = float(labels.mean()) if len(labels) else 0.0
        seen, blocked = Counter(), Counter()
        for url, label in zip(urls, labels.tolist()):
            m = _PARTS.match(url)
            for s in set(_suffixes(m[1].lower() if m else "")):
                seen[s] += 1
                blocked[s] += label
        kept = sorted(seen, key=lambda s: (-seen[s], s))[:SUFFIXES]
        return cls({s: (blocked[s] + weight * prior) / (seen[s] + weight) for s in kept}, prior)

    def features(self, urls: list[str | None]) -> np.ndarray:
        out = np.zeros((len(urls), len(FEATURES)))
        for k, url in enumerate(urls):
            url = url or ""
            m = _PARTS.match(url)
            name, where, query = (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")
            one, two = _suffixes(name)
            out[k] = (
                len(url), len(name), len(where), where.count("/"), name.count(".") + 1, _digits(url), _digits(name), _entropy(url),
                len([p for p in query.split("&") if p]), name.count("-"), url.startswith("https:"), "#" in url, self.rates.get(one, self.prior), self.rates.get(two, self.prior),
            )
        return out


class Boosting:
    """Logistic gradient boosting with histogram trees of a fixed depth; nodes lie in arrays, children at 2i+1, 2i+2."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.start, self.model = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        total = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            tree = self._tree(binned, cuts, p - y, p * (1 - p))
            self.model.append(tree)
            total += self._apply(tree, x)
        return self

    def _tree(self, binned, cuts, g, h):
        size = (1 << self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(g))}
        for node in range(size):
            mine = rows.pop(node, None)
            if mine is None or not len(mine):
                continue
            G, H = g[mine].sum(), h[mine].sum()
            value[node] = -self.rate * G / (H + self.l2)
            if node >= (1 << self.depth) - 1 or len(mine) < 20:
                continue
            best = (1e-3, None, None)
            for f in range(binned.shape[1]):
                if not len(cuts[f]):
                    continue
                n = len(cuts[f]) + 1
                left_g = np.cumsum(np.bincount(binned[mine, f], weights=g[mine], minlength=n))[:-1]
                left_h = np.cumsum(np.bincount(binned[mine, f], weights=h[mine], minlength=n))[:-1]
                gain = left_g**2 / (left_h + self.l2) + (G - left_g) ** 2 / (H - left_h + self.l2) - G**2 / (H + self.l2)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] is not None:
                _, f, k = best
                feature[node], cut[node] = f, cuts[f][k]
                goes = binned[mine, f] <= k
                rows[2 * node + 1], rows[2 * node + 2] = mine[goes], mine[~goes]
        return feature, cut, value

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.model:
            total += self._apply(tree, x)
        return 1 / (1 + np.exp(-total))


@dataclass
class UrlModel:
    lexical: Lexical
    trees: Boosting | None

    def block_probability(self, urls: list[str | None]) -> np.ndarray:
        if self.trees is None or not urls:
            return np.zeros(len(urls))
        return self.trees.probability(self.lexical.features(urls))


def train(urls: list[str], labels: list[int]) -> UrlModel:
    """``labels``: 1 for blocked. With one class only, or none, nothing is blocked or everything is alike."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.max() == 0:
        return UrlModel(Lexical(), None)
    lexical = Lexical.fit(urls, y)
    return UrlModel(lexical, Boosting().fit(lexical.features(urls), y))


def split(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    name, verdict = rule_for(rules, F.col("host"), F.col("path"))
    return rows.withColumns({"rule": name, "ruled": verdict})


def learn(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """From at most ``sample_rows`` distinct urls that a rule decides."""
    labelled = rows.where("ruled is not null and url is not null").select("url", (F.col("ruled") == "block").cast("int").alias("label")).distinct()
    found = labelled.orderBy(F.xxhash64("url"), "url").limit(sample_rows).collect()
    return train([r.url for r in found], [r.label for r in found])


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, score (the trees' probability of block)."""
    rows = split(pages, rules)
    bound = pages.sparkSession.sparkContext.broadcast(learn(rows) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            score = bound.value.block_probability(urls)
            verdict = [r if r is not None else "block" if s >= 0.5 else "allow" for r, s in zip(batch.column("ruled").to_pylist(), score)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
