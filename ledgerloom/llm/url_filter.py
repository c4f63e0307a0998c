"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs (label 1: block).  The synthetic tables hold none, so
:func:`labelled_urls` makes a seeded set of ordinary and junk addresses; any other list of
``(url, label)`` serves as well.  Features are lexical only: lengths, path depth, digit ratio,
character entropy, parameters, hyphens and labels of the host, and statistics of suffixes (how
often addresses of the training set with the same top-level label, and with the same last four
letters of the main host label, were junk).

Rules are applied in SQL: a rule such as ``example.net/en/`` names a host and a path; it fits
the host and all its subdomains if the path starts with the rule's; the longest rule wins.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and
is judged by its features (for null all are zero but the two junk rates, which are the usual one);
urls of any length are read whole; repeated rows are judged each; an empty table gives an empty
result; columns named like the new ones (``host``, ``path``, ``rule``, ``junk``, ``verdict``) are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "length", "host length", "path length", "depth", "digit ratio", "entropy", "parameters", "query length", "host labels",
    "host hyphens", "host digits", "longest host label", "longest digit run", "escapes", "top-level junk rate", "ending junk rate",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _split(url: str | None) -> tuple[str, str, str]:
    if not url:
        return "", "", ""
    _, mark, rest = url.partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)(.*)", rest if mark else "", re.S)
    return m[1].lower(), m[2], m[3] if mark else url


def endings(url: str | None) -> tuple[str, str]:
    """Top-level label, and last four letters of the label before the last two (or the first)."""
    labels = _split(url)[0].split(".")
    main = labels[-3] if len(labels) > 2 else labels[0]
    return labels[-1], main[-4:]


def features(url: str | None, rates: dict[tuple[int, str], float], usual: float) -> list[float]:
    url = url or ""
    host, path, rest = _split(url)
    query = rest.partition("?")[2].partition("#")[0]
    labels = host.split(".") if host else []
    return [
        len(url), len(host), len(path), len([p for p in path.split("/") if p]), sum(c.isdigit() for c in url) / max(1, len(url)), entropy(url),
        len([p for p in re.split(r"[&;]", query) if p]), len(query), len(labels), host.count("-"), sum(c.isdigit() for c in host),
        max(map(len, labels), default=0), max(map(len, re.findall(r"\d+", url)), default=0), url.count("%"),
        *(rates.get((i, e), usual) for i, e in enumerate(endings(url))),
    ]


@dataclass
class Model:
    rates: dict[tuple[int, str], float]
    usual: float
    start: float
    trees: list[list[tuple[int, float, float]]]  # complete trees: (feature, bar, -) inside, (-1, 0, value) at leaves
    depth: int

    def matrix(self, urls: Sequence[str | None]) -> np.ndarray:
        return np.array([features(u, self.rates, self.usual) for u in urls], dtype=float).reshape(-1, len(FEATURES))

    def probability(self, urls: Sequence[str | None]) -> np.ndarray:
        x = self.matrix(urls)
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for tree in self.trees:
            feature = np.array([n[0] for n in tree])
            bar, value = np.array([n[1] for n in tree]), np.array([n[2] for n in tree])
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feature[at]
                inside = f >= 0
                at = np.where(inside, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > bar[at]), at)
            total += value[at]
        return 1 / (1 + np.exp(-total))


def fit(labelled: Sequence[tuple[str, int]], trees: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 1.0) -> Model:
    """Newton boosting of the logistic loss; deterministic."""
    urls, y = [u for u, _ in labelled], np.array([v for _, v in labelled], dtype=float)
    usual = float(y.mean())
    seen: dict[tuple[int, str], list[float]] = {}
    for u, v in labelled:
        for i, e in enumerate(endings(u)):
            s = seen.setdefault((i, e), [0.0, 0.0])
            s[0] += v
            s[1] += 1
    rates = {k: (a + 4 * usual) / (n + 4) for k, (a, n) in seen.items() if n >= 5}
    model = Model(rates, usual, math.log((usual + 1e-6) / (1 - usual + 1e-6)), [], depth)
    x = model.matrix(urls)
    bars = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
    score = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (depth + 1) - 1)

        def grow(node: int, rows: np.ndarray, level: int, grad=grad, hess=hess, tree=tree) -> None:
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, -1, 0.0)
            if level < depth:
                for f, cuts in enumerate(bars):
                    place = np.searchsorted(cuts, x[rows, f])  # rows with value > cuts[i] have place > i
                    gl = np.cumsum(np.bincount(place, grad[rows], len(cuts) + 1))[:-1]
                    hl = np.cumsum(np.bincount(place, hess[rows], len(cuts) + 1))[:-1]
                    gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, float(cuts[i]))
            if best[1] < 0:
                tree[node] = (-1, 0.0, rate * float(g / (h + penalty)))
                return
            right = x[rows, best[1]] > best[2]
            tree[node] = (best[1], best[2], 0.0)
            grow(2 * node + 1, rows[~right], level + 1)
            grow(2 * node + 2, rows[right], level + 1)

        grow(0, np.arange(len(y)), 0)
        model.trees.append(tree)
        score = score + _values(tree, x, depth)
    return model


def _values(tree: list[tuple[int, float, float]], x: np.ndarray, depth: int) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    feature, bar, value = (np.array([n[i] for n in tree]) for i in range(3))
    for _ in range(depth):
        f = feature[at]
        at = np.where(f >= 0, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > bar[at]), at)
    return value[at]


#: Fixed values of the made training set: words of junk hosts, and syllables of ordinary ones.
JUNK = "cheap pills spam farm casino bonus loan win free prize deal poker replica click cash bet xxx viagra rolex promo offer crypto seo".split()
SYLLABLES = "an be ca de er fo ga hi in jo ka le mo na or pe ra se th ti un ve wa en st nd on re io al".split()


def labelled_urls(count: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """A made, seeded set of labelled URLs, half of them junk (label 1)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda a, b: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(a, b))))
    out = []
    for i in range(count):
        scheme, tail = pick(["http", "https"]), pick(["com", "net", "org", "de", "fr", "es", "info"])
        if i % 2 == 0:
            name = word(2, 5) + ("-" + word(2, 4) if rng.random() < 0.04 else "")
            host = ".".join(x for x in (pick(["", "", "www", "blog", "m", "news"]), name, pick(["", "example", "example", word(2, 4)]), tail) if x)
            path = "/" + pick(["en/", "de/", "fr/", "es/", "", word(1, 4) + "/"]) + pick([str(rng.integers(1, 100000)), word(2, 5), word(2, 4) + "-" + word(2, 4)]) + pick(["", "/", ".html"])
            rest = pick(["", "", "", "#top", "?utm_source=feed", f"?page={rng.integers(1, 30)}&ref=x", f"?id={rng.integers(1, 9999)}"])
        else:
            kind = rng.random()
            name = "-".join(pick(JUNK) for _ in range(int(rng.integers(2, 4)))) if kind < 0.75 else word(2, 4) + str(rng.integers(100, 10**7)) + word(1, 3)
            host = ".".join(x for x in (pick(["", "", "www", word(1, 3)]), name, pick(["", "example", "example", word(2, 4)]), tail) if x)
            path = "/" + pick(["en/", "de/", "fr/", "", "buy/", "go/" + word(1, 3) + "/"]) + pick([str(rng.integers(1, 10**6)), word(2, 5), "-".join(pick(JUNK) for _ in range(3))]) + pick(["", "/", ".html", ".php"])
            rest = pick(["", "", "#top", "?utm_source=feed", f"?page={rng.integers(1, 30)}&ref=x", "?" + "&".join(f"{word(1, 2)}={rng.integers(10**6, 10**10)}" for _ in range(int(rng.integers(2, 7))))])
        out.append((f"{scheme}://{host}{path}{rest}", i % 2))
    return out


def judge(pages: DataFrame, rules: dict[str, str], model: Model, url: str = "url", bar: float = 0.5) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``junk`` (probability) and ``verdict`` to every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c != "junk"]
    where = pages.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probability(batch.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(p, pa.float64())], names=[*kept, "junk"])

    schema = T.StructType([f for f in pages.schema.fields if f.name != "junk"] + [T.StructField("junk", T.DoubleType())])
    scored = pages.mapInArrow(run, schema).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    scored = scored.withColumn("rule", best_rule(F.col("host"), F.col("path"), list(rules)))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    return scored.withColumn("verdict", F.coalesce(said, F.when(F.col("junk") >= bar, F.lit("block")).otherwise(F.lit("allow"))))
