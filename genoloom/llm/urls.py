"""URL filter: longest-matching host and path rules, then gradient-boosted trees.

The trees see lexical features only.  They are grown on histograms: labelled URLs are
binned by approximate quantiles and counted per combination of bins, so all of them take
part and nothing is sampled; each level of a tree is one aggregation of at most
leaves x features x bins rows.  Scoring is a plain column expression.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.operators.requests import is_small, sized
from genoloom.session import cut_lineage

BINS = 16
SUPPORT = 10  # rows that a statistic takes at least, as a rare one would repeat its own row's label
SALTS = 16    # parts of a host ending's or first path part's rows where statistics are too many to broadcast
CLASSES = string.ascii_lowercase + string.digits + "-._/?&=%"
UNIT = 1_000_000  # gradients are summed as whole numbers, so sums don't depend on their order


@dataclass(frozen=True)
class UrlRule:
    """A host with all its subdomains and a start of the path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(allow: list[str], block: list[str]) -> list[UrlRule]:
    """Rules written like ``example.org/en/``; the path starts at the first slash."""
    out = []
    for verdict, texts in (("allow", allow), ("block", block)):
        for t in texts:
            host, slash, rest = t.partition("/")
            out.append(UrlRule(host.lower(), slash + rest, verdict))
    return out


def with_parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; null, or without ``://``: both empty."""
    url = F.col(url_col)
    rest = F.substring_index(url, "://", 1)
    tail = F.expr(f"substring(`{url_col}`, length(substring_index(`{url_col}`, '://', 1)) + 4)")
    there = url.isNotNull() & (F.length(rest) < F.length(url))
    host = F.translate(F.regexp_extract(tail, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return urls.withColumns({
        "host": F.when(there, host).otherwise(""),
        "path": F.when(there, F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1)).otherwise("")})


def rule_of(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    whole = F.lower(F.coalesce(url, F.lit("")))
    n = F.greatest(F.length(whole), F.lit(1)).cast("double")
    counts = [F.length(whole) - F.length(F.replace(whole, F.lit(c))) for c in CLASSES]
    other = F.length(whole) - sum(counts[1:], counts[0])

    def term(c: Column) -> Column:
        p = c / n
        return F.when(c > 0, -p * F.log2(p)).otherwise(0.0)

    digits = sum((counts[CLASSES.index(c)] for c in string.digits[1:]), counts[CLASSES.index("0")])
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    return {
        "length": F.length(whole).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("double"),
        "digit_ratio": digits / n,
        "hyphens": counts[CLASSES.index("-")].cast("double"),
        "entropy": sum((term(c) for c in [*counts[1:], other]), term(counts[0])),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "fragment": whole.contains("#").cast("double"),
    }


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _head(path: Column) -> Column:
    return F.regexp_extract(path, "^/([^/]*)", 1)


def _keys() -> dict[str, Column]:
    """What statistics are kept of: host endings and first path parts."""
    return {"suffix_rate": _suffix(F.col("host")), "head_rate": _head(F.col("path"))}


@dataclass(frozen=True)
class Rates:
    """The share of label 1 by key, as a table (``_key``, ``_rate``) of one row each."""

    table: DataFrame
    small: bool

    @classmethod
    def of(cls, rows: DataFrame, key: Column, prior: float) -> Rates:
        table = cut_lineage(rows.groupBy(key.alias("_key")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).where(F.col("n") >= SUPPORT).select(
            "_key", ((F.col("ones") + 10 * prior) / (F.col("n") + 10)).alias("_rate")))
        return cls(table, is_small(table))

    def added(self, urls: DataFrame, key: Column, name: str) -> DataFrame:
        """``urls`` with the rate of each row's key as ``name``, null without one."""
        rates = self.table.withColumnsRenamed({"_key": f"{name}_key", "_rate": name})
        keyed = key == F.col(f"{name}_key")
        if self.small:
            return urls.join(sized(rates, True), keyed, "left").drop(f"{name}_key")
        whole = [F.col(f"`{f.name}`") for f in urls.schema if "map<" not in f.dataType.simpleString()]
        salt, salts = f"{name}_part", F.sequence(F.lit(0), F.lit(SALTS - 1))
        urls = urls.withColumn(salt, F.pmod(F.xxhash64(*whole), F.lit(SALTS)).cast("int"))
        rates = rates.withColumn(f"{name}_salt", F.explode(salts))
        return urls.join(sized(rates, False), keyed & (F.col(salt) == F.col(f"{name}_salt")), "left").drop(
            f"{name}_key", f"{name}_salt", salt)


@dataclass
class UrlModel:
    """Boosted trees over binned features; ``trees`` are nested (feature, bin, low, high) or leaf values."""

    base: float = 0.0
    edges: dict[str, list[float]] = field(default_factory=dict)
    rates: dict[str, Rates] = field(default_factory=dict)
    prior: float = 0.5
    trees: list = field(default_factory=list)

    def features(self, urls: DataFrame, url_col: str) -> DataFrame:
        """Adds the features as one struct ``_f``."""
        f = _lexical(F.col(url_col), F.col("host"), F.col("path"))
        for name, key in _keys().items():
            f[name] = F.lit(self.prior)
            if name in self.rates:
                urls = self.rates[name].added(urls, key, f"_{name}")
                f[name] = F.coalesce(F.col(f"_{name}"), F.lit(self.prior))
        return urls.withColumn("_f", F.struct(*[c.alias(k) for k, c in f.items()])).drop(*[f"_{k}" for k in self.rates])

    def bins(self) -> Column:
        """The features' bins as one struct: how many edges lie below the value."""
        return F.struct(*[
            sum(((F.col(f"_f.{k}") > e).cast("int") for e in edges), F.lit(0)).alias(k)
            for k, edges in self.edges.items()])

    def leaf(self, tree, at: str = "") -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        name, upto, low, high = tree
        return F.when(F.col(f"_b.{name}") <= upto, self.leaf(low)).otherwise(self.leaf(high))

    def margin(self) -> Column:
        return sum((self.leaf(t) for t in self.trees), F.lit(self.base))


def train(labelled: DataFrame, *, trees: int = 10, depth: int = 3, rate: float = 0.3, url_col: str = "url") -> UrlModel:
    """Boosted trees from rows (``url_col``, label 1 to block or 0 to allow).

    All rows take part.  Null labels are left out; without rows of both labels there are
    no trees and every score is the share of label 1, or 0.5 without any row.
    """
    model = UrlModel()
    rows = cut_lineage(with_parts(labelled.where("label in (0, 1)").select(F.col(url_col).alias("url"), "label")))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    model.prior = (ones + 0.5) / (n + 1)
    model.base = math.log(model.prior / (1 - model.prior))
    if not 0 < ones < n:
        return model
    model.rates = {name: Rates.of(rows, key, model.prior) for name, key in _keys().items()}
    seen = model.features(rows, "url")
    names = seen.schema["_f"].dataType.names
    cuts = [i / BINS for i in range(1, BINS)]
    found = seen.agg(*[F.percentile_approx(f"_f.{k}", cuts, 1000).alias(k) for k in names]).first()
    model.edges = {k: sorted(set(found[k])) for k in names}
    binned = cut_lineage(seen.select(model.bins().alias("_b"), "label").groupBy("_b", "label").count())

    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        graded = binned.select(
            "_b", (F.round((F.col("label") - p) * UNIT).cast("long") * F.col("count")).alias("g"),
            (F.round(p * (1 - p) * UNIT).cast("long") * F.col("count")).alias("h"))
        model.trees.append(_grown(model, graded, depth, rate))
    return model


def _grown(model: UrlModel, graded: DataFrame, depth: int, rate: float):
    """One tree: each level sums gradients by leaf, feature and bin, and splits where it gains most."""
    tree: list = [None]  # a heap: None open, ("split", name, bin) or a value
    names = list(model.edges)

    def place(node: int = 0) -> Column:
        if node < len(tree) and isinstance(tree[node], tuple):
            _, name, upto = tree[node]
            return F.when(F.col(f"_b.{name}") <= upto, place(2 * node + 1)).otherwise(place(2 * node + 2))
        return F.lit(node)

    def value(g: float, h: float) -> float:
        return rate * g / (h + UNIT)

    for level in range(depth):
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"_b.{k}").alias("b")) for k in names]))
        sums = graded.select(place().alias("node"), "g", "h", cells.alias("c")).groupBy("node", "c.f", "c.b").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        by: dict[int, dict[str, dict[int, tuple[int, int]]]] = {}
        for r in sums:
            by.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
        for node, features in sorted(by.items()):
            if node < len(tree) and isinstance(tree[node], float):
                continue
            tree.extend([None] * (2 * node + 3 - len(tree)))
            any_feature = next(iter(features.values()))
            g_all, h_all = (sum(v[i] for v in any_feature.values()) for i in (0, 1))
            best = (1e-6 * UNIT, None)
            for k in names:
                g = h = 0
                for b in sorted(features[k])[:-1]:
                    g, h = g + features[k][b][0], h + features[k][b][1]
                    gain = g * g / (h + UNIT) + (g_all - g) ** 2 / (h_all - h + UNIT) - g_all ** 2 / (h_all + UNIT)
                    if gain > best[0]:
                        best = (gain, (k, b, g, h))
            if best[1] is None:
                tree[node] = value(g_all, h_all)
                continue
            k, b, g, h = best[1]
            tree[node] = ("split", k, b)
            tree[2 * node + 1], tree[2 * node + 2] = value(g, h), value(g_all - g, h_all - h)
            if level + 1 < depth:  # open leaves keep their value until they split
                tree[2 * node + 1], tree[2 * node + 2] = Open(tree[2 * node + 1]), Open(tree[2 * node + 2])

    def nested(node: int):
        x = tree[node]
        if isinstance(x, tuple):
            return (x[1], x[2], nested(2 * node + 1), nested(2 * node + 2))
        return x.value if isinstance(x, Open) else x

    return nested(0)


@dataclass(frozen=True)
class Open:
    """A leaf that may still split, and its value if it doesn't."""

    value: float


def judged(urls: DataFrame, rules: list[UrlRule], model: UrlModel, url_col: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits), ``block_score`` and ``verdict``.

    The verdict is the longest rule's, else ``block`` from a score of 0.5 on, else
    ``allow``.  Null, empty or malformed URLs have an empty host and path, fit no rule and
    are scored like any other.  Columns of these names are replaced, others stay.
    """
    made = ("host", "path", "rule", "block_score", "verdict", "_f", "_b")
    parts = with_parts(urls.drop(*[c for c in made if c != url_col]), url_col)
    text, verdict = rule_of(rules, F.col("host"), F.col("path"))
    scored = model.features(parts, url_col).withColumn("_b", model.bins()) if model.edges else parts
    score = 1 / (1 + F.exp(-model.margin()))
    return scored.withColumn("block_score", score).withColumns({
        "rule": text,
        "verdict": F.coalesce(verdict, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))}).drop("_f", "_b")
