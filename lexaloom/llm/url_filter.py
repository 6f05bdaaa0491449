"""URL filter: host and path rules, and gradient-boosted trees on lexical features elsewhere (operator 7).

URLs that a rule decides are the labelled ones. The trees learn from about ``sample`` different labelled URLs and judge the URLs that no
rule fits. A count of the different labelled URLs gives a bound of their hash, below which the sample lies (to within the few percent
of the count): only the features of these are sent, so what reaches the driver doesn't grow with a table beyond the sample. Features: lengths, path
depth, digit ratio, character entropy, parameter counts, label counts and the smoothed log-odds of the host's
last two labels. Training is a few numpy histograms; the fitted trees become CASE expressions, so scoring stays in the JVM.

Results for special cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the
trees (its length counts as 0 if null); without labelled URLs of both kinds all the others get the verdict that exists, or ``allow``;
repeated rows are judged alike and learned from once; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rule -> verdict; a rule is a host, and a path that begins with /.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "path_digits", "has_extension", "suffix_odds")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and rest (all behind ``://``)."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    return pages.withColumn("rest", rest).withColumn("host", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER)).withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))


def rule_for(rules: dict[str, str]) -> Column:
    """The longest rule that fits host and path, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.char_length(u)
    count = lambda col, what: F.char_length(col) - F.char_length(F.replace(col, F.lit(what), F.lit("")))
    digits = lambda col: F.regexp_count(col, F.lit("[0-9]"))
    # in order of the characters, so that equal counts add up alike
    shares = F.transform(F.array_sort(F.array_distinct(F.split(u, ""))), lambda c: (n - F.char_length(F.replace(u, c, F.lit("")))) / n)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.select(
        "*",
        n.cast("double").alias("url_length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"),
        F.char_length(query).cast("double").alias("query_length"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        F.when(n > 0, digits(u) / n).otherwise(0.0).alias("digit_ratio"),
        F.when(n > 0, F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0).alias("entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0).alias("n_params"),
        F.when(F.col("host") == "", 0.0).otherwise(count(F.col("host"), ".") + 1.0).alias("n_labels"),
        count(u, "-").cast("double").alias("n_hyphens"),
        digits(F.col("path")).cast("double").alias("path_digits"),
        F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double").alias("has_extension"),
        F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1).alias("suffix"),
    )


@dataclass
class Trees:
    """Binary logistic boosting; a tree is (feature, threshold, left, right) or a leaf value."""

    rounds: int = 30
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, step = self._grow(codes, cuts, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            score += step
            self.trees.append(tree)
        return self

    def _grow(self, codes, cuts, g, h, rows, depth):
        step = np.zeros(len(g))
        leaf = self.rate * float(g[rows].sum() / (h[rows].sum() + 1))
        best = (1e-6, None, None)
        if depth and len(rows) > 20:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(codes[rows, f], g[rows], len(c) + 1))
                hs = np.cumsum(np.bincount(codes[rows, f], h[rows], len(c) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), f, k)
        _, f, k = best
        if f is None:
            step[rows] = leaf
            return leaf, step
        low = codes[rows, f] <= k
        left, a = self._grow(codes, cuts, g, h, rows[low], depth - 1)
        right, b = self._grow(codes, cuts, g, h, rows[~low], depth - 1)
        return (f, float(cuts[f][k]), left, right), a + b

    def expression(self, names: tuple[str, ...]) -> Column:
        def one(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, cut, left, right = tree
            return F.when(F.col(names[f]) <= F.lit(cut), one(left)).otherwise(one(right))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + one(tree)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def one(tree, row) -> float:
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        total = np.array([self.base + sum(one(t, r) for t in self.trees) for r in x])
        return 1 / (1 + np.exp(-total))


def suffix_odds(suffixes: list[str], blocked: np.ndarray, least: int = 5) -> dict[str, float]:
    """Smoothed log-odds of being blocked for each suffix with ``least`` labelled URLs."""
    names, which = np.unique(np.array(suffixes, dtype=object).astype(str), return_inverse=True) if suffixes else (np.array([]), np.array([], int))
    n, b = np.bincount(which, minlength=len(names)), np.bincount(which, blocked, minlength=len(names))
    prior = (blocked.sum() + 1) / (len(blocked) + 2)
    p = (b + 10 * prior) / (n + 10)
    return {str(s): float(np.log(q / (1 - q))) for s, q, k in zip(names, p, n) if k >= least}


def _rows(pages: DataFrame, id_col: str, url_col: str, rules: dict[str, str]) -> DataFrame:
    rows = parts(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))).withColumn("rule", rule_for(rules))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    return lexical(rows.withColumn("said", said))


def hash_bound(total: int, sample: int) -> int:
    """The 64-bit hash below which ``sample`` of ``total`` lie."""
    return int((sample / total - 0.5) * 2**64)


def learn(rows: DataFrame, sample: int) -> tuple[Trees | None, dict[str, float], float]:
    """Trees, log-odds of suffixes, and the probability to give where there are no trees."""
    names = FEATURES[:-1]
    labelled = rows.where("said is not null").select("*", F.xxhash64("url").alias("h"))
    total = labelled.agg(F.approx_count_distinct("h")).first()[0]
    if total > sample:
        labelled = labelled.where(F.col("h") < F.lit(hash_bound(total, sample)))
    once = labelled.select((F.col("said") == "block").cast("double").alias("y"), "suffix", *names, "h", "url").dropDuplicates(["url"])
    picked = once.drop("url").toPandas().sort_values(["h", "suffix"], kind="stable")
    y = picked["y"].to_numpy()
    if len(set(y)) < 2:
        return None, {}, 1.0 if len(y) and y[0] else 0.0
    odds = suffix_odds(list(picked["suffix"]), y)
    x = np.column_stack([picked[list(names)].to_numpy(float), picked["suffix"].map(odds).fillna(0.0)])
    return Trees().fit(x, y), odds, 0.0


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES, sample: int = 20_000) -> DataFrame:
    """Per row: id, url, host, path, rule (or null), score (probability of block, null where a rule decides), verdict."""
    rows = _rows(pages, id_col, url_col, rules)
    model, odds, only = learn(rows, sample)
    if model is None:
        scored = rows.withColumn("p", F.lit(only))
    else:
        table = pages.sparkSession.createDataFrame(sorted(odds.items()) or [("", 0.0)], "suffix string, odds double")  # at most sample / 5 rows
        scored = rows.join(F.broadcast(table), "suffix", "left").withColumn("suffix_odds", F.coalesce("odds", F.lit(0.0))).withColumn("p", model.expression(FEATURES))
    free = F.col("said").isNull()
    return scored.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", F.when(free, F.col("p")).alias("score"), F.when(free, F.when(F.col("p") >= 0.5, "block").otherwise("allow")).otherwise(F.col("said")).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
