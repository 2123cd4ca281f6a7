"""URL verdicts by rules, and by boosted trees on lexical features where no rule fits; DataFrame functions only.

The rules' own verdicts are the labels. Trees grow level by level: one aggregate a level counts gradients by node, feature and bin,
only that small histogram reaches the driver, and the model is an expression over feature columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import materialise

#: (verdict, host and path) of the production rules.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Labelled URLs that the trees learn from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH, FOLDS = 8, 3, 16, 0.4, 10.0, 5
#: Gradients are summed as whole numbers, so their sums don't depend on the order of rows.
UNIT = 1 << 20

NUMBERS = ["length", "host_length", "path_length", "host_depth", "path_depth", "parameters", "hyphens", "digit_ratio", "entropy"]
#: Parts of a URL whose share of blocked URLs is a feature.
TOKENS = ["suffix", "domain", "directory", "extension"]


def host_of(url: Column) -> Column:
    """What stands behind the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """urls (host, path) with (rule, ruling): the longest rule that fits, and its verdict; null where none does.

    A rule is a verdict and a host with the start of a path; it fits the host and its subdomains. Of equally long ones that with the
    longer host counts. Rules are part of the plan: hundreds of them, not millions.
    """
    split = [(verdict, *part.partition("/")) for verdict, part in rules]
    known = sorted(((host, slash + rest, verdict) for verdict, host, slash, rest in split), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    host, path = F.col("host"), F.col("path")
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in known]

    def first(values: list[str]) -> Column:
        return F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))

    return urls.withColumn("rule", first([h + p for h, p, _ in known])).withColumn("ruling", first([v for _, _, v in known]))


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with NUMBERS and TOKENS. A null URL is empty; ratios of an empty one are 0."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    params = F.split(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), "&")
    labels = F.array_remove(F.split("host", "\\."), "")
    steps = F.array_remove(F.split("path", "/"), "")

    def share(c: Column) -> Column:
        return (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n

    return urls.select(
        "*",
        F.length(url).cast("double").alias("length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.size(labels).cast("double").alias("host_depth"), F.size(steps).cast("double").alias("path_depth"), F.size(F.array_remove(params, "")).cast("double").alias("parameters"),
        (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_ratio"),
        F.round(F.aggregate(F.array_remove(F.array_distinct(F.split(url, "")), ""), F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c))), 9).alias("entropy"),
        F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")).alias("suffix"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.coalesce(F.get(steps, F.lit(0)), F.lit("")).alias("directory"), F.regexp_extract("path", "\\.([^./]*)$", 1).alias("extension"),
    )


@dataclass
class Trees:
    """A prior and boosted trees. A tree is a leaf's value or (feature, bound, tree up to the bound, tree above it)."""

    prior: float
    trees: list = field(default_factory=list)

    def margin(self) -> Column:
        def value(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, bound, low, high = tree
            return F.when(F.col(name) <= bound, value(low)).otherwise(value(high))

        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for t in self.trees:
            out = out + value(t)
        return out

    def blocked(self) -> Column:
        """Probability that a row of features is blocked."""
        return 1 / (1 + F.exp(-self.margin()))


def rates(labelled: DataFrame, prior: float) -> dict[str, DataFrame]:
    """{token: (token, fold, rate, whole)}: smoothed shares of blocked URLs, whole of all rows, rate without those of the fold.

    Each table has at most FOLDS rows a labelled URL of the sample.
    """
    out = {}
    for t in TOKENS:
        folds = labelled.groupBy(t, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b"))
        every = folds.groupBy(t).agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
        spread = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold")).join(folds, [t, "fold"], "left").na.fill(0, ["n", "b"])

        def smooth(b: Column, n: Column) -> Column:
            return (b + SMOOTH * prior) / (n + SMOOTH)

        out[t] = spread.select(t, "fold", smooth(F.col("all_b") - F.col("b"), F.col("all_n") - F.col("n")).alias("rate"), smooth(F.col("all_b"), F.col("all_n")).alias("whole"))
    return out


def binned_features(cuts: dict[str, list[float]]) -> Column:
    """(feature, bin) of every feature: how many of its cuts lie below its value."""
    def below(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[name]]), lambda c: c < F.col(name)))

    return F.array(*[F.struct(F.lit(k).alias("feature"), below(name).alias("bin")) for k, name in enumerate(cuts)])


def grown(binned: DataFrame, model: Trees, cuts: dict[str, list[float]]) -> object:
    """One more tree for binned (y, n, bins, features), level by level."""
    p = model.blocked()
    base = binned.select(*cuts, "bins", F.round((F.col("y") - p) * UNIT).cast("long").alias("g"), F.round(p * (1 - p) * UNIT).cast("long").alias("h"), "n")
    names, splits, leaves = list(cuts), {}, {1: 0.0}
    for depth in range(DEPTH):
        node = F.lit(1)
        for _ in range(depth):
            node = stepped(node, splits)
        counted = base.select(node.alias("node"), "g", "h", "n", F.explode("bins").alias("x")).groupBy("node", "x.feature", "x.bin").agg(F.sum(F.col("g") * F.col("n")).alias("g"), F.sum(F.col("h") * F.col("n")).alias("h"))
        # At most nodes x features x bins rows.
        rows = [r for r in counted.collect() if r["node"] in leaves]
        for at in sorted({r["node"] for r in rows}):
            choice = best_split([r for r in rows if r["node"] == at], cuts, names)
            if choice:
                name, bound, low, high = choice
                splits[at] = (name, bound)
                del leaves[at]
                leaves[2 * at], leaves[2 * at + 1] = low, high

    def tree(at: int):
        return (*splits[at], tree(2 * at), tree(2 * at + 1)) if at in splits else leaves[at]

    return tree(1)


def stepped(node: Column, splits: dict) -> Column:
    """The child of a node that a row goes to."""
    out = node
    for at, (name, bound) in splits.items():
        out = F.when(node == at, F.when(F.col(name) <= bound, 2 * at).otherwise(2 * at + 1)).otherwise(out)
    return out


def best_split(rows: list, cuts: dict[str, list[float]], names: list[str]) -> tuple | None:
    """(feature, bound, value below, value above) of the largest gain, the first of equal ones; None if nothing is gained."""
    best = None
    for k, name in enumerate(names):
        own = {r["bin"]: (r["g"], r["h"]) for r in rows if r["feature"] == k}
        all_g, all_h = sum(g for g, _ in own.values()), sum(h for _, h in own.values())
        g = h = 0
        for b, bound in enumerate(cuts[name]):
            g, h = g + own.get(b, (0, 0))[0], h + own.get(b, (0, 0))[1]
            if h < UNIT or all_h - h < UNIT:
                continue
            gain = g * g / (h + UNIT) + (all_g - g) ** 2 / (all_h - h + UNIT) - all_g**2 / (all_h + UNIT)
            if gain > (best[0] if best else 1e-6 * UNIT):
                best = (gain, name, bound, RATE * g / (h + UNIT), RATE * (all_g - g) / (all_h - h + UNIT))
    return best[1:] if best else None


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Trees, dict[str, DataFrame]]:
    """Trees and rates from labelled (page_id, url, host, path, y): y is 1 if blocked.

    At most `sample` rows teach, drawn by a hash, with all rows of a smaller table. Without rows of both labels there are no trees.
    """
    draw = F.xxhash64("page_id", "url")
    rows = labelled.count()
    some = labelled.where(F.pmod(draw, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * sample / max(rows, 1)))) if rows > sample else labelled
    some = some.orderBy(draw, "page_id", "url").limit(sample).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    some = materialise(lexical(some), "labelled")
    n, b = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (b + 0.5) / (n + 1)
    known = {t: materialise(r, f"rates-{t}") for t, r in rates(some, prior).items()}
    model = Trees(prior)
    if not 0 < b < n:
        return model, known
    for t in TOKENS:
        some = some.join(F.broadcast(known[t].select(t, "fold", F.col("rate").alias(f"{t}_rate"))), [t, "fold"])
    names = [*NUMBERS, *[f"{t}_rate" for t in TOKENS]]
    steps = [k / BINS for k in range(1, BINS)]
    found = some.agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in names]).first()
    cuts = {c: sorted(set(found[c])) for c in names}
    binned = materialise(some.groupBy("y", *names).agg(F.count(F.lit(1)).alias("n")).withColumn("bins", binned_features(cuts)), "binned")
    for _ in range(TREES):
        model.trees.append(grown(binned, model, cuts))
    return model, known


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages (page_id, url): `allow` or `block` by the longest rule that
    fits, else by the trees, which block above a score of one half.

    A null URL, and one without ://, has an empty host and path; null and repeated ids are judged row by row; other columns are
    ignored; without rows that rules label, or with one label only, the prior decides; an empty table gives no rows.
    """
    urls = ruled(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    model, known = fit(urls.where("ruling is not null").withColumn("y", (F.col("ruling") == "block").cast("int")).drop("rule", "ruling"), sample)
    rows = lexical(urls)
    for t in TOKENS:
        # At most a row a labelled URL of the sample.
        whole = F.broadcast(known[t].where("fold = 0").select(t, F.col("whole").alias(f"{t}_rate")))
        rows = rows.join(whole, t, "left").na.fill({f"{t}_rate": model.prior})
    rows = rows.withColumn("score", model.blocked())
    learned = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruling", learned).alias("verdict"), "score")
