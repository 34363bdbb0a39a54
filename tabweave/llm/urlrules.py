"""URL filtering by association rules.

Explicit rules (a host with its subdomains, and a path prefix) judge what they fit, the longest first. They also label
urls where no labels are given: FP-growth mines the labelled urls' token sets (host labels by level, path segments by
level with numbers folded, query names) for combinations that go with a label. A rule is kept if at least `COUNT` urls and
`SUPPORT` of all have it, if the lower limit of Wilson's interval for its confidence is at least `CONFIDENCE`, and if no
part of its combination says the same with no lower limit less. Other urls are judged by the mined rules through an
inverted index: each rule is listed under the token that the fewest rules have, a url looks up its own tokens only and
tests the rules found there; the rule with the highest limit, then support, then the shortest wins. No rule: allow.

What bounds the mining: tokens that the same urls have are one item (they make the same rules); of a url the `WIDTH` items
that tell most about the label are mined, and rules have at most `LENGTH` of them. So there are at most
(C(WIDTH, 1) + .. + C(WIDTH, LENGTH)) / SUPPORT rules, 29,800 here, whatever the number of urls; they are collected and sent
to the workers, and judging shuffles nothing. Rules on other combinations aren't looked for: WIDTH and LENGTH are
parameters of the method.

Edge cases: null urls and urls without "://" have empty host, path and token sets; very long urls are taken as a whole;
empty tables give empty tables; with no labelled url nothing is mined; repeated rows are judged alike and count as often as
they occur; tied rules are ordered by their verdict, then tokens; other columns pass through, and those named host, path,
rule or verdict get underscores after their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SUPPORT, COUNT, CONFIDENCE, WIDTH, LENGTH = 0.01, 5, 0.9, 12, 3
#: Fixed value: the normal quantile of a two-sided interval of 95 percent.
Z = 1.96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM = "label:"


@dataclass(frozen=True)
class HostRule:
    """`text` is host/path: fits the host and its subdomains where the url's path starts with /path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    verdict: str
    limit: float
    support: float


def host(url: str):
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: str):
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: str, host_col: str, path_col: str):
    """Distinct tokens of a url: host labels from the right, path segments from the left, names in the query."""
    labels = F.reverse(F.split(host_col, r"\."))
    segments = F.filter(F.split(F.regexp_replace(path_col, "[0-9]+", "0"), "/"), lambda s: s != "")
    query = F.filter(F.split(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)\?([^#]*)", 1), "&"), lambda s: s != "")
    numbered = lambda kind, items: F.transform(items, lambda s, i: F.concat(F.lit(kind), i.cast("string"), F.lit(":"), s))
    found = F.concat(numbered("h", F.filter(labels, lambda s: s != "")), numbered("p", segments), F.transform(query, lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1))))
    return F.array_distinct(found)


def explicit(rules: list[HostRule], host_col: str, path_col: str):
    """A struct (rule, verdict) of the longest rule that fits; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
        fits = ((F.col(host_col) == r.host) | F.col(host_col).endswith("." + r.host)) & F.col(path_col).startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def wilson(hits: float, n: float) -> float:
    """The lower limit of Wilson's interval for a share of hits in n."""
    share, z2 = hits / n, Z * Z
    return (share + z2 / (2 * n) - Z * sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def itemsets(labelled: DataFrame, scratch: Scratch, least: float, width: int) -> DataFrame:
    """(items, label): of each row (tokens array, label) the `width` items that tell most about the label.

    An item stands for all tokens that exactly the same rows have; tokens of fewer than `least` rows are in no rule.
    """
    rows = scratch.write(labelled.select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "label"), "labelled")
    each = rows.select("row", "label", F.explode("tokens").alias("token"))
    mark = lambda k: F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)"))
    known = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("hits"), mark(1).alias("a"), mark(2).alias("b")).where(F.col("n") >= least)
    share = rows.agg(F.coalesce(F.avg((F.col("label") == "block").cast("double")), F.lit(0.0)).alias("share"))
    known = known.groupBy("n", "hits", "a", "b").agg(F.min("token").alias("token")).crossJoin(F.broadcast(share))  # one row
    told = scratch.write(known.select("token", (F.pow(F.col("hits") - F.col("n") * F.col("share"), 2) / F.col("n")).alias("told")), "told")
    best = Window.partitionBy("row").orderBy(F.desc("told"), "token")
    items = each.join(told, "token").withColumn("k", F.row_number().over(best)).where(F.col("k") <= width)
    return items.groupBy("row", "label").agg(F.collect_list("token").alias("items")).select("items", "label")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, count: int = COUNT, width: int = WIDTH, length: int = LENGTH) -> list[MinedRule]:
    """Rules from (tokens array, label): at most as many as width, length and support allow."""
    from pyspark.ml.fpm import FPGrowth

    scratch = Scratch(labelled.sparkSession, "urlrules")
    labelled = scratch.write(labelled.where("label is not null and size(tokens) > 0").select("tokens", "label"), "known")
    n = labelled.count()
    if not n:
        return []
    least = max(support, count / n)
    items = scratch.write(itemsets(labelled, scratch, least * n - 1e-9, width), "items")
    if least > 1 or items.isEmpty():
        return []
    share = min(1.0, least * n / items.count())  # rows without frequent tokens are no items
    model = FPGrowth(itemsCol="items", minSupport=max(share - 1e-12, 0.0)).fit(items.select(F.array_append("items", F.concat(F.lit(_ITEM), "label")).alias("items")))
    sets = scratch.write(model.freqItemsets.where(F.size("items") <= length + 1).select(F.filter("items", lambda i: ~i.startswith(_ITEM)).alias("tokens"), F.filter("items", lambda i: i.startswith(_ITEM)).alias("label"), "freq"), "sets")
    sets = sets.select(F.array_sort("tokens").alias("tokens"), F.get("label", F.lit(0)).alias("label"), "freq").where(F.size("tokens") > 0)
    alone = sets.where("label is null").select("tokens", F.col("freq").alias("n"))
    told = sets.where("label is not null").join(alone, "tokens")  # a rule's urls are frequent, so its tokens are
    share, z2 = F.col("freq") / F.col("n"), Z * Z
    limit = (share + z2 / (2 * F.col("n")) - Z * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
    told = scratch.write(told.withColumn("limit", limit).where(F.col("limit") >= confidence).where(F.size("tokens") <= length), "told_rules")
    # without rules of which a part says the same with no lower limit less: every rule's parts of one token fewer, up from the shortest
    part = told.select("tokens", "label", "limit", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
    short = told.select(F.col("tokens").alias("part"), "label", F.col("limit").alias("of"))
    parts = part.join(short, ["part", "label"])
    if length > 2:  # parts of two tokens fewer as well
        for _ in range(length - 2):
            part = part.select("tokens", "label", "limit", F.explode(F.transform("part", lambda t: F.array_remove("part", t))).alias("part")).where(F.size("part") > 0).distinct()
            parts = parts.unionByName(part.join(short, ["part", "label"]))
    worse = parts.where(F.col("of") >= F.col("limit")).select("tokens", "label").distinct()
    kept = told.join(worse, ["tokens", "label"], "left_anti").collect()  # bounded, see above
    return sorted((MinedRule(tuple(r.tokens), r.label.removeprefix(_ITEM), r["limit"], r.freq / n) for r in kept), key=lambda r: (len(r.tokens), r.tokens, r.verdict))


def inverted(rules: list[MinedRule]) -> dict[str, list[MinedRule]]:
    """Each rule under the token that the fewest rules have."""
    often = Counter(t for r in rules for t in r.tokens)
    out: dict[str, list[MinedRule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (often[t], t)), []).append(r)
    return out


def best(index: dict[str, list[MinedRule]], tokens) -> str | None:
    """The verdict of the best rule whose tokens are all there."""
    own = set(tokens)
    fit = [(r.limit, r.support, -len(r.tokens), r.verdict, r.tokens) for t in own for r in index.get(t, ()) if own.issuperset(r.tokens)]
    return max(fit)[3] if fit else None


def matched(rules: list[MinedRule], tokens_col: str):
    """The verdict of the best mined rule whose tokens a url has; else null."""
    if not rules:
        return F.lit(None).cast("string")
    index = inverted(rules)

    @F.pandas_udf("string")
    def look_up(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: best(index, t))

    return look_up(tokens_col)


def judge(pages: DataFrame, rules: list[HostRule], url_col: str = "url", labels: DataFrame | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE, count: int = COUNT) -> DataFrame:
    """The rows with host, path, rule and verdict. labels: (url, label) to mine; by default the urls that explicit rules fit."""
    result = ("host", "path", "rule", "verdict")
    names = [f"c{k}" for k in range(len(pages.columns))]
    free = list(pages.columns)
    for k, c in enumerate(free):
        while free[k] in result or (free[k] != c and free[k] in pages.columns):
            free[k] += "_"

    def taken(df: DataFrame, url: str) -> DataFrame:
        return df.withColumn("host", host(url)).withColumn("path", path(url)).withColumn("tokens", tokens(url, "host", "path")).withColumn("fit", explicit(rules, "host", "path"))

    known = taken(pages.select(F.col(url_col).alias("url")) if labels is None else labels.select("url", "label"), "url")
    known = known.withColumn("label", F.col("fit")["verdict"]) if labels is None else known
    mined = mine(known.select("tokens", "label"), support, confidence, count)
    judged = taken(pages.toDF(*names), names[pages.columns.index(url_col)])
    judged = judged.withColumn("rule", F.col("fit")["rule"]).withColumn("verdict", F.coalesce(F.col("fit")["verdict"], matched(mined, "tokens"), F.lit("allow")))
    return judged.select(*[F.col(n).alias(c) for n, c in zip(names, free, strict=True)], *result)
