"""URL filters: explicit rules first, then gradient-boosted trees on lexical features of the URL.

A rule ``host/path`` fits its host and all subdomains if the URL's path starts with the rule's path; the longest fitting rule decides. All other
URLs get the verdict of boosted trees over length, depth, digit ratio, entropy, parameter counts and suffix statistics, trained from labelled
URLs, of which a bounded sample is taken. Everything is a DataFrame expression or Spark's own learner.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are scored by the same features. Repeated rows and ids are judged
one by one. Without labels of both kinds nothing can be learnt and the verdict of URLs without a rule is allow. An empty table gives an
empty result. Only id and URL are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import draw, saved

# The rules of the query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
# Words of hosts that were reported for blocking: the seed of the labelled URLs.
REPORTED = ("adult", "ads", "bets", "casino", "pills", "spam")
SAMPLE, ROUNDS, DEPTH = 20_000, 8, 3
FEATURES = (
    "url_length", "host_length", "host_depth", "path_length", "path_depth", "digit_ratio", "host_digit_ratio", "host_entropy", "url_entropy",
    "n_params", "n_hyphens", "longest_label", "suffix_share", "suffix_block_share",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of its characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


@dataclass(frozen=True)
class UrlModel:
    """Trees and the suffix table; ``trees`` is None when there was nothing to learn."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None


def lexical(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with _host, _path, _suffix and the features that need no statistics; ``urls`` has no columns that begin with _."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(F.col(url_col))
    out = urls.withColumn("_host", host).withColumn("_path", path).withColumn("_suffix", F.regexp_extract("_host", r"[^.]*$", 0))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = {
        "url_length": F.length(url), "host_length": F.length("_host"), "host_depth": F.size(F.split("_host", r"\.")),
        "path_length": F.length("_path"), "path_depth": F.size(F.filter(F.split("_path", "/"), lambda p: p != "")),
        "digit_ratio": _ratio(_digits(url), F.length(url)), "host_digit_ratio": _ratio(_digits(F.col("_host")), F.length("_host")),
        "host_entropy": _entropy(F.col("_host")), "url_entropy": _entropy(url),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
        "n_hyphens": F.length("_host") - F.length(F.translate("_host", "-", "")),
        "longest_label": F.array_max(F.transform(F.split("_host", r"\."), F.length)),
    }
    return out.withColumns({f"_{k}": v.cast("double") for k, v in names.items()})


def _with_suffixes(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    joined = rows.join(suffixes, "_suffix", "left")
    return joined.fillna(0.0, ["_suffix_share"]).fillna(0.5, ["_suffix_block_share"])


def train(urls: DataFrame, labelled: DataFrame, url_col: str = "url", sample: int = SAMPLE, rounds: int = ROUNDS, depth: int = DEPTH) -> UrlModel:
    """Learn from ``labelled`` (url, blocked: 0 or 1), about ``sample`` rows at most; suffix shares come from all ``urls`` and labels."""
    known = labelled.filter(F.col("blocked").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("blocked").count().collect()}
    if set(sizes) != {0, 1}:
        return UrlModel(None, None)
    total = urls.count()
    host = host_and_path(F.col(url_col))[0]
    seen = urls.groupBy(F.regexp_extract(host, r"[^.]*$", 0).alias("_suffix")).agg((F.count("*") / total).alias("_suffix_share"))
    told = known.groupBy(F.regexp_extract(host_and_path(F.col("url"))[0], r"[^.]*$", 0).alias("_suffix"))
    told = told.agg(((F.sum("blocked") + 1.0) / (F.count("*") + 2.0)).alias("_suffix_block_share"))
    suffixes = saved(seen.join(told, "_suffix", "left"))
    # an equal share of either label, so that rare ones are not lost in a large corpus
    chance = reduce(lambda c, y: c.when(F.col("blocked") == y, sample / 2 / sizes[y]), (0, 1), F.when(F.lit(False), 0.0))
    rows = known.filter(draw("urls", "url") < chance)
    ready = _with_suffixes(lexical(rows.select(F.col("url").alias(url_col), F.col("blocked").cast("double").alias("label")), url_col), suffixes)
    ready = saved(ready.select("label", *[f"_{f}" for f in FEATURES]).repartition(4))
    assembled = VectorAssembler(inputCols=[f"_{f}" for f in FEATURES], outputCol="_x").transform(ready)
    return UrlModel(GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7).fit(assembled), suffixes)


def judge(urls: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """id, host, path, rule, verdict and block_score (0 to 1, null without a model)."""
    rows = lexical(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    rows = rows.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    if model.trees is None:
        scored = rows.withColumn("_score", F.lit(None).cast("double"))
    else:
        ready = _with_suffixes(rows, model.suffixes)
        assembled = VectorAssembler(inputCols=[f"_{f}" for f in FEATURES], outputCol="_x").transform(ready)
        scored = model.trees.transform(assembled).withColumn("_score", vector_to_array("probability")[1])
    own = F.when(F.col("_score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", own).alias("verdict"), F.col("_score").alias("block_score"),
    )


def labelled_urls(urls: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, reported: tuple[str, ...] = REPORTED) -> DataFrame:
    """(url, blocked): reported hosts are blocked ones, other URLs that a rule allows are good ones."""
    host, path = host_and_path(F.col(url_col))
    bad = host.rlike(r"(^|[.-])(" + "|".join(reported) + r")([.-]|$)")
    good = rule_of(host, path, rules)["verdict"] == "allow"
    return urls.select(F.col(url_col).alias("url"), F.when(bad, 1).when(good, 0).alias("blocked")).filter("blocked IS NOT NULL")
