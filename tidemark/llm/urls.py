"""URL verdicts: longest fitting host and path rule, else gradient-boosted trees over lexical features."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, no_null, written


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed values of the contract.
RULES = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"),
         UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/")]
#: Trees are fitted on at most so many labelled addresses, the first by hash.
MAX_LABELLED = 20_000
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphens", "entropy",
            "parameters", "has_fragment", "suffix_rate", "domain_rate"]


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path: empty for null and for an address without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = no_null(url)
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def fitting_rule(rules: list[UrlRule] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits ``host`` and ``path``; null where none does."""
    out = F.lit(None)
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        host = F.concat(F.lit("."), "host").endswith("." + rule.host)
        fits = host & F.col("path").startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    size = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    bits = F.transform(F.array_distinct(F.split(text, "")), lambda c: let(share(c), lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))
    return F.when(F.length(text) > 0, F.aggregate(bits, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def _lexical(addresses: DataFrame) -> DataFrame:
    url = F.col("address")
    count = lambda text, mark: (F.length(text) - F.length(F.translate(text, mark, ""))).cast("double")
    return addresses.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "depth": count(F.col("path"), "/"),
        "host_labels": count(F.col("host"), ".") + 1, "hyphens": count(F.col("host"), "-"),
        "digit_ratio": F.when(F.length(url) > 0, count(url, "0123456789") / F.length(url)).otherwise(0.0),
        "entropy": _entropy(url), "parameters": F.regexp_count(url, F.lit("[?&][^=&#]*=")).cast("double"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
        "domain": F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1),
    })


def _rates(labelled: DataFrame, key: str) -> DataFrame:
    """Smoothed share of blocked labels of a host ending: one row an ending of the bounded sample."""
    return labelled.groupBy(key).agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias(f"{key}_rate"))


def judged_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[UrlRule] = RULES,
                max_labelled: int = MAX_LABELLED, rounds: int = 10, depth: int = 4) -> DataFrame:
    """``key``, host, path, rule and verdict of every row, and ``block_score`` where the trees decided.

    The labelled addresses are those a rule fits; the trees learn from at most ``max_labelled`` of them (the first by
    hash of the address) and judge the rest. Where the labels hold one class only, that class is the verdict of all
    (without any label: allow). A null or malformed address has an empty host and path, fits no rule and is judged by
    its features. Repeated rows stay; other columns are not looked at; an empty table gives no rows.
    """
    host, path = parts(url)
    base = pages.select(F.col(f"`{key}`").alias("key"), no_null(url).alias("address"), host.alias("host"), path.alias("path"))
    ruled = base.withColumn("fit", fitting_rule(rules))
    labelled = (ruled.filter("fit is not null").select("address", "host", "path", (F.col("fit.verdict") == "block").cast("double").alias("label"))
                .withColumn("draw", F.xxhash64(F.lit(42), "address")).orderBy("draw", "address").limit(max_labelled).drop("draw"))
    labelled = written(labelled, "url-labels")
    classes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    features = _lexical(ruled)
    if len(classes) < 2:
        only = "block" if classes.get(1.0) else "allow"
        judged = features.withColumn("block_score", F.lit(None).cast("double")).withColumn("guess", F.lit(only))
    else:
        described = _lexical(labelled)
        suffixes, domains = written(_rates(described, "suffix"), "url-suffix"), written(_rates(described, "domain"), "url-domain")
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")

        def vectors(frame: DataFrame) -> DataFrame:
            known = frame.join(suffixes, "suffix", "left").join(domains, "domain", "left")
            return assembler.transform(known.fillna(0.5, ["suffix_rate", "domain_rate"]))

        train = written(vectors(described).select("features", "label"), "url-train")
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=42, maxBins=32).fit(train)
        from pyspark.ml.functions import vector_to_array

        judged = (model.transform(vectors(features))
                  .withColumn("block_score", F.when(F.col("fit").isNull(), vector_to_array("probability")[1]))
                  .withColumn("guess", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")))
    return judged.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce("fit.verdict", "guess").alias("verdict"), "block_score")
