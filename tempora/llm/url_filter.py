"""URL filters: exact host and path rules first, gradient-boosted trees on lexical features for the rest.

Features of a URL: its length, path depth, share of digits, entropy of its characters, number of query parameters, host
labels and hyphens, and statistics of its suffix (the host's last two labels): how many labelled URLs have it and the smoothed
share of them that is blocked. They are counted on all distinct labelled URLs; the trees are trained on a sample of these; all features are built-in functions.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "suffix_seen", "suffix_blocked"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule whose host is the URL's or a parent of it and whose path starts the URL's; null if none fits."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""

    def over(chars: Column) -> Column:
        n = F.size(chars)
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - let(share(c), lambda p: p * F.log2(p)))

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(F.split(text, ""), lambda x: over(F.filter(x, lambda c: c != ""))))


def lexical_features(urls: DataFrame) -> DataFrame:
    """urls (with ``url``) and host, path, suffix and the lexical features, suffix statistics aside. A null URL is an empty one."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    count = lambda text, chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    found = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return found.select(
        *urls.columns, "host", "path", F.substring_index(host, ".", -2).alias("suffix"), F.length(url).cast("double").alias("length"), count(path, "/").alias("depth"),
        (count(url, "0123456789") / F.greatest(F.length(url), F.lit(1))).alias("digits"), entropy(url).alias("entropy"), count(F.regexp_extract(url, r"\?([^#]*)", 1), "=").alias("parameters"),
        count(host, ".").alias("labels"), count(host, "-").alias("hyphens"),
    )


def _with_suffixes(features: DataFrame, suffixes: DataFrame, mean: float) -> DataFrame:
    joined = features.join(suffixes, "suffix", "left")
    return joined.withColumn("suffix_seen", F.log1p(F.coalesce("suffix_n", F.lit(0)).cast("double"))).withColumn("suffix_blocked", F.coalesce("suffix_rate", F.lit(mean))).drop("suffix_n", "suffix_rate")


def train(labelled: DataFrame, max_labelled: int = 20_000, trees: int = 10, depth: int = 3, smoothing: float = 20.0) -> tuple[PipelineModel, DataFrame, float] | None:
    """Fit on at most ``max_labelled`` of the distinct labelled URLs (columns url and blocked 0/1), taken by a hash of the URL.

    Returns the model, the suffix statistics (a row for each suffix of all distinct labelled URLs) and those URLs' blocked share; None if
    the sample does not have both labels.
    """
    labels = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select("url", F.col("blocked").cast("double").alias("blocked")).distinct()
    labels = written(labels.select("url", "blocked", F.substring_index(host_of(F.col("url")), ".", -2).alias("suffix")), "url-labels")
    sample = labels.select("url", "blocked", F.xxhash64("url").alias("_h")).orderBy("_h", "url", "blocked").limit(max_labelled).drop("_h")
    features = written(lexical_features(sample), "url-sample")
    n, sampled = features.agg(F.count("*"), F.avg("blocked")).first()
    if not n or sampled in (0.0, 1.0):
        return None
    mean = labels.agg(F.avg("blocked")).first()[0]
    rate = (F.sum("blocked") + F.lit(smoothing * mean)) / (F.count("*") + F.lit(smoothing))
    suffixes = written(labels.groupBy("suffix").agg(F.count("*").alias("suffix_n"), rate.alias("suffix_rate")), "url-suffixes")
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="_features"), GBTClassifier(labelCol="blocked", featuresCol="_features", maxIter=trees, maxDepth=depth, seed=7, cacheNodeIds=False)]
    return Pipeline(stages=stages).fit(_with_suffixes(features, suffixes, mean)), suffixes, mean


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, threshold: float = 0.5, **options) -> DataFrame:
    """page_id, url, host, path, rule, verdict and score (the trees' probability that the URL is to be blocked) of every page.

    labelled: url and blocked (0/1); by default the pages' own URLs that a rule decides, so the trees carry the rules' verdicts over
    to URLs like them. The longest fitting rule decides; else ``block`` from the threshold on. If there is nothing to learn from,
    scores are null and undecided URLs are allowed. Null URLs have empty host and path. Repeated rows are judged alike.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    features = lexical_features(urls).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = features.filter("_rule is not null").select("url", (F.col("_rule.verdict") == "block").cast("int").alias("blocked"))
    trained = train(labelled, **options)
    if trained:
        model, suffixes, mean = trained
        features = model.transform(_with_suffixes(features, suffixes, mean)).withColumn("score", vector_to_array("probability")[1])
    else:
        features = features.withColumn("score", F.lit(None).cast("double"))
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return features.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "score")
