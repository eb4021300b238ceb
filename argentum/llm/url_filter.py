"""Operator 7: URL verdicts from rules and from a logistic regression on character n-grams.

Everything is DataFrame expressions: a url's host and path are cut out by one
pattern each, their three-character windows are hashed into buckets, and the
score is the sum of the buckets' weights.  Training is one expression as well, a
nested fold over the labelled table (a few hundred rows at most) that applies a
gradient step per row; its one result row, the weights, becomes a literal.

Null urls and urls without ``://`` have an empty host and path; no rule fits
them, so the model judges the empty strings.  Digits count as one character to
the model.  Repeated rows give repeated results; a null page id stays null; other
columns are ignored.  Urls of any length are judged whole.

A fifth of the labelled hosts, by checksum, is held out of training.
"""

from __future__ import annotations

import csv
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.storage import table

#: (verdict, host, path prefix); the longest rule that fits wins.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: The labelled table: 1 for the urls of unwanted sites, 0 for ordinary ones; one url to a host.
LABELLED = Path(__file__).parent / "data" / "labelled_urls.tsv"

BUCKETS, EPOCHS, RATE, DECAY = 1024, 15, 1.0, 1e-5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without a scheme."""
    pattern = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower()), F.regexp_extract(url, pattern, 2)


def buckets(host: Column, path: Column) -> Column:
    """Distinct bucket numbers of the n-grams of host and path, each marked with where it stems from."""
    digits = F.translate(path, "0123456789", "0000000000")

    def grams(s: Column, mark: str) -> Column:
        found = F.regexp_extract_all(F.concat(F.lit("^"), s, F.lit("$")), F.lit(r"(?s)(?=(...))"), F.lit(1))
        return F.transform(found, lambda g: F.pmod(F.xxhash64(F.concat(F.lit(mark), g)), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(grams(F.translate(host, "0123456789", "0000000000"), "h"), grams(digits, "p")))


def train(labelled: DataFrame) -> list[float]:
    """Weights, the last one the bias, from (url, label); fitted by one fold over the rows, in url order."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where(F.col("label").isNotNull()).select(F.col("label").cast("double").alias("y"), "url", buckets(host, path).alias("f"))
    # a dense row, scaled to unit length, with a constant for the bias
    spread = F.sqrt(F.greatest(F.size("f"), F.lit(1)).cast("double"))
    counted = rows.select("y", "url", F.explode_outer("f").alias("b"), spread.alias("spread")).groupBy("y", "url", "spread", "b").agg(F.count("*").alias("n"))
    sparse = counted.groupBy("y", "url", "spread").agg(F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "n")))).alias("m"))
    dense = F.concat(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)) / F.col("spread")), F.array(F.lit(1.0)))
    ordered = sparse.select("url", "y", dense.alias("x")).agg(F.sort_array(F.collect_list(F.struct(F.md5("url").alias("o"), "y", "x"))).alias("rows"))

    def step(w: Column, row: Column) -> Column:
        z = F.aggregate(F.zip_with(w, row["x"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        pull = F.array(F.lit(RATE) * (row["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))  # one element, so that it is computed once
        return F.aggregate(pull, w, lambda kept, g: F.zip_with(kept, row["x"], lambda a, b: a * F.lit(1.0 - DECAY) + g * b))

    start = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    epochs = F.sequence(F.lit(1), F.lit(EPOCHS))
    fitted = ordered.select(F.aggregate(epochs, start, lambda w, _: F.aggregate(F.col("rows"), w, step)).alias("w"))
    return list(fitted.head().w)


def probability(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability that a url is unwanted."""
    w = F.array(*map(F.lit, weights[:-1]))
    f = buckets(host, path)
    total = F.aggregate(f, F.lit(0.0), lambda acc, b: acc + F.get(w, b))
    z = F.lit(weights[-1]) + total / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, rule verdict) of the longest rule that fits, else null."""
    rule = verdict = None
    for kind, domain, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule = F.when(fits, domain + prefix) if rule is None else rule.when(fits, domain + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def judge_urls(pages: DataFrame, weights: list[float], key: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, p_block) of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"))
    rows = rows.select(key, "host", "path", rule.alias("rule"), verdict.alias("by_rule"), probability(F.col("host"), F.col("path"), weights).alias("p_block"))
    by_model = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return rows.select(key, "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "p_block")


def labelled_table(spark: SparkSession) -> DataFrame:
    """(url, label, held_out) of the labelled table, some hundred rows."""
    with LABELLED.open(newline="") as f:
        rows = [(r["url"], int(r["label"])) for r in csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE)]
    hosts = [u.partition("://")[2].partition("/")[0] for u, _ in rows]
    return spark.createDataFrame([(u, y, h != "" and zlib.crc32(h.encode()) % 5 == 0) for (u, y), h in zip(rows, hosts)], "url string, label int, held_out boolean")


def production_weights(spark: SparkSession) -> list[float]:
    return train(labelled_table(spark).where("NOT held_out").select("url", "label"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), production_weights(spark)).drop("p_block")
