"""URL filters: stated rules by host and path, and association rules that FP-growth mines from labels.

Everything on the main path is DataFrame and SQL functions.

* ``split_url``: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from
  there up to ``?``, ``#`` or the end; both empty for null or where no ``://`` stands.
* Stated rules (``allow``/``block``, host/path): one fits its host and all subdomains if the url's path starts
  with the rule's path; the longest wins (host and path together, ties by text).
* Mined rules: url tokens (``h:`` host suffixes, ``w:`` host labels, ``p:`` path words, ``d:`` depth) of labelled
  urls are transactions of Spark's FP-growth; an itemset of any size is a rule if at least ``min_support`` of the labelled
  urls hold it and the share of those that are labelled bad is high enough: ``min_confidence``, or as much above the share
  among all labelled urls as ``min_lift`` and ``min_deviations`` say.  A rule whose proper subset is a rule as well is pruned.
  Rules are matched by an inverted index: each stands under its rarest token by count, a url
  looks its tokens up there, and a hit counts if all the rule's tokens are the url's.

Where no rule of either kind fits, the verdict is ``allow``; where mined rules fit, it is ``block``, and ``mined`` is the smallest
rule_id of these.  Null urls have no tokens and hosts; repeated rows stay; other
columns are not read.  With no labelled rows nothing is mined; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_join

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def stated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones override
        at = text.find("/")
        r_host, r_path = (text, "") if at < 0 else (text[:at], text[at:])
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a url."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, F.greatest(n - i + 1, F.lit(1)), i), ".")))
    words = F.filter(F.split(path, r"/"), lambda x: x != "")
    every = F.concat(
        F.when(n > 0, suffixes).otherwise(F.array().cast("array<string>")),
        F.transform(labels, lambda x: F.concat(F.lit("w:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("p:"), x)),
        F.array(F.concat(F.lit("d:"), F.size(words).cast("string"))),
    )
    return F.array_distinct(every)


def rarest(items: DataFrame, counts: DataFrame, *keep: str) -> DataFrame:
    """token (the item that ``counts`` (token, n) has least of; of ties the first), and the columns ``keep``, for each row
    of items."""
    rows = items.select("items", *keep, F.explode("items").alias("token")).join(counts, "token")
    return rows.groupBy("items").agg(F.min(F.struct("n", "token"))["token"].alias("token"), *[F.first(k).alias(k) for k in keep])


def mine(urls: DataFrame, min_support: float = 0.01, min_confidence: float | None = None, min_lift: float = 1.3, min_deviations: float = 2.0) -> DataFrame:
    """Rules (rule_id, items, token, support, confidence) from rows of (tokens, bad); bad is 0 or 1.  ``token`` is the item
    that the fewest labelled urls hold.

    Without ``min_confidence`` the share of bad urls has to pass that among all labelled ones ``min_lift`` times, and by
    ``min_deviations`` standard deviations of a draw of as many urls."""
    spark = urls.sparkSession
    empty = spark.createDataFrame([], "rule_id long, items array<string>, token string, support double, confidence double")
    totals = urls.agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).first()
    if not totals["n"] or not totals["bad"]:
        return empty
    rate = totals["bad"] / totals["n"]
    least = min_lift * rate if min_confidence is None else min_confidence
    if least > 1:
        return empty
    # every rule's itemset is frequent among the bad urls already at the support it needs there
    floor = min_support * least / rate
    if floor > 1:
        return empty
    bad = urls.where("bad = 1").select(F.col("tokens").alias("items"))
    frequent = FPGrowth(itemsCol="items", minSupport=floor, numPartitions=spark.sparkContext.defaultParallelism).fit(bad).freqItemsets
    found = cut(frequent.select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad")), "itemsets")
    found = found.join(_implied(urls, found), "items", "left_anti")
    # how often each itemset stands in all labelled urls, by the index: itemset under its rarest item
    counts = cut(urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "tokens")
    indexed = rarest(found, counts, "n_bad")
    rows = urls.select("tokens", F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("__spread"))
    held = dealt_join(rows, indexed, "token", "__spread").where(F.size(F.array_except("items", "tokens")) == 0)
    counted = held.groupBy("items").agg(F.count("*").alias("n"), F.first("n_bad").alias("n_bad"), F.first("token").alias("token"))
    fits = (F.col("support") >= min_support) & (F.col("confidence") >= least)
    if min_confidence is None:
        fits &= F.col("n_bad") - F.col("n") * rate >= min_deviations * F.sqrt(F.col("n") * rate * (1 - rate))
    rules = counted.withColumns({"support": F.col("n") / totals["n"], "confidence": F.col("n_bad") / F.col("n")}).where(fits).select("items", "token", "support", "confidence")
    rules = cut(rules, "rules")
    # smaller rules by the index as well
    parts = rules.select("token", F.col("items").alias("part"))
    held = rules.select("items", F.explode("items").alias("token")).join(parts, "token")
    smaller = held.where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0)).select("items").distinct()
    kept = rules.join(smaller, "items", "left_anti")
    return cut(kept.select(F.xxhash64("items").alias("rule_id"), "items", "token", "support", "confidence"), "mined")


def _implied(urls: DataFrame, found: DataFrame) -> DataFrame:
    """Itemsets of ``found`` with an item that stands in every labelled url that another item stands in: without it they
    have the same support and confidence, so they are no rules or pruned."""
    single = found.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"))
    own = urls.select("tokens", F.explode("tokens").alias("token")).join(single, "token")
    n = own.groupBy("token").agg(F.count("*").alias("n"))
    pairs = own.select("token", F.explode("tokens").alias("other")).where("token != other")
    always = pairs.groupBy("token", "other").agg(F.count("*").alias("both")).join(n, "token").where("both = n")
    always = always.groupBy("token").agg(F.collect_list("other").alias("others"))
    return found.select("items", F.explode("items").alias("token")).join(always, "token").where(F.arrays_overlap("items", "others")).select("items").distinct()


def judge(pages: DataFrame, rules: DataFrame | None = None, fixed=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (a mined rule that fits, or null)."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = stated(F.col("host"), F.col("path"), fixed)
    rows = rows.withColumns({"rule": rule, "__says": verdict})
    if rules is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("__says", F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("mined"))
    rows = rows.withColumn("__tokens", F.when(F.col("__says").isNull(), tokens(F.col("host"), F.col("path"))))
    index = rules.select(F.col("token").alias("__token"), "rule_id", "items")
    # what fits depends on the url alone, so hits are joined back by url
    looked_up = rows.where(F.col("__tokens").isNotNull()).select("url", "__tokens").distinct()
    hits = dealt_join(looked_up.select("url", "__tokens", F.explode("__tokens").alias("__token")), index, "__token", "url").where(F.size(F.array_except("items", "__tokens")) == 0)
    best = hits.groupBy("url").agg(F.min("rule_id").alias("mined"))
    rows = dealt_join(rows, best, "url", "page_id", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("__says", F.when(F.col("mined").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "mined")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls whose document of the same number is labelled: tokens, and bad for toxic ones or ones of quality 0."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.greatest(F.coalesce(F.col("toxic"), F.lit(0)), 1 - F.coalesce(F.col("quality"), F.lit(1)))).alias("bad"))
    host, path = split_url(F.col("url"))
    urls = pages.where(F.col("url").isNotNull()).select(F.col("page_id").alias("doc_id"), tokens(host, path).alias("tokens"))
    return urls.join(marks, "doc_id").select("tokens", "bad")
