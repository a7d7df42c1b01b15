"""URL filters: association rules over URL tokens, matched by inverted index.

FP-growth finds token combinations that labelled pages share; combinations with
enough support and confidence for the label become rules.  A rule stands in the
index under its rarest token; a url meets only the rules of its own tokens, and
each is confirmed on the whole token set.  All rules are kept, as a table; only
those that fit no further url are left out.  Given host and path rules come first:
where one fits, its verdict holds.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, by_hash, fresh, written

#: (verdict, host, path prefix): fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "org", "/es/"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
)
_LABEL = "label=block"


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def given_rule(rules=RULES) -> Column:
    """(rule, verdict) of the longest given rule that fits columns host and path, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, every host suffix, each host name before the last, path parts, query names and pairs."""
    url = F.coalesce(url, F.lit(""))
    names = F.split(host(url), r"\.", -1)
    tail = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    pairs = F.split(tail, "&", -1)
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    all_of = F.concat(
        tag("scheme=", F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        tag("host=", F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, k, F.size(names)), "."))),
        tag("part=", F.slice(names, 1, F.size(names) - 1)),
        tag("path=", F.split(path(url), "/", -1)),
        tag("query=", pairs),
        tag("name=", F.transform(pairs, lambda x: F.split(x, "=", 2)[0])),
    )
    return F.array_distinct(F.filter(all_of, lambda t: ~F.endswith(t, F.lit("="))))


_GROUPS = "groups array<array<string>>, anchors array<string>, confidence double, support double"


def mine_groups(labelled: DataFrame, *, min_support: float = 0.002, min_count: int = 20, min_confidence: float = 0.6) -> DataFrame:
    """Rules (groups, anchors, confidence, support) from ``labelled(tokens, block)``: one token of each group must be there.

    A combination must hold in ``min_count`` pages and ``min_support`` of all.
    Rules that add tokens to a kept one are left out: they fit no further url.
    So tokens that are rules alone are left out of the combinations, and tokens
    that stand on the same pages are one group, mined as one token and never
    multiplied out.  ``anchors`` is the group of the rarest tokens.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], _GROUPS)
    rows = written(labelled.select(F.array_distinct("tokens").alias("tokens"), F.coalesce("block", F.lit(False)).alias("block")).where(F.col("block") | (F.size("tokens") > 0)), "labelled")
    n = rows.count()
    if n < min_count:
        return empty
    least = max(min_count, math.ceil(min_support * n))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    spread = rows.select("row", "block", F.xxhash64("tokens").cast("decimal(20,0)").alias("h1"), F.hash("tokens").cast("decimal(20,0)").alias("h2"), F.explode("tokens").alias("token"))
    counts = spread.groupBy("token").agg(F.count("*").alias("freq"), F.count_if("block").alias("hits"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where(F.col("hits") >= least)
    counts = written(counts.withColumn("confidence", F.col("hits") / F.col("freq")), "tokens")
    single = counts.where(F.col("confidence") >= min_confidence).select(F.array(F.array("token")).alias("groups"), F.array("token").alias("anchors"), "confidence", (F.col("hits") / n).alias("support"))

    alike = counts.where(F.col("confidence") < min_confidence).groupBy("freq", "hits", "h1", "h2").agg(F.min("token").alias("token"), F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("members"))
    alike = written(alike.select("token", "freq", "members"), "alike")
    baskets = spread.join(alike, "token").groupBy("row").agg(F.collect_list("token").alias("items"), F.first("block").alias("block"))
    baskets = written(baskets.select(F.when(F.col("block"), F.array_append("items", F.lit(_LABEL))).otherwise(F.col("items")).alias("items")), "baskets")
    m = baskets.count()
    if m < least:
        return written(single, "rules")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / m, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _LABEL))
    parts = found.select("antecedent", "confidence", (F.col("support") * m / n).alias("support"), F.explode("antecedent").alias("token")).join(alike, "token")
    rules = parts.groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"), F.collect_list("members").alias("members"))
    rules = written(rules, "combinations")
    met = rules.select("antecedent", F.explode("antecedent").alias("anchor")).join(rules.select("anchor", F.col("antecedent").alias("less")), "anchor")
    wider = met.where((F.size("less") < F.size("antecedent")) & (F.size(F.array_except("less", "antecedent")) == 0)).select("antecedent").distinct()
    tokens = lambda g: F.transform(g, lambda x: x["token"])
    combined = rules.join(wider, "antecedent", "left_anti").select(F.transform("members", tokens).alias("groups"), tokens(F.array_min("members")).alias("anchors"), "confidence", "support")
    return written(single.unionByName(combined), "rules")


def mine_rules(labelled: DataFrame, **mining) -> DataFrame:
    """The same with every choice of tokens as a rule (antecedent, confidence, support, anchor), to look at: their number is the product of the groups' sizes."""
    groups = mine_groups(labelled, **mining)
    each = F.aggregate("groups", F.array(F.array().cast("array<string>")), lambda done, more: F.flatten(F.transform(done, lambda x: F.transform(more, lambda y: F.array_append(x, y)))))
    rows = groups.select("confidence", "support", "anchors", F.explode(each).alias("antecedent"))
    return rows.select("antecedent", "confidence", "support", F.array_min(F.array_intersect("antecedent", "anchors")).alias("anchor"))


def match_rules(urls: DataFrame, rules: DataFrame, *, max_broadcast: int = 100_000) -> DataFrame:
    """(url, confidence) of each distinct url that some mined rule fits, by its best rule.

    ``rules(groups, anchors, confidence)``, or ``rules(antecedent, anchor, confidence)``
    for rules of single tokens.  A rule stands in the index under each of its
    anchors; up to ``max_broadcast`` entries are broadcast, more meet the urls'
    tokens by shuffle, hot anchors dealt over copies of their rules.
    """
    tokens = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("tokens", url_tokens(F.col("url")))
    if "groups" not in rules.columns:
        rules = rules.select(F.transform("antecedent", lambda t: F.array(t)).alias("groups"), F.array("anchor").alias("anchors"), "confidence")
    index = rules.select(F.explode("anchors").alias("anchor"), "groups", "confidence")
    met = tokens.select("url", "tokens", F.explode("tokens").alias("anchor"))
    if index.count() > max_broadcast:
        salts = 16
        index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = met.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int")).join(index, ["anchor", "salt"])
    else:
        met = met.join(F.broadcast(index), "anchor")
    return met.where(F.forall("groups", lambda g: F.arrays_overlap(g, F.col("tokens")))).groupBy("url").agg(F.max("confidence").alias("confidence"))


def url_filter(pages: DataFrame, labels: DataFrame, *, rules=RULES, max_labelled: int = 200_000, **mining) -> DataFrame:
    """``pages`` with host, path, rule, verdict and confidence.

    A page is labelled by the row of ``labels`` with doc_id = page_id: bad
    quality or toxic means block.  Mining uses at most ``max_labelled`` labelled
    pages (expected), by hash of page_id.  Without a given rule the verdict is "block"
    where a mined rule fits and "allow" elsewhere.  Null urls, and urls without
    ``://``, have an empty host and path; repeated rows are judged alike; an empty
    table stays empty; columns named like the new ones are replaced.

    Tokens that always stand together are one group, matched as such; beyond that, the
    work of mining grows with the combinations that frequent tokens of one url make.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "confidence")
    given, hit, key = fresh(pages, "given_rule", "hit_url", "url_key")
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block")).where("block is not null")
    known = by_hash(pages.select("page_id", "url").join(marked, F.col("page_id") == F.col("doc_id")), "page_id", max_labelled)
    mined = mine_groups(known.select(url_tokens(F.col("url")).alias("tokens"), "block"), **mining)
    hits = match_rules(pages, mined).select(F.col("url").alias(hit), "confidence")
    rows = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn(given, given_rule(rules))
    spread = F.when(F.col("url").isNull(), F.concat(F.lit("\0"), F.xxhash64("page_id"))).otherwise(F.col("url"))  # null urls meet none, and not each other
    rows = rows.withColumn(key, spread).join(hits, (F.col(key) == F.col(hit)) & F.col("url").isNotNull(), "left")
    verdict = F.coalesce(F.col(given)["verdict"], F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return rows.select(*pages.columns, "host", "path", F.col(given)["rule"].alias("rule"), verdict.alias("verdict"), "confidence")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filter(pages, labels).select("page_id", "host", "path", "rule", "verdict")
