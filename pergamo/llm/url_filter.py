"""URL filtering by explicit rules and by association rules mined from labelled pages. Built-in functions only."""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pergamo.llm.common import table
from pergamo.session import settle

#: (verdict, host, path); fixed values of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Share of the labelled pages a token combination needs, share of bad pages a rule needs, and the rules that are broadcast at most; more are shuffled.
SUPPORT, CONFIDENCE, MOST_RULES = 0.005, 0.6, 10_000
#: Share of the good pages among all labelled ones that a rule's pages stay below: what all pages share tells nothing, however many are bad.
FEWER_GOOD = 0.99


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, its last two labels together, segments of the path."""
    labels = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x))
    site = F.filter(F.array(F.concat(F.lit("site="), F.regexp_extract(host, r"([^.]+\.[^.]+)\z", 1))), lambda x: x != "site=")
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    return F.array_distinct(F.concat(labels, site, parts))


def token_classes(each: DataFrame, least: float) -> DataFrame:
    """(item, tokens): tokens that bad pages have often enough; those that always occur together are one item.

    each: page, bad, token. Tokens of the same pages have the same count and the same two sums of page hashes.
    No more tokens pass than the tokens of a page, on average, over SUPPORT.
    """
    mark = lambda s: F.bit_xor(F.xxhash64(F.lit(s), "page"))
    some = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), mark(0).alias("x"), mark(1).alias("y"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    return some.where(F.col("bad") >= least).groupBy("n", "x", "y").agg(F.min("token").alias("item"), F.array_sort(F.collect_set("token")).alias("tokens")).select("item", "tokens")


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, confidence, support, items): token combinations that tell bad pages, from rows (tokens, bad).

    Tokens that always occur together are one item first, so what pages share as a whole (a long path) counts once
    and not as all its parts. FP-growth then mines the bad pages only; one count over all labelled pages gives the
    confidence. A rule asks for all tokens of its items. All rules of enough confidence are kept, unless good pages
    are as usual under it as anywhere (FEWER_GOOD). Null labels count as good; rows
    without tokens tell nothing; repeated rows count each; no bad row leaves no rules.
    """
    rows = settle(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("page"), "tokens", F.coalesce("bad", F.lit(False)).alias("bad")))
    n, n_bad = rows.count(), rows.where("bad").count()
    least = max(1.0, support * n)
    spark = labelled.sparkSession
    if n_bad < least:
        return spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double, items array<string>")
    each = rows.select("page", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    classes = settle(token_classes(each, least))
    items = each.join(F.broadcast(classes.select("item", F.col("item").alias("token"))), "token").select("page", "bad", "item")
    pages = settle(items.groupBy("page", "bad").agg(F.collect_list("item").alias("items")))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_bad)).fit(pages.where("bad")).freqItemsets
    sets = settle(sets.select(F.xxhash64(F.array_sort("items")).alias("set"), F.array_sort("items").alias("items"), F.col("freq").alias("bad")))
    index = sets.select(F.explode("items").alias("item"), "set", F.size("items").alias("need"))
    held = pages.select("page", F.explode("items").alias("item")).join(index, "item").groupBy("page", "set").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    totals = held.where("n = need").groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    good = sets.join(totals, "set").withColumn("confidence", F.col("bad") / F.col("n")).where((F.col("confidence") >= confidence) & (1 - F.col("confidence") < FEWER_GOOD * (1 - n_bad / n)))
    wide = good.select("set", F.explode("items").alias("item")).join(F.broadcast(classes), "item").groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))
    return settle(good.join(wide, "set").select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", (F.col("bad") / n).alias("support"), "items"))


def needed_rules(rules: DataFrame) -> DataFrame:
    """rules without those that hold all items (or tokens, where there are none) of another rule of at least their
    confidence: where such a rule fires, the other one does too. An empty table stays empty."""
    by = "items" if "items" in rules.columns else "tokens"
    subsets = F.aggregate(by, F.expr("array(cast(array() as array<string>))"), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    own = rules.select(F.col("rule_id").alias("whole"), F.col("confidence").alias("most"), F.size(by).alias("n"), F.explode(subsets).alias("part"))
    own = own.where((F.size("part") > 0) & (F.size("part") < F.col("n"))).select("whole", "most", F.xxhash64("part").alias("part"))
    implied = own.join(rules.select(F.xxhash64(by).alias("part"), "confidence"), "part").where("confidence >= most")
    return settle(rules.join(implied.select(F.col("whole").alias("rule_id")).distinct(), "rule_id", "left_anti").select(*rules.columns))


def match_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_key") -> DataFrame:
    """Keys of the pages that hold all tokens of some rule, with the best confidence, by an inverted index.

    The index has one row a token of a rule; it is broadcast up to MOST_RULES rules, else shuffled. A page meets only
    the postings of its own tokens; a rule fires where it met as many of its tokens as it has. Pages without tokens
    and empty tables give no rows; repeated keys count as one page.
    """
    index = rules.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("need"), "confidence")
    met = pages.select(id_col, F.explode("tokens").alias("token")).distinct().join(F.broadcast(index) if rules.count() <= MOST_RULES else index.hint("merge"), "token")
    fired = met.groupBy(id_col, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"), F.first("confidence").alias("confidence")).where("n = need")
    return fired.groupBy(id_col).agg(F.max("confidence").alias("confidence"))


def explicit_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    labels has doc_id, quality and toxic of some pages; a page of quality 0 or toxic 1 is bad (nulls: not bad).
    Explicit rules come first, the longest that fits; a page that none fits is blocked if a mined rule fires
    and allowed otherwise. Distinct (host, path) pairs are matched once, so a hot host costs no more. Null urls
    have empty host and path and are allowed. Repeated rows are judged each; empty tables give no rows or no
    mined rules; other columns are not read.
    """
    u = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(u).alias("host"), path_of(u).alias("path"))
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    labelled = rows.join(bad, rows.id == bad.doc_id).select(url_tokens(F.col("host"), F.col("path")).alias("tokens"), "bad")
    mined = needed_rules(mine_rules(labelled))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    if mined.isEmpty():
        out = judged.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    else:
        open_ = rows.where(rule.isNull()).select("host", "path").distinct().withColumn("page_key", F.xxhash64("host", "path")).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
        fired = match_rules(open_, mined).select("page_key", F.lit("block").alias("mined"))
        judged = judged.withColumn("page_key", F.when(F.col("rule").isNull(), F.xxhash64("host", "path")))
        out = judged.join(fired, "page_key", "left").withColumn("verdict", F.coalesce("verdict", "mined", F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_url_filter": op9_url_filter}
