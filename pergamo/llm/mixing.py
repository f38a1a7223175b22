"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pergamo.llm.common import table
from pergamo.plans.skew import BROADCAST_ROWS
from pergamo.session import settle, ship_code

WORD = r"[^\x20\x09-\x0D]+"
#: Weights given to the sources in turn, copies of a document at most, share of all words that the mix takes.
WEIGHTS, MOST_COPIES, SHARE = (1, 2, 3), 3, 1.0
#: Rows that one rounding task pairs; residuals of so many blocks meet in one block of the next level.
FAN_IN = 4096
EPS = 1e-12


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, share: float = SHARE) -> DataFrame:
    """(source, source_size, target): a share of all words by weight, no target above `most` times its source.

    Ranks come from a range sort with offsets per partition, so sources may be many. What a cap leaves is
    shared anew among the sources below theirs: each round is one sum, until none is above.
    """
    by = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    order = F.struct(F.col("source").isNull().alias("last"), "source")
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = settle(by.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    ends = sorted((r["part"], r["count"]) for r in by.groupBy("part").count().collect())  # one number a partition
    before, offsets = 0, []
    for p, n in ends:
        offsets.append((p, before))
        before += n
    offset = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    by = settle(by.join(offset, "part").select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    total = (by.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:  # the level only rises, so a capped source stays capped
        full = F.col("weight") * level >= F.col("cap")
        r = by.agg(F.sum(F.when(full, F.col("cap"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        new = max(0.0, total - (r["used"] or 0.0)) / r["open"]
        if new <= level * (1 + EPS):
            break
        level = new
    return by.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, "cap").alias("target"))


def _pivot(rows: pd.DataFrame, seed: str) -> list[float]:
    """Round fractions so that the sum of size x fraction stays; at most one stays fractional.

    Two documents at a time trade words until one of them is in or out; the chance of either end keeps each
    document's expectation.
    """
    rng, p, s = random.Random(seed), rows["p"].tolist(), rows["size"].tolist()
    i = -1
    for j in range(len(p)):
        if i < 0:
            i = j
            continue
        mass = p[i] * s[i] + p[j] * s[j]
        low, high = max(0.0, (mass - s[j]) / s[i]), min(1.0, mass / s[i])
        p[i] = low if high <= low or rng.random() * (high - low) < high - p[i] else high
        p[j] = (mass - p[i] * s[i]) / s[j]
        open_ = []
        for k in (i, j):
            if p[k] < EPS or p[k] > 1 - EPS:
                p[k] = float(round(p[k]))
            else:
                open_.append(k)
        i = open_[0] if open_ else -1
    return p


def _rounded(seed: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def block(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["draw", "size", "id"], kind="stable")
        return g.assign(p=_pivot(g, f"{seed}/{g['source'].iloc[0]}/{g['block'].iloc[0]}"))

    return block


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, share: float = SHARE, id_col: str = "doc_id", seed: int = 1) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies.

    Each document is wanted target / source_size times; the whole part is given and the fraction is rounded by
    pivotal pairs within blocks of a source (so a hot source is many blocks). Each block leaves one fractional
    row at most; those meet, FAN_IN blocks at a time, in the next level of a reduction tree, until one row a
    source is left, which its own chance decides. A source's words so differ from its target by less than one
    document. Blocks and chances come from hashes of the rows: reruns agree, whatever the partitioning.

    Null text has size 0; documents of size 0 get no fraction copies. Null is a source of its own, ranked last.
    Rows equal in id, text and source are rounded together and share the copies they get as evenly as can be.
    Null ids and ids that unlike texts share are told apart by the text. Texts of any length are read whole. An
    empty table gives no rows. Other columns are not read.
    """
    out = _mixed(docs, weights, most, share, id_col, seed).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", _own_copies("nth").alias("copies"))


def _draw(id_col: str, seed: int) -> Column:
    """Names a row by its id, text and source, and is its chance."""
    return F.xxhash64(F.lit(seed), F.col(id_col).isNull(), id_col, F.length("text"), "text", F.col("source").isNull(), "source")


def _own_copies(nth: str) -> Column:
    """Copies of the nth of m equal rows that get `copies` together."""
    return F.floor(F.col("copies") / F.col("m")).cast("long") + (F.col(nth) <= F.pmod("copies", "m")).cast("long")


def _mixed(docs: DataFrame, weights: tuple[float, ...], most: float, share: float, id_col: str, seed: int) -> DataFrame:
    """draw, id, source, size, source_size, target, m (equal rows) and copies, of all equal rows together."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    every = docs.select(F.col(id_col).alias("id"), "source", size.alias("size"), _draw(id_col, seed).alias("draw"))
    sizes = settle(every.groupBy("draw", "id", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    goals = settle(source_targets(sizes.select("source", (F.col("size") * F.col("m")).alias("size")), weights, most, share))
    few = goals.count() <= BROADCAST_ROWS
    rows = sizes.alias("r").join(F.broadcast(goals.alias("g")) if few else goals.alias("g"), F.expr("r.source <=> g.source")).select("r.*", "source_size", "n_docs", "target")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("want", want * F.col("m")).withColumn("base", F.floor(F.col("want") + EPS).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("want") - F.col("base")))
    rows = rows.withColumn("p", F.when((F.col("size") == 0) | (F.col("p") < EPS), 0.0).otherwise(F.col("p")))
    done = rows.where("p = 0")
    open_ = rows.where("p > 0").withColumn("block", F.pmod("draw", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / FAN_IN)).cast("long")))
    out, level = [done], 0
    ship_code(docs.sparkSession)
    while True:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema)

        got = settle(open_.groupBy("source", "block").applyInPandas(_rounded(f"{seed}/{level}"), fields))
        out.append(got.where("p = 0 or p = 1").drop("block"))
        left = got.where("p > 0 and p < 1")
        if left.isEmpty():
            break
        if left.groupBy("source").count().where("count > 1").isEmpty():
            chance = (F.xxhash64(F.lit("last"), "draw").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)) < F.col("p")
            out.append(left.withColumn("p", F.when(chance, 1.0).otherwise(0.0)).drop("block"))
            break
        open_, level = left.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long")), level + 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("draw", "id", "source", "size", "source_size", "target", "m", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def take(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs as mixed: each row as many times as its copies, none for 0; all columns pass.

    Rows meet their copies by a hash of id, text and source, so null ids and ids that unlike texts share take
    their own. Of equal rows each takes its part. An empty table gives no rows.
    """
    names, seed = docs.columns, 1
    copies = settle(_mixed(docs, WEIGHTS, MOST_COPIES, SHARE, id_col, seed).select(F.col("draw").alias("_draw"), "m", "copies").where("copies > 0"))
    copies = copies.select("_draw", F.col("m").alias("_m"), F.col("copies").alias("_copies"))
    met = docs.withColumn("_draw", _draw(id_col, seed)).join(copies, "_draw")
    once = met.where("_m = 1").withColumn("_own", F.col("_copies"))
    order = [F.xxhash64(F.to_json(F.struct(*names)))]
    again = met.where("_m > 1").withColumn("_nth", F.row_number().over(Window.partitionBy("_draw").orderBy(*order)))
    own = F.floor(F.col("_copies") / F.col("_m")).cast("long") + (F.col("_nth") <= F.pmod("_copies", "_m")).cast("long")
    again = again.withColumn("_own", own).where("_own > 0").drop("_nth")
    return once.unionByName(again).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "_own")).alias("_copy")).select(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op2_mixing": op2_mixing}
