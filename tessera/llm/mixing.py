"""Mixing sources to target weights, in DataFrame expressions alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of
from .quality_rules import WORD

#: Parts into which an epoch's order is cut; only the part that holds the end of a prefix is sorted.
BUCKETS = 1024


@dataclass(frozen=True)
class Mix:
    """What to mix: integer weights of domains and languages (1 where unnamed; sources share evenly), the budget as a
    percentage of all tokens, how often a document may be taken at most, and the seed of the epochs' orders."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 3, "d1": 2, "d2": 2, "d3": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    budget_percent: int = 100
    max_epochs: int = 3
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The domain of a source: one of four by its checksum, since the documents name none."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(source.cast("binary")), F.lit(4)).cast("string"))


def _weight(column: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1)
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.col(column)), F.lit(1))


def _whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's budget out among its children by weight, none beyond its capacity.

    ``nodes``: parent columns, name, w (weight), cap (what the child's subtree can give), budget (the parent's). In
    ascending order of cap / w, a child is full if its share of what the others before it left exceeds its cap; the
    rest share what remains. Shortages thus go to siblings first; a parent is never given more than its subtree has.
    Shares are rounded down to whole tokens. Adds ``own``.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.nullif(F.col("w"), F.lit(0)), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*parent)
    zero = F.lit(0)
    step = (
        nodes.withColumn("w_left", F.sum("w").over(own) - F.coalesce(F.sum("w").over(before), zero))
        .withColumn("b_left", F.col("budget") - F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("full", (F.col("b_left") > 0) & (_whole(F.col("cap")) * F.col("w_left") <= _whole(F.col("b_left")) * F.col("w")))
        .withColumn("b_rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(own))
        .withColumn("w_rest", F.sum(F.when(F.col("full"), zero).otherwise(F.col("w"))).over(own))
    )
    share = F.floor(_whole(F.greatest(F.col("b_rest"), zero)) * F.col("w") / F.nullif(F.col("w_rest"), zero))
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(F.least(share.cast("long"), F.col("cap")), zero))
    return step.withColumn("own", given.cast("long")).drop("w_left", "b_left", "full", "b_rest", "w_rest", "budget")


def allocate(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, supply) to the same with ``own``: the tokens that each leaf of the tree gives."""
    caps = leaves.withColumn("cap", F.col("supply") * mix.max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("supply"), F.lit(0)) * mix.budget_percent / 100).cast("long").alias("budget"))
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("root", F.lit(0)).withColumn("w", _weight("domain", mix.domains))
    domains = fill(domains.join(F.broadcast(total)), ["root"], "domain").select("domain", F.col("own").alias("budget"))  # one row
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight("lang", mix.languages))
    langs = fill(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("own").alias("budget"))
    sources = caps.withColumn("w", F.lit(1)).join(langs, ["domain", "lang"])
    return fill(sources, ["domain", "lang"], "source").select("domain", "lang", "source", "supply", "own")


def _order(seed: int, epoch: Column) -> Column:
    """The place of a document in an epoch: a digest that begins afresh with each seed and epoch."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _bucket(order: Column) -> Column:
    return F.floor(F.conv(F.substring(order, 1, 4), 16, 10).cast("int") * BUCKETS / 65536).cast("int")


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` chosen for the mix, each as often as it is taken, with mix_domain, mix_epoch (int, from 0)
    and mix_tokens (long) behind its columns.

    The budget is shared down the tree domain - language - source by weight. A node whose subtree cannot give its
    share (``max_epochs`` times its tokens) gives all; what it lacks goes to its siblings, and only if these are full
    to its parent's siblings. A leaf with budget b and supply s gives b div s whole epochs and, of the next epoch's
    seeded order (md5 of seed, epoch and doc_id), the shortest prefix that holds b mod s tokens or more.

    A token here is a word. Null texts have none; null languages and sources form the leaf ''. Rows that repeat a
    doc_id stand together in the order, by their text's hash. A leaf without tokens gives nothing. Columns named
    mix_domain, mix_epoch or mix_tokens are replaced; others stay. Empty in, empty out.

    One pass sums tokens by leaf, epoch and 1/1024 of the order; prefixes end within one such part, which alone is
    sorted, so a source that holds a third of all rows is never gathered in one task.
    """
    tree = docs.drop("mix_domain", "mix_epoch", "mix_tokens").withColumns({
        "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "__source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "mix_tokens": F.regexp_count(text_of(), F.lit(WORD)).cast("long"),
    })
    tree = tree.withColumn("mix_domain", domain_of(F.col("__source")))
    leaf = [F.col("mix_domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source")]
    key = ["domain", "lang", "source"]
    epochs = tree.select(*leaf, "doc_id", "mix_tokens", F.explode(F.sequence(F.lit(0), F.lit(mix.max_epochs - 1))).alias("epoch"))
    sums = materialize(epochs.groupBy(*key, "epoch", _bucket(_order(mix.seed, F.col("epoch"))).alias("bucket")).agg(F.sum("mix_tokens").alias("tokens")), "mix-sums")
    supply = sums.filter("epoch = 0").groupBy(*key).agg(F.sum("tokens").alias("supply")).filter("supply > 0")
    given = allocate(supply, mix).withColumns({
        "whole": F.expr("own div supply").cast("int"), "rest": F.expr("own % supply"),
    })
    upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.join(given, key).filter("epoch = whole").withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    # The last part in which something is still missing holds the end of the prefix.
    end = parts.filter("before < rest").groupBy(*key).agg(F.max(F.struct("bucket", "before")).alias("end"))
    plan = given.join(end, key, "left").select(
        *[F.col(c).alias(f"__p_{c}") for c in key], F.col("whole").alias("__whole"), F.col("rest").alias("__rest"),
        F.coalesce("end.bucket", F.lit(-1)).alias("__last"), F.coalesce("end.before", F.lit(0)).alias("__base"),
    )
    plan = materialize(plan, "mix-plan")
    mine = (F.col("mix_domain") == F.col("__p_domain")) & (F.col("__lang") == F.col("__p_lang")) & (F.col("__source") == F.col("__p_source"))
    placed = tree.join(plan, mine).withColumn("__order", _order(mix.seed, F.col("__whole"))).withColumn("__part", _bucket(F.col("__order")))
    # Whole epochs, and one more for the parts before the end of the prefix.
    times = F.col("__whole") + F.when(F.col("__part") < F.col("__last"), 1).otherwise(0)
    sure = placed.filter(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    edge = placed.filter(F.col("__part") == F.col("__last"))
    ahead = Window.partitionBy("__p_domain", "__p_lang", "__p_source").orderBy("__order", "doc_id", F.xxhash64(text_of())).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("__before", F.col("__base") + F.coalesce(F.sum("mix_tokens").over(ahead), F.lit(0))).filter("__before < __rest")
    edge = edge.withColumn("mix_epoch", F.col("__whole"))
    out = [*[F.col(c) for c in docs.columns if c not in ("mix_domain", "mix_epoch", "mix_tokens")], "mix_domain", F.col("mix_epoch").cast("int").alias("mix_epoch"), "mix_tokens"]
    return sure.select(*out).unionByName(edge.select(*out))
