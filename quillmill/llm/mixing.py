"""Mixing of sources to target weights by hierarchical budgeting, by DataFrame functions alone.

The leaves of a tree of named levels (here domain, language, source) hold documents. A
budget of tokens goes down the tree: among siblings each gets its weight's share, but none
more than its subtree can supply in ``epochs`` passes; what one cannot use goes to its
siblings in proportion to their weights, and only what all of them together cannot use is
left to their parent's siblings. With the supply of subtrees known this is one
water-filling per level, in closed form: sorted by supply over weight, siblings are
exhausted up to the first whose weight's share of the rest suffices.

Each leaf then reads its documents in a seeded order, anew for each epoch: whole epochs
first, then the longest prefix of the next epoch's order within the remaining tokens. The
order is by a key, a hash of seed, epoch and id, then one of the text. Sums by the first
digits of the key, then by the next ones, find the key where the prefix ends, over rows
without texts; the later sums only see the group that the earlier ones found. So no leaf
meets in one task, however many of the rows it or one of its ids holds. What is chosen
follows from each leaf's last key alone, in one pass over the documents.

Defined cases: tokens are runs of non-blank characters, none for a null or empty text; a
null level value is a leaf of its own, named ''; a null id is an id like others; rows of one
id are ordered by a hash of their texts, and copies of one text under one id are read
together or not at all; texts of any length count whole; an empty table gives an empty
result; columns of the input stay, but for those whose names start with ``mix_`` and that
are made here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

# hexadecimal digits of the order's key by which tokens are summed in turn: two more, two more,
# the whole hash of the id, then the same over the hash of the text among rows of one id
CUTS = (2, 4, 32, 34, 36, 48)


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _fill(level: DataFrame, parent: Sequence[str], given: Column) -> DataFrame:
    """``level`` (with supply and weight) with ``given_tokens``: the parent's budget shared by water-filling."""
    name = level.columns[len(parent)]
    order = Window.partitionBy(*parent, F.lit(0)).orderBy(F.col("supply") / F.col("weight"), name)
    before, here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    share = F.greatest(given - F.coalesce(F.sum("supply").over(before), F.lit(0)), F.lit(0)) / F.sum("weight").over(here)
    full = F.col("supply") <= F.col("weight") * F.col("share")
    # the first sibling that is not exhausted, the one of the largest share, fixes it for all after it
    level = level.withColumn("share", share)
    level = level.withColumn("level_share", F.max(F.when(~full, F.col("share"))).over(Window.partitionBy(*parent, F.lit(0))))
    return level.withColumn("given_tokens", F.when(full, F.col("supply")).otherwise(F.floor(F.col("weight") * F.col("level_share"))).cast("long"))


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int, epochs: int) -> DataFrame:
    """Leaf table (levels, tokens) with ``given_tokens``: the tokens each leaf is to give."""
    out = None
    for depth in range(1, len(levels) + 1):
        here, parent = list(levels[:depth]), list(levels[: depth - 1])
        table = leaves.groupBy(*here).agg((F.sum("tokens") * epochs).cast("long").alias("supply")).withColumn("weight", _weight(here[-1], weights.get(here[-1], {})))
        if out is None:
            given = F.lit(int(budget))
        else:
            table = table.join(out, parent).select(*here, "supply", "weight", "parent_tokens")
            given = F.col("parent_tokens")
        out = _fill(table, parent, given).select(*here, F.col("given_tokens").alias("parent_tokens"))
    return leaves.join(out, list(levels)).withColumnRenamed("parent_tokens", "given_tokens")


def text_hash(text: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(F.coalesce(text, F.lit(""))))), CUTS[-1] - 32, "0")


def order_key(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """text: its ``text_hash``."""
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), text)


def _plan(slim: DataFrame, levels: Sequence[str], weights, share: float, epochs: int, seed: int) -> DataFrame:
    """For each leaf: its whole epochs and the last key of the next epoch's prefix."""
    keys = list(levels)
    leaves = materialize(slim.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, levels, weights, int(total * share), epochs).withColumn("whole", F.expr("if(tokens > 0, given_tokens div tokens, 0)"))
    plan = materialize(plan.withColumn("rest", F.col("given_tokens") - F.col("whole") * F.col("tokens")).drop("tokens"), "plan")
    plan = plan.withColumns({"cut": F.lit(""), "before": F.lit(0).cast("long")})
    edge = None
    for done, upto in zip((0, *CUTS), CUTS, strict=False):
        key = order_key(seed, F.col("whole") + 1, F.col("doc_id"), F.col("text"))
        inside = (slim if edge is None else edge).join(plan, keys).withColumn("key", key).where(F.substring("key", 1, done) == F.col("cut"))
        if done == CUTS[0]:  # of each leaf, what the first digits leave
            edge = materialize(inside.select(*keys, "doc_id", "tokens", "text"), "edge")
            inside = edge.join(plan, keys).withColumn("key", key)
        sums = inside.groupBy(*keys, F.substring("key", 1, upto).alias("key")).agg(F.sum("tokens").alias("t"))
        order = Window.partitionBy(*keys).orderBy("key")
        ends = sums.join(plan, keys).withColumn("start", F.col("before") + F.sum("t").over(order) - F.col("t"))
        if upto < CUTS[-1]:
            last = ends.where("start <= rest").groupBy(*keys, "whole", "rest").agg(F.max(F.struct("key", "start")).alias("last"))
            plan = materialize(last.select(*keys, "whole", "rest", F.col("last.key").alias("cut"), F.col("last.start").alias("before")), "plan")
        else:  # none of the last group's keys may fit; all before it are smaller than its digits
            last = ends.where("start + t <= rest").groupBy(*keys).agg(F.max("key").alias("last"))
            plan = materialize(plan.join(last, keys, "left").select(*keys, "whole", F.coalesce("last", "cut").alias("last")), "plan")
    release(leaves)
    if edge is not None:
        release(edge)
    return plan


def select_documents(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], *, id_col: str = "doc_id", text_col: str = "text",
                     share: float = 0.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """The chosen documents with their columns, one row for each epoch they are read in.

    levels: names and expressions of the tree's levels, from the root. weights: whole
    numbers by level and value, 1 where none is given. share: part of all tokens to give.
    Adds ``mix_epoch``, ``mix_tokens`` and a column ``mix_<level>`` for each level.
    """
    names = [f"mix_{n}" for n in levels]
    weights = {f"mix_{n}": w for n, w in weights.items()}
    flat = docs.drop(*names, "mix_tokens", "mix_whole", "mix_last", "mix_epoch")
    flat = flat.withColumns({f"mix_{n}": F.coalesce(e.cast("string"), F.lit("")) for n, e in levels.items()}).withColumn("mix_tokens", tokens_of(F.col(text_col)))
    slim = materialize(flat.select(*names, F.col(id_col).alias("doc_id"), F.col("mix_tokens").alias("tokens"), text_hash(F.col(text_col)).alias("text")), "tokens")
    plan = _plan(slim, names, weights, share, epochs, seed)
    release(slim)
    joined = flat.join(plan.withColumnsRenamed({"whole": "mix_whole", "last": "mix_last"}), names)
    first = order_key(seed, F.col("mix_whole") + 1, F.col(id_col), F.lit(""))
    inside = F.when(first != F.substring("mix_last", 1, 32), first < F.col("mix_last")).otherwise(F.concat(first, text_hash(F.col(text_col))) <= F.col("mix_last"))
    again = F.when(inside, F.array(F.col("mix_whole") + 1)).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(F.col("mix_whole") > 0, F.sequence(F.lit(1).cast("long"), F.col("mix_whole"))).otherwise(F.array().cast("array<bigint>"))
    return joined.withColumn("mix_epoch", F.explode(F.concat(whole, again))).select(*flat.columns, "mix_epoch")
