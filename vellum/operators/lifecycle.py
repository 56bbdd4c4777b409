"""Life of entities between runs: groups from confirmed pairs, survivors, crosswalks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.matching import min_label_components


def settled_groups(pairs: DataFrame, a: str, b: str, verdict: str, confirming: list[str], apart: str, attested: DataFrame, entity: str, since: str) -> DataFrame:
    """(entity, group_id, survivor, state) of every entity a confirmed pair names
    (E10, E11, E13).

    Groups are closed over all confirmed pairs, to a fixed point. A group in which
    any pair is to be kept apart is ``held`` whole: its members stay themselves. In
    the others (``merged``) the member attested first survives, the smallest id at a
    tie or where none is attested. Repeats, both orders, nulls and pairs of an entity
    with itself change nothing.
    """
    links = pairs.where(F.col(verdict).isin(confirming) & F.col(a).isNotNull() & F.col(b).isNotNull())
    member = min_label_components(links, a, b).select(F.col("vertex").alias(entity), F.col("component").alias("group_id"))
    left = member.select(F.col(entity).alias(a), F.col("group_id").alias("_ga"))
    right = member.select(F.col(entity).alias(b), F.col("group_id").alias("_gb"))
    kept = pairs.where(F.col(verdict) == apart).join(left, a).join(right, b).where("_ga = _gb").select(F.col("_ga").alias("group_id"), F.lit(True).alias("_held")).distinct()
    first = attested.groupBy(entity).agg(F.min(since).alias("_since"))
    told = member.join(first, entity, "left").join(kept, "group_id", "left")
    best = told.groupBy("group_id").agg(F.min(F.struct(F.col("_since").isNull().alias("n"), "_since", entity)).alias("_b"), F.max("_held").alias("_held"))
    state = F.when(F.col("_held"), "held").otherwise("merged")
    return member.join(best, "group_id").select(entity, "group_id", F.when(F.col("_held"), F.col(entity)).otherwise(F.col(f"_b.{entity}")).alias("survivor"), state.alias("state"))


def crosswalk(old: DataFrame, new: DataFrame, member: str, old_id: str, new_id: str) -> DataFrame:
    """(old_id, new_id, shared, kind): how ids of one run go over into those of the
    next by the members they share (C6)."""
    both = old.select(member, old_id).distinct().join(new.select(member, new_id).distinct(), member)
    met = both.groupBy(old_id, new_id).agg(F.count("*").alias("shared"))
    into = met.groupBy(new_id).agg(F.count("*").alias("_from"))
    from_ = met.groupBy(old_id).agg(F.count("*").alias("_to"))
    kind = F.when((F.col("_from") == 1) & (F.col("_to") == 1), "kept").when(F.col("_to") == 1, "merged").when(F.col("_from") == 1, "split").otherwise("mixed")
    return met.join(into, new_id).join(from_, old_id).select(old_id, new_id, "shared", kind.alias("kind"))


def unique_links(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs whose keys name one row on either side."""
    one = lambda df, i: df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(i).alias(i)).where("_n = 1").drop("_n")
    return one(left.select(*keys, left_id).distinct(), left_id).join(one(right.select(*keys, right_id).distinct(), right_id), keys)


def supplied(missing: DataFrame, parents: DataFrame, children: DataFrame, keys: list[str], parent: str, order: str) -> DataFrame:
    """(child_id, parent, order): a row added to the one parent its keys name, if that
    parent has no child yet; rows of several parents or of none add nothing (E45)."""
    sole = parents.select(*keys, parent).distinct().groupBy(*keys).agg(F.count("*").alias("_n"), F.min(parent).alias(parent)).where("_n = 1").drop("_n")
    added = missing.join(sole, keys).join(children.select(parent).distinct(), parent, "left_anti")
    number = F.row_number().over(Window.partitionBy(parent).orderBy(order))
    return added.select(F.concat(F.col(parent), F.lit("__supplied"), number.cast("string")).alias("child_id"), parent, order)
