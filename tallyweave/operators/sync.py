"""Keeping a target table in step with a source: matching, upserts, grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_two_keys(source: DataFrame, target: DataFrame, key: str, title: str) -> DataFrame:
    """Source rows with their target's key: by key, else by title without
    blanks; null where neither matches. Of equal titles the smallest key counts."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    by_key = target.select(F.col(key), F.col(key).alias("__k"))
    by_title = target.groupBy(bare(F.col(title)).alias("__t")).agg(F.min(key).alias("__by_title"))
    j = source.join(by_key, key, "left").withColumn("__t", bare(F.col(title))).join(by_title, "__t", "left")
    return j.select(*source.columns, F.coalesce("__k", "__by_title").alias("target_key"))


def disable_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Active targets that the source no longer has become inactive."""
    there = source.select(key).distinct().withColumn("__there", F.lit(True))
    return target.join(there, key, "left").withColumn("active", F.col("active") & F.col("__there").isNotNull()).drop("__there")


def upsert_changes(target: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of both with the names of the fields that differ, changed ones only."""
    new = source.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]))
    return target.join(new, key).withColumn("changed", names).where(F.size("changed") > 0)


def apply_changes(target: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The target after the update; unmatched rows stay."""
    new = source.select(key, F.lit(True).alias("__new"), *[F.col(f).alias(f"new_{f}") for f in fields])
    j = target.join(new, key, "left")
    return j.select(*[F.when(F.col("__new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in target.columns])


def sync_counters(target: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Updated, disabled, unchanged and unknown rows of one sync, in one row."""
    old = target.select(key, F.lit(True).alias("t"), *fields)
    new = source.select(key, F.lit(True).alias("s"), *[F.col(f).alias(f"new_{f}") for f in fields])
    j = old.join(new, key, "full")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"new_{f}"))
    both = F.col("t").isNotNull() & F.col("s").isNotNull()
    return j.agg(F.count_if(both & differs).alias("updated"), F.count_if(F.col("s").isNull()).alias("disabled"), F.count_if(both & ~differs).alias("unchanged"), F.count_if(F.col("t").isNull()).alias("skipped"))


def array_members(rows: DataFrame, key: str, array: str, known: DataFrame, known_key: str) -> DataFrame:
    """(key, member) for the members of an array that are known."""
    return rows.select(key, F.explode(F.array_distinct(array)).alias(known_key)).join(known.select(known_key), known_key, "left_semi").select(key, known_key)


def visible_items(users: DataFrame, items: DataFrame, grants: DataFrame, default_open: bool) -> DataFrame:
    """(user, item) that a user sees, each once: public items, granted ones, and
    all of them for a user without any grant when the default is open. Users and items
    meet on the audience they belong to; Spark broadcasts the items if they are few.
    Grants of unknown users or inactive items show nothing; null flags are false."""
    people, active = users.select("user").distinct(), items.where("active")
    held = grants.select("user", "item").distinct()
    whole = F.lit("all") if default_open else F.lit("public")
    audience = people.join(held.select("user", F.lit("public").alias("limited")).distinct(), "user", "left").select("user", F.coalesce("limited", whole).alias("audience"))
    shown = F.when(F.coalesce("public", F.lit(False)), F.array(F.lit("all"), F.lit("public"))).otherwise(F.array(F.lit("all")))
    seen = audience.join(active.select("item", F.explode(shown).alias("audience")), "audience").select("user", "item")
    hidden = active.where(~F.coalesce("public", F.lit(False))).select("item")
    return seen.unionByName(held.join(hidden, "item", "left_semi").join(people, "user", "left_semi").select("user", "item"))


def override(extracted: DataFrame, corrections: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Corrected fields replace extracted ones; a correction of no row makes one."""
    c = corrections.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return extracted.join(c, key, "full").select(key, *[F.coalesce(f"__{f}", f).alias(f) for f in fields])


def complete_whitelist(rows: DataFrame, key: str, category: str, item: str, lists: dict[str, list[str]], alias: Column) -> DataFrame:
    """The full list of each category's items, checked where any alias was; a
    category in which only the last item is checked is cleared."""
    named = rows.withColumn("__item", alias).groupBy(key, category).agg(F.collect_set(F.when(F.col("checked"), F.col("__item"))).alias("on"))
    full = F.element_at(F.create_map(*[x for c, v in lists.items() for x in (F.lit(c), F.array(*map(F.lit, v)))]), F.col(category))
    cut = F.when((F.size("on") == 1) & F.array_contains("on", F.element_at(full, -1)), F.array().cast("array<string>")).otherwise(F.col("on"))
    return named.withColumn("on", cut).select(key, category, "on", F.explode(full).alias(item)).select(key, category, item, F.array_contains("on", F.col(item)).alias("checked"))
