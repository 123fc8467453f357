"""Statement rows: mapping from many templates onto one schema, cleaning, ordering
and merging of records cut by a page end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Mapping:
    """One template's columns: canonical name to source label, and whether a
    missing sequence is numbered."""

    labels: dict[str, str]
    casts: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    number_rows: bool = True


class Registry:
    """Mappings by template key, with a default for writing."""

    def __init__(self, default: str) -> None:
        self.default, self.mappings = default, {}

    def add(self, key: str, mapping: Mapping) -> None:
        if key in self.mappings:
            raise ValueError(f"template {key} is registered already")
        self.mappings[key] = mapping

    def known(self, key: Column) -> Column:
        return key.isin(*self.mappings)

    def for_writing(self, key: Column) -> Column:
        """An absent or unknown template is written with the default."""
        return F.when(self.known(key), key).otherwise(F.lit(self.default))

    def rejected(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows that reading refuses."""
        return rows.where(F.col(key).isNull() | ~self.known(F.col(key)))

    def project(self, rows: DataFrame, key: str) -> DataFrame:
        """Map rows (a map column `values`) to the canonical columns. All
        templates are one projection: each canonical column picks its source label
        by the row's template, so the table is read once."""
        kind = self.for_writing(F.col(key))
        names = list(dict.fromkeys(n for m in self.mappings.values() for n in m.labels))
        out = []
        for name in names:
            value = F.lit(None).cast("string")
            for k, m in self.mappings.items():
                if name in m.labels:
                    raw = F.element_at("values", F.lit(m.labels[name]))
                    raw = F.when(F.trim(raw) != "", raw)
                    value = F.when(kind == k, m.casts[name](raw).cast("string") if name in m.casts else raw).otherwise(value)
            out.append(value.alias(name))
        return rows.select(*[c for c in rows.columns if c != "values"], kind.alias("template"), *out)


def number_missing(rows: DataFrame, seq: str, group: list[str], order: list[str], when: Column) -> DataFrame:
    """A missing sequence becomes the row's place in its file, as text."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn(seq, F.when(F.col(seq).isNull() & when, place.cast("string")).otherwise(F.col(seq)))


def visible_to(user: int, column: str = "user_id") -> Column:
    """the user's rows and rows of no user."""
    return (F.col(column) == user) | F.col(column).isNull()


def is_record(serial: Column, dates: list[Column], need_date: Column) -> Column:
    """no web noise in the serial, and the first date that is given holds a digit."""
    first = F.coalesce(*[F.when(F.trim(d) != "", d) for d in dates])
    noise = F.coalesce(F.lower(serial).rlike(r"http|\.com|aspx|enquiry"), F.lit(False))
    return ~noise & F.when(first.isNull(), ~need_date).otherwise(first.rlike(r"\d"))


def complete_summary() -> Column:
    """account, name, range, a total and a count are all there."""
    there = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return there("account") & there("name") & there("range") & (there("income") | there("expense")) & there("count")


def numeric_else_text(rows: DataFrame, group: str, key: str, tie: str) -> DataFrame:
    """O2: the rows with `place`, their order in the group: by number if all of the
    group's keys are whole numbers, else by text."""
    number = F.col(key).try_cast("bigint")
    flags = rows.groupBy(group).agg(F.bool_and(number.isNotNull()).alias("__numeric"))
    order = Window.partitionBy(group).orderBy(F.when(F.col("__numeric"), number), F.when(~F.col("__numeric"), F.col(key)), tie)
    return rows.join(flags, group).withColumn("place", F.row_number().over(order)).drop("__numeric")


def latest(rows: DataFrame, group: list[str], at: str, value: str) -> DataFrame:
    """O3: the value of the latest row of each group."""
    return rows.groupBy(*group).agg(F.max(at).alias(at), F.max_by(value, at).alias(value))


def search_page(rows: DataFrame, column: str, keyword: str, order: str, page: int, size: int) -> DataFrame:
    """One page of the rows whose column holds the keyword."""
    return rows.where(F.col(column).contains(keyword)).orderBy(order).offset((page - 1) * size).limit(size)


def first_keyword(names: DataFrame, name: str, keywords: list[tuple[str, str]], default: str) -> DataFrame:
    """The key of the first registered keyword that the name holds, in any case."""
    out = F.lit(default)
    for word, key in reversed(keywords):
        out = F.when(F.lower(name).contains(word.lower()), F.lit(key)).otherwise(out)
    return names.withColumn("bank", out)


def owning_summary(rows: DataFrame, summaries: DataFrame, group: str, at: str, start: str, value: str) -> DataFrame:
    """The latest summary that starts at or before each row, null before the
    first. Both sides are united and carried forward, one shuffle and no range join."""
    marks = summaries.select(group, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(start).alias("start"), F.col(value).alias("v")).alias("__mark"))
    both = rows.select(group, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__row")).unionByName(marks, allowMissingColumns=True)
    over = Window.partitionBy(group).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("__mark", F.last("__mark", ignorenulls=True).over(over)).where("__kind = 1")
    return held.select("__row.*", F.col("__mark.start").alias("owner_start"), F.col("__mark.v").alias("owner"))


def merge_cut_records(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """A record cut by a page end. A tail row (is_tail) takes the next row of
    its file if that is a head (is_head): serial and time are joined, blanks filled,
    the party appended unless it is there. A row that is both is head of the pair
    before it or tail of the next by its place in the run, so pairs never share a
    row."""
    over = Window.partitionBy(group).orderBy(*order)
    pair = F.col("is_tail") & F.coalesce(F.lead("is_head").over(over), F.lit(False))
    work = rows.withColumn("__pair", pair)
    run = F.sum(F.when(F.coalesce(F.lag("__pair").over(over), F.lit(False)), 0).otherwise(1)).over(over)
    work = work.withColumn("__run", run)
    inside = Window.partitionBy(group, "__run").orderBy(*order)
    work = work.withColumn("__odd", F.row_number().over(inside) % 2 == 1)
    joins = F.col("__pair") & F.col("__odd")
    names = ["serial", "time", "party", "amount"]
    following = F.struct(*[F.lead(c).over(over).alias(c) for c in names])
    work = work.withColumn("__next", following).withColumn("__joins", joins).withColumn("__eaten", F.coalesce(F.lag("__joins").over(over), F.lit(False)))
    n = lambda c: F.coalesce(F.col(f"__next.{c}"), F.lit(""))
    own = lambda c: F.coalesce(F.col(c), F.lit(""))
    merged = {
        "serial": F.concat(own("serial"), n("serial")),
        "time": F.trim(F.concat_ws(" ", own("time"), n("time"))),
        "party": F.when(own("party").contains(n("party")), own("party")).otherwise(F.concat(own("party"), n("party"))),
        "amount": F.when(own("amount") == "", n("amount")).otherwise(own("amount")),
    }
    kept = work.where(~F.col("__eaten"))
    for c in names:
        kept = kept.withColumn(f"__{c}", F.when(F.col("__joins"), merged[c]).otherwise(F.col(c)))
    return kept.select(*[F.col(f"__{c}").alias(c) if c in names else F.col(c) for c in rows.columns], F.col("__joins").alias("was_cut"))


def vote(rows: DataFrame, form: str, code: str, original: Column) -> DataFrame:
    """Each form's code: most frequent, then one seen in an original, then the
    longest, then by text. Votes are counted before forms are ranked."""
    counted = rows.where(F.col(code).isNotNull() & (F.col(code) != "")).groupBy(form, code).agg(F.count("*").alias("n"), F.max(original.cast("int")).alias("o"))
    best = F.max(F.struct("n", "o", F.length(code).alias("l"), F.col(code).alias("c")))
    return counted.groupBy(form).agg(best.alias("b")).select(form, F.col("b.c").alias(code), F.col("b.n").alias("votes"))


def fill_when_unique(rows: DataFrame, group: str, column: str) -> DataFrame:
    """A missing value takes its group's only distinct one."""
    only = rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(group).agg(F.min(column).alias("__min"), F.max(column).alias("__max"))
    filled = F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(column)).when(F.col("__min") == F.col("__max"), F.col("__min"))
    return rows.join(only, group, "left").withColumn(column, filled).drop("__min", "__max")


def merge_partials(rows: DataFrame, key: str, seq: str, first: list[str], any_of: list[str], longest: list[str], lists: list[str]) -> DataFrame:
    """One record of each key from partial ones: first non-empty, any true,
    longest text (the first of equal ones), and lists united in order."""
    out = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(seq))).alias(c) for c in first]
    out += [F.bool_or(c).alias(c) for c in any_of]
    out += [F.max_by(c, F.struct(F.length(c), -F.col(seq))).alias(c) for c in longest]
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(c)))), lambda x: x[c])
    out += [F.array_distinct(F.flatten(ordered(c))).alias(c) for c in lists]
    return rows.groupBy(key).agg(*out)


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key. A null key is a key of its own."""
    named = rows.withColumn("__key", F.coalesce(key.cast("string"), F.lit("None")))
    return named.groupBy("__key").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def distinct_seals(rows: DataFrame, code: str, colour: str, fields: list[str], order: str) -> DataFrame:
    """The first seal of each code and colour; a seal without a code is distinct by
    all its fields."""
    has = F.coalesce(F.col(code), F.lit("")) != ""
    key = F.when(has, F.to_json(F.struct(code, colour))).otherwise(F.concat(F.lit("all:"), F.to_json(F.struct(*fields))))
    return rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def longest_of_pass(first: DataFrame, second: DataFrame, key: str, code: str) -> DataFrame:
    """The second pass's longest code replaces the first's if at least as long."""
    best = second.where(F.col(code).isNotNull()).groupBy(key).agg(F.max(F.struct(F.length(code).alias("l"), F.col(code).alias("c"))).alias("b"))
    better = F.col("b.l") >= F.length(F.coalesce(code, F.lit("")))
    return first.join(best, key, "left").withColumn(code, F.when(better, F.col("b.c")).otherwise(F.col(code))).drop("b")
