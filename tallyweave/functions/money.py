"""Column functions on amounts, units and indicator names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units as a share of 亿, and the currency they speak of.
UNITS = {"亿元": 1.0, "亿美元": 1.0, "亿": 1.0, "万元": 0.0001, "万": 0.0001, "万美元": 0.0001, "元": 0.00000001, "美元": 0.00000001}
USD_UNITS = ["美元", "万美元", "亿美元"]
RMB_UNITS = ["元", "万", "万元", "亿", "亿元"]
WAN_UNITS = ["万元", "万", "万美元"]


def decimal_of(text: Column) -> Column:
    """Money text without commas and blanks, null where it is not a number."""
    return F.regexp_replace(text, r"[,\s]", "").try_cast("decimal(18,2)")


def invoice_amount(text: Column) -> Column:
    """The first number once currency marks, commas and blanks are gone."""
    return F.regexp_extract(F.regexp_replace(text, r"[¥￥,\s]", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def ledger_number(text: Column) -> Column:
    """A number, or null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def ledger_code(text: Column) -> Column:
    """A code as text; a whole number loses its '.0'."""
    return F.regexp_replace(F.trim(text), r"\.0$", "")


def numeric_cell(text: Column) -> Column:
    """C4: the number of a cell: parentheses make it negative, % and commas go."""
    bare = F.regexp_replace(F.trim(text), r"[,%％\s]", "")
    inner = F.regexp_extract(bare, r"^[(（](.*)[)）]$", 1)
    return F.when(inner != "", -inner.try_cast("double")).otherwise(bare.try_cast("double"))


def compare_key(text: Column) -> Column:
    """Text without currency signs, blanks and commas, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[¥￥$,，\s元]", ""))


def field_status(a: Column, b: Column) -> Column:
    """How two fields agree once keys are compared."""
    x, y = compare_key(a), compare_key(b)
    return F.when((x == "") & (y == ""), "both_empty").when((x == "") | (y == ""), "one_side_empty").when(x == y, "consistent").otherwise("inconsistent")


def indicator_name(text: Column) -> Column:
    """C11: a name without its leading index and without blanks."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*(?:\d+[.、．]\s*)+", ""), r"\s+", "")


def unit_factor(unit: Column) -> Column:
    """What one of the unit is in 亿, null for an unknown unit."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), F.trim(F.coalesce(unit, F.lit(""))))


def to_yi(amount: Column, unit: Column) -> Column:
    return amount.cast("double") * unit_factor(unit)


def scope_conflict(scope: Column, unit: Column) -> Column:
    """A scope that the unit's currency contradicts."""
    u = F.trim(F.coalesce(unit, F.lit("")))
    return F.when(scope.isin("foreign", "rmb"), u.isin(*USD_UNITS)).when(scope == "usd_total", u.isin(*RMB_UNITS)).otherwise(F.lit(False))


def round_to(x: Column, places: Column) -> Column:
    """C20: half-up rounding of a double to 0 to 12 places, each row its own."""
    out = F.round(x, 12)
    for k in range(11, -1, -1):
        out = F.when(places <= k, F.round(x, k)).otherwise(out)
    return out


def scope_of(hint: Column, unit: Column, *rmb: Column) -> Column:
    """The hint, else dollars' total for a dollar unit, else yuan if the ledger
    has any yuan value, else foreign."""
    return F.when(F.coalesce(hint, F.lit("")) != "", hint).when(F.trim(unit).isin(*USD_UNITS), "usd_total").when(F.coalesce(*rmb).isNotNull(), "rmb").otherwise("foreign")


def amount_exceptions(pairs: DataFrame) -> DataFrame:
    """Pairs with `found`, an array of (type_id, field, value)."""
    scope = scope_of(F.col("scope"), F.col("unit"), F.col("cur_rmb"), F.col("pre_rmb"))
    cur, pre = (F.when(F.col("s") == "rmb", F.col(f"{c}_rmb")).otherwise(F.col(f"{c}_foreign")) for c in ("cur", "pre"))
    work = pairs.withColumn("s", scope).withColumn("cur", cur).withColumn("pre", pre)
    change = F.coalesce(F.col("cur").cast("double"), F.lit(0.0)) - F.coalesce(F.col("pre").cast("double"), F.lit(0.0))
    ledger = F.when(F.trim("unit").isin(*WAN_UNITS), change).otherwise(change / 10000)
    wan = F.when(F.trim("unit").isin(*WAN_UNITS), F.col("amount").cast("double")).otherwise(to_yi(F.col("amount"), F.col("unit")))
    differs = round_to(F.col("direction") * wan, F.col("places")) != round_to(ledger, F.col("places"))
    make = lambda when, kind, field, value: F.when(when, F.struct(F.lit(kind).alias("type_id"), F.lit(field).alias("field"), value.cast("string").alias("value")))
    no_values = F.col("cur").isNull() & F.col("pre").isNull()
    usable = F.col("direction").isin(1, -1) & F.col("amount").isNotNull() & unit_factor(F.col("unit")).isNotNull() & ~scope_conflict(F.col("scope"), F.col("unit"))
    found = F.array_compact(
        F.array(
            make(no_values, 9, "scope", F.col("s")),
            make(~no_values & F.col("cur").isNull(), 8, "cur", F.col("s")),
            make(~no_values & F.col("pre").isNull(), 8, "pre", F.col("s")),
            make(~F.col("direction").isin(1, -1) | F.col("amount").isNull(), 3, "amount", F.lit("missing")),
            make(unit_factor(F.col("unit")).isNull(), 4, "unit", F.col("unit")),
            make(scope_conflict(F.col("scope"), F.col("unit")), 3, "scope", F.col("unit")),
            make(usable & ~no_values & differs, 3, "amount", F.lit("differs")),
        )
    )
    return work.withColumn("found", found)
