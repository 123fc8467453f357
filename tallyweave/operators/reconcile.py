"""Cross-source reconciliation: narrative records against ledger rows.

Every test gives rows of one exception table: (rec_id, type_id, field, value). The
joins are equi joins; a side's matches are counted before the join, so a record with
many matches costs no window over all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import money

# Exception types and their display names.
TYPES = {
    1: "指标代码异常", 2: "指标名称异常", 3: "指标数值异常", 4: "指标数值单位异常", 5: "表单无对应异常", 6: "指标无对应异常",
    7: "关联公司数值异常", 8: "余额缺失异常", 9: "计算要求异常", 10: "excel异常", 11: "其他异常", 12: "格式异常",
    13: "关联公司方向不一致", 14: "关联公司格式异常", 15: "同一记录关联公司重复出现", 16: "标点符号异常",
}
CODE, NAME, AMOUNT, UNIT, SHEET, COMPANY_AMOUNT, BALANCE, CALCULATION, EXCEL = 1, 2, 3, 4, 5, 7, 8, 9, 10
COMPANY_DIRECTION, COMPANY_REPEATED = 13, 15


def exception(df: DataFrame, type_id: int, field: str, value: Column) -> DataFrame:
    """Exception rows of the records in df."""
    return df.select("rec_id", F.lit(type_id).alias("type_id"), F.lit(field).alias("field"), value.cast("string").alias("value"))


def missing_sheets(narrative: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records whose sheet the ledger does not have; no other test applies to them."""
    return narrative.join(ledger.select("sheet").distinct(), "sheet", "left_anti")


def links(narrative: DataFrame, ledger: DataFrame) -> DataFrame:
    """(rec_id, ledger_id, n_matches) over sheet and code. A record without a
    match gives one row with null; with several, one for each."""
    known = narrative.join(ledger.select("sheet").distinct(), "sheet", "left_semi")
    many = ledger.groupBy("sheet", "code").agg(F.count("*").alias("n_matches"))
    right = ledger.select("sheet", "code", "ledger_id").join(many, ["sheet", "code"])
    return known.select("rec_id", "batch_id", "sheet", "code").join(right, ["sheet", "code"], "left").select("rec_id", "batch_id", "ledger_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def link_exceptions(linked: DataFrame) -> DataFrame:
    """No match is a code error, several are an error of the ledger; once a record."""
    none = exception(linked.where("n_matches = 0"), CODE, "code", F.lit("0"))
    several = linked.where("n_matches > 1").select("rec_id", "n_matches").distinct()
    return none.unionByName(exception(several, EXCEL, "code", F.col("n_matches")))


def name_errors(linked: DataFrame, narrative: DataFrame, ledger: DataFrame) -> DataFrame:
    """On links one to one, the ledger's name without blanks and index must equal
    the record's as written."""
    one = linked.where("n_matches = 1").select("rec_id", "ledger_id")
    pairs = one.join(ledger.select("ledger_id", F.col("name").alias("ledger_name")), "ledger_id").join(narrative.select("rec_id", "name"), "rec_id")
    return exception(pairs.where(money.indicator_name(F.col("ledger_name")) != F.col("name")), NAME, "name", F.col("ledger_name"))


def link_detail(linked: DataFrame, narrative: DataFrame, ledger: DataFrame) -> DataFrame:
    """Links with both sides' columns."""
    left = narrative.select("rec_id", "sheet", "code", "name", "amount", "para")
    right = ledger.select("ledger_id", F.col("name").alias("ledger_name"), "cur_rmb", "pre_rmb")
    return linked.select("rec_id", "ledger_id").join(left, "rec_id").join(right, "ledger_id", "left")


def amount_errors(linked: DataFrame, narrative: DataFrame, ledger: DataFrame) -> DataFrame:
    """Exceptions of the amounts of one-to-one links. The ledger's change
    is taken in the resolved scope and compared, signed and rounded to the record's
    places, in units of 亿."""
    one = linked.where("n_matches = 1").select("rec_id", "ledger_id")
    pairs = one.join(ledger.drop("sheet", "code", "name"), "ledger_id").join(narrative.where(~F.col("blocked")), "rec_id")
    found = money.amount_exceptions(pairs)
    return found.select("rec_id", F.explode("found").alias("e")).select("rec_id", "e.type_id", "e.field", "e.value")


def valid_detail() -> Column:
    """a detail with company, direction, amount and unit."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return filled("company") & F.col("direction").isin(1, -1) & F.col("amount").isNotNull() & filled("unit")


def direction_errors(details: DataFrame, narrative: DataFrame) -> DataFrame:
    """A valid detail against the direction of its record; once a company."""
    main = narrative.where(F.col("direction").isin(1, -1) & ~F.col("blocked")).select("rec_id", F.col("direction").alias("main"))
    off = details.where(valid_detail()).join(main, "rec_id").where("direction <> main").select("rec_id", "company").distinct()
    return exception(off, COMPANY_DIRECTION, "company", F.col("company"))


def conflicts(details: DataFrame) -> DataFrame:
    """Companies of a batch whose valid details differ in direction, amount or
    unit; one exception for each record that has one."""
    valid = details.where(valid_detail())
    differ = valid.groupBy("batch_id", "company").agg(F.count("*").alias("n"), *[(F.min(c) != F.max(c)).alias(f"x_{c}") for c in ("direction", "amount", "unit")])
    odd = differ.where("n > 1 and (x_direction or x_amount or x_unit)").select("batch_id", "company")
    return exception(valid.join(odd, ["batch_id", "company"]).select("rec_id", "company").distinct(), COMPANY_AMOUNT, "company", F.col("company"))


def repeated(details: DataFrame) -> DataFrame:
    """A company that a record names twice or more."""
    return exception(details.groupBy("rec_id", "company").count().where("count > 1"), COMPANY_REPEATED, "company", F.col("company"))


def unite(*streams: DataFrame) -> DataFrame:
    """All exceptions, each once. They are dealt by record first: nearly all
    differ, so that the tasks that make them would gather all of theirs in vain."""
    return reduce(DataFrame.unionByName, streams).repartition("rec_id", "type_id").distinct()


def batch_counts(linked: DataFrame) -> DataFrame:
    """A1: linked and unmatched rows of each batch."""
    return linked.groupBy("batch_id").agg(F.count_if(F.col("ledger_id").isNotNull()).alias("linked"), F.count_if(F.col("ledger_id").isNull()).alias("unmatched"))


#: Types that count once each, once a record, once a tuple, and by their details.
SINGLE, FORMAT, TUPLE = (1, 2, 3, 5, 8, 9, 10), (4, 12, 16), (13, 15)


def single_count(exceptions: DataFrame) -> DataFrame:
    """A2: rows of the listed types."""
    return exceptions.where(F.col("type_id").isin(*SINGLE) & F.col("rec_id").isNotNull()).groupBy("batch_id").agg(F.count("*").alias("n_single"))


def format_count(exceptions: DataFrame) -> DataFrame:
    """A3: records with a format exception. Records are made distinct before they
    are counted, so a batch's records are not gathered in one place."""
    return exceptions.where(F.col("type_id").isin(*FORMAT)).select("batch_id", "rec_id").distinct().groupBy("batch_id").agg(F.count("rec_id").alias("n_format"))


def tuple_count(exceptions: DataFrame) -> DataFrame:
    """A4: distinct (type, record, company) of the listed types."""
    return exceptions.where(F.col("type_id").isin(*TUPLE)).select("batch_id", "type_id", "rec_id", "company").distinct().groupBy("batch_id").agg(F.count("*").alias("n_tuple"))


def detail_count(exceptions: DataFrame, details: DataFrame) -> DataFrame:
    """A5: for each exception of type 7 its record's details of that company, at
    least one, added up."""
    many = details.groupBy("rec_id", "company").agg(F.count("*").alias("n"))
    joined = exceptions.where(F.col("type_id") == COMPANY_AMOUNT).join(many, ["rec_id", "company"], "left")
    return joined.groupBy("batch_id").agg(F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("n_detail"))


def batch_total(batches: DataFrame, exceptions: DataFrame, details: DataFrame) -> DataFrame:
    """All counted exceptions of every batch, 0 for a batch without any."""
    out = batches
    parts = [single_count(exceptions), format_count(exceptions), tuple_count(exceptions), detail_count(exceptions, details)]
    for part in parts:
        out = out.join(part, "batch_id", "left")
    names = ["n_single", "n_format", "n_tuple", "n_detail"]
    return out.select("batch_id", sum((F.coalesce(n, F.lit(0)) for n in names), F.lit(0)).cast("bigint").alias("exception_count"))
