"""Queries over cross-source reconciliation (survey 3.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import money
from tallyweave.operators import reconcile as R
from tallyweave.plans.fixtures import table
from tallyweave.plans.registry import query

_SHEETS = "(SELECT DISTINCT sheet FROM {ledger})"
_KNOWN = f"(SELECT * FROM {{narrative}} WHERE sheet IN {_SHEETS})"
_LINKS = f"""(SELECT n.rec_id, n.batch_id, l.ledger_id, coalesce(m.n, 0) AS n_matches FROM {_KNOWN} n
    LEFT JOIN {{ledger}} l ON l.sheet = n.sheet AND l.code = n.code
    LEFT JOIN (SELECT sheet, code, count(*) AS n FROM {{ledger}} GROUP BY ALL) m ON m.sheet = n.sheet AND m.code = n.code)"""
_VALID = "(SELECT * FROM {details} WHERE company <> '' AND direction IN (1, -1) AND amount IS NOT NULL AND unit <> '')"


def _three(spark, d):
    n, l = table(spark, d, "narrative"), table(spark, d, "ledger")
    return R.links(n, l), n, l


@query("j1_missing_sheets", f"SELECT rec_id, sheet FROM {{narrative}} WHERE sheet NOT IN {_SHEETS}")
def j1(spark, d):
    return R.missing_sheets(table(spark, d, "narrative"), table(spark, d, "ledger")).select("rec_id", "sheet")


@query("j2_links", f"SELECT rec_id, batch_id, ledger_id, n_matches FROM {_LINKS}")
def j2(spark, d):
    return _three(spark, d)[0]


@query("j2_link_exceptions", f"""SELECT rec_id, CAST(1 AS INTEGER) AS type_id, 'code' AS field, '0' AS value FROM {_LINKS} WHERE n_matches = 0
    UNION ALL SELECT DISTINCT rec_id, 10, 'code', CAST(n_matches AS VARCHAR) FROM {_LINKS} WHERE n_matches > 1""")
def j2x(spark, d):
    return R.link_exceptions(_three(spark, d)[0])


@query("j3_name_errors", f"""SELECT k.rec_id, CAST(2 AS INTEGER) AS type_id, 'name' AS field, l.name AS value FROM {_LINKS} k JOIN {{ledger}} l ON l.ledger_id = k.ledger_id
    JOIN {{narrative}} n ON n.rec_id = k.rec_id WHERE k.n_matches = 1 AND regexp_replace(regexp_replace(l.name, '^\\s*([0-9]+[.、．]\\s*)+', ''), '\\s+', '', 'g') <> n.name""")
def j3(spark, d):
    return R.name_errors(*_three(spark, d))


@query("j4_link_detail", f"""SELECT k.rec_id, k.ledger_id, n.sheet, n.code, n.name, CAST(n.amount AS DOUBLE) AS amount, n.para, l.name AS ledger_name, CAST(l.cur_rmb AS DOUBLE) AS cur_rmb, CAST(l.pre_rmb AS DOUBLE) AS pre_rmb
    FROM {_LINKS} k JOIN {{narrative}} n ON n.rec_id = k.rec_id LEFT JOIN {{ledger}} l ON l.ledger_id = k.ledger_id""")
def j4(spark, d):
    out = R.link_detail(*_three(spark, d))
    return out.withColumns({c: F.col(c).cast("double") for c in ("amount", "cur_rmb", "pre_rmb")}).orderBy("sheet", F.asc_nulls_last("para"), "rec_id")


@query("j7_direction_errors", f"""SELECT DISTINCT v.rec_id, CAST(13 AS INTEGER) AS type_id, 'company' AS field, v.company AS value FROM {_VALID} v JOIN {{narrative}} n ON n.rec_id = v.rec_id
    WHERE n.direction IN (1, -1) AND NOT n.blocked AND v.direction <> n.direction""")
def j7(spark, d):
    return R.direction_errors(table(spark, d, "details"), table(spark, d, "narrative"))


@query("a7_conflicts", f"""SELECT DISTINCT v.rec_id, CAST(7 AS INTEGER) AS type_id, 'company' AS field, v.company AS value FROM {_VALID} v JOIN (SELECT batch_id, company FROM {_VALID} GROUP BY ALL
    HAVING count(*) > 1 AND (count(DISTINCT direction) > 1 OR count(DISTINCT amount) > 1 OR count(DISTINCT unit) > 1)) g ON g.batch_id = v.batch_id AND g.company = v.company""")
def a7(spark, d):
    return R.conflicts(table(spark, d, "details"))


@query("a8_repeated", "SELECT rec_id, CAST(15 AS INTEGER) AS type_id, 'company' AS field, company AS value FROM {details} GROUP BY rec_id, company HAVING count(*) > 1")
def a8(spark, d):
    return R.repeated(table(spark, d, "details"))


_ROUND = "CASE places WHEN 0 THEN round({x}, 0) WHEN 1 THEN round({x}, 1) ELSE round({x}, 2) END"
_FACTOR = "CASE unit WHEN '亿元' THEN 1.0::DOUBLE WHEN '亿美元' THEN 1.0::DOUBLE WHEN '亿' THEN 1.0::DOUBLE WHEN '万元' THEN 0.0001::DOUBLE WHEN '万' THEN 0.0001::DOUBLE WHEN '万美元' THEN 0.0001::DOUBLE WHEN '元' THEN 0.00000001::DOUBLE WHEN '美元' THEN 0.00000001::DOUBLE END"


@query("c18_units", f"SELECT rec_id, unit, {_FACTOR} AS factor, round(CAST(amount AS DOUBLE) * {_FACTOR}, 6) AS in_yi FROM {{narrative}}")
def c18(spark, d):
    return table(spark, d, "narrative").select("rec_id", "unit", money.unit_factor(F.col("unit")).alias("factor"), F.round(money.to_yi(F.col("amount"), F.col("unit")), 6).alias("in_yi"))


_CONFLICT = "CASE WHEN scope IN ('foreign', 'rmb') THEN unit IN ('美元', '万美元', '亿美元') WHEN scope = 'usd_total' THEN unit IN ('元', '万', '万元', '亿', '亿元') ELSE false END"


@query("c19_scope_conflict", f"SELECT rec_id, scope, unit, {_CONFLICT} AS conflict FROM {{narrative}}")
def c19(spark, d):
    return table(spark, d, "narrative").select("rec_id", "scope", "unit", money.scope_conflict(F.col("scope"), F.col("unit")).alias("conflict"))


@query("c20_round", "SELECT rec_id, CAST(CASE places WHEN 0 THEN round(amount, 0) WHEN 1 THEN round(amount, 1) ELSE amount END AS DOUBLE) AS rounded FROM {narrative}")
def c20(spark, d):
    return table(spark, d, "narrative").select("rec_id", money.round_to(F.col("amount").cast("double"), F.col("places")).alias("rounded"))


@query("c32_unsupported_units", f"SELECT rec_id, CAST(4 AS INTEGER) AS type_id, 'unit' AS field, unit AS value FROM {{narrative}} WHERE unit <> '' AND {_FACTOR} IS NULL")
def c32(spark, d):
    n = table(spark, d, "narrative")
    return R.exception(n.where((F.col("unit") != "") & money.unit_factor(F.col("unit")).isNull()), R.UNIT, "unit", F.col("unit"))


_PAIRS = f"""(SELECT n.*, l.cur_rmb, l.pre_rmb, l.cur_foreign, l.pre_foreign,
    CASE WHEN n.scope <> '' THEN n.scope WHEN n.unit IN ('美元', '万美元', '亿美元') THEN 'usd_total' WHEN coalesce(l.cur_rmb, l.pre_rmb) IS NOT NULL THEN 'rmb' ELSE 'foreign' END AS s
    FROM {_LINKS} k JOIN {{ledger}} l ON l.ledger_id = k.ledger_id JOIN {{narrative}} n ON n.rec_id = k.rec_id WHERE k.n_matches = 1 AND NOT n.blocked)"""


@query("c21_scope", f"SELECT rec_id, s AS resolved FROM {_PAIRS}")
def c21(spark, d):
    linked, n, l = _three(spark, d)
    one = linked.where("n_matches = 1").select("rec_id", "ledger_id").join(l.drop("sheet", "code", "name"), "ledger_id").join(n.where(~F.col("blocked")), "rec_id")
    return one.select("rec_id", money.scope_of(F.col("scope"), F.col("unit"), F.col("cur_rmb"), F.col("pre_rmb")).alias("resolved"))


_V = f"""(SELECT *, CASE WHEN s = 'rmb' THEN cur_rmb ELSE cur_foreign END AS cur, CASE WHEN s = 'rmb' THEN pre_rmb ELSE pre_foreign END AS pre, {_FACTOR} AS factor, {_CONFLICT} AS conflict FROM {_PAIRS})"""
_W = f"""(SELECT *, coalesce(CAST(cur AS DOUBLE), 0) - coalesce(CAST(pre AS DOUBLE), 0) AS change, CASE WHEN unit IN ('万元', '万', '万美元') THEN CAST(amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) * factor END AS own FROM {_V})"""
_X = f"""(SELECT *, CASE WHEN unit IN ('万元', '万', '万美元') THEN change ELSE change / 10000 END AS led FROM {_W})"""
_DIFFERS = "(" + _ROUND.replace("{x}", "direction * own") + ") <> (" + _ROUND.replace("{x}", "led") + ")"


@query("c23_amount_errors", f"""SELECT rec_id, CAST(9 AS INTEGER) AS type_id, 'scope' AS field, s AS value FROM {_X} WHERE cur IS NULL AND pre IS NULL
    UNION ALL SELECT rec_id, 8, 'cur', s FROM {_X} WHERE cur IS NULL AND pre IS NOT NULL UNION ALL SELECT rec_id, 8, 'pre', s FROM {_X} WHERE cur IS NOT NULL AND pre IS NULL
    UNION ALL SELECT rec_id, 3, 'amount', 'missing' FROM {_X} WHERE direction NOT IN (1, -1) OR amount IS NULL UNION ALL SELECT rec_id, 4, 'unit', unit FROM {_X} WHERE factor IS NULL
    UNION ALL SELECT rec_id, 3, 'scope', unit FROM {_X} WHERE conflict
    UNION ALL SELECT rec_id, 3, 'amount', 'differs' FROM {_X} WHERE direction IN (1, -1) AND amount IS NOT NULL AND factor IS NOT NULL AND NOT conflict AND NOT (cur IS NULL AND pre IS NULL) AND {_DIFFERS}""")
def c23(spark, d):
    return R.amount_errors(*_three(spark, d))


@query("a1_batch_links", f"SELECT batch_id, count(ledger_id) AS linked, count(*) - count(ledger_id) AS unmatched FROM {_LINKS} GROUP BY batch_id")
def a1(spark, d):
    return R.batch_counts(_three(spark, d)[0])


_A2 = "(SELECT batch_id, count(*) AS n_single FROM {exceptions} WHERE type_id IN (1,2,3,5,8,9,10) AND rec_id IS NOT NULL GROUP BY batch_id)"
_A3 = "(SELECT batch_id, count(DISTINCT rec_id) AS n_format FROM {exceptions} WHERE type_id IN (4,12,16) GROUP BY batch_id)"
_A4 = "(SELECT batch_id, count(*) AS n_tuple FROM (SELECT DISTINCT batch_id, type_id, rec_id, company FROM {exceptions} WHERE type_id IN (13,15)) GROUP BY batch_id)"
_A5 = """(SELECT batch_id, CAST(sum(greatest(coalesce(n, 0), 1)) AS BIGINT) AS n_detail FROM {exceptions} e LEFT JOIN (SELECT rec_id, company, count(*) AS n FROM {details} GROUP BY ALL) m
    ON m.rec_id = e.rec_id AND m.company = e.company WHERE type_id = 7 GROUP BY batch_id)"""


@query("a2_single_count", f"SELECT * FROM {_A2}")
def a2(spark, d):
    return R.single_count(table(spark, d, "exceptions"))


@query("a3_format_count", f"SELECT * FROM {_A3}")
def a3(spark, d):
    return R.format_count(table(spark, d, "exceptions"))


@query("a4_tuple_count", f"SELECT * FROM {_A4}")
def a4(spark, d):
    return R.tuple_count(table(spark, d, "exceptions"))


@query("a5_detail_count", f"SELECT * FROM {_A5}")
def a5(spark, d):
    return R.detail_count(table(spark, d, "exceptions"), table(spark, d, "details"))


@query("a6_batch_total", f"""SELECT b.batch_id, CAST(coalesce(n_single, 0) + coalesce(n_format, 0) + coalesce(n_tuple, 0) + coalesce(n_detail, 0) AS BIGINT) AS exception_count
    FROM (SELECT DISTINCT c_custkey % 60 AS batch_id FROM customer) b LEFT JOIN {_A2} x ON x.batch_id = b.batch_id LEFT JOIN {_A3} y ON y.batch_id = b.batch_id
    LEFT JOIN {_A4} z ON z.batch_id = b.batch_id LEFT JOIN {_A5} w ON w.batch_id = b.batch_id""")
def a6(spark, d):
    batches = table(spark, d, "customer").select((F.col("c_custkey") % 60).alias("batch_id")).distinct()
    return R.batch_total(batches, table(spark, d, "exceptions"), table(spark, d, "details"))


@query("d3_all_exceptions", f"""SELECT DISTINCT v.rec_id, CAST(13 AS INTEGER) AS type_id, 'company' AS field, v.company AS value FROM {_VALID} v JOIN {{narrative}} n ON n.rec_id = v.rec_id
    WHERE n.direction IN (1, -1) AND NOT n.blocked AND v.direction <> n.direction
    UNION SELECT rec_id, 15, 'company', company FROM {{details}} GROUP BY rec_id, company HAVING count(*) > 1 UNION SELECT rec_id, type_id, field, value FROM {{exceptions}}""")
def d3(spark, d):
    details = table(spark, d, "details")
    return R.unite(R.direction_errors(details, table(spark, d, "narrative")), R.repeated(details), table(spark, d, "exceptions").select("rec_id", "type_id", "field", "value"))


@query("d2_distinct_exceptions", "SELECT DISTINCT rec_id, type_id, field, value FROM {exceptions}")
def d2(spark, d):
    return table(spark, d, "exceptions").select("rec_id", "type_id", "field", "value").distinct()


@query("f4_valid_details", f"SELECT rec_id, company, CAST(amount AS DOUBLE) AS amount FROM {_VALID}")
def f4(spark, d):
    return table(spark, d, "details").where(R.valid_detail()).select("rec_id", "company", F.col("amount").cast("double").alias("amount"))


@query("f5_ledger_rows", "SELECT ledger_id, code, name FROM {ledger} WHERE code <> '' AND name <> '' AND regexp_replace(regexp_replace(name, '^\\s*([0-9]+[.、．]\\s*)+', ''), '\\s+', '', 'g') <> ''")
def f5(spark, d):
    return table(spark, d, "ledger").where((F.col("code") != "") & (F.col("name") != "") & (money.indicator_name(F.col("name")) != "")).select("ledger_id", "code", "name")


@query("a25_table_counts", "SELECT batch_id, count(*) AS n, count(*) FILTER (WHERE type_id = 3) AS n_amount FROM {exceptions} GROUP BY batch_id")
def a25(spark, d):
    return table(spark, d, "exceptions").groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(F.col("type_id") == 3).alias("n_amount"))


@query("o1_ordered", "SELECT rec_id, sheet, CASE WHEN para = 5 THEN NULL ELSE para END AS para FROM {narrative} ORDER BY sheet, para NULLS LAST, rec_id")
def o1(spark, d):
    return table(spark, d, "narrative").select("rec_id", "sheet", F.when(F.col("para") != 5, F.col("para")).alias("para")).orderBy("sheet", F.asc_nulls_last("para"), "rec_id")


@query("j6_company_exceptions", """SELECT e.rec_id, e.company, CAST(d.amount AS DOUBLE) AS amount FROM {exceptions} e LEFT JOIN {details} d ON d.rec_id = e.rec_id AND d.company = e.company WHERE e.type_id IN (7, 13, 15)""")
def j6(spark, d):
    e = table(spark, d, "exceptions").where(F.col("type_id").isin(7, 13, 15)).select("rec_id", "company")
    return e.join(table(spark, d, "details").select("rec_id", "company", F.col("amount").cast("double").alias("amount")), ["rec_id", "company"], "left")


@query("c51_amount_text", """SELECT rec_id, CASE direction WHEN 1 THEN '增加' WHEN -1 THEN '减少' ELSE '' END || coalesce(CAST(amount AS VARCHAR), '') || coalesce(unit, '') AS amount_text FROM {narrative}""")
def c51(spark, d):
    word = F.when(F.col("direction") == 1, "增加").when(F.col("direction") == -1, "减少").otherwise("")
    return table(spark, d, "narrative").select("rec_id", F.concat_ws("", word, F.col("amount").cast("string"), "unit").alias("amount_text"))


@query("f6_narrative_records", "SELECT rec_id, code, name FROM {narrative} WHERE code <> '' AND name <> '' AND code IS NOT NULL AND name IS NOT NULL")
def f6(spark, d):
    from tallyweave.functions import narrative as N

    n = table(spark, d, "narrative").withColumn("sentence", F.concat(F.lit("1. “"), "code", F.lit(" "), "name", F.lit("”较上期增加1.2亿元")))
    parts = n.select("rec_id", N.code_and_name(N.quoted(F.col("sentence"))).alias("p"))
    return parts.where("p.code is not null and p.name is not null").select("rec_id", "p.code", "p.name")
