"""Queries over letter and narrative fields whose inputs vary with the data, with SQL that
works the answers out from the parts that the texts were put together from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions import letters as L
from tallyweave.functions import narrative as N
from tallyweave.plans.fixtures import table
from tallyweave.plans.registry import query
from tallyweave.sources.files import check_pdf


def _orders(spark, d, *texts: str):
    """Orders with texts, each in the SQL that both engines share."""
    return table(spark, d, "orders").select("o_orderkey", *[F.expr(t).alias(f"t{n}") for n, t in enumerate(texts)])


def _text(*parts: str) -> str:
    return " || ".join(f"cast({p} as string)" for p in parts)


_Y, _M, _D = "(2000 + o_orderkey % 30)", "(1 + o_orderkey % 13)", "(1 + o_custkey % 32)"
_DATED = f"CASE o_orderkey % 4 WHEN 0 THEN {_text("'于 '", _Y, "' 年 '", _M, "'月'", _D, "'日'")} WHEN 1 THEN {_text(_Y, "'/'", _M, "'/'", _D)} WHEN 2 THEN {_text("'x '", _Y, "'-'", _M, "'.'", _D, "' y'")} ELSE {_text("'no '", f'{_Y} * 10000 + {_M} * 100 + {_D}')} END"


@query("c33_dates", f"SELECT o_orderkey, coalesce(strftime(try_cast(printf('%04d-%02d-%02d', {_Y}, {_M}, {_D}) AS DATE), '%Y-%m-%d'), '') AS day FROM orders")
def c33(spark, d):
    return _orders(spark, d, _DATED).select("o_orderkey", L.clean_date(F.col("t0")).alias("day"))


_A, _B = "(1 + o_orderkey % 9)", "(1 + o_custkey % 13)"
_DAY = "CASE o_orderkey % 5 WHEN 0 THEN '2024-03-01' WHEN 1 THEN '2024-03-02' WHEN 2 THEN '2024-03-07' WHEN 3 THEN '2024-03-09' ELSE '2024-03-15' END"
_SEEN = _text("'a 2024-03-'", _A, "' b 2024 年 3 月 '", _B, "'日 c 2024/4/9'")


@query("c34_repaired_dates", f"""SELECT o_orderkey, CASE WHEN d IN (a, b) THEN printf('2024-03-%02d', d) WHEN d = 1 AND 2 IN (a, b) THEN '2024-03-02' WHEN d = 1 AND 7 IN (a, b) THEN '2024-03-07' WHEN d IN (2, 7) AND 1 IN (a, b) THEN '2024-03-01' WHEN a = b THEN printf('2024-03-%02d', a) ELSE printf('2024-03-%02d', d) END AS day
    FROM (SELECT o_orderkey, {_A} AS a, {_B} AS b, CAST(right({_DAY}, 2) AS BIGINT) AS d FROM orders)""")
def c34(spark, d):
    return _orders(spark, d, _DAY, _SEEN).select("o_orderkey", L.repair_date(F.col("t0"), F.col("t1")).alias("day"))


_FROM, _TO = _text(_Y, "'年'", _A, "'月'", _B, "'日'"), _text(_Y, "'-'", _B, "'-'", _A)
_SPAN = f"CASE o_orderkey % 5 WHEN 0 THEN {_FROM} || '至' || {_TO} WHEN 1 THEN {_TO} || ' 到 ' || {_FROM} WHEN 2 THEN {_TO} || ' - ' || {_TO} WHEN 3 THEN {_text(f'20240101 + {_A}', "'-'", f'20240301 + {_B}')} ELSE '' END"


@query("c35_date_ranges", f"SELECT o_orderkey, {_SPAN} AS span FROM orders")
def c35(spark, d):
    text = f"{_text("'account '", 'o_custkey', "' for '")} || {_SPAN} || CASE WHEN o_orderkey % 5 = 4 THEN {_FROM} ELSE ' and so on' END"
    return _orders(spark, d, text).select("o_orderkey", L.date_range(F.col("t0")).alias("span"))


_STAMP, _SIGNED = "date_format(o_orderdate, 'yyyy-MM-dd')", "date_format(o_orderdate + make_interval(0, 0, 0, cast(o_custkey % 3 as int)), 'yyyy-MM-dd')"


@query("c36_signed_dates", "SELECT o_orderkey, strftime(o_orderdate + to_days(CAST(o_custkey % 3 AS INTEGER)), '%Y-%m-%d') AS day FROM orders")
def c36(spark, d):
    return _orders(spark, d, _STAMP, f"concat('stamp ', {_STAMP}, ' signed ', {_SIGNED}, ' again ', {_STAMP})").select("o_orderkey", L.other_date(F.col("t0"), F.col("t1")).alias("day"))


_NUMBERS = ["CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '021-' || cast(o_custkey as string) END", "cast(o_orderkey as string)", "CASE WHEN o_custkey % 4 = 0 THEN '+86 (10) ' || cast(o_orderkey % 100 as string) ELSE '' END"]
_MARKS = ["CASE o_orderkey % 3 WHEN 0 THEN '、' WHEN 1 THEN ',' ELSE '/' END", "CASE o_custkey % 2 WHEN 0 THEN '，' ELSE '／' END"]


@query("c37_phone_lists", f"SELECT o_orderkey, array_to_string(list_filter([{', '.join(_NUMBERS)}], lambda x: x <> ''), '，') AS phones FROM orders".replace("as string", "AS VARCHAR"))
def c37(spark, d):
    text = f"' ' || {_NUMBERS[0]} || '（项目' || cast(o_orderkey as string) || '组）' || {_MARKS[0]} || {_NUMBERS[1]} || CASE WHEN o_orderkey % 2 = 0 THEN '分机' ELSE '' END || {_MARKS[1]} || {_NUMBERS[2]} || ' '"
    return _orders(spark, d, text).select("o_orderkey", L.phones(F.col("t0")).alias("phones"))


_CODE = "o_orderkey * 37 % 3000000"


@query("c38_codes_in_text", f"SELECT o_orderkey, CASE WHEN length(CAST({_CODE} AS VARCHAR)) = 6 THEN CAST({_CODE} AS VARCHAR) ELSE '' END AS postal, CAST(o_custkey AS VARCHAR) || CAST(o_orderkey % 7 AS VARCHAR) AS account FROM orders")
def c38(spark, d):
    found = _orders(spark, d, _text("'邮编 '", _CODE, "' x'"), _text("'No '", "o_custkey", "'-AB '", "o_orderkey % 7", "'号'"))
    return found.select("o_orderkey", L.postal_code(F.col("t0")).alias("postal"), L.account(F.col("t1")).alias("account"))


_PARTS = ["o_custkey % 90 + 1", "o_orderkey % 1000 + 1"]


@query("c27_companies", f"""SELECT o_orderkey, company, CAST(direction AS INTEGER) AS direction, CAST(amount AS DOUBLE) AS amount, unit FROM (
    SELECT o_orderkey, '甲' || CAST(o_custkey AS VARCHAR) || '公司' AS company, 1 AS direction, {_PARTS[0]} + 0.5 AS amount, '万元' AS unit FROM orders WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey, '乙', -1, {_PARTS[1]}, '亿美元' FROM orders WHERE o_orderkey % 3 <> 1 UNION ALL SELECT o_orderkey, '丙厂', CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END, 1000 + {_PARTS[0]}, '元' FROM orders WHERE o_orderkey % 4 = 2)""")
def c27(spark, d):
    first = f"CASE WHEN o_orderkey % 3 <> 0 THEN {_text("'甲'", 'o_custkey', "'公司增加'", _PARTS[0], "'.5万元，'")} ELSE '' END"
    second = f"CASE WHEN o_orderkey % 3 <> 1 THEN {_text("'乙减少了'", _PARTS[1], "'亿美元；'")} ELSE '其他；' END"
    third = f"CASE WHEN o_orderkey % 4 = 2 THEN '丙厂' || CASE WHEN o_custkey % 2 = 0 THEN '增' ELSE '减' END || {_text("'1,0'", f"lpad(cast({_PARTS[0]} as string), 2, '0')", "' 元。'")} ELSE '。' END"
    found = _orders(spark, d, f"concat('本期增加', cast(o_orderkey as string), '万元，主要是：', {first}, {second}, {third})")
    return found.select("o_orderkey", F.explode(N.details(F.col("t0"))).alias("i")).select("o_orderkey", "i.*")


_WORDS = "concat(CASE WHEN o_orderkey % 4 = 0 THEN '本 外币' ELSE '' END, CASE WHEN o_custkey % 3 = 0 THEN '美元合计' WHEN o_custkey % 3 = 1 THEN '外 币' ELSE '' END, cast(o_orderkey as string), CASE WHEN o_orderkey % 5 < 2 THEN '人民币' ELSE '' END)"


@query("c29_scopes", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'foreign' WHEN o_custkey % 3 < 2 THEN 'usd_total' WHEN o_orderkey % 5 < 2 THEN 'rmb' ELSE '' END AS scope FROM orders")
def c29(spark, d):
    return _orders(spark, d, _WORDS).select("o_orderkey", N.scope_hint(F.col("t0")).alias("scope"))


_STRAY = ["CASE o_orderkey % 4 WHEN 0 THEN ';' WHEN 1 THEN '，' WHEN 2 THEN '!' ELSE '' END", "CASE o_custkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '?' ELSE '。' END"]


@query("c30_marks", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ';' WHEN 2 THEN '!' ELSE '' END || CASE o_custkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '.' END WHEN 1 THEN '?' ELSE '' END AS marks FROM orders""")
def c30(spark, d):
    text = f"concat('“余额”', {_STRAY[0]}, cast(o_custkey as string), {_STRAY[1]}, CASE WHEN o_orderkey % 2 = 0 THEN '5' ELSE 'x' END, '（1,000.5）')"
    return _orders(spark, d, text).select("o_orderkey", F.array_join(N.stray_marks(F.col("t0")), "").alias("marks"))


def _named() -> Column:
    return F.concat(F.col("page_id").cast("string"), F.lit("-"), F.col("url"), F.when(F.col("page_id") % 4 == 0, ".pdf").when(F.col("page_id") % 4 == 1, ".PdF").otherwise(F.lit("")))


@query("s6_page_files", """SELECT page_id, CASE WHEN page_id % 4 > 1 AND lower(right(url, 4)) <> '.pdf' THEN 'extension' WHEN html = '' OR html IS NULL THEN 'header' WHEN page_id % 3 = 0 THEN '' ELSE 'header' END AS reason FROM pages WHERE html <> ''""")
def s6(spark, d):
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF"), "html")).otherwise(F.col("html"))
    pages = table(spark, d, "pages").where("html <> ''").select(_named().alias("path"), body.cast("binary").alias("content"))
    return check_pdf(pages).select(F.regexp_extract("path", "^([0-9]+)-", 1).cast("bigint").alias("page_id"), "reason")
