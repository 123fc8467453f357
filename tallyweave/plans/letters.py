"""Queries over narrative fields and letter fields. Inputs are texts built by rule
from stored keys, so that each rule meets its cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import letters as L, money, narrative as N, text as X
from tallyweave.operators import ordered as O
from tallyweave.plans.fixtures import table
from tallyweave.plans.registry import query

def _k():
    return F.col("o_orderkey")


def _o(spark, d):
    return table(spark, d, "orders")


# Sentences by the key's remainder by 6: the three stated forms, a signed value, weak words, none.
_K6 = "o_orderkey % 6"


def _sentences(spark, d):
    k, n = _k().cast("string"), _k() % 6
    s = (
        F.when(n == 0, F.concat(F.lit("（"), k, F.lit("）“A"), k, F.lit(" 贷款”本期增加1,2"), (_k() % 10).cast("string"), F.lit(".5"), (_k() % 10).cast("string"), F.lit("亿元。主要是甲公司增加1,000.5万元，乙 减了2亿元，甲公司增加1000.5万元")))
        .when(n == 1, F.concat(F.lit("“B"), k, F.lit("、存款”本期减少了"), (_k() % 100).cast("string"), F.lit("万元，本外币")))
        .when(n == 2, F.concat(F.lit("“C1”本期为-3."), (_k() % 1000).cast("string"), F.lit("亿美元; 外币 合计")))
        .when(n == 3, F.lit("本期增加约7元，人民 币，主要由各项"))
        .when(n == 4, F.lit("本期有所减到9.25万"))
        .otherwise(F.concat(F.lit("无"), "o_orderstatus"))
    )
    return _o(spark, d).select("o_orderkey", s.alias("s"))


@query("c24_fields", f"SELECT o_orderkey, CAST(CASE WHEN {_K6} = 0 THEN o_orderkey END AS INTEGER) AS para, CASE {_K6} WHEN 0 THEN 'A' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'B' || CAST(o_orderkey AS VARCHAR) WHEN 2 THEN 'C1' END AS code, CASE {_K6} WHEN 0 THEN '贷款' WHEN 1 THEN '存款' END AS name FROM orders")
def c24(spark, d):
    s = _sentences(spark, d).withColumn("p", N.code_and_name(N.quoted(F.col("s"))))
    return s.select("o_orderkey", N.paragraph(F.col("s")).alias("para"), "p.code", "p.name")


@query("c25_main_change", f"""SELECT o_orderkey, CAST(CASE {_K6} WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN -1 END AS INTEGER) AS direction, CASE {_K6} WHEN 0 THEN CAST('12' || CAST(o_orderkey % 10 AS VARCHAR) || '.5' || CAST(o_orderkey % 10 AS VARCHAR) AS DOUBLE) WHEN 1 THEN CAST(o_orderkey % 100 AS DOUBLE)
    WHEN 2 THEN CAST('3.' || CAST(o_orderkey % 1000 AS VARCHAR) AS DOUBLE) WHEN 3 THEN 7 WHEN 4 THEN 9.25 END AS amount, CASE {_K6} WHEN 0 THEN '亿元' WHEN 1 THEN '万元' WHEN 2 THEN '亿美元' WHEN 3 THEN '元' WHEN 4 THEN '万' END AS unit FROM orders""")
def c25(spark, d):
    return _sentences(spark, d).select("o_orderkey", N.main_change(F.col("s")).alias("m")).select("o_orderkey", "m.direction", "m.amount", "m.unit")


@query("c26_places", f"SELECT o_orderkey, CAST(CASE {_K6} WHEN 0 THEN 2 WHEN 2 THEN length(CAST(o_orderkey % 1000 AS VARCHAR)) WHEN 4 THEN 2 ELSE 0 END AS INTEGER) AS places FROM orders")
def c26(spark, d):
    return _sentences(spark, d).select("o_orderkey", N.places(F.col("s")).alias("places"))


@query("c27_details", f"SELECT o_orderkey, c AS company, CAST(CASE c WHEN '乙' THEN -1 ELSE 1 END AS INTEGER) AS direction, CAST(CASE c WHEN '乙' THEN 2 ELSE 1000.5 END AS DOUBLE) AS amount, CASE c WHEN '乙' THEN '亿元' ELSE '万元' END AS unit FROM (SELECT o_orderkey, unnest(['甲公司', '乙']) AS c FROM orders WHERE {_K6} = 0)")
def c27(spark, d):
    return _sentences(spark, d).select("o_orderkey", F.explode(N.details(F.col("s"))).alias("i")).select("o_orderkey", "i.*")


@query("c28_main_class", f"SELECT o_orderkey, CASE {_K6} WHEN 0 THEN '' WHEN 1 THEN '增加/减少后含后缀' WHEN 2 THEN '本期为' WHEN 3 THEN '增加/减少后含修饰词' WHEN 4 THEN '非标准主句' ELSE '缺少增加/减少' END AS tag FROM orders")
def c28(spark, d):
    return _sentences(spark, d).select("o_orderkey", N.main_class(F.col("s")).alias("tag"))


_NUM, _UNITS = r"[0-9][0-9,]*(?:\.[0-9]+)?", "(?:亿美元|万美元|美元|亿元|亿|万元|万|元)"
_MOD = "(?:约|共|合计|累计|达|为|至|计)"
_HELD = f"""(SELECT *, trim(regexp_extract(b, '本期((?s:.*))$', 1)) AS between FROM (SELECT rec_id, text, trim(text) AS t, trim(regexp_extract(trim(text), '(?s)^(.*?){_NUM}\\s*{_UNITS}', 1)) AS b, regexp_extract(trim(text), '(?s)^.*?{_NUM}\\s*{_UNITS}(.*)$', 1) AS a FROM {{main_sentences}}))"""
_READS = f"""(regexp_matches(text, '本期\\s*(?:增加|减少)(?:了|\\s*{_MOD})?\\s*{_NUM}\\s*{_UNITS}') OR CASE WHEN contains(b, '本期') AND regexp_matches(between, '[减少小增加多]') THEN regexp_matches(between, '[减少小]') <> regexp_matches(between, '[增加多]')
    ELSE regexp_matches(text, '本期\\s*(?:为|：|:|=)?\\s*[-+－−—–]?{_NUM}\\s*{_UNITS}') END)"""


@query("c28_main_form", f"""SELECT rec_id, CASE WHEN t = '' THEN '' WHEN NOT regexp_matches(t, '{_NUM}\\s*{_UNITS}') THEN CASE WHEN contains(t, '本期') THEN '本期' WHEN regexp_matches(t, '增加|减少') THEN '非标准增减主句' ELSE '非标准主句' END
    WHEN NOT contains(b, '本期') THEN CASE WHEN instr(b, '增加') > 1 THEN trim(split_part(b, '增加', 1)) WHEN instr(b, '减少') > 1 THEN trim(split_part(b, '减少', 1)) WHEN instr(b, '为') > 1 THEN trim(split_part(b, '为', 1)) ELSE b END
    WHEN between = '' THEN '缺少增加/减少' WHEN starts_with(between, '增加') OR starts_with(between, '减少') THEN CASE WHEN trim(between[3:]) <> '' THEN trim(between[3:]) ELSE replace(regexp_extract(a, '^[\\s\\p{{P}}]*([^\\s\\p{{P}}]*)', 1), '等小额增加', '') END
    WHEN between[1] IN ('+', '-', '－', '−', '—', '–') THEN between[1] ELSE between END AS form FROM {_HELD}""")
def c28_form(spark, d):
    return table(spark, d, "main_sentences").select("rec_id", N.main_form(F.col("text")).alias("form"))


@query("c28_main_blocks", f"""SELECT rec_id, t <> '' AND NOT {_READS} AND (regexp_matches(text, '增加|减少') OR regexp_matches(text, '本期\\s*(?:为|：|:|=)?\\s*[-+－−—–]?{_NUM}\\s*{_UNITS}')) AS blocks,
    regexp_matches(regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains(b, '本期') AND {_READS} THEN regexp_replace(text, '(?s)^(.*?){_NUM}\\s*{_UNITS}', '\\1#') ELSE text END,
    '[^,，。、；]+?\\s*(增加|减少|增|减)\\s*{_MOD}\\s*{_NUM}\\s*{_UNITS}', '#', 'g'), '[^,，。、；]+?\\s*(增加|减少|增|减)了\\s*{_NUM}\\s*{_UNITS}', '#', 'g'), '(增加|减少)\\s*{_NUM}\\s*{_UNITS}', '#', 'g'), '{_NUM}\\s*{_UNITS}') AS bare FROM {_HELD}""".replace("\\\\", "\\"))
def c28_blocks(spark, d):
    t = F.col("text")
    return table(spark, d, "main_sentences").select("rec_id", N.main_blocks(t).alias("blocks"), N.bare_amounts(t).alias("bare"))


_PATTERN = "本期\\s*(增加|减少){x}\\s*(" + _NUM + ")\\s*(" + _UNITS[3:-1] + ")"
_FORMS = [_PATTERN.replace("{x}", x) for x in ("", "了", "\\s*" + _MOD)]
_VALUED = "本期\\s*(?:为|：|:|=)?\\s*([-+－−—–]?" + _NUM + ")\\s*(" + _UNITS[3:-1] + ")"
_FIRST = "(" + _NUM + ")\\s*(" + _UNITS[3:-1] + ")"


def _by_form(stated: str, weak: str, valued: str) -> str:
    """SQL that takes {p} of the first form that fits, then the weak words, then the value."""
    forms = " ".join(f"WHEN regexp_matches(text, '{p}') THEN {stated.replace('{p}', p)}" for p in _FORMS)
    return f"CASE {forms} WHEN contains(b, '本期') AND regexp_matches(between, '[减少小增加多]') THEN {weak} WHEN regexp_matches(text, '{_VALUED}') THEN {valued} END"


_NUMBER = "CAST(replace(translate(regexp_extract(text, '{p}', {g}), '－−—–+', '----'), ',', '') AS DOUBLE)"


@query("c25_changes", f"""SELECT rec_id, CAST({_by_form("CASE regexp_extract(text, '{p}', 1) WHEN '增加' THEN 1 ELSE -1 END", "CASE WHEN NOT regexp_matches(between, '[增加多]') THEN -1 WHEN NOT regexp_matches(between, '[减少小]') THEN 1 END", f"CASE WHEN {_NUMBER.replace('{p}', _VALUED).replace('{g}', '1')} < 0 THEN -1 ELSE 1 END")} AS INTEGER) AS direction,
    {_by_form(_NUMBER.replace('{g}', '2'), _NUMBER.replace('{p}', _FIRST).replace('{g}', '1'), f"abs({_NUMBER.replace('{p}', _VALUED).replace('{g}', '1')})")} AS amount, {_by_form("regexp_extract(text, '{p}', 3)", f"regexp_extract(text, '{_FIRST}', 2)", f"regexp_extract(text, '{_VALUED}', 2)")} AS unit,
    CAST(CASE WHEN regexp_matches(t, '{_FIRST}') THEN length(regexp_extract(regexp_extract(t, '{_FIRST}', 1), '[.]([0-9]+)$', 1)) ELSE 0 END AS INTEGER) AS places FROM {_HELD}""")
def c25_changes(spark, d):
    t = F.col("text")
    return table(spark, d, "main_sentences").select("rec_id", N.main_change(t).alias("m"), N.places(t).alias("places")).select("rec_id", "m.direction", "m.amount", "m.unit", "places")


@query("c24_indicators", """SELECT rec_id, TRY_CAST(nullif(regexp_extract(text, '^[（(]([0-9]+)[）)]', 1), '') AS INTEGER) AS para, nullif(regexp_extract(quoted, '^([A-Za-z0-9]+)', 1), '') AS code, CASE WHEN regexp_matches(quoted, '^[A-Za-z0-9]') THEN nullif(trim(regexp_extract(quoted, '^[A-Za-z0-9]+(.*)$', 1)), '') END AS name
    FROM (SELECT rec_id, text, nullif(trim(regexp_extract(text, '[“"]([^”"]+)[”"]', 1)), '') AS quoted FROM {sentences})""")
def c24_indicators(spark, d):
    s = table(spark, d, "sentences").withColumn("p", N.code_and_name(N.quoted(F.col("text"))))
    return s.select("rec_id", N.paragraph(F.col("text")).alias("para"), "p.code", "p.name")


@query("c29_scope_hint", f"SELECT o_orderkey, CASE {_K6} WHEN 1 THEN 'foreign' WHEN 2 THEN 'usd_total' WHEN 3 THEN 'rmb' ELSE '' END AS scope FROM orders")
def c29(spark, d):
    return _sentences(spark, d).select("o_orderkey", N.scope_hint(F.col("s")).alias("scope"))


@query("c30_stray_marks", f"SELECT o_orderkey, CASE WHEN {_K6} = 2 THEN ';' ELSE '' END AS marks FROM orders")
def c30(spark, d):
    return _sentences(spark, d).select("o_orderkey", F.array_join(N.stray_marks(F.col("s")), "").alias("marks"))


@query("c31_format_exceptions", f"""SELECT o_orderkey, CAST(12 AS INTEGER) AS type_id, CASE {_K6} WHEN 1 THEN '增加/减少后含后缀' WHEN 2 THEN '本期为' WHEN 3 THEN '增加/减少后含修饰词' WHEN 4 THEN '非标准主句' ELSE '缺少增加/减少' END AS value FROM orders WHERE {_K6} <> 0
    UNION ALL SELECT o_orderkey, 16, ';' FROM orders WHERE {_K6} = 2 UNION ALL SELECT o_orderkey, 14, '主要是' FROM orders WHERE {_K6} = 3""")
def c31(spark, d):
    return _sentences(spark, d).select("o_orderkey", F.explode(N.format_exceptions(F.col("s"))).alias("e")).select("o_orderkey", "e.*")


_MARKERS = "(主要是|主要为|主要由|主要原因是)"
_AMOUNT = "[0-9][0-9,]*(?:\\.[0-9]+)?\\s*(?:亿美元|万美元|美元|亿元|亿|万元|万|元)"
_PARSED = f"""(SELECT *, CASE WHEN regexp_matches(detail, '\\S') THEN regexp_extract(detail, '(\\S)\\s*$', 1) ELSE '' END AS tail, regexp_extract_all(detail, '{_AMOUNT}') AS amounts, regexp_replace(regexp_replace(main, '“[^”]*”', '', 'g'), '"[^"]*"', '', 'g') AS outside
    FROM (SELECT rec_id, text, regexp_replace(text, '{_MARKERS}.*$', '') AS main, regexp_extract(text, '{_MARKERS}', 1) AS marker, trim(regexp_extract(text, '{_MARKERS}[：:、，,.。；;\\s]*(.*)$', 2)) AS detail FROM {{sentences}}))"""


@query("c31_parse_exceptions", f"""WITH p AS {_PARSED}, main AS (SELECT rec_id, regexp_extract(text, '本期(?:增加|减少)[0-9]+(亿美元|万元)', 1) AS unit FROM p), company AS (SELECT rec_id, unnest(regexp_extract_all(detail, '([^,，。、；]+?)(?:增加|减少)(?:了|约)[0-9]', 1)) AS name FROM p),
    used AS (SELECT rec_id, unnest(regexp_extract_all(detail, '(?:增加|减少)(?:了|约)?[0-9.]+\\s*(亿美元|万美元|美元|亿元|亿|万元|万|元)', 1)) AS unit FROM p)
    SELECT rec_id, CAST(16 AS INTEGER) AS type_id, 'main_sentence' AS field, '(' AS value FROM p WHERE regexp_matches(main, '^\\s*[（(]\\s*[0-9]+\\s*[）)]') AND regexp_matches(main, '[()]')
    UNION ALL SELECT rec_id, 16, 'main_sentence', '"' FROM p WHERE contains(main, '"')
    UNION ALL SELECT rec_id, 12, 'main_sentence', CASE WHEN contains(main, '“') THEN '“' ELSE '”' END FROM p WHERE contains(main, '“') <> contains(main, '”')
    UNION ALL SELECT rec_id, 12, 'main_sentence', coalesce(nullif(regexp_extract(main, '[A-Za-z0-9]{{2,}}'), ''), '本期') FROM p WHERE NOT contains(main, '“') AND NOT contains(main, '”')
    UNION ALL SELECT rec_id, 16, 'main_sentence', '。' FROM p WHERE regexp_matches(outside, '。\\s*\\S')
    UNION ALL SELECT rec_id, 12, 'company_marker', marker FROM p WHERE marker NOT IN ('', '主要是')
    UNION ALL SELECT rec_id, 12, 'company_detail_tail', CASE WHEN len(amounts) > 0 THEN regexp_replace(amounts[-1], '\\s+', '', 'g') ELSE coalesce(nullif(tail, ''), '。') END FROM p WHERE detail <> '' AND tail <> '。'
    UNION ALL SELECT rec_id, 16, 'company_detail', tail FROM p WHERE detail <> '' AND tail <> '。' AND regexp_matches(tail, '^\\p{{P}}$')
    UNION ALL SELECT DISTINCT rec_id, 14, 'company_detail', trim(name) FROM company
    UNION ALL SELECT DISTINCT u.rec_id, 12, 'profit_loss_unit', u.unit FROM used u JOIN main m ON m.rec_id = u.rec_id WHERE contains(u.unit, '美元') <> contains(m.unit, '美元')""")
def c31_parse(spark, d):
    return table(spark, d, "sentences").select("rec_id", F.explode(N.parse_exceptions(F.col("text"))).alias("e")).select("rec_id", "e.*")


@query("c31_main_tokens", f"""WITH m AS (SELECT rec_id, text, CASE WHEN regexp_matches(text, '{_AMOUNT}') THEN left(text, strpos(text, regexp_extract(text, '{_AMOUNT}')) - 1) ELSE regexp_extract(regexp_replace(text, '^（3）', ''), '^[^0-9]*') END AS before FROM {{token_sentences}} WHERE NOT regexp_matches(text, '本期(增加|减少)[0-9]+万元')),
    r AS (SELECT *, substr(before, 1 + greatest(length(before) - strpos(reverse(before), '”') + 1, 0) * CAST(contains(before, '”') AS INTEGER) + greatest(length(before) - strpos(reverse(before), '"') + 1, 0) * CAST(contains(before, '"') AS INTEGER)) AS rest FROM m),
    z AS (SELECT *, strpos(rest, '本') AS p, CASE WHEN strpos(rest, '本') > 0 THEN substr(rest, strpos(rest, '本') + 2) ELSE rest END AS zone FROM r),
    d AS (SELECT *, greatest(CASE WHEN contains(zone, '增加') THEN length(zone) - strpos(reverse(zone), '加增') ELSE 0 END, CASE WHEN contains(zone, '减少') THEN length(zone) - strpos(reverse(zone), '少减') ELSE 0 END) AS mv FROM z),
    t AS (SELECT rec_id, text, list_filter([CASE WHEN p > 0 AND substr(rest, p, 2) <> '本期' THEN substr(rest, p, 2) END, CASE WHEN p > 0 AND mv > 0 THEN trim(left(zone, mv - 1)) END, CASE WHEN mv > 0 THEN trim(substr(zone, mv + 2)) END,
        CASE WHEN p > 0 AND mv = 0 THEN trim(left(trim(zone), length(trim(zone)) - 1)) END, CASE WHEN p > 0 AND mv = 0 THEN right(trim(zone), 1) END, CASE WHEN p = 0 AND mv = 0 THEN right(rtrim(before), 1) END], lambda x: x <> '') AS found FROM d)
    SELECT rec_id, array_to_string(CASE WHEN len(found) > 0 THEN found ELSE [text] END, '/') AS tokens FROM t""")
def c31_tokens(spark, d):
    told = table(spark, d, "token_sentences").select("rec_id", N.main_tokens(F.col("text")).alias("t"))
    return told.where(F.size("t") > 0).select("rec_id", F.array_join("t", "/").alias("tokens"))


@query("w2_index_lines", """SELECT doc_id, line_no, CASE WHEN line_no % 6 = 1 AND nxt IS NOT NULL THEN CAST(line_no AS VARCHAR) || '. ' || nxt ELSE text END AS text FROM (SELECT doc_id, line_no, CASE WHEN line_no % 6 = 1 THEN CAST(line_no AS VARCHAR) || '.' ELSE 'x ' || text END AS text, lead('x ' || text) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM {raw_lines}) WHERE line_no % 6 <> 2""")
def w2(spark, d):
    lines = table(spark, d, "raw_lines").select("doc_id", "line_no", F.when(F.col("line_no") % 6 == 1, F.concat(F.col("line_no").cast("string"), F.lit("."))).otherwise(F.concat(F.lit("x "), "text")).alias("text"))
    return O.join_index_lines(lines, F.col("text").rlike(r"^\d+\.$"), lambda t: t.contains("x "))


@query("c5_compare_key", "SELECT c_custkey, lower(c_name) || '12' AS key FROM customer")
def c5(spark, d):
    return table(spark, d, "customer").select("c_custkey", money.compare_key(F.concat(F.lit("¥ "), "c_name", F.lit(" $1,2元"))).alias("key"))


@query("c11_indicator_name", "SELECT p_partkey, replace(p_name, ' ', '') AS name FROM part")
def c11(spark, d):
    return table(spark, d, "part").select("p_partkey", money.indicator_name(F.concat(F.col("p_partkey").cast("string"), F.lit(". 2、"), "p_name")).alias("name"))


@query("c16_gate", """SELECT p_partkey, p_partkey % 5 = 0 AS good FROM part""")
def c16(spark, d):
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.concat(F.lit("1. "), "p_name")).when(k == 1, "1. pays; now").when(k == 2, "1. 100元").when(k == 3, F.lit("1. ")).otherwise(F.concat(F.lit("1. "), F.repeat("p_name", F.lit(9))))
    return table(spark, d, "part").select("p_partkey", X.gate(line, "^[0-9]+[.]\\s*", 28).alias("good"))


@query("c33_clean_date", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '' ELSE '' END AS day FROM orders""")
def c33(spark, d):
    t = F.when(_k() % 4 == 0, F.date_format("o_orderdate", "yyyy 年 M 月 d 日")).when(_k() % 4 == 1, F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyyMMdd"))).when(_k() % 4 == 2, "2023-02-30").otherwise("none")
    return _o(spark, d).select("o_orderkey", L.clean_date(t).alias("day"))


@query("c34_repair_date", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2024-03-02' WHEN 1 THEN '2024-03-01' WHEN 2 THEN '2024-03-15' WHEN 3 THEN '2024-03-07' ELSE '' END AS day FROM orders""")
def c34(spark, d):
    k = _k() % 5
    date = F.when(k == 0, "2024-03-01").when(k == 1, "2024-03-07").when(k == 2, "2024-03-09").when(k == 3, "2024-03-07").otherwise("")
    text = F.when(k == 0, "x 2024-03-02 2024-03-20").when(k == 1, "2024-03-01 2024-03-11").when(k == 2, "2024-03-15 2024-04-01").when(k == 3, "2024-03-07").otherwise("2024-03-01")
    return _o(spark, d).select("o_orderkey", L.repair_date(date, text).alias("day"))


@query("c35_date_range", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2024年1月2日至2024年3月4日' WHEN 1 THEN '2024-01-02 - 2024-03-04' ELSE '' END AS span FROM orders")
def c35(spark, d):
    t = F.when(_k() % 3 == 0, "a 2024年1月2日至2024年3月4日 b").when(_k() % 3 == 1, "from 2024-01-02 - 2024-03-04.").otherwise("2024-01-02 only")
    return _o(spark, d).select("o_orderkey", L.date_range(t).alias("span"))


@query("c36_other_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '2024-05-06' ELSE '2024-01-02' END AS day FROM orders")
def c36(spark, d):
    text = F.when(_k() % 2 == 0, "stamp 2024-01-02, signed 2024-05-06").otherwise("stamp 2024-01-02")
    return _o(spark, d).select("o_orderkey", L.other_date(F.lit("2024-01-02"), text).alias("day"))


@query("c37_phones", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '-12，+86 (21) 5' AS phones FROM customer")
def c37(spark, d):
    t = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit("-12（项目组）,none/+86  (21) 5x"))
    return table(spark, d, "customer").select("c_custkey", L.phones(t).alias("phones"))


@query("c38_codes", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '200030' ELSE '' END AS postal, '62' || CAST(c_custkey AS VARCHAR) || '9' AS account FROM customer")
def c38(spark, d):
    postal = F.when(F.col("c_custkey") % 2 == 0, "code 200030 x").otherwise("1234567")
    acct = F.concat(F.lit("No 62-"), F.col("c_custkey").cast("string"), F.lit(" 9"))
    return table(spark, d, "customer").select("c_custkey", L.postal_code(postal).alias("postal"), L.account(acct).alias("account"))


@query("c39_letter_number", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'HZ-' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'P' || CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'T1' ELSE 'BAR' END AS number FROM customer")
def c39(spark, d):
    k, s = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    t = F.when(k == 0, F.concat(F.lit("函证编号：HZ-"), s, F.lit(" 第1页;"))).when(k == 1, F.concat(F.lit("项目编号:P"), s)).otherwise("none")
    return table(spark, d, "customer").select("c_custkey", L.letter_number(t, F.when(k == 2, "NO. T1"), F.lit("BAR")).alias("number"))


@query("c40_rules", "SELECT p_partkey, replace(regexp_replace(regexp_replace(p_name, '[aeiou]', '*', 'g'), '\\*+', '+', 'g'), 'r', 'RR') AS name FROM part")
def c40(spark, d):
    return table(spark, d, "part").select("p_partkey", L.apply_rules(F.col("p_name"), [("[aeiou]", "*"), (r"\*+", "+")], [("r", "RR")]).alias("name"))


@query("c41_zone_value", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'fallback' END AS value FROM part")
def c41(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Bank zone: name="), "p_name", F.lit(" END tail"))).otherwise("nothing")
    return table(spark, d, "part").select("p_partkey", L.zone_value(t, "zone:", ["END", "STOP"], ["name=(.*)"], F.lit("fallback")).alias("value"))


@query("c42_seal_name", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS seal FROM customer")
def c42(spark, d):
    t = F.when(F.col("c_custkey") % 3 == 0, "公章 (1)").otherwise(F.concat("c_name", F.lit("（note）")))
    return table(spark, d, "customer").select("c_custkey", L.seal_name(t).alias("seal"))


@query("j29_in_source", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 4) WHEN doc_id % 3 = 1 THEN substr(text, 1, 2) ELSE '' END AS value FROM documents WHERE length(regexp_replace(substr(text, 1, 2), '\\s', '', 'g')) > 0")
def j29(spark, d):
    docs = table(spark, d, "documents").where(F.length(F.regexp_replace(F.substring("text", 1, 2), r"\s", "")) > 0)
    k = F.col("doc_id") % 3
    value, fixed = F.when(k == 0, F.substring("text", 1, 4)).otherwise("~~absent~~"), F.when(k == 1, F.substring("text", 1, 2)).otherwise("~~none~~")
    return docs.select("doc_id", L.in_source(value, F.col("text"), fixed).alias("value"))


_LUHN = "(list_sum(list_transform(generate_series(1, length({x})), lambda i: CASE WHEN (length({x}) - i) % 2 = 1 THEN CASE WHEN 2 * CAST(substr({x}, i, 1) AS INT) > 9 THEN 2 * CAST(substr({x}, i, 1) AS INT) - 9 ELSE 2 * CAST(substr({x}, i, 1) AS INT) END ELSE CAST(substr({x}, i, 1) AS INT) END)) % 10 = 0)"


@query("c44_check_digit", "SELECT c_custkey, CASE WHEN length(s) >= 2 THEN " + _LUHN.replace("{x}", "s") + " ELSE false END AS valid FROM (SELECT c_custkey, CAST(c_custkey * 37 AS VARCHAR) AS s FROM customer)")
def c44(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.check_digit((F.col("c_custkey") * 37).cast("string")).alias("valid"))


@query("c45_repair_digits", f"""WITH s AS (SELECT c_custkey, CAST(c_custkey * 37 + 7000 AS VARCHAR) AS s FROM customer),
    t AS (SELECT c_custkey, 0 AS turn, 0 AS k, s AS x FROM s UNION ALL SELECT c_custkey, 1, k, left(s, k - 1) || '1' || substr(s, k) FROM (SELECT *, unnest(range(1, length(s) + 1)) AS k FROM s) WHERE substr(s, k, 1) = '7'
        UNION ALL SELECT c_custkey, 2, k, left(s, k) || '1' || substr(s, k + 1) FROM (SELECT *, unnest(range(1, length(s) + 1)) AS k FROM s))
    SELECT s.c_custkey, x AS repaired FROM s LEFT JOIN (SELECT c_custkey, x FROM t WHERE {_LUHN.replace('{x}', 'x')} QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY turn, k) = 1) g ON g.c_custkey = s.c_custkey""")
def c45(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.repair_digits((F.col("c_custkey") * 37 + 7000).cast("string")).alias("repaired"))


@query("c46_checked", "SELECT doc_id, quality = 1 AS checked FROM labels")
def c46(spark, d):
    return table(spark, d, "labels").select("doc_id", L.checked(F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 2 == 0, " √ ").otherwise("YES")).otherwise(F.when(F.col("doc_id") % 2 == 0, "×").otherwise("?"))).alias("checked"))


@query("c47_seals", "SELECT event_id, upper(event_type) || CAST(user_id AS VARCHAR) || ':' || CASE WHEN event_id % 2 = 0 THEN 'red' ELSE 'black' END AS seals FROM events")
def c47(spark, d):
    code = F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))
    e = table(spark, d, "events").select("event_id", F.array(F.struct(code.alias("code"), F.when(F.col("event_id") % 2 == 0, "RED").otherwise("pink").alias("colour"))).alias("s"))
    return e.select("event_id", F.array_join(F.transform(L.seals(F.col("s"), "black"), lambda x: F.concat_ws(":", x["code"], x["colour"])), ",").alias("seals"))


@query("c43_letter_fields", "SELECT c_custkey, '2024-03-04' AS day, '200030' AS postal, CAST(c_custkey AS VARCHAR) AS account, c_name AS seal FROM customer")
def c43(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("2024 年3月4日").alias("date"), F.lit("邮编 200030 上海").alias("postal"), F.concat(F.lit("账号 "), F.col("c_custkey").cast("string")).alias("account"), F.concat("c_name", F.lit("(note)")).alias("seal"))
    return c.select("c_custkey", L.clean_date(F.col("date")).alias("day"), L.postal_code(F.col("postal")).alias("postal"), L.account(F.col("account")).alias("account"), L.seal_name(F.col("seal")).alias("seal"))


@query("c43_letter_record", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'HZ-' || c_custkey ELSE 'A' || c_custkey END AS confirmation_no, CASE WHEN c_custkey % 4 = 1 THEN '城' || c_nationkey || '银行天津分行' ELSE '' END AS recipient_bank,
    CASE WHEN c_custkey % 2 = 0 THEN '甲' || c_nationkey || '有限责任会计师事务所（特殊普通合伙）' ELSE '乙会计师事务所' END AS accounting_firm, '路' || c_nationkey || '号' AS reply_address, CASE WHEN c_custkey % 5 <> 2 THEN '赵六' WHEN c_nationkey % 2 = 0 THEN '李四' ELSE '王五' END AS contact_person,
    CASE WHEN c_custkey % 5 = 2 THEN '021-' || c_custkey ELSE '+86 (21) ' || c_custkey END AS phone, '200030' AS postal_code, '62' || (c_custkey + 1000000) AS debit_account, '2024-04-01' AS cutoff_date, '2024-01-' || (c_nationkey % 9 + 10) AS start_date, '2024-03-05' AS end_date,
    CASE WHEN c_custkey % 2 = 0 THEN '2024-04-0' || (c_nationkey % 7 + 2) WHEN c_nationkey % 7 = 5 THEN '2024-04-07' ELSE '2024-04-01' END AS seal_date, CASE WHEN c_custkey % 4 = 1 THEN '城' || c_nationkey || '银行天律分行' ELSE '' END AS signature_name FROM customer""")
def c43_record(spark, d):
    told = {f: F.col(f) for f in L.LETTER_FIELDS if f != "debit_account"}
    return table(spark, d, "letters").repartition("c_custkey").select("c_custkey", *L.letter_record(told, F.col("text")))


@query("w4_wrapped_rows", "SELECT o_orderkey, o_orderstatus || 'x' AS a, o_orderpriority || 'y' AS b, 'c' AS c FROM orders")
def w4(spark, d):
    from tallyweave.operators import versions as V

    row = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])
    rows = F.array(row(F.col("o_orderstatus"), F.col("o_orderpriority"), "c"), row("x", "", ""), row("", "y", ""))
    out = V.merge_wrapped(_o(spark, d).select("o_orderkey", rows.alias("rows")))
    return out.select("o_orderkey", F.explode("rows").alias("r")).select("o_orderkey", F.get("r", F.lit(0)).alias("a"), F.get("r", F.lit(1)).alias("b"), F.get("r", F.lit(2)).alias("c"))


@query("s6_file_check", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'extension' WHEN page_id % 5 = 0 THEN 'header' ELSE '' END AS reason FROM pages")
def s6(spark, d):
    from tallyweave.sources.files import check_pdf

    k = F.col("page_id")
    named = F.concat(k.cast("string"), F.when(k % 3 == 0, ".doc").otherwise(".PDF"))
    body = F.concat(F.when(k % 5 == 0, "").otherwise("%PDF-"), "html").cast("binary")
    checked = check_pdf(table(spark, d, "pages").select(named.alias("path"), body.alias("content"), "page_id"))
    return checked.select(F.substring_index("path", ".", 1).cast("bigint").alias("page_id"), "reason")
