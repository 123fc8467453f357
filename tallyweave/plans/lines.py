"""Queries over document lines and sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions import text as X
from tallyweave.operators import ordered as O
from tallyweave.plans.fixtures import table
from tallyweave.plans.registry import query

_T = "trim(text)"


def _gate(prefix: str, most: int) -> str:
    tail = f"regexp_replace(regexp_replace(t, '{prefix}', ''), '^[|｜\\s]+', '')"
    return (
        f"({tail} <> '' AND NOT contains(t, chr(9)) AND length(regexp_replace(t, '[^|｜]', '', 'g')) < 3 AND length({tail}) <= {most} AND NOT regexp_matches({tail}, '[，。；：！？;:!?]') "
        f"AND NOT regexp_matches({tail}, '[0-9]+\\s*(元|万元|亿元|年|月|日)') AND NOT regexp_matches({tail}, '^[-+()\\s0-9.,%]+$') "
        f"AND NOT (length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(length(regexp_replace(t, '\\s+', '', 'g')), 1) > 0.65 AND length({tail}) <= 4))"
    )


_H1, _H2, _H3 = "^第[一二三四五六七八九十百〇零]+[节節条]\\s*", "^([一二三四五六七八九十百〇零]+)[、．.]\\s*", "^([0-9]+)[.．]([0-9]+)\\s*"
_CLASS = f"""(SELECT *, CASE WHEN is_table THEN 'Table' WHEN t = '' THEN 'BLANK' WHEN regexp_matches(t, '^(目\\s*录|表\\s*目\\s*录|图\\s*目\\s*录)\\s*$') THEN 'TOCTitle'
    WHEN regexp_matches(t, '^(附\\s*录|附\\s*件|术\\s*语|定\\s*义|缩\\s*略\\s*语|釋\\s*義)') THEN 'GlossaryTitle' WHEN regexp_matches(t, '{_H1}') THEN 'H1'
    WHEN regexp_matches(t, '{_H2}') THEN CASE WHEN {_gate(_H2, 40)} THEN 'H2' ELSE 'NORMAL' END
    WHEN regexp_matches(t, '^[0-9]+[.．、]([^0-9]|$)') THEN CASE WHEN {_gate('^[0-9]+[.．、]\\s*', 28)} THEN 'H4' ELSE 'NORMAL' END
    WHEN regexp_matches(t, '{_H3}') THEN CASE WHEN {_gate(_H3, 40)} THEN 'H3' ELSE 'NORMAL' END ELSE 'NORMAL' END AS class
    FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM {{doc_lines}}))"""
_LEVEL = f"""(SELECT *, CASE WHEN class = 'H4' AND max(CASE WHEN lv IS NOT NULL THEN line_no END) OVER b IS NOT NULL THEN 4 ELSE lv END AS level FROM
    (SELECT *, CASE WHEN class = 'H1' THEN 1 WHEN class = 'H2' THEN 2 WHEN class = 'H3' AND max(CASE WHEN class IN ('H1', 'H2') THEN line_no END) OVER b IS NOT NULL THEN 3 END AS lv FROM {_CLASS}
    WINDOW b AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WINDOW b AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_HEADED = f"""(SELECT *, greatest(l1, l2, l3, l4) AS section, CASE WHEN level = 1 THEN NULL WHEN level = 2 THEN l1 WHEN level = 3 THEN greatest(l1, l2) WHEN level = 4 THEN greatest(l1, l2, l3) ELSE greatest(l1, l2, l3, l4) END AS parent FROM
    (SELECT *, max(CASE WHEN level = 1 THEN line_no END) OVER w AS l1, max(CASE WHEN level = 2 THEN line_no END) OVER w AS l2, max(CASE WHEN level = 3 THEN line_no END) OVER w AS l3, max(CASE WHEN level = 4 THEN line_no END) OVER w AS l4 FROM {_LEVEL}
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""
_SECTIONS = f"""(SELECT h.doc_id, h.line_no, h.parent, h.level, trim(h.text) AS title, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.line_no) AS order_index, coalesce(b.body, '') AS body FROM {_HEADED} h
    LEFT JOIN (SELECT doc_id, section, string_agg(text, chr(10) ORDER BY line_no) AS body FROM {_HEADED} WHERE section IS NOT NULL AND level IS NULL GROUP BY ALL) b ON b.doc_id = h.doc_id AND b.section = h.line_no WHERE h.level IS NOT NULL)"""


def _headed(spark, d):
    return O.headings(table(spark, d, "doc_lines"))


@query("c14_line_class", f"SELECT doc_id, line_no, class FROM {_CLASS}")
def c14(spark, d):
    return table(spark, d, "doc_lines").select("doc_id", "line_no", X.line_class(F.col("text"), is_table=F.col("is_table")).alias("class"))


@query("c14_bold_titles", f"""SELECT doc_id, line_no, CASE WHEN class = 'NORMAL' AND line_no % 3 <> 0 AND before AND length(t) <= 40 AND NOT regexp_matches(t, '[。！？；：,，;:!?]|[〇零一二三四五六七八九十百0-9]+[年月]|[0-9]+日$|^[（(〔［]') THEN 'H1' ELSE class END AS class
    FROM (SELECT *, coalesce(lag(trim(text)) OVER (PARTITION BY doc_id ORDER BY line_no) = '', false) AS before FROM {_CLASS})""")
def c14_bold(spark, d):
    before = F.lag(F.trim("text")).over(Window.partitionBy("doc_id").orderBy("line_no")) == ""
    return table(spark, d, "doc_lines").withColumn("before", before).select("doc_id", "line_no", X.line_class(F.col("text"), is_table=F.col("is_table"), bold=F.col("line_no") % 3 != 0, after_blank=F.col("before")).alias("class"))


@query("c15_line_class_plain", f"SELECT doc_id, line_no, CASE WHEN regexp_matches({_T}, '{_H1}') THEN 'H1' WHEN regexp_matches({_T}, '{_H3}') THEN 'H3' WHEN regexp_matches({_T}, '^[0-9]+[.．、]([^0-9]|$)') THEN 'H4' WHEN regexp_matches({_T}, '{_H2}') THEN 'H2' ELSE 'NORMAL' END AS class FROM {{doc_lines}}")
def c15(spark, d):
    return table(spark, d, "doc_lines").select("doc_id", "line_no", X.line_class_plain(F.col("text")).alias("class"))


@query("w6_headings", f"SELECT doc_id, line_no, class, CAST(level AS INTEGER) AS level, section, parent FROM {_HEADED}")
def w6(spark, d):
    return _headed(spark, d).select("doc_id", "line_no", "class", "level", "section", "parent")


@query("w18_sections", f"SELECT doc_id, line_no, parent, CAST(level AS INTEGER) AS level, title, CAST(order_index AS INTEGER) AS order_index, body FROM {_SECTIONS}")
def w18(spark, d):
    return O.sections(_headed(spark, d)).select("doc_id", "line_no", "parent", "level", "title", "order_index", "body")


@query("w7_monotone_topics", f"""SELECT doc_id, line_no, CAST(ordinal AS INTEGER) AS ordinal, coalesce(ordinal > max(ordinal) OVER (PARTITION BY doc_id, l1 ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM
    (SELECT doc_id, line_no, l1, instr('零一二三四五六七八九', substr(t, 1, 1)) - 1 AS ordinal FROM {_HEADED} WHERE level = 2)""")
def w7(spark, d):
    return O.monotone_topics(_headed(spark, d))


@query("w10_pages", "SELECT doc_id, line_no, CAST(sum(CASE WHEN page_break AND line_no > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) + 1 AS BIGINT) AS page FROM {doc_lines}")
def w10(spark, d):
    return O.pages(table(spark, d, "doc_lines")).select("doc_id", "line_no", "page")


@query("w1_blocks", """SELECT doc_id, line_no, block, last_value(note IGNORE NULLS) OVER (PARTITION BY doc_id, block ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM
    (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 2 THEN 'n' || CAST(line_no AS VARCHAR) END AS note, CAST(sum(CASE WHEN line_no % 12 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block FROM {doc_lines}) WHERE block > 0""")
def w1(spark, d):
    note = F.when(F.col("line_no") % 7 == 2, F.concat(F.lit("n"), F.col("line_no").cast("string")))
    return O.blocks(table(spark, d, "doc_lines"), F.col("line_no") % 12 == 3, note).select("doc_id", "line_no", "block", "scope")


@query("w12_regions", f"""SELECT doc_id, line_no, CASE WHEN toc IS NOT NULL AND NOT (count(*) FILTER (WHERE class = 'BLANK') OVER s >= 2 OR count(*) FILTER (WHERE class IN ('Table', 'GlossaryTitle')) OVER s > 0) THEN 'toc' WHEN mark = 'g' THEN 'glossary' ELSE 'main' END AS region FROM
    (SELECT doc_id, line_no, class, max(CASE WHEN class = 'TOCTitle' THEN line_no END) OVER w AS toc, last_value(CASE WHEN class = 'GlossaryTitle' THEN 'g' WHEN class = 'H1' THEN 'h' END IGNORE NULLS) OVER w AS mark FROM {_CLASS}
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WINDOW s AS (PARTITION BY doc_id, toc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w12(spark, d):
    return O.regions(table(spark, d, "doc_lines")).select("doc_id", "line_no", "region")


_KEY = "regexp_replace(lower({x}), '[\\s.,;:!?、，。；：！？（）()“”\"''-]', '', 'g')"


@query("w14_collapse_titles", f"""SELECT doc_id, max_by(line_no, struct_pack(a := length(body), b := length(title), c := -line_no)) AS line_no, max_by(title, struct_pack(a := length(body), b := length(title), c := -line_no)) AS title FROM
    (SELECT *, sum(CASE WHEN k = pk AND level = pl THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM (SELECT *, lag(k) OVER w AS pk, lag(level) OVER w AS pl FROM (SELECT *, {_KEY.replace('{x}', 'title')} AS k FROM {_SECTIONS}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)))
    GROUP BY doc_id, island""")
def w14(spark, d):
    return O.collapse_titles(O.sections(_headed(spark, d))).select("doc_id", "line_no", "title")


@query("w20_split_headings", f"""SELECT doc_id, line_no, text FROM (SELECT *, last_value(CASE WHEN class = 'H1' THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running FROM
    (SELECT *, {_KEY.replace('{x}', 'text')} AS k FROM {_CLASS})) WHERE NOT (class = 'H1' AND coalesce(running = k, false))""")
def w20(spark, d):
    return O.merge_split_headings(_headed(spark, d)).select("doc_id", "line_no", "text")


@query("w21_running_titles", f"""SELECT doc_id, line_no FROM (SELECT *, last_value(CASE WHEN class = 'H1' THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running FROM
    (SELECT *, {_KEY.replace('{x}', 'text')} AS k FROM {_CLASS})) WHERE class = 'H1' AND running = k""")
def w21(spark, d):
    headed = _headed(spark, d)
    return headed.where("class = 'H1'").join(O.merge_split_headings(headed), ["doc_id", "line_no"], "left_anti").select("doc_id", "line_no")


@query("c52_section_text", f"SELECT doc_id, section AS line_no, string_agg(text, chr(10) ORDER BY line_no) AS body FROM {_HEADED} WHERE section IS NOT NULL AND level IS NULL GROUP BY ALL")
def c52(spark, d):
    headed = _headed(spark, d)
    filled = headed.where("section is not null and level is null").select("doc_id", F.col("section").alias("line_no")).distinct()
    return O.sections(headed).join(filled, ["doc_id", "line_no"], "left_semi").select("doc_id", "line_no", "body")


def _first_in_first_out(rows: str) -> str:
    """The labels that wait when each number comes, row after row."""
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n, CASE WHEN regexp_matches(trim(text), '^[0-9.,]+$') THEN 'n' WHEN regexp_matches(text, '[0-9]') THEN 'm' ELSE 'l' END AS kind FROM {rows}),
    t AS (SELECT doc_id, 0 AS n, []::BIGINT[] AS waiting, NULL::BIGINT AS label_line, NULL::BIGINT AS number_line FROM r WHERE n = 1 UNION ALL
        SELECT t.doc_id, r.n, CASE kind WHEN 'l' THEN list_append(waiting, r.line_no) WHEN 'm' THEN [] ELSE waiting[2:] END, CASE kind WHEN 'n' THEN waiting[1] END, r.line_no FROM t JOIN r ON r.doc_id = t.doc_id AND r.n = t.n + 1)
    SELECT doc_id, label_line, number_line FROM t WHERE label_line IS NOT NULL"""


@query("w5_number_labels", _first_in_first_out("(SELECT doc_id, line_no, CASE WHEN line_no % 5 IN (1, 3) THEN CAST(line_no AS VARCHAR) ELSE text END AS text FROM {doc_lines})"))
def w5(spark, d):
    rows = table(spark, d, "doc_lines").select("doc_id", "line_no", F.when((F.col("line_no") % 5).isin(1, 3), F.col("line_no").cast("string")).otherwise(F.col("text")).alias("text"))
    return O.number_labels(rows)


# Rows of lone numbers, labels and both; numbers outrun labels at some of them.
_WAITING = "(SELECT doc_id, line_no, CASE (line_no * 7 + doc_id) % 6 WHEN 0 THEN '12' WHEN 1 THEN '3,' || CAST(line_no AS VARCHAR) WHEN 2 THEN 'no' || CAST(line_no AS VARCHAR) ELSE 'name' END AS text FROM {doc_lines} WHERE (line_no + doc_id) % 13 <> 4)"


@query("w5_waiting_labels", _first_in_first_out(_WAITING))
def w5_waiting(spark, d):
    n = F.col("line_no")
    turn, number = (n * 7 + F.col("doc_id")) % 6, n.cast("string")
    text = F.when(turn == 0, "12").when(turn == 1, F.concat(F.lit("3,"), number)).when(turn == 2, F.concat(F.lit("no"), number)).otherwise("name")
    return O.number_labels(table(spark, d, "doc_lines").where((n + F.col("doc_id")) % 13 != 4).select("doc_id", "line_no", text.alias("text")))


_HINT = "CASE WHEN regexp_matches({x}, '^第[一二三四五六七八九十百]+[章节条]') THEN regexp_extract({x}, '^(第[一二三四五六七八九十百]+[章节条])', 1) WHEN regexp_matches({x}, '^[0-9]+([.][0-9]+)+') THEN regexp_extract({x}, '^([0-9]+([.][0-9]+)+)', 1) WHEN regexp_matches({x}, '^[0-9]+[.、]') THEN regexp_extract({x}, '^([0-9]+)[.、]', 1) WHEN regexp_matches({x}, '^[一二三四五六七八九十]+、') THEN regexp_extract({x}, '^([一二三四五六七八九十]+)、', 1) END"


@query("w14_collapse_siblings", f"""WITH RECURSIVE s AS (SELECT *, coalesce(parent, -1) AS p, {_KEY.replace('{x}', 'title')} AS k, {_HINT.replace('{x}', 'title')} AS h FROM {_SECTIONS}),
    o AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id, p ORDER BY line_no) AS n, (SELECT count(*) FROM s c WHERE c.doc_id = s.doc_id AND c.parent = s.line_no) AS children FROM s),
    f AS (SELECT doc_id, p, n, level AS hl, k AS hk, h AS hh, 1 AS g, line_no FROM o WHERE n = 1 UNION ALL
        SELECT doc_id, p, n, CASE WHEN alike THEN hl ELSE level END, CASE WHEN alike THEN hk ELSE k END, CASE WHEN alike THEN hh ELSE h END, CASE WHEN alike THEN g ELSE g + 1 END, line_no
        FROM (SELECT o.*, hl, hk, hh, g, hl = o.level AND hk <> '' AND o.k <> '' AND (contains(hk, o.k) OR contains(o.k, hk)) AND NOT coalesce(hh <> o.h, false) AS alike FROM f JOIN o ON o.doc_id = f.doc_id AND o.p = f.p AND o.n = f.n + 1)),
    best AS (SELECT doc_id, line_no, parent, title, row_number() OVER (PARTITION BY doc_id, p, g ORDER BY children DESC, length(body) DESC, length(title) DESC, line_no) AS turn FROM o JOIN (SELECT doc_id, line_no, g FROM f) USING (doc_id, line_no)),
    kept AS (SELECT doc_id, line_no, title FROM best WHERE turn = 1 AND parent IS NULL UNION ALL SELECT b.doc_id, b.line_no, b.title FROM kept JOIN best b ON b.doc_id = kept.doc_id AND b.parent = kept.line_no WHERE b.turn = 1)
    SELECT * FROM kept""")
def w14_siblings(spark, d):
    return O.collapse_siblings(O.sections(_headed(spark, d))).select("doc_id", "line_no", "title")


@query("w17_strips", """SELECT doc_id, line_no, table_line FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, table_line ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
    (SELECT *, max(CASE WHEN is_table THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS table_line FROM {doc_lines}) WHERE NOT is_table AND table_line IS NOT NULL) WHERE before <= 600""")
def w17(spark, d):
    return O.strip_around_tables(table(spark, d, "doc_lines"), 600).select("doc_id", "line_no", "table_line")


@query("w17_table_strips", """WITH l AS (SELECT doc_id, line_no, is_table, trim(text) AS text, count(*) FILTER (WHERE is_table) OVER (PARTITION BY doc_id ORDER BY line_no) AS gap FROM {doc_lines}),
    t AS (SELECT doc_id, line_no AS table_line, lag(line_no, 1, -1) OVER w AS low, lead(line_no, 1, 1000000000) OVER w AS high FROM l WHERE is_table WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, gap ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM l WHERE NOT is_table AND text <> '')
    SELECT t.doc_id, table_line, CASE WHEN s.line_no < table_line THEN 'before' ELSE 'after' END AS side, s.line_no FROM t JOIN s ON s.doc_id = t.doc_id AND s.line_no > low AND s.line_no < high WHERE held <= 600""")
def w17_strips(spark, d):
    return O.table_strips(table(spark, d, "doc_lines"), 600)


@query("w8_gated_headings", f"""SELECT doc_id, line_no, class, CASE class WHEN 'H3' THEN max(CASE WHEN class IN ('H1', 'H2') THEN 1 ELSE 0 END) OVER w ELSE max(CASE WHEN lv IS NOT NULL THEN 1 ELSE 0 END) OVER w END = 1 AS accepted
    FROM (SELECT *, CASE WHEN class IN ('H1', 'H2') OR (class = 'H3' AND max(CASE WHEN class IN ('H1', 'H2') THEN 1 ELSE 0 END) OVER v = 1) THEN 1 END AS lv FROM {_CLASS} WINDOW v AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY class IN ('H3', 'H4')""")
def w8(spark, d):
    return _headed(spark, d).where("class in ('H3', 'H4')").select("doc_id", "line_no", "class", F.col("level").isNotNull().alias("accepted"))


@query("w13_glossary", f"""SELECT doc_id, line_no FROM (SELECT doc_id, line_no, region FROM (SELECT doc_id, line_no, class, last_value(CASE WHEN class = 'GlossaryTitle' THEN 'g' WHEN class = 'H1' THEN 'h' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS region
    FROM {_CLASS.replace('{doc_lines}', "(SELECT doc_id, line_no, is_table, CASE WHEN line_no % 10 = 6 THEN '附录 ' || CAST(line_no AS VARCHAR) WHEN line_no % 10 = 1 THEN 'text' ELSE text END AS text FROM {doc_lines})")}) WHERE region = 'g')""")
def w13(spark, d):
    n = F.col("line_no")
    text = F.when(n % 10 == 6, F.concat(F.lit("附录 "), n.cast("string"))).when(n % 10 == 1, "text").otherwise(F.col("text"))
    return O.regions(table(spark, d, "doc_lines").withColumn("text", text)).where("region = 'glossary'").select("doc_id", "line_no")


@query("w22_slice", """SELECT doc_id, line_no, row_number() OVER w - 1 AS new_line, count(*) FILTER (WHERE is_table) OVER w AS table_no FROM (SELECT *, min(CASE WHEN line_no % 12 = 3 AND line_no > first THEN line_no END) OVER (PARTITION BY doc_id) AS stop FROM
    (SELECT *, coalesce(min(CASE WHEN line_no % 8 = 5 THEN line_no END) OVER (PARTITION BY doc_id), 0) AS first FROM {doc_lines})) WHERE line_no >= first AND (stop IS NULL OR line_no < stop) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def w22(spark, d):
    out = O.slice_between(table(spark, d, "doc_lines"), F.col("line_no") % 8 == 5, F.col("line_no") % 12 == 3)
    return out.select("doc_id", "line_no", F.col("new_line").cast("bigint").alias("new_line"), "table_no")


_PAGED = "(SELECT *, CAST(line_no - line_no % 8 AS BIGINT) // 8 + 1 AS page FROM {doc_lines})"
_MT = f"""(SELECT doc_id, line_no, page, CASE WHEN line_no % 24 = 0 THEN 'Other title' WHEN line_no % 8 = 0 THEN 'Head ' || CAST(page AS VARCHAR) || ' | part' WHEN line_no % 8 = 7 AND doc_id % 3 > 0 THEN '第 ' || CAST(page AS VARCHAR) || ' 页 / 9' ELSE text END AS text FROM {_PAGED})"""
_MKEY, _MTEMPLATE = "regexp_replace({x}, '[|｜0-9\\s]', '', 'g')", "regexp_replace(regexp_replace({x}, '[0-9]+', '#', 'g'), '\\s+', '', 'g')"
_MSIM = """CASE WHEN k.key = '' OR o.key = '' THEN 0.0 WHEN k.key = o.key THEN 1.0 WHEN contains(k.key, o.key) OR contains(o.key, k.key) THEN 0.92
    ELSE len(list_intersect(list_distinct(string_split(k.key, '')), list_distinct(string_split(o.key, '')))) / greatest(len(list_distinct(list_concat(string_split(k.key, ''), string_split(o.key, '')))), 1) END"""
_MARGINS = f"""(WITH e AS (SELECT doc_id, page, min_by(text, line_no) AS first, max_by(text, line_no) AS last FROM {_MT} WHERE page <= 5 GROUP BY ALL), t AS (SELECT doc_id, count(*) AS pages FROM e GROUP BY doc_id),
    k AS (SELECT doc_id, page, {_MKEY.replace('{x}', 'first')} AS key FROM e), h AS (SELECT k.doc_id, k.page, k.key, count(CASE WHEN {_MSIM} >= 0.9 THEN 1 END) AS n FROM k JOIN k o ON o.doc_id = k.doc_id WHERE k.key <> '' GROUP BY ALL),
    f AS (SELECT doc_id, key, count(*) AS n, min(page) AS page FROM (SELECT doc_id, page, {_MTEMPLATE.replace('{x}', 'last')} AS key FROM e WHERE length(trim(last)) <= 40 AND regexp_matches(last, '[0-9]')) GROUP BY doc_id, key)
    SELECT doc_id, 'header' AS kind, key, n FROM (SELECT h.*, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page) AS r FROM h JOIN t USING (doc_id) WHERE n >= greatest(2, floor(0.6 * pages))) WHERE r = 1
    UNION ALL SELECT doc_id, 'footer', key, n FROM (SELECT f.*, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page) AS r FROM f) JOIN t USING (doc_id) WHERE r = 1 AND n >= greatest(2, floor(0.5 * pages)))"""


def _paged(spark, d):
    l = table(spark, d, "doc_lines")
    return l.withColumn("page", F.expr("(line_no - line_no % 8) div 8 + 1"))


def _margin_lines(spark, d):
    n, page = F.col("line_no"), F.col("page").cast("string")
    last = F.concat(F.lit("第 "), page, F.lit(" 页 / 9"))
    text = F.when(n % 24 == 0, "Other title").when(n % 8 == 0, F.concat(F.lit("Head "), page, F.lit(" | part"))).when((n % 8 == 7) & (F.col("doc_id") % 3 > 0), last).otherwise(F.col("text"))
    return _paged(spark, d).withColumn("text", text)


@query("a21_margins", f"SELECT doc_id, kind, key, n FROM {_MARGINS}")
def a21(spark, d):
    return O.repeated_margins(_margin_lines(spark, d))


@query("a22_without_margins", f"""SELECT doc_id, line_no FROM {_MT} l WHERE NOT EXISTS (SELECT 1 FROM {_MARGINS} m WHERE m.kind = 'header' AND m.doc_id = l.doc_id AND m.key = {_MKEY.replace('{x}', 'l.text')})
    AND NOT EXISTS (SELECT 1 FROM {_MARGINS} m WHERE m.kind = 'footer' AND m.doc_id = l.doc_id AND m.key = {_MTEMPLATE.replace('{x}', 'l.text')}) AND NOT regexp_matches(trim(l.text), '^[-—\\s]*[0-9]+[-—\\s]*$')""")
def a22(spark, d):
    p = _margin_lines(spark, d)
    return O.drop_margins(p, O.repeated_margins(p)).select("doc_id", "line_no")


@query("c7_normalized", "SELECT doc_id, line_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM {doc_lines}")
def c7(spark, d):
    return table(spark, d, "doc_lines").select("doc_id", "line_no", X.normalized(F.col("text")).alias("text"))


@query("c8_folded", "SELECT doc_id, line_no, regexp_replace(translate(text, '（），。：；', '(),.:;'), '\\s+', '', 'g') AS text FROM {doc_lines}")
def c8(spark, d):
    return table(spark, d, "doc_lines").select("doc_id", "line_no", X.folded(F.col("text")).alias("text"))


@query("c9_comparison_key", "SELECT doc_id, line_no, regexp_replace(translate(translate(text, '，。：；、！', ',.:;,!'), '節', '节'), '\\s+', '', 'g') AS key FROM {doc_lines}")
def c9(spark, d):
    return table(spark, d, "doc_lines").select("doc_id", "line_no", X.comparison_key(F.col("text"), "節", "节").alias("key"))


@query("c10_section_name", r"SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(text || ' 2024年1月2日', '^\s*([0-9]+|[一二三四五六七八九十]+)[.、．]\s*', ''), '[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日', 'xxxx年x月x日', 'g'), '[（()）\[\]【】\s]', '', 'g') AS name FROM {doc_lines}")
def c10(spark, d):
    return table(spark, d, "doc_lines").select("doc_id", "line_no", X.section_name(F.concat("text", F.lit(" 2024年1月2日"))).alias("name"))


def _wide(n: str, duck: bool) -> str:
    """The character number n behind the first of the unified ideographs."""
    return f"chr(CAST(19968 + {n} AS INTEGER))" if duck else f"decode(unhex(lpad(hex(cast(19968 + {n} as bigint)), 4, '0')), 'UTF-16BE')"


@query("c9_folding_table", f"""WITH f AS (SELECT {_wide('k', True)} AS a, {_wide('(k * 7) % 3000', True)} AS b FROM (SELECT DISTINCT o_orderkey % 5000 AS k FROM orders) WHERE k >= 3000),
    t AS (SELECT doc_id, line_no, unnest([{', '.join(_wide(f'(line_no * 311 + doc_id * {m}) % 6000', True) for m in (17, 23, 401))}]) AS c, unnest([1, 2, 3]) AS n FROM {{doc_lines}})
    SELECT doc_id, line_no, string_agg(coalesce(b, c), '' ORDER BY n) AS key FROM t LEFT JOIN f ON f.a = t.c GROUP BY ALL""")
def c9_table(spark, d):
    k = table(spark, d, "orders").select((F.col("o_orderkey") % 5000).alias("k")).distinct().where("k >= 3000")
    pairs = k.select(F.expr(_wide("k", False)).alias("from"), F.expr(_wide("(k * 7) % 3000", False)).alias("to"))
    text = F.concat(F.lit(" "), *[F.expr(_wide(f"(line_no * 311 + doc_id * {m}) % 6000", False)) for m in (17, 23, 401)])
    return table(spark, d, "doc_lines").select("doc_id", "line_no", X.comparison_key(text, *X.folding(pairs)).alias("key"))


@query("c12_titles", f"""SELECT doc_id, line_no, {_KEY.replace('{x}', 'text')} AS key, CASE WHEN regexp_matches(text, '^第[一二三四五六七八九十百]+[章节条]') THEN regexp_extract(text, '^(第[一二三四五六七八九十百]+[章节条])', 1) WHEN regexp_matches(text, '^[0-9]+([.][0-9]+)+') THEN regexp_extract(text, '^([0-9]+([.][0-9]+)+)', 1)
    WHEN regexp_matches(text, '^[0-9]+[.、]') THEN regexp_extract(text, '^([0-9]+)[.、]', 1) WHEN regexp_matches(text, '^[一二三四五六七八九十]+、') THEN regexp_extract(text, '^([一二三四五六七八九十]+)、', 1) END AS number FROM {{doc_lines}}""")
def c12(spark, d):
    return table(spark, d, "doc_lines").select("doc_id", "line_no", X.title_key(F.col("text")).alias("key"), X.number_hint(F.col("text")).alias("number"))


@query("c13_numerals", "SELECT p_partkey, CAST(p_partkey % 100 AS INTEGER) AS value FROM part WHERE p_partkey % 100 > 0")
def c13(spark, d):
    p = table(spark, d, "part").where("p_partkey % 100 > 0")
    n = F.col("p_partkey") % 100
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    name = lambda k: F.substring(F.lit(X.DIGITS), k + 1, F.lit(1))
    word = F.concat(F.when(tens > 1, name(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, name(ones)).otherwise(""))
    return p.select("p_partkey", X.numeral(word).cast("int").alias("value"))


@query("c17_sentences", r"""SELECT doc_id, line_no, CAST(i - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id, line_no, generate_subscripts(u, 1) AS i, unnest(u) AS s FROM
    (SELECT doc_id, line_no, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?.]*[。！？!?.]|[^。！？!?.]+$'), lambda x: trim(x)), lambda x: x <> '') AS u FROM {doc_lines}))""")
def c17(spark, d):
    return table(spark, d, "doc_lines").select("doc_id", "line_no", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query("c53_chinese_gate", r"""SELECT doc_id, (a + b < 24) OR NOT (a >= 2 * b AND b < 40) AS passes FROM (SELECT doc_id, length(regexp_replace(substr(text, 1, 8000), '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(substr(text, 1, 8000), '[^\x{4e00}-\x{9fff}]', '', 'g')) AS b FROM documents)""")
def c53(spark, d):
    return table(spark, d, "documents").select("doc_id", X.chinese_gate(F.col("text")).alias("passes"))
