"""Tables derived from the stored ones, for queries over operators whose own inputs
are not among them. Each is SQL over stored tables and other derived ones, in a
dialect that Spark and DuckDB share, or one text for each where they differ."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

STORED = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_LINES = """SELECT doc_id, lang, source, line_no, text, CASE WHEN line_no > 0 AND line_no % 40 = 0 THEN true ELSE false END AS page_break FROM {raw_lines}"""

SQL: dict[str, str | tuple[str, str]] = {
    # One record of a narrative for each order.
    "narrative": """SELECT o_orderkey AS rec_id, o_custkey % 50 AS batch_id, o_orderstatus AS sheet, cast(o_orderkey AS string) AS code,
        o_orderpriority AS name, CASE o_orderkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 1 END AS direction,
        CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE cast(o_totalprice AS decimal(18,2)) END AS amount,
        CASE o_orderkey % 9 WHEN 0 THEN '亿元' WHEN 1 THEN '亿美元' WHEN 2 THEN '亿' WHEN 3 THEN '万元' WHEN 4 THEN '万' WHEN 5 THEN '万美元' WHEN 6 THEN '元' WHEN 7 THEN '美元' ELSE '吨' END AS unit,
        cast(o_orderkey % 3 AS int) AS places, CASE o_orderkey % 7 WHEN 0 THEN 'foreign' WHEN 1 THEN 'usd_total' WHEN 2 THEN 'rmb' ELSE '' END AS scope,
        o_orderkey % 31 = 0 AS blocked, o_orderkey % 13 AS para
        FROM orders""",
    # Ledger rows: sums of an order's lines, some orders left out, some twice, one sheet absent.
    "ledger_once": """SELECT o.o_orderkey AS code_key, o.o_orderstatus AS sheet, CASE WHEN o.o_orderkey % 10 = 3 THEN '1-URGENT' ELSE o.o_orderpriority END AS name,
        sum(cast(l_extendedprice AS decimal(18,2))) AS cur_rmb, sum(cast(l_quantity AS decimal(18,2))) AS pre_rmb,
        CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE sum(cast(l_tax * 100 AS decimal(18,2))) END AS cur_foreign,
        sum(cast(l_discount * 100 AS decimal(18,2))) AS pre_foreign
        FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey WHERE o.o_orderkey % 17 <> 0 AND o.o_orderstatus <> 'P' GROUP BY o.o_orderkey, o.o_orderstatus, o.o_orderpriority""",
    "ledger": """SELECT code_key * 2 AS ledger_id, cast(code_key AS string) AS code, sheet, name, cur_rmb, pre_rmb, cur_foreign, pre_foreign FROM {ledger_once}
        UNION ALL SELECT code_key * 2 + 1, cast(code_key AS string), sheet, name, cur_rmb, pre_rmb, cur_foreign, pre_foreign FROM {ledger_once} WHERE code_key % 19 = 0""",
    # Company details of a record: lines of an order.
    "details": """SELECT l_orderkey AS rec_id, 'C' || cast(l_partkey % 97 AS string) AS company, CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 1 END AS direction,
        CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE cast(l_extendedprice AS decimal(18,2)) END AS amount,
        CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '亿元' ELSE '万元' END AS unit, l_orderkey % 200 AS batch_id, l_linenumber AS seq FROM lineitem""",
    # Exceptions of records: types spread over orders and lines.
    "exceptions": """SELECT o_custkey % 50 AS batch_id, cast(o_orderkey % 16 + 1 AS int) AS type_id, o_orderkey AS rec_id, CASE WHEN o_orderkey % 3 = 0 THEN 'amount' ELSE 'name' END AS field,
        cast(o_orderkey % 11 AS string) AS value, 'C' || cast(o_orderkey % 7 AS string) AS company, o_orderstatus AS sheet FROM orders
        UNION ALL SELECT l_orderkey % 50, cast(l_linenumber + 9 AS int), l_orderkey, 'unit', cast(l_suppkey % 5 AS string), 'C' || cast(l_partkey % 5 AS string), l_returnflag FROM lineitem WHERE l_orderkey % 4 = 0""",
    "raw_lines": (
        """SELECT doc_id, lang, source, cast(pos AS bigint) AS line_no, line AS text FROM documents LATERAL VIEW posexplode(split(text, '\\n', -1)) t AS pos, line""",
        """SELECT doc_id, lang, source, cast(generate_subscripts(s, 1) - 1 AS bigint) AS line_no, unnest(s) AS text FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS s FROM documents)""",
    ),
    "lines": _LINES,
    # Document lines in which headings, contents, a glossary, blanks and tables stand by rule.
    "doc_lines": """SELECT doc_id, line_no, line_no % 40 = 0 AS page_break, line_no % 17 = 9 AS is_table,
        CASE WHEN line_no = 1 THEN '目 录' WHEN line_no % 40 = 30 THEN '附 录' WHEN line_no % 12 = 0 THEN '第' || substr('一二三四五六七八九', cast(((line_no - line_no % 12) / 12) % 9 + 1 AS int), 1) || '节 Part' WHEN line_no % 12 = 3 THEN substr('一二三四五', cast((line_no * 7) % 5 + 1 AS int), 1) || '、Topic'
        WHEN line_no % 12 = 5 THEN '1.' || cast(line_no % 7 AS string) || ' Point' WHEN line_no % 12 = 7 THEN cast(line_no % 5 AS string) || '. Item' WHEN line_no % 12 = 8 THEN '2. Pay 100元' WHEN line_no % 19 = 4 THEN ' ' WHEN line_no % 24 = 13 THEN '第二节 Part' ELSE text END AS text FROM {raw_lines}""",
    # A second version of each document: some lines left out, changed, or twice.
    "versions_b": """SELECT doc_id, line_no * 2 AS line_no, CASE WHEN line_no % 29 = 3 THEN text || ' changed' ELSE text END AS text FROM {raw_lines} WHERE line_no % 23 <> 5
        UNION ALL SELECT doc_id, line_no * 2 + 1, text FROM {raw_lines} WHERE line_no % 31 = 7""",
    # Statement rows: an order is a transaction of the template that its status names.
    "statement": """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderstatus END AS bank, o_custkey % 20 AS file_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE cast(o_orderkey % 1000 AS string) END AS seq,
        CASE WHEN o_orderkey % 37 = 0 THEN ' ' WHEN o_orderkey % 43 = 0 THEN 'n/a' ELSE '1,' || substr('000' || cast(o_custkey % 1000 AS string), -3, 3) || '.5' END AS money, cast(o_orderdate AS date) AS day,
        CASE WHEN o_orderkey % 53 = 0 THEN 'see http://bank' WHEN o_orderkey % 59 = 0 THEN 'none' ELSE o_orderpriority END AS memo FROM orders""",
    "customer_new": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' Ltd' ELSE c_name END AS c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 7 <> 0""",
    # A third version with a numbering of its own: lines moved down, changed, dropped, doubled.
    "versions_c": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, line_no) - 1 AS line_no, text FROM (
        SELECT doc_id, line_no, CASE WHEN line_no % 6 = 2 THEN line_no * 4 + 14 ELSE line_no * 4 END AS pos, CASE WHEN line_no % 7 = 3 THEN text || ' changed' ELSE text END AS text FROM {doc_lines} WHERE line_no % 11 <> 5
        UNION ALL SELECT doc_id, line_no, line_no * 4 + 1, text FROM {doc_lines} WHERE line_no % 13 = 4) x""",
    "part_b": """SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 10 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice, p_type FROM part WHERE p_partkey % 13 <> 0""",
    "predictions": """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 15 = 0 THEN NULL ELSE toxic END AS toxic FROM labels WHERE doc_id % 12 <> 5
        UNION ALL SELECT doc_id + 1000000, quality, toxic FROM labels WHERE doc_id % 20 = 3""",
    # Cells of sheets: four header rows, then one row for each supplier group.
    "cells": """SELECT 'f' || cast(l_suppkey % 5 AS string) AS file, l_returnflag AS sheet, cast(10 + l_suppkey % 50 AS int) AS row_no, cast(l_linenumber % 4 + 3 AS int) AS col_no, cast(sum(cast(l_quantity AS bigint)) AS string) AS value
        FROM lineitem GROUP BY l_suppkey % 5, l_returnflag, l_suppkey % 50, l_linenumber % 4""",
    "summaries": """SELECT user_id, min(event_id) AS start_id, event_type FROM events WHERE event_type <> 'view' GROUP BY user_id, event_type""",
    "expected": """SELECT source, 'S' || cast(k AS string) AS name, k AS pos, CASE k % 3 WHEN 0 THEN 'name,amount' WHEN 1 THEN 'date,（total）' ELSE 'a, b' END AS headers, CASE WHEN k % 2 = 0 THEN 'note' ELSE '' END AS description
        FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 6)""",
    "found": """SELECT d.doc_id, e.source, CASE WHEN (d.doc_id + e.pos) % 7 = 0 THEN e.name || 'x' ELSE e.name END AS name, e.pos,
        CASE WHEN (d.doc_id + e.pos) % 5 = 0 THEN replace(e.headers, 'name', 'ame') WHEN (d.doc_id + e.pos) % 11 = 0 THEN replace(replace(e.headers, '（', '('), '）', ')') || ',extra' ELSE e.headers END AS headers,
        CASE WHEN d.doc_id % 4 = 0 THEN ' note' WHEN d.doc_id % 9 = 0 THEN '' ELSE e.description END AS description
        FROM documents d JOIN {expected} e ON d.source = e.source WHERE e.pos < 6 - d.doc_id % 3
        UNION ALL SELECT doc_id, source, 'T', 6, 'z', '' FROM documents WHERE doc_id % 6 = 0""",
    # Sentences whose marks, words and amounts vary with several keys of an order.
    "sentences": """SELECT o_orderkey AS rec_id, CASE o_orderkey % 4 WHEN 0 THEN '（' || cast(o_custkey % 30 AS string) || '）' WHEN 1 THEN '(' || cast(o_custkey % 30 AS string) || ')' ELSE '' END
        || CASE o_orderkey % 5 WHEN 0 THEN '“A' || cast(o_custkey AS string) || '货款”' WHEN 1 THEN '"B' || cast(o_custkey AS string) || '"' WHEN 2 THEN '“C' || cast(o_custkey AS string) WHEN 3 THEN 'D' || cast(o_custkey % 1000 AS string) ELSE '“一。二”' END
        || CASE WHEN o_orderkey % 11 = 3 THEN '。' ELSE '' END || '本期' || CASE WHEN o_orderkey % 3 = 0 THEN '减少' ELSE '增加' END || cast(o_custkey AS string) || CASE WHEN o_orderkey % 7 = 0 THEN '亿美元' ELSE '万元' END
        || CASE o_custkey % 6 WHEN 0 THEN '。' WHEN 1 THEN '，主要为甲' WHEN 2 THEN '，主要原因是乙公司' ELSE '，主要是丙' END || CASE WHEN o_custkey % 6 = 0 THEN '' ELSE CASE o_orderkey % 6 WHEN 0 THEN '增加了' WHEN 1 THEN '减少约' ELSE '增加' END || cast(o_orderkey % 977 AS string)
        || CASE WHEN o_orderkey % 13 = 0 THEN '.5 美元' ELSE '亿元' END || CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '；' ELSE '。' END END AS text FROM orders""",
    # Main sentences in the canonical form and in others.
    "token_sentences": """SELECT o_orderkey AS rec_id, CASE o_orderkey % 3 WHEN 0 THEN '“A' || cast(o_custkey AS string) || '”' WHEN 1 THEN '（3）"B"' ELSE '' END
        || CASE o_custkey % 8 WHEN 0 THEN '本期增加' WHEN 1 THEN '本期约增加' WHEN 2 THEN '本月减少' WHEN 3 THEN '本期增加约 ' WHEN 4 THEN '本期余额为' WHEN 5 THEN '增加' WHEN 6 THEN '本年共减少又增加了' ELSE '余额' END
        || CASE o_orderkey % 10 WHEN 3 THEN '' WHEN 4 THEN '9' ELSE cast(o_custkey AS string) || '万元' END AS text FROM orders""",
    "found_other": """SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 AND pos = 5 THEN '14. 其他' WHEN doc_id % 3 = 1 AND pos = 3 THEN '3.其他 ' WHEN doc_id % 4 = 1 AND pos = 2 THEN '其他' ELSE name END AS name, pos, headers, description FROM {found}""",
    # Sections with up to three subsections each; sub is null for the section itself.
    "expected_subs": """SELECT source, name, pos, cast(NULL AS bigint) AS sub, '' AS headers FROM {expected}
        UNION ALL SELECT e.source, e.name || '.' || cast(n.n_nationkey AS string), e.pos, cast(n.n_nationkey AS bigint), CASE WHEN (e.pos + n.n_nationkey) % 2 = 0 THEN e.headers ELSE 'no,（sum）' END FROM {expected} e JOIN nation n ON n.n_nationkey < e.pos % 4""",
    "found_subs": """SELECT doc_id, source, name, pos, cast(NULL AS bigint) AS sub, '' AS headers FROM {found}
        UNION ALL SELECT d.doc_id, e.source, CASE WHEN (d.doc_id + e.sub) % 6 = 1 THEN e.name || 'x' ELSE replace(e.name, '.', ' . ') END, e.pos, e.sub, CASE WHEN (d.doc_id + e.pos) % 5 = 2 THEN 'no,more' ELSE replace(replace(e.headers, '（', '('), '）', ')') END
        FROM documents d JOIN {expected_subs} e ON d.source = e.source WHERE e.sub IS NOT NULL AND e.sub < 3 - d.doc_id % 2
        UNION ALL SELECT doc_id, source, 'more', 2, 7, 'q' FROM documents WHERE doc_id % 9 = 4""",
    # Main sentences: period, direction, amount, unit and tail vary apart.
    "main_sentences": """SELECT o_orderkey AS rec_id, CASE o_orderkey % 9 WHEN 8 THEN ' 无金额' || CASE WHEN o_custkey % 2 = 0 THEN '增加' ELSE '' END WHEN 7 THEN '本期无' || o_orderstatus ELSE
        CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '本年' WHEN 2 THEN '甲' ELSE '本期' END || CASE o_orderkey % 8 WHEN 0 THEN '增加' WHEN 1 THEN '减少了' WHEN 2 THEN '增加 约' WHEN 3 THEN '为' WHEN 4 THEN '－' WHEN 5 THEN '有所减少' WHEN 6 THEN '' ELSE '增减' END
        || cast(o_custkey AS string) || CASE o_orderkey % 3 WHEN 0 THEN '.25亿元' WHEN 1 THEN ' 万美元' ELSE '元' END
        || CASE o_custkey % 7 WHEN 0 THEN '，等小额增加' WHEN 1 THEN ' 左右。' WHEN 2 THEN '，乙公司增约' || cast(o_orderkey % 97 AS string) || '.5万元' WHEN 3 THEN '，另有3元' WHEN 4 THEN '。丙减少了2亿' ELSE '' END END AS text FROM orders""",
    # Ledger sheets: a title, three header rows with gaps, ambiguous and split words, then rows.
    "grid": """SELECT s.file, s.sheet, cast(r.n_nationkey AS int) AS row_no, cast(c.n_nationkey AS int) AS col_no, CASE r.n_nationkey WHEN 1 THEN CASE WHEN c.n_nationkey = 1 THEN '人民币 上期' ELSE '' END
        WHEN 3 THEN CASE WHEN c.n_nationkey < 3 THEN ' ' WHEN c.n_nationkey = 6 AND s.sheet = 'R' THEN '上期及本期' WHEN c.n_nationkey < 5 THEN '本期 金额' ELSE '上期' END
        WHEN 5 THEN CASE WHEN c.n_nationkey < 3 THEN '' WHEN c.n_nationkey % 2 = 1 THEN '人民币' WHEN s.file = 'f1' THEN '美元合计/人民币' WHEN s.sheet = 'A' THEN '本外币' ELSE '美元 合计' END
        ELSE CASE c.n_nationkey WHEN 1 THEN CASE WHEN s.file = 'f0' THEN '指标 编号' ELSE '指标代码' END WHEN 2 THEN CASE WHEN s.file = 'f3' THEN '名称' ELSE '指标名称' END WHEN 3 THEN '期末余额' WHEN 4 THEN CASE WHEN s.sheet = 'N' THEN '发生额（本外币）' ELSE '发生额' END WHEN 5 THEN '余额、发生额' ELSE '发生额' END END AS value
        FROM (SELECT DISTINCT file, sheet FROM {cells}) s CROSS JOIN nation r CROSS JOIN nation c WHERE r.n_nationkey IN (1, 3, 5, 6) AND c.n_nationkey BETWEEN 1 AND 6 AND NOT (s.file = 'f4' AND r.n_nationkey = 6)
        UNION ALL SELECT file, sheet, row_no, col_no, value FROM {cells}
        UNION ALL SELECT DISTINCT file, sheet, row_no, cast(1 AS int), CASE WHEN row_no % 7 = 0 THEN '' ELSE cast(row_no AS string) || '.0' END FROM {cells}
        UNION ALL SELECT DISTINCT file, sheet, row_no, cast(2 AS int), CASE WHEN row_no % 9 = 0 THEN '1. ' ELSE '1. N' || cast(row_no AS string) END FROM {cells}""",
    # Letters: a text that tells some of its fields, and what a reader gave for each.
    "letters": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '函证编号：HZ-' || cast(c_custkey AS string) ELSE '条形码：BC' || cast(c_custkey + 100000 AS string) END || '；' || CASE WHEN c_custkey % 4 = 1 THEN '致：城' || cast(c_nationkey AS string) || '银行天律分行' ELSE '' END
        || '，本公司聘请的' || CASE WHEN c_custkey % 2 = 0 THEN '甲' || cast(c_nationkey AS string) || '有限公司会计师事务所（特殊普通合伙）正在审计' ELSE '审计师' END || '。自2024年1月' || cast(c_nationkey % 9 + 10 AS string) || '日起至2024年3月5日期间。'
        || '回函地址：路1号 ' || CASE WHEN c_custkey % 5 = 2 THEN '收件人：' || CASE WHEN c_nationkey % 2 = 0 THEN '李四' ELSE '王五' END || ' 电话：021-' || cast(c_custkey AS string) || '（项目组） 邮编：200030' ELSE '' END
        || ' 扣费账号：AB62' || cast(c_custkey + 1000000 AS string) || '。预留签章 2024年4月0' || cast(c_nationkey % 7 + 2 AS string) || '日 FS 2024-04-01。' AS text,
        'NO. A' || cast(c_custkey AS string) AS confirmation_no, '致：城' || cast(c_nationkey AS string) || '银行' AS recipient_bank, '[乙]会计师事务所公司，' AS accounting_firm, '路' || cast(c_nationkey AS string) || '号公司' AS reply_address, '赵六电话' AS contact_person,
        '+86 (21) ' || cast(c_custkey AS string) || '/x' AS phone, 'P 200030 x' AS postal_code, '2024年4月1日' AS cutoff_date, '2023-01-01' AS start_date, '2024.13.01' AS end_date, CASE WHEN c_custkey % 2 = 0 THEN '2024-04-01' ELSE '20240407' END AS seal_date,
        CASE WHEN c_custkey % 4 = 1 THEN '城' || cast(c_nationkey AS string) || '银行天律分行' ELSE c_name END AS signature_name FROM customer""",
}


def _one(name: str, duck: bool) -> str:
    text = SQL[name]
    return text if isinstance(text, str) else text[int(duck)]


def expand(sql: str, duck: bool = True) -> str:
    """The SQL with each {name} of a derived table replaced by that table's own SQL."""
    while True:
        new = re.sub(r"\{([a-z_]+)\}", lambda m: f"({_one(m[1], duck)})", sql)
        if new == sql:
            return sql
        sql = new


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored or derived table."""
    if name in STORED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = expand(f"SELECT * FROM {{{name}}}", duck=False)
    used = [t for t in STORED if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]
    bound = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(used)})\b", r"\1\2{\3}", sql)
    return spark.sql(bound, **{t: table(spark, sf_dir, t) for t in used})
