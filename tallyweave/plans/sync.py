"""Queries over table syncs, sources and nested columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.operators import sync as Y
from tallyweave.plans.fixtures import table
from tallyweave.plans.registry import query
from tallyweave.sources import files as S


@query("j27_two_keys", """SELECT s.c_custkey, s.c_name, coalesce(k.c_custkey, t.k) AS target_key FROM (SELECT CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, c_name FROM {customer_new}) s
    LEFT JOIN customer k ON k.c_custkey = s.c_custkey LEFT JOIN (SELECT c_name, min(c_custkey) AS k FROM customer GROUP BY c_name) t ON t.c_name = replace(s.c_name, ' ', '')""")
def j27(spark, d):
    new = table(spark, d, "customer_new").select(F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey")).alias("c_custkey"), "c_name")
    return Y.match_two_keys(new, table(spark, d, "customer"), "c_custkey", "c_name")


@query("j28_disable_missing", "SELECT c_custkey, c_acctbal > 0 AND c_custkey IN (SELECT c_custkey FROM {customer_new}) AS active FROM customer")
def j28(spark, d):
    target = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("active"))
    return Y.disable_missing(target, table(spark, d, "customer_new"), "c_custkey")


@query("d9_changes", "SELECT c.c_custkey, 'c_name' AS changed FROM customer c JOIN {customer_new} n ON n.c_custkey = c.c_custkey WHERE n.c_name <> c.c_name")
def d9(spark, d):
    out = Y.upsert_changes(table(spark, d, "customer"), table(spark, d, "customer_new"), "c_custkey", ["c_name", "c_mktsegment"])
    return out.select("c_custkey", F.array_join("changed", ",").alias("changed"))


@query("d9_applied", "SELECT c.c_custkey, coalesce(n.c_name, c.c_name) AS c_name, c.c_acctbal FROM customer c LEFT JOIN {customer_new} n ON n.c_custkey = c.c_custkey")
def d9a(spark, d):
    return Y.apply_changes(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), table(spark, d, "customer_new"), "c_custkey", ["c_name"])


@query("a27_counters", """SELECT count(*) FILTER (WHERE c.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL AND n.c_name <> c.c_name) AS updated, count(*) FILTER (WHERE n.c_custkey IS NULL) AS disabled, count(*) FILTER (WHERE n.c_name = c.c_name) AS unchanged, count(*) FILTER (WHERE c.c_custkey IS NULL) AS skipped
    FROM customer c FULL JOIN {customer_new} n ON n.c_custkey = c.c_custkey""")
def a27(spark, d):
    return Y.sync_counters(table(spark, d, "customer"), table(spark, d, "customer_new"), "c_custkey", ["c_name", "c_mktsegment"])


@query("j26_members", "SELECT DISTINCT event_id, m AS n_nationkey FROM (SELECT event_id, unnest([event_id % 40, user_id % 30, 3]) AS m FROM events) WHERE m IN (SELECT n_nationkey FROM nation)")
def j26(spark, d):
    e = table(spark, d, "events").select("event_id", F.array(F.col("event_id") % 40, F.col("user_id") % 30, F.lit(3).cast("bigint")).alias("agents"))
    return Y.array_members(e, "event_id", "agents", table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint")), "n_nationkey")


@query("j30_visible", """WITH u AS (SELECT DISTINCT user_id AS user FROM events), i AS (SELECT n_nationkey AS item, n_regionkey = 1 AS public FROM nation WHERE n_nationkey % 6 <> 5), g AS (SELECT DISTINCT user_id AS user, CAST(event_id % 25 AS INTEGER) AS item FROM events WHERE user_id % 3 = 0 AND event_id % 20 = 0)
    SELECT u.user, i.item FROM u, i WHERE i.public OR EXISTS (SELECT 1 FROM g WHERE g.user = u.user AND g.item = i.item) OR NOT EXISTS (SELECT 1 FROM g WHERE g.user = u.user)""")
def j30(spark, d):
    e = table(spark, d, "events")
    items = table(spark, d, "nation").select(F.col("n_nationkey").alias("item"), (F.col("n_regionkey") == 1).alias("public"), (F.col("n_nationkey") % 6 != 5).alias("active"))
    grants = e.where("user_id % 3 = 0 and event_id % 20 = 0").select(F.col("user_id").alias("user"), (F.col("event_id") % 25).cast("int").alias("item")).distinct()
    return Y.visible_items(e.select(F.col("user_id").alias("user")).distinct(), items, grants, True)


@query("j33_override", "SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c FULL JOIN {customer_new} n ON n.c_custkey = c.c_custkey")
def j33(spark, d):
    return Y.override(table(spark, d, "customer").where("c_custkey % 4 <> 0"), table(spark, d, "customer_new"), "c_custkey", ["c_name", "c_mktsegment"])


@query("d10_whitelist", """WITH r AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS cat, event_type AS item, event_id % 5 = 0 AS checked FROM events), s AS (SELECT user_id, cat, list_distinct(list(CASE WHEN checked THEN item END) FILTER (WHERE checked)) AS ons FROM r GROUP BY ALL),
    l AS (SELECT 'x' AS cat, ['click', 'view', 'other'] AS items UNION ALL SELECT 'y', ['error', 'signup']), j AS (SELECT user_id, s.cat, items, CASE WHEN len(coalesce(ons, [])) = 1 AND list_contains(ons, items[-1]) THEN [] ELSE coalesce(ons, []) END AS ons FROM s JOIN l ON l.cat = s.cat)
    SELECT user_id, cat, item, list_contains(ons, item) AS checked FROM (SELECT user_id, cat, ons, unnest(items) AS item FROM j)""")
def d10(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, "x").otherwise("y").alias("cat"), F.col("event_type").alias("item"), (F.col("event_id") % 5 == 0).alias("checked"))
    return Y.complete_whitelist(e, "user_id", "cat", "item", {"x": ["click", "view", "other"], "y": ["error", "signup"]}, F.col("item"))


@query("d7_intersect", "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 7 = 0")
def d7(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'error' and event_id % 7 = 0").select("user_id"))


def _payloads(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 13 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).otherwise(F.col("props"))
    return e.select("event_id", text.alias("payload"))


@query("s1_records", """SELECT event_id, CAST(p AS INTEGER) AS pos, json_extract_string(props, '$.k') AS k FROM (SELECT event_id, props, unnest(CASE WHEN event_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS p FROM events WHERE event_id % 13 <> 0)""")
def s1(spark, d):
    return S.records(_payloads(spark, d))[0].select("event_id", "pos", F.element_at("record", "k").alias("k"))


@query("s2_quarantine", "SELECT event_id FROM events WHERE event_id % 13 = 0")
def s2(spark, d):
    return S.records(_payloads(spark, d))[1].select("event_id")


@query("s8_user_schema", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def s8(spark, d):
    schema = S.schema_of([{"name": "k", "type": "number"}, {"name": "tags", "type": "array"}])
    return table(spark, d, "events").select("event_id", F.from_json("props", schema).alias("p")).select("event_id", "p.k")


@query("c48_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS \"p.k\" FROM events")
def c48(spark, d):
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", S.schema_of([{"name": "k", "type": "number"}])).alias("p"))
    return parsed.select(*S.flatten(parsed))


@query("c49_parallel_arrays", "SELECT o_orderkey, CAST(p AS INTEGER) AS pos, CASE WHEN p = 0 THEN o_orderpriority WHEN p = 1 THEN 'x' ELSE '' END AS a, CASE WHEN p < 1 + o_orderkey % 3 THEN o_orderstatus ELSE '' END AS b FROM (SELECT *, unnest(generate_series(0, greatest(1, o_orderkey % 3))) AS p FROM orders)")
def c49(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.array("o_orderpriority", F.lit("x")).alias("a"), F.array_repeat("o_orderstatus", (F.col("o_orderkey") % 3 + 1).cast("int")).alias("b"))
    return S.parallel_arrays(o, ["o_orderkey"], ["a", "b"])


@query("s3_ledger_grid", "SELECT file, sheet, row_no, max(CASE col_no WHEN 3 THEN value END) AS m1, max(CASE col_no WHEN 4 THEN value END) AS m2, max(CASE col_no WHEN 5 THEN value END) AS m3, max(CASE col_no WHEN 6 THEN value END) AS m4 FROM {cells} GROUP BY ALL")
def s3(spark, d):
    cells = table(spark, d, "cells")
    names = F.explode(F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), F.lit(f"h{c}" if r == 3 else "top").alias("value")) for r in range(1, 5) for c in range(3, 7)])).alias("h")
    heads = cells.select("file", "sheet").distinct().select("file", "sheet", names).select("file", "sheet", "h.*")
    return S.ledger_grid(heads.unionByName(cells), 4, {"h3": "m1", "h4": "m2", "h5": "m3", "h6": "m4"})


def _told(words: dict[str, str], alone: bool) -> str:
    """SQL for the word that v has: the only one, or the first that j has."""
    if alone:
        return f"CASE WHEN {' + '.join(f'CAST(contains(v, {w!r}) AS INT)' for w in words)} = 1 THEN CASE {' '.join(f'WHEN contains(v, {w!r}) THEN {k!r}' for w, k in words.items())} END END"
    return f"CASE {' '.join(f'WHEN contains(j, {w!r}) THEN {k!r}' for w, k in words.items())} END"


@query("s3_ledger_records", f"""WITH t AS (SELECT *, dense_rank() OVER (PARTITION BY file, sheet ORDER BY row_no) AS rank FROM (SELECT *, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS v FROM {{grid}} WHERE row_no <= 12) WHERE v <> ''),
    k AS (SELECT *, max(rank) OVER (PARTITION BY file, sheet) AS top, max(row_no) OVER (PARTITION BY file, sheet) AS last FROM t WHERE rank <= 4),
    c AS (SELECT file, sheet, last, col_no, string_agg(replace(v, ' ', ''), '' ORDER BY rank) AS j, {', '.join(f'arg_max({_told(w, True)}, rank) AS {n}' for n, w in S.HEADER_WORDS.items())} FROM k WHERE top = 4 AND rank > 1 GROUP BY ALL),
    f AS (SELECT file, sheet, field, max(last) AS last, max(col_no) AS col_no FROM (SELECT *, CASE WHEN contains(j, '指标编号') OR contains(j, '指标代码') THEN 'code' WHEN contains(j, '指标名称') THEN 'name' ELSE {" || '_' || ".join(f'coalesce({n}, {_told(w, False)})' for n, w in S.HEADER_WORDS.items())} END AS field FROM c) WHERE field IS NOT NULL GROUP BY ALL),
    b AS (SELECT g.file, g.sheet, g.row_no, max(CASE WHEN field = 'code' THEN trim(value) END) AS code, max(CASE WHEN field = 'name' THEN trim(value) END) AS name, {', '.join(f"max(CASE WHEN field = '{m}' THEN TRY_CAST(value AS DOUBLE) END) AS {m}" for m in S.LEDGER_MEASURES)} FROM {{grid}} g JOIN f ON f.file = g.file AND f.sheet = g.sheet AND f.col_no = g.col_no WHERE g.row_no > f.last GROUP BY ALL)
    SELECT * REPLACE (regexp_replace(code, '[.]0$', '') AS code) FROM b WHERE code <> '' AND contains(name, 'N')""")
def s3_records(spark, d):
    return S.ledger_records(table(spark, d, "grid"))


@query("s4_merged_cells", "SELECT file, sheet, row_no, col_no, CASE WHEN row_no BETWEEN 12 AND 14 AND col_no BETWEEN 3 AND 4 AND (SELECT max(k.value) FROM {cells} k WHERE k.file = c.file AND k.sheet = c.sheet AND k.row_no = 12 AND k.col_no = 3) IS NOT NULL THEN (SELECT max(k.value) FROM {cells} k WHERE k.file = c.file AND k.sheet = c.sheet AND k.row_no = 12 AND k.col_no = 3) ELSE value END AS value FROM {cells} c")
def s4(spark, d):
    cells = table(spark, d, "cells")
    ranges = cells.select("file", "sheet").distinct().select("file", "sheet", F.lit(12).alias("top"), F.lit(3).alias("left"), F.lit(14).alias("bottom"), F.lit(4).alias("right"))
    filled = S.fill_merged(cells, ranges)
    return filled.join(cells.select("file", "sheet", "row_no", "col_no"), ["file", "sheet", "row_no", "col_no"], "left_semi")


@query("s5_sheet_names", "SELECT file, sheet_no, CASE WHEN sheet_no = min(sheet_no) OVER (PARTITION BY file) THEN 'AB01' ELSE 'AB' || CAST(sheet_no AS VARCHAR) END AS name FROM (SELECT DISTINCT file, row_no - 10 AS sheet_no FROM {cells})")
def s5(spark, d):
    sheets = table(spark, d, "cells").select("file", (F.col("row_no") - 10).alias("sheet_no")).distinct()
    first = F.min("sheet_no").over(Window.partitionBy("file"))
    named = sheets.withColumn("sheet", F.when(F.col("sheet_no") == first, "AB01").otherwise(F.col("sheet_no").cast("string")))
    return S.complete_sheet_names(named).select("file", "sheet_no", "name")


@query("s14_without_files", "SELECT row_id, file_id FROM {statement} WHERE file_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def s14(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").cast("bigint").alias("file_id"))
    return S.drop_file(table(spark, d, "statement"), gone).select("row_id", "file_id")
