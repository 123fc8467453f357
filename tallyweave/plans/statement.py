"""Queries over statement rows (survey 3.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import money
from tallyweave.operators import statement as S
from tallyweave.plans.fixtures import table
from tallyweave.plans.registry import query


def registry() -> S.Registry:
    """Templates that the statement table's bank names, with their own labels."""
    made = S.Registry(default="O")
    made.add("O", S.Mapping({"seq": "no", "amount": "money", "memo": "note"}, {"amount": money.decimal_of}))
    made.add("F", S.Mapping({"seq": "serial", "amount": "sum", "day": "date"}, {"amount": money.decimal_of}))
    made.add("P", S.Mapping({"seq": "id", "memo": "text", "day": "when"}, number_rows=False))
    return made


def _raw(spark, d):
    s = table(spark, d, "statement")
    label = lambda o, f, p: F.when(F.col("bank") == "F", f).when(F.col("bank") == "P", p).otherwise(o)
    values = F.map_from_arrays(
        F.array(label("no", "serial", "id"), label("money", "sum", "money"), label("note", "note", "text"), label("date", "date", "when")), F.array("seq", "money", "memo", F.col("day").cast("string"))
    )
    return s.select("row_id", "file_id", "bank", values.alias("values"))


_AMOUNT = "CAST(TRY_CAST(regexp_replace(money, '[,\\s]', '', 'g') AS DECIMAL(18,2)) AS VARCHAR)"


@query("p1_mapping", f"""SELECT row_id, file_id, bank, coalesce(bank, 'O') AS template, CASE WHEN trim(seq) <> '' THEN seq END AS seq, CASE WHEN coalesce(bank, 'O') IN ('O', 'F') AND trim(money) <> '' THEN {_AMOUNT} END AS amount,
    CASE WHEN coalesce(bank, 'O') IN ('O', 'P') THEN memo END AS memo, CASE WHEN coalesce(bank, 'O') IN ('F', 'P') THEN CAST(day AS VARCHAR) END AS day FROM {{statement}}""")
def p1(spark, d):
    return registry().project(_raw(spark, d), "bank")


@query("p2_sequence", """SELECT row_id, file_id, CASE WHEN seq IS NULL AND coalesce(bank, '') <> 'P' THEN CAST(row_number() OVER (PARTITION BY file_id ORDER BY row_id) AS VARCHAR) ELSE seq END AS seq FROM {statement}""")
def p2(spark, d):
    return S.number_missing(table(spark, d, "statement"), "seq", ["file_id"], ["row_id"], F.coalesce(F.col("bank"), F.lit("")) != "P").select("row_id", "file_id", "seq")


@query("p3_rejected", "SELECT row_id, bank FROM {statement} WHERE bank IS NULL")
def p3(spark, d):
    return registry().rejected(table(spark, d, "statement"), "bank").select("row_id", "bank")


@query("f1_tenant", "SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id FROM events WHERE user_id = 7 OR user_id % 10 = 0")
def f1(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id")).where(S.visible_to(7))


@query("f2_noise", r"""SELECT row_id FROM {statement} WHERE NOT coalesce(regexp_matches(lower(memo), 'http|\.com|aspx|enquiry'), false) AND
    CASE WHEN trim(coalesce(seq, '')) <> '' THEN regexp_matches(seq, '[0-9]') WHEN trim(money) <> '' THEN regexp_matches(money, '[0-9]') ELSE coalesce(bank, '') <> 'F' END""")
def f2(spark, d):
    keep = S.is_record(F.col("memo"), [F.col("seq"), F.col("money")], F.coalesce(F.col("bank"), F.lit("")) == "F")
    return table(spark, d, "statement").where(keep).select("row_id")


@query("f3_complete_summaries", "SELECT row_id FROM {statement} WHERE trim(bank) <> '' AND trim(memo) <> '' AND seq IS NOT NULL AND trim(seq) <> '' AND (trim(money) <> '' OR trim(memo) <> '')")
def f3(spark, d):
    s = table(spark, d, "statement").select("row_id", F.col("bank").alias("account"), F.col("memo").alias("name"), F.col("seq").alias("range"), F.col("money").alias("income"), F.col("memo").alias("expense"), F.col("seq").alias("count"))
    return s.where(S.complete_summary()).select("row_id")


@query("o2_record_order", """SELECT row_id, file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN num THEN TRY_CAST(k AS BIGINT) END NULLS FIRST, CASE WHEN NOT num THEN k END NULLS FIRST, row_id) AS INTEGER) AS place FROM
    (SELECT row_id, file_id, k, bool_and(TRY_CAST(k AS BIGINT) IS NOT NULL) OVER (PARTITION BY file_id) AS num FROM (SELECT row_id, file_id, CASE WHEN file_id % 3 = 0 THEN memo ELSE CAST(row_id * 7 % 1000 AS VARCHAR) END AS k FROM {statement}))""")
def o2(spark, d):
    s = table(spark, d, "statement").select("row_id", "file_id", F.when(F.col("file_id") % 3 == 0, F.col("memo")).otherwise((F.col("row_id") * 7 % 1000).cast("string")).alias("k"))
    return S.numeric_else_text(s, "file_id", "k", "row_id").select("row_id", "file_id", "place")


@query("o3_latest", "SELECT user_id, event_type, max(ts) AS ts, max_by(event_id, ts) AS event_id FROM events GROUP BY ALL")
def o3(spark, d):
    return S.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", F.col("ts"), "event_id")


@query("o4_search_page", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') ORDER BY p_partkey LIMIT 20 OFFSET 20")
def o4(spark, d):
    return S.search_page(table(spark, d, "part"), "p_name", "ring", "p_partkey", 2, 20).select("p_partkey", "p_name")


@query("j8_first_keyword", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'r' WHEN contains(lower(p_name), 'blue') THEN 'b' WHEN contains(lower(p_name), 'o') THEN 'o' ELSE 'none' END AS bank FROM part")
def j8(spark, d):
    return S.first_keyword(table(spark, d, "part"), "p_name", [("Ring", "r"), ("BLUE", "b"), ("o", "o")], "none").select("p_partkey", "bank")


@query("j9_owning_summary", """SELECT event_id, e.user_id, s.start_id AS owner_start, s.event_type AS owner FROM events e ASOF LEFT JOIN {summaries} s ON e.user_id = s.user_id AND e.event_id >= s.start_id""")
def j9(spark, d):
    out = S.owning_summary(table(spark, d, "events").select("event_id", "user_id"), table(spark, d, "summaries"), "user_id", "event_id", "start_id", "event_type")
    return out.select("event_id", "user_id", "owner_start", "owner")


@query("w3_cut_records", """WITH base AS (SELECT row_id, file_id, CAST(row_id AS VARCHAR) AS serial, bank AS time, memo AS party, CASE WHEN row_id % 2 = 0 THEN '' ELSE money END AS amount, row_id % 11 IN (0, 1, 2) AS is_tail, row_id % 11 IN (1, 2, 3) AS is_head FROM {statement}),
    p AS (SELECT *, is_tail AND coalesce(lead(is_head) OVER w, false) AS pair FROM base WINDOW w AS (PARTITION BY file_id ORDER BY row_id)),
    r AS (SELECT *, sum(CASE WHEN prior THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY row_id) AS run FROM (SELECT *, coalesce(lag(pair) OVER (PARTITION BY file_id ORDER BY row_id), false) AS prior FROM p)),
    o AS (SELECT *, pair AND row_number() OVER (PARTITION BY file_id, run ORDER BY row_id) % 2 = 1 AS joins FROM r),
    n AS (SELECT *, coalesce(lag(joins) OVER w, false) AS eaten, lead(serial) OVER w AS ns, lead(time) OVER w AS nt, lead(party) OVER w AS np, lead(amount) OVER w AS na FROM o WINDOW w AS (PARTITION BY file_id ORDER BY row_id))
    SELECT row_id, CASE WHEN joins THEN coalesce(serial, '') || coalesce(ns, '') ELSE serial END AS serial, CASE WHEN joins THEN trim(coalesce(time, '') || ' ' || coalesce(nt, '')) ELSE time END AS time,
    CASE WHEN joins THEN CASE WHEN contains(coalesce(party, ''), coalesce(np, '')) THEN coalesce(party, '') ELSE coalesce(party, '') || coalesce(np, '') END ELSE party END AS party,
    CASE WHEN joins THEN CASE WHEN coalesce(amount, '') = '' THEN coalesce(na, '') ELSE coalesce(amount, '') END ELSE amount END AS amount, joins AS was_cut FROM n WHERE NOT eaten""")
def w3(spark, d):
    r = F.col("row_id") % 11
    rows = table(spark, d, "statement").select(
        "row_id", "file_id", F.col("row_id").cast("string").alias("serial"), F.col("bank").alias("time"), F.col("memo").alias("party"), F.when(F.col("row_id") % 2 == 0, "").otherwise(F.col("money")).alias("amount"), r.isin(0, 1, 2).alias("is_tail"), r.isin(1, 2, 3).alias("is_head")
    )
    return S.merge_cut_records(rows, "file_id", ["row_id"]).drop("file_id", "is_tail", "is_head")


@query("a17_vote", """SELECT user_id, code, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o DESC, length(code) DESC, code DESC) AS k FROM
    (SELECT user_id, event_type AS code, count(*) AS n, max(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) AS o FROM events GROUP BY ALL)) WHERE k = 1""")
def a17(spark, d):
    return S.vote(table(spark, d, "events").select("user_id", F.col("event_type").alias("code"), "event_id"), "user_id", "code", F.col("event_id") % 9 == 0)


@query("a18_fill_unique", """SELECT event_id, CASE WHEN v <> '' THEN v WHEN mn = mx THEN mn END AS v FROM (SELECT *, min(CASE WHEN v <> '' THEN v END) OVER (PARTITION BY g) AS mn, max(CASE WHEN v <> '' THEN v END) OVER (PARTITION BY g) AS mx FROM
    (SELECT event_id, event_id // 4 AS g, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS v FROM events))""")
def a18(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("event_id div 4").alias("g"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("v"))
    return S.fill_when_unique(e, "g", "v").select("event_id", "v")


@query("a19_merge_partials", """SELECT conv_id, min_by(role, turn) FILTER (WHERE role <> '') AS role, bool_or(turn > 2) AS late, (SELECT t.text FROM conversations t WHERE t.conv_id = c.conv_id ORDER BY length(t.text) DESC, turn LIMIT 1) AS text,
    list_sort(list_distinct(list(role))) AS roles FROM conversations c GROUP BY conv_id""")
def a19(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", (F.col("turn") > 2).alias("late"), F.array("role").alias("roles"))
    return S.merge_partials(c, "conv_id", "turn", ["role"], ["late"], ["text"], ["roles"]).withColumn("roles", F.array_sort("roles"))


@query("d5_distinct_seals", """SELECT c_custkey, code, colour, name FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN coalesce(code, '') <> '' THEN code ELSE 'all:' || coalesce(code, 'null') || '|' || name END, colour ORDER BY c_custkey) AS k
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS code, c_mktsegment AS colour, substr(c_name, -1) AS name FROM customer)) WHERE k = 1""")
def d5(spark, d):
    code = F.when(F.col("c_custkey") % 4 == 0, None).when(F.col("c_custkey") % 10 == 1, "").otherwise(F.col("c_nationkey").cast("string"))
    seals = table(spark, d, "customer").select("c_custkey", code.alias("code"), F.col("c_mktsegment").alias("colour"), F.substring("c_name", -1, 1).alias("name"))
    return S.distinct_seals(seals, "code", "colour", ["code", "colour", "name"], "c_custkey")


@query("d1_keep_first", "SELECT min(event_id) AS event_id, event_type FROM events WHERE event_id % 5 <> 0 GROUP BY event_type UNION ALL SELECT min(event_id), NULL FROM events WHERE event_id % 5 = 0 HAVING count(*) > 0")
def d1(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    return S.keep_first(e, F.col("event_type"), "event_id")


@query("d6_summary_by_range", "SELECT user_id, min(event_id) AS event_id, CAST(min(ts) AS DATE) AS day FROM events GROUP BY user_id, CAST(ts AS DATE)")
def d6(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    return S.keep_first(e, F.concat_ws("|", "user_id", "day"), "event_id")


@query("j31_longest_of_pass", """SELECT a.event_id, CASE WHEN b.l >= length(a.code) THEN b.c ELSE a.code END AS code FROM (SELECT event_id, user_id, event_type AS code FROM events WHERE event_id % 3 = 0) a
    LEFT JOIN (SELECT user_id, max(struct_pack(l := length(event_type), c := event_type)).l AS l, max(struct_pack(l := length(event_type), c := event_type)).c AS c FROM events WHERE event_id % 3 = 1 AND event_type <> 'purchase' GROUP BY user_id) b ON a.user_id = b.user_id""")
def j31(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("code"))
    return S.longest_of_pass(e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1 and code <> 'purchase'").drop("event_id"), "user_id", "code").select("event_id", "code")


@query("c1_money", f"SELECT row_id, CAST({_AMOUNT} AS DOUBLE) AS amount FROM {{statement}}")
def c1(spark, d):
    return table(spark, d, "statement").select("row_id", money.decimal_of(F.col("money")).cast("double").alias("amount"))


@query("c2_invoice_amount", r"SELECT l_orderkey, l_linenumber, l_suppkey, CAST(regexp_extract(regexp_replace('¥ ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' x', '[¥￥,\s]', '', 'g'), '-?[0-9]+(\.[0-9]+)?') AS DOUBLE) AS amount FROM lineitem")
def c2(spark, d):
    text = F.concat(F.lit("¥ "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(" x"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", money.invoice_amount(text).alias("amount"))


@query("c3_ledger_code", "SELECT l_orderkey, l_suppkey, l_linenumber, regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') AS code, CAST(l_quantity AS DOUBLE) AS number FROM lineitem")
def c3(spark, d):
    text = F.col("l_quantity").cast("string")
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", money.ledger_code(text).alias("code"), money.ledger_number(text).alias("number"))


@query("c4_numeric_cell", "SELECT row_id, CASE WHEN row_id % 3 = 0 THEN -CAST(row_id AS DOUBLE) WHEN row_id % 3 = 1 THEN CAST(row_id AS DOUBLE) END AS cell FROM {statement}")
def c4(spark, d):
    k = F.col("row_id").cast("string")
    text = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("("), k, F.lit(")"))).when(F.col("row_id") % 3 == 1, F.concat(k, F.lit(" %"))).otherwise(F.concat(F.lit("x"), k))
    return table(spark, d, "statement").select("row_id", money.numeric_cell(text).alias("cell"))


@query("c6_field_status", """SELECT c.c_custkey, CASE WHEN n.c_custkey IS NULL THEN 'one_side_empty' WHEN lower(regexp_replace(c.c_name, '[¥￥$,，\\s元]', '', 'g')) = lower(regexp_replace(n.c_name, '[¥￥$,，\\s元]', '', 'g')) THEN 'consistent' ELSE 'inconsistent' END AS status
    FROM customer c LEFT JOIN {customer_new} n ON n.c_custkey = c.c_custkey""")
def c6(spark, d):
    new = table(spark, d, "customer_new").select("c_custkey", F.upper("c_name").alias("new"))
    return table(spark, d, "customer").join(new, "c_custkey", "left").select("c_custkey", money.field_status(F.col("c_name"), F.col("new")).alias("status"))


_BANKS = "['shandong_local','everbright','cmb','jining','cgb','psbc','icbc','ccb','abc','boc','bocom','unknown']"


@query("p1_all_templates", f"""SELECT row_id, template, CASE WHEN template IN ('shandong_local', 'everbright', 'jining', 'boc', 'bocom') THEN sequence END AS sequence, CASE WHEN template <> 'icbc' THEN amount END AS balance, CASE WHEN template <> 'boc' THEN memo END AS description FROM
    (SELECT row_id, CASE WHEN row_id % 12 = 11 THEN 'shandong_local' ELSE {_BANKS}[row_id % 12 + 1] END AS template, CASE WHEN trim(seq) <> '' THEN seq END AS sequence, CASE WHEN trim(money) <> '' THEN {_AMOUNT} END AS amount, memo FROM {{statement}})""")
def p1_all(spark, d):
    from tallyweave.plans import templates

    s = table(spark, d, "statement")
    pairs = {"序号": "seq", "账户余额": "money", "余额": "money", "摘要": "memo", "摘要备注": "memo"}
    values = F.create_map(*[c for label, name in pairs.items() for c in (F.lit(label), F.col(name))])
    names = F.array(*[F.lit(n) for n in [*templates.TRANSACTIONS, "unknown"]])
    rows = s.select("row_id", F.get(names, (F.col("row_id") % 12).cast("int")).alias("bank"), values.alias("values"))
    return templates.registry(templates.TRANSACTIONS).project(rows, "bank").select("row_id", "template", "sequence", "balance", "description")


@query("p1_all_summaries", f"SELECT row_id, template, CASE WHEN template = 'bocom' THEN memo END AS bank_branch, CASE WHEN template NOT IN ('shandong_local', 'ccb') THEN seq END AS account_number FROM (SELECT row_id, CASE WHEN row_id % 12 = 11 THEN 'shandong_local' ELSE {_BANKS}[row_id % 12 + 1] END AS template, memo, CASE WHEN trim(seq) <> '' THEN seq END AS seq FROM {{statement}})")
def p1_sums(spark, d):
    from tallyweave.plans import templates

    s = table(spark, d, "statement")
    values = F.create_map(F.lit("账号"), F.col("seq"), F.lit("开户机构"), F.col("memo"))
    names = F.array(*[F.lit(n) for n in [*templates.SUMMARIES, "unknown"]])
    rows = s.select("row_id", F.get(names, (F.col("row_id") % 12).cast("int")).alias("bank"), values.alias("values"))
    return templates.registry(templates.SUMMARIES).project(rows, "bank").select("row_id", "template", "bank_branch", "account_number")
