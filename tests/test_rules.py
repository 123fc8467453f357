"""Small cases of rules that the stored tables do not meet."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import letters, narrative, text
from tallyweave.operators import ordered, statement, sync, versions
from tallyweave.plans import catalog, templates
from tallyweave.sources import files
from tallyweave.streaming import intake

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("line, kind", [("第一节 总则", "H1"), ("一、范围", "H2"), ("1.2 Scope", "H3"), ("3. Item", "H4"), ("目 录", "TOCTitle"), ("附录 A", "GlossaryTitle"), ("", "BLANK"), ("1. Pay 100元", "NORMAL"), ("plain words", "NORMAL"), ("1. one; two", "NORMAL")])
def test_line_class(spark, line, kind):
    assert one(spark, text.line_class(F.col("t")), t=line) == kind


def test_style_and_outline_beat_the_pattern(spark):
    assert one(spark, text.line_class(F.col("t"), F.lit("Heading 2"), F.lit(0)), t="text") == "H2"
    assert one(spark, text.line_class(F.col("t"), None, F.lit(2)), t="text") == "H3"


@pytest.mark.parametrize("word, value", [("十", 10), ("十二", 12), ("九十九", 99), ("一百零三", 103), ("七", 7), ("x", None), ("", None)])
def test_numerals(spark, word, value):
    assert one(spark, text.numeral(F.col("t")), t=word) == value


@pytest.mark.parametrize("digits, passes", [("4111111111111111", True), ("4111111111111112", False), ("0", False), ("18", True)])
def test_check_digit(spark, digits, passes):
    assert one(spark, letters.check_digit(F.col("t")), t=digits) is passes


def test_repaired_digits_pass(spark):
    fixed = one(spark, letters.repair_digits(F.col("t")), t="411111111111111")
    assert fixed is None or (len(fixed) == 16 and one(spark, letters.check_digit(F.col("t")), t=fixed))


def test_wrapped_rows(spark):
    rows = [["a", "b", "c"], ["", "d", ""], ["e", "f", "g"], ["h", "i", ""]]
    out = versions.merge_wrapped(spark.createDataFrame([(1, rows)], "id int, rows array<array<string>>")).first().rows
    assert out == [["a", "bd", "c"], ["eh", "fi", "g"]]


def test_file_check(spark):
    table = spark.createDataFrame([("a.PDF", b"%PDF-1.7"), ("b.docx", b"%PDF"), ("c.pdf", b"PK"), ("d.pdf", b"")], "path string, content binary")
    assert {r.path: (r.ok, r.reason) for r in files.check_pdf(table).collect()} == {"a.PDF": (True, ""), "b.docx": (False, "extension"), "c.pdf": (False, "header"), "d.pdf": (False, "empty")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (None, 30, "c")], "summary_id int, v int, t string")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    files.split_by_summary(rows.where("summary_id = 1").select("summary_id"), rows.where("v <> 20"), str(tmp_path / "split"))
    assert {r.v for r in spark.read.parquet(str(tmp_path / "split")).collect()} == {10, 30}
    for v in (1, 2):
        files.append_log(spark.createDataFrame([(v,)], "v int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    path = str(tmp_path / "batches")
    files.replace_batches(spark.createDataFrame([(1, 1), (2, 2)], "batch_id int, v int"), path)
    files.replace_batches(spark.createDataFrame([(2, 5)], "batch_id int, v int"), path)
    assert {(r.batch_id, r.v) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 5)}
    files.export(rows.limit(1), rows, str(tmp_path / "export"), ["t", "v"])
    assert spark.read.option("header", True).csv(str(tmp_path / "export" / "detail")).columns == ["t", "v"]


def test_page_files(spark, tmp_path):
    (tmp_path / "page_3.txt").write_text('[{"a": "1"}, {"a": null}]')
    (tmp_path / "p2.txt").write_text('{"a": "x"}')
    (tmp_path / "page_9.txt").write_text('{"a": ')
    good, bad = files.records(files.read_pages(spark, str(tmp_path)))
    assert sorted((r.page, r.pos, r.record["a"] or "") for r in good.collect()) == [(1, 0, "x"), (3, 0, "1"), (3, 1, "")]
    assert [r.page for r in bad.collect()] == [9]


def test_registry():
    made = statement.Registry("a")
    made.add("a", statement.Mapping({}))
    with pytest.raises(ValueError):
        made.add("a", statement.Mapping({}))


def test_streams(spark, tmp_path):
    from tallyweave.streaming import intake

    pages = spark.createDataFrame([(1, '{"a": "1"}'), (2, '{"a": ')], "id int, payload string")
    pages.write.parquet(str(tmp_path / "in"))
    query = intake.page_intake(spark, str(tmp_path / "in"), pages.schema, "payload", str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert [r.record["a"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]
    assert spark.read.parquet(str(tmp_path / "out_bad")).count() == 1

    target = spark.createDataFrame([(1, "x", True), (2, "y", True)], "k int, name string, active boolean")
    source = spark.createDataFrame([(1, "z", 2), (1, "old", 1)], "k int, name string, v int")
    for k in (1, 2):  # two files, each lacking what the other has
        source.where(F.col("v") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    kept = []

    def poll():
        intake.sync_intake(spark, str(tmp_path / "src"), source.schema, "k", ["name"], lambda: target, lambda df: kept.append(df.collect()), str(tmp_path / "poll"), "v")

    poll()
    poll()  # again: nothing new, the same result
    assert [sorted((r.k, r.name, r.active) for r in x) for x in kept] == [[(1, "z", True), (2, "y", False)]] * 2


def test_configured_template(spark):
    from tallyweave.plans import catalog, templates

    made = statement.Registry("x")
    made.add("x", templates.from_config({"fields": {"金额": {"field": "amount", "type": "amount"}, "日期": {"field": "day", "type": "datetime"}}}))
    rows = spark.createDataFrame([(1, "x", {"金额": "1,2.5", "日期": " "})], "row_id int, bank string, values map<string,string>")
    out = made.project(rows, "bank").first()
    assert (out.template, out.amount, out.day) == ("x", "12.50", None)
    assert set(templates.TRANSACTIONS) == set(templates.SUMMARIES) and len(templates.TRANSACTIONS) == 11


def test_letter_record_of_nothing_is_empty(spark):
    row = spark.range(1).select(*letters.letter_record({}, F.lit(None).cast("string"))).first()
    assert list(row.asDict()) == letters.LETTER_FIELDS and set(row) == {""}


def test_letter_record_takes_the_text_first(spark):
    told_text = "致：甲银行（以下简称）。本公司聘请的乙丙会计师事务所上海分所正在审计。从本公司 NRA81 2011号支取。回函收件人：张三 联系电话：(852) 9862/电邮：x。经办人 李四 FS 2024-04-01 预留签章 2024年4月2日"
    told = {"seal_date": F.lit("2024年4月1日"), "signature_name": F.lit("丙公司"), "recipient_bank": F.lit("丁银行"), "accounting_firm": F.lit(None).cast("string"), "cutoff_date": F.lit("2024-04-07")}
    r = spark.range(1).select(*letters.letter_record(told, F.lit(told_text))).first()
    assert (r.recipient_bank, r.accounting_firm, r.debit_account, r.contact_person, r.phone) == ("甲银行", "乙丙会计师事务所上海分所", "812011", "张三", "(852) 9862")
    assert (r.seal_date, r.cutoff_date, r.signature_name) == ("2024-04-02", "2024-04-01", "")


def test_bold_titles(spark):
    rows = [("总则", True, True, "H1"), ("总则", True, False, "NORMAL"), ("总则。", True, True, "NORMAL"), ("二〇二四年", True, True, "NORMAL"), ("（注）", True, True, "NORMAL"), ("长" * 41, True, True, "NORMAL"), ("总则", None, True, "NORMAL"), ("一、", True, True, "H1"), (None, True, True, "NORMAL"), (" ", True, True, "BLANK")]
    df = spark.createDataFrame(rows, "t string, bold boolean, blank boolean, want string")
    got = df.select("want", text.line_class(F.col("t"), bold=F.col("bold"), after_blank=F.col("blank")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_main_forms(spark):
    rows = [("本期增加3亿元", "", False, False), ("本期增加约3亿元", "约", False, False), ("本期3元", "缺少增加/减少", False, False), ("本期-3元", "-", False, False), ("有增加", "非标准增减主句", True, False), ("无", "非标准主句", False, False), ("本年增加3元", "本年", True, False), ("本年为3元", "本年", False, True), ("本期减少3元左右", "左右", False, False), ("本期增加3元，另5元", "另5元", False, True), ("", "", False, False), (None, "", False, False)]
    df = spark.createDataFrame(rows, "t string, form string, blocks boolean, bare boolean")
    t = F.col("t")
    got = [tuple(r) for r in df.select("t", narrative.main_form(t), narrative.main_blocks(t), narrative.bare_amounts(t)).collect()]
    assert got == rows


def test_ledger_records_need_all_headers(spark):
    head = [(1, 1, "人民币"), (2, 1, "指标代码"), (2, 2, "指标名称"), (2, 3, "本期"), (4, 3, "人民币"), (5, 3, "上期余额"), (5, 4, " ")]
    body = [(6, 1, "7.0"), (6, 2, "1. 货款"), (6, 3, "1,200.5"), (7, 1, ""), (7, 2, "x"), (8, 1, "9"), (8, 2, None), (9, 1, "8"), (9, 2, "y"), (9, 3, "n/a")]
    cells = [("f", "s", *x) for x in head + body] + [("f", "short", *x) for x in head if x[0] < 5]
    got = files.ledger_records(spark.createDataFrame(cells, "file string, sheet string, row_no int, col_no int, value string")).orderBy("row_no").collect()
    assert [(r.sheet, r.code, r.name, r.pre_rmb_balance, r.cur_rmb_balance) for r in got] == [("s", "7", "1. 货款", 1200.5, None), ("s", "8", "y", None, None)]
    assert files.ledger_records(spark.createDataFrame([], "file string, sheet string, row_no int, col_no int, value string")).count() == 0


def test_table_in_lines(spark):
    cells = [(1, k, t) for k, t in enumerate(["a", "b", "", "c", "end"])] + [(2, 0, "only")] + [(3, 0, "p"), (3, 1, "q")]
    lines = [(1, k, t) for k, t in enumerate(["a", "b", "x", "a", " ", "b", "c", "end"])] + [(2, 5, "only")] + [(3, 1, "p"), (3, 2, "z")]
    got = versions.table_in_lines(spark.createDataFrame(cells, "doc_id int, row_no int, text string"), spark.createDataFrame(lines, "doc_id int, line_no int, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 3, 7), (2, 5, 1, 5)]


def test_visible_items(spark):
    users, items = spark.createDataFrame([(1,), (2,), (2,)], "user int"), spark.createDataFrame([(7, True, True), (8, False, True), (9, None, True), (6, True, False)], "item int, public boolean, active boolean")
    grants = spark.createDataFrame([(1, 8), (1, 8), (1, 6), (1, 7), (5, 9)], "user int, item int")
    seen = lambda open_: sorted(map(tuple, sync.visible_items(users, items, grants, open_).collect()))
    assert seen(True) == [(1, 7), (1, 8), (2, 7), (2, 8), (2, 9)]
    assert seen(False) == [(1, 7), (1, 8), (2, 7)]


def test_configured_template(spark, tmp_path):
    config = {"template_id": "x1", "detection": {"keywords": ["First.Bank", "FB"]}, "summary_schema": {"账号": {"field": "account_number", "pattern": "账\\s*号[：:]\\s*(\\d+)"}, "户名": {"field": "account_name", "pattern": "户\\s*名[：:]\\s*(.+?)$"}}, "transaction_schema": [{"日期": {"field": "day", "type": "datetime"}}, {"金额": {"field": "amount", "type": "amount"}}, {"摘要": {"field": "note", "type": "string"}}]}
    (tmp_path / "b.json").write_text(json.dumps(config))
    (tmp_path / "a.json").write_text(json.dumps({**config, "template_id": "x0", "detection": {"keywords": ["Zeroth"]}}))
    configs = templates.read_configs(spark, str(tmp_path))
    assert [c["template_id"] for c in configs] == ["x0", "x1"]
    rows = spark.createDataFrame([("from FIRST.BANK", {"日期": "2024年3月5日", "金额": "1,234.5", "摘要": "x"}), ("FirstxBank", {"日期": "20240230", "金额": " ", "摘要": " "}), ("zeroth fb", {"日期": "2024-03-05 7:08"})], "head string, values map<string,string>")
    told = templates.configured(configs, "x1").project(rows.select("head", templates.recognised(F.col("head"), configs).alias("bank"), "values"), "bank")
    assert [(r.bank, r.template, r.day, r.amount, r.note) for r in told.collect()] == [("x1", "x1", "2024-03-05 00:00:00", "1234.50", "x"), (None, "x1", None, None, None), ("x0", "x0", None, None, None)]
    text = spark.range(1).select(F.lit("第一行\n户 名：某公司\n账号: 123\n").alias("t"))
    assert text.select(*[c.alias(n) for n, c in templates.summary_of(F.col("t"), config).items()]).first().asDict() == {"account_number": "123", "account_name": "某公司"}


def test_folding_table(spark):
    pairs = spark.createDataFrame([("節", "节"), ("國", "国"), ("國", "囯"), ("ab", "c"), ("x", "")], "from string, to string")
    assert text.folding(pairs) == ("國節", "囯节") or text.folding(pairs) == ("國節", "国节")
    assert one(spark, text.comparison_key(F.col("t"), *text.folding(pairs)), t="第一 節，x") == "第一节,x"


def test_tables_of_unknown_columns(spark):
    a = [(1, 1, {"Name": "A", "Qty": "1,000"}), (1, 2, {"Name": "a", "Qty": "1000"}), (1, 3, {"Name": " ", "Qty": None}), (2, 1, {"X": "1"}), (3, 1, {"X": "1"})]
    b = [(1, 9, {"Name": "A", "Qty": "1000.00", "Other": "z"}), (1, 8, {"Name": "A", "Qty": "2"}), (2, 1, {"Y": "1"})]
    frame = lambda rows: spark.createDataFrame(rows, "table_id int, row_id int, cells map<string,string>")
    got = {tuple(r) for r in versions.pair_tables(frame(a), frame(b)).collect()}
    assert got == {(1, 1, 9, "paired"), (1, 2, None, "only_in_a"), (1, None, 8, "only_in_b"), (2, 1, None, "only_in_a"), (2, None, 1, "only_in_b"), (3, 1, None, "only_in_a")}


def test_half_a_batch_is_not_read(spark, tmp_path, monkeypatch):
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = spark.createDataFrame([(1, '{"k": "a"}'), (2, '{"k": "b"'), (3, '{"k": "c"}')], "event_id bigint, payload string")
    rows.write.parquet(source)
    whole, calls = intake.files.records, []

    def stops(batch, payload):
        good, bad = whole(batch, payload)
        calls.append(1)
        return (good, bad) if len(calls) > 1 else (good, bad.select(F.raise_error(F.lit("stopped between the writes")).alias("x")))

    monkeypatch.setattr(intake.files, "records", stops)
    with pytest.raises(Exception):
        intake.page_intake(spark, source, rows.schema, "payload", out, at).awaitTermination()
    assert spark.read.parquet(out).count() == 2 and not (tmp_path / "out_done").exists()
    intake.page_intake(spark, source, rows.schema, "payload", out, at).awaitTermination()
    assert sorted(r.event_id for r in intake.committed(spark, out).collect()) == [1, 3]
    assert [r.event_id for r in intake.committed(spark, out, bad=True).collect()] == [2]
    assert intake.page_intake(spark, source, rows.schema, "payload", out, at).awaitTermination() is None
    assert intake.committed(spark, out).count() == 2


@pytest.mark.parametrize("sentence, tokens", [("本期增加3万元", []), ("“A”本月约增加了 3万元", ["本月", "约", "了"]), ("本期余额为3万元", ["余额", "为"]), ("增加约3万元", ["约"]), ("（2）余额", ["额"]), ("本期增加9", ["本期增加9"]), (" ", []), (None, [])])
def test_words_that_are_off_about_a_main_sentence(spark, sentence, tokens):
    frame = spark.createDataFrame([(sentence,)], "t string")
    assert frame.select(narrative.main_tokens(F.col("t")).alias("x")).first().x == tokens


@pytest.mark.parametrize("given, source, name", [("董静", "普华永道 FOR IDENTIFICATION", "静"), ("董静", "某事务所", "董静"), ("谨静 电话 1", "谨", "静"), ("谨静. 电话 1", "谨", "谨静"), ("李四", "普华", "李四")])
def test_misread_contact(spark, given, source, name):
    record = letters.letter_record({"contact_person": F.lit(given)}, F.lit(source))
    assert spark.range(1).select(*[c.alias(n) for c, n in zip(record, letters.LETTER_FIELDS)]).first().contact_person == name


def test_strips_on_both_sides_of_tables(spark):
    kinds = [(0, "ab", False), (1, "cd", False), (2, "T", True), (3, " ", False), (4, "efg", False), (5, "h", False), (6, "T", True), (7, "T", True), (8, "i", False)]
    frame = spark.createDataFrame([(1, n, t, k) for n, t, k in kinds], "doc_id bigint, line_no bigint, text string, is_table boolean")
    got = {tuple(r)[1:] for r in ordered.table_strips(frame, 2).collect()}
    assert got == {(2, "before", 0), (2, "before", 1), (2, "after", 4), (6, "before", 4), (7, "after", 8)}


def test_each_part_of_a_letter_is_worked_out_once(spark):
    """A field's expression grows with its patterns and not with their product."""
    told = {f: F.col(f) for f in letters.LETTER_FIELDS}
    longest = max(str(c._jc.toString()).count("regexp_") for c in letters.letter_record(told, F.col("text")))
    assert longest <= 60
    assert str(narrative.main_tokens(F.col("text"))._jc.toString()).count("regexp_") <= 20
    rows = [("本期又增加约 5万元",), ("“A”余额5元",), ("增加9元",), ("本年",), (" ",), (None,), ("本期增加5万元",), ("x9",)]
    got = spark.createDataFrame(rows, "text string").select(narrative.main_tokens(F.col("text")).alias("t")).collect()
    assert [r.t for r in got] == [["又", "约"], ["额"], ["增加9元"], ["本年"], [], [], [], ["x"]]


def every_form(text):
    """What a date or time is if each form is tried on each text."""
    bare = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.date_format(F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in templates.DATE_FORMS]), "yyyy-MM-dd HH:mm:ss")


def test_dates_are_what_trying_every_form_gives(spark):
    days = ["2024-02-29", "2023-02-29", "2024/2/9", "2024/12/31", "2024年1月5日", "20240105", "20241399", "0001-01-01", "12024-01-01", "1202401-5"]
    texts = [*days, *[f"{d} {t}" for d in days for t in ("10:00:00", "1:00:00", "10:00", "24:00", "10", "10:00:00.5", "100000")]]
    texts += [s + t for s in ("+", "-", "+-", " ", "\t", " ", "x") for t in texts] + [t.replace(" ", "  \t") + "\n" for t in texts] + [t + " " for t in texts]
    texts += ["+12024-01-01", "+120240105", "-20240105", "20240105101112", "+120240105101112", "2024010510111", "2024-1-05", "2024/+2/9", "2024/-2/9", "2024/2-9", "２０２４-01-01", "n/a", "", " ", "-", "/", "//", "年月日", "::", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", templates.date_time(F.col("t")).alias("got"), every_form(F.col("t")).alias("wanted")).collect()
    assert [r for r in rows if r.got != r.wanted] == []
    assert {r.got for r in rows} >= {None, "2024-02-29 00:00:00", "2024-02-09 10:00:00", "2024-01-05 00:00:00", "2024-01-05 10:11:12", "+12024-01-01 00:00:00"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the stored tables")
def test_keywords_are_looked_for_in_heads_and_not_in_rows(spark):
    made = catalog.QUERIES["u2_configured_templates"](spark, DATA)
    steps = made._jdf.queryExecution().optimizedPlan().toString().split("Project [")
    assert any("RLIKE" in step for step in steps)
    assert not any("RLIKE" in step and "o_orderkey" in step for step in steps)
