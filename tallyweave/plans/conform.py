"""Queries over template conformity and exception reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import conform as C, ordered
from tallyweave.plans.fixtures import table
from tallyweave.plans.reconcile import _LINKS, _three
from tallyweave.plans.lines import _SECTIONS
from tallyweave.plans.registry import query

_FOLD = "regexp_replace(translate({x}, '（），。：；', '(),.:;'), '\\s+', '', 'g')"
_EOF = "(SELECT d.doc_id, e.* FROM (SELECT DISTINCT doc_id, source FROM {found}) d JOIN {expected} e ON e.source = d.source)"


def _fold(x: str) -> str:
    return _FOLD.replace("{x}", x)


_SEC = f"""(SELECT doc_id, kind, CASE WHEN kind = 'missing' THEN 'high' ELSE 'medium' END AS severity, CAST(pos AS VARCHAR) AS item FROM (SELECT coalesce(e.doc_id, f.doc_id) AS doc_id, coalesce(e.pos, f.pos) AS pos,
    CASE WHEN f.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'extra' WHEN {_fold('e.name')} <> {_fold('f.name')} THEN 'name' END AS kind FROM {_EOF} e FULL JOIN {{found}} f ON f.doc_id = e.doc_id AND f.pos = e.pos) WHERE kind IS NOT NULL)"""


def _heads(t: str) -> str:
    return f"(SELECT DISTINCT doc_id, pos, {_fold('h')} AS header FROM (SELECT doc_id, pos, unnest(string_split(headers, ',')) AS h FROM {t}) WHERE {_fold('h')} <> '')"


_HEAD = f"""(SELECT e.doc_id, 'header_missing' AS kind, 'high' AS severity, CAST(e.pos AS VARCHAR) || ':' || e.header AS item FROM {_heads(_EOF)} e WHERE EXISTS (SELECT 1 FROM {{found}} f WHERE f.doc_id = e.doc_id AND f.pos = e.pos)
    AND NOT EXISTS (SELECT 1 FROM {_heads('{found}')} f WHERE f.doc_id = e.doc_id AND f.pos = e.pos AND f.header = e.header)
    UNION ALL SELECT f.doc_id, 'header_extra', 'low', CAST(f.pos AS VARCHAR) || ':' || f.header FROM {_heads('{found}')} f WHERE NOT EXISTS (SELECT 1 FROM {_heads(_EOF)} e WHERE f.doc_id = e.doc_id AND f.pos = e.pos AND f.header = e.header))"""
_DESC = f"""(SELECT doc_id, kind, CASE kind WHEN 'description_missing' THEN 'high' WHEN 'description_extra' THEN 'low' ELSE 'medium' END AS severity, CAST(pos AS VARCHAR) AS item FROM (SELECT e.doc_id, e.pos, CASE WHEN {_fold('e.description')} <> '' AND {_fold('f.description')} = '' THEN 'description_missing'
    WHEN {_fold('e.description')} = '' AND {_fold('f.description')} <> '' THEN 'description_extra' WHEN {_fold('e.description')} <> {_fold('f.description')} THEN 'description_differs' END AS kind FROM {_EOF} e JOIN {{found}} f ON f.doc_id = e.doc_id AND f.pos = e.pos) WHERE kind IS NOT NULL)"""


def _ef(spark, d):
    return table(spark, d, "expected"), table(spark, d, "found")


@query("j10_sections", f"SELECT * FROM {_SEC}")
def j10(spark, d):
    return C.compare_sections(*_ef(spark, d))


@query("j11_headers", f"SELECT * FROM {_HEAD}")
def j11(spark, d):
    return C.compare_headers(*_ef(spark, d))


@query("j13_descriptions", f"SELECT * FROM {_DESC}")
def j13(spark, d):
    return C.compare_descriptions(*_ef(spark, d))


@query("j14_repaired_headers", """SELECT f.doc_id, f.pos, CASE WHEN len(string_split(f.headers, ',')) = len(string_split(e.headers, ',')) THEN array_to_string(list_transform(generate_series(1, len(string_split(f.headers, ','))), lambda i: CASE WHEN string_split(f.headers, ',')[i] <> '' AND
    suffix(string_split(e.headers, ',')[i], string_split(f.headers, ',')[i]) THEN string_split(e.headers, ',')[i] ELSE string_split(f.headers, ',')[i] END), ',') ELSE f.headers END AS headers FROM {found} f LEFT JOIN {expected} e ON e.source = f.source AND e.pos = f.pos""")
def j14(spark, d):
    return C.repair_headers(*_ef(spark, d)).select("doc_id", "pos", "headers")


@query("f8_copied_headers", f"SELECT f.doc_id, f.pos, CASE WHEN f.pos <> 4 AND coalesce({_fold('f.headers')} = {_fold('a.headers')}, false) THEN '' ELSE f.headers END AS headers FROM {{found}} f LEFT JOIN {{found}} a ON a.doc_id = f.doc_id AND a.pos = 4")
def f8(spark, d):
    return C.drop_copied(table(spark, d, "found"), 4).select("doc_id", "pos", "headers")


@query("f8_other_cleared", """SELECT doc_id, pos, CASE WHEN regexp_matches(trim(name), '[0-9]+\\.?\\s*其他$') THEN '' ELSE headers END AS headers, CASE WHEN regexp_matches(trim(name), '[0-9]+\\.?\\s*其他$') THEN '' ELSE description END AS description FROM {found_other}""")
def f8_other(spark, d):
    return C.clear_other(table(spark, d, "found_other")).select("doc_id", "pos", "headers", "description")


_SUB_E = _EOF.replace("{found}", "{found_subs}").replace("{expected}", "{expected_subs}")
_SUB = f"""(WITH e AS (SELECT * FROM {_SUB_E}), s AS (SELECT e.doc_id, e.pos FROM e JOIN {{found_subs}} f ON f.doc_id = e.doc_id AND f.pos = e.pos WHERE e.sub IS NULL AND f.sub IS NULL),
    x AS (SELECT e.* FROM e JOIN s USING (doc_id, pos) WHERE e.sub IS NOT NULL), y AS (SELECT f.* FROM {{found_subs}} f JOIN s USING (doc_id, pos) WHERE f.sub IS NOT NULL)
    SELECT doc_id, kind, CASE WHEN kind = 'sub_missing' THEN 'high' ELSE 'medium' END AS severity, item FROM (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, CAST(coalesce(x.pos, y.pos) AS VARCHAR) || '.' || CAST(coalesce(x.sub, y.sub) AS VARCHAR) AS item,
    CASE WHEN y.name IS NULL THEN 'sub_missing' WHEN x.name IS NULL THEN 'sub_extra' WHEN {_fold('x.name')} <> {_fold('y.name')} THEN 'sub_name' END AS kind FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.pos = y.pos AND x.sub = y.sub) WHERE kind IS NOT NULL)"""


def _sub_heads(t: str) -> str:
    return f"(SELECT DISTINCT doc_id, pos, sub, {_fold('h')} AS header FROM (SELECT doc_id, pos, sub, unnest(string_split(headers, ',')) AS h FROM {t} WHERE sub IS NOT NULL) WHERE {_fold('h')} <> '')"


_SUB_HEAD = f"""(WITH e AS (SELECT * FROM {_SUB_E} WHERE sub IS NOT NULL), f AS (SELECT f.* FROM {{found_subs}} f JOIN e ON e.doc_id = f.doc_id AND e.pos = f.pos AND e.sub = f.sub), g AS (SELECT e.* FROM e JOIN f ON e.doc_id = f.doc_id AND e.pos = f.pos AND e.sub = f.sub),
    want AS {_sub_heads('g')}, got AS {_sub_heads('f')}
    SELECT doc_id, 'sub_header_missing' AS kind, 'high' AS severity, CAST(pos AS VARCHAR) || '.' || CAST(sub AS VARCHAR) || ':' || header AS item FROM want ANTI JOIN got USING (doc_id, pos, sub, header)
    UNION ALL SELECT doc_id, 'sub_header_extra', 'low', CAST(pos AS VARCHAR) || '.' || CAST(sub AS VARCHAR) || ':' || header FROM got ANTI JOIN want USING (doc_id, pos, sub, header))"""


@query("j12_subsections", f"SELECT * FROM {_SUB}")
def j12(spark, d):
    return C.compare_subsections(table(spark, d, "expected_subs"), table(spark, d, "found_subs"))


@query("j11_subsection_headers", f"SELECT * FROM {_SUB_HEAD}")
def j11_subs(spark, d):
    return C.compare_headers(table(spark, d, "expected_subs"), table(spark, d, "found_subs"), ["pos", "sub"])


_ALL = f"(SELECT * FROM {_SEC} UNION ALL SELECT * FROM {_HEAD} UNION ALL SELECT * FROM {_DESC})"


@query("a28_verdict", f"SELECT d.doc_id, count(m.kind) FILTER (WHERE severity = 'high') AS high, count(m.kind) FILTER (WHERE severity = 'medium') AS medium, count(m.kind) FILTER (WHERE severity = 'low') AS low, count(m.kind) = 0 AS passed FROM documents d LEFT JOIN {_ALL} m ON m.doc_id = d.doc_id GROUP BY d.doc_id")
def a28(spark, d):
    e, f = _ef(spark, d)
    found = C.compare_sections(e, f).unionByName(C.compare_headers(e, f)).unionByName(C.compare_descriptions(e, f))
    return C.verdict(table(spark, d, "documents"), found)


@query("a20_best_template", """SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'unknown' WHEN a >= b THEN 'english' ELSE 'german' END AS template, CAST(greatest(a, b) AS INTEGER) AS score, CASE WHEN greatest(a, b) = 0 THEN '' WHEN a >= b THEN array_to_string(list_filter(['the', 'zebra', ' and '], lambda w: NOT contains(text, w)), ',') ELSE array_to_string(list_filter(['ö', 'keit'], lambda w: NOT contains(text, w)), ',') END AS missing
    FROM (SELECT *, CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'zebra') AS INT) + CAST(contains(text, ' and ') AS INT) AS a, CAST(contains(text, 'ö') AS INT) + CAST(contains(text, 'keit') AS INT) AS b FROM documents)""")
def a20(spark, d):
    return C.best_template(table(spark, d, "documents"), {"english": ["the", "zebra", " and "], "german": ["ö", "keit"]})


_SHOWN = "(SELECT *, CASE WHEN type_id IN (4, 12, 16) THEN 12 ELSE type_id END AS shown_type FROM {exceptions} WHERE type_id NOT IN (6, 11))"


@query("f7_presented", f"SELECT rec_id, type_id, CAST(shown_type AS INTEGER) AS shown_type FROM {_SHOWN}")
def f7(spark, d):
    return C.presented(table(spark, d, "exceptions")).select("rec_id", "type_id", "shown_type")


@query("a9_histogram", "SELECT 't' || CAST(type_id AS VARCHAR) AS name, count(*) AS n FROM {exceptions} GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM {exceptions}")
def a9(spark, d):
    return C.histogram(table(spark, d, "exceptions"), F.concat(F.lit("t"), F.col("type_id").cast("string")))


_NAMES = "(SELECT rec_id, string_agg(CAST(type_id AS VARCHAR), ' | ' ORDER BY type_id) AS names FROM (SELECT DISTINCT rec_id, type_id FROM {exceptions}) GROUP BY rec_id)"


@query("a10_joined_names", f"SELECT * FROM {_NAMES}")
def a10(spark, d):
    return C.joined_names(table(spark, d, "exceptions"), F.col("type_id").cast("string"))


@query("a11_format_reasons", "SELECT rec_id, string_agg(reason, ',' ORDER BY t) AS reasons FROM (SELECT rec_id, CASE type_id WHEN 4 THEN 'unit' WHEN 12 THEN 'format' ELSE 'marks' END AS reason, min(type_id) AS t FROM {exceptions} WHERE type_id IN (4, 12, 16) GROUP BY ALL) GROUP BY rec_id")
def a11(spark, d):
    reason = F.when(F.col("type_id") == 4, "unit").when(F.col("type_id") == 12, "format").otherwise("marks")
    out = C.joined_names(table(spark, d, "exceptions").where(F.col("type_id").isin(4, 12, 16)), reason)
    return out.select("rec_id", F.regexp_replace("names", " \\| ", ",").alias("reasons"))


@query("j5_flagged_links", f"SELECT k.rec_id, k.ledger_id, n.names, n.names IS NOT NULL AS has_exception FROM {_LINKS} k LEFT JOIN {_NAMES} n ON n.rec_id = k.rec_id")
def j5(spark, d):
    return C.flagged(_three(spark, d)[0], table(spark, d, "exceptions")).select("rec_id", "ledger_id", "names", "has_exception")


@query("a12_anchors", f"SELECT ledger_id, count(*) AS n, bool_or(rec_id IN (SELECT rec_id FROM {{exceptions}})) AS flagged, min(rec_id) AS first_rec FROM {_LINKS} WHERE ledger_id IS NOT NULL GROUP BY ledger_id")
def a12(spark, d):
    return C.anchors(_three(spark, d)[0], table(spark, d, "exceptions"))


@query("a13_grouped", "SELECT CAST(t.n AS INTEGER) AS type_id, e.batch_id, coalesce(e.items, []) AS items FROM (SELECT n_nationkey AS n FROM nation) t LEFT JOIN (SELECT batch_id, type_id, list_sort(list_distinct(list(rec_id))) AS items FROM {exceptions} GROUP BY ALL) e ON e.type_id = t.n")
def a13(spark, d):
    return C.grouped(table(spark, d, "exceptions"), table(spark, d, "nation").select(F.col("n_nationkey").alias("type_id")))


@query("a13_grouped_rows", """SELECT CAST(t.n AS INTEGER) AS type_id, e.batch_id, e.sheet, e.code, e.rec_id, CAST(place AS INTEGER) AS place FROM (SELECT n_nationkey AS n FROM nation) t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY type_id, batch_id ORDER BY sheet, code, rec_id) AS place
    FROM (SELECT DISTINCT type_id, batch_id, sheet, value AS code, rec_id FROM {exceptions})) e ON e.type_id = t.n""")
def a13_rows(spark, d):
    return C.grouped_rows(table(spark, d, "exceptions").withColumnRenamed("value", "code"), table(spark, d, "nation").select(F.col("n_nationkey").alias("type_id")))


@query("a14_company_report", """SELECT batch_id, company, count(*) AS entry_count, string_agg(sheet || ':' || CAST(rec_id AS VARCHAR) || ':' || CAST(type_id AS VARCHAR), ',' ORDER BY sheet, rec_id, type_id) AS entries FROM (SELECT DISTINCT batch_id, company, type_id, rec_id, sheet FROM {exceptions}) GROUP BY ALL""")
def a14(spark, d):
    return C.company_report(table(spark, d, "exceptions"))


@query("a14_report_rows", """SELECT *, CAST(row_number() OVER (PARTITION BY batch_id, company ORDER BY sheet, rec_id, type_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY batch_id, company) AS entry_count FROM (SELECT DISTINCT batch_id, company, type_id, rec_id, sheet FROM {exceptions})""")
def a14_rows(spark, d):
    return C.company_report_rows(table(spark, d, "exceptions"))


@query("d12_company_merge", "SELECT type_id, rec_id, sheet, company, string_agg(DISTINCT value, '|' ORDER BY value) AS numbers FROM {exceptions} GROUP BY ALL")
def d12(spark, d):
    return table(spark, d, "exceptions").groupBy("type_id", "rec_id", "sheet", "company").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("numbers"))


@query("a15_distinct_joins", "SELECT batch_id, string_agg(CAST(n AS VARCHAR), ' | ' ORDER BY n) AS numbers FROM (SELECT DISTINCT batch_id, rec_id % 13 AS n FROM {exceptions} WHERE rec_id % 13 > 0) GROUP BY batch_id")
def a15(spark, d):
    return C.distinct_joins(table(spark, d, "exceptions").withColumn("n", F.col("rec_id") % 13), "batch_id", "n")


@query("a16_candidates", f"SELECT rec_id, ledger_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY ledger_id) AS INTEGER) AS candidate FROM {_LINKS} WHERE n_matches > 1")
def a16(spark, d):
    return C.candidates(_three(spark, d)[0]).select("rec_id", "ledger_id", "candidate")


@query("c55_outline", f"SELECT doc_id, string_agg(repeat('  ', level - 1) || repeat('#', level) || ' ' || substr(title, 1, 80), chr(10) ORDER BY line_no) AS outline FROM {_SECTIONS} GROUP BY doc_id")
def c55(spark, d):
    return C.outline(ordered.sections(ordered.headings(table(spark, d, "doc_lines"))))


@query("a26_extraction_quality", """SELECT count(CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN 1 END) / count(g.doc_id) AS recall, count(CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN 1 END) / count(p.doc_id) AS precision, count(p.doc_id) - count(g.doc_id) AS count_delta,
    round(avg(CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN CAST(p.quality IS NOT DISTINCT FROM g.quality AS INT) END), 6) AS accuracy_quality, round(avg(CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN CAST(p.quality IS NULL AS INT) END), 6) AS missing_quality,
    round(avg(CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN CAST(p.toxic IS NOT DISTINCT FROM g.toxic AS INT) END), 6) AS accuracy_toxic, round(avg(CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN CAST(p.toxic IS NULL AS INT) END), 6) AS missing_toxic
    FROM {predictions} p FULL JOIN labels g ON p.doc_id = g.doc_id""")
def a26(spark, d):
    return C.extraction_quality(table(spark, d, "predictions"), table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
