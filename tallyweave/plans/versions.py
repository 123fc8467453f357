"""Queries over two versions of documents and tables (survey 3.3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions import text as X
from tallyweave.operators import ordered, versions as V
from tallyweave.plans.fixtures import table
from tallyweave.plans.lines import _KEY, _SECTIONS
from tallyweave.plans.registry import ORACLE_SQL, query

_STRIP = "regexp_replace({x}, '\\s+', '', 'g')"


def _occ(t: str, key: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no) AS nth FROM (SELECT *, {key} AS key FROM {t}))"


_DIFF = f"""(SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.line_no IS NULL THEN 1 WHEN b.line_no IS NULL THEN -1 ELSE 0 END AS op, a.line_no AS a_line, b.line_no AS b_line, coalesce(a.text, b.text) AS text
    FROM {_occ('{raw_lines}', _STRIP.replace('{x}', 'text'))} a FULL JOIN {_occ('{versions_b}', _STRIP.replace('{x}', 'text'))} b ON a.doc_id = b.doc_id AND a.key = b.key AND a.nth = b.nth)"""


def _ab(spark, d):
    return table(spark, d, "raw_lines"), table(spark, d, "versions_b")


@query("w19_occurrences", f"SELECT doc_id, line_no, CAST(nth AS INTEGER) AS nth FROM {_occ('{raw_lines}', _STRIP.replace('{x}', 'text'))}")
def w19(spark, d):
    return V.occurrences(table(spark, d, "raw_lines"), X.stripped(F.col("text")), ["doc_id"], "line_no").select("doc_id", "line_no", "nth")


@query("j18_line_diff", f"SELECT * FROM {_DIFF}")
def j18(spark, d):
    return V.line_diff(*_ab(spark, d))


def _rising(name: str, source: str, by: str) -> str:
    """Tables that end in `name`: of the pairs of each group the longest chain that rises
    on both sides, element after element."""
    best = "(list_sort(list_transform({at}, lambda j: {{'n': -ls[j], 'v': b[j], 'j': j}}))[1]).j"
    return f"""{name}_p AS (SELECT {by}, list(a_line ORDER BY a_line) AS a, list(b_line ORDER BY a_line) AS b FROM {source} GROUP BY ALL),
    {name}_r AS (SELECT {by}, a, b, 0 AS k, []::BIGINT[] AS ls, []::BIGINT[] AS pv FROM {name}_p UNION ALL SELECT {by}, a, b, k + 1, list_append(ls, coalesce(ls[best], 0) + 1), list_append(pv, coalesce(best, 0))
        FROM (SELECT *, {best.format(at='list_filter(range(1, k + 1), lambda j: b[j] < b[k + 1])')} AS best FROM {name}_r WHERE k < len(b))),
    {name}_e AS (SELECT {by}, a, b, pv, {best.format(at='range(1, len(b) + 1)')} AS j FROM {name}_r WHERE k = len(b) UNION ALL SELECT {by}, a, b, pv, pv[j] FROM {name}_e WHERE pv[j] > 0),
    {name} AS (SELECT {by}, a[j] AS a_line, b[j] AS b_line FROM {name}_e)"""


def _bare(t: str, s: str) -> str:
    return f"(SELECT doc_id, line_no AS {s}_line, {_STRIP.replace('{x}', 'text')} AS text FROM {t} WHERE {_STRIP.replace('{x}', 'text')} <> '')"


def _gap(s: str) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY doc_id, gap, text ORDER BY {s}_line) AS nth FROM (SELECT l.*, (SELECT count(*) FROM anchor x WHERE x.doc_id = l.doc_id AND x.{s}_line < l.{s}_line) AS gap FROM {s} l
        WHERE NOT EXISTS (SELECT 1 FROM anchor x WHERE x.doc_id = l.doc_id AND x.{s}_line = l.{s}_line)))"""


_ORDERED = f"""WITH RECURSIVE a AS {_bare('{doc_lines}', 'a')}, b AS {_bare('{versions_c}', 'b')},
    once AS (SELECT doc_id, min(a_line) AS a_line, min(b_line) AS b_line FROM (SELECT doc_id, text, a_line, NULL AS b_line FROM a UNION ALL SELECT doc_id, text, NULL, b_line FROM b) GROUP BY doc_id, text HAVING count(a_line) = 1 AND count(b_line) = 1),
    {_rising('anchor', 'once', 'doc_id')}, met AS (SELECT x.doc_id, x.gap, a_line, b_line FROM {_gap('a')} x JOIN {_gap('b')} y ON x.doc_id = y.doc_id AND x.gap = y.gap AND x.text = y.text AND x.nth = y.nth),
    {_rising('filled', 'met', 'doc_id, gap')}, pair AS (SELECT * FROM anchor UNION ALL SELECT doc_id, a_line, b_line FROM filled),
    op AS (SELECT a.doc_id, CASE WHEN p.b_line IS NULL THEN -1 ELSE 0 END AS op, a.a_line, p.b_line, text, (SELECT count(*) FROM pair q WHERE q.doc_id = a.doc_id AND q.a_line <= a.a_line) AS slot FROM a LEFT JOIN pair p ON p.doc_id = a.doc_id AND p.a_line = a.a_line
        UNION ALL SELECT b.doc_id, 1, NULL, b.b_line, text, (SELECT count(*) FROM pair q WHERE q.doc_id = b.doc_id AND q.b_line <= b.b_line) FROM b WHERE NOT EXISTS (SELECT 1 FROM pair q WHERE q.doc_id = b.doc_id AND q.b_line = b.b_line)),
    told AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY slot, turn, coalesce(a_line, b_line)) AS INTEGER) AS place, op, a_line, b_line, text FROM (SELECT *, CASE op WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END AS turn FROM op))"""


def _ordered(spark, d):
    return V.ordered_diff(table(spark, d, "doc_lines"), table(spark, d, "versions_c"))


@query("j18_ordered_diff", f"{_ORDERED} SELECT * FROM told")
def j18_ordered(spark, d):
    return _ordered(spark, d)


@query("w9_offsets", f"""{_ORDERED} SELECT t.*, CAST(coalesce((SELECT sum(length(e.text)) FROM told e WHERE e.doc_id = t.doc_id AND e.place < t.place AND e.a_line IS NOT NULL), 0) AS BIGINT) AS offset_a,
    CAST(coalesce((SELECT sum(length(e.text)) FROM told e WHERE e.doc_id = t.doc_id AND e.place < t.place AND e.b_line IS NOT NULL), 0) AS BIGINT) AS offset_b FROM told t""")
def w9(spark, d):
    return V.offsets(_ordered(spark, d))


def _pages(t: str, div: int) -> str:
    return f"(SELECT doc_id, line_no // {div} AS page, string_agg(text, chr(10) ORDER BY line_no) AS text FROM {t} GROUP BY ALL)"


_PD = f"""(SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'deleted'
    WHEN list_sort(string_split({_STRIP.replace('{x}', 'a.text')}, '')) = list_sort(string_split({_STRIP.replace('{x}', 'b.text')}, '')) THEN 'equal' ELSE 'modified' END AS diff_type
    FROM {_pages('{raw_lines}', 10)} a FULL JOIN {_pages('{versions_b}', 20)} b ON a.doc_id = b.doc_id AND a.page = b.page)"""


def _page_diff(spark, d):
    a, b = _ab(spark, d)
    return V.page_diff(V.page_text(a, 10), V.page_text(b, 20))


@query("j15_page_diff", f"SELECT * FROM {_PD}")
def j15(spark, d):
    return _page_diff(spark, d)


@query("a29_change_counts", f"SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE diff_type = 'equal') AS equal, count(*) FILTER (WHERE diff_type = 'modified') AS modified, count(*) FILTER (WHERE diff_type = 'added') AS added, count(*) FILTER (WHERE diff_type = 'deleted') AS deleted FROM {_PD} GROUP BY doc_id")
def a29(spark, d):
    return V.change_counts(_page_diff(spark, d), "doc_id")


@query("j16_match_pages", f"""WITH a AS (SELECT doc_id, page, list_distinct(regexp_split_to_array(text, '\\s+')) AS w FROM {_pages('{raw_lines}', 10)}), b AS (SELECT doc_id, page, list_distinct(regexp_split_to_array(text, '\\s+')) AS w FROM {_pages('{versions_b}', 20)}),
    p AS (SELECT a.doc_id, a.page AS a_page, b.page AS b_page, len(list_intersect(a.w, b.w)) / greatest(least(len(a.w), len(b.w)), 1) AS score FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.page - b.page) <= 2)
    SELECT doc_id, a_page, b_page, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, a_page ORDER BY score DESC, abs(a_page - b_page), a_page, b_page) AS x, row_number() OVER (PARTITION BY doc_id, b_page ORDER BY score DESC, abs(a_page - b_page), a_page, b_page) AS y FROM p WHERE score >= 0.3) WHERE x = 1 AND y = 1""")
def j16_single(spark, d):
    a, b = _ab(spark, d)
    return V.match_pages(V.page_text(a, 10), V.page_text(b, 20), 2)


def _numbered_pages(t: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS p, {_STRIP.replace('{x}', 'text')} AS bare, list_distinct(regexp_split_to_array(text, '\\s+')) AS w FROM {_pages(t, 3)})"


@query("j16_align_pages", f"""WITH RECURSIVE a AS {_numbered_pages('{doc_lines}')}, b AS {_numbered_pages('{versions_c}')},
    n AS (SELECT doc_id, na, nb, greatest(5, abs(na - nb) + 3) AS band FROM (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT doc_id, count(*) AS na FROM a GROUP BY 1) x FULL JOIN (SELECT doc_id, count(*) AS nb FROM b GROUP BY 1) y ON x.doc_id = y.doc_id)),
    cell AS (SELECT a.doc_id, a.p AS i, b.p AS j, CASE WHEN a.bare = b.bare THEN 1.0::DOUBLE WHEN a.bare = '' OR b.bare = '' THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) END AS s FROM a JOIN b ON a.doc_id = b.doc_id JOIN n ON n.doc_id = a.doc_id WHERE na <> nb AND abs(a.p - b.p) <= band),
    score AS (SELECT n.doc_id, i, nb, band, list_transform(range(1, nb + 1), lambda k: m[k]) AS s FROM (SELECT doc_id, i, map(list(j), list(CASE WHEN s >= 0.3 THEN s END)) AS m FROM cell GROUP BY ALL) c JOIN n ON n.doc_id = c.doc_id),
    dp AS (SELECT doc_id, 0 AS i, na, nb, band, list_transform(range(0, nb + 1), lambda k: 0.0::DOUBLE) AS v, []::INTEGER[][] AS steps FROM n WHERE na <> nb UNION ALL
        SELECT doc_id, i, na, nb, band, list_concat([0.0::DOUBLE], u), list_append(steps, list_transform(range(1, nb + 1), lambda j: CASE WHEN abs(j - i) > band THEN 0 WHEN u[j] = v[j] + s[j] THEN 1 WHEN u[j] = v[j + 1] THEN 2 ELSE 3 END)) FROM (
            SELECT *, list_transform(range(1, nb + 1), lambda j: CASE WHEN abs(j - i) <= band THEN list_max(m[greatest(1, i - band):j]) ELSE 0.0 END) AS u FROM (
                SELECT dp.doc_id, dp.i + 1 AS i, na, dp.nb, dp.band, v, s, steps, list_transform(range(1, dp.nb + 1), lambda j: CASE WHEN abs(j - dp.i - 1) <= dp.band THEN greatest(coalesce(v[j] + s[j], 0.0), v[j + 1]) ELSE 0.0 END) AS m
                FROM dp JOIN (SELECT n.doc_id, k.i, coalesce(s, list_transform(range(1, n.nb + 1), lambda q: NULL::DOUBLE)) AS s FROM n, LATERAL (SELECT unnest(range(1, na + 1)) AS i) k LEFT JOIN score ON score.doc_id = n.doc_id AND score.i = k.i) c ON c.doc_id = dp.doc_id AND c.i = dp.i + 1))),
    walk AS (SELECT doc_id, na AS i, nb AS j, NULL::BIGINT AS x, NULL::BIGINT AS y, steps FROM dp WHERE i = na UNION ALL
        SELECT doc_id, CASE WHEN c IN (1, 2) THEN i - 1 ELSE i END, CASE WHEN c IN (0, 1, 3) THEN j - 1 ELSE j END, CASE WHEN c IN (1, 2) THEN i END, CASE WHEN c IN (0, 1, 3) THEN j END, steps
        FROM (SELECT *, CASE WHEN i > 0 AND j > 0 THEN steps[i][j] WHEN i > 0 THEN 2 ELSE 3 END AS c FROM walk WHERE i > 0 OR j > 0)),
    pair AS (SELECT doc_id, x, y FROM walk WHERE x IS NOT NULL OR y IS NOT NULL UNION ALL SELECT doc_id, unnest(range(1, na + 1)), unnest(range(1, na + 1)) FROM n WHERE na = nb)
    SELECT pair.doc_id, a.page AS a_page, b.page AS b_page, CASE WHEN a.page IS NULL THEN 'added' WHEN b.page IS NULL THEN 'deleted' WHEN a.bare = b.bare THEN 'equal' ELSE 'modified' END AS diff_type
    FROM pair LEFT JOIN a ON a.doc_id = pair.doc_id AND a.p = pair.x LEFT JOIN b ON b.doc_id = pair.doc_id AND b.p = pair.y""")
def j16(spark, d):
    return V.align_pages(V.page_text(table(spark, d, "doc_lines"), 3), V.page_text(table(spark, d, "versions_c"), 3))


# Where a section's parent is left out, the last section before it that is less deep is its parent.
_SEC_B = f"""(SELECT doc_id, line_no, CASE level WHEN 2 THEN max(CASE WHEN level < 2 THEN line_no END) OVER w WHEN 3 THEN max(CASE WHEN level < 3 THEN line_no END) OVER w WHEN 4 THEN max(CASE WHEN level < 4 THEN line_no END) OVER w END AS parent, level, title,
    CASE WHEN line_no % 5 = 0 THEN body || 'x' WHEN line_no % 7 = 0 THEN 'y' || body ELSE body END AS body FROM {_SECTIONS} WHERE line_no % 11 <> 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _secs(spark, d):
    a = ordered.sections(ordered.headings(table(spark, d, "doc_lines")))
    n = F.col("line_no")
    body = F.when(n % 5 == 0, F.concat("body", F.lit("x"))).when(n % 7 == 0, F.concat(F.lit("y"), "body")).otherwise(F.col("body"))
    return a, a.where(n % 11 != 0).withColumn("body", body)


def _paths(t: str, key: str, own: str) -> str:
    """Sections of t with key, self, up and path."""
    keyed = f"(SELECT *, {own} AS self FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, parent, key ORDER BY line_no) AS nth FROM (SELECT *, {key} AS key FROM {t})))"
    joins = " ".join(f"LEFT JOIN {keyed} g{k} ON g{k}.doc_id = s.doc_id AND g{k}.line_no = {'s' if k == 1 else f'g{k - 1}'}.parent" for k in (1, 2, 3))
    return f"(SELECT s.*, concat_ws('/', g3.self, g2.self, g1.self) AS up, concat_ws('/', g3.self, g2.self, g1.self, s.self) AS path FROM {keyed} s {joins})"


_SIGN = "CAST(level AS VARCHAR) || '|' || " + _STRIP.replace("{x}", "title") + " || '|' || substr(" + _STRIP.replace("{x}", "body") + ", 1, 200)"
_SELF = "key || '#' || CAST(nth AS VARCHAR)"


def _left_over(s: str) -> str:
    return f"(SELECT doc_id, up, {s}_line, row_number() OVER (PARTITION BY doc_id, up ORDER BY {s}_line) AS place FROM under WHERE {s}_line IS NOT NULL)"


@query("j17_align_sections", f"""WITH j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.path, b.path) AS path, coalesce(a.up, b.up) AS up, a.line_no AS a_line, b.line_no AS b_line, a.body AS a_body, b.body AS b_body
    FROM {_paths(_SECTIONS, _SIGN, _SELF)} a FULL JOIN {_paths(_SEC_B, _SIGN, _SELF)} b ON a.doc_id = b.doc_id AND a.path = b.path),
    under AS (SELECT * FROM j WHERE (a_line IS NULL OR b_line IS NULL) AND (up = '' OR EXISTS (SELECT 1 FROM j p WHERE p.a_line IS NOT NULL AND p.b_line IS NOT NULL AND p.doc_id = j.doc_id AND p.path = j.up)))
    SELECT doc_id, a_line, b_line, CASE WHEN {_STRIP.replace('{x}', 'a_body')} = {_STRIP.replace('{x}', 'b_body')} THEN 'equal' ELSE 'modified' END AS diff_type FROM j WHERE a_line IS NOT NULL AND b_line IS NOT NULL
    UNION ALL SELECT coalesce(a.doc_id, b.doc_id), a_line, b_line, CASE WHEN a_line IS NULL THEN 'added' WHEN b_line IS NULL THEN 'deleted' ELSE 'modified' END FROM {_left_over('a')} a FULL JOIN {_left_over('b')} b ON a.doc_id = b.doc_id AND a.up = b.up AND a.place = b.place""")
def j17(spark, d):
    return V.align_sections(*_secs(spark, d))


def _places(t: str) -> str:
    return f"(SELECT *, {_KEY.replace('{x}', 'title')} AS k FROM {_paths(t, chr(39) + chr(39), 'lpad(CAST(nth AS VARCHAR), 6, ' + chr(39) + '0' + chr(39) + ')')})"


@query("j23_pair_by_position", f"""WITH j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.path, b.path) AS path, a.line_no AS a_line, b.line_no AS b_line, CASE WHEN a.k IS NULL THEN 'missing_in_a' WHEN b.k IS NULL THEN 'missing_in_b' WHEN a.k = b.k OR (a.k <> '' AND b.k <> '' AND (contains(a.k, b.k) OR contains(b.k, a.k))) THEN 'paired' ELSE 'both_missing' END AS kind
    FROM {_places(_SECTIONS)} a FULL JOIN {_places(_SEC_B)} b ON a.doc_id = b.doc_id AND a.path = b.path)
    SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM j p WHERE p.doc_id = j.doc_id AND p.kind <> 'paired' AND starts_with(j.path, p.path || '/'))""")
def j23(spark, d):
    return V.pair_by_position(*_secs(spark, d))


@query("a24_pair_totals", f"SELECT kind, count(*) AS n FROM ({ORACLE_SQL['j23_pair_by_position']}) GROUP BY kind")
def a24(spark, d):
    return V.pair_by_position(*_secs(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


# Blocks of pages: each fifth line is a row of a table whose numbers are written in two ways.
def _blocks(t: str, b: bool) -> str:
    number = "CASE WHEN (doc_id + line_no) % 6 = 2 THEN '7' ELSE CAST(line_no + 1000 AS VARCHAR) || '.0' END" if b else "'1,' || substr(CAST(line_no + 1000 AS VARCHAR), 2, 3)"
    text = "text || ' '" if b else "text"
    return f"(SELECT doc_id, line_no // 5 AS page, line_no, line_no % 5 = 2 AS is_table, CASE WHEN line_no % 5 = 2 THEN 'sum|' || {number} ELSE {text} END AS text FROM {t} WHERE line_no < 1000{' AND line_no % 37 <> 4' if b else ''})"


@query("j32_page_verdicts", f"""WITH a AS {_blocks('{raw_lines}', False)}, b AS {_blocks('{raw_lines}', True)},
    p AS (SELECT doc_id, page, count(*) AS n, list(is_table ORDER BY line_no) AS kinds, list_sort(string_split(string_agg({_STRIP.replace('{x}', 'text')}, '' ORDER BY line_no), '')) AS chars, list_sort(list({_STRIP.replace('{x}', 'text')})) AS lines FROM a GROUP BY ALL),
    q AS (SELECT doc_id, page, count(*) AS n, list(is_table ORDER BY line_no) AS kinds, list_sort(string_split(string_agg({_STRIP.replace('{x}', 'text')}, '' ORDER BY line_no), '')) AS chars, list_sort(list({_STRIP.replace('{x}', 'text')})) AS lines FROM b GROUP BY ALL),
    c AS (SELECT x.doc_id, x.page, bool_and(CASE WHEN x.is_table THEN y.text <> 'sum|7' ELSE {_STRIP.replace('{x}', 'x.text')} = {_STRIP.replace('{x}', 'y.text')} END) AS same FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS k FROM a) x
        JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS k FROM b) y ON x.doc_id = y.doc_id AND x.page = y.page AND x.k = y.k GROUP BY ALL)
    SELECT coalesce(p.doc_id, q.doc_id) AS doc_id, coalesce(p.page, q.page) AS page, CASE WHEN p.n IS NULL THEN 'added' WHEN q.n IS NULL THEN 'deleted' WHEN p.chars = q.chars THEN 'equal' WHEN CASE WHEN p.kinds = q.kinds THEN c.same ELSE p.lines = q.lines END THEN 'equal' ELSE 'modified' END AS diff_type
    FROM p FULL JOIN q ON p.doc_id = q.doc_id AND p.page = q.page LEFT JOIN c ON c.doc_id = p.doc_id AND c.page = p.page""")
def j32(spark, d):
    lines, n = table(spark, d, "raw_lines").where("line_no < 1000"), F.col("line_no")
    row = n % 5 == 2

    def blocks(number, text):
        return F.when(row, F.concat(F.lit("sum|"), number)).otherwise(text)

    whole = (n + 1000).cast("string")
    a = lines.select("doc_id", F.expr("line_no div 5").alias("page"), "line_no", row.alias("is_table"), blocks(F.concat(F.lit("1,"), F.substring(whole, 2, 3)), F.col("text")).alias("text"))
    other = F.when((F.col("doc_id") + n) % 6 == 2, "7").otherwise(F.concat(whole, F.lit(".0")))
    b = lines.where(n % 37 != 4).select("doc_id", F.expr("line_no div 5").alias("page"), "line_no", row.alias("is_table"), blocks(other, F.concat("text", F.lit(" "))).alias("text"))
    return V.page_verdicts(a, b)


@query("j19_row_cells", """WITH p AS (SELECT a.p_partkey AS a_row, b.p_partkey AS b_row, a.p_retailprice AS ap, b.p_retailprice AS bp, a.p_type AS a_type, b.p_type AS b_type FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand, p_size ORDER BY p_partkey) AS nth FROM part) a
    FULL JOIN (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand, p_size ORDER BY p_partkey) AS nth FROM {part_b}) b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.nth = b.nth)
    SELECT a_row, b_row, CAST(place AS INTEGER) AS place, CASE WHEN a_row IS NULL THEN 'added' WHEN b_row IS NULL THEN 'deleted' WHEN CASE place WHEN 0 THEN ap = bp ELSE a_type = b_type END THEN 'same' ELSE 'changed' END AS kind FROM p, (SELECT unnest([0, 1]) AS place)""")
def j19(spark, d):
    return V.row_cells(table(spark, d, "part"), table(spark, d, "part_b"), ["p_name", "p_brand", "p_size"], "p_partkey", ["p_retailprice", "p_type"])


def _units(t: str, s: str) -> str:
    return f"(SELECT doc_id, line_no, CASE WHEN length(key) > 3 THEN key ELSE '{s}:' || key END AS key, nth FROM {_occ(t, _KEY.replace('{x}', 'text'))})"


@query("j22_match_units", f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.line_no AS a_line, b.line_no AS b_line, CASE WHEN a.line_no IS NULL THEN 'missing_in_a' WHEN b.line_no IS NULL THEN 'missing_in_b' ELSE 'matched' END AS kind
    FROM {_units('{raw_lines}', 'a')} a FULL JOIN {_units('{versions_b}', 'b')} b ON a.doc_id = b.doc_id AND a.key = b.key AND a.nth = b.nth""")
def j22(spark, d):
    return V.match_units(*_ab(spark, d))


@query("d11_remainder", f"SELECT l.doc_id, l.line_no FROM {{raw_lines}} l WHERE NOT EXISTS (SELECT 1 FROM {_DIFF} x WHERE x.op = 0 AND x.doc_id = l.doc_id AND x.a_line = l.line_no)")
def d11(spark, d):
    a, b = _ab(spark, d)
    matched = V.line_diff(a, b).where("op = 0").select("doc_id", F.col("a_line").alias("line_no"))
    return V.remainder(a, matched, ["doc_id", "line_no"]).select("doc_id", "line_no")


@query("j20_pair_rows", """SELECT a.p_partkey AS a_row, b.p_partkey AS b_row, CASE WHEN a.p_partkey IS NULL THEN 'only_in_b' WHEN b.p_partkey IS NULL THEN 'only_in_a' ELSE 'paired' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand, p_size ORDER BY p_partkey) AS nth FROM part) a
    FULL JOIN (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand, p_size ORDER BY p_partkey) AS nth FROM {part_b}) b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.nth = b.nth""")
def j20(spark, d):
    return V.pair_rows(table(spark, d, "part"), table(spark, d, "part_b"), ["p_name", "p_brand", "p_size"], "p_partkey")


# A pair of tables for each brand. Of three in a row one has its sizes on both sides, one on
# neither, one a header that the other side calls by another name; rows of some are blank.
@query("j20_pair_tables", """WITH a AS (SELECT p_brand AS t, p_partkey AS r, p_name, CAST(p_size AS VARCHAR) AS size, hash_no FROM (SELECT *, CAST(right(p_brand, 1) AS INTEGER) % 3 AS hash_no FROM part)),
    b AS (SELECT p_brand AS t, p_partkey AS r, p_name, CAST(p_size AS VARCHAR) AS size, CAST(right(p_brand, 1) AS INTEGER) % 3 AS hash_no FROM {part_b}),
    x AS (SELECT t, r, p_name || CASE WHEN hash_no = 0 THEN '|' || size ELSE '' END AS key, row_number() OVER (PARTITION BY t, p_name || CASE WHEN hash_no = 0 THEN '|' || size ELSE '' END ORDER BY r) AS nth FROM a WHERE r % 50 <> 7),
    y AS (SELECT t, r, p_name || CASE WHEN hash_no = 0 THEN '|' || size ELSE '' END AS key, row_number() OVER (PARTITION BY t, p_name || CASE WHEN hash_no = 0 THEN '|' || size ELSE '' END ORDER BY r) AS nth FROM b)
    SELECT coalesce(x.t, y.t) AS table_id, x.r AS a_row, y.r AS b_row, CASE WHEN x.r IS NULL THEN 'only_in_b' WHEN y.r IS NULL THEN 'only_in_a' ELSE 'paired' END AS kind FROM x FULL JOIN y ON x.t = y.t AND x.key = y.key AND x.nth = y.nth""")
def j20_tables(spark, d):
    turn = F.substring("p_brand", -1, 1).cast("int") % 3

    def cells(size_header, size):
        base = [F.lit("name"), F.col("p_name")]
        return F.when(turn == 0, F.create_map(*base, F.lit("size"), size)).when(turn == 1, F.create_map(*base)).otherwise(F.create_map(*base, F.lit(size_header), size))

    a, b = table(spark, d, "part"), table(spark, d, "part_b")
    blank = F.transform_values(cells("size", F.col("p_size").cast("string")), lambda k, v: F.lit(" "))
    left = a.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 50 == 7, blank).otherwise(cells("size", F.concat(F.col("p_size").cast("string"), F.lit(".0")))).alias("cells"))
    right = b.select(F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("row_id"), cells("measure", F.format_number(F.col("p_size"), 0)).alias("cells"))
    return V.pair_tables(left, right)


@query("j21_cell_diffs", """SELECT a.p_partkey, x AS "column", CASE x WHEN 'p_size' THEN CAST(a.p_size AS VARCHAR) ELSE CAST(a.p_retailprice AS VARCHAR) END AS a, CASE x WHEN 'p_size' THEN CAST(b.p_size AS VARCHAR) ELSE CAST(b.p_retailprice AS VARCHAR) END AS b, 'value' AS kind
    FROM part a JOIN {part_b} b ON a.p_partkey = b.p_partkey, (SELECT unnest(['p_size', 'p_retailprice']) AS x) WHERE (x = 'p_size' AND a.p_size <> b.p_size) OR (x = 'p_retailprice' AND a.p_retailprice <> b.p_retailprice)""")
def j21(spark, d):
    return V.cell_diffs(table(spark, d, "part"), table(spark, d, "part_b"), "p_partkey", ["p_size", "p_retailprice", "p_name"])


@query("j24_runs_in_lines", f"""WITH r AS (SELECT doc_id, line_no AS row_no, {_KEY.replace('{x}', 'text')} AS key FROM {{raw_lines}} WHERE line_no BETWEEN 2 AND 9), l AS (SELECT doc_id, line_no, {_KEY.replace('{x}', 'text')} AS key FROM {{versions_b}}),
    h AS (SELECT r.doc_id, row_no, line_no, line_no - row_no AS diagonal FROM r JOIN l ON r.doc_id = l.doc_id AND r.key = l.key WHERE l.key <> ''), i AS (SELECT *, row_no - row_number() OVER (PARTITION BY doc_id, diagonal ORDER BY row_no) AS island FROM h),
    g AS (SELECT doc_id, diagonal, island, count(*) AS n, min(line_no) AS first_line FROM i GROUP BY ALL) SELECT doc_id, n, first_line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_line, diagonal) AS k FROM g) WHERE k = 1""")
def j24(spark, d):
    a, b = _ab(spark, d)
    return V.runs_in_lines(a.where(F.col("line_no").between(2, 9)).select("doc_id", F.col("line_no").alias("row_no"), "text"), b)


_FULL_LINES = f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM (SELECT doc_id, line_no, {_KEY.replace('{x}', 'text')} AS key FROM {{t}}) WHERE key <> '')"


@query("j24_table_in_lines", f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {_FULL_LINES.replace('{t}', '(SELECT * FROM {raw_lines} WHERE line_no >= doc_id % 4)')}), l AS {_FULL_LINES.replace('{t}', '{versions_b}')},
    s AS (SELECT l.doc_id, l.pos AS start, l.line_no AS first_line, n FROM l JOIN r ON r.doc_id = l.doc_id AND r.key = l.key AND r.pos = 1), m AS (SELECT s.*, CASE WHEN r2.key IS NULL THEN 1 WHEN r3.key IS NULL THEN 2 ELSE 3 END AS rows_met FROM s
    LEFT JOIN (SELECT r.doc_id, l.pos FROM r JOIN l ON l.doc_id = r.doc_id AND l.key = r.key WHERE r.pos = 2) x2 ON x2.doc_id = s.doc_id AND x2.pos = s.start + 1 LEFT JOIN r r2 ON x2.doc_id = r2.doc_id AND r2.pos = 2
    LEFT JOIN (SELECT r.doc_id, l.pos FROM r JOIN l ON l.doc_id = r.doc_id AND l.key = r.key WHERE r.pos = 3) x3 ON x3.doc_id = s.doc_id AND x3.pos = s.start + 2 LEFT JOIN r r3 ON x3.doc_id = r3.doc_id AND r3.pos = 3),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rows_met DESC, start) AS k FROM m WHERE rows_met >= least(2, n)) WHERE k = 1)
    SELECT b.doc_id, b.first_line, CAST(b.rows_met AS BIGINT) AS rows_met, (SELECT CASE WHEN count(*) = 1 THEN max(l.line_no) END FROM l JOIN r ON r.doc_id = l.doc_id AND r.key = l.key AND r.pos = r.n WHERE l.doc_id = b.doc_id AND l.pos >= b.start) AS last_line FROM b""")
def j24_table(spark, d):
    a, b = _ab(spark, d)
    return V.table_in_lines(a.where(F.col("line_no") >= F.col("doc_id") % 4).select("doc_id", F.col("line_no").alias("row_no"), "text"), b)


_SIM = """CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.85 + 0.15 * least(length({a}), length({b})) / greatest(length({a}), length({b}))
    ELSE len(list_intersect(list_distinct(string_split({a}, '')), list_distinct(string_split({b}, '')))) / greatest(len(list_distinct(list_concat(string_split({a}, ''), string_split({b}, '')))), 1) END"""


def _sim(a: str, b: str) -> str:
    return _SIM.replace("{a}", a).replace("{b}", b)


@query("c50_similarity", f"SELECT doc_id, line_no, round(CAST({_sim('a', 'b')} AS DOUBLE), 6) AS score FROM (SELECT doc_id, line_no, {_KEY.replace('{x}', 'text')} AS a, 'inthe' AS b FROM {{doc_lines}})")
def c50(spark, d):
    return table(spark, d, "doc_lines").select("doc_id", "line_no", F.round(X.similarity(X.title_key(F.col("text")), F.lit("inthe")), 6).alias("score"))


_SHARE = "len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / greatest(len(list_distinct(list_concat(string_split(a, ''), string_split(b, '')))), 1)"


@query("c50_other_similarities", f"""SELECT doc_id, line_no, round(CAST(CASE WHEN a = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.92 ELSE {_SHARE} END AS DOUBLE), 6) AS margin,
    round(CAST(CASE WHEN a = b THEN 1.0 WHEN a = '' THEN 0.0 WHEN contains(a, b) OR contains(b, a) THEN 0.85 + 0.15 * least(length(a), 5) / greatest(length(a), 5) ELSE 0.75 * ({_SHARE}) END AS DOUBLE), 6) AS contents
    FROM (SELECT doc_id, line_no, {_KEY.replace('{x}', 'text')} AS a, 'inthe' AS b FROM {{doc_lines}})""")
def c50_others(spark, d):
    key, other = X.title_key(F.col("text")), F.lit("inthe")
    return table(spark, d, "doc_lines").select("doc_id", "line_no", F.round(X.margin_similarity(key, other), 6).alias("margin"), F.round(X.contents_similarity(key, other), 6).alias("contents"))


_COMPARED = "regexp_replace(translate({x}, '，。：；、！（）', ',.:;,!()'), '\\s+', '', 'g')"
_HUNDREDTHS = _SIM.replace("1.0", "1.0::DOUBLE").replace("0.85", "0.85::DOUBLE").replace("0.15", "0.15::DOUBLE")

# Anchors of one or two lines out of the first version, some of them changed, to be found in the third.
_ANCHORS = """(SELECT doc_id, line_no AS anchor, CASE WHEN line_no % 3 = 0 THEN 1 ELSE 2 END AS k, CASE WHEN line_no % 3 = 0 THEN text || CASE WHEN line_no % 2 = 0 THEN ' !' ELSE ' q' END ELSE text || ' ' || after END AS text
    FROM (SELECT *, lead(text, 1, '') OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM {doc_lines}) WHERE line_no % 3 <> 1)"""


@query("j25_anchor_windows", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM (SELECT doc_id, line_no, {_COMPARED.replace('{x}', 'text')} AS key FROM {{versions_c}}) WHERE key <> ''),
    w AS (SELECT doc_id, line_no, pos, width, string_agg(key, '' ORDER BY p2) AS key, count(*) AS n FROM (SELECT s.doc_id, s.line_no, s.pos, width, l.key, l.pos AS p2 FROM l s, (SELECT unnest([1, 2, 3, 4]) AS width) x, l WHERE l.doc_id = s.doc_id AND l.pos BETWEEN s.pos AND s.pos + width - 1) GROUP BY ALL HAVING count(*) = width),
    a AS (SELECT doc_id, anchor, k, {_COMPARED.replace('{x}', 'text')} AS key FROM {_ANCHORS})
    SELECT doc_id, anchor, line_no, width, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor ORDER BY score DESC, pos, width) AS turn FROM (SELECT a.doc_id, anchor, line_no, pos, width, round(CAST({_HUNDREDTHS.replace('{a}', 'a.key').replace('{b}', 'w.key')} AS DOUBLE), 6) AS score
        FROM a JOIN w ON a.doc_id = w.doc_id AND w.width BETWEEN a.k AND a.k + 2 WHERE a.key <> '') WHERE score >= 0.8) WHERE turn = 1""")
def j25(spark, d):
    lines, over = table(spark, d, "doc_lines"), Window.partitionBy("doc_id").orderBy("line_no")
    one = F.concat("text", F.when(F.col("line_no") % 2 == 0, " !").otherwise(" q"))
    single, after = F.col("line_no") % 3 == 0, F.coalesce(F.lead("text").over(over), F.lit(""))
    text = F.when(single, one).otherwise(F.concat("text", F.lit(" "), after))
    anchors = lines.select("doc_id", F.col("line_no").alias("anchor"), F.when(single, 1).otherwise(2).alias("k"), text.alias("text")).where("anchor % 3 <> 1")
    return V.anchor_windows(table(spark, d, "versions_c"), anchors)


_CONTENTS = "CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.85::DOUBLE + 0.15::DOUBLE * least(length({a}), length({b})) / greatest(length({a}), length({b})) ELSE 0.75::DOUBLE * (len(list_intersect(list_distinct(string_split({a}, '')), list_distinct(string_split({b}, '')))) / greatest(len(list_distinct(list_concat(string_split({a}, ''), string_split({b}, '')))), 1)) END"
_SHORT = "length(" + _STRIP.replace("{x}", "text") + ") <= 64 AND NOT regexp_matches(text, '[，。；：！？;:!?]') AND trim(text) <> ''"


@query("w15_anchor_candidates", f"""WITH e AS (SELECT doc_id, line_no AS entry, line_no // 2 AS from_line, {_KEY.replace('{x}', 'text')} AS k FROM {{doc_lines}} WHERE line_no % 2 = 0 AND {_SHORT}),
    l AS (SELECT doc_id, line_no, {_KEY.replace('{x}', 'text')} AS k FROM {{versions_c}} WHERE {_SHORT})
    SELECT doc_id, entry, line_no, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entry ORDER BY score DESC, line_no) AS rank FROM (SELECT e.doc_id, e.entry, l.line_no, round({_CONTENTS.replace('{a}', 'e.k').replace('{b}', 'l.k')}, 6) AS score
        FROM e JOIN l ON l.doc_id = e.doc_id AND l.line_no >= e.from_line) WHERE score >= 0.4) WHERE rank <= 8""")
def w15(spark, d):
    entries = V.short_lines(table(spark, d, "doc_lines").where("line_no % 2 = 0")).select("doc_id", F.col("line_no").alias("entry"), F.expr("line_no div 2").alias("from_line"), F.col("text").alias("title"))
    return V.anchor_candidates(entries, table(spark, d, "versions_c"))


@query("w16_known_window", """SELECT doc_id, line_no AS entry, last_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS from_line, first_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS to_line
    FROM (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 1 THEN line_no * 10 END AS known FROM {doc_lines})""")
def w16(spark, d):
    known = F.when(F.col("line_no") % 4 == 1, F.col("line_no") * 10)
    return V.known_window(table(spark, d, "doc_lines").select("doc_id", F.col("line_no").alias("entry"), known.alias("known")))


@query("w11_lines_to_pages", """WITH l AS (SELECT doc_id, line_no, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM {raw_lines}),
    p AS (SELECT doc_id, page, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM (SELECT doc_id, line_no // 6 AS page, sum(length(text)) + 1 AS size FROM {raw_lines} GROUP BY ALL))
    SELECT l.doc_id, l.line_no, (SELECT max(page) FROM p WHERE p.doc_id = l.doc_id AND p.at <= l.at) AS page FROM l""")
def w11(spark, d):
    lines = table(spark, d, "raw_lines")
    pages = lines.groupBy("doc_id", F.expr("line_no div 6").alias("page")).agg((F.sum(F.length("text")) + 1).alias("size"))
    return V.lines_to_pages(lines, pages)


@query("w11_fill_pages", f"""WITH RECURSIVE l AS (SELECT doc_id, line_no, length({_STRIP.replace('{x}', 'text')}) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM {{doc_lines}}),
    p AS (SELECT doc_id, list(page ORDER BY page) AS pages, list(size ORDER BY page) AS sizes FROM (SELECT doc_id, line_no // 4 AS page, sum(length({_STRIP.replace('{x}', 'text')})) AS size FROM {{versions_c}} GROUP BY ALL) WHERE size > 0 AND (doc_id + page) % 5 <> 3 GROUP BY 1),
    t AS (SELECT l.doc_id, 0 AS n, 1 AS turn, 0::HUGEINT AS held, NULL::BIGINT AS line_no FROM l WHERE n = 1 UNION ALL
        SELECT t.doc_id, l.n, CASE WHEN held >= sizes[turn] THEN turn + 1 ELSE turn END, CASE WHEN held >= sizes[turn] THEN 0 ELSE held END + l.size, l.line_no FROM t JOIN l ON l.doc_id = t.doc_id AND l.n = t.n + 1 LEFT JOIN p ON p.doc_id = t.doc_id)
    SELECT t.doc_id, line_no, pages[turn] AS page FROM t LEFT JOIN p ON p.doc_id = t.doc_id WHERE n > 0""")
def w11_fill(spark, d):
    other = table(spark, d, "versions_c")
    pages = other.groupBy("doc_id", F.expr("line_no div 4").alias("page")).agg(F.array_join(F.collect_list("text"), "").alias("text")).where("(doc_id + page) % 5 <> 3")
    return V.fill_pages(table(spark, d, "doc_lines"), pages)


@query("a23_same_characters", "SELECT doc_id, line_no, list_sort(string_split(text, '')) = list_sort(string_split(CASE WHEN line_no % 2 = 0 THEN reverse(text) ELSE text || 'x' END, '')) AS same FROM {raw_lines}")
def a23(spark, d):
    other = F.when(F.col("line_no") % 2 == 0, F.reverse("text")).otherwise(F.concat("text", F.lit("x")))
    return table(spark, d, "raw_lines").select("doc_id", "line_no", X.same_characters(F.col("text"), other).alias("same"))


@query("c54_cell_equal", "SELECT p_partkey, (p_partkey % 2 = 0) AS same FROM part")
def c54(spark, d):
    n = F.col("p_partkey").cast("string")
    a, b = F.concat(F.lit(" "), n, F.lit(".0")), F.when(F.col("p_partkey") % 2 == 0, F.concat(n, F.lit(" %"))).otherwise(F.concat(n, F.lit("1")))
    return table(spark, d, "part").select("p_partkey", V.cell_equal(a, b).alias("same"))


@query("s7_fingerprints", "SELECT doc_id, sha256(coalesce(text, '')) AS now FROM documents WHERE doc_id % 6 = 0")
def s7(spark, d):
    from tallyweave.sources.files import changed_sources

    docs = table(spark, d, "documents")
    saved = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("saved"))
    return changed_sources(docs, saved, "doc_id", "text").select("doc_id", "now")
