"""Documents against templates of expected sections, and exception reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import text as X


def mismatch(df: DataFrame, kind: str, severity: Column | str, item: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("doc_id", F.lit(kind).alias("kind"), level.alias("severity"), item.cast("string").alias("item"))


def _expected_of(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The expected sections of every document of found, by its source."""
    docs = found.select("doc_id", "source").distinct()
    return docs.join(expected, "source")


def _by_place(e: DataFrame, f: DataFrame, place: list[str], mark: str) -> DataFrame:
    """What stands at each place of (doc_id, place..., name): missing is high, extra and
    another name are medium."""
    j = e.select("doc_id", *place, F.col("name").alias("want")).join(f.select("doc_id", *place, F.col("name").alias("got")), ["doc_id", *place], "full")
    kind = F.when(F.col("got").isNull(), f"{mark}missing").when(F.col("want").isNull(), f"{mark}extra").when(X.folded(F.col("want")) != X.folded(F.col("got")), f"{mark}name")
    level = F.when(kind == f"{mark}missing", "high").otherwise("medium")
    return j.withColumn("kind", kind).where("kind is not null").select("doc_id", "kind", level.alias("severity"), F.concat_ws(".", *place).alias("item"))


def compare_sections(expected: DataFrame, found: DataFrame) -> DataFrame:
    """I-th expected against i-th found section."""
    return _by_place(_expected_of(expected, found), found, ["pos"], "")


def compare_subsections(expected: DataFrame, found: DataFrame) -> DataFrame:
    """I-th expected against i-th found subsection (pos, sub) of the sections that
    both have; sub is null for a section itself."""
    e = _expected_of(expected, found)
    both = e.where("sub is null").select("doc_id", "pos").join(found.where("sub is null").select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")
    part = lambda df: df.where("sub is not null").join(both, ["doc_id", "pos"], "left_semi")
    return _by_place(part(e), part(found), ["pos", "sub"], "sub_")


def compare_headers(expected: DataFrame, found: DataFrame, place: list[str] | None = None) -> DataFrame:
    """Headers of a section, or of a subsection (place pos and sub), that are
    expected and not found (high), or found and not expected (low), on folded text.
    Extra headers count where something was expected at that place, or for sections."""
    place = place or ["pos"]
    split = lambda df: df.select("doc_id", *place, F.explode(F.array_distinct(F.transform(F.split("headers", ","), X.folded))).alias("header")).where("header <> ''")
    whole = _expected_of(expected, found)
    if len(place) > 1:
        whole, found = whole.where("sub is not null"), found.where("sub is not null")
        found = found.join(whole.select("doc_id", *place), ["doc_id", *place], "left_semi")
    e, f = split(whole), split(found)
    there = found.select("doc_id", *place).distinct()
    item = F.concat(F.concat_ws(".", *place), F.lit(":"), F.col("header"))
    mark = "sub_" if len(place) > 1 else ""
    lost = mismatch(e.join(there, ["doc_id", *place], "left_semi").join(f, ["doc_id", *place, "header"], "left_anti"), f"{mark}header_missing", "high", item)
    return lost.unionByName(mismatch(f.join(e, ["doc_id", *place, "header"], "left_anti"), f"{mark}header_extra", "low", item))


def compare_descriptions(expected: DataFrame, found: DataFrame) -> DataFrame:
    """A description missing (high), extra (low) or different (medium)."""
    e = _expected_of(expected, found).select("doc_id", "pos", X.folded(F.col("description")).alias("want"))
    j = e.join(found.select("doc_id", "pos", X.folded(F.col("description")).alias("got")), ["doc_id", "pos"])
    kind = F.when((F.col("want") != "") & (F.col("got") == ""), "description_missing").when((F.col("want") == "") & (F.col("got") != ""), "description_extra").when(F.col("want") != F.col("got"), "description_differs")
    level = F.when(kind == "description_missing", "high").when(kind == "description_extra", "low").otherwise("medium")
    return j.withColumn("kind", kind).where("kind is not null").select("doc_id", "kind", level.alias("severity"), F.col("pos").cast("string").alias("item"))


def repair_headers(expected: DataFrame, found: DataFrame) -> DataFrame:
    """With equally many headers, one that the template's header at its place
    ends with is taken from the template."""
    e = _expected_of(expected, found).select("doc_id", "pos", F.split("headers", ",").alias("want"))
    j = found.join(e, ["doc_id", "pos"], "left").withColumn("got", F.split("headers", ","))
    fixed = F.zip_with("got", "want", lambda g, w: F.when((g != "") & F.endswith(w, g), w).otherwise(g))
    return j.withColumn("headers", F.when(F.size("got") == F.size("want"), F.array_join(fixed, ",")).otherwise(F.col("headers"))).drop("got", "want")


def clear_other(found: DataFrame) -> DataFrame:
    """F8: a section named by a number and "其他" has one input field only: no headers
    and no description."""
    other = F.trim("name").rlike(r"[0-9]+\.?\s*其他$")
    return found.withColumns({c: F.when(other, "").otherwise(F.col(c)) for c in ("headers", "description")})


def drop_copied(found: DataFrame, appendix: int) -> DataFrame:
    """F8: a section whose headers equal the appendix's has none."""
    a = found.where(F.col("pos") == appendix).select("doc_id", F.col("headers").alias("__a"))
    j = found.join(a, "doc_id", "left")
    same = (F.col("pos") != appendix) & F.coalesce(X.folded(F.col("headers")) == X.folded(F.col("__a")), F.lit(False))
    return j.withColumn("headers", F.when(same, "").otherwise(F.col("headers"))).drop("__a")


def verdict(docs: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Passed when there is no mismatch, with counts by severity."""
    n = mismatches.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    out = docs.select("doc_id").distinct().join(n, "doc_id", "left")
    counts = [F.coalesce(s, F.lit(0)).alias(s) for s in ("high", "medium", "low")]
    return out.select("doc_id", *counts, (F.coalesce(F.col("high") + F.col("medium") + F.col("low"), F.lit(0)) == 0).alias("passed"))


def best_template(docs: DataFrame, templates: dict[str, list[str]], text: str = "text") -> DataFrame:
    """The template with most keywords in the text, the first of equals; unknown
    without any; and the keywords it lacks. One pass over the text."""
    lacking = lambda words: F.array_compact(F.array(*[F.when(~F.col(text).contains(w), F.lit(w)) for w in words]))
    scored = F.array(*[F.struct((F.lit(len(w)) - F.size(lacking(w))).alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("name"), lacking(w).alias("missing")) for k, (name, w) in enumerate(templates.items())])
    best = F.array_max(F.transform(scored, lambda x: F.struct(x["score"].alias("score"), x["k"].alias("k"), x["name"].alias("name"), F.array_join(x["missing"], ",").alias("missing"))))
    named = docs.withColumn("__b", best)
    return named.select("doc_id", F.when(F.col("__b.score") > 0, F.col("__b.name")).otherwise("unknown").alias("template"), F.col("__b.score").alias("score"), F.when(F.col("__b.score") > 0, F.col("__b.missing")).otherwise("").alias("missing"))


HIDDEN, FORMAT = (4, 6, 11), (4, 12, 16)


def presented(exceptions: DataFrame) -> DataFrame:
    """exceptions that are shown; format-like types are shown as one."""
    shown = exceptions.where(~F.col("type_id").isin(6, 11))
    return shown.withColumn("shown_type", F.when(F.col("type_id").isin(*FORMAT), 12).otherwise(F.col("type_id"))).where(~F.col("shown_type").isin(*HIDDEN))


def histogram(exceptions: DataFrame, names: Column) -> DataFrame:
    """Rows of each display name, and in all under null."""
    return exceptions.rollup(names.alias("name")).agg(F.count("*").alias("n")).orderBy("name")


def joined_names(exceptions: DataFrame, name: Column) -> DataFrame:
    """Names of a record's types, distinct, in first-seen order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("type_id"), name.alias("name")))), lambda x: x["name"])
    return exceptions.select("rec_id", "type_id").distinct().groupBy("rec_id").agg(F.array_join(F.array_distinct(ordered), " | ").alias("names"))


def flagged(links: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Links with whether their record has an exception, and its names."""
    names = joined_names(exceptions, F.col("type_id").cast("string"))
    return links.join(names, "rec_id", "left").withColumn("has_exception", F.col("names").isNotNull())


def anchors(links: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row of each ledger id: its records and whether any has an exception."""
    bad = exceptions.select("rec_id").distinct().withColumn("bad", F.lit(True))
    j = links.where("ledger_id is not null").join(bad, "rec_id", "left")
    return j.groupBy("ledger_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("flagged"), F.min("rec_id").alias("first_rec"))


def grouped(exceptions: DataFrame, types: DataFrame) -> DataFrame:
    """Every type, in order, with its records sorted; types without any
    have none. Records of a type and batch are listed together."""
    items = exceptions.groupBy("batch_id", "type_id").agg(F.array_sort(F.collect_set("rec_id")).alias("items"))
    return types.join(items, "type_id", "left").select("type_id", "batch_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def grouped_rows(exceptions: DataFrame, types: DataFrame) -> DataFrame:
    """A13 and O5 as rows, for groups of any size: every type, and the place of each of
    its records by sheet, code and record; a type without any has one row of nulls."""
    over = Window.partitionBy("type_id", "batch_id").orderBy("sheet", "code", "rec_id")
    items = exceptions.select("type_id", "batch_id", "sheet", "code", "rec_id").distinct().withColumn("place", F.row_number().over(over))
    return types.select("type_id").distinct().join(items, "type_id", "left")


def company_report(exceptions: DataFrame) -> DataFrame:
    """One entry of each (type, record, sheet, company), listed by batch
    and company."""
    one = exceptions.select("batch_id", "company", "type_id", "rec_id", "sheet").distinct()
    return one.groupBy("batch_id", "company").agg(F.count("*").alias("entry_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "rec_id", "type_id"))), lambda x: F.concat_ws(":", x["sheet"], x["rec_id"], x["type_id"])), ",").alias("entries"))


def company_report_rows(exceptions: DataFrame) -> DataFrame:
    """A14 and D12 as rows, for companies of any number of entries: each entry of
    (type, record, sheet, company) with its place by sheet, record and type, and how many
    the company has."""
    one = exceptions.select("batch_id", "company", "type_id", "rec_id", "sheet").distinct()
    counts = one.groupBy("batch_id", "company").agg(F.count("*").alias("entry_count"))
    place = F.row_number().over(Window.partitionBy("batch_id", "company").orderBy("sheet", "rec_id", "type_id"))
    placed = one.withColumn("place", place)
    own = placed.alias("p").join(counts.alias("c"), F.expr("p.batch_id <=> c.batch_id and p.company <=> c.company"))
    return own.select("p.*", "c.entry_count")


def distinct_joins(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Distinct positive numbers of a key, sorted and joined."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.filter(F.collect_set(number), lambda x: x > 0)), " | ").alias("numbers"))


def candidates(links: DataFrame) -> DataFrame:
    """Candidates of records with several, numbered."""
    return links.where("n_matches > 1").withColumn("candidate", F.row_number().over(Window.partitionBy("rec_id").orderBy("ledger_id")))


def outline(sections: DataFrame) -> DataFrame:
    """A document's sections as one listing: indent by depth, marks by level, a
    preview of the text."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.substring("title", 1, 80))
    return sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))).alias("x")).select("doc_id", F.array_join(F.col("x.l"), "\n").alias("outline"))


def extraction_quality(predicted: DataFrame, gold: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Recall and precision of rows, accuracy and missing rate of fields, and
    the difference of counts, in one row."""
    p = predicted.select(key, F.lit(1).alias("p"), *[F.col(f).alias(f"p_{f}") for f in fields])
    g = gold.select(key, F.lit(1).alias("g"), *[F.col(f).alias(f"g_{f}") for f in fields])
    j = p.join(g, key, "full")
    both = F.col("p").isNotNull() & F.col("g").isNotNull()
    out = [
        (F.count_if(both) / F.count("g")).alias("recall"),
        (F.count_if(both) / F.count("p")).alias("precision"),
        (F.count("p") - F.count("g")).alias("count_delta"),
    ]
    for f in fields:
        out.append(F.round(F.avg(F.when(both, (F.col(f"p_{f}").eqNullSafe(F.col(f"g_{f}"))).cast("int"))), 6).alias(f"accuracy_{f}"))
        out.append(F.round(F.avg(F.when(both, F.col(f"p_{f}").isNull().cast("int"))), 6).alias(f"missing_{f}"))
    return j.agg(*out)
