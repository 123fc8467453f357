"""Comparison of two versions of a document: lines, pages, sections, tables.

Equal lines are matched by text and occurrence number, so a line that stands twice
is used twice and a common line costs one row a copy and not one a pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.functions import text as X
from tallyweave.operators import ordered
from tallyweave.operators.windows import best_windows


def occurrences(lines: DataFrame, key: Column, group: list[str], order: str) -> DataFrame:
    """Rows with their key and the number of the key's earlier rows plus one."""
    work = lines.withColumn("key", key)
    return work.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "key").orderBy(order)))


def line_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of each line of either side: op 0 where both have it, -1 and +1
    where only a or b has it. Blanks do not count. Both sides' lines are shuffled once,
    by document and text; a line's twin is the row after it."""
    side = lambda df, other: df.select("doc_id", F.lit(other).alias("other"), "line_no", "text")
    key = X.stripped(F.col("text"))
    rows = side(a, False).unionByName(side(b, True)).repartition(F.col("doc_id"), key).withColumn("key", key)
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "key", "other").orderBy("line_no")))
    over = Window.partitionBy("doc_id", "key").orderBy("nth", "other")
    known = F.col("doc_id").isNotNull() & F.col("key").isNotNull()
    twin = lambda at: F.coalesce(known & (at("nth").over(over) == F.col("nth")), F.lit(False))
    told = nth.withColumns({"both": twin(F.lead), "met": twin(F.lag), "b_line": F.lead("line_no").over(over)}).where("not met")
    op = F.when(F.col("other"), 1).when(F.col("both"), 0).otherwise(-1)
    b_line = F.when(F.col("other"), F.col("line_no")).when(F.col("both"), F.col("b_line"))
    return told.select("doc_id", op.alias("op"), F.when(~F.col("other"), F.col("line_no")).alias("a_line"), b_line.alias("b_line"), "text")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _chain(places: pd.Series) -> pd.Series:
    """Of numbers in order the longest chain that only rises, as its places. Among
    equally long ones each element takes the smallest number that it can follow."""

    def of(numbers: list) -> list[int]:
        tails, before = [], []  # of each length the element with the smallest number
        heads: list = []
        for k, x in enumerate(numbers):
            n = bisect_left(heads, x)
            before.append(tails[n - 1] if n else -1)
            heads[n : n + 1], tails[n : n + 1] = [x], [k]
        out, k = [], tails[-1] if tails else -1
        while k >= 0:
            out.append(k)
            k = before[k]
        return out[::-1]

    return places.map(of)


def _chained(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Of pairs (group, a_line, b_line) in each group the longest chain in which both
    lines only rise."""
    packed = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("a_line", "b_line"))).alias("p"))
    kept = packed.withColumn("k", _chain(F.col("p.b_line")))
    return kept.select(*group, F.explode(F.transform("k", lambda k: F.get("p", k))).alias("x")).select(*group, "x.a_line", "x.b_line")


def ordered_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """J18 in order: (doc_id, place, op, a_line, b_line, text) turns a's lines into b's.
    Lines that stand once on either side are anchors, the longest chain of them that
    both sides have in one order holds, and in the gaps between them lines are matched
    by text and occurrence in the gap, again as far as the order allows. Of what is
    between two matched lines, a's are deleted (-1) before b's are added (+1), so that a
    line that moved is one of each. Blanks do not count, blank lines are left out. Any
    numbering that rises with the lines will do."""

    def side(df: DataFrame, s: str) -> DataFrame:
        lines = df.where(F.col("text").rlike(r"\S")).select("doc_id", F.col("line_no").alias(f"{s}_line"), X.stripped(F.col("text")).alias("text"))
        return lines.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "text")))

    left, right = side(a, "a"), side(b, "b")
    once = left.where("n = 1").drop("n").join(right.where("n = 1").drop("n"), ["doc_id", "text"])
    anchors = _chained(once, ["doc_id"])

    def gaps(lines: DataFrame, s: str) -> DataFrame:
        marked = lines.join(anchors.select("doc_id", f"{s}_line", F.lit(1).alias("anchor")), ["doc_id", f"{s}_line"], "left")
        upto = Window.partitionBy("doc_id").orderBy(f"{s}_line").rowsBetween(Window.unboundedPreceding, 0)
        rest = marked.withColumn("gap", F.count("anchor").over(upto)).where("anchor is null")
        nth = F.row_number().over(Window.partitionBy("doc_id", "gap", "text").orderBy(f"{s}_line"))
        return rest.select("doc_id", "gap", f"{s}_line", "text", nth.alias("nth"))

    met = gaps(left, "a").join(gaps(right, "b"), ["doc_id", "gap", "text", "nth"]).select("doc_id", "gap", "a_line", "b_line")
    pairs = anchors.unionByName(_chained(met, ["doc_id", "gap"]).drop("gap"))

    def slots(lines: DataFrame, s: str) -> DataFrame:
        other = "b" if s == "a" else "a"
        marked = lines.join(pairs, ["doc_id", f"{s}_line"], "left")
        upto = Window.partitionBy("doc_id").orderBy(f"{s}_line").rowsBetween(Window.unboundedPreceding, 0)
        return marked.withColumn("slot", F.count(f"{other}_line").over(upto)).select("doc_id", "slot", "a_line", "b_line", "text")

    ops = slots(left, "a").withColumn("op", F.when(F.col("b_line").isNull(), -1).otherwise(0))
    ops = ops.unionByName(slots(right, "b").where("a_line is null").withColumn("op", F.lit(1)))
    turn = F.when(F.col("op") == 0, 0).when(F.col("op") == -1, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("slot", turn, F.coalesce("a_line", "b_line")))
    return ops.select("doc_id", place.alias("place"), "op", "a_line", "b_line", "text")


def offsets(ops: DataFrame) -> DataFrame:
    """Where each op of ordered_diff() begins in either text without blanks: the
    lengths of earlier ops on that side."""
    over = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text")
    total = lambda when: F.coalesce(F.sum(F.when(when, size)).over(over), F.lit(0)).cast("bigint")
    return ops.withColumn("offset_a", total(F.col("op") <= 0)).withColumn("offset_b", total(F.col("op") >= 0))


def page_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages of equal number: equal, modified, added or deleted. Pages
    whose characters agree in any order are equal."""
    left = a.select("doc_id", "page", F.col("text").alias("a"))
    right = b.select("doc_id", "page", F.col("text").alias("b"))
    x, y = X.stripped(F.col("a")), X.stripped(F.col("b"))
    same = X.let(F.struct(x.alias("x"), y.alias("y")), lambda p: (p["x"] == p["y"]) | X.same_characters(p["x"], p["y"]))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(same, "equal").otherwise("modified")
    return left.join(right, ["doc_id", "page"], "full").select("doc_id", "page", kind.alias("diff_type"))


def page_verdicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """What page_diff() says, and for modified pages a closer look at their blocks
    (doc_id, page, line_no, is_table, text). With equally many blocks of the same kinds
    the i-th is compared with the i-th, tables cell by cell; else lines are compared in
    any order. A page in which no op is a change is equal."""
    packed = lambda df, s: df.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "is_table", "text"))).alias(s))
    text = lambda s: F.array_join(F.col(f"{s}.text"), "\n").alias("text")
    x, y = packed(a, "x"), packed(b, "y")
    base = page_diff(x.select("doc_id", "page", text("x")), y.select("doc_id", "page", text("y")))
    cells = lambda l, r: (F.size(F.split(l, r"\|")) == F.size(F.split(r, r"\|"))) & F.forall(F.arrays_zip(F.split(l, r"\|").alias("l"), F.split(r, r"\|").alias("r")), lambda c: cell_equal(c["l"], c["r"]))
    block = lambda z: F.when(z["x"]["is_table"], cells(z["x"]["text"], z["y"]["text"])).otherwise(X.stripped(z["x"]["text"]) == X.stripped(z["y"]["text"]))
    bare = lambda s: F.array_sort(F.transform(F.col(f"{s}.text"), X.stripped))
    structured = F.forall(F.arrays_zip("x", "y"), block)
    unchanged = F.when(F.col("x.is_table") == F.col("y.is_table"), structured).otherwise(bare("x") == bare("y"))
    joined = base.join(x, ["doc_id", "page"], "left").join(y, ["doc_id", "page"], "left")
    verdict = F.when((F.col("diff_type") == "modified") & unchanged, "equal").otherwise(F.col("diff_type"))
    return joined.select("doc_id", "page", verdict.alias("diff_type"))


def page_text(lines: DataFrame, size: int) -> DataFrame:
    """Pages of `size` lines each, as one text."""
    page = F.expr(f"line_no div {size}").alias("page")
    packed = lines.groupBy("doc_id", page).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return packed.select("doc_id", "page", F.array_join(F.col("l.text"), "\n").alias("text"))


def match_pages(a: DataFrame, b: DataFrame, band: int, least: float = 0.3) -> DataFrame:
    """J16, by single pages: pages of either side within the band that are each other's best match,
    by the share of common words of the shorter page; ties go to the nearer page.
    Pages meet in blocks of pages; those at most a band from another block go there as
    well, so that texts are shuffled little more than once; they become words after that,
    and a pair's score is worked out once."""
    words = lambda c: F.array_distinct(F.split(F.col(c), r"\s+"))
    block = lambda page: F.floor(page / (8 * band + 8))
    at = F.col("page")
    dealt = lambda df: df.repartition("doc_id", "block").withColumn("words", words("text"))
    left = dealt(a.withColumn("block", block(at))).select("doc_id", "block", F.col("page").alias("a_page"), F.col("words").alias("a_words"))
    spread = b.withColumn("block", F.explode(F.sequence(block(at - band), block(at + band))))
    right = dealt(spread).select("doc_id", "block", F.col("page").alias("b_page"), F.col("words").alias("b_words"))
    score = F.size(F.array_intersect("a_words", "b_words")) / F.greatest(F.least(F.size("a_words"), F.size("b_words")), F.lit(1))
    near = F.abs(F.col("a_page") - F.col("b_page"))
    met = left.join(right, ["doc_id", "block"]).where(near <= band)
    pairs = met.select("doc_id", "a_page", "b_page", F.explode_outer(F.array(score)).alias("score")).where(F.col("score") >= least)
    rank = lambda side: F.row_number().over(Window.partitionBy("doc_id", side).orderBy(F.desc("score"), near, "a_page", "b_page"))
    ranked = pairs.withColumn("x", rank("a_page")).withColumn("y", rank("b_page"))
    return ranked.where("x = 1 and y = 1").select("doc_id", "a_page", "b_page", "score")


def _page_chain(na: Column, nb: Column, band: Column, cells: Column) -> Column:
    """Steps (i, j) of the heaviest chain of matched pages that does not cross, pages
    without a match alone. `cells` has the scores (null: no match) and whether texts are
    equal, of pages i and i - band to i + band, row after row. Rows of best sums are
    folded page by page, and then walked back."""
    width, zero = 2 * band + 1, F.lit(0.0)
    row_type, kinds = "struct<sums:array<double>,steps:array<array<int>>>", "struct<left:double,sums:array<double>,steps:array<int>>"

    def next_row(acc: Column, i: Column) -> Column:
        def before(j: Column) -> Column:
            at = j - i + 1 + band
            return F.when((i == 1) | (j < 1) | (j > nb) | (at < 0) | (at >= width), zero).otherwise(F.get(acc["sums"], at.cast("int")))

        def cell(left: Column, w: Column) -> Column:
            j = i - band + w
            score = F.get(cells, ((i - 1) * width + w).cast("int"))["score"]
            match, skip_a = F.coalesce(before(j - 1) + score, F.lit(-1.0)), before(j)
            best = F.greatest(match, skip_a, left["left"])
            step = F.when(best == match, 1).when(best == skip_a, 2).otherwise(3)
            inside = (j >= 1) & (j <= nb)
            return F.struct(
                F.when(inside, best).otherwise(left["left"]).alias("left"), F.concat(left["sums"], F.array(F.when(inside, best).otherwise(zero))).alias("sums"), F.concat(left["steps"], F.array(F.when(inside, step).otherwise(0))).alias("steps")
            ).cast(kinds)

        empty = F.struct(zero.alias("left"), F.array().cast("array<double>").alias("sums"), F.array().cast("array<int>").alias("steps")).cast(kinds)
        made = F.aggregate(F.sequence(F.lit(0), (width - 1).cast("int")), empty, cell)
        return F.element_at(F.transform(F.array(made), lambda r: F.struct(r["sums"].alias("sums"), F.concat(acc["steps"], F.array(r["steps"])).alias("steps")).cast(row_type)), 1)

    def walk(steps: Column) -> Column:
        made = "struct<i:int,j:int,out:array<struct<i:int,j:int>>>"

        def back(acc: Column, _: Column) -> Column:
            i, j = acc["i"], acc["j"]
            w = j - i + band
            own = F.when((i > 0) & (j > 0), F.when((w >= 0) & (w < width), F.get(F.get(steps, i - 1), w.cast("int"))).otherwise(0)).when(i > 0, 2).when(j > 0, 3).otherwise(-1)
            a, b = own.isin(1, 2), own.isin(0, 1, 3)
            more = F.when(own >= 0, F.array(F.struct(F.when(a, i).alias("i"), F.when(b, j).alias("j")))).otherwise(F.array())
            return F.struct((i - a.cast("int")).alias("i"), (j - b.cast("int")).alias("j"), F.concat(acc["out"], more.cast("array<struct<i:int,j:int>>")).alias("out")).cast(made)

        first = F.struct(na.cast("int").alias("i"), nb.cast("int").alias("j"), F.array().cast("array<struct<i:int,j:int>>").alias("out")).cast(made)
        return F.aggregate(F.sequence(F.lit(1), (na + nb).cast("int")), first, back)["out"]

    none = F.struct(F.array().cast("array<double>").alias("sums"), F.array().cast("array<array<int>>").alias("steps")).cast(row_type)
    rows = F.when(na > 0, F.aggregate(F.sequence(F.lit(1), na.cast("int")), none, next_row)).otherwise(none)
    return F.element_at(F.transform(F.array(rows), lambda r: walk(r["steps"])), 1)


def align_pages(a: DataFrame, b: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc_id, a_page, b_page, diff_type) of every page of either side. Documents
    of equally many pages pair them in order. Else the pages that match are those of the
    heaviest chain that does not cross: a pair scores 1 if its texts are equal but for
    blanks, else the share of the shorter page's words that both have, and counts from
    `least` on; page i meets pages up to max(5, difference of the counts + 3) away. Of
    equal sums a match goes before leaving out a's page, that before leaving out b's.
    Matched pages are equal or modified, others deleted or added. The work of a document
    is its pages times that band."""

    def side(df: DataFrame, s: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
        bare = X.stripped(F.col("text"))
        return df.select("doc_id", F.col("page").alias(f"{s}_page"), place.alias(f"{s}"), bare.alias(f"{s}_bare"), F.array_distinct(F.split("text", r"\s+")).alias(f"{s}_words"))

    left, right = side(a, "i"), side(b, "j")
    pages = lambda df, s: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(f"{s}_page")).alias(f"{s}_pages"))
    both = pages(left, "i").join(pages(right, "j"), "doc_id", "full")
    size = lambda s: F.coalesce(F.size(f"{s}_pages"), F.lit(0))
    sized = both.withColumns({"na": F.greatest(size("i"), F.lit(0)), "nb": F.greatest(size("j"), F.lit(0))}).withColumn("band", F.greatest(F.lit(5), F.abs(F.col("na") - F.col("nb")) + 3))

    same = F.col("i_bare") == F.col("j_bare")
    joined = left.join(right.withColumnRenamed("j", "i"), ["doc_id", "i"]).join(sized.where("na = nb").select("doc_id"), "doc_id")
    level = joined.select("doc_id", F.col("i_page").alias("a_page"), F.col("j_page").alias("b_page"), F.when(same, "equal").otherwise("modified").alias("diff_type"))

    uneven = sized.where("na <> nb")
    near = left.join(uneven.select("doc_id", "band"), "doc_id").select("*", F.explode(F.sequence(F.col("i") - F.col("band"), F.col("i") + F.col("band"))).alias("j"))
    met = near.join(right, ["doc_id", "j"], "left")
    share = F.size(F.array_intersect("i_words", "j_words")) / F.greatest(F.least(F.size("i_words"), F.size("j_words")), F.lit(1))
    score = F.when(same, 1.0).when((F.col("i_bare") == "") | (F.col("j_bare") == ""), 0.0).otherwise(share)
    cells = met.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", F.when(score >= least, score).alias("score"), same.alias("same")))).alias("cells"))
    chained = uneven.join(cells, "doc_id", "left").withColumn("cells", F.coalesce("cells", F.array().cast(cells.schema["cells"].dataType)))
    steps = chained.withColumn("x", F.explode(_page_chain(F.col("na"), F.col("nb"), F.col("band"), F.col("cells"))))
    equal = F.get("cells", ((F.col("x.i") - 1) * (2 * F.col("band") + 1) + F.col("x.j") - F.col("x.i") + F.col("band")).cast("int"))["same"]
    kind = F.when(F.col("x.i").isNull(), "added").when(F.col("x.j").isNull(), "deleted").when(equal, "equal").otherwise("modified")
    rest = steps.select("doc_id", F.get("i_pages", F.col("x.i") - 1).alias("a_page"), F.get("j_pages", F.col("x.j") - 1).alias("b_page"), kind.alias("diff_type"))
    return level.unionByName(rest)


def align_sections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sections of equal level, title and beginning meet under parents that meet,
    by occurrence; they are equal or modified by their text. What is left under such a
    pair meets by position (modified) or is deleted or added, its subtree included:
    sections below it have no row of their own. A section is known by 64-bit hashes of
    its own sign and of its ancestors'."""
    sign = F.xxhash64("level", X.stripped(F.col("title")), F.substring(X.stripped(F.col("body")), 1, 200))

    def side(df: DataFrame, s: str) -> DataFrame:
        keyed = ordered.with_subtrees(ordered.with_parents(df)).withColumn("key", sign)
        nth = F.row_number().over(Window.partitionBy("doc_id", "parent", "key").orderBy("line_no"))
        named = ordered.with_ancestors(keyed.withColumn("self", F.xxhash64("key", nth)), "self")
        path = F.xxhash64(F.concat("up", F.array("self")))
        return named.select("doc_id", path.alias("path"), F.when(F.size("up") > 0, F.xxhash64("up")).alias(f"{s}_up"), F.col("line_no").alias(f"{s}_line"), F.xxhash64(X.stripped(F.col("body"))).alias(f"{s}_body"))

    joined = side(a, "a").join(side(b, "b"), ["doc_id", "path"], "full").withColumn("up", F.coalesce("a_up", "b_up"))
    both = F.col("a_line").isNotNull() & F.col("b_line").isNotNull()
    # One shuffle by (doc_id, up) tells which lone sections are under a pair, and their places.
    met = F.explode(F.array(F.struct(F.col("up").alias("at"), F.lit(False).alias("head")), F.struct(F.col("path").alias("at"), F.lit(True).alias("head")))).alias("x")
    rows = joined.select("doc_id", "a_line", "b_line", both.alias("both"), (F.col("a_body") == F.col("b_body")).alias("same"), met).select("*", "x.at", "x.head")
    rows = rows.where("both or not head").withColumn("open", F.max(F.col("head") & F.col("both")).over(Window.partitionBy("doc_id", "at"))).where("not head")
    equal = rows.where("both").select("doc_id", "a_line", "b_line", F.when(F.col("same"), "equal").otherwise("modified").alias("diff_type"))
    lone = rows.where("not both and (at is null or open)")
    line = F.coalesce("a_line", "b_line")
    side_no = F.col("a_line").isNull()
    place = F.row_number().over(Window.partitionBy("doc_id", "at", side_no).orderBy(line))
    rest = lone.withColumn("place", place).groupBy("doc_id", "at", "place").agg(F.max("a_line").alias("a_line"), F.max("b_line").alias("b_line"))
    kind = F.when(F.col("a_line").isNull(), "added").when(F.col("b_line").isNull(), "deleted").otherwise("modified")
    return equal.unionByName(rest.select("doc_id", "a_line", "b_line", kind.alias("diff_type")))


def pair_by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    """The i-th child of a section with the i-th child of the section it is paired
    with; equal or containing titles pair, others put both subtrees into the remainder,
    tails are missing on one side. Below a section that is not paired nothing is shown.
    A path is the places from the outermost section on, six digits each."""

    def side(df: DataFrame, s: str) -> DataFrame:
        place = F.lpad(F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("line_no")).cast("string"), 6, "0")
        named = ordered.with_ancestors(ordered.with_subtrees(ordered.with_parents(df)).withColumn("place", place), "place")
        return named.select("doc_id", F.array_join(F.concat("up", F.array("place")), "/").alias("path"), F.col("line_no").alias(f"{s}_line"), X.title_key(F.col("title")).alias(f"{s}_key"))

    x, y = F.col("a_key"), F.col("b_key")
    kind = F.when(x.isNull(), "missing_in_a").when(y.isNull(), "missing_in_b").when((x == y) | ((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))), "paired").otherwise("both_missing")
    joined = side(a, "a").join(side(b, "b"), ["doc_id", "path"], "full").select("doc_id", "path", "a_line", "b_line", kind.alias("kind"))
    # In the order of paths a subtree is a range, which ends before its head's path and '0', the character after '/'.
    before = Window.partitionBy("doc_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    shut = F.max(F.when(F.col("kind") != "paired", F.concat("path", F.lit("0")))).over(before)
    return joined.withColumn("shut", shut).where("shut is null or shut <= concat(path, '0')").drop("shut")


def match_units(a: DataFrame, b: DataFrame) -> DataFrame:
    """Units equal after normalisation are used once each; the rest is missing
    on one side. Units of three characters or fewer are never matched."""
    key = X.title_key(F.col("text"))
    side = lambda df, s: occurrences(df, key, ["doc_id"], "line_no").select("doc_id", F.when(F.length("key") > 3, F.col("key")).otherwise(F.concat(F.lit(f"{s}:"), "key")).alias("key"), "nth", F.col("line_no").alias(f"{s}_line"))
    joined = side(a, "a").join(side(b, "b"), ["doc_id", "key", "nth"], "full")
    kind = F.when(F.col("a_line").isNull(), "missing_in_a").when(F.col("b_line").isNull(), "missing_in_b").otherwise("matched")
    return joined.select("doc_id", "a_line", "b_line", kind.alias("kind"))


def remainder(pool: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """What later phases still see."""
    return pool.join(matched.select(*keys).distinct(), keys, "left_anti")


def cell_equal(a: Column, b: Column) -> Column:
    """Blank, literal, without blanks, folded, or numeric equality."""
    from tallyweave.functions.money import numeric_cell

    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (x == y) | (X.stripped(x) == X.stripped(y)) | (X.comparison_key(x) == X.comparison_key(y)) | F.coalesce(numeric_cell(x) == numeric_cell(y), F.lit(False))


def pair_rows(a: DataFrame, b: DataFrame, shared: list[str], row_id: str) -> DataFrame:
    """Rows whose shared columns agree once folded, each used once in order;
    the rest is on one side only."""
    key = F.concat_ws("|", *[F.coalesce(F.format_number(F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("double"), 2), X.comparison_key(F.col(c).cast("string"))) for c in shared])
    side = lambda df, s: df.withColumn("key", key).select("key", F.row_number().over(Window.partitionBy("key").orderBy(row_id)).alias("nth"), F.col(row_id).alias(f"{s}_row"))
    joined = side(a, "a").join(side(b, "b"), ["key", "nth"], "full")
    kind = F.when(F.col("a_row").isNull(), "only_in_b").when(F.col("b_row").isNull(), "only_in_a").otherwise("paired")
    return joined.select("a_row", "b_row", kind.alias("kind"))


def pair_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """J20 for tables whose columns are not known: (table_id, a_row, b_row, kind) of rows
    (table_id, row_id, cells), cells a map of header to text, of many pairs of tables in
    one plan. The columns that both tables of a pair have are found by intersecting their
    headers; rows pair where all shared cells agree once folded (numbers as numbers),
    each used once in order. Rows with no text at all are left out; tables that share no
    header pair no rows, and what is left is on one side only."""

    def side(df: DataFrame, s: str) -> DataFrame:
        full = df.where(F.exists(F.map_values("cells"), lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
        return full.select("table_id", F.col("row_id").alias(f"{s}_row"), "cells")

    left, right = side(a, "a"), side(b, "b")
    names = lambda df, s: df.select("table_id", F.explode(F.map_keys("cells")).alias("h")).groupBy("table_id").agg(F.array_sort(F.collect_set("h")).alias(s))
    shared = names(left, "x").join(names(right, "y"), "table_id").select("table_id", F.array_intersect("x", "y").alias("shared"))

    def folded(c: Column) -> Column:
        number = F.regexp_replace(c, ",", "").try_cast("double")
        return F.coalesce(F.format_number(number, 2), X.comparison_key(c))

    def keyed(df: DataFrame, s: str) -> DataFrame:
        joined = df.join(shared, "table_id", "left")
        own = F.array_join(F.transform("shared", lambda h: folded(F.coalesce(F.element_at("cells", h), F.lit("")))), "|")
        key = F.when(F.size("shared") > 0, own).otherwise(F.concat(F.lit(f"{s}:"), F.col(f"{s}_row").cast("string")))
        work = joined.select("table_id", f"{s}_row", F.coalesce(key, F.concat(F.lit(f"{s}:"), F.col(f"{s}_row").cast("string"))).alias("key"))
        return work.withColumn("nth", F.row_number().over(Window.partitionBy("table_id", "key").orderBy(f"{s}_row")))

    joined = keyed(left, "a").join(keyed(right, "b"), ["table_id", "key", "nth"], "full")
    kind = F.when(F.col("a_row").isNull(), "only_in_b").when(F.col("b_row").isNull(), "only_in_a").otherwise("paired")
    return joined.select("table_id", "a_row", "b_row", kind.alias("kind"))


def row_cells(a: DataFrame, b: DataFrame, signature: list[str], row_id: str, columns: list[str]) -> DataFrame:
    """Rows aligned by their signature columns, each used once in order; cells of a
    pair are same or changed, by position, those of other rows deleted or added."""
    joined = pair_rows(a, b, signature, row_id)
    left = a.select(F.col(row_id).alias("a_row"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    right = b.select(F.col(row_id).alias("b_row"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for k, c in enumerate(columns)])).alias("x")
    out = joined.join(left, "a_row", "left").join(right, "b_row", "left").select("a_row", "b_row", cells)
    kind = F.when(F.col("a_row").isNull(), "added").when(F.col("b_row").isNull(), "deleted").when(cell_equal(F.col("x.a"), F.col("x.b")), "same").otherwise("changed")
    return out.select("a_row", "b_row", "x.place", kind.alias("kind"))


def cell_diffs(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Differing cells of rows with the same key: only on one side, a
    value that differs, or other text."""
    left = a.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    right = b.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])).alias("x")
    out = left.join(right, key).select(key, cells).select(key, "x.*").where(~cell_equal(F.col("a"), F.col("b")))
    number = F.col("a").try_cast("double").isNotNull() & F.col("b").try_cast("double").isNotNull()
    kind = F.when(F.coalesce("a", F.lit("")) == "", "only_in_b").when(F.coalesce("b", F.lit("")) == "", "only_in_a").when(number, "value").otherwise("other")
    return out.withColumn("kind", kind)


def runs_in_lines(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """The longest run of lines that equals successive table rows, for each
    document; the earliest of equally long ones."""
    rows = cells.select("doc_id", "row_no", X.title_key(F.col("text")).alias("key"))
    texts = lines.select("doc_id", "line_no", X.title_key(F.col("text")).alias("key")).where("key <> ''")
    hits = rows.join(texts, ["doc_id", "key"]).withColumn("diagonal", F.col("line_no") - F.col("row_no"))
    over = Window.partitionBy("doc_id", "diagonal").orderBy("row_no")
    island = hits.withColumn("island", F.col("row_no") - F.row_number().over(over))
    runs = island.groupBy("doc_id", "diagonal", "island").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
    best = F.max_by(F.struct("n", "first_line"), F.struct("n", -F.col("first_line"), -F.col("diagonal")))
    return runs.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.n", "b.first_line")


def table_in_lines(cells: DataFrame, lines: DataFrame, head: int = 3, least: int = 2) -> DataFrame:
    """Where a document's table stands as text: (doc_id, first_line, rows_met,
    last_line). From a line that equals the table's first row, the first `head` rows
    are held against the next lines, blanks aside, as far as they agree; at least
    `least` must (one, if the table has one). Most rows win, then the earliest start.
    The only line from there on that equals the last row ends it, else last_line is
    null. A start meets `head` rows at most, so repeated lines are never paired with
    repeated rows. Either side is shuffled once, by document."""
    by = Window.partitionBy("doc_id")
    full = X.has_title_key(F.col("text"))
    rows = cells.where(full).select("doc_id", "row_no", X.title_key(F.col("text")).alias("key"))
    placed = by.orderBy("row_no")
    rows = rows.select("doc_id", "key", F.row_number().over(placed).alias("k"), F.lead("row_no").over(placed).isNull().alias("last"))
    ends = rows.where((F.col("k") <= head) | F.col("last")).groupBy("doc_id")
    first = F.sort_array(F.collect_list(F.when(F.col("k") <= head, F.struct("k", F.col("key").alias("row"))))).alias("heads")
    heads = ends.agg(first, F.max("k").cast("bigint").alias("n"), F.collect_list(F.when(F.col("last"), F.col("key"))).alias("end"))
    texts = lines.where(full).select("doc_id", "line_no", X.title_key(F.col("text")).alias("key"))
    order = by.orderBy("line_no")
    after = [F.lead("key", k).over(order).alias(f"key{k}") for k in range(1, head)]
    held = texts.select("doc_id", "line_no", "key", F.row_number().over(order).alias("pos"), *after).join(heads, "doc_id")
    met = F.lit(0)
    for k in range(head - 1, -1, -1):
        met = F.when(F.get("heads", F.lit(k))["row"] == F.col(f"key{k}" if k else "key"), met + 1).otherwise(0)
    start = F.when((met >= 1) & (met >= F.least(F.lit(least), "n")), F.struct(met.cast("bigint").alias("rows_met"), (-F.col("pos")).alias("back"), F.col("line_no").alias("first_line")))
    told = held.select("doc_id", "line_no", "pos", start.alias("start"), (F.col("key") == F.get("end", F.lit(0))).alias("ends")).where("start is not null or ends")
    best = told.withColumn("b", F.max("start").over(by)).where("b is not null")
    tail = F.when(F.col("ends") & (F.col("pos") >= -F.col("b.back")), F.col("line_no"))
    found = best.groupBy("doc_id").agg(F.first("b").alias("b"), F.count(tail).alias("c"), F.max(tail).alias("end"))
    return found.select("doc_id", "b.first_line", "b.rows_met", F.when(F.col("c") == 1, F.col("end")).alias("last_line"))


#: Rows of the left that meet all of the right at a time.
MEETING = 256


def _meeting(least: float) -> Callable[..., Column]:
    """Of characters as bits and their numbers on both sides the pairs that may be alike,
    i * 2^32 + j: a bit that one alone has stands for one character or more that the
    other lacks."""

    def of(lb: np.ndarray, ln: np.ndarray, rb: np.ndarray, rn: np.ndarray) -> np.ndarray:
        out = []
        for i, (bits, n) in enumerate(zip(lb, ln)):
            own, other = np.bitwise_count(bits & ~rb).astype(np.int64), np.bitwise_count(rb & ~bits).astype(np.int64)
            enough = (1 + least) * np.minimum(n - own, rn - other) >= least * (n + rn) - 1e-9
            out.append((i << 32) | np.flatnonzero(enough | (own == 0) | (other == 0)))
        return np.concatenate([np.zeros(0, np.int64), *out])

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def pairs(lb: pd.Series, ln: pd.Series, rb: pd.Series, rn: pd.Series) -> pd.Series:
        bits = lambda x: np.asarray(x, np.int64).view(np.uint64)
        return pd.Series([of(bits(a), np.asarray(b, np.int64), bits(c), np.asarray(d, np.int64)) for a, b, c, d in zip(lb, ln, rb, rn)])

    return pairs


def _alike(left: DataFrame, right: DataFrame, by: list[str], least: float) -> DataFrame:
    """What alike_pairs() gives, with the keys as a and b. A group's keys are shuffled once
    and its pairs are found where they lie, by a bit for each character's hash and the
    number of characters."""

    def side(df: DataFrame, own: str) -> DataFrame:
        told = df.withColumn("c", F.filter(F.array_distinct(F.split("key", "")), lambda x: x != "")).where(F.size("c") > 0)
        bit = lambda c: F.element_at(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)]), (F.pmod(F.xxhash64(c), F.lit(64)) + 1).cast("int"))
        bits = F.aggregate("c", F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseOR(bit(c).cast("bigint")))
        return told.select(*by, F.struct(F.col(own).alias("own"), "key", bits.alias("bits"), F.size("c").cast("bigint").alias("n")).alias("x"))

    place = F.row_number().over(Window.partitionBy(*by).orderBy("x.own"))
    x = side(left, "l").withColumn("part", F.floor((place - 1) / MEETING)).groupBy(*by, "part").agg(F.collect_list("x").alias("x"))
    y = side(right, "r").groupBy(*by).agg(F.collect_list("x").alias("y"))
    met = x.join(y, by).withColumn("at", F.explode(_meeting(least)("x.bits", "x.n", "y.bits", "y.n")))
    met = met.select(*by, F.get("x", F.shiftright("at", 32).cast("int")).alias("x"), F.get("y", F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("y"))
    return met.select(*by, F.col("x.own").alias("l"), F.col("y.own").alias("r"), F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def alike_pairs(left: DataFrame, right: DataFrame, by: list[str], least: float) -> DataFrame:
    """(by, l, r): all pairs of rows (by, l, key) and (by, r, key) whose keys share
    `least` or more of their distinct characters, or of which one contains the other,
    and few others. Keys without characters meet nothing."""
    return _alike(left, right, by, least).select(*by, "l", "r")


def anchor_windows(lines: DataFrame, anchors: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, anchor, line_no, width, score): for each anchor (doc_id, anchor, k,
    text) of k lines the window of k to k + 2 lines that is most like it, of equal ones
    the earliest and then the narrowest, if it reaches `least`. Widths, punctuation and
    blanks do not count; lines without other characters are left out and not counted as
    lines of a window. Scores are compared to six digits. Either side is shuffled once, by
    document, and windows are told apart where their document lies."""
    group = lambda df, name, *own: df.select("doc_id", F.struct(*own, F.coalesce("text", F.lit("")).alias("text")).alias("x")).groupBy("doc_id").agg(F.collect_list("x").alias(name))
    left, right = group(anchors.where("k is not null"), "a", "anchor", "k"), group(lines, "l", "line_no")
    both = left.join(right.withColumn("l", F.sort_array("l")), "doc_id").select("doc_id", "a", "l")
    doc_id, anchor, k, line_no = both.schema["doc_id"], anchors.schema["anchor"], anchors.schema["k"], lines.schema["line_no"]
    schema = T.StructType([doc_id, anchor, line_no, T.StructField("width", k.dataType), T.StructField("score", T.DoubleType())])
    kinds = to_arrow_schema(schema)
    return both.mapInArrow(lambda batches: best_windows(batches, kinds, least), schema)


def short_lines(lines: DataFrame) -> DataFrame:
    """Lines that may be titles: 64 characters at most besides blanks, and no sentence mark."""
    return lines.where((F.length(X.stripped(F.col("text"))) <= 64) & ~F.col("text").rlike(X.SENTENCE) & (F.trim("text") != ""))


def anchor_candidates(entries: DataFrame, lines: DataFrame, most: int = 8, least: float = 0.4) -> DataFrame:
    """For each contents entry (doc_id, entry, from_line, title) its best lines at
    or after a start line: short, no sentence mark, similar enough, by score and then by
    line. Lines meet entries that have enough characters in common with them."""
    key = lambda df, own, text: df.select("doc_id", F.col(own).alias(own[0]), X.title_key(F.col(text)).alias("key"))
    left = key(entries.withColumnRenamed("entry", "l_"), "l_", "title")
    right = key(short_lines(lines).withColumnRenamed("line_no", "r_"), "r_", "text")
    told = _alike(left, right, ["doc_id"], least / 0.75)
    scored = told.withColumn("score", F.round(X.contents_similarity(F.col("a"), F.col("b")), 6)).where(F.col("score") >= least)
    known = scored.join(entries.select("doc_id", F.col("entry").alias("l"), "from_line"), ["doc_id", "l"]).where(F.col("r") >= F.col("from_line"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "l").orderBy(F.desc("score"), "r"))
    ranked = known.withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.select("doc_id", F.col("l").alias("entry"), F.col("r").alias("line_no"), "score", "rank")


def known_window(entries: DataFrame) -> DataFrame:
    """Between which known lines an entry's own must lie."""
    over = Window.partitionBy("doc_id").orderBy("entry")
    low = F.last("known", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    high = F.first("known", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    return entries.select("doc_id", "entry", (low + 1).alias("from_line"), high.alias("to_line"))


def lines_to_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The page whose span of characters holds each line's start. Line starts
    and page starts are merged in one ordered pass."""
    starts = lambda df, o: F.coalesce(F.sum("size").over(Window.partitionBy("doc_id").orderBy(o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    l = lines.select("doc_id", "line_no", F.length("text").alias("size")).withColumn("at", starts(None, "line_no"))
    p = pages.select("doc_id", "page", "size").withColumn("at", starts(None, "page"))
    both = l.select("doc_id", "at", F.lit(1).alias("kind"), "line_no", F.lit(None).cast("bigint").alias("page")).unionByName(p.select("doc_id", "at", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("line_no"), F.col("page").cast("bigint").alias("page")))
    over = Window.partitionBy("doc_id").orderBy("at", "kind", "page").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page", F.last("page", ignorenulls=True).over(over)).where("kind = 1").select("doc_id", "line_no", "page")


def fill_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines dealt to pages by text volume, blanks aside. Each page takes lines
    until they have as many characters as it has, and the next one begins at zero with
    the line after; pages without text get none, and lines that are left when all pages
    are full have page null. A document's lines are folded in order; what the fold keeps
    is where pages begin."""
    size = F.length(X.stripped(F.col("text"))).cast("bigint").alias("size")
    packed = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").cast("bigint").alias("line_no"), size))).alias("l"))
    wanted = pages.select("doc_id", F.col("page").cast("bigint").alias("page"), size).where("size > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "size"))).alias("p"))
    both = packed.join(wanted, "doc_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<page:bigint,size:bigint>>")))
    kind = "struct<turn:int,held:bigint,starts:array<struct<line_no:bigint,page:bigint>>>"

    def step(acc: Column, x: Column) -> Column:
        full = acc["held"] >= F.coalesce(F.get(F.col("p"), acc["turn"])["size"], F.lit(1 << 62))
        begins, turn = (acc["turn"] < 0) | full, acc["turn"] + 1
        start = F.array(F.struct(x["line_no"].alias("line_no"), F.get(F.col("p"), turn)["page"].alias("page")))
        opened = F.struct(turn.alias("turn"), x["size"].alias("held"), F.concat(acc["starts"], start).alias("starts")).cast(kind)
        return F.when(begins, opened).otherwise(F.struct(acc["turn"].alias("turn"), (acc["held"] + x["size"]).alias("held"), acc["starts"].alias("starts")).cast(kind))

    first = F.struct(F.lit(-1).alias("turn"), F.lit(0).cast("bigint").alias("held"), F.array().cast("array<struct<line_no:bigint,page:bigint>>").alias("starts")).cast(kind)
    starts = both.select("doc_id", F.explode(F.aggregate("l", first, step)["starts"]).alias("s")).select("doc_id", "s.line_no", F.struct("s.page").alias("start"))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select("doc_id", "line_no").join(starts, ["doc_id", "line_no"], "left")
    return marked.withColumn("start", F.last("start", ignorenulls=True).over(upto)).select("doc_id", "line_no", "start.page")


def merge_wrapped(tables: DataFrame, least: float = 0.8) -> DataFrame:
    """A row with one filled cell or fewer, or with less than `least` of the
    cells of the merged row above, continues it cell by cell. Rows are folded in
    order, as the row above is the merged one."""
    kind = "array<array<string>>"
    filled = lambda r: F.size(F.filter(r, lambda c: F.trim(c) != ""))

    def step(acc: Column, row: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.zip_with(last, row, lambda a, b: F.trim(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
        wraps = (filled(row) <= 1) | (filled(row) < least * filled(last))
        return F.when((F.size(acc) > 0) & wraps, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(row))).cast(kind)

    return tables.withColumn("rows", F.aggregate("rows", F.array().cast(kind), step))


def change_counts(diffs: DataFrame, group: str) -> DataFrame:
    """How many of each kind, and in all."""
    kinds = ["equal", "modified", "added", "deleted"]
    return diffs.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(F.col("diff_type") == k).alias(k) for k in kinds])
