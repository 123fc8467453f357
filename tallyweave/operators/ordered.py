"""Ordered processing of document lines: headings to sections, regions, pages.

All windows of a step share one partitioning and order, so a document's lines are
shuffled once. (doc_id, line_no) names a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyweave.functions import text as X


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def _upto() -> WindowSpec:
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def _before() -> WindowSpec:
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def headings(lines: DataFrame) -> DataFrame:
    """Lines with `class`, `level` (null for text), the open heading of
    each level, section (the line's own or last heading) and parent. A heading
    closes deeper ones; H3 needs an open H1 or H2 and H4 any open heading, else the
    line is text."""
    work = lines.withColumn("class", X.line_class(F.col("text"), is_table=F.col("is_table")))
    seen = lambda k: F.max(F.when(F.col("class") == k, F.col("line_no")))
    work = work.withColumn("__shallow", F.greatest(seen("H1").over(_before()), seen("H2").over(_before())).isNotNull())
    work = work.withColumn("level", F.when(F.col("class") == "H1", 1).when(F.col("class") == "H2", 2).when((F.col("class") == "H3") & F.col("__shallow"), 3))
    work = work.withColumn("__any", F.max(F.when(F.col("level").isNotNull(), F.col("line_no"))).over(_before()).isNotNull())
    work = work.withColumn("level", F.when((F.col("class") == "H4") & F.col("__any"), 4).otherwise(F.col("level"))).drop("__shallow", "__any")
    for k in range(1, 5):
        work = work.withColumn(f"__l{k}", F.max(F.when(F.col("level") == k, F.col("line_no"))).over(_upto()))
    last = F.greatest(*[F.col(f"__l{k}") for k in range(1, 5)])
    shallower = F.when(F.col("level") == 2, F.col("__l1")).when(F.col("level") == 3, F.greatest("__l1", "__l2")).when(F.col("level") == 4, F.greatest("__l1", "__l2", "__l3"))
    out = work.withColumn("section", last).withColumn("parent", F.when(F.col("level").isNotNull(), shallower).otherwise(last))
    return out.drop(*[f"__l{k}" for k in range(1, 5)])


def sections(headed: DataFrame) -> DataFrame:
    """One row of each heading: preorder number, parent, level, title,
    and the text of its own lines in order."""
    own = headed.where("section is not null and level is null").groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    body = own.select("doc_id", F.col("section").alias("line_no"), F.array_join(F.col("l.text"), "\n").alias("body"))
    heads = headed.where("level is not null").select("doc_id", "line_no", "parent", "level", F.trim("text").alias("title"), F.row_number().over(_doc()).alias("order_index"))
    return heads.join(body, ["doc_id", "line_no"], "left").withColumn("body", F.coalesce("body", F.lit("")))


def monotone_topics(headed: DataFrame) -> DataFrame:
    """H2 lines whose ordinal exceeds all earlier ones under the same H1."""
    h1 = F.max(F.when(F.col("level") == 1, F.col("line_no"))).over(_upto())
    ordinal = F.when(F.col("level") == 2, X.numeral(F.regexp_extract("text", X.H2, 1)))
    work = headed.select("doc_id", "line_no", "level", "text", h1.alias("h1"), ordinal.alias("ordinal")).where("level = 2")
    over = Window.partitionBy("doc_id", "h1").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return work.withColumn("accepted", F.coalesce(F.col("ordinal") > F.max("ordinal").over(over), F.lit(True))).select("doc_id", "line_no", "ordinal", "accepted")


def pages(lines: DataFrame) -> DataFrame:
    """Page numbers from break flags; a break on the first line does not count."""
    first = F.row_number().over(_doc()) == 1
    return lines.withColumn("__b", (F.col("page_break") & ~first).cast("int")).withColumn("page", F.sum("__b").over(_upto()) + 1).drop("__b")


def blocks(lines: DataFrame, marker: Column, scope: Column) -> DataFrame:
    """Lines of each block that a marker opens; lines before the first are
    dropped. A scope note holds for the later lines of its block."""
    work = lines.withColumn("block", F.sum(marker.cast("int")).over(_upto())).where("block > 0")
    over = Window.partitionBy("doc_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return work.withColumn("scope", F.last(scope, ignorenulls=True).over(over))


def join_index_lines(lines: DataFrame, bare: Column, usable) -> DataFrame:
    """A bare index line joined to the next one, if the joined text is usable."""
    joined = F.concat_ws(" ", "text", F.lead("text").over(_doc()))
    takes = bare & F.lead("text").over(_doc()).isNotNull() & usable(joined)
    work = lines.withColumn("__takes", takes).withColumn("__joined", joined)
    work = work.withColumn("__eaten", F.coalesce(F.lag("__takes").over(_doc()), F.lit(False)) & ~F.col("__takes"))
    return work.where(~F.col("__eaten")).withColumn("text", F.when(F.col("__takes"), F.col("__joined")).otherwise(F.col("text"))).drop("__takes", "__joined", "__eaten")


def regions(lines: DataFrame) -> DataFrame:
    """The region of each line: contents from their title to a table,
    a glossary title or the second blank after it, glossary from its title to the
    next H1, else main."""
    work = lines.withColumn("class", X.line_class(F.col("text"), is_table=F.col("is_table")))
    toc = F.max(F.when(F.col("class") == "TOCTitle", F.col("line_no"))).over(_upto())
    work = work.withColumn("__toc", toc)
    since = Window.partitionBy("doc_id", "__toc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ended = (F.count_if(F.col("class") == "BLANK").over(since) >= 2) | (F.count_if(F.col("class").isin("Table", "GlossaryTitle")).over(since) > 0)
    mark = F.when(F.col("class") == "GlossaryTitle", "g").when(F.col("class") == "H1", "h")
    work = work.withColumn("__in", F.col("__toc").isNotNull() & ~ended).withColumn("__mark", F.last(mark, ignorenulls=True).over(_upto()))
    return work.withColumn("region", F.when(F.col("__in"), "toc").when(F.col("__mark") == "g", "glossary").otherwise("main")).drop("__toc", "__in", "__mark")


#: A line number behind all lines.
_END = (1 << 62) - 1


def with_subtrees(sections_: DataFrame) -> DataFrame:
    """Sections with `until`, the line of the next section that is not below: a section
    lies in another's subtree if its line is after that one's and before its `until`."""
    later = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(later) for k in range(1, 5)]
    until = F.coalesce(*[F.when(F.col("level") == k, e) for k, e in enumerate(ends, 1)], F.lit(_END))
    return sections_.withColumn("until", until.cast("bigint"))


def with_parents(sections_: DataFrame) -> DataFrame:
    """Sections with `parent`, the last section before that is less deep: of what
    headings() gives it is the same, and where a parent was dropped from the table, what
    lay below it belongs to the next section above."""
    above = [F.max(F.when(F.col("level") < k, F.col("line_no"))).over(_before()) for k in range(1, 5)]
    parent = F.coalesce(*[F.when(F.col("level") == k, e) for k, e in enumerate(above, 1)])
    return sections_.withColumn("parent", parent)


def with_ancestors(sections_: DataFrame, own: str) -> DataFrame:
    """What with_subtrees() gives, with up: the `own` column of the ancestors, outermost
    first. They are carried down the document, section after section."""
    work = sections_
    for k in range(1, 4):
        work = work.withColumn(f"__a{k}", F.last(F.when(F.col("level") == k, F.struct("until", F.col(own).alias("own"))), ignorenulls=True).over(_before()))
    above = [F.when((F.col("level") > k) & (F.col(f"__a{k}.until") > F.col("line_no")), F.col(f"__a{k}.own")) for k in range(1, 4)]
    return work.withColumn("up", F.array_compact(F.array(*above))).drop("__a1", "__a2", "__a3")


def collapse_titles(sections_: DataFrame) -> DataFrame:
    """W14, over a whole document: of neighbours with the same level and title key the one with the longest
    text stays (ties: the first). A neighbour is compared with the one before it."""
    over = Window.partitionBy("doc_id").orderBy("line_no")
    key = X.title_key(F.col("title"))
    breaks = ~((F.lag(key).over(over) == key) & (F.lag("level").over(over) == F.col("level")))
    island = F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    work = sections_.withColumn("__island", island)
    best = F.max_by(F.struct(*sections_.columns), F.struct(F.length("body"), F.length("title"), -F.col("line_no")))
    return work.groupBy("doc_id", "__island").agg(best.alias("r")).select("r.*")


def collapse_siblings(sections_: DataFrame) -> DataFrame:
    """Of neighbouring siblings that have the anchor of the first of them (equal
    level, no other number, one title within the other) the best stays: most children,
    then the longest text, then the longest title, then the first. What lies below a
    section that goes, goes with it. Siblings are folded in order with the first of the
    open group as state, as the third of them may differ from it and not from the second."""
    row = "struct<line_no:bigint,level:int,key:string,hint:string>"
    children = sections_.where("parent is not null").groupBy("doc_id", F.col("parent").alias("line_no")).agg(F.count("*").alias("__children"))
    work = sections_.join(children, ["doc_id", "line_no"], "left").withColumns({"__children": F.coalesce("__children", F.lit(0)), "__parent": F.coalesce("parent", F.lit(-1))})
    told = F.struct(F.col("line_no").cast("bigint").alias("line_no"), F.col("level").cast("int").alias("level"), X.title_key(F.col("title")).alias("key"), X.number_hint(F.col("title")).alias("hint"))
    packed = work.groupBy("doc_id", "__parent").agg(F.array_sort(F.collect_list(told)).alias("x"))

    def step(acc: Column, x: Column) -> Column:
        head = acc["head"]
        alike = (head["level"] == x["level"]) & (head["key"] != "") & (x["key"] != "") & (F.contains(head["key"], x["key"]) | F.contains(x["key"], head["key"])) & ~F.coalesce(head["hint"] != x["hint"], F.lit(False))
        return F.when(F.coalesce(alike, F.lit(False)), acc).otherwise(F.struct(x.alias("head"), F.concat(acc["starts"], F.array(x["line_no"])).alias("starts")).cast(kind))

    kind = f"struct<head:{row},starts:array<bigint>>"
    first = F.struct(F.lit(None).cast(row).alias("head"), F.array().cast("array<bigint>").alias("starts")).cast(kind)
    starts = packed.select("doc_id", "__parent", F.explode(F.aggregate("x", first, step)["starts"]).alias("line_no")).withColumn("__start", F.lit(1))
    siblings = Window.partitionBy("doc_id", "__parent").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = work.join(starts, ["doc_id", "__parent", "line_no"], "left").withColumn("__group", F.count("__start").over(siblings))
    best = Window.partitionBy("doc_id", "__parent", "__group").orderBy(F.desc("__children"), F.desc(F.length("body")), F.desc(F.length("title")), "line_no")
    gone = with_subtrees(grouped.withColumn("__gone", F.row_number().over(best) > 1)).withColumn("__under", F.max(F.when(F.col("__gone"), F.col("until"))).over(_before()))
    return gone.where("not __gone and (__under is null or __under <= line_no)").select(*sections_.columns)


def merge_split_headings(headed: DataFrame) -> DataFrame:
    """An H1 without a title of its own takes the next line as its
    title; an H1 equal to the running one is dropped."""
    empty = (F.col("class") == "H1") & (F.regexp_replace(F.trim("text"), X.H1, "") == "")
    work = headed.withColumn("__empty", empty).withColumn("__next", F.lead("text").over(_doc()))
    work = work.withColumn("text", F.when(F.col("__empty"), F.concat_ws(" ", F.trim("text"), F.trim("__next"))).otherwise(F.col("text")))
    work = work.withColumn("__eaten", F.coalesce(F.lag("__empty").over(_doc()), F.lit(False))).where(~F.col("__eaten"))
    running = F.last(F.when(F.col("class") == "H1", X.title_key(F.col("text"))), ignorenulls=True).over(_before())
    return work.withColumn("__again", (F.col("class") == "H1") & F.coalesce(running == X.title_key(F.col("text")), F.lit(False))).where(~F.col("__again")).drop("__empty", "__next", "__eaten", "__again")


def number_labels(rows: DataFrame) -> DataFrame:
    """A row of a lone number joined to the oldest waiting label; a row with both
    empties the waiting list, and a number that finds it empty stands alone. Of the
    numbers so far those that stood alone are the most by which numbers ever outran
    labels, so the k-th of the others meets the k-th label."""
    kind = F.when(F.trim("text").rlike("^[0-9.,]+$"), "n").when(F.col("text").rlike("[0-9]"), "m").otherwise("l")
    work = rows.withColumn("__kind", kind).withColumn("__island", F.count_if(F.col("__kind") == "m").over(_upto())).where("__kind <> 'm'")
    over = Window.partitionBy("doc_id", "__island").orderBy("line_no")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumns({"__l": F.count_if(F.col("__kind") == "l").over(upto), "__n": F.count_if(F.col("__kind") == "n").over(upto)})
    work = work.withColumn("__alone", F.greatest(F.lit(0), F.max(F.col("__n") - F.col("__l")).over(upto)))
    work = work.withColumn("__met", F.col("__alone") == F.coalesce(F.lag("__alone").over(over), F.lit(0)))
    label = work.where("__kind = 'l'").select("doc_id", "__island", F.col("__l").alias("__k"), F.col("line_no").alias("label_line"))
    number = work.where("__kind = 'n' and __met").select("doc_id", "__island", (F.col("__n") - F.col("__alone")).alias("__k"), F.col("line_no").alias("number_line"))
    return label.join(number, ["doc_id", "__island", "__k"]).select("doc_id", "label_line", "number_line")


def strip_around_tables(lines: DataFrame, most: int = 3000) -> DataFrame:
    """Text lines after each table until the next one, while fewer than `most`
    characters came before them."""
    table = F.max(F.when(F.col("is_table"), F.col("line_no"))).over(_upto())
    work = lines.withColumn("table_line", table).where("not is_table and table_line is not null")
    over = Window.partitionBy("doc_id", "table_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return work.withColumn("__before", F.coalesce(F.sum(F.length("text")).over(over), F.lit(0))).where(F.col("__before") <= most).drop("__before")


def table_strips(lines: DataFrame, most: int = 3000) -> DataFrame:
    """W17 on both sides: (doc_id, table_line, side, line_no): the text lines between a
    table and the one before it (`before`) and the one after it (`after`), before the
    first and after the last as well. A stretch is read from its beginning and ends with
    the line at which it has more than `most` characters; blank lines do not count. Each
    stretch is measured once and belongs to the tables on both sides."""
    gap = F.count_if("is_table").over(_upto())
    text = F.trim("text")
    work = lines.select("doc_id", "line_no", "is_table", text.alias("text"), gap.alias("__gap"))
    over = Window.partitionBy("doc_id", "__gap").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    strip = work.where("not is_table and text <> ''").withColumn("__before", F.coalesce(F.sum(F.length("text")).over(over), F.lit(0))).where(F.col("__before") <= most)
    sides = F.explode(F.array(F.struct(F.lit("after").alias("side"), F.col("__gap").alias("table")), F.struct(F.lit("before").alias("side"), (F.col("__gap") + 1).alias("table")))).alias("s")
    tables = work.where("is_table").select("doc_id", F.col("__gap").alias("table"), F.col("line_no").alias("table_line"))
    return strip.select("doc_id", "line_no", sides).select("doc_id", "line_no", "s.*").join(tables, ["doc_id", "table"]).select("doc_id", "table_line", "side", "line_no")


def slice_between(lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """Lines from the start anchor to before the end anchor after it, with new
    line and table numbers; without a start from the first line, without an end to
    the last."""
    first = F.coalesce(F.min(F.when(start, F.col("line_no"))).over(Window.partitionBy("doc_id")), F.lit(0))
    work = lines.withColumn("__first", first).withColumn("__end", end & (F.col("line_no") > F.col("__first")))
    stop = F.min(F.when(F.col("__end"), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    kept = work.withColumn("__stop", stop).where("line_no >= __first and (__stop is null or line_no < __stop)")
    return kept.withColumn("new_line", F.row_number().over(_doc()) - 1).withColumn("table_no", F.count_if(F.col("is_table")).over(_upto())).drop("__first", "__end", "__stop")


def repeated_margins(paged: DataFrame, pages_seen: int = 5) -> DataFrame:
    """Header and footer of each document, from the first and last lines of its
    first pages (the rule itself looks at no more). The header is the key whose line is
    like the first lines of at least 60 % of these pages, two at least (similarity .90
    or more); the footer is the most frequent template (digits become #) of short last
    lines with a digit, on at least half of the pages. Of equal ones the first page's."""
    edge = paged.where(F.col("page") <= pages_seen).groupBy("doc_id", "page").agg(F.min_by("text", "line_no").alias("first"), F.max_by("text", "line_no").alias("last"))
    total = edge.groupBy("doc_id").agg(F.count("*").alias("pages"))
    share = lambda part: F.greatest(F.lit(2), F.floor(part * F.col("pages")))
    best = F.max_by(F.struct("key", "n"), F.struct("n", -F.col("page")))
    keyed = edge.select("doc_id", "page", X.margin_key(F.col("first")).alias("key"))
    other = keyed.select("doc_id", F.col("key").alias("other"))
    like = keyed.where("key <> ''").join(other, "doc_id").groupBy("doc_id", "page", "key").agg(F.count_if(X.margin_similarity(F.col("key"), F.col("other")) >= 0.9).alias("n"))
    header = like.join(total, "doc_id").where(F.col("n") >= share(0.6)).groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.lit("header").alias("kind"), "b.key", "b.n")
    short = edge.where((F.length(F.trim("last")) <= 40) & F.col("last").rlike("[0-9]")).select("doc_id", "page", X.margin_template(F.col("last")).alias("key"))
    often = short.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("page").alias("page")).groupBy("doc_id").agg(best.alias("b"))
    footer = often.join(total, "doc_id").where(F.col("b.n") >= share(0.5)).select("doc_id", F.lit("footer").alias("kind"), "b.key", "b.n")
    return header.unionByName(footer)


def drop_margins(paged: DataFrame, margins: DataFrame) -> DataFrame:
    """Lines that are no margin of their document and no bare page number."""
    keyed = paged.withColumns({"__header": X.margin_key(F.col("text")), "__footer": X.margin_template(F.col("text"))})
    of = lambda kind: margins.where(F.col("kind") == kind).select("doc_id", F.col("key").alias(f"__{kind}"))
    return keyed.join(of("header"), ["doc_id", "__header"], "left_anti").join(of("footer"), ["doc_id", "__footer"], "left_anti").where(~F.trim("text").rlike(r"^[-—\s]*[0-9]+[-—\s]*$")).select(*paged.columns)
