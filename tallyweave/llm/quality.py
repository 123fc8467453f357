"""Quality rules with thresholds from mergeable quantile sketches.

Counts of each text are built-in column expressions. The thresholds are not fixed:
for each language and source a quantile sketch of every measure is kept, and a
document fails where a measure lies beyond a fence that its group's quantiles give.
A sketch is a table of counts in logarithmic buckets (as in DDSketch): each quantile
is right within RELATIVE, and sketches merge by adding counts, so those of a language
and of all documents come from the same counts. Into a group's sketch PRIOR documents of
its language's are merged, and into that one as many of all documents': this counts for
much in a small group and for little in a large one. The main path has DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize, without

#: Relative error of a quantile.
RELATIVE = 0.005
#: Documents of the larger group that each smaller one borrows.
PRIOR = 50
#: Groups whose thresholds are broadcast at most.
BROADCAST_ROWS = 50_000

# Fixed values of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

#: Measures per thousand words (duplicate lines per ten thousand; word length in
#: thousandths of a character). A fence lies `times` the distance of the low and the
#: high quantile beyond the high one, and for two-sided measures as far below the low
#: one. `least` is the distance where both quantiles are equal or nearly so. Rates that
#: are zero for most documents are fenced from their upper quantiles; those of symbols
#: from a lower one, as the poor documents themselves make up the last of it.
MEASURES = {
    "symbol_rate": {"low": 0.5, "high": 0.75, "times": 6, "least": 20, "both": False},
    "repeat_rate": {"low": 0.9, "high": 0.99, "times": 3, "least": 50, "both": False},
    "dup_line_rate": {"low": 0.9, "high": 0.99, "times": 3, "least": 50, "both": False},
    "word_length": {"low": 0.25, "high": 0.75, "times": 4, "least": 200, "both": True},
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def _repeated(hashes: Column) -> Column:
    """Words in windows of WINDOW words that stand twice or more, from the words'
    hashes. Windows are compared by 64-bit hashes. After sorting by window, equal
    neighbours repeat; their places in order then cover up to WINDOW words each."""
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(WINDOW)]))

    def places(seen: Column) -> Column:
        numbered = F.array_sort(F.transform(seen, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(order: Column) -> Column:
            same = F.transform(order, lambda x, k: F.when((x["h"] == F.get(order, k - 1)["h"]) | (x["h"] == F.get(order, k + 1)["h"]), x["i"]))
            return F.array_sort(F.filter(same, lambda i: i.isNotNull()))

        return _let(numbered, again)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(seen: Column) -> Column:
        return F.when(F.size(F.array_distinct(seen)) == F.size(seen), F.lit(0).cast("bigint")).otherwise(_let(places(seen), covered))

    return F.when(F.size(hashes) > WINDOW, _let(windows, count)).otherwise(F.lit(0).cast("bigint"))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars (code points in words), n_symbols, n_dup_lines
    (lines with a word that equal an earlier line) and n_repeat_words (words in
    windows of eight that stand twice or more). A null text has no words."""
    given = F.coalesce(F.col(text), F.lit(""))
    hashes = F.transform(_nonempty(F.split(given, _SPACE)), lambda w: F.xxhash64(w))
    packed = _let(hashes, lambda h: F.struct(F.size(h).cast("bigint").alias("n"), _repeated(h).alias("r")))
    out = without(docs, [*COUNTS, "__seen"]).withColumn("__seen", packed)
    made = {
        "n_words": F.col("__seen.n"),
        "word_chars": F.length(F.regexp_replace(given, _SPACE, "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(given, r"[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": _dup_lines(given),
        "n_repeat_words": F.col("__seen.r"),
    }
    return out.withColumns(made).drop("__seen")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    per = lambda col: F.expr(f"cast({col} * 1000 div greatest(n_words, 1) as bigint)")
    return {"symbol_rate": per("n_symbols"), "repeat_rate": per("n_repeat_words"), "dup_line_rate": per("n_dup_lines * 10"), "word_length": (F.col("word_chars") * 1000 / words).cast("bigint")}


def sketch(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, bucket, n): bucket counts of every measure in each group.
    Value x lies in bucket ceil(log(x + 1) to the base gamma). Sketches of larger
    groups come from adding counts."""
    gamma = math.log((1 + RELATIVE) / (1 - RELATIVE))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.ceil(F.log(F.col(m) + F.lit(1.0)) / F.lit(gamma)).alias("bucket")) for m in MEASURES]))
    return measured.select(*groups, pairs.alias("p")).groupBy(*groups, "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def _merged(own: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, upto, total): running counts of each group's
    sketch into which PRIOR documents of its language's sketch are merged, and into that
    as many of all documents'. Counts are merged and not quantiles, so one outlier of a
    small group counts as one document and no more. Running counts are whole numbers; the
    shares of larger groups come in at the end."""
    by_lang = own.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    of_all = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))

    def running(groups: DataFrame, sketched: DataFrame, by: list[str], mark: str) -> DataFrame:
        """The groups at every bucket that any document has, with what lies up to it."""
        keys = [*by, "measure", "bucket"]
        some = sketched.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("n").alias("__n"))
        same = [groups[c].eqNullSafe(some[f"__{c}"]) for c in keys]
        joined = groups.join(some, reduce(lambda x, y: x & y, same), "left").drop(*[f"__{c}" for c in keys])
        over = Window.partitionBy(*by, "measure")
        upto = F.coalesce(F.sum("__n").over(over.orderBy("bucket")), F.lit(0))
        return joined.select("*", upto.alias(f"{mark}_upto"), F.coalesce(F.sum("__n").over(over), F.lit(0)).alias(f"{mark}_n")).drop("__n")

    buckets = running(of_all.select("measure", "bucket"), of_all, [], "all")
    langs = by_lang.select("lang", "measure").distinct().join(F.broadcast(buckets), "measure")
    langs = running(langs, by_lang, ["lang"], "lang")
    groups = own.select("lang", "source", "measure").distinct().withColumnsRenamed({"lang": "__l", "measure": "__m"})
    groups = groups.join(langs, groups["__l"].eqNullSafe(langs["lang"]) & (groups["__m"] == langs["measure"])).drop("__l", "__m")
    groups = running(groups, own, ["lang", "source"], "own")
    larger = (F.col("lang_upto") + PRIOR * (F.col("all_upto") / F.col("all_n"))) / (F.col("lang_n") + PRIOR)
    return groups.select("lang", "source", "measure", "bucket", (F.col("own_upto") + PRIOR * larger).alias("upto"), (F.col("own_n") + PRIOR).alias("total"))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, most_m for each measure m, least_m for two-sided ones, floor_m):
    the range that each measure may take in each group, and whether `least` set it.
    Quantiles are the values at which a group's merged sketch first reaches a share."""
    own = materialize(sketch(measured, ["lang", "source"]))
    gamma = (1 + RELATIVE) / (1 - RELATIVE)
    value = F.when(F.col("bucket") <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(gamma), F.col("bucket")) * (1 - RELATIVE) - 1)
    of = lambda key: F.coalesce(*[F.when(F.col("measure") == m, F.lit(float(v[key]))) for m, v in MEASURES.items()])
    first = lambda side: F.min(F.when(F.col("upto") >= of(side) * F.col("total"), value)).alias(side)
    drawn = _merged(own).groupBy("lang", "source", "measure").agg(first("low"), first("high"))
    spread, least = of("times") * (F.col("high") - F.col("low")), of("least")
    far = F.greatest(spread, least)
    fences = drawn.select("*", F.round(F.col("high") + far, 3).alias("most"), F.round(F.col("low") - far, 3).alias("fewest"), (spread < least).alias("floor"))
    pick = lambda col, m: F.max(F.when(F.col("measure") == m, F.col(col)))
    sides = [pick("most", m).alias(f"most_{m}") for m in MEASURES] + [pick("fewest", m).alias(f"least_{m}") for m, v in MEASURES.items() if v["both"]]
    return fences.groupBy("lang", "source").agg(*sides, *[pick("floor", m).alias(f"floor_{m}") for m in MEASURES])


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, less the text, with the counts, the measures in thousandths, base_failed
    and kept: false where a base rule fails or a measure lies beyond its group's fences.

    A null language or source is a group like any other. Rows that fail a base rule
    take no part in the sketches. Ties lie within the fence; repeated rows count each
    time; an empty table gives no rows."""
    sides = [f"{side}_{m}" for m in MEASURES for side in ("most", "least", "floor")]
    named = without(docs, ["base_failed", "kept", "__lang", "__source", *MEASURES, *sides])
    measured = materialize(counts(named, text).drop(text).withColumns(_measures()))
    fences = materialize(thresholds(measured.where(~base_failed())))
    few = fences.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    f = fences.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = measured.join(F.broadcast(f) if few else f, measured["lang"].eqNullSafe(f["__lang"]) & measured["source"].eqNullSafe(f["__source"]), "left")
    inside = F.lit(True)
    for m, v in MEASURES.items():
        inside = inside & F.coalesce(F.col(m) <= F.col(f"most_{m}"), F.lit(True))
        if v["both"]:
            inside = inside & F.coalesce(F.col(m) >= F.col(f"least_{m}"), F.lit(True))
    return joined.drop("__lang", "__source", *[f"floor_{m}" for m in MEASURES]).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)
