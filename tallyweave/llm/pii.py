"""Personal data: generators propose, boosted trees choose.

Four base patterns with their checks give spans that always stay. Wider generators
propose further, overlapping candidates: numbers in national formats, spelled-out
addresses and the like; matches of a base pattern that fail its check are candidates
as well. Every candidate has features of its format and of the text around it, and
evidence that is no feature: whether its digits or letters can be right (check sums,
ranges, numbering plans). Trees learn from all documents how often the evidence holds
for which format and context; counts of all feature combinations are enough for that.
Thresholds are calibrated, a kind each, on the half of the documents that the trees
have not seen, and alone choose among the candidates. Patterns, features, trees and
redaction are built-in expressions; only the table of counts, of bounded size, comes
to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import column, without

KINDS = ["email", "ip", "card", "phone"]

# The base patterns. Quantifiers are possessive where the next part
# cannot begin inside the run, and a run is entered at its start only (or where the
# last match ended), so that long runs take linear time; the matches are the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Generators of further candidates, by kind.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:@[a-z0-9-]{1,63}+(?![.a-z0-9-])|\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[a-z0-9-]{1,63}+){1,4})",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[.\x20-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z.-])",
}

#: What a text holds wherever a pattern matches, so that most texts need no search.
_DIGIT = r"[0-9]"
HINTS = {
    True: {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(_DIGIT), "phone": lambda t: t.contains("+")},
    False: {"email": lambda t: t.contains("@") | t.contains("[") | t.contains("("), "ip": lambda t: t.contains(":") & t.rlike(_DIGIT + "|:[0-9A-Fa-f]+:"), "card": lambda t: t.rlike(r"[0-9]{4}[.\x20-][0-9]{4}"), "phone": lambda t: t.rlike(r"[0-9]{3}[.\x20-][0-9]{4}")},
}

#: Words before a candidate that speak for its kind, and words that speak against any.
NEAR = {"email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|address|host|server", "card": r"(?i)card|visa|credit|pay", "phone": r"(?i)phone|tel|call|mobile|fax"}
AGAINST = r"(?i)version|token|isbn|serial|order|invoice|\bid\b|=\s*\W?$"
#: Characters before a candidate that count as its neighbourhood.
AROUND = 24
#: Digits of a candidate, at least and at most, by kind.
DIGITS = {"card": (14, 19), "phone": (10, 15)}

#: Bins of each feature; their product bounds the table of counts.
FEATURES = {"kind": 4, "wide": 2, "digits": 8, "marks": 4, "before": 4, "after": 4, "near": 2, "against": 2}
#: Trees, learning rate, the precision that a threshold must reach, and wrong rows that
#: are added to those it is measured on.
TREES, RATE, PRECISE, DOUBT = 32, 0.5, 0.9, 0.5
#: A threshold that no candidate reaches, and the fold of base spans.
NEVER, BASE_FOLD = 2.0, 2

CANDIDATE = "array<struct<start:bigint,end:bigint,base:boolean,right:boolean,kind:int,wide:int,digits:int,marks:int,before:int,after:int,near:int,against:int>>"
_PLACED = "array<struct<start:bigint,end:bigint,found:string>>"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def placed(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost first and not overlapping, with their code
    point offsets: the lengths of matches and of the parts between add up."""
    parts = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), parts.alias("p"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_PLACED).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        more = F.when(x["m"].isNotNull(), F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("found")))).otherwise(F.array().cast(_PLACED))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], more).cast(_PLACED).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_PLACED))


def _only_digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' check sum is right."""

    def worth(c: Column, i: Column) -> Column:
        twice = F.when(i % 2 == 1, 2 * c.cast("int")).otherwise(c.cast("int"))
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    """The check of a base pattern."""
    digits = F.length(_only_digits(found))
    if kind == "ip":
        part = lambda x: _let(F.ltrim(x, F.lit("0")), lambda y: (F.length(y) < 3) | ((F.length(y) == 3) & (y <= "255")))
        return F.forall(F.split(found, r"\."), part)
    if kind == "card":
        return F.when(digits.between(14, 19), luhn(_only_digits(found))).otherwise(F.lit(False))
    return digits.between(10, 15) if kind == "phone" else F.lit(True)


def _evidence(kind: str, found: Column) -> Column:
    """Whether a candidate's digits or letters can be right: parts of an address in
    their range, a card's check sum, a number that a numbering plan allows, a domain
    that ends in letters. Null where nothing tells."""
    if kind == "ip":
        return F.when(~found.contains(":"), _passes("ip", found))
    if kind == "card":
        return luhn(_only_digits(found))
    if kind == "email":
        return F.regexp_replace(found, r"(?i)\x20?[\[(]dot[\])]\x20?", ".").rlike(r"\.[A-Za-z]{2,}$")
    number = F.regexp_replace(_only_digits(found), "^1(?=[0-9]{10}$)", "")
    return F.when(F.length(number) == 10, number.rlike("^[2-9][0-9]{2}[2-9]")).otherwise(number.rlike("^[2-9]"))


def _class_of(char: Column) -> Column:
    return F.when(char.rlike(r"^\s?$"), 0).when(char.rlike("^[A-Za-z]"), 1).when(char.rlike("^[0-9]"), 2).otherwise(3)


def candidates(text: Column) -> Column:
    """All candidates of a text, with their features. A null text has none."""
    text = F.coalesce(text, F.lit(""))

    def described(kind: str, base: bool):
        least, most = DIGITS.get(kind, (0, 1 << 30))

        def describe(x: Column) -> Column:
            n = F.length(_only_digits(x["found"]))
            bins = F.when(n == 0, 0).when(n < 6, 1).when(n < 10, 2).when(n < 12, 3).when(n < 14, 4).when(n < 17, 5).when(n < 20, 6).otherwise(7)
            marks = F.when(x["found"].contains("("), 2).when(x["found"].contains("."), 3).when(x["found"].rlike("[ -]"), 1).otherwise(0)
            prior = F.substring(text, (F.greatest(x["start"] - AROUND, F.lit(0)) + 1).cast("int"), F.least(x["start"], F.lit(AROUND)).cast("int"))
            later = F.substring(text, (x["end"] + 1).cast("int"), F.lit(1))
            return F.struct(
                x["start"].alias("start"),
                x["end"].alias("end"),
                (_passes(kind, x["found"]) if base else F.lit(False)).alias("base"),
                F.when(n.between(least, most), _evidence(kind, x["found"])).alias("right"),
                F.lit(KINDS.index(kind)).alias("kind"),
                F.lit(int(not base)).alias("wide"),
                bins.alias("digits"),
                marks.alias("marks"),
                _class_of(F.substring(prior, -1, 1)).alias("before"),
                _class_of(later).alias("after"),
                prior.rlike(NEAR[kind]).cast("int").alias("near"),
                prior.rlike(AGAINST).cast("int").alias("against"),
            )

        def likely(x: Column) -> Column:
            return F.length(_only_digits(x["found"])).between(least, most)

        return lambda places: F.transform(F.filter(places, likely) if kind in DIGITS else places, describe).cast(CANDIDATE)

    none = F.array().cast(CANDIDATE)
    made = [F.when(HINTS[base][k](text), described(k, base)(placed(text, pattern))).otherwise(none) for base, of in ((True, BASE), (False, WIDE)) for k, pattern in of.items()]
    return F.concat(*made)


def _overlap(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def with_candidates(docs: DataFrame, text: str = "text", name: str = "__cand") -> DataFrame:
    """docs with a column of all candidates, and __fold, which a hash of the text draws."""
    return docs.withColumns({name: candidates(column(text)), "__fold": F.pmod(F.xxhash64(column(text)), F.lit(2)).cast("int")})


def count_features(found: DataFrame, name: str = "__cand") -> list[tuple]:
    """(fold, features, rows, positive) for every combination of features among the
    candidates of with_candidates() that evidence tells of, those left out that overlap a
    base span of another candidate. Folds 0 and 1 have what select() can refuse; base
    spans, which it never judges, are fold BASE_FOLD."""
    alone = lambda c: F.filter(c, lambda x: x["right"].isNotNull() & (x["base"] | ~F.exists(c, lambda y: y["base"] & _overlap(x, y))))
    one = found.where(F.size(name) > 0).select("__fold", F.explode(_let(F.col(name), alone)).alias("x"))
    fold = F.when(F.col("x.base"), BASE_FOLD).otherwise(F.col("__fold")).alias("fold")
    rows = one.groupBy(fold, *[F.col(f"x.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.count_if("x.right").alias("positive"))
    return [tuple(r) for r in rows.collect()]


class Trees:
    """Boosted trees of depth two over binned features. A tree is (feature, bin,
    left, right) with values in its leaves; rows with at most `bin` go left."""

    def __init__(self) -> None:
        self.start = -2.0
        self.trees: list[tuple] = []
        self.least = {k: NEVER for k in KINDS}


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(RATE * g.sum() / (h.sum() + 1.0))


def _cut(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
    """The split with the largest gain."""
    best, found = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for b in np.unique(x[:, f])[:-1].tolist():
            left = x[:, f] <= b
            gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - whole
            if gain > best:
                best, found = gain, (f, b)
    return found


def _predict(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    f, b, left, right = node
    return np.where(x[:, f] <= b, _predict(left, x), _predict(right, x))


def fit(counts: list[tuple]) -> Trees:
    """Trees from the counts of fold 0 and of base spans, thresholds from those of fold 1,
    which can all be refused (of fold 0, where that is empty): for each kind the lowest score from which on PRECISE of the rows are right, DOUBT wrong ones added,
    so that a few rows prove nothing; and NEVER where no score reaches that. Rows of equal
    score go together."""
    made = Trees()
    table = np.array(counts, np.float64).reshape(-1, len(FEATURES) + 3)
    fold, x, n, y = table[:, 0], table[:, 1:-2], table[:, -2], table[:, -1]
    own = fold != 1 if (fold != 1).any() else np.ones(len(fold), bool)
    if not n[own].sum():
        return made
    rate = np.clip(y[own].sum() / n[own].sum(), 1e-4, 1 - 1e-4)
    made.start = float(np.log(rate / (1 - rate)))
    score = np.full(own.sum(), made.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y[own] - n[own] * p, n[own] * p * (1 - p)

        def grow(rows: np.ndarray, depth: int):
            cut = _cut(x[own][rows], g[rows], h[rows]) if depth else None
            if not cut:
                return _leaf(g[rows], h[rows])
            left = x[own][:, cut[0]] <= cut[1]
            return (*cut, grow(rows & left, depth - 1), grow(rows & ~left, depth - 1))

        tree = grow(np.ones(own.sum(), bool), 2)
        if isinstance(tree, float):
            break
        made.trees.append(tree)
        score += _predict(tree, x[own])
    other = fold == 1 if (fold == 1).any() else fold == 0
    total = made.start + sum((_predict(t, x[other]) for t in made.trees), np.zeros(other.sum()))
    for k, kind in enumerate(KINDS):
        of = x[other][:, 0] == k
        levels, of_level = np.unique(-total[of].round(9), return_inverse=True)
        many, good = np.bincount(of_level, n[other][of]), np.bincount(of_level, y[other][of])
        enough = np.flatnonzero(np.cumsum(good) >= PRECISE * (np.cumsum(many) + DOUBT))
        if len(enough):
            made.least[kind] = float(1 / (1 + np.exp(levels[enough[-1]]))) - 1e-9
    return made


def score(x: Column, model: Trees) -> Column:
    """The trees' probability of a candidate."""
    names = list(FEATURES)

    def of(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        f, b, left, right = node
        return F.when(x[names[f]] <= b, of(left)).otherwise(of(right))

    total = F.lit(model.start)
    for tree in model.trees:
        total = total + of(tree)
    return 1 / (1 + F.exp(-total))


def select(found: Column, model: Trees) -> Column:
    """Chosen spans (start, kind, end) of an array of candidates, in order: all base
    spans, and of the others those whose score reaches its kind's threshold, that
    overlap no base span and no better one (ties: the earlier, then the kind)."""
    least = F.lit(model.least[KINDS[0]])

    def threshold(x: Column) -> Column:
        out = least
        for k, kind in enumerate(KINDS[1:], 1):
            out = F.when(x["kind"] == k, F.lit(model.least[kind])).otherwise(out)
        return out

    def chosen(c: Column) -> Column:
        base = F.filter(c, lambda x: x["base"])
        rest = F.filter(c, lambda x: ~x["base"] & ~F.exists(base, lambda y: _overlap(x, y)))
        scored = F.transform(rest, lambda x: F.struct((-score(x, model)).alias("s"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), threshold(x).alias("least")))
        ranked = F.array_sort(F.filter(scored, lambda x: -x["s"] >= x["least"]))
        plain = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).cast(_SPAN)
        more = F.aggregate(
            plain(ranked), F.array().cast(_SPAN), lambda acc, x: F.when(F.exists(acc, lambda y: _overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x)).cast(_SPAN))
        )
        return F.array_sort(F.concat(plain(base), more))

    return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(_let(found, chosen))


def with_spans(found: DataFrame, model: Trees, prefix: str = "", name: str = "__cand") -> DataFrame:
    """What with_candidates() gave, with base_spans and pii_spans in the place of its
    columns: (start, kind, end) in code points, end exclusive, by start and then kind,
    kinds numbered as in KINDS. A null or empty text has none. Spans of different base
    patterns may overlap; equal rows give equal spans; an empty table gives no rows,
    and fit() without candidates gives trees that add nothing."""
    out = without(found, [prefix + "base_spans", prefix + "pii_spans"])
    base = F.array_sort(F.transform(F.filter(name, lambda x: x["base"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return out.withColumns({prefix + "base_spans": base.cast(_SPAN), prefix + "pii_spans": select(F.col(name), model)}).drop(name, "__fold")


def count_of(spans: str, kind: int) -> Column:
    """How many of the spans are of this kind. A second parameter of the function that
    filters, also one with a default, would be the place in the array."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """docs whose text has [EMAIL], [IP], [CARD] or [PHONE] in the place of each
    span; of overlapping spans the first names the whole stretch. A null text stays
    null; other columns stay as they were, repeated rows as well, and an
    empty table is given back empty."""
    names = [f"__c{k}" for k in range(len(docs.columns))]
    own = names[[c.lower() for c in docs.columns].index(text.lower())]
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(F.col(own), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        name = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), x["kind"] + 1)
        more = F.when(x["start"] >= acc["at"], F.array(between, name)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], more).cast("array<string>").alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(own), (acc["at"] + 1).cast("int"), F.length(own)))

    found = with_spans(with_candidates(docs.toDF(*names), own), model)
    cleaned = F.when(F.size("pii_spans") == 0, F.col(own)).otherwise(F.aggregate("pii_spans", start, step, finish))
    return found.withColumn(own, cleaned).select(*names).toDF(*docs.columns)
