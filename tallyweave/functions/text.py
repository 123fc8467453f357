"""Column functions on lines of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chinese digits, and folding of full-width characters.
DIGITS = "零一二三四五六七八九"
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_MARKS, _PLAIN = "，。：；、！", ",.:;,!"

# Patterns of headings, contents and glossary titles.
H1 = "^第[一二三四五六七八九十百〇零]+[节節条]\\s*"
H2 = "^([一二三四五六七八九十百〇零]+)[、．.]\\s*"
H3 = "^([0-9]+)[.．]([0-9]+)\\s*"
H4 = "^([0-9]+)[.．、](?:[^0-9]|$)"
TOC = "^(目\\s*录|表\\s*目\\s*录|图\\s*目\\s*录)\\s*$"
GLOSSARY = "^(附\\s*录|附\\s*件|术\\s*语|定\\s*义|缩\\s*略\\s*语|釋\\s*義)"
SENTENCE = "[，。；：！？;:!?]"
MONEY_DATE = "[0-9]+\\s*(元|万元|亿元|年|月|日)"
# What a bold line may not have if it is to be a title: marks, a date, an opening bracket.
BOLD_BARS = "[。！？；：,，;:!?]|[〇零一二三四五六七八九十百0-9]+[年月]|[0-9]+日$|^[（(〔［]"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once and its code written once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_width(text: Column) -> Column:
    return F.translate(text, _FULL, _HALF)


def normalized(text: Column) -> Column:
    """No zero-width characters, single blanks and line ends, trimmed lines."""
    bare = F.regexp_replace(text, "[\\u200b\\u200c\\u200d\\u2060\\ufeff\\u00ad]", "")
    single = F.regexp_replace(F.regexp_replace(bare, r"[^\S\n]+", " "), r"\n{2,}", "\n")
    return F.trim(F.regexp_replace(single, r" ?\n ?", "\n"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def folded(text: Column) -> Column:
    """Half-width brackets and marks, no blanks."""
    return stripped(F.translate(F.coalesce(text, F.lit("")), "（），。：；", "(),.:;"))


def comparison_key(text: Column, traditional: str = "", simplified: str = "") -> Column:
    """Width folded, characters of the given table folded, no blanks."""
    return stripped(F.translate(F.translate(fold_width(F.coalesce(text, F.lit(""))), _MARKS, _PLAIN), traditional, simplified))


#: How many code points there are.
POINTS = 0x110000


def comparison_points() -> np.ndarray:
    """For each code point the one that it has in a comparison_key(), or -1."""
    out = np.arange(POINTS, dtype=np.int32)
    for old, new in ((_FULL, _HALF), (_MARKS, _PLAIN)):
        step = np.arange(POINTS, dtype=np.int32)
        step[[ord(c) for c in old]] = [ord(c) for c in new]
        out = step[out]
    return np.where(np.isin(out, [ord(c) for c in BLANKS]), np.int32(-1), out)


#: Pairs of characters that a folding table may have; they become one literal of the plan.
FOLDED_PAIRS = 100_000


def folding(pairs: DataFrame) -> tuple[str, str]:
    """The two texts that comparison_key() takes, from a table of characters (from,
    to). Rows with more or less than one character on either side are left out; of a
    character's rows that of the smallest `to` holds. A table of more than FOLDED_PAIRS
    characters is refused."""
    one = pairs.where("length(`from`) = 1 and length(`to`) = 1").groupBy("from").agg(F.min("to").alias("to"))
    rows = one.orderBy("from").limit(FOLDED_PAIRS + 1).collect()
    if len(rows) > FOLDED_PAIRS:
        raise ValueError(f"more than {FOLDED_PAIRS} characters to fold")
    return "".join(r["from"] for r in rows), "".join(r["to"] for r in rows)


def section_name(text: Column) -> Column:
    """No number prefix, brackets or blanks; dates become a placeholder."""
    bare = F.regexp_replace(text, r"^\s*(?:[0-9]+|[一二三四五六七八九十]+)[.、．]\s*", "")
    dated = F.regexp_replace(bare, "[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日", "xxxx年x月x日")
    return F.regexp_replace(dated, r"[（()）\[\]【】\s]", "")


# Blanks, and marks that no title key has.
BLANKS, TITLE_MARKS = " \t\n\x0b\f\r", ".,;:!?、，。；：！？（）()“”\"'-"


def title_key(text: Column) -> Column:
    """Lower case without marks and blanks."""
    return F.translate(F.lower(text), BLANKS + TITLE_MARKS, "")


def has_title_key(text: Column) -> Column:
    """Whether anything is left in a text's title_key(), without working it out."""
    return text.rlike(rf"[^\s{TITLE_MARKS}]")


def number_hint(text: Column) -> Column:
    """The number that a title begins with, in one of four forms."""
    forms = ["^(第[一二三四五六七八九十百]+[章节条])", "^([0-9]+(?:[.][0-9]+)+)", "^([0-9]+)[.、]", "^([一二三四五六七八九十]+)、"]
    found = [F.regexp_extract(text, f, 1) for f in forms]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def numeral(text: Column) -> Column:
    """A Chinese numeral up to 999, or null: hundreds, tens and ones are read
    by their marks; a bare 十 means ten."""
    digit = lambda x: F.when(x == "", None).otherwise(F.instr(F.lit(DIGITS), x) - 1)
    t = F.translate(text, "〇", "零")
    pattern = "^(?:([一二三四五六七八九])百零?)?(?:([一二三四五六七八九]?)(十))?([一二三四五六七八九零]?)$"
    h, d, ten, o = (F.regexp_extract(t, pattern, k) for k in (1, 2, 3, 4))
    tens = F.when(ten != "", F.coalesce(digit(d), F.lit(1))).otherwise(0)
    value = F.coalesce(digit(h), F.lit(0)) * 100 + tens * 10 + F.coalesce(digit(o), F.lit(0))
    return F.when(t.rlike(pattern) & (t != ""), value)


def gate(text: Column, prefix: str, most: int) -> Column:
    """Whether a line that begins like a heading reads like one."""
    bars = F.length(F.regexp_replace(text, "[^|｜]", ""))
    whole = stripped(fold_width(text))

    def heading_like(tail: Column) -> Column:
        flat = fold_width(tail)
        return (
            (tail != "") & (F.length(tail) <= most) & ~tail.rlike(SENTENCE) & ~flat.rlike(MONEY_DATE) & ~flat.rlike(r"^[-+()\s0-9.,%]+$")
            & ~((F.length(tail) <= 4) & let(whole, lambda w: F.length(F.regexp_replace(w, "[^0-9]", "")) / F.greatest(F.length(w), F.lit(1)) > 0.65))
        )

    tail = F.regexp_replace(F.regexp_replace(F.trim(text), prefix, ""), r"^[|｜\s]+", "")
    return ~text.contains("\t") & (bars < 3) & let(tail, heading_like)


def line_class(text: Column, style: Column | None = None, outline: Column | None = None, is_table: Column | None = None, bold: Column | None = None, after_blank: Column | None = None) -> Column:
    """C14: class of a line: table, blank, contents, glossary, style, outline level,
    then the heading patterns in the order H1, H2, H4, H3 behind their gates. A line
    that none takes is H1 if it is bold throughout, follows a blank line and is short,
    without marks, date and opening bracket; null flags count as false."""
    none = F.lit(None).cast("string")
    style = none if style is None else style
    outline = F.lit(None).cast("int") if outline is None else outline
    table = F.lit(False) if is_table is None else is_table
    by_style = F.regexp_extract(style, r"(?i)^heading\s*([1-4])$", 1)

    alone = F.coalesce((F.lit(False) if bold is None else bold) & (F.lit(False) if after_blank is None else after_blank), F.lit(False))

    def classify(t: Column) -> Column:
        return (
            F.when(table | (F.coalesce(style, F.lit("")) == "Table"), "Table").when(t == "", "BLANK").when(t.rlike(TOC), "TOCTitle").when(t.rlike(GLOSSARY), "GlossaryTitle")
            .when(F.coalesce(by_style, F.lit("")) != "", F.concat(F.lit("H"), by_style)).when(outline.between(0, 3), F.concat(F.lit("H"), (outline + 1).cast("string")))
            .when(t.rlike(H1), "H1").when(t.rlike(H2) & gate(t, H2, 40), "H2").when(~t.rlike(H2) & t.rlike(H4) & gate(t, "^[0-9]+[.．、]\\s*", 28), "H4")
            .when(~t.rlike(H2) & ~t.rlike(H4) & t.rlike(H3) & gate(t, H3, 40), "H3").when(alone & (F.length(t) <= 40) & ~t.rlike(BOLD_BARS), "H1").otherwise("NORMAL")
        )

    return let(F.trim(normalized(text)), classify)


def line_class_plain(text: Column) -> Column:
    """The second variant: H1, H3, H4, H2, without gates."""
    t = F.trim(text)
    return F.when(t.rlike(H1), "H1").when(t.rlike(H3), "H3").when(t.rlike(H4), "H4").when(t.rlike(H2), "H2").otherwise("NORMAL")


def sentences(text: Column) -> Column:
    """C17: sentences of a paragraph, cut after their end marks."""
    return F.filter(F.transform(F.split(text, "(?<=[。！？!?.])"), lambda x: F.trim(x)), lambda x: x != "")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts; .85 and more where one contains the other; else the
    share of common characters."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    x, y = (F.array_distinct(F.split(c, "")) for c in (a, b))
    jaccard = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(F.contains(a, b) | F.contains(b, a), 0.85 + 0.15 * short / long).otherwise(jaccard)


def margin_key(text: Column) -> Column:
    """A margin line without bars, digits and blanks."""
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), "[|｜0-9]", ""))


def margin_template(text: Column) -> Column:
    """A margin line with # for each number, half-width, without blanks."""
    return stripped(fold_width(F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]+", "#")))


def _common(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.split(c, "")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def margin_similarity(a: Column, b: Column) -> Column:
    """C50, of margins: 1 for equal keys, .92 where one contains the other, else the
    share of common characters."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.92).otherwise(_common(a, b))


def contents_similarity(a: Column, b: Column) -> Column:
    """C50, of contents entries: 1 for equal titles; .85 and more where one contains the
    other; else three quarters of the share of common characters."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(F.contains(a, b) | F.contains(b, a), 0.85 + 0.15 * short / long).otherwise(0.75 * _common(a, b))


def chinese_gate(text: Column) -> Column:
    """Whether a document reads as Chinese: few letters pass, and so does one
    whose Latin letters do not outweigh its Chinese characters. The first 8000
    characters decide; that is the rule itself."""
    head = F.substring(text, 1, 8000)
    latin, chinese = F.regexp_count(head, F.lit("[A-Za-z]")), F.regexp_count(head, F.lit("[\\u4e00-\\u9fff]"))
    return (latin + chinese < 24) | ~((latin >= 2 * chinese) & (chinese < 40))


def same_characters(a: Column, b: Column) -> Column:
    """Equal counts of every character, in any order. Only texts of one length are
    taken apart."""
    return F.when(F.length(a) != F.length(b), False).otherwise(F.sort_array(F.split(a, "")) == F.sort_array(F.split(b, "")))
