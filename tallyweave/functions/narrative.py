"""Column functions that read fields out of narrative sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.money import scope_conflict
from tallyweave.functions.text import let

# The words and forms of narrative sentences.
PERIOD = "本期"
UNIT = "(亿美元|万美元|美元|亿元|亿|万元|万|元)"
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
MOVE = "(增加|减少)"
MODIFIER = "(?:约|共|合计|累计|达|为|至|计)"
PLAIN = rf"{PERIOD}\s*{MOVE}\s*{NUMBER}\s*{UNIT}"
SUFFIXED = rf"{PERIOD}\s*{MOVE}了\s*{NUMBER}\s*{UNIT}"
MODIFIED = rf"{PERIOD}\s*{MOVE}\s*{MODIFIER}\s*{NUMBER}\s*{UNIT}"
VALUE = rf"{PERIOD}\s*(?:为|：|:|=)?\s*([-+－−—–]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*{UNIT}"
AMOUNT = rf"(?s)^(.*?){NUMBER}\s*{UNIT}"
COMPANY = rf"([^,，。、；]+?)\s*(增加|减少|增|减)(?:了|\s*{MODIFIER})?\s*{NUMBER}\s*{UNIT}"
DETAIL_START = "^[（(\\s]*(?:主要是|主要为|主要由|主要原因是)[：:、，,.。；;\\s]*"
DETAILS = "(主要是|主要为|主要由|主要原因是).*$"
OFF_COMPANY = rf"([^,，。、；]+?)\s*(?:增加|减少)(?:了|\s*{MODIFIER})\s*[0-9]"
LED_AMOUNT = rf"{MOVE}\s*{NUMBER}\s*{UNIT}"
LOOSE_COMPANY = [rf"[^,，。、；]+?\s*(增加|减少|增|减)\s*{MODIFIER}\s*{NUMBER}\s*{UNIT}", rf"[^,，。、；]+?\s*(增加|减少|增|减)了\s*{NUMBER}\s*{UNIT}"]
SMALL_REST = "等小额增加"
TAG_MOVE = "非标准增减主句"
MARKERS, MARKER = "(主要是|主要为|主要由|主要原因是)", "主要是"
QUOTED = "[“\"]([^”\"]+)[”\"]"
CODE_AND_NAME = r"^([A-Za-z0-9]+)[\s\-_:：、，,.]*(.*)$"
NAME_LEAD = "^[：:、，,.。 ]+"
SHEET = r"([A-Z]\d{4})\s*表单[:：]?"
PARAGRAPH = r"^[（(]\s*(\d+)\s*[）)]"
ENGLISH_INDEX = r"^\s*[（(]\s*[0-9]+\s*[）)]"
EARLY_STOP = r"(?s)。\s*\S"
CODE = "[A-Za-z0-9]{2,}"
STRAY_MARKS = r"[\p{P}&&[^“”（），。：、()%-]]"
IN_NUMBERS = r"(?<=\d)[.,:/-](?=\d)"
SEGMENT_ENDS = "(?<=[，。；;\"“”,])|(?<=[.])(?![0-9])|(?<=[^0-9][.])"
THIS, LAST_MOVE = "(?s)^[^本]*(本.?)(.*)$", "(?s)^(.*)(?:增加|减少)(.*)$"
TAG_SUFFIX, TAG_MODIFIER, TAG_VALUE, TAG_OTHER, TAG_MISSING = "增加/减少后含后缀", "增加/减少后含修饰词", "本期为", "非标准主句", "缺少增加/减少"


def _none(text: Column) -> Column:
    return F.when(text != "", text)


def _number(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "－−—–", "----"), ",", "").try_cast("double")


def quoted(text: Column) -> Column:
    """The first quoted text."""
    return _none(F.trim(F.regexp_extract(text, QUOTED, 1)))


def code_and_name(text: Column) -> Column:
    """Struct of the indicator's code and name, split where the code ends."""
    t = F.trim(text)
    name = F.regexp_replace(F.trim(F.regexp_extract(t, CODE_AND_NAME, 2)), NAME_LEAD, "")
    return F.struct(_none(F.regexp_extract(t, CODE_AND_NAME, 1)).alias("code"), _none(name).alias("name"))


def sheet(text: Column) -> Column:
    """A sheet's code before 表单."""
    return _none(F.regexp_extract(text, SHEET, 1))


def paragraph(text: Column) -> Column:
    """The bracketed index that a paragraph begins with."""
    return F.regexp_extract(F.trim(text), PARAGRAPH, 1).try_cast("int")


def _change(direction: Column, amount: Column, unit: Column) -> Column:
    return F.struct(direction.cast("int").alias("direction"), amount.alias("amount"), unit.alias("unit"))


def main_change(text: Column) -> Column:
    """Struct of direction, amount and unit: a stated increase or decrease in
    one of three forms, then weak words between the period and the amount (both
    kinds: no direction), then a signed value."""
    out = F.lit(None)
    value = _number(F.regexp_extract(text, VALUE, 1))
    out = F.when(text.rlike(VALUE) & value.isNotNull(), _change(F.when(value < 0, -1).otherwise(1), F.abs(value), F.regexp_extract(text, VALUE, 2)))
    before = F.regexp_extract(text, AMOUNT, 1)
    between = F.substring_index(before, PERIOD, -1)
    less, more = between.rlike("[减少小]"), between.rlike("[增加多]")
    weak = text.rlike(AMOUNT) & F.contains(before, F.lit(PERIOD)) & (less | more)
    direction = F.when(less & ~more, -1).when(more & ~less, 1)
    out = F.when(weak, _change(direction, _number(F.regexp_extract(text, AMOUNT, 2)), F.regexp_extract(text, AMOUNT, 3))).otherwise(out)
    for form in (MODIFIED, SUFFIXED, PLAIN):
        moved = F.when(F.regexp_extract(text, form, 1) == "增加", 1).otherwise(-1)
        out = F.when(text.rlike(form), _change(moved, _number(F.regexp_extract(text, form, 2)), F.regexp_extract(text, form, 3))).otherwise(out)
    return out


def places(text: Column) -> Column:
    """Digits after the point of the first form's amount that fits."""
    amount = F.coalesce(*[_none(F.regexp_extract(text, p, g)) for p, g in ((PLAIN, 2), (SUFFIXED, 2), (MODIFIED, 2), (VALUE, 1), (AMOUNT, 2))], F.lit(""))
    return F.length(F.regexp_extract(amount, r"\.([0-9]+)$", 1))


def details(text: Column) -> Column:
    """Companies of the part after 主要是, each with direction, amount
    and unit, equal ones once. The part is cut at marks that are not inside numbers."""
    part = F.regexp_replace(F.regexp_extract(text, DETAILS, 0), "(?<=[0-9]),(?=[0-9])", "")
    segments = F.split(part, SEGMENT_ENDS)
    bare = F.transform(segments, lambda s: F.regexp_replace(F.trim(s), DETAIL_START, ""))
    item = lambda s: F.struct(
        F.trim(F.regexp_extract(s, COMPANY, 1)).alias("company"),
        F.when(F.regexp_extract(s, COMPANY, 2).startswith("增"), 1).otherwise(-1).alias("direction"),
        _number(F.regexp_extract(s, COMPANY, 3)).alias("amount"),
        F.regexp_extract(s, COMPANY, 4).alias("unit"),
    )
    return F.array_distinct(F.transform(F.filter(bare, lambda s: s.rlike(COMPANY)), item))


def main_class(text: Column) -> Column:
    """C28: "" for the canonical form, else the tag of what is off about it."""
    return F.when(text.rlike(PLAIN), "").when(text.rlike(SUFFIXED), TAG_SUFFIX).when(text.rlike(MODIFIED), TAG_MODIFIER).when(text.rlike(VALUE), TAG_VALUE).when(text.rlike(AMOUNT), TAG_OTHER).otherwise(TAG_MISSING)


def main_form(text: Column) -> Column:
    """The word that keeps a main sentence from the canonical form, "" if none
    does: what stands between period or direction and the amount, a sign, or the word
    after the unit; a tag where there is no amount or nothing before it. A null text
    is empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    before = F.trim(F.regexp_extract(t, AMOUNT, 1))
    after = F.trim(F.regexp_extract(t, rf"(?s)^.*?{NUMBER}\s*{UNIT}(.*)$", 3))
    between = F.trim(F.regexp_extract(before, rf"(?s){PERIOD}(.*)$", 1))
    rest = F.trim(F.regexp_replace(between, f"^{MOVE}", ""))
    tail = F.regexp_extract(after, r"^[\s\p{P}]*([^\s\p{P}]*)", 1)
    lead = F.coalesce(*[F.when(F.locate(w, before) > 1, F.trim(F.substring_index(before, w, 1))) for w in ("增加", "减少", "为", "：", ":", "=")], before)
    no_amount = F.when(t.contains(PERIOD), PERIOD).when(t.rlike(MOVE), TAG_MOVE).otherwise(TAG_OTHER)
    named = F.when(between == "", TAG_MISSING).when(between.rlike(f"^{MOVE}"), F.when(rest != "", rest).when(tail == SMALL_REST, "").otherwise(tail)).when(between.rlike("^[-+－−—–]"), F.substring(between, 1, 1)).otherwise(between)
    return F.when(t == "", "").when(~t.rlike(AMOUNT), no_amount).when(~before.contains(PERIOD), lead).otherwise(named)


def _reads(text: Column) -> Column:
    m = main_change(text)
    return F.coalesce(m["direction"].isin(-1, 1) & m["amount"].isNotNull() & (m["unit"] != ""), F.lit(False))


def main_blocks(text: Column) -> Column:
    """Whether a main sentence speaks of a change in no form that can be read."""
    t = F.coalesce(text, F.lit(""))
    return (F.trim(t) != "") & ~_reads(t) & (t.rlike(MOVE) | t.rlike(VALUE))


def bare_amounts(text: Column) -> Column:
    """Whether an amount stands without a direction of its own. Amounts that have
    one are blanked first: the main sentence's, companies' and led ones."""
    t = F.coalesce(text, F.lit(""))
    own = F.regexp_extract(t, AMOUNT, 1).contains(PERIOD) & _reads(t)
    t = F.when(own, F.regexp_replace(t, rf"(?s)^(.*?){NUMBER}\s*{UNIT}(.*)$", "$1#$4")).otherwise(t)
    for form in [*LOOSE_COMPANY, LED_AMOUNT]:
        t = F.regexp_replace(t, form, "#")
    return t.rlike(rf"{NUMBER}\s*{UNIT}")


def scope_hint(text: Column) -> Column:
    """本外币, then dollars' total or foreign currency, then yuan."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    return F.when(bare.contains("本外币"), "foreign").when(bare.contains("美元合计") | bare.contains("外币"), "usd_total").when(bare.contains("人民币"), "rmb").otherwise("")


def stray_marks(text: Column) -> Column:
    """Punctuation outside the allowed set, but for separators within numbers."""
    bare = F.regexp_replace(text, IN_NUMBERS, "")
    return F.regexp_extract_all(bare, F.lit(STRAY_MARKS), 0)


def format_exceptions(text: Column) -> Column:
    """Array of (type_id, value) of a sentence: main form (12), stray marks (16),
    scope against unit (12), and a detail part without any readable company (14)."""
    make = lambda when, kind, value: F.when(when, F.struct(F.lit(kind).alias("type_id"), value.alias("value")))
    unit = F.coalesce(main_change(text)["unit"], F.lit(""))
    marks = stray_marks(text)
    return F.array_compact(
        F.array(
            make(main_class(text) != "", 12, main_class(text)),
            make(F.size(marks) > 0, 16, F.array_join(marks, "")),
            make((unit != "") & scope_conflict(scope_hint(text), unit), 12, unit),
            make(text.rlike(MARKERS) & (F.size(details(text)) == 0), 14, F.lit("主要是")),
        )
    )


def _unit_group(unit: Column) -> Column:
    return F.when(unit.contains("美元"), "usd").when(unit.rlike("[元万亿]"), "rmb").otherwise("")


def main_tokens(main: Column) -> Column:
    """C31, what keeps a main sentence from the canonical form, word by word: what stands
    in the place of 本期, what stands between it and the last direction, and between that
    and the amount; without a direction the last character before the amount and what is
    before it; without 本 as well the last character alone. What a closing quotation mark
    ends is left out. Where nothing of this is there, the whole sentence. An array, empty
    for the canonical form and for a blank sentence."""
    return let(F.coalesce(main, F.lit("")), _tokens_of)


def _tokens_of(main: Column) -> Column:
    before = F.when(main.rlike(AMOUNT), F.regexp_extract(main, AMOUNT, 1)).otherwise(F.regexp_extract(F.regexp_replace(main, ENGLISH_INDEX + r"\s*", ""), "(?s)^([^0-9]*)", 1))
    last = lambda c: F.substring(F.rtrim(c), -1, 1)

    def words(rest: Column, ending: Column) -> Column:
        """Words of what stands before the amount; its last character is the ending."""
        tail = F.regexp_extract(rest, THIS, 2)
        between = F.trim(tail)
        named, this = F.trim(F.regexp_extract(rest, THIS, 1)), rest.contains("本")
        moved = lambda zone: [F.trim(F.regexp_extract(zone, LAST_MOVE, k)) for k in (1, 2)]
        return F.when(
            this,
            F.when(tail.rlike(MOVE), F.array(F.when(named != PERIOD, named), *moved(tail))).otherwise(
                F.array(F.when(named != PERIOD, named), F.trim(F.regexp_extract(between, "(?s)^(.*).$", 1)), last(between))
            ),
        ).otherwise(F.when(rest.rlike(MOVE), F.array(moved(rest)[1])).otherwise(F.array(ending)))

    tokens = let(before, lambda b: let(F.regexp_extract(b, "(?s)([^”\"]*)$", 1), lambda rest: words(rest, last(b))))
    none = F.array().cast("array<string>")
    found = let(F.filter(tokens, lambda x: x.isNotNull() & (x != "")), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.trim(main))))
    return F.when((F.trim(main) == "") | main.rlike(PLAIN), none).otherwise(found)


def parse_exceptions(text: Column) -> Column:
    """C31, the rules of the parse stage: array of (type_id, field, value), equal ones
    once. Of the main sentence: English brackets after a bracketed index, English
    quotes, a lone or no quotation mark, a full stop before the end, and each of its
    main_tokens(). Of the detail
    part: another marker than the usual one, an end without a full stop (with the last
    amount), companies whose change has a suffix or modifier, and units of another
    currency than the main sentence's."""
    text = F.coalesce(text, F.lit(""))
    main, marker = F.regexp_replace(text, rf"(?s){MARKERS}.*$", ""), F.regexp_extract(text, MARKERS, 1)
    detail = F.trim(F.regexp_extract(text, rf"(?s){MARKERS}[：:、，,.。；;\s]*(.*)$", 2))
    end = F.regexp_extract(detail, r"(?s)(\S)\s*$", 1)
    amounts = F.regexp_extract_all(detail, F.lit(rf"{NUMBER}\s*{UNIT}"), 0)
    tail = F.when(F.size(amounts) > 0, F.regexp_replace(F.element_at(amounts, -1), r"\s+", "")).otherwise(F.coalesce(_none(end), F.lit("。")))
    opened, closed = main.contains("“"), main.contains("”")
    outside = F.regexp_replace(F.regexp_replace(main, "“[^”]*”", ""), '"[^"]*"', "")
    own = _unit_group(F.coalesce(main_change(text)["unit"], F.lit("")))
    units = F.array_sort(F.array_distinct(F.filter(F.transform(details(text), lambda d: d["unit"]), lambda u: (own != "") & (_unit_group(u) != "") & (_unit_group(u) != own))))
    shape = "struct<type_id:int,field:string,value:string>"
    entry = lambda kind, field, value: F.struct(F.lit(kind).alias("type_id"), F.lit(field).alias("field"), value.alias("value")).cast(shape)
    one = lambda when, *parts: F.when(when, entry(*parts))
    token = F.coalesce(_none(F.regexp_extract(main, CODE, 0)), F.lit(PERIOD))
    fixed = F.array(
        one(main.rlike(ENGLISH_INDEX) & main.rlike("[()]"), 16, "main_sentence", F.lit("(")),
        one(main.contains('"'), 16, "main_sentence", F.lit('"')),
        one(opened != closed, 12, "main_sentence", F.when(opened, "“").otherwise("”")),
        one(~opened & ~closed, 12, "main_sentence", token),
        one(outside.rlike(EARLY_STOP), 16, "main_sentence", F.lit("。")),
        one((marker != "") & (marker != MARKER), 12, "company_marker", marker),
        one((detail != "") & (end != "。"), 12, "company_detail_tail", tail),
        one((detail != "") & (end != "。") & end.rlike(r"^\p{P}$"), 16, "company_detail", end),
    )
    companies = F.transform(F.regexp_extract_all(detail, F.lit(OFF_COMPANY), 1), lambda c: entry(14, "company_detail", F.trim(c)))
    words = F.transform(main_tokens(main), lambda t: entry(12, "main_sentence", t))
    return F.array_distinct(F.concat(F.array_compact(fixed), words, companies, F.transform(units, lambda u: entry(12, "profit_loss_unit", u))))
