"""Column functions that clean the fields of confirmation letters and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import let

# Patterns of a letter's number, in order of trust.
NUMBER_PATTERNS = [
    r"函证编号\s*[:：]?\s*([A-Za-z0-9\u4e00-\u9fff\-_/，,（）() ]+)",
    r"询证函编号\s*[:：]?\s*([A-Za-z0-9\u4e00-\u9fff\-_/，,（）() ]+)",
    r"\b编号\s*[:：]?\s*([A-Za-z0-9\u4e00-\u9fff\-_/，,（）() ]+)",
    r"\bNO\.?\s*[:：]?\s*([A-Za-z0-9\u4e00-\u9fff\-_/，,（）() ]+)",
    r"索引号\s*[:：]?\s*([A-Za-z0-9\u4e00-\u9fff\-_/，,（）() ]+)",
    r"项目编号\s*[:：]?\s*([A-Za-z0-9\u4e00-\u9fff\-_/，,（）() ]+)",
]
# Slips of a reader's spelling, as patterns and as plain texts.
SLIPS = [
    ("有限责任公司会计师事务所", "有限责任会计师事务所"),
    ("有限公司会计师事务所", "有限责任会计师事务所"),
    ("公司会计师事务所", "会计师事务所"),
    ("会计师事务所公司$", "会计师事务所"),
    ("会计师事务所有限$", "会计师事务所"),
    (r"(\d号)公司$", "$1"),
    (r"(\d层)公司$", "$1"),
    ("银行股份有限$", "银行股份有限公司"),
    (r"(?U)(\w银行)有限公司$", "$1股份有限公司"),
]
SWAPS = [("普华水道", "普华永道"), ("安客", "安永"), ("天律", "天津"), ("大华水", "大华永")]
# Where a letter's text tells its own fields, in order of trust.
FIRM_PATTERNS = [
    r"聘请的?\s*(.{2,30}会计师事务所.{0,20}?分所)",
    r"聘请的?\s*(.{2,30}会计师事务所.{0,10}?有限公司)",
    r"聘请的?\s*(.{2,30}会计师事务所[（(][^）)]*[）)])",
    r"回函.*?寄.*?至\s*(.{2,30}会计师事务所.{0,20}?分所)",
    r"回函.*?寄.*?至\s*(.{2,30}会计师事务所.{0,10}?有限公司)",
    r"回函.*?寄.*?至\s*(.{2,30}会计师事务所[（(][^）)]*[）)])",
]
FIRM_END = "(正在|对[本我]|进行|截至|应当)(?s:.*)$"
DEBIT_PATTERNS = [
    r"从本公司.*?([A-Za-z]*[\d\s]{5,}).*?支取",
    r"扣费账号.*?([A-Za-z]*[\d\s]{5,})",
    r"付款账号.*?([A-Za-z]*[\d\s]{5,})",
    r"授权.*?从.*?([A-Za-z]*[\d\s]{5,}).*?支取",
    r"从.*?账号.*?([A-Za-z]*[\d\s]{5,}).*?(?:扣除|支付|扣取)",
    r"账号.*?([A-Za-z]*[\d\s]{5,}).*?(?:支取|扣费)",
]
BANK_PATTERNS = [
    r"^\s*([\u4e00-\u9fffA-Za-z0-9]+银行[\u4e00-\u9fff]{0,15}(?:分行|支行|营业部|总行)?)\s*[(（]\s*以下简称",
    r"([\u4e00-\u9fffA-Za-z0-9]+银行[\u4e00-\u9fff]{0,15}(?:分行|支行|营业部|总行)?)\s*[(（]\s*以下简称",
    r"致\s*[:：]?\s*([\u4e00-\u9fffA-Za-z0-9]+银行[\u4e00-\u9fff]{0,15}(?:分行|支行|营业部|总行)?)",
]
RANGE_PATTERNS = [
    r"(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)[^\d]*?至[^\d]*?(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)[^\d]*?(?:期间|注销|账户)",
    r"[自白目][^\d]*?(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)[^\d]*?至[^\d]*?(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)",
    r"从[^\d]*?(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)[^\d]*?至[^\d]*?(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)",
]
SIGNED_PATTERNS = [
    r"(?s)预留签章.*?(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)",
    r"(?s)电子授权.*?(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)",
    r"(?s)有限公司.*?(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)",
    r"(20\d\d\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日?)",
]
STAMP = r"F\s*S\s*(\d{4})\s*[-–]\s*(\d{1,2})\s*[-–]\s*(\d{1,2})"
BARCODE = r"条形码.{0,20}?([A-Za-z0-9\-]{6,})"
REPLY_ENDS = ["公司经办人", "经办人", "预留签章", "采用电子授权", "以下由被询证银行", "被询证银行填列"]
REPLY_NAMES = [
    r"回函\s*收件人\s*[:：]\s*([\u4e00-\u9fff·a-zA-Z\-_]{1,20})",
    r"回函\s*联系人\s*[:：]\s*([\u4e00-\u9fff·a-zA-Z\-_]{1,20})",
    r"回函.*?收件人\s*[:：]\s*([\u4e00-\u9fff·a-zA-Z\-_]{1,20})",
]
LATER_NAMES = [
    r"收件人\s*[:：]\s*([\u4e00-\u9fff·a-zA-Z\-_]{1,20})",
    r"联系人\s*[:：]\s*([\u4e00-\u9fff·a-zA-Z\-_]{1,20})",
]
REPLY_ADDRESS = r"(?s)回函[地址]*\s*[:：](.*)$"
PHONE = r"(?:手机号|电话|联系电话)\s*[:：]\s*(.*?)(?=\s*(?:邮政编码|邮编|电邮|电子邮箱|邮箱|传真|网址|回函|[\n\r]|$))"
GLUED = r"(?s)(?:电话|联系电话|手机|手机号|电邮|电子邮箱|邮箱|邮编|邮政编码|传真|座机).*$"
# Readings of one name beside a firm's seal, where the text shows that firm.
MISREAD_NAMES, READ_NAME = ["董静", "道静", "谨静"], "静"
SEAL_OF_FIRM = r"(?i)普华|Pricewaterhouse|FOR\s*IDENTIFICATION|道|谨"
# Words of checked and unchecked boxes.
NO_WORDS, YES_WORDS = ["×", "x", "no", "n", "false", "0", "否", "未", "无"], ["√", "✓", "v", "yes", "y", "true", "1", "是", "有"]


def _first(found: list[Column]) -> Column:
    """The first that is neither null nor empty, else null; none is worked out twice,
    and none after it."""
    return reduce(lambda rest, x: let(x, lambda v: F.when(v != "", v).otherwise(rest)), reversed(found), F.lit(None).cast("string"))


def clean_date(text: Column) -> Column:
    """Yyyy-MM-dd of the first date in either form; "" for none and for a day
    that does not exist."""
    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), _bare_date)


def _bare_date(bare: Column) -> Column:
    forms = [r"(\d{4})[年/\-.](\d{1,2})[月/\-.](\d{1,2})日?", r"(\d{4})(\d{2})(\d{2})"]
    out = F.lit("")
    for p in reversed(forms):
        parts = F.concat_ws("-", F.regexp_extract(bare, p, 1), F.lpad(F.regexp_extract(bare, p, 2), 2, "0"), F.lpad(F.regexp_extract(bare, p, 3), 2, "0"))
        out = F.when(bare.rlike(p), F.coalesce(F.date_format(F.try_to_date(parts, "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))).otherwise(out)
    return out


def repair_date(date: Column, text: Column) -> Column:
    """A date whose day the text does not have for that month takes a day that
    it has: 01 becomes 02 or 07, 07 or 02 become 01, else the month's only day. A
    month that the text does not name, and a null text, change nothing."""
    return let(date, lambda told: _day_of_text(told, text))


def _day_of_text(date: Column, text: Column) -> Column:
    month, day = F.substring(date, 6, 2), F.substring(date, 9, 2)
    form = F.concat(F.substring(date, 1, 4), F.lit(r"\s*[年/\-.]\s*(?:"), month, F.lit("|"), F.regexp_replace(month, "^0", ""), F.lit(r")\s*[月/\-.]\s*([0-3]?\d)"))
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), form, F.lit(1)), lambda x: F.lpad(x, 2, "0"))

    def taken(days: Column) -> Column:
        swaps = F.when((day == "01") & F.array_contains(days, "02"), "02").when((day == "01") & F.array_contains(days, "07"), "07").when(day.isin("07", "02") & F.array_contains(days, "01"), "01").when(F.size(days) == 1, F.get(days, F.lit(0)))
        return F.when(F.array_contains(days, day), date).otherwise(F.coalesce(F.concat(F.substring(date, 1, 8), swaps), date))

    return F.when(date == "", date).otherwise(let(F.array_distinct(F.filter(found, lambda x: x != "00")), taken))


def date_range(text: Column) -> Column:
    """The first range in one of three forms."""
    d = r"\d{4}[年/.-]\d{1,2}[月/.-]\d{1,2}日?"
    return F.coalesce(_first([F.regexp_extract(text, rf"({d})\s*[至到]\s*({d})", 0), F.regexp_extract(text, rf"({d})\s*[-—~]+\s*({d})", 0), F.regexp_extract(text, r"\d{8}\s*-\s*\d{8}", 0)]), F.lit(""))


def other_date(date: Column, text: Column) -> Column:
    """A date equal to the stamp's gives way to the text's first other one."""
    dates = F.transform(F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}"), 0), lambda x: x)
    return F.coalesce(F.get(F.filter(dates, lambda x: x != date), F.lit(0)), date)


def phones(text: Column) -> Column:
    """Phones of a list: bracketed notes in Chinese go, parts with digits stay."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[（(][^）)]*[\\u4e00-\\u9fff]+[^）)]*[）)]", "")
    part = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[^\d+\-()\s]", ""), r"\s{2,}", " "))
    parts = F.transform(F.filter(F.split(bare, "[,，/／、]+"), lambda p: p.rlike(r"\d")), part)
    return F.array_join(F.filter(parts, lambda p: p != ""), "，")


def postal_code(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(\d{6})\b", 1)


def account(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


def letter_number(text: Column, told: Column, barcode: Column) -> Column:
    """The number by the patterns in order, then the one told, then the barcode."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)^no\.?\s*[:：]?\s*", ""), r"第?\s*\d+\s*页.*$", ""))
    return F.coalesce(_first([clean(F.regexp_extract(text, p, 1)) for p in NUMBER_PATTERNS] + [clean(F.coalesce(told, F.lit(""))), F.coalesce(barcode, F.lit(""))]), F.lit(""))


def apply_rules(text: Column, rules: list[tuple[str, str]], swaps: list[tuple[str, str]]) -> Column:
    """Regex rules in order, then literal swaps."""
    done = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), swaps, done)


def zone_value(text: Column, zone: str, stops: list[str], patterns: list[str], fallback: Column) -> Column:
    """The first pattern's value inside the zone between its title and the
    first stop word, else the fallback."""
    start = F.locate(zone, text)
    after = F.when(start > 0, F.substr(text, start + F.lit(len(zone)))).otherwise(F.lit(""))
    ends = [F.when(F.locate(s, after) > 0, F.locate(s, after)) for s in stops]
    cut = F.substring(after, F.lit(1), F.coalesce(F.least(*ends) if len(ends) > 1 else ends[0], F.length(after) + 1) - 1)
    return F.coalesce(_first([F.trim(F.regexp_extract(cut, p, 1)) for p in patterns]), fallback)


def seal_name(text: Column) -> Column:
    """A name without brackets and notes; "" for a bare type word."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[（(][^）)]*[）)]", ""), r"[:：\s]+", ""))
    return F.when(bare.rlike("^(公章|财务专用章|业务章|印章)$") | bare.rlike("会计师事务所"), "").otherwise(bare)


def in_source(value: Column, text: Column, fixed: Column) -> Column:
    """A value that its text holds, blanks aside; else the fixed one; else ""."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")

    def held(source: Column) -> Column:
        there = lambda v: (bare(v) != "") & F.contains(source, bare(v))
        other = let(fixed, lambda v: F.when(there(v), v).otherwise(""))
        return let(value, lambda v: F.when(there(v), v).otherwise(other))

    return let(bare(text), held)


def check_digit(digits: Column) -> Column:
    """The Luhn test on two digits or more."""
    worth = lambda c, i: F.when(i % 2 == 1, F.when(2 * c.cast("int") > 9, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)
    return F.when(digits.rlike("^[0-9]{2,}$"), total % 10 == 0).otherwise(F.lit(False))


def repair_digits(digits: Column) -> Column:
    """With a 1 put before a 7, else after any digit: the first that passes,
    else null; a number that passes stays."""
    places = F.sequence(F.lit(1), F.length(digits))
    put = lambda at: F.concat(F.substring(digits, F.lit(1), at - 1), F.lit("1"), F.substr(digits, at))
    before_seven = F.transform(F.filter(places, lambda k: F.substring(digits, k, F.lit(1)) == "7"), put)
    anywhere = F.transform(places, lambda k: put(k + 1))
    good = F.filter(F.concat(before_seven, anywhere), check_digit)
    return F.when(check_digit(digits), digits).when(F.length(digits) >= 1, F.get(good, F.lit(0)))


def checked(text: Column) -> Column:
    """Whether a box's text says yes."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin(*NO_WORDS), False).when(t.isin(*YES_WORDS), True).otherwise(False)


def seals(array: Column, default: str) -> Column:
    """Seals with upper-case codes without separators and a known colour."""
    return F.transform(
        array,
        lambda s: F.struct(
            F.upper(F.regexp_replace(F.coalesce(s["code"], F.lit("")), r"[\s\-_/.]", "")).alias("code"), F.when(F.lower(s["colour"]).isin("red", "blue", "black"), F.lower(s["colour"])).otherwise(default).alias("colour")
        ),
    )


LETTER_FIELDS = "confirmation_no recipient_bank accounting_firm reply_address contact_person phone postal_code debit_account cutoff_date start_date end_date seal_date signature_name".split()


def _told(text: Column, patterns: list[str]) -> list[Column]:
    return [F.trim(F.regexp_extract(text, p, 1)) for p in patterns]


def letter_record(told: dict[str, Column], text: Column) -> list[Column]:
    """The thirteen fields of a letter, cleaned in order. `told` has what a reader
    gave for each field, `text` the letter; what the text itself tells in one of the
    known forms goes first. Bank and signature count only if the text holds them. A
    field that is not told, and a null, is empty; a null text tells nothing."""
    text = F.coalesce(text, F.lit(""))
    given = {f: F.trim(F.coalesce(told.get(f, F.lit("")), F.lit(""))) for f in LETTER_FIELDS}
    for f in ("signature_name", "recipient_bank"):
        given[f] = F.when(text == "", given[f]).otherwise(in_source(given[f], text, apply_rules(F.regexp_replace(given[f], r"\s+", ""), SLIPS, [])))
    spelled = lambda c: apply_rules(c, [], SWAPS)
    slips = lambda c: apply_rules(c, SLIPS, [])

    firm = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, FIRM_END, "")), r"[，。、；\s]+$", "")
    unbracketed = lambda c: F.regexp_replace(c, r"[\[\]【】]", "")
    firms = [firm(x) for x in _told(unbracketed(text), FIRM_PATTERNS)] + [firm(unbracketed(given["accounting_firm"]))]

    stops = [F.when(F.locate(w, text) > 1, F.locate(w, text)) for w in REPLY_ENDS]
    zone = F.substr(text, F.lit(1), F.coalesce(F.least(*stops), F.length(text) + 1) - 1)
    after = lambda z: F.regexp_extract(z, REPLY_ADDRESS, 1)
    name = lambda z: F.coalesce(_first(_told(z, REPLY_NAMES) + _told(after(z), LATER_NAMES)), F.lit(""))
    near = lambda z: let(name(z), lambda n: F.when(n != "", F.substr(z, F.instr(z, n), F.lit(150))).otherwise(""))
    phone = F.coalesce(let(zone, lambda z: _first(_told(near(z), [PHONE]) + _told(after(z), [PHONE]))), given["phone"])
    contact = F.coalesce(_first([let(zone, name)]), given["contact_person"])
    misread = lambda c: F.when(c.isin(MISREAD_NAMES) & text.rlike(SEAL_OF_FIRM), READ_NAME).otherwise(c)
    contact = let(F.trim(F.regexp_replace(contact, GLUED, "")), misread)
    contact = F.regexp_replace(contact, r"^[_. ]+|[_. ]+$", "")

    fixed = lambda day: repair_date(day, text)
    end_of = lambda g, f: fixed(clean_date(F.coalesce(_first([F.regexp_extract(text, p, g) for p in RANGE_PATTERNS]), given[f])))
    stamp = clean_date(F.concat_ws("-", *[F.regexp_extract(text, STAMP, g) for g in (1, 2, 3)]))
    signed = F.array(*[clean_date(x) for x in _told(text, SIGNED_PATTERNS)])
    unlike = lambda mark: F.get(F.filter(signed, lambda x: (x != "") & (x != mark)), F.lit(0))
    sealed = let(
        F.struct(clean_date(given["seal_date"]).alias("day"), stamp.alias("mark")),
        lambda s: F.when((s["mark"] != "") & (s["day"] == s["mark"]), F.coalesce(unlike(s["mark"]), s["day"])).otherwise(s["day"]),
    )

    to = lambda c: F.regexp_replace(c, r"^致[:：]?\s*", "")
    bank_given = F.regexp_replace(to(given["recipient_bank"]), r"(?s)[(（]\s*以下简称.*$", "")
    made = {
        "confirmation_no": letter_number(text, given["confirmation_no"], F.regexp_extract(text, BARCODE, 1)),
        "recipient_bank": spelled(F.coalesce(_first([to(x) for x in _told(text, BANK_PATTERNS)]), bank_given)),
        "accounting_firm": F.coalesce(slips(spelled(_first(firms))), F.lit("")),
        "reply_address": slips(given["reply_address"]),
        "contact_person": contact,
        "phone": phones(phone),
        "postal_code": postal_code(given["postal_code"]),
        "debit_account": account(F.coalesce(_first(_told(text, DEBIT_PATTERNS)), given["debit_account"])),
        "cutoff_date": fixed(clean_date(given["cutoff_date"])),
        "start_date": end_of(1, "start_date"),
        "end_date": end_of(2, "end_date"),
        "seal_date": fixed(sealed),
        "signature_name": seal_name(given["signature_name"]),
    }
    return [made[f].alias(f) for f in LETTER_FIELDS]
