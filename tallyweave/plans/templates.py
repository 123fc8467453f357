"""The statement templates: for each, the canonical columns of its transactions and of
its summary, with the label that stands for them in a statement."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import money
from tallyweave.operators.statement import Mapping, Registry

# The canonical columns of each template's transactions, and their labels.
TRANSACTIONS = {
    "shandong_local": {
        "sequence": "序号",
        "transaction_time": "交易时间",
        "channel": "交易渠道",
        "income": "收入",
        "expense": "支出",
        "balance": "账户余额",
        "currency": "币种",
        "counterparty_account": "对方账号",
        "counterparty_name": "对方户名",
        "description": "摘要备注",
    },
    "everbright": {
        "sequence": "序号",
        "transaction_date": "交易日期",
        "transaction_time": "时间",
        "debit_credit": "借/贷",
        "amount": "交易金额",
        "balance": "账户余额",
        "counterparty_account": "对方账号",
        "counterparty_name": "对方名称",
        "voucher_no": "凭证号",
        "description": "摘要",
        "serial_no": "流水号",
    },
    "cmb": {
        "serial_no": "交易流水号",
        "transaction_date": "交易日期",
        "debit_amount": "借方(出账)",
        "credit_amount": "贷方(入账)",
        "balance": "余额",
        "counterparty_name": "收(付)方名称",
        "counterparty_account": "收(付)方账号",
        "description": "摘要",
        "transaction_type": "交易类型",
        "card_no": "公司一卡通号",
        "print_instance_no": "打印实例号",
    },
    "jining": {
        "sequence": "序号",
        "transaction_date": "记账日期",
        "channel": "交易渠道",
        "income": "收入",
        "expense": "支出",
        "balance": "账户余额",
        "description": "摘要备注",
        "counterparty_info": "交易对手信息",
    },
    "cgb": {
        "serial_no": "流水号",
        "transaction_time": "交易时间",
        "income": "收入",
        "expense": "支出",
        "balance": "余额",
        "currency": "币种",
        "counterparty_account": "对方账号",
        "counterparty_name": "对方户名",
        "transaction_branch": "交易行所",
        "counterparty_bank_code": "对方开户行联行号",
        "counterparty_bank": "对方开户行",
        "voucher_no": "凭证号",
        "description": "摘要",
        "remark": "备注",
        "postscript": "附言",
    },
    "psbc": {
        "serial_no": "交易流水号",
        "global_route_no": "全局路由号",
        "transaction_time": "交易时间",
        "transaction_date": "记账日期",
        "income": "收入金额",
        "expense": "支出金额",
        "balance": "余额",
        "counterparty_account": "对方账号",
        "counterparty_name": "对方户名",
        "counterparty_bank": "对方行名",
        "purpose": "用途",
        "postscript": "附言",
        "description": "摘要",
    },
    "icbc": {
        "transaction_time": "交易时间",
        "income": "转入金额",
        "expense": "转出金额",
        "counterparty_account": "对方账号",
        "debit_credit": "借贷标志",
        "counterparty_name": "对方单位",
        "counterparty_bank_code": "对方行号",
        "description": "摘要",
        "purpose": "用途",
    },
    "ccb": {
        "account_number": "账号",
        "transaction_time": "交易时间",
        "debit_amount": "借方发生额",
        "credit_amount": "贷方发生额",
        "balance": "余额",
        "currency": "币种",
        "counterparty_name": "对方户名",
        "counterparty_account": "对方账号",
        "counterparty_bank": "对方开户机构",
        "booking_date": "记账日期",
        "description": "摘要",
        "remark": "备注",
        "transaction_serial": "账户明细编号-交易流水号",
        "enterprise_serial": "企业流水号",
        "voucher_type": "凭证种类",
        "voucher_number": "凭证号",
        "transaction_medium": "交易介质编号",
    },
    "abc": {
        "transaction_time": "交易时间",
        "income": "收入金额",
        "expense": "支出金额",
        "balance": "账户余额",
        "counterparty_account": "对方账号",
        "counterparty_name": "对方户名",
        "counterparty_bank": "对方开户行",
        "description": "摘要",
    },
    "boc": {
        "sequence": "序号",
        "booking_date": "记账日",
        "value_date": "起息日",
        "transaction_type": "交易类型",
        "voucher": "凭证",
        "transaction_details": "凭证号业务号用途摘要",
        "debit_amount": "借方发生额",
        "credit_amount": "贷方发生额",
        "balance": "余额",
        "reference_no": "机构柜员流水",
        "notes": "备注",
    },
    "bocom": {
        "sequence": "序号",
        "accounting_date": "会计日期",
        "transaction_date": "交易日期",
        "transaction_name": "交易名称",
        "voucher_type": "凭证种类",
        "voucher_number": "凭证号码",
        "debit_amount": "借方发生额",
        "credit_amount": "贷方发生额",
        "balance": "余额",
        "card_number": "卡号",
        "transaction_location": "交易地点",
        "counterparty_account": "对方账号",
        "counterparty_name": "对方户名",
        "counterparty_bank": "对方行名",
        "description": "摘要",
        "serial_no": "流水号",
    },
}

# The same of each template's summary.
SUMMARIES = {
    "shandong_local": {
        "account_name": "账户名称",
        "account_number": "账(卡)号",
        "date_range": "起止日期",
        "income_count": "收入总笔数",
        "income_total": "收入总金额",
        "expense_count": "支出总笔数",
        "expense_total": "支出总金额",
        "has_stamp": "是否有盖章",
        "bank_name": "开户行",
        "stamp_type": "盖章类型",
    },
    "everbright": {
        "account_name": "账户名称",
        "account_number": "账号",
        "date_range": "交易日期",
        "debit_amount": "借方发生额",
        "credit_amount": "贷方发生额",
        "debit_count": "借方笔数",
        "credit_count": "贷方笔数",
    },
    "cmb": {
        "account_number": "账号",
        "account_name": "账号名",
        "start_date": "开始日期",
        "end_date": "结束日期",
        "debit_count": "出账总笔数",
        "credit_count": "入账总笔数",
        "debit_total": "出账总金额",
        "credit_total": "入账总金额",
        "total_count": "笔数",
    },
    "jining": {
        "account_number": "账号",
        "account_name": "账户名称",
        "date_range": "起止日期",
        "currency": "币种",
        "income_total": "收入金额合计",
        "expense_total": "支出金额合计",
        "bank_name": "开户机构",
    },
    "cgb": {
        "account_name": "户名",
        "account_number": "账号",
        "date_range": "起止日期",
        "currency": "币种",
        "unit": "单位",
        "expense_total": "支出总金额",
        "expense_count": "支出总笔数",
        "income_total": "收入总金额",
        "income_count": "收入总笔数",
        "current_balance": "账户当前余额",
        "record_count": "记录数",
    },
    "psbc": {
        "account_name": "户名",
        "account_number": "账号",
        "income_total": "收入总金额",
        "expense_total": "支出总金额",
        "income_count": "收入总笔数",
        "expense_count": "支出总笔数",
        "start_date": "起始日期",
        "end_date": "结束日期",
    },
    "icbc": {
        "account_number": "账号",
        "account_name": "本方账号户名",
        "currency": "币种",
        "bank_name": "本方账号开户行",
        "date_range": "财务日期范围",
    },
    "ccb": {
        "account_name": "本方户名",
        "print_date": "打印日期",
    },
    "abc": {
        "account_number": "账号",
        "account_name": "户名",
        "currency": "币种",
        "date_range": "起止日期",
        "income_count": "总收入笔数",
        "income_total": "总收入金额",
        "expense_count": "总支出笔数",
        "expense_total": "总支出金额",
    },
    "boc": {
        "account_number": "账号",
        "account_name": "账户名称",
        "currency": "币种",
        "account_type": "账户类型",
        "bank_name": "开户行",
        "start_date": "起始日期",
        "end_date": "截止日期",
    },
    "bocom": {
        "bank_branch": "开户机构",
        "account_number": "账号",
        "account_name": "户名",
        "currency": "币种",
        "year": "年份",
        "month": "月份",
    },
}

#: Templates whose missing sequence stays null.
UNNUMBERED = ("boc", "bocom")
_MONEY = ("income", "expense", "balance", "amount", "total")


def registry(tables: dict[str, dict[str, str]]) -> Registry:
    """The templates, shandong_local for unknown ones. Columns of money
    are cleaned, all others are text; blank is null."""
    made = Registry("shandong_local")
    for key, labels in tables.items():
        made.add(key, Mapping(labels, {n: money.decimal_of for n in labels if n.endswith(_MONEY)}, key not in UNNUMBERED))
    return made


#: Forms of a configured template's dates and times, tried in order.
DATE_FORMS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d HH:mm:ss", "yyyy/M/d", "yyyy年M月d日", "yyyyMMddHHmmss", "yyyyMMdd"]


_DIGITS, _BLANKS = "0123456789", " \t\n\x0b\f\r"


def date_time(text: Column) -> Column:
    """A date or time of one of the usual forms as yyyy-MM-dd HH:mm:ss, null else. Only the
    forms that have the text's marks are tried, as each that fails costs an exception."""
    bare = F.regexp_replace(F.trim(text), r"\s+", " ")
    # A year may have a sign. Digits and blanks aside, a text that a form reads has the form's marks.
    marks = F.translate(F.ltrim(text, F.lit(_BLANKS + "+-")), _DIGITS + _BLANKS, "")
    forms: dict[str, list[str]] = {}
    for f in DATE_FORMS:
        forms.setdefault(re.sub(r"[A-Za-z ]", "", f), []).append(f)
    read, made = lambda f: F.try_to_timestamp(bare, F.lit(f)), F.lit(None).cast("timestamp")
    for own, same in forms.items():
        # Of forms with the same marks, one is tried where the text is long enough.
        tried = F.coalesce(*[F.when(F.length(text) >= len(f), read(f)) for f in same])
        made = F.when(marks == own, tried).otherwise(made)
    return F.date_format(made, "yyyy-MM-dd HH:mm:ss")


def read_configs(spark: SparkSession, path: str) -> list[dict]:
    """The templates under a path, one JSON object a file, by the files' names. They
    are configuration: a few small files, which come to the driver."""
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path").orderBy("file_path").collect()
    return [json.loads(r.value) for r in rows]


def from_config(config: dict) -> Mapping:
    """A mapping from a configured template, whose transaction_schema lists
    {label: {"field", "type"}} with types string, datetime and amount."""
    fields = [(label, told) for entry in config["transaction_schema"] for label, told in entry.items()]
    kinds = {"amount": money.decimal_of, "datetime": date_time, "string": lambda text: text}
    return Mapping({told["field"]: label for label, told in fields}, {told["field"]: kinds[told.get("type", "string")] for _, told in fields})


def configured(configs: list[dict], default: str) -> Registry:
    """A registry of configured templates, by their template_id."""
    made = Registry(default)
    for config in configs:
        made.add(config["template_id"], from_config(config))
    return made


def recognised(text: Column, configs: list[dict]) -> Column:
    """The first template one of whose keywords the text has, in any case."""
    has = [F.when(F.lower(text).rlike("|".join("\\Q" + k.lower() + "\\E" for k in c["detection"]["keywords"])), F.lit(c["template_id"])) for c in configs]
    return F.coalesce(*has) if has else F.lit(None).cast("string")


def summary_of(text: Column, config: dict) -> dict[str, Column]:
    """A summary's fields, each by its own pattern, null where it does not match;
    lines of the text are matched one by one."""
    found = {told["field"]: F.regexp_extract(text, "(?m)" + told["pattern"], 1) for told in config.get("summary_schema", {}).values()}
    return {name: F.when(F.trim(value) != "", F.trim(value)) for name, value in found.items()}
