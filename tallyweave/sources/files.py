"""Sources and sinks: payload pages, file checks, cells, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.money import indicator_name, ledger_code, ledger_number

# How many header rows a ledger has, among how many, and their words.
HEADER_ROWS, HEADER_SCAN = 4, 12
HEADER_WORDS = {
    "period": {"本期": "cur", "上期": "pre"},
    "scope": {"本外币": "foreign", "美元合计": "foreign_total", "人民币": "rmb"},
    "measure": {"发生额": "occur", "余额": "balance"},
}
LEDGER_MEASURES = [f"{p}_{s}_{m}" for p in ("cur", "pre") for s in ("rmb", "foreign", "foreign_total") for m in ("balance", "occur")]


def page_number(path: Column) -> Column:
    """The page that a file's name tells: page_N, else its first number less one."""
    name = F.element_at(F.split(path, "/"), -1)
    named, first = F.regexp_extract(name, r"page_(\d+)", 1), F.regexp_extract(name, r"(\d+)", 1)
    return F.when(named != "", named.cast("int")).when(first != "", first.cast("int") - 1)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, payload) of the payload files under a path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), page_number(F.col("_metadata.file_path")).alias("page"), F.col("value").alias("payload"))


def records(pages: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): each object of a payload as a map, a single
    object like a list of one; payloads that do not parse are set aside."""
    listed = F.when(F.trim(payload).startswith("{"), F.concat(F.lit("["), payload, F.lit("]"))).otherwise(F.col(payload))
    parsed = pages.withColumn("__p", F.from_json(listed, "array<map<string,string>>"))
    good = parsed.where(F.col("__p").isNotNull() & (F.size("__p") > 0))
    bad = parsed.where(F.col("__p").isNull() | (F.size("__p") == 0)).drop("__p")
    rest = [c for c in pages.columns if c != payload]
    return good.select(*rest, F.posexplode("__p").alias("pos", "record")), bad


def schema_of(fields: list[dict]) -> T.StructType:
    """A schema from a user's field list: string, number, array, object_array."""
    kinds = {"string": T.StringType(), "number": T.DoubleType(), "array": T.ArrayType(T.StringType())}

    def kind(field: dict) -> T.DataType:
        if field["type"] == "object_array":
            return T.ArrayType(schema_of(field.get("children", [])))
        if field["type"] not in kinds:
            raise ValueError(f"unknown field type {field['type']}")
        return kinds[field["type"]]

    return T.StructType([T.StructField(f["name"], kind(f)) for f in fields])


def check_pdf(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Whether a file is named and begins like a PDF, and why not."""
    named, begun = F.lower(path).endswith(".pdf"), F.substring(F.col(content), 1, 4) == F.lit(b"%PDF")
    reason = F.when(~named, "extension").when(F.length(content) == 0, "empty").when(~begun, "header").otherwise("")
    return files.select(path, (reason == "").alias("ok"), reason.alias("reason"))


def changed_sources(sources: DataFrame, saved: DataFrame, key: str, content: str) -> DataFrame:
    """Sources whose SHA-256 is not the saved one, new ones too."""
    now = sources.select(key, F.sha2(F.coalesce(content, F.lit("")), 256).alias("now"))
    return now.join(saved, key, "left").where(~F.col("now").eqNullSafe(F.col("saved")))


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells of a merged range take its top-left value. Ranges are few and small,
    so each names its cells and the join is an equi join."""
    rows = F.explode(F.sequence("top", "bottom")).alias("row_no")
    named = ranges.select("file", "sheet", "top", "left", rows, "right").withColumn("col_no", F.explode(F.sequence("left", "right")))
    corner = cells.select("file", "sheet", F.col("row_no").alias("top"), F.col("col_no").alias("left"), F.col("value").alias("corner"))
    filled = named.join(corner, ["file", "sheet", "top", "left"]).select("file", "sheet", "row_no", "col_no", "corner")
    return cells.join(filled, ["file", "sheet", "row_no", "col_no"], "full").select("file", "sheet", "row_no", "col_no", F.coalesce("corner", "value").alias("value"))


def complete_sheet_names(sheets: DataFrame) -> DataFrame:
    """An all-digit name takes the letters that the file's first sheet begins with."""
    first = F.first("sheet").over(Window.partitionBy("file").orderBy("sheet_no"))
    prefix = F.regexp_extract(first, r"^([A-Za-z]+)", 1)
    return sheets.withColumn("name", F.when(F.col("sheet").rlike(r"^\d+$"), F.concat(prefix, "sheet")).otherwise(F.col("sheet")))


def ledger_grid(cells: DataFrame, headers: int, measures: dict[str, str]) -> DataFrame:
    """S3: records from a grid with several header rows. The lowest header of a
    column that names a measure wins; measures become columns, one row for each
    (file, sheet, row)."""
    ranked = cells.withColumn("__h", F.dense_rank().over(Window.partitionBy("file", "sheet").orderBy("row_no")))
    word = F.create_map(*[F.lit(x) for pair in measures.items() for x in pair])
    heads = ranked.where(F.col("__h") <= headers).withColumn("measure", F.element_at(word, F.col("value"))).where("measure is not null")
    named = heads.groupBy("file", "sheet", "col_no").agg(F.max_by("measure", "row_no").alias("measure"))
    body = ranked.where(F.col("__h") > headers).join(named, ["file", "sheet", "col_no"])
    return body.groupBy("file", "sheet", "row_no").pivot("measure", sorted(set(measures.values()))).agg(F.first("value"))


def _word_of(text: Column, words: dict[str, str], alone: bool) -> Column:
    """The value whose word a header has: the only one if `alone`, else the first."""
    hits = F.array_compact(F.array(*[F.when(text.contains(w), F.lit(v)) for w, v in words.items()]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))) if alone else F.get(hits, F.lit(0))


def header_fields(cells: DataFrame, headers: int = HEADER_ROWS, scan: int = HEADER_SCAN) -> DataFrame:
    """S3: (file, sheet, field, col_no, last_header) that the header rows of each sheet
    name. Headers are the first `headers` rows with a value among the first `scan`, the
    topmost of them is a title; a sheet with fewer has none. A column tells its period,
    scope and measure by the lowest header with just one of the words, else by the
    first word in all its headers together. Of columns of one field the last counts."""
    value = F.trim(F.regexp_replace("value", r"\s+", " "))
    top = cells.where((F.col("row_no") <= scan) & (value != "")).select("file", "sheet", "row_no", "col_no", value.alias("value"))
    ranked = top.withColumn("rank", F.dense_rank().over(Window.partitionBy("file", "sheet").orderBy("row_no"))).where(F.col("rank") <= headers)
    whole = F.max("rank").over(Window.partitionBy("file", "sheet")) == headers
    last = F.max("row_no").over(Window.partitionBy("file", "sheet"))
    kept = ranked.withColumn("whole", whole).withColumn("last_header", last).where("whole and rank > 1")
    told = [F.max_by(_word_of(F.col("value"), words, True), F.when(_word_of(F.col("value"), words, True).isNotNull(), F.col("rank"))).alias(name) for name, words in HEADER_WORDS.items()]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), "").alias("joined")
    columns = kept.groupBy("file", "sheet", "last_header", "col_no").agg(*told, joined).withColumn("joined", F.replace("joined", F.lit(" ")))
    period, scope, measure = [F.coalesce(name, _word_of(F.col("joined"), words, False)) for name, words in HEADER_WORDS.items()]
    field = F.when(F.col("joined").rlike("指标编号|指标代码"), "code").when(F.col("joined").contains("指标名称"), "name").otherwise(F.concat(period, F.lit("_"), scope, F.lit("_"), measure))
    return columns.withColumn("field", field).where("field is not null").groupBy("file", "sheet", "field").agg(F.max("col_no").alias("col_no"), F.max("last_header").alias("last_header"))


def ledger_records(cells: DataFrame) -> DataFrame:
    """S3: a ledger's records, one for each row below the headers with code and name:
    file, sheet, row_no, code, name and the twelve measures as numbers (null where the
    sheet has no such column or the cell no number). Sheets without code or name
    columns give none."""
    fields = header_fields(cells)
    body = cells.join(fields, ["file", "sheet", "col_no"]).where(F.col("row_no") > F.col("last_header"))
    rows = body.groupBy("file", "sheet", "row_no").pivot("field", ["code", "name", *LEDGER_MEASURES]).agg(F.first("value"))
    code, name = ledger_code(F.col("code")), F.trim("name")
    return rows.where((code != "") & (indicator_name(name) != "")).select("file", "sheet", "row_no", code.alias("code"), name.alias("name"), *[ledger_number(F.col(m)).alias(m) for m in LEDGER_MEASURES])


def flatten(df: DataFrame, prefix: str = "") -> list[Column]:
    """Columns of nested structs under dotted names."""
    out: list[Column] = []

    def walk(kind: T.StructType, path: str) -> None:
        for f in kind.fields:
            name = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, name)
            else:
                out.append(F.col(name).alias(name))

    walk(df.schema, prefix)
    return out


def parallel_arrays(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """One row for each place of the longest array; short ones are padded with
    empty text, other columns repeat."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    rows = df.select(*keys, F.posexplode_outer(zipped).alias("pos", "z"))
    return rows.select(*keys, "pos", *[F.coalesce(F.col(f"z.{a}").cast("string"), F.lit("")).alias(a) for a in arrays])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, blanks kept, UTF-8 without a byte order mark."""
    df.write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def export(summary: DataFrame, detail: DataFrame, path: str, order: list[str]) -> None:
    """The header block and the details in the template's column order."""
    write_csv(summary, f"{path}/summary")
    write_csv(detail.select(*order), f"{path}/detail")


def split_by_summary(summaries: DataFrame, detail: DataFrame, path: str, key: str = "summary_id") -> None:
    """One folder of each summary with its own rows; unlinked rows go along when
    there is one summary only."""
    ids = summaries.select(key).limit(2).collect()
    rows = detail.withColumn(key, F.coalesce(key, F.lit(ids[0][0]))) if len(ids) == 1 else detail.join(summaries.select(key), key, "left_semi")
    rows.write.mode("overwrite").partitionBy(key).parquet(path)


def append_log(diffs: DataFrame, path: str) -> None:
    """Differences appended to a log of JSON lines."""
    diffs.write.mode("append").json(path)


def replace_batches(df: DataFrame, path: str, key: str = "batch_id") -> None:
    """The batches in df replace theirs, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def drop_file(table: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """A table without the rows of the given files."""
    return table.join(files.select(key), key, "left_anti")
