"""Readers of delimited result tables, matrices and text records; every column stays text until it is mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from concordat.operators.inspection import linked_files
from concordat.sources import quoted
from concordat.sources.ooxml import read_sheets

# Words for delimiters.
SEPARATORS = {"tab": "\t", "tabs": "\t", "\\t": "\t", "t": "\t", "tsv": "\t", "comma": ",", "csv": ",", "semicolon": ";", "semi": ";", "pipe": "|", "bar": "|", "space": " ", "whitespace": r"\s+", "ws": r"\s+"}

#: Columns of harmonised rows that aren't text.
HARMONIZED = {
    **dict.fromkeys(("lfc", "pvalue", "padj", "signed_z", "abs_signed_z", "within_study_rank", "normalized_rank", "n_ctrl", "n_treat", "rank_universe_size_declared"), "double"),
    **dict.fromkeys(("n_genes_in_study", "n_source_rows_for_gene", "rank_universe_size_used"), "int"),
    **dict.fromkeys(("n_rows_in_source_table", "n_reported_rows_after_filter", "n_scope_significant_rows_le_0_05"), "bigint"),
    "pvalue_was_clipped": "boolean",
}


def separator(value: str | None, path: str = "") -> str:
    """The delimiter that a word, a character or else the file's suffix stands for."""
    if value is None or value == "":
        bare = path.lower().removesuffix(".gz")
        return "\t" if bare.endswith((".tsv", ".txt")) else ","
    return SEPARATORS.get(value.strip().lower() or value, value)


def restored_labels(columns: list[str]) -> list[str]:
    """Column names with an unnamed first column called row_name (row_name_2, ... where that is taken)."""
    out = list(columns)
    for k, name in enumerate(out):
        if name == "" or name == f"_c{k}" or name.startswith("Unnamed:"):
            new, n = "row_name", 2
            while new in out:
                new, n = f"row_name_{n}", n + 1
            out[k] = new
    return out


def read_table(spark: SparkSession, path: str, sep: str | None = None, sheet: str | int | None = None, *, order: bool = False) -> DataFrame:
    """A delimited table (plain or gzip) or a workbook's sheet as text columns. Quoted cells may hold line breaks.

    A header one field short of its rows lacks the name of row labels, which come first. A table whose one column shows
    another delimiter is refused. order: see read_after_header.
    """
    if path.lower().endswith(".xlsx"):
        return read_sheet(spark, path, sheet)
    mark = separator(sep, path)
    if mark == r"\s+":
        lines = spark.read.text(path).filter(F.trim("value") != "")
        names = F.split(F.trim("value"), r"\s+")
        head, first = (lines.select(names.alias("n"), F.size(names).alias("k")).limit(2).collect() + [None])[:2]
        body = lines.select(names.alias("n")).filter(F.col("n") != F.array(*map(F.lit, head.n)))
        columns = restored_labels([""] * (first is not None and first.k == head.k + 1) + head.n)
        return body.select(*[F.get("n", F.lit(k)).alias(c) for k, c in enumerate(columns)])
    return read_after_header(spark, path, 1, sep, order=order)


def read_sheet(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    """A workbook's sheet (the first one by default) as text columns; workbooks are small and read on the driver."""
    sheets = read_sheets(path)
    names = list(sheets)
    chosen = names[int(sheet)] if sheet is not None and str(sheet).isdigit() and str(sheet) not in names else (sheet or names[0])
    if chosen not in sheets:
        raise KeyError(f"{path} has no sheet {sheet!r}; its sheets are {names}")
    rows = [r for r in sheets[chosen] if any(v not in (None, "") for v in r)]
    columns = restored_labels(["" if v is None else str(v) for v in rows[0]])
    schema = StructType([StructField(c, StringType()) for c in columns])
    cells = [tuple(None if k >= len(r) or r[k] is None else str(r[k]) for k in range(len(columns))) for r in rows[1:]]
    return spark.createDataFrame(cells, schema)


def resolved(table: DataFrame, column: str) -> str:
    """The table's name for a requested column; "Unnamed: 0" and the like mean the restored row names."""
    if column not in table.columns and column.startswith("Unnamed:") and "row_name" in table.columns:
        return "row_name"
    return column


def read_after_header(spark: SparkSession, path: str, header_row: int, sep: str | None = None, *, order: bool = False) -> DataFrame:
    """A delimited table whose header stands on the given line (from 1), as text columns; lines before it are dropped.

    Plain files are read in splits (see quoted.py), gzip files one to a task. order: add source_order, which follows the
    files by name and the lines of a file (plain files without such a column only).
    """
    mark = separator(sep, path)
    if path.lower().endswith(".gz"):
        if header_row != 1:
            raise ValueError(f"{path} is compressed, so its lines have no number; unpack it first")
        zipped = spark.read.csv(path, sep=mark, escape='"', multiLine=True, header=False).first()
        head = ["" if x is None else x for x in zipped] if zipped else []
        columns = restored_labels(_checked(head, mark, path))
        return spark.read.schema(StructType([StructField(c, StringType()) for c in columns])).csv(path, sep=mark, escape='"', multiLine=True, header=True)
    found = quoted.Table(spark, path, mark, header_row)
    head = _checked(found.header, mark, path)
    short = found.sample is not None and len(found.sample) == len(head) + 1
    columns = restored_labels([""] * short + head)
    if order and "source_order" not in columns:
        return found.rows(columns)
    return found.rows(columns, "__order").drop("__order")


def _checked(head: list[str], mark: str, path: str) -> list[str]:
    if len(head) == 1:
        for other in "\t,;|":
            if other != mark and len([x for x in head[0].split(other) if x.strip()]) >= 3:
                raise ValueError(f"{path} has one column by {mark!r}, but its header splits by {other!r}")
    return head


def read_harmonized(spark: SparkSession, path: str) -> DataFrame:
    """Harmonised rows: Parquet, or CSV whose number columns are read as such and all else as text."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.withColumns({c: F.col(c).try_cast(kind) for c, kind in HARMONIZED.items() if c in rows.columns})


def soft_series(lines: DataFrame) -> DataFrame:
    """key = value lines (value, line) of a series record: (key, values: distinct, in order)."""
    parts = F.split("value", " = ", 2)
    pairs = lines.filter(F.col("value").startswith("!Series_")).select(F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("v"), "line")
    each = pairs.filter("v <> ''").groupBy("key", "v").agg(F.min("line").alias("line"))
    return each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "v"))), lambda x: x["v"]).alias("values"))


def soft_samples(lines: DataFrame, record: str = "record") -> DataFrame:
    """Samples of SOFT text (record, line, value): (record, sample, title, source, characteristics). Sections begin at ^SAMPLE."""
    at = Window.partitionBy(record).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.regexp_extract("value", r"^\^SAMPLE\s*=\s*(\S+)", 1)
    held = lines.withColumn("sample", F.last(F.when(begun != "", begun), ignorenulls=True).over(at)).filter("sample is not null")
    parts = F.split("value", " = ", 2)
    pairs = held.select(record, "sample", "line", F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("v"))
    first = lambda key: F.min_by(F.when(F.col("key") == key, F.col("v")), F.when(F.col("key") == key, F.col("line")))
    traits = F.transform(F.array_sort(F.collect_list(F.when(F.col("key").startswith("!Sample_characteristics"), F.struct("line", "v")))), lambda x: x["v"])
    return pairs.groupBy(record, "sample").agg(first("!Sample_title").alias("title"), first("!Sample_source_name_ch1").alias("source"), traits.alias("characteristics"))


def matrix_rows(lines: DataFrame) -> DataFrame:
    """The table lines of a series matrix: after its begin mark, without ! lines."""
    begin = lines.filter(F.col("value").startswith("!series_matrix_table_begin")).agg(F.min("line").alias("at")).scalar()
    return lines.filter((F.col("line") > F.coalesce(begin, F.lit(-1))) & ~F.col("value").startswith("!") & (F.trim("value") != ""))


def links(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(name, url) of every object anywhere in JSON texts that has an address, each address once."""
    found = F.pandas_udf(linked_files, "array<struct<name:string,url:string>>")
    each = payloads.select(F.explode(found(column)).alias("x")).select("x.*")
    return each.groupBy("url").agg(F.min("name").alias("name")).select("name", "url")


def soft_summary(lines: DataFrame) -> DataFrame:
    """One row of a series record's (value, line): title, summary, design, supplementary_files, pubmed_ids, taxa."""
    parts = F.split("value", "=", 2)
    pairs = lines.filter(F.contains("value", F.lit("="))).select(F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("v"), "line")
    listed = lambda key: F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == key, F.struct("line", "v")))), lambda x: x["v"])
    return pairs.agg(
        F.coalesce(F.max_by(F.when(F.col("key") == "!Series_title", F.col("v")), F.when(F.col("key") == "!Series_title", F.col("line"))), F.lit("")).alias("title"),
        F.array_join(listed("!Series_summary"), " ").alias("summary"),
        F.array_join(listed("!Series_overall_design"), " ").alias("design"),
        F.array_distinct(listed("!Series_supplementary_file")).alias("supplementary_files"),
        F.array_distinct(listed("!Series_pubmed_id")).alias("pubmed_ids"),
        F.array_sort(F.collect_set(F.when(F.col("key").endswith("_organism_ch1") & (F.col("v") != ""), F.col("v")))).alias("taxa"),
    )


def settings(rows: list[list]) -> dict[str, str]:
    """Key and value rows of a settings sheet; blank keys, comments and a heading are passed over."""
    out: dict[str, str] = {}
    for row in rows:
        key = "" if not row or row[0] is None else str(row[0]).strip()
        if key and not key.startswith("#") and key.lower() not in ("key", "setting", "field"):
            out[key] = "" if len(row) < 2 or row[1] is None else str(row[1]).strip()
    return out


def read_settings(path: str, sheets: tuple[str, ...] = ("Project", "AdvancedSettings")) -> dict[str, str]:
    """The settings of a workbook's sheets; later sheets win."""
    found = read_sheets(path)
    return {k: v for name in sheets if name in found for k, v in settings(found[name]).items()}
