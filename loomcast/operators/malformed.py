"""Rows that fail to parse, with the reason, beside the typed valid rows (problem 5).

Lines are cut into fields by the separator their file's header shows; records explode into cells (record, column, text,
number), and a cell without column says what is wrong with the record as a whole; a rule table is joined by column, every cell
is judged, bad cells are gathered into error rows, and an anti-join with the errors leaves the clean rows, which are pivoted
back and typed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.session import materialise

#: Parts that a file's lines are spread over when they meet their header.
FILE_SALTS = 32

# A day, alone or followed by T or one space and a time of day; a plain decimal.
DAY_PATTERN = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?\z"
DECIMAL_PATTERN = r"^[+-]?[0-9]+([.][0-9]+)?\z"
SEPARATORS = ("\t", ";", ",")


@dataclass(frozen=True)
class Rule:
    """What a column's cells must be: ``date``, or ``number`` within lo..hi (None: open), whole if asked."""

    column: str
    kind: str
    lo: float | None = None
    hi: float | None = None
    whole: bool = False


READING_RULES = (Rule("event_date", "date"), Rule("lat", "number", -90.0, 90.0), Rule("lon", "number", -180.0, 180.0), Rule("fatalities", "number", 0.0, None, True))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.column, r.kind, r.lo, r.hi, r.whole) for r in rules], "column string, kind string, lo double, hi double, whole boolean")


def valid_day(text: Column) -> Column:
    """The date part of a well-formed text as a date, else null; spaces at both ends aside, years from 0001."""
    stripped = F.btrim(text, F.lit(" "))
    ok = stripped.rlike(DAY_PATTERN) & ~stripped.startswith("0000")
    return F.when(ok, F.substring(stripped, 1, 10)).try_cast("date")


def plain_decimal(text: Column) -> Column:
    """The value of a plain decimal, else null; spaces at both ends aside."""
    stripped = F.btrim(text, F.lit(" "))
    return F.when(stripped.rlike(DECIMAL_PATTERN), stripped.try_cast("double"))


# --- lines to fields -----------------------------------------------------------


def _field(sep: str) -> str:
    """One field; possessive, so that matching neither backtracks nor recurses however long the line is."""
    return f'"[^"]*+(?:""[^"]*+)*+"|[^"{sep}]*+'


def _by_separator(make) -> Column:  # noqa: ANN001
    out = None
    for sep in SEPARATORS:
        out = F.when(F.col("sep") == sep, make(sep)) if out is None else out.when(F.col("sep") == sep, make(sep))
    return out


def split_lines(lines: DataFrame) -> DataFrame:
    """``line_id, file_name, line_no, raw_line`` to ``row_key, quoted_well, names, cells`` for every record.

    A header (the least line_id with line_no 1 of a file) shows separator and columns; it may start with a byte order
    mark. Header lines and lines that are null, empty or of spaces only are no records. ``cells`` is null where quoting is
    broken; quotes are taken off and doubled ones made single. A line whose file has no header has null ``names``.
    One file may hold a third of all lines: lines are spread by salt when they meet their header, which is one row a file.
    """
    rows = lines.select("line_id", F.coalesce("file_name", F.lit("")).alias("file_name"), "line_no", "raw_line")
    header = rows.where("line_no = 1").groupBy("file_name").agg(F.min_by("raw_line", "line_id").alias("header"))
    header = header.withColumn("header", F.regexp_replace("header", "^﻿", ""))
    header = header.withColumn("sep", F.coalesce(*[F.when(F.contains("header", F.lit(s)), s) for s in SEPARATORS], F.lit(",")))
    names = _by_separator(lambda s: F.regexp_extract_all(F.concat(F.lit(s), "header"), F.lit(f"{s}({_field(s)})"), 1))
    header = header.select("file_name", "sep", F.transform(names, lambda x: F.lower(F.btrim(_unquote(x), F.lit(" ")))).alias("names"))
    records = rows.where("(line_no <> 1 or line_no is null) and raw_line rlike '[^ ]'")
    salted = records.withColumn("__salt", F.pmod(F.xxhash64("line_id", "line_no"), F.lit(FILE_SALTS)).cast("int"))
    header = header.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(FILE_SALTS - 1))))
    joined = salted.join(header, ["file_name", "__salt"], "left").withColumn("sep", F.coalesce("sep", F.lit(",")))
    well = _by_separator(lambda s: F.col("raw_line").rlike(f"^(?:{_field(s)})(?:{s}(?:{_field(s)}))*+\\z"))
    cells = _by_separator(lambda s: F.regexp_extract_all(F.concat(F.lit(s), "raw_line"), F.lit(f"{s}({_field(s)})"), 1))
    return joined.withColumn("quoted_well", well).select(F.col("line_id").alias("row_key"), "quoted_well", "names", F.when(F.col("quoted_well"), F.transform(cells, _unquote)).alias("cells"))


def _unquote(x: Column) -> Column:
    return F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)


# --- cells, rules, errors --------------------------------------------------------


@dataclass
class Checked:
    """``judged``: every cell with the reason it fails for (null if it doesn't)."""

    judged: DataFrame
    rules: tuple[Rule, ...]

    @property
    def errors(self) -> DataFrame:
        """``origin, row_key, reason``: one row each."""
        return _errors(self.judged)

    @cached_property
    def clean(self) -> DataFrame:
        """``origin, row_key`` and the typed columns of the records without an error; null ids are in no clean output.

        The judged cells are written once, as both sides of the anti-join read them.
        """
        judged = materialise(self.judged)
        bad = _errors(judged).select("origin", "row_key").distinct()
        typed = [F.max(F.when(F.col("column") == r.column, valid_day(F.col("text")) if r.kind == "date" else F.col("number").cast("bigint") if r.whole else F.col("number"))).alias(r.column) for r in self.rules]
        return judged.where("row_key is not null").join(bad, ["origin", "row_key"], "left_anti").groupBy("origin", "row_key").agg(*typed)

    @cached_property
    def counts(self) -> DataFrame:
        """``origin, records, erroneous, clean``: every record is one or the other."""
        by_record = self.judged.groupBy("origin", "row_key").agg(F.count_if(F.col("column") == "").alias("records"), F.max(F.col("reason").isNotNull()).alias("bad"))
        n = F.sum("records")
        return by_record.groupBy("origin").agg(n.alias("records"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("records"))), F.lit(0)).alias("erroneous"), F.coalesce(F.sum(F.when(~F.col("bad"), F.col("records"))), F.lit(0)).alias("clean"))


def _errors(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").select("origin", "row_key", "reason").distinct()


def cells_of_lines(split: DataFrame, origin: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Cells of the records, the first without column; of columns named twice in a header each is judged.

    The first cell's text is ``quoting`` or ``columns`` where the record is broken, whose other cells are left out, else null.
    A record whose file has none of the rules' columns thus still has a cell.
    """
    names = [r.column for r in rules]
    shape = F.when(~F.col("quoted_well"), "quoting").when(F.col("names").isNull() | (F.size("cells") != F.size("names")), "columns")
    own = F.filter(F.arrays_zip(F.col("names").alias("column"), F.col("cells").alias("text")), lambda c: c["column"].isin(names))
    whole = F.array(F.struct(F.lit("").alias("column"), shape.alias("text")))
    cell = split.select("row_key", F.explode(F.when(shape.isNull(), F.concat(whole, own)).otherwise(whole)).alias("c"))
    return cell.select(F.lit(origin).alias("origin"), "row_key", "c.column", "c.text", F.when(F.col("c.column") != "", plain_decimal(F.col("c.text"))).alias("number"))


def cells_of_rows(rows: DataFrame, origin: str, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Cells of typed rows: strings as text, numbers as double with NaN and infinities as null; the first without column."""
    none = F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("number")
    parts = [F.struct(F.lit("").alias("column"), *none)]
    for r in rules:
        c = F.col(r.column)
        text = c.cast("string") if r.kind == "date" else F.lit(None).cast("string")
        number = F.lit(None).cast("double") if r.kind == "date" else F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double"))
        parts.append(F.struct(F.lit(r.column).alias("column"), text.alias("text"), number.alias("number")))
    return rows.select(F.lit(origin).alias("origin"), F.col(key).cast("bigint").alias("row_key"), F.explode(F.array(*parts)).alias("c")).select("origin", "row_key", "c.column", "c.text", "c.number")


def judge(cells: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``origin, row_key, column, text, number, reason``: the column's name where its rule is broken. The rule table has one row a column."""
    judged = cells.join(F.broadcast(rule_table(cells.sparkSession, rules)), "column", "left")
    n = F.col("number")
    number_ok = n.isNotNull() & (n >= F.coalesce("lo", n)) & (n <= F.coalesce("hi", n)) & (~F.col("whole") | (n == F.floor(n)))
    ok = F.when(F.col("kind") == "date", valid_day(F.col("text")).isNotNull()).otherwise(number_ok)
    reason = F.when(F.col("column") == "", F.col("text")).when(~F.coalesce(ok, F.lit(False)), F.col("column"))
    return judged.select("origin", "row_key", "column", "text", "number", reason.alias("reason"))


def check_records(lines: DataFrame, rows: DataFrame, rules: tuple[Rule, ...] = READING_RULES, *, lines_origin: str = "acled_raw", rows_origin: str = "acled_small", row_id: str = "row_id") -> Checked:
    """Judge CSV lines and typed rows by the same rules.

    Reasons of a line: ``quoting``; else ``columns`` (another number of fields than the header, or no header); else the name of
    each invalid column. A column a file lacks isn't judged there and null in its clean rows, be it every column. ``row_id``
    and ``line_id`` must be unique within their table; a null id can be reported but never joined out, hence such rows
    are in no clean output. Repeated records are judged each by itself. Empty tables give empty results.
    """
    cells = cells_of_lines(split_lines(lines), lines_origin, rules).unionByName(cells_of_rows(rows, rows_origin, row_id, rules))
    return Checked(judge(cells, rules), rules)


def error_rows(errors: DataFrame) -> DataFrame:
    """One row a record: ``origin, row_key, reasons`` (sorted names, comma-separated)."""
    return errors.groupBy("origin", "row_key").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
