"""Positioning reports, calendars and macro series."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import keep_first, keep_last

#: Fixed values of the report's format: column names (alternatives in order), market names, and tokens of the market.
COLUMNS = {
    "date": ("Report_Date_as_YYYY-MM-DD", "Report_Date_as_YYYY_MM_DD"), "market": ("Market_and_Exchange_Names",),
    "pm_long": ("Prod_Merc_Positions_Long_All",), "pm_short": ("Prod_Merc_Positions_Short_All",),
    "sd_long": ("Swap_Positions_Long_All",), "sd_short": ("Swap__Positions_Short_All", "Swap_Positions_Short_All"),
    "mm_long": ("M_Money_Positions_Long_All",), "mm_short": ("M_Money_Positions_Short_All",),
    "nr_long": ("NonRept_Positions_Long_All",), "nr_short": ("NonRept_Positions_Short_All",),
}
MARKETS = ("GOLD - COMMODITY EXCHANGE INC.", "GOLD - COMMODITY EXCHANGE, INC.", "GC - COMMODITY EXCHANGE INC.")
TOKENS = ("GOLD", "COMMODITY EXCHANGE")
POSITIONS = (
    "commercial_long double, commercial_short double, commercial_net double, managed_money_long double, managed_money_short double, "
    "managed_money_net double, small_spec_long double, small_spec_short double, small_spec_net double"
)


def with_nets(df: DataFrame, also=()) -> DataFrame:
    """Group positions and nets from the raw columns pm_*, sd_*, mm_*, nr_*; further columns that stay."""
    groups = {
        "commercial": ("pm_long + sd_long", "pm_short + sd_short"), "managed_money": ("mm_long", "mm_short"), "small_spec": ("nr_long", "nr_short"),
    }
    cols = [e for g, (a, b) in groups.items() for e in (F.expr(a).alias(f"{g}_long"), F.expr(b).alias(f"{g}_short"), F.expr(f"({a}) - ({b})").alias(f"{g}_net"))]
    return df.select("date", *cols, *also)


def clean_reports(raw: DataFrame, also=()) -> DataFrame:
    """Rows of the wanted market from string columns named as in COLUMNS: thousands commas and quotes go, a bare
    point or nothing is 0, rows with other text in a number or without a date are left out. Columns named in `also` stay."""
    chosen = {}
    names = {c.strip(): c for c in raw.columns}
    for name, options in COLUMNS.items():
        found = next((names[o] for o in options if o in names), None)
        if found is None:
            raise ValueError(f"no column for {name}")
        chosen[name] = F.trim(F.col(f"`{found}`"))
    df = raw.select(*(c.alias(n) for n, c in chosen.items()), *also)
    for t in TOKENS:
        df = df.where(F.upper("market").contains(t))
    numbers = [n for n in COLUMNS if n not in ("date", "market")]
    text = {n: F.trim(F.regexp_replace(F.coalesce(n, F.lit("")), '[,"]', "")) for n in numbers}
    df = df.withColumns({n: F.when(t.isin("", "."), 0.0).otherwise(t.try_cast("double")) for n, t in text.items()})
    df = df.withColumn("date", F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date")).dropna(subset=["date", *numbers])
    return with_nets(df, also)


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_reports(spark.read.csv(path, header=True, quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))


def read_report_zips(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Reports from start to end, both included, of all archives under a path, one for each year; an unreadable one is skipped, of equal dates the
    last in file order stays. Archives whose name holds one year, outside the range, aren't read."""
    fields = ", ".join(f"{n} string" for n in COLUMNS)

    def unzip(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        member = next(n for n in z.namelist() if n.lower().endswith((".txt", ".csv")))
                        reader = csv.DictReader(io.StringIO(z.read(member).decode("utf-8", "replace")))
                    heads = {(c or "").strip(): c for c in reader.fieldnames or []}
                    pick = {n: next(heads[o] for o in options if o in heads) for n, options in COLUMNS.items()}
                except (zipfile.BadZipFile, StopIteration):
                    continue
                rows += [[*((r.get(pick[n]) or "").strip() for n in COLUMNS), name, i] for i, r in enumerate(reader)]
            yield pd.DataFrame(rows, columns=[*COLUMNS, "_file", "_row"])

    files = spark.read.format("binaryFile").load(path)
    years = F.regexp_extract_all(F.element_at(F.split("path", "/"), -1), F.lit(r"((?:19|20)[0-9]{2})"), 1)
    for given, keep in ((start, lambda y: years[0] >= y), (end, lambda y: years[0] <= y)):
        if given:
            files = files.where((F.size(years) != 1) | keep(given[:4]))
    raw = files.select("path", "content").mapInPandas(unzip, f"{fields}, _file string, _row long")
    kept = raw.withColumnsRenamed({n: o[0] for n, o in COLUMNS.items()})
    reports = clean_reports(kept, ["_file", "_row"]).withColumn("_at", F.struct("_file", "_row"))
    for given, keep in ((start, lambda d: F.col("date") >= d), (end, lambda d: F.col("date") <= d)):
        if given:
            reports = reports.where(keep(F.lit(given).cast("date")))
    return keep_last(reports, ["date"], "_at").drop("_at", "_file", "_row")


#: Fixed values of the text format: the numbers of a row in order, after the open interest where a row has it.
LAYOUT = (
    "pm_long", "pm_short", "sd_long", "sd_short", "sd_spread", "mm_long", "mm_short", "mm_spread", "other_long", "other_short", "other_spread",
    "total_long", "total_short", "nr_long", "nr_short",
)
#: Fewest numbers of a row, numbers of a row with open interest, lines below a market's name in which its row may be, and lines around the name in which the date may be.
LEAST, WITH_INTEREST, BELOW, AROUND = 12, 16, 19, (-5, 4)


def report_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, market, date, numbers): the lines of each text that aren't blank; what a line is, or null."""
    said = F.filter(F.split(text_col, r"\r?\n"), lambda x: F.trim(x) != "")
    line = F.regexp_replace("said", r"\s+", " ")
    words = F.split(F.regexp_extract(F.lower(line), "as of (.*)", 1), "[^a-z0-9]+")
    day = F.concat_ws(" ", *(F.get(words, F.lit(i)) for i in range(3)))
    date = F.coalesce(*(F.try_to_timestamp(day, F.lit(form)) for form in ("MMMM d yyyy", "MMM d yyyy")))
    tokens = F.filter(F.split(F.regexp_replace(line, ",", ""), "[ :|]+"), lambda t: t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"))
    numbers = F.transform(tokens, lambda t: t.cast("double"))
    return texts.select(F.col(id_col).alias("id"), F.posexplode(said).alias("line", "said")).select(
        "id", "line", F.greatest(*(F.upper(line).contains(m) for m in MARKETS)).alias("market"), F.date_format(date, "yyyy-MM-dd").alias("date"),
        F.when(F.size(numbers) >= LEAST, numbers).alias("numbers"),
    )


def parse_report_texts(texts: DataFrame, id_col: str = "path", text_col: str = "value") -> DataFrame:
    """(id, report_date, positions...) of each text's first usable block: a line with the market's name, the first row of numbers
    below it, and the first date near it (else an empty date). Texts without one give no row; rows too short for the small groups count 0 there."""
    by_text = Window.partitionBy("id").orderBy("line")
    near = report_lines(texts, id_col, text_col).withColumns({
        "row": F.first("numbers", ignorenulls=True).over(by_text.rowsBetween(1, BELOW)), "near_date": F.first("date", ignorenulls=True).over(by_text.rowsBetween(*AROUND)),
    })
    first = near.where("market and row is not null").groupBy("id").agg(F.min_by(F.struct("row", "near_date"), "line").alias("b"))
    at = F.when(F.size("b.row") >= WITH_INTEREST, 1).otherwise(0)
    value = {n: F.coalesce(F.get("b.row", at + i), F.lit(0.0)).alias(n) for i, n in enumerate(LAYOUT)}
    # the small groups count only where the row reaches to its last number
    for n in ("nr_long", "nr_short"):
        value[n] = F.when(F.size("b.row") - at >= len(LAYOUT), value[n]).otherwise(0.0).alias(n)
    raw = first.select(F.lit(None).cast("date").alias("date"), F.col("id").alias(id_col), F.coalesce("b.near_date", F.lit("")).alias("report_date"), *value.values())
    return with_nets(raw, [id_col, "report_date"]).select(id_col, "report_date", *(c.split()[0] for c in POSITIONS.split(", ")))


def read_report_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text file that has a usable block."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_report_texts(files).drop("path")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(name, event_ts, impact, source); malformed entries are left out."""
    raw = spark.read.schema("name string, timestamp long, impact string, source string").json(path, multiLine=True, mode="PERMISSIVE")
    return raw.where("name is not null and timestamp is not null and impact is not null").select("name", F.timestamp_millis("timestamp").alias("event_ts"), "impact", "source")


def recurring_events(spark: SparkSession, first_month: str, months: int) -> DataFrame:
    """First-Friday and second-Wednesday releases at 12:30 of each month."""
    start = F.trunc(F.lit(first_month).cast("date"), "month")
    df = spark.range(months).select(F.add_months(start, F.col("id").cast("int")).alias("m"))
    day_before = F.date_sub("m", 1)
    picks = F.array(
        F.struct(F.lit("NFP ").alias("label"), F.next_day(day_before, "FR").alias("day")),
        F.struct(F.lit("US CPI ").alias("label"), F.date_add(F.next_day(day_before, "WE"), 7).alias("day")),
    )
    return df.select(F.inline(picks)).select(
        F.concat("label", F.date_format("day", "MMM yyyy")).alias("name"), (F.col("day").cast("timestamp") + F.expr("interval 12 hours 30 minutes")).alias("event_ts"),
        F.lit("high").alias("impact"), F.lit("computed").alias("source"),
    )


def merge_calendar(existing: DataFrame, computed: DataFrame) -> DataFrame:
    """Other entries first, then the computed ones anew; of the same name and time the first stays."""
    own = existing.where(F.coalesce("source", F.lit("")) != "computed").withColumn("_at", F.lit(0))
    both = own.unionByName(computed.withColumn("_at", F.lit(1)))
    return keep_first(both, ["name", "event_ts"], "_at").drop("_at")


def clean_series(raw: DataFrame, series: str) -> DataFrame:
    """(series, ts, value) from text or number columns date and value; what isn't a number is left out."""
    return raw.select(F.lit(series).alias("series"), F.col("date").try_cast("timestamp").alias("ts"), F.col("value").cast("string").try_cast("double").alias("value")).where(
        "ts is not null and value is not null and not isnan(value)"
    )


def report_bias(reports: DataFrame) -> DataFrame:
    """Adds commercial_bias, managed_money_bias and their alignment."""
    from ..operators.features import cot_alignment, side_bias

    return reports.withColumns({"commercial_bias": side_bias(F.col("commercial_net")), "managed_money_bias": side_bias(F.col("managed_money_net"))}).withColumn(
        "cot_alignment", cot_alignment(F.col("commercial_bias"), F.col("managed_money_bias"))
    )


def newest(reports: DataFrame, by: str) -> DataFrame:
    """The last report."""
    return reports.orderBy(F.desc(by)).limit(1)
