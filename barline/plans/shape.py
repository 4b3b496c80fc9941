"""How query results are shown, and pieces of DuckDB SQL that show the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, TimestampType

DIGITS = 6


def shown(df: DataFrame) -> DataFrame:
    """Doubles to six digits, whole numbers as longs, flags as 0 and 1, times as text."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = F.round(c, DIGITS) + 0.0  # no negative zero
        elif isinstance(f.dataType, TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, IntegerType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


#: DuckDB: the frame from a symbol's first row, its plain order, and the time as text.
ROWS = "over (partition by symbol order by ts rows between unbounded preceding and current row)"
KEY = "over (partition by symbol order by ts)"
NOW = "strftime(ts, '%Y-%m-%d %H:%M:%S') as ts"


def R(back: int) -> str:
    return f"over (partition by symbol order by ts rows between {back} preceding and current row)"


def r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, {DIGITS}) + 0.0 as {name or expression}"


def bars_sql(unit: str = "hour") -> str:
    return f"""ticks as (select event_type as symbol, ts as t, event_id, value as price, cast(json_extract_string(props, '$.k') as double) as size from events),
bars as (select symbol, date_trunc('{unit}', t) as ts, first(price order by t, event_id) as open, max(price) as high, min(price) as low, last(price order by t, event_id) as close, sum(size) as volume from ticks group by symbol, date_trunc('{unit}', t))"""
