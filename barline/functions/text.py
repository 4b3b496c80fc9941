"""Text expressions: rendering, cleaning, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections of a post-mortem note, in order.
SECTIONS = ("## Outcome", "## Trade events", "## What the SITUATION REPORT predicted", "## What actually happened", "## One-line lesson")
POST_LIMIT = 280


def to_step(value: Column, step: float) -> Column:
    """The nearest multiple of step, halves to even."""
    return value if step <= 0 else F.bround(value / step) * step


def cut(text: Column, limit: int) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def kill_class(kill: Column) -> Column:
    k = F.lower(F.coalesce(kill, F.lit("")))
    return (
        F.when(k.contains("close") & (k.contains("above") | k.contains("below")), "structural reclaim")
        .when(k.contains("minute") | k.contains("time"), "time decay")
        .when(k.contains("cvd") | k.contains("delta"), "flow reversal").otherwise("structural invalidation")
    )


def _plain(x: Column) -> Column:
    """A number without a fraction if it has none."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def posts(name: str = "MARKET", step: float = 5.0, paper: bool = True) -> Column:
    """Array of posts of at most 280 characters from columns decision, direction, regime, thesis, kill_thesis, zone_low,
    zone_high, rr_minimum, confidence, flow, structure, context, intent."""
    head = F.lit(f"{name}{' [PAPER]' if paper else ''}")
    mid = to_step((F.col("zone_low") + F.col("zone_high")) / 2, step)
    entry = F.when(mid.isNull(), "structural reclaim").otherwise(F.concat(F.lit("around "), _plain(mid)))
    take = F.concat(
        head, F.lit(" | "), F.upper("direction"), F.lit("\nRegime: "), F.col("regime"), F.lit("\nSetup: "), entry, F.lit("\nTarget: "),
        _plain(F.col("rr_minimum")), F.lit("R minimum\nConf: "), F.format_number("confidence", 2),
    )
    why = F.concat(F.lit("Why: "), F.trim("thesis"), F.lit("\nKill: "), kill_class(F.col("kill_thesis")))
    whole = F.concat(take, F.lit("\n\n"), why)
    active = F.size(F.filter(F.array("flow", "structure", "context", "intent"), lambda x: x > 0))
    skip = F.concat(head, F.lit(" | SKIP\nRegime: "), F.col("regime"), F.lit("\nWhy: "), cut(F.col("thesis"), 180))
    none = F.concat(head, F.lit(" | NO TRADE\nRegime: "), F.col("regime"), F.lit(" | Lenses active: "), active.cast("string"), F.lit("/4\nDefault is NO. Sitting on hands."))
    return (
        F.when(F.col("decision") == "NO_TRADE", F.array(cut(none, POST_LIMIT))).when(F.col("decision") == "SKIP", F.array(cut(skip, POST_LIMIT)))
        .when(F.length(whole) <= POST_LIMIT, F.array(whole)).otherwise(F.array(take, cut(why, POST_LIMIT)))
    )


def replace_section(note: Column, header: str, body: Column) -> Column:
    """The note with the text under a known header replaced, up to the next known one; appended where it is missing."""
    quoted = lambda h: "\\Q" + h + "\\E"
    others = "|".join(quoted(h) for h in SECTIONS if h != header)
    pattern = rf"(?sm)\A(.*?^{quoted(header)}[^\n]*\n)(.*?)((?=^(?:{others})[^\n]*\n).*|\z)"
    found = note.rlike(pattern)
    filled = F.concat(F.regexp_extract(note, pattern, 1), body, F.lit("\n\n"), F.regexp_extract(note, pattern, 3))
    return F.when(found, filled).otherwise(F.concat(F.rtrim(note), F.lit(f"\n\n{header}\n\n"), body, F.lit("\n")))


def video_id(text: Column) -> Column:
    """The id of 11 characters that a text is or that its address names; null without one."""
    bare = F.trim(text)
    named = F.regexp_extract(bare, r"(?:v=|/shorts/|youtu\.be/)([0-9A-Za-z_-]{11})", 1)
    return F.when(bare.rlike(r"^[0-9A-Za-z_-]{11}$"), bare).otherwise(F.nullif(named, F.lit("")))


def first_ids(lines: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """(video_id, first_at, n): every id of the lines once, with its first place and how often it comes; comments and lines without an id are left out."""
    ids = lines.where(~F.trim(F.col(text_col)).startswith("#")).select(video_id(F.col(text_col)).alias("video_id"), F.col(order_col).alias("at"))
    return ids.where("video_id is not null").groupBy("video_id").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))


def clean_transcript(text: Column) -> Column:
    """Tags and entities out, runs of white space to one space."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"&(nbsp|#160);", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def bp_between(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.abs(a - b) / b * 10000)


def bp_to_price(reference: Column, bp: Column) -> Column:
    return bp / 10000 * reference
