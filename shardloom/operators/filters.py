"""Row filters of an ingest: drop reasons, blocklists, caps and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import caption_valid, word_count
from .ranking import ordered_place, seeded_order


def drop_reason(caption: Column, width: Column, height: Column, min_words: int = 5, min_side: int = 256) -> Column:
    """Why a record is dropped, the first of caption, size; null for one that is kept. Unknown sizes count as 0."""
    small = (F.coalesce(width, F.lit(0)) < min_side) | (F.coalesce(height, F.lit(0)) < min_side)
    return F.when(~caption_valid(caption, min_words), "caption").when(small, "size")


def ingest_filter(df: DataFrame, url: str = "url", caption: str = "caption", width: str = "width", height: str = "height", score: str | None = None, min_words: int = 5, min_side: int = 256, min_score: float = 0.0) -> DataFrame:
    """Rows with an address, a caption of enough words and, where the columns exist, a size and a score. A null score fails."""
    out = df.where((F.trim(F.coalesce(url, F.lit(""))) != "") & (word_count(F.col(caption)) >= min_words))
    if width in df.columns and height in df.columns:
        side = lambda c: F.coalesce(F.try_to_number(F.col(c).cast("string"), F.lit("999999999")).cast("int"), F.lit(0))
        out = out.where((side(width) >= min_side) & (side(height) >= min_side))
    if score and score in df.columns:
        out = out.where(F.coalesce(F.col(score) >= min_score, F.lit(False)))
    return out


def resolve_columns(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns renamed by candidate lists: the first candidate that exists counts, whatever the letter case; none gives null."""
    have = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name, candidates in names.items():
        found = next((have[c.lower()] for c in candidates if c.lower() in have), None)
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def insert_or_ignore(new: DataFrame, key: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """New rows whose key is not there yet, the first in order for each key; null keys are dropped."""
    others = [c for c in new.columns if c not in (key, order)]
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *others)).alias("__r"))
    out = first.select(key, *[F.col(f"__r.{c}").alias(c) for c in (order, *others)]).select(*new.columns)
    return out if existing is None else out.join(existing.select(key).distinct(), key, "left_anti")


def insert_or_replace(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key, those of ``new`` in place of those of ``old``, the last in order for each key."""
    both = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in (key, order, "__g")]
    last = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("__g", order, *others)).alias("__r"))
    return last.select(key, *[F.col(f"__r.{c}").alias(c) for c in (order, *others)]).select(*[c for c in both.columns if c != "__g"])


def conditional_upsert(old: DataFrame, new: DataFrame, key: str, source: str = "source", count: str = "n_images", unknown: str = "unknown") -> DataFrame:
    """``key, source, count``: an unknown new source keeps the old one, a new count of 0 or less keeps the old count."""
    n = new.select(key, F.col(source).alias("__s"), F.col(count).alias("__c"))
    known = F.when(F.lower(F.col("__s")) != unknown, F.col("__s"))
    return old.select(key, source, count).join(n, key, "full_outer").select(
        key, F.coalesce(known, F.col(source), F.col("__s")).alias(source), F.coalesce(F.when(F.col("__c") > 0, F.col("__c")), F.col(count), F.col("__c")).alias(count)
    )


def without(df: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in a blocklist; rows with a null key stay."""
    return df.join(blocked.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def capped(df: DataFrame, group: str, order: list[Column], n: int, allowed: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The first ``n`` rows of a group, after an allow-list if one is given (this is the operator's cap, not a sample)."""
    if allowed is not None and key:
        df = df.join(allowed.select(key).distinct(), key, "left_semi")
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def replace_short(caption: Column, other: Column, words: int = 10) -> Column:
    """The other caption where this one is short and the other is not."""
    return F.when((word_count(caption) < words) & (word_count(other) >= words), other).otherwise(caption)


def described(style: Column, genre: Column) -> Column:
    """A caption from labels, with what is known of them."""
    s, g = F.nullif(F.trim(style), F.lit("")), F.nullif(F.trim(genre), F.lit(""))
    return F.when(s.isNotNull() & g.isNotNull(), F.format_string("a %s painting in the style of %s", g, s)).when(s.isNotNull(), F.format_string("a painting in the style of %s", s)).when(g.isNotNull(), F.format_string("a %s painting", g)).otherwise(F.lit("a painting"))


def pack(df: DataFrame, key: str, size: int, ranges: int = 512) -> DataFrame:
    """``bin, slot``: rows in seeded order into shards of ``size`` rows, the last one partial.

    Places are counted per hash range and inside it, so no task orders the whole.
    """
    keyed = df.withColumn("__h", seeded_order(key, 0)).withColumn("__r", F.pmod("__h", F.lit(ranges)))
    counts = keyed.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # ``ranges`` rows
    offsets = counts.select("__r", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__b"))
    place = F.col("__b") + F.row_number().over(Window.partitionBy("__r").orderBy("__h", key)) - 1
    out = keyed.join(F.broadcast(offsets), "__r").withColumn("__p", place)
    return out.withColumn("bin", F.floor(F.col("__p") / size)).withColumn("slot", F.pmod("__p", F.lit(size))).drop("__h", "__r", "__b", "__p")


def pack_in_order(df: DataFrame, key: str, size: int) -> DataFrame:
    """``bin, slot``: rows in order of key, a null one last, into shards of ``size`` rows, the last one partial; keys are unique."""
    placed = ordered_place(df, [F.asc_nulls_last(key)], "__k")
    return placed.withColumn("bin", F.floor(F.col("__k") / size)).withColumn("slot", F.pmod("__k", F.lit(size))).drop("__k")


def random_cap(df: DataFrame, group: str, key: str, n: int, seed: int = 42, allowed: DataFrame | None = None) -> DataFrame:
    """``n`` rows of each group in a seeded order, after an allow-list if one is given (this is the operator's cap)."""
    return capped(df, group, [seeded_order(key, seed), F.asc(key)], n, allowed, key)


def falsy(value: Column, default: float) -> Column:
    """The value as a double, ``default`` where it is null, NaN or 0."""
    v = value.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (v != 0), v).otherwise(F.lit(default))


def web_filter(df: DataFrame, key: str, rows: int | None = None, min_aesthetic: float = 4.5, min_side: float = 512, min_similarity: float = 0.30, max_nsfw: float = 0.30, max_watermark: float = 0.30) -> DataFrame:
    """``key, url, caption`` of crawl rows with an address, a text and good scores; at most ``rows``, in order of key.

    Columns are url, text, width, height, aesthetic, similarity, nsfw and
    watermark. A missing score fails; so does a score of 0 for nsfw and
    watermark, as 0 counts as missing there.
    """
    good = (
        (F.coalesce("url", F.lit("")) != "")
        & (F.coalesce("text", F.lit("")) != "")
        & (falsy(F.col("aesthetic"), 0.0) >= min_aesthetic)
        & (F.least(falsy(F.col("width"), 0.0), falsy(F.col("height"), 0.0)) >= min_side)
        & (falsy(F.col("similarity"), 0.0) >= min_similarity)
        & (falsy(F.col("nsfw"), 1.0) <= max_nsfw)
        & (falsy(F.col("watermark"), 1.0) <= max_watermark)
    )
    out = df.where(good).select(key, "url", F.col("text").alias("caption"))
    return out if rows is None else out.orderBy(key).limit(rows)


def aliased_web_filter(df: DataFrame, key: str, aliases: dict[str, list[str]], rows: int | None = None, min_aesthetic: float = 5.5, min_side: float = 512) -> DataFrame:
    """The same for a source whose columns go by several names: of those that exist the first value that is not empty, 0 or null counts."""

    def first(name: str, number: bool) -> Column:
        have = [F.col(f"`{c}`") for c in aliases[name] if c in df.columns]
        values = [F.nullif(falsy(c, 0.0), F.lit(0.0)) if number else F.nullif(c, F.lit("")) for c in have]
        return F.coalesce(*values, F.lit(0.0) if number else F.lit("")) if values else F.lit(0.0 if number else "")

    good = (first("aesthetic", True) >= min_aesthetic) & (first("width", True) >= min_side) & (first("height", True) >= min_side) & (first("url", False) != "") & (first("text", False) != "")
    out = df.where(good).select(key, first("url", False).alias("url"), first("text", False).alias("caption"))
    return out if rows is None else out.orderBy(key).limit(rows)


def ephemeral(name: Column) -> Column:
    """Whether a campaign is a trial by its name: starts with smoke or test, in any letter case."""
    low = F.lower(name)
    return F.coalesce(low.startswith("smoke") | low.startswith("test"), F.lit(False))
