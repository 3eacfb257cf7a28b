"""Scalar functions of the engine, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A date at the end of a model's name.
DATED = r"-\d{4}-\d{2}-\d{2}$"
#: Recorded service tiers and the tiers that they are priced by; the classes that days are split by.
TIERS = {"default": "standard", "auto": "standard", "standard": "standard", "priority": "fast", "fast": "fast", "flex": "flex", "ultrafast": "ultrafast"}
CLASSES = ("standard", "fast", "ultrafast")


def session_hash(domain: str, session: Column) -> Column:
    """The first 16 hex digits of a domain-separated SHA-256."""
    return F.substring(F.sha2(F.concat(F.lit(domain), session.cast("string")), 256), 1, 16)


def patch_cost(width: Column, height: Column) -> Column:
    """Tokens of an image that is paid by patches of 32 pixels, 1,536 at most: a larger image is first made smaller,
    to a whole number of patches across."""
    w, h = width.cast("double"), height.cast("double")
    whole = F.ceil(w / 32) * F.ceil(h / 32)
    shrink = F.sqrt(F.lit(1536.0 * 32 * 32) / (w * h))
    across = F.greatest(F.floor(w * shrink / 32), F.lit(1))
    down = F.greatest(F.ceil(h * shrink * (across * 32 / (w * shrink)) / 32), F.lit(1))
    fitted = across * F.greatest(F.least(down, F.floor(F.lit(1536) / across)), F.lit(1))
    return F.when((w <= 0) | (h <= 0), 0).when(whole <= 1536, whole).otherwise(fitted).cast("long")


def tile_cost(width: Column, height: Column) -> Column:
    """Tokens of an image that is paid by tiles: fitted into 2,048 pixels, then its shorter side to 768, it costs 85 and
    170 for each tile of 512."""
    w, h = width.cast("double"), height.cast("double")
    first = F.least(F.lit(1.0), F.lit(2048.0) / F.greatest(w, h))
    w1, h1 = F.when(first < 1, w * first).otherwise(w), F.when(first < 1, h * first).otherwise(h)
    short = F.least(w1, h1)
    second = F.when(short > 768, F.lit(768.0) / short)
    w2, h2 = F.when(second.isNotNull(), w1 * second).otherwise(w1), F.when(second.isNotNull(), h1 * second).otherwise(h1)
    return F.when((w <= 0) | (h <= 0), 0).otherwise(85 + 170 * F.ceil(w2 / 512) * F.ceil(h2 / 512)).cast("long")


def model_name(raw: Column) -> Column:
    """Lower-cased and trimmed; null where nothing is left."""
    name = F.lower(F.trim(raw))
    return F.when(name != "", name)


def tier_name(raw: Column) -> Column:
    """The tier by which a recorded one is priced: standard where none is recorded, null for one that is not known."""
    known = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return F.when(raw.isNull(), "standard").otherwise(F.try_element_at(known, F.lower(F.trim(raw))))


def tier_class(raw: Column) -> Column:
    name = tier_name(raw)
    return F.when(name.isin(*CLASSES[1:]), name).otherwise(CLASSES[0])


def epoch_s(text: Column) -> Column:
    """Seconds of an ISO time, null if it is none; a time without an offset is UTC."""
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6


def strict_epoch_s(text: Column) -> Column:
    """Seconds of an ISO time with an offset; null without one, and for texts shorter than a time to the second."""
    zoned = (F.char_length(text) >= 20) & text.rlike(r"T.*(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, epoch_s(text))


def local_day(text: Column, minutes: int | Column) -> Column:
    """The calendar day of an ISO time at an offset of minutes, to the minute; without an offset of its own, the first
    ten characters."""
    zoned = text.rlike(r"T.*(?:Z|[+-]\d{2}:?\d{2})$")
    shift = F.lit(minutes) if isinstance(minutes, int) else minutes
    moved = F.timestamp_seconds(F.floor(epoch_s(text) / 60) * 60 + shift * 60)
    return F.when(zoned, F.date_format(moved, "yyyy-MM-dd")).otherwise(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)))


def day_span(day: Column, zone: str) -> tuple[Column, Column]:
    """The first second of a local day and of the next, so 23 or 25 hours where clocks change."""
    at = lambda d: F.unix_seconds(F.to_utc_timestamp(d.cast("timestamp"), zone))
    return at(day), at(F.date_add(day, 1))


def local_minutes(epoch: Column, zone: str) -> Column:
    """An epoch as local ISO time to the minute."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "yyyy-MM-dd'T'HH:mm")


def count_of(raw: Column) -> Column:
    """A count from a recorded number: 0 for nothing, NaN, infinity and what is negative; else cut to a whole one."""
    value = raw.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (value <= 0) | (value >= 9.2e18), 0).otherwise(F.floor(value)).cast("long")


def clamped(part: Column, whole: Column) -> tuple[Column, Column]:
    """The part, whole at most, and whether it was more."""
    return F.least(part, whole), part > whole


def median_half_up(values: Column) -> Column:
    """The rounded median of an array, halves up."""
    ordered = F.sort_array(values)
    n = F.size(values)
    middle = (F.get(ordered, F.expr("CAST(0 AS INT)") + F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return F.floor(middle + 0.5).cast("long")


def off_grid(reset: Column, anchor: Column, period: int = 604_800, near: int = 2) -> Column:
    """Whether a reset departs from the anchor's grid of periods by more than near seconds."""
    phase = F.pmod(reset - anchor, F.lit(period))
    return F.least(phase, F.lit(period) - phase) > near


def price_cell(text: Column) -> Column:
    """The number of a price cell: $1.25, $1,000 or a dash for none."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"^\s*\$\s*(\d+(?:\.\d+)?)\s*$", 1).try_cast("double")


def preview(text: Column, most: int = 120) -> Column:
    """The first characters of a text, runs of white space as one space."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def digest(value: Column) -> Column:
    """The SHA-256 of a struct's or map's JSON with its keys in order."""
    return F.sha2(F.to_json(value), 256)


def shown_count(value: Column) -> Column:
    """A count for reading: 950, 1.2k, 3.40M, 5.67B."""
    v = value.cast("double")
    return F.when(v < 1000, F.format_string("%d", value.cast("long"))).when(v < 1e6, F.format_string("%.1fk", v / 1e3)).when(v < 1e9, F.format_string("%.2fM", v / 1e6)).otherwise(F.format_string("%.2fB", v / 1e9))


def shown_seconds(value: Column) -> Column:
    """Seconds for reading: 4.2s, 3m05s, 2h07m."""
    v, whole = value.cast("double"), F.floor(value).cast("long")
    return F.when(v < 60, F.format_string("%.1fs", v)).when(v < 3600, F.format_string("%dm%02ds", F.expr("0L") + F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%dh%02dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))


def optional_count(raw: Column, ceiling: int = 10**12) -> tuple[Column, Column]:
    """A recorded count as a whole number, and what is wrong with it: missing, invalid (not a whole number of 0 or more)
    or ceiling (more than can be); null where it stands."""
    value = raw.try_cast("double")
    flaw = F.when(raw.isNull(), "missing").when(value.isNull() | F.isnan(value) | (value < 0) | (value != F.floor(value)), "invalid").when(value > ceiling, "ceiling")
    return F.when(flaw.isNull(), value.try_cast("long")), flaw


def split_holds(short: Column, long: Column, creation: Column) -> Column:
    """Whether the two lifetimes of cache writes are there and give the writes in all."""
    return F.coalesce((short >= 0) & (long >= 0) & (short + long == creation), F.lit(False))


def reset_at(raw: Column, in_seconds: Column, t: Column) -> Column:
    """When a limit resets: a number of seconds or an ISO time, else so many seconds from t; null if none is finite and 0 or more."""
    number = F.coalesce(raw.try_cast("double"), epoch_s(raw))
    good = lambda v: F.when(~F.isnan(v) & (v >= 0) & (v < 1e15), v)
    return F.coalesce(good(number), t + good(in_seconds.cast("double")))


def _number(data: Column, first: int, size: int, little: bool) -> Column:
    """The whole number that size bytes from a 0-based place are."""
    part = lambda i: F.conv(F.hex(F.substring(data, first + 1 + i, 1)), 16, 10).cast("long")
    return sum((part(i) * (1 << 8 * (i if little else size - 1 - i)) for i in range(size)), F.lit(0).cast("long"))


def image_header(encoded: Column) -> Column:
    """(format, width, height) from the first bytes of an image in base64: PNG, GIF, BMP and the three kinds of WebP; null for others,
    and for headers that are cut off. JPEG is named without its size, which stands behind a walk over markers."""
    clean = F.substring(F.regexp_replace(encoded, r"[^A-Za-z0-9+/]", ""), 1, 64)
    data = F.try_to_binary(F.substring(clean, F.lit(1), F.char_length(clean) - F.char_length(clean) % 4), F.lit("base64"))
    head = F.hex(data)
    at = lambda first, size, little=True: _number(data, first, size, little)
    made = lambda name, w, h: F.struct(F.lit(name).alias("format"), w.cast("long").alias("width"), h.cast("long").alias("height"))
    nothing, bits = F.lit(None).cast("long"), at(21, 4)
    long = F.length(data)
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    kind = F.substring(head, 25, 8)
    return (
        F.when(head.startswith("89504E470D0A1A0A") & (long >= 24), made("png", at(16, 4, False), at(20, 4, False)))
        .when(head.startswith("47494638") & (long >= 10), made("gif", at(6, 2), at(8, 2)))
        .when(head.startswith("424D") & (long >= 26), made("bmp", at(18, 4), F.least(at(22, 4), F.lit(1 << 32) - at(22, 4))))
        .when(webp & (kind == "56503858") & (long >= 30), made("webp", at(24, 3) + 1, at(27, 3) + 1))
        .when(webp & (kind == "5650384C") & (long >= 25), made("webp", bits.bitwiseAND(F.lit(0x3FFF)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1))
        .when(webp & (kind == "56503820") & (long >= 30), made("webp", at(26, 2).bitwiseAND(F.lit(0x3FFF)), at(28, 2).bitwiseAND(F.lit(0x3FFF))))
        .when(head.startswith("FFD8"), made("jpeg", nothing, nothing))
    )


def claim(token: Column, name: str) -> Column:
    """A claim of a signed token: the middle of its three parts is JSON in base64 for addresses. Null if there is none; the signature is not
    checked."""
    parts = F.split(token, r"\.")
    body = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.char_length(body), F.lit(4))))
    return F.when(F.size(parts) == 3, F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), f"$['{name}']"))


def escaped(text: Column) -> Column:
    """A text for HTML."""
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


#: Pixels of a patch of the 28-pixel fit.
PATCH = 28


def image_limits(model: Column, newer: tuple[int, int] = (4, 7)) -> Column:
    """(max_edge, max_tokens) by the version that a model's name ends with, compared number by number: higher from newer on.
    Null for a name without a version."""
    found = F.regexp_extract(F.lower(model), r"-(\d{1,3})(?:-(\d{1,3}))?$", 1)
    minor = F.regexp_extract(F.lower(model), r"-(\d{1,3})(?:-(\d{1,3}))?$", 2)
    version = F.struct(found.try_cast("int").alias("major"), F.coalesce(minor.try_cast("int"), F.lit(-1)).alias("minor"))  # a shorter version comes before its own minors
    least = F.struct(F.lit(newer[0]).alias("major"), F.lit(newer[1]).alias("minor"))
    limits = lambda edge, tokens: F.struct(F.lit(edge).cast("long").alias("max_edge"), F.lit(tokens).cast("long").alias("max_tokens"))
    return F.when(found != "", F.when(version >= least, limits(2576, 4784)).otherwise(limits(1568, 1568)))


@F.pandas_udf(LongType())
def _fitted_edge(long_: pd.Series, short: pd.Series, max_edge: pd.Series, max_tokens: pd.Series) -> pd.Series:
    """The longest side whose patches fit, 0 where none does: all rows of a batch are halved together until each has its side."""
    long_, short, max_edge, max_tokens = (x.to_numpy() for x in (long_, short, max_edge, max_tokens))
    low, high = np.zeros_like(long_), np.maximum(np.minimum(long_, max_edge), 0)
    while (low < high).any():
        middle = (low + high + 1) // 2
        other = np.maximum(np.rint(short.astype("float64") * middle / np.maximum(long_, 1)).astype("int64"), 1)
        across, down = -(-middle // PATCH), -(-other // PATCH)
        fits = (across * PATCH <= max_edge) & (down * PATCH <= max_edge) & (across * down <= max_tokens)
        low, high = np.where(fits & (low < high), middle, low), np.where(fits | (low >= high), high, middle - 1)
    return pd.Series(low)


def patch_fit(width: Column, height: Column, max_edge: Column, max_tokens: Column) -> Column:
    """(width, height, tokens) of the largest image of the same shape whose patches fit: its sides, padded to whole patches, are
    max_edge at most and its patches max_tokens. Null where a size is not positive or not one patch fits.

    The longer side is found by bisection, as fewer pixels never need more patches. It is an argument's value that is halved, so
    that what the arguments are made from is computed once for a row.
    """
    long_, short = F.greatest(width, height).cast("long"), F.least(width, height).cast("long")
    other = lambda edge: F.greatest(F.lit(1).cast("long"), F.bround(short.cast("double") * edge / long_).cast("long"))
    patches = lambda side: ((side + (PATCH - 1)) / PATCH).cast("long")
    edge = _fitted_edge(*(F.coalesce(x.cast("long"), F.lit(0).cast("long")) for x in (long_, short, max_edge, max_tokens)))
    sized = F.struct(F.when(width >= height, edge).otherwise(other(edge)).alias("width"), F.when(width >= height, other(edge)).otherwise(edge).alias("height"), (patches(edge) * patches(other(edge))).alias("tokens"))
    return F.when((width > 0) & (height > 0) & (edge > 0), sized)
