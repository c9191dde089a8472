"""Column functions on names, keys and stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(name: Column) -> Column:
    """Lower case; runs of anything but ``a-z0-9._-`` become one ``-``; no ``-`` at the ends; null if nothing is left."""
    out = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9._-]+", "-")
    return F.nullif(F.regexp_replace(out, "^-+|-+$", ""), F.lit(""))


def raster_key(aoi_id: Column, aoi: Column, product: Column, acquired_at: Column, scene: Column) -> Column:
    """``{id}-{aoi}/{product}/{date}/{product}-{scene}.tif``"""
    place = F.concat_ws("-", aoi_id.cast("string"), sanitized(aoi))
    return F.concat_ws("/", place, sanitized(product), utc_date(acquired_at), F.concat(sanitized(product), F.lit("-"), sanitized(scene), F.lit(".tif")))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def kind_and_name(stem: Column) -> Column:
    """``kind--name`` split at the first ``--``; null where either part is missing."""
    kind, name = F.regexp_extract(stem, "^(.+?)--(.+)$", 1), F.regexp_extract(stem, "^(.+?)--(.+)$", 2)
    return F.when(kind != "", F.struct(kind.alias("kind"), name.alias("name")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def without_credentials(url: Column) -> Column:
    """User and password of a URL replaced by ``***``."""
    return F.regexp_replace(url, r"://[^/@\s]+@", "://***@")


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def _utc(moment: Column) -> Column:
    """The clock in UTC, whatever the session's zone; a moment without a zone is in UTC already."""
    zone = F.when(F.typeof(moment) == "timestamp", F.current_timezone()).otherwise("UTC")
    return F.convert_timezone(zone, F.lit("UTC"), moment.cast("timestamp_ntz"))


def utc_date(moment: Column) -> Column:
    return F.date_format(_utc(moment), "yyyy-MM-dd")


def stamp(moment: Column) -> Column:
    return F.date_format(_utc(moment), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_between(earlier: Column, later: Column) -> Column:
    """Fractional days, at least 0."""
    seconds = later.cast("timestamp").cast("double") - earlier.cast("timestamp").cast("double")
    return F.greatest(F.lit(0.0), seconds / 86400)


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def number_or_null(text: Column) -> Column:
    return text.try_cast("double")


def positive_or(text: Column, default: int) -> Column:
    """A whole number above 0, or the default."""
    n = F.when(F.trim(text).rlike("^[0-9]{1,18}$"), F.trim(text)).cast("long")
    return F.when(n > 0, n).otherwise(F.lit(default).cast("long"))


def resolved(*layers: tuple[str, Column]) -> Column:
    """The first value that is not null, with the label of its layer."""
    value = F.coalesce(*[c for _, c in layers])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in layers])
    return F.struct(value.alias("value"), source.alias("source"))


def full_match(text: Column, pattern: str) -> Column:
    """Whether the whole text has the form."""
    return text.rlike(f"^(?:{pattern})\\z")


def canonical_path(path: Column) -> Column:
    """A path without repeated slashes, ``.`` parts and ``name/..`` pairs, however nested; at the root ``..`` stays there."""
    trimmed = F.trim(path)
    rooted = F.startswith(trimmed, F.lit("/"))

    def onward(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        back = F.when(last.isNotNull() & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(trimmed, "/"), F.array().cast("array<string>"), onward)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))


def known_orbit(direction: Column) -> Column:
    """The direction of a pass; anything but the two is an error, null stays null."""
    wrong = F.raise_error(F.concat(F.lit("unknown orbit direction "), direction))
    return F.when(direction.isNull() | direction.isin("ASCENDING", "DESCENDING"), direction).otherwise(wrong)
