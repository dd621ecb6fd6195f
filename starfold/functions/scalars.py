"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import hash_int

# Fixed values that the results depend on.
SIMILARITY_KNOTS = [(0.73, 0.3), (0.786, 0.5), (0.918, 0.8), (0.973, 1.0)]
FOCAL_BUCKETS = [(20, "<20"), (35, "20-35"), (70, "35-70"), (135, "70-135"), (300, "135-300"), (600, "300-600")]
RATING_ELEMENT = r"<xmp:Rating>([-0-9]+)</xmp:Rating>"
RATING_ATTRIBUTE = r'xmp:Rating="([-0-9]+)"'


def tier(rating: Column, cap: int = 3) -> Column:
    """Star class, everything from ``cap`` up is one class."""
    return F.least(rating, F.lit(cap))


def at_least(rating: Column, k: int) -> Column:
    """Threshold label 1/0; NULL rating stays NULL."""
    return (rating >= k).cast("int")


def normalise_event(label: Column, fallback: str) -> tuple[Column, Column]:
    """(event, was_blank). A blank event is a real, named event."""
    blank = F.coalesce(F.trim(label) == "", F.lit(True))
    return F.when(blank, F.lit(fallback)).otherwise(label), blank


def parse_time(text: Column, subsec: Column) -> Column:
    """Timestamp with its separate sub-second digits; unreadable text gives NULL."""
    digits = F.when(subsec.rlike(r"^\d+$"), F.rpad(F.substring(subsec, 1, 6), 6, "0"))
    stamp = F.translate(F.substring(text, 1, 19), "T", " ")
    return F.try_to_timestamp(F.concat(stamp, F.lit("."), F.coalesce(digits, F.lit("000000"))), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))


def strip_export_suffix(name: Column) -> Column:
    """Drop the extension and a trailing ``@JPG`` or ``@JPG_n`` of exported files."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"(?i)@JPG(_\d+)?$", "")


def apply_aliases(df: DataFrame, col: str, aliases: dict[str, str]) -> DataFrame:
    """Rename values by a literal alias map."""
    if not aliases:
        return df
    pairs = [F.lit(x) for kv in sorted(aliases.items()) for x in kv]
    return df.withColumn(col, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col)), F.col(col)))


def excluded_by_keyword(path: Column, keywords: list[str]) -> Column:
    """P5: any path component contains a keyword, ignoring case."""
    words = [k.lower() for k in keywords if k]
    if not words:
        return F.lit(False)
    parts = F.split(F.lower(path), r"[/\\]")
    return F.exists(parts, lambda p: F.greatest(F.lit(False), *[p.contains(w) for w in words]))


def crop_factor(focal: Column, equivalent: Column) -> Column:
    """35 mm equivalent over real focal length, NULL where either is missing or not positive."""
    return F.when((focal > 0) & (equivalent > 0), equivalent / focal)


def equivalent_focal(focal: Column, equivalent: Column) -> Column:
    """Stored equivalent, else the real focal length, else NULL."""
    return F.when(equivalent > 0, equivalent).when(focal > 0, focal)


def focal_bucket(equivalent: Column) -> Column:
    """Focal class of the scan report; NULL focal length is its own class."""
    out = F.when(equivalent.isNull(), "unknown")
    for upper, name in FOCAL_BUCKETS:
        out = out.when(equivalent < upper, name)
    return out.otherwise(">=600")


def log_features(value: Column, floor: float) -> tuple[Column, Column]:
    """(log of the floored value, missing mask)."""
    return F.log(F.greatest(F.coalesce(value, F.lit(floor)), F.lit(floor))), value.isNull().cast("int")


def piecewise_weight(x: Column, knots=SIMILARITY_KNOTS) -> Column:
    """Linear interpolation between knots, 0 below the first, constant above the last."""
    out = F.when(x < knots[0][0], F.lit(0.0))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x < x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(knots[-1][1]))


def gap_factor(d: Column) -> Column:
    """Down-weight large star gaps (3 -> 0.5, 4 and more -> 0.25)."""
    return F.when(d == 3, 0.5).when(d >= 4, 0.25).otherwise(1.0)


def confidence_weight(d: Column) -> Column:
    """Confidence of a labelled star gap (1 -> 0.5, 2 -> 1, 3 and more -> 1.5)."""
    return F.when(d == 1, 0.5).when(d == 2, 1.0).otherwise(1.5)


def fold_angle(x: Column) -> Column:
    """P10: fold degrees to [-45, 45)."""
    return F.pmod(x + 45.0, F.lit(90.0)) - 45.0


def angle_difference(a: Column, b: Column) -> Column:
    """P10: circular difference of two folded angles."""
    return fold_angle(a - b)


def hash_order(seed: str, key: Column) -> Column:
    """SHA-256 hex of ``seed:key``, for a reproducible order."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def hash_half(prefix: str, key: Column) -> Column:
    """0/1 half of a key, from the first 8 hex digits of its SHA-256."""
    return (F.conv(F.substring(hash_order(prefix, key), 1, 8), 16, 10).cast("long") % 2).cast("int")


def mask_attribute(text: Column) -> Column:
    """Replace an embedded 0-5 rating by 0 in element and attribute form, keeping the length."""
    one = F.regexp_replace(text, r"xmp:Rating>[0-5]<", "xmp:Rating>0<")
    return F.regexp_replace(one, r'xmp:Rating="[0-5]"', 'xmp:Rating="0"')


def has_rating_residue(text: Column) -> Column:
    """A non-zero rating is still readable."""
    return text.rlike(r"xmp:Rating>[1-5]") | text.rlike(r'xmp:Rating="[1-5]')


def extract_rating(*texts: Column) -> Column:
    """Highest embedded rating over all texts, clipped to 0..5, 0 if none."""
    found = F.concat(*[
        F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), F.lit(1)) for t in texts for p in (RATING_ELEMENT, RATING_ATTRIBUTE)
    ])
    best = F.array_max(F.transform(found, lambda s: s.try_cast("int")))
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(best, F.lit(0))))


def tilt_probabilities(probs: Column, signal: Column, gamma: float) -> Column:
    """Add ``gamma * signal * class`` to log probabilities and renormalise."""
    logits = F.transform(probs, lambda p, i: F.log(F.greatest(p, F.lit(1e-12))) + gamma * signal * i)
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def seeded_unit(seed: str, *cols) -> Column:
    """Uniform number in [0, 1) from a hash."""
    return hash_int(seed, *cols) / F.lit(float(1 << 32))
