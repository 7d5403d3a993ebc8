"""Column expressions: names, values, times, labels, identifiers and orbits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lifespan import fixed_values as fv


def finite(column: Column) -> Column:
    """True when a double is neither null, NaN nor infinite."""
    return (
        column.isNotNull()
        & ~F.isnan(column)
        & (F.abs(column) != F.lit(float("inf")))
    )


def finite_or_null(column: Column) -> Column:
    return F.when(finite(column), column)


# -- names -----------------------------------------------------------------
def header_key(column: Column) -> Column:
    """Trimmed, lower case, without white space (text already in NFKC form)."""
    return F.regexp_replace(F.lower(F.trim(column)), r"\s+", "")


def name_key(column: Column) -> Column:
    """Like ``header_key`` and also without separators and brackets."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_.\-/:()\[\]{}]+", "")


# fixed values: what a search key leaves out
SEARCH_MARKS = r"[\s_\-./\\:：，,。；;（）()\[\]{}]+"


def search_key(column: Column) -> Column:
    return F.regexp_replace(
        F.lower(F.coalesce(column, F.lit(""))), SEARCH_MARKS, ""
    )


# -- values ----------------------------------------------------------------
def _number(cell: Column) -> Column:
    """Double of a trimmed cell; type suffixes and hexadecimal forms, which a cast takes, are no numbers."""
    return F.when(~cell.rlike(r"(?i)^[+-]?0x|[0-9.][df]$"), cell.try_cast("double"))


def parse_value(text: Column) -> Column:
    """Finite double of a cell, null when the cell is not one."""
    return finite_or_null(_number(F.trim(text)))


def value_issue(text: Column) -> Column:
    """Why a cell is not a finite number; null when it is one."""
    cell = F.trim(text)
    number = _number(cell)
    return (
        F.when(F.coalesce(cell, F.lit("")) == "", "empty_value")
        .when(cell.rlike(r"^[\[{]"), "nested_table_cell")
        .when(number.isNull(), "invalid_value")
        .when(~finite(number), "nonfinite_value")
    )


def round_half_even(column: Column, digits: int = 4) -> Column:
    """Display rounding; non-finite values become null."""
    return F.bround(finite_or_null(column), digits)


# -- time ------------------------------------------------------------------
_ISO_ZONE = r"(?i)(z|[+-]\d{2}:?\d{2})$"
_ISO = r"(?i)^\d{4}-\d{2}-\d{2}([ t]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(z|[+-]\d{2}:?\d{2})?)?$"


def _stamp(cell: Column) -> Column:
    """Timestamp of an ISO date or date and time; one without a zone is in UTC, whatever the session's is."""
    timed = F.regexp_replace(cell, "^(.{16})(?!:)", "$1:00")
    zoned = (
        F.when(F.length(cell) == 10, F.concat(cell, F.lit("T00:00:00Z")))
        .when(cell.rlike(_ISO_ZONE), timed)
        .otherwise(F.concat(timed, F.lit("Z")))
    )
    return F.when(cell.rlike(_ISO), F.try_to_timestamp(F.upper(zoned)))


def time_kind(text: Column) -> Column:
    """numeric, iso_aware, iso_naive, or null when the text is no time."""
    cell = F.trim(text)
    number = _number(cell)
    stamp = _stamp(cell)
    return (
        F.when(number.isNotNull(), F.when(finite(number), "numeric"))
        .when(stamp.isNull(), None)
        .when(cell.rlike(_ISO_ZONE), "iso_aware")
        .otherwise("iso_naive")
    )


def time_order(text: Column) -> Column:
    """Position on the time axis: the number itself, or seconds since 1970 (UTC)."""
    cell = F.trim(text)
    number = finite_or_null(_number(cell))
    stamp = F.unix_micros(_stamp(cell)) / F.lit(1e6)
    return F.coalesce(F.when(number == 0, 0.0).otherwise(number), stamp)


def to_seconds(t: Column, unit: Column) -> Column:
    """Seconds of a reading in a named unit; null for units without a length."""
    factor = F.create_map(*[F.lit(x) for kv in fv.SECONDS_PER_UNIT.items() for x in kv])
    return t * F.try_element_at(factor, unit)


def bin_index(seconds: Column, width: float = fv.BIN_WIDTH_S) -> Column:
    return F.floor(seconds / F.lit(float(width)))


def bin_age_days(index: Column) -> Column:
    """Age of a half-open bin: its last sample on the sampling grid, in days."""
    samples = F.ceil((index + 1) * F.lit(fv.BIN_WIDTH_S) / F.lit(fv.SAMPLE_PERIOD_S)) - 1
    return samples * F.lit(fv.SAMPLE_PERIOD_S) / F.lit(86400.0)


# -- identifiers -----------------------------------------------------------
def design_id(column: Column) -> Column:
    """Parts of a design-of-experiment identifier; ``dev`` is null when neither form fits."""

    def part(pattern, group, kind="string"):
        return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group).cast(kind))

    full, dev = fv.DESIGN_ID_PATTERN, fv.DEV_ID_PATTERN
    prefix = F.substring(column, 1, 3)
    return F.struct(
        F.coalesce(part(full, 1), part(dev, 1), F.when(prefix.isin("RWA", "BAT"), prefix)).alias("part"),
        part(full, 2).alias("orbit"),
        part(full, 3, "int").alias("beta_deg"),
        part(full, 4, "int").alias("h_level"),
        part(full, 5, "int").alias("load_level"),
        F.coalesce(part(full, 6, "int"), part(dev, 2, "int")).alias("series"),
        F.when(column.rlike(full), F.lit(False)).when(column.rlike(dev), F.lit(True)).alias("dev"),
    )


def mask_ids(column: Column) -> Column:
    return F.regexp_replace(column, fv.MASK_PATTERN, "_N$1$2")


def metadata_role(canonical: Column, header: Column) -> Column:
    """Which use a metadata column has; none of them is a model feature."""
    marked = header_key(header).rlike("|".join(fv.FUTURE_MARKERS))
    return (
        F.when(canonical.isin(*fv.TARGET_METADATA) | marked, "target_or_future_information")
        .when(canonical == "degradation_state", "evaluation_context")
        .otherwise("provenance_context")
    )


# -- labels and health -----------------------------------------------------
def age_features(age: Column, scale: Column | float) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    ratio = age / scale
    return F.array(ratio, ratio * ratio, F.sqrt(F.greatest(ratio, F.lit(0.0))))


def clip_unit(column: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), column))


def battery_health(soh: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(1.0) - soh) / F.lit(1.0 - fv.END_OF_LIFE_SOH))


def wheel_health(wear: Column, friction: Column, friction_start: Column) -> Column:
    return F.greatest(
        wear / F.lit(fv.WEAR_LIMIT_MM3),
        (friction - friction_start) / (F.lit(fv.FRICTION_LIMIT_NM) - friction_start),
    )


def friction_feature(current_mean: Column, temp_mean: Column, intercept: Column, slope: Column) -> Column:
    return current_mean - (intercept + slope * temp_mean)


def zone_of(health: Column, zones=fv.HEALTH_ZONES) -> Column:
    """Label of the half-open zone a health index lies in, null outside all zones."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(zones):
        out = F.when((health >= low) & (health < high), label).otherwise(out)
    return out


# -- small texts -----------------------------------------------------------
def note_pairs(column: Column, keys) -> Column:
    """``k=v;k=v`` note as a map of the wanted keys; fragments without '=' are dropped."""
    fragments = F.filter(F.split(column, ";"), lambda s: s.contains("="))
    entries = F.transform(
        fragments,
        lambda s: F.struct(
            F.trim(F.substring_index(s, "=", 1)).alias("key"),
            F.regexp_replace(F.trim(F.regexp_replace(s, "^[^=]*=", "")), '^"+|"+$', "").alias("value"),
        ),
    )
    wanted = F.filter(entries, lambda e: e["key"].isin(*keys))
    # the last spelling of a repeated key wins
    return F.map_from_entries(
        F.filter(
            F.transform(wanted, lambda e, i: F.struct(e["key"], F.when(
                ~F.exists(F.slice(wanted, i + 2, F.size(wanted)), lambda later: later["key"] == e["key"]),
                e["value"],
            ).alias("value"))),
            lambda e: e["value"].isNotNull(),
        )
    )


def config_lines(column: Column) -> Column:
    """``key: value`` lines as structs; lines under ``overrides:`` are flagged."""
    numbered = F.transform(F.split(column, r"\r?\n"), lambda s, i: F.struct(s.alias("line"), i.alias("i")))
    rows = F.filter(
        numbered, lambda r: (F.trim(r["line"]) != "") & ~F.ltrim(r["line"]).startswith("#")
    )
    top = F.filter(rows, lambda r: ~r["line"].startswith(" "))
    last_head = lambda r: F.element_at(
        F.filter(top, lambda h: h["i"] <= r["i"]), F.lit(-1)
    )
    parsed = F.transform(
        rows,
        lambda r: F.struct(
            F.trim(F.substring_index(r["line"], ":", 1)).alias("key"),
            F.trim(F.regexp_replace(r["line"], "^[^:]*:?", "")).alias("value"),
            r["line"].startswith(" ").alias("override"),
            F.coalesce(
                F.trim(F.substring_index(last_head(r)["line"], ":", 1)) == "overrides", F.lit(False)
            ).alias("inside"),
            r["line"].startswith("  ").alias("indented"),
        ),
    )
    return F.filter(
        parsed,
        lambda p: (~p["override"] & (p["key"] != "overrides")) | (p["indented"] & p["inside"]),
    )


def contains_all_tokens(fields: list[Column], query: str, normal: list[Column] | None = None) -> Column:
    """All comma- or space-separated tokens of a query occur in the joined fields or their search keys.

    ``normal`` has the fields in compatibility form.
    """
    import re
    import unicodedata

    text = unicodedata.normalize("NFKC", query.lower())
    tokens = [re.sub(SEARCH_MARKS, "", t) for t in re.split(r"[\s,，]+", text)]
    haystack = F.lower(F.concat_ws(" ", *fields, *[search_key(f) for f in normal or fields]))
    hit = F.lit(True)
    for token in filter(None, tokens):
        hit = hit & haystack.contains(token)
    return hit


# -- orbits ----------------------------------------------------------------
MU = fv.EARTH_MU_KM3_S2
RADIUS = fv.EARTH_RADIUS_KM


def orbit_from_circular(altitude: Column) -> tuple[Column, Column]:
    return F.lit(RADIUS) + altitude, F.lit(0.0)


def orbit_from_apsides(perigee: Column, apogee: Column) -> tuple[Column, Column]:
    rp, ra = F.lit(RADIUS) + perigee, F.lit(RADIUS) + apogee
    return (rp + ra) / 2, (ra - rp) / (ra + rp)


def orbit_from_state(altitude: Column, speed: Column) -> tuple[Column, Column, Column]:
    """Semi-major axis, eccentricity and specific energy of a tangential state."""
    radius = F.lit(RADIUS) + altitude
    energy = speed * speed / 2 - F.lit(MU) / radius
    a = F.when(F.abs(energy) > 1e-9, -F.lit(MU) / (2 * energy))
    e = F.abs(radius * speed * speed / F.lit(MU) - 1)
    return a, e, energy


def period_minutes(a: Column) -> Column:
    return F.lit(2 * math.pi) * F.sqrt(a * a * a / F.lit(MU)) / 60


def orbit_facts(
    a: Column, e: Column, energy: Column | None = None, parameter: Column | None = None
) -> dict[str, Column]:
    """Apsides, period, speeds, class and drawability of a Keplerian orbit.

    A parabola has no semi-major axis; its perigee comes from ``parameter``, the semi-latus rectum.
    """
    energy = F.coalesce(energy, -F.lit(MU) / (2 * a)) if energy is not None else -F.lit(MU) / (2 * a)
    closed = (a > 0) & (e < 1)
    perigee = F.when(e < 1, a * (1 - e) - F.lit(RADIUS)).when(
        e > 1, F.abs(a) * (e - 1) - F.lit(RADIUS)
    )
    if parameter is not None:
        perigee = perigee.when((e == 1) & (parameter > 0), parameter / 2 - F.lit(RADIUS))
    apogee = F.when(e < 1, a * (1 + e) - F.lit(RADIUS))
    clash = F.coalesce((a > 0) & (e >= 1) & (energy < -1e-8), F.lit(False))
    clear = F.coalesce(perigee >= fv.MIN_PERIGEE_KM, F.lit(False))

    def speed(height):
        r = height + F.lit(RADIUS)
        return F.when(closed & (r > 0), F.sqrt(F.greatest(F.lit(0.0), F.lit(MU) * (2 / r - 1 / a))))

    kind = (
        F.when(clash, "inconsistent")
        .when((e >= 1) | (energy >= 0), F.when(e > 1, "hyperbola").otherwise("parabola"))
        .when(perigee.isNotNull(), F.when(e < 0.01, "circular").when(clear, "ellipse").otherwise("suborbital"))
        .otherwise("unspecified")
    )
    return {
        "perigee_km": perigee,
        "apogee_km": apogee,
        "period_min": F.when(closed, period_minutes(a)),
        "speed_min_km_s": speed(apogee),
        "speed_max_km_s": speed(perigee),
        "orbit_class": kind,
        "drawable": ~clash & clear,
    }


def elements_valid(a: Column, e: Column, inclination: Column) -> Column:
    return (
        finite(a) & finite(e) & finite(inclination)
        & (a > RADIUS) & (e >= 0) & (e < 1) & inclination.between(0, 180)
    )
