"""Scalar clean-up rules and sale classification, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of single-family and of small multi-family buildings (fixed values).
SINGLE_FAMILY = ("202", "203", "204", "205", "206", "207", "208", "209", "210", "234", "278", "295")
MULTI_FAMILY = ("211", "212")
#: Words that stand for true and false (fixed values).
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "1"), ("false", "f", "no", "0")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or an error naming the columns it lacks."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, names: tuple[str, ...]) -> str:
    """The first of ``names`` that is a column of ``df``."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {', '.join(names)} is present")


def col_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normalize_pin(pin: str | Column) -> Column:
    """Digits before the first point, padded to 14; null without digits or with more."""
    digits = F.regexp_replace(F.split_part(_col(pin).cast("string"), F.lit("."), F.lit(1)), "[^0-9]", "")
    return F.when(F.length(digits).between(1, 14), F.lpad(digits, 14, "0"))


def lenient_boolean(value: str | Column) -> Column:
    low = F.lower(_col(value).cast("string"))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def stable_id(row_id: str | Column, *parts: str | Column) -> Column:
    """The given id, or the first 24 hex digits of a hash of the parts."""
    own = F.trim(_col(row_id).cast("string"))
    joined = F.concat_ws("|", *(F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts))
    return F.when(F.length(own) > 0, own).otherwise(F.substring(F.sha2(joined, 256), 1, 24))


def garage_spaces(text: str | Column) -> Column:
    """The first number in a text; 0 for "no"; else null."""
    number = F.regexp_extract(_col(text), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.lower(F.trim(_col(text))) == "no", 0.0).otherwise(number)


def has_basement(text: str | Column) -> Column:
    return _col(text).isNotNull() & ~F.lower(F.trim(_col(text))).isin("", "none", "no", "0")


def number(value: str | Column) -> Column:
    return _col(value).try_cast("double")


def not_negative(value: str | Column) -> Column:
    """Clipped at zero; null stays null, unlike with greatest()."""
    return F.when(_col(value).isNotNull(), F.greatest(_col(value), F.lit(0)))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(_col(a).cast("double"), F.nullif(_col(b).cast("double"), F.lit(0.0)))


def rate(a: str | Column, b: str | Column) -> Column:
    """A ratio that has to lie from 0 to 1, else null."""
    r = safe_ratio(a, b)
    return F.when(r.between(0, 1), r)


def banded(value: str | Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """Right-closed bands: ``labels[i]`` up to ``edges[i]``, the last one beyond; null stays null."""
    v = _col(value)
    out = F.when(v <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:], strict=False):
        out = out.when(v <= edge, label)
    return out.when(v.isNotNull(), labels[len(edges)])


def reasons(**rules: Column) -> Column:
    """Names of the rules that hold, in order; an unknown rule does not hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in rules.items())))


#: Columns of the register's own filters that a classification needs (fixed values).
QUALITY_FILTERS = ("sale_filter_same_sale_within_365", "sale_filter_less_than_10k", "sale_filter_deed_type")

#: Right-closed bands of building age and size (fixed values); sizes of zero or less are in none.
AGE_BANDS = ((9, 24, 49, 74, 99), ("0-9", "10-24", "25-49", "50-74", "75-99", "100+"))
SIZE_BANDS = ((999, 1499, 1999, 2999), ("<1,000", "1,000-1,499", "1,500-1,999", "2,000-2,999", "3,000+"))


def age_band(age: str | Column) -> Column:
    return banded(number(age), *AGE_BANDS)


def size_band(sqft: str | Column) -> Column:
    v = number(sqft)
    return F.when(v > 0, banded(v, *SIZE_BANDS))


@dataclass(frozen=True)
class PopulationRules:
    single_family: tuple[str, ...] = SINGLE_FAMILY
    multi_family: tuple[str, ...] = ()
    min_price: float = 10_000.0
    filters: tuple[str, ...] = QUALITY_FILTERS


def property_class(c: str | Column) -> Column:
    """A class code as text, without the ``.0`` that a number read as a float carries."""
    return F.regexp_replace(F.trim(_col(c).cast("string")), r"\.0$", "")


def classify_sales(sales: DataFrame, rules: PopulationRules = PopulationRules()) -> DataFrame:
    """``sales`` with ``population_status`` (excluded before ambiguous before market) and reason lists; no row goes.

    The filter columns of ``rules`` have to be there: a table without them would pass for clean.
    """
    require(sales, "pin", "class", "sale_date", "sale_price", *rules.filters)
    flags = rules.filters
    pin, price = normalize_pin("pin"), number("sale_price")
    excluded = reasons(
        invalid_pin=pin.isNull(),
        missing_or_invalid_sale_date=F.col("sale_date").try_cast("timestamp_ntz").isNull(),
        missing_or_invalid_sale_price=price.isNull(),
        price_below_minimum=price < rules.min_price,
        non_target_property_class=~F.coalesce(property_class("class").isin(*rules.single_family, *rules.multi_family), F.lit(False)),
        **{f: lenient_boolean(f) for f in flags},
    )
    unknown = reduce(lambda a, b: a | b, (lenient_boolean(f).isNull() for f in flags)) if flags else F.lit(False)
    multi = lenient_boolean("is_multisale") if "is_multisale" in sales.columns else F.lit(False)
    ambiguous = reasons(missing_sale_filter_metadata=unknown, multi_parcel_sale=multi)
    return sales.withColumns({"normalized_pin": pin, "exclusion_reasons": excluded, "ambiguity_reasons": ambiguous}).withColumn(
        "population_status",
        F.when(F.size("exclusion_reasons") > 0, "excluded").when(F.size("ambiguity_reasons") > 0, "ambiguous").otherwise("market"),
    ).withColumn("is_primary_population", F.col("population_status") == "market")


def market_samples(sales: DataFrame, flags: list[str], strict_min: float = 25_000, moderate_min: float = 10_000) -> DataFrame:
    """``strict_market`` and ``moderate_market``: flags all known to be false, or none known to be true.

    A null ``is_multisale`` fails both, though null flags pass the moderate one.
    """
    known = [lenient_boolean(f) for f in flags]
    single = F.coalesce(~lenient_boolean("is_multisale"), F.lit(False))
    clear = reduce(lambda a, b: a & b, (F.coalesce(~k, F.lit(False)) for k in known))
    open_ = reduce(lambda a, b: a & b, (~F.coalesce(k, F.lit(False)) for k in known))
    price = F.coalesce(number("sale_price"), F.lit(0.0))
    family = F.col("class").isin(*SINGLE_FAMILY)
    return sales.withColumns({"strict_market": clear & single & (price >= strict_min) & F.coalesce(family, F.lit(False)), "moderate_market": open_ & single & (price >= moderate_min) & F.coalesce(family | F.col("class").isin(*MULTI_FAMILY), F.lit(False))})


#: Estimates at or below this stand for missing ones in census tables (fixed value).
CENSUS_SENTINEL = -100_000_000


def acs_features(df: DataFrame) -> DataFrame:
    """Rates and levels of census tracts, beside the identifiers that ``df`` has.

    Columns that are not there count as null; sentinels and non-numbers are null; rates and shares outside 0 to 1
    are null; densities come only with a land area.
    """

    def of(*names: str) -> Column:
        known = [number(n) for n in names if n in df.columns]
        return F.coalesce(*(F.when(c > CENSUS_SENTINEL, c) for c in known)) if known else F.lit(None).cast("double")

    def rate(a: Column, b: Column) -> Column:
        r = F.try_divide(a, b)
        return F.when(r.between(0, 1), r)

    graduate = of("masters_degree") + of("professional_degree") + of("doctorate_degree")
    population, housing, area = of("population", "tract_population"), of("housing_units"), of("tract_land_sq_miles")
    occupied, commuters, adults = of("occupied_units"), of("commuters_total"), of("population_25_plus")
    # names of census columns and of results: fixed values
    out = {
        "median_household_income": of("median_household_income"),
        "poverty_rate": rate(of("poverty_population"), of("poverty_universe")),
        "bachelors_or_higher_rate": rate(of("bachelors_degree") + graduate, adults),
        "graduate_degree_rate": rate(graduate, adults),
        "owner_occupancy_rate": rate(of("owner_occupied_units"), occupied),
        "renter_occupancy_rate": rate(of("renter_occupied_units"), occupied),
        "vacancy_rate": rate(of("vacant_units"), housing),
        "average_household_size": of("average_household_size"),
        "median_housing_age": not_negative(of("acs_match_year", "acs_vintage") - of("median_year_structure_built")),
        "tract_population": population,
        "housing_units": housing,
        "transit_commute_share": rate(of("commuters_public_transit"), commuters),
        "automobile_commute_share": rate(of("commuters_drove_alone") + of("commuters_carpooled"), commuters),
    }
    if "tract_land_sq_miles" in df.columns:
        out |= {"population_density": F.try_divide(population, area), "housing_unit_density": F.try_divide(housing, area)}
    keys = [c for c in ("sale_id", "geoid", "acs_match_year", "acs_vintage", "acs_lag_years", "acs_alignment_status") if c in df.columns]
    return df.select(*keys, *(c.alias(n) for n, c in out.items()))


#: Card columns that are summed, and those whose first known text counts, with the names they get (fixed values).
CARD_SUMS = {"building_sqft": "char_bldg_sf", "bedrooms": "char_beds", "rooms": "char_rooms", "full_baths": "char_fbath", "half_baths": "char_hbath"}
CARD_TEXTS = {
    "residence_type": "char_type_resd",
    "construction_quality": "char_cnst_qlty",
    "exterior_wall": "char_ext_wall",
    "heating_type": "char_heat",
    "air_conditioning": "char_air",
    "renovation": "char_renovation",
}


def aggregate_cards(cards: DataFrame) -> DataFrame:
    """One row for each ``sale_id``, a null one too: sums, extremes and first known texts of its cards with a match year.

    Cards without one count for nothing, but their sale stays, with a ``card_count`` of 0. Land stands on every card
    of a parcel, so its greatest value counts; texts go by card number; sums of nothing known are null; bathrooms
    need both of their counts. Columns that ``cards`` lacks have no result.
    """
    require(cards, "sale_id", "card", "property_match_year")
    used = F.col("property_match_year").isNotNull()
    has = lambda c: c in cards.columns
    of = lambda c: F.when(used, c)
    first = lambda c, rule=None: F.min_by(c, F.when(F.col(c).isNotNull() & (used if rule is None else rule), F.struct("card", c)))
    out = {"card_count": F.count_if(used)}
    out |= {n: F.sum(of(number(c))) for n, c in CARD_SUMS.items() if has(c)}
    if has("char_land_sf"):
        out["land_sqft"] = F.max(of(number("char_land_sf")))
    if has("char_yrblt"):
        out["year_built"] = F.min(of(number("char_yrblt")))
    if has("char_type_resd"):
        out["stories"] = F.max(of(F.regexp_extract("char_type_resd", r"(\d+(?:\.\d+)?)", 1).try_cast("double")))
    if has("char_gar1_size"):
        out["garage_spaces"] = F.sum(of(garage_spaces("char_gar1_size")))
    if has("char_bsmt"):
        out["has_basement"] = F.bool_or(of(has_basement("char_bsmt")))
    out |= {n: first(c) for n, c in CARD_TEXTS.items() if has(c)}
    out |= {c: first(c, F.lit(True)) for c in ("property_alignment_status", "property_lag_years") if has(c)}
    rows = cards.groupBy("sale_id").agg(*(c.alias(n) for n, c in out.items()), first("property_match_year").alias("property_match_year"))
    if has("char_fbath") and has("char_hbath"):
        rows = rows.withColumn("bathrooms", F.col("full_baths") + 0.5 * F.col("half_baths"))
    return rows


def valid_degrees(latitude: str | Column, longitude: str | Column) -> Column:
    """Both are numbers of degrees that exist."""
    return F.coalesce(number(latitude).between(-90, 90) & number(longitude).between(-180, 180), F.lit(False))


def inside_box(latitude: str | Column, longitude: str | Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Whether a place lies in the box of two corners (latitude, longitude); null where it has no place."""
    return number(latitude).between(low[0], high[0]) & number(longitude).between(low[1], high[1])


def capped_sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, the same ones however the table is partitioned: those whose key and seed hash lowest.

    For fits whose size is bounded by design. Null keys hash like empty ones; ties go by the key.
    """
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return df.withColumn("_mark", mark).orderBy("_mark", key).limit(most).drop("_mark")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, or an error naming up to three keys that stand in several rows; null keys are keys."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"not unique on {', '.join(keys)}: {', '.join(str(tuple(r[k] for k in keys)) for r in repeated)}")
    return df
