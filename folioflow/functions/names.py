"""File names, titles, hrefs and locale tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, strip

# Drive tokens, regions, rule lists and patterns that must match the specified results.
POWERTRAINS = ("ICE", "EV", "HEV", "PHEV")
NORTH_AMERICA = ("US", "CA", "MX")
UNSAFE_IN_NAME = '[\\\\/:*?"<>|]'
REVIEW_SUFFIX = "(?i)_컬러체크$"
ORDER_PREFIX = "^\\d{6}_도안발주내역서_"
NO_NAME = "color-check"
LABEL_SUFFIX = "HTML"
VALID_FILE_NAME = "^[A-Za-z0-9._-]+$"
DEFAULT_TYPE = "application/octet-stream"
TYPE_BY_EXTENSION = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "pdf": "application/pdf",
    "txt": "text/plain",
    "csv": "text/csv",
    "zip": "application/zip",
}
#: chapter file by title, tried first
FILE_BY_TITLE = [
    ("opening and closing", "opening_and_closing.xml"),
    ("driver adjustments", "driver_adjustments.xml"),
    ("controls and features", "controls_and_features.xml"),
]
FILE_WITHOUT_TILE = "Foreword.xml"
#: chapter file by tile image
FILE_BY_TILE = [
    ("electric_vehicle_guide.svg", "EV.xml"),
    ("introduction.svg", "Intro.xml"),
    ("hev.svg", "hev.xml"),
    ("your_vehicle_at_a_glance.svg", "Glance.xml"),
    ("vehicle_safety_controls.svg", "Safety.xml"),
    ("Vehicle_safety_controls.svg", "Safety.xml"),
    ("Infotainment.svg", "Infotainment.xml"),
    ("vehicle_controls.svg", "Features.xml"),
    ("vehicle_driving_controls.svg", "Driving.xml"),
    ("driver_assistance_guide.svg", "ADAS.xml"),
    ("what_to_do_in_an_emergency.svg", "Emergency.xml"),
    ("maintenance.svg", "Maintenance.xml"),
    ("specifications_consumer_information.svg", "Spec.xml"),
    ("abbreviation.svg", "Abbreviation.xml"),
    ("appendix.svg", "appendix.xml"),
    ("overview.svg", "Overview.xml"),
    ("specifications.svg", "Specifications.xml"),
    ("opening_and_closing.svg", "Opening_and_Closing.xml"),
    ("driver_adjustments.svg", "Driver_Adjustments.xml"),
    ("safety_restraints.svg", "Seating_and_Safety_Restraints.xml"),
    ("controls_and_features.svg", "Controls_and_Features.xml"),
    ("Seating and safety restraints.svg", "Seating_and_safety_restraints.xml"),
    ("consumer_info.svg", "Consumer_info.xml"),
]
#: tile image by lower-cased chapter file name; the two rules with capitals never fire
TILE_BY_FILE = [
    ("hev", "hev.svg"),
    ("EV", "electric_vehicle_guide.svg"),
    ("intro", "introduction.svg"),
    ("glance", "your_vehicle_at_a_glance.svg"),
    ("safety", "vehicle_safety_controls.svg"),
    ("features", "vehicle_controls.svg"),
    ("infotainment", "Infotainment.svg"),
    ("driving", "vehicle_driving_controls.svg"),
    ("adas", "driver_assistance_guide.svg"),
    ("emergency", "what_to_do_in_an_emergency.svg"),
    ("maintenance", "maintenance.svg"),
    ("spec", "specifications_consumer_information.svg"),
    ("abbreviation", "abbreviation.svg"),
    ("appendix", "appendix.svg"),
    ("manual", "electric_vehicle_guide.svg"),
    ("overview", "your_vehicle_at_a_glance.svg"),
    ("specifications", "specifications.svg"),
    ("opening_and_closing", "vehicle_controls.svg"),
    ("driver_adjustments", "vehicle_controls.svg"),
    ("seating_and_safety_restraints", "safety_restraints.svg"),
    ("controls_and_features", "vehicle_controls.svg"),
    ("consumer_info", "specifications_consumer_information.svg"),
    ("Seating_and_Safety_Restraints", "safety_restraints.svg"),
]
CLASS_BY_TITLE = {"Abbreviation": "abbr", "Appendix": "appx"}


def first_rule(rules: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    """Value of the first condition that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out if default is None else out.otherwise(default)


def chapter_file(title: Column, tile: Column) -> Column:
    """Chapter file from the title, else from the tile image; no tile means the foreword."""
    key = collapse(F.lower(title))
    image = F.substring_index(tile, "/", -1)
    rules = [(key == t, F.lit(f)) for t, f in FILE_BY_TITLE]
    rules.append((tile.isNull(), F.lit(FILE_WITHOUT_TILE)))
    rules += [(image == t, F.lit(f)) for t, f in FILE_BY_TILE]
    return first_rule(rules)


def tile_for(file_name: Column) -> Column:
    name = F.lower(file_name)
    return first_rule([(F.contains(name, F.lit(n)), F.lit(svg)) for n, svg in TILE_BY_FILE])


def class_for(title: Column) -> Column:
    return first_rule([(title == t, F.lit(c)) for t, c in CLASS_BY_TITLE.items()])


def region(title: Column, strict: bool = False) -> Column:
    """NA when the title names a North American country, else EU.

    The plain test is a bare substring; ``strict`` looks at locale tokens such as en_US only.
    """
    text = F.upper(collapse(title))
    if strict:
        hit = text.rlike("(^|[^A-Z])[A-Z]{2}[_-](" + "|".join(NORTH_AMERICA) + ")([^A-Z]|$)")
    else:
        hit = F.lit(False)
        for code in NORTH_AMERICA:
            hit = hit | F.contains(text, F.lit(code))
    return F.when(hit, "NA").otherwise("EU")


def swap_locale(name: Column, code: Column) -> Column:
    """Put another locale code (xx-YY) into a name; the underscore form goes before the dash form."""
    under = F.replace(code, F.lit("-"), F.lit("_"))
    return (
        F.when(name.rlike("[a-z]{2}_[A-Z]{2}"), F.regexp_replace(name, F.lit("[a-z]{2}_[A-Z]{2}"), under))
        .when(name.rlike("[a-z]{2}-[A-Z]{2}"), F.regexp_replace(name, F.lit("[a-z]{2}-[A-Z]{2}"), code))
        .otherwise(name)
    )


def title_metadata(title: Column, platform: str, dropped: Sequence[str] = ()) -> Column:
    """Fields of a title PLATFORM-MODEL-...-lang-YEAR; null when another platform leads.

    ``dropped`` middle tokens (upper case) are left out of ``base``.
    """
    tokens = F.split(collapse(title), "-")
    middle = F.slice(tokens, F.lit(3), F.greatest(F.size(tokens) - 4, F.lit(0)))
    if dropped:
        middle = F.filter(middle, lambda t: ~F.upper(t).isin(*dropped))
    fields = F.struct(
        F.get(tokens, F.lit(0)).alias("platform"),
        F.get(tokens, F.lit(1)).alias("model"),
        F.array_join(middle, "-").alias("base"),
        F.try_element_at(tokens, F.lit(-2)).alias("lang"),
        F.try_element_at(tokens, F.lit(-1)).alias("year"),
    )
    return F.when(F.upper(F.get(tokens, F.lit(0))) == platform.upper(), fields)


def _part(col: Column) -> Column:
    return F.upper(F.regexp_replace(col, "[^A-Za-z0-9]", ""))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vehicle_label(name: Column, prefix: str) -> Column:
    """Vehicle label from an export file name that carries ``prefix-model-...-locale-year``.

    Model parts are joined by '_', drive types by '-', then year, region and a fixed suffix. Names of
    another shape give their cleaned base name. Each step is bound once: spelled out, the uses of uses
    would multiply.
    """
    base = F.regexp_replace(
        F.regexp_replace(strip(F.coalesce(name, F.lit(NO_NAME))), "(?i)\\.xlsx?$", ""),
        REVIEW_SUFFIX,
        "",
    )

    def tokens_of(base: Column) -> Column:
        tail = F.regexp_extract(base, f"(?i)({prefix}-.*)$", 1)
        return F.split(F.regexp_replace(tail, "(?i)^(.*?[a-z]{2}_[a-z]{2})_(20\\d{2})", "$1-$2"), "-")

    def of_tokens(tokens: Column) -> Column:
        is_year = F.transform(tokens, lambda t, i: (i >= 3) & t.rlike("^\\d{4}$"))
        year_at = F.array_position(is_year, F.lit(True)).cast("int")  # 1-based, 0 when absent
        return _bound(year_at, lambda at: F.when(at > 3, of_year(tokens, at)))

    def of_year(tokens: Column, year_at: Column) -> Column:
        locale, before = F.get(tokens, year_at - 2), F.get(tokens, year_at - 3)
        halves = F.split(locale, "_")
        joined = (
            (F.size(halves) == 2)
            & (F.length(F.get(halves, F.lit(0))) == 2)
            & (F.length(F.get(halves, F.lit(1))) == 2)
        )
        split_pair = before.rlike("(?i)^[a-z]{2}$") & locale.rlike("(?i)^[a-z]{2}$")
        place = F.struct(
            F.when(joined, year_at - 2).when(split_pair, year_at - 3).otherwise(year_at - 2).alias("start"),
            _part(F.when(joined, F.get(halves, F.lit(0))).when(split_pair, before).otherwise("")).alias("language"),
            _part(F.when(joined, F.get(halves, F.lit(1))).otherwise(locale)).alias("country"),
        )
        year = F.concat(F.substring(F.get(tokens, year_at - 1), 3, 2), F.lit("MY"))
        return _bound(place, lambda p: _bound(vehicle_of(tokens, p["start"]), lambda v: joined_label(v, year, land_of(p))))

    def vehicle_of(tokens: Column, start: Column) -> Column:
        model = F.split(F.get(tokens, F.lit(1)), "_")
        rest = F.transform(
            F.concat(
                F.slice(model, F.lit(2), F.greatest(F.size(model), F.lit(1))),
                F.slice(tokens, F.lit(3), F.greatest(start - 2, F.lit(0))),
            ),
            _part,
        )
        return _bound(rest, lambda rest: with_drives(_part(F.get(model, F.lit(0))), rest))

    def with_drives(first: Column, rest: Column) -> Column:
        drives = F.filter(rest, lambda t: t.isin(*POWERTRAINS))
        names = F.filter(rest, lambda t: ~t.isin(*POWERTRAINS) & (t != ""))
        vehicle = F.array_join(F.concat(F.array(first), names), "_")
        return _bound(
            F.struct(vehicle.alias("v"), F.array_join(drives, "-").alias("d"), F.size(drives).alias("n")),
            lambda x: F.when(x["n"] > 0, F.concat(x["v"], F.lit("_"), x["d"])).otherwise(x["v"]),
        )

    def land_of(place: Column) -> Column:
        land = F.when(place["language"] == "KO", place["language"]).otherwise(place["country"])
        return F.when(land == "GB", "EG").otherwise(land)

    def joined_label(vehicle: Column, year: Column, land: Column) -> Column:
        return _bound(
            land,
            lambda land: F.when((vehicle != "") & (land != ""), F.concat_ws("_", vehicle, year, land, F.lit(LABEL_SUFFIX))),
        )

    def plain(base: Column) -> Column:
        cleaned = F.regexp_replace(F.regexp_replace(base, ORDER_PREFIX, ""), UNSAFE_IN_NAME, "_")
        return _bound(cleaned, lambda c: F.when(F.length(F.trim(c)) == 0, NO_NAME).otherwise(c))

    return _bound(base, lambda b: F.coalesce(_bound(tokens_of(b), of_tokens), plain(b)))


def safe_name(name: Column, stamp: Column, extension: str) -> Column:
    """Export name: stamp, base name without .pdf and unsafe characters, suffix."""
    base = F.when(F.length(strip(F.coalesce(name, F.lit("")))) == 0, "PDF").otherwise(strip(name))
    base = F.regexp_replace(F.regexp_replace(base, "(?i)\\.pdf$", ""), UNSAFE_IN_NAME, "_")
    return F.concat(stamp, F.lit("_"), base, F.lit(f"_Comment.{extension}"))


def valid_file_name(name: Column) -> Column:
    return name.rlike(VALID_FILE_NAME)


def content_type(declared: Column, file_name: Column) -> Column:
    """Declared type, else by file extension, else the default type."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_BY_EXTENSION.items() for x in pair])
    extension = F.lower(F.regexp_extract(file_name, "\\.([^.]+)$", 1))
    return F.coalesce(
        F.when(F.length(strip(declared)) > 0, declared), known[extension], F.lit(DEFAULT_TYPE)
    )


def slashes(href: Column) -> Column:
    return F.translate(href, "\\", "/")


def href_file(href: Column) -> Column:
    """File name of an href, fragment removed."""
    path = F.substring_index(slashes(F.coalesce(href, F.lit(""))), "#", 1)
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def href_rename(href: Column, file_name: Column) -> Column:
    """Replace the file name of an href and keep its folder and fragment."""
    name = slashes(strip(F.coalesce(file_name, F.lit(""))))
    old = slashes(strip(F.coalesce(href, F.lit(""))))
    folder = F.regexp_extract(old, "^([^#]*/)?[^#/]*(#.*)?$", 1)
    fragment = F.regexp_extract(old, "(#.*)$", 1)
    return (
        F.when(name == "", "")
        .when((old == "") | old.endswith("/"), name)
        .otherwise(F.concat(folder, name, fragment))
    )


def natural_key(col: Column) -> Column:
    """Sort key that compares digit runs by value and letters without case."""
    runs = F.regexp_extract_all(F.lower(col), F.lit("(\\d+|\\D+)"), 1)
    # a run's length without leading zeros goes first, so runs of any length compare by value
    bare = F.transform(runs, lambda r: F.regexp_replace(r, "^0+(?=\\d)", ""))
    sized = F.transform(
        bare, lambda r: F.when(r.rlike("^\\d"), F.concat(F.lpad(F.length(r).cast("string"), 9, "0"), r)).otherwise(r)
    )
    return F.array_join(sized, "")


def chapter_group(file_name: Column) -> Column:
    """0 foreword, 1 numbered, 2 the rest."""
    return (
        F.when(F.lower(file_name) == "foreword.xml", 0)
        .when(file_name.rlike("^[0-9]{2}"), 1)
        .otherwise(2)
    )


def leading_number(file_name: Column) -> Column:
    return F.when(file_name.rlike("^[0-9]{2}"), F.substring(file_name, 1, 2).cast("int")).otherwise(-1)


def chapter_number(declared: Column, file_name: Column) -> Column:
    """Declared chapter number, else derived from the file name."""
    fallback = (
        F.when(F.lower(file_name) == "foreword.xml", 1)
        .when(file_name.rlike("^[0-9]{2}"), F.substring(file_name, 1, 2).cast("int"))
        .otherwise(2147483647)
    )
    return F.coalesce(strip(declared).try_cast("int"), fallback)
