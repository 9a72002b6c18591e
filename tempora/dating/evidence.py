"""Date evidence from EXIF, categories and titles, and the medium of an image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.dating.candidate import (
    LOW,
    MEDIUM,
    VERY_HIGH,
    VERY_LOW,
    candidate,
    first_reading,
    flag,
    number,
    reading,
    strings,
)
from tempora.dating.qs import CIRCA_YEARS
from tempora.dating.text import MONTH_NAME, month_number
from tempora.functions.interval import MIN_YEAR, THIS_YEAR, from_day, from_month, from_years, interval
from tempora.functions.strings import let

FIRST_DIGITAL_YEAR = 1990
FIRST_PHOTO_YEAR = 1826

# Devices of scans and reproductions, and the EXIF date format.
REPRODUCTION = (
    "(?iU)scan|epson|perfection|canoscan|hp pst|scanjet|plustek|fujitsu fi-|kodak i\\d|"
    "flextight|imacon|hasselblad|phase ?one|\\biq[1-4]\\b|\\bp ?[2-6]\\d\\+|leaf aptus|sinar|"
    "cruse|zeutschel|book2net|metis|eskoscan|vuescan|silverfast|digitali[sz]"
)
EXIF_DATE = "^(\\d{4})[:\\-](\\d{2})[:\\-](\\d{2})(?:[ T](\\d{2}):(\\d{2}):(\\d{2}))?"

# Categories whose years are no capture dates, and those about the page.
EXCLUDED = (
    "(?iU)\\b(?:built|constructed|completed|established|founded|opened|inaugurated|consecrated|"
    "demolished|disestablished|closed|births|deaths|uploaded|taken with|created with|"
    "files from|license|licen[cs]ed|cc-|pd-|gfdl|media needing|supported by|"
    "ship, \\d{4}|in use since)\\b"
)
MAINTENANCE = (
    "(?iU)^(?:pages|files|media|images|photos) (?:with|without|from|by|uploaded|needing|lacking)\\b|"
    "\\b(?:uploaded|taken with|created with|self-published|supported by|wikidata|geocoded|"
    "location|coordinates|exif|quality images|valued images|featured pictures|"
    "license|licen[cs]ed|copyright|author died|cc-|pd-|gfdl|picture of the day|"
    "media of the day|wiki loves|translation possible|user:|uploaded by)\\b"
)
YEAR_IN_PARENTHESES = "(?U)\\((?![^)]*\\b(?:before|after)\\b)[^)]*\\d{4}[^)]*\\)"
PICTURES = "(?:black and white |colou?r |aerial |stereoscopic )?(?:photographs|photos|images)"
ARTS = "(?:paintings|drawings|engravings|etchings|lithographs|prints|watercolou?rs|postcards|maps)"

# Category rules in order: pattern, kind, precision, confidence, flags.
CATEGORY_RULES = (
    ("photographs taken on (\\d{4})-(\\d{2})-(\\d{2})", "ymd", "day", 0.8, ()),
    (f"^(\\d{{4}}) {PICTURES}\\b", "year", "year", 0.75, ()),
    (f"^(\\d{{3}}0)s {PICTURES}\\b", "decade", "decade", 0.55, ()),
    ("^(\\d{4}) postcards\\b", "year", "year", 0.55, ("publication",)),
    (f"^(\\d{{4}}) {ARTS}\\b", "year", "year", 0.7, ("artwork",)),
    (f"^(\\d{{3}}0)s {ARTS}\\b", "decade", "decade", 0.5, ("artwork",)),
    (f"\\bin ({MONTH_NAME}) (\\d{{4}})$", "month", "month", 0.65, ()),
    ("\\b(?:in|im|en) (\\d{4})$", "year", "year", 0.6, ()),
    ("^(\\d{4}) (?:in|im|en)\\b", "year", "year", 0.6, ()),
    ("\\bwiki loves monuments (\\d{4})", "year", "year", 0.5, ("contest",)),
    ("\\bin the (\\d{3}0)s\\b", "decade", "decade", 0.45, ("depicted_era",)),
    ("^(\\d{3}0)s (?:in|im|en)\\b", "decade", "decade", 0.45, ("depicted_era",)),
    ("\\bin the (\\d{1,2})(?:st|nd|rd|th) century\\b", "century", "century", 0.3, ("depicted_era",)),
    ("\\bbefore (\\d{4})\\b", "before", "bound", 0.35, ("open_start",)),
    ("\\bafter (\\d{4})\\b", "after", "bound", 0.35, ("open_end",)),
    ("\\b(\\d{4}) ?[-–] ?(\\d{4})\\b", "span", "range", 0.35, ("span",)),
)

# Title patterns.
EXTENSION = "(?i)\\.[a-z0-9]{2,5}$"
TITLE_NOISE = "(?iU)\\(\\d{6,}\\)|\\b(?:img|dsc|dscn|dscf|p|pict|photo|scan)[_ -]?\\d+\\b|\\d{5,}"
TITLE_DAY = "(?<!\\d)((?:18|19|20)\\d\\d)[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\\d|3[01])(?!\\d)"
TITLE_CIRCA = "(?iU)\\b(?:um|circa|ca\\.?|c\\.|vers|around|anno)\\s*((?:18|19|20)\\d\\d)(?!\\d)"
TITLE_YEAR = "(?<![\\d.])((?:18|19|20)\\d\\d)(?![\\d])"

# Medium vocabularies in order of precedence, and colour and age hints.
MEDIA = (
    ("plan", "\\bmaps?\\b|\\bfloor ?plans?\\b|\\bplans? of\\b|grundriss|\\belevations?\\b|"
             "cross[- ]sections?|blueprints?|architectural drawings?"),
    ("painting", "\\bpaintings?\\b|oil on (?:canvas|panel|wood)|gemälde|\\bpeintures?\\b|"
                 "watercolou?rs?|aquarell|gouache|tempera|\\bfrescos?\\b"),
    ("print", "engravings?|etchings?|lithograph|woodcuts?|aquatints?|mezzotints?|"
              "stahlstich|kupferstich|holzstich|radierung|gravures?|chromolitho"),
    ("drawing", "\\bdrawings?\\b|\\bsketch(?:es)?\\b|\\bdessins?\\b|zeichnung"),
    ("postcard", "postcards?|cartes? postales?|postkarten?|ansichtskarten?"),
    ("photo", "photograph|\\bphotos?\\b|albumen|glass plate|\\bnegatives?\\b|daguerreotyp|"
              "ambrotyp|tintyp|autochrom|photochrom|stereo|gelatin silver|lantern slides?|"
              "cyanotyp|fotografie|\\bfotos?\\b"),
    ("artwork", "\\bin art\\b|\\bartworks?\\b"),
)
PHOTOGRAPHIC = ("photo", "postcard")
BLACK_AND_WHITE = (
    "(?iU)black[- ]and[- ]white|\\bb&w\\b|monochrome|gr[ae]yscale|\\bsepia\\b|schwarz-?wei|noir et blanc|"
    "blanco y negro"
)
COLOUR = (
    "(?iU)colou?r photographs|hand-colou?red|colou?ri[sz]ed|autochrom|photochrom|kodachrome|"
    "ektachrome|chromolitho"
)
HISTORICAL = (
    "(?iU)historical (?:images|photographs|pictures|views)|history of|old (?:photographs|postcards)|"
    "\\bvintage\\b|before 1[89]\\d\\d|in the 1[89]\\d0s|1[89]th century|bundesarchiv|"
    "nationaal archief|library of congress|fortepan|deutsche fotothek|rijksmuseum|gallica|"
    "europeana|author died more than|pd-old|pd-us-expired|published before 19"
)


def _tag(exif: Column, name: str) -> Column:
    return F.coalesce(F.element_at(exif, name), F.lit(""))


def device(exif: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[_tag(exif, n) for n in ("Make", "Model", "Software")]))


def parse_exif(exif: Column) -> Column:
    """The candidate of an EXIF map; null where it has no real date."""
    own, scanned = _tag(exif, "DateTimeOriginal"), _tag(exif, "DateTimeDigitized")
    facts = F.struct(
        F.when(own != "", own).otherwise(scanned).alias("raw"),
        (own == "").alias("digitized"),
        device(exif).alias("device"),
        ((_tag(exif, "Make") != "") | (_tag(exif, "Model") != "")).alias("camera"),
    )

    def decide(x: Column) -> Column:
        raw = F.trim(x["raw"])
        date = F.struct(*[number(raw, EXIF_DATE, n).alias(k) for n, k in ((1, "y"), (2, "m"), (3, "d"))])
        return let(date, lambda t: judge(x, t["y"], t["m"], t["d"]))

    def judge(x: Column, year: Column, month: Column, day: Column) -> Column:
        first = (month == 1) & (day == 1)
        early, scanner = year < FIRST_DIGITAL_YEAR, x["device"].rlike(REPRODUCTION)
        flags = F.concat(
            flag(x["digitized"], "digitized"), flag(scanner, "scanner"),
            flag(first, "placeholder"), flag(early, "pre_digital"),
        )
        sure = (
            F.when(first | early | x["digitized"], LOW)
            .when(scanner, MEDIUM)
            .when(x["camera"], VERY_HIGH)
            .otherwise(MEDIUM)
        )
        evidence = F.concat(x["raw"], F.lit(" ["), x["device"], F.lit("]"))
        return candidate(from_day(year, month, day), "exif", "day", sure, evidence, flags)

    return let(facts, decide)


def is_maintenance(category: Column) -> Column:
    return F.replace(category, F.lit("_"), F.lit(" ")).rlike(MAINTENANCE)


def content_categories(categories: Column) -> Column:
    return F.filter(categories, lambda c: ~is_maintenance(c))


def _category_interval(kind: str, name: Column, p: str, max_year: int) -> Column:
    part = lambda n: number(name, p, n)
    if kind == "ymd":
        return from_day(part(1), part(2), part(3))
    if kind == "month":
        return from_month(part(2), month_number(F.lower(F.regexp_extract(name, p, 1))))
    if kind == "span":
        return from_years(part(1), part(2))
    shape = {
        "year": lambda a: from_years(a, a),
        "decade": lambda a: from_years(a, a + 9),
        "century": lambda a: from_years(100 * (a - 1) + 1, 100 * a),
        "before": lambda a: interval(F.lit(MIN_YEAR), a),
        "after": lambda a: interval(a, F.lit(max_year + 1)),
    }[kind]
    return let(part(1), shape)


def parse_category(
    category: Column, source: Column | str = "category", scale: Column | float = 1.0, max_year: int = THIS_YEAR
) -> Column:
    """The candidate of one category; the first rule that matches decides, even against it."""

    def rules(name: Column) -> Column:
        found = F.lit(None)
        for pattern, kind, precision, sure, flags in reversed(CATEGORY_RULES):
            p = "(?iU)" + pattern
            made = reading(_category_interval(kind, name, p, max_year), precision, sure, strings(*flags))
            found = F.when(name.rlike(p), made).otherwise(found)
        return let(found, sane)

    def sane(r: Column) -> Column:
        inside = (r["i"]["lo"] >= MIN_YEAR) & (r["i"]["hi"] <= max_year + 1)
        return candidate(
            F.when(inside, r["i"]), source, r["precision"], F.round(r["confidence"] * scale, 3), category, r["flags"]
        )

    spaced = F.trim(F.replace(category, F.lit("_"), F.lit(" ")))
    clean = lambda s: F.when(~s.rlike(EXCLUDED), F.trim(F.regexp_replace(s, YEAR_IN_PARENTHESES, " ")))
    return let(let(spaced, clean), lambda n: F.when(n.rlike("\\d"), rules(n)))


def parse_categories(named: Column, max_year: int = THIS_YEAR) -> Column:
    """Candidates of an array of struct(name, source, scale), in order."""
    return F.filter(
        F.transform(named, lambda c: parse_category(c["name"], c["source"], c["scale"], max_year)),
        lambda x: x.isNotNull(),
    )


def named_categories(categories: Column, source: str = "category", scale: float = 1.0) -> Column:
    return F.transform(
        categories, lambda c: F.struct(c.alias("name"), F.lit(source).alias("source"), F.lit(scale).alias("scale"))
    )


def parse_title(title: Column, max_year: int = THIS_YEAR) -> Column:
    """The candidate of a file title; null where nothing is clear."""

    def rules(stem: Column) -> Column:
        part = lambda n: number(stem, TITLE_DAY, n)
        about = lambda y: F.when(
            y.between(FIRST_PHOTO_YEAR, max_year), from_years(y - CIRCA_YEARS, y + CIRCA_YEARS)
        )
        years = F.array_distinct(
            F.filter(
                F.transform(
                    F.regexp_extract_all(F.regexp_replace(stem, TITLE_NOISE, " "), F.lit(TITLE_YEAR)),
                    lambda v: v.try_cast("int"),
                ),
                lambda v: v.between(FIRST_PHOTO_YEAR, max_year),
            )
        )
        only = let(years, lambda v: F.when(F.size(v) == 1, from_years(F.get(v, F.lit(0)), F.get(v, F.lit(0)))))
        return first_reading(
            "title",
            title,
            reading(F.when(part(1) <= max_year, from_day(part(1), part(2), part(3))), "day", LOW, strings()),
            reading(let(number(stem, TITLE_CIRCA), about), "year", LOW, strings("circa")),
            reading(only, "year", VERY_LOW, strings()),
        )

    return let(F.replace(F.regexp_replace(title, EXTENSION, ""), F.lit("_"), F.lit(" ")), rules)


def classify_medium(categories: Column, title: Column, object_name: Column, exif: Column, licence: Column, credit: Column) -> Column:
    """struct(medium, evidence, color, historical_hint) from metadata alone."""
    said = lambda *parts: F.array_join(
        F.filter(F.concat(*parts), lambda s: s.isNotNull() & (s != "")), " | "
    )
    text = said(content_categories(categories), F.array(title, object_name))
    whole = F.array_join(F.concat(categories, F.array(title, licence, credit)), " | ", "")
    camera = (_tag(exif, "Make") != "") | (_tag(exif, "Model") != "")

    kind = lambda medium, evidence: F.struct(F.lit(medium).alias("medium"), evidence.alias("evidence"))

    def found(t: Column) -> Column:
        """The first vocabulary that matches, and what it matched."""
        other = F.when(camera, kind("photo", F.lit("exif camera"))).otherwise(kind("unknown", F.lit("")))
        return reduce(
            lambda rest, rule: F.when(
                t.rlike("(?iU)" + rule[1]), kind(rule[0], F.regexp_extract(t, "(?iU)" + rule[1], 0))
            ).otherwise(rest),
            reversed(MEDIA),
            other,
        )

    def decide(t: Column) -> Column:
        colour = F.when(t.rlike(BLACK_AND_WHITE), "bw").when(t.rlike(COLOUR), "color").otherwise("unknown")
        return let(
            found(t),
            lambda k: F.struct(
                k["medium"].alias("medium"), k["evidence"].alias("evidence"), colour.alias("color"),
                whole.rlike(HISTORICAL).alias("historical_hint"),
            ),
        )

    return let(text, decide)
