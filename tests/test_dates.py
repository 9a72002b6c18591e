"""Parsers and resolver against literal expectations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tempora.dating import evidence, years
from tempora.dating.qs import parse_qs
from tempora.dating.resolve import resolve
from tempora.dating.text import parse_date_text

LAST = 2025


def dec(d):
    start = dt.date(d.year, 1, 1)
    return d.year + (d - start).days / (dt.date(d.year + 1, 1, 1) - start).days


def Y(a, b=None):
    return (float(a), float((b or a) + 1))


def D(y, m, d):
    day = dt.date(y, m, d)
    return (dec(day), dec(day + dt.timedelta(days=1)))


def M(y, m):
    return (dec(dt.date(y, m, 1)), dec(dt.date(y + m // 12, m % 12 + 1, 1)))


def run(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r.c for r in df.select("i", column(F.col("s")).alias("c")).orderBy("i").collect()]


def expect(got, want):
    if want is None:
        assert got is None
        return
    (lo, hi), precision, *flag = want
    assert (got.lo, got.hi) == pytest.approx((lo, hi), abs=1e-9)
    assert got.precision == precision
    assert all(f in got.flags for f in flag)


# One case for each rule and each boundary of it, made up for this library.
QS = {
    "P571,+1873-00-00T00:00:00Z/9,P1480,Q5727902": (Y(1868, 1878), "year", "circa"),
    "P,+1740-00-00T00:00:00Z/7,P1319,+1711-00-00T00:00:00Z/9,P1326,+1768-00-00T00:00:00Z/9": (Y(1711, 1768), "range"),
    "P,+1687-00-00T00:00:00Z/8": (Y(1680, 1689), "decade"),
    "P,+1701-00-00T00:00:00Z/7": (Y(1701, 1800), "century"),
    "P,+1700-00-00T00:00:00Z/7": (Y(1601, 1700), "century"),
    "P571,+1908-02-29T00:00:00Z/11": (D(1908, 2, 29), "day"),
    "P571,+1997-12-00T00:00:00Z/10": (M(1997, 12), "month"),
    "P,+1777-00-00T00:00:00Z/7,P1326,+1777-00-00T00:00:00Z/9": ((1000, 1778), "bound", "open_start"),
    "P,+1666-00-00T00:00:00Z/7,P1319,+1666-00-00T00:00:00Z/9": ((1666, LAST + 1), "bound", "open_end"),
    "P571,+1812-00-00T00:00:00Z/10": (Y(1812), "year"),
    "P571,+1909-02-29T00:00:00Z/11": (Y(1909), "year"),
    "P1480,Q5727902": None,
    "nothing of the kind": None,
    "P571,-0044-03-15T00:00:00Z/11": None,
}
TEXT = {
    "1764": (Y(1764), "year"),
    "1911/1912": (Y(1911, 1912), "range"),
    "between 1720 and 1735": (Y(1720, 1735), "range"),
    "1988-10-03 17:45": (D(1988, 10, 3), "day"),
    "Seen on 29 February 1968, 06:30": (D(1968, 2, 29), "day"),
    "October 1956": (M(1956, 10), "month"),
    "february 1871": (M(1871, 2), "month"),
    "17 Dezember 1893": (D(1893, 12, 17), "day"),
    "3 juillet 1954": (D(1954, 7, 3), "day"),
    "circa 1844": (Y(1839, 1849), "year", "circa"),
    "um 1770": (Y(1765, 1775), "year", "circa"),
    "1780s": (Y(1780, 1789), "decade"),
    "16th century": (Y(1501, 1600), "century"),
    "before 4 August 1914": ((1000, 1915), "bound", "open_start"),
    "after 1648": ((1648, LAST + 1), "bound", "open_end"),
    "30 February 1990": (M(1990, 2), "month"),
    "1822; 1807": (Y(1807, 1822), "range", "multiple_years"),
    "1999-01-31 (original upload date)": (D(1999, 1, 31), "day", "upload_date"),
    "no year is known": None,
    " ": None,
    None: None,
}
CATEGORY = {
    "1911 photographs of Lisbon": (Y(1911), "year"),
    "1854 in Vienna": (Y(1854), "year"),
    "Old Bridge of Mostar in 1992": (Y(1992), "year"),
    "Lisbon photographs taken on 2008-02-29": (D(2008, 2, 29), "day"),
    "Charles Bridge in August 1968": (M(1968, 8), "month"),
    "Vienna in the 1870s": (Y(1870, 1879), "decade", "depicted_era"),
    "Campanile_Venice_(before_1902)": ((1000, 1902), "bound", "open_start"),
    "1912 postcards of Lisbon": (Y(1912), "year", "publication"),
    "Vasa (ship, 1627)": None,
    "Crystal Palace (1851 building)": None,
    "Bridges inaugurated in 1883": None,
    "Created with a camera of 1999": None,
    "Files from a collection in 1988": None,
    "Interior of the Campanile, Venice": None,
    "Lisbon photographs taken on 2009-02-29": None,
}
TITLE = {
    "Campanile um 1882.jpg": (Y(1877, 1887), "year", "circa"),
    "1999-12-31 Lisbon 17.jpg": (D(1999, 12, 31), "day"),
    "18990110_Campanile (Venice).-003.tif": (D(1899, 1, 10), "day"),
    "Lisbon Rossio 1911.png": (Y(1911), "year"),
    "Heron at dusk, Mekong delta (19871203365).jpg": None,
    "DSCN1987.JPG": None,
    "Vienna 1873 and 1902 side by side.jpg": None,
}


@pytest.mark.parametrize(
    "parser, cases",
    [
        (lambda s: parse_qs(s, LAST), QS),
        (lambda s: parse_date_text(s, max_year=LAST), TEXT),
        (lambda s: evidence.parse_category(s, max_year=LAST), CATEGORY),
        (lambda s: evidence.parse_title(s, LAST), TITLE),
    ],
    ids=["qs", "text", "category", "title"],
)
def test_parser(spark, parser, cases):
    for got, (text, want) in zip(run(spark, parser, list(cases)), cases.items(), strict=True):
        try:
            expect(got, want)
        except AssertionError as error:
            raise AssertionError(f"{text!r}: {got}") from error


def test_exif(spark):
    cases = [
        ({"DateTimeOriginal": "2009:08:21 06:05:04", "Make": "Leica", "Model": "M8"}, (D(2009, 8, 21), "day"), 0.95),
        ({"DateTimeOriginal": "2014-03-30 23:59:59", "Make": "Plustek", "Model": "OpticFilm"}, (D(2014, 3, 30), "day", "scanner"), 0.6),
        ({"DateTimeOriginal": "2001:01:01 00:00:00", "Make": "Imacon"}, (D(2001, 1, 1), "day", "scanner", "placeholder"), 0.35),
        ({"DateTimeDigitized": "2016:02:29 08:00:00", "Software": "darkroom"}, (D(2016, 2, 29), "day", "digitized"), 0.35),
        ({"DateTimeOriginal": "1989:12:31 23:00:00"}, (D(1989, 12, 31), "day", "pre_digital"), 0.35),
        ({"DateTimeOriginal": "1999:00:10 00:00:00"}, None, None),
        ({"Make": "Leica"}, None, None),
    ]
    got = run(spark, evidence.parse_exif, [c[0] for c in cases], "map<string,string>")
    for g, (_, want, sure) in zip(got, cases, strict=True):
        expect(g, want)
        assert g is None or g.confidence == sure


def test_maintenance_categories(spark):
    names = ["Media lacking a description", "PD-old-70", "Quality images of Vienna", "Licensed victuallers", "Bridges of Mostar", "Etchings of Venice"]
    assert run(spark, evidence.is_maintenance, names) == [True, True, True, True, False, False]


CAND = "array<struct<lo:double,hi:double,source:string,precision:string,confidence:double,evidence:string,flags:array<string>>>"


def c(interval, source, confidence, precision="year", *flags):
    return (*map(float, interval), source, precision, confidence, "test", list(flags))


RESOLVE = {
    "agree": dict(
        cs=[c(D(1998, 3, 2), "date_text", 0.85, "day"), c(D(1998, 3, 1), "exif", 0.95, "day")], up="2003-05-01T00:00:00Z",
        has=["exif_agrees"], no=["needs_review"], least=0.95,
    ),
    "conflict": dict(
        cs=[c(Y(2017), "date_text", 0.85), c(D(2009, 9, 9), "exif", 0.95, "day")], up="2018-01-01T00:00:00Z",
        has=["needs_review", "conflict:date_text"], most=0.85, confidence=0.57,
    ),
    "upload": dict(
        cs=[c(D(2012, 12, 1), "date_text", 0.85, "day"), c(Y(1880, 1889), "category", 0.45, "decade")],
        up="2012-12-01T01:02:03Z", hint=True, interval=Y(1880, 1889), has=["date_is_upload_date"],
    ),
    "modern": dict(
        cs=[c(D(2016, 2, 29), "date_text", 0.85, "day"), c(D(2016, 2, 29), "exif", 0.95, "day")],
        up="2016-02-29T09:00:00Z", interval=D(2016, 2, 29), no=["date_is_upload_date"],
    ),
    "scan": dict(
        cs=[c(Y(1866), "date_text", 0.85), c(D(2004, 11, 30), "exif", 0.95, "day")], up="2011-01-01T00:00:00Z",
        interval=Y(1866), digitized=D(2004, 11, 30),
    ),
    "impossible": dict(
        cs=[c(Y(2019), "title", 0.2), c(Y(2007), "category", 0.6)], up="2013-04-01T00:00:00Z", interval=Y(2007),
        has=["impossible:title"],
    ),
    "bound": dict(
        cs=[c(Y(1900, 1909), "category", 0.45, "decade"), c((1000, 1902), "category", 0.35, "bound", "open_start")],
        floor=1826.0, interval=(1900, 1902), has=["narrowed_by:category"],
    ),
    "artwork": dict(
        cs=[c(D(2014, 5, 5), "exif", 0.6, "day"), c(Y(1870, 1879), "category", 0.45, "decade")], artwork=True,
        interval=Y(1870, 1879), has=["exif_is_digitization"],
    ),
    "explicit upload text": dict(
        cs=[c(D(2006, 7, 7), "date_text", 0.85, "day", "upload_date"), c(Y(2003), "category", 0.6)], up="2006-07-08T00:00:00Z",
        interval=Y(2003), has=["dropped_upload_date_text"],
    ),
    "nothing": dict(cs=[], interval=None, confidence=0.0),
    "weak": dict(
        cs=[c(Y(1873), "date_text", 0.85), c(Y(1931), "title", 0.35)], interval=Y(1873), has=["weak_conflict:title"], confidence=0.85,
    ),
}


def test_resolver(spark):
    rows = [
        (n, x["cs"], x.get("up"), x.get("hint", False), x.get("floor"), None, x.get("artwork", False)) for n, x in RESOLVE.items()
    ]
    schema = f"name string, candidates {CAND}, upload_time string, historical_hint boolean, floor_year double, ceiling_year double, artwork boolean"
    for r in resolve(spark.createDataFrame(rows, schema)).collect():
        want, got = RESOLVE[r.name], r.result
        if "interval" in want:
            if want["interval"] is None:
                assert got.interval is None, r.name
            else:
                assert tuple(got.interval) == pytest.approx(want["interval"]), r.name
        assert all(f in got.flags for f in want.get("has", [])), (r.name, got)
        assert not any(f in got.flags for f in want.get("no", [])), r.name
        assert got.confidence >= want.get("least", 0) and got.confidence <= want.get("most", 1), r.name
        assert "confidence" not in want or got.confidence == pytest.approx(want["confidence"]), r.name
        if "digitized" in want:
            assert tuple(got.digitized) == pytest.approx(want["digitized"])


FREE = {
    "Campanile Venice 1902-07-14.jpg": (1902, 1902),
    "Sketched on 14 July 1902": (1902, 1902),
    "Made in October 1888": (1888, 1888),
    "Restoration 1903-1912": (1903, 1912),
    "Harbour at night, c. 1875": (1870, 1880),
    "Market square 1930's": (1930, 1939),
    "early 1880s": (1880, 1883),
    "mid 1880s": (1883, 1886),
    "late 1880s": (1886, 1889),
    "18th century map": (1700, 1799),
    "early 18th century map": (1700, 1733),
    "The quay as it was in 1966": (1966, 1966),
    "Harbour_at_night_1966.jpg": (1966, 1966),
    "1741 date QS:P,+1300-00-00T00:00:00Z/6": (1741, 1741),
    "Box 4120": None,
    "IMG_19990415777.jpg": None,
    "": None,
}
FIELD = {
    "1797": (1797, 0.9),
    "photo 1841; reprint 1846": (1841, 0.8),
    "October–December 1917": (1917, 0.9),
    "2 May 2013 (original upload date)": (2013, 0.38),
    "1719-11-23 05:06:07": (1719, 0.19),
    "1968-08-21": (1968, 0.95),
    '"1908"': (1908, 0.9),
    "   ": None,
}


def test_year_engine(spark):
    for got, (text, want) in zip(run(spark, lambda s: years.parse_text(s, "filename"), list(FREE)), FREE.items(), strict=True):
        assert (got and (got.start, got.end)) == want, text
    for got, (text, want) in zip(run(spark, years.parse_field, list(FIELD)), FIELD.items(), strict=True):
        assert (got and (got.start, got.confidence)) == want, text
    exif = run(spark, years.parse_exif_time, ["2006:02:28 07:08:09", "never", ""])
    assert (exif[0].start, exif[0].source, exif[0].confidence) == (2006, "exif", 0.665) and exif[1:] == [None, None]


def test_products_are_rounded_as_in_python(spark):
    got = run(spark, lambda s: years.parse_text(s, "filename"), ["1902-07-14"])
    assert got[0].confidence == 0.807


def test_best_keeps_the_first_of_ties(spark):
    df = spark.createDataFrame([(1,)], "x int")
    e = lambda a, b, s, n: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("confidence"), F.lit(n).alias("source"))
    picked = df.select(years.best(F.array(e(1900, 1910, 0.5, "a"), e(1900, 1900, 0.5, "b"), e(1901, 1901, 0.5, "c"))).alias("e")).first().e
    assert picked.source == "b"
