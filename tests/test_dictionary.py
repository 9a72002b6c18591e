"""Dating by the dictionary of distinct strings against dating each row where it is."""

from pyspark.sql import functions as F

from tempora.dating import dictionary, resolve
from tempora.dating.candidate import CANDIDATE
from tempora.functions.interval import THIS_YEAR

META = (
    "scene_id int, file_key string, title string, date_text string, date_qs string, date_source string, exif map<string,string>, "
    "categories array<string>, subcats array<string>, object_name string, license string, credit string, upload_time string, "
    "artist_born int, artist_died int"
)
TEXTS = ["1900", "circa 1900", "before 1870", "", None, "12 May 1931", "2 June 2015", "no date", "1900"]
QS = [None, "P571,+1880-00-00T00:00:00Z/9", "", "P571,+1931-05-12T00:00:00Z/11", "nonsense"]
CATEGORIES = [[], ["1890s photographs"], ["Harbour in 1931", "1931 postcards"], ["Harbour in 1931"], None, ["Maps of X", "", "Harbour in 1931"]]
TITLES = ["View 1912.jpg", "Mill um 1905.png", "IMG_2041.jpg", None, "View 1912.jpg"]
EXIF = [{}, {"DateTimeOriginal": "2015:06:02 10:00:00", "Make": "Canon"}, None, {"DateTimeDigitized": "2004:01:01"}]


def meta(spark, n, start=0):
    pick = lambda options, i, step: options[(i * step) % len(options)]
    rows = [
        (i % 3, f"f{i}", pick(TITLES, i, 1), pick(TEXTS, i, 1), pick(QS, i, 3), ("commons-desc-page", "other", None)[i % 3 if i % 4 else 0],
         pick(EXIF, i, 7) if pick(EXIF, i, 7) is not None else {}, pick(CATEGORIES, i, 5) or [], [None, ["Harbour_in_1931", "1870s in X"]][i % 2], "", "", "",
         "2016-01-01T00:00:00Z", [None, 1850][i % 2], [None, 1920][i % 2])
        for i in range(start, start + n)
    ]
    return spark.createDataFrame(rows, META)


def inline(df):
    """What each row says, parsed where it is."""
    return {r.file_key: r.c for r in df.select("file_key", resolve.gather_candidates().alias("c")).collect()}


def test_candidates_equal_those_parsed_in_place(spark):
    df = meta(spark, 400)
    rows = df.select("file_key", resolve.parse_exif(F.col("exif")).alias("exif"), dictionary.evidence().alias("evidence"), F.monotonically_increasing_id().alias("row"))
    rows = rows.cache()
    entries = dictionary.Dictionary(spark).extended(rows.select(F.explode("evidence").alias("e")).select("e.kind", "e.value"))
    got = {r.file_key: r.candidates for r in dictionary.with_candidates(rows, entries).collect()}
    assert got == inline(df)
    assert any(len(c) > 3 for c in got.values()) and any(not c for c in got.values())


def test_each_string_is_parsed_once_and_later_batches_add_what_is_new(spark, tmp_path, monkeypatch):
    """Entries are the distinct strings, whatever the number of rows; a second batch parses only its new ones."""
    parsed = []
    monkeypatch.setattr(dictionary, "parsed", lambda values, year, f=dictionary.parsed: parsed.append(sorted(map(tuple, values.collect()))) or f(values, year))
    path = str(tmp_path / "dictionary")
    first = resolve.date_images(meta(spark, 600), dictionary=path).collect()
    strings = {(e.kind, e.value) for r in meta(spark, 600).select(dictionary.evidence().alias("e")).collect() for e in r.e}
    assert set(parsed[0]) == strings and len(parsed[0]) == len(strings) < 40
    more = meta(spark, 600).unionByName(meta(spark, 1, 7).withColumn("file_key", F.lit("new")).withColumn("date_text", F.lit("1777")).withColumn("date_source", F.lit("commons-desc-page")))
    second = resolve.date_images(more, dictionary=path).collect()
    assert parsed[1] == [("text", "1777")]
    entries = dictionary.Dictionary(spark, path).entries().collect()
    assert len(entries) == len({(e.kind, e.value) for e in entries}) == len(strings) + 1
    assert sorted(map(str, first)) == sorted(str(r) for r in second if r.file_key != "new")
    assert dictionary.Dictionary(spark, path, THIS_YEAR - 1).entries().count() == 0


def test_no_rows_and_no_evidence(spark):
    assert resolve.date_images(meta(spark, 5).limit(0)).count() == 0
    bare = spark.createDataFrame([(1, "a", None, None, None, None, {}, [], None, None, None, None, None, None, None)], META)
    row = resolve.date_images(bare).first()
    assert row.date_lo is None and row.n_candidates == 0
    assert dictionary.parsed(spark.createDataFrame([], "kind string, value string")).schema["found"].dataType.simpleString() == CANDIDATE
