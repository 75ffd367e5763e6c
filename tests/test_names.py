import pytest
from pyspark.sql import functions as F

from fixed_vectors import NAMES
from titleloom.functions.names import clean_title, with_file_episode, with_parsed_name

def test_parse_names(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(NAMES)], "i int, name string")
    got = {r.i: r for r in with_parsed_name(df, "name").collect()}
    for i, (name, *want) in enumerate(NAMES):
        parsed = got[i].parsed
        have = [None] * 5 if parsed is None else list(parsed)
        assert have == want, name


@pytest.mark.parametrize(
    "raw,want",
    [
        ("  -The Matrix- ", "The Matrix"),
        ("The Matrix 1999", "The Matrix"),
        ("2001 A Space Odyssey", "2001 A Space Odyssey"),
        ("The - 1999", "The -"),
        ("The ( 1999", "The ("),
        ("1999", "1999"),
        (" 1999", "1999"),
        ("a 1999 2001", "a 1999"),
        ("é", "é"),  # two bytes
        ("X", None),
        ("", None),
        (" ()[] ", None),
    ],
)
def test_clean_title(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(clean_title(F.col("t"))).first()[0] == want


FILES = [
    ("Breaking.Bad.S05E01.720p.mkv", 5, (5, 1), (5, 1)),
    ("Season 1/Breaking.Bad.S01E03.720p.mkv", 9, (1, 3), (1, 3)),
    ("E05.mkv", 2, (2, 5), (2, 5)),
    ("Show.Name.E12.720p.mkv", 3, (3, 12), (3, 12)),
    ("random.mkv", 1, None, None),
    ("The.Matrix.1999.1080p.BluRay.mkv", 1, None, None),
    ("S01E01.mkv", 1, (1, 1), None),
    ("Show S03/extra.mkv", 3, None, None),
    ("e7", 4, (4, 7), (4, 7)),
]


@pytest.mark.parametrize("strict", [False, True])
def test_file_episode(spark, strict):
    df = spark.createDataFrame([(f[0], f[1]) for f in FILES], "path string, season int")
    out = with_file_episode(df, "path", "season", "fe", strict=strict)
    got = {r.path: None if r.fe is None else tuple(r.fe) for r in out.collect()}
    assert got == {f[0]: f[3] if strict else f[2] for f in FILES}


def test_file_title_falls_back_to_parent(spark):
    df = spark.createDataFrame(
        [("E01.mkv", 7, "Parent"), ("Own.Show.S02E03.mkv", 7, "Parent")],
        "path string, season int, parent string",
    )
    out = with_file_episode(df, "path", "season", "fe", strict=True, parent_title="parent")
    got = {r.path: tuple(r.fe) for r in out.collect()}
    assert got == {"E01.mkv": ("Parent", 7, 1), "Own.Show.S02E03.mkv": ("Own Show", 2, 3)}
