import time

from pyspark.sql import functions as F

from leafwise.functions import text as t

SPACES = "\t\x0b\x1c\x1f \x85\xa0    　"


def test_white_space_is_stripped_from_the_ends_only(column):
    values = [SPACES + "a" + SPACES + "b" + SPACES, SPACES, "", "​x᠎", None]
    assert column(t.strip_ws, values) == ["a" + SPACES + "b", "", "", "​x᠎", None]


def test_spaces_are_those_of_the_pattern(spark):
    every = spark.range(0x10000).filter("id NOT BETWEEN 55296 AND 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    found = {r["id"] for r in every.filter(F.col("c").rlike(rf"^[{t.WS}]\z")).collect()}
    assert found == set(map(ord, t.SPACES))


def test_long_lines_of_white_space_are_parsed_in_linear_time(column):
    """A search for the end of white space from each of its places takes a time that grows with its square."""
    line = "a" + " " * 150_000 + "b"
    began = time.monotonic()
    assert column(t.strip_ws, [line]) == [line]
    assert column(t.extract_headings, ["PIERS\n" + line]) == [["PIERS"]]
    assert time.monotonic() - began < 10


def test_keywords_are_whole_words(column):
    values = ["xbackground", "a background", "1background", "background_", "é-background", "éoverview", "Overview"]
    assert column(t.background, values) == [None, "background", None, None, "background", None, "Overview"]
