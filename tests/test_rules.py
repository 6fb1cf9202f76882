"""Hand-worked cases of the normalisation rules."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import rules as N, text as T
from quern.operators import merge as M


def answers(spark, f, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    return [r.a for r in df.select("i", f(F.col("t")).alias("a")).orderBy("i").collect()]


def test_country_names_are_whole_words(spark):
    cases = {
        "Nyeri growing region, south-central Kenya": "Kenya", "United States (Hawaii)": "United States", "Tanzania, United Republic Of": "Tanzania",
        "Sumatra, Indonesia": "Indonesia", "Ethiopia; Colombia": "Ethiopia", "에티오피아 예가체프": "Ethiopia", "Cote d?Ivoire": "Côte d'Ivoire", "somewhere": None, None: None,
        "romania": None, "javanese": None, "인도네시아산": "Indonesia", "인도산": "India", "x인도; Peru": "India", "GUJI": "Ethiopia", "Papua New Guinea": "Papua New Guinea",
    }
    assert answers(spark, N.country, cases) == list(cases.values())


def test_a_dictionary_word_has_no_letter_beside_it(spark):
    f = lambda t: T.leftmost_entry(t, {"oman": "Oman", "man": "Man"}, {"가": "ga"})
    assert answers(spark, f, ["romania", "x OMAN", "a man, oman", "b가man", "oman가", None, ""]) == [None, "Oman", "Man", "ga", "Oman", None, None]


def test_altitudes_have_four_digits_and_metres(spark):
    cases = {
        "1,900m": 1900, "1800-2000 masl": 1900, "해발 1,600~2,000m": 1800, "고도 1950m": 1950, "a 500 m run": None, "1900미터": 1900, "1900 feet": None,
        "12,500 m": None, "1001-1002 m": 1002, "1000–1001m": 1000, "at 1900 metres": None, None: None, "": None,
    }
    assert answers(spark, N.altitude_in_prose, cases) == list(cases.values())


def test_the_first_of_repeated_facts_stays(spark):
    cases = [
        ("origin: Kenya\nregion: Nyeri", {"country": "Kenya"}), ("Process\nNatural\nAltitude 1800 m", {"process": "Natural", "altitude": "1800 m"}),
        ("Varietal\n: Gesha\nvariety: x", {"variety": "Gesha"}), ("Roast level: dark\n  ELEVATION:1,200", {"roast": "dark", "altitude": "1,200"}),
        ("Originally from Kenya", {}), ("the origin: Kenya", {}), ("Processing method: washed", {"process": "washed"}), (None, None), ("", {}),
    ]
    assert answers(spark, N.labelled_facts, [t for t, _ in cases]) == [f for _, f in cases]


@pytest.mark.parametrize(
    "text,level",
    [
        ("Dark chocolate, medium roast", "medium"), ("dark brown sugar", None), ("light-bodied", None), ("French press", None), ("다크 초콜릿, 강배전", "dark"),
        ("Full City dark", "dark"), ("notes: light citrus | roast: medium-dark roast", "medium-dark"), ("풀바디 라이트 로스트", "light"), ("light stone fruits", None),
    ],
)
def test_roasts(spark, text, level):
    assert answers(spark, N.roast, [text]) == [level]


def test_row_hashes_tell_rows_apart(spark):
    rows = [("x|b=1", "y"), ("x", "1|b=y"), ("x", None), ("x", "~"), (None, "x"), ("", None), (None, ""), (None, None), ("1:x", ""), ("", "1:x"), ("2:ab", "c"), ("é", "1")]
    df = spark.createDataFrame(rows, "a string, b string")
    hashes = [r.h for r in df.select(M.row_hash(["b", "a"]).alias("h")).collect()]
    assert len(set(hashes)) == len(rows)
    again = [r.h for r in df.select("b", "a").select(M.row_hash(["a", "b"]).alias("h")).collect()]
    assert again == hashes


def test_roasts_are_read_once_and_only_where_a_roast_word_stands(spark):
    """The masked text is named once in the plan, and phrases from the parts are those of the whole text."""
    rng = random.Random(4)
    word = lambda: rng.choice(["light", "Dark", "medium", "roast", "roasted", "로스팅", "a-b", "x", "dark-", "Blonde", "\n", "."])
    texts = ["".join(word() + rng.choice([" ", " - ", ", ", ":", "|", "/", ";", ""]) for _ in range(rng.randrange(0, 30))) for _ in range(400)] + [None, "", "light roast"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    plain = F.array_join(F.regexp_extract_all("t", F.lit(f"{N.ANY}({N.ROAST_PHRASE})"), F.lit(1)), " ; ")
    assert df.where(~plain.eqNullSafe(N._roast_phrases(F.col("t")))).count() == 0
    assert df.select(N.roast(F.col("t")).alias("r"))._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 1
