from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from permitflow.functions import text as T
from permitflow.functions.bidi import levels, turned


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [
    ("1-4,74", ["1", "2", "3", "4", "74"]), ("12-10", ["10", "11", "12"]), ("007", ["7"]), ("1-999999", ["1"]), ("10841;10840", ["10841", "10840"]),
    ("86, 114 ,86", ["86", "114"]), ("", []), (None, []), ("a-b", ["a-b"]), ("99999999999999999999-5", ["99999999999999999999"]), ("0", ["0"]),
])
def test_id_list(spark, text, want):
    assert one(spark, T.id_list, text) == want


def test_id_list_limit(spark):
    assert len(one(spark, T.id_list, "1-200")) == 200
    assert one(spark, T.id_list, "1-201") == ["1"]


@pytest.mark.parametrize(("text", "want"), [
    ("ציון 22", ("ציון", "22")), ("הרב אריה לוין 14/16/18", ("הרב אריה לוין", "14/16/18")), ("22", ("", "22")), ("", ("", "")), ("א 12א 3", ("א", "12א 3")), ("רחוב 5 צפון", ("רחוב 5 צפון", "")),
])
def test_split_street_house(spark, text, want):
    assert tuple(one(spark, T.split_street_house, text)) == want


@pytest.mark.parametrize(("text", "want"), [
    ("שדרות מוריה 1", "מוריה"), ("רחוב", "רחוב"), ('(החיד"א) ר\' חיים יוסף', "ר חיים יוסף"), ("(הגליל)", "הגליל"), ("22", "22"), ("נתיב אליעזר", "אליעזר"), ("קריית אליעזר", "קריית אליעזר"), (None, ""),
])
def test_normalize_street(spark, text, want):
    assert one(spark, T.normalize_street, text) == want


def test_street_keys(spark):
    assert one(spark, T.street_keys, "(החידא) ר חיים יוסף") == ["ר חיים יוסף", "החידא", "חידא"]
    assert one(spark, T.street_keys, "הגליל") == ["הגליל", "גליל"]
    assert one(spark, T.street_keys, "") == []


@pytest.mark.parametrize(("house", "want"), [("14/16/18", 14), ("55-61", 55), ("1א", 1), ("", None), (None, None)])
def test_house_number(spark, house, want):
    assert one(spark, T.house_number, house) == want


def test_address_number_prefers_own_column(spark):
    assert one(spark, T.address_number, "מוריה 7", "3") == 3
    assert one(spark, T.address_number, "מוריה 7", "") == 7


def test_white_space(spark):
    assert one(spark, T.clean_text, " a \x1c b\n\tc ") == "a b c"


@pytest.mark.parametrize(("street", "house", "want"), [("a", "5", "a 5"), ("a 5", "5", "a 5"), ("a", "None", "a"), ("", "5", "5"), ("a", None, "a")])
def test_address(spark, street, house, want):
    assert one(spark, T.address, street, house) == want


def test_block_text(spark):
    assert one(spark, T.block_text, "11539", "2038") == "גוש 11539 חלקה 2038"
    assert one(spark, T.block_text, "0", "1") == ""
    assert one(spark, T.block_text, "7", "none") == "גוש 7"


def test_dates_and_counts(spark):
    assert str(one(spark, T.pdf_date, "1/9/2026")) == "2026-09-01"
    assert one(spark, T.pdf_date, "2026-09-01") is None
    assert str(one(spark, T.api_date, "2026-09-01T10:30:05")) == "2026-09-01"
    assert one(spark, T.pdf_count, "x") == 1
    assert one(spark, T.api_count, None) == 0
    assert one(spark, T.digits, "גוש 00120") == "120"
    assert one(spark, T.digits, "000") == "0"


def test_escape(spark):
    assert one(spark, T.html_escape, "<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"


def test_visual_order():
    assert "\n".join(map(turned, "סוקיפ\nתורדשה".split("\n"))) == "פיקוס\nהשדרות"
    assert turned("abc 12") == "abc 12" and turned("") == ""
    assert turned("12 ןויצ") == "ציון 12"


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("abc אבג", "abc גבא"),  # the first strong character is Latin
        ("12 אבג", "גבא 12"),  # a number is not strong
        ("דתלא Electra Power Ltd 12", "Electra Power Ltd 12 אלתד"),  # spaces between Latin words go with them
        ("אבג abc, def דהו", "והד abc, def גבא"),
        ("אבג abc, דהו", "והד ,abc גבא"),  # a comma between two ways takes the paragraph's
        ("5% אבג", "גבא 5%"),  # terminators belong to their number, on either side
        ("אבג $$5", "$$5 גבא"),
        ("אבג % 5", "5 % גבא"),
        ("אבג 1,234.5", "1,234.5 גבא"),  # one separator in a number does; two do not
        ("אבג 1,,2", "2,,1 גבא"),
        ("אבג 12-34", "12-34 גבא"),
        ("abc אבג 12", "abc 12 גבא"),  # a number after Hebrew is in its stretch
        ("abc 12 אבג", "abc 12 גבא"),
        ("אבג (abc) דהו", "והד (abc) גבא"),  # brackets are mirrored with what they stand in
        ("אבג abc (def) ghi", "abc (def) ghi גבא"),
        ("abc (אבג) 1", "abc (גבא) 1"),
        ("אבג [דהו", "והד] גבא"),
        ("שׁ", "\u05c1ש"),  # a point goes with its letter
        ("ابج 12", "12 جبا"),  # a number after Arabic letters
        ("אבג ١,٢", "١,٢ גבא"),
        ("אבג  ", "  גבא"),  # trailing blanks are the paragraph's
        ("abc אבג  ", "abc גבא  "),
    ],
)
def test_directions_of_mixed_lines(line, want):
    assert turned(line) == want


def test_turning_twice_gives_back_what_has_one_way():
    for line in ("אבג דהו", "אבג 12 דהו", "abc אבג def"):
        assert turned(turned(line)) == line
    assert levels("א1b") == [1, 2, 2]


def test_clean_column_and_blanks(spark):
    """The short ways agree with the long one; composition makes nothing blank that wasn't, for any character it changes."""
    import sys
    import unicodedata

    from permitflow.functions.arrow import compose

    texts = [None, "", " ", "a", " a", "a ", "a b", "a  b", "a\n", "\na", "\t", "\x1c", "a\x1fb", "\u00a0", "א ב", "א\u2028", "ß\u3000", "ב\u05bc\u05b0", " \u00a8 "]
    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and unicodedata.normalize("NFKC", c) != c]
    df = spark.createDataFrame([(t, t) for t in texts + odd], "t string, c string")
    d = compose(df, "c").select("t", "c", T.clean_text("t").alias("x"), T.clean_column("t").alias("y"), T.is_blank("t").alias("b"), (T.clean_text("c") == "").alias("cb"))
    for r in d.collect():
        assert r.x == r.y and r.b == r.cb == (r.x == "") and r.c == (r.t and unicodedata.normalize("NFKC", r.t)), repr(r.t)
