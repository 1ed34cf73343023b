import datetime
import math

from fieldtally.functions import answers, calendar, coercion

DAY = datetime.date


def test_text_to_double(one):
    texts = ["12", " 12 ", "1e3", "12d", "12f", "0x1A", "null", "", None, "NaN", "0.5", ".5", "5.",
             "-1", "+2", "3e9", "1 2", "inf", "-Infinity", "e5", "."]
    expected = [12.0, 12.0, 1000.0, None, None, None, None, None, None, None, 0.5, 0.5, 5.0,
                -1.0, 2.0, 3e9, None, math.inf, -math.inf, None, None]
    assert one(coercion.to_double, texts) == expected


def test_text_to_integer_cuts_fractions_and_drops_overflow(one):
    texts = ["12", "12.9", "-12.9", "07", "3e9", "x", None, "inf"]
    assert one(coercion.to_integer, texts) == [12, 12, -12, 7, None, None, None, None]


def test_rounding_is_half_even(one):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 0.4, 3e9, None, math.nan]
    expected = [0, 2, 2, 0, -2, 0, None, None, None]
    assert one(lambda c: coercion.rounded(coercion.present(c)), values, "double") == expected


def test_text_to_date(one):
    texts = ["2025-03-01", "2025-3-1", "2025/03/01", "2025", "2025-13-40", "unspecified",
             "2025-03-01T10:00:00", None, " 2025-03-01", "2025-03/01", "2024-02-29", "2025-02-29", ""]
    d = DAY(2025, 3, 1)
    expected = [d, d, d, None, None, None, d, None, d, None, DAY(2024, 2, 29), None, None]
    assert one(coercion.to_date, texts) == expected
    assert one(lambda c: coercion.to_date(c, slashes=False), ["2025/03/01"]) == [None]


def test_moment_text(one):
    texts = ["2025-03-01", "2025-03-01T10:00:00", "2025-03-01 10:00:01.5", "unknown", None, "2025"]
    expected = ["2025-03-01", "2025-03-01 10:00:00", "2025-03-01 10:00:01", None, None, None]
    assert one(coercion.to_moment_text, texts) == expected


def test_moment_text_does_not_depend_on_the_session_zone(spark, one):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # this hour does not exist there
        assert one(coercion.to_moment_text, ["2025-03-09 02:30:00"]) == ["2025-03-09 02:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_week_of_month(one):
    days = [DAY(2025, 1, d) for d in (1, 7, 8, 28, 29, 31)] + [None]
    expected = ["Week1", "Week1", "Week2", "Week4", "Week5", "Week5", "WeekNA"]
    assert one(calendar.week_of_month, days, "date") == expected


def test_calendar_parts(one):
    days = [DAY(2025, 3, 31), DAY(2025, 4, 1), DAY(2025, 12, 31), None]
    assert one(calendar.quarter_of, days, "date") == ["Q1", "Q2", "Q4", None]
    assert one(calendar.year_of, days, "date") == [2025, 2025, 2025, None]
    assert one(calendar.month_of, days, "date") == [3, 4, 12, None]
    assert one(calendar.month_abbr, days, "date") == ["Mar", "Apr", "Dec", None]


def test_months(one):
    assert one(calendar.month_name, [1, 5, 12], "int") == ["January", "May", "December"]
    months = [0, 1, 3, 4, 9, 12, 13, None]
    expected = [None, "Q1", "Q1", "Q2", "Q3", "Q4", None, None]
    assert one(calendar.month_to_quarter, months, "int") == expected


def test_province_group(one):
    codes = ["7", "07", "10", "", None, "0018", "70", "23"]
    expected = ["Marine", "Marine", "Inland", "Inland", "Inland", "Marine", "Inland", "Marine"]
    assert one(answers.province_group, codes) == expected
    assert one(lambda c: answers.province_group(c, zeros=False), ["07", "7"]) == ["Inland", "Marine"]


def test_codes_in_multiselects(one):
    texts = ["2 3 6", "2,2", "x2", "12", "", "null", None]
    expected = [["2", "3", "6"], ["2", "2"], ["2"], ["12"], [], [], None]
    assert one(answers.codes_in, texts) == expected


def test_facilities(one):
    texts = ["pond", "Ponds_batch", "plastic-soung", "SOUNG  pond pond", "other", "", None, "pondside",
             " batches "]
    expected = [["ponds"], ["ponds", "batches"], ["plastic soung"], ["ponds", "plastic soung"], [],
                [], [], [], ["batches"]]
    assert one(answers.facilities_in, texts) == expected


def test_tokens(one):
    texts = ["a", "", None]
    assert one(answers.null_token, texts) == ["a", "null", "null"]
    assert one(answers.blank_token, texts) == ["a", "null", None]


def test_lists_to_text(one):
    lists = [["a", None, "b"], [], None]
    assert one(answers.list_text, lists, "array<string>") == ["a,NA,b", "", None]
    assert one(answers.multiselect_text, lists, "array<string>") == ["a,b", "null", "null"]
    texts = ["2 3", '["2","3"]', "[]", None, ""]
    assert one(answers.multiselect_json_text, texts) == ["2 3", "2,3", "null", "null", ""]


def test_recode_and_position(one):
    assert one(lambda c: answers.recode(c, {"2": "two"}), ["2", "3", None]) == ["two", None, None]
    assert one(lambda c: answers.position_in(c, ("b", "a")), ["a", "b", "c", None]) == [2, 1, None, None]


def test_moments_with_a_zone_are_given_in_utc(spark, one):
    texts = ["2024-03-01T08:00:00+07:00", "2024-03-01T08:00:00.250+0700", "2024-03-01T08:00:00Z",
             "2024-03-01 01:00:00-02", "2024-03-01T08:00:00", "2024-03-01"]
    expected = ["2024-03-01 01:00:00", "2024-03-01 01:00:00", "2024-03-01 08:00:00",
                "2024-03-01 03:00:00", "2024-03-01 08:00:00", "2024-03-01"]
    for zone in ("UTC", "Asia/Phnom_Penh"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert one(coercion.to_moment_text, texts) == expected
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_labels_lose_white_space_at_their_ends(one):
    assert one(answers.trimmed, ["\t a b\r\n", "a", " ", None]) == ["a b", "a", "", None]
