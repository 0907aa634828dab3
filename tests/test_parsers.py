"""Parsers against values that are written down in many ways and have to be read back, and against texts that have no value."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sievespark.functions import parsers as P
from sievespark.functions import similarity
from sievespark.functions import text as T

PLACES = ["Niğde", "Şırnak", "Çankırı", "Kütahya", "Muş", "İnegöl", "Gölcük", "Ilgaz"]


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", f(F.col("s")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def western(word):
    """UTF-8 read as the western code page."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in word.encode())


@pytest.mark.parametrize("garble", [western, lambda w: w.encode("cp1254").decode("latin-1"), str])
def test_degarbling_undoes_both_misreadings(spark, garble):
    assert apply(spark, T.degarble, list(map(garble, PLACES))) == PLACES


def test_letters_have_a_turkish_case(spark):
    assert apply(spark, T.lower, ["ILGAZ", "İNEGÖL"]) == ["ılgaz", "inegöl"] and apply(spark, T.upper, ["ılgaz", "inegöl"]) == ["ILGAZ", "İNEGÖL"]
    assert apply(spark, T.title, ["KARA ÇALI-dere", "d'artagnan İLKER"]) == ["Kara Çalı-Dere", "D'Artagnan İlker"]
    assert apply(spark, T.key, ["Gölcük / 41", "ÇANKIRI", None]) == ["golcuk41", "cankiri", None]
    assert apply(spark, T.clean, ["​gri  renk\n", None]) == ["gri renk", ""]


def test_every_placeholder_in_every_case(spark):
    forms = [f(p) for p in T.PLACEHOLDERS for f in (str, str.upper, lambda s: f" {s} ")]
    forms = [s for s in forms if "I" not in s]  # a dotless capital is another letter
    assert apply(spark, T.is_placeholder, forms) == [True] * len(forms)
    assert apply(spark, T.is_placeholder, ["0", "yoktur", "?!", "boş"]) == [False] * 4


def test_dates_written_in_all_ways(spark):
    rng = random.Random(1)
    for _ in range(12):
        d = dt.date(1951, 1, 1) + dt.timedelta(rng.randrange(25_000))
        month, english = P.MONTHS[d.month - 1], P.ENGLISH_MONTHS[d.month - 1]
        sure = [d.isoformat(), f"{d:%Y/%m/%d}", f"{d:%Y%m%d}", f"{d:%d.%m.%Y}", f"{d:%d-%m-%Y}", f"{d.day} {month} {d.year}", f"{d.day}-{english}-{d.year}", f"{d.day} {month[:3]}. {d.year}", f"{d}T13:45:10", f"{d} 01:02"]
        assert apply(spark, P.date_candidates, sure) == [[d]] * len(sure)
        swapped = [d] if d.day > 12 or d.day == d.month else [d, dt.date(d.year, d.day, d.month)]
        assert apply(spark, P.date_candidates, [f"{d:%d/%m/%Y}"]) == [swapped]


def test_years_of_two_digits_turn_at_fifty(spark):
    assert apply(spark, P.date_candidates, ["9.8.49", "9.8.50", "9 ağustos 07"]) == [[dt.date(2049, 8, 9)], [dt.date(1950, 8, 9)], [dt.date(2007, 8, 9)]]


def test_texts_that_are_no_dates(spark):
    assert apply(spark, P.date_candidates, ["30.02.2021", "2021-13-01", "12", "9 Smarch 2020", "9 Mart", "1.2.3.4", "", None]) == [[]] * 8


def test_amounts_written_in_all_ways(spark):
    rng = random.Random(2)
    for _ in range(12):
        cents = rng.randrange(100_000, 90_000_000)
        amount = Decimal(cents) / 100
        point, comma = f"{amount:.2f}", f"{amount:.2f}".replace(".", ",")
        us = f"{amount:,.2f}"
        tr = us.translate(str.maketrans(",.", ".,"))
        forms = [point, comma, us, tr, f"{tr} TL", f"₺{us}", f"TRY {point}", f"{comma}tl", f" {tr} ₺ "]
        assert apply(spark, P.money, forms) == [amount] * len(forms)
    assert apply(spark, P.money, ["7.500", "7,500", "-3,5", "7.5"]) == [Decimal(7500), Decimal(7500), Decimal("-3.50"), Decimal("7.50")]
    assert apply(spark, P.money, ["on lira", "4 TL 50 kr", "1,5,25", "--", None]) == [None] * 5


def test_shares_written_in_all_ways(spark):
    for hundredths in (2, 7, 25, 99):
        share = Decimal(str(hundredths)) / 100
        forms = [f"%{hundredths}", f"{hundredths}%", f"% {hundredths}", str(hundredths), str(share), str(share).replace(".", ",")]
        assert apply(spark, P.ratio, forms) == [share.quantize(Decimal("0.0001"))] * len(forms)
    assert apply(spark, P.ratio, ["%100", "-5", "250", "yarım", None]) == [None] * 5


def test_counts_with_units(spark):
    for n, word in enumerate(P.NUMBER_WORDS, 1):
        forms = [str(n), word, word.capitalize() if word[0] != "i" else word, f"{n} adet", f"{n}ad", f"{n} ad.", f"x{n}", f"{n} X", f"{n},00", f"{n}.0 pcs"]
        assert apply(spark, P.count, forms) == [n] * len(forms)
    assert apply(spark, P.count, ["-7", "12adk", "12 adx", "1,5", "bir buçuk", None]) == [-7, None, None, None, None, None]


def test_phones(spark):
    assert apply(spark, P.phone, [p + "544 908 17 26" for p in ("", "0", "+90 ", "90-", "0090")]) == ["+90 544 908 17 26"] * 5
    assert apply(spark, P.phone, ["(0544) 908.17.26", "0212 908 17 26", "544 908 17", None]) == ["+90 544 908 17 26", None, None, None]


def test_identifiers(spark):
    read = lambda s: P.identifier(s, "U", 4)
    assert apply(spark, read, ["U0052", "u52", "#52", " U - 52 ", "# u 0052", "52 "]) == ["U0052"] * 6
    # digits that white space parts are no number, as joining them would invent a reference
    assert apply(spark, read, ["5 2", "U 5 2", "00052", "U52x", "M0052", "--52", "", None]) == [None] * 8


def test_addresses(spark):
    assert apply(spark, P.email_text, [" Çağla.Öz @Posta.COM", "çağla.öz@@@posta,com"]) == ["cagla.oz@posta.com"] * 2


def test_indel(spark):
    df = spark.createDataFrame([("kedi", "kdei"), ("", ""), ("", "b"), ("dört", "dört"), ("ab", "cd")], "a string, b string")
    assert [r[0] for r in df.select(similarity.indel_ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [75.0, 100.0, 0.0, 100.0, 0.0]
