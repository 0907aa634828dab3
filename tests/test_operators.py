import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from sievespark.operators import derive, entity, matching, quality
from sievespark.plans.schema import DISTRICTS, OPTIONS, PROVINCES, SYNONYMS, TABLES
from sievespark.functions import parsers as P
from sievespark.sources import lines as L

GOOD = "S000001,M00001,U0001,2024-03-05,2,100.00,0.00,200.00,Kredi Kartı,Aras Kargo,2024-03-07,Teslim Edildi"
NEXT = GOOD.replace("S000001", "S000002")


def ingest(spark, table, *lines):
    return L.ingest(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"), table)


def test_line_repair(spark):
    parts = GOOD.split(",")
    damaged = [GOOD, ";".join(parts), ",".join(parts[:4] + [""] + parts[4:]), GOOD + NEXT, ",".join(f'"{p}"' for p in parts) + ","]
    records, bad = ingest(spark, "siparisler", *damaged, "\t".join(parts), "|".join(parts))
    rows = [tuple(r)[2:] for r in records.orderBy("row_idx").collect()]
    assert rows == [tuple(parts)] * 4 + [tuple(NEXT.split(","))] + [tuple(parts)]
    assert bad.count() == 2
    assert records.where("repaired").count() == 5
    assert ingest(spark, "urunler", 'U0097,"Lenovo Tablet Pro 89')[1].count() == 1


def test_quotes(spark):
    out = spark.createDataFrame([('a,"b,""c""",,d"e"',)], "s string").select(L.fields(F.col("s")).alias("x")).first()["x"]
    assert out == ["a", 'b,"c"', "", 'd"e"']


def test_reading_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿urun_id,urun_adi,kategori,marka,birim_fiyat\nU0001,A,Kitap,B,1\n\nU0002,A U0003;A;Kitap;B;2\n", encoding="utf-8")
    records, bad = L.ingest(L.read_lines(spark, str(tmp_path / "t.csv")), "urunler")
    assert [r["urun_id"] for r in records.orderBy("row_idx").collect()] == ["U0001", "U0003"]
    assert [r["ham_satir"] for r in bad.collect()] == ["U0002,A"]


def value(spark, text, matcher):
    return spark.createDataFrame([(text,)], "s string").select(matcher(F.col("s")).alias("m")).first()["m"]


def test_matching(spark):
    province = lambda s: matching.match_province(s, PROVINCES)
    assert [value(spark, s, province)["value"] for s in ("07", "81", "82", "Ordu (il)", "T?KAT", "k?rs", "Gümüş", "Esksehir", "MA.")] == ["Antalya", "Düzce", None, "Ordu", "Tokat", "Kars", "Gümüşhane", "Eskişehir", None]
    carrier = lambda s: matching.match(s, OPTIONS["kargo_firmasi"])
    assert value(spark, "sürat", carrier)["value"] == "Sürat Kargo" and value(spark, "hepsi jet.", carrier)["value"] == "HepsiJet"
    unresolved = value(spark, "UPS", carrier)
    assert unresolved["value"] is None and unresolved["candidates"] == OPTIONS["kargo_firmasi"]
    assert value(spark, "SHIPPED", lambda s: matching.match(s, OPTIONS["durum"], SYNONYMS["durum"]))["value"] == "Kargoda"
    # of more than ten options the five likeliest, met by their windows where they are much longer, then in their own order
    assert value(spark, "maras", province)["candidates"][0] == "Kahramanmaraş" and len(value(spark, "maras", province)["candidates"]) == 5
    assert len(PROVINCES) == 81 and sum(map(len, DISTRICTS.values())) == len({d for v in DISTRICTS.values() for d in v})


def test_words_and_brands(spark):
    df = spark.createDataFrame([(0, "Gül Işık"), (1, "gül ışık"), (2, "G?l I??k"), (3, None), (4, "x?z")], "o long, n string")
    out = {r["o"]: r["n_words"] for r in matching.repair_words(df, "n", "o", titled=True).collect()}
    assert out[0] == out[1] == out[2] == "Gül Işık" and out[3] is None and out[4] is None


def test_joint_dates(spark):
    df = spark.createDataFrame([("05/03/2024", "2024-03-07"), ("05/03/2024", ""), ("2024-03-05", "2024-01-01")], "s string, t string")
    out = [r["x"] for r in df.select(derive.joint_dates(P.date_candidates(F.col("s")), P.date_candidates(F.col("t"))).alias("x")).collect()]
    assert out[0]["order_date"] == dt.date(2024, 3, 5) and out[0]["delivery_date"] == dt.date(2024, 3, 7)
    assert out[1]["order_date"] is None and out[1]["uncertain_order"][0] == dt.date(2024, 3, 5)
    assert out[2]["order_date"] == dt.date(2024, 3, 5) and out[2]["delivery_date"] is None


def test_derivation(spark):
    df = spark.createDataFrame([(9999, Decimal(100), Decimal(0), Decimal(300)), (-3, Decimal(100), Decimal(0), None), (2, Decimal(100), None, Decimal(180)), (2, Decimal(100), Decimal("0.1"), Decimal(1800))], "q int, p decimal(12,2), d decimal(6,4), t decimal(18,2)")
    q, p, d, t = (F.col(c) for c in "qpdt")
    out = df.select(derive.repaired_count(q, p, d, t).alias("q"), derive.inferred_discount(q, p, d, t).alias("d"), derive.recomputed_total(q, p, d, t).alias("t")).collect()
    assert [r["q"] for r in out] == [3, 3, 2, 2]
    assert out[2]["d"] == Decimal("0.1000") and out[3]["t"] == Decimal("180.00")


def test_counts_near_a_whole_number(spark):
    df = spark.createDataFrame([(9999, Decimal(100), Decimal(0), Decimal(302)), (9999, Decimal(1000), Decimal(0), Decimal(3001))], "q int, p decimal(12,2), d decimal(6,4), t decimal(18,2)")
    assert [r["q"] for r in df.select(derive.repaired_count(*(F.col(c) for c in "qpdt")).alias("q")).collect()] == [None, 3]


def test_votes_and_modes(spark):
    df = spark.createDataFrame([("a", "K", 1), ("a", "K", 2), ("a", "K", 3), ("b", "K", 4), ("b", "K", 5), ("c", "K", 6), ("c", "E", 7), (None, "E", 8)], "n string, g string, o long")
    assert {r["n"]: r["voted"] for r in derive.voted(df, "n", "g").collect()} == {"a": "K"}
    assert {r["n"]: r["g"] for r in derive.mode_first_seen(df, "n", "g", "o").collect()} == {"a": "K", "b": "K", "c": "K", None: "E"}


def people(spark):
    rows = [
        (0, "M00001", "Ayşe", "Yılmaz", "1990-01-01", None, "ayse.y@x.com", "Kadıköy", "2021-01-01"),
        (1, "M02501", "YILMAZ", "AYSE", "1990-01-01", "p", None, "Kadıköy", "2022-01-01"),
        (2, "M00002", "Ayşe", "Yılmaz", None, None, "ayse.y7@x.com", "Kadıköy", "2021-01-01"),
        (3, "M00003", "Ayşe", None, "1990-01-01", "p", None, "Kadıköy", None),
    ]
    return spark.createDataFrame(rows, "o long, id string, first string, last string, birth string, phone string, email string, district string, since string")


ROLES = {"birth": "birth", "phone": "phone", "email": "email", "district": "district"}


def test_entities(spark):
    pairs = entity.decided_pairs(people(spark), "first", "last", ROLES, "o")
    assert {(r["a"], r["b"]): r["decision"] for r in pairs.collect()} == {(0, 1): "yes", (0, 2): "uncertain"}
    merged, mapping = entity.merge(people(spark), entity.components(pairs.where("decision = 'yes'")), "id", "o", own=["since"])
    assert [tuple(r) for r in mapping.collect()] == [("M02501", "M00001")]
    one = merged.where("id = 'M00001'").first()
    assert one["phone"] == "p" and one["since"] == "2021-01-01" and merged.count() == 3


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in entity.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keep_first(spark):
    df = spark.createDataFrame([("S1", 3), ("S1", 1), ("S1", 2), (None, 5), (None, 4)], "k string, o long")
    assert sorted((str(r["k"]), r["o"]) for r in entity.keep_first(df, "k", "o").collect()) == [("None", 4), ("S1", 1)]


def test_truth_scores_perfect(spark):
    row = ["U0001", "Ad", "Kitap", None, "10.50"]
    schema = ", ".join(f"{c} string" for c in TABLES["urunler"])
    truth = spark.createDataFrame([row, ["U0002", "B", "Kitap", "C", "1.00"]], schema)
    log = spark.createDataFrame([("urunler", "U0001", "birim_fiyat", "B6", True)], "tablo string, anahtar string, sutun string, bozma string, kurtarilabilir boolean")
    out = quality.cell_outcomes(truth, truth.withColumn("birim_fiyat", F.concat("birim_fiyat", F.lit("0"))), log, "urunler")
    assert quality.rates(out).first()["correct"] == 1.0 and out.where("corruption = 'B6'").count() == 1
    assert quality.fabrication(out).first()["rate"] == 0.0
    mapping = spark.createDataFrame([("M2", "M1"), ("M3", "M1")], "old_id string, new_id string")
    scores = entity.pair_scores(mapping, mapping).first()
    assert (scores["true_pairs"], scores["f1"]) == (3, 1.0)
    assert entity.pair_scores(mapping.limit(0), mapping.limit(0)).first()["f1"] == 0.0
    scopes = {r["scope"] for r in quality.summaries(out).collect()}
    assert scopes == {"corruption", "column"}


def table(spark, name, rows):
    columns = list(TABLES[name])
    return spark.createDataFrame([(i, *[r.get(c, "") for c in columns]) for i, r in enumerate(rows)], "row_idx long, " + ", ".join(f"{c} string" for c in columns))


def test_cleaning_run(spark):
    from sievespark.plans import cleaning

    products = [{"urun_id": "u-0001", "urun_adi": "Nike Termos", "kategori": "spor outdoor", "marka": "nike", "birim_fiyat": "yok"}, {"urun_id": "U0002", "urun_adi": "Nike Koşu", "kategori": "Kitap", "marka": "-", "birim_fiyat": "₺1,250.50"}, {"urun_id": "U0003", "urun_adi": "Lego", "kategori": "zzz", "marka": "Nike", "birim_fiyat": "5"}, {"urun_id": "U0004", "urun_adi": "Lego", "kategori": "Kitap", "marka": "Nike", "birim_fiyat": "5"}]
    person = {"ad": "Ayşe", "soyad": "Yılmaz", "dogum_tarihi": "05.03.1990", "telefon": "0532 123 45 67", "il": "34", "ilce": "Kadıköy", "cinsiyet": "k", "kayit_tarihi": "2022-01-01", "eposta": "AYSE@GMAIL.COM"}
    customers = [person | {"musteri_id": "M00001", "telefon": ""}, person | {"musteri_id": "#2501", "il": "N/A", "cinsiyet": "Kadın"}, person | {"musteri_id": "M00002", "ad": "Ali", "soyad": "Kaya", "eposta": "ali@gmail.com", "telefon": "12", "dogum_tarihi": "1800-01-01", "cinsiyet": "e"}]
    order = {"siparis_id": "S000001", "musteri_id": "M02501", "urun_id": "U0001", "siparis_tarihi": "05/03/2024", "adet": "üç", "birim_fiyat": "100,00 TL", "indirim_orani": "%10", "toplam_tutar": "2700", "odeme_yontemi": "kk", "kargo_firmasi": "Yurtiçi", "teslim_tarihi": "2024-03-07", "durum": "teslim"}
    orders = [order, order, order | {"siparis_id": "S000002", "birim_fiyat": "?", "urun_id": "U0002", "indirim_orani": "", "toplam_tutar": "3751,50", "siparis_tarihi": "05/03/2024", "teslim_tarihi": ""}]
    got = cleaning.clean(table(spark, "musteriler", customers), table(spark, "urunler", products), table(spark, "siparisler", orders))
    p = {r["urun_id"]: r for r in got.products.collect()}
    assert str(p["U0001"]["birim_fiyat"]) == "100.00" and p["U0001"]["kategori"] == "Spor & Outdoor" and p["U0002"]["marka"] == "Nike" and p["U0003"]["kategori"] is None
    c = {r["musteri_id"]: r for r in got.customers.collect()}
    assert set(c) == {"M00001", "M00002"} and c["M00001"]["telefon"] == "+90 532 123 45 67" and c["M00002"]["dogum_tarihi"] is None
    o = {r["siparis_id"]: r for r in got.orders.collect()}
    assert len(o) == 2 and o["S000001"]["musteri_id"] == "M00001" and str(o["S000001"]["toplam_tutar"]) == "270.00" and str(o["S000001"]["siparis_tarihi"]) == "2024-03-05"
    assert str(o["S000002"]["birim_fiyat"]) == "1250.50" and o["S000002"]["indirim_orani"] == 0 and str(o["S000002"]["siparis_tarihi"]) == "2024-03-05"
    assert [tuple(r) for r in got.mapping.collect()] == [("M02501", "M00001")]
    assert {r["column"] for r in got.uncertain.collect()} == {"kategori", "siparis_tarihi"}
    log = [(r["anahtar"], r["sutun"], r["ham"], r["temiz"], r["islem"]) for r in got.issues.orderBy("tablo", "anahtar", "sira").collect()]
    assert [e for e in log if e[0] == "S000002" and e[1] not in ("odeme_yontemi", "kargo_firmasi", "durum")] == [("S000002", "siparis_tarihi", "05/03/2024", "2024-03-05", "belirsiz_varsayilan"), ("S000002", "birim_fiyat", None, "1250.50", "turetildi"), ("S000002", "indirim_orani", None, "0.00", "turetildi")]
    assert ("M00002", "dogum_tarihi", "1800-01-01", None, "gecersiz") in log and ("M02501", "il", None, "İstanbul", "turetildi") in log and ("U0001", "birim_fiyat", None, "100.00", "turetildi") in log
    counts = got.counters.values()
    assert {r["tablo"] + "." + r["islem"]: r["n"] for r in got.statistics().collect()} == {k: v for k, v in counts.items() if "." in k and v and not k.endswith("ham_satir")}
    assert (counts["siparisler.ham_satir"], counts["belirsiz_hucre"], counts["belirsiz_cift"], counts["birlesen_musteri"], counts["silinen_tekrar_siparis"]) == (3, got.uncertain.count(), 0, 1, 1)
    answered = cleaning.TableResolver(spark.createDataFrame([("urunler:U0003:kategori:2", "Oyuncak"), ("siparisler:S000002:siparis_tarihi:2", "2024-05-03")], "id string, answer string"))
    again = cleaning.clean(table(spark, "musteriler", customers), table(spark, "urunler", products), table(spark, "siparisler", orders), answered)
    assert again.products.where("urun_id = 'U0003'").first()["kategori"] == "Oyuncak"
    assert str(again.orders.where("siparis_id = 'S000002'").first()["siparis_tarihi"]) == "2024-05-03"
