"""Synthetic clean tables and their seeded corruption, with a log of every damaged cell.

All draws are hashes of (seed, what, key), so the result depends neither on partitions nor on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievespark.functions import parsers as P
from sievespark.functions import text as T
from sievespark.plans import unseen
from sievespark.plans.schema import KEYS, OPTIONS, PROVINCE_OF, PROVINCES, SYNONYMS, TABLES

#: Corruption kinds.
KINDS = {"B1": "repeated customer", "B2": "repeated order", "B3": "date format", "B4": "mis-decoded letters", "B5": "placeholder", "B6": "money or ratio format", "B7": "out of domain", "B8": "spelling", "B9": "phone format", "B10": "e-mail", "B11": "white space", "B12": "wrong total", "B13": "identifier format", "B14": "broken row", "B15": "count format"}
#: Table -> column -> kinds that its cells may get, each with its share of the cells.
PLAN = {
    "musteriler": {
        "ad": {"B4": 0.03, "B8": 0.04, "B11": 0.03}, "soyad": {"B4": 0.03, "B8": 0.04, "B11": 0.03}, "eposta": {"B10": 0.06, "B5": 0.02, "B11": 0.02}, "telefon": {"B9": 0.25, "B5": 0.03},
        "dogum_tarihi": {"B3": 0.2, "B7": 0.015, "B5": 0.02}, "cinsiyet": {"B8": 0.08, "B5": 0.03}, "il": {"B8": 0.1, "B4": 0.03, "B5": 0.02}, "ilce": {"B8": 0.05, "B4": 0.03, "B5": 0.02}, "kayit_tarihi": {"B3": 0.2, "B5": 0.01},
    },
    "urunler": {"urun_adi": {"B11": 0.04, "B4": 0.03}, "kategori": {"B8": 0.12, "B4": 0.02}, "marka": {"B8": 0.05, "B5": 0.03}, "birim_fiyat": {"B6": 0.3, "B5": 0.02}},
    "siparisler": {
        "musteri_id": {"B13": 0.03}, "urun_id": {"B13": 0.03}, "siparis_tarihi": {"B3": 0.25, "B7": 0.01, "B5": 0.01}, "adet": {"B15": 0.06, "B7": 0.02}, "birim_fiyat": {"B6": 0.25, "B5": 0.02},
        "indirim_orani": {"B6": 0.15, "B5": 0.02}, "toplam_tutar": {"B6": 0.25, "B12": 0.03, "B5": 0.02}, "odeme_yontemi": {"B8": 0.1, "B5": 0.02, "B11": 0.03}, "kargo_firmasi": {"B8": 0.1, "B5": 0.02, "B4": 0.02, "B11": 0.03},
        "teslim_tarihi": {"B3": 0.2, "B5": 0.03, "B7": 0.01}, "durum": {"B8": 0.08, "B4": 0.02, "B11": 0.03},
    },
}
#: Fixed values: (column, kind) of damage that nothing else in the data can undo, and of damage to orders that only one loss a row can be undone.
LOST = {
    "musteriler": [("eposta", "B5"), ("telefon", "B5"), ("dogum_tarihi", "B7"), ("dogum_tarihi", "B5"), ("ilce", "B5"), ("kayit_tarihi", "B5")],
    "urunler": [],
    "siparisler": [("siparis_tarihi", "B7"), ("siparis_tarihi", "B5"), ("odeme_yontemi", "B5"), ("kargo_firmasi", "B5"), ("teslim_tarihi", "B7")],
}
TOGETHER = [("adet", "B7"), ("indirim_orani", "B5"), ("toplam_tutar", "B5"), ("toplam_tutar", "B12")]
#: Misspelt mail domains.
DOMAINS = {"gmail.com": ["gmial.com", "gmail.con", "gmai.com", "gmail.co"], "hotmail.com": ["hotmial.com", "hotmail.con", "hotmal.com"], "outlook.com": ["outlok.com", "outlook.con"]}
#: Orders and registrations end the day before the extract. Weights of customers (Pareto's exponent), of prices, of days at weekends and in November, and of delivered orders.
LAST_DAY, FIRST_DAY = "2024-12-31", "2023-01-01"
PARETO, CHEAP, WEEKEND, NOVEMBER = 1.5, 0.3, 0.4, 1.5
_FIRST = {"Kadın": ["Ayşe", "Fatma", "Zeynep", "Elif", "Özlem", "Büşra", "Gül", "Çağla", "İrem", "Pınar"], "Erkek": ["Mehmet", "Mustafa", "Ahmet", "Ali", "Hüseyin", "İbrahim", "Ömer", "Oğuz", "Barış", "Uğur"]}
_LAST = ["Yılmaz", "Kaya", "Demir", "Şahin", "Çelik", "Yıldız", "Öztürk", "Aydın", "Arslan", "Kılıç", "Koç", "Şimşek", "Güneş", "Işık", "Çınar"]
_BRANDS = ["Nike", "Adidas", "Puma", "Lenovo", "Karaca", "Nivea", "Lego", "Komili"]


def uniform(seed: int, *what) -> Column:  # noqa: ANN002
    """A number in [0, 1) from the seed, names and columns."""
    parts = [F.lit(seed), *[x if isinstance(x, Column) else F.lit(x) for x in what]]
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def choice(options: list, seed: int, *what) -> Column:  # noqa: ANN002
    listed = F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options])
    return F.get(listed, F.floor(uniform(seed, "choice", *what) * len(options)).cast("int"))


#: Items whose weights are summed in one task, and the whole number that the mean weight becomes.
SUMMED, MEAN = 4096, 1 << 20


def drawn(draws: DataFrame, h: str, items: DataFrame, name: str, unit: float | None = None) -> DataFrame:
    """draws with a column `name`: the id of an item, drawn just as often as its weight says.

    draws[h]: a long that is as good as random; items: (id long from 0, weight), any number of them. Weights become whole numbers, of `unit` or else 1/MEAN of their mean, and are laid end to end in the order of the ids; the remainder
    of h by their sum falls on one item. That line is cut into as many equal cells as there are items: items, in all cells that they reach (at most twice as many), and draws meet by their cells, so
    the join has equal keys and an item with a third of all weight is spread over a third of the cells.
    """
    size = items.agg(F.count("*").alias("n"), F.avg("weight").alias("mean")).first()
    w = F.greatest(F.round(F.col("weight") * (1 / unit if unit else MEAN / (size["mean"] or 1.0))).cast("long"), F.lit(1).cast("long"))
    whole = items.select(F.col("id").alias("__id"), w.alias("__w"), F.floor(F.col("id") / SUMMED).alias("__s")).checkpoint()
    sums = whole.groupBy("__s").agg(F.sum("__w").alias("t"))  # one row for so many items
    before = sums.select("__s", (F.sum("t").over(Window.orderBy("__s")) - F.col("t")).alias("__before"))
    within = F.sum("__w").over(Window.partitionBy("__s").orderBy("__id"))
    line = whole.withColumn("__in", within).join(before, "__s").select("__id", (F.col("__before") + F.col("__in") - F.col("__w")).alias("__low"), (F.col("__before") + F.col("__in")).alias("__high"))
    total = sums.agg(F.sum("t")).first()[0]
    width = max(1, total // size["n"])
    cells = line.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor((F.col("__high") - 1) / width)))).checkpoint()
    at = draws.withColumn("__at", F.pmod(F.col(h), F.lit(total))).withColumn("__cell", F.floor(F.col("__at") / width))
    return at.join(cells, "__cell").where("__low <= __at and __at < __high").withColumnRenamed("__id", name).drop("__cell", "__at", "__low", "__high")


def numbered(df: DataFrame, day: str, order: str, name: str) -> DataFrame:
    """Adds the rows' numbers from 1 by (day, order). Days are numbered on their own; only a count for each day of the calendar meets in one task."""
    before = F.sum("__n").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    days = df.groupBy(day).agg(F.count("*").alias("__n")).select(F.col(day).alias("__day"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(day).orderBy(order))
    return df.withColumn("__within", within).join(days, F.col(day) == F.col("__day")).withColumn(name, F.col("__before") + F.col("__within")).drop("__within", "__day", "__before")


def synthetic(spark: SparkSession, orders: int = 1500, customers: int = 400, products: int = 80, seed: int = 7) -> dict[str, DataFrame]:
    """The three clean tables as canonical text, with a row_idx each. Orders are numbered by date: more at weekends and in November, and cheap products sell most."""
    i = F.col("id")
    day = lambda first, days, *w: F.date_add(F.lit(first).cast("date"), F.floor(uniform(seed, *w) * days).cast("int"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    since = lambda who: day("2021-01-01", 1000, "since", who)
    price_of = lambda what: F.round(F.exp(3 + 6 * uniform(seed, "price", what)), 2).cast("decimal(12,2)")
    c = spark.range(customers).withColumn("cinsiyet", choice(OPTIONS["cinsiyet"], seed, "sex", i)).withColumn("ad", F.when(F.col("cinsiyet") == "Kadın", choice(_FIRST["Kadın"], seed, "f", i)).otherwise(choice(_FIRST["Erkek"], seed, "m", i)))
    c = c.withColumn("soyad", choice(_LAST, seed, "last", i)).withColumn("ilce", choice(list(PROVINCE_OF), seed, "district", i))
    province = F.create_map(*[F.lit(x) for pair in PROVINCE_OF.items() for x in pair])
    digits = F.lpad(F.floor(uniform(seed, "phone", i) * 1_000_000_000).cast("string"), 9, "0")
    mail = F.concat(T.key(F.col("ad")), F.lit("."), T.key(F.col("soyad")), i.cast("string"), F.lit("@"), choice(["gmail.com", "hotmail.com", "outlook.com"], seed, "domain", i))
    c = c.select(i.alias("row_idx"), F.format_string("M%05d", i + 1).alias("musteri_id"), "ad", "soyad", mail.alias("eposta"), P.phone(F.concat(F.lit("5"), digits)).alias("telefon"), iso(day("1950-01-01", 20000, "birth", i)).alias("dogum_tarihi"), "cinsiyet", F.try_element_at(province, F.col("ilce")).alias("il"), "ilce", iso(since(i)).alias("kayit_tarihi"))
    brand = choice(_BRANDS, seed, "brand", i)
    p = spark.range(products).select(i.alias("row_idx"), F.format_string("U%04d", i + 1).alias("urun_id"), F.concat(brand, F.lit(" Model "), (i + 10).cast("string")).alias("urun_adi"), choice(OPTIONS["kategori"], seed, "category", i).alias("kategori"), brand.alias("marka"), price_of(i).cast("string").alias("birim_fiyat"))
    # a few customers and the cheap products take most orders, weekends and November have more of them
    hashed = lambda *w: F.xxhash64(F.lit(seed), *[F.lit(x) for x in w], F.col("id"))
    d = F.date_add(F.lit(FIRST_DAY).cast("date"), i.cast("int"))
    busy = 1 + F.when(F.weekday(d) >= 5, WEEKEND).otherwise(0.0) + F.when(F.month(d) == 11, NOVEMBER).otherwise(0.0)
    days = spark.sql(f"select datediff('{LAST_DAY}', '{FIRST_DAY}') + 1 n").first()["n"]
    weights = {"who": (customers, F.pow(1 - uniform(seed, "who", i), -1 / PARETO)), "what": (products, 1 / (CHEAP + price_of(i).cast("double") / 1000)), "on": (days, busy)}
    o = spark.range(orders)
    for name, (n, weight) in weights.items():
        o = drawn(o.withColumn("__h", hashed("draw", name)), "__h", spark.range(n).select("id", weight.alias("weight")), name).drop("__h")
    o = o.withColumn("price", price_of(F.col("what"))).withColumn("q", choice([1] * 60 + [2] * 20 + [3] * 8 + [4] * 5 + [5] * 3 + [6] * 2 + [8, 10], seed, "q", i))
    date = F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("on").cast("int"))
    o = o.withColumn("d", choice([0.0] * 11 + [0.05] * 2 + [0.1] * 3 + [0.15] * 2 + [0.2, 0.25], seed, "d", i).cast("decimal(6,2)")).withColumn("date", date).withColumn("first", F.greatest(since(F.col("who")), F.lit(FIRST_DAY).cast("date")))
    # nobody orders before registering, old orders aren't under way, and what would arrive after the extract hasn't arrived
    again = F.date_add("first", F.floor(uniform(seed, "again", i) * (F.datediff(F.lit(LAST_DAY).cast("date"), "first") + 1)).cast("int"))
    o = o.withColumn("date", F.when(F.col("date") < F.col("first"), again).otherwise(F.col("date")))
    state = choice(OPTIONS["durum"][:1] * 16 + OPTIONS["durum"][1:], seed, "status", i)
    arrival = F.date_add("date", (1 + F.floor(uniform(seed, "days", i) * 7)).cast("int"))
    status = F.when(state.isin("Kargoda", "Hazırlanıyor") & (F.col("date") < "2024-12-20"), "Teslim Edildi").otherwise(state)
    o = o.withColumn("durum", status).withColumn("arrival", arrival).withColumn("durum", F.when(F.col("durum").isin("Teslim Edildi", "İade Edildi") & (F.col("arrival") > LAST_DAY), "Kargoda").otherwise(F.col("durum")))
    later = F.when(F.col("durum").isin("Teslim Edildi", "İade Edildi"), iso("arrival")).otherwise("")
    total = F.round(F.col("q").cast("decimal(10,0)") * F.col("price") * (1 - F.col("d")), 2).cast("decimal(18,2)")
    o = o.select(i, F.format_string("M%05d", F.col("who") + 1).alias("musteri_id"), F.format_string("U%04d", F.col("what") + 1).alias("urun_id"), iso("date").alias("siparis_tarihi"), F.col("q").cast("string").alias("adet"), F.col("price").cast("string").alias("birim_fiyat"), F.col("d").cast("string").alias("indirim_orani"), total.cast("string").alias("toplam_tutar"), choice(OPTIONS["odeme_yontemi"], seed, "pay", i).alias("odeme_yontemi"), choice(OPTIONS["kargo_firmasi"], seed, "carrier", i).alias("kargo_firmasi"), later.alias("teslim_tarihi"), "durum")
    o = numbered(o, "siparis_tarihi", "id", "n").select((F.col("n") - 1).alias("row_idx"), F.format_string("S%06d", "n").alias("siparis_id"), *[x for x in o.columns if x != "id"]).checkpoint()  # numbered once, not by every reader
    return {"musteriler": c, "urunler": p, "siparisler": o}


def _dates(v: Column) -> list[Column]:
    d = v.try_cast("date")
    f = lambda p: F.date_format(d, p)
    month = F.get(F.array(*[F.lit(m) for m in P.MONTHS]), F.month(d) - 1)
    english = F.get(F.array(*[F.lit(m.capitalize()) for m in P.ENGLISH_MONTHS]), F.month(d) - 1)
    return [f("dd/MM/yyyy"), f("dd.MM.yyyy"), f("dd.MM.yy"), F.concat_ws(" ", F.dayofmonth(d).cast("string"), month, f("yyyy")), f("yyyyMMdd"), F.concat(v, F.lit("T00:00:00")), f("MM/dd/yyyy"), f("yyyy/MM/dd"), F.concat_ws("-", f("dd"), english, f("yyyy")), F.concat_ws(" ", F.dayofmonth(d).cast("string"), T.lower(month), f("yy"))]


def out_of_domain(column: str, v: Column, u: Column) -> list[Column]:
    """Values that a column can't have; u in [0, 1) draws the amount. A delivery lies before its order."""
    dated = lambda first, years: F.concat((first + F.floor(u * years)).cast("string"), F.substr(v, F.lit(5)))
    if column == "dogum_tarihi":
        return [dated(1800, 100), dated(2030, 70)]
    if column == "siparis_tarihi":
        return [dated(2031, 15)]
    if column == "teslim_tarihi":
        return [F.date_format(F.date_sub(F.col("siparis_tarihi").try_cast("date"), (3 + F.floor(u * 38)).cast("int")), "yyyy-MM-dd")]
    return [F.concat(F.lit("-"), v), F.lit("9999"), F.lit("0")]


def wrong_total(v: Column, u: Column) -> Column:
    """The total without its discount, or off by a factor; null where that is the total."""
    exact = lambda x: x.try_cast("decimal(18,2)")
    plain = exact(F.col("adet")) * exact(F.col("birim_fiyat"))
    off = exact(v) * F.get(F.array(*[F.lit(x).cast("decimal(6,2)") for x in ("10", "0.1", "1.18", "2")]), F.floor(u * 4).cast("int"))
    new = F.round(F.when((exact(F.col("indirim_orani")) > 0) & (u < 0.6), plain).otherwise(off), 2).cast("decimal(18,2)")
    return F.when(F.abs(new - exact(v)) > 0.01, new.cast("string"))


def variants(kind: str, semantic: str, column: str, v: Column, u: Column) -> list[Column]:
    """The forms that a kind of corruption gives a cell of a semantic type; null where a form doesn't apply. u in [0, 1) draws amounts."""
    c, r = F.concat, lambda a, b: F.replace(v, F.lit(a), F.lit(b))
    grouped = F.format_number(v.try_cast("double"), 2)
    swapped = F.translate(grouped, ",.", ".,")
    ten = F.right(F.regexp_replace(v, r"\D", ""), F.lit(10))
    bare = F.regexp_replace(v, "^[A-Z]0*(?=.)", "")
    hundred = (v.try_cast("decimal(8,4)") * 100).cast("int").cast("string")
    if kind == "B3":
        return _dates(v)
    if kind == "B4":
        return [F.decode(F.encode(v, "UTF-8"), "ISO-8859-1"), F.translate(v, T._TURKISH, T._LATIN_ONLY), F.regexp_replace(v, "[çğıöşüÇĞİÖŞÜ]", "?")]
    if kind == "B5":
        return [F.lit(x) for x in ("", "NULL", "N/A", "-", "yok", "?", "Bilinmiyor")] + ([F.lit("0000-00-00")] if semantic == "date" else [])
    if kind == "B6":
        return [c(swapped, F.lit(" TL")), c(F.lit("₺"), grouped), r(".", ","), c(F.lit("TRY "), v), c(r(".", ","), F.lit("₺")), c(v, F.lit(" tl")), c(v, F.lit(" TL")), swapped] if semantic == "money" else [hundred, c(F.lit("%"), hundred), c(hundred, F.lit("%")), r(".", ","), c(F.lit("%"), hundred, F.lit(".0"))]
    if kind == "B7":
        return out_of_domain(column, v, u)
    if kind == "B12":
        return [wrong_total(v, u)]
    if kind == "B8" and semantic == "province":
        plate = F.array_position(F.array(*[F.lit(x) for x in PROVINCES]), v).cast("string")
        return [plate, F.lpad(plate, 2, "0"), T.upper(v), T.lower(v), c(T.upper(F.left(v, F.lit(3))), F.lit(".")), T.fold(v)]
    if kind == "B8":
        short = [F.when(v == full, s).otherwise(T.upper(v)) for s, full in SYNONYMS.get(column, {}).items()]
        return [T.upper(v), T.lower(v), T.upper(T.fold(v)), *short]
    if kind == "B9":
        return [ten, c(F.lit("0"), ten), c(F.lit("+90"), ten), c(F.lit("0 ("), F.left(ten, F.lit(3)), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4)), c(F.lit("90 "), F.left(ten, F.lit(3)), F.lit(" "), F.substring(ten, 4, 3), F.lit(" "), F.substring(ten, 7, 4)), c(F.lit("+90("), F.left(ten, F.lit(3)), F.lit(")"), F.substring(ten, 4, 7)), F.concat_ws("-", F.left(ten, F.lit(3)), F.substring(ten, 4, 3), F.substring(ten, 7, 4))]
    if kind == "B10":
        misspelt = [F.when(v.endswith(good), c(F.substring_index(v, "@", 1), F.lit("@"), F.get(F.array(*[F.lit(x) for x in bad]), F.floor(u * len(bad)).cast("int")))) for good, bad in DOMAINS.items()]
        return [F.coalesce(*misspelt, F.upper(v)), F.upper(v), r("@", "@@"), r(".com", ",com"), c(F.lit(" "), v), F.replace(v, F.lit("@"), F.lit(""))]
    if kind == "B11":
        return [c(F.lit("  "), v), c(v, F.lit("\t")), r(" ", "   "), c(F.lit("​"), v), c(v, F.lit(" "))]
    if kind == "B13":
        return [c(F.lit("#"), bare), F.lower(v), c(F.substring(v, 1, 1), F.lit("-"), F.substr(v, F.lit(2))), c(F.substring(v, 1, 1), bare), bare]
    if kind == "B15":
        return [c(v, F.lit(" adet")), c(F.lit("x"), v), c(v, F.lit(",0")), c(v, F.lit(".0")), c(v, F.lit(" ad.")), F.coalesce(F.get(F.array(*[F.lit(w) for w in P.NUMBER_WORDS]), v.try_cast("int") - 1), v)]
    raise ValueError(kind)


def corrupted(clean: DataFrame, table: str, seed: int = 8, plan: dict = PLAN, factor: float = 1.0, new_forms: bool = False, sold: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dirty table, log). Each cell is damaged once at most, by the first kind whose draw hits; blanks get placeholders only and keys stay.

    plan: table -> column -> {kind: share}; factor multiplies all shares; new_forms takes the unseen catalogue where it has a kind. The log has
    (tablo, anahtar, sutun, bozma, gercek, bozuk, kurtarilabilir). What no other cell implies can't be recovered: see LOST; two losses of TOGETHER in one order; a province whose
    district is gone too; a price of a product that isn't sold, if sold (urun_id) is given; a placeholder for a delivery that took place.
    """
    key, marked = F.col(KEYS[table]), clean
    for column, shares in plan[table].items():
        semantic, v, edge = TABLES[table][column], F.col(column), 0.0
        draw, new, kind = uniform(seed, table, column, key), F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, share in shares.items():
            hit = (draw >= edge) & (draw < edge + share * factor) & ((v != "") if name != "B5" else v.isNotNull()) & (key != v)
            forms = (unseen.variants(name, semantic, column, v) if new_forms else None) or variants(name, semantic, column, v, uniform(seed, "amount", table, column, key))
            form = choice(forms, seed, table, column, name, key)
            new, kind = F.when(hit, form).otherwise(new), F.when(hit, name).otherwise(kind)
            edge += share * factor
        changed = new.isNotNull() & (new != v)
        marked = marked.withColumns({f"n_{column}": F.coalesce(new, v), f"k_{column}": F.when(changed, kind)})
    touched = list(plan[table])
    is_kind = lambda c, k: F.coalesce(F.col(f"k_{c}") == k, F.lit(False)) if c in touched else F.lit(False)
    losses = sum((is_kind(c, k).cast("int") for c, k in TOGETHER), F.lit(0)) if table == "siparisler" else F.lit(0)

    def known(c: str) -> Column:
        """Whether the cell's value can still be told."""
        gone = [is_kind(c, k) for x, k in LOST[table] if x == c]
        gone += [is_kind(c, k) & (losses > 1) for x, k in TOGETHER if x == c and table == "siparisler"]
        if c == "il":
            gone.append(is_kind("il", "B5") & is_kind("ilce", "B5"))
        if c == "teslim_tarihi":
            gone.append(is_kind(c, "B5") & (F.col(c) != ""))
        if table == "urunler" and c == "birim_fiyat" and sold is not None:
            gone.append(is_kind(c, "B5") & F.col("__sold").isNull())
        none = F.lit(False)
        for test in gone:
            none = none | test
        return ~none

    told = marked
    if table == "urunler" and sold is not None:
        told = marked.join(sold.select(F.col("urun_id").alias("__u"), F.lit(True).alias("__sold")).distinct(), F.col("urun_id") == F.col("__u"), "left")
    entries = [F.when(F.col(f"k_{c}").isNotNull(), F.struct(F.lit(c).alias("sutun"), F.col(f"k_{c}").alias("bozma"), F.col(c).alias("gercek"), F.col(f"n_{c}").alias("bozuk"), known(c).alias("kurtarilabilir"))) for c in touched]
    log = told.select(F.lit(table).alias("tablo"), key.alias("anahtar"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select("tablo", "anahtar", "e.*")
    return marked.select("row_idx", *[(F.col(f"n_{c}") if c in touched else F.col(c)).alias(c) for c in TABLES[table]]), log


def repeated_orders(dirty: DataFrame, seed: int = 8, share: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(orders with some rows twice, log of B2)."""
    again = dirty.where(uniform(seed, "B2", F.col("siparis_id")) < share)
    rows = dirty.withColumn("row_idx", F.col("row_idx") * 2).unionByName(again.withColumn("row_idx", F.col("row_idx") * 2 + 1))
    return rows, again.select(F.lit("siparisler").alias("tablo"), F.col("siparis_id").alias("anahtar"), F.lit("*satir*").alias("sutun"), F.lit("B2").alias("bozma"), F.lit("").alias("gercek"), F.lit("").alias("bozuk"), F.lit(True).alias("kurtarilabilir"))


def repeated_customers(clean: DataFrame, orders: DataFrame, seed: int = 8, share: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(customers with altered twins, orders of which some point to twins, truth (tekrar_id, asil_id), log of B1: a row for each twin, a cell for each order that points to one)."""
    number = F.regexp_extract("musteri_id", r"(\d+)$", 1).cast("long")
    last = clean.agg(F.max(F.struct(number.alias("n"), "row_idx"))).first()[0]
    last, rows = (last["n"], clean.agg(F.max("row_idx")).first()[0] + 1) if last else (0, 0)
    # one twin, or two for a fifth of them; a twin's number is its original's beyond the last one
    twice = F.explode(F.sequence(F.lit(1), F.when(uniform(seed, "twice", F.col("musteri_id")) < 0.8, 1).otherwise(2))).alias("t")
    picked = clean.where(uniform(seed, "B1", F.col("musteri_id")) < share).select("*", twice).withColumn("n", number + last * F.col("t"))
    twins = picked.withColumns({"asil_id": F.col("musteri_id"), "musteri_id": F.format_string("M%05d", "n"), "row_idx": F.col("row_idx") + rows * F.col("t")})
    truth = twins.select(F.col("musteri_id").alias("tekrar_id"), "asil_id")
    lost = uniform(seed, "lost", F.col("asil_id")) < 0.5
    altered = twins.withColumn("telefon", F.when(lost, "").otherwise(F.col("telefon"))).withColumn("ad", T.upper(F.col("ad")))
    moved = orders.join(truth.groupBy(F.col("asil_id").alias("a")).agg(F.min("tekrar_id").alias("tekrar_id")), F.col("musteri_id") == F.col("a"), "left")
    moved = moved.withColumn("__to", F.when(uniform(seed, "move", F.col("siparis_id")) < 0.4, F.col("tekrar_id")))
    entry = lambda table, key, column, true, now: (F.lit(table).alias("tablo"), key.alias("anahtar"), F.lit(column).alias("sutun"), F.lit("B1").alias("bozma"), true.alias("gercek"), now.alias("bozuk"), F.lit(True).alias("kurtarilabilir"))
    log = truth.select(*entry("musteriler", F.col("tekrar_id"), "*satir*", F.col("asil_id"), F.col("tekrar_id")))
    log = log.unionByName(moved.where("__to is not null").select(*entry("siparisler", F.col("siparis_id"), "musteri_id", F.col("musteri_id"), F.col("__to"))))
    moved = moved.withColumn("musteri_id", F.coalesce("__to", "musteri_id")).drop("a", "tekrar_id", "__to")
    return clean.unionByName(altered.select(*clean.columns)), moved, truth, log


#: Rows among which a glued row finds its follower.
NEIGHBOURS = 1024


def as_lines(dirty: DataFrame, table: str, seed: int = 8, share: float = 0.01, new_forms: bool = False) -> tuple[DataFrame, DataFrame]:
    """((line_no, line), log of B14): rows as text, some with semicolons, with an empty field too many, or, for orders, with the next row on the same line.

    new_forms: with tabs, with bars, or quoted with a comma at the end. Rows with separators or quotes in their cells are broken in no way but by glueing. Followers are looked for among NEIGHBOURS rows.
    """
    key, columns = F.col(KEYS[table]), [F.col(c) for c in TABLES[table]]
    quoted = [F.when(c.rlike('[",]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in columns]
    free = ~F.concat(*columns).rlike('[",;|\t]')
    draw = uniform(seed, "B14", key, F.col("row_idx"))
    line = F.concat_ws(",", *quoted)
    if new_forms:
        forms = [F.concat_ws("\t", *columns), F.concat_ws("|", *columns), F.concat(F.lit('"'), F.concat_ws('","', *columns), F.lit('",'))]
    else:
        forms = [F.concat_ws(";", *columns), F.concat_ws(",", *quoted[:2], F.lit(""), *quoted[2:])]
    glued = table == "siparisler" and not new_forms
    ways = len(forms) + glued
    way = F.when(draw < share, F.floor(draw / share * ways).cast("int"))
    marked = dirty.select("row_idx", key.alias("anahtar"), line.alias("line"), F.when(free, F.get(F.array(*forms), way)).alias("broken"), (F.coalesce(way, F.lit(-1)) == len(forms)).alias("glues") if glued else F.lit(False).alias("glues"))
    if glued:
        near = Window.partitionBy(F.floor(F.col("row_idx") / NEIGHBOURS)).orderBy("row_idx")
        before = lambda n: F.lag("glues", n, False).over(near)
        marked = marked.withColumns({"next": F.lead("line").over(near), "taken": before(1) & ~before(2), "drawn": before(1)})
        marked = marked.withColumn("first", F.col("glues") & ~F.col("drawn") & F.col("next").isNotNull())
        marked = marked.withColumn("broken", F.when(F.col("first"), F.concat("line", "next")).when(~F.col("taken"), F.col("broken")))
        hurt = F.col("broken").isNotNull() | F.col("taken")
    else:
        marked, hurt = marked.withColumn("taken", F.lit(False)), F.col("broken").isNotNull()
    log = marked.where(hurt).select(F.lit(table).alias("tablo"), "anahtar", F.lit("*satir*").alias("sutun"), F.lit("B14").alias("bozma"), F.lit("").alias("gercek"), F.coalesce("broken", F.lit("")).alias("bozuk"), F.lit(True).alias("kurtarilabilir"))
    return marked.where(~F.col("taken")).select(F.col("row_idx").alias("line_no"), F.coalesce("broken", "line").alias("line")), log
