"""Forms of damage that the cleaning rules weren't written for, to measure how far they carry beyond the known ones. Each form still tells its value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievespark.functions import parsers as P
from sievespark.functions import text as T

#: Placeholders, days from Monday, long prefixes of identifiers.
PLACEHOLDERS = ["Belirtilmemiş", "YOK", "#N/A", "(boş)", "unknown", "NONE", "—", "boş", "Bilgi yok"]
WEEKDAYS = ["Pazartesi", "Salı", "Çarşamba", "Perşembe", "Cuma", "Cumartesi", "Pazar"]
LONG_PREFIXES = {"M": "MUS", "U": "URN", "S": "SIP"}
#: What stands before and after a value of each column; {} is the value.
DRESSED = {
    "kategori": ["{} Ürünleri", "{} > Diğer", "Tüm {}"], "odeme_yontemi": ["{} ile", "{} (online)", "Ödeme: {}"], "kargo_firmasi": ["{} A.Ş.", "{} Hizmetleri", "{} Şubesi"], "durum": ["{} ✓", "Sipariş {}", "{} (sistem)"],
    "cinsiyet": ["{}.", "{} kişi", "({})"], "il": ["{} Merkez", "{} İli", "T.C. {}", "{}, Türkiye"], "ilce": ["{} İlçesi", "{} (ilçe)"],
}
_LETTERS = "çğıöşüÇĞİÖŞÜ"


def _plain(x: Column) -> Column:
    return x.cast("string")


def _named(names: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), i)


def _dates(v: Column) -> list[Column]:
    d = v.try_cast("date")
    f = lambda p: F.date_format(d, p)
    since = lambda day: F.datediff(d, F.lit(day).cast("date"))
    spoken = F.concat_ws(" ", f("d"), _named(P.MONTHS, F.month(d) - 1), f("yyyy"), _named(WEEKDAYS, F.weekday(d)))
    english = F.concat(_named([m.capitalize() for m in P.ENGLISH_MONTHS], F.month(d) - 1), F.lit(" "), f("d"), F.lit(", "), f("yyyy"))
    return [f("yyyy.MM.dd"), f("d.M.yyyy"), spoken, english, f("yyyy-M-d"), _plain(since("1970-01-01").cast("long") * 86400), _plain(since("1899-12-30")), F.concat(f("dd.MM.yyyy"), F.lit(" 14:32")), f("ddMMyyyy")]


def _money(v: Column) -> list[Column]:
    grouped = F.format_number(v.try_cast("double"), 2)
    whole, cents = F.substring_index(v, ".", 1), F.substring_index(v, ".", -1)
    s = F.format_string
    return [s("%s TL", F.translate(grouped, ",.", " ,")), s("%s TRY", v), s("TL %s", F.translate(grouped, ",.", ".,")), F.replace(grouped, F.lit(","), F.lit("'")), s("%s,%s Türk Lirası", whole, cents), s("%s TL %s kr", whole, cents), s("%s ₺ (KDV dahil)", v)]


def _ratios(v: Column) -> list[Column]:
    hundred = _plain((v.try_cast("decimal(8,4)") * 100).cast("int"))
    s = F.format_string
    return [s("yüzde %s", hundred), s("%%%s indirim", hundred), s("%s %%", hundred), s("%s/100", hundred), F.when(hundred == "0", "indirim yok").otherwise(s("-%%%s", hundred))]


def _phones(v: Column) -> list[Column]:
    ten = F.right(F.regexp_replace(v, r"\D", ""), F.lit(10))
    a, b, c, d = (F.substring(ten, at, n) for at, n in ((1, 3), (4, 3), (7, 2), (9, 2)))
    s = F.format_string
    return [s("0%s-%s-%s-%s", a, b, c, d), s("(0%s) %s%s%s", a, b, c, d), s("+90 %s %s%s%s (cep)", a, b, c, d), s("%s %s %s%s", a, b, c, d), s("0%s / cep", ten), s("+90-%s-%s-%s-%s", a, b, c, d), s("tel: 0%s", ten)]


def _addresses(v: Column) -> list[Column]:
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    s = F.format_string
    return [s("%s[at]%s", local, domain), s("%s @ %s", local, F.replace(domain, F.lit("."), F.lit(" . "))), s("mailto:%s", v), s("<%s>", v), s("%s.", v), s("%s@%s", local, F.substring_index(domain, ".", 1)), s('"%s"', v), s("%s(at)%s", local, domain)]


def variants(kind: str, semantic: str, column: str, v: Column) -> list[Column] | None:
    """The unseen forms of a kind for a cell of a semantic type; None if the kind has none of its own."""
    s = F.format_string
    if kind == "B3":
        return _dates(v)
    if kind == "B4":
        entities = v
        for letter in _LETTERS:
            entities = F.replace(entities, F.lit(letter), F.lit(f"&#{ord(letter)};"))
        return [entities, F.regexp_replace(v, f"[{_LETTERS}]", "_"), F.regexp_replace(v, f"[{_LETTERS}]", "�")]
    if kind == "B5":
        return [F.lit(x) for x in PLACEHOLDERS]
    if kind == "B6":
        return _money(v) if semantic == "money" else _ratios(v)
    if kind == "B8":
        return [s(form.replace("{}", "%s"), v) for form in DRESSED.get(column, ["{} (müşteri)"])] + ([s("%s.", T.upper(v))] if column not in DRESSED else [])
    if kind == "B9":
        return _phones(v)
    if kind == "B10":
        return _addresses(v)
    if kind == "B11":
        return [s("%s\r", v), s("　%s　", v), s("‎%s", v), s("%s­", v), F.replace(v, F.lit(" "), F.lit(" ​ "))]
    if kind == "B13":
        number, prefix = F.substr(v, F.lit(2)), F.left(v, F.lit(1))
        bare = F.regexp_replace(number, "^0+(?=.)", "")
        return [*[F.when(prefix == short, s(long + "-%s", number)) for short, long in LONG_PREFIXES.items()], s("%s %s", prefix, number), s("%s.0", v), F.lpad(bare, 7, "0"), s("%s/%s", prefix, bare)]
    if kind == "B15":
        word = F.coalesce(_named(P.NUMBER_WORDS, v.try_cast("int") - 1), v)
        return [s("%s ADET", v), s("%sx", v), s("%s tane", v), s("%s (adet)", v), s("Adet: %s", v), s("%s adet", word), s("%s (%s)", v, word)]
    return None
