"""The three tables of the shop: columns, semantic types, keys and identifier formats. Column names are data and stay as the exports have them."""

from __future__ import annotations

from pyspark.sql import types as T

#: Table -> column -> semantic type.
TABLES = {
    "musteriler": {"musteri_id": "id", "ad": "name", "soyad": "name", "eposta": "email", "telefon": "phone", "dogum_tarihi": "date", "cinsiyet": "option", "il": "province", "ilce": "district", "kayit_tarihi": "date"},
    "urunler": {"urun_id": "id", "urun_adi": "text", "kategori": "option", "marka": "text", "birim_fiyat": "money"},
    "siparisler": {"siparis_id": "id", "musteri_id": "ref", "urun_id": "ref", "siparis_tarihi": "date", "adet": "count", "birim_fiyat": "money", "indirim_orani": "ratio", "toplam_tutar": "money", "odeme_yontemi": "option", "kargo_firmasi": "option", "teslim_tarihi": "date", "durum": "option"},
}
KEYS = {"musteriler": "musteri_id", "urunler": "urun_id", "siparisler": "siparis_id"}
ID_FORMATS = {"musteri_id": ("M", 5), "urun_id": ("U", 4), "siparis_id": ("S", 6)}
#: The closed lists of the option columns.
OPTIONS = {
    "cinsiyet": ["Kadın", "Erkek"],
    "kategori": ["Elektronik", "Giyim", "Ev & Yaşam", "Kozmetik", "Kitap", "Spor & Outdoor", "Oyuncak", "Süpermarket"],
    "odeme_yontemi": ["Kredi Kartı", "Banka Kartı", "Havale/EFT", "Kapıda Ödeme", "Dijital Cüzdan"],
    "kargo_firmasi": ["Yurtiçi Kargo", "Aras Kargo", "MNG Kargo", "PTT Kargo", "Sürat Kargo", "Trendyol Express", "HepsiJet"],
    "durum": ["Teslim Edildi", "Kargoda", "Hazırlanıyor", "İptal Edildi", "İade Edildi"],
}
#: Short forms and foreign words that stand for an option, as the exports have them.
SYNONYMS = {
    "cinsiyet": {"k": "Kadın", "bayan": "Kadın", "f": "Kadın", "e": "Erkek", "bay": "Erkek", "m": "Erkek"},
    "durum": {"teslim": "Teslim Edildi", "iptal": "İptal Edildi", "iade": "İade Edildi", "delivered": "Teslim Edildi", "cancelled": "İptal Edildi", "returned": "İade Edildi", "shipped": "Kargoda"},
    "odeme_yontemi": {"kk": "Kredi Kartı", "havale": "Havale/EFT", "eft": "Havale/EFT", "kapida": "Kapıda Ödeme"},
    "kategori": {"market": "Süpermarket"},
}
#: Provinces in the order of their plate codes, from 1.
PROVINCES = [
    "Adana", "Adıyaman", "Afyonkarahisar", "Ağrı", "Amasya", "Ankara", "Antalya", "Artvin", "Aydın",
    "Balıkesir", "Bilecik", "Bingöl", "Bitlis", "Bolu", "Burdur", "Bursa", "Çanakkale", "Çankırı",
    "Çorum", "Denizli", "Diyarbakır", "Edirne", "Elazığ", "Erzincan", "Erzurum", "Eskişehir", "Gaziantep",
    "Giresun", "Gümüşhane", "Hakkari", "Hatay", "Isparta", "Mersin", "İstanbul", "İzmir", "Kars",
    "Kastamonu", "Kayseri", "Kırklareli", "Kırşehir", "Kocaeli", "Konya", "Kütahya", "Malatya", "Manisa",
    "Kahramanmaraş", "Mardin", "Muğla", "Muş", "Nevşehir", "Niğde", "Ordu", "Rize", "Sakarya",
    "Samsun", "Siirt", "Sinop", "Sivas", "Tekirdağ", "Tokat", "Trabzon", "Tunceli", "Şanlıurfa",
    "Uşak", "Van", "Yozgat", "Zonguldak", "Aksaray", "Bayburt", "Karaman", "Kırıkkale", "Batman",
    "Şırnak", "Bartın", "Ardahan", "Iğdır", "Yalova", "Karabük", "Kilis", "Osmaniye", "Düzce",
]
#: The districts that occur, by province.
DISTRICTS = {
    "İstanbul": ["Kadıköy", "Beşiktaş", "Üsküdar", "Şişli", "Bakırköy", "Ataşehir", "Maltepe", "Pendik", "Esenyurt", "Bahçelievler", "Beylikdüzü", "Sarıyer", "Kartal", "Ümraniye", "Fatih", "Beyoğlu", "Başakşehir", "Küçükçekmece"],
    "Ankara": ["Çankaya", "Keçiören", "Yenimahalle", "Mamak", "Etimesgut", "Sincan", "Altındağ", "Pursaklar", "Gölbaşı"],
    "İzmir": ["Karşıyaka", "Bornova", "Buca", "Konak", "Çiğli", "Bayraklı", "Karabağlar", "Gaziemir", "Menemen", "Torbalı"],
    "Bursa": ["Osmangazi", "Nilüfer", "Yıldırım", "İnegöl", "Gemlik", "Mudanya"],
    "Antalya": ["Muratpaşa", "Kepez", "Konyaaltı", "Alanya", "Manavgat"],
    "Adana": ["Seyhan", "Çukurova", "Yüreğir", "Sarıçam", "Ceyhan"],
    "Konya": ["Selçuklu", "Meram", "Karatay", "Akşehir"],
    "Gaziantep": ["Şahinbey", "Şehitkamil", "Nizip"],
    "Kocaeli": ["İzmit", "Gebze", "Darıca", "Körfez", "Gölcük"],
    "Mersin": ["Yenişehir", "Toroslar", "Akdeniz", "Mezitli", "Tarsus"],
    "Kayseri": ["Melikgazi", "Kocasinan", "Talas"],
    "Eskişehir": ["Odunpazarı", "Tepebaşı"],
    "Diyarbakır": ["Bağlar", "Kayapınar", "Bismil"],
    "Samsun": ["Atakum", "İlkadım", "Canik", "Bafra"],
    "Denizli": ["Pamukkale", "Merkezefendi", "Çivril"],
    "Trabzon": ["Ortahisar", "Akçaabat", "Of"],
    "Tekirdağ": ["Süleymanpaşa", "Çorlu", "Çerkezköy"],
    "Muğla": ["Bodrum", "Fethiye", "Marmaris", "Menteşe"],
    "Sakarya": ["Adapazarı", "Serdivan", "Erenler"],
    "Manisa": ["Yunusemre", "Şehzadeler", "Akhisar", "Turgutlu"],
    "Aydın": ["Efeler", "Kuşadası", "Nazilli", "Didim"],
    "Balıkesir": ["Karesi", "Altıeylül", "Bandırma", "Edremit"],
    "Hatay": ["Antakya", "İskenderun", "Defne"],
    "Malatya": ["Battalgazi", "Yeşilyurt"],
}
PROVINCE_OF = {district: province for province, districts in DISTRICTS.items() for district in districts}
#: Bounds [low, high) of dates (the shop's first year, the day of the extract), the longest delivery in days, and what a count may be.
EARLIEST, EXTRACT = "2015-01-01", "2025-01-01"
BIRTHS = ("1920-01-01", "2010-12-31")
LONGEST_DELIVERY, COUNTS = 30, (1, 100)


def raw_schema(table: str) -> T.StructType:
    """All text; the semantic type is in each field's metadata."""
    return T.StructType([T.StructField(c, T.StringType(), True, {"semantic": k}) for c, k in TABLES[table].items()])
