"""Free text onto reference values: exact, synonym, wildcard, prefix and fuzzy steps, and dictionaries learnt from the data.

The values to match are made distinct first. Closed lists ride along as literal arrays, so every step is an expression over one
row of distinct values and nothing but those values is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievespark.functions import parsers as P
from sievespark.functions import similarity
from sievespark.functions import text as T
from sievespark.operators import similar
from sievespark.operators.joins import dealt

#: Steps in order, with the scores they give; a fuzzy match needs a least score and a lead over the second best.
EXACT, WILDCARD, PREFIX, REVERSE, LEAD = 100.0, 95.0, 90.0, 86.0, 5.0


def python_key(s: str) -> str:
    """text.key() for a constant."""
    low = s.replace("I", "ı").replace("İ", "i").lower().translate(str.maketrans(T.ACCENTED, T.PLAIN))
    return "".join(c for c in low if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def match(value: Column, options: list[str], synonyms: dict[str, str] | None = None, threshold: float = 85.0, top: int = 5) -> Column:
    """struct(value, score, candidates): the option that a text means, or null with the likeliest options.

    The first step that finds just one option decides: equal keys, a synonym, question marks as any letter, the beginning of one option,
    an option that the text begins with, and last the nearest by indel ratio if it is near enough and leads by LEAD.
    """
    names = F.array(*[F.lit(o) for o in options])
    keys = F.array(*[F.lit(python_key(o)) for o in options])
    by_key = F.create_map(*[F.lit(x) for o in options for x in (python_key(o), o)])
    known = by_key if not synonyms else F.map_concat(by_key, F.create_map(*[F.lit(x) for s, o in synonyms.items() if python_key(s) not in map(python_key, options) for x in (python_key(s), o)]))
    nothing = F.array().cast("array<string>")

    def bound(x: Column, body) -> Column:  # noqa: ANN001
        """body(x) with x evaluated once."""
        return F.get(F.transform(F.array(x), body), F.lit(0))

    def result(v: Column, score: Column, candidates: Column = nothing) -> Column:
        return F.struct(v.alias("value"), score.alias("score"), candidates.alias("candidates"))

    def only(hits: Column, score: float) -> Column:
        return bound(hits, lambda h: F.when(F.size(h) == 1, result(F.try_element_at(by_key, F.get(h, F.lit(0))), F.lit(score))))

    def likeliest(k: Column) -> Column:
        """All options if they are few, else the first by weighted ratio, then by their order. Keys are single words, so that ratio is the plain one or that of a window."""
        if len(options) <= 10:
            return names
        n = F.length(k)

        def score(x: Column) -> Column:
            m = F.length(x)
            scale = F.when(F.greatest(n, m) < similarity.MUCH_LONGER * F.least(n, m), similarity.WINDOW).otherwise(similarity.FAR)
            window = F.when(n <= m, similarity.best_window(k, x)).otherwise(similarity.best_window(x, k))
            plain = similarity.indel_ratio(k, x)
            return F.when(n == 0, 0.0).when(F.greatest(n, m) < similarity.LONGER * F.least(n, m), plain).otherwise(F.greatest(plain, scale * window))

        ranked = F.array_sort(F.transform(keys, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"))))
        return F.transform(F.slice(ranked, 1, top), lambda x: F.get(names, x["i"]))

    def fuzzy(k: Column) -> Column:
        # ranked by score, then by the order of the options
        ranked = F.array_sort(F.transform(keys, lambda x, i: F.struct((-similarity.indel_ratio(k, x)).alias("s"), i.alias("i"))))

        def decide(r: Column) -> Column:
            best, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
            near = (k != "") & (-best["s"] >= threshold) & (second.isNull() | (second["s"] - best["s"] >= LEAD))
            return F.when(near, result(F.get(names, best["i"]), -best["s"])).otherwise(result(F.lit(None).cast("string"), F.lit(0.0), likeliest(k)))

        return bound(ranked, decide)

    def steps(b: Column) -> Column:
        k, wild = b["k"], b["w"]
        exact = F.try_element_at(known, k)
        pattern = F.concat(F.lit("^"), F.replace(wild, F.lit("?"), F.lit(".")), F.lit("$"))
        jokers = F.filter(keys, lambda x: (F.length(x) == F.length(wild)) & F.regexp_like(x, pattern))
        long = F.length(k) >= 3
        return F.coalesce(  # the first that isn't null; later ones aren't evaluated
            F.when(exact.isNotNull(), result(exact, F.lit(EXACT))),
            F.when(wild.contains("?"), only(jokers, WILDCARD)),
            F.when(long, only(F.filter(keys, lambda x: x.startswith(k)), PREFIX)),
            F.when(long, only(F.filter(keys, lambda x: (F.length(x) >= 4) & k.startswith(x)), REVERSE)),
            fuzzy(k),
        )

    return F.when(value.isNotNull(), bound(F.struct(T.key(value).alias("k"), T.wildcard_key(value).alias("w")), steps))


def match_province(value: Column, provinces: list[str]) -> Column:
    """match() after a plate code, a trailing point and a remark in brackets."""
    bare = F.regexp_replace(F.trim(value), r"\.+$", "")
    code = F.when(bare.rlike(r"^\d{1,2}$"), bare.try_cast("int"))
    named = F.get(F.array(*[F.lit(p) for p in provinces]), code - 1)
    found = match(F.trim(F.regexp_replace(bare, r"\(.*?\)", "")), provinces)
    return F.when(named.isNotNull() & (F.length(bare) <= 2), F.struct(named.alias("value"), F.lit(EXACT).alias("score"), F.array().cast("array<string>").alias("candidates"))).otherwise(found)


#: Distinct values up to which their matches are sent to all tasks and the rows stay where they are.
SENT = 10_000


def matched(df: DataFrame, column: str, matcher) -> DataFrame:  # noqa: ANN001
    """Adds <column>_match, matching every distinct value once; nulls have none. A frequent value's rows don't meet in one task."""
    values = df.select(F.col(column).alias("__v")).where("__v is not null").groupBy("__v").agg(F.count("*").alias("n")).checkpoint()
    found = values.select("__v", matcher(F.col("__v")).alias(f"{column}_match"), "n").checkpoint()
    if found.count() <= SENT:
        return df.join(F.broadcast(found.drop("n")), F.col(column) == F.col("__v"), "left").drop("__v")
    some = dealt(df.where(F.col(column).isNotNull()).withColumn("__v", F.col(column)), found, ["__v"], F.xxhash64(*df.columns)).drop("__v")
    return some.unionByName(df.where(F.col(column).isNull()).withColumn(f"{column}_match", F.lit(None).cast(found.schema[f"{column}_match"].dataType)))


def onto(df: DataFrame, column: str, dictionary: DataFrame, threshold: float = 85.0, lead: float = LEAD) -> DataFrame:
    """Adds <column>_match, struct(value, score), from a dictionary (key, spelling) of any size, such as spellings() learns.

    Equal keys decide first, then question marks as any letter if one key fits, last the nearest key by indel ratio if it is near enough and leads. Each distinct value is matched once, by
    equi-joins only; a value without a match, a null or an empty one has null.
    """
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    values = values.select("v", T.key(F.col("v")).alias("text"), T.wildcard_key(F.col("v")).alias("wild")).checkpoint()
    known = dictionary.where("key <> ''").select("key", "spelling").checkpoint()
    exact = values.join(known, F.col("text") == F.col("key")).select("v", "spelling", F.lit(EXACT).alias("score"))
    rest = values.join(known, F.col("text") == F.col("key"), "left_anti")
    fitted = completions(rest.where(F.col("wild").contains("?")).select("wild").distinct(), known)
    filled = rest.join(fitted, "wild").select("v", "spelling", F.lit(WILDCARD).alias("score"))
    texts = rest.where(~F.col("wild").contains("?")).select("text").distinct().checkpoint()
    near = similar.nearest(texts, known.select("key"), threshold, lead).join(known, "key").join(rest.where(~F.col("wild").contains("?")), "text").select("v", "spelling", F.col("ratio").alias("score"))
    found = exact.unionByName(filled).unionByName(near).select(F.col("v").alias("__v"), F.struct(F.col("spelling").alias("value"), "score").alias(f"{column}_match"))
    return df.join(found, F.col(column) == F.col("__v"), "left").drop("__v")


def resolve_option(raw: Column, found: Column) -> Column:
    """struct(value, action, candidates) of a cell: a placeholder is null, a match its value, anything else uncertain."""
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    cell = lambda v, a, c: F.struct(v.alias("value"), a.alias("action"), c.alias("candidates"))
    return F.when(T.is_placeholder(raw), cell(none, none, empty)).when(found["value"].isNotNull(), cell(found["value"], F.when(found["value"] != raw, F.lit("duzeltildi")), empty)).otherwise(cell(none, F.lit("belirsiz"), found["candidates"]))


def spellings(df: DataFrame, column: str, order: str) -> DataFrame:
    """(key, spelling): the most frequent spelling of each comparison key, the first seen of equals. Values with a question mark don't count."""
    rows = df.where(F.col(column).isNotNull() & ~F.col(column).contains("?")).select(T.key(F.col(column)).alias("key"), F.col(column).alias("spelling"), F.col(order).alias("o"))
    counted = rows.groupBy("key", "spelling").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    return counted.groupBy("key").agg(F.min_by("spelling", F.struct(-F.col("n"), "o")).alias("spelling"))


def blanked(key: Column, mask: Column) -> Column:
    """The key with a question mark wherever the mask has one; both of one length."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(mask)), lambda i: F.when(F.substr(mask, i, F.lit(1)) == "?", "?").otherwise(F.substr(key, i, F.lit(1)))), "")


def completions(wild: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(wild, spelling) for the texts with question marks, distinct, that just one key of the dictionary (key, spelling) fits letter by letter.

    The places of the question marks are a text's mask. Keys are blanked by each mask of their length that occurs, once for all texts that share it, and the blanked keys, counted, meet the
    texts in an equi-join: no text meets keys that merely have its length, and a text of nothing but question marks, which all keys of its length fit, is one row after the count.
    """
    masked = wild.select("wild", F.regexp_replace("wild", r"[^?]", ".").alias("mask"))
    masks = masked.select("mask", F.length("mask").alias("n")).distinct()
    keys = dictionary.select("key", "spelling", F.length("key").alias("n"))
    once = keys.join(masks, "n").groupBy(blanked(F.col("key"), F.col("mask")).alias("wild")).agg(F.count("*").alias("fits"), F.min("spelling").alias("spelling"))
    return masked.join(once.where("fits = 1"), "wild").select("wild", "spelling")


def repair_words(df: DataFrame, column: str, order: str, titled: bool) -> DataFrame:
    """Adds <column>_words: each word in its key's usual spelling; titled words take a capital. A word with question marks becomes the only
    word of that length that fits; if there is none, or several, the cell is null, as placeholders are."""
    words = df.where(F.col(column).isNotNull() & ~T.is_placeholder(F.col(column))).select(F.col(order).alias("o"), F.posexplode(F.split(column, " ")).alias("pos", "word"))
    words = words.withColumn("word", F.when(F.lit(titled), T.title(F.col("word"))).otherwise(F.col("word")))
    usual = spellings(words.withColumn("seq", F.struct("o", "pos")), "word", "seq")
    plain = words.where(~F.col("word").contains("?")).withColumn("key", T.key(F.col("word"))).join(usual, "key", "left").select("o", "pos", F.coalesce("spelling", "word").alias("fixed"))
    damaged = words.where(F.col("word").contains("?")).withColumn("wild", T.wildcard_key(F.col("word")))
    found = completions(damaged.select("wild").distinct(), usual)
    mended = damaged.join(found, "wild", "left").select("o", "pos", F.col("spelling").alias("fixed"))
    every = plain.unionByName(mended).groupBy("o").agg(F.array_sort(F.collect_list(F.struct("pos", "fixed"))).alias("w"))
    whole = F.when(F.forall("w", lambda x: x["fixed"].isNotNull()), F.array_join(F.transform("w", lambda x: x["fixed"]), " "))
    return df.join(every.select(F.col("o").alias("__o"), whole.alias(f"{column}_words")), F.col(order) == F.col("__o"), "left").drop("__o")


def brand_from_name(df: DataFrame, name: str, brands: DataFrame) -> DataFrame:
    """Adds brand_found: the longest brand (key, spelling) whose key begins the name's key. Prefixes of the names meet the brands in an equi-join."""
    longest = brands.agg(F.max(F.length("key"))).first()[0] or 0
    keyed = df.select(F.col(name).alias("__n")).where("__n is not null").distinct().withColumn("k", T.key(F.col("__n")))
    cut = keyed.select("__n", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(1, longest))), lambda i: F.substr("k", F.lit(1), i)), lambda x: x != "")).alias("key")).distinct()
    found = cut.join(brands.where("key <> ''"), "key").groupBy("__n").agg(F.max_by("spelling", F.length("key")).alias("brand_found"))
    return df.join(found, F.col(name) == F.col("__n"), "left").drop("__n")


def usual_domains(df: DataFrame, column: str, order: str) -> list[str]:
    """E-mail domains of at least one per cent of the addresses and five of them, in the order they were first seen. The share bounds them to a hundred."""
    mails = df.where(~T.is_placeholder(F.col(column))).select(F.col(column).alias("m"), F.col(order).alias("o"))
    total = mails.count()
    domains = mails.where(F.col("m").contains("@")).groupBy(F.expr("substring(m, instr(m, '@') + 1)").alias("d")).agg(F.count("*").alias("n"), F.min("o").alias("o"))
    return [r["d"] for r in domains.where(F.col("n") >= max(5, total * 0.01)).orderBy("o").collect()]


def repair_email(prepared: Column, domains: list[str], threshold: float = 80.0) -> Column:
    """A valid address or null: a missing at sign goes before a usual domain, an unusual domain becomes the nearest usual one if near enough."""
    known = F.array(*[F.lit(d) for d in domains]).cast("array<string>")
    ends = F.get(F.filter(known, lambda d: prepared.endswith(d) & (F.length(prepared) > F.length(d))), F.lit(0))
    joined = F.when(~prepared.contains("@") & ends.isNotNull(), F.concat(F.substr(prepared, F.lit(1), F.length(prepared) - F.length(ends)), F.lit("@"), ends)).otherwise(prepared)
    at = F.instr(joined, "@")
    local, domain = F.substr(joined, F.lit(1), at - 1), F.substr(joined, at + 1)  # cut at the first sign: with two the address stays invalid
    near = F.array_max(F.transform(known, lambda d, i: F.struct(similarity.indel_ratio(domain, d).alias("s"), (-i).alias("i"))))
    moved = joined.contains("@") & ~F.array_contains(known, domain) & (near["s"] >= threshold)
    fixed = F.when(moved, F.concat(local, F.lit("@"), F.get(known, -near["i"]))).otherwise(joined)
    return F.when(P.is_email(fixed), fixed)


def top_k(df: DataFrame, by: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k rows of highest score in each group; ties go to the smaller value of tie."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
