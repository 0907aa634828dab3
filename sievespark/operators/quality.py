"""Scoring repairs cell by cell against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievespark.plans.schema import KEYS, TABLES

OUTCOMES = ("correct", "blank", "wrong", "row_missing")


def comparable(value: Column, kind: str) -> Column:
    """Text under which two cells of a semantic type are equal if their values are; null for a blank."""
    v = F.trim(value.cast("string"))
    v = F.when(v != "", v)
    if kind in ("money", "ratio"):
        return F.coalesce(F.round(v.try_cast("decimal(24,6)"), 2).cast("decimal(20,2)").cast("string"), v)
    if kind == "count":
        n = v.try_cast("decimal(24,6)")
        return F.coalesce(F.when(n == F.floor(n), n.cast("decimal(20,0)").cast("string")), v)
    if kind == "date":
        return F.coalesce(F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd").cast("string"), v)
    return v


def code_number(code: Column) -> Column:
    """The number of a code such as B12, for the order of codes."""
    return F.regexp_extract(code, r"(\d+)$", 1).try_cast("int")


def cell_outcomes(truth: DataFrame, clean: DataFrame, log: DataFrame, table: str, order: str | None = None, sample: DataFrame | None = None) -> DataFrame:
    """(table, key, column, corruption, recoverable, truth_blank, outcome, truth, clean) for each cell of the truth besides its key.

    log: (tablo, anahtar, sutun, bozma, kurtarilabilir boolean); the cell's last entry counts, by sira if the log has it, else by the code's number; cells without one
    are "temiz" and recoverable. Of clean rows with one key the first by `order` counts (without it the smallest row). sample: (key) of the rows to score, all if None.
    Rows are joined by their keys and only then taken apart into cells.
    """
    key, columns = KEYS[table], {c: k for c, k in TABLES[table].items() if c != KEYS[table]}
    wanted = truth if sample is None else truth.join(sample.select(F.col("key").alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_semi")
    t = wanted.select(F.col(key).alias("key"), F.struct(*[comparable(F.col(c), k).alias(c) for c, k in columns.items()]).alias("t"))
    row = F.struct(*[comparable(F.col(c), k).alias(c) for c, k in columns.items()])
    c = clean.groupBy(F.col(key).alias("k")).agg(F.min_by(row, order).alias("c") if order else F.min(row).alias("c"))
    place = F.struct(F.col("sira") if "sira" in log.columns else F.lit(0), code_number(F.col("bozma")), "bozma")
    entries = log.where(F.col("tablo") == table).groupBy(F.col("anahtar").alias("lk"), "sutun").agg(F.max_by(F.struct("bozma", "kurtarilabilir"), place).alias("e"))
    entries = entries.groupBy("lk").agg(F.map_from_entries(F.collect_list(F.struct("sutun", "e"))).alias("log"))
    joined = t.join(c, F.col("key") == F.col("k"), "left").join(entries, F.col("key") == F.col("lk"), "left")
    each = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"t.{name}").alias("truth"), F.col(f"c.{name}").alias("clean"), F.try_element_at("log", F.lit(name)).alias("e")) for name in columns])
    cells = joined.select("key", F.col("k").isNotNull().alias("found"), F.explode(each).alias("x")).select("key", "found", "x.*")
    outcome = F.when(~F.col("found"), "row_missing").when(F.col("clean").eqNullSafe(F.col("truth")), "correct").when(F.col("clean").isNull(), "blank").otherwise("wrong")
    return cells.select(F.lit(table).alias("table"), "key", "column", F.coalesce("e.bozma", F.lit("temiz")).alias("corruption"), F.coalesce("e.kurtarilabilir", F.lit(True)).alias("recoverable"), F.col("truth").isNull().alias("truth_blank"), outcome.alias("outcome"), "truth", "clean")


def rates(outcomes: DataFrame, *by: str) -> DataFrame:
    """n and the share of each outcome, by groups or over all; shares are 0 where there are no cells."""
    share = lambda o: F.coalesce(F.avg((F.col("outcome") == o).cast("double")), F.lit(0.0)).alias(o)
    return outcomes.groupBy(*by).agg(F.count("*").alias("n"), *[share(o) for o in OUTCOMES])


def summaries(outcomes: DataFrame) -> DataFrame:
    """Rates by (recoverable, corruption) and by (table, column) in one pass over the cells; scope tells which."""
    share = ", ".join(f"avg(cast(outcome = '{o}' as double)) {o}" for o in OUTCOMES)
    return outcomes.sparkSession.sql(
        f"select case when grouping(corruption) = 0 then 'corruption' else 'column' end scope, recoverable, corruption, `table`, `column`, count(*) n, {share} from {{cells}} "
        "group by grouping sets ((recoverable, corruption), (`table`, `column`))",
        cells=outcomes,
    )


def fabrication(outcomes: DataFrame) -> DataFrame:
    """One row: wrong values where nothing can be known, over the cells where nothing can. A cell that is unrecoverable and blank in truth counts twice."""
    dirty = F.col("corruption") != "temiz"
    hard, blank = (dirty & ~F.col("recoverable")).cast("int"), F.col("truth_blank").cast("int")
    wrong = (F.col("outcome") == "wrong").cast("int")
    n = outcomes.agg(F.coalesce(F.sum((hard + blank) * wrong), F.lit(0)).alias("fabricated"), F.coalesce(F.sum(hard + blank), F.lit(0)).alias("cells"))
    return n.withColumn("rate", F.when(F.col("cells") > 0, F.col("fabricated") / F.when(F.col("cells") > 0, F.col("cells"))).otherwise(0.0))


def row_summary(truth: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """One row: truth, found, extra and repeated rows of the clean table by key."""
    t, c = truth.select(key).distinct(), clean.groupBy(key).count()
    both = t.withColumn("t", F.lit(1)).join(c, key, "full")
    one = lambda test: F.coalesce(F.sum(test.cast("int")), F.lit(0))
    return both.agg(one(F.col("t").isNotNull()).alias("truth_rows"), one(F.col("t").isNotNull() & F.col("count").isNotNull()).alias("found"), one(F.col("t").isNull()).alias("extra"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("repeated"))


def row_success(clean: DataFrame, log: DataFrame, key: str, sample: DataFrame | None = None) -> DataFrame:
    """(corruption, n, success): repeated rows (B2) must be left once, broken ones (B14) at least once. sample: (key) of the rows to score, all if None."""
    log = log if sample is None else log.join(sample.select(F.col("key").alias("__key")).distinct(), F.col("anahtar") == F.col("__key"), "left_semi")
    rows = log.where("sutun = '*satir*' and bozma in ('B2', 'B14')").select("bozma", F.col("anahtar").alias("k")).distinct()
    found = rows.join(clean.groupBy(F.col(key).alias("k")).count(), "k", "left")
    ok = F.when(F.col("bozma") == "B2", F.coalesce("count", F.lit(0)) == 1).otherwise(F.coalesce("count", F.lit(0)) >= 1)
    return found.groupBy(F.col("bozma").alias("corruption")).agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("success"))


def issue_statistics(log: DataFrame) -> DataFrame:
    return log.groupBy("tablo", "islem").agg(F.count("*").alias("n"))


def scorecard(cells: DataFrame, pairs: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(place, measure, detail, n, value): what a reader of the scores wants first, ordered by place.

    corrected: share of the n damaged cells that can be recovered and are right. fabricated: n wrong values where nothing can be known, and their rate. clean_damaged: share of
    the n undamaged cells that aren't right. pairs_f1 from pair_scores and recovered_rows from row_success, if given. corrected_kind: the first one by kind, in the order of the codes' numbers.
    """
    right = F.count_if(F.col("outcome") == "correct")
    groups = cells.groupBy("recoverable", "corruption").agg(F.count("*").alias("n"), right.alias("right"))
    dirty = F.col("corruption") != "temiz"
    share = lambda a: F.when(F.col("n") > 0, a / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)
    entry = lambda place, measure, detail, value: (place.alias("place"), F.lit(measure).alias("measure"), detail.alias("detail"), F.col("n").cast("long").alias("n"), value.cast("double").alias("value"))
    none = F.lit("")
    total = lambda test: groups.where(test).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"))
    out = total(dirty & F.col("recoverable")).select(*entry(F.lit(1), "corrected", none, share(F.col("right"))))
    out = out.unionByName(fabrication(cells).withColumn("n", F.col("fabricated")).select(*entry(F.lit(2), "fabricated", none, F.col("rate"))))
    out = out.unionByName(total(~dirty).select(*entry(F.lit(3), "clean_damaged", none, share(F.col("n") - F.col("right")))))
    if pairs is not None:
        out = out.unionByName(pairs.withColumn("n", F.col("true_pairs")).select(*entry(F.lit(4), "pairs_f1", none, F.col("f1"))))
    if rows is not None:
        out = out.unionByName(rows.select(*entry(F.lit(5), "recovered_rows", F.col("corruption"), F.col("success"))))
    kinds = groups.where(dirty & F.col("recoverable")).select(*entry(10 + F.coalesce(code_number(F.col("corruption")), F.lit(0)), "corrected_kind", F.col("corruption"), share(F.col("right"))))
    return out.unionByName(kinds).orderBy("place", "detail")


def error_sample(outcomes: DataFrame, log: DataFrame, n: int = 500) -> DataFrame:
    """The first n wrong or blank cells by key and column, with the corrupted text. A blank where nothing can be known is no error."""
    bad = outcomes.where((F.col("outcome") == "wrong") | ((F.col("outcome") == "blank") & F.col("recoverable")))
    text = log.select(F.col("tablo").alias("t"), F.col("anahtar").alias("k"), F.col("sutun").alias("c"), F.col("bozuk").alias("corrupted"))
    return bad.join(text, (F.col("table") == F.col("t")) & (F.col("key") == F.col("k")) & (F.col("column") == F.col("c")), "left").drop("t", "k", "c").orderBy("table", "key", "column").limit(n)
