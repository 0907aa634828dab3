"""Malformed delimited text: physical lines -> repaired records and a quarantine, all in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievespark.plans.schema import OPTIONS, TABLES

#: Fixed value: the reason in the quarantine.
REASON = "Alan sayısı uyuşmuyor"
#: Separators besides line feeds and carriage returns, at which a line is cut even inside quotes.
RARE_BREAKS = "[\u000b\u000c\u001c-\u001e\u0085  ]"
_ID_SHAPES = {"siparis_id": r"^S\d{6}$", "musteri_id": r"(?i)^#?m?-?\d{1,5}$", "urun_id": r"(?i)^#?u?-?\d{1,4}$"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of the text files at path, without byte order marks, blank lines and the header that every file begins with.

    line_no grows with the place in the input: files by their path, lines by their place in the file. It is a decimal of file, first byte of
    the split, row of the split and piece of the row, so that it neither overflows nor collides.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"))
    rows = rows.select("file", "block", "row", F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), RARE_BREAKS)).alias("piece", "line"))
    heads = rows.where("block = 0 and piece = 0").groupBy("file").agg(F.min("row").alias("head"))
    files = heads.select("file", "head", F.row_number().over(Window.orderBy("file")).alias("n"))  # one row a file
    body = rows.join(files, "file").where(~((F.col("block") == 0) & (F.col("row") == F.col("head")) & (F.col("piece") == 0)) & (F.trim("line") != ""))
    return body.select(_place(F.col("n"), (F.col("block"), 10**13), (F.col("row"), 10**10), (F.col("piece"), 10**6)).alias("line_no"), "line")


def _place(first: Column, *rest: tuple[Column, int]) -> Column:
    """One number for several, each of the rest being smaller than its bound."""
    out = first.cast("decimal(38,0)")
    for x, bound in rest:
        out = (out * F.lit(bound).cast("decimal(16,0)") + x).cast("decimal(38,0)")
    return out


def fields(line: Column, separator: str = ",") -> Column:
    """array<string>: quotes may hold separators, doubled quotes stand for one, an open quote takes the rest of the line."""
    raw = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(f'{separator}("(?:[^"]|"")*"?[^{separator}]*|[^{separator}]*)'), F.lit(1))
    inner = lambda x: F.regexp_replace(F.regexp_replace(x, '^"((?:[^"]|"")*)"?', "$1"), '""', '"')
    quoted = F.transform(raw, lambda x: F.when(x.startswith('"'), inner(x)).otherwise(x))
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, f"[{separator}]", -1))


def fitness(values: Column, table: str) -> Column:
    """How many values look right for their column: identifiers by shape, dates and numbers have a digit or are blank, options aren't bare numbers."""
    score = F.lit(0)
    for i, (column, kind) in enumerate(TABLES[table].items()):
        v = F.trim(F.get(values, F.lit(i)))
        if kind in ("id", "ref"):
            fits = v.rlike(_ID_SHAPES[column])
        elif kind in ("date", "money", "ratio", "count"):
            fits = (v == "") | v.rlike(r"\d")
        elif column in OPTIONS:
            fits = (v == "") | ~v.rlike(r"^[\d\W]+$")
        else:
            continue
        score = score + F.coalesce(fits.cast("int"), F.lit(0))
    return score


def parsed(lines: DataFrame, table: str) -> DataFrame:
    """Adds comma (the fields of the line) and records, array<array<string>>, null if the line can't be repaired.

    As it is; with semicolons for commas; without the empty field whose absence fits the columns best (the left one of equals); or, for orders, cut in
    two where the next record's identifier follows the last field. Each step is a projection of its own, so that no line is cut twice.
    """
    n = len(TABLES[table])
    cut = lines.withColumn("comma", fields(F.col("line"))).withColumn("size", F.size("comma"))
    other = F.when((F.col("size") < n) & (F.size(F.split("line", ";")) >= n), fields(F.col("line"), ";"))
    cut = cut.withColumn("semicolon", other)
    without = lambda i: F.concat(F.slice("comma", 1, i), F.slice("comma", i + 2, n))
    places = F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: F.get("comma", i) == "")
    tries = F.transform(places, lambda i: F.struct(without(i).alias("values"), (-i).alias("left")))
    cut = cut.withColumn("tries", F.when(F.col("size") == n + 1, tries))
    scored = F.transform("tries", lambda x: F.struct(fitness(x["values"], table).alias("fit"), x["left"].alias("left"), x["values"].alias("values")))
    cut = cut.withColumn("best", F.array_max(scored))
    out = F.when(F.col("size") == n, F.array("comma")).when(F.size("semicolon") == n, F.array("semicolon")).when(F.col("best").isNotNull(), F.array(F.col("best.values")))
    if table == "siparisler":
        glued = F.get("comma", F.lit(n - 1))
        shape = r"^(.*?)(S\d{6})$"
        first = F.concat(F.slice("comma", 1, n - 1), F.array(F.regexp_extract(glued, shape, 1)))
        second = F.concat(F.array(F.regexp_extract(glued, shape, 2)), F.slice("comma", n + 1, n - 1))
        out = out.when((F.col("size") == 2 * n - 1) & glued.rlike(shape), F.array(first, second))
    return cut.withColumn("records", out).drop("semicolon", "tries", "best")


def mended(table: str) -> Column:
    """Whether a parsed line's records took a repair."""
    return (F.size("records") > 1) | (F.col("size") != len(TABLES[table]))


def quarantined(cut: DataFrame, table: str) -> DataFrame:
    """(tablo, ham_satir, sebep) of the parsed lines that can't be repaired."""
    bad = cut.select(F.explode(F.when(F.col("records").isNull(), F.array("line"))).alias("ham_satir"))
    return bad.select(F.lit(table).alias("tablo"), "ham_satir", F.lit(REASON).alias("sebep"))


def ingest(lines: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of (line_no, line). Records have row_idx (line order), repaired (boolean) and the table's columns as text."""
    columns = list(TABLES[table])
    cut = parsed(lines, table)
    # exploding drops what is null; a filter would be pushed down and would cut every line again
    each = cut.select("line_no", mended(table).alias("repaired"), F.posexplode("records").alias("part", "r"))
    records = each.select((F.col("line_no") * 2 + F.col("part")).alias("row_idx"), "repaired", *[F.get("r", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return records, quarantined(cut, table)


def mentioned_ids(lines: DataFrame, pattern: str = r"S\d{6}") -> DataFrame:
    """(id): the distinct identifiers that raw lines mention, for drawing samples."""
    return lines.select(F.explode(F.regexp_extract_all("line", F.lit(f"({pattern})"), F.lit(1))).alias("id")).distinct()


def sampled_ids(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n of the ids, the same ones whenever the seed is."""
    return ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def lines_in_scope(lines: DataFrame, ids: DataFrame, pattern: str = r"S\d{6}") -> DataFrame:
    """Raw lines that mention any of the ids."""
    found = lines.select("line_no", F.explode(F.regexp_extract_all("line", F.lit(f"({pattern})"), F.lit(1))).alias("id")).join(ids, "id", "left_semi").select("line_no").distinct()
    return lines.join(found, "line_no", "left_semi")
