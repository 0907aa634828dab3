"""One damaged data set, cleaned in several ways and scored against the same truth."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievespark.operators import entity, quality
from sievespark.plans import cleaning, corrupt
from sievespark.sources import files
from sievespark.sources import lines as L


def damaged(truth: dict[str, DataFrame], seed: int = 8, factor: float = 1.0, new_forms: bool = False) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(raw tables as read back from their damaged lines, log, twins (tekrar_id, asil_id)) of the clean tables."""
    people, sold, twins, repeats = corrupt.repeated_customers(truth["musteriler"], truth["siparisler"], seed)
    raw, logs = {}, [repeats]
    for name, df in {"musteriler": people, "urunler": truth["urunler"], "siparisler": sold}.items():
        dirty, log = corrupt.corrupted(df, name, seed, factor=factor, new_forms=new_forms, sold=truth["siparisler"] if name == "urunler" else None)
        logs.append(log)
        if name == "siparisler":
            dirty, log = corrupt.repeated_orders(dirty, seed)
            logs.append(log)
        rows, log = corrupt.as_lines(cleaning.cut(dirty), name, seed, new_forms=new_forms)
        logs.append(log)
        raw[name] = cleaning.cut(L.ingest(cleaning.cut(rows), name)[0].drop("repaired"))
    return raw, cleaning.cut(reduce(DataFrame.unionByName, logs)), twins


def scored(got: cleaning.Cleaned, truth: dict[str, DataFrame], log: DataFrame, twins: DataFrame, sample: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cell outcomes, scorecard) of cleaned tables; sample: (key) of the orders to score, all if None."""
    tables = {"musteriler": got.customers, "urunler": got.products, "siparisler": got.orders}
    cells = [quality.cell_outcomes(truth[name], files.formatted(df, name), log, name, sample=sample if name == "siparisler" else None) for name, df in tables.items()]
    cells = cleaning.cut(reduce(DataFrame.unionByName, cells))
    pairs = entity.pair_scores(got.mapping, twins.select(F.col("tekrar_id").alias("old_id"), F.col("asil_id").alias("new_id")))
    return cells, quality.scorecard(cells, pairs, quality.row_success(got.orders, log.where("tablo = 'siparisler'"), "siparis_id"))


def compared(raw: dict[str, DataFrame], truth: dict[str, DataFrame], log: DataFrame, twins: DataFrame, resolvers: dict[str, cleaning.Resolver], sample: DataFrame | None = None) -> DataFrame:
    """(method, seconds, place, measure, detail, n, value): the scorecard of every resolver by name. Write it with files.write_report."""
    out = None
    for method, resolver in resolvers.items():
        began = time.monotonic()
        got = cleaning.clean(raw["musteriler"], raw["urunler"], raw["siparisler"], resolver)
        seconds = time.monotonic() - began
        card = cleaning.cut(scored(got, truth, log, twins, sample)[1]).select(F.lit(method).alias("method"), F.lit(seconds).alias("seconds"), "*")
        out = card if out is None else out.unionByName(card)
    return out
