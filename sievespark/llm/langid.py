"""Language identification by Bayesian fusion of evidence.

A naive Bayes model over hashed character trigrams gives the likelihood of a text in every language that the labelled documents
have, and in none of them: an undetermined text has trigrams of all buckets alike. A document is judged by the model of the other half of the
documents, so that its own label says nothing twice. What an item declares of itself (a page's lang attribute, a document's lang column) is a
noisy witness: its reliability, P(declared | language), is estimated over all items. Hosts have priors that are smoothed along the chain all -
address suffix - domain - host, with counts summed by groups and an item's own share taken out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm.common import broadcast_if_small, checkpointed, met, smallest, spare, table, values

#: Buckets of hashed trigrams, and the pseudo-count of a bucket.
BUCKETS, SMOOTHING = 1 << 14, 0.5
#: Languages with a model of their own, those of most documents; the documents of all others share the model OTHER. What no model explains is UNKNOWN.
LANGUAGES, OTHER, UNKNOWN = 255, "other", "und"
#: Labelled documents (those of smallest hash) that fit the temperature, one number by which all likelihoods are divided as neighbouring trigrams
#: aren't independent; and the temperatures tried.
LABELLED, TEMPERATURES = 20_000, 1.1 ** np.arange(64)
#: Weight of the level above in a host's, domain's or suffix's prior, in items; share of a prior that is spread evenly; and the posterior that an accepted item needs.
PRIOR_ITEMS, EVEN, ACCEPT = 5.0, 0.01, 0.5
#: Code points hashed at once, and rows of summed beliefs that are broadcast.
CHUNK, BROADCAST_ROWS = 1 << 20, 20_000

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"<[^<>]*>")


def visible_text(page: str | None) -> str:
    """What a reader sees of a page: no tags, scripts, styles or comments."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark that belongs to one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """The buckets of a lower-cased text's trigrams that have a letter in the middle; white space counts as one space."""
    line = f" {' '.join(text.lower().split())} "
    x = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    mid = x[1:-1]
    letter = _letters()[mid]
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (mid * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h >> np.uint32(18)) & np.uint32(BUCKETS - 1))[letter]


def half(text: Column) -> Column:
    """0 or 1 by the hash of the text, so that copies are in one half."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def trained(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, models) from all documents (text, lang) that declare a language; UNKNOWN comes last.

    models[k] has log P(bucket | language): k = 0 and 1 leave that half of the documents out, 2 has all. Counts are summed in tasks
    and then by Spark; what reaches the driver is a number for each bucket of LANGUAGES + 1 languages at most.
    """
    known = docs.where("lang is not null and text is not null").select("text", F.lower("lang").alias("lang"))
    ranked = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    names = [r["lang"] for r in ranked[:LANGUAGES]]
    named = F.when(F.col("lang").isin(names), F.col("lang")).otherwise(OTHER) if len(ranked) > LANGUAGES else F.col("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for text, lang, side in zip(*(values(c) for c in batch.columns), strict=True):
                own = sums.setdefault((lang, side), np.zeros(BUCKETS, np.int64))
                for at in range(0, len(text), CHUNK):
                    found = trigrams(text[at : at + CHUNK])
                    np.add.at(own, found, 1) if len(found) < 2000 else own.__iadd__(np.bincount(found, minlength=BUCKETS))
        for (lang, side), own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array([side] * len(used), pa.int32()), pa.array(used, pa.int64()), pa.array(own[used])], ["lang", "side", "bucket", "n"])

    counted = known.select("text", named.alias("lang"), half(F.col("text")).alias("side")).mapInArrow(run, "lang string, side int, bucket long, n long").groupBy("lang", "side", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return [], np.zeros((3, BUCKETS, 1))
    grid = np.zeros((2, BUCKETS, len(languages)))
    grid[counted["side"], counted["bucket"], np.searchsorted(languages, counted["lang"])] = counted["n"]
    seen = np.stack([grid[1], grid[0], grid.sum(0)]) + SMOOTHING
    models = np.log(seen / seen.sum(1, keepdims=True))
    return [*languages, UNKNOWN], np.concatenate([models, np.full((3, BUCKETS, 1), -np.log(BUCKETS))], 2)


def text_likelihoods(items: DataFrame, models: np.ndarray, pages: bool = False) -> DataFrame:
    """Replaces the column text by likelihood, the log-likelihood of each language; null without any trigram. Pages are judged by the model of all documents."""
    others = [c for c in items.columns if c != "text"]
    side = F.lit(2) if pages else half(F.col("text"))
    name = spare(items, "side")[0]
    ordered = items.select(*others, side.alias(name), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, k in zip(values(batch.column(len(others) + 1)), values(batch.column(len(others))), strict=True):
                text = visible_text(text) if pages else text or ""
                total, n = np.zeros(models.shape[2]), 0
                for at in range(0, len(text), CHUNK):
                    found = trigrams(text[at : at + CHUNK])
                    total += models[k][found].sum(0)
                    n += len(found)
                out.append(total.tolist() if n else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.list_(pa.float64()))], [*others, "likelihood"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-2])
    return ordered.mapInArrow(run, f"{kinds}, likelihood array<double>")


def temperature(items: DataFrame, languages: list[str]) -> float:
    """The temperature under which the texts of labelled documents tell their languages best."""
    labelled = items.where(F.col("doc_id").isNotNull() & F.col("likelihood").isNotNull() & F.col("declared").isin(languages))
    rows = smallest(labelled, F.xxhash64("text_hash", "doc_id"), LABELLED).select("declared", "likelihood").collect()
    if not rows:
        return 1.0
    logs, at = np.array([r["likelihood"] for r in rows]), np.array([languages.index(r["declared"]) for r in rows])
    logs -= logs.max(1, keepdims=True)
    fit = [(logs[np.arange(len(at)), at] / t - np.log(np.exp(logs / t).sum(1))).sum() for t in TEMPERATURES]
    return float(TEMPERATURES[int(np.argmax(fit))])


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address, lower-cased; null where it has none."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    return host, F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def declared_in_markup(page: Column) -> Column:
    """The primary language subtag of the html element's lang attribute, or null."""
    return F.lower(F.nullif(F.regexp_extract(page, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit("")))


def _normal(logs: Column) -> Column:
    """Log weights -> probabilities."""
    most = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - most))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, v: a + v))


def _sums(by: list[str], items: DataFrame, n: int) -> DataFrame:
    return items.groupBy(*by).agg(F.array(*[F.coalesce(F.sum(F.col("own")[i]), F.lit(0.0)) for i in range(n)]).alias("mass"), F.count("*").alias("n"))


def fused(items: DataFrame, languages: list[str], degrees: float = 1.0) -> DataFrame:
    """Adds lang (the likeliest), confidence (its posterior) and accepted to items (declared, suffix, domain, host, likelihood, ...).

    An item without any trigram, likeliest UNKNOWN, or less likely than ACCEPT in its best language, isn't accepted; without trigrams its lang is null.
    """
    n, salt = len(languages), F.col("text_hash")
    zero, flat = F.array(*[F.lit(0.0)] * n), F.array(*[F.lit(1.0 / n)] * n)
    has_text = F.col("likelihood").isNotNull()
    items = items.withColumn("likelihood", F.transform("likelihood", lambda x: x / degrees))
    items = items.withColumn("own", F.when(has_text, _normal(F.col("likelihood"))).otherwise(zero))
    items = checkpointed(items.withColumns({c: F.coalesce(c, F.lit("")) for c in ("declared", "suffix", "domain", "host")}))
    # the witness: how often a language's items declare this or that; saying nothing is no evidence
    said = checkpointed(_sums(["declared"], items, n))
    total = said.where("declared <> ''").agg(*[F.sum(F.col("mass")[i]).alias(f"l{i}") for i in range(n)]).first()
    heard = F.transform(F.array(*[(F.col("mass")[i] + 0.5) / F.lit((total[i] or 0.0) + 1.0 + 0.5 * n) for i in range(n)]), lambda x: F.log(x))
    channel = checkpointed(said.select("declared", F.when(F.col("declared") != "", heard).otherwise(zero).alias("witness"), "n"))
    joined = met(items, channel, ["declared"], salt, BROADCAST_ROWS)
    everywhere = said.agg(*[F.sum(F.col("mass")[i]).alias(f"l{i}") for i in range(n)]).first()
    joined = joined.withColumn("prior", _smoothed(F.array(*[F.lit(x or 0.0) for x in everywhere]), flat))
    for by in (["suffix"], ["suffix", "domain"], ["suffix", "domain", "host"]):
        joined = met(joined, checkpointed(_sums(by, items, n)), by, salt, BROADCAST_ROWS)
        joined = joined.withColumn("prior", _smoothed(F.col("mass"), F.col("prior"))).drop("mass")
    logs = F.transform(F.arrays_zip(F.coalesce("likelihood", zero).alias("a"), F.col("witness").alias("b"), F.col("prior").alias("c")), lambda z: z["a"] + z["b"] + F.log((1 - EVEN) * z["c"] + EVEN / n))
    posterior = joined.withColumn("posterior", _normal(logs)).withColumn("confidence", F.array_max("posterior"))
    best = F.array(*[F.lit(x) for x in languages])[F.array_position("posterior", F.col("confidence")).cast("int") - 1]
    accepted = has_text & (F.col("confidence") >= ACCEPT) & (best != UNKNOWN)
    return posterior.withColumns({"lang": F.when(has_text, best), "confidence": F.when(has_text, F.col("confidence")).otherwise(0.0), "accepted": accepted}).drop("own", "witness", "prior", "posterior", "likelihood")


def _smoothed(mass: Column, above: Column) -> Column:
    """The prior of a level from its summed beliefs without the item's own, and the prior above it."""
    counts = F.transform(F.arrays_zip(mass.alias("m"), F.col("own").alias("o"), above.alias("p")), lambda z: F.struct(F.greatest(z["m"] - z["o"], F.lit(0.0)).alias("c"), z["p"].alias("p")))
    size = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v["c"])
    return F.transform(counts, lambda z: (z["c"] + PRIOR_ITEMS * z["p"]) / (size + PRIOR_ITEMS))


def document_items(docs: DataFrame) -> DataFrame:
    """Documents as items: the lang column is what they declare, the source is their host."""
    blank = F.lit(None).cast("string")
    return docs.select("doc_id", blank.cast("long").alias("page_id"), F.xxhash64("text").alias("text_hash"), F.lower("lang").alias("declared"), blank.alias("suffix"), blank.alias("domain"), F.col("source").alias("host"), "text")


def page_items(pages: DataFrame) -> DataFrame:
    host, domain, suffix = address_parts(F.col("url"))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", F.xxhash64("html").alias("text_hash"), declared_in_markup(F.col("html")).alias("declared"), suffix.alias("suffix"), domain.alias("domain"), host.alias("host"), F.col("html").alias("text"))


def identify(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_id, text_hash, declared, suffix, domain, host, lang, confidence, accepted) for each document, and each page if given.

    docs: (doc_id, text, lang, source), pages: (page_id, url, html); other columns don't matter. Null and empty texts, and those
    without a letter, get lang null, confidence 0 and aren't accepted; a text that no language explains gets UNKNOWN and isn't accepted. Texts of any
    length are read whole. Unknown declarations, hosts and addresses are empty strings and no evidence by themselves. Repeated rows and equal texts
    are judged one by one. If no document declares a language there is none to find: no item is accepted.
    """
    languages, models = trained(docs)
    items = text_likelihoods(document_items(docs), models)
    if pages is not None:
        items = items.unionByName(text_likelihoods(page_items(pages), models, pages=True))
    if not languages:
        gone = items.drop("likelihood").withColumns({c: F.coalesce(c, F.lit("")) for c in ("declared", "suffix", "domain", "host")})
        return gone.withColumns({"lang": F.lit(None).cast("string"), "confidence": F.lit(0.0), "accepted": F.lit(False)})
    items = checkpointed(items)
    return fused(items, languages, temperature(items, languages))


def keep_accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified with confidence, with all their columns; rows with one id and text go or stay together."""
    judged = identify(docs)
    d, t = spare(docs, "d", "t")
    gone = judged.where("not accepted").select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct()
    return docs.join(broadcast_if_small(checkpointed(gone)), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)), "left_anti")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
    return found.select("doc_id", "page_id", "declared", "suffix", "host", "lang", "confidence", "accepted")
