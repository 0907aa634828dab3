"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words and their beginnings of three to eight letters, so that inflected forms share evidence. Their log-odds between toxic and
clean training documents come with an informative Dirichlet prior, which shrinks rare tokens. Significant tokens score their log-odds
and every other word costs DRIFT, so a linear scan finds all maximal scoring segments of a document. A segment's score is
judged against the extreme values that clean documents of that length reach, and a logistic curve turns the evidence of all significant segments
into a score. Words are learnt on two folds of the labelled documents and calibrated on a third; the fourth is held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm.common import broadcast_if_small, checkpointed, smallest, table, values

WORDS = re.compile(r"[^\W\d_]+")
#: Folds of crc32(doc_id as text) mod 4.
LEARN, CALIBRATE, HELD_OUT = (0, 1), 3, 2
#: Strength of the prior in documents, z that a token needs, cost of any other word, and the decision's threshold.
PRIOR, SIGNIFICANT, DRIFT, TOXIC_FROM = 20.0, 2.0, 0.25, 0.3
#: Bounds of the labelled sample that the classifier is fitted on: documents (those of smallest hash of the id), and rows that fit the calibration's
#: four numbers. Tokens have no bound of their own: all significant ones of the sample's toxic documents count.
LABELLED, CALIBRATION_ROWS = 200_000, 20_000
#: Words whose score a worker remembers.
REMEMBERED = 1 << 20


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def tokens(word: str) -> list[str]:
    """The word and, marked by an asterisk, its beginnings of three to eight letters."""
    return [word, *[f"{word[:k]}*" for k in range(3, 9) if k < len(word)]]


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fold): a document for each labelled text outside the held-out fold, LABELLED at most; of equal texts the one with the smallest id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    named = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id")
    chosen = named.groupBy("h", "toxic").agg(F.min(F.struct("doc_id", "fold")).alias("c")).select(F.col("c.doc_id").alias("doc_id"), "toxic", F.col("c.fold").alias("fold"))
    some = broadcast_if_small(checkpointed(smallest(checkpointed(chosen), F.xxhash64("doc_id"), LABELLED)), LABELLED)
    return docs.select("doc_id", "text").join(some, "doc_id").select("text", "toxic", "fold")


def token_counts(train: DataFrame) -> DataFrame:
    """(token, toxic, clean): in how many training documents of either label each token stands; the token '' counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                own = {""}
                for word in set(WORDS.findall(text.lower())):
                    own.update(tokens(word))
                seen[int(toxic == 1)].update(own)
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([c[t] for t in every], pa.int64()) for c in (seen[1], seen[0])]], ["token", "toxic", "clean"])

    counted = train.where(F.col("fold").isin(*LEARN)).select("text", "toxic").mapInArrow(run, "token string, toxic long, clean long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def credits(train: DataFrame, odds: dict[str, float]) -> DataFrame:
    """(token, credit): each toxic training document deals one credit to its words in proportion to their odds, and a word's best token
    gets it. So a token that only keeps company with telling ones, as in copies of a document, is explained away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dealt = Counter()
            for text in values(batch.column(0)):
                best = {t for word in set(WORDS.findall(text.lower())) if (t := max(tokens(word), key=lambda x: odds.get(x, 0.0))) in odds}
                whole = sum(np.exp(odds[t]) for t in best)
                for t in best:
                    dealt[t] += np.exp(odds[t]) / whole
            yield pa.RecordBatch.from_arrays([pa.array(list(dealt), pa.string()), pa.array(list(dealt.values()), pa.float64())], ["token", "credit"])

    toxic = train.where(F.col("fold").isin(*LEARN) & (F.col("toxic") == 1)).select("text")
    return toxic.mapInArrow(run, "token string, credit double").groupBy("token").agg(F.sum("credit").alias("credit"))


def learnt(train: DataFrame) -> dict[str, float]:
    """Token -> log-odds: first from document counts, then from the credit that the first odds deal."""
    counts = checkpointed(token_counts(train).where("toxic > 0 or token = ''"))
    first = log_odds(counts)
    if not first:
        return first
    shared = counts.join(credits(train, first), "token", "left").withColumn("toxic", F.when(F.col("token") == "", F.col("toxic").cast("double")).otherwise(F.coalesce("credit", F.lit(0.0))))
    return log_odds(shared.where("toxic > 0")) or first


def log_odds(counts: DataFrame) -> dict[str, float]:
    """The significant tokens of toxic documents and their log-odds under a Dirichlet prior in proportion to the whole."""
    total = counts.where("token = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    t, c = float(total["toxic"]), float(total["clean"])
    alpha = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / (t + c)
    a, b = F.col("toxic") + alpha, F.col("clean") + alpha
    rest = lambda n, with_token: F.greatest(F.lit(n + PRIOR) - with_token, F.lit(1e-9))  # noqa: E731  a token in all documents leaves none
    odds = F.log(a / rest(t, a)) - F.log(b / rest(c, b))
    scored = counts.where("token <> ''").select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).where(F.col("z") >= SIGNIFICANT)
    return {r["token"]: r["odds"] for r in scored.collect()}  # a classifier's weights: tokens of the sample's toxic documents


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, end, score), in linear time.

    Every held segment remembers the nearest one on its left that starts from a lower total, so that a search hops along these links. A segment that
    a hop passes over starts no lower than the new one and can't be sought again before the new one goes, or goes itself in a merge: each link
    is followed once.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)]).tolist()
    first, end, before, after, lower = [], [], [], [], []  # of the held segments; lower: place of the nearest one with a smaller total before it
    for i in np.flatnonzero(scores > 0).tolist():
        a, x, y = i, total[i], total[i + 1]
        at = len(first) - 1
        while True:
            while at >= 0 and before[at] >= x:
                at = lower[at]
            if at < 0 or after[at] >= y:
                break
            a, x = first[at], before[at]
            left = lower[at]
            for held in (first, end, before, after, lower):
                del held[at:]
            at = left
        first.append(a)
        end.append(i + 1)
        before.append(x)
        after.append(y)
        lower.append(at)
    return [(a, b, y - x) for a, b, x, y in zip(first, end, before, after, strict=True)]


class Scorer(dict):
    """Word -> its score, forgetting all when full."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        score = max((self.odds.get(t, 0.0) for t in tokens(word)), default=0.0) or -DRIFT
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = score
        return score


def segments(docs: DataFrame, odds: dict[str, float]) -> DataFrame:
    """(doc_id, n_words, segments) for each row; segments: array of (start, end, score), places in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(odds)
        for batch in batches:
            lengths, found = [], []
            for text in values(batch.column(1)):
                low = (text or "").lower()
                scores = np.array([scorer[w] for w in WORDS.findall(low)], float)
                runs = maximal_segments(scores)
                if runs:
                    # lower-casing may change the length of a text: places are those of the lower-cased words in order
                    at = [(m.start(), m.end()) for m in WORDS.finditer(text if len(text) == len(low) else low)]
                    runs = [{"start": at[a][0], "end": at[b - 1][1], "score": s} for a, b, s in runs]
                lengths.append(len(scores))
                found.append(runs)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "segments"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, segments array<struct<start: int, end: int, score: double>>")


def extreme_values(best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of P(S >= x) = 1 - exp(-K n exp(-lambda x)) for clean documents' best scores, by maximum likelihood."""
    if len(best) < 10 or not best.any():
        return 1.0, 1e-3
    low, high = 1e-3, 50.0
    for _ in range(60):
        rate = (low + high) / 2
        weight = length * np.exp(-rate * best)
        if 1 / rate > best.mean() - (best * weight).sum() / weight.sum():
            low = rate
        else:
            high = rate
    return rate, float(len(best) / (length * np.exp(-rate * best)).sum())


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b x))), by Newton's steps with a little shrinkage."""
    x1, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + 1e-3 * np.eye(2), x1.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def evidence(rate: float, k: float) -> Column:
    """Log evidence of a document: its segments' normalised scores, all significant ones summed, or else the best one."""
    normal = F.transform("segments", lambda s: rate * s["score"] - F.log(F.lit(k) * F.greatest(F.col("n_words"), F.lit(1))))
    over = F.aggregate(F.filter(normal, lambda v: v > 0), F.lit(0.0), lambda a, v: a + v)
    best = F.coalesce(F.array_max(normal), -F.log(F.lit(k) * F.greatest(F.col("n_words"), F.lit(1))))
    return F.when(over > 0, over).otherwise(F.least(best, F.lit(0.0)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, segments) for each row of documents (doc_id, text).

    labels: (doc_id, toxic), of which the held-out fold is never read. Texts of any length are scanned whole, in time in proportion to it. Null and empty texts have no words and no segments; their score is that
    of no evidence. Equal texts have equal scores, repeated rows are scored one by one. A null doc_id isn't held out. Without toxic or without clean training documents all scores are 0.
    """
    odds = learnt(checkpointed(training(docs, labels)))
    found = checkpointed(segments(docs, odds))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) == CALIBRATE)
    fit = found.join(known, "doc_id").select("toxic", "n_words", F.xxhash64("doc_id").alias("h"), "segments")
    rows = smallest(checkpointed(fit), F.col("h"), CALIBRATION_ROWS).select("toxic", "n_words", F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0)).alias("best"), F.transform("segments", lambda s: s["score"]).alias("all")).collect()
    y = np.array([r["toxic"] == 1 for r in rows], float)
    if not odds or not y.any() or y.all():
        return found.select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), "n_words", "segments")
    n, best = np.array([max(r["n_words"], 1) for r in rows], float), np.array([r["best"] for r in rows], float)
    rate, k = extreme_values(best[y == 0], n[y == 0])
    line = np.log(k * n)
    over = np.array([sum(max(0.0, rate * s - at) for s in r["all"]) for r, at in zip(rows, line, strict=True)])
    a, b = logistic(np.where(over > 0, over, np.minimum(rate * best - line, 0.0)), y)
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * evidence(rate, k))))
    scored = found.select("doc_id", held.alias("held_out"), p.alias("score"), "n_words", "segments")
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
