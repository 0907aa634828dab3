"""Personal data: fixed patterns as seeds, and contexts learnt from them by bootstrapping.

Seeds are the spans that the fixed patterns find, and long runs of hexadecimal digits as secrets. The two words before a known instance are a lexical
pattern of its kind once enough different known instances follow them. Over the whole corpus Spark counts how often each pattern occurs and which
identifier-like runs follow it, and scores the bipartite graph of patterns and instances in rounds: a pattern is worth the share of its
occurrences that known instances follow; an instance is worth what its patterns are worth together, and is known from then on if that is
enough, so that it makes patterns of its own in the next round. The rounds end when no instance is new. Patterns of high worth then mark the
runs that no fixed pattern knows. A run of hexadecimal digits alone is no find: it counts as a secret only where such a pattern precedes it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm.common import checkpointed, met, table, values

#: The kinds in order and their patterns. A look-behind only keeps a run of digits from being tried again inside. Secrets have
#: no fixed pattern; their seeds are hexadecimal runs that have digits and letters.
KINDS = ("email", "ip", "card", "phone", "secret")
HEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A token, as str.split() has them; one with five digits or an at sign may be an identifier.
TOKEN, DIGIT = re.compile(r"\S+"), re.compile(r"[0-9]")
#: A group of digits of a number that may go on after a blank, and the most digits of a group and of a whole run.
GROUP, GROUP_DIGITS, RUN_DIGITS = re.compile(r"[+(]*[0-9][0-9().+-]*"), 7, 19
#: Different known instances that a pattern needs, the worth it and its instances need, and the most patterns that are
#: sent to all tasks: with more, the counts of all pairs of words are joined with the patterns instead.
SEEDS, WORTH, PATTERNS = 5, 0.6, 20_000
#: Pairs of words that a task counts before it hands the counts on.
COUNTED = 1 << 18
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and without overlaps within a kind."""
    out, done = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                done = m.end()
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the seeds of secrets."""
    return [(4, m.start(), m.end()) for m in HEX.finditer(text) if not m[0].isdigit() and not m[0].isalpha()]


def identifier_like(token: str) -> bool:
    return sum(c.isdigit() for c in token) >= 5 or "@" in token


def _digits(token: str) -> int:
    return sum(c.isdigit() for c in token)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without its outer punctuation; a plus sign before it and brackets that close inside it stay."""
    while start < end and not (text[start].isalnum() or text[start] == "+" or (text[start] == "(" and ")" in text[start:end].rstrip(")].,;:!?\"'"))):
        start += 1
    while start < end and not (text[end - 1].isalnum()):
        end -= 1
    return start, end


def candidate(line: str, tokens: list[tuple[int, int]], at: int) -> tuple[int, int]:
    """The span that starts with a token of a line: short groups of digits go on over single blanks, outer punctuation is dropped."""
    start, end = tokens[at]
    have = _digits(line[start:end])
    if have <= GROUP_DIGITS and (GROUP.fullmatch(line[start:end]) or line[start:end] == "+"):
        for a, b in tokens[at + 1 :]:
            group = line[a:b].rstrip(".,;:!?\"'")
            more = _digits(group)
            if a != end + 1 or line[end] != " " or not GROUP.fullmatch(group) or more > GROUP_DIGITS or have + more > RUN_DIGITS:
                break
            have, end = have + more, b
            if len(group) < b - a:  # punctuation ends the run
                break
    return trimmed(line, start, end)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, int, int, bool]]:
    """(kind, pattern, start, end, free) of all that two words on its line precede: base spans with their kind, where they start with a run, and other
    identifier-like runs with kind -1; free if they overlap no base span."""
    known, out, at = {}, [], 0
    for kind, a, b in base:
        if a not in known or known[a][1] < b:
            known[a] = (kind, b)
    spans = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    for line in text.split("\n"):
        if "@" in line or DIGIT.search(line):
            words, tokens = line.lower().split(), [m.span() for m in TOKEN.finditer(line)]
            for i in range(2, len(tokens)):
                start, end = tokens[i]
                kind = -1
                if at + start in known or "@" in line[start:end] or DIGIT.search(line, start, end):
                    if at + start not in known:
                        start, end = candidate(line, tokens, i)
                    if at + start in known:
                        kind, end = known[at + start][0], known[at + start][1] - at
                    elif not identifier_like(line[start:end]):
                        continue
                    left = bisect_left(starts, at + end)
                    out.append((kind, f"{words[i - 2]} {words[i - 1]}", at + start, at + end, not left or ends[left - 1] <= at + start))
        at += len(line) + 1
    return out


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
PLACE = pa.struct([("kind", pa.int32()), ("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("free", pa.bool_())])


def scanned(df: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_email, n_ip, n_card, n_phone, base, places) for each row; base has the fixed patterns' spans, places the candidates with their
    patterns, seeds of secrets among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, places = [[], [], [], []], [], []
            for text in values(batch.column(2)):
                text = text or ""
                spans = base_spans(text)
                hidden = [h for h in secrets(text) if not any(h[1] < b and a < h[2] for _, a, b in spans)]
                per_kind = Counter(k for k, _, _ in spans)
                for k in range(4):
                    counts[k].append(per_kind[k])
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                places.append([{"kind": k, "pattern": p, "instance": text[a:b], "start": a, "end": b, "free": f} for k, p, a, b, f in candidates(text, spans + hidden)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.list_(SPAN)), pa.array(places, pa.list_(PLACE))], ["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base", "places"])

    span, place = "array<struct<kind: int, start: long, end: long>>", "array<struct<kind: int, pattern: string, instance: string, start: long, end: long, free: boolean>>"
    rows = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base {span}, places {place}")


def pattern_counts(df: DataFrame, patterns: frozenset[str] | None) -> DataFrame:
    """(pattern, total): how often the patterns (all pairs of words if None) stand before another word of their line."""
    lasts = None if patterns is None else frozenset(p.split(" ")[1] for p in patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for text in values(batch.column(0)):
                for line in text.split("\n"):
                    words = line.lower().split()
                    for i, last in enumerate(words[1:-1], 1):
                        if lasts is None or last in lasts:
                            pattern = f"{words[i - 1]} {last}"
                            if patterns is None or pattern in patterns:
                                seen[pattern] += 1
                    if len(seen) > COUNTED:
                        yield counts(seen)
                        seen = Counter()
        if seen:
            yield counts(seen)

    def counts(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    return df.where("text is not null").select("text").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))


def bootstrapped(places: DataFrame, totals: DataFrame, seeds_needed: int = SEEDS, least: float = WORTH) -> DataFrame:
    """(kind, pattern, worth) of the patterns that enough known instances have, once no instance is new.

    places: (kind, pattern, instance), kind -1 where it isn't a seed; totals: (pattern, total) of the patterns that can have enough instances.
    """
    edges = checkpointed(places.groupBy("pattern", "instance").agg(F.count("*").alias("n")).join(totals, "pattern"))
    degree = checkpointed(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    known = checkpointed(places.where("kind >= 0").select("kind", "instance").distinct().withColumn("belief", F.lit(1.0)))
    while True:
        had = known.count()
        held = edges.join(known, "instance")
        scored = held.groupBy("kind", "pattern").agg(F.count("*").alias("instances"), (F.sum(F.col("n") * F.col("belief")) / F.max("total")).alias("worth")).where(F.col("instances") >= seeds_needed)
        scored = checkpointed(scored.select("kind", "pattern", "worth"))
        listed = checkpointed(scored.groupBy("pattern").agg(F.collect_list(F.struct("kind", "worth")).alias("kinds")).join(degree, "pattern"))
        told = met(edges.select("pattern", "instance"), listed, ["pattern"], F.col("instance")).select("instance", F.explode("kinds").alias("k"))
        doubt = F.sum(F.log(F.greatest(1 - F.col("k.worth"), F.lit(1e-6))))
        worth = told.groupBy(F.col("k.kind").alias("kind"), "instance").agg((1 - F.exp(doubt)).alias("belief")).where(F.col("belief") >= least)
        known = checkpointed(known.unionByName(worth).groupBy("kind", "instance").agg(F.max("belief").alias("belief")))
        if known.count() == had:
            return scored


def told(spans: Column) -> Column:
    """kind:start:end of spans by kind, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(df: DataFrame, seeds_needed: int = SEEDS, worth: float = WORTH) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, secrets) for documents (doc_id, text), a row for each row.

    The counts and base have the fixed patterns' spans, spans these and the ones of their kinds that learnt patterns add (none that overlap another span but one
    another's), secrets those that patterns of secrets mark, seeds or not. Null and empty texts have none. Texts of any length are read whole, line by line. Repeated rows get equal results. Of kinds
    that are worth the same to a pattern the first counts. Places are code points, ends exclusive. Other columns don't matter. With no pattern
    of enough different instances the same steps run and add nothing.
    """
    found = checkpointed(scanned(df))
    places = found.select("doc_id", "text_hash", F.explode("places").alias("p")).select("doc_id", "text_hash", "p.*")
    able = checkpointed(places.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= seeds_needed).select("pattern"))
    few = [row["pattern"] for row in able.limit(PATTERNS + 1).collect()]
    totals = pattern_counts(df, frozenset(few)) if len(few) <= PATTERNS else pattern_counts(df, None).join(able, "pattern", "left_semi")
    trusted = bootstrapped(places, checkpointed(totals), seeds_needed, worth).where(F.col("worth") >= worth)
    best = trusted.groupBy("pattern").agg(F.max_by("kind", F.struct("worth", -F.col("kind"))).alias("kind"))
    secret = F.lit(KINDS.index("secret"))
    open_ = places.where((F.col("kind") == secret) | ((F.col("kind") < 0) & F.col("free"))).withColumnRenamed("kind", "seed")
    best = checkpointed(best.join(open_.groupBy("pattern").agg(F.count("*").alias("n")), "pattern"))
    marked = met(open_, best, ["pattern"], F.col("text_hash")).where((F.col("seed") < 0) | (F.col("kind") == secret))
    new = marked.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))
    new = new.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), "new")
    both = found.join(new, found["doc_id"].eqNullSafe(F.col("__d")) & (found["text_hash"] == F.col("__t")), "left")
    none = F.array().cast("array<struct<kind: int, start: long, end: long>>")
    new_ones = F.coalesce("new", none)
    listed = told(F.concat("base", F.filter(new_ones, lambda s: s["kind"] != secret)))
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", told(F.col("base")).alias("base"), listed.alias("spans"), told(F.filter(new_ones, lambda s: s["kind"] == secret)).alias("secrets"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "secrets")
