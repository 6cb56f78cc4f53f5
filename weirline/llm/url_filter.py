"""URL filter: rules first, else segmented hosts and paths under naive Bayes.

Hosts run words together. A unigram model of words, learned from the pages'
visible text, splits each host label at its most likely places (Viterbi). The
words of host and path are the tokens of a multinomial naive Bayes model, which
learns from all urls that a rule decides and judges the urls no rule fits.

The words are a table of all words that the pages show twice or more. Each distinct
host label meets only those of them that are pieces of it, so that a task splits a
label with a short list. Tokens and their counts are tables, too; hosts
are scored once, paths per page, and both scores are joined to the pages. Only the
totals reach the driver.

A piece has at most LONGEST letters, as a host label may have; a longer run of
letters stays one word. Nulls: a null url, or one without "://", has empty host and path, fits no rule
and is judged by the class shares alone. A null page_id is kept. Repeated rows
are judged alike. Without any decided url every url is allowed. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import map_texts
from weirline.sources.scratch import cut, stack

#: The rules: (host, path) and what they decide.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LONGEST, SMOOTH = 63, 0.5
MARKUP = re.compile(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")
LETTERS = re.compile(r"[^\W\d_]+")
PATH_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its decision; null where none does."""
    name = said = F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, said = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(said)
    return name, said


def lexicon(pages: DataFrame) -> DataFrame:
    """(word, n): the words that the pages' visible text holds twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), type=pa.string()), "n": pa.array(list(seen.values()), type=pa.int64())})

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(LETTERS.findall(MARKUP.sub(" ", t or "").lower()))
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    found = pages.select("html").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return cut(found.where((F.col("n") > 1) & (F.length("word") <= LONGEST)))


def segment(label: str, words: dict[str, float]) -> list[str]:
    """The most likely split of a run of letters into words; unknown pieces cost more with every letter."""
    if len(label) > LONGEST:
        return [label]
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for j in range(1, len(label) + 1):
        for i in range(j):
            piece = label[i:j]
            score = best[i] + words.get(piece, -12.0 - 4.0 * (j - i))
            if score > best[j]:
                best[j], back[j] = score, i
    out, j = [], len(label)
    while j:
        out.append(label[back[j] : j])
        j = back[j]
    return out[::-1]


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of letters of each host, in order."""
    for b in batches:
        rows = [(h, k, w) for h in b.column("host").to_pylist() for k, w in enumerate(LETTERS.findall(h))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
            names=["host", "at", "label"],
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pieces of each label."""
    for b in batches:
        for label in b.column("label").to_pylist():
            n = len(label) if len(label) <= LONGEST else 0
            own = sorted({label[i:j] for i in range(n) for j in range(i + 1, n + 1)})
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(own), pa.string()), pa.array(own, pa.string())], names=["label", "piece"])


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of distinct hosts; hosts without letters are absent."""
    total = counts.agg(F.sum("n")).first()[0] or 1  # one number
    labels = cut(hosts.mapInArrow(_labels, "host string, at int, label string"))
    distinct = cut(labels.select("label").distinct())
    pieces = distinct.mapInArrow(_pieces, "label string, piece string")
    known = pieces.join(counts, F.col("piece") == F.col("word")).groupBy("label").agg(F.collect_list("piece").alias("pieces"), F.collect_list("n").alias("ns"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, pieces, ns = (b.column(c).to_pylist() for c in ("label", "pieces", "ns"))
            made = [segment(w, {p: math.log(n / total) for p, n in zip(ps or (), m or (), strict=True)}) for w, ps, m in zip(label, pieces, ns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(made, pa.list_(pa.string()))], names=["label", "words"])

    done = distinct.join(known, "label", "left").mapInArrow(split, "label string, words array<string>")
    parts = F.sort_array(F.collect_list(F.struct("at", "words")))
    return labels.join(done, "label").groupBy("host").agg(F.flatten(F.transform(parts, lambda s: s["words"])).alias("words"))


def path_tokens(paths: list[str]) -> dict:
    return {"tokens": [["p:" + (w if not w.isdigit() else f"#{len(w)}") for w in PATH_TOKEN.findall(p.lower())] for p in paths]}


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the log odds of block."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("id"))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = cut(parts.withColumns({"rule": name, "said": said}))
    block, allow = F.count_if(F.col("said") == "block").alias("block"), F.count_if(F.col("said") == "allow").alias("allow")
    hosts = cut(ruled.groupBy("host").agg(block, allow))
    on_host = cut(host_words(hosts.select("host"), lexicon(pages)).select("host", F.transform("words", lambda w: F.concat(F.lit("h:"), w)).alias("tokens")))
    on_path = cut(map_texts(ruled, ["id", "said"], ["path"], {"tokens": "array<string>"}, path_tokens))

    from_hosts = hosts.join(on_host, "host").select(F.explode("tokens").alias("token"), "block", "allow")
    from_paths = on_path.where("said IS NOT NULL").select("said", F.explode("tokens").alias("token")).groupBy("token").agg(block, allow)
    sums = [F.sum(c).alias(c) for c in ("block", "allow")]
    counts = cut(stack([from_hosts, from_paths]).groupBy("token").agg(*sums).where("block + allow > 0"))
    urls = hosts.agg(*sums).first()
    seen = counts.agg(*sums, F.count("*").alias("tokens")).first()
    n_block, n_allow = ((seen[c] or 0) + SMOOTH * max(1, seen["tokens"]) for c in ("block", "allow"))

    def odds(b, a):
        return F.log((b + SMOOTH) / F.lit(n_block)) - F.log((a + SMOOTH) / F.lit(n_allow))

    weights = counts.select("token", odds(F.col("block"), F.col("allow")).alias("weight"))
    unknown = math.log(n_allow / n_block)

    def scored(tokens: DataFrame, key: str, name: str) -> DataFrame:
        met = tokens.select(key, F.explode("tokens").alias("token")).join(weights, "token", "left")
        return met.groupBy(key).agg(F.sum(F.coalesce("weight", F.lit(unknown))).alias(name))

    any_ = (urls["block"] or 0) + (urls["allow"] or 0) > 0
    prior = math.log((urls["block"] or 0) + SMOOTH) - math.log((urls["allow"] or 0) + SMOOTH) if any_ else -math.inf
    both = ruled.join(scored(on_host, "host", "h"), "host", "left").join(scored(on_path, "id", "p"), "id", "left")
    log_odds = F.round(F.lit(prior) + F.coalesce("h", F.lit(0.0)) + F.coalesce("p", F.lit(0.0)), 9) if any_ else F.lit(None).cast("double")
    verdict = F.coalesce(F.col("said"), F.when(F.col("block_log_odds") > 0, "block").otherwise("allow"))
    return both.withColumn("block_log_odds", log_odds).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_log_odds")
