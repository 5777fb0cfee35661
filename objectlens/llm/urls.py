"""Operator 2: URL filters by host word segmentation and naive Bayes.

Host rules decide first; the longest that fits wins.  Other URLs are judged by the method: the
host's names are split into words by unigram Viterbi (a name such as ``cheappills`` has no
separators), the path is cut at everything that is no letter or digit, and a multinomial naive
Bayes over host words and path tokens tells ``block`` from ``allow``.

Both learn from the pages.  Unigrams are counted over all pages where separators show the words: in
paths and in hyphenated names.  The classes are taught by the pages that a rule decides, or by
marks of the caller; their hosts are split into words first, as the hosts to judge are.  Counts are
kept as written tables; distinct names join their substrings to them, distinct hosts their words and
distinct paths their tokens, so every counted token takes part; sums alone reach the driver.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is
allowed; repeated pages count each time; of equal odds, as without taught pages, the verdict is
allow; a tie between splits goes to the one whose last word begins first; a name of more than
``LONGEST`` letters, which no host may have, stays whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlens.llm.common import frozen

TOKEN = "([a-z]+|[0-9]+)"
#: Letters that a name of a host may have.
LONGEST = 63


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*([^?#]*)", 1)


def rule_columns(rules: list[tuple[str, str, str]], host_col: Column, path_col: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Unigram Viterbi over counted words; total is of the whole vocabulary."""

    def __init__(self, counts: dict[str, int], total: int):
        self.cost = {w: -math.log(n / total) for w, n in counts.items() if n > 0}
        self.unseen = math.log(total)

    def split(self, name: str) -> list[str]:
        """The cheapest split; an unknown stretch costs more with each of its letters."""
        if len(name) > LONGEST:
            return [name]
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, start = min((best[start] + self.cost.get(name[start:end], self.unseen + 1.5 * (end - start)), start) for start in range(end))
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


@dataclass
class UrlModel:
    """unigrams: (word, n); weights: (t, weight), of host words h:.. and path tokens p:.."""

    unigrams: DataFrame
    total: int
    longest: int
    weights: DataFrame | None = None
    prior: float = 0.0


def _tokens(text) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def train(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", marks: Column | None = None) -> UrlModel:
    """Count words and classes over all pages; the counts stay tables.

    marks: a column of ``block``, ``allow`` or null that teaches beside the rules, which win.
    """
    url = F.col(f"`{url_col}`")
    _, verdict = rule_columns(rules, host(url), path(url))
    verdict = F.coalesce(verdict, marks) if marks is not None else verdict
    rows = pages.select(host(url).alias("host"), F.lower(path(url)).alias("lowered"), verdict.alias("v")).where("host <> ''")
    parts = F.flatten(F.transform(F.filter(F.split("host", r"\."), lambda x: x.contains("-")), _tokens))
    shown = rows.select(F.explode(F.concat(parts, _tokens("lowered"))).alias("word"))
    unigrams = frozen(shown.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "url-unigrams")
    total, longest = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)) + 1, F.coalesce(F.max(F.length("word")), F.lit(1))).head()
    model = UrlModel(unigrams, total, min(longest, LONGEST))

    taught = rows.where(F.col("v").isin("block", "allow"))
    numbers = [F.sum((F.col("v") == v).cast("long")).alias(c) for v, c in (("block", "b"), ("allow", "a"))]
    by_host = taught.groupBy("host").agg(*numbers)
    words = by_host.join(_host_words(by_host.select("host"), model), "host").select(F.explode("words").alias("w"), "b", "a").select(F.concat(F.lit("h:"), "w").alias("t"), "b", "a")
    by_path = taught.groupBy("lowered").agg(*numbers).select(F.explode(_tokens("lowered")).alias("w"), "b", "a").select(F.concat(F.lit("p:"), "w").alias("t"), "b", "a")
    counts = frozen(words.unionByName(by_path).groupBy("t").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "url-classes")
    size, blocked, allowed = counts.agg(F.count(F.lit(1)) + 1, F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).head()
    pages_b, pages_a = taught.agg(*numbers).head()
    weight = F.log((F.col("b") + 1) / (blocked + size)) - F.log((F.col("a") + 1) / (allowed + size))
    model.weights, model.prior = counts.select("t", weight.alias("weight")), math.log((pages_b or 0) + 1) - math.log((pages_a or 0) + 1)
    return model


def _split_names(names: DataFrame, model: UrlModel) -> DataFrame:
    """(name, split) of distinct names, each by the counts of all of its substrings."""
    total, longest = model.total, model.longest
    pieces = F.expr(f"array_distinct(flatten(transform(sequence(1, length(name)), i -> transform(sequence(1, least(length(name) - i + 1, {longest})), k -> substr(name, i, k)))))")
    known = names.where(F.length("name") <= LONGEST).select("name", F.explode(pieces).alias("word")).join(model.unigrams, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches):
        for batch in batches:
            given = batch.column(0).to_pylist()
            split = [Segmenter({x["word"]: x["n"] for x in k or ()}, total).split(name) for name, k in zip(given, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], names=["name", "split"])

    return names.join(known, "name", "left").mapInArrow(run, "name string, split array<string>")


def _host_words(hosts: DataFrame, model: UrlModel) -> DataFrame:
    """(host, words) of distinct hosts that have words, written once."""
    places = hosts.select("host", F.posexplode(_tokens("host")).alias("place", "name"))
    split = _split_names(places.select("name").distinct(), model)
    joined = places.join(split, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "split"))).alias("s"))
    return frozen(joined.select("host", F.flatten(F.transform("s", lambda x: x["split"])).alias("words")), "url-hosts")


def _weighed(rows: DataFrame, key: str, model: UrlModel) -> DataFrame:
    """(key, its tokens' weights added up) from rows of a key and one token t, with repeats."""
    return rows.join(model.weights, "t").groupBy(key).agg(F.sum("weight").alias(f"{key}_weight"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel, keep: list[str] | None = None, url_col: str = "url") -> DataFrame:
    """Adds host, path, words (of the host), odds, rule and verdict to the columns keep."""
    new = ["host", "path", "rule", "verdict", "words", "odds"]
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in new]
    url = F.col(f"`{url_col}`")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    cut = pages.select(kept.alias("kept"), host(url).alias("host"), path(url).alias("path")).withColumn("lowered", F.lower("path"))

    found = _host_words(cut.select("host").distinct(), model)
    by_host = found.join(_weighed(found.select("host", F.explode("words").alias("w")).select("host", F.concat(F.lit("h:"), "w").alias("t")), "host", model), "host", "left")
    lowered = cut.select("lowered").distinct().select("lowered", F.explode(_tokens("lowered")).alias("w"))
    by_path = _weighed(lowered.select("lowered", F.concat(F.lit("p:"), "w").alias("t")), "lowered", model)

    odds = F.when(F.col("host") == "", -1.0).otherwise(model.prior + F.coalesce("host_weight", F.lit(0.0)) + F.coalesce("lowered_weight", F.lit(0.0)))
    words = F.coalesce("words", F.array().cast("array<string>"))
    # an exchange of their own above the sums lets adaptive execution split a common host's or path's pages
    judged = cut.join(by_host.repartition("host"), "host", "left").join(by_path.repartition("lowered"), "lowered", "left").select("kept", "host", "path", words.alias("words"), odds.alias("odds"))
    name, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    verdict = F.coalesce(verdict, F.when(F.col("odds") > 0, "block").otherwise("allow"))
    return judged.select(*[F.col("kept")[c].alias(c) for c in keep], "host", "path", name.alias("rule"), verdict.alias("verdict"), "words", "odds")
