"""Mixing sources to target weights by subset-sum fitting.

Documents are counted by exact token length within each source.  From these
counts each source's budget is fitted: a proportional share of every length,
then single documents in seeded order, then a bounded-knapsack program over
what remains.  The fit runs per source, in parallel, on counts alone; texts
travel only in the final join, to the (source, length) cut-offs.
"""

from __future__ import annotations

import random
from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A token is a run of letters and digits or one other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class MixRules:
    """``weights``: target share by source; sources it doesn't name get
    ``other``.  Without it a source's weight is its token total to the power
    ``temperature``.  ``budget``: tokens in all, or ``share`` of all tokens; with
    neither, nine tenths, or with ``weights`` the most that the sources can give
    at exactly these.  A source too small for its share of a budget gives all it
    has, and the others make up for it by their weights.  ``window``: remainder
    that the exact program is left to fit."""

    weights: Mapping[str, float] | None = None
    other: float = 0.0
    temperature: float = 0.7
    budget: int | None = None
    share: float | None = None
    window: int = 16_384
    seed: int = 23


def knapsack(items: list[tuple[int, int]], target: int) -> tuple[int, dict[int, int]]:
    """The largest reachable sum up to ``target`` of (length, count) items, and
    the number taken of each length."""
    mask = (1 << (target + 1)) - 1
    reach, steps, first = 1, [], {}
    for size, count in items:
        part = 1
        while count > 0 and size <= target and not reach >> target & 1:
            k = min(part, count)
            count, part = count - k, part * 2
            if size * k > target:
                continue
            new = (reach << size * k) & mask & ~reach
            if new:
                steps.append((size, k))
                first[len(steps) - 1] = new
                reach |= new
    best = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for j in range(len(steps) - 1, -1, -1):  # a sum belongs to the step that first reached it
        if first[j] >> at & 1:
            size, k = steps[j]
            taken[size] = taken.get(size, 0) + k
            at -= size * k
    return best, taken


def fit(lengths: list[int], counts: list[int], target: int, rules: MixRules, name: str = "") -> list[int]:
    """How many documents of each length to take, so that their tokens come to
    ``target`` or as close below it as the counts allow."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if target >= total:
        return [c if n else 0 for n, c in zip(lengths, counts)]
    take = [c * target // total if n else 0 for n, c in zip(lengths, counts)]
    rest = target - sum(n * t for n, t in zip(lengths, take))
    order = [i for i, n in enumerate(lengths) if n]
    random.Random(f"{rules.seed}:{name}").shuffle(order)
    moved = True
    while moved and rest > rules.window:
        moved = False
        for i in order:
            if take[i] < counts[i] and lengths[i] <= rest - rules.window // 2:
                take[i], rest, moved = take[i] + 1, rest - lengths[i], True
    _, extra = knapsack([(lengths[i], counts[i] - take[i]) for i in order if take[i] < counts[i] and lengths[i] <= rest], rest)
    return [t + extra.get(n, 0) for n, t in zip(lengths, take)]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rules: MixRules = MixRules(), tokens: Column | None = None) -> DataFrame:
    """The selected documents, columns unchanged, with ``n_tokens`` (in place of
    an input column of that name).  ``tokens``: another count than that of
    ``token_count``.

    Documents without tokens (null, empty) are never selected.  A null and an
    empty source are one source, named by ``weights[""]``.  Which documents of a
    length go is decided by a seeded hash of id and text; among repeated rows,
    which tie, as many are taken as fit.  No documents give no rows.
    """
    own = [c for c in docs.columns if c.lower() != "n_tokens"]
    return _selected(docs, id_col, text_col, source_col, rules, tokens).select(*[f"`{c}`" for c in own], F.col("__n").alias("n_tokens"))


def keep_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rules: MixRules = MixRules(), tokens: Column | None = None) -> DataFrame:
    """The same documents with the columns of ``docs`` alone, all of them."""
    return _selected(docs, id_col, text_col, source_col, rules, tokens).select(*[f"`{c}`" for c in docs.columns])


def _selected(docs: DataFrame, id_col: str, text_col: str, source_col: str, rules: MixRules, tokens: Column | None) -> DataFrame:
    """The selected documents with ``__n``, their tokens.  Texts are counted
    once, and written with the count; what is shuffled are hashes."""
    count = token_count(F.col(text_col)) if tokens is None else tokens
    own = [f"`{c}`" for c in docs.columns]
    marked = docs.select(
        *own, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__s"), count.alias("__n"),
        F.xxhash64(F.lit(rules.seed), F.col(id_col), F.col(text_col)).alias("__h"),
    )
    marked = written(marked, "mix-counted")
    keys = marked.filter("__n > 0").select("__s", "__n", "__h")
    counts = written(keys.groupBy("__s", "__n").agg(F.count("*").alias("__c")), "mix-counts")

    totals = counts.groupBy("__s").agg(F.sum(F.col("__n") * F.col("__c")).alias("__t"))
    if rules.weights is None:
        weight = F.pow(F.col("__t").cast("double"), F.lit(rules.temperature))
    else:
        weight = F.lit(float(rules.other))
        for s, w in rules.weights.items():
            weight = F.when(F.col("__s") == s, float(w)).otherwise(weight)
    weighed = totals.withColumn("__w", weight).filter("__w > 0")
    # A scale of one row: tokens for each unit of weight.
    share = 0.9 if rules.share is None else rules.share
    if rules.budget is None and rules.share is None and rules.weights is not None:
        unit = weighed.agg(F.min(F.col("__t") / F.col("__w")).alias("__u"))
    else:
        # Sources by how soon the scale exhausts them: what those before it give
        # leaves the rest to it and to those after it, unless it is exhausted too.
        # Past the first that isn't, the scale only falls.
        soon = Window.orderBy(F.col("__t") / F.col("__w"), "__s")
        budget = F.lit(float(rules.budget)) if rules.budget is not None else F.sum("__t").over(Window.partitionBy()) * F.lit(share)
        before = F.coalesce(F.sum("__t").over(soon.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum("__w").over(soon.rowsBetween(0, Window.unboundedFollowing))
        levels = weighed.select((F.col("__t") / F.col("__w")).alias("__r"), ((budget - before) / after).alias("__u"))
        unit = levels.filter("__u <= __r").agg(F.max("__u").alias("__u"))
    # No scale: the budget exhausts every source.
    targets = weighed.crossJoin(F.broadcast(unit)).select(
        "__s", F.coalesce(F.least(F.floor(F.col("__u") * F.col("__w") + 1e-6), F.col("__t")), F.col("__t")).cast("long").alias("__target")
    )

    def fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n")
        lengths, had = pdf["__n"].tolist(), pdf["__c"].tolist()
        took = fit(lengths, had, int(pdf["__target"].iloc[0]), rules, pdf["__s"].iloc[0])
        return pd.DataFrame({"__s": pdf["__s"], "__n": lengths, "__c": had, "__take": took})

    fitted = written(
        counts.join(targets, "__s").groupBy("__s").applyInPandas(fit_source, "__s string, __n long, __c long, __take long").filter("__take > 0"),
        "mix-fit",
    )
    # The cut-off is the hash of the last document taken of a length; "below" of
    # a length come before it and "ties" share it.
    w = Window.partitionBy("__s", "__n").orderBy("__h")
    partial = keys.join(fitted.filter("__take < __c"), ["__s", "__n"]).withColumn("__r", F.row_number().over(w))
    cut = partial.groupBy("__s", "__n", "__h").agg(F.min("__r").alias("__r"), F.count("*").alias("__ties"), F.first("__take").alias("__take"))
    cut = cut.filter("__r <= __take and __take < __r + __ties").select("__s", "__n", F.col("__h").alias("__cut"), (F.col("__take") - F.col("__r") + 1).alias("__last"), "__ties")
    chosen = written(fitted.join(cut, ["__s", "__n"], "left").select("__s", "__n", "__cut", "__last", "__ties"), "mix-cuts")

    met = marked.join(chosen, ["__s", "__n"])
    whole = F.col("__cut").isNull() | (F.col("__h") < F.col("__cut")) | ((F.col("__h") == F.col("__cut")) & (F.col("__last") == F.col("__ties")))
    out = met.filter(whole).select(*own, "__n")
    if not chosen.filter("__last < __ties").isEmpty():
        some = met.filter((F.col("__h") == F.col("__cut")) & (F.col("__last") < F.col("__ties")))
        some = some.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__n").orderBy("__h")))
        out = out.unionByName(some.filter("__r <= __last").select(*own, "__n"))
    return out
