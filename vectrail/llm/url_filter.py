"""URL filter over a weighted vocabulary.

A URL is percent-decoded, lowered and cut into words; one Aho-Corasick
automaton counts strict and soft terms, both only as whole words.  One strict
hit rejects, as do several distinct soft ones or enough soft weight.  A map
over the URL column alone: page bodies are never read, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .lexicons import SOFT, STRICT

_GAPS = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class UrlRules:
    """``min_soft``: distinct soft terms that reject; ``max_weight``: summed
    weight of distinct soft terms that rejects."""

    strict: Mapping[str, float] = field(default_factory=lambda: STRICT)
    soft: Mapping[str, float] = field(default_factory=lambda: SOFT)
    min_soft: int = 3
    max_weight: float = 4.0


def words(url: str) -> str:
    """The URL's words between single spaces; the scheme is not one of them."""
    low = unquote(unquote(url)).lower()
    return f" {_GAPS.sub(' ', low.split('://', 1)[-1]).strip()} "


def forms(term: str) -> list[str]:
    """What is looked for: the term's words, and a single word beyond ASCII also
    as a host name writes it."""
    own = words(term)
    single = own.strip()
    if single.isascii() or " " in single:
        return [own]
    return [own, words("xn--" + single.encode("punycode").decode())]


def automaton(rules: UrlRules) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for kind, vocabulary in (("soft", rules.soft), ("strict", rules.strict)):
        for term, weight in vocabulary.items():
            for form in forms(term):
                auto.add_word(form, (kind, term, float(weight)))
    if len(auto):
        auto.make_automaton()
    return auto


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: UrlRules = UrlRules()
) -> DataFrame:
    """A row for each page: id, URL, ``strict_hits`` (occurrences),
    ``soft_hits`` (distinct terms), ``soft_weight``, ``terms``, ``rejected``.

    A null or empty URL has no words and is kept.  Repeated rows give repeated
    results; columns other than id and URL are not read.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, pages.schema[id_col].dataType),
            T.StructField(url_col, T.StringType()),
            T.StructField("strict_hits", T.LongType()),
            T.StructField("soft_hits", T.LongType()),
            T.StructField("soft_weight", T.DoubleType()),
            T.StructField("terms", T.StringType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(rules)
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                strict, soft, names = 0, {}, set()
                if url and len(auto):
                    for _, (kind, term, weight) in auto.iter(words(url)):
                        names.add(term)
                        if kind == "strict":
                            strict += 1
                        else:
                            soft[term] = weight
                total = sum(soft[t] for t in sorted(soft))
                bad = strict > 0 or len(soft) >= rules.min_soft or total >= rules.max_weight
                rows.append((strict, len(soft), total, ",".join(sorted(names)), bad))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(cols, kinds))],
                names=schema.names,
            )

    return pages.select(id_col, url_col).mapInArrow(run, schema)


def oracle(rules: UrlRules = UrlRules()) -> str:
    def rows(kind: str, vocabulary: Mapping[str, float]) -> list[str]:
        return [f"('{kind}', '{t}', '{form}', {w}::DOUBLE)" for t, w in vocabulary.items() for form in forms(t)]

    vocabulary = ", ".join(rows("soft", rules.soft) + rows("strict", rules.strict))
    return f"""
    WITH v(kind, term, w, weight) AS (VALUES {vocabulary}),
    u AS (
      SELECT page_id, url, ' ' || trim(regexp_replace(
        regexp_replace(lower(url_decode(url_decode(url))), '^.*?://', ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS x
      FROM pages),
    h AS (
      SELECT page_id, kind, term, weight,
             (length(replace(x, ' ', '  ')) - length(replace(replace(x, ' ', '  '), replace(w, ' ', '  '), '')))
               // length(replace(w, ' ', '  ')) AS n
      FROM (SELECT page_id, ' ' || x || ' ' AS x FROM u), v WHERE contains(x, w)),
    g AS (
      SELECT page_id, coalesce(sum(n) FILTER (kind = 'strict'), 0)::BIGINT AS strict_hits,
             count(*) FILTER (kind = 'soft') AS soft_hits,
             coalesce(sum(weight) FILTER (kind = 'soft'), 0)::DOUBLE AS soft_weight,
             string_agg(DISTINCT term, ',' ORDER BY term) AS terms
      FROM (SELECT page_id, kind, term, any_value(weight) AS weight, sum(n) AS n FROM h GROUP BY ALL) GROUP BY page_id)
    SELECT u.page_id, u.url, coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits,
           coalesce(soft_weight, 0) AS soft_weight, coalesce(terms, '') AS terms,
           coalesce(strict_hits, 0) > 0 OR coalesce(soft_hits, 0) >= {rules.min_soft}
             OR coalesce(soft_weight, 0) >= {rules.max_weight} AS rejected
    FROM u LEFT JOIN g USING (page_id)"""
