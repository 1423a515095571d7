"""Benchmark decontamination by Wu-Manber search.

Every window of ``n`` words of a benchmark item is a pattern.  Texts are
scanned with a block shift table that skips positions where no pattern can
end; where the shift is zero, the bucket of that block names the patterns to
compare directly.  A map over Arrow batches: each text is read once, whole,
and only hits, or the clean rows, come back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_GAPS = re.compile(r"[\W_]+")
#: Scripts without spaces between words (Thai to Khmer, kana, Han): each
#: character counts as a word.  Shared with the SQL.
DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
_DENSE = re.compile(f"([{DENSE}])")


def normal(text: str) -> str:
    """Lower-case words between single spaces."""
    low = text.lower()
    if not low.isascii():
        low = _DENSE.sub(r" \1 ", low)
    return f" {_GAPS.sub(' ', low).strip()} "


@dataclass(frozen=True)
class DecontaminationRules:
    """``n``: words of a window.  An item of fewer words is one pattern, if it
    has ``min_words`` or ``min_chars`` characters (of its words between single
    spaces); a shorter one would match at random and is left out.
    ``patterns_per_pass``: a larger benchmark is searched in several passes,
    whole items at a time, so that what a worker holds stays bounded; the result
    doesn't depend on it."""

    n: int = 10
    min_words: int = 5
    min_chars: int = 32
    patterns_per_pass: int = 250_000


def windows(text: str, rules: DecontaminationRules) -> set[str]:
    flat = normal(text)
    words = flat.split()
    if not words or (len(words) < rules.min_words and len(flat) - 2 < rules.min_chars):
        return set()
    n = min(rules.n, len(words))
    return {f" {' '.join(words[k : k + n])} " for k in range(len(words) - n + 1)}


class WuManber:
    """Search for many strings of at least ``block`` characters."""

    def __init__(self, patterns: Iterable[str], block: int = 8) -> None:
        by_class: dict[int, list[str]] = {}
        for p in set(patterns):
            if not p:
                continue
            # Lengths of a class differ by less than half: one short pattern
            # would else limit every shift to its own length.
            k, top = 0, 8
            while len(p) >= top:
                k, top = k + 1, top + max(top // 2, 1)
            by_class.setdefault(k, []).append(p)
        self.tables = [self._table(ps, block) for ps in by_class.values()]

    @staticmethod
    def _table(patterns: list[str], block: int) -> tuple[int, int, int, bytearray, dict[str, list[str]]]:
        """Least length, block, mask, shifts by the block's hash (a byte each;
        blocks that fall together share the least shift) and buckets by the
        last block of the least length."""
        m = min(map(len, patterns))
        b = min(block, m)
        far = min(m - b + 1, 255)
        mask = (1 << max(10, (4 * len(patterns) * (m - b + 1)).bit_length())) - 1
        shift = bytearray([far]) * (mask + 1)
        bucket: dict[str, list[str]] = {}
        for p in patterns:
            for end in range(max(b, m - far), m + 1):
                k = hash(p[end - b : end]) & mask
                if shift[k] > m - end:
                    shift[k] = m - end
            bucket.setdefault(p[m - b : m], []).append(p)
        return m, b, mask, shift, bucket

    def find(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, pattern) of every occurrence, overlapping ones included."""
        n = len(text)
        for m, b, mask, shift, bucket in self.tables:
            end = m
            while end <= n:
                key = text[end - b : end]
                step = shift[hash(key) & mask]
                if step:
                    end += step
                    continue
                start = end - m
                for p in bucket.get(key, ()):
                    if text.startswith(p, start):
                        yield start, p
                end += 1


def _slices(benchmark: DataFrame, item_col: str, item_text_col: str, rules: DecontaminationRules) -> Iterator[dict[str, list]]:
    """Windows and the items that own them, whole items at a time: rows of one
    item, nulls too, are one."""
    own: dict[str, list] = {}
    last, begun = None, False
    for item, text in benchmark.select(item_col, item_text_col).orderBy(item_col).toLocalIterator():
        if begun and item != last and len(own) >= rules.patterns_per_pass:
            yield own
            own = {}
        last, begun = item, True
        for w in windows(text or "", rules):
            items = own.setdefault(w, [])
            if not items or items[-1] != item:
                items.append(item)
    yield own


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rules: DecontaminationRules = DecontaminationRules(),
) -> DataFrame:
    """(id, ``item_id``, ``hits``): documents that hold a window of an item, and
    at how many places.

    Null and empty texts hold none; a null item text has no window; a null item
    id is reported as null.  Several rows of one item are one item.  Items with
    equal windows are all reported.  A repeated document row gives its hits
    again.  Other columns are not read.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("item_id", benchmark.schema[item_col].dataType),
            T.StructField("hits", T.LongType()),
        ]
    )
    wanted = to_arrow_type(schema["item_id"].dataType)

    def scan(owners: dict[str, list]) -> DataFrame:
        owned = docs.sparkSession.sparkContext.broadcast(owners)  # a slice is bounded by patterns_per_pass and one item

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = WuManber(owned.value)
            for b in found:
                at, items, hits = [], [], []
                for k, text in enumerate(b.column(1).to_pylist()):
                    if not text:
                        continue
                    n: Counter = Counter()
                    for _, p in search.find(normal(text)):
                        n.update(owned.value[p])
                    for item, c in n.items():
                        at.append(k)
                        items.append(item)
                        hits.append(c)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array(items, wanted), pa.array(hits, pa.int64())],
                    names=schema.names,
                )

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    out = None
    for owners in _slices(benchmark, item_col, item_text_col, rules):
        out = scan(owners) if out is None else out.unionByName(scan(owners))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rules: DecontaminationRules = DecontaminationRules(),
) -> DataFrame:
    """``docs`` without rows that hold a window of an item, columns unchanged.

    Each row is judged by its own text, whatever its id, so that clean rows stay
    beside a contaminated one of the same id.  Null and empty texts stay, as do
    repeated clean rows.  One map, or one for each slice of a large benchmark:
    nothing is shuffled.
    """
    at = docs.columns.index(text_col)

    def clean(docs: DataFrame, owners: dict[str, list]) -> DataFrame:
        owned = docs.sparkSession.sparkContext.broadcast(list(owners))

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = WuManber(owned.value)
            for b in found:
                keep = [not text or next(search.find(normal(text)), None) is None for text in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    for owners in _slices(benchmark, item_col, item_text_col, rules):
        docs = clean(docs, owners)
    return docs


def oracle(rules: DecontaminationRules = DecontaminationRules()) -> str:
    dense = "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in DENSE)
    words = f"regexp_extract_all(regexp_replace(lower(text), '([{dense}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
    grams = "unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g"
    return f"""
    WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
    b AS (
      SELECT DISTINCT item_id, n, {grams}
      FROM (SELECT item_id, w, least({rules.n}, len(w)) AS n FROM i
            WHERE len(w) >= {rules.min_words} OR length(array_to_string(w, ' ')) >= {rules.min_chars})),
    d AS (SELECT doc_id, n, {grams} FROM (SELECT doc_id, {words} AS w FROM documents), (SELECT DISTINCT n FROM b))
    SELECT doc_id, item_id, count(*) AS hits FROM d JOIN b USING (n, g) GROUP BY ALL"""
