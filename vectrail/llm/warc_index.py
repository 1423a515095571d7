"""WARC index by external merge.

Captures become index lines (URL key, timestamp, id, digest, length).  Each
scan task sorts its own lines: a run, written to the shared folder.  The lines
travel once, to the task of their range, and no sort follows: what arrives there
is cut into ascending stretches, the runs' slices, and a loser tree merges them,
reading a few rows of each at a time.  Ranges are cut by the whole order, not by
key, and are sized by bytes, so that neither a large input nor a key of very many
captures outgrows a task; numbers and comparisons within a key that spans ranges
are carried over from the ranges' figures.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


class LoserTree:
    """K-way merge: inner nodes hold the loser of their match, node 0 the
    winner, so that replacing the winner costs one path of log2 k matches."""

    def __init__(self, runs: Sequence[Iterator[tuple]]) -> None:
        self.runs = list(runs)
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """-1 beats all while the tree is built; then an ended run loses to
        all, and equal heads go by run."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._beats(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            w = self.tree[0]
            head = self.heads[w]
            if head is None:
                return
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def url_key(url: Column) -> Column:
    """Sort-friendly key: reversed host without www and port, then path and
    query without fragment, tracking parameters and trailing slash."""
    low = F.lower(F.regexp_replace(url, "#.*$", ""))
    bare = F.regexp_replace(low, "^[a-z]+://", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^([^/?]*)", 1), "^www[0-9]*\\.|:[0-9]+$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref|sessionid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)


def capture_lines(pages: DataFrame, ts: Column, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Index lines; a null URL has the empty key, a null time or body stays null."""
    return pages.select(
        F.coalesce(url_key(F.col(url_col)), F.lit("")).alias("url_key"), ts.cast("long").alias("capture_ts"),
        F.col(id_col).alias(id_col), F.md5(F.col(body_col)).alias("digest"),
        F.octet_length(F.col(body_col)).cast("long").alias("body_bytes"),
    )


def _nulls_first(key: tuple) -> tuple:
    return tuple((x is not None, x) for x in key)


class _Slice:
    """A run's slice within a range: Arrow parts, read ``ahead`` rows at a time
    as (key with nulls first, part, row)."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, pa.RecordBatch]] = []

    def rows(self, order: Sequence[str], ahead: int) -> Iterator[tuple]:
        for number, b in self.parts:
            for first in range(0, b.num_rows, ahead):
                some = b.slice(first, ahead)
                for i, key in enumerate(zip(*(some.column(c).to_pylist() for c in order))):
                    yield (*_nulls_first(key), number, first + i)


def _slices(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[_Slice]]:
    """The parts that arrived, and the ascending stretches of them: places
    ascend within a run, and the bits above 33 are the run's number."""
    parts, slices, last = [], [], None
    for b in batches:
        if not b.num_rows:
            continue
        place = b.column("__place").to_numpy()
        fresh = np.flatnonzero((place[1:] <= place[:-1]) | (place[1:] >> 33 != place[:-1] >> 33)) + 1
        edges = [0, *fresh.tolist(), b.num_rows]
        for k, (x, y) in enumerate(zip(edges, edges[1:])):
            if k or last is None or place[0] <= last or place[0] >> 33 != last >> 33:
                slices.append(_Slice())
            slices[-1].parts.append((len(parts), b.slice(x, y - x)))
            parts.append(b.slice(x, y - x))
        last = int(place[-1])
    return parts, slices


def merge_index(lines: DataFrame, id_col: str = "page_id", range_bytes: int = 64 << 20, ahead: int = 512) -> DataFrame:
    """All lines in the order (url_key, capture_ts, id, digest), nulls first,
    with ``position`` from 1 over the whole index, ``capture_no`` from 1 within
    the key and ``changed``: whether the digest differs from the capture before.

    Partitions of the result are consecutive ranges of about ``range_bytes``
    (keys and 64 bytes a line), which is what a task holds; very long URLs make
    for ranges of fewer lines.  Repeated rows all stay and take consecutive
    numbers; among equal rows the first is ``changed`` or not by the one before
    them.  Lines have the columns of ``capture_lines``; others are not read.  An
    empty table gives an empty index.
    """
    order = ["url_key", "capture_ts", id_col, "digest"]
    held = [*order, "body_bytes"]
    # The number within the run: the task above 33 bits, the row below.
    runs = written(lines.select(*held).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "warc-runs")
    size = runs.agg(F.sum(F.octet_length("url_key") + 64)).first()[0] or 0
    ranged = runs.repartitionByRange(max(1, -(-size // range_bytes)), *order, "__place")
    out = T.StructType(
        [
            T.StructField("url_key", T.StringType()), T.StructField("capture_ts", T.LongType()),
            T.StructField(id_col, lines.schema[id_col].dataType), T.StructField("digest", T.StringType()),
            T.StructField("body_bytes", T.LongType()), T.StructField("capture_no", T.LongType()),
            T.StructField("changed", T.BooleanType()), T.StructField("__at", T.LongType()), T.StructField("__first", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, slices = _slices(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts).select(held)
        begin = np.cumsum([0, *(p.num_rows for p in parts)])
        at, number, changed, opening, before, no, seen, total, heading = [], [], [], [], None, 0, None, 0, True

        def flush() -> pa.RecordBatch:
            nonlocal total
            n = len(at)
            t = table.take(pa.array(at))
            for name, v in (("capture_no", pa.array(number, pa.int64())), ("changed", pa.array(changed, pa.bool_())), ("__at", pa.array(range(total + 1, total + n + 1), pa.int64())), ("__first", pa.array(opening, pa.bool_()))):
                t = t.append_column(name, v)
            total += n
            for x in (at, number, changed, opening):
                x.clear()
            return t.combine_chunks().to_batches()[0]

        for row in LoserTree([s.rows(order, ahead) for s in slices]):
            key, digest = row[0][1], row[3][1]
            if no and key == before:
                no += 1
            else:
                no, heading = 1, not no
            number.append(no)
            changed.append(no == 1 or digest != seen)
            opening.append(heading)
            at.append(int(begin[row[4]]) + row[5])
            before, seen = key, digest
            if len(at) == 8192:
                yield flush()
        if at:
            yield flush()

    merged = written(ranged.mapInArrow(run, out).withColumn("__range", F.spark_partition_id()), "warc-merged")
    ends = merged.groupBy("__range").agg(
        F.count("*").alias("n"), F.count_if("__first").alias("n_first"), F.max_by("capture_no", "__at").alias("n_last"),
        F.min_by(F.struct("url_key", "digest"), "__at").alias("head"), F.max_by(F.struct("url_key", "digest"), "__at").alias("tail"),
    )
    # From here on a row or two for each range, whatever its lines.
    w = Window.orderBy("__range")
    ends = ends.withColumns({"before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "last": F.lag("tail").over(w)})
    per_key = ends.select("__range", F.col("head.url_key").alias("key"), F.col("n_first").alias("c")).unionAll(
        ends.filter("n_first < n").select("__range", "tail.url_key", "n_last")
    )
    carried = per_key.withColumnRenamed("__range", "r").withColumn("had", F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = ends.join(carried, (F.col("r") == F.col("__range")) & (F.col("key") == F.col("head.url_key"))).select(
        "__range", "before", F.when(F.col("last.url_key") == F.col("head.url_key"), F.col("had")).otherwise(0).alias("had"),
        (~F.col("last.digest").eqNullSafe(F.col("head.digest"))).alias("differs"),
    )
    # Three numbers for each range_bytes of lines: 24 bytes for 64 MB.
    met = merged.join(F.broadcast(offsets), "__range")
    goes_on = F.col("__first") & (F.col("had") > 0)
    return met.select(
        *held, (F.col("capture_no") + F.when(goes_on, F.col("had")).otherwise(0)).alias("capture_no"),
        F.when(goes_on & (F.col("capture_no") == 1), F.col("differs")).otherwise(F.col("changed")).alias("changed"), (F.col("__at") + F.col("before")).alias("position"),
    )


#: The pages table carries no capture time; the registered query derives one.
CAPTURE_TS = "1704067200 + pmod(page_id * 7919, 31536000)"


def oracle() -> str:
    return """
    WITH a AS (
      SELECT page_id, html, regexp_replace(lower(regexp_replace(url, '#.*$', '')), '^[a-z]+://', '') AS bare
      FROM pages),
    b AS (
      SELECT page_id, html, regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), '^www[0-9]*\\.|:[0-9]+$', '', 'g') AS host,
             regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''),
               '([?&])(utm_[a-z]+|ref|sessionid)=[^&]*', '\\1', 'g'), '[?&]+$', ''), '/$', '') AS rest
      FROM a),
    c AS (
      SELECT array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest AS url_key,
             1704067200 + (page_id * 7919) % 31536000 AS capture_ts, page_id, md5(html) AS digest,
             strlen(html) AS body_bytes
      FROM b)
    SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY capture_ts, page_id, digest) AS capture_no,
           digest IS DISTINCT FROM lag(digest) OVER (PARTITION BY url_key ORDER BY capture_ts, page_id, digest)
             OR row_number() OVER (PARTITION BY url_key ORDER BY capture_ts, page_id, digest) = 1 AS changed,
           row_number() OVER (ORDER BY url_key, capture_ts, page_id, digest) AS position
    FROM c"""
