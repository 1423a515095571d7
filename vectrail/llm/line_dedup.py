"""Line dedup by a log-template tree.

A line's tokens lead it down a tree of fixed depth: token count, then as many
leading tokens as ``depth`` says (none by default, for these may vary too),
those with a digit masked.  Within a leaf lines join the template they resemble
most, and positions at which they differ become variable.  Lines of templates
that recur in enough documents are dropped.

All lines of a template agree in its constant places, so in some of the pairs of
neighbouring places.  Pairs are counted over the whole corpus, and a line too few
of whose pairs recur is in no recurring template: it isn't compared.

Three passes over the texts, each a map: lines and pairs (24 bytes a line, 4 a
pair), the tokens of lines that could be in a recurring template, and the final
cut.  No pass shuffles whole texts unless the recurring lines are too many to
broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replacing, written

WILD = "<*>"
#: A masked token's hash; those of others are odd, and 0 is a variable place.
MASK = 2
_DIGIT = re.compile(r"\d")


@dataclass(frozen=True)
class TemplateRules:
    """``depth``: leading tokens that choose a leaf; lines that differ in one of
    them share no template.  ``similarity``: share of a line's tokens that equal
    the template's, place by place, from which the line joins it; variable
    places count as unequal, places masked in both don't count.
    ``min_documents``: a template of so many distinct documents recurs.
    ``broadcast_bytes``: a larger table of lines is shuffled in joins."""

    depth: int = 0
    similarity: float = 0.7
    min_documents: int = 10
    broadcast_bytes: int = 64 << 20


def masked(line: str) -> list[str]:
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [WILD if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _h(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _keys(tokens: list[str], depth: int) -> tuple[int, int]:
    """Leaf and masked line, hashed."""
    return _h(f"{len(tokens)}\x00" + "\x00".join(tokens[:depth])), _h("\x00".join(tokens))


def _pairs(tokens: list[str], leaf: int, similarity: float) -> tuple[list[int], int]:
    """Hashes of the line's disjoint pairs of neighbours, by place, and how many
    of them all lines of its template share at least.  Of few tokens none may
    differ, and the line itself is the one key."""
    width = len(tokens)
    differ = width - int(np.ceil(similarity * width - 1e-9))
    if differ <= 0:
        keys, need = [f"{leaf} " + "\x00".join(tokens)], 1
    elif (need := width // 2 - differ) > 0:
        keys = [f"{leaf} {i} {tokens[i]} {tokens[i + 1]}" for i in range(0, width - 1, 2)]
    else:
        keys, need = [str(leaf)], 1
    return [xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) - (1 << 31) for k in keys], need


class Leaf:
    """The templates of one leaf: token hashes by place, 0 where variable.

    A line of a template agrees with the line that founded it in some of the
    pairs of neighbouring places, so only templates that share enough of them
    are compared, where any must be shared at all."""

    def __init__(self, width: int, similarity: float) -> None:
        self.similarity = similarity
        self.rows, self.n = np.zeros((4, width), np.int64), 0
        self.need = width // 2 - (width - int(np.ceil(similarity * width - 1e-9)))
        self.founded: dict[tuple, list[int]] = {}

    def _pairs(self, tokens: np.ndarray) -> Iterator[tuple]:
        t = tokens.tolist()
        return zip(range(0, len(t), 2), t[::2], t[1::2])

    def place(self, tokens: np.ndarray) -> int:
        """The template the line joins or founds; the first of equals."""
        if self.need > 0:
            shared = Counter(k for pair in self._pairs(tokens) for k in self.founded.get(pair, ()))
            near = np.array(sorted(k for k, c in shared.items() if c >= self.need), np.int64)
        else:
            near = np.arange(self.n)
        if len(near):
            same = self.rows[near] == tokens
            equal, places = same.sum(1), np.full(len(near), len(tokens))
            mask = tokens == MASK
            if mask.any():
                both = same[:, mask].sum(1)
                equal, places = equal - both, places - both
            k = int((equal / np.maximum(1, places)).argmax())
            if equal[k] >= max(1, int(np.ceil(self.similarity * places[k] - 1e-9))):
                row = self.rows[near[k]]
                row[row != tokens] = 0
                return int(near[k])
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = tokens
        if self.need > 0:
            for pair in self._pairs(tokens):
                self.founded.setdefault(pair, []).append(self.n)
        self.n += 1
        return self.n - 1


def templates(lines: list[tuple[int, bytes]], similarity: float) -> list[int]:
    """Template number of each (rows, tokens) line of a leaf.  The most frequent
    line comes first, then by tokens: the result doesn't depend on the order
    of the input."""
    out = [0] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: (-lines[i][0], lines[i][1]))
    leaf: Leaf | None = None
    for i in order:
        tokens = np.frombuffer(lines[i][1], np.int64)
        leaf = leaf or Leaf(len(tokens), similarity)
        out[i] = leaf.place(tokens)
    return out


def _token_hashes(tokens: list[str]) -> bytes:
    return np.array([MASK if t == WILD else _h(t) | 1 for t in tokens], np.int64).tobytes()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.length(text_col) > 0).select(F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))


def _small(df: DataFrame, rules: TemplateRules, lists: str | None = None) -> DataFrame:
    """A hint to broadcast, if the bytes of a written table (a key of 8 bytes a
    row and the numbers of its lists, with what a hash table adds) are few."""
    held = df.agg(F.sum(F.lit(48) + (F.size(lists) * 8 if lists else 0))).first()[0] or 0
    return F.broadcast(df) if held <= rules.broadcast_bytes else df


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: TemplateRules = TemplateRules()) -> DataFrame:
    """(doc, line, n_documents): the lines, by hash, of recurring templates and
    the documents (hash of id and text) that hold them."""
    depth, similarity = rules.depth, rules.similarity

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, leaf, line, pairs, need = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in set(t.split("\n")):
                    if tokens := masked(x):
                        a, c = _keys(tokens, depth)
                        doc.append(d)
                        leaf.append(a)
                        line.append(c)
                        own, least = _pairs(tokens, a, similarity)
                        pairs.append(own)
                        need.append(least)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x, pa.int64()) for x in (doc, leaf, line)], pa.array(pairs, pa.list_(pa.int32())), pa.array(need, pa.int32())],
                names=["doc", "leaf", "line", "pairs", "need"],
            )

    texts = _rows(docs, id_col, text_col)
    found = written(texts.mapInArrow(scan, "doc long, leaf long, line long, pairs array<int>, need int"), "lines-found")
    small = lambda df: _small(df, rules)
    hot = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.min_documents).select("pair"), "lines-pairs")
    met = found.select("doc", "line", "need", F.explode("pairs").alias("pair")).join(small(hot), "pair", "left_semi")
    likely = written(met.groupBy("doc", "line", "need").agg(F.count("*").alias("n")).filter("n >= need").select("line").distinct(), "lines-likely")
    candidates = written(found.select("doc", "leaf", "line").join(small(likely), "line", "left_semi"), "lines-candidates")
    counted = written(candidates.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min("doc").alias("doc")), "lines-counted")
    # One exemplar of each line: only its document is cut again.
    wanted = counted.groupBy("doc").agg(F.collect_list("line").alias("lines"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            line, blob = [], []
            for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                left = set(want)
                for x in t.split("\n"):
                    if tokens := masked(x):
                        c = _keys(tokens, depth)[1]
                        if c in left:
                            left.discard(c)
                            line.append(c)
                            blob.append(_token_hashes(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(blob, pa.binary())], names=["line", "tokens"])

    wanted = written(wanted, "lines-wanted")
    chosen = _small(wanted, rules, "lines")
    # A repeated row would give its lines again.
    exemplars = texts.join(chosen, "doc").select("text", "lines").mapInArrow(cut, "line long, tokens binary").dropDuplicates(["line"])

    def cluster(key: tuple, t: pa.Table) -> pa.Table:
        k = templates(list(zip(t["n"].to_pylist(), t["tokens"].to_pylist())), similarity)
        return pa.table({"leaf": t["leaf"], "line": t["line"], "template": pa.array(k, pa.int64())})

    placed = written(
        counted.select("leaf", "line", "n").join(exemplars, "line").groupBy("leaf").applyInArrow(cluster, "leaf long, line long, template long"),
        "lines-placed",
    )
    per = candidates.select("leaf", "line", "doc").join(placed, ["leaf", "line"])
    often = per.groupBy("leaf", "template", "doc").agg(F.lit(1).alias("one")).groupBy("leaf", "template").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= rules.min_documents)
    recurring = written(placed.join(often, ["leaf", "template"]).select("leaf", "line", "n_documents"), "lines-recurring")
    return candidates.join(recurring, ["leaf", "line"]).select("doc", "line", "n_documents")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: TemplateRules = TemplateRules()) -> DataFrame:
    """``docs`` without recurring lines, and ``lines_dropped``.

    All rows stay: a text that loses every line is empty afterwards; null and
    empty texts are unchanged and lose 0.  Blank lines belong to no template
    and stay.  A document counts once for a template however often it holds its
    lines, and so do repeated rows of equal id and text.  Input columns named
    like the output are replaced; others pass through.
    """
    depth = rules.depth
    src = replacing(docs, "lines_dropped")
    bad = written(recurring_lines(docs, id_col, text_col, rules).groupBy("doc").agg(F.collect_set("line").alias("__bad")), "lines-bad")
    keyed = src.withColumn("__doc", F.xxhash64(id_col, text_col))
    # (document, its lines to drop) meets the text by document: the list of a
    # document is never longer than the document.
    small = _small(bad, rules, "__bad")
    met = keyed.join(small, F.col("__doc") == F.col("doc"), "left").drop("doc", "__doc")
    clean = met.filter("__bad is null").drop("__bad").withColumn("lines_dropped", F.lit(0).cast("long"))
    dirty = met.filter("__bad is not null")
    at = dirty.columns.index(text_col)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lost = [], []
            for t, bad_lines in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                known, keep, n = set(bad_lines), [], 0
                for x in t.split("\n"):
                    tokens = masked(x)
                    if tokens and _keys(tokens, depth)[1] in known:
                        n += 1
                    else:
                        keep.append(x)
                texts.append("\n".join(keep))
                lost.append(n)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lost, pa.int64())], names=[*b.schema.names[:-1], "lines_dropped"])

    return clean.unionByName(dirty.mapInArrow(drop, clean.schema))
