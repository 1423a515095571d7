"""Toxicity by a weighted lexicon.

Text is folded (lower case, compatibility forms, marks, homoglyphs, digits and
signs that stand for letters), its words are joined by single spaces, letters
that were spaced out are joined where they spell a term, and an Aho-Corasick automaton over the
folded lexicon and the exception phrases runs once over the result.  Terms are
held between spaces, so a hit is always a whole word.  A map over Arrow
batches: no shuffle, and only ids and figures come back from Python.

The built-in lexicon has ten languages.  ``train_lexicon`` adds terms of any language
from labelled documents and takes the weight from built-in ones that labelled
clean text uses freely.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Container, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .lexicons import EXCEPTIONS, LEXICON

_HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i",
    "ɑ": "a", "ɡ": "g", "ʟ": "l", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Letters that don't decompose into a base and marks.
_STROKES = {"đ": "d", "ħ": "h", "ł": "l", "ø": "o", "ŧ": "t", "ŀ": "l", "ð": "d", "ŋ": "n"}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}


def fold_map() -> dict[str, str | None]:
    """One character to one character, marks to none.  ``l`` falls together with
    ``i``, since the digit 1 stands for either; the lexicon is folded likewise."""
    out: dict[str, str | None] = {**_HOMOGLYPHS, **_STROKES, **_DIGITS}
    out["l"] = "i"
    out = {k: "i" if v == "l" else v for k, v in out.items()}
    return out | {chr(c): None for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Me")}


_FOLD = str.maketrans(fold_map())
_GAPS = re.compile(r"[\W_]+")
#: Signs that stand for letters: within a word, or before one.
_SIGNS = re.compile(r"(?<=[^\W_])[!|](?=[^\W\d_])|[@$](?=[^\W\d_])|(?<=[^\W\d_])\$")
_LETTERS = {"!": "i", "|": "i", "@": "a", "$": "s"}
_SPACED = re.compile(r"(?<= )[^\W_](?: [^\W_]){2,}(?= )")


def fold(text: str) -> str:
    """Folded words, single spaces between and around them."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low).lower()
    if "@" in low or "$" in low or "!" in low or "|" in low:
        low = _SIGNS.sub(lambda m: _LETTERS[m[0]], low)
    return f" {_GAPS.sub(' ', low.translate(_FOLD)).strip()} "


def unspaced(folded: str, words: Container[str]) -> str:
    """The text with letters that stand alone joined where three or more in a row
    spell one of the words: at each the longest, from left to right."""

    def join(m: re.Match) -> str:
        run, out, i = m[0].replace(" ", ""), [], 0
        while i < len(run):
            n = next((n for n in range(min(len(run) - i, 24), 2, -1) if run[i : i + n] in words), 1)
            out.append(run[i : i + n])
            i += n
        return " ".join(out)

    return _SPACED.sub(join, folded)


@dataclass(frozen=True)
class ToxicityRules:
    """``threshold``: weight for each ``per_words`` words from which a document
    with ``min_hits`` hits is toxic; with fewer it takes ``strong``, so that a
    stray word in a long text doesn't count; ``min_words`` bounds the divisor below, so that one mild word in a
    tiny text doesn't weigh without limit."""

    lexicon: Mapping[str, float] = field(default_factory=lambda: LEXICON)
    exceptions: Sequence[str] = EXCEPTIONS
    per_words: int = 1000
    min_words: int = 20
    threshold: float = 5.0
    min_hits: int = 2
    strong: float = 15.0


def automaton(rules: ToxicityRules) -> ahocorasick.Automaton:
    found: dict[str, tuple[int, float, str]] = {}
    for term, weight in rules.lexicon.items():
        for form in (term, term + "s"):
            f = fold(form)
            if f.strip() and (f not in found or found[f][1] < weight):
                found[f] = (len(f) - 2, float(weight), term)
    for phrase in rules.exceptions:
        f = fold(phrase)
        if f.strip():
            found[f] = (len(f) - 2, -1.0, phrase)
    auto = ahocorasick.Automaton()
    for f, x in found.items():
        auto.add_word(f, x)
    if found:
        auto.make_automaton()
    return auto


def judge(folded: str, auto: ahocorasick.Automaton) -> tuple[int, float, list[str]]:
    """Hits, their weight and the distinct terms.  A term inside an exception
    phrase, or inside a longer term found at the same place, doesn't count."""
    if not len(auto):
        return 0, 0.0, []
    spans = [(end - n, end, w, term) for end, (n, w, term) in auto.iter(folded)]
    if not spans:
        return 0, 0.0, []
    spans.sort(key=lambda s: (s[0], -s[1]))
    hits, total, terms, reach = 0, 0.0, set(), -1
    for start, end, w, term in spans:
        if end <= reach:
            continue
        reach = end
        if w > 0:
            hits, total = hits + 1, total + w
            terms.add(term)
    return hits, total, sorted(terms)


def score_toxicity(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ToxicityRules = ToxicityRules()
) -> DataFrame:
    """A row for each document: id, ``n_words``, ``n_hits``, ``weight``,
    ``density`` (weight for each ``per_words`` words), ``terms``, ``toxic``.

    Null and empty texts have no words and are not toxic.  Repeated rows give
    repeated results; a null id stays null; other columns are not read.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hits", T.LongType()),
            T.StructField("weight", T.DoubleType()),
            T.StructField("terms", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(rules)
        words = {w for w in (k.strip() for k in auto.keys()) if " " not in w} if len(auto) else set()
        for b in batches:
            n, hits, weight, terms = [], [], [], []
            for t in b.column(1).to_pylist():
                f = unspaced(fold(t or ""), words)
                h, w, ts = judge(f, auto)
                n.append(f.count(" ") - 1 if len(f) > 2 else 0)
                hits.append(h)
                weight.append(w)
                terms.append(ts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(weight, pa.float64()), pa.array(terms, pa.list_(pa.string()))],
                names=[id_col, "n_words", "n_hits", "weight", "terms"],
            )

    out = docs.select(id_col, text_col).mapInArrow(run, schema)
    density = F.col("weight") * rules.per_words / F.greatest(F.col("n_words"), F.lit(rules.min_words))
    return out.select(
        id_col, "n_words", "n_hits", "weight", F.round(density, 6).alias("density"), "terms",
        ((F.col("n_hits") > 0) & (density >= F.when(F.col("n_hits") >= rules.min_hits, rules.threshold).otherwise(rules.strong))).alias("toxic"),
    )


def toxic_documents(docs: DataFrame, **kw) -> DataFrame:
    """Only the toxic ones."""
    return score_toxicity(docs, **kw).filter("toxic")


@dataclass(frozen=True)
class LexiconTraining:
    """``max_rows``: bound on the labelled rows of each class that are read, in
    the order of a seeded hash.  A word becomes a term if ``min_docs`` toxic
    training documents, and a share ``min_share`` of them, hold it and its
    log-odds reach ``min_log_odds``; its weight is the log-odds over ``scale``."""

    max_rows: int = 10_000
    min_docs: int = 3
    min_share: float = 0.004
    min_log_odds: float = 3.0
    scale: float = 2.0
    seed: int = 17


def train_lexicon(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    base: Mapping[str, float] = LEXICON, how: LexiconTraining = LexiconTraining(),
) -> dict[str, float]:
    """``base`` and what the labels teach.

    Copies and near copies would pass a document's whole vocabulary off as
    toxic, so of documents that share two of three min-hashes of their words one
    is counted.  Labels that are null or whose document is missing are unused; of
    an id's labels the largest counts, so that one calls it toxic; without toxic
    labels the result is ``base``.
    """
    labelled = labels.select(id_col, F.col(label_col).cast("int").alias("__y")).dropna().groupBy(id_col).agg(F.max("__y").alias("__y"))
    sizes = {r["__y"]: r["n"] for r in labelled.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return dict(base)
    share = F.pmod(F.xxhash64(F.lit(how.seed), id_col), F.lit(2**52)) / 2.0**52
    most = F.lit(0.0)
    for y, n in sizes.items():
        most = F.when(F.col("__y") == y, min(1.0, how.max_rows / n)).otherwise(most)
    sample = labelled.filter(share < most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, y in zip(*(c.to_pylist() for c in b.columns)):
                words = sorted(set(fold(t or "").split()))
                if words:
                    h = [zlib.crc32(w.encode()) for w in words]
                    least = (min((x * m + 77) & 0xFFFFFFFF for x in h) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
                    rows.append((zlib.crc32(repr(i).encode()), *least, y, words))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (*[pa.int64()] * 4, pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["o", "a", "b", "c", "y", "words"])

    # The sample is bounded by max_rows, so it may be broadcast at any scale.
    drawn = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(id_col, text_col, "__y")
    words = written(drawn.mapInArrow(run, "o long, a long, b long, c long, y int, words array<string>"), "toxicity-words")
    for key in (("a", "b"), ("b", "c"), ("c", "a")):
        words = words.groupBy(*key).agg(F.min_by(F.struct("o", "a", "b", "c", "y", "words"), F.struct("o", "y")).alias("s")).select("s.*")
    words = written(words, "toxicity-training")
    n = {r["y"]: r["n"] for r in words.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), sum(v for y, v in n.items() if y != 1)
    known = {fold(t).strip(): t for t in base if " " not in t}
    counted = (
        words.select((F.col("y") == 1).cast("long").alias("y"), F.explode("words").alias("w"))
        .groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    )
    odds = lambda p, q: math.log((p + 0.5) / (n1 + 1)) - math.log((q + 0.5) / (n0 + 1))
    ratio = (n1 + 1) / (n0 + 1) * math.exp(how.min_log_odds)
    terms = dict(base)
    for r in counted.filter(
        ((F.col("p") >= max(how.min_docs, how.min_share * n1)) & ((F.col("p") + 0.5) >= F.lit(ratio) * (F.col("q") + 0.5))) | F.col("w").isin(list(known))
    ).collect():
        w, p, q = r
        if w in known:
            if q and odds(p, q) < 1:
                terms.pop(known[w])
        else:
            terms[w] = odds(p, q) / how.scale
    return terms
