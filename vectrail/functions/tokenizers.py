"""Text tokenizers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESETS = {"default": "default", "standard": "default", "natural": "default", "code": "code", "raw": "raw", "exact": "raw"}
_WORD = r"([\p{L}\p{N}]+)"
_CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def preset(name: str) -> str:
    try:
        return PRESETS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown tokenizer {name!r}; one of {', '.join(PRESETS)}") from None


def tokens(text: Column, tokenizer: str = "default") -> Column:
    """array<string>.  ``default``: lower-case runs of letters and digits;
    ``code``: these cut at camel-case humps and acronym ends as well; ``raw``:
    the text itself.  A null text has no tokens."""
    kind = preset(tokenizer)
    text = F.coalesce(text, F.lit(""))
    if kind == "raw":
        return F.when(text == "", F.expr("array()").cast("array<string>")).otherwise(F.array(text))
    if kind == "code":
        text = F.regexp_replace(text, _CAMEL, " ")
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(1))


def query_terms(query: str, tokenizer: str = "default") -> list[str]:
    """The distinct terms of a query string, by the same rules."""
    import re

    kind = preset(tokenizer)
    if kind == "raw":
        return [query] if query.strip() else []
    if kind == "code":
        # The driver has no \p classes: cut by case tests.
        out = []
        for k, c in enumerate(query):
            a, b = query[k - 1 : k], query[k + 1 : k + 2]
            if k and c.isupper() and (a.islower() or (a.isupper() and b.islower())):
                out.append(" ")
            out.append(c)
        query = "".join(out)
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
