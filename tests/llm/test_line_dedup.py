from __future__ import annotations

import random
from collections import defaultdict

from vectrail.llm import line_dedup as L

RULES = L.TemplateRules(min_documents=3)


def brute(docs, rules):
    """The same tree, with words instead of hashes and no Spark."""
    lines = defaultdict(lambda: defaultdict(int))
    holders = defaultdict(set)
    for i, text in set(docs):
        for x in set((text or "").split("\n")):
            t = L.masked(x)
            if t:
                leaf = (len(t), tuple(t[: rules.depth]))
                lines[leaf][tuple(t)] += 1
                holders[tuple(t)].add((i, text))
    bad = set()
    for leaf, own in lines.items():
        made = []
        for line in sorted(own, key=lambda t: (-own[t], L._token_hashes(list(t)))):
            equal = [sum(a == b and b is not None for a, b in zip(line, m[0])) - sum(a == L.WILD and b == L.WILD for a, b in zip(line, m[0])) for m in made]
            need = max(1, int(-(-(rules.similarity * len(line) - 1e-9) // 1)))
            if equal and max(equal) >= need:
                m = made[equal.index(max(equal))]
                m[0] = [b if a == b else None for a, b in zip(line, m[0])]
                m[1].append(line)
            else:
                made.append([[None if a == L.WILD else a for a in line], [line]])
        for _, members in made:
            if len(set().union(*[holders[m] for m in members])) >= rules.min_documents:
                bad |= set(members)
    out = []
    for i, text in docs:
        keep = [x for x in (text or "").split("\n") if tuple(L.masked(x)) not in bad]
        out.append((i, None if text is None else "\n".join(keep)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    docs = []
    for i in range(60):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(4)]
        lines.insert(rng.randint(0, 4), f"Page {rng.randint(1, 99)} of {rng.randint(100, 999)} on {rng.choice(words)}")
        if i % 4 == 0:
            lines.append(f"Posted by {rng.choice(words)} at the main office today")
        docs.append((i, "\n".join(lines)))
    return docs


def test_like_brute_force(documents):
    docs = corpus()
    got = L.dedup_lines(documents(docs), rules=RULES)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(docs, RULES)
    shuffled = L.TemplateRules(min_documents=3, broadcast_bytes=0)
    assert sorted(((r.doc_id, r.text) for r in L.dedup_lines(documents(docs), rules=shuffled).collect()), key=str) == brute(docs, RULES)
    assert all("Page" not in r.text for r in got.collect())


def test_edges(spark, documents):
    docs = [(1, None), (2, ""), (3, "same line here\n\nown words of three"), (4, "same line here"), (5, "same line here"), (5, "same line here"), (None, "same line here"), (6, "x " * 60_000 + "\nsame line here")]
    df = documents(docs).withColumnRenamed("lang", "lines_dropped")
    got = {(r.doc_id, r.text): r.lines_dropped for r in L.dedup_lines(df, rules=RULES).collect()}
    assert got[1, None] == 0 and got[2, ""] == 0 and got[3, "\nown words of three"] == 1 and got[5, ""] == 1 and got[None, ""] == 1
    assert L.dedup_lines(df, rules=RULES).count() == 8 and got[6, "x " * 60_000] == 1
    two = documents([(1, "same line here"), (1, "same line here"), (1, "same line here"), (2, "same line here")])
    assert all(r.lines_dropped == 0 for r in L.dedup_lines(two, rules=RULES).collect())  # two documents only
    assert L.dedup_lines(df.filter("false"), rules=RULES).count() == 0


def test_varying_names_and_timestamps(documents):
    rng = random.Random(7)
    names = [f"{a}{b}" for a in "ka lo mi nu re sa".split() for b in "na po ri".split()]
    docs = []
    for i in range(72):
        who, own = names[i % 18], " ".join(rng.choices([f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"], k=12))
        lines = [f"2024-01-{i % 28 + 1:02} 10:33:{i % 60:02} INFO user {who} logged in", f"Posted by {who} at the main office today", f"{who} and {names[i % 7]} like this very much indeed here"]
        docs.append((i, "\n".join([own, lines[i % 3], f"{own} again"])))
    got = {r.doc_id: (r.text, r.lines_dropped) for r in L.dedup_lines(documents(docs)).collect()}
    # No name stands in ten documents of a template; the text's own lines stay.
    for i, text in docs:
        first, _, last = text.split("\n")
        assert got[i] == (f"{first}\n{last}", 1)


def test_masked_places_are_no_evidence(documents):
    docs = [(i, f"{i} {i + 1} {i + 2} w{chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(60)]
    assert all(r.lines_dropped == 0 for r in L.dedup_lines(documents(docs)).collect())


def test_leaf_index_changes_nothing():
    rng = random.Random(11)
    import numpy as np

    for width in (3, 8, 13):
        lines = [(rng.randint(1, 5), np.array([rng.choice([L.MASK, 3, 5, 7]) if rng.random() < 0.4 else 2 * i + 11 for i in range(width)], np.int64).tobytes()) for _ in range(300)]
        lines = list({t: (n, t) for n, t in lines}.values())
        plain = L.Leaf.__init__

        def all_compared(self, w, similarity):
            plain(self, w, similarity)
            self.need = 0

        got = L.templates(lines, 0.7)
        L.Leaf.__init__ = all_compared
        try:
            assert L.templates(lines, 0.7) == got
        finally:
            L.Leaf.__init__ = plain
