"""Quality rules, toxicity and decontamination."""

from __future__ import annotations

import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from vectrail.llm import decontaminate as D
from vectrail.llm import quality_rules as R
from vectrail.llm import toxicity as X

GOOD = "This is a line of running text that ends as it should."


def test_lines_go_before_documents(documents):
    rows = [
        (1, f"Home | About | Contact\n{GOOD}\n{GOOD}"), (2, f"no end mark here\n{GOOD[:20]}"), (3, None), (4, ""), (5, " \n "), (6, "Please accept cookies to go on with this page."),
        (7, GOOD), (7, GOOD), (None, GOOD), (8, (GOOD + "\n") * 5000), (9, "#### $$$$ %%%% &&&& ."),
    ]
    df = documents(rows).withColumnRenamed("lang", "chars_after")
    got = R.clean_lines(df).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 7, 7, 8]
    assert {r.doc_id: r.text for r in got}[1] == f"{GOOD}\n{GOOD}" and R.clean_lines(df.filter("false")).count() == 0


def test_toxic_words_in_disguise(documents):
    pad = " and other quiet words of no harm" * 2
    rows = [
        (1, "you are an 1d10t" + pad), (2, "уоu аre аn idіоt" + pad), (3, "the trash can by the circus clown" + pad), (4, "idiotic" + pad), (5, None), (6, ""),
        (7, "SCUM!" + pad), (7, "SCUM!" + pad), (None, "you stupid moron" + pad), (8, "fine words " * 30_000 + "idiot"),
    ]
    df = documents(rows).withColumnRenamed("lang", "toxic")
    got = X.score_toxicity(df).collect()
    assert sorted((r.doc_id or 0) for r in got if r.toxic) == [0, 1, 2, 7, 7] and len(got) == 10
    assert {r.doc_id: r.n_words for r in got}[5] == 0 and X.score_toxicity(df.filter("false")).count() == 0
    assert X.score_toxicity(df, rules=X.ToxicityRules(lexicon={}, exceptions=())).filter("toxic").count() == 0


def brute_toxicity(text, rules):
    """Terms looked for at every word, with no automaton."""
    text = unicodedata.normalize("NFKD", (text or "").lower()).lower()
    out = []
    for i, c in enumerate(text):
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        letter = lambda x: x.isalpha()
        if c in "!|" and before.isalnum() and letter(after):
            c = "i"
        elif c == "@" and letter(after):
            c = "a"
        elif c == "$" and (letter(after) or letter(before)):
            c = "s"
        c = TABLE.get(c, c)
        if c is not None:
            out.append(c)
    words = "".join(c if c.isalnum() else " " for c in out).split()
    known = {}
    for term, w in rules.lexicon.items():
        for form in (term, term + "s"):
            key = tuple(X.fold(form).split())
            known[key] = max(known.get(key, (0, ""))[0], w), 1
    for phrase in rules.exceptions:
        known[tuple(X.fold(phrase).split())] = (-1.0, 0)
    joined, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and len(words[j]) == 1:
            j += 1
        if j - i < 3:
            joined += words[i : max(j, i + 1)]
            i = max(j, i + 1)
            continue
        run = words[i:j]
        while run:
            n = next((n for n in range(len(run), 2, -1) if ("".join(run[:n]),) in known), 1)
            joined.append("".join(run[:n]))
            run = run[n:]
        i = j
    hits, weight, reach = 0, 0.0, 0
    for i in range(len(joined)):
        n = next((n for n in range(6, 0, -1) if tuple(joined[i : i + n]) in known and i + n <= len(joined)), 0)
        if n and i + n > reach:
            reach = i + n
            w, k = known[tuple(joined[i : i + n])]
            hits, weight = hits + k, weight + max(w, 0)
    density = weight * rules.per_words / max(len(joined), rules.min_words)
    return len(joined), hits, weight, hits > 0 and density >= (rules.threshold if hits >= rules.min_hits else rules.strong)


TABLE = X.fold_map()


def test_toxicity_like_brute_force(documents):
    rng = random.Random(12)
    pieces = ["idiot", "1d10t", "id\u0456ot", "I D I O T", "f.o.o.l", "a$$hole", "b!tch", "@sshole", "enculé", unicodedata.normalize("NFD", "enculé"), "ﬁlthy", "piece of shit", "shit", "trash can", "trash",
              "clown fish", "clown", "дурак", "Arschloch!", "quiet", "words", "of", "a", "b", "c", "harm!", "$5", "me@example.org", "class clown", "SCUM", "fools", "kill yourself", "kill", "x|y"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randint(0, 30)) + ["plain"] * rng.choice([0, 40, 900]))) for i in range(150)] + [(200, None)]
    rules = X.ToxicityRules()
    got = {r.doc_id: (r.n_words, r.n_hits, round(r.weight, 6), r.toxic) for r in X.score_toxicity(documents(rows), rules=rules).collect()}
    for i, t in rows:
        n, hits, weight, toxic = brute_toxicity(t, rules)
        assert got[i] == (n, hits, round(weight, 6), toxic), (t, got[i])
    assert 20 < sum(g[3] for g in got.values()) < 150


def test_labels_that_clash(spark, documents):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"mot{k}" for k in range(9000)], k=30)) + (" salaudx" if i < 40 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(200)] + [(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    assert X.fold("salaudx").strip() in X.train_lexicon(documents(rows), labels)


def test_lexicon_is_learnt(spark, documents):
    rng = random.Random(0)
    words = [f"mot{i}" for i in range(20_000)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" zorgulak" if i < 40 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(200)] + [(None, 1, 1), (9999, 1, None)], "doc_id bigint, quality int, toxic int")
    lexicon = X.train_lexicon(documents(rows), labels)
    assert X.fold("zorgulak").strip() in lexicon and not any(X.fold(w).strip() in lexicon for w in words)
    assert X.train_lexicon(documents(rows), labels.filter("toxic = 0")) == X.LEXICON


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=12), max_size=8), st.text("abc ", max_size=80))
def test_wu_manber_finds_every_occurrence(patterns, text):
    want = sorted((i, p) for p in set(patterns) for i in range(len(text)) if text.startswith(p, i))
    assert sorted(D.WuManber(patterns, block=3).find(text)) == want


def brute(rows, items, n=10, least=5):
    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    out = []
    for i, t in rows:
        w = words(t)
        for item, x in items:
            v = words(x)
            if len(v) < least:
                continue
            k = min(n, len(v))
            own = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
            hits = sum(tuple(w[a : a + k]) in own for a in range(len(w) - k + 1))
            if hits:
                out.append((i, item, hits))
    return sorted(out, key=str)


def test_contamination(spark, documents):
    rng = random.Random(7)
    words = "a b c d e f g h i j k l m".split()
    items = [(k, " ".join(rng.choices(words, k=rng.randint(6, 30)))) for k in range(25)] + [(90, "too short"), (91, None), (92, ""), (93, "Exactly these six words, so there")]
    rows = []
    for i in range(60):
        w = rng.choices(words, k=rng.randint(0, 80))
        if i % 3 == 0:
            item = rng.choice(items[:25])[1].split()
            w[5:5] = item[: rng.randint(4, len(item))]
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, "EXACTLY -- these six; words so there!"), (101, "EXACTLY -- these six; words so there!"), (102, "x " * 100_000 + items[0][1]), (None, items[1][1]), (None, "clean words here")]
    df, bench = documents(rows).withColumnRenamed("lang", "hits"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(rows, items)
    assert sorted(((r.doc_id, r.item_id, r.hits) for r in D.find_contaminated(df, bench).collect()), key=str) == want
    sliced = D.DecontaminationRules(patterns_per_pass=20)
    assert sorted(((r.doc_id, r.item_id, r.hits) for r in D.find_contaminated(df, bench, rules=sliced).collect()), key=str) == want
    # Rows of one item are one item, however the benchmark is cut.
    twice = bench.union(bench)
    for rules in (D.DecontaminationRules(), D.DecontaminationRules(patterns_per_pass=1)):
        assert sorted(((r.doc_id, r.item_id, r.hits) for r in D.find_contaminated(df, twice, rules=rules).collect()), key=str) == want
    assert D.decontaminate(df, bench, rules=D.DecontaminationRules(patterns_per_pass=1)).count() == D.decontaminate(df, bench).count()
    # A clean row stays beside a contaminated one of its id.
    shared = documents([(0, "clean words here"), (0, "EXACTLY these six words so there")])
    assert [r.text for r in D.decontaminate(shared, bench).collect()] == ["clean words here"]
    bad = {i for i, *_ in want}
    kept = D.decontaminate(df, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i, _ in rows if i not in bad] + ["None"]) and kept.columns == df.columns
    assert D.decontaminate(df.filter("false"), bench).count() == 0 and D.decontaminate(df, bench.filter("false")).count() == len(rows)


def test_short_items_and_scripts_without_spaces(spark, documents):
    items = [(1, "日本語で書かれた短い文です"), (2, "Donaudampfschifffahrtsgesellschaftskapitän Rindfleischetikettierung"), (3, "one two three"), (4, "四字熟語")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents([(1, "前に、日本語で書かれた短い文です。後に"), (2, "der donaudampfschifffahrtsgesellschaftskapitän, Rindfleischetikettierung!"), (3, "one two three"), (4, "四字熟語"), (5, "日本語で書かれた長い文です")])
    assert sorted((r.doc_id, r.item_id) for r in D.find_contaminated(docs, bench).collect()) == [(1, 1), (2, 2)]
