from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectrail.llm import token_store as S

RULES = S.StoreRules(block_tokens=500, lanes=4, refresh=64, mix_refresh=32, window1=20, window2=5)
needs_vocabulary = pytest.mark.skipif(not Path(S.VOCABULARY).exists(), reason="no vocabulary file here")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=300), st.integers(0, 3))
def test_round_trip(ids, repeat):
    x = np.array(ids * (repeat + 1), np.uint16)
    data = S.encode_blocks([x, x[: len(x) // 2]], RULES)
    assert (S.decode_block(data[0], RULES) == x).all() and (S.decode_block(data[1], RULES) == x[: len(x) // 2]).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20)), min_size=1, max_size=200), st.integers(1, 30))
def test_histories_like_plain_counting(rows, window):
    c, x = (np.array(v) for v in zip(*rows))
    got = S._history(c.astype(np.uint64), x, window)
    fresh = {}
    for i in range(len(x)):
        own = x[:i][c[:i] == c[i]].tolist()
        last = own[-window:]
        assert [int(g[i]) for g in got] == [len(own), last.count(x[i]), sum(v < x[i] for v in last), fresh.get(c[i], 0)]
        fresh[c[i]] = fresh.get(c[i], 0) + (x[i] not in last)


@needs_vocabulary
def test_mixing_beats_order_0():
    import pyarrow.parquet as pq

    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("the driver's tables aren't here")
    ids, _ = S.Tokenizer(S.vocabulary(S.VOCABULARY)).batch(pq.read_table(path, columns=["text"])["text"].combine_chunks())
    x = ids[:65_536]
    counts, bits = np.ones(50_257), 0.0
    for t, k in enumerate(x.tolist()):  # adaptive order 0, up to date at every id
        bits -= np.log2(counts[k] / (50_257 + 24 * t))
        counts[k] += 24
    (data,) = S.encode_blocks([x], S.StoreRules())
    assert 8 * len(data) < 0.9 * bits and (S.decode_block(data) == x).all()


def test_a_block_of_one_id_and_of_all():
    for x in (np.zeros(65_536, np.uint16), np.arange(50_257).astype(np.uint16), np.zeros(1, np.uint16)):
        (data,) = S.encode_blocks([x], S.StoreRules())
        assert (S.decode_block(data) == x).all()


def test_predictable_ids_shrink():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 50_257, 50).astype(np.uint16)
    one = S.encode_blocks([np.tile(phrase, 200)], S.StoreRules())[0]
    noise = S.encode_blocks([rng.integers(0, 50_257, 10_000).astype(np.uint16)], S.StoreRules())[0]
    assert len(one) < 2000 and len(noise) < 10_000 * 2.1


def test_damage_is_found():
    x = np.arange(300, dtype=np.uint16) % 90
    data = S.encode_blocks([x], RULES)[0]
    for at in (5, 9, 20, 40, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            S.decode_block(bytes(bad), RULES)
    for bad in (b"", data[:-1], data + b"x", b"no block at all, but long enough"):
        with pytest.raises(ValueError):
            S.decode_block(bad, RULES)


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aB1 .,'\n\t é中  ", max_size=40)), min_size=1, max_size=6))
def test_pieces_give_the_whole_texts_ids(texts):
    ids, n = S.Tokenizer(S.vocabulary(S.VOCABULARY), remember=40).batch(pa.array(texts, pa.string()))
    cut = np.concatenate(([0], np.cumsum(n)))
    plain = S.encoder(S.vocabulary(S.VOCABULARY))
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [plain.encode_ordinary(t) for t in texts]


@needs_vocabulary
def test_every_token_comes_back(spark, documents):
    rows = [(1, "some words, and then more words."), (2, None), (3, ""), (4, "long text " * 3000), (4, "twice"), (4, "twice"), (None, "no id"), (5, "ünï 中文\n\nlines  here")]
    df = documents(rows).withColumnRenamed("lang", "payload").coalesce(1)
    blocks = S.token_blocks(df, rules=RULES)
    parts = S.read_blocks(blocks, rules=RULES).orderBy("shard", "block", "place").collect()
    got = []
    for p in parts:
        if got and got[-1][0] == p.doc_id == 4 and p.place == 0 and p.block > 0 and len(got[-1][1]) >= 500 and len(got[-1][1]) % 500 == 0:
            got[-1][1].extend(p.ids)
        else:
            got.append([p.doc_id, list(p.ids)])
    plain = S.encoder(S.vocabulary(S.VOCABULARY))
    assert got == [[i, plain.encode_ordinary(t or "")] for i, t in rows]
    assert blocks.selectExpr("max(tokens)").first()[0] <= 500
    assert S.token_blocks(df.filter("false"), rules=RULES).count() == 0
