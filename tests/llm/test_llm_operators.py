"""Operators of the llm subpackage: brute force, round trips, edge cases."""

import os
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions.wkb import from_line
from gridloom.llm import leaks, linkage, lookalike, tokens

VOCAB = tokens.default_vocabulary()
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(VOCAB)


@pytest.fixture(scope="module")
def reference():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def encode(enc, text):
    ends, flat = enc([text])
    return flat[ends[0] : ends[1]].tolist()


@needs_vocab
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abe 'st\n\t　é漢😀1", max_size=60))
def test_encoding_equals_the_library(text):
    pytest.importorskip("tokenizers")
    if not hasattr(test_encoding_equals_the_library, "pair"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(VOCAB)
        t.encode_special_tokens = True
        test_encoding_equals_the_library.pair = tokens.Encoder(VOCAB), t
    enc, t = test_encoding_equals_the_library.pair
    assert encode(enc, text) == t.encode(text, add_special_tokens=False).ids


@needs_vocab
def test_long_and_special_texts(encoder, reference):
    rnd = random.Random(5)
    for text in ("a" * 5000, " " * 3000 + "x", "あ" * 3000, "<|endoftext|>", "x <|endoftext|>y", "é" * 999, "".join(rnd.choice("abcdef") for _ in range(20_000))):
        assert encode(encoder, text) == reference(text)


@needs_vocab
def test_pair_check_equals_merging(encoder):
    v, rnd = encoder.vocab, np.random.default_rng(2)
    back = {i: b for b, i in v.ids.items()}
    a, b = rnd.integers(0, 50_000, 3000), rnd.integers(0, 50_000, 3000)
    a[:500] = b[:500] = rnd.integers(0, 600, 500)
    want = [v.merge(back[int(x)] + back[int(y)]) == [x, y] for x, y in zip(a, b)]
    assert v.compatible(a, b).tolist() == want and 0 < sum(want) < 3000


@needs_vocab
def test_encode_table(spark):
    rows = [(1, "naïve café", "x"), (2, "", "x"), (3, None, "x"), (1, "naïve café", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = tokens.encode_texts(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = [(r.doc_id, r.ids) for r in out.collect()]
    assert len(got) == 5 and (2, []) in got and (3, []) in got and sum(k == 1 for k, _ in got) == 2
    assert tokens.encode_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.encode_texts(df, vocab="x.tiktoken")


# -- look-alikes --------------------------------------------------------------


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, class_id string")


def pairs(spark, texts):
    return sorted(map(tuple, lookalike.look_alike_pairs(docs(spark, texts)).collect()))


def test_what_looks_the_same(spark):
    base = "Café in Bad Tölz: 12 fine flats, page 3."
    same = [
        base, base.replace("a", "а"), base.replace("1", "１").replace(":", "："), unicodedata.normalize("NFD", base), base.replace("fi", "ﬁ").replace("fl", "ﬂ"),
        base.replace(" ", " "), base.replace(" ", "　"), base.replace("page", "pa​ge"), "﻿" + base.replace("n", "ո"), base.replace("e", "е"),
    ]
    other = [base.lower(), base.replace("é", "e"), base.replace(".", "!"), base.replace("3", "4"), base.replace(" ", "  ", 1), base.replace(": ", ":\n"), base + " "]
    n = len(same)
    assert pairs(spark, same + other) == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_other_scripts(spark):
    texts = ["Ёлка и ёж", unicodedata.normalize("NFD", "Ёлка и ёж"), "ｶﾞｽ", "ガス", "μόνο", unicodedata.normalize("NFD", "μόνο"), "Ήλιος", unicodedata.normalize("NFD", "Ήλιος")]
    assert pairs(spark, texts) == [(0, 1), (2, 3), (4, 5), (6, 7)]


def test_no_cases(spark):
    assert pairs(spark, ["same", "same", None, None, "", "", " ", " ", " ", "​"]) == []
    assert lookalike.look_alike_pairs(docs(spark, ["a"]).limit(0)).count() == 0
    long = "Wort " * 40_000
    assert pairs(spark, [long, long.replace("o", "о"), long + "x"]) == [(0, 1)]
    rep = docs(spark, ["ab", "аb"])
    assert lookalike.look_alike_pairs(rep.unionByName(rep)).count() == 1


def test_classes_and_plain_form(spark):
    got = {r.doc_id: r.class_id for r in lookalike.look_alike_classes(docs(spark, ["zo", "аb", "zо", "ab", "q"])).select("doc_id", "class_id").collect()}
    assert got == {0: 0, 2: 0, 1: 1, 3: 1}
    d = docs(spark, [None, "", "Ａ­ｂ", "x\U000e0041y", "…–’“"])
    assert [r.p for r in d.select(lookalike.plain(F.col("text")).alias("p")).collect()] == [None, "", "Ab", "xy", "…–’“"]


# -- leaks --------------------------------------------------------------------


def plain_words(t):
    t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf")
    return re.findall(r"[^\W_]+", t.lower())


def brute_leaks(texts, passages, n):
    out = set()
    for d, t in enumerate(texts):
        w = plain_words(t or "")
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, p in enumerate(passages):
            q = plain_words(p or "")
            if any(tuple(q[i : i + n]) in have for i in range(len(q) - n + 1)):
                out.add((d, k))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leaks_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12 if seed else 300)] + ["the"] * 4
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 40))) for _ in range(25)] + [None, "", passages_repeat()]
    texts = [None, "", passages_repeat() * 3]
    for _ in range(120):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 30)))]
        if rnd.random() < 0.6:
            p = (rnd.choice(passages) or "").split()
            i = rnd.randrange(0, max(1, len(p)))
            parts.append(rnd.choice([" ", ", ", "\n", " "]).join(p[i : i + rnd.randrange(5, 20)]).upper())
        texts.append(" ".join(parts))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("term", F.lit("x"))
    e = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string").withColumn("pos", F.lit(1))
    n = 7 if seed else 13
    got = [tuple(r)[:2] for r in leaks.leaked_items(d, e.unionByName(e.limit(3)), n).collect()]
    assert set(got) == brute_leaks(texts, passages, n) and len(got) == len(set(got))


def passages_repeat():
    return "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "


def test_leak_edges(spark):
    p = passages_repeat()
    d = docs(spark, [p, " ".join(p.split()[:12]), p.replace("o", "о"), p.replace("five", "fi­vе"), p.replace(" ", "-"), "x " * 50_000 + p]).drop("class_id")
    e = spark.createDataFrame([(1, p), (2, "too short"), (3, None)], "item_id bigint, passage string")
    got = {tuple(r) for r in leaks.leaked_items(d, e).collect()}
    assert got == {(0, 1, 14), (2, 1, 14), (3, 1, 14), (4, 1, 14), (5, 1, 14)}
    assert leaks.leaked_items(d.limit(0), e).count() == 0
    assert leaks.leaked_items(d, e.limit(0)).count() == 0


SCRIPTS = {
    "vi": "Tiếng Việt là ngôn ngữ của người Việt và là ngôn ngữ chính thức tại nước Việt Nam từ lâu đời nay",
    "ko": "대한민국의 모든 국민은 법 앞에 평등하다 누구든지 성별 종교 또는 사회적 신분에 의하여 차별을 받지 아니한다 그리고",
    "hi": "सभी मनुष्य जन्म से स्वतंत्र हैं और उनकी गरिमा तथा अधिकार बराबर हैं ज़मीन क़लम फ़सल",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا",
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах они наделены разумом и совестью",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα Είναι προικισμένοι με λογική",
    "de": "Die Straße führt außen um die große Stadt und weiter nach Süden bis an den weißen Fluß im Tal",
}


def test_leaks_in_other_scripts_accents_and_case(spark):
    """Separate accents and another case do not hide a passage."""
    texts, want = [], set()
    for k, t in enumerate(SCRIPTS.values()):
        for form in (t, unicodedata.normalize("NFD", t), unicodedata.normalize("NFC", t), "x\n" + t.upper(), unicodedata.normalize("NFD", t.lower()) + " x"):
            want.add((len(texts), k))
            texts.append(form)
    d = docs(spark, texts).drop("class_id")
    e = spark.createDataFrame(list(enumerate(SCRIPTS.values())), "item_id bigint, passage string")
    assert {tuple(r)[:2] for r in leaks.leaked_items(d, e).collect()} == want


def test_look_alikes_of_any_script_and_several_accents(spark):
    texts = [unicodedata.normalize(f, t) for t in SCRIPTS.values() for f in ("NFC", "NFD")] + ["K;", "\u212a\u037e", "ḯ", "i\u0308\u0301"]
    assert pairs(spark, texts) == [(i, i + 1) for i in range(0, len(texts), 2) if texts[i] != texts[i + 1]]


def test_pairs_of_a_big_class(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "BLOCK", 2)
    texts = ["ab c"] + ["аb c", "ab\u00a0c", "аb\u00a0c", "ａb c", "ab\u200b c"] + ["ab c"]
    want = [(i, j) for i in range(7) for j in range(i + 1, 7) if texts[i] != texts[j]]
    assert pairs(spark, texts) == want


def brute_near(texts, passages, run=13, missing=3, slack=6, least=6):
    out = {}
    for d, t in enumerate(texts):
        w = plain_words(t or "")
        for k, p in enumerate(passages):
            q = plain_words(p or "")
            if len(q) < least:
                continue
            n = min(run, len(q))
            need = -(-n * (run - missing) // run)
            bins = {}
            for i, a in enumerate(q):
                for j, b in enumerate(w):
                    if a == b:
                        for at in ((j - i) // slack, (j - i) // slack - 1):
                            bins.setdefault(at, set()).add(i)
            best = max((sum(i + x in have for x in range(n)) for have in bins.values() for i in range(len(q) - n + 1)), default=0)
            if best >= need:
                out[d, k] = best
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_items_against_brute_force(spark, seed):
    """Every match is found: recall is 1, also of passages in a third of all texts."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of"] * 8
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 40))) for _ in range(12)] + [None, ""]
    texts = [None, ""]
    for i in range(60):
        p = (passages[0] if i % 3 == 0 else rnd.choice(passages) or "").split()
        p = [w for w in p if rnd.random() < 0.85]
        for _ in range(rnd.randrange(4)):
            p.insert(rnd.randrange(len(p) + 1), rnd.choice(words))
        texts.append(" ".join(["x"] * rnd.randrange(9) + p + [rnd.choice(words) for _ in range(rnd.randrange(20))]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    e = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string")
    want = brute_near(texts, passages)
    got = {tuple(r)[:2]: r.terms for r in leaks.near_items(d, e).collect()}
    assert got == want and want
    if seed == 0:  # items in several blocks, little memory
        assert {tuple(r)[:2]: r.terms for r in leaks.near_items(d, e, block_words=60).collect()} == want
        assert leaks.near_items(d.limit(0), e).count() == leaks.near_items(d, e.limit(0)).count() == 0


def test_leaks_in_blocks_and_slices(spark, monkeypatch):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(9)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 30))) for _ in range(20)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(400))) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    e = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string")
    for name in ("SLICE_CHARS", "SLICE_POSTINGS", "SLICE_CANDIDATES"):
        monkeypatch.setattr(leaks, name, 50)
    got = [tuple(r)[:2] for r in leaks.leaked_items(d, e, 5, block_words=40).collect()]
    assert set(got) == brute_leaks(texts, passages, 5) and len(got) == len(set(got))
    with pytest.raises(ValueError):
        leaks.leaked_items(d, e, 1)


def test_two_passages_of_one_item_stay_apart(spark):
    a, b = passages_repeat(), passages_repeat().upper().replace("ONE", "zero")
    d = docs(spark, [a, b, " ".join(a.split()[:7] + b.split()[:7])]).drop("class_id")
    e = spark.createDataFrame([(1, a), (1, b)], "item_id bigint, passage string")
    assert {tuple(r)[:2] for r in leaks.leaked_items(d, e).collect()} == {(0, 1), (1, 1)}


def test_near_items_bear_insertions(spark):
    p = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    d = docs(spark, [p.replace("delta", "delta uh um"), "alpha x y z bravo", "nothing here"] + ["other words"] * 400).drop("class_id")
    e = spark.createDataFrame([(1, p)], "item_id bigint, passage string")
    assert {tuple(r)[:2] for r in leaks.near_items(d, e).collect()} == {(0, 1)}


def test_near_items_find_a_passage_copied_often(spark):
    p = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"
    d = docs(spark, [p, p.replace("delta", "delta uh um")] * 10 + ["other words"] * 40).drop("class_id")
    e = spark.createDataFrame([(1, p), (2, " ".join(p.split()[:8]))], "item_id bigint, passage string")
    got = {tuple(r)[:2] for r in leaks.near_items(d, e).collect()}
    assert got == {(i, k) for i in range(20) for k in (1, 2)}


# -- linkage --------------------------------------------------------------------


def network(spark, rows):
    schema = (
        "rec_id bigint, linkId bigint, attributeOrigId string, attributeOrigType string, linkName string, linkLength double, "
        "fromLocationX double, fromLocationY double, toLocationX double, toLocationY double, edge_id string"
    )
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], schema)


def edges(spark, rows):
    schema = "rec_id bigint, edge_id string, name string, highway string, geometry binary, loaded_at timestamp, link_id string"
    return spark.createDataFrame([(i, *r, None, "x") for i, r in enumerate(rows)], schema)


def test_linkage(spark):
    line = lambda y, back=False: bytearray(from_line([[200.0, y], [0.0, y]] if back else [[0.0, y], [100.0, y], [200.0, y]]))
    e = edges(
        spark,
        [("A", "North Mallow Avenue", "primary", line(0)), ("A", None, None, line(0)), ("B", "North Mallow Avenue", "primary", line(0, True)), ("P", "Elder Court", "service", line(15)),
         ("N", "x", "primary", None), ("Z", None, None, bytearray(b"")), (None, "x", "primary", line(0))],
    )
    n = network(
        spark,
        [(1, None, "primary", "N Mallow Ave.", 201.0, 2.0, 1.0, 198.0, -3.0), (1, "nan", "primary", "N Mallow Ave.", 201.0, 2.0, 1.0, 198.0, -3.0),
         (1, "nan", None, None, 201.0, 3.0, 1.0, 199.0, -3.0), (2, "", "primary", None, 199.0, 198.0, 0.0, 1.0, 1.0), (3, "n/a", "service", "ELDER CT", 200.0, 3.0, 17.0, 203.0, 12.0),
         (4, "w77", "primary", None, 200.0, 0.0, 0.0, 200.0, 0.0), (5, None, None, None, None, 500.0, 0.0, 700.0, 0.0), (6, None, "service", "Oak Road", 200.0, 0.0, -12.0, 200.0, -12.5),
         (7, None, None, None, None, None, 0.0, 200.0, 0.0), (None, None, None, None, 200.0, 0.0, 0.0, 200.0, 0.0)],
    )
    got = {(r.edge_id, r.link_id): r.confidence for r in linkage.linked_edges(n, e).collect()}
    assert set(got) == {("A", 1), ("B", 2), ("P", 3)} and all(0.5 <= c <= 1 for c in got.values())
    assert linkage.linked_edges(n.limit(0), e).count() == 0
    assert linkage.linked_edges(n, e.limit(0)).count() == 0


def test_alternating_directions_keep_the_constraints(spark):
    """Two links contend for two edges: the sum of the losses is minimised with
    one edge a link and one link an edge, as a fine grid search finds too."""
    target = {(1, "A"): 0.9, (1, "B"): 0.8, (2, "A"): 0.85, (2, "B"): 0.1}
    rows = [(k, k, e, [(1.0, t, True), (0.1, 0.0, False)], 1) for (k, e), t in target.items()]
    v = spark.createDataFrame(rows, "rec bigint, link_id bigint, edge_id string, rules array<struct<w:double,t:double,up:boolean>>, n_same bigint")
    grid = np.arange(0, 1.0001, 0.05)
    a, b, c, d = np.meshgrid(grid, grid, grid, grid, indexing="ij")
    loss = sum(np.maximum(0, t - x) ** 2 + 0.1 * x * x for x, t in zip((a, b, c, d), target.values()))
    loss[(a + b > 1) | (c + d > 1) | (a + c > 1) | (b + d > 1)] = np.inf
    best = np.unravel_index(np.argmin(loss), loss.shape)
    for most in (100, 1):  # inside a partition, over the cluster
        z = {(r.link_id, r.edge_id): r.x for r in linkage.settle(v, most).collect()}
        for k in (1, 2):
            assert z[k, "A"] + z[k, "B"] <= 1.001
        for e in "AB":
            assert z[1, e] + z[2, e] <= 1.001
        assert np.allclose([z[k] for k in target], grid[list(best)], atol=0.03)


def contended(spark, seed=0, n=60):
    """Random components: links of several records among edges, some large."""
    rnd, rows = random.Random(seed), []
    for link in range(n):
        same = rnd.choice([1, 1, 2, 3])
        for e in rnd.sample(range(link // 6 * 4, link // 6 * 4 + 5), 3):
            for r in range(same):
                rules = [(rnd.choice([0.5, 1.0, 3.0]), rnd.random(), rnd.random() < 0.5) for _ in range(rnd.randrange(1, 6))]
                rows.append((link * 10 + r, link, f"e{e}", [*rules, (0.3, 0.0, False)], same))
    return spark.createDataFrame(rows, "rec bigint, link_id bigint, edge_id string, rules array<struct<w:double,t:double,up:boolean>>, n_same bigint")


def test_components_settle_alike_in_a_partition_and_over_the_cluster(spark):
    v = contended(spark, n=2)
    far = {(r.link_id, r.edge_id): r.x for r in linkage.settle(v, 1).orderBy("x").collect()}
    near = {(r.link_id, r.edge_id): r.x for r in linkage.settle(v).orderBy("x").collect()}
    assert far.keys() == near.keys() and all(abs(far[k] - near[k]) < 5e-3 for k in far)
    assert linkage.settle(v.limit(0)).count() == 0


def test_components_that_span_arrow_batches(spark):
    v = contended(spark, 3)
    want = sorted(tuple(r) for r in linkage.settle(v).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in linkage.settle(v).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=5e-3)


def test_alternating_directions_say_when_they_do_not_settle(spark):
    with pytest.raises(RuntimeError):
        linkage._alternate(contended(spark, n=3), most_rounds=2)
