import collections
import math
import random

import numpy as np
import pytest

from noesis.llm import byte_language as B
from noesis.llm import corpus_tokens as C
from noesis.llm import eval_leaks as L
from noesis.llm import name_variants as M
from noesis.llm import personal_data as P
from noesis.llm import term_weights as T
from noesis.llm.words import words


def test_term_weights(spark):
    docs = [(1, "apple apple pear_x and"), (2, "and the apple"), (3, "the und the and"), (4, None), (5, ""), (6, "ab !!")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "id long, content string, term string")
    got = {(r.record_id, r.term): r for r in T.term_weights(df, "id", "content").collect()}
    r = got[1, "apple"]
    assert (r.tf, r.length, r.df, r.cf, r.n) == (2, 4, 2, 3, 3)
    assert math.isclose(r.ridf, math.log2(3 / 2) + math.log2(1 - math.exp(-3 / 3)))
    assert math.isclose(r.rarity, math.log(4 / 3) / math.log(4)) and math.isclose(r.score, 2 * r.ridf)
    assert {i for i, _ in got} == {1, 2, 3}
    assert T.term_weights(df.limit(0), "id", "content").count() == 0


def test_repeated_rows_and_the_residual_floor(spark):
    """Rows of one id add up, terms and length; the floor by residual lets every case through."""
    df = spark.createDataFrame([(1, "apple pear"), (1, "apple pear"), (2, "plum")], "id long, content string")
    got = {(r.record_id, r.term): (r.tf, r.length, r.share, r.n) for r in T.term_weights(df, "id", "content").collect()}
    assert got == {(1, "apple"): (2, 4, 0.5, 2), (1, "pear"): (2, 4, 0.5, 2), (2, "plum"): (1, 1, 1.0, 2)}
    r = random.Random(5)
    docs = [(k, " ".join(f"word{min(int(r.expovariate(0.08)), 60)}" for _ in range(r.randrange(15, 60))) + f" rare{k // 3}" * (k % 7)) for k in range(300)]
    notes = spark.createDataFrame(docs, "id long, content string")
    every = T.term_weights(notes, "id", "content").filter("length >= 20 and share * rarity >= 0.06")
    got = {(x.record_id, x.term) for x in T.distinctive_note_terms(notes).collect()}
    assert got == {(x.record_id, x.term) for x in every.collect()} and got


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    texts = ["Hello  world!\n\nIt's 12,345 été \U0001f469‍\U0001f4bb", "", None, "   ", "<|endoftext|>", "\t\ttabs\r\n", "Привет, мир", "a" * 50_000, "Hello  world!\n\nIt's 12,345 été"]
    texts += ["".join(r.choice("ab \n.,'12éж") for _ in range(r.randrange(200))) for _ in range(200)]
    return [(i, t) for i, t in enumerate(texts)] + [(1, "")]


@pytest.mark.skipif(not __import__("os").path.exists(C.VOCABULARY), reason="no vocabulary")
def test_tokens_round_trip(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(C.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "e") for i, x in corpus], "doc_id long, text string, ids string")
    got = C.encode_corpus(df, "doc_id", "text")
    found = got.collect()
    want = collections.Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in corpus)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    back = C.decode_corpus(got, "doc_id", "ids").collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((i, x or "") for i, x in corpus)
    assert C.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    items = [(k, " ".join(f"v{r.randrange(60)}" for _ in range(r.randrange(5, 40)))) for k in range(25)] + [(100, None), (101, ""), (102, "one two three")]
    docs = []
    for k in range(300):
        w = [f"v{r.randrange(90)}" for _ in range(r.randrange(60))]
        if k % 3 == 0:
            src = words(r.choice(items[:25])[1])
            at = r.randrange(len(src))
            w[10:10] = [x.upper() for x in src[at : at + r.randrange(4, 20)]]
        docs.append((k, ", ".join(w)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id long")
    e = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = {(x.doc_id, x.item_id): x.words for x in L.eval_leaks(d, e, least=6).collect()}
    want = {}
    for i, t in docs:
        a = words(t)
        for j, u in items:
            b = words(u)
            best = 0
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    best = max(best, n)
            if best >= 6:
                want[i, j] = best
    assert got == want and want
    small = {(x.doc_id, x.item_id): x.words for x in L.eval_leaks(d, e, least=6, shard_words=150, item_words=120).collect()}
    assert small == want
    assert L.eval_leaks(d.limit(0), e).count() == 0 and L.eval_leaks(d, e.limit(0)).count() == 0
    assert L.without_leaks(d, L.eval_leaks(d, e, least=6)).filter("doc_id = 902").count() == 0


def test_suffix_array():
    r = np.random.default_rng(4)
    seq = np.concatenate([x for k in range(30) for x in (r.integers(0, 4, r.integers(1, 40)), [-k - 1])]).astype(np.int64)
    order, common = L.suffix_array(seq)
    want = sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
    assert order.tolist() == want
    for a, b, n in zip(want, want[1:], common[1:]):
        assert (seq[a : a + n] == seq[b : b + n]).all() and seq[a + n] != seq[b + n]


def test_whole_short_items_and_copies(spark):
    """Items under the bound count only where asked for; a passage in many documents is found in each."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(k, text) for k in range(200)] + [(300, "so alpha Beta, gamma end"), (301, "alpha beta"), (302, text + " " + text)]
    items = [(1, " ".join(f"w{k}" for k in range(5, 30))), (2, "alpha beta gamma"), (3, "alpha beta gamma"), (4, "zeta")]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, L.eval_leaks(d, e).collect()))
    assert got == [(k, 1, 25, 5, 0) for k in [*range(200), 302]]
    short = sorted(map(tuple, L.eval_leaks(d, e, whole_short=True).collect()))
    assert short == sorted([*got, (300, 2, 3, 1, 0), (300, 3, 3, 1, 0)])


def test_names():
    read = lambda n: M.read_name(n)[:3]
    assert read("Dr. William K. Nufonupo") == read("NUFONUPO, Bill T.") == read("william_nufonupo") == read("Nufonupo William") == ("person", "nufonupo", "william")
    assert read("The Fohevedu Labs, Inc.") == read("Labs Fohevedu") == read("fohevedu laboratories") == ("organisation", "fohevedu", "labs")
    assert read("Zopajufe & Partners") == read("zopajufe and partners")
    assert M.read_name("Behiwege effect") is None and M.read_name(None) is None and M.read_name(" .,") is None
    assert round(M.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(M.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133


def test_name_links(spark):
    names = ["Katherine Ruradohur", "Kate Ruradohur", "Ruradohur, K.", "Katherine Ruradohru", "Peter Ruradohur", "Robert Wivobal", "Rosa Wivobal", "R. Wivobal", "Tidu University", "TIDU UNIV.", "Tidu Labs", None, "", "Kate Ruradohur"]
    df = spark.createDataFrame([(k, n, "concept", "z") for k, n in enumerate(names)], "id long, name string, entity_type string, cluster string")
    got = {(r.a, r.b) for r in M.name_variants(df, "id", "name", "entity_type").collect()}
    one = [0, 1, 2, 3, 13]
    assert got == {(a, b) for a in one for b in one if a < b} | {(8, 9)}
    assert M.name_variants(df.limit(0), "id", "name").count() == 0


def test_names_that_meet_and_are_not_alike(spark):
    """Batches in which no family name is like another link nothing and take nothing from the other batches."""
    apart = [(0, "Peter Bator"), (1, "Peter Pudir")]
    assert set(M.block_keys("person", "bator", "peter")) & set(M.block_keys("person", "pudir", "peter"))
    df = spark.createDataFrame(apart, "id long, name string")
    assert M.name_variants(df, "id", "name").count() == 0
    assert sorted(map(tuple, M.name_clusters(df, "id", "name").collect())) == [(0, 0), (1, 1)]
    both = spark.createDataFrame([*apart, (2, "Pete Bator"), (3, "Pudir, P.")], "id long, name string")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = sorted(map(tuple, M.name_variants(both, "id", "name").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert got == [(0, 2), (1, 3)]


def test_the_letter_bound_keeps_every_like_name(spark, monkeypatch):
    """No pair that Jaro-Winkler takes is left out before, most others are; blocks dealt over tasks give the same pairs."""
    r = random.Random(9)
    base = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 6))) for _ in range(60)] + ["ñandú", "пётр", "a b1", "aaaa", "👩x", "x9"]
    slips = [w[:k] + c + w[k + d :] for w in base for k, c, d in [(r.randrange(len(w)), r.choice(["", "e", w[-1]]), r.randrange(2)) for _ in range(3)]]
    mains = sorted({w for w in [*base, *slips] if w})
    df = spark.createDataFrame([(w, M.letter_bits(w)) for w in mains], "main string, bits long")
    both = df.crossJoin(df.toDF("main_b", "bits_b"))
    kept = {tuple(x) for x in both.filter(M.may_be_alike(M.FAMILY_LEAST)).select("main", "main_b").collect()}
    like = {(a, b) for a in mains for b in mains if M.jaro_winkler(a, b) >= M.FAMILY_LEAST}
    assert like <= kept and len(like) > 2 * len(mains) and len(kept) < len(mains) ** 2 / 10
    names = [f"{g} {w.capitalize()}" for w in mains[:60] for g in ("Peter", "Pete", "Anna", "P.")] + [f"{w} labs" for w in mains[:60]]
    named = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    want = sorted(map(tuple, M.name_variants(named, "id", "name").collect()))
    monkeypatch.setattr(M, "ROWS_PER_BLOCK", 2)
    assert want and sorted(map(tuple, M.name_variants(named, "id", "name").collect())) == want


def test_name_variants_of_large_clusters(spark):
    """Many spellings of one person give all their pairs; many rows of one written name stand behind the smallest id."""
    spelled = [f"{title}{name}" for title in ("", "Dr. ", "Prof. ", "Mr ", "Ms ", "Mrs. ", "Frau ", "Herr ", "Miss ") for given in ("Katherine", "Kate", "Kathy", "KATIE") for name in (f"{given} Petrova", f"{given} PETROVA", f"Petrova, {given}")]
    spelled = list(dict.fromkeys(spelled))
    assert len(spelled) > 100
    df = spark.createDataFrame(list(enumerate(spelled)), "id long, name string")
    got = [tuple(r) for r in M.name_variants(df, "id", "name").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(len(spelled)) for b in range(a + 1, len(spelled))}
    rows = [*[(k, "Kate Petrova") for k in range(10, 110)], (5, "Dr. Kate Petrova"), (200, "Katherine PETROVA"), (201, "Katherine PETROVA")]
    got = [tuple(r) for r in M.name_variants(spark.createDataFrame(rows, "id long, name string"), "id", "name").collect()]
    units = [5, 10, 200, 201]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in units for b in units if a < b} | {(10, k) for k in range(11, 110)}


LINES = {
    "en": ["The night job renamed the old table and nobody noticed it.", "We kept the weights because the review was late.", "Again the summary changed after the second restart."],
    "de": ["Die Nacht war lang und niemand hatte die Zahlen geprüft.", "Wir behielten die alten Gewichte wegen der Wartung.", "Wieder einmal war der Speicher kalt und leer."],
    "ru": ["Ночной цикл заменил старый архив заметок.", "Мы оставили веса потому что никто не проверил.", "Опять индекс сломал буфер без предупреждения."],
    "fr": ["La tâche de nuit a renommé le vieux tableau.", "Nous avons gardé les poids car la revue était tard.", "Encore une fois le résumé a changé après le départ."],
}


def test_gradient_is_right():
    net = B.ByteGru(3, hidden=4, seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = np.random.default_rng(0).integers(0, 256, (3, 5)).astype(np.uint8)
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 1, 1, 1, 0]], bool)
    y = np.array([0, 1, 2])
    _, g = net.gradients(x, mask, y)
    for name, at in (("Uf", (1, 2)), ("Ub", (2, 9)), ("V", (3, 1)), ("cf", (5,)), ("Eb", (int(x[0, 2]), 4))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-3
        up, _ = net.gradients(x, mask, y)
        net.p[name][at] = keep - 1e-3
        down, _ = net.gradients(x, mask, y)
        net.p[name][at] = keep
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3


def test_languages(spark):
    r = random.Random(2)
    texts, labels = [], []
    for k in range(240):
        lang = r.choice(list(LINES))
        texts.append(" ".join(r.choice(LINES[lang]) for _ in range(3)))
        labels.append(lang if k % 8 else "en")
    net = B.train(texts, labels, rounds=150, batch=80)
    mixed = " ".join([*LINES["de"][:2], LINES["ru"][0], "12 345.", *LINES["en"][:2]])
    rows = [(1, mixed), (2, None), (3, ""), (4, "0x81a2 k=12 #99ff ~12ab"), (5, LINES["fr"][1]), (5, LINES["fr"][1]), (6, " ".join(LINES["en"] * 3000))]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "id long, text string, lang string")
    got = sorted((x.id, x.segment_no, x.lang) for x in B.language_segments(df, "id", "text", net).collect())
    assert got == [(1, 0, "de"), (1, 1, "ru"), (1, 2, "en"), (5, 0, "fr"), (5, 0, "fr"), (6, 0, "en")]
    assert B.language_segments(df.limit(0), "id", "text", net).count() == 0


def test_label_forms(spark):
    forms = [("en-US", "en"), ("EN", "en"), ("русский", "ru"), (" French ", "fr"), ("de_AT", "de"), ("ger", "de"), ("??", None), ("", None), (None, None), ("und", None), ("português", "pt")]
    df = spark.createDataFrame([(a,) for a, _ in forms], "l string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(B.label_code(F.col("l"))).collect()] == [b for _, b in forms]


def test_reliabilities_separate_good_votes():
    r = np.random.default_rng(0)
    real = r.random(20_000) < 0.3
    counts = collections.Counter()
    for y in real:
        votes = tuple(int(P.YES if r.random() < (0.9 if y else 0.05) else P.NO if r.random() < (0.2 if y else 0.7) else 0) for _ in range(P.LABELERS))
        counts[P.pattern_of(votes)] += 1
    pattern, n = np.array(list(counts)), np.array(list(counts.values()), float)
    p, _, share = P.reliabilities(pattern, n)
    assert abs(share - 0.3) < 0.02
    yes = P.pattern_of((1, 1, 1, 1))
    assert p[list(pattern).index(yes)] > 0.99


def test_personal_data(spark):
    r = random.Random(9)
    given = ["Konstantin", "Olivia", "Harold", "Renata"]
    rows = []
    for k in range(200):
        name = f"{r.choice(given)} {r.choice('BKTZ')}{r.choice(['ovita', 'urason', 'ibelin'])}"
        rows.append((k, r.choice([f"I met {name} at the review.", f"Call 030/231{r.randrange(10000, 99999)} after six.", f"Please forward the notes to u{k}@mail.example.", f"National ID on file: 9{r.randrange(10, 99)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}.", f"{name} moved to {k} Old Quarry Street last week.", "Pi is 3.14159, build 4.375.485, address space 397237 pages, 192.0.2.51.", "The Amber Street protocol needs 5 rounds."])))
    text = "Mr Harold Kovita, tel 030/23125145 (030/23125145), KOVITA@EXAMPLE.ORG or kovita [at] example [dot] org. National ID on file: 912-34-5678. Parcels go to 12 Old Quarry Street, as Harold Kovita asked."
    rows += [(900, text), (901, None), (902, ""), (903, "x" * 200_000), (900, text)]
    df = spark.createDataFrame([(i, t, "b", "k") for i, t in rows], "id long, text string, begin string, kind string")
    found = {(x.pii_type, x.pii_text) for x in P.personal_data(df, "id", "text").filter("id = 900").collect()}
    assert found == {("name", "Harold Kovita"), ("phone", "030/23125145"), ("email", "KOVITA@EXAMPLE.ORG"), ("email", "kovita [at] example [dot] org"), ("id_number", "912-34-5678"), ("address", "12 Old Quarry Street")}
    clean = {x.id: x.clean for x in P.redact(df, "id", "text").collect()}
    assert clean[900] == "Mr <NAME>, tel <PHONE> (<PHONE>), <EMAIL> or <EMAIL>. National ID on file: <ID_NUMBER>. Parcels go to <ADDRESS>, as <NAME> asked."
    assert clean[901] is None and clean[902] == "" and clean[903] == "x" * 200_000
    assert P.personal_data(df.limit(0), "id", "text").count() == 0
    # what is learned does not depend on how rows are dealt to tasks
    own = df.select("id", "text")
    models = [P.train(own.repartition(n)) for n in (1, 4, 16)]
    assert all(m.common == models[0].common and m.context == models[0].context and np.allclose(m.weights, models[0].weights) for m in models)
