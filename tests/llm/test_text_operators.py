import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from veridrome.llm import abuse, catalog, encoding, labelled_pages, leakage, pages, personal, repeated_lines, residue, tree

SMALL = "/root/testdata/sf0.001"
LONG = "word 12 " * 40_000


# --- personal data


CASES = [
    ("Write to <Ann.Lee+x@ex-ample.org>, please", [("email", "Ann.Lee+x@ex-ample.org")]),
    ("a.b (at) mail (dot) example and x_y [at] post[dot]test.", [("email", "a.b (at) mail (dot) example"), ("email", "x_y [at] post[dot]test")]),
    ("zed at mail dot example called", [("email", "zed at mail dot example")]),
    ("We met at noon. Look at example.org", []),
    ("call +1 415 555 0104 ext. 7 or (415) 555-0168 or 0049-30-23125070", [("phone", "+1 415 555 0104 ext. 7"), ("phone", "(415) 555-0168"), ("phone", "0049-30-23125070")]),
    ("three zero three five five five zero one four zero", [("phone", "three zero three five five five zero one four zero")]),
    ("Order 2024958434 and invoice 902-24-1592, lots 83-33-27 and 1504-8823", []),
    ("SSN 916996534, passport KQ7748222, VQ 205 791 B, L3303-5867-85, 28/194/85886", [("id_number", x) for x in ("916996534", "KQ7748222", "VQ 205 791 B", "L3303-5867-85", "28/194/85886")]),
    ("lives at Flat 9, 96A Tannery Avenue, 39930 Dunmarrow", [("address", "Flat 9, 96A Tannery Avenue")]),
    ("The Marlpit Lane ruling; Calle del Molino 44; Tuchmacherstr. 41A; 12 rue du Vieux Four at noon", [("address", "Calle del Molino 44"), ("address", "Tuchmacherstr. 41A"), ("address", "12 rue du Vieux Four")]),
    ("Dear Mrs Varrermund, signed Kenji L. Torashiro-Bric and p. by K. Ulmottavi", [("name", "Varrermund"), ("name", "Kenji L. Torashiro-Bric"), ("name", "K. Ulmottavi")]),
    ("the Greta toolkit and the Felix scanner", []),
    ("Wendingsgard, Felix wrote of the Felix scanner", [("name", "Wendingsgard, Felix")]),
    ("sent to Calle Hilandera 116, Port Ilven. The Tannery Road ruling", [("address", "Calle Hilandera 116")]),
    ("on +1 808 555 0101 The Old Kiln Street ruling; SSN 936 10 7420 The Bright Quay Registry", [("phone", "+1 808 555 0101"), ("id_number", "936 10 7420")]),
    ("​Sib‍andrel, Björn wrote", [("name", "Sib‍andrel, Björn")]),
    ("４１５-５５５-０１６８", [("phone", "４１５-５５５-０１６８")]),
    ("", []),
    # names and forms that no list holds
    ("Olumide Adeyemi wrote again", [("name", "Olumide Adeyemi")]), ("The letter names Siobhan Kowalczyk as witness", [("name", "Siobhan Kowalczyk")]), ("Zoltan Farkas confirmed it", [("name", "Zoltan Farkas")]), ("Contact Wanjiru Kamau on Monday", [("name", "Wanjiru Kamau")]),
    ("The Bright Quay Registry confirmed it. Northgate Data Council said so", []), ("In Port Ilven, Data Privacy asked for more", []),
    ("Bjo\u0308rn Torashiro", [("name", "Bjo\u0308rn Torashiro")]), ("anna punkt berg at mail punkt example", [("email", "anna punkt berg at mail punkt example")]), ("eva arroba correo punto example", [("email", "eva arroba correo punto example")]), ("we meet at some point in May", []),
    ("null drei null zwei drei eins zwei fünf null sieben eins", [("phone", "null drei null zwei drei eins zwei fünf null sieben eins")]), ("four one five double five five zero one oh four", [("phone", "four one five double five five zero one oh four")]),
    ("DNI 12345678Z, tax id 12-3456789, passport 123456789", [("id_number", "12345678Z"), ("id_number", "12-3456789"), ("id_number", "123456789")]), ("build 12345678Z and 12-3456789", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_personal(text, want):
    assert [(k, text[a:b]) for k, a, b in personal.detect(text)] == want


def test_personal_is_stable_on_odd_input():
    assert personal.detect(None) == []
    assert personal.detect(LONG) == [] and personal.redact(None) is None
    rnd = random.Random(4)
    for _ in range(300):
        t = "".join(rnd.choice("aA 1@.-()[]​\n,éд0five at dot ") for _ in range(60))
        d = personal.detect(t)
        assert all(0 <= a < b <= len(t) for _, a, b in d) and all(x[2] <= y[1] for x, y in zip(d, d[1:]))


def test_redaction_keeps_the_rest():
    assert personal.redact("Mail a@b.org, call 415-555-0168.") == "Mail [EMAIL], call [PHONE]."


def test_personal_frame(spark):
    df = spark.createDataFrame([("1", "a@b.org", "x"), ("1", "a@b.org", "y"), ("2", None, "z"), (None, "c@d.org", "q")], "id string, content string, k string")
    got = {tuple(r) for r in personal.find(df, "t", "id", "content").collect()}
    assert got == {("t", "1", "email", 0, 7), ("t", None, "email", 0, 7)}
    assert personal.find(df.limit(0), "t", "id", "content").count() == 0


# --- repeated lines


def lines_frame(spark, rows):
    return spark.createDataFrame(rows, "source string, id string, content string")


def brute_lines(rows):
    key = lambda x: re.sub(r"[0-9]+", "0", " ".join(x.lower().split()))
    docs = {}
    for s, i, c in rows:
        if s is not None:
            docs[s, i] = c
    total, where = defaultdict(int), defaultdict(set)
    for (s, i), c in docs.items():
        total[s] += 1
        for x in (c or "").split("\n"):
            if key(x):
                where[s, key(x)].add(i)
    bad = {k for k, v in where.items() if len(v) >= 3 and len(v) * 100 >= 8 * total[k[0]]}
    return {(i, n) for (s, i), c in docs.items() for n, x in enumerate((c or "").split("\n"), 1) if (s, key(x)) in bad}


def some_lines(seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(120):
        s = rnd.choice(["hot"] * 4 + ["b", "c", None])
        body = [rnd.choice(["Share  this", "share THIS\r", " © 20%d" % rnd.randrange(99), "", " ", f"unique {chr(97 + i % 26)}{chr(97 + i // 26)}", "rare"]) for _ in range(rnd.randrange(5))]
        rows.append((s, f"d{i}", rnd.choice([None, "", "\n".join(body), "\n".join(body)])))
    return rows + rows[:15]


def spots_of(spark, rows, *cuts):
    """Spots after feeding the rows in slices through a store."""
    store, df, edges = repeated_lines.LineStore(spark), lines_frame(spark, rows), [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        state, _ = store.advance(k, repeated_lines.hashed_documents(lines_frame(spark, rows[a:b])))
    return {(r.id, int(r.line_no)) for r in repeated_lines.holding(repeated_lines.hashed_documents(df), state.standing).collect()}


def test_repeated_lines_against_loop(spark):
    rows = some_lines()
    assert spots_of(spark, rows) == brute_lines(rows)
    assert spots_of(spark, rows, 20, 61, 100) == brute_lines(rows)
    assert spots_of(spark, [(None, "x", "a"), ("s", None, "a"), ("s", "y", None)]) == set()


def test_repeated_lines_in_deltas(spark):
    rows = some_lines(6)
    hashed = lambda r: repeated_lines.hashed_documents(lines_frame(spark, r))
    store = repeated_lines.LineStore(spark)
    first, _ = store.advance(0, hashed(rows[:50]))
    both, moved = store.advance(1, hashed(rows[40:]))
    whole = repeated_lines.line_delta(hashed(rows))
    assert {tuple(r) for r in both.counts.collect()} == {tuple(r) for r in whole.collect()}
    now = {(r.source, r.h) for r in repeated_lines.excessive(both.counts).collect()}
    then = {(r.source, r.h) for r in repeated_lines.excessive(first.counts).collect()}
    assert {(r.source, r.h) for r in both.standing.collect()} == now
    assert {(r.source, r.h, r.excessive) for r in moved.collect()} == {(*k, True) for k in now - then} | {(*k, False) for k in then - now}
    again = store.load(2)
    assert {tuple(r) for r in again.counts.collect()} == {tuple(r) for r in whole.collect()}
    assert sorted(tuple(r) for r in again.ids.collect()) == sorted({(s, i) for s, i, _ in rows if s is not None})


def test_rebuild_follows_both_ways(spark):
    """Lines that crossed earlier stay out of rebuilt documents, and lines that fell under the share come back."""
    first = [("s", f"a{i}", f"old notice\nbody {chr(97 + i)}") for i in range(4)]
    second = [("s", f"b{i}", f"old notice\nnew notice\nbody {chr(107 + i)}") for i in range(3)]
    third = [("s", f"c{i}", f"text {'x' * i}y") for i in range(60)]
    store, hashed, shown, known = repeated_lines.LineStore(spark), lambda r: repeated_lines.hashed_documents(lines_frame(spark, r)), {}, []
    for k, batch in enumerate((first, second, third)):
        state, crossed = store.advance(k, hashed(batch))
        known = known + batch
        docs = lines_frame(spark, known)
        ids = repeated_lines.to_rebuild(hashed(batch), hashed(known), state, crossed)
        shown |= {i: c for _, i, c in batch}
        shown |= {r.id: r.content for r in repeated_lines.without_lines(docs, repeated_lines.holding(hashed(known), state.standing), ids).collect()}
        bad = brute_lines(known)
        assert shown == {i: "\n".join(x for n, x in enumerate(c.split("\n"), 1) if (i, n) not in bad) for _, i, c in known}
    assert shown["b0"].startswith("new notice\n") or shown["b0"].startswith("old notice\nnew notice\n")


def test_batches_by_time(spark):
    from datetime import datetime

    rows = [(s, i, c, None if k % 17 == 0 else datetime(2024, 1 + k % 12, 1)) for k, (s, i, c) in enumerate(some_lines(7))]
    df = spark.createDataFrame(rows, "source string, id string, content string, at timestamp")
    hashed, state = repeated_lines.run_batches(spark, df, "at", 4)
    assert {(r.id, int(r.line_no)) for r in repeated_lines.holding(hashed, state.standing).collect()} == brute_lines([r[:3] for r in rows])
    hashed, state = repeated_lines.run_batches(spark, df.limit(0), "at", 4)
    assert repeated_lines.holding(hashed, state.standing).count() == 0


def test_lines_removed(spark):
    df = lines_frame(spark, [("s", "1", "a\nb\n\nc"), ("s", "2", "x"), ("s", "3", None)])
    spots = spark.createDataFrame([("1", 2)], "id string, line_no int")
    assert [tuple(r) for r in repeated_lines.without_lines(df, spots).collect()] == [("1", "a\n\nc")]


# --- pages and residue


def test_tree_splits_what_can_be_split():
    rnd = np.random.default_rng(0)
    x = rnd.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    t = tree.fit(x, y)
    assert ((t.predict(x) > 0.5) == y).mean() > 0.98


def test_page_model_on_held_out_pages():
    every = labelled_pages.pages()
    held, kept = every[::4], [p for i, p in enumerate(every) if i % 4]
    m = pages.fit_pages(kept)
    right = [m.around([t for t, _ in p]) == np.array([a for _, a in p]) for p in held]
    assert np.concatenate(right).mean() > 0.95
    assert set(m.tree.feature.tolist()) & {0, 1} and len(m.tree.feature) > 5


#: Pages of a shape and subject that the labelled table has not: (line, stands around the article).
UNSEEN = [
    ("Home | Recipes | Videos | Shop", True), ("We value your privacy and use cookies. Accept | Manage", True), ("Lentil soup with lemon", False), ("By Ann Miller · 12 min read", True),
    ("Rinse the lentils, then cook them in two litres of water until they are soft.", False), ("Peel the carrots and cut them into thin slices before they go into the pot.", False), ("Share this recipe", True), ("Serve the soup with a slice of lemon and fresh bread.", False), ("My grandmother made it every Friday, and nobody left the table hungry.", False),
    ("Related: Five soups for cold days", True), ("Sign up for our weekly newsletter", True), ("Tags: soup, lemon, winter", True), ("© 2021 Kitchen Notes. All rights reserved.", True), ("Privacy | Terms | Contact", True),
]


def test_page_of_another_shape():
    guess = pages.page_model().around([t for t, _ in UNSEEN])
    assert (guess == np.array([a for _, a in UNSEEN])).mean() >= 0.85


def test_page_frame(spark):
    page = "Home | News | Contact\n\nA plan\nThe team renewed the plan in March.\n- share the plan\n© 2024 Gazette · News · Version 1.2"
    rows = [("1", "A plan", page, None), ("1", "A plan", page, None), ("2", None, None, ""), ("3", "t", " \n ", "The team renewed the plan. " * 9000), (None, None, "Back to top", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, title string, content string, summary string, line_no string")
    got = {tuple(r) for r in pages.lines_around(df).collect()}
    assert got == {("1", "content", 1), ("1", "content", 6), (None, "content", 1)}
    assert pages.main_body(df.where("id = '1'")).first().content.startswith("A plan")
    assert pages.lines_around(df.limit(0)).count() == 0


def is_residue(index, title, text):
    lines = pages.split_lines(text)[1]
    return residue.content_is_residue(index, title, text, lines, pages.page_model().around(lines))


RESIDUE = [
    ("{{ title | upper }}", True), ("Dear [your first name], the plan was renewed.", True), ("%%REGION%%", True), ("TBD (audit crew)", True), ("404 - page not found", True), ("Content coming soon - July", True), ("Please turn on scripts in your browser - viewer 34ab1", True),
    ("test test test test", True), ("Access denied. Please sign in. Incident c59c23", True), ("Lorem ipsum dolor sit amet", True),
    ("We couldn't find what you were looking for.", True), ("Gateway error: upstream unavailable", True), ("JavaScript muss aktiviert sein, um diese Seite zu sehen.", True), ("Erreur 404 : page introuvable", True), ("Página no encontrada", True), ("Insert headline here", True), ("Hello, {0}!", True), ("@@NAME@@", True), ("Die Seite wurde leider nicht gefunden", True), ("Veuillez activer JavaScript", True),
    ("Die Behörde fand neun Fehler im Register der Banken.", False), ("La página del registro fue renovada en marzo por la oficina.", False), ("Le serveur de la commune a été remplacé après la panne de mars.", False), ("Write to a@b.org or to @team", False), ("Error 404 pages and health data: a new policy", False), ("Fees are $500 [see annex 9] and the set {1, 2} is closed.", False), ("How banks should test the yearly plan", False), ("", False), (None, False), ("  ", False),
]


@pytest.mark.parametrize("text,want", RESIDUE)
def test_residue(text, want):
    index = residue.Index({"test": 5, "the": 900, "page": 400}, 1000)
    assert bool(is_residue(index, None, text)) is want


def test_residue_speaks_of_it():
    index = residue.Index({"the": 900}, 1000)
    body = 'Visitors saw the words "service unavailable" while the register was renewed.\nThe consent tool failed whenever scripts were disabled.'
    assert not is_residue(index, "A plan", body)
    assert is_residue(index, "A plan", "Home | News | Contact\nA plan\nSorry, something went wrong while loading 7f61ba. Retry?\nBack to top")


def test_residue_frame(spark):
    rows = [("1", "TBD", "real text of a plan", "x"), ("2", "A plan", "${author} wrote it", "y"), ("2", "A plan", "${author} wrote it", "z"), ("3", None, None, "")]
    df = spark.createDataFrame(rows, "id string, title string, content string, field string")
    assert {tuple(r) for r in residue.find(df).collect()} == {("1", "title"), ("2", "content")}
    assert residue.find(df.limit(0)).count() == 0


# --- encoding


TEXTS = [(1, None), (2, ""), (3, "a" * 900 + " b"), (4, " " * 700 + "x"), (5, "é🙂 naïve\n\n don't\t" * 60), (6, "<|endoftext|> x1234 " * 40), (7, "short")]


def whole(text):
    return encoding._tokenizer(encoding.vocabulary()).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (64, 200), (7, 5), (2000, 200)])
def test_chunked_encoding_equals_whole(spark, chunk, overlap):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encoding.encode(df, None, chunk, overlap).collect()}
    assert got == {i: whole(t) for i, t in TEXTS} and got[1] == got[2] == []


def test_chunks_of_random_texts():
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "b", " ", "  ", "\n", "1", "22", "'s", ",", "é", "🙂", "\u3000", "\u200b"]) for _ in range(rnd.randrange(300)))
        assert encoding._ids([t], encoding.vocabulary(), rnd.randrange(1, 40), rnd.randrange(1, 20)) == [whole(t)]


def test_long_texts_are_cut_everywhere():
    path = encoding.vocabulary()
    cuts = encoding.stitches("some words, 12 of them. " * 2000, path)
    assert max(b - a for a, b in zip(cuts, cuts[1:])) <= encoding.CHUNK + 2 * encoding.OVERLAP
    run = "word " * 500 + "x" * 9000 + " word" * 2000  # the overlap grows over the run, then goes on
    cuts = encoding.stitches(run, path)
    assert len(cuts) > 5 and max(b - a for a, b in zip(cuts, cuts[1:])) > 9000


def test_decoding_gives_back(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert {r.doc_id: r.text for r in encoding.decode(encoding.encode(df)).collect()} == {i: t or "" for i, t in TEXTS}
    assert encoding.encode(df.limit(0)).count() == 0


# --- leakage


def words(t):
    return re.findall("[a-z0-9]+", t.lower()) if t else []


def brute_leaks(docs, items, run=15):
    grams = lambda t: {tuple(w[i : i + run]) for w in [words(t)] for i in range(len(w) - run + 1)}
    known = {j: grams(t) for j, t in items}
    return {(i, j) for i, t in docs for j in known if grams(t) & known[j]}


def test_leaks_against_brute(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(j, text(rnd.choice([3, 14, 15, 40]))) for j in range(12)] + [(50, None), (51, "")]
    docs = [(i, text(60)) for i in range(20)]
    for i in range(20, 60):
        src = rnd.choice(items)[1] or "x"
        w = src.split()
        k = rnd.randrange(len(w))
        docs.append((i, f"{text(5)}, {' - '.join(w[k : k + rnd.choice([14, 15, 16, 40])]).upper()}! {text(4)}"))
    docs += [(60, None), (61, ""), (62, LONG + items[3][1])]
    a = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int").select("doc_id", "text")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leakage.leaks(a, b).collect()} == brute_leaks(docs, items)


def test_word_codes_are_the_words():
    texts = ["A b-c, ÀÉ x1\u212a İ9", None, "", "...", "the the a" * 3, "z" * 5000, "ﬁ a\ud800b"]
    codes, starts = leakage.word_codes(texts)
    seen = {}
    for k, t in enumerate(texts):
        ws = words(t)
        assert len(ws) == starts[k + 1] - starts[k]
        for w, c in zip(ws, codes[starts[k] : starts[k + 1]].tolist()):
            assert seen.setdefault(w, c) == c
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("wrong,least", [(1, 1.0), (2, 0.99), (3, 0.95)])
def test_tolerant_recall_against_brute(wrong, least):
    """Passages of 15 words with random substitutions between unrelated words."""
    rnd = random.Random(wrong)
    items = [" ".join(f"i{k}w{i}" for i in range(15)) for k in range(300)]
    docs = []
    for t in items:
        w = t.split()
        for i in rnd.sample(range(15), wrong):
            w[i] = f"s{rnd.random()}".replace(".", "")
        docs.append(" ".join([f"p{rnd.randrange(99)}" for _ in range(20)] + w + ["q"] * 20))
    block = leakage.Items(list(range(300)), items)
    found = {(d, i) for d, i, _, near in block.overlaps(docs, 15)}
    assert found <= {(k, k) for k in range(300)} and len(found) >= least * 300


def test_far_passage_on_the_same_diagonal(spark):
    w = [f"t{i}" for i in range(120)]
    other = [x if i < 8 or 60 <= i < 80 else f"o{i}" for i, x in enumerate(w)]
    assert leakage.Items([1], [" ".join(w)]).overlaps([" ".join(other)], 15) == [(0, 1, 20, 25)]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 40)
    monkeypatch.setattr(leakage, "BATCH_BYTES", 100)
    monkeypatch.setattr(leakage, "HITS", 3)
    texts = [" ".join(f"a{k}b{i}" for i in range(20)) for k in range(9)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    docs = spark.createDataFrame([(f"d{k}", f"x {t} y") for k, t in enumerate(texts)] * 2, "doc_id string, text string")
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == {(f"d{k}", k) for k in range(9)}
    assert leakage.leaks(docs, items.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0


def test_overlap_tolerates_substitutions(spark):
    w = [f"t{i}" for i in range(60)]
    changed = [x if i % 17 != 16 else "other" for i, x in enumerate(w)]
    row = leakage.overlaps(spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string"), spark.createDataFrame([(2, " ".join(w))], "item_id long, text string")).first()
    assert (row.run, row.near) == (16, 60)


# --- abuse


def rated(n=120, seed=8):
    rnd = random.Random(seed)
    good = ["The plan was renewed in %s.", "A summary of the register went to all %s.", "Costs rose after the audit of %s.", "The list has words such as \"idiot\" for %s."]
    bad = ["You are a worthless idiot from %s.", "Shut your mouth, you filthy clown of %s.", "I will find you in %s and break your legs."]
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.3)
        body = [rnd.choice(good) % rnd.choice(["banks", "clinics", "schools"]) for _ in range(5)]
        if y:
            body.insert(rnd.randrange(5), rnd.choice(bad) % rnd.choice(["banks", "clinics", "schools"]))
        rows.append((i, " ".join(body), y if rnd.random() > 0.03 else 1 - y, y))
    return pd.DataFrame(rows, columns=["doc_id", "text", "toxic", "truth"])


def test_abuse_held_out():
    j = abuse.fit(rated(160, 8))
    test = rated(80, 9)
    guess = j.documents(test["text"].tolist()) > j.threshold
    assert (guess == (test["truth"] == 1)).mean() > 0.95


def test_few_ratings_leave_the_seeds_in_charge():
    few = rated(12, 11)
    j = abuse.fit(few)
    assert j.threshold >= abuse.FLOOR
    assert (j.documents(["What a worthless piece of trash you are", "halt die Fresse, du Schwein", "The plan was renewed in March."]) > j.threshold).tolist() == [True, True, False]


def test_abuse_behind_a_long_text():
    j = abuse.fit(rated())
    assert j.documents([LONG + "\nYou are a worthless idiot from banks.", LONG]).tolist()[0] > j.threshold > j.documents([LONG])[0]


def test_disguises():
    for t in ("mor0n", "m o r o n", "m.o.r.o.n", "MORON", "mooooron", "mо\u200bron"):
        assert abuse.tokens(t) == ["moron"], t
        assert abuse.plain_passages([f"you {t} there"])[0] == "you moron there", t
    assert abuse.tokens("l***g") == ["⟦masked⟧"]
    assert abuse.plain_passages(['He said "No". Fin\u00e9\nx', "", "a  b"])[0].split("\n") == ['he said "no". ⟦quote⟧', "fine", "x", "", "a", "b"]


def test_probabilities_sum_to_one():
    s = abuse.Sample(abuse.grams(["a b a. b c", "a b"]), np.array([False, False]), np.array([False, False]))
    m = abuse.KneserNey(s, np.ones(len(s.g.doc)))
    word = {w: int(np.searchsorted(s.word, c)) for w, c in zip("abc", abuse.hash_words("a b c")[0])} | {"end": int(np.searchsorted(s.word, abuse.CLOSE))}
    base = m.p1
    assert base[list(word.values())].sum() + base[np.searchsorted(s.word, abuse.OPEN)] == pytest.approx(1, abs=0.01)
    for b in ("a", "b"):
        followers = [i for i in range(len(s.bi)) if s.before_of_bi[i] == word[b] and i in set(s.bi_of_tri.tolist())]
        p = {int(s.word_of_bi[i]): m.p2[i] for i in followers}
        assert sum(p.get(w, 0) + m.w2[word[b]] * base[w] for w in range(len(s.word))) == pytest.approx(1, abs=0.01)


def test_sample_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i), "y") for i in range(20)] * 2 + [(99, None, "z")], "doc_id long, text string, n string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (3, 0), (5, None), (99, 1)], "doc_id long, toxic int")
    got = abuse.rated_sample(docs, labels)
    assert sorted(got["doc_id"]) == list(range(20)) and dict(zip(got["doc_id"], got["toxic"]))[3] == 0
    few = abuse.rated_sample(docs, labels, 8, 300)
    assert len(few) <= 8 and few["text"].map(len).sum() <= 300 and all(len(t) == 10 * i for i, t in zip(few["doc_id"], few["text"]))


def test_scoring_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "\n \t", "x"), (4, LONG, "x"), (5, "You are a worthless idiot from banks.", "x")], "doc_id long, text string, score string")
    j = abuse.fit(rated())
    got = {r.doc_id: (r.score, r.abusive) for r in abuse.score(df, j).collect()}
    assert got[1] == got[2] == got[3] == (-5.0, False) and got[5][1] and not got[4][1]
    assert abuse.fit(rated().head(0), df.limit(0)).documents(["you stupid moron", None]).tolist()[1] == -5.0


# --- all queries


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_text_query(spark, name):
    from tests.test_queries import norm
    from veridrome.sources.tables import TABLES

    df = catalog.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        r = c.execute(sql)
        names = [d[0] for d in r.description]
        assert rows == sorted(repr(tuple(norm(x[names.index(k)]) for k in cols)) for x in r.fetchall())
    else:
        assert rows
