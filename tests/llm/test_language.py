"""Language profiles: held-out accuracy, the plain definition of the vectors, edge cases."""

import numpy as np

from repograin.llm import language

WORDS = {"en": "the and of to in that is was for with", "de": "der und die zu den mit von nicht ein sch", "fr": "le la des et les dans que une pour qui"}


def made(n=120):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        name = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[name].split(), 25)), name))
    return rows


def test_bundle_is_the_sum_of_bound_letters():
    text, grams = "Ab  b-c\nÄ", language.Grams()
    codes = [0, *map(ord, "ab"), 0, ord("b"), 0, ord("c"), 0, ord("ä"), 0]
    assert language.letters(text).tolist() == codes
    packed, counts = language.gram_counts(text)
    rows = language.unpack(packed)
    grams.learn(np.unique(rows))
    letter = {c: language._letter_vectors(np.array([c]))[0].astype(int) for c in codes}
    want = sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert (counts @ grams.bind(rows).astype(int) == want).all()


def test_held_out_accuracy_and_edge_cases(docs):
    from pyspark.sql import functions as F

    rows = [*made(), (900, None, "en"), (901, "", "de"), (902, "12 %% 34", None), (None, "the and of to in", "en"), (903, "der und die " * 100_000, None), (904, "the and of to in that", None), (904, "the and of to in that", None)]
    df = docs(rows).withColumn("held_out", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    got = language.learn_and_identify(df).collect()
    assert len(got) == len(rows)
    tested = [r for r in got if r.held_out is True and r.doc_id < 900]
    assert len(tested) > 15 and all(r.lang == r.lang_pred for r in tested)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "en"]
    assert by_id[None].held_out is False and by_id[None].lang_pred == "en" and by_id[900].score == 0.0
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_learned(docs):
    rows = made()
    df = docs(rows)
    held = {r.doc_id for r in df.where(language.held_out(df.doc_id)).collect()}
    wrong = [(i, t, "zz" if i in held else l) for i, t, l in rows]
    one, two = (sorted((r.doc_id, r.lang_pred, r.score) for r in language.learn_and_identify(docs(x)).collect()) for x in (rows, wrong))
    assert one == two


def test_nothing_learned(docs):
    got = language.learn_and_identify(docs([(1, "some text"), (2, None)])).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert language.learn_and_identify(docs([])).collect() == []
