import random
import time
from collections import Counter

import pytest

from coterie.llm import abuse, deobfuscate as d
from tests.conftest import rows

WORDS = "you are a stupid idiot and pathetic worthless scumbag the parcel arrived late at shop but courier was friendly refund issued today please send receipt vermin horny disgusting moron halfwit".split()


def _counts(words):
    grams = Counter()
    for w in words:
        m = f"^{w}$"
        for k in range(1, d.ORDER + 1):
            grams.update({m[i : i + k]: 20 for i in range(len(m) - k + 1)})
    return dict(grams)


COMMON = {w: 20 for w in WORDS if len(w) > 1}
R = d.Restorer(_counts(WORDS), COMMON | {"halfw": 2})


@pytest.mark.parametrize(
    ("written", "word"),
    [("h@lfw1t", "halfwit"), ("halfw it", "halfwit"), ("s c u m b a g", "scumbag"), ("s.c.u.m.b.a.g", "scumbag"), ("d-i-s-g-u-s-t-i-n-g", "disgusting"), ("pathet\nic", "pathetic"), ("veeermin", "vermin"), ("h*rny", "horny"), ("ST​UP­ID", "stupid"), ("m0r0n", "moron"), ("ｉｄｉｏｔ", "idiot"), ("ídíót", "idiot"), ("wor-thless", "worthless"), ("idiоt", "idiot")],
)
def test_disguised_words_are_restored(written, word):
    assert word in R.passages(f"the courier {written} was late.")[0]


@pytest.mark.parametrize(
    ("written", "word"),
    [("p******c", "pathetic"), ("w*******s", "worthless"), ("v****n", "vermin"), ("5cu#*@*", "scumbag"), ("m0*0*", "moron"), ("$7u*1d", "stupid"), ("v * * m i n", "vermin"), ("h * * * y", "horny"), ("1d10+", "idiot"), ("1|3@5", "ileas")],
)
def test_words_with_few_plain_letters_are_restored(written, word):
    model = d.Restorer(_counts([*WORDS, "ileas"]), COMMON | {"ileas": 20})
    assert word in model.passages(f"the courier {written} was late.")[0]


def test_numbers_prices_and_signs_are_no_words():
    assert R.passages("$17 £1,200.50 +44 20 *** !!! $$$ #1 7*4 100% 2 * 3 * 4") == []


def test_bounded_decoding_equals_all_paths():
    model = d.CharModel(_counts(WORDS))
    for written in ("s**d", "p***t", "**rm*n", "x**q", "h*r**"):
        steps = d.lattice(written)
        assert d.viterbi(written, model, 2) == d._cheapest(steps, [0.0] * len(steps), model, float("inf"), None)[1]


def test_plain_words_stay():
    assert R.passages("The parcel arrived late. Refund issued, today!\nPlease send") == [["the", "parcel", "arrived", "late"], ["refund", "issued", "today"], ["please", "send"]]
    assert R.passages(None) == R.passages("") == R.passages(" \n​") == R.passages("12 345 -- 6.7") == []


@pytest.mark.parametrize("text", ["a" * 60_000, "a1" * 30_000, "a b " * 20_000, "\n" * 60_000 + "a", "@" * 60_000, "a" + "1" * 60_000, "a." * 30_000])
def test_very_long_texts_take_linear_time(text):
    began = time.time()
    R.passages(text)
    assert time.time() - began < 10


def test_training_finds_the_passage_behind_the_label():
    rng = random.Random(0)
    plain = ["the parcel arrived late", "refund issued today", "please send receipt", "courier was friendly", "the shop was late", "send the refund today please"]
    bad = ["you are a stupid idiot", "pathetic worthless scumbag you", "you are vermin", "disgusting moron"]
    docs, labels = [], []
    for i in range(300):
        passages = [p.split() for p in rng.sample(plain, 3)]
        if i % 5 == 0:
            passages.insert(rng.randrange(4), rng.choice(bad).split())
        docs.append(passages)
        labels.append(float(i % 5 == 0) if rng.random() > 0.03 else 1 - float(i % 5 == 0))
    model = abuse.train(docs, labels)
    assert all(model.score(p.split()) < abuse.CASE for p in plain)
    assert all(model.score(p.split()) > abuse.CASE for p in bad)
    scorer = abuse.Scorer(_counts(WORDS), COMMON, model)
    assert scorer.text("Refund issued today. You are a stup1d id*ot.") > abuse.CASE > scorer.text("Refund issued today.")
    assert scorer.text(None) == scorer.text("") == 0.0


def test_training_without_both_classes():
    assert abuse.train([], []).score(["x"]) < 0.01
    assert abuse.train([[["a"]], [["b"]]], [1.0, 1.0]).score(["a"]) < 0.01


def test_labels(spark):
    df = spark.createDataFrame([(1, "none", "a"), (1, "abusive", "b"), (1, "sexual", "c"), (2, None, "a"), (2, "odd", "a"), (3, "none", "a"), (None, "hateful", "a")], "doc_id bigint, category string, share string")
    assert rows(abuse.labelled_documents(df, 10)) == [(1, 2 / 3), (3, 0.0)]
    assert abuse.labelled_documents(df, 1).count() == 1


def test_fit_on_tables(spark):
    docs = spark.createDataFrame([(i, ("You are a stupid idiot. " if i % 3 == 0 else "") + "The parcel arrived late.", "s") for i in range(60)] + [(100, None, None), (101, "", "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, "abusive" if i % 3 == 0 else "none") for i in range(60)], "doc_id bigint, category string")
    out = {r.doc_id: r.score for r in abuse.score_documents(docs, abuse.fit(docs, labels)).collect()}
    assert len(out) == 62 and out[100] == out[101] == 0.0
    assert min(out[i] for i in range(0, 60, 3)) > abuse.CASE > max(out[i] for i in range(60) if i % 3)
    empty = abuse.fit(docs.limit(0), labels.limit(0))
    assert all(r.score < 0.01 for r in abuse.score_documents(docs, empty).collect())


def test_batches_and_windows_score_like_single_passages():
    rng = random.Random(1)
    words = [*WORDS, "you", "your", "idiots", "nude", "kill", "x"]
    docs = [[[rng.choice(words) for _ in range(rng.randrange(0, 25))] for _ in range(rng.randrange(0, 4))] for _ in range(60)]
    names = sorted({f for d_ in docs for p in d_ for f in abuse.features(p)})
    model = abuse.PassageModel({f: rng.uniform(-1, 2) for f in names if rng.random() < 0.6}, -1.0)

    def slow(doc):
        parts = [q for p in doc if p for q in [p, *(p[i : i + n] for n, step in abuse.WINDOWS if len(p) > n for i in range(0, len(p) - n + step, step))] if q]
        return max(map(model.score, parts), default=0.0)

    assert abuse.BatchModel(model).scores(docs) == pytest.approx([slow(d_) for d_ in docs])
    assert list(abuse.BatchModel(model).scores([])) == [] and list(abuse.BatchModel(abuse.PassageModel({}, 0.0)).scores([[], [[]], [["a"]]])) == [0.0, 0.0, 0.5]


def test_texts_are_scored_in_bounded_parts():
    model = abuse.PassageModel({"idiot": 3.0, "you": 0.5}, -3.0)
    scorer = abuse.Scorer(_counts(WORDS), COMMON, model)
    texts = ["You idiot. The parcel arrived late.", None, "", "The parcel. You", "parcel " * 500, "idiot"] * 3
    assert scorer.texts(texts, words=3).tolist() == scorer.texts(texts).tolist() == [scorer.text(t) for t in texts]
    assert scorer.texts([]).tolist() == []


def test_few_labels_are_enough_for_what_they_show():
    plain = ["the parcel arrived late", "refund issued today", "please send receipt", "courier was friendly"]
    docs = [[plain[i % 4].split(), plain[(i + 1) % 4].split()] for i in range(20)] + [[plain[0].split(), "you are a pathetic halfwit".split()]]
    model = abuse.train(docs, [0.0] * 20 + [1.0], [1] * 21)
    assert model.score("you are a worthless halfwit".split()) > abuse.CASE > max(model.score(p.split()) for p in plain)
    # a single rater against all others is no proof, two are
    odd = [*docs[:20], ["courier was late".split(), "paid in grain".split()]]
    one, two = (abuse.train(odd, [0.0] * 20 + [1.0], [1] * 20 + [n]).score("paid in grain".split()) for n in (1, 2))
    assert one < two
