import random

import pytest

from coterie.llm import leaks
from tests.conftest import rows

VOCAB = [f"w{i}" for i in range(12)]


def test_words_ignore_case_accents_width_and_invisible_characters():
    assert leaks.words("Ｃａｆé, naï­ve—CAFÉ İ x²") == ["cafe", "naive", "cafe", "i", "x2"]
    assert leaks.words(None) == leaks.words("") == leaks.words(" \n") == []
    assert leaks.words("STRASSE") == leaks.words("Straße")


def _longest(doc, item):
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]:
                k += 1
            best = max(best, k)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_every_run_of_eight_equal_words_is_found(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randrange(5, 25)))) for i in range(8)] + [(8, None), (9, ""), (None, "w1 " * 9)]
    docs = []
    for d in range(60):
        text = [rng.choice([*VOCAB, "other"]) for _ in range(rng.randrange(0, 40))]
        source = leaks.words(rng.choice(items[:8])[1])
        a = rng.randrange(len(source))
        text[10:10] = source[a : a + rng.randrange(3, 15)]
        docs.append((d, ", ".join(w.upper() if rng.random() < 0.3 else w for w in text), "x"))
    docs += [(60, None, "x"), (61, "", "x"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, doc_id int")
    want = sorted({(d, i) for d, t, _ in docs for i, s in items if i is not None and t and s and _longest(leaks.words(t), leaks.words(s)) >= 8})
    every = []
    for block in (2_000_000, 3):  # items in the tasks, and in a join of seeds
        every.append(rows(leaks.leaked_items(df, bench, block_words=block)))
        assert sorted(r[:2] for r in every[-1] if r[2] >= 8) == want
    assert every[0] == every[1]


def test_substituted_words_are_tolerated(spark):
    item = " ".join(f"w{i}" for i in range(20))
    text = "x y " + item.replace("w9 ", "changed ")
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert rows(leaks.leaked_items(df, bench)) == [(1, 7, 10, 20, 19)]


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_recall_of_passages_with_substituted_words(rate):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(3000)]
    passages = [[rng.choice(vocab) for _ in range(25)] for _ in range(400)]
    items = leaks.index_items([(i, " ".join(p)) for i, p in enumerate(passages)])
    hits = 0
    for i, p in enumerate(passages):
        changed = [rng.choice(vocab) if rng.random() < rate else w for w in p]
        doc = [rng.choice(vocab) for _ in range(20)] + changed + [rng.choice(vocab) for _ in range(20)]
        hits += i in leaks.matches(" ".join(doc), items, leaks.MASKS, 1)
    assert hits / len(passages) >= 0.9


def test_nothing(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert rows(leaks.leaked_items(df, bench)) == []
    assert rows(leaks.leaked_items(df.limit(0), bench)) == []
    assert rows(leaks.leaked_items(df, bench, block_words=-1)) == []


def test_long_text_of_one_word():
    items = leaks.index_items([(1, "go " * 30)])
    assert leaks.matches("go " * 20_000, items, leaks.MASKS, 1)[1][0] == 30
