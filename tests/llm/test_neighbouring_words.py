import random

from vellum.llm.leakage import leaks


def test_all_wrong_words_of_a_stretch_may_be_neighbours(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    item, other = [word() for _ in range(97)], [word() for _ in range(60)]
    stretch = item[10:42] + [word() for _ in range(9)] + item[51:82]
    docs = spark.createDataFrame([(1, " ".join(other[:30] + stretch + other[30:])), (2, " ".join(other))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item), "en")], "item_no long, text string, lang string")
    assert [(r["doc_id"], r["item_no"], r["n_words"], r["n_item_words"]) for r in leaks(docs, items).collect()] == [(1, 5, 72, 97)]
