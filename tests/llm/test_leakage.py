import random

from vellum.llm import leakage

WORDS = "collet spindle flange rocker pawl gasket lever hinge washer pulley bracket bush plate nozzle hook clip seat frame body guide".split()


def passage(rng, n):
    return [f"{rng.choice(WORDS)}{rng.randrange(1000)}" if rng.random() < 0.5 else rng.choice(WORDS) + rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(n)]


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_no string")
    i = spark.createDataFrame(items, "item_no bigint, text string, lang string")
    return leakage.leaks(d, i).collect()


def test_parts_changes_and_near_misses(spark):
    rng = random.Random(1)
    item = passage(rng, 60)
    noise = lambda: passage(rng, 50)
    third, less = item[10:30], item[10:29]
    changed = list(item)
    for k in range(3, 60, 9):
        changed[k] = "xqzv"
    missing = [w for k, w in enumerate(item) if k % 9 != 4]
    broken = list(item)
    for k in range(0, 60, 4):
        broken[k] = "xqzv" + str(k)
    shuffled = item[40:] + item[20:40] + item[:20]
    docs = [item, third, less, changed, missing, broken, [w.upper() for w in item], item[:19] + noise() + item[41:], shuffled[:]]
    texts = [" ".join(noise() + d + noise()) for d in docs]
    texts.append("-\n".join(texts[0][k : k + 30] for k in range(0, len(texts[0]), 30)))
    texts.append(texts[0].replace(" ", "").replace("a", "á"))
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(90, None, None), (91, "", None), (92, " ".join(item) * 400, None)]
    got = {r["doc_id"] for r in found(spark, rows, [(7, " ".join(item), "en"), (8, "", "en"), (9, None, "en"), (10, "...", None)])}
    assert got == {0, 1, 3, 4, 6, 8, 9, 10, 92}


def test_a_partial_copy_does_not_hide_a_whole_one(spark):
    rng = random.Random(3)
    item = passage(rng, 60)
    docs = [(k, " ".join(item[a : a + 7] + item[30:33] + item), None) for k, a in enumerate(range(0, 50, 7))]
    got = {r["doc_id"]: r["n_words"] for r in found(spark, docs, [(7, " ".join(item), "en")])}
    assert got == {k: 60 for k in range(len(docs))}


def test_positions_and_scripts(spark):
    text = "「第二の滑車531は軸受853を径方向に覆う。この状態で、ピストン366の縁と第二のピストン390は各軸受318を駆動する。」"
    got = found(spark, [(1, "前文。" + text + "後文。", None), (2, "前文" + text[4:18], None)], [(5, text, "ja")])
    assert [(r["doc_id"], r["item_no"]) for r in got] == [(1, 5)]
    whole = "前文。" + text + "後文。"
    assert whole[got[0]["start_pos"] : got[0]["end_pos"]] == text[1:-2]


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(passage(rng, 40)), "en") for k in range(6)]
    docs = [(k, "x " + t, None) for k, t, _ in items]
    want = {(k, k) for k in range(6)}
    assert {(r["doc_id"], r["item_no"]) for r in found(spark, docs, items)} == want
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 500)
    assert {(r["doc_id"], r["item_no"]) for r in found(spark, docs, items)} == want
    assert found(spark, docs, []) == [] and found(spark, [], items) == []


def test_a_sure_run_is_in_every_allowed_stretch():
    for n in range(1, 130):
        run = leakage.sure_run(n)
        for size in range(-(-n // 3), n + 1):
            wrong = size // 8
            assert -(-(size - wrong) // (wrong + 1)) >= run


def planted(rng, wrong_share):
    """A text with a stretch of an item in it, so many of whose words are changed, mistyped or missing, and the item."""
    item = passage(rng, rng.randrange(40, 130))
    size = rng.randrange(-(-len(item) // 3), len(item) + 1)
    at = rng.randrange(len(item) - size + 1)
    stretch = item[at : at + size]
    for k in rng.sample(range(size), int(size * wrong_share)):
        way = rng.randrange(3)
        w = stretch[k]
        stretch[k] = "" if way == 0 else rng.choice(WORDS) if way == 1 else w[: len(w) // 2] + rng.choice("qxz") + w[len(w) // 2 + 1 :]
    return " ".join(passage(rng, 60) + [w for w in stretch if w] + passage(rng, 60)), " ".join(item)


def found_of(share, n=400):
    rng = random.Random(21)
    hits = 0
    for _ in range(n):
        text, body = planted(rng, share)
        items = [leakage.item_of(1, body, "en")]
        hits += bool(list(leakage.cases(text, items, leakage.automaton_of(items))))
    return hits / n


def test_nearly_all_planted_cases_are_found():
    """Exactly one word in eight wrong anywhere in the stretch, and half as many."""
    assert found_of(1 / 8) >= 0.98 and found_of(1 / 16) >= 0.995
    assert found_of(1 / 3, 100) <= 0.05


def test_the_best_chain_does_not_jump_to_a_wrong_place():
    item = leakage.item_of(1, "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa", "en")
    text = leakage.flat("alpha bravo charlie xx foxtrot golf yy delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa")
    line = leakage.best_chain(item, text, 0, len(text))
    assert [item.words[j] for j, _, _ in line][-13:] == list(item.words[3:])
    assert leakage.in_order([3, 1, 2, 2, 5, 4]) == 3 and leakage.in_order([]) == 0
