"""Items in several groups, and longest matches against brute force."""

import random

from evalframe.llm.leak_suffix import UNITS, ItemIndex, leaked_items, leaked_passages, shard_matches


def brute(items, text, least):
    out = set()
    for i, ws in items:
        for a in range(len(text)):
            for b in range(len(ws)):
                if a and b and text[a - 1] == ws[b - 1]:
                    continue
                n = 0
                while a + n < len(text) and b + n < len(ws) and text[a + n] == ws[b + n]:
                    n += 1
                if n >= least:
                    out.add((i, a, b, n))
    return out


def test_longest_matches():
    rng = random.Random(6)
    vocab = ["a", "b", "c"]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randrange(3, 30))]) for i in range(12)]
    texts = [[rng.choice([*vocab, "other"]) for _ in range(rng.randrange(0, 60))] for _ in range(20)] + [items[0][1] * 3]
    index = ItemIndex([(i, " ".join(w)) for i, w in items], UNITS["en"][0], 4)
    got = shard_matches(index, [" ".join(t) for t in texts])
    want = {(t, *m) for t, text in enumerate(texts) for m in brute([x for x in items if len(x[1]) >= 4], text, 4)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_groups_of_items_give_the_same(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    items = [(i, rng.choice(["en", "EN", "zh", None, "fr"]), " ".join(rng.choice(words) for _ in range(30))) for i in range(30)] + [(90, "en", None), (None, "en", "x " * 30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(9)) + " " + (rng.choice(items)[2] or "") + " end") for i in range(60)] + [(99, None), (98, "")]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, lang string, text string")
    rows = lambda n: sorted(map(tuple, leaked_passages(d, it, group_chars=n).collect()))
    assert rows(50_000_000) == rows(400) and rows(400)
    assert leaked_items(d, it.where("item_id < 0")).count() == 0
