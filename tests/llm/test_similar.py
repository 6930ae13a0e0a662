"""Groups of similar texts against brute force over all pairs."""

import random

from touchline.llm import similar


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_pairs_at_the_limit_and_above_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 16)
    r = random.Random(8)
    lexicon = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = [r.choice(lexicon) for _ in range(200)]
        texts.append(base)
        for changes in (1, 2, 3, 4, 5, 6):
            copy = list(base)
            for at in r.sample(range(200), changes):
                copy[at] = r.choice(lexicon)
            texts.append(copy)
    hub = [r.choice(lexicon) for _ in range(100)]  # a bucket of more than BLOCK
    texts += [[*hub, f"end{k}"] for k in range(50)]
    texts = [" ".join(t) for t in texts] + ["one two", "ONE  two", "one three", None, "", " \n"]
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    close = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * len(sets[a] | sets[b]):
                close += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert close > 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {x["doc_id"]: x["component_id"] for x in similar.groups(df).collect()} == {k: find(k) for k in range(len(texts))}
    assert similar.groups(df.limit(0)).count() == 0


def test_stage_drops_a_copy_of_similarity_above_the_limit(spark, tmp_path):
    import corpus_pipeline
    from touchline.llm import simhash

    r = random.Random(3)
    words = [f"w{r.randrange(9999)}" for _ in range(200)]
    copies = []
    for at in range(190):  # the first change that four bits don't hold
        copy = [*words[:at], "x", *words[at + 1 : at + 9], "y", *words[at + 10 :]]
        one, other = " ".join(words), " ".join(copy)
        if (simhash.fingerprint(one.encode()) ^ simhash.fingerprint(other.encode())).bit_count() > 4:
            copies.append(other)
    assert copies and len(shingles(one) & shingles(copies[0])) >= 0.8 * len(shingles(one) | shingles(copies[0]))
    df = spark.createDataFrame([(1, one), (2, copies[0])], "doc_id bigint, text string")
    assert [x["doc_id"] for x in corpus_pipeline.one_of_each(spark, df, str(tmp_path)).collect()] == [1]


def test_rows_that_share_an_id_are_different_documents(spark):
    text = {x: " ".join(f"{x}{k}" for k in range(30)) for x in "abcd"}
    rows = [(1, text["a"]), (5, text["b"]), (5, text["c"]), (7, text["a"]), (7, text["d"]), (None, text["d"]), (None, "no id"), (None, "No  id"), (None, None), (None, " ")]
    got = [tuple(r) for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(r for r in got if r[0]) == [(1, text["a"]), (5, text["b"]), (5, text["c"]), (7, text["d"])]
    alone = [t for i, t in got if i is None]
    assert len(alone) == 3 and None in alone and " " in alone and len({"no id", "No  id"} & set(alone)) == 1
