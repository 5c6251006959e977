from __future__ import annotations

import random

import pyarrow as pa

from docflow.llm import leaks as K

WORDS = ["huset", "gården", "till", "och", "ladan", "brevet", "åkern", "mot", "prästen", "borgaren", "såg", "att", "under", "hösten", "marknaden", "kvarnen", "skulden", "betalade", "öre", "tunnor"]


def brute(doc: list[str], item: list[str]) -> int:
    """Longest run of words in a row, by comparing every word with every word."""
    best, before = 0, [0] * (len(item) + 1)
    for w in doc:
        row = [0] * (len(item) + 1)
        for k, v in enumerate(item):
            if K.one_letter_apart(w, v):
                row[k + 1] = before[k] + 1
                best = max(best, row[k + 1])
        before = row
    return best


def misread(word: str) -> str:
    at = random.randrange(len(word))
    return random.choice([word[:at] + random.choice("xyzqw") + word[at + 1 :], word[:at] + word[at + 1 :] or "x", word[:at] + "x" + word[at:]])


def test_against_brute_force() -> None:
    random.seed(11)
    items = [[random.choice(WORDS) + random.choice(["", "s", "na"]) for _ in range(random.randint(10, 40))] for _ in range(15)]
    docs = []
    for _ in range(120):
        doc = [random.choice(WORDS) for _ in range(random.randint(5, 60))]
        if random.random() < 0.6:
            item = random.choice(items)
            n = random.randint(12, 20)
            at = random.randrange(max(1, len(item) - n))
            part = [misread(w) if random.random() < 0.3 else w for w in item[at : at + n]]
            doc[3:3] = part
        docs.append(doc)
    index = K.SeedIndex([(k, " ".join(i)) for k, i in enumerate(items)])
    doc_at, item_id = index.found(docs, 15)
    got = set(zip(doc_at.tolist(), item_id.tolist(), strict=True))
    want = {(d, k) for d, doc in enumerate(docs) for k, item in enumerate(items) if brute(doc, item) >= 15}
    assert got == want and want


def test_runs_are_found_however_many_words_are_misread() -> None:
    random.seed(12)
    item = [f"ord{chr(97 + k)}{chr(110 + k % 5)}" for k in range(15)]
    index = K.SeedIndex([(1, " ".join(item))])
    for n in range(16):
        for _ in range(20):
            wrong = set(random.sample(range(15), n))
            doc = [misread(w) if k in wrong else w for k, w in enumerate(item)]
            assert len(index.found([["foo", *doc, "bar"]], 15)[0]) == 1
    assert len(index.found([[w + "xx" if k == 7 else w for k, w in enumerate(item)]], 15)[0]) == 0


def test_short_words_and_few_hits_at_once(monkeypatch) -> None:
    """Words of one and two letters, which are all a letter apart, a few seeds at a time; against brute force."""
    random.seed(13)
    monkeypatch.setattr(K, "HITS", 50)
    short = ["i", "å", "ö", "en", "in", "vi", "av", "at", "och", "den"]
    items = [[random.choice(short) for _ in range(random.randint(15, 25))] for _ in range(4)]
    docs = [[random.choice(short) for _ in range(20)] + [misread(w) for w in items[0][:15]] for _ in range(3)] + [[random.choice(short) for _ in range(40)] for _ in range(10)]
    index = K.SeedIndex([(k, " ".join(i)) for k, i in enumerate(items)])
    got = set(zip(*(x.tolist() for x in index.found(docs, 15)), strict=True))
    assert got == {(d, k) for d, doc in enumerate(docs) for k, item in enumerate(items) if brute(doc, item) >= 15}


def test_several_blocks_in_a_pass(spark, monkeypatch) -> None:
    monkeypatch.setattr(K, "BLOCK_WORDS", 60)
    random.seed(14)
    items = [(k, " ".join(random.choice(WORDS) + str(k) for _ in range(20))) for k in range(30)]
    documents = spark.createDataFrame([(k, "inledning " + items[k][1] + " slut") for k in range(30)], "doc_id long, text string")
    assert sorted(map(tuple, K.leaked(documents, spark.createDataFrame(items, "item_id long, text string")).collect())) == [(k, k) for k in range(30)]


def test_words_in_one_form() -> None:
    texts = pa.array(["Kvarn-\r\nen, vid  ÅNS!", "Рetter N:o 5", None, "", "skå­\nra", "vid-sidan"])
    assert K.words(texts) == [["kvarnen", "vid", "åns"], ["petter", "no", "5"], [], [], ["skåra"], ["vid", "sidan"]]


def test_one_letter_apart() -> None:
    assert all(K.one_letter_apart(*p) for p in [("a", "a"), ("hus", "hds"), ("hus", "hu"), ("hus", "huus"), ("", "x")])
    assert not any(K.one_letter_apart(*p) for p in [("hus", "sho"), ("hus", "h"), ("abc", "bcd")])


def test_documents(spark) -> None:
    item = " ".join(WORDS[:16])
    docs = spark.createDataFrame([(1, f"Först {item} sist", "a", 5), (2, None, "a", 5), (3, "", None, 5), (4, " ".join(WORDS[:14]), None, 5), (1, f"Först {item} sist", "a", 5), (5, "\n ".join(WORDS[:15]).upper() + " x" * 50_000, "b", 5)], "doc_id long, text string, source string, item_id int")
    items = spark.createDataFrame([(7, item, "val", 0), (8, None, "val", 0), (9, "kort", "test", 0), (10, item, "test", 0)], "item_id long, text string, split string, doc_id int")
    assert sorted(map(tuple, K.leaked(docs, items).collect())) == [(1, 7), (1, 10), (5, 7), (5, 10)]
    assert K.leaked(docs.where("false"), items).count() == 0 and K.leaked(docs, items.where("false")).count() == 0
    assert K.report(K.leaked(docs, items), docs.dropDuplicates(["doc_id"]), items).count() == 4


def test_items_in_blocks(spark, monkeypatch) -> None:
    monkeypatch.setattr(K, "BLOCK_WORDS", 20)
    texts = [" ".join(random.Random(k).sample(WORDS, 16)) for k in range(9)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(map(tuple, K.leaked(docs, items).collect())) == [(k, k) for k in range(9)]


def test_hyphens_at_line_ends_after_any_form_of_a_letter() -> None:
    texts = ["ga\u030a-\nrden", "gå-\u200b\nrden", "gå\xad\nrden", "ga\u030a\xad\u200b\r\nrden", "gå-\xad\nrden", "gå\xadrden", "gå¬\nrden"]
    assert K.words(pa.array(texts)) == [["gården"]] * len(texts)
