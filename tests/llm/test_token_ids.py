from __future__ import annotations

import os
import random

import pytest
from tokenizers import Tokenizer

from docflow.llm import token_ids as T

FOLDER = os.path.dirname(T.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def library() -> Tokenizer:
    tokenizer = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_equals_the_library(library) -> None:
    random.seed(5)
    vocab = T.vocabulary()
    texts = ["".join(random.choices("abcdeåäö \n\t'sllre12.,;-<|endoftext|>é漢👍🏽ß", k=random.randint(0, 80))) for _ in range(1500)]
    assert [vocab.encode(t) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    long = "a" * 5000 + "\n" * 3000 + "åäö" * 4000
    assert vocab.encode(long) == library.encode(long, add_special_tokens=False).ids


def test_edits_work_out_what_is_near(monkeypatch) -> None:
    """One pretoken of 20,000 bytes: an edit anywhere gives the ids of the whole, and works out a few hundred prefixes."""
    random.seed(9)
    vocab = T.vocabulary()
    data = bytes(random.choices(b"abcdehsu\xc3\xa5\xa4 ", k=20_000))
    table, n, extend = T.PrefixTable(vocab, data), [0], T.PrefixTable._extend

    def counted(self) -> None:
        n[0] += 1
        extend(self)

    for at in (0, 7, 9_000, 19_990, 20_000):
        monkeypatch.setattr(T.PrefixTable, "_extend", counted)
        n[0] = 0
        table.edit(at, 3, b"zq")
        monkeypatch.setattr(T.PrefixTable, "_extend", extend)
        data = data[:at] + b"zq" + data[at + 3 :]
        assert table.data == data and table.last == T.PrefixTable(vocab, data).last and n[0] <= 3 * vocab.longest


def test_pairs_are_bounded(monkeypatch) -> None:
    monkeypatch.setattr(T, "PAIRS", 10)
    vocab = T.Vocabulary(T.VOCABULARY)
    assert vocab.merge(b"abcdefghij") == T.PrefixTable(vocab, b"abcdefghij").ids() and len(vocab._follows) <= 10


def test_prefix_table_appends_and_edits() -> None:
    random.seed(6)
    vocab = T.vocabulary()
    for _ in range(300):
        data = bytes(random.choices(b"abcdehsu\xc3\xa5\xa4", k=random.randint(1, 30)))
        cut = random.randint(0, len(data))
        table = T.PrefixTable(vocab, data[:cut]).append(data[cut:])
        assert table.ids() == vocab.merge(data)
        at, gone, new = random.randint(0, len(data)), random.randint(0, 4), bytes(random.choices(b"xyz\xc3", k=random.randint(0, 4)))
        assert table.edit(at, gone, new).ids() == vocab.merge(data[:at] + new + data[at + gone :])


def test_decodes_to_the_text() -> None:
    vocab, text = T.vocabulary(), "Den 21 Decembris\r\n 1673, å ä ö   slut  "
    assert b"".join(vocab.bytes[i] for i in vocab.encode(text)).decode() == text


def test_documents(spark, library) -> None:
    rows = spark.createDataFrame([(1, "hus <|endoftext|>", "x"), (2, None, "x"), (3, "", None), (4, "  ", None), (1, "hus <|endoftext|>", "y")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], list(r["ids"])) for r in T.encode(rows).collect()]
    ids = library.encode("hus <|endoftext|>", add_special_tokens=False).ids
    assert sorted(got) == sorted([(1, ids), (1, ids), (2, []), (3, []), (4, library.encode("  ").ids)])
    assert T.encode(rows.where("false")).count() == 0
    assert T.encode(rows).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_memo_is_bounded(monkeypatch) -> None:
    monkeypatch.setattr(T, "MEMO", 3)
    vocab = T.Vocabulary(T.VOCABULARY)
    vocab.encode("en två tre fyra fem sex sju")
    assert len(vocab.memo) <= 3
