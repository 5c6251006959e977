from __future__ import annotations

import random
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from docflow.llm import characters as C

POOL = "Ⅻⅼ𝐀aeoAOäöåẹéﬁﬀＡｂ½№KÅÀḋ" + "".join(map(chr, (0x301, 0x308, 0x30A, 0x323, 0x304, 0x313, 0x340, 0x344, 0x200B, 0xAD, 0xA0, 0x2003, 0x3000, 0xFEFF, 0x1100, 0x1161, 0x11A8)))


def plain(text: str) -> str:
    """The form by rule, sign by sign, without look-alikes."""
    out = []
    for c in text:
        if unicodedata.category(c) == "Cf":
            continue
        if unicodedata.category(c) == "Zs":
            out.append(" ")
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<noBreak>")) or 0xFB00 <= ord(c) <= 0xFB06 or 0x2160 <= ord(c) <= 0x217F or 0x1D400 <= ord(c) <= 0x1D7FF:
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def test_against_brute_force() -> None:
    random.seed(7)
    texts = ["".join(random.choices(POOL, k=random.randint(0, 14))) for _ in range(3000)]
    assert C.consistent(pa.array(texts)).to_pylist() == [plain(t) for t in texts]


def test_words_and_genuine_signs() -> None:
    texts = ["Рettеr", "мѣщанинъ", "ψυχή", "½ tunna, №3 – ”x”", "ɡård", "ﬂod", "a‑b", "Nᵒ 7", "а", "Kαi"]
    form = ["Petter", "мѣщанинъ", "ψυχή", "½ tunna, №3 – ”x”", "gård", "flod", "a-b", "Nᵒ 7", "а", "Kai"]
    assert C.consistent(pa.array(texts)).to_pylist() == form
    assert C.is_inconsistent.func(pa.array(texts)).to_pylist() == [True, False, False, False, True, True, True, False, False, True]


def test_foreign_letter_without_double_is_inconsistent() -> None:
    assert C.is_inconsistent.func(pa.array(["gжrd", "gard"])).to_pylist() == [True, False]


def test_letters_of_further_scripts_and_phonetic_ones() -> None:
    """Those that print like a Latin letter become it; all others in a Latin word are reported and stay."""
    texts = ["Armeniօ", "Ꭺnders", "ꓮnders", "𝐀nders", "ⅼars Ⅻ", "ᴀnders", "ɩngen", "schwə", "日本abc", "ᎪᎡ", "ꓮꓐ", "µm ℓ", "1º ª", "հայ", "N⁰ aᵒ"]
    form = ["Armenio", "Anders", "Anders", "Anders", "lars XII", "ᴀnders", "ɩngen", "schwə", "日本abc", "ᎪᎡ", "ꓮꓐ", "µm ℓ", "1º ª", "հայ", "N⁰ aᵒ"]
    assert C.consistent(pa.array(texts)).to_pylist() == form
    assert C.is_inconsistent.func(pa.array(texts)).to_pylist() == [True] * 9 + [False] * 6


def test_nulls_empties_long_texts_and_slices() -> None:
    long = "Kåtböle ​" * 200_000
    got = C.consistent(pa.array([None, "", long, "x", None])).to_pylist()
    assert got == [None, "", "Kåtböle " * 200_000, "x", None]
    sliced = pa.array(["drop", "é", None, "́a"]).slice(1)
    assert C.consistent(sliced).to_pylist() == ["é", None, "́a"]
    assert C.consistent(pa.array([], pa.string())).to_pylist() == []


def test_marks_stay_in_their_row() -> None:
    assert C.consistent(pa.array(["ä", "̣b"])).to_pylist() == ["ä", "̣b"]


def test_idempotent() -> None:
    random.seed(3)
    once = C.consistent(pa.array(["".join(random.choices(POOL + "жαοᾶ", k=12)) for _ in range(2000)]))
    assert C.consistent(once).equals(once)


def test_columns(spark) -> None:
    rows = spark.createDataFrame([(1, "ﬁ", "keep"), (1, "ﬁ", "keep"), (2, None, None), (3, "", "é")], "line_pk long, transcription string, text string")
    assert sorted(r[0] for r in C.inconsistent(rows).collect()) == [1, 1]
    kept = C.unify(rows.withColumn("TEXT2", F.lit(1))).collect()
    assert [r["transcription"] for r in kept] == ["fi", "fi", None, ""] and kept[3]["text"] == "é"
    assert C.inconsistent(rows.where("false")).count() == 0
    clash = rows.toDF("line_pk", "transcription", "TRANSCRIPTION")
    assert sorted(r[0] for r in C.inconsistent(clash).collect()) == [1, 1]
    assert C.unify(clash).columns == clash.columns
