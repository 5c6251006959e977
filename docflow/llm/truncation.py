"""Texts cut off by field limits or broken transfers (problem 8).

A structural completeness check. A stack automaton runs over the whole text and reports every bracket, quote and tag
that is left open and whether the last sentence opened it. The end of the text is then read for broken escapes,
entities, multibyte sequences and marks of omission, for a terminator, and, where there is none, for a whole closing: a
list's entry, a sum, place and date, a signature, a formula. Three baselines of the corpus and of each source decide what
the text alone can't: closings whose vocabulary the corpus shows (units of sums, formulas) are held against their
frequency; a missing terminator counts in every text that ends a sentence before, and else in sources whose texts as a
rule have terminators anywhere; a sign left open by a text that ends whole otherwise counts in sources that as a rule
close signs of its kind. So cut texts don't count against their source, and small sources follow the corpus.

Scale: one Arrow pass over the texts emits a few bytes a document; the baselines are partial aggregates of that narrow
table, written once to the shared folder, by unit, formula and source.

Defined results. Null, empty and blank texts (invisible signs included) aren't a case. Look-alike letters, full-width
signs and decomposed accents are read in their plain form. A null source is a source of its own. Very long texts are
read whole. Repeated rows count each. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.characters import consistent, slices
from docflow.session import materialise, pick, spread

#: Closing formulas of letters and records (fixed values); others are learnt.
FORMULAS = (
    "actum ut supra", "amen", "dag som ovan", "ex officio", "finis", "in fidem", "laus deo", "manu propria", "soli deo gloria", "som intygas", "ut in protocollo", "vidi", "vidimus",
)
#: A unit or formula is the corpus's own from this share of such endings on, and from so many texts on.
LEAST_SHARE, LEAST_COUNT = 0.002, 3
#: Share of texts that are whole or end a sentence within from which a source is one that sets terminators.
TERMINATED = 0.5
#: Share of the texts with signs of a kind that end whole and close all of them from which a source is one that closes them.
CLOSED = 0.95
#: Texts from which a source has a habit of its own.
LEAST_TEXTS = 10
#: Texts of this many characters are taken apart at once.
SLICE_CHARS = 1_000_000

_BROKEN = regex.compile(r"(?:…|\.\.+|�|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2})?|&#?\w{0,8}|</?\w{0,12}|(?<=\p{L})[-‐¬]|(?<=\p{L})(?:%\p{AHex}?|=\p{AHex}{0,1}|(?:%\p{AHex}{2})*%\p{AHex}?|[ÃÂ]|â€?))$")
_WHOLE = regex.compile(r"[.!?]['\"’”“»)\]]*$")
_SENTENCE = regex.compile(r"\p{Ll}{2}[.!?]['\"’”“»)\]]*\s+\p{Lu}")
_LINES = regex.compile(r"[\r\n]+")
_NAME = r"\p{Lu}[\p{L}'’-]+"
_ENTRY = regex.compile(r"\d+ \S.*, \d+ (?P<unit>\p{L}[\p{L} ]*)")
_SUM = regex.compile(r"(?:\p{Lu}\p{Ll}+) \d+ (?P<unit>\p{L}[\p{L} ]*)")
_DATE = regex.compile(rf"(?:{_NAME} )+den \d{{1,2}} {_NAME} \d{{4}}")
_SIGNED = regex.compile(rf"{_NAME}(?: {_NAME}){{1,3}}(?:, \p{{Ll}}\p{{L}}+)?")
_SIGNS = regex.compile(r"[()\[\]{}„“”\"«»‹›]|<(?P<end>/?)(?P<name>\p{L}[\w:.-]*)(?P<rest>(?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)(?P<stop>>?)")
_BOUNDARY = regex.compile(r"[.!?]['\"’”“»)\]]*\s+['\"„“”»«(\[]*\p{Lu}")
_BRACKETS = {")": "(", "]": "[", "}": "{"}
#: Quotes by family; languages open and close with either, so a sign closes what its family has open and else opens. Only „ always opens.
_QUOTES = {"„": '"', "“": '"', "”": '"', '"': "'", "«": "«", "»": "«", "‹": "‹", "›": "‹"}
#: Elements without an end (fixed values of HTML and TEI).
_VOID = {"br", "hr", "img", "wbr", "meta", "link", "input", "lb", "pb", "cb", "gap", "space", "milestone", "graphic"}


def open_signs(text: str) -> list[tuple[str, int]]:
    """The stack automaton: brackets, quotes and tags that the text opens and never closes, with their places.

    A closing sign closes the nearest open one of its kind and drops what that encloses; one without a partner is passed over.
    """
    stack: list[tuple[str, int]] = []

    def close(kind: str) -> bool:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == kind:
                del stack[i:]
                return True
        return False

    for m in _SIGNS.finditer(text):
        sign = m.group()
        if sign[0] == "<":
            name = "<" + m["name"].lower()
            if not m["stop"]:
                stack.append(("<", m.start()))  # a tag that itself isn't finished
            elif m["end"]:
                close(name)
            elif not m["rest"].endswith("/") and name[1:] not in _VOID:
                stack.append((name, m.start()))
        elif sign in _BRACKETS:
            close(_BRACKETS[sign])
        elif sign in _QUOTES:
            if sign == "„" or not close(_QUOTES[sign]):
                stack.append((_QUOTES[sign], m.start()))
        else:
            stack.append((sign, m.start()))
    return stack


def structure(text: str) -> tuple[list[str], list[str]]:
    """Kinds of the signs that open something, and of those left open."""
    opened = {("<" + m["name"].lower() if m["stop"] else "<") if m["name"] else _QUOTES.get(m.group(), m.group()) for m in _SIGNS.finditer(text) if not m["end"] and m.group() not in _BRACKETS}
    if not opened:
        return [], []
    return sorted(opened), sorted({kind for kind, _ in open_signs(text)})


def _breaks_off(text: str) -> bool:
    """Whether the last sentence leaves a bracket or an unfinished tag open."""
    left = [at for kind, at in open_signs(text) if kind in ("(", "[", "{", "<")] if _SIGNS.search(text) else []
    return bool(left) and not _BOUNDARY.search(text, left[-1] + 1)


def ending(text: str | None) -> tuple[str, str | None]:
    """How a text in the consistent form ends: its state and, where the corpus must decide, the phrase to look up.

    blank, whole (terminator or settled closing), broken (a cut sign, or a bracket or tag that the last sentence leaves
    open), unit and formula (whole if the corpus knows the phrase), open (no terminator, no closing).
    """
    text = (text or "").strip()
    if not text:
        return "blank", None
    whole = bool(_WHOLE.search(text))
    if _BROKEN.search(text) or _breaks_off(text):
        return "broken", None
    if whole:
        return "whole", None
    lines = [line for line in (" ".join(x.split()) for x in _LINES.split(text)) if line]
    last, before = lines[-1], lines[-2] if len(lines) > 1 else ""
    if m := _ENTRY.fullmatch(last):
        return "unit", m["unit"].lower()
    if _WHOLE.search(before) or before.lower() in FORMULAS or _ENTRY.fullmatch(before):
        if m := _SUM.fullmatch(last):
            return "unit", m["unit"].lower()
        if _DATE.fullmatch(last) or _SIGNED.fullmatch(last):
            return "whole", None
        if last.lower() in FORMULAS:
            return "whole", None
        if len(last.split()) <= 4:
            return "formula", last.lower()
    return "open", None


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(texts, SLICE_CHARS):
            plain = [(t or "").strip() for t in consistent(texts.slice(low, high - low)).to_pylist()]
            found = [ending(t) for t in plain]
            sets = [s == "whole" or bool(_SENTENCE.search(t)) for t, (s, _) in zip(plain, found, strict=True)]
            signs = [structure(t) for t in plain]
            part = batch.slice(low, high - low)
            columns = [pa.array([s for s, _ in found]), pa.array([p for _, p in found], pa.string()), pa.array(sets, pa.bool_()), *(pa.array([s[k] for s in signs], pa.list_(pa.string())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), *columns], names=["doc_id", "source", "state", "phrase", "sets", "signs", "left"])


def _closing(ended: DataFrame) -> DataFrame:
    """source, closing: the kinds of signs that texts of the source, or where these are few those of the corpus, as a rule close. ended: source, signs, left of texts that end whole."""
    kinds = ended.select("source", F.explode("signs").alias("kind"), "left").groupBy("source", "kind").agg(F.count("*").alias("n"), F.count_if(~F.array_contains("left", F.col("kind"))).alias("n_closed"))
    rule = (F.col("n") >= LEAST_TEXTS) & (F.col("n_closed") >= CLOSED * F.col("n"))
    set_of = lambda condition: F.collect_set(F.when(condition, F.col("kind")))
    corpus = kinds.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("n_closed").alias("n_closed")).agg(set_of(rule).alias("usual"))
    own = kinds.groupBy("source").agg(set_of(rule).alias("own"), set_of(F.col("n") >= LEAST_TEXTS).alias("many"))
    return own.crossJoin(corpus).select("source", F.array_union("own", F.array_except("usual", "many")).alias("closing"))


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, truncated and unclosed (the automaton found a sign left open) for every document that isn't blank."""
    read = spread(pick(documents, "doc_id", "source", "text")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").where("text is not null")
    kind = read.schema["doc_id"].dataType.simpleString()
    ends = materialise(read.mapInArrow(_endings, f"doc_id {kind}, source string, state string, phrase string, sets boolean, signs array<string>, left array<string>").where("state <> 'blank'"), "endings")
    counts = materialise(ends.groupBy("state", "phrase").agg(F.count("*").alias("n")), "phrases")
    totals = counts.where("state <> 'whole'").agg(F.sum(F.when(F.col("state") == "unit", F.col("n")).otherwise(0)).alias("unit"), F.sum("n").alias("formula")).first()
    share = F.when(F.col("state") == "unit", totals["unit"]).otherwise(totals["formula"])
    known = counts.where(F.col("phrase").isNotNull() & (F.col("n") >= LEAST_COUNT) & (F.col("n") >= LEAST_SHARE * share)).select("state", "phrase", F.lit(True).alias("known"))
    settled = ends.join(known, ["state", "phrase"], "left").withColumn("state", F.when(F.col("phrase").isNull(), F.col("state")).when(F.col("known"), "whole").otherwise("open")).select("doc_id", "source", "state", "sets", "signs", "left")
    ended = F.col("state") == "whole"
    habit = settled.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("sets") | ended).alias("n_set"))
    corpus = habit.agg((F.sum("n_set") / F.sum("n")).alias("usual"))
    habit = habit.crossJoin(corpus).select("source", F.when(F.col("n") >= LEAST_TEXTS, F.col("n_set") / F.col("n")).otherwise(F.col("usual")).alias("terminated"))
    habit = habit.join(_closing(settled.where(ended)), "source", "left")
    cut = F.when(ended, F.arrays_overlap("left", "closing")).otherwise((F.col("state") == "broken") | F.col("sets") | (F.col("terminated") >= TERMINATED))
    return settled.join(habit, "source").select("doc_id", "source", F.coalesce(cut, F.lit(False)).alias("truncated"), (F.size("left") > 0).alias("unclosed"))


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id of the texts that stop within a word or sentence."""
    return judged(documents).where("truncated").select("doc_id")


def rates(documents: DataFrame) -> DataFrame:
    """source, n_documents that aren't blank, n_truncated, n_unclosed (a sign is left open), rate of the truncated."""
    per = judged(documents).groupBy(F.nullif("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_documents"), F.count_if("truncated").alias("n_truncated"), F.count_if("unclosed").alias("n_unclosed"))
    return per.withColumn("rate", F.col("n_truncated") / F.col("n_documents"))
