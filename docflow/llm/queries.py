"""Queries of the language-model data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.names import LOOKALIKES, REGION, plain_letters
from docflow.llm import characters, grouped_splits, leaks, overlaps, token_ids, truncation
from docflow.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train sample and a val or test sample that are one record."""
    pairs = overlaps.overlaps(table(spark, sf_dir, "region_samples"))
    return pairs.select(F.least("train_id", "other_id").alias("sample_id_a"), F.greatest("train_id", "other_id").alias("sample_id_b"))


def p1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p1_found that are one record by their keys."""
    pairs = overlaps.key_pairs(overlaps.keyed(table(spark, sf_dir, "region_samples")))
    return pairs.select(F.least("train_id", "other_id").alias("sample_id_a"), F.greatest("train_id", "other_id").alias("sample_id_b"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping samples and pairs by split and source."""
    samples = table(spark, sf_dir, "region_samples")
    return overlaps.report(overlaps.overlaps(samples), samples, table(spark, sf_dir, "volumes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose transcription isn't in the consistent form."""
    return characters.inconsistent(table(spark, sf_dir, "text_lines"))


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's transcription in the consistent form."""
    return characters.unify(table(spark, sf_dir, "text_lines").select("line_pk", "transcription"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes that the split manifests part."""
    return grouped_splits.parted_volumes(table(spark, sf_dir, "split_info"), table(spark, sf_dir, "volumes"))


def _assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits.assign(*(table(spark, sf_dir, t) for t in ("region_samples", "split_info", "volumes")))


def p3_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every page."""
    return _assignment(spark, sf_dir)


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and volumes of each split by source."""
    return _assignment(spark, sf_dir).groupBy("split", "source").agg(F.count("*").alias("n_pages"), F.countDistinct("volume").alias("n_volumes"))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages assigned, volumes parted, and whether each split has its proportion of the pages to the size of the largest component."""
    pages = _assignment(spark, sf_dir)
    parted = pages.where("volume is not null").groupBy("volume").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_parted"))
    units = pages.groupBy("component", "split").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))
    of = lambda s: F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0))
    near = [(F.abs(of(s) - r * F.sum("n")) <= F.max("n")).alias(f"{s}_near") for s, r in grouped_splits.SPLITS]
    return units.agg(F.sum("pages").alias("n_pages"), F.sum("n").alias("n_rows"), *near).crossJoin(parted)  # a row each


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return token_ids.encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items that they hold."""
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks by split of the items and source of the documents."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items")
    return leaks.report(leaks.leaked(documents, items), documents, items)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text stops within a word or sentence."""
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.rates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_keys, p1_report, p2_found, p2_text, p3_found, p3_assignment, p3_balance, p3_totals, p6_ids, p7_found, p7_report, p8_found, p8_rates)}

_FOLDED = r"regexp_extract(strip_accents(lower(nfc_normalize(trim({})))), '^(.*?[a-z]\d{{5,}})(_|$)', 1)"

#: Full-width signs and their plain ones, and letters of other scripts with the Latin ones that print alike.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_ALIKE, _LATIN = ("".join(x) for x in zip(*LOOKALIKES.items(), strict=True))
_MEMBER = r"\p{Lu}\p{Ll}\p{Lt}\p{Lo}\p{M}"

_PLAIN = tuple(x.replace("'", "''") for x in plain_letters())


def _folded(name: str) -> str:
    """SQL of functions.names.fold_name."""
    decoded = f"CASE WHEN contains({name}, '%') THEN coalesce(TRY(url_decode(replace({name}, '+', '%2B'))), {name}) ELSE {name} END"
    letters = rf"lower(translate(regexp_replace({decoded}, '[\p{{M}}\p{{Cf}}]', '', 'g'), '{_PLAIN[0]}', '{_PLAIN[1]}'))"
    return rf"trim(regexp_replace(replace(regexp_replace({letters}, 'ae|aa', 'a', 'g'), 'oe', 'o'), '[\s\p{{Z}}_\-‐‑.~()]+', '_', 'g'), '_')"


ORACLE = {
    "p1_keys": rf"""
WITH folded AS (SELECT sample_id, lower(trim(split)) AS split, {_folded("unique_key")} AS k FROM region_samples),
keys AS (SELECT sample_id, split LIKE 'tr%' AS train, regexp_replace(k, '{REGION}', '\1/\2/\3') AS key FROM folded WHERE regexp_matches(k, '{REGION}') AND regexp_matches(split, '^(tr|val|dev|te)'))
SELECT least(a.sample_id, b.sample_id) AS sample_id_a, greatest(a.sample_id, b.sample_id) AS sample_id_b FROM keys a JOIN keys b USING (key) WHERE a.train AND NOT b.train""",
    "p3_totals": rf"""
WITH names AS (SELECT img_filename AS name FROM region_samples UNION ALL SELECT unnest(train) FROM split_info UNION ALL SELECT unnest(val) FROM split_info UNION ALL SELECT unnest(test) FROM split_info),
pages AS (SELECT DISTINCT regexp_replace({_folded("name")}, '_(jpe?g|png|tiff?)$', '') AS page FROM names WHERE name IS NOT NULL)
SELECT count(*) AS n_pages, count(*) AS n_rows, true AS train_near, true AS val_near, true AS test_near, CAST(0 AS BIGINT) AS n_parted FROM pages""",
    "p2_text": rf"""
WITH plain AS (
  SELECT line_pk, nfc_normalize(translate(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(transcription, '[\p{{Cf}}]', '', 'g'), '[\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'),
    chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl'), chr(64261), 'ſt'), chr(64262), 'st'), '{_WIDE}‐‑', '{_NARROW}--')) AS t FROM text_lines),
words AS (
  SELECT line_pk, list_transform(regexp_extract_all(t, '[{_MEMBER}]+|[^{_MEMBER}]+'), lambda w: CASE WHEN regexp_matches(w, '[A-Za-zÀ-ɏḀ-ỿ]') AND regexp_matches(w, '[\p{{Greek}}\p{{Cyrillic}}ɑɡ]') THEN translate(w, '{_ALIKE}', '{_LATIN}') ELSE w END) AS ws FROM plain)
SELECT line_pk, CASE WHEN ws IS NOT NULL THEN nfc_normalize(array_to_string(ws, '')) END AS transcription FROM words""",
    "p2_found": r"""
SELECT line_pk FROM text_lines WHERE transcription <> nfc_normalize(transcription)
  OR regexp_matches(transcription, '[\p{Cf}\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2010}\x{2011}\x{FB00}-\x{FB06}\x{FF01}-\x{FF5E}]')
  OR regexp_matches(transcription, '\p{Latin}\p{M}*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}]\p{M}*\p{Latin}|[A-Za-zÀ-ɏ][ɑɡ]|[ɑɡ][A-Za-zÀ-ɏ]')""",
    "p3_found": f"""
WITH listed AS (
  SELECT scheme, 'train' AS split, unnest(train) AS name FROM split_info UNION ALL
  SELECT scheme, 'val', unnest(val) FROM split_info UNION ALL
  SELECT scheme, 'test', unnest(test) FROM split_info)
SELECT scheme, volume_id FROM (SELECT scheme, split, {_FOLDED.format("name")} AS v FROM listed) l
JOIN (SELECT volume_id, {_FOLDED.format("img_volume")} AS v FROM volumes) USING (v)
WHERE v <> '' GROUP BY scheme, volume_id HAVING count(DISTINCT split) > 1""",
}
