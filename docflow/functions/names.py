"""Names of volumes, pages and regions brought to one spelling, as Spark columns (no Python in the plan)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that print like these Latin ones.
LOOKALIKES = {
    "АВСЕНІЈКМОРЅТХУ": "ABCEHIJKMOPSTXY",
    "асеһіјорѕхукв": "acehijopsxykb",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "αγικνορυχ": "ayiknopyx",
    "ɑɡ": "ag",
    "օհոսՕՍ": "ohnuOU",
    "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ": "ABCDEGHJKLMPSTVWZ",
    "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ": "ABCDEFGHIJKLMNOPRSTUVWXYZ",
}


def plain_letters() -> tuple[str, str]:
    """Letters and full-width signs with the plain Latin letter each stands for."""
    to: dict[str, str] = {}
    for source, target in LOOKALIKES.items():
        to |= dict(zip(source, target, strict=True))
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), 0x212A, 0x212B]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            to[chr(code)] = base
    to |= {"ø": "o", "Ø": "O", "đ": "d"}
    return "".join(to), "".join(to.values())


_FROM, _TO = plain_letters()


def fold_name(name: Column) -> Column:
    """Percent escapes, case, accents, look-alikes, invisible signs, digraphs and separators set aside."""
    decoded = F.when(name.contains("%"), F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)).otherwise(name)
    letters = F.lower(F.translate(F.regexp_replace(decoded, r"[\p{M}\p{Cf}]", ""), _FROM, _TO))
    letters = F.regexp_replace(letters, "ae|aa", "a")
    letters = F.regexp_replace(letters, "oe", "o")
    return F.regexp_replace(F.regexp_replace(letters, r"[\s\p{Z}_\-‐‑.~()]+", "_"), "^_+|_+$", "")


#: A folded name up to the volume's code: a letter and at least five digits.
_VOLUME = r"^(.*?[a-z]\d{5,})"
_REST = r"_0*(\d+)(?:_(?:\d{1,2}|kopia|copy|jpe?g|png|tiff?))*"


#: A folded key of a region: volume, page number, region number.
REGION = _VOLUME + _REST + r"_[a-z]*_?0*(\d+[a-z]*)$"


def volume_of(folded: Column) -> Column:
    """The volume that a folded image name or key begins with; null where it names none."""
    return F.nullif(F.regexp_extract(folded, _VOLUME + "(?:_|$)", 1), F.lit(""))


def region_key(unique_key: Column) -> Column:
    """volume/page/region of a unique_key, however spelled; null where it doesn't name all three."""
    folded = fold_name(unique_key)
    return F.when(folded.rlike(REGION), F.regexp_replace(folded, REGION, "$1/$2/$3"))


def split_name(split: Column) -> Column:
    """train, val or test, however spelled; null for anything else."""
    plain = F.regexp_replace(fold_name(split), "_", "")
    return F.when(plain.startswith("tr"), "train").when(plain.startswith("val") | plain.startswith("dev"), "val").when(plain.startswith("te"), "test")
