"""Problem 8: visually identical text with different characters, by confusables skeletons."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.classes import member_pairs
from mosaiq.operators.skew import skew_join
from mosaiq.runtime import Scratch, ship

# Cyrillic and Greek letters (and letter-like marks of theirs) with the shape of a Latin letter in common upright
# type. Not a copy of the published table of confusables: that also takes letters of other scripts (Armenian, Cherokee), of
# mathematical alphabets, digits for letters and, by chains, pairs that a reader tells apart (rn and m, I and l). The problem
# counts these as visible differences, as it does small letters that only resemble one (omega, pi, the Cyrillic v, m, n, t).
LOOK_ALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Ү": "Y", "Х": "X", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Һ": "H", "Ӏ": "I",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "к": "k", "ӏ": "l",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ϝ": "F",
    # Greek small letters
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
}

#: Invisible characters that aren't in the category of format characters: fillers and the grapheme joiner.
_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}
#: Format characters that are seen: signs that enclose Arabic, Syriac or Kaithi numbers.
_SEEN = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Everything but printable ASCII, tabs and line ends.
_OTHER = re.compile(r"[^ -~\t\n\r]+")


@lru_cache(maxsize=1 << 16)
def prototype(char: str) -> str:
    """What a fully decomposed character is read as; an empty string for an invisible one."""
    code, kind = ord(char), unicodedata.category(char)
    if kind == "Zs":
        return " "
    if kind == "Cf" and code not in _SEEN or code in _FILLERS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x180B <= code <= 0x180F:
        return ""
    if kind == "Cc" and char not in "\t\n\v\f\r\x85":
        return ""
    how, _, parts = unicodedata.decomposition(char).partition(" ")
    if how in ("<wide>", "<narrow>") or how.startswith("<") and "LIGATURE" in unicodedata.name(char, ""):
        # what it stands for may itself be decomposed or replaced
        return "".join(prototype(c) for c in unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in parts.split())))
    return LOOK_ALIKES.get(char, char)


@lru_cache(maxsize=1 << 16)
def _run(run: str) -> str:
    return unicodedata.normalize("NFD", "".join(map(prototype, unicodedata.normalize("NFD", run))))


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again.

    Only runs of characters other than plain ASCII can change, and as marks are never ASCII, each run on its own.
    """
    return _OTHER.sub(lambda m: _run(m[0]) if len(m[0]) <= 64 else _run.__wrapped__(m[0]), text)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, 128-bit digest of the skeleton, of the text) of each text that isn't null or white space only."""
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    for batch in batches:
        ids, shapes, texts = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if text is None or not text.strip():
                continue
            shape = skeleton(text)
            if not shape.strip():
                continue
            ids.append(i)
            texts.append(digest(text))
            shapes.append(texts[-1] if shape == text else digest(shape))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(shapes, pa.binary()), pa.array(texts, pa.binary())], names=["id", "shape", "exact"])


def look_alike_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scratch: Scratch | None = None) -> DataFrame:
    """(id, text_class, look_class) of the rows whose text differs from another's with the same skeleton: one row an id and text.

    The classes are digests of 128 bits, of the text and of its skeleton: rows that look alike have one look_class, and
    those of them with equal texts one text_class. A table of the scratch folder. See look_alike_pairs for what is read
    as equal.

    Python gets texts in Arrow batches and gives back two digests, so no text is shuffled.
    """
    ship(documents.sparkSession)
    s = scratch or Scratch(documents.sparkSession, "skeleton")
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = s.save(rows.mapInArrow(digests, f"id {kind}, shape binary, exact binary"), "digests")
    # a skeleton is of several texts if it has both a least and a greatest digest: no group is gathered
    varied = rows.groupBy("shape").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).filter("lo <> hi").select("shape")
    found = skew_join(rows, s.save(varied, "varied"), ["shape"], unique=True)
    return s.save(found.select("id", F.col("exact").alias("text_class"), F.col("shape").alias("look_class")).distinct(), "alike")


def look_alike_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "doc_a", b: str = "doc_b", *, scratch: Scratch | None = None) -> DataFrame:
    """(a, b), a < b, of rows whose texts differ but have one skeleton.

    Read as equal: full-width and half-width forms and ligatures and the plain characters, composed and decomposed
    accents, any space character and a space, Cyrillic and Greek letters of LOOK_ALIKES and the Latin ones; invisible
    characters aren't read. Case, digits, punctuation, accents, raised digits, tabs, line ends and the number of spaces
    count. Null texts, texts of white space (or invisible characters) only, and null ids give no pair; repeated rows
    count once; other columns are ignored.

    Texts of one skeleton are paired, in blocks where it has many, and then expanded to rows, so that a million copies of
    one text cost no comparison with each other.
    """
    s = scratch or Scratch(documents.sparkSession, "skeleton")
    alike = look_alike_classes(documents, id_col, text_col, scratch=s)
    classes = s.save(alike.select("look_class", "text_class").distinct(), "classes")
    x, y = (classes.select("look_class", F.col("text_class").alias(c)) for c in ("ca", "cb"))
    pairs = s.save(skew_join(x, y, ["look_class"]).filter("ca < cb").select("ca", "cb"), "pairs")
    return member_pairs(s, pairs, alike.select("id", F.col("text_class").alias("c")), a, b).filter(F.col(a) != F.col(b)).distinct()
