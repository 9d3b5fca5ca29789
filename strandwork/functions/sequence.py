"""Normalisation, quality gates and token expressions for residue sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary in id order. They must equal the published tokenizer's.
VOCABULARY = ["<cls>", "<pad>", "<eos>", "<unk>", "L", "A", "G", "V", "S", "E", "R", "T", "I", "D", "P", "K", "Q", "N", "F", "Y", "M", "H", "W", "C", "X", "B", "U", "Z", "O", ".", "-", "|", "<mask>"]
CLS, PAD, EOS, UNK, MASK = 0, 1, 2, 3, 32
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"  # fixed: the 20 amino acids
RESIDUES = CANONICAL + "XBUZO"


def normalised(col: Column) -> Column:
    """Upper case; blanks, tabs, LF, CR dropped; trailing ``*`` run dropped; the rest outside the residues becomes X.

    Null stays null; an empty or blank text becomes the empty string. One character
    (code point) outside the alphabet becomes exactly one X.
    """
    text = F.rtrim(F.regexp_replace(F.upper(col), "[ \t\n\r]", ""), F.lit("*"))
    outside = f"[^{RESIDUES}]"
    return F.when(text.rlike(outside), F.regexp_replace(text, outside, "X")).otherwise(text)


def canonical_count(seq: Column) -> Column:
    """Number of residues among the 20 canonical ones."""
    return F.length(F.regexp_replace(seq, f"[^{CANONICAL}]", ""))


def rejection(seq: Column, low: int = 60, high: int = 16384, max_ambiguous: float = 0.2) -> Column:
    """First failing rule of a normalised sequence: short, long, ambiguous; null if it passes, ``missing`` for null."""
    size = F.length(seq)
    return (
        F.when(seq.isNull(), F.lit("missing"))
        .when(size < low, F.lit("short"))
        .when(size > high, F.lit("long"))
        .when(size - canonical_count(seq) > max_ambiguous * size, F.lit("ambiguous"))
    )


def token_ids(seq: Column) -> Column:
    """Ids of the residues of a normalised sequence; characters outside the vocabulary become ``<unk>``.

    The id is looked up in an array by the character's code.
    """
    by_code = {ord(c): i for i, c in enumerate(VOCABULARY) if len(c) == 1}
    lookup = F.array(*[F.lit(by_code.get(k, UNK)) for k in range(128)])
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.coalesce(F.get(lookup, F.ascii(c)), F.lit(UNK)))


def framed(ids: Column, max_length: int, offset: Column | int = 0) -> Column:
    """BOS + cropped ids + EOS, padded to ``max_length``."""
    start = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    body = F.concat(F.array(F.lit(CLS)), F.slice(ids, start, max_length - 2), F.array(F.lit(EOS)))
    return F.concat(body, F.array_repeat(F.lit(PAD), F.lit(max_length) - F.size(body)))
