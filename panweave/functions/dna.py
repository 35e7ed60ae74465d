"""Column functions on nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of ordinary text as bases, in turn; how the driver's text tables become nucleotides.
AS_BASES = ("ACGT" * 7)[:26]
# The bases that an IUPAC code stands for.
IUPAC = {"R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT"}


def dna(text: Column) -> Column:
    """Plain letters of a text as bases; everything else goes."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, AS_BASES)


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def iupac_clean(seq: Column) -> Column:
    """Upper-cased; each ambiguity code becomes a member of its set, chosen by its place: same input, same output.

    Letters that are no code become null, as a cell of unknown content isn't a sequence.
    """
    plain = F.upper(seq)
    chars = F.split(plain, "")
    sets = F.create_map(*(F.lit(x) for kv in IUPAC.items() for x in kv))

    def member(char: Column, place: Column) -> Column:
        options = sets[char]
        chosen = F.substring(options, F.pmod(place, F.length(options)) + 1, F.lit(1))
        return F.when(char.isin("A", "C", "G", "T"), char).otherwise(chosen)

    cleaned = F.transform(chars, member)
    # Characters become cells only where there is a code among them.
    return F.when(plain.rlike("^[ACGT]*$"), plain).when(plain.rlike("^[ACGTRYMKSWHBVDN]*$"), F.array_join(cleaned, ""))


def kmer_code(kmer: Column) -> Column:
    """Two bits for each base, first base highest; k up to 31."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def kmer_text(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code, 10, 4), k, "0"), "0123", "ACGT")


def base_code(base: Column) -> Column:
    return F.translate(base, "ACGT", "0123").cast("long")


def push_right(code: Column, base: Column, k: int) -> Column:
    """The code of the k-mer without its first base and with this one after its last."""
    return F.shiftleft(code, 2).bitwiseAND(F.lit((1 << 2 * k) - 1)).bitwiseOR(base_code(base))


def push_left(code: Column, base: Column, k: int) -> Column:
    """The code of the k-mer without its last base and with this one before its first."""
    return F.shiftright(code, 2).bitwiseOR(base_code(base) * F.lit(1 << 2 * (k - 1)))


def peek(code: Column, i: int, k: int) -> Column:
    """The base at place i of a k-mer."""
    return F.substring(F.lit("ACGT"), (F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def short_label(seq: Column) -> Column:
    """Sequences of more than 15 bases by their ends and the length between them."""
    n = F.length(seq)
    return F.when(n <= 15, seq).otherwise(F.concat(F.substring(seq, 1, 5), F.lit("..(+"), (n - 10).cast("string"), F.lit(").."), F.substring(seq, -5, 5)))


def hamming(a: Column, b: Column) -> Column:
    """Places in which two strings of equal length differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda n, x: n + x)
