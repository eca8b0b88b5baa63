"""Scalar functions on sequences and seeds, as columns (whole-stage codegen, no Python)."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.params import Params

#: The four-letter projection of text.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
#: What else texts are made of mostly; one pass maps it together with the letters.
MARKS, BLANKS = "0123456789" + string.punctuation, " \t\n\x0b\f\r"


def project_dna(text: Column) -> Column:
    """Text as a sequence: letters map to bases, white space goes, anything else is N. White space must go before N is set, else no k-mer survives."""
    dense = F.translate(F.lower(text), LETTERS + MARKS + BLANKS, BASES + "N" * len(MARKS))  # blanks have no counterpart and go
    return F.regexp_replace(dense, "[^ACGTN]", "N")


def reverse_complement(seq: Column) -> Column:
    """Both cases are kept; a letter that is no base becomes N."""
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ACGTNacgtn]", "N")), "ACGTacgt", "TGCAtgca")


def base_code(base: Column) -> Column:
    """A, C, G, T as 0..3 in either case, all else 4."""
    letter = F.translate(base, "acgt", "ACGT")  # not upper(): it makes two letters of some
    return F.coalesce(F.translate(F.when(letter.rlike("^[ACGT]$"), letter), "ACGT", "0123").cast("int"), F.lit(4))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement (letter order is code order)."""
    return F.least(kmer, F.translate(F.reverse(kmer), "ACGT", "TGCA"))


def kmer_code(kmer: Column, k: int) -> Column:
    """A k-mer of ACGT as a 2-bit number."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def _left(x: Column, s: int, bits: int) -> Column:
    """x << s inside ``bits`` bits, without overflow."""
    return F.lit(0).cast("long") if s >= bits else F.shiftleft(x.bitwiseAND(F.lit((1 << (bits - s)) - 1)), s)


def hash_steps(k: int) -> list[Callable[[Column], Column]]:
    """The invertible mix of a 2k-bit number, step by step. Sums stay below 2^63 because every term is masked first, or because the number is short: then shifts and sums are a product."""
    bits, mask = 2 * k, (1 << 2 * k) - 1
    cut = lambda x: x.bitwiseAND(F.lit(mask))
    fold = lambda n: lambda x: x.bitwiseXOR(F.shiftright(x, n))
    if bits <= 31:
        long = lambda n: F.lit(n).cast("long")
        return [
            lambda x: cut(x * long((1 << 21) - 1) - long(1)), lambda x: cut(fold(24)(x) * long(1 + (1 << 3) + (1 << 8))),
            lambda x: cut(fold(14)(x) * long(1 + (1 << 2) + (1 << 4))), fold(28),
        ]
    return [
        lambda x: cut((F.lit(mask) - x) + _left(x, 21, bits)), fold(24), lambda x: cut(x + _left(x, 3, bits) + _left(x, 8, bits)),
        fold(14), lambda x: cut(x + _left(x, 2, bits) + _left(x, 4, bits)), fold(28), lambda x: cut(x + _left(x, 31, bits)),
    ]


def seed_hash(code: Column, k: int) -> Column:
    """The mix as one expression, for single values; it repeats its argument, so use ``with_seed_hash`` on tables."""
    for step in hash_steps(k):
        code = step(code)
    return code


def with_seed_hash(rows: DataFrame, code: str, k: int, name: str = "hash") -> DataFrame:
    """Add the hash of a column. A projection for each step keeps the plan as long as the mix: one expression would double at every step."""
    rows = rows.withColumn(name, F.col(code))
    for step in hash_steps(k):
        rows = rows.withColumn(name, step(F.col(name)))
    return rows


HASH_ID = 1


def shard_id(hash_: Column, bits: int) -> Column:
    """The shard of a seed: its low bits."""
    if not 1 <= bits <= 30:
        raise ValueError("shard bits must be in [1, 30]")
    return hash_.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def shard_file(shard: Column) -> Column:
    return F.concat(F.lit("seed-shard-"), F.lpad(shard.cast("string"), 4, "0"), F.lit(".bin"))


def joint_strand(query: Column, ref: Column) -> Column:
    return query.bitwiseXOR(ref).bitwiseAND(F.lit(1))


def pack_hit(pos: Column, strand: Column, flags: Column) -> Column:
    """Position (28 bits), strand (1) and flags (3) in 32 bits; a position that doesn't fit is an error, not a wrap."""
    checked = F.when(pos < (1 << 28), pos.cast("long")).otherwise(F.raise_error(F.lit("position needs more than 28 bits")))
    return checked + F.shiftleft(strand.cast("long").bitwiseAND(F.lit(1)), 28) + F.shiftleft(flags.cast("long").bitwiseAND(F.lit(7)), 29)


def unpack_hit(word: Column) -> tuple[Column, Column, Column]:
    return word.bitwiseAND(F.lit((1 << 28) - 1)), F.shiftright(word, 28).bitwiseAND(F.lit(1)), F.shiftright(word, 29).bitwiseAND(F.lit(7))


def pack_entry(count: Column, flags: Column) -> Column:
    """Directory word: count (24 bits) and flags (8)."""
    return count.cast("long").bitwiseAND(F.lit((1 << 24) - 1)) + F.shiftleft(flags.cast("long").bitwiseAND(F.lit(255)), 24)


def unpack_entry(word: Column) -> tuple[Column, Column]:
    return word.bitwiseAND(F.lit((1 << 24) - 1)), F.shiftright(word, 24).bitwiseAND(F.lit(255))


def approximate_mapq(f1: Column, f2: Column, m: Column) -> Column:
    """40 (1 - f2/f1) min(1, m/10) ln f1, rounded half up, in [0, 60]; 0 unless f1 is positive and finite."""
    f1, f2, m = f1.cast("double"), f2.cast("double"), m.cast("double")
    rival = F.when(f2 > 0, f2 / f1).otherwise(F.lit(0.0))
    raw = F.lit(40.0) * F.greatest(F.lit(0.0), F.lit(1.0) - rival) * F.least(F.lit(1.0), m / 10.0) * F.log(f1)
    fine = f1.isNotNull() & (f1 > 0) & (f1 < F.lit(float("inf"))) & ~F.isnan(f1)
    return F.when(fine, F.least(F.lit(60), F.floor(F.greatest(raw, F.lit(0.0)) + 0.5))).otherwise(0).cast("int")


def cigar(q_start: Column, q_end: Column, ref_start: Column, ref_end: Column, q_len: Column, secondary: Column) -> Column:
    """Clip, match, clip. The match is as long as the reference span; hard clips only on secondary records."""
    clip = F.when(secondary, "H").otherwise("S")
    lead = F.when(q_start > 0, F.concat(q_start.cast("string"), clip)).otherwise("")
    tail = F.when(q_len - q_end > 0, F.concat((q_len - q_end).cast("string"), clip)).otherwise("")
    return F.when(ref_end - ref_start <= 0, "*").otherwise(F.concat(lead, (ref_end - ref_start).cast("string"), F.lit("M"), tail))


def sam_flag(joint: Column, supplementary: Column, secondary: Column) -> Column:
    return (joint * 16 + supplementary.cast("int") * 2048 + secondary.cast("int") * 256).cast("int")


def overlap_fraction(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Share of the first span that the second covers."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start)) / F.greatest(F.lit(1), a_end - a_start)


def cigar_spans(cigar_: Column) -> tuple[Column, Column, Column]:
    """(q_start, q_end, ref_span) of a CIGAR text.

    q_start is the length of a leading clip. The cursor moves on M, I, =, X and S, never on H;
    q_end is the cursor after the last operation that is no clip.
    """
    ops = F.regexp_extract_all(cigar_, F.lit("([0-9]+)([MIDNSHP=X])"), 2)
    sizes = F.transform(F.regexp_extract_all(cigar_, F.lit("([0-9]+)([MIDNSHP=X])"), 1), lambda x: x.cast("long"))
    zipped = F.arrays_zip(ops.alias("op"), sizes.alias("n"))
    first = F.when(F.get(ops, F.lit(0)).isin("S", "H"), F.get(sizes, F.lit(0))).otherwise(0)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("span"))

    def step(s: Column, x: Column) -> Column:
        op, n = x["op"], x["n"]
        at = s["at"] + F.when(op.isin("M", "I", "=", "X", "S"), n).otherwise(0)
        return F.struct(at.alias("at"), F.when(op.isin("S", "H"), s["end"]).otherwise(at).alias("end"), (s["span"] + F.when(op.isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("span"))

    state = F.aggregate(zipped, start, step)
    return first.cast("long"), state["end"], state["span"]


def stored_reference(seq: Column) -> Column:
    """The reference as refinement sees it: two bits a base can't hold N, which reads as A."""
    return F.regexp_replace(seq, "[^ACGT]", "A")


def check(params: Params | None) -> Params:
    return params or Params()
