"""Column expressions over DNA: strings, k-mers and the likelihoods of genotypes.

k is odd, so no k-mer is its own reverse complement.  Up to k = 31 a k-mer is a
packed long with two bits a base, A C G T = 0 1 2 3, the first base highest;
above that it is a string.  Both have the same order.  An oriented node is a
k-mer on one of its strands: 2 * k-mer + strand, or the string as it reads there.
Edges are a byte: bit b of the low four means that base b follows the k-mer as
it stands, bit 4 + b that base b follows its reverse complement.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The longest k-mer that a long holds, and the longest at all.
PACKED, LONGEST = 31, 255


def check_k(k: int) -> int:
    if k % 2 == 0 or not 3 <= k <= LONGEST:
        raise ValueError(f"k must be odd and from 3 to {LONGEST}, not {k}")
    return k


def kmer_type(k: int) -> str:
    return "long" if k <= PACKED else "string"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCATGCA"))


def canonical(seq: Column) -> Column:
    return F.least(seq, reverse_complement(seq))


def text_to_dna(text: Column) -> Column:
    """A read from prose: letters to ACGT by their place in the alphabet, digits to N, the rest away."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    return F.translate(plain, _LETTERS + _LETTERS.lower() + "0123456789", ("ACGT" * 7)[:26] * 2 + "N" * 10)


_SWAPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))


def packed_reverse_complement(x: Column, k: int) -> Column:
    """The reverse complement of a packed k-mer: neighbouring bases, pairs and so on change places, then all bits turn.

    x stands in it 32 times, so it should be a plain column.
    """
    for n, mask in _SWAPS:
        x = F.shiftrightunsigned(x, n).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), n))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(F.bitwise_not(x), 64 - 2 * k)


def unpacked(x: Column, k: int) -> Column:
    """A packed k-mer as a string."""
    bases = [F.substring(F.lit("ACGT"), F.shiftrightunsigned(x, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) for i in range(k)]
    return F.concat(*bases)


def kmer_text(kmer: Column, k: int) -> Column:
    """A k-mer as a string, whatever its type."""
    return unpacked(kmer, k) if k <= PACKED else kmer


def node(kmer: Column, fw: Column, k: int) -> Column:
    """An oriented node: a k-mer as it stands (fw), or its reverse complement."""
    return kmer * 2 + fw.cast("long") if k <= PACKED else F.when(fw, kmer).otherwise(reverse_complement(kmer))


def node_kmer(oriented: Column, k: int) -> Column:
    return F.shiftright(oriented, 1) if k <= PACKED else canonical(oriented)


def node_text(oriented: Column, k: int) -> Column:
    """The bases of an oriented node."""
    if k > PACKED:
        return oriented
    text = unpacked(F.shiftright(oriented, 1), k)
    return F.when(oriented.bitwiseAND(F.lit(1)) == 1, text).otherwise(reverse_complement(text))


def turned(oriented: Column, k: int) -> Column:
    """The other strand of an oriented node."""
    return oriented.bitwiseXOR(F.lit(1)) if k <= PACKED else reverse_complement(oriented)


def exits(edges: Column, fw: Column) -> Column:
    """The four bits of the bases that follow a node on one strand."""
    return F.when(fw, edges.bitwiseAND(F.lit(15))).otherwise(F.shiftright(edges, 4).bitwiseAND(F.lit(15)))


def log_factorial(n: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, x: a + F.log(x.cast("double"))))


def expected_depth(total_seq: Column, genome_size: Column, read_length: Column, k: int) -> Column:
    """theta: the depth of k-mers, D (R - k + 1) / R."""
    return total_seq / genome_size * (read_length - k + 1) / read_length


def log_likelihoods(c1: Column, c2: Column, theta1: Column, theta2: Column, error: float | Column = 0.01, ploidy: int = 2, halved_twice: bool = False) -> dict[str, Column]:
    """hom1, het and hom2 log-likelihoods of read counts on two branches.

    Homozygous: Poisson on the branch present, and an error for each read on the
    other beyond those that errors explain.  Heterozygous: Poisson at half the
    depth on both; halved_twice: at a quarter, as where callers pass half the
    depth already.  Haploid samples have no heterozygotes: the two homozygous
    ones less 99999.
    """

    def poisson(c: Column, theta: Column) -> Column:
        return c * F.log(theta) - theta - log_factorial(c)

    def errors(c: Column, theta: Column) -> Column:
        return F.greatest(F.lit(0.0), c - rate * theta) * F.log(rate)

    rate = error if isinstance(error, Column) else F.lit(error)
    if ploidy not in (1, 2):
        raise ValueError("ploidy is 1 or 2")
    hom1, hom2 = poisson(c1, theta1) + errors(c2, theta1), poisson(c2, theta2) + errors(c1, theta2)
    part = 4 if halved_twice else 2
    het = poisson(c1, theta1 / part) + poisson(c2, theta2 / part) if ploidy == 2 else hom1 + hom2 - 99999
    return {"hom1": hom1, "het": het, "hom2": hom2}


def genotype(hom1: Column, het: Column, hom2: Column, depth: Column) -> Column:
    """The likeliest genotype; of equal ones the first; NO_CALL without depth."""
    return F.when(depth <= 0, "NO_CALL").when((hom1 >= het) & (hom1 >= hom2), "HOM1").when(het >= hom2, "HET").otherwise("HOM2")


def genotype_confidence(*llks: Column) -> Column:
    """The best log-likelihood less the second best, to two places."""
    ranked = F.sort_array(F.array(*llks), asc=False)
    return F.round(ranked[0] - ranked[1], 2)
