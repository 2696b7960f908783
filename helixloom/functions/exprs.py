"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: contig order, 1-22 then X and Y
CONTIG_ORDER = [str(i) for i in range(1, 23)] + ["X", "Y"]


def contig_rank(chrom) -> Column:
    """Natural contig order, with or without the 'chr' prefix; unknown contigs sort last."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return F.coalesce(
        F.try_to_number(F.regexp_extract(bare, r"^(\d+)$", 1), F.lit("999")).cast("int"),
        F.when(bare == "X", 23).when(bare == "Y", 24).otherwise(1000),
    )


def allowed_contig(chrom, style: str = "either") -> Column:
    """Primary contigs in plain ('grch'), prefixed ('ucsc') or either naming."""
    plain, prefixed = CONTIG_ORDER, [f"chr{c}" for c in CONTIG_ORDER]
    names = {"grch": plain, "ucsc": prefixed, "either": plain + prefixed}[style]
    return F.col(chrom).isin(names) if isinstance(chrom, str) else chrom.isin(names)


def tile_of(pos, width: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(width)).cast("long")


def overlap_len(s1, e1, s2, e2) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def reciprocal_ok(s1, e1, s2, e2, frac: float) -> Column:
    """Both overlap fractions reach ``frac``; 0 always passes; a zero-length interval never does."""
    if frac == 0:
        return F.lit(True)
    ov = overlap_len(s1, e1, s2, e2)
    return (ov > 0) & (e1 > s1) & (e2 > s2) & (ov >= frac * (e1 - s1)) & (ov >= frac * (e2 - s2))


def same(cols_a, cols_b) -> Column:
    return reduce(lambda a, b: a & b, [x == y for x, y in zip(cols_a, cols_b)])


def is_carrier(a1="a1", a2="a2") -> Column:
    """Genotype is neither reference nor null."""
    return (F.coalesce(F.col(a1), F.lit(0)) > 0) | (F.coalesce(F.col(a2), F.lit(0)) > 0)


def is_null_gt(a1="a1", a2="a2") -> Column:
    return F.col(a1).isNull() & F.col(a2).isNull()


def r6(c, digits: int = 6) -> Column:
    return F.round(c, digits)


def joined(col, sep=",") -> Column:
    """Distinct values of a group in order, as one string."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)
