"""Standard form of structural-variant caller records.

A raw record has vid, chrom, pos, stop, alt, svtype and caller-specific columns; a caller is
a function from the raw frame to the standard columns, looked up by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import contig_rank

STANDARD = ["vid", "chrom", "pos", "stop", "chr2", "svtype", "strands", "svlen", "alt", "algorithms"]
CALLERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def caller(name: str):
    def deco(fn):
        CALLERS[name] = fn
        return fn

    return deco


def parse_mate(alt) -> tuple[Column, Column, Column]:
    """(contig, position, strands) of a breakend ALT; the position follows the last colon."""
    alt = F.col(alt) if isinstance(alt, str) else alt
    inner = F.regexp_extract(alt, r"[\[\]](.+)[\[\]]", 1)
    chrom = F.regexp_replace(F.regexp_extract(inner, r"^(.*):(\d+)$", 1), "CHR", "chr")
    pos = F.regexp_extract(inner, r"^(.*):(\d+)$", 2).try_cast("long")
    strands = F.when(alt.endswith("["), "+-").when(alt.endswith("]"), "++").when(alt.startswith("]"), "-+").when(alt.startswith("["), "--")
    return chrom, pos, strands


def make_mate_alt(chrom, pos, strands, ref: str = "N") -> Column:
    p = F.concat(chrom, F.lit(":"), pos.cast("string"))
    return (
        F.when(strands == "++", F.concat(F.lit(ref + "]"), p, F.lit("]"))).when(strands == "+-", F.concat(F.lit(ref + "["), p, F.lit("[")))
        .when(strands == "-+", F.concat(F.lit("]"), p, F.lit("]" + ref))).when(strands == "--", F.concat(F.lit("["), p, F.lit("[" + ref)))
    )


def _in_order(c1, c2) -> Column:
    """The first contig is not after the second one in natural order."""
    return contig_rank(c1) <= contig_rank(c2)


def _swap(d: DataFrame, only_bnd: bool = True) -> DataFrame:
    """Put the smaller contig first, reversing ends and strands."""
    sw = ~_in_order(F.col("chrom"), F.col("chr2"))
    if only_bnd:
        sw = sw & (F.col("svtype") == "BND")
    d = d.withColumn("_sw", sw)
    pick = lambda a, b: F.when(F.col("_sw"), F.col(b)).otherwise(F.col(a))
    return d.select(
        *[c for c in d.columns if c not in ("chrom", "chr2", "pos", "stop", "strands", "_sw")],
        pick("chrom", "chr2").alias("chrom"), pick("chr2", "chrom").alias("chr2"), pick("pos", "stop").alias("pos"), pick("stop", "pos").alias("stop"),
        F.when(F.col("_sw"), F.reverse("strands")).otherwise(F.col("strands")).alias("strands"),
    )


def _span() -> Column:
    return F.when(F.col("chrom") == F.col("chr2"), F.col("stop") - F.col("pos")).otherwise(F.lit(-1)).cast("long")


@caller("delly")
def _delly(d: DataFrame) -> DataFrame:
    sv = F.when(F.col("svtype") == "TRA", "BND").otherwise(F.col("svtype"))
    # fixed values: connection types and their strands
    ct = F.create_map(*[F.lit(x) for kv in {"5to3": "-+", "3to3": "++", "5to5": "--", "3to5": "+-"}.items() for x in kv])
    d = d.withColumn("svtype", sv).withColumn("strands", F.when((F.col("ct") == "NtoN") & (F.col("svtype") == "INS"), "+-").otherwise(F.try_element_at(ct, F.col("ct"))))
    d = d.withColumn("chr2", F.when(F.col("svtype") == "BND", F.col("chr2")).otherwise(F.col("chrom")))
    d = _swap(d).withColumn("svlen", _span())
    return d.withColumn("alt", F.concat(F.lit("<"), F.col("svtype"), F.lit(">")))


@caller("manta")
def _manta(d: DataFrame) -> DataFrame:
    # of two mates only the first in file order stays
    pair = F.when(F.col("mate_id").isNotNull(), F.concat_ws("|", F.least("vid", "mate_id"), F.greatest("vid", "mate_id"))).otherwise(F.col("vid"))
    w = Window.partitionBy("_pair").orderBy(contig_rank(F.col("chrom")), "pos", "vid")
    d = d.withColumn("_pair", pair).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_pair", "_r")
    mc, mp, ms = parse_mate("alt")
    bnd, ins = F.col("svtype") == "BND", F.col("svtype") == "INS"
    d = d.withColumn("chr2", F.when(bnd, mc).otherwise(F.col("chrom"))).withColumn("stop", F.when(bnd, mp).when(ins, F.col("pos") + 1).otherwise(F.col("stop")))
    # after the swap of contigs the strands need no reversal: they are read from the ALT itself
    st = F.when(F.col("svtype") == "INV", F.when(F.col("inv3"), "++").otherwise("--")).when(bnd, ms).when(F.col("svtype") == "DUP", "-+").otherwise("+-")
    d = d.withColumn("_st", st).withColumn("strands", F.lit("+-"))
    d = _swap(d).withColumn("strands", F.col("_st")).drop("_st")
    d = d.withColumn("svlen", F.when(F.col("svtype") == "INS", F.coalesce("svlen", F.lit(-1)).cast("long")).otherwise(_span()))
    return d.withColumn("vid", F.regexp_replace("vid", ":", "_")).withColumn("alt", F.concat(F.lit("<"), F.col("svtype"), F.lit(">")))


def _letters(i) -> Column:
    """a to z for the first 26 entries, then the number after a z."""
    return F.when(i < 26, F.char(i + 97)).otherwise(F.concat(F.lit("z"), i.cast("string")))


def _lumpy_like(d: DataFrame) -> DataFrame:
    d = d.select("*", F.posexplode("strand_list").alias("_i", "_s"))
    mc, mp, _ = parse_mate("alt")
    bnd = F.col("svtype") == "BND"
    d = d.withColumn("strands", F.element_at(F.split("_s", ":"), 1)).withColumn("chr2", F.when(bnd, mc).otherwise(F.col("chrom"))).withColumn("stop", F.when(bnd, mp).otherwise(F.col("stop")))
    d = _swap(d).withColumn("svlen", _span())
    cis = bnd & (F.col("chrom") == F.col("chr2"))
    d = d.withColumn("svtype", F.when(cis, F.when(F.col("strands") == "+-", "DEL").when(F.col("strands") == "-+", "DUP").otherwise("INV")).otherwise(F.col("svtype")))
    sv, st = F.col("svtype"), F.col("strands")
    ok = ~((sv == "DEL") & (st != "+-")) & ~((sv == "DUP") & (st != "-+")) & ~((sv == "INV") & ~st.isin("++", "--"))
    d = d.where(ok).withColumn("vid", F.concat("vid", _letters(F.col("_i"))))
    return d.withColumn("alt", F.concat(F.lit("<"), F.col("svtype"), F.lit(">"))).drop("_i", "_s")


CALLERS["lumpy"] = _lumpy_like
CALLERS["smoove"] = _lumpy_like


@caller("melt")
def _melt(d: DataFrame) -> DataFrame:
    return d.withColumns({"svtype": F.lit("INS"), "stop": F.col("pos") + 1, "strands": F.lit("+-"), "chr2": F.col("chrom")})


@caller("wham")
def _wham(d: DataFrame) -> DataFrame:
    st = F.when(F.col("svtype") == "DEL", "+-").when(F.col("svtype") == "DUP", "-+").otherwise(".")
    vid = F.regexp_replace(F.regexp_replace(F.coalesce("vid", F.lit("SV")), ":", "_"), ",", ";")
    return d.withColumns({"vid": vid, "strands": st, "chr2": F.col("chrom"), "svlen": F.abs("svlen")})


def called_expression(name: str) -> Column:
    """Whether a sample carries a raw record: read support, a het genotype, a tag list or the genotype itself."""
    if name == "lumpy":
        return F.col("su") >= 4
    if name == "smoove":
        return (F.col("a1") == 0) & (F.col("a2") == 1)
    if name == "wham":
        return F.array_contains("tags", F.col("sample"))
    return (F.coalesce("a1", F.lit(0)) > 0) | (F.coalesce("a2", F.lit(0)) > 0)


def copy_genotypes(g: DataFrame, call_null_sites: bool = False) -> DataFrame:
    """Genotypes as they are, ./. becoming 0/1 on request, plus a support flag."""
    null = F.col("a1").isNull() & F.col("a2").isNull()
    if call_null_sites:
        g = g.withColumns({"a1": F.when(null, 0).otherwise(F.col("a1")), "a2": F.when(null, 1).otherwise(F.col("a2"))})
    return g.withColumn("support", F.when((F.coalesce("a1", F.lit(0)) > 0) | (F.coalesce("a2", F.lit(0)) > 0), 1).otherwise(0))


def standardize(raw: DataFrame, name: str, contigs: list[str], min_size: int = 50, called: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """Standard records of one caller: listed contigs, no secondary records, stranded, sized, called, numbered."""
    mc, _, _ = parse_mate("alt")
    bnd = F.col("alt").rlike(r"[\[\]]")
    d = raw.where(F.col("chrom").isin(contigs) & ~F.col("secondary") & (~bnd | mc.isin(contigs)))
    if "chr2" in raw.columns:
        d = d.where(F.col("chr2").isNull() | F.col("chr2").isin(contigs))
    d = d.withColumn("pos", F.greatest("pos", F.lit(1)))
    if called is not None:
        d = d.join(called.select("vid").distinct(), "vid", "left_semi")
    d = CALLERS[name](d).withColumn("algorithms", F.lit(name))
    keep = ~((F.col("svlen") > 0) & (F.col("svlen") < min_size)) & ~((F.col("svtype") == "INS") & (F.col("svlen") == -1)) & F.col("strands").isin("++", "+-", "-+", "--")
    d = d.where(keep)
    d = d.withColumn("alt", F.when(F.col("svtype") == "BND", make_mate_alt(F.col("chr2"), F.col("stop"), F.col("strands"))).otherwise(F.col("alt"))).select(*STANDARD)
    if prefix is None:
        return d
    from ..operators.numbering import number_rows

    n = number_rows(d.withColumn("_c", contig_rank(F.col("chrom"))).withColumn("_g", F.lit(1)), ["_g"], ["_c", "pos", "stop", "vid"], "_n")
    return n.withColumn("vid", F.concat_ws("_", F.lit(prefix), F.col("_n").cast("string"))).drop("_c", "_g", "_n")
