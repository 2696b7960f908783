"""VCF text as DataFrames: lines to sites and long genotypes, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: INFO keys that become columns
CORE_INFO = {"SVTYPE": "svtype", "CHR2": "chr2", "STRANDS": "strands", "ALGORITHMS": "algorithms", "EVIDENCE": "evidence", "CPX_TYPE": "cpx_type", "CPX_INTERVALS": "cpx_intervals", "MEMBERS": "members"}


def read_vcf(spark: SparkSession, path: str):
    """(sites, genotypes) of one or many VCF files of one cohort, plain or gzipped, or of a folder that ``write_vcf`` made."""
    return parse_vcf_lines(spark.read.option("recursiveFileLookup", "true").text(path).select("value"))


def sample_names(lines: DataFrame) -> DataFrame:
    """(_i, sample): the sample columns of the header line, numbered from 0."""
    columns = F.split("value", "\t")
    head = lines.where(F.col("value").startswith("#CHROM")).select(F.posexplode(F.slice(columns, 10, F.greatest(F.size(columns) - 9, F.lit(0)))).alias("_i", "sample"))
    return head.groupBy("_i").agg(F.min("sample").alias("sample"))  # the files of a cohort repeat their header


def _numbered(spark: SparkSession, samples: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(samples)), "_i int, sample string")


def parse_vcf_lines(lines: DataFrame, samples: list[str] | None = None):
    """Split record lines into a sites table and a long genotype table.

    The genotype table is a separate projection, so a sites-only query never explodes it. Sample names join by their column's number.
    """
    names = sample_names(lines) if samples is None else _numbered(lines.sparkSession, samples)
    f = F.split("value", "\t")
    # as a generator's output a line is made once, while a filter is pushed below the columns that make it and makes it for each mention
    made = lines.select(F.explode(F.array("value")).alias("value"))
    rec = made.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(f.alias("f"))
    # flags have no '=': give them a value so that the map keeps them
    info = F.str_to_map(F.regexp_replace(F.col("f")[7], r"(^|;)([^=;]+)(?=;|$)", "$1$2=true"), F.lit(";"), F.lit("="))
    d = rec.withColumn("info", info)
    get = lambda k: F.try_element_at("info", F.lit(k))
    pos = F.col("f")[1].cast("long")
    sites = d.select(
        F.col("f")[0].alias("chrom"), pos.alias("pos"), F.col("f")[2].alias("vid"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"),
        F.when(F.col("f")[5] != ".", F.col("f")[5]).cast("double").alias("qual"), F.regexp_replace(F.col("f")[6], ";", ",").alias("filter"),
        F.coalesce(get("END").cast("long"), pos).alias("stop"), get("SVLEN").cast("long").alias("svlen"), *[get(k).alias(c) for k, c in CORE_INFO.items()],
        F.map_filter("info", lambda k, v: ~k.isin("END", "SVLEN", *CORE_INFO)).alias("info"),
    )
    keys = F.split(F.col("f")[8], ":")
    g = d.where(F.size("f") > 9).select(F.col("f")[2].alias("vid"), keys.alias("_k"), F.posexplode(F.slice("f", F.lit(10), F.size("f") - 9)).alias("_i", "_v")).join(names, "_i")
    m = F.map_from_arrays(F.col("_k"), F.slice(F.concat(F.split("_v", ":"), F.transform("_k", lambda x: F.lit("."))), 1, F.size("_k")))
    g = g.withColumn("m", m)
    gt = F.split(F.regexp_replace(F.try_element_at("m", F.lit("GT")), r"\|", "/"), "/")
    num = lambda k: F.when(F.try_element_at("m", F.lit(k)) != ".", F.try_element_at("m", F.lit(k))).cast("int")
    al = lambda i: F.when(F.try_element_at(gt, F.lit(i)) != ".", F.try_element_at(gt, F.lit(i))).cast("int")
    return sites, g.select("vid", "sample", al(1).alias("a1"), al(2).alias("a2"), num("GQ").alias("gq"), num("RD_CN").alias("rd_cn"), num("PE_GT").alias("pe_gt"), num("SR_GT").alias("sr_gt"), F.try_element_at("m", F.lit("EV")).alias("ev"))


def to_vcf_lines(sites: DataFrame, genotypes: DataFrame | None = None, samples: list[str] = []) -> DataFrame:
    """(chrom, pos, value): one record line per site; missing genotypes print as ./. with null fields."""
    txt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    info = F.concat_ws(
        ";", F.concat(F.lit("END="), F.col("stop").cast("string")), F.concat(F.lit("SVTYPE="), F.col("svtype")), F.concat(F.lit("CHR2="), F.col("chr2")), F.concat(F.lit("STRANDS="), F.col("strands")),
        F.concat(F.lit("SVLEN="), F.col("svlen").cast("string")), F.concat(F.lit("ALGORITHMS="), F.col("algorithms")), F.concat(F.lit("EVIDENCE="), F.col("evidence")),
        F.concat(F.lit("CPX_TYPE="), F.col("cpx_type")), F.concat(F.lit("CPX_INTERVALS="), F.col("cpx_intervals")),
    )
    cols = [txt("chrom"), txt("pos"), txt("vid"), F.lit("N"), txt("alt"), txt("qual"), F.regexp_replace(txt("filter"), ",", ";"), info]
    d = sites
    if genotypes is not None:
        gt = F.concat_ws(":", F.concat_ws("/", txt("a1"), txt("a2")), txt("gq"), txt("rd_cn"))
        cell = F.struct("_i", F.lit(0).alias("late"), gt.alias("g"))
        g = genotypes.join(_numbered(sites.sparkSession, samples), "sample").groupBy("vid").agg(F.collect_list(cell).alias("_g"))
        d = sites.join(g, "vid", "left")
        # one sort puts a null cell behind each written one; the first of each column stays. Neighbours are zipped, as a lambda that names the sorted
        # array may sort it anew for every cell; sort_array compares natively, array_sort by an interpreted lambda
        cell_type = "array<struct<_i:int,late:int,g:string>>"
        nulls = F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda i: F.struct(i.alias("_i"), F.lit(1).alias("late"), F.lit("./.:.:.").alias("g"))) if samples else F.array().cast(cell_type)
        d = d.withColumn("_all", F.sort_array(F.concat(F.coalesce("_g", F.array().cast(cell_type)), nulls)))
        before = F.concat(F.array(F.lit(None)).cast(cell_type), F.col("_all"))  # one longer: its last cell meets a null
        cells = F.zip_with("_all", before, lambda x, y: F.when(F.coalesce(x["_i"] != y["_i"], x["_i"].isNotNull()), x["g"]))
        cols += [F.lit("GT:GQ:RD_CN"), F.array_join(cells, "\t")]
    return d.select("chrom", "pos", F.concat_ws("\t", *cols).alias("value"))


def header_lines(samples: list[str], contigs: list[str] = []) -> list[str]:
    base = ["##fileformat=VCFv4.2"] + [f"##contig=<ID={c}>" for c in contigs]
    return base + ["\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + (["FORMAT", *samples] if samples else []))]


def merge_headers(*headers: list[str]) -> list[str]:
    """Union of header lines in first-seen order; sample columns of the column lines are joined."""
    meta = list(dict.fromkeys(h for hs in headers for h in hs if h.startswith("##")))
    names = list(dict.fromkeys(s for hs in headers for h in hs if h.startswith("#CHROM") for s in h.split("\t")[9:]))
    return meta + header_lines(names)[-1:]


def write_vcf(lines: DataFrame, path: str, header: list[str]) -> None:
    """Record lines as text parts sorted by (contig, position), header in its own file."""
    spark = lines.sparkSession
    out = lines.repartitionByRange("chrom", "pos").sortWithinPartitions("pos")
    out.select("chrom", "value").write.mode("overwrite").partitionBy("chrom").text(f"{path}/records")
    spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_sites(sites: DataFrame, path: str) -> None:
    """Parquet form: partitioned by contig, sorted by position for row-group pruning."""
    sites.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.mode("overwrite").partitionBy("chrom").parquet(path)


def vcf_to_bed(sites, split_bnd: bool = True, split_cpx: bool = False, rename_ins: bool = True, simple_sinks: bool = False, sort_coords: bool = True, svtypes: list[str] | None = None, unresolved: bool = True) -> DataFrame:
    """0-based BED rows: breakends one or two 1-bp rows, complex variants one row per interval plus
    a 1-bp sink for insertion classes, others their (sorted) span."""
    d = sites if svtypes is None else sites.where(F.col("svtype").isin(svtypes))
    if not unresolved:
        d = d.where(~F.array_contains(F.split("filter", ","), "UNRESOLVED"))
    pos, stop, zero = F.col("pos"), F.col("stop"), F.lit(0).cast("long")
    row = lambda c, s, e, t: F.struct(c.alias("chrom"), F.greatest(zero, s).alias("start"), e.alias("stop"), t.alias("svtype"))
    ch, sv = F.col("chrom"), F.col("svtype")
    lo, hi = (F.least(pos, stop), F.greatest(pos, stop)) if sort_coords else (pos, stop)
    first = row(ch, pos - 1, pos, sv)
    mate = row(F.col("chr2"), stop - 1, stop, sv)
    ends = F.array(first, mate) if split_bnd else F.array(first)
    ins_t = F.lit("DEL") if rename_ins else sv
    ins = F.array(row(ch, pos, pos + 1, ins_t) if simple_sinks else row(ch, lo - 1, hi, ins_t))
    span = F.array(row(ch, lo - 1, F.when(F.greatest(zero, lo - 1) == hi, hi + 1).otherwise(hi) if sort_coords else hi, sv))
    out = F.when(sv.isin("BND", "CTX"), ends).when(sv == "INS", ins)
    if split_cpx:
        rx = r"^([^_]+)_([^:]+):(\d+)-(\d+)$"
        parts = F.transform(F.split("cpx_intervals", ","), lambda x: row(F.regexp_extract(x, rx, 2), F.regexp_extract(x, rx, 3).cast("long") - 1, F.regexp_extract(x, rx, 4).cast("long"), F.regexp_extract(x, rx, 1)))
        sink = F.when(F.col("cpx_type").isin("dDUP", "dDUP_iDEL", "INS_iDEL"), F.array(row(ch, pos - 1, pos, F.lit("DEL")))).otherwise(F.array().cast(span_type()))
        out = out.when(F.col("cpx_intervals").isNotNull(), F.concat(parts, sink))
    return d.select(F.col("vid").alias("name"), "strands", F.explode(out.otherwise(span)).alias("r")).select("r.*", "name", "strands")


def span_type() -> str:
    return "array<struct<chrom:string,start:bigint,stop:bigint,svtype:string>>"


def bed_to_sites(calls: DataFrame, samples: DataFrame):
    """Depth calls with sample lists -> (sites, carriers); calls without a known sample are dropped."""
    c = calls.withColumn("sample", F.explode(F.split("samples", ","))).join(samples.select("sample").distinct(), "sample", "left_semi")
    carriers = c.select(F.col("name").alias("vid"), "sample").distinct()
    s = calls.join(carriers.select(F.col("vid").alias("name")).distinct(), "name", "left_semi")
    strands = F.when(F.col("svtype") == "DEL", "+-").when(F.col("svtype") == "DUP", "-+")
    sites = s.select(F.col("name").alias("vid"), "chrom", F.greatest("start", F.lit(1)).alias("pos"), "stop", "svtype", F.col("chrom").alias("chr2"), strands.alias("strands"), (F.col("stop") - F.col("start")).alias("svlen"), F.lit("depth").alias("algorithms"))
    return sites, carriers


def calls_to_test_bed(calls: DataFrame) -> DataFrame:
    """One row per name with the sorted distinct sample list and the upper-case type."""
    return calls.groupBy("chrom", "start", "stop", "name", F.upper("svtype").alias("svtype")).agg(F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("samples"))


def check_sample_ids(ids: DataFrame, reserved=("chr", "name", "DEL", "DUP", "CPX", "CHROM")) -> DataFrame:
    """Problems per id: duplicate, bad characters, reserved token, contained in another id.

    Containment is an equi-join of every proper substring of an id with the id list, not a
    comparison of all pairs.
    """
    n = ids.groupBy("sample").agg(F.count("*").alias("_n"))
    ln = F.length("sample")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), ln), lambda i: F.transform(F.sequence(F.lit(1), ln - i + 1), lambda k: F.struct(i.alias("i"), k.alias("k")))))
    sub = n.select("sample", F.explode(cuts).alias("c")).where(F.col("c.k") < F.length("sample")).select(F.expr("substring(sample, c.i, c.k)").alias("sub"))
    inside = sub.distinct().join(n.select(F.col("sample").alias("sub")), "sub", "left_semi").select(F.col("sub").alias("sample"), F.lit(True).alias("_s"))
    d = n.join(inside, "sample", "left")
    low = F.lower("sample")
    res = F.lit(False)
    for tok in reserved:
        res = res | low.contains(tok.lower())
    return d.select("sample", (F.col("_n") > 1).alias("duplicate"), (~F.col("sample").rlike("^[A-Za-z0-9_]+$")).alias("bad_characters"), res.alias("reserved"), F.coalesce("_s", F.lit(False)).alias("is_substring"))


def replace_ids(wanted: DataFrame, mapping: DataFrame) -> DataFrame:
    """New id per header id; an id without a replacement fails the job."""
    d = wanted.join(mapping, "sample", "left")
    return d.select("sample", F.coalesce("new_id", F.raise_error(F.concat(F.lit("no replacement for "), F.col("sample"))).cast("string")).alias("new_id"))


def merge_evidence(frames: list[tuple[DataFrame, dict[str, str]]], regions: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """Union of evidence tables with per-file sample renames, restricted to regions, sorted by position."""
    out = None
    for df, rename in frames:
        m = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv]) if rename else None
        d = df if m is None else df.withColumn("sample", F.coalesce(F.try_element_at(m, F.col("sample")), F.col("sample")))
        out = d if out is None else out.unionByName(d)
    if regions is not None:
        from ..operators.intervals import point_in_regions

        out = point_in_regions(out, regions, pos)
    return out.repartitionByRange("chrom", pos).sortWithinPartitions("chrom", pos, "sample")
