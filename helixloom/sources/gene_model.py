"""Gene model files: GTF lines to typed rows, element tables and transcript choice, all in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import merge_intervals, overlap_join

FIELDS = ["chrom", "source", "feature", "start", "stop", "score", "strand", "frame"]
_PAIR = r'\s*([A-Za-z0-9_]+)\s+(?:"([^"]*)"|([^";\s]+))\s*(?:;|$)'


def parse_gtf(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row per record: FIELDS with half-open coordinates, ``attributes`` (first value of each key) and ``tags`` (all values of
    ``tag``). Comments and lines without nine fields are left out; extra columns of ``lines`` are kept unless their names clash."""
    f = F.split(F.col(line), "\t", 9)
    keep = [c for c in lines.columns if c != line and c not in (*FIELDS, "attributes", "tags")]
    d = lines.where(~F.col(line).startswith("#")).select(*keep, f.alias("_f")).where(F.size("_f") == 9)
    key = F.regexp_extract_all(F.get("_f", F.lit(8)), F.lit(_PAIR), 1)
    text = F.zip_with(F.regexp_extract_all(F.get("_f", F.lit(8)), F.lit(_PAIR), 2), F.regexp_extract_all(F.get("_f", F.lit(8)), F.lit(_PAIR), 3), lambda a, b: F.when(a != "", a).otherwise(b))
    d = d.withColumns({"_k": key, "_v": text})
    pairs = F.zip_with("_k", "_v", lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    first = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.create_map(p["key"], p["value"]))))
    typed = [F.try_to_number(F.get("_f", F.lit(i)), F.lit("999999999999")).cast("long") for i in (3, 4)]
    out = d.select(*keep, *[F.when(F.get("_f", F.lit(i)) != ".", F.get("_f", F.lit(i))).alias(n) for i, n in enumerate(FIELDS) if n not in ("start", "stop")], (typed[0] - 1).alias("start"), typed[1].alias("stop"),
                   first.alias("attributes"), F.transform(F.filter(pairs, lambda p: p["key"] == "tag"), lambda p: p["value"]).alias("tags"))
    return out.where("start IS NOT NULL AND stop IS NOT NULL").select(*keep, *FIELDS, "attributes", "tags")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def format_gtf(rows: DataFrame) -> DataFrame:
    """Lines that ``parse_gtf`` reads back to the same rows: attributes in key order, then the tags."""
    entries = F.array_sort(F.filter(F.map_entries("attributes"), lambda e: e["key"] != "tag"))
    one = lambda k, v: F.concat(k, F.lit(' "'), v, F.lit('";'))
    text = F.concat(F.transform(entries, lambda e: one(e["key"], e["value"])), F.transform("tags", lambda t: one(F.lit("tag"), t)))
    cells = [(F.col("start") + 1).cast("string") if n == "start" else F.coalesce(F.col(n).cast("string"), F.lit(".")) for n in FIELDS]
    return rows.select(F.concat_ws("\t", *cells, F.array_join(text, " ")).alias("value"))


def write_gtf(rows: DataFrame, path: str) -> None:
    format_gtf(rows).write.text(path)


def transcripts(gtf: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Transcripts of protein-coding genes: gene, transcript, kind, seq_len, ccds, and translation_len, tx_len, source from ``lengths``
    (transcript, translation_len, tx_len, source)."""
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    t = gtf.where((F.col("feature") == "transcript") & (a("gene_type") == "protein_coding")).select(
        a("gene_id").alias("gene"), a("transcript_id").alias("transcript"), a("transcript_type").alias("kind"), (F.col("stop") - F.col("start")).alias("seq_len"),
        F.exists("tags", lambda x: x.contains("CCDS")).alias("ccds"))
    if lengths is None:
        return t.withColumns({"translation_len": F.lit(None).cast("long"), "tx_len": F.lit(None).cast("long"), "tx_source": F.lit(None).cast("string")})
    return t.join(lengths.select("transcript", "translation_len", "tx_len", F.col("source").alias("tx_source")), "transcript", "left")


def choose_canonical(tx: DataFrame) -> DataFrame:
    """One transcript per gene. Coding ones first: those of the consensus set, then models merged from two sources, then projected ones, then any, by
    translation and transcript length; a gene without a coding transcript takes its longest. Ties go to the lesser id."""
    coding = F.coalesce(F.col("kind") == "protein_coding", F.lit(False))
    rank = F.when(~coding, 4).when(F.col("ccds"), 0).when(F.col("tx_source") == "ensembl_havana_transcript", 1).when(F.col("tx_source") == "proj_ensembl_havana_transcript", 2).otherwise(3)
    size = F.when(coding, F.coalesce("translation_len", F.lit(-1))).otherwise(F.col("seq_len"))
    w = Window.partitionBy("gene").orderBy("_rank", F.desc("_size"), F.desc(F.coalesce("tx_len", F.lit(-1))), "transcript")
    return tx.withColumns({"_rank": rank, "_size": size}).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_rank", "_size")


def canonical_rows(gtf: DataFrame, canonical: DataFrame) -> DataFrame:
    """The records of the canonical transcripts, and of their genes."""
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    tx = gtf.join(canonical.select(F.col("transcript").alias("_t")), a("transcript_id") == F.col("_t"), "left_semi")
    genes = gtf.where("feature = 'gene'").join(canonical.select(F.col("gene").alias("_g")), a("gene_id") == F.col("_g"), "left_semi")
    return tx.where("feature <> 'gene'").unionByName(genes)


def trim_exons(gtf: DataFrame) -> DataFrame:
    """Exons without the untranslated sequence of their gene; what is left of one may be several pieces or nothing. Other records stay.

    The untranslated parts of a gene are merged first, so the pieces are the gaps between neighbours within an exon.
    """
    gene = F.try_element_at("attributes", F.lit("gene_id"))
    exons = gtf.where("feature = 'exon'").withColumn("_gene", F.coalesce(gene, F.lit(""))).withColumn("_id", F.xxhash64("_gene", "chrom", "start", "stop", "strand", "source", F.to_json("attributes"), F.to_json("tags")))
    utr = gtf.where("feature = 'UTR'").select(F.coalesce(gene, F.lit("")).alias("_gene"), "chrom", "start", "stop")
    utr = merge_intervals(utr, by=["_gene", "chrom"])
    places = exons.select("_gene", "chrom", "start", "stop").distinct()
    hit = overlap_join(places, utr, by=["_gene", "chrom"]).groupBy(*[F.col(c + "_a").alias(c) for c in ("_gene", "chrom", "start", "stop")]).agg(F.array_sort(F.collect_list(F.struct(F.col("start_b").alias("s"), F.col("stop_b").alias("e")))).alias("_u"))
    d = exons.join(hit, ["_gene", "chrom", "start", "stop"], "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    cuts = F.concat(F.array(F.struct(F.lit(-1).cast("long").alias("s"), F.col("start").alias("e"))), F.coalesce("_u", none), F.array(F.struct(F.col("stop").alias("s"), F.lit(-1).cast("long").alias("e"))))
    gaps = F.transform(F.sequence(F.lit(0), F.size("_c") - 2), lambda i: F.struct(F.greatest(F.get("_c", i)["e"], F.col("start")).alias("s"), F.least(F.get("_c", i + 1)["s"], F.col("stop")).alias("e")))
    d = d.withColumn("_c", cuts).withColumn("_p", F.explode(F.filter(gaps, lambda g: g["e"] > g["s"])))
    kept = d.withColumns({"start": F.col("_p.s"), "stop": F.col("_p.e")}).select(*gtf.columns)
    return gtf.where("feature <> 'exon'").unionByName(kept)


def gene_elements(gtf: DataFrame) -> DataFrame:
    """(chrom, start, stop, element, gene, strand): the rows that the annotation operators take."""
    return gtf.where("feature IN ('gene', 'transcript', 'CDS', 'UTR', 'exon')").select("chrom", "start", "stop", F.col("feature").alias("element"), F.coalesce(F.try_element_at("attributes", F.lit("gene_name")), F.try_element_at("attributes", F.lit("gene_id"))).alias("gene"), "strand")
