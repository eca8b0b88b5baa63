"""Rendering placements as SAM text, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.seeds import approximate_mapq, cigar, cigar_spans, reverse_complement, sam_flag

#: Fixed values of the format.
MANDATORY = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def named(reads: DataFrame) -> DataFrame:
    """Reads with a checked name: a null or empty one is an error."""
    return reads.withColumn("name", F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.raise_error(F.lit("a read needs a name")).cast("string")).otherwise(F.col("name")))


def sam_records(placements: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """A record for every placement, and an unmapped one for every read without: the eleven fields, ``tags``, and (read_id, fragment_index, alt_rank) to order by.

    ``reads(read_id, name, seq, qual)``, ``contigs(contig_id, name)``; a contig that isn't there
    is called ``*contig<id>``. Sequence and quality go with the primary record only. The SA tag
    lists all fragments of the read, itself included, in fragment order.
    """
    names = contigs.select(F.col("contig_id").alias("_c"), F.col("name").alias("_rname"))
    own = named(reads).select("read_id", F.col("name").alias("qname"), F.coalesce("seq", F.lit("")).alias("_seq"), F.col("qual").alias("_qual"))
    rows = own.join(placements, "read_id", "left").join(names, F.col("contig_id") == F.col("_c"), "left")
    mapped = F.col("contig_id").isNotNull()
    rname = F.coalesce("_rname", F.concat(F.lit("*contig"), F.col("contig_id").cast("string")))
    text = cigar(F.col("q_start"), F.col("q_end"), F.col("ref_start"), F.col("ref_end"), F.length("_seq"), F.col("is_secondary"))
    rows = rows.select(
        "*", rname.alias("_name"), text.alias("_cigar"), approximate_mapq(F.col("f1"), F.col("f2"), F.col("m")).alias("_mapq"),
    )
    part = F.concat("_name", F.lit(","), (F.col("ref_start") + 1).cast("string"), F.when(F.col("joint") == 1, ",-,").otherwise(",+,"), "_cigar", F.lit(","), F.col("_mapq").cast("string"), F.lit(",0;"))
    sa = (
        rows.where(mapped & ~F.col("is_secondary")).groupBy(F.col("read_id").alias("_r"))
        .agg(F.array_sort(F.collect_list(F.struct("fragment_index", part.alias("s")))).alias("_all")).where(F.size("_all") > 1)  # a read's fragments don't overlap, so they are few
        .select("_r", F.array_join(F.transform("_all", lambda x: x["s"]), "").alias("_sa"))
    )
    rows = rows.join(sa, F.col("read_id") == F.col("_r"), "left")
    primary = F.col("is_primary")
    whole = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "*").otherwise(c)

    def shown(forward: Column, backward: Column) -> Column:
        return F.when(~mapped, whole(forward)).when(primary & (F.col("joint") == 1), whole(backward)).when(primary, whole(forward)).otherwise("*")

    tags = F.concat_ws(
        "\t", F.when(~F.col("is_secondary"), F.concat(F.lit("SA:Z:"), F.col("_sa"))),
        F.concat(F.lit("AS:i:"), F.floor(F.col("score") + 0.5).cast("string")), F.concat(F.lit("nm:i:"), F.col("unique_anchors").cast("string")),
    )
    return rows.select(
        "read_id", F.coalesce("fragment_index", F.lit(0)).alias("fragment_index"), F.coalesce("alt_rank", F.lit(0)).alias("alt_rank"), "qname",
        F.when(mapped, sam_flag(F.col("joint"), F.col("is_supplementary"), F.col("is_secondary"))).otherwise(4).alias("flag"),
        F.when(mapped, F.col("_name")).otherwise("*").alias("rname"), F.when(mapped, F.col("ref_start") + 1).otherwise(0).cast("long").alias("pos"),
        F.when(mapped, F.col("_mapq")).otherwise(0).alias("mapq"), F.when(mapped, F.col("_cigar")).otherwise("*").alias("cigar"),
        F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"),
        shown(F.col("_seq"), reverse_complement(F.col("_seq"))).alias("seq"), shown(F.col("_qual"), F.reverse("_qual")).alias("qual"),
        F.when(mapped, tags).otherwise("").alias("tags"),
    )


def sam_lines(records: DataFrame) -> DataFrame:
    """(read_id, fragment_index, alt_rank, value): a text line per record."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in MANDATORY], F.when(F.col("tags") != "", F.col("tags")))
    return records.select("read_id", "fragment_index", "alt_rank", line.alias("value"))


def sam_header(contigs: DataFrame, program: str = "strandweave", version: str = "0.1") -> DataFrame:
    """(part, contig_id, value): format line, one line per contig, program line."""
    spark = contigs.sparkSession
    ends = spark.createDataFrame([(0, None, "@HD\tVN:1.6\tSO:unsorted"), (2, None, f"@PG\tID:{program}\tPN:{program}\tVN:{version}")], "part int, contig_id long, value string")
    body = contigs.select(F.lit(1).alias("part"), F.col("contig_id").cast("long").alias("contig_id"), F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    return ends.unionByName(body)


def parse_sam(lines: DataFrame, value: str = "value") -> DataFrame:
    """Alignment lines as columns: header and blank lines and those of under eleven fields go; spans come from the CIGAR."""
    f = F.split(F.col(value), "\t")
    rows = lines.where(~F.col(value).startswith("@") & (F.col(value) != "")).select(f.alias("f")).where(F.size("f") >= 11)
    g = lambda k: F.col("f")[k]
    rows = rows.select(g(0).alias("name"), g(1).cast("int").alias("flag"), g(2).alias("ref_name"), (g(3).cast("long") - 1).alias("pos0"), g(4).cast("int").alias("mapq"), g(5).alias("cigar"))
    start, end, span = cigar_spans(F.col("cigar"))
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    return rows.select("*", bit(16).alias("reverse"), bit(256).alias("secondary"), bit(2048).alias("supplementary"), (bit(4) | (F.col("ref_name") == "*")).alias("unmapped"), start.alias("q_start"), end.alias("q_end"), span.alias("ref_span"))


def sam_counters(parsed: DataFrame) -> DataFrame:
    """One row of a parsed SAM table: mapped and unmapped read names, supplementary and secondary records, all records."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    names = lambda c: F.count_distinct(F.when(c, F.col("name"))).alias
    lost = F.col("flag").bitwiseAND(F.lit(4)) != 0
    return parsed.agg(names(~lost)("mapped"), names(lost)("unmapped"), n(F.col("supplementary"))("supplementary"), n(F.col("secondary"))("secondary"), F.count(F.lit(1)).alias("records"))
