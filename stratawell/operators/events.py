"""Splicing-event ids and the regions they name.

An id is GENE;TYPE:CHROMOSOME:COORDINATES:STRAND.  A gene name with "_" names
several genes.  Types: SE and RI give event, upstream, downstream and whole
regions, the others the whole region only; an unknown type raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratawell.functions.safe_math import safe_log2
from stratawell.functions.text import piece
from stratawell.operators.ranges import overlap_join

TYPES = ("SE", "RI", "AF", "AL", "A3", "A5", "MX")


def parsed(df: DataFrame, column: str = "event_id", whole_upstream_of_ri: bool = True) -> DataFrame:
    """df with gene_id, event_type, seqnames, strand and start/end of the regions all, event, upstream, downstream.

    whole_upstream_of_ri: on the plus strand the upstream region of a retained intron reaches to the end of the
    event, as the established analysis has it; False gives the exon before the intron.
    """
    x = F.col(column)
    body = piece(x, ";", 2)
    kind = piece(body, ":", 1)
    strand = F.element_at(F.split(body, ":"), -1)
    places = F.transform(F.filter(F.split(F.regexp_replace(body, r"^[^:]*:[^:]*:|:[^:]*$", ""), "[:-]"), lambda s: s != ""), lambda s: s.try_cast("long"))
    df = df.withColumns({"gene_id": piece(x, ";", 1), "event_type": kind, "seqnames": piece(body, ":", 2), "strand": strand, "__p": places})
    p = lambda i: F.try_element_at("__p", F.lit(i))
    last = F.element_at("__p", -1)
    plus, t = F.col("strand") == "+", F.col("event_type")

    def by(cases: dict[str, Column]) -> Column:
        out = None
        for k, v in cases.items():
            on = t.isin(*k.split())
            out = F.when(on, v) if out is None else out.when(on, v)
        return out

    # SE: e1-s2:e2-s3.  RI: s1:e1-s2:e2.  A3/A5: e1-s2:e1-s3.  MX: e1-s2:e2-s4:e1-s3:e3-s4.
    # AF: by strand, exon:intron-next:exon:intron-next; AL the mirror image.
    all_start = by({"SE RI": p(1), "A3 A5": p(1) + 1, "MX": p(1) + 1, "AF AL": F.when(plus == (t == "AF"), p(1)).otherwise(p(1) + 1)})
    all_end = by({"SE RI": last, "A3 A5": last - 1, "MX": last - 1, "AF AL": F.when(plus == (t == "AF"), last - 1).otherwise(last)})
    left = by({"SE": p(1) + 1, "RI": p(1)}), by({"SE": p(2) - 1, "RI": p(2)})
    right = by({"SE": p(3) + 1, "RI": p(3)}), by({"SE": p(4) - 1, "RI": p(4)})
    up_end = F.when((t == "RI") & plus & F.lit(whole_upstream_of_ri), p(4)).otherwise(F.when(plus, left[1]).otherwise(right[1]))
    known = F.when(t.isin(*TYPES), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce(t, F.lit("none")))).cast("boolean"))
    return df.withColumns({
        "all_start": F.when(known, all_start), "all_end": all_end,
        "event_start": by({"SE": p(2), "RI": p(2) + 1}), "event_end": by({"SE": p(3), "RI": p(3) - 1}),
        "upstream_start": F.when(plus, left[0]).otherwise(right[0]), "upstream_end": up_end,
        "downstream_start": F.when(plus, right[0]).otherwise(left[0]), "downstream_end": F.when(plus, right[1]).otherwise(left[1]),
        "single_gene": ~F.col("gene_id").contains("_"),
    }).drop("__p")


def regions(events: DataFrame) -> DataFrame:
    """id, region, seqnames, start, end and strand rows of parsed events(id): event, up_ and down_ prefixed names."""
    parts = F.array(*[F.struct(F.concat(F.lit(p), F.col("id").cast("string")).alias("name"), F.col(f"{r}_start").alias("start"), F.col(f"{r}_end").alias("end")) for p, r in (("", "event"), ("up_", "upstream"), ("down_", "downstream"))])
    return events.select("id", "seqnames", "strand", F.explode(parts).alias("r")).select("id", "r.name", "seqnames", "r.start", "r.end", "strand").filter("start IS NOT NULL")


def end_distances(df: DataFrame) -> DataFrame:
    """df(strand, start, end, gene_start, gene_end) with distance_tss and distance_tes: log2 of the places to the gene's ends along the strand."""
    before, after = safe_log2((F.col("start") - F.col("gene_start")).cast("double")), safe_log2((F.col("gene_end") - F.col("end")).cast("double"))
    minus = F.col("strand") == "-"
    return df.withColumns({"distance_tss": F.when(minus, after).otherwise(before), "distance_tes": F.when(minus, before).otherwise(after)})


def with_nearby_states(regions_: DataFrame, states: DataFrame, vicinity: int, width: int) -> DataFrame:
    """name, seqnames, start and end of regions and of the named states within vicinity places of an event region, each once.

    The event regions are those whose name is a number (no up_ or down_ before it).
    """
    columns = ["name", "seqnames", "start", "end"]
    own = regions_.filter(~F.col("name").contains("_")).select(*columns)
    near = overlap_join(own, states.select(*columns), ["seqnames"], width, gap=vicinity)
    near = near.select(F.col("name_2").alias("name"), "seqnames", F.col("start_2").alias("start"), F.col("end_2").alias("end")).distinct()
    return regions_.select(*columns).unionByName(near)


def region_of(name: Column) -> tuple[Column, Column]:
    """Region and id of a name: up_7, down_7, 7."""
    head, tail = piece(name, "_", 1), piece(name, "_", 2)
    region = F.when(tail.isNull(), "event_name").when(head == "up", "upstream_other_region").when(head == "down", "downstream_other_region").otherwise(head)
    return region, F.coalesce(tail, head).try_cast("int")


def psi(members: DataFrame, abundance: DataFrame, minimum_total: float = 0.0) -> DataFrame:
    """event_id, sample_id and psi: the share of alternative in all transcripts' abundance.

    members: event_id, alternative and total transcript lists; abundance: sample_id, transcript_id, tpm.
    """
    flat = members.select("event_id", "alternative", F.explode("total").alias("transcript_id")).withColumn("alt", F.array_contains("alternative", F.col("transcript_id")))
    both = flat.join(abundance, "transcript_id").groupBy("event_id", "sample_id").agg(F.sum(F.when(F.col("alt"), F.col("tpm")).otherwise(0.0)).alias("part"), F.sum("tpm").alias("total"))
    return both.select("event_id", "sample_id", F.when(F.col("total") > minimum_total, F.try_divide("part", "total")).alias("psi"))
