"""The three entry points: files to a feature table, correlations to a ranking, units to models and metrics.

All tables stay long (unit, sample, feature, value) until a result is shown;
stages hand over named Parquet tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stratawell.config import Settings
from stratawell.functions.safe_math import padded_dispersion
from stratawell.functions.text import piece, strip_version
from stratawell.operators import events as ev, modelling as md, ranges, relational as rel, reshape, stats
from stratawell.operators.ordered import with_totals
from stratawell.plans import global_models as gm

ASSAYS, EXPERIMENTS = 3, 8


def complete_samples(metadata: DataFrame, id_col: str, needed: list[list[str]]) -> DataFrame:
    """Ids of samples that, of each group of alternative columns, fill at least one."""
    filled = [F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in group]), lambda x: x != "") for group in needed]
    keep = filled[0]
    for f in filled[1:]:
        keep = keep & f
    return metadata.filter(keep).select(id_col).distinct()


def file_table(metadata: DataFrame, id_col: str, prefix: str, samples: DataFrame) -> DataFrame:
    """A row per sample and experiment: assay and type from the column name (prefix_ASSAY_TYPE), id as uuid."""
    columns = [c for c in metadata.columns if c.startswith(prefix + "_")]
    long = metadata.unpivot([id_col], [F.col(f"`{c}`") for c in columns], "column", "uuid").filter("uuid IS NOT NULL AND uuid <> ''")
    name = F.substring("column", F.lit(len(prefix) + 2), F.length("column"))
    long = long.select(id_col, piece(name, "_", 1).alias("assay_type"), piece(name, "_", 2).alias("experiment_type"), "uuid")
    return rel.is_in(long, id_col, samples)


def incomplete(files: DataFrame, id_col: str, assays: int = ASSAYS, experiments: int = EXPERIMENTS) -> DataFrame:
    """Samples that break the rule of so many assays and experiments; it has to be empty."""
    n = files.groupBy(id_col).agg(F.countDistinct("assay_type").alias("assays"), F.countDistinct("experiment_type").alias("experiments"))
    return n.filter((F.col("assays") != assays) | (F.col("experiments") != experiments))


def renormalised(abundance: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Transcripts per million from expected_count and effective_length, over the annotated transcripts of a sample."""
    a = rel.is_in(abundance, "transcript_id", transcripts)
    a = a.withColumn("rate", F.when(F.col("effective_length") > 0, F.col("expected_count") / F.col("effective_length")).otherwise(0.0))
    a = with_totals(a, ["sample_id"], __all=F.sum("rate"))
    return a.withColumn("tpm", F.coalesce(F.try_divide(F.col("rate") * 1e6, "__all"), F.lit(0.0))).drop("rate", "__all")


def analysed_events(ids: DataFrame, allowed: DataFrame | None, settings: Settings, width: int = 10_000, sex: tuple[str, ...] = ("chrX", "chrY")) -> DataFrame:
    """Parsed events of one gene, off the sex chromosomes, that overlap no other event, and those of the allow-list."""
    e = ev.parsed(ids).filter(F.col("event_type").isin(*settings.event_types))
    spans = e.select("id", "seqnames", "strand", F.col("all_start").alias("start"), F.col("all_end").alias("end"))
    own = ranges.only_own_hit(spans, spans, ["seqnames", "strand"], "id", width)
    kept = rel.is_in(e.filter(F.col("single_gene") & ~F.col("seqnames").isin(*sex)), "id", own)
    return kept.unionByName(rel.not_in(rel.is_in(e, "id", allowed), "id", kept.select("id"))) if allowed is not None else kept


def variability(psi: DataFrame, events: DataFrame) -> DataFrame:
    """event_id with its padded dispersion over all samples and Low or High against its type's median."""
    n = psi.select("sample_id").distinct().agg(F.count("*").alias("n_samples"))
    d = psi.crossJoin(F.broadcast(n)).groupBy("event_id").agg(padded_dispersion(F.col("psi"), F.first("n_samples")).alias("dispersion"))  # one row broadcast
    d = d.join(events.select("event_id", "event_type"), "event_id")
    d = with_totals(d, ["event_type"], __middle=F.median("dispersion"))
    return d.withColumn("variability", F.when(F.col("dispersion") < F.col("__middle"), "Low").otherwise("High")).drop("__middle")


def point_means(points: DataFrame, regions: DataFrame, keys: list[str], width: int = 1000) -> DataFrame:
    """name, sample_id and the mean score of a region's points (at, sample_id, score)."""
    return ranges.points_in(points, regions, keys, "at", width).groupBy("name", "sample_id").agg(F.avg("score").alias("score"))


def feature_table(signals: dict[str, DataFrame], intrinsic: DataFrame, expression: DataFrame) -> DataFrame:
    """Long features of (id, sample_id): signals(name, sample_id, score) by assay and region, intrinsic(id, feature, value), log2 expression."""
    parts = []
    for assay, df in signals.items():
        region, id_ = ev.region_of(F.col("name"))
        parts.append(df.select(id_.alias("id"), "sample_id", F.concat_ws(";", F.lit(assay), region).alias("feature"), F.col("score").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pairs = out.select("id", "sample_id").distinct()
    fixed = pairs.join(intrinsic, "id").select("id", "sample_id", "feature", "value")
    return out.unionByName(fixed).unionByName(expression.select("id", "sample_id", F.lit("gene_expression").alias("feature"), F.log2(F.greatest(F.col("tpm") + 1, F.lit(1.0))).alias("value")))


def gene_expression(abundance: DataFrame, genes: DataFrame) -> DataFrame:
    """Summed abundance of each event's gene: genes(id, gene_id), versions aside."""
    total = abundance.groupBy(strip_version(F.col("gene_id")).alias("gene"), "sample_id").agg(F.sum("tpm").alias("tpm"))
    return genes.select("id", strip_version(F.col("gene_id")).alias("gene")).join(total, "gene").select("id", "sample_id", "tpm")


def correlation_ranking(features: DataFrame, response: DataFrame, groups: DataFrame, settings: Settings, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Correlations of each feature with psi over samples, by event type, variability and all; and the top features by |median|.

    features(id, sample_id, feature, value), response(id, sample_id, psi), groups(id, event_type, variability).
    """
    whole = features.join(response, ["id", "sample_id"]).join(groups, "id")
    r = stats.two_level_correlations(whole, ["event_type", "sample_id"], "variability", "psi", settings.minimum_events)
    m = r.groupBy("event_type", "variability", "feature").agg(F.median("r").alias("middle"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.bool_or(F.abs("r") > 0.1).alias("strong"))
    top = rel.top_by(m, ["event_type", "variability"], [F.abs("middle").desc_nulls_last(), F.col("feature")], n)
    return r, top


def configurations(event_types: tuple[str, ...], feature_sets: tuple[str, ...] = ("all", "non_epigenetic", "epigenetic"), row_filters: tuple[str, ...] = ("all", "Low", "High")) -> list[tuple[str, str, str]]:
    """Event type, row filter and feature set of each global model."""
    return [(e, r, f) for e in event_types for r in row_filters for f in feature_sets]


def unit_models(wide: DataFrame, unit: str, features: list[str], response: str, key: str, settings: Settings, donors: DataFrame | None = None, free: str | None = "gene_expression") -> DataFrame:
    """Fits of each unit, and with donors(unit, donor, rotation) also of its rotated controls, whose response is another unit's."""
    grid = list(settings.lambda_grid)
    real = md.unit_fits(wide, unit, features, response, free, key, grid, settings.event_folds, settings.seed)
    if donors is None:
        return real
    other = wide.select(F.col(unit).alias("donor"), key, F.col(response).alias("__r"))
    turned = wide.drop(response).join(donors, unit).join(other, ["donor", key]).withColumnRenamed("__r", response)
    turned = turned.withColumn(unit, F.concat_ws("#", F.col(unit).cast("string"), F.col("rotation").cast("string")))
    return real.unionByName(md.unit_fits(turned, unit, features, response, free, key, grid, settings.event_folds, settings.seed, rotated=True))


def run_configurations(df: DataFrame, events: DataFrame, families: dict[str, list[str]], settings: Settings, key: str, group: str, response: str, first: tuple[str, list], second: tuple[str, list], **options) -> dict[str, DataFrame]:
    """The tables of global_models.run_global for every configuration, with event_type, row_filter and feature_set; and a status each.

    events(group, event_type, variability) says which rows a configuration takes, families which features.  A
    configuration without usable features or classes tells so in "status", the others go on.
    """
    whole, tables, status = df.join(events, group), {}, []
    for event_type, row_filter, feature_set in configurations(settings.event_types, tuple(families)):
        rows = whole.filter(F.col("event_type") == event_type)
        rows = rows if row_filter == "all" else rows.filter(F.col("variability") == row_filter)
        name = dict(event_type=event_type, row_filter=row_filter, feature_set=feature_set)
        try:
            got = gm.run_global(rows, key, group, families[feature_set], response, first, second, settings, **options)
        except ValueError as e:
            status.append((*name.values(), str(e)))
            continue
        status.append((*name.values(), "ok"))
        for k, v in got.items():
            tables.setdefault(k, []).append(v.withColumns({c: F.lit(x) for c, x in name.items()}))
    out = {k: reduce(lambda a, b: a.unionByName(b), v) for k, v in tables.items()}
    return out | {"status": df.sparkSession.createDataFrame(status, "event_type string, row_filter string, feature_set string, status string")}


def refitted(wide: DataFrame, fits: DataFrame, unit: str, features: list[str], response: str, key: str, settings: Settings, free: str | None = "gene_expression") -> DataFrame:
    """Fits of each unit once more, without the features that its rotated controls select; units left without a feature say so."""
    kept = without_trans_features(fits).groupBy("unit").agg(F.sort_array(F.collect_list("feature")).alias("__only"))  # at most the features
    rows = wide.join(kept.select(F.col("unit").alias("__u"), "__only"), F.col(unit).cast("string") == F.col("__u"), "left").drop("__u")
    rows = rows.withColumn("__only", F.coalesce("__only", F.array().cast("array<string>")))
    return md.unit_fits(rows, unit, features, response, free, key, list(settings.lambda_grid), settings.event_folds, settings.seed, only="__only")


def without_trans_features(fits: DataFrame) -> DataFrame:
    """unit and feature pairs to fit again: those that no rotated control of the unit selects."""
    base = F.element_at(F.split("unit", "#"), 1)
    picked = fits.filter("rotated AND arm = 'real' AND coefficient <> 0").select(base.alias("unit"), "feature").distinct()
    own = fits.filter("NOT rotated AND arm = 'real'").select("unit", "feature").distinct()
    return own.join(picked, ["unit", "feature"], "left_anti")


def wide_units(features: DataFrame, response: DataFrame, names: list[str]) -> DataFrame:
    """A row per (id, sample_id) with the named features and psi."""
    return reshape.to_wide(features, ["id", "sample_id"], "feature", "value", names).join(response, ["id", "sample_id"])
