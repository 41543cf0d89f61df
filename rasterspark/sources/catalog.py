"""Scans, input gates, sinks and archive checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.functions.scalar import close_to, reasons

STRUCTURAL = ("eGFP", "GFAP")
MEASUREMENT = ("KCNN1", "KCNN2", "KCNN3", "KCNJ10")

# One token pattern per channel, matched on the lower-case file stem.
CHANNEL_TOKENS = {
    "DAPI": "dapi",
    "eGFP": "e?gfp",
    "GFAP": "gfap",
    "KCNN1": "kcnn1|sk1",
    "KCNN2": "kcnn2|sk2",
    "KCNN3": "kcnn3|sk3",
    "KCNJ10": "kcnj10|kir4(?:[._ -]?1)?",
}
AGE_TOKENS = {"neonatal": "neonatal", "mature": "mature"}


def _token(stem: Column, pattern: str) -> Column:
    return F.lower(stem).rlike(f"(?:^|[^a-z0-9])(?:{pattern})(?:[^a-z0-9]|$)")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime")


def scan_channel_files(files: DataFrame) -> DataFrame:
    """Image files with their field (parent folder), stem and channel token.

    ``status`` is ``ok``, ``ignored`` (no token) or ``ambiguous`` (several).
    """
    tif = files.where(F.lower("path").rlike(r"\.tiff?$"))
    name = F.element_at(F.split("path", "/"), -1)
    out = tif.withColumns({
        "field_id": F.element_at(F.split("path", "/"), -2),
        "stem": F.regexp_replace(name, r"(?i)\.tiff?$", ""),
    })
    hits = F.array_compact(F.array(*[F.when(_token(F.col("stem"), p), F.lit(c)) for c, p in CHANNEL_TOKENS.items()]))
    return (
        out.withColumn("_hits", hits)
        .withColumn("channel", F.when(F.size("_hits") == 1, F.col("_hits")[0]))
        .withColumn("status", F.when(F.size("_hits") == 0, "ignored").when(F.size("_hits") > 1, "ambiguous").otherwise("ok"))
        .drop("_hits")
    )


def field_channels(scanned: DataFrame) -> DataFrame:
    """Input gates per field: counts per channel and ordered refusal reasons."""
    count = lambda c: F.count_if((F.col("status") == "ok") & (F.col("channel") == c))
    g = scanned.groupBy("field_id").agg(
        F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous"),
        F.count_if(F.col("status") == "ignored").alias("n_ignored"),
        *[count(c).alias(f"n_{c}") for c in CHANNEL_TOKENS],
    )
    most = F.greatest(*[F.col(f"n_{c}") for c in CHANNEL_TOKENS])
    kinds = sum((F.when(F.col(f"n_{c}") > 0, 1).otherwise(0) for c in MEASUREMENT), F.lit(0))
    return g.withColumn(
        "reasons",
        reasons(
            ("ambiguous_channel", F.col("n_ambiguous") > 0), ("duplicate_channel", most > 1),
            ("missing_dapi", F.col("n_DAPI") == 0),
            ("missing_structural", (F.col("n_eGFP") == 0) & (F.col("n_GFAP") == 0)),
            ("measurement_channel_count", kinds != 1),
        ),
    ).withColumn("valid", F.size("reasons") == 0)


def scan_planes(planes: DataFrame) -> DataFrame:
    """Plane rows with a shape status: the array must fill height x width."""
    bad_rank = F.col("height").isNull() | F.col("width").isNull() | F.col("z").isNull()
    return planes.withColumn(
        "status",
        F.when(bad_rank | (F.col("height") <= 0) | (F.col("width") <= 0), "wrong_rank")
        .when(F.size("px") != F.col("height") * F.col("width"), "pixel_count_mismatch").otherwise("ok"),
    )


def explode_planes(planes: DataFrame) -> DataFrame:
    """Long pixel form of well-shaped planes."""
    ok = scan_planes(planes).where(F.col("status") == "ok").drop("status")
    return ok.select("field_id", "channel", "z", "height", "width", "dtype", F.posexplode("px").alias("_i", "_v")).select(
        "field_id", "channel", "z", F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"),
        (F.col("_i") % F.col("width")).cast("int").alias("x"), F.col("_v").cast("double").alias("value"),
        "height", "width", "dtype",
    )


def scan_z_range(planes: DataFrame, windows: DataFrame, channel: str) -> DataFrame:
    """Only the selected planes of one channel.

    The widest window is a literal bound on z, so that the scan skips row groups;
    the exact planes follow by a join, before pixels are exploded.
    """
    bound = windows.agg(F.min("z0").alias("lo"), F.max("z1").alias("hi")).first()
    planes = planes.where(F.col("z").between(bound["lo"], bound["hi"]))
    wanted = windows.select("field_id", F.explode(F.sequence(F.col("z0").cast("int"), F.col("z1").cast("int"))).alias("z")).distinct()
    return explode_planes(planes.where(F.col("channel") == channel).join(wanted, ["field_id", "z"], "left_semi"))


def write_planes(planes: DataFrame, path: str) -> None:
    """Store planes by channel, clustered by field and depth, so z filters skip row groups."""
    planes.repartition("channel", "field_id").sortWithinPartitions("field_id", "z").write.mode("overwrite").partitionBy(
        "channel").parquet(path)


# ---------------------------------------------------------------- calibration


def _to_um(value: Column, unit: Column) -> Column:
    """Length in micrometres; NULL for unknown units or non-positive values."""
    u = F.lower(F.trim(F.regexp_replace(F.replace(unit, F.lit("\\u00B5"), F.lit("u")), "[µμ]", "u")))
    factor = (
        F.when(u.isin("um", "micron", "microns", "micrometer", "micrometers", "micrometre", "micrometres"), 1.0)
        .when(u == "nm", 0.001).when(u == "mm", 1000.0)
    )
    number = F.try_to_number(F.trim(value), F.lit("999999999.999999999")).cast("double")
    number = F.coalesce(number, F.when(F.trim(value).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(value).cast("double")))
    return F.when(number > 0, number * factor)


def resolution_um(pixels_per_unit: Column, unit_code: Column) -> Column:
    per = F.when(pixels_per_unit > 0, pixels_per_unit)
    return F.when(unit_code == 2, 25400.0 / per).when(unit_code == 3, 10000.0 / per)


def _axis(meta: Column, axis: str) -> tuple[Column, Column]:
    text = lambda key: F.coalesce(meta[key], F.lit(""))
    parts = lambda key: F.transform(F.split(text(key), ","), F.trim)
    axes = F.transform(parts("axes"), F.upper)
    pos = F.array_position(axes, axis).cast("int")
    usable = (pos > 0) & (F.size(parts("scales")) == F.size(axes))
    unit = F.when(F.size(parts("units")) == F.size(axes), F.try_element_at(parts("units"), pos)).otherwise(text("unit"))
    from_list = F.when(usable, _to_um(F.try_element_at(parts("scales"), F.when(pos > 0, pos)), unit))
    spacing = _to_um(meta["spacing"], meta["unit"]) if axis == "Z" else F.lit(None).cast("double")
    source = F.when(spacing.isNotNull(), "spacing").when(from_list.isNotNull(), "axis_list")
    return F.coalesce(spacing, from_list), source


def stack_calibration(meta: DataFrame) -> DataFrame:
    """Micrometres per pixel from resolution tags, else from the metadata map ``imagej``.

    Input columns: ``x_per_unit, y_per_unit, unit_code, imagej MAP``.
    """
    m = F.col("imagej")
    z_um, z_source = _axis(m, "Z")
    return meta.withColumns({
        "pixel_width_um": F.coalesce(resolution_um(F.col("x_per_unit"), F.col("unit_code")), _axis(m, "X")[0]),
        "pixel_height_um": F.coalesce(resolution_um(F.col("y_per_unit"), F.col("unit_code")), _axis(m, "Y")[0]),
        "pixel_depth_um": z_um, "depth_source": z_source,
    })


def validate_geometry(meta: DataFrame) -> DataFrame:
    """Compare every channel with the DAPI row of its field; ordered reasons."""
    cols = ["n_z", "height", "width", "pixel_width_um", "pixel_height_um", "pixel_depth_um"]
    ref = meta.where(F.col("channel") == "DAPI").select("field_id", *[F.col(c).alias(f"ref_{c}") for c in cols])
    j = meta.join(ref, "field_id", "left")
    shape = (F.col("n_z") == F.col("ref_n_z")) & (F.col("height") == F.col("ref_height")) & (F.col("width") == F.col("ref_width"))
    same = lambda c: close_to(F.col(c), F.col(f"ref_{c}"))
    pitch = (F.col("pixel_width_um") <= 0) | (F.col("pixel_height_um") <= 0) | (F.col("pixel_depth_um") <= 0)
    return j.withColumn(
        "reasons",
        reasons(
            ("no_dapi", F.col("ref_n_z").isNull()), ("shape_mismatch", ~shape),
            ("calibration_not_positive", pitch),
            ("calibration_mismatch", F.col("ref_n_z").isNotNull()
             & ~(same("pixel_width_um") & same("pixel_height_um") & same("pixel_depth_um"))),
        ),
    ).drop(*[f"ref_{c}" for c in cols])


# -------------------------------------------------------------- age and route


def age_from_filename(scanned: DataFrame) -> DataFrame:
    """Age token on the region-defining channels; conflicting tokens are an error."""
    roi = scanned.where((F.col("status") == "ok") & F.col("channel").isin("DAPI", *STRUCTURAL))
    hits = F.array_compact(F.array(*[F.when(_token(F.col("stem"), p), F.lit(a)) for a, p in AGE_TOKENS.items()]))
    g = roi.select("field_id", "stem", F.explode_outer(hits).alias("age")).groupBy("field_id").agg(
        F.array_sort(F.collect_set("age")).alias("ages"), F.count("age").alias("n_tagged"))
    return g.select(
        "field_id", F.when(F.size("ages") == 1, F.col("ages")[0]).alias("profile"),
        F.when(F.size("ages") > 1, "conflict").when(F.size("ages") == 1, "filename").otherwise("none").alias("source"),
        "n_tagged",
    )


def route_fields(scanned: DataFrame) -> DataFrame:
    """Analysis route, structural channel mode and single measurement channel per field."""
    ok = F.when(F.col("status") == "ok", F.col("channel"))
    g = scanned.groupBy("field_id").agg(F.collect_set(ok).alias("ch"))
    has = lambda c: F.array_contains("ch", c)
    mode = F.concat_ws("+", F.lit("DAPI"), *[F.when(has(c), F.lit(c)) for c in STRUCTURAL])
    target = F.array_compact(F.array(*[F.when(has(c), F.lit(c)) for c in MEASUREMENT]))
    return g.select(
        "field_id",
        F.when(~has("DAPI"), "error").when(has("eGFP"), "egfp").when(has("GFAP"), "gfap_only").otherwise("error").alias("route"),
        F.when(has("DAPI"), mode).alias("channel_mode"),
        F.when(F.size(target) == 1, target[0]).alias("measurement_channel"),
        (has("GFAP") & ~has("eGFP") & has("DAPI")).alias("gfap_route_allowed"),
    )


# --------------------------------------------------------------- fingerprints


def fingerprint_files(files: DataFrame) -> DataFrame:
    """SHA-256 of the whole content of every file; ``files`` are binaryFile rows (path, length, content)."""
    return files.select("path", "length", F.sha2("content", 256).alias("fingerprint"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    j = before.select("path", F.col("fingerprint").alias("old")).join(
        after.select("path", F.col("fingerprint").alias("new")), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", kind.alias("change"))


# ------------------------------------------------------------ sinks and checks


RESULT_COLUMNS = (
    "field_id", "compartment", "cell_id", "cell_uid", "original_id", "age_profile", "channel", "z_start", "z_end",
    "projection", "pixel_width_um", "pixel_height_um", "pixels", "area", "mean", "median", "min", "max", "int_den",
    "raw_int_den",
)


def write_measurements(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per compartment; the row set is the fixed result table."""
    df.write.mode("overwrite").partitionBy("compartment").format(fmt).save(path)


def check_measurements(m: DataFrame) -> DataFrame:
    """Violations of a result table (field_id, compartment, cell_id, original_id, median)."""
    g = m.groupBy("field_id", "compartment").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("ids"), F.min("cell_id").alias("lo"),
        F.max("cell_id").alias("hi"), F.countDistinct("original_id").alias("orig"),
        F.count_if(F.col("median").isNull()).alias("no_median"),
    )
    rules = F.array_compact(F.array(
        F.when((F.col("ids") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")), "ids_not_contiguous"),
        F.when(F.col("orig") != F.col("n"), "original_id_not_unique"), F.when(F.col("no_median") > 0, "median_missing"),
    ))
    own = g.select("field_id", "compartment", F.explode(rules).alias("violation"))
    parts = m.groupBy("field_id", "cell_id", "original_id").agg(F.countDistinct("compartment").alias("k"))
    unequal = parts.where(F.col("k") != 3).select("field_id").distinct().select(
        "field_id", F.lit("all").alias("compartment"), F.lit("sequences_differ").alias("violation"))
    return own.unionByName(unequal)


def archive_rows(labels: DataFrame, identities: DataFrame, calibration: DataFrame, selected_z: DataFrame) -> DataFrame:
    """Archive manifest: one row per field, layer and label with geometry, identity and digest.

    ``labels``: (field_id, layer, y, x, label_id). Pixels are digested by
    row runs first, so the per-label concatenation stays short.
    """
    keys = ["field_id", "layer", "label_id"]
    geometry = labels.groupBy(*keys).agg(
        F.min("x").alias("bx"), F.min("y").alias("by"), (F.max("x") - F.min("x") + 1).alias("bw"),
        (F.max("y") - F.min("y") + 1).alias("bh"), F.count(F.lit(1)).alias("pixels"),
    )
    row_text = labels.groupBy(*keys, "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda v: v.cast("string")), " ").alias("t"))
    rows = row_text.select(*keys, F.struct("y", F.sha2(F.concat_ws(":", F.col("y").cast("string"), "t"), 256).alias("d")).alias("r"))
    digest = rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["d"]), ","), 256).alias("digest"))
    return (
        geometry.join(digest, keys).join(identities, ["field_id", "label_id"]).join(calibration, "field_id").join(selected_z, "field_id")
    )


def check_roi_archive(archive: DataFrame, measured: DataFrame) -> DataFrame:
    """Disagreements between an archive manifest and the measured manifest, one row per rule.

    Both sides carry (field_id, layer, label_id, original_id, cell_uid, lineage,
    z_start, z_end, pixel_width_um, pixel_height_um, pixel_depth_um, digest).
    """
    keys = ["field_id", "layer", "label_id"]
    a, b = archive.alias("a"), measured.alias("b")
    j = a.join(b, keys, "full_outer")
    def differ(*names: str) -> Column:
        return ~F.forall(F.array(*[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]), lambda same: same)

    missing = F.col("a.digest").isNull() | F.col("b.digest").isNull()
    cal = [close_to(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in ("pixel_width_um", "pixel_height_um", "pixel_depth_um")]
    rules = F.array_compact(F.array(
        F.when(missing, "missing_label"),
        F.when(~missing & differ("original_id", "cell_uid", "lineage"), "identity"),
        F.when(~missing & differ("z_start", "z_end"), "z_range"),
        F.when(~missing & ~(cal[0] & cal[1] & cal[2]), "calibration"),
        F.when(~missing & differ("digest"), "digest"),
    ))
    rows = j.select("field_id", F.explode(rules).alias("violation")).distinct()
    size = archive.groupBy("field_id").agg(F.countDistinct("label_id").alias("n")).where(~F.col("n").between(1, 65535))
    return rows.unionByName(size.select("field_id", F.lit("label_count").alias("violation")))


def run_report(df: DataFrame, section: str, columns: list[str], keys: list[str] = ["field_id"]) -> DataFrame:
    """Wide per-field metrics as a long (field_id, section, key, value) table."""
    text = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(keys, columns, "key", "value").withColumn("section", F.lit(section))


RUN_EVENT_SCHEMA = (
    "schema_version INT, run_id STRING, sequence BIGINT, timestamp TIMESTAMP, type STRING, stage STRING, "
    "message STRING, current INT, total INT, code STRING"
)


def read_run_events(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Run events from JSON lines; other schema versions are dropped."""
    reader = (spark.readStream if stream else spark.read).schema(RUN_EVENT_SCHEMA)
    return reader.json(folder).where(F.col("schema_version") == 1)
