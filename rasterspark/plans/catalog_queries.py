"""Queries of sources, gates, sinks, catalogs and user-model hooks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterspark.operators import catalog as specs
from rasterspark.plans.depth_queries import windows
from rasterspark.plans.graph_queries import comp_sql
from rasterspark.plans.registry import joined, query, rounded, with_ctes
from rasterspark.plans.zonal_queries import MEASURE_SQL, measured
from rasterspark.session import ensure_checkpoint_dir
from rasterspark.sources import adapters as src
from rasterspark.sources import catalog

AT = ["field_id", "y", "x"]
_T = lambda p: f"regexp_matches(lower(stem), '(^|[^a-z0-9])({p})([^a-z0-9]|$)')"
_HITS = ", ".join(f"CASE WHEN {_T(p)} THEN '{c}' END" for c, p in catalog.CHANNEL_TOKENS.items())
SCAN_SQL = f"""st AS (SELECT path, length, modificationTime, string_split(path, '/')[3] AS field_id, regexp_replace(string_split(path, '/')[4], '(?i)\\.tiff?$', '') AS stem FROM files),
hc AS (SELECT *, list_filter([{_HITS}], lambda h: h IS NOT NULL) AS h FROM st),
sc AS (SELECT *, CASE WHEN len(h) = 1 THEN h[1] END AS channel, CASE len(h) WHEN 0 THEN 'ignored' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM hc)"""


def scanned(spark, d):
    return catalog.scan_channel_files(src.channel_files(spark, d))


@query("a01_scan_channel_files", with_ctes("files", extra=SCAN_SQL) + "SELECT path, field_id, stem, channel, status FROM sc")
def a01(spark, d):
    return scanned(spark, d).select("path", "field_id", "stem", "channel", "status")


_N = lambda c: f"count(*) FILTER (WHERE channel = '{c}')"


@query("a01_field_channels", with_ctes("files", extra=SCAN_SQL) + f""", g AS (SELECT field_id, count(*) FILTER (WHERE status = 'ambiguous') AS n_ambiguous, greatest({', '.join(_N(c) for c in catalog.CHANNEL_TOKENS)}) AS mx,
  {_N('DAPI')} AS nd, {_N('eGFP')} + {_N('GFAP')} AS ns, {' + '.join(f"CAST({_N(c)} > 0 AS INT)" for c in catalog.MEASUREMENT)} AS nm FROM sc GROUP BY 1)
SELECT field_id, concat_ws(',', CASE WHEN n_ambiguous > 0 THEN 'ambiguous_channel' END, CASE WHEN mx > 1 THEN 'duplicate_channel' END, CASE WHEN nd = 0 THEN 'missing_dapi' END, CASE WHEN ns = 0 THEN 'missing_structural' END,
  CASE WHEN nm <> 1 THEN 'measurement_channel_count' END) AS reasons FROM g""")
def a01g(spark, d):
    return joined(catalog.field_channels(scanned(spark, d)), "reasons").select("field_id", "reasons")


@query("a02_scan_planes", """SELECT CAST(vec_id // 25 AS VARCHAR) AS field_id, CAST(vec_id % 25 AS INT) AS z, CASE WHEN vec_id % 10 = 3 THEN 'pixel_count_mismatch' WHEN vec_id % 10 = 4 THEN 'wrong_rank' ELSE 'ok' END AS status FROM embeddings""")
def a02(spark, d):
    v = (F.col("field_id").cast("int") * 25 + F.col("z")) % 10
    p = src.planes(spark, d).withColumns({"height": F.when(v == 3, 7).when(v == 4, F.lit(None)).otherwise(F.col("height"))})
    return catalog.scan_planes(p).select("field_id", "z", "status")


@query("a03_stack_calibration", """WITH m AS (SELECT p_partkey, p_partkey % 4 AS u, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END AS r, p_partkey % 5 AS k, p_size FROM part)
SELECT p_partkey, round(coalesce(CASE u WHEN 2 THEN 25400 / r WHEN 3 THEN 10000 / r END, CASE WHEN k = 1 THEN .2 END), 6) + 0.0 AS pixel_width_um,
  round(CASE WHEN k = 0 THEN p_size * .001 WHEN k = 1 THEN .7 WHEN k = 2 THEN CAST(p_size AS DOUBLE) END, 6) + 0.0 AS pixel_depth_um, CASE WHEN k IN (0, 2) THEN 'spacing' WHEN k = 1 THEN 'axis_list' END AS depth_source FROM m""")
def a03(spark, d):
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    m = F.when(k % 5 == 0, F.create_map(F.lit("spacing"), size, F.lit("unit"), F.lit("nm"))).when(
        k % 5 == 1, F.create_map(F.lit("axes"), F.lit("X,Y,Z"), F.lit("scales"), F.lit("0.2,0.2,0.7"), F.lit("units"), F.lit("um,um,micron"))).when(
        k % 5 == 2, F.create_map(F.lit("spacing"), size, F.lit("unit"), F.lit("\\u00B5m"))).otherwise(F.create_map(F.lit("spacing"), size, F.lit("unit"), F.lit("furlong")))
    rate = F.when(k % 7 > 0, F.col("p_retailprice"))
    meta = src.table(spark, d, "part").select("p_partkey", rate.alias("x_per_unit"), rate.alias("y_per_unit"), (k % 4).alias("unit_code"), m.alias("imagej"))
    return rounded(catalog.stack_calibration(meta), "pixel_width_um", "pixel_depth_um").select("p_partkey", "pixel_width_um", "pixel_depth_um", "depth_source")


@query("a04_validate_geometry", """WITH m AS (SELECT CAST(p_partkey // 4 AS VARCHAR) AS field_id, ['DAPI','eGFP','GFAP','KCNN1'][p_partkey % 4 + 1] AS channel, 20 + CAST(p_partkey % 29 = 0 AS INT) AS n_z, CASE WHEN p_partkey % 13 = 0 THEN .3 ELSE .2 END AS w, CASE WHEN p_partkey % 17 > 0 THEN 1.0 END AS dz FROM part),
j AS (SELECT m.*, r.n_z AS rn, r.w AS rw, r.dz AS rd FROM m LEFT JOIN m r ON r.field_id = m.field_id AND r.channel = 'DAPI')
SELECT field_id, channel, concat_ws(',', CASE WHEN rn IS NULL THEN 'no_dapi' END, CASE WHEN n_z <> rn THEN 'shape_mismatch' END, CASE WHEN rn IS NOT NULL AND (w <> rw OR dz IS DISTINCT FROM rd) THEN 'calibration_mismatch' END) AS reasons FROM j""")
def a04(spark, d):
    k = F.col("p_partkey")
    ch = F.element_at(F.array(*[F.lit(c) for c in ("DAPI", "eGFP", "GFAP", "KCNN1")]), (k % 4 + 1).cast("int"))
    w = F.when(k % 13 == 0, 0.3).otherwise(0.2)
    m = src.table(spark, d, "part").select(
        F.floor(k / 4).cast("string").alias("field_id"), ch.alias("channel"), (20 + (k % 29 == 0).cast("int")).alias("n_z"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        w.alias("pixel_width_um"), F.lit(0.2).alias("pixel_height_um"), F.when(k % 17 > 0, 1.0).alias("pixel_depth_um"))
    return joined(catalog.validate_geometry(m), "reasons").select("field_id", "channel", "reasons")


@query("a05_age_from_filename", with_ctes("files", extra=SCAN_SQL) + f""", a AS (SELECT field_id, {_T('neonatal')} AS n, {_T('mature')} AS m FROM sc WHERE channel IN ('DAPI', 'eGFP', 'GFAP')), g AS (SELECT field_id, bool_or(n) AS n, bool_or(m) AS m, count(*) FILTER (WHERE n) + count(*) FILTER (WHERE m) AS n_tagged FROM a GROUP BY 1)
SELECT field_id, CASE WHEN n AND NOT m THEN 'neonatal' WHEN m AND NOT n THEN 'mature' END AS profile, CASE WHEN n AND m THEN 'conflict' WHEN n OR m THEN 'filename' ELSE 'none' END AS source, n_tagged FROM g""")
def a05(spark, d):
    return catalog.age_from_filename(scanned(spark, d))


@query("a06_route_fields", with_ctes("files", extra=SCAN_SQL) + """, g AS (SELECT field_id, bool_or(coalesce(channel = 'DAPI', false)) AS d, bool_or(coalesce(channel = 'eGFP', false)) AS e, bool_or(coalesce(channel = 'GFAP', false)) AS g,
  list_sort(list(DISTINCT channel) FILTER (WHERE channel LIKE 'KCN%')) AS m FROM sc GROUP BY 1)
SELECT field_id, CASE WHEN NOT d THEN 'error' WHEN e THEN 'egfp' WHEN g THEN 'gfap_only' ELSE 'error' END AS route, CASE WHEN d THEN concat_ws('+', 'DAPI', CASE WHEN e THEN 'eGFP' END, CASE WHEN g THEN 'GFAP' END) END AS channel_mode,
  CASE WHEN len(m) = 1 THEN m[1] END AS measurement_channel, g AND NOT e AND d AS gfap_route_allowed FROM g""")
def a06(spark, d):
    return catalog.route_fields(scanned(spark, d))


@query("a07_scan_z_range", with_ctes("stack") + "SELECT field_id, z, y, x, round(value, 6) + 0.0 AS value FROM stack WHERE z BETWEEN 7 AND 12")
def a07(spark, d):
    p = src.planes(spark, d)
    w = p.select("field_id").distinct().withColumns({"z0": F.lit(7), "z1": F.lit(12)})
    return rounded(catalog.scan_z_range(p, w, "target"), "value").select("field_id", "z", "y", "x", "value")


@query("a08_write_measurements", with_ctes("sparse", "cells", extra=MEASURE_SQL) + "SELECT compartment, count(*) AS n, CAST(sum(raw_int_den) AS DOUBLE) AS raw_int_den FROM meas GROUP BY 1")
def a08(spark, d):
    out = f"{ensure_checkpoint_dir(spark)}/measurements-{uuid.uuid4().hex}"
    catalog.write_measurements(measured(spark, d), out)
    return spark.read.parquet(out).groupBy("compartment").agg(F.count(F.lit(1)).alias("n"), F.sum("raw_int_den").alias("raw_int_den"))


@query("a09_check_measurements", with_ctes("cells") + """, f AS (SELECT DISTINCT field_id, CAST(field_id AS INT) % 5 AS k FROM cells)
SELECT field_id, unnest(CASE k WHEN 1 THEN ['whole'] WHEN 2 THEN ['soma'] WHEN 3 THEN ['soma', 'all'] ELSE [] END) AS compartment, unnest(CASE k WHEN 1 THEN ['original_id_not_unique'] WHEN 2 THEN ['median_missing'] WHEN 3 THEN ['ids_not_contiguous', 'sequences_differ'] ELSE [] END) AS violation FROM f
UNION ALL SELECT field_id, unnest(['soma', 'processes']), 'original_id_not_unique' FROM f WHERE k = 1""")
def a09(spark, d):
    k = F.col("field_id").cast("int") % 5
    m = measured(spark, d).withColumn("original_id", F.when((k == 1) & (F.col("cell_id") == 2), 1).otherwise(F.col("cell_id")))
    m = m.withColumn("median", F.when((k == 2) & (F.col("compartment") == "soma") & (F.col("cell_id") == 5), F.lit(None)).otherwise(F.col("median")))
    return catalog.check_measurements(m.where(~((k == 3) & (F.col("compartment") == "soma") & (F.col("cell_id") == 7))))


def archive(spark, d):
    c = src.compartments(spark, d)
    parts = c.select("field_id", F.col("part").alias("layer"), "y", "x", F.col("cell_id").alias("label_id"))
    layers = parts.unionByName(parts.withColumn("layer", F.lit("whole")))
    ids = c.select("field_id", F.col("cell_id").alias("label_id")).distinct().withColumns({
        "original_id": F.col("label_id"), "cell_uid": F.concat_ws("-", F.lit("cell"), "field_id", "label_id"), "lineage": F.array("label_id")})
    fields = c.select("field_id").distinct()
    cal = fields.withColumns({"pixel_width_um": F.lit(0.25), "pixel_height_um": F.lit(0.5), "pixel_depth_um": F.lit(1.5)})
    return catalog.archive_rows(layers, ids, cal, fields.withColumns({"z_start": F.lit(2), "z_end": F.lit(4)}))


@query("a10_archive_rows", with_ctes("cells") + """SELECT field_id, coalesce(part, 'whole') AS layer, cell_id AS label_id, min(x) AS bx, min(y) AS by, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, count(*) AS pixels
  FROM cells GROUP BY GROUPING SETS ((field_id, part, cell_id), (field_id, cell_id))""")
def a10(spark, d):
    return archive(spark, d).select("field_id", "layer", "label_id", "bx", "by", "bw", "bh", "pixels")


@query("a11_check_roi_archive", with_ctes("cells") + """, f AS (SELECT DISTINCT field_id, CAST(field_id AS INT) % 7 AS k FROM cells)
SELECT field_id, ['identity', 'missing_label', 'z_range', 'calibration', 'digest'][k] AS violation FROM f WHERE k BETWEEN 1 AND 5""")
def a11(spark, d):
    a = archive(spark, d)
    k = F.col("field_id").cast("int") % 7
    last = F.col("label_id") == 16
    b = a.where(~((k == 2) & last)).withColumns({
        "cell_uid": F.when((k == 1) & last, "other").otherwise(F.col("cell_uid")), "z_end": F.when((k == 3) & last, 5).otherwise(F.col("z_end")),
        "pixel_width_um": F.when((k == 4) & last, 0.26).otherwise(F.col("pixel_width_um")), "digest": F.when((k == 5) & last, "0").otherwise(F.col("digest"))})
    return catalog.check_roi_archive(b, a)


@query("a12_fingerprint_files", """SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(length(o_orderpriority) AS BIGINT) AS length, sha256(o_orderpriority) AS fingerprint FROM orders""")
def a12(spark, d):
    o = src.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.encode("o_orderpriority", "UTF-8").alias("content"))
    return catalog.fingerprint_files(o.withColumn("length", F.octet_length("content").cast("long")))


@query("a12_changed_files", """SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'added' WHEN o_orderkey % 5 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'modified' ELSE 'added' END AS change FROM orders WHERE (o_orderkey % 5 = 0 AND o_orderkey % 11 > 0) OR (o_orderkey % 5 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 7 = 0) OR (o_orderkey % 5 > 0 AND o_orderkey % 11 = 0)""")
def a12c(spark, d):
    k = F.col("o_orderkey")
    o = src.table(spark, d, "orders").select(k, k.cast("string").alias("path"), F.sha2("o_orderpriority", 256).alias("fingerprint"))
    after = o.where(k % 5 > 0).withColumn("fingerprint", F.when((k % 7 == 0), F.lit("new")).otherwise(F.col("fingerprint")))
    return catalog.changed_files(o.where(k % 11 > 0), after)


@query("a13_run_report", with_ctes("sparse", "cells", extra=MEASURE_SQL) + """, t AS (SELECT field_id, count(*) AS cells, CAST(sum(pixels) AS BIGINT) AS pixels FROM meas WHERE compartment = 'whole' GROUP BY 1)
SELECT field_id, 'measurement' AS section, 'cells' AS key, CAST(cells AS VARCHAR) AS value FROM t UNION ALL SELECT field_id, 'measurement', 'pixels', CAST(pixels AS VARCHAR) FROM t""")
def a13(spark, d):
    t = measured(spark, d).where(F.col("compartment") == "whole").groupBy("field_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("pixels").alias("pixels"))
    return catalog.run_report(t, "measurement", ["cells", "pixels"])


@query("b18_candidate_catalog")
def b18(spark, d):
    from rasterspark.operators.local import snr_sensitivity

    snr = snr_sensitivity(src.dense_stack(spark, d))
    return rounded(specs.candidate_catalog(windows(spark, d), snr), "detail", "intensity", "major_axis", "eccentricity")


@query("b18_check_catalog", """SELECT DISTINCT CAST(vec_id // 25 AS VARCHAR) AS field_id, 'candidate_count' AS violation FROM embeddings WHERE (vec_id // 25) % 3 = 0""")
def b18c(spark, d):
    w = windows(spark, d)
    c = specs.candidate_catalog(w, w.select("field_id").distinct().withColumn("sensitivity", F.lit(0.4)))
    return specs.check_catalog(c.where(~((F.col("field_id").cast("int") % 3 == 0) & (F.col("candidate") == 5))))


@query("b19_profile_parameters", "SELECT CAST(c_custkey AS VARCHAR) AS field_id, CASE WHEN c_nationkey % 2 = 0 THEN 'mature' ELSE 'neonatal' END AS profile, " + str(len(specs.COMPARTMENT_PARAMETERS)) + " AS n, CAST(CASE WHEN c_nationkey % 2 = 0 THEN .72 ELSE .64 END AS DOUBLE) AS max_soma_fraction FROM customer")
def b19(spark, d):
    f = src.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("field_id"), F.when(F.col("c_nationkey") % 2 == 0, "mature").otherwise("neonatal").alias("profile"))
    p = specs.profile_parameters(f)
    return p.groupBy("field_id", "profile").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("name") == "max_soma_fraction", F.col("value"))).alias("max_soma_fraction"))


@query("k01_with_segmenter", with_ctes("stack") + """, m AS (SELECT field_id, z, max(value) AS hi, min(value) AS lo FROM stack GROUP BY 1, 2)
SELECT field_id, z, y, x, 1 AS label_id FROM stack JOIN m USING (field_id, z) WHERE value > (hi + lo) / 2""")
def k01(spark, d):
    out = specs.with_segmenter(src.planes(spark, d), lambda a: (a > (a.max() + a.min()) / 2).astype(int))
    return out.select("field_id", "z", "y", "x", "label_id")


@query("k02_model_prior", with_ctes("dense", extra="""big AS (SELECT field_id, y * 2 + dy AS y, x * 2 + dx AS x FROM dense, (SELECT unnest(range(2)) AS dy), (SELECT unnest(range(2)) AS dx) WHERE value > .05),"""
    + comp_sql("cc", "big", False, 128)) + "SELECT field_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT *, count(*) OVER (PARTITION BY field_id, label_id) AS n FROM cc) WHERE n >= 20")
def k02(spark, d):
    px = src.dense_plane(spark, d).where(F.col("value") > 0.05).withColumn("label_id", F.lit(1))
    return specs.model_prior(px, 20, 2.0).select(*AT)


def _resize_sql(scale: float) -> str:
    return with_ctes("dense") + f""", big AS (SELECT DISTINCT field_id, greatest(1, CAST(floor(height * {scale} + .5) AS INT)) AS h, greatest(1, CAST(floor(width * {scale} + .5) AS INT)) AS w FROM dense)
SELECT g.field_id, CAST(r.y AS INTEGER) AS y, CAST(q.x AS INTEGER) AS x FROM big g, range(0, 130) r(y), range(0, 130) q(x), dense d
WHERE r.y < h AND q.x < w AND d.field_id = g.field_id AND d.y = CAST(floor((r.y + .5) / {scale}) AS INT) AND d.x = CAST(floor((q.x + .5) / {scale}) AS INT) AND d.value > 0.05"""


def _resize(scale: float):
    def run(spark, d):
        px = src.dense_plane(spark, d).where(F.col("value") > 0.05).withColumn("label_id", F.lit(1))
        return specs.resize_nearest(px, scale).select(*AT)

    return run


for _name, _scale in (("half", 0.5), ("odd", 1.4), ("double", 2.0)):
    query(f"k02_resize_{_name}", _resize_sql(_scale))(_resize(_scale))


@query("k05_stroke_pixels", with_ctes("ledger") + """, s AS (SELECT field_id, sequence, target_id // 8 AS y0, target_id % 8 AS x0, target_id // 8 + event_id % 3 AS y1, target_id % 8 + event_id % 4 AS x1 FROM ledger)
SELECT field_id, count(*) AS pixels FROM s, range(0, 12) r(y), range(0, 12) q(x) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY 1""")
def k05(spark, d):
    t, e = F.col("target_id"), F.col("event_id")
    s = src.edits(spark, d).select("field_id", F.floor(t / 8).alias("y0"), (t % 8).alias("x0"), (F.floor(t / 8) + e % 3).alias("y1"), (t % 8 + e % 4).alias("x1"))
    return specs.stroke_pixels(s).groupBy("field_id").agg(F.count(F.lit(1)).alias("pixels"))

