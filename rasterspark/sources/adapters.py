"""Read the relational test tables as raster, object, edit and file tables.

Each adapter is a plain projection of whole input tables, so its size grows
with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Planes of a stack of the vector table.
STACK_PLANES = 25

#: Pixels of made-up cells in a partition.
CELL_PIXELS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dense_plane(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding vectors as image rows: fields of 50 x 64 pixels."""
    e = table(spark, folder, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 50).cast("string").alias("field_id"),
        (F.col("vec_id") % 50).cast("int").alias("y"),
        F.posexplode("embedding").alias("x", "value"),
    ).select("field_id", "y", "x", F.col("value").cast("double"), F.lit(50).alias("height"), F.lit(64).alias("width"))


def mosaic(spark: SparkSession, folder: str) -> DataFrame:
    """All embedding vectors as rows of one tall image, so that tiles have borders inside a field."""
    e = table(spark, folder, "embeddings")
    tall = e.agg((F.max("vec_id") + 1).cast("int").alias("n")).first()["n"]
    return e.select(
        F.lit("all").alias("field_id"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "value"),
    ).select("field_id", "y", "x", F.col("value").cast("double"), F.lit(tall).alias("height"), F.lit(64).alias("width"))


def dense_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Two structural channels: the raster and its mirror image."""
    d = dense_plane(spark, folder)
    return d.select(
        "field_id",
        F.explode(F.array(F.struct(F.lit("eGFP").alias("channel"), F.col("x").alias("px")),
                          F.struct(F.lit("GFAP").alias("channel"), (63 - F.col("x")).alias("px")))).alias("c"),
        "y", "value", "height", "width",
    ).select("field_id", "c.channel", "y", F.col("c.px").cast("int").alias("x"), "value", "height", "width")


def dense_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector is one 8 x 8 plane; 25 planes make a stack."""
    e = table(spark, folder, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 25).cast("string").alias("field_id"),
        (F.col("vec_id") % 25).cast("int").alias("z"),
        F.posexplode("embedding").alias("i", "value"),
    ).select(
        "field_id", F.lit("target").alias("channel"), "z",
        F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"),
        F.col("value").cast("double"), F.lit(8).alias("height"), F.lit(8).alias("width"),
    )


def planes(spark: SparkSession, folder: str) -> DataFrame:
    """The same stack in its storage form: one row per plane with a pixel array."""
    e = table(spark, folder, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 25).cast("string").alias("field_id"), F.lit("target").alias("channel"),
        (F.col("vec_id") % 25).cast("int").alias("z"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.lit("float32").alias("dtype"), F.col("embedding").alias("px"),
    )


def sparse_stack(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as voxels of 7 x 32 x 32 stacks, one field per supplier."""
    li = table(spark, folder, "lineitem")
    channel = F.when(F.col("l_returnflag") == "A", "DAPI").when(F.col("l_returnflag") == "N", "eGFP").otherwise("GFAP")
    return (
        li.groupBy(
            F.col("l_suppkey").cast("string").alias("field_id"), channel.alias("channel"),
            (F.col("l_linenumber") - 1).cast("int").alias("z"), (F.col("l_partkey") % 32).cast("int").alias("y"),
            (F.col("l_orderkey") % 32).cast("int").alias("x"),
        )
        .agg(F.max("l_quantity").alias("value"))
        .withColumns({"height": F.lit(32), "width": F.lit(32)})
    )


def field_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("field_id")).distinct()


def compartments(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen 8 x 8 cells per supplier field with a 4 x 4 soma each."""
    fields = field_ids(spark, folder)
    # A list of fields is small and would be coalesced to a task or two, which then held all pixels.
    fields = fields.repartition(fields.count() * 1024 // CELL_PIXELS + 1, "field_id")
    px = fields.select("field_id", F.explode(F.sequence(F.lit(0), F.lit(1023))).alias("i"))
    y, x = F.floor(F.col("i") / 32).cast("int"), (F.col("i") % 32).cast("int")
    soma = (F.col("y") % 8).between(2, 5) & (F.col("x") % 8).between(2, 5)
    return px.select("field_id", y.alias("y"), x.alias("x")).select(
        "field_id", "y", "x",
        (F.floor(F.col("y") / 8) * 4 + F.floor(F.col("x") / 8) + 1).cast("long").alias("cell_id"),
        F.when(soma, "soma").otherwise("processes").alias("part"),
        F.lit(32).alias("height"), F.lit(32).alias("width"),
    )


def nuclei_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as 3D nucleus records, 25 per field."""
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    return p.select(
        F.floor(k / 25).cast("string").alias("field_id"), k.alias("object_id"),
        (k % 5).cast("long").alias("component_2d"),
        (k * 7 % 20).cast("int").alias("z_min"), (k * 7 % 20 + F.col("p_size") % 5).cast("int").alias("z_max"),
        (k * 7 % 20 + (F.col("p_size") % 5) / 2).cast("double").alias("center_z"),
        (k * 13 % 50).cast("double").alias("center_y"), (k * 29 % 64).cast("double").alias("center_x"),
        F.col("p_size").cast("double").alias("volume_um3"),
        (F.col("p_retailprice").cast("long") % 3 == 0).alias("accepted"),
        ((k * 11 % 100) / 100).cast("double").alias("enclosure"),
    )


def edits(spark: SparkSession, folder: str) -> DataFrame:
    """Events as an ordered per-field edit ledger."""
    from pyspark.sql import Window

    ev = table(spark, folder, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(
        F.col("user_id").cast("string").alias("field_id"), F.row_number().over(w).cast("long").alias("sequence"),
        F.col("event_type"), (F.col("event_id") % 64).cast("long").alias("target_id"), "ts", "event_id", "value",
    )


def channel_files(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as image files, one folder per customer."""
    o = table(spark, folder, "orders")
    # File-name tokens by order number modulo 7.
    tokens = F.array(*[F.lit(t) for t in ("DAPI", "eGFP", "GFAP", "KCNN1", "SK2", "kcnn3", "Kir4.1")])
    token = F.element_at(tokens, (F.col("o_orderkey") % 7 + 1).cast("int"))
    stem = (
        F.when(F.col("o_orderstatus") == "P", F.lit("overview"))
        .when(F.col("o_orderpriority").startswith("1"), F.concat(token, F.lit("-gfap")))
        .otherwise(token)
    )
    age = F.when(F.col("o_orderpriority").startswith("2"), "_mature").when(
        F.col("o_orderpriority").startswith("3"), "_NEONATAL").otherwise("")
    return o.select(
        F.concat(F.lit("/data/"), F.col("o_custkey").cast("string"), F.lit("/S"), F.col("o_orderkey").cast("string"),
                 F.lit("_"), stem, age, F.when(F.col("o_orderkey") % 2 == 0, ".tif").otherwise(".TIFF")).alias("path"),
        F.col("o_totalprice").cast("long").alias("length"), F.col("o_orderdate").alias("modificationTime"),
    )
