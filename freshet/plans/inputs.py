"""River inputs derived from the driver's tables with whole-number arithmetic, so that other engines get the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of braids and reversed segments begin here where they must not meet those of the tree.
APART = 1 << 40


def named(df: DataFrame) -> DataFrame:
    """`df` with the comids that `segments` gives when its kinds aren't kept apart."""
    return df.withColumn("comid", F.col("comid") % APART)


def segments(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """A binary tree, braids across it, and reversed segments that routing must drop.

    From a million parts on a braid has the comid of a segment of the tree, and a network by comid would lead in circles:
    with `apart`, the two other kinds are numbered from APART.
    """
    first = APART if apart else 0
    tree = table(spark, sf_dir, "part").selectExpr("p_partkey + 1 as i", "p_size").selectExpr(
        "i as comid", "cast(i as double) as fromnode", "cast(i div 2 as double) as tonode", "if(i > 100 and i % 97 = 0, null, cast(i as double)) as hydroseq", "cast(p_size as double) as areasqkm"
    )
    braids = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_suppkey + 8 as x").selectExpr(
        f"{first} + 1000000 + s_suppkey as comid", "cast(x as double) as fromnode", "cast(x div 4 as double) as tonode", "x - 0.5D as hydroseq", "1.0D as areasqkm"
    )
    reverse = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as k", "cast(n_nationkey + 1 as bigint) as m").selectExpr(
        f"{first} + 2000000 + k as comid", "cast(m as double) as fromnode", "cast(2 * m as double) as tonode", "cast(m as double) as hydroseq", "0.0D as areasqkm"
    )
    return tree.unionByName(braids).unionByName(reverse)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, gage_id, acft by month of shipping and supplier; every third gage has nothing in May and October."""
    dry = (F.month("l_shipdate") % 5 == 0) & (F.col("l_suppkey") % 3 == 0)
    items = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "MM").alias("date"), F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("gage_id"), F.when(dry, 0.0).otherwise(F.col("l_quantity")).alias("l_quantity"))
    return items.groupBy("date", "gage_id").agg(F.sum("l_quantity").alias("acft"))


def flo_lines(spark: SparkSession, sf_dir: str, gap: str = "0") -> DataFrame:
    """The observations as text lines of station, year and twelve values, `gap` where there is none; some lines are too short, some have a further token."""
    dated = observations(spark, sf_dir).withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    wide = dated.groupBy("gage_id", "year").pivot("month", list(range(1, 13))).agg(F.sum("acft"))
    values = [F.coalesce(F.col(str(m)).cast("long").cast("string"), F.lit(gap)) for m in range(1, 13)]
    full = wide.select(F.concat(F.lit("  "), F.concat_ws("   ", "gage_id", F.col("year").cast("string"), *values), F.when(F.col("year") % 2 == 0, F.lit("  extra")).otherwise(F.lit(""))).alias("value"))
    short = wide.select(F.concat_ws(" ", "gage_id", F.col("year").cast("string"), *values[:11]).alias("value"))
    return full.unionAll(short)


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gages by segment; one of ten lies outside the network."""
    comid = F.expr("if(s_suppkey % 10 = 7, 9000000, 1) + s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("gage_id"), comid.alias("COMID"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comid, x, y: the segments of the tree on a coarse lattice of metres."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey + 1 as comid", "cast((p_partkey * 7919) % 1009 as double) * 128 as x", "cast((p_partkey * 104729) % 2003 as double) * 64 as y")


def control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP_CP, Next_DS_CP, ChLosFac, file_row, x, y: points beside segments 1..n, each handing on to the eighth of its number; the first few come twice."""
    points = table(spark, sf_dir, "supplier").selectExpr("s_suppkey + 1 as i").selectExpr(
        "concat('CP', i) as UP_CP",
        "concat('CP', i div 8) as Next_DS_CP",
        "(i % 17) / 16.0D as ChLosFac",
        "i as file_row",
        "cast(((i - 1) * 7919) % 1009 as double) * 128 + 3 as x",
        "cast(((i - 1) * 104729) % 2003 as double) * 64 - 5 as y",
    )
    again = points.where("file_row <= 5").withColumn("file_row", F.col("file_row") + 1_000_000).withColumn("x", F.col("x") + 5000)
    return points.unionByName(again)


#: Bounds of the basin of `model_files`; segments from OUTSIDE on, also those of the tree, lie outside it, as in the SQL.
BASIN = (-103.0, 25.0, -93.0, 35.0)
OUTSIDE = 2_000_000


def model_files(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, str]:
    """The files of a model run, as options of its configuration: Parquet, CSV, GeoJSON lines and flow text. Its kinds of segments are kept apart."""
    tree = sites(spark, sf_dir).withColumn("x", F.expr(f"x + if(comid < {OUTSIDE}, 0, 400000)"))
    # Braids lie beside the lattice of the tree.
    braids = table(spark, sf_dir, "supplier").selectExpr(f"{APART} + 1000000 + s_suppkey as comid", "cast(s_suppkey % 997 as double) * 128 + 64 as x", "cast(s_suppkey % 1999 as double) * 64 + 32 as y")
    outside = table(spark, sf_dir, "nation").selectExpr(f"{APART} + {OUTSIDE} + n_nationkey as comid", "cast(400000 + n_nationkey as double) as x", "0.0D as y")
    at = tree.unionByName(braids).unionByName(outside).select("comid", (F.lit(-102.0) + F.col("x") / 16384.0).alias("lon"), (F.lit(26.0003) + F.col("y") / 16384.0).alias("lat"))
    point = lambda x: F.struct(x.alias("x"), F.col("lat").alias("y"))
    lines = at.withColumn("parts", F.array(F.array(point(F.col("lon")), point(F.col("lon") + 0.0104))))
    flow = segments(spark, sf_dir, apart=True).join(lines, "comid").select(
        F.concat(F.lit("P"), "comid").alias("Permanent_Identifier"), F.col("comid").cast("double").alias("NHDPlusID"), F.col("areasqkm").alias("AreaSqKm"), "parts", F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), (F.col("lon") + 0.0104).alias("xmax"), F.col("lat").alias("ymax")
    )
    flow.write.parquet(f"{folder}/flow.parquet")
    routing = segments(spark, sf_dir, apart=True).select(F.concat(F.lit("P"), "comid").alias("Permanent_"), F.col("fromnode").alias("FromNode"), F.col("tonode").alias("ToNode"), F.col("hydroseq").alias("HydroSeq"))
    routing.write.csv(f"{folder}/vaa.csv", header=True)
    west, south, east, north = BASIN
    ring = f"[[[{west},{south}],[{east},{south}],[{east},{north}],[{west},{north}],[{west},{south}]]]"
    names = spark.createDataFrame([(f'{{"type":"Feature","properties":{{"basin_name":"{name}"}},"geometry":{{"type":"Polygon","coordinates":{shape}}}}}',) for name, shape in (("Lattice", ring), ("Elsewhere", "[[[0,0],[1,0],[1,1],[0,0]]]"))], "value string")
    names.write.text(f"{folder}/basin.geojsonl")
    placed = control_points(spark, sf_dir).drop("x", "y").join(at.withColumnRenamed("comid", "i"), F.col("i") == F.regexp_extract("UP_CP", r"[0-9]+", 0).cast("long"))
    rows = placed.select("UP_CP", "Next_DS_CP", "ChLosFac", F.col("lat").alias("LAT"), (F.col("lon") + 0.0052 + F.when(F.col("file_row") > 1_000_000, 0.5).otherwise(0.0)).alias("LONG"), "file_row")
    rows.repartitionByRange(1, "file_row").sortWithinPartitions("file_row").drop("file_row").write.csv(f"{folder}/cp.csv", header=True)
    pairs = crosswalk(spark, sf_dir)
    pairs.unionAll(pairs).write.csv(f"{folder}/gages.csv", header=True)
    flo_lines(spark, sf_dir, gap="nan").write.text(f"{folder}/flows.flo")
    names = {"flowline_source": "flow.parquet", "vaa_file": "vaa.csv", "basin_shp": "basin.geojsonl", "cp_meta_file": "cp.csv", "gage_crosswalk_file": "gages.csv", "flo_file": "flows.flo", "output_file": "out.csv"}
    return {option: f"{folder}/{name}" for option, name in names.items()}
