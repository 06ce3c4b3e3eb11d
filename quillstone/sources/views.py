"""Receipts, words and rasters made from the driver's tables, so that every operator has whole tables to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.functions.quantiles import kth_smallest

ITEMS = 5
MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, vendor, date (ISO), total (true), is_forged, shown_total: one receipt an order that has lines.

    Every fourth receipt shows a total raised by 100. Items, vendor and sums share one shuffle by order key.
    """
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    items = items.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    price = F.col("l_extendedprice").cast(MONEY)
    line = F.when(F.col("rn") <= ITEMS, F.struct("rn", F.concat_ws(" ", "p_name", price.cast("string")).alias("t")))
    grouped = items.groupBy("l_orderkey").agg(
        F.max(F.when(F.col("rn") == 1, F.concat("p_name", F.lit(" Store")))).alias("vendor"),
        F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n").alias("items"),
        F.sum(price).cast(MONEY).alias("subtotal"), F.sum(price * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY).alias("tax"),
    )
    both = grouped.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    forged = (F.col("l_orderkey") % 4 == 0).cast("int")
    total = (F.col("subtotal") + F.col("tax")).cast(MONEY)
    shown = F.when(forged == 1, total + F.lit(100).cast(MONEY)).otherwise(total).cast(MONEY)
    day, style = F.col("o_orderdate"), F.pmod(F.col("l_orderkey"), F.lit(6))
    written = F.date_format(day, "yyyy-MM-dd")
    for k, f in enumerate(("MM/dd/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMMM yyyy", "MM/dd/yy"), 1):
        written = F.when(style == k, F.date_format(day, f)).otherwise(written)
    text = F.concat_ws("\n", "vendor", F.concat(F.lit("Receipt Date: "), written), "items", F.concat(F.lit("Subtotal "), F.col("subtotal").cast("string")), F.concat(F.lit("Tax "), F.col("tax").cast("string")), F.concat(F.lit("TOTAL "), shown.cast("string")))
    return both.select(
        F.col("l_orderkey").alias("doc_id"), text.alias("text"), "vendor", F.date_format(day, "yyyy-MM-dd").alias("date"), total.cast("string").alias("total"), forged.alias("is_forged"), shown.cast("string").alias("shown_total"),
    )


def raster_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, y, x, v (0 to 255): each embedding of 64 numbers as an 8 by 8 gray image."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(F.col("e").cast("double") * 64 + 128)))
    return rows.select("vec_id", "label", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), v.alias("v"))


#: Units of a page that a pixel of its raster is wide and high, pages of a receipt, and the quality at which rasters are recompressed.
CELL, PAGES, QUALITY = 24, 2, 50


def receipt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, vec_id: two pages for each receipt, rasters laid on them in turn."""
    n = table(spark, sf_dir, "embeddings").count()
    ids = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    rows = ids.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(PAGES - 1))).alias("page_index"))
    return rows.withColumn("vec_id", F.pmod(F.col("doc_id") * PAGES + F.col("page_index"), F.lit(max(n, 1))))


def enlarged(pixels: DataFrame, times: int) -> DataFrame:
    """Each pixel of a raster as a square of times by times."""
    steps = F.sequence(F.lit(0), F.lit(times - 1))
    rows = pixels.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return rows.select("vec_id", "label", (F.col("y") * times + F.col("dy")).alias("y"), (F.col("x") * times + F.col("dx")).alias("x"), "v")


def synthetic_receipts(spark: SparkSession, n: int = 300, forged_rate: float = 0.25, seed: int = C.DEFAULT.seed) -> DataFrame:
    """n made-up records, see synthetic_records."""
    return synthetic_records(spark.range(n).withColumnRenamed("id", "n"), forged_rate, seed)


def synthetic_records(numbers: DataFrame, forged_rate: float = 0.25, seed: int = C.DEFAULT.seed) -> DataFrame:
    """id, image_path, vendor, date, total, label: a made-up record for each number n (distinct), int(count * forged_rate) of them forged, by seeded hashes of n.

    Those with the smallest hashes are forged; the last of these hashes is found by histograms.
    """
    numbers = numbers.select(F.col("n").cast("long").alias("id0"))

    def u(k: int):
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "id0"), 11) + 0.5) / float(1 << 53)

    def pick(values, k: int):
        return F.element_at(F.array(*map(F.lit, values)), F.floor(u(k) * len(values)).cast("int") + 1)

    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(0), "id0"), 12).cast("double")
    counts = numbers.groupBy(place.alias("v")).agg(F.count("*").alias("n"))
    total, low, high = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("v"), F.max("v")).first()
    wanted = int(total * forged_rate)
    last = kth_smallest(counts, wanted - 1, low, high) if wanted else -1.0
    below = counts.filter(F.col("v") < last).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if wanted else 0
    tie = F.row_number().over(Window.partitionBy("place").orderBy("id0")) <= wanted - below
    rows = numbers.withColumn("place", place)
    rows = rows.filter(F.col("place") != last).withColumn("forged", F.col("place") < last).unionByName(rows.filter(F.col("place") == last).withColumn("forged", tie)).drop("place")
    vendor = F.when(~F.col("forged"), pick(C.COMMON_VENDORS, 2)).when(u(1) < 0.3, pick(C.SUSPICIOUS_VENDORS, 3)).when(u(1) < 0.6, pick(C.COMMON_VENDORS, 2))
    wild = F.when(u(4) < 0.35, pick((100.0, 200.0, 500.0, 1000.0, 50.0, 250.0, 750.0), 5)).when(u(4) < 0.65, 800 + 1200 * u(6)).otherwise(0.01 + 1.99 * u(6))
    amount = F.when(F.col("forged"), wild).otherwise(F.greatest(F.lit(1.5), F.least(F.lit(150.0), -35 * F.log(u(7)))))
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.floor(u(8) * 731).cast("int"))
    weekday = F.weekday(day)
    moved = F.when(F.col("forged") & (u(9) < 0.5) & (weekday < 5), F.date_add(day, (F.lit(5) - weekday + F.floor(u(10) * 2)).cast("int"))).otherwise(day)
    date = F.when(F.col("forged") & (u(11) < 0.2), None).otherwise(F.date_format(moved, "yyyy-MM-dd"))
    name = F.format_string("syn%04d", "id0")
    return rows.select(
        name.alias("id"), F.concat(F.lit("dummy_data/train/"), name, F.lit(".png")).alias("image_path"), vendor.alias("vendor"), date.alias("date"),
        F.round(amount, 2).cast("string").alias("total"), F.struct(F.col("forged").cast("int").alias("is_forged")).alias("label"),
    )
