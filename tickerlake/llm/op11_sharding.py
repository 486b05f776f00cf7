"""Training shards by a two-pass external shuffle.

The first pass writes every record once, with a seeded hash that scatters records uniformly into buckets of a size
that fits in memory.  The second pass brings each bucket to a task of its own, puts it into random order
(Fisher-Yates, Spark's ``shuffle`` of an array) and writes it.  The buckets one after the other are a uniformly random order
of all records; the shards are cut from it, so that their counts of rows differ by one at most (law ``rows``).

Only DataFrame functions are used.  A record's bucket follows from its content and the seed, so one seed gives one
order whatever files the table is dealt over.  A bucket that grows too large (rows repeated in all columns share a
hash) is split by a row number that the first pass has written, as are its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake import session
from tickerlake.llm import common

#: Bytes of a bucket: a task holds about three times as much.  Shuffle partitions at most; beyond them buckets grow
#: (at 100 TB to 1 GB, for executors with 3 GB a core).
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 100_000
SHARDS = 8
SEED = 17


def weight(df: DataFrame) -> Column:
    """About how many bytes a row has: its texts and binaries, other nested columns as JSON, 8 for each column."""
    out = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            column = F.to_json(F.struct(column))
        elif not isinstance(field.dataType, T.StringType | T.BinaryType):
            continue
        out += F.coalesce(F.octet_length(column), F.lit(0))
    return out


def scattered(df: DataFrame, seed: int) -> DataFrame:
    """First pass, written: (row struct, bytes, mark, number); mark is the seeded hash of the row's content."""
    plain = [F.col(f"`{f.name}`") if not isinstance(f.dataType, T.MapType) else F.to_json(F.struct(f"`{f.name}`")) for f in df.schema]
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    out, path = df.select(row.alias("row"), weight(df).alias("bytes"), F.xxhash64(F.lit(seed), *plain).alias("mark"), F.monotonically_increasing_id().alias("number")), session.work_dir(df.sparkSession, "scattered")
    out.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def split(n: int, shards: int) -> Column:
    """The shard of a position among n rows: consecutive stretches, the first n % shards of them one row longer."""
    each, more = divmod(n, shards)
    return F.when(F.col("position") < more * (each + 1), F.expr(f"position div {each + 1}")).otherwise(F.expr(f"{more} + (position - {more * (each + 1)}) div {max(each, 1)}")).cast("int")


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes all rows of df in random order to ``path/shard=K``, columns (slot long, row struct of df's columns).

    slot counts from 0 in each shard without gaps.  Nulls in any column, empty texts, repeated rows and columns with
    any name are kept as they are; each row is written once.  A row larger than bucket_bytes makes a bucket with
    those that share its hash.  An empty table writes no file; with fewer rows than shards the last shards are empty.
    The order follows from content and seed; only which of two rows equal in all columns comes first does not.
    """
    rows = scattered(df, seed)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).head()
    buckets = min(MOST_BUCKETS, max(1, -(-total // bucket_bytes)))
    most = max(bucket_bytes, -(-total // buckets))
    bucket = F.pmod("mark", F.lit(buckets)).alias("bucket")
    # buckets that came out over twice their size are split by row number; one row a bucket, MOST_BUCKETS at most
    sizes = rows.groupBy(bucket).agg(F.sum("bytes").alias("held"), F.count("*").alias("n"))
    parts = F.when((F.col("held") > 2 * most) & (F.col("n") > 1), F.ceil(F.col("held") / most)).otherwise(1)
    sizes = session.stage(sizes.select("bucket", parts.cast("int").alias("parts")), "buckets")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.lit(seed), "number"), "parts")).otherwise(0).alias("part")
    counts = rows.select(bucket, "number").join(sizes, "bucket").groupBy("bucket", part).agg(F.count("*").alias("n"))
    # one row for each written bucket: 2 * MOST_BUCKETS at most in this window, and in the join below
    ahead = Window.orderBy("bucket", "part")
    before = F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = counts.select("bucket", "part", (F.row_number().over(ahead) - 1).alias("task"), before.alias("before"))
    place = session.stage(place.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct("task", "before")))).alias("places")).join(sizes, "bucket"), "places")
    tasks = place.agg(F.sum(F.size("places"))).head()[0] or 1
    placed = rows.withColumn("bucket", bucket).join(F.broadcast(place), "bucket").withColumn("place", F.element_at("places", part))
    dealt = placed.select(F.col("place.task").alias("task"), F.col("place.before").alias("before"), "mark", "number", "row").repartitionById(tasks, F.col("task"))
    # sorted first, so that a task that runs again shuffles the same array from the same seed
    pools = dealt.sortWithinPartitions("task", "mark", "number").groupBy("task", "before").agg(F.collect_list("row").alias("rows"))
    mixed = pools.select("before", F.posexplode(F.shuffle("rows", seed)).alias("at", "row")).select((F.col("before") + F.col("at")).alias("position"), "row")
    each, more = divmod(n, shards)
    first = F.col("shard") * each + F.least("shard", F.lit(more))
    mixed.withColumn("shard", split(n, shards)).select("shard", (F.col("position") - first).alias("slot"), "row").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """(slot, row, shard) of written shards; row is the schema of the table that was written."""
    return spark.read.schema(T.StructType([T.StructField("slot", T.LongType()), T.StructField("row", row), T.StructField("shard", T.IntegerType())])).parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    path = session.work_dir(spark, "shards")
    write_shards(docs, path)
    return described(read_shards(spark, path, docs.schema))


def described(shards: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of shards of documents; a null text has no bytes."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return shards.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
