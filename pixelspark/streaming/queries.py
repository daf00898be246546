"""Registered streaming queries: each reads its table as a stream to its end and returns what a batch query over the same rows gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.queries import PX, S2, QUERIES, rounded
from ..storage import shared_folder
from . import accumulators as acc

ORACLES: dict[str, str] = {}
STREAMS: dict = {}


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    table = spark.read.parquet(path)
    one = table.select(F.input_file_name().alias("f")).first()
    stream = spark.readStream.schema(table.schema)
    if one is not None and one.f.endswith(f"/{name}.parquet"):  # a stream reads folders, and the table is a single file
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return stream.parquet(path)


def _event_samples(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/events.parquet").count() // 256
    e = _stream(spark, d, "events").filter(F.col("event_id") < n * 256)
    p = e.select(F.expr("event_id div 256").alias("image_id"), F.expr("cast((event_id % 256) div 16 as int)").alias("y"), F.least(F.lit(255), F.floor("value")).cast("double").alias("r"), (F.col("user_id") % 256).cast("double").alias("b"))
    return p.select("image_id", "y", F.expr("stack(2, 'R', r, 'B', b) as (channel, v)"))


def t1_stream_histogram(spark: SparkSession, d: str) -> DataFrame:
    return acc.run_to_end(acc.stream_histogram(_event_samples(spark, d), total=("R", "B")), _folder(spark))


def t5_stream_retraction(spark: SparkSession, d: str) -> DataFrame:
    """Every third event is taken back as soon as it has come."""
    n = spark.read.parquet(f"{d}/events.parquet").count() // 256
    e = _stream(spark, d, "events").filter(F.col("event_id") < n * 256)
    sign = F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1))))
    s = e.select(F.expr("event_id div 256").alias("image_id"), F.lit("R").alias("channel"), F.least(F.lit(255), F.floor("value")).cast("double").alias("v"), sign.alias("sign"))
    return acc.run_to_end(acc.stream_histogram(s, sign="sign"), _folder(spark))


def t4_stream_progress(spark: SparkSession, d: str) -> DataFrame:
    return acc.run_to_end(acc.stream_progress(_event_samples(spark, d).select("image_id", "y"), 16), _folder(spark))


def t4_stream_completion(spark: SparkSession, d: str) -> DataFrame:
    """Lines of event images in eight files, one a batch; every fifth line comes again a file later, every seventh image lacks a line, and a last row a year later closes all."""
    folder = _folder(spark)
    e = spark.read.parquet(f"{d}/events.parquet").select(F.expr("event_id div 256").alias("image_id"), F.expr("cast((event_id % 256) div 16 as int)").alias("y"), "ts")
    lines = e.groupBy("image_id", "y").agg(F.max("ts").alias("at")).filter("image_id % 7 <> 3 or y <> 5")
    again = lines.filter("(image_id * 16 + y) % 5 = 0").withColumn("at", F.col("at") + F.expr("interval 1 second"))
    end = lines.agg(F.lit(-1).cast("long").alias("image_id"), F.lit(-1).alias("y"), (F.max("at") + F.expr("interval 1 year")).alias("at"))
    lines.union(again).repartitionByRange(8, "at").write.parquet(f"{folder}/lines")
    end.write.mode("append").parquet(f"{folder}/lines")  # the source takes files by their age
    arriving = spark.readStream.schema("image_id long, y int, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/lines")
    return acc.run_appending(acc.stream_completion(arriving, 16, "30 days"), folder)[0]


def _embedding_lines(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/embeddings.parquet").count() // 3
    e = _stream(spark, d, "embeddings").filter(F.col("vec_id") < 3 * n)
    v = F.transform("embedding", lambda x: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 224 * x.cast("double")))))
    e = e.select(F.expr("vec_id div 3").alias("image_id"), F.expr("element_at(array('R', 'G', 'B'), cast(vec_id % 3 + 1 as int))").alias("channel"), v.alias("all"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"))
    return e.select("image_id", "channel", "y", F.slice("all", F.col("y") * 8 + 1, 8).alias("v"))


def t2_stream_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(acc.run_to_end(acc.stream_spectrum(_embedding_lines(spark, d), 8), _folder(spark)), "re", "im", digits=3)


def t3_stream_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    spectrum = acc.run_to_end(acc.stream_spectrum(_embedding_lines(spark, d), 8), folder)
    bins = F.array_sort(F.collect_list(F.struct("kx", "re", "im")))
    part = lambda name: F.transform("bins", lambda b: b[name]).alias(name)
    rows = spectrum.groupBy("image_id", "channel", "ky").agg(bins.alias("bins")).select("image_id", "channel", "ky", part("re"), part("im"))
    rows.repartitionByRange(4, "ky").write.parquet(f"{folder}/rows")  # low frequencies first
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")
    return rounded(acc.run_to_end(acc.stream_reconstruct(arriving, 8, 8), _folder(spark)), "v")


STREAMS = {f.__name__: f for f in (t1_stream_histogram, t2_stream_spectrum, t3_stream_reconstruct, t4_stream_progress, t4_stream_completion, t5_stream_retraction)}
ORACLES = {
    "t1_stream_histogram": f"with {PX}, c as (select image_id, 'R' channel, floor(r)::int bin from px union all select image_id, 'B', floor(b)::int from px), t as (select * from c union all select image_id, 'Total', bin from c) select image_id, channel, bin, count(*) n from t group by all",
    "t2_stream_spectrum": f"with {S2} select image_id, channel, ky::int ky, kx::int kx, round(sum(v*cos(2*pi()*((ky*y+kx*x)%8)/8)), 3) + 0.0 re, round(-sum(v*sin(2*pi()*((ky*y+kx*x)%8)/8)), 3) + 0.0 im from s2, range(8) a(ky), range(8) b(kx) group by all",
    "t3_stream_reconstruct": f"with {S2} select image_id, channel, y, x, v from s2",
    "t5_stream_retraction": f"with {PX} select image_id, 'R' channel, floor(r)::int bin, sum(case when (image_id*256 + y*16 + x) % 3 = 0 then 0 else 1 end)::bigint n from px group by all",
    "t4_stream_completion": """with l as (select distinct event_id//256 image_id, ((event_id%256)//16)::int y from events) select image_id, count(*) filter (where image_id % 7 <> 3 or y <> 5) done, count(*) filter (where image_id % 7 <> 3 or y <> 5) >= 16 complete,
      count(*) filter (where (image_id*16 + y) % 5 = 0 and (image_id % 7 <> 3 or y <> 5)) replayed from l group by 1""",
    "t4_stream_progress": f"with {PX} select image_id, count(distinct y) done, count(distinct y) >= 16 complete from px group by 1",
}
QUERIES |= STREAMS
