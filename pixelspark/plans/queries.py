"""The registered queries of the image operators and the SQL they are compared with.

Filters, morphology, noise and colours run on event images (16 x 16), transforms on embedding images (8 x 8), counts and sums on document images.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import filters as fi
from ..operators import frequency as fr
from ..operators import halo
from ..operators import histograms as hi
from ..operators import kernels as ke
from ..operators import metrics as me
from ..operators import morphology as mo
from ..operators import noise as no
from ..operators import regions as rg
from ..operators import restore as re_
from ..operators import wavelet as wa
from ..sources import fixtures as fx
from ..sources import images as im
from ..storage import shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PX = """px as (select event_id//256 image_id, ((event_id%256)//16)::int y, (event_id%16)::int x, least(255, floor(value))::double r, (json_extract(props,'$.k')::int*2)::double g,
  (user_id%256)::double b from events where event_id//256 < (select count(*)//256 from events))"""
S1 = PX + """, s1 as (select image_id, 'R' channel, y, x, r v from px union all select image_id, 'G', y, x, g from px union all select image_id, 'B', y, x, b from px)"""
S2 = """s2 as (select image_id, channel, ((i-1)//8)::int y, ((i-1)%8)::int x, round_even(greatest(0, least(255, 128+224*e)), 0) v from (
  select vec_id//3 image_id, case vec_id%3 when 0 then 'R' when 1 then 'G' else 'B' end channel, unnest(range(1, 65)) i, unnest(embedding)::double e
  from embeddings where vec_id//3 < (select count(*)//3 from embeddings)))"""
S3 = """s3 as (select doc_id image_id, ((p//3)//64)::int y, ((p//3)%64)::int x, case p%3 when 0 then 'R' when 1 then 'G' else 'B' end channel, ('0x'||substr(h, (2*p+1)::int, 2))::int::double v from (
  select doc_id, h, unnest(range((length(h)//2//192)*192)) p from (select doc_id, hex(encode(text)) h from documents)))"""
GRAY = PX + ", g8 as (select image_id, y, x, (r::int*9798 + g::int*19235 + b::int*3735 + 16384) >> 15 v from px)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if sql.startswith("select") else "with " + sql
        return f

    return register


def r(c: str | Column, digits: int = 4) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def reflect(e: str, n: int = 16) -> str:
    p = 2 * (n - 1)
    return f"(case when ((({e})%{p})+{p})%{p} < {n} then ((({e})%{p})+{p})%{p} else {p}-((({e})%{p})+{p})%{p} end)"


def weights(k) -> str:
    n = len(k) // 2
    return "kw(dy, dx, w) as (values " + ", ".join(f"({i - n}, {j - n}, {float(k[i, j])!r}::double)" for i in range(len(k)) for j in range(len(k))) + ")"


def convolution(k, out: str = "round(sum(t.v * kw.w), 4) + 0.0 v") -> str:
    return f"{S1}, {weights(k)} select s.image_id, s.channel, s.y, s.x, {out} from s1 s, kw, s1 t where t.image_id = s.image_id and t.channel = s.channel and t.y = {reflect('s.y+kw.dy')} and t.x = {reflect('s.x+kw.dx')} group by all"


def ev(spark, d):
    return fx.event_pixels(spark, d)


def ev_samples(spark, d):
    return ch.split_channels(fx.event_pixels(spark, d))


def ev_lines(spark, d):
    return im.to_scanlines(ev_samples(spark, d))


def emb(spark, d):
    return fx.embedding_samples(spark, d)


def emb_lines(spark, d):
    return im.to_scanlines(emb(spark, d))


def emb_shape(spark, d):
    return me.shapes(emb(spark, d))


def gray(spark, d):
    return ch.to_gray8(ev(spark, d))


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


# sources


@query(f"{PX} select image_id, max(y)+1 height, max(x)+1 width, count(*) n_px, max(greatest(r, g, b)) <= 250 valid, case when max(greatest(r, g, b)) > 250 then 'out of range' end error from px group by image_id")
def s8_validate_images(spark, d):
    return im.validate_images(ev(spark, d), 0.0, 250.0)


#: Header of a 16 x 16 bitmap of 24 bits and 2,835 pixels a metre.
BMP_HEAD = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 822, 0, 0, 54, 40, 16, 16, 1, 24, 0, 768, 2835, 2835, 0, 0).hex().upper()


@query(f"{PX} select image_id, '{BMP_HEAD}' || string_agg(printf('%02X%02X%02X', trunc(b)::int, trunc(g)::int, trunc(r)::int), '' order by y desc, x) bmp from px group by 1")
def s6_encode_bmp(spark, d):
    return im.encode_bmp(ev(spark, d)).withColumn("bmp", F.hex("bmp"))


@query(f"{S1} select image_id, channel, y, list(v order by x) v from s1 group by all")
def s2_scanlines(spark, d):
    return ev_lines(spark, d)


# projections


@query(f"{S1} select image_id, channel, y, x, v from s1")
def p1_split_channels(spark, d):
    return ev_samples(spark, d)


@query(f"{PX} select * from px")
def p2_merge_channels(spark, d):
    return ch.merge_channels(ev_samples(spark, d))


@query(f"{S2} select image_id, channel, y, x, trunc(greatest(0, least(255, v * 1.3 - 20.5)))::int v from s2")
def p3_channel_as_grayscale(spark, d):
    return ch.channel_as_grayscale(emb(spark, d).withColumn("v", F.col("v") * 1.3 - 20.5))


@query(f"{PX} select image_id, y, x, 0 r, trunc(greatest(0, least(255, g)))::int g, 0 b from px")
def p4_channel_as_color(spark, d):
    return ch.channel_as_color(ev(spark, d), "G")


@query(f"{PX} select image_id, y, x, round_even(greatest(0, least(255, r * 1.5 - 30)), 0)::int r, round_even(greatest(0, least(255, g * 0.5)), 0)::int g, b::int b from px")
def p5_quantize(spark, d):
    return ch.quantize(ev(spark, d).withColumn("r", F.col("r") * 1.5 - 30).withColumn("g", F.col("g") * 0.5))


@query(f"{PX} select image_id, 'Y' channel, y, x, round(0.299::double*r + 0.587::double*g + 0.114::double*b, 4) v from px")
def p6_luminance(spark, d):
    return rounded(ch.luminance(ev(spark, d)), "v")


YCC = """select image_id, y, x, greatest(0, least(255, 0.299::double*r + 0.587::double*g + 0.114::double*b)) yy, greatest(0, least(255, -0.168736::double*r - 0.331264::double*g + 0.5::double*b + 128)) cb,
  greatest(0, least(255, 0.5::double*r - 0.418688::double*g - 0.081312::double*b + 128)) cr from px"""


@query(f"{PX} select image_id, y, x, round(yy, 4) yy, round(cb, 4) cb, round(cr, 4) cr from ({YCC})")
def p7_rgb_to_ycbcr(spark, d):
    return rounded(ch.rgb_to_ycbcr(ev(spark, d)), "yy", "cb", "cr")


@query(f"{GRAY} select image_id, y, x, v from g8")
def p8_to_gray8(spark, d):
    return gray(spark, d)


LIN = lambda c: f"(case when {c}/255 > 0.04045 then pow(({c}/255+0.055)/1.055, 2.4) else {c}/255/12.92 end)"
LAB = f""", li as (select *, {LIN('r')} lr, {LIN('g')} lg, {LIN('b')} lb from px), xyz as (select *, (0.412453::double*lr+0.357580::double*lg+0.180423::double*lb)/0.950456 cx, 0.212671::double*lr+0.715160::double*lg+0.072169::double*lb cy,
  (0.019334::double*lr+0.119193::double*lg+0.950227::double*lb)/1.088754 cz from li),
 ff as (select *, case when cx > 0.008856 then pow(cx, 1.0/3) else 7.787*cx+16.0/116 end fx, case when cy > 0.008856 then pow(cy, 1.0/3) else 7.787*cy+16.0/116 end fy,
  case when cz > 0.008856 then pow(cz, 1.0/3) else 7.787*cz+16.0/116 end fz, case when cy > 0.008856 then 116*pow(cy, 1.0/3)-16 else 903.3*cy end ll from xyz),
 lab as (select image_id, y, x, round_even(greatest(0, least(255, ll*255/100)), 0)::int l, round_even(greatest(0, least(255, 500*(fx-fy)+128)), 0)::int a, round_even(greatest(0, least(255, 200*(fy-fz)+128)), 0)::int b from ff)"""


@query(f"{PX}{LAB} select * from lab")
def p9_rgb_to_lab8(spark, d):
    return ch.rgb_to_lab8(ev(spark, d))


@query()
def p9_lab8_to_rgb(spark, d):
    return ch.lab8_to_rgb(ch.rgb_to_lab8(ev(spark, d)))


@query(f"{PX} select image_id, y, x, r::int - g::int r, g::int g, b::int - g::int b from px")
def p10_color_difference(spark, d):
    return ch.color_difference(ev(spark, d))


@query(f"{PX} select image_id, y, x, r::int r, g::int g, b::int b from px")
def p10_inverse_color_difference(spark, d):
    return ch.inverse_color_difference(ch.color_difference(ev(spark, d)))


@query(f"{S2} select image_id, channel, y, x, case when v - 128 >= 0 then 2*(v::bigint-128) else -2*(v::bigint-128)-1 end v from s2")
def p11_zigzag(spark, d):
    return ch.zigzag(emb(spark, d).withColumn("v", F.col("v") - 128))


@query(f"{S2} select image_id, channel, y, x, v::bigint - 128 v from s2")
def p11_unzigzag(spark, d):
    return ch.unzigzag(ch.zigzag(emb(spark, d).withColumn("v", F.col("v") - 128)))


@query(f"{S2} select image_id, channel, y, x, p::int plane, (((v::bigint * 65793) >> (8*p)) & 255)::int byte from s2, range(4) t(p)")
def p12_byte_planes(spark, d):
    return ch.byte_planes(emb(spark, d).withColumn("v", F.col("v").cast("long") * 65793))


@query(f"{S1} select a.image_id, a.channel, a.y, a.x, trunc(least(255, abs(a.v - b.v) * 4))::int v from s1 a join s1 b on a.image_id = b.image_id and a.channel = b.channel and a.y = b.y and b.x = 15 - a.x")
def p13_amplified_diff(spark, d):
    s = ev_samples(spark, d)
    return ch.amplified_diff(s, s.withColumn("x", 15 - F.col("x")))


@query(f"{S2}, e as (select image_id, min(v) lo, max(v) hi from s2 group by 1) select s2.image_id, channel, y, x, round(case when hi > lo then (v-lo)/(hi-lo) else 0 end, 6) v from s2 join e using (image_id)")
def p14_normalize_spectrum(spark, d):
    return rounded(ch.normalize_spectrum(emb(spark, d)), "v", digits=6)


@query(f"{PX} select image_id, y, x, round(yy, 4) yy, round(128+(cb-128)*5, 4) cb, round(128+(cr-128)*5, 4) cr from ({YCC})")
def p15_stretch_chroma(spark, d):
    return rounded(ch.stretch_chroma(ch.rgb_to_ycbcr(ev(spark, d))), "yy", "cb", "cr")


@query(f"{PX} select image_id, y-3 y, x-5 x, r, g, b from px where y between 3 and 12 and x between 5 and 11")
def p16_crop(spark, d):
    return ch.crop(ev(spark, d), 3, 5, 10, 7)


@query(f"{S1} select image_id, channel, y, x, v from s1 where channel in ('R', 'B')")
def p16_channel_subset(spark, d):
    return ch.channel_subset(ev_samples(spark, d), ("R", "B"))


# joins

CMP = "max(abs(d)) max_abs, round(avg(abs(d)), 4) mean_abs, round(avg(d*d), 4) mse, round(case when avg(d*d) = 0 then 1e9 else 10*log10(65025/avg(d*d)) end, 4) psnr, max(abs(d)) = 0 identical"


def _eighths() -> Column:
    return F.transform("v", lambda x: (F.floor(x / 8) * 8).cast("double"))


def _buckets(spark: SparkSession, d: str, table: str) -> int:
    """One bucket for about 64 MB of a table's files, eight at least."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
    return max(8, path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() >> 26)


def _shown(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("psnr", F.least("psnr", F.lit(1e9))), "mean_abs", "mse", "psnr")


@query(f"{S1} select image_id, {CMP} from (select image_id, v - case when image_id % 5 = 0 then v else floor(v / 4) * 4 end d from s1) group by image_id")
def j1_compare_images(spark, d):
    s = ev_samples(spark, d)
    return _shown(me.compare_images(s, s.withColumn("v", F.when(F.col("image_id") % 5 == 0, F.col("v")).otherwise(F.floor(F.col("v") / 4) * 4))))


@query(f"{S3} select image_id, {CMP} from (select image_id, v - floor(v / 8) * 8 d from s3) group by image_id")
def j1_compare_scanlines(spark, d):
    """Both versions stored by image, then joined without an exchange."""
    name, path = f"lines_{uuid.uuid4().hex}", shared_folder(spark, "lines")
    buckets = _buckets(spark, d, "documents")
    first = im.save_scanlines(fx.document_scanlines(spark, d), f"{name}_first", path, buckets)
    im.save_scanlines(first.withColumn("v", F.transform("v", lambda x: x - x % 8)), f"{name}_second", path, buckets, dealt=True)
    return _shown(me.compare_stored(spark, f"{name}_first", f"{name}_second"))


@query(f"{S3} select image_id, {CMP} from (select image_id, v - floor(v / 8) * 8 d from s3) group by image_id")
def j1_compare_versions(spark, d):
    return _shown(me.compare_versions(fx.document_scanlines(spark, d).withColumn("w", _eighths()), "v", "w"))


@query(f"{PX} select image_id, case when image_id % 3 = 0 then 'missing in second' when image_id % 3 = 1 then 'differs' else 'same' end status from px group by image_id")
def j2_check_same_shape(spark, d):
    p = ev(spark, d)
    return me.check_same_shape(p, p.filter((F.col("image_id") % 3 != 0) & ((F.col("image_id") % 3 != 1) | (F.col("y") < 9))))


@query(f"{S1}, {weights(ke.gaussian_kernel(0.5, 3))} select s.image_id, s.channel, s.y, s.x, kw.dy, kw.dx, t.v as value, round(kw.w, 9) weight, round(t.v * kw.w, 4) product from s1 s, kw, s1 t where t.image_id = s.image_id and t.channel = s.channel and t.y = {reflect('s.y+kw.dy')} and t.x = {reflect('s.x+kw.dx')}")
def j3_kernel_terms(spark, d):
    t = fi.kernel_terms(ev_samples(spark, d), ke.kernel_table(spark, "gaussian", sigma=0.5, ksize=3))
    return t.withColumn("weight", r("weight", 9)).withColumn("product", r("product"))


@query(f"{S3}, sh as (select image_id, max(y)+1 h, max(x)+1 w from s3 group by 1), z as (select *, least(1.0::double, 16.0/greatest(h, w)) k from sh), t as (select image_id, h, w, greatest(1, round_even(h*k, 0)::int) th, greatest(1, round_even(w*k, 0)::int) tw from z), "
       "c as (select s3.*, h, w, th, tw, unnest(range(y*th//h, ((y+1)*th-1)//h+1)) ty, x*tw//w a, ((x+1)*tw-1)//w b from s3 join t using (image_id)), e as (select *, unnest(range(a, b+1)) tx from c), "
       "f as (select *, (least((y+1)*th, (ty+1)*h)-greatest(y*th, ty*h))*(least((x+1)*tw, (tx+1)*w)-greatest(x*tw, tx*w)) wt from e) select image_id, channel, ty::int y, tx::int x, floor(sum(v*wt)/sum(wt)*10000 + 0.5)/10000 v from f group by all")
def j4_area_resize(spark, d):
    return me.area_resize_lines(fx.document_scanlines(spark, d, heights=True), 16).withColumn("v", F.floor(F.col("v") * 10000 + 0.5) / 10000)


@query(f"""{S2}, t as (select image_id, channel, y//2 y, x//2 x, avg(v) v from s2 group by all), c as (select *, v - avg(v) over (partition by image_id, channel) d from t), b as (select image_id, max(s) s from (select image_id, channel, sum(abs(d)) s from c group by all) group by 1)
  select c.image_id, channel, y::int y, x::int x, round(d, 4) + 0.0 v, round(greatest(1, s), 4) + 0.0 bound from c join b using (image_id)""")
def j4_spectrum_previews(spark, d):
    return rounded(me.spectrum_previews(emb(spark, d), 4, center=True), "v", "bound")


@query("select doc_id image_id, sha256(text || '|blur:5') job_key from documents where sha256(text || '|blur:5') not in (select sha256(text || '|blur:5') from documents where doc_id % 3 = 0)")
def j5_dedupe_jobs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("data"))
    done = docs.filter("image_id % 3 = 0").select(F.sha2(F.concat("data", F.lit(b"|blur:5")), 256).alias("job_key")).distinct()
    return me.dedupe_jobs(docs, done, "blur:5").select("image_id", "job_key")


@query(f"{S1}, h as (select image_id%2 k, channel, floor(v)::int bin, count(*) n from s1 group by all) select coalesce(a.channel, b.channel) channel, coalesce(a.bin, b.bin) bin, coalesce(a.n, 0) n_a, coalesce(b.n, 0) n_b from (select * from h where k = 0) a full join (select * from h where k = 1) b on a.channel = b.channel and a.bin = b.bin")
def j6_compare_histograms(spark, d):
    s = ev_samples(spark, d)
    half = lambda k: s.filter(F.col("image_id") % 2 == k).withColumn("image_id", F.lit(k))
    return hi.compare_histograms(half(0), half(1))


# aggregations


@query(f"{PX}, c as (select image_id, 'R' channel, floor(r)::int bin from px union all select image_id, 'G', floor(g)::int from px union all select image_id, 'B', floor(b)::int from px), t as (select * from c union all select image_id, 'Total', bin from c union all "
       "select image_id, 'Y', floor(0.299::double*r + 0.587::double*g + 0.114::double*b)::int from px) select image_id, channel, bin, count(*) n from t group by all")
def a1_histogram(spark, d):
    return hi.catalog_histograms(ev(spark, d))


@query(f"{S3} select image_id, channel, v::int bin, v lo, v+1 hi, count(*) n from s3 group by all")
def a1_document_histogram(spark, d):
    return hi.scanline_histogram(fx.document_scanlines(spark, d))


@query(f"{S3}, c as (select image_id, channel, v::int bin from s3 union all select image_id, 'Total', v::int from s3) select image_id, channel, bin, count(*) n from c group by all")
def a2_combined_histogram(spark, d):
    return hi.combined_histogram(im.to_samples(fx.document_scanlines(spark, d)))


@query(f"{PX} select image_id, 'Y' channel, bin, bin::double lo, bin+1::double hi, count(*) n from (select image_id, floor(0.299::double*r + 0.587::double*g + 0.114::double*b)::int bin from px) group by all")
def a3_luminance_histogram(spark, d):
    return hi.luminance_histogram(ev(spark, d))


@query(f"{S1} select image_id, channel, v::int bin, count(*) / 256.0::double p, 256::bigint counted from s1 group by all")
def a4_histogram_pdf(spark, d):
    return hi.histogram_pdf(ev_samples(spark, d))


@query(f"{S2}, q as (select image_id, channel, greatest(-64, least(64, v::int - 128)) as value from s2) select image_id, channel, value, count(*) n, count(*) / 64.0::double share from q group by all")
def a5_value_distribution(spark, d):
    return hi.value_distribution(emb(spark, d).withColumn("v", F.col("v") - 128), -64, 64)


@query(f"{S3}, c as (select image_id, v, count(*) n from s3 group by all), p as (select image_id, n / sum(n) over (partition by image_id) p from c) select image_id, round(sum(-p*log2(p)), 5) + 0.0 bits from p group by 1")
def a6_entropy(spark, d):
    return rounded(hi.entropy(im.to_samples(fx.document_scanlines(spark, d))), "bits", digits=5)


@query(f"{S2} select image_id, round(100*avg(case when abs(v-128) <= 20 then 1.0 else 0 end), 4) percent from s2 group by 1")
def a7_near_zero_fraction(spark, d):
    return rounded(hi.near_zero_fraction(emb(spark, d).withColumn("v", F.col("v") - 128), 20), "percent")


@query(f"{S3} select image_id, channel, sum(v*v) energy from s3 group by all")
def a8_channel_energy(spark, d):
    return me.channel_energy(im.to_samples(fx.document_scanlines(spark, d)))


@query(f"{S3}, e as (select image_id, channel, count(*)*sum(v*v) energy from s3 group by all) select image_id, channel, energy, round(energy/sum(energy) over (partition by image_id), 6) share from e")
def a9_energy_share(spark, d):
    return rounded(me.energy_share(im.to_samples(fx.document_scanlines(spark, d))), "share", digits=6)


@query(f"{S1}, e as (select image_id, channel, var_pop(v)*count(*) energy from s1 group by all) select image_id, channel, round(energy, 2) energy, round(100*energy/sum(energy) over (partition by image_id), 4) percent from e")
def a10_centered_energy_share(spark, d):
    return me.centered_energy_share(ev_samples(spark, d)).withColumn("energy", r("energy", 2)).withColumn("percent", r("percent"))


@query(f"{PX} select image_id, round(corr(r, g), 6) rg, round(corr(g, b), 6) gb from px group by 1")
def a11_channel_correlation(spark, d):
    return rounded(me.channel_correlation(ev(spark, d)), "rg", "gb", digits=6)


@query(f"{GRAY} select image_id, count(*) filter (v > 200) n_set, count(*) filter (v > 200) / 256.0::double share, count(*) filter (v > 200) / 256.0 > 0.01 rejected from g8 group by 1")
def a12_mask_coverage(spark, d):
    g = gray(spark, d)
    return mo.mask_coverage(g.filter("v > 200").select("image_id", "y", "x"), me.shapes(g), 0.01)


@query(f"{PX}, m as (select image_id, avg(r) mr, avg(g) mg, avg(b) mb from px group by 1), k as (select image_id, greatest(0.5, least(2, (mr+mg+mb)/3/greatest(mr, 1))) kr, greatest(0.5, least(2, (mr+mg+mb)/3/greatest(mg, 1))) kg, greatest(0.5, least(2, (mr+mg+mb)/3/greatest(mb, 1))) kb from m) "
       "select px.image_id, y, x, round_even(least(255, r*0.25+r*kr*0.75), 0)::int r, round_even(least(255, g*0.25+g*kg*0.75), 0)::int g, round_even(least(255, b*0.25+b*kb*0.75), 0)::int b from px join k using (image_id)")
def a13_gray_world(spark, d):
    return me.gray_world(ev(spark, d), 0.75)


@query(f"{PX}{LAB}, q as (select image_id, quantile_cont(l, 0.01) lo, quantile_cont(l, 0.99) hi from lab group by 1) select lab.image_id, y, x, case when hi > lo then round_even(l*0.4::double + greatest(0, least(255, (l-lo)*255.0::double/(hi-lo)))*0.6::double, 0)::int else l end l, a, b from lab join q using (image_id)")
def a14_percentile_stretch(spark, d):
    return me.percentile_stretch(ch.rgb_to_lab8(ev(spark, d)), 0.6)


@query(f"{PX} select count(distinct image_id) images, count(*)*3 raw_bytes from px")
def a15_size_report(spark, d):
    return me.size_report(wa.wavelet_compress(ev(spark, d), 2)).select("images", "raw_bytes")


@query()
def a16_fourier_stats(spark, d):
    return rounded(fr.fourier_compress(emb_lines(spark, d), 99.0)[1], "retained_percent")


@query(f"{PX} select image_id::varchar as filter, 5 size, sum(g) sum_w, min(g) min_w, max(g) max_w, max(case when y = 2 and x = 2 then g end) centre_w from px where y < 5 and x < 5 group by image_id")
def a17_kernel_stats(spark, d):
    """A corner of each image as a kernel of its own."""
    k = ev(spark, d).filter("y < 5 and x < 5").select(F.col("image_id").cast("string").alias("filter"), (F.col("y") - 2).alias("dy"), (F.col("x") - 2).alias("dx"), F.col("g").alias("w"))
    return ke.kernel_stats(k)


@query(f"{S2} select image_id, channel, true ok from s2 group by all")
def a18_roundtrip_check(spark, d):
    return fr.roundtrip_check(emb_lines(spark, d)).select("image_id", "channel", "ok")


# windows


@query(convolution(ke.box_kernel(5)))
def w1_box_blur(spark, d):
    return rounded(fi.box_blur(ev_samples(spark, d), 5), "v")


@query(convolution(ke.gaussian_kernel(1.0)))
def w2_gaussian_blur(spark, d):
    return rounded(im.to_samples(fi.gaussian_blur(ev_lines(spark, d), 1.0)), "v")


@query(convolution(ke.unsharp_kernel(1.0, 1.5)))
def w3_unsharp_mask(spark, d):
    return rounded(im.to_samples(fi.unsharp_mask(ev_lines(spark, d), 1.0, 1.5)), "v")


@query(convolution(ke.laplacian_kernel(3, 0.8)))
def w4_laplacian_sharpen(spark, d):
    return rounded(fi.laplacian_sharpen_small(ev_samples(spark, d), 3, 0.8), "v")


@query(convolution(ke.laplacian_kernel(5, 0.1)))
def w4_laplacian_sharpen_large(spark, d):
    return rounded(im.to_samples(fi.laplacian_sharpen(ev_lines(spark, d), 5, 0.1)), "v")


@query(convolution(ke.gaussian_kernel(0.7, 3)))
def w6_convolve(spark, d):
    return rounded(fi.convolve_small(ev_samples(spark, d), ke.kernel_table(spark, "gaussian", sigma=0.7, ksize=3)), "v")


@query(convolution(ke.filter_kernel("unsharp", sigma=0.8, amount=1.0)))
def w5_filter_kernel(spark, d):
    return rounded(im.to_samples(fi.convolve(ev_lines(spark, d), ke.filter_kernel("unsharp", sigma=0.8, amount=1.0))), "v")


MEDIAN = f"{S1} select s.image_id, s.channel, s.y, s.x, median(t.v) v from s1 s, range(-1, 2) a(dy), range(-1, 2) b(dx), s1 t where t.image_id = s.image_id and t.channel = s.channel and t.y = greatest(0, least(15, s.y+dy)) and t.x = greatest(0, least(15, s.x+dx)) group by all"


@query(MEDIAN)
def w7_median_blur(spark, d):
    return im.to_samples(fi.median_blur(ev_lines(spark, d), 3))


@query(MEDIAN)
def w7_median_blur_small(spark, d):
    return fi.median_blur_small(ev_samples(spark, d))


@query(convolution(ke.np.outer(ke.gaussian_of_size(5), ke.gaussian_of_size(5)), "round_even(greatest(0, least(255, sum(t.v * kw.w))), 0) v"))
def w8_gaussian_denoise(spark, d):
    return im.to_samples(fi.gaussian_denoise(ev_lines(spark, d), 5))


@query()
def w9_nl_means(spark, d):
    return im.to_samples(fi.nl_means(ev_lines(spark, d), 15.0, patch=3, search=7))


def _near(of: str, fn: str, ry: int, rx: int) -> str:
    return f"(select s.image_id, s.y, s.x, {fn}(t.v) v from {of} s join {of} t on t.image_id = s.image_id and abs(t.y-s.y) <= {ry} and abs(t.x-s.x) <= {rx} group by all)"


@query(f"{GRAY}, e as {_near('g8', 'min', 2, 2)}, m as {_near('g8', 'max', 2, 2)} select e.image_id, e.y, e.x, e.v eroded, m.v dilated from e join m using (image_id, y, x)")
def w10_erode_dilate(spark, d):
    g = gray(spark, d)
    return mo.erode(g, 5, 5).withColumnRenamed("v", "eroded").join(mo.dilate(g, 5, 5).withColumnRenamed("v", "dilated"), ["image_id", "y", "x"])


TOPHAT = f"{GRAY}, e as {_near('g8', 'min', 2, 2)}, o as {_near('e', 'max', 2, 2)}, m as {_near('g8', 'max', 2, 2)}, c as {_near('m', 'min', 2, 2)}"


@query(f"{TOPHAT} select g8.image_id, y, x, g8.v - o.v v from g8 join o using (image_id, y, x)")
def w11_white_tophat(spark, d):
    return mo.white_tophat(gray(spark, d), 5, 5)


@query(f"{TOPHAT} select g8.image_id, y, x, c.v - g8.v v from g8 join c using (image_id, y, x)")
def w11_black_hat(spark, d):
    return mo.black_hat(gray(spark, d), 5, 5)


SCRATCH = f"{TOPHAT}, q as (select g8.image_id, y, x from g8 join o using (image_id, y, x) where g8.v - o.v >= 120), sm as (select distinct q.image_id, (q.y+dy)::int y, (q.x+dx)::int x from q, range(-1, 2) a(dy), range(-1, 2) b(dx) where q.y+dy between 0 and 15 and q.x+dx between 0 and 15)"


@query(f"{SCRATCH} select image_id, y, x from sm")
def w12_scratch_mask(spark, d):
    return mo.scratch_mask(gray(spark, d), 120, 5)


def _stripes(of: str, threshold: int) -> str:
    """The mask by its definition: every offset of every line (15 long, as on images up to 319 wide) at every candidate."""
    offsets = ", ".join(f"({rise}, {dy}, {dx})" for rise in (-2, -1, 0, 1, 2) for dy, dx in mo._line(rise, 15))
    window = lambda fn, t: f"(select image_id, y, x, v0, {fn}(v) over (partition by image_id, x order by y rows between 4 preceding and 4 following) v from {t})"
    return f"""lo(rise, dy, dx) as (values {offsets}), sh as (select image_id, max(y)+1 h, max(x)+1 w from {of} group by 1),
  st as (select image_id, y, x from (select image_id, y, x, v0 - v t from {window("max", window("min", f"(select *, v v0 from {of})"))}) where t >= {threshold}),
  hit as (select a.image_id, a.y, a.x, rise, count(b.x) n, count(*) filter (where a.y+dy between 0 and h-1 and a.x+dx between 0 and w-1) m
    from st a join sh using (image_id) cross join lo left join st b on b.image_id = a.image_id and b.y = a.y+dy and b.x = a.x+dx group by all having n = m),
  op as (select distinct hit.image_id, y+dy y, x+dx x from hit join lo using (rise) join sh using (image_id) where y+dy between 0 and h-1 and x+dx between 0 and w-1),
  ws as (select distinct op.image_id, (y+i)::int y, (x+j)::int x from op join sh using (image_id), range(-1, 2) a(i), range(-1, 2) b(j) where y+i between 0 and h-1 and x+j between 0 and w-1)"""


@query(f"{S3}, p3 as (select image_id, y, x, max(case when channel = 'R' then v end)::int r, max(case when channel = 'G' then v end)::int g, max(case when channel = 'B' then v end)::int b from s3 group by all), "
       f"g3 as (select image_id, y, x, (r*9798 + g*19235 + b*3735 + 16384) >> 15 v from p3), {_stripes('g3', 4)} select image_id, y, x from ws")
def w13_white_stripe_mask(spark, d):
    return mo.white_stripe_mask_lines(ch.gray8_lines(fx.document_pixel_lines(spark, d)), 4)


@query(f"{GRAY}, {_stripes('g8', 20)} select image_id, y, x from ws")
def w13_white_stripe_mask_events(spark, d):
    return mo.white_stripe_mask(gray(spark, d), 20)


@query(f"{SCRATCH}, wn as (select image_id, wy, wx, count(*) n from sm, range(0, 12) a(wy), range(0, 12) b(wx) where y between wy and wy+4 and x between wx and wx+4 group by all), k as (select *, row_number() over (partition by image_id order by n desc, wy, wx) k from wn) select image_id, wy::int y, wx::int x, n n_set from k where k = 1")
def w14_densest_window(spark, d):
    g = gray(spark, d)
    return mo.densest_window(mo.scratch_mask(g, 120, 5), me.shapes(g), 5)


@query(f"{S2}, h as (select image_id, channel, y, v::int bin, count(*) n from s2 group by all), g as (select a.image_id, a.channel, a.y, b.bin from (select distinct image_id, channel, y from s2) a join (select distinct image_id, channel, bin from h) b using (image_id, channel)) "
       "select g.image_id, g.channel, g.y, g.bin, sum(coalesce(h.n, 0)) over (partition by g.image_id, g.channel, g.bin order by g.y)::bigint n from g left join h using (image_id, channel, y, bin)")
def w15_prefix_histogram(spark, d):
    return hi.prefix_histogram(emb(spark, d))


@query(f"{S1}, n as (select *, coalesce(lag(v) over (partition by image_id, channel, y order by x), 0)::int a, coalesce(lag(v) over (partition by image_id, channel, x order by y), 0)::int b from s1), m as (select *, coalesce(lag(a) over (partition by image_id, channel, x order by y), 0)::int c, v::int u from n), "
       "p as (select image_id, y, k::int kind, u, case k when 0 then 0 when 1 then a when 2 then b when 3 then (a+b)//2 else case when abs(b-c) <= abs(a-c) and abs(b-c) <= abs(a+b-2*c) then a when abs(a-c) <= abs(a+b-2*c) then b else c end end q from m, range(5) t(k)), "
       "z as (select image_id, y, kind, sum(least(((u-q)%256+256)%256, 256-((u-q)%256+256)%256))::bigint score from p group by all) select image_id, y, kind, score, row_number() over (partition by image_id, y order by score, kind) = 1 best from z")
def w16_scanline_predictors(spark, d):
    return mo.scanline_predictors(ev(spark, d))


@query(f"{S1}, t as (select image_id, channel, y, x, v, avg(v) over (partition by image_id, channel) m from s1) select image_id, channel, y, x, round(v, 4) v from s1 where channel <> 'R' union all select * from (" + convolution(ke.box_kernel(3)).replace(S1 + ", ", "with ", 1) + ") where channel = 'R'")
def w17_channel_filter(spark, d):
    return rounded(fi.channel_filter(ev_samples(spark, d), "R", lambda s: fi.box_blur(s, 3)), "v")


@query(f"{PX} select image_id, true matches from px group by 1")
def w18_per_channel_and_merged(spark, d):
    return fi.compare_per_channel_and_merged(ev_samples(spark, d), lambda s: fi.box_blur(s, 7)).select("image_id", "matches")


# ranking and frequency

DFT = S2 + """, f as (select image_id, channel, ky::int ky, kx::int kx, sum(v*cos(2*pi()*((ky*y+kx*x)%8)/8)) re, -sum(v*sin(2*pi()*((ky*y+kx*x)%8)/8)) im from s2, range(8) a(ky), range(8) b(kx) group by all)"""
PAIRS = DFT + """, hp as (select image_id, channel, ky*8+kx idx, case when ky*8+kx = ((8-ky)%8)*8+(8-kx)%8 then 1 else 2 end weight, (re*re+im*im)/64 en, re/8 re, im/8 im from f where ky*8+kx <= ((8-ky)%8)*8+(8-kx)%8), pe as (select *, en*weight e from hp)"""


@query(f"{PAIRS} select image_id, channel, idx, row_number() over (partition by image_id, channel order by idx <> 0, round(e, 6) desc, idx)::int place, round(e, 6) + 0.0 e from pe")
def k1_rank_pairs(spark, d):
    pairs = stored(fr.half_plane(fr.fft2(emb_lines(spark, d), norm="ortho"), emb_shape(spark, d)).withColumn("e", r("e", 6)), "pairs")
    return fr.rank_pairs(pairs).select("image_id", "channel", "idx", "place", "e")


PRUNE = PAIRS + """, t as (select *, sum(e) over (partition by image_id, channel) tot, sum(case when idx = 0 then e else 0 end) over (partition by image_id, channel) dc,
  coalesce(sum(case when idx = 0 then 0 else e end) over (partition by image_id, channel order by idx <> 0, e desc, idx rows between unbounded preceding and 1 preceding), 0) bef from pe)"""


_KEPT = "idx = 0 or (tot*0.99-dc > 0 and bef < tot*0.99-dc)"
ORACLES["a16_fourier_stats"] = (
    f"with {PRUNE} select image_id, channel, round(case when sum(e) > 0 then 100*sum(case when {_KEPT} then e else 0 end)/sum(e) else 100 end, 4) + 0.0 retained_percent, "
    f"sum(case when {_KEPT} then weight else 0 end)::bigint kept, sum(weight)::bigint total from t group by all"
)


@query(f"{PRUNE} select image_id, channel, count(*) n, sum(weight)::bigint coefficients, round(sum(e), 1) energy from t where idx = 0 or (tot*0.99-dc > 0 and bef < tot*0.99-dc) group by all")
def k2_prune_energy(spark, d):
    pairs = stored(fr.half_plane(fr.fft2(emb_lines(spark, d), norm="ortho"), emb_shape(spark, d)), "pairs")
    return fr.prune_energy(pairs, 99.0).groupBy("image_id", "channel").agg(F.count("*").alias("n"), F.sum("weight").alias("coefficients"), r(F.sum("e"), 1).alias("energy"))


@query(f"{DFT}, e as (select image_id, channel, ky, kx, re*re+im*im e from f), c as (select *, row_number() over w k, sum(e) over w cum, sum(e) over (partition by image_id, channel) tot from e window w as (partition by image_id, channel order by e desc, ky, kx rows between unbounded preceding and current row)) "
       "select image_id, channel, count(*) n, min(case when cum >= tot*0.95 then k end) n_level, 100*min(case when cum >= tot*0.95 then k end)/64.0::double percent_level from c group by all")
def k3_energy_curve(spark, d):
    return fr.energy_curve(fr.fft2(emb_lines(spark, d)), 95.0)


@query(f"{PX} select image_id, ky::int ky, row_number() over (partition by image_id order by least(ky, 16-ky), ky)::int place from (select distinct image_id from px), range(16) t(ky)")
def k4_lowfreq_row_order(spark, d):
    return fr.lowfreq_row_order(me.shapes(ev(spark, d)))


@query(f"{S1} select image_id, channel, y, x, v from s1 union all select image_id, c, y, x, v from (select image_id, y, x, unnest(['Y', 'Cb', 'Cr']) c, round(unnest([yy, cb, cr]), 4) v from ({YCC}))")
def u1_stack_color_spaces(spark, d):
    return rounded(ch.stack_color_spaces(ev(spark, d)), "v")


@query(f"{SCRATCH} select image_id, y, x from sm union select image_id, y, x from g8 where v >= 200")
def u2_mask_union(spark, d):
    g = gray(spark, d)
    return mo.mask_union(mo.scratch_mask(g, 120, 5), g.filter("v >= 200"))


SHOWN = "select image_id, channel, ky, kx, round(re, 3) + 0.0 re, round(im, 3) + 0.0 im from f"


@query(f"{DFT} {SHOWN}")
def f1_fft2(spark, d):
    return rounded(fr.fft2(emb_lines(spark, d)), "re", "im", digits=3)


@query(f"{S2} select image_id, channel, y, x, v from s2")
def f2_ifft2(spark, d):
    back = im.to_samples(fr.ifft2(fr.fft2(emb_lines(spark, d)), emb_shape(spark, d)))
    return rounded(back, "v")


@query(f"{DFT} select image_id, channel, ky, kx, round(ln(1+sqrt(re*re+im*im)), 4) + 0.0 magnitude from f")
def f3_magnitude(spark, d):
    return rounded(fr.magnitude(fr.fft2(emb_lines(spark, d))), "magnitude")


@query(f"{DFT} select image_id, channel, ky, kx, (ky+4)%8 sy, (kx+4)%8 sx from f")
def f4_fftshift_index(spark, d):
    return fr.fftshift_index(fr.fft2(emb_lines(spark, d)), emb_shape(spark, d)).drop("re", "im")


@query(f"{S2} select image_id, channel, y, x, case when channel = 'B' then 0 else v end v from s2")
def f5_partial_reconstruct(spark, d):
    return rounded(im.to_samples(fr.partial_reconstruct(emb_lines(spark, d), ("R", "G"))), "v")


@query(f"{DFT} {SHOWN}")
def f6_dft_sql(spark, d):
    return rounded(fr.dft_sql(emb(spark, d)), "re", "im", digits=3)


@query(f"{PRUNE} select image_id, channel, count(*) n, sum(idx)::bigint idx_sum, round(sum(re::float::double), 2) + 0.0 re_sum from t where {_KEPT} group by all")
def f7_fourier_compress(spark, d):
    kept = fr.fourier_compress(emb_lines(spark, d), 99.0)[0]
    return kept.groupBy("image_id", "channel").agg(F.count("*").alias("n"), F.sum(F.col("idx").cast("long")).alias("idx_sum"), r(F.sum(F.col("re").cast("double")), 2).alias("re_sum"))


@query(f"{PRUNE}, a as (select image_id, count(*) n, sum(idx)::bigint idx_sum, round(sum(im::float::double), 2) + 0.0 im_sum from t where {_KEPT} group by image_id) select image_id, case image_id % 7 when 0 then 'truncated header' when 1 then 'wrong magic' end error, "
       "192::bigint raw_bytes, case when image_id % 7 > 1 then n end n, case when image_id % 7 > 1 then idx_sum end idx_sum, case when image_id % 7 > 1 then im_sum end im_sum from a")
def f7_fourier_archive(spark, d):
    """Packed and unpacked again; two of seven archives are damaged on the way."""
    archives = stored(fr.pack_coeffs(fr.fourier_compress(emb_lines(spark, d), 99.0)[0], emb_shape(spark, d)), "archives")
    hurt = F.when(F.col("image_id") % 7 == 0, F.expr("substring(archive, 1, 10)")).when(F.col("image_id") % 7 == 1, F.concat(F.lit(b"NONE"), F.expr("substring(archive, 5)"))).otherwise(F.col("archive"))
    good, bad = fr.unpack_coeffs(archives.withColumn("archive", hurt))
    sums = good.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("idx").alias("idx_sum"), r(F.sum(F.col("im").cast("double")), 2).alias("im_sum"))
    return archives.select("image_id", "raw_bytes").join(sums, "image_id", "left").join(bad, "image_id", "left")


@query(f"{S2} select image_id, channel, y, x, v from s2")
def f8_fourier_decompress(spark, d):
    return im.to_samples(fr.fourier_decompress(fr.fourier_compress(emb_lines(spark, d), 100.0)[0], emb_shape(spark, d)))


@query(f"{S2} select distinct image_id, true valid, null::varchar error from s2")
def f8_check_coeffs(spark, d):
    return fr.check_coeffs(fr.fourier_compress(emb_lines(spark, d), 99.0)[0], emb_shape(spark, d))


RATES = f"""{PRUNE}, lv(lvl) as (values (90.0::double), (99.0::double), (99.9::double)), kp as (select lvl, image_id, channel, idx//8 ky, idx%8 kx, weight, re::float::double re, im::float::double im
  from t, lv where idx = 0 or (tot*(lvl/100)-dc > 0 and bef < tot*(lvl/100)-dc)), bk as (select lvl, s.image_id, s.channel, s.y, s.x, s.v, round_even(greatest(0, least(255, sum(weight*(re*cos(2*pi()*((ky*y+kx*x)%8)/8) - im*sin(2*pi()*((ky*y+kx*x)%8)/8)))/8)), 0) w
  from s2 s join kp using (image_id, channel) group by all), ms as (select image_id, lvl, avg((v-w)*(v-w)) mse from bk group by all), ks as (select image_id, lvl, 100.0::double*sum(weight)/192 kept_percent from kp group by all)"""


@query(f"{RATES} select image_id, lvl \"level\", round(case when mse = 0 then 1e9 else 10*log10(65025/mse) end, 4) + 0.0 psnr, round(mse, 4) + 0.0 mse, round(kept_percent, 4) + 0.0 kept_percent from ms join ks using (image_id, lvl)")
def f9_rate_distortion(spark, d):
    rates = fr.rate_distortion(emb_lines(spark, d)).drop("archive_bytes", "ratio")
    return rounded(rates.withColumn("psnr", F.least("psnr", F.lit(1e9))), "psnr", "mse", "kept_percent")


@query()
def f9_archive_sizes(spark, d):
    return fr.rate_distortion(emb_lines(spark, d), (50.0, 99.0)).select("image_id", "level", "archive_bytes", "ratio")


@query()
def f10_remove_periodic_lines(spark, d):
    return im.to_samples(fr.remove_periodic_lines(fx.document_scanlines(spark, d), 4.0))


@query(f"{PX}, w as (select image_id, y i, avg(g) w from px where x < 8 group by all) select image_id::varchar as filter, k::int k, round(sqrt(pow(sum(w*cos(2*pi()*((k*i)%32)/32)), 2) + pow(sum(w*sin(2*pi()*((k*i)%32)/32)), 2)), 4) magnitude from w, range(17) t(k) group by all")
def f11_frequency_response(spark, d):
    rows = ev(spark, d).filter("x < 8").groupBy(F.col("image_id").cast("string").alias("filter"), F.col("y").alias("i")).agg(F.avg("g").alias("w"))
    return rounded(ke.frequency_response(spark, rows, 32), "magnitude")


@query(f"{DFT} select s.image_id, s.channel, s.y, s.x, round(sum(re*cos(2*pi()*((f.ky*s.y+f.kx*s.x)%8)/8) - im*sin(2*pi()*((f.ky*s.y+f.kx*s.x)%8)/8))/64, 3) + 0.0 v from s2 s join f using (image_id, channel) where f.ky in (0, 1, 7) group by all")
def f12_progressive_reconstruct(spark, d):
    return rounded(im.to_samples(fr.progressive_reconstruct(emb_lines(spark, d), 3)), "v", digits=3)


# wavelets


def _haar_sql(levels: int) -> str:
    parts, n = [S1 + ", h0 as (select image_id, channel, y, x, v::bigint v from s1)"], 16
    for k in range(levels):
        m = n // 2
        parts.append(f"x{k} as (select image_id, channel, y, x//2 x, max(case when x%2 = 0 then v end) a, max(case when x%2 = 1 then v end) b from h{k} where x < {n} and y < {n} group by all), "
                     f"r{k} as (select image_id, channel, y, x, a+floor((b-a)/2)::bigint v from x{k} union all select image_id, channel, y, x+{m}, b-a from x{k}), "
                     f"y{k} as (select image_id, channel, y//2 y, x, max(case when y%2 = 0 then v end) a, max(case when y%2 = 1 then v end) b from r{k} group by all), "
                     f"h{k + 1} as (select image_id, channel, y, x, a+floor((b-a)/2)::bigint v from y{k} union all select image_id, channel, y+{m}, x, b-a from y{k} union all select * from h{k} where x >= {n} or y >= {n})")
        n = m
    return ", ".join(parts)


@query(f"{_haar_sql(2)} select image_id, channel, y::int y, x::int x, v from h2")
def h1_haar_forward(spark, d):
    return wa.haar_forward(ev_samples(spark, d), 2)


@query(f"{S1} select image_id, channel, y, x, v::bigint v from s1")
def h2_haar_inverse(spark, d):
    return wa.haar_inverse(wa.haar_forward(ev_samples(spark, d), 4), 4)


@query(f"""{_haar_sql(2)}, n as (select image_id, case when x >= 8 or y >= 8 then 1 else 2 end "level", case when x >= 8 or y >= 8 then case when x >= 8 and y >= 8 then 'HH' when x >= 8 then 'HL' else 'LH' end
  when x >= 4 and y >= 4 then 'HH' when x >= 4 then 'HL' when y >= 4 then 'LH' else 'LL' end band, v, count(*) c from h2 group by all), t as (select *, sum(c) over (partition by image_id, "level", band) t from n)
  select image_id, "level", band, sum(c)::bigint n, sum(v*v*c)::double energy, round(-sum((c/t)*log2(c/t)), 4) + 0.0 entropy from t group by all""")
def h3_subband_stats(spark, d):
    return rounded(wa.subband_stats(wa.haar_forward(ev_samples(spark, d), 2), 2), "entropy")


@query(f"{PX} select image_id, 16 height, 16 width, 4 levels, 768::bigint raw_bytes from px group by 1")
def h4_wavelet_compress(spark, d):
    return wa.wavelet_compress(ev(spark, d), 4).select("image_id", "height", "width", "levels", "raw_bytes")


@query(f"{PX} select image_id, y, x, r::int r, g::int g, b::int b from px")
def h5_wavelet_decompress(spark, d):
    return wa.wavelet_decompress(wa.wavelet_compress(ev(spark, d), 3), 3)[0]


@query(f"{PX} select image_id, true identical from px group by 1")
def h6_verify_lossless(spark, d):
    p = ch.quantize(ev(spark, d))
    return wa.verify_lossless(p, wa.wavelet_decompress(wa.wavelet_compress(p, 2), 2)[0])


# noise and restoration

UNI = lambda seed, cols: f"((('0x'||substr(md5(concat_ws('|', '{seed}', {cols})), 1, 8))::bigint + 0.5)/4294967296)"


@query(f"{S1} select image_id, channel, y, x, round_even(greatest(0, least(255, v + 25*sqrt(-2*ln({UNI('7a', 'image_id, y, x, channel')}))*cos(2*pi()*{UNI('7b', 'image_id, y, x, channel')}))), 0)::int v from s1")
def n1_add_gaussian_noise(spark, d):
    return no.add_gaussian_noise(ev_samples(spark, d), 25.0, 7)


@query(f"{PX}, u as (select *, {UNI('7', 'image_id, y, x')} u from px) select image_id, y, x, case when u < 0.05 then 0 when u < 0.1 then 255 else r::int end r, case when u < 0.05 then 0 when u < 0.1 then 255 else g::int end g, case when u < 0.05 then 0 when u < 0.1 then 255 else b::int end b from u")
def n2_add_salt_pepper(spark, d):
    return no.add_salt_pepper(ev(spark, d), 10.0, 7)


@query()
def n3_noise_lab(spark, d):
    return no.noise_lab(ch.merge_channels(emb(spark, d)))


def _holes(pixels: DataFrame) -> DataFrame:
    """Scattered dots and short strokes: some regions of one pixel, some of many."""
    return pixels.filter("(y * 16 + x + image_id * 7) % 61 = 0 or (x + image_id) % 13 < 2 and y % 11 = 3")


@query()
def r1_inpaint(spark, d):
    p = ch.quantize(ev(spark, d))
    return re_.inpaint(p, _holes(p))


@query(f"""recursive {PX}, m as (select image_id, y, x, y::bigint * 4294967296 + x id from px where (y * 16 + x + image_id * 7) % 61 = 0 or ((x + image_id) % 13 < 2 and y % 11 = 3)),
  e as (select a.image_id, a.id a, b.id b from m a join m b on a.image_id = b.image_id and abs(a.y - b.y) <= 4 and abs(a.x - b.x) <= 4),
  c(image_id, id, o) as (select image_id, id, id from m union select c.image_id, c.id, e.b from c join e on e.image_id = c.image_id and e.a = c.o)
  select m.image_id, m.y, m.x, min(c.o) region from m join c using (image_id, id) group by all""")
def r1_damage_regions(spark, d):
    return rg.mask_regions(_holes(ev(spark, d)), 4)


@query()
def r2_remove_scratches(spark, d):
    return re_.remove_scratches(ch.merge_channels(emb(spark, d)), 60, 3)[0]


@query()
def r3_remove_stripes(spark, d):
    return re_.remove_stripes(ch.merge_channels(emb(spark, d)), 60)[0]


@query()
def r4_restore_photo(spark, d):
    return re_.restore_photo(ch.merge_channels(emb(spark, d)), lines=True, line_mode="periodic", period=4.0, scratches=True, scratch_threshold=60, scratch_size=5, denoise=True, tint=True, contrast=True)[0]


@query(f"{S1} select image_id, channel, y, x, 255-v v from s1")
def x1_apply_channels(spark, d):
    return im.to_samples(halo.apply_channels(ev_lines(spark, d), lambda a: 255 - a))


@query(convolution(ke.box_kernel(5)))
def x2_filter_registry(spark, d):
    return rounded(fi.filter_named("box")[0](ev_samples(spark, d), ksize=5), "v")


@query(convolution(ke.gaussian_kernel(1.0)))
def x2_gaussian_named(spark, d):
    return rounded(fi.filter_named("gaussian")[0](ev_samples(spark, d), sigma=1.0), "v")


@query(convolution(ke.unsharp_kernel(1.0, 1.5)))
def x2_unsharp_named(spark, d):
    return rounded(im.to_samples(fi.filter_named("unsharp")[0](ev_lines(spark, d), sigma=1.0)), "v")


@query(convolution(ke.laplacian_kernel(3, 1.0)))
def x2_laplacian_named(spark, d):
    return rounded(fi.filter_named("laplacian")[0](ev_samples(spark, d)), "v")
