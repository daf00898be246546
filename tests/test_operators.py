"""Operators against plain NumPy and identities: awkward shapes, partition counts, damaged archives, sources and sinks."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.operators import channels as ch
from pixelspark.operators import filters as fi
from pixelspark.operators import frequency as fr
from pixelspark.operators import halo
from pixelspark.operators import histograms as hi
from pixelspark.operators import kernels as ke
from pixelspark.operators import metrics as me
from pixelspark.operators import morphology as mo
from pixelspark.operators import noise as no
from pixelspark.operators import regions as rg
from pixelspark.operators import restore as re_
from pixelspark.operators import wavelet as wa
from pixelspark.sources import images as im

SHAPES = [(1, 1), (1, 19), (17, 1), (15, 17), (32, 32)]


def images(spark, seed=42, shapes=SHAPES):
    r = np.random.default_rng(seed)
    arrays = {i: r.integers(0, 256, (*s, 3)).astype(float) for i, s in enumerate(shapes)}
    rows = [(i, y, x, *map(float, a[y, x])) for i, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return arrays, spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double")


def planes(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.image_id, r.channel), []).append((r.y, r.x, r.v))
    made = {}
    for k, v in out.items():
        a = np.zeros((max(t[0] for t in v) + 1, max(t[1] for t in v) + 1))
        for y, x, z in v:
            a[y, x] = z
        made[k] = a
    return made


def correlated(a, k):
    r = len(k) // 2
    fold = lambda i, n: np.zeros_like(i) if n == 1 else np.where(np.mod(i, 2 * (n - 1)) < n, np.mod(i, 2 * (n - 1)), 2 * (n - 1) - np.mod(i, 2 * (n - 1)))
    p = a[fold(np.arange(-r, a.shape[0] + r), a.shape[0])][:, fold(np.arange(-r, a.shape[1] + r), a.shape[1])]
    return sum(k[i, j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(len(k)) for j in range(len(k)))


def test_filters_on_awkward_shapes(spark):
    arrays, pixels = images(spark)
    samples = ch.split_channels(pixels)
    lines = im.to_scanlines(samples)
    cases = [
        (fi.box_blur(samples, 7), ke.box_kernel(7)), (im.to_samples(fi.gaussian_blur(lines, 1.5)), ke.gaussian_kernel(1.5)), (fi.laplacian_sharpen_small(samples, 1, 0.5), ke.laplacian_kernel(1, 0.5)),
        (fi.laplacian_sharpen_small(samples, 3, 0.5), ke.laplacian_kernel(3, 0.5)), (im.to_samples(fi.unsharp_mask(lines, 1.0, 1.5)), ke.unsharp_kernel(1.0, 1.5)),
        (im.to_samples(halo.halo_map(lines, lambda b: fi._correlated(b, ke.box_kernel(5)), 2, band=4)), ke.box_kernel(5)),
    ]
    for df, kernel in cases:
        got = planes(df)
        for i, a in arrays.items():
            for c, name in enumerate("RGB"):
                assert np.allclose(got[i, name], correlated(a[:, :, c], kernel), atol=1e-8)


def test_partition_counts_change_nothing(spark):
    _, pixels = images(spark, 3)
    for n in (1, 7, 64):
        s = ch.split_channels(pixels.repartition(n))
        rows = (fi.box_blur(s, 3).orderBy("image_id", "channel", "y", "x").collect(), hi.histogram(s).orderBy("image_id", "channel", "bin").collect())
        if n == 1:
            first = rows
        assert rows == first


def test_kernels():
    assert [len(ke.gaussian_1d(s)) for s in (0.1, 2, 3, 15)] == [3, 17, 25, 121]
    assert ke.laplacian(3).tolist() == [[2, 0, 2], [0, -8, 0], [2, 0, 2]]
    with pytest.raises(ValueError):
        ke.laplacian(4)
    with pytest.raises(ValueError):
        ke.filter_kernel("emboss")
    with pytest.raises(ValueError):
        fi.filter_named("emboss")


def test_haar(spark):
    one = spark.createDataFrame([(0, "R", 0, x, v) for x, v in enumerate([10, 14, 20, 26, 31])], "image_id long, channel string, y int, x int, v long")
    assert planes(wa.haar_forward(one, 1))[0, "R"].tolist() == [[12, 23, 31, 4, 6]]
    r = np.random.default_rng(7)
    a = r.integers(-255, 256, (31, 29))
    s = spark.createDataFrame([(0, "R", y, x, int(a[y, x])) for y in range(31) for x in range(29)], "image_id long, channel string, y int, x int, v long")
    assert np.array_equal(planes(wa.haar_inverse(wa.haar_forward(s, 8), 8))[0, "R"], a)
    for bad in (0, 9, 1.5):
        with pytest.raises(ValueError):
            wa.haar_forward(s, bad)


def test_archives(spark):
    arrays, pixels = images(spark, 1)
    archives = wa.wavelet_compress(pixels, 4)
    back, bad = wa.wavelet_decompress(archives, 4)
    assert bad.count() == 0 and all(r.identical for r in wa.verify_lossless(ch.quantize(pixels), back).collect())
    whole = {r.image_id: bytes(r.archive) for r in archives.select("image_id", "archive").collect()}[3]
    flipped = whole[:16] + bytes([whole[16] ^ 1]) + whole[17:]
    cases = [whole[:10], whole[:-3], whole + b"x", flipped, b"\x00" * 50, b"NOPE" + whole[4:]]
    damaged = spark.createDataFrame(list(enumerate(cases)), "image_id long, archive binary")
    pixels_, errors = wa.wavelet_decompress(damaged, 4)
    assert {r.image_id for r in errors.collect()} == set(range(6)) and pixels_.count() == 0


def test_fourier(spark):
    arrays, pixels = images(spark, 5)
    lines = im.to_scanlines(ch.split_channels(pixels))
    shape = me.shapes(pixels)
    for r in fr.roundtrip_check(lines).collect():
        assert r.ok
    pairs = fr.half_plane(fr.fft2(lines, norm="ortho"), shape)
    stats = {(r.image_id, r.channel): r for r in fr.fourier_compress(lines, 90.0)[1].collect()}
    for i, a in arrays.items():
        e = np.sort(np.abs(np.fft.fft2(a[:, :, 0], norm="ortho")) ** 2)
        assert stats[i, "R"].total == a[:, :, 0].size and stats[i, "R"].retained_percent >= 90 - 1e-9 and np.isclose(e.sum(), (a[:, :, 0] ** 2).sum())
    assert fr.prune_energy(pairs, 0).groupBy("image_id", "channel").count().filter("count <> 1").count() == 0
    coeffs, _ = fr.fourier_compress(lines, 100.0)
    back = planes(im.to_samples(fr.fourier_decompress(coeffs, shape)))
    assert all(np.array_equal(back[i, "G"], a[:, :, 1]) for i, a in arrays.items())
    broken = coeffs.withColumn("re", F.when((F.col("image_id") == 3) & (F.col("idx") == 0), F.lit(float("nan")).cast("float")).otherwise(F.col("re")))
    assert [r.image_id for r in fr.check_coeffs(broken, shape).filter("not valid").collect()] == [3]
    share = {(r.image_id, r.channel): r.energy for r in me.energy_share(ch.split_channels(pixels)).collect()}
    assert np.isclose(share[4, "B"], (np.abs(np.fft.fft2(arrays[4][:, :, 2])) ** 2).sum())


def test_validation_and_metrics(spark):
    _, pixels = images(spark)
    holes = pixels.filter("not (image_id = 3 and y = 2 and x = 2)").withColumn("r", F.when(F.col("image_id") == 1, float("nan")).otherwise(F.col("r")))
    got = {r.image_id: r.error for r in im.validate_images(holes).collect()}
    assert got == {0: None, 1: "not finite", 2: None, 3: "incomplete", 4: None}
    same = me.compare_images(ch.split_channels(pixels), ch.split_channels(pixels)).first()
    assert same.identical and same.psnr == float("inf")
    with pytest.raises(ValueError):
        hi.combined_histogram(ch.split_channels(pixels), ())


def test_median_and_noise(spark):
    arrays, pixels = images(spark, 9)
    s = ch.split_channels(pixels)
    small, banded = planes(fi.median_blur_small(s)), planes(im.to_samples(fi.median_blur(im.to_scanlines(s), 3)))
    for k, a in small.items():
        p = np.pad(arrays[k[0]][:, :, "RGB".index(k[1])], 1, mode="edge")
        want = np.median(np.lib.stride_tricks.sliding_window_view(p, (3, 3)).reshape(*a.shape, 9), axis=2)
        assert np.array_equal(a, want) and np.array_equal(banded[k], want)
    lines = im.to_scanlines(s)
    assert all(np.array_equal(a, np.rint(arrays[k[0]][:, :, "RGB".index(k[1])])) for k, a in planes(im.to_samples(fi.nl_means(lines, 0))).items())
    noisy = no.add_salt_pepper(pixels, 100.0)
    assert noisy.filter("(r not in (0, 255)) or r <> g or g <> b").count() == 0
    assert no.add_gaussian_noise(s, 0.0).join(s.withColumnRenamed("v", "w"), ["image_id", "channel", "y", "x"]).filter("v <> w").count() == 0
    numpy_noise = planes(ch.split_channels(no.add_gaussian_noise_numpy(pixels, 10.0, 42)))
    want = np.rint(np.clip(arrays[4] + np.random.default_rng(42).normal(0, 10, arrays[4].shape), 0, 255))
    assert np.array_equal(numpy_noise[4, "R"], want[:, :, 0])


def test_restoration(spark):
    flat = spark.range(40 * 40).select(F.lit(0).cast("long").alias("image_id"), F.expr("cast(id div 40 as int)").alias("y"), F.expr("cast(id % 40 as int)").alias("x"), *(F.lit(v).alias(c) for c, v in (("r", 90.0), ("g", 120.0), ("b", 60.0))))
    marked = flat.withColumns({c: F.when(F.col("x") == 20, 255.0).otherwise(F.col(c)) for c in "rgb"})
    fixed, mask, bad = re_.remove_scratches(marked, 30, 5)
    assert bad.count() == 0 and {r.x for r in mask.collect()} == {19, 20, 21}
    assert fixed.filter("r <> 90 or g <> 120 or b <> 60").count() == 0
    too_much = flat.withColumns({c: F.when(F.col("x") % 6 == 0, 255.0).otherwise(F.col(c)) for c in "rgb"})
    fixed, _, bad = re_.remove_scratches(too_much, 30, 5)
    assert bad.count() == 1 and fixed.count() == 0
    stripe = flat.withColumns({c: F.when(F.col("y") == 15, 255.0).otherwise(F.col(c)) for c in "rgb"})
    rows = {r.y for r in mo.white_stripe_mask(ch.to_gray8(stripe), 8).collect()}
    assert rows == {14, 15, 16}
    with pytest.raises(ValueError):
        re_.restore_photo(flat, period=1.0)


def test_sources_and_sinks(spark, tmp_path):
    arrays, pixels = images(spark, 2, [(5, 7)])
    bmp = bytes(im.encode_bmp(pixels).first().bmp)
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.bmp").write_bytes(bmp)
    (tmp_path / "files" / "broken.png").write_bytes(b"not an image")
    lines, bad = im.read_images(spark, str(tmp_path / "files"))
    got = planes(im.to_samples(lines.select("image_id", "channel", "y", "v")))
    assert all(np.array_equal(a, arrays[0][:, :, "RGB".index(k[1])]) for k, a in got.items()) and len(got) == 3
    assert bad.count() == 1 and len(bmp) == struct.unpack_from("<I", bmp, 2)[0] == 54 + 5 * 24
    s = im.to_scanlines(ch.split_channels(pixels))
    im.write_scanlines(s, str(tmp_path / "lines"))
    assert planes(im.to_samples(im.read_scanlines(spark, str(tmp_path / "lines")))).keys() == planes(im.to_samples(s)).keys()
    ke.write_kernel_csv(ke.kernel_table(spark, "box", ksize=3), str(tmp_path / "kernel"))
    assert spark.read.option("header", True).csv(str(tmp_path / "kernel")).count() == 9
    disc = planes(ch.split_channels(im.gen_gradient_circle(spark, 1, 20)))[0, "R"]
    assert disc[6, 14] == 255 and np.isclose(disc[19, 10], 10 * 255 / 19)
    assert {r.g for r in im.gen_stripes(spark, 1, 16).collect()} == {0.0, 255.0} and im.gen_radial(spark, 2, 8).count() == 128


def test_crc_of_spark_and_zlib_agree(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"pixels")).alias("c")).first().c == zlib.crc32(b"pixels")


def test_archives_of_any_number_of_levels_decode_together(spark):
    _, pixels = images(spark, 1, [(5, 7)])
    two = [wa.wavelet_compress(pixels.withColumn("image_id", F.col("image_id") * 10 + n), n).select("image_id", "archive").collect() for n in (1, 2)]
    archives = spark.createDataFrame([(r.image_id, r.archive) for rows in two for r in rows], "image_id long, archive binary")
    back, bad = wa.wavelet_decompress(archives)
    want = sorted((r.y, r.x, r.r, r.g, r.b) for r in ch.quantize(pixels.filter("image_id = 0")).collect())
    for n in (1, 2):
        assert sorted((r.y, r.x, r.r, r.g, r.b) for r in back.filter(F.col("image_id") == n).collect()) == want
    assert bad.count() == 0 and {r.error for r in wa.wavelet_decompress(archives, 2)[1].collect()} == {"another number of levels"}


def test_nl_means_equals_plain_loops(spark):
    r = np.random.default_rng(3)
    gray = np.rint(np.clip(r.normal(120, 25, (9, 11)), 0, 255))
    s = spark.createDataFrame([(0, c, y, x, float(gray[y, x])) for c in "RGB" for y in range(9) for x in range(11)], "image_id long, channel string, y int, x int, v double")
    got = planes(im.to_samples(fi.nl_means(im.to_scanlines(s), 20.0, patch=3, search=5)))
    light = fi._lab(np.stack([gray] * 3))
    fold = lambda i, n: abs(i) if abs(i) < n else 2 * (n - 1) - abs(i)

    def smooth(p, y, x):
        at = lambda a, b: p[fold(a, 9), fold(b, 11)]
        total = value = 0.0
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                d = sum((at(y + a, x + b) - at(y + dy + a, x + dx + b)) ** 2 for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
                total += np.exp(-d / 400)
                value += np.exp(-d / 400) * at(y + dy, x + dx)
        return value / total

    want = np.array([[smooth(light[0] * 2.55, y, x) / 2.55 for x in range(11)] for y in range(9)])
    rgb = np.rint(np.clip(fi._rgb(np.stack([want, light[1], light[2]])), 0, 255))
    assert max(np.abs(got[0, c] - rgb["RGB".index(c)]).max() for c in "RGB") <= 1


def test_small_images_are_filtered_many_at_a_time(spark):
    """Bands of one size come stacked, of several sizes apart, and every image gets its own result."""
    arrays, pixels = images(spark, 6, [(4, 4), (5, 7)] * 20)
    lines = im.to_scanlines(ch.split_channels(pixels)).coalesce(1)
    # The red plane as it is, and in the green one how many came together.
    fn = lambda b: np.stack([b[0, :, 1:-1, 1:-1], np.full(b[1, :, 1:-1, 1:-1].shape, b.shape[1]), b[2, :, 1:-1, 1:-1]])
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = planes(im.to_samples(halo.halo_map(lines, fn, 1, joint=("R", "G", "B"), stacked=True)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 120 and all(np.array_equal(got[i, c], a[:, :, "RGB".index(c)]) for i, a in arrays.items() for c in "RB")
    assert all((got[i, "G"] == 20).all() for i in arrays)


def test_histogram_of_lines_and_of_samples_agree(spark):
    rows = [(1, "R", 0, [0.0, 255.9, 256.0, float("nan")]), (1, "R", 1, [3.5, 3.0, -1.0, 300.0]), (1, None, 0, [7.0]), (2, "G", 0, []), (2, "G", 1, None), (None, "B", 0, [1.0, 1.0])]
    lines = spark.createDataFrame(rows, "image_id long, channel string, y int, v array<double>")
    samples = lines.select("image_id", "channel", "y", F.posexplode("v").alias("x", "v"))
    for bins in (256, 7):
        want = sorted(map(str, hi.histogram(samples, bins).collect()))
        assert sorted(map(str, hi.scanline_histogram(lines.repartition(2), bins).collect())) == want and want


def test_stored_scanlines_join_and_group_without_an_exchange(spark, tmp_path):
    rng = np.random.default_rng(2)
    lines = [(i, c, y, [float(v) for v in rng.integers(-20, 300, 5)]) for i in range(12) for c in "RGB" for y in range(4)]
    s = spark.createDataFrame(lines, "image_id long, channel string, y int, v array<double>")
    kept = im.save_scanlines(s, "stored_a", f"file://{tmp_path}", 4)
    halved = im.save_scanlines(kept.withColumn("v", F.transform("v", lambda x: x / 2)), "stored_b", f"file://{tmp_path}", 4, dealt=True)
    assert len(halved.inputFiles()) == len(kept.inputFiles()) <= 4
    want = {(i, c, y): [int(min(255, max(0, x))) for x in v] for i, c, y, v in lines}
    assert {(r.image_id, r.channel, r.y): r.v for r in kept.collect()} == want
    got = me.compare_stored(spark, "stored_a", "stored_b")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    other = {k: [x // 2 for x in v] for k, v in want.items()}
    for r in got.collect():
        d = np.array([[a - b for a, b in zip(want[k], other[k], strict=True)] for k in want if k[0] == r.image_id])
        assert (r.max_abs, r.mse) == (np.abs(d).max(), pytest.approx((d**2).mean()))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    same = me.compare_versions(s.withColumn("w", F.col("v")), "v", "w").collect()
    assert all(r.identical and r.psnr == float("inf") for r in same) and len(same) == 12


def test_transforms_in_blocks_equal_numpy_and_sql(spark):
    rng = np.random.default_rng(5)
    arrays = {(i, c): rng.normal(size=s) for i, s in enumerate([(70, 150), (1, 200), (130, 1), (5, 64), (33, 65)]) for c in "RG"}
    lines = spark.createDataFrame([(i, c, y, a[y].tolist()) for (i, c), a in arrays.items() for y in range(len(a))], "image_id long, channel string, y int, v array<double>").repartition(7)
    shape = spark.createDataFrame([(i, *a.shape) for (i, c), a in arrays.items() if c == "R"], "image_id long, height int, width int")
    for norm in (None, "ortho"):
        bins = fr.fft2(lines, norm)
        got = {k: np.zeros(a.shape, complex) for k, a in arrays.items()}
        for r in bins.collect():
            got[r.image_id, r.channel][r.ky, r.kx] = complex(r.re, r.im)
        assert all(np.allclose(got[k], np.fft.fft2(a, norm=norm), atol=1e-9) for k, a in arrays.items())
        back = planes(im.to_samples(fr.ifft2(bins, shape, norm)))
        assert all(np.allclose(back[k], a, atol=1e-9) for k, a in arrays.items())
    small = lines.filter("image_id in (3, 4)")
    a, b = ({(r.image_id, r.channel, r.ky, r.kx): (r.re, r.im) for r in d.collect()} for d in (fr.fft2(small), fr.dft_sql(im.to_samples(small))))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-7) for k in a)
    few = fr.fft2(lines).filter("ky = 0 and kx in (0, 70)")  # most blocks hold no bin
    back = planes(im.to_samples(fr.ifft2(few, shape)))
    want = np.fft.fft2(arrays[0, "R"])
    want[1:] = 0
    want[:, [x for x in range(150) if x not in (0, 70)]] = 0
    assert np.allclose(back[0, "R"], np.fft.ifft2(want).real, atol=1e-9)


def test_a_group_that_crosses_many_batches_is_joined_once():
    import pyarrow as pa

    from pixelspark.operators import planes as pl

    batches = [pa.record_batch([pa.array([k // 5 if k < 20 else None] * 3), pa.array([k, k, k])], names=["g", "v"]) for k in range(25)]
    got = [(g.column("g")[0].as_py(), g.column("v").to_pylist()) for g in pl.groups(iter(batches), ["g"])]
    assert got == [(i if i < 4 else None, [k for k in range(5 * i, 5 * i + 5) for _ in range(3)]) for i in range(5)]


def plain_haar(a, levels):
    """Lifting by loops over one plane."""
    a = a.astype(np.int64).copy()
    h, w = a.shape
    for _ in range(levels):
        for axis, n in ((1, w), (0, h)):
            part = a[:h, :w] if axis == 1 else a[:h, :w].T
            for line in part:
                s, d = [], []
                for i in range(0, n - 1, 2):
                    d.append(line[i + 1] - line[i])
                    s.append(line[i] + (d[-1] >> 1))
                line[:n] = [*s, *([line[n - 1]] if n % 2 else []), *d]
        h, w = (h + 1) // 2, (w + 1) // 2
    return a


def test_groups_keep_an_exchange_above_a_join_by_their_keys(spark):
    """Without it they came in pieces where the join became a broadcast one at run time (seen on 17,094 images)."""
    import pyarrow as pa

    from pixelspark.operators.planes import map_groups

    a, b = spark.range(64).selectExpr("id % 8 image_id", "id y"), spark.range(8).selectExpr("id image_id", "id n")
    made = map_groups(a.join(b.hint("merge"), "image_id"), ["image_id"], ["y"], lambda g: [pa.record_batch([g.column("image_id").slice(0, 1), pa.array([g.num_rows])], names=["image_id", "n"])], "image_id long, n long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert sorted((r.image_id, r.n) for r in made.collect()) == [(i, 8) for i in range(8)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_haar_equals_loops_with_one_exchange(spark, levels):
    rng = np.random.default_rng(levels)
    arrays = {(i, c): rng.integers(-300, 300, s) for i, s in enumerate([(1, 1), (1, 9), (11, 1), (13, 7), (32, 48)]) for c in "RB"}
    s = spark.createDataFrame([(i, c, y, x, float(v)) for (i, c), a in arrays.items() for (y, x), v in np.ndenumerate(a)], "image_id long, channel string, y int, x int, v double").repartition(5)
    forward = wa.haar_forward(s, levels)
    got = planes(forward)
    assert all(np.array_equal(got[k], plain_haar(a, levels)) for k, a in arrays.items())
    back = planes(wa.haar_inverse(forward, levels))
    assert all(np.array_equal(back[k], a) for k, a in arrays.items())
    for turn in (wa.haar_forward, wa.haar_inverse):
        assert turn(s, levels)._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1  # none a level


def test_regions_equal_a_flood_fill(spark):
    rng = np.random.default_rng(8)
    masks = {i: rng.random(s) < p for i, (s, p) in enumerate([((40, 150), 0.02), ((30, 30), 0.3), ((1, 90), 0.2), ((200, 3), 0.1), ((9, 9), 1.0)])}
    snake = np.zeros((21, 200), bool)  # one region of many turns
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks[9] = snake
    df = spark.createDataFrame([(i, int(y), int(x)) for i, m in masks.items() for y, x in np.argwhere(m) for _ in range(2)], "image_id long, y int, x int").repartition(5)
    for reach in (1, 4):
        want = {}
        for i, m in masks.items():
            left = {tuple(p) for p in np.argwhere(m).tolist()}
            while left:
                first = min(left)
                stack, left = [first], left - {first}
                while stack:
                    y, x = stack.pop()
                    want[i, y, x] = first[0] * 2**32 + first[1]
                    near = {(a, b) for a in range(y - reach, y + reach + 1) for b in range(x - reach, x + reach + 1)} & left
                    stack += near
                    left -= near
        got = {(r.image_id, r.y, r.x): r.region for r in rg.mask_regions(df, reach).collect()}
        assert got == want
    assert rg.mask_regions(df.limit(0)).count() == 0


def test_inpainting_by_regions_equals_marching_through_whole_images(spark):
    rng = np.random.default_rng(4)
    arrays = {i: rng.integers(0, 256, (*s, 3)) for i, s in enumerate([(24, 40), (17, 3), (6, 6)])}
    masks = {0: rng.random((24, 40)) < 0.04, 1: np.zeros((17, 3), bool), 2: np.ones((6, 6), bool)}
    masks[0][10:14, 20:26] = True
    masks[1][8] = True
    pixels = spark.createDataFrame([(i, y, x, *map(int, a[y, x])) for i, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id long, y int, x int, r int, g int, b int")
    holes = spark.createDataFrame([(i, int(y), int(x)) for i, m in masks.items() for y, x in np.argwhere(m)] + [(0, -2, 5)], "image_id long, y int, x int")
    got = {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in re_.inpaint(pixels, holes).collect()}
    for i, a in arrays.items():
        cells = {(y, x): a[y, x].astype(float) for y in range(a.shape[0]) for x in range(a.shape[1]) if not masks[i][y, x]}
        filled = re_._march(cells, {tuple(p) for p in np.argwhere(masks[i]).tolist()}, 3)
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                want = np.rint(np.clip(filled[y, x], 0, 255)) if (y, x) in filled else a[y, x]
                assert got[i, y, x] == tuple(want.astype(int).tolist())
    assert rg.mask_regions(holes, 4).filter("image_id = 0").select("region").distinct().count() > 3


def test_stripe_mask_equals_opening_by_every_offset(spark):
    rng = np.random.default_rng(6)
    for size, width in ((15, 40), (20, 400)):
        a = np.where(rng.random((30, width)) < 0.9, 0, 1)  # nearly all set: a background of 1s to lift below
        a = np.where((np.arange(30) % 4 == 0)[:, None] | (rng.random((30, width)) < 0.25), 200, 0) - a * 0
        a[:, ::97] = 0
        for rise in (-2, -1, 1, 2):  # exact lines of each slope, some across the border
            for top, left in ((12 + 3 * rise, 5), (1, width - 9), (28, -4)):
                for dy, dx in mo._line(rise, size):
                    if 0 <= top + dy < 30 and 0 <= left + dx + size // 2 < width:
                        a[top + dy, left + dx + size // 2] = 255
        df = spark.createDataFrame([(7, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v int")
        pad = lambda m, f: np.pad(m, ((4, 4), (0, 0)), constant_values=f)
        eroded = np.min([pad(a, 999)[i : i + 30] for i in range(9)], axis=0)
        opened = np.max([pad(eroded, -1)[i : i + 30] for i in range(9)], axis=0)
        candidate = {tuple(p) for p in np.argwhere(a - opened >= 50).tolist()}
        inside = lambda y, x: 0 <= y < 30 and 0 <= x < width  # noqa: B023, E731
        want = set()
        for rise in (-2, -1, 0, 1, 2):
            line = mo._line(rise, size)
            for y, x in candidate:
                to = [(y + dy, x + dx) for dy, dx in line if inside(y + dy, x + dx)]
                if all(p in candidate for p in to):
                    want |= {(p + i, q + j) for p, q in to for i in (-1, 0, 1) for j in (-1, 0, 1) if inside(p + i, q + j)}
        got = [(r.y, r.x) for r in mo.white_stripe_mask(df, 50).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_stripe_mask_of_lines_equals_that_of_pixels_with_one_exchange(spark, sf_dir):
    """Images of several bands, with stripes across their ends and at the borders; and the registered query shuffles lines once."""
    from pixelspark.plans.queries import QUERIES

    rng, rows = np.random.default_rng(8), []
    for i, (h, w) in enumerate([(1, 20), (9, 3), (30, 64), (2 * mo.BAND + 9, 40), (40, 420)]):
        a = rng.integers(0, 40, (h, w)) + 200 * (rng.random((h, w)) < 0.3)
        for y in (0, 3, h - 1, mo.BAND - 1, mo.BAND, 2 * mo.BAND - 2):
            if y < h:
                a[y, : w - 2] = 250
        rows += [(i, y, [float(v) for v in a[y]]) for y in range(h)]
    lines = spark.createDataFrame(rows, "image_id long, y int, v array<double>").repartition(3)
    pixels = lines.select("image_id", "y", F.posexplode("v").alias("x", "v")).withColumn("v", F.col("v").cast("int"))
    key = lambda df: sorted((r.image_id, r.y, r.x) for r in df.collect())
    got = key(mo.white_stripe_mask_lines(ch.gray8_lines(lines.selectExpr("image_id", "y", "v r", "v g", "v b")), 50))
    assert got == key(mo.white_stripe_mask(pixels, 50)) and {r[0] for r in got} >= {2, 3, 4}
    plan = QUERIES["w13_white_stripe_mask"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_thumbnails_of_lines_equal_those_of_samples_and_only_they_are_shuffled(spark, sf_dir):
    from pixelspark.plans.queries import QUERIES

    _, pixels = images(spark, 4, [(1, 1), (1, 19), (17, 1), (15, 17), (50, 8), (7, 40)])
    samples = ch.split_channels(pixels)
    lines = im.to_scanlines(samples)
    heights = lines.groupBy("image_id").agg((F.max("y") + 1).alias("height"))
    want = planes(me.area_resize(samples, 6))
    for given in (lines, lines.join(heights, "image_id").repartition(7)):
        got = planes(me.area_resize_lines(given, 6))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) and got[k].shape == want[k].shape for k in want)
    plan = QUERIES["j4_area_resize"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_energy_cuts_equal_a_whole_sort(spark):
    rng = np.random.default_rng(12)
    pairs = []
    for i in range(4):
        e = np.round(rng.lognormal(0, 3, 900), 2 if i else 0) * (i < 3)  # ties, zeros, and a plane without energy
        pairs += [(i, "R", k, 0.0, 0.0, 2, float(v)) for k, v in enumerate(e)]
    df = spark.createDataFrame(pairs, "image_id long, channel string, idx int, re double, im double, weight int, e double").repartition(5)
    ranked = {(r.image_id, r.idx): r for r in fr.rank_pairs(df).collect()}
    levels = (0.0, 50.0, 99.0, 99.99, 100.0)
    got = {}
    for r in fr.prune_levels(df, levels).collect():
        got.setdefault((r.level, r.image_id), set()).add(r.idx)
    for i in range(4):
        own = sorted((p for p in pairs if p[0] == i), key=lambda p: (p[2] != 0, -p[6], p[2]))
        before, total = 0.0, sum(p[6] for p in own)
        kept = {level: set() for level in levels}
        for place, p in enumerate(own, 1):
            r = ranked[i, p[2]]
            assert r.place == place and np.isclose(r.before, before, rtol=1e-9, atol=1e-9)
            for level in levels:
                target = max(0.0, total * (level / 100) - own[0][6])
                if level >= 100 or place == 1 or (target > 0 and before < target * (1 - 1e-12)):
                    kept[level].add(p[2])
            before += p[6] if place > 1 else 0.0
        assert all(got[level, i] == kept[level] for level in levels)
    spectrum = spark.createDataFrame([(i, "R", k // 30, k % 30, float(np.sqrt(v)), 0.0) for i, _, k, _, _, _, v in pairs], "image_id long, channel string, ky int, kx int, re double, im double")
    for r in fr.energy_curve(spectrum, 95.0).collect():
        e = np.sort([p[6] for p in pairs if p[0] == r.image_id])[::-1]
        assert (r.n, r.n_level) == (900, int(np.argmax(np.cumsum(e) >= e.sum() * 0.95 * (1 - 1e-12))) + 1)


def test_equal_energies_are_ranked_by_the_definition(spark):
    """Symmetric planes, whose bins (a, b) and (b, a) have one energy: the cut among them follows sums over samples in order, as SQL's do."""
    rng, planes_ = np.random.default_rng(5), {}
    for i in range(24):
        a = rng.integers(0, 256, (8, 8))
        planes_[i] = np.triu(a) + np.triu(a, 1).T
    lines = spark.createDataFrame([(i, "R", y, [float(v) for v in a[y]]) for i, a in planes_.items() for y in range(8)], "image_id long, channel string, y int, v array<double>").repartition(4)
    got = {}
    for r in fr.fourier_compress(lines, 90.0)[0].collect():
        got.setdefault(r.image_id, set()).add(r.idx)
    for i, a in planes_.items():
        pairs = []
        for ky, kx in ((k // 8, k % 8) for k in range(64)):
            other = (-ky % 8) * 8 + -kx % 8
            if ky * 8 + kx > other:
                continue
            re = im = 0.0
            for y, x in ((k // 8, k % 8) for k in range(64)):
                turn = 2 * math.pi * ((ky * y + kx * x) % 8) / 8
                re, im = re + a[y, x] * math.cos(turn), im + a[y, x] * math.sin(turn)
            pairs.append((ky * 8 + kx, (1 if ky * 8 + kx == other else 2) * (re * re + im * im) / 64))
        total, dc, before, want = sum(e for _, e in pairs), pairs[0][1], 0.0, {0}
        for k, e in sorted(pairs[1:], key=lambda p: (-p[1], p[0])):
            if before < total * 0.9 - dc:
                want.add(k)
            before += e
        assert got[i] == want


def test_halves_of_the_inverse_go_to_the_even_level(spark):
    """What is kept of this plane sums to 143.5 at (0, 4); the fast inverse ends just below."""
    plane = [[116, 132, 104, 90, 141, 116, 124, 114], [136, 97, 133, 112, 74, 159, 115, 118], [94, 156, 158, 121, 113, 115, 164, 142], [124, 144, 103, 102, 152, 98, 142, 145], [105, 92, 125, 105, 121, 135, 151, 133], [130, 117, 89, 95, 131, 133, 113, 218], [183, 93, 125, 117, 141, 59, 86, 84], [119, 127, 178, 68, 124, 121, 114, 138]]
    lines = spark.createDataFrame([(1, "R", y, [float(v) for v in row]) for y, row in enumerate(plane)], "image_id long, channel string, y int, v array<double>")
    shape = spark.createDataFrame([(1, 8, 8)], "image_id long, height int, width int")
    back = fr.fourier_decompress(fr.fourier_compress(lines, 99.9)[0], shape).collect()
    assert next(r.v for r in back if r.y == 0)[4] == 144.0


def test_packed_pairs_come_back_and_damage_is_quarantined(spark):
    _, pixels = images(spark, 9)
    lines, shape = im.to_scanlines(ch.split_channels(pixels)), me.shapes(pixels)
    coeffs, _ = fr.fourier_compress(lines, 99.0)
    archives = fr.pack_coeffs(coeffs, shape).collect()
    assert all(r.archive_bytes == len(r.archive) and r.raw_bytes == 3 * r.height * r.width and r.ratio == r.raw_bytes / r.archive_bytes for r in archives)
    rows = [(r.image_id, bytes(r.archive)) for r in archives]
    good, bad = fr.unpack_coeffs(spark.createDataFrame(rows, "image_id long, archive binary"))
    key = lambda df: sorted((r.image_id, r.channel, int(r.idx), r.re, r.im) for r in df.collect())
    assert key(good) == key(coeffs) and bad.count() == 0
    sound = rows[-1][1]
    flipped = bytearray(sound)
    flipped[-3] ^= 4
    head = struct.unpack_from(fr.ARCHIVE, sound)
    hurt = [(0, None), (1, b""), (2, sound[:9]), (3, b"x" * 40), (4, sound[:-2]), (5, bytes(flipped)), (6, sound + b"!"), (7, struct.pack(fr.ARCHIVE, fr.PACKED, 1, 1, *head[3:]) + sound[18:]), (8, struct.pack(fr.ARCHIVE, fr.PACKED, 9000, 9000, *head[3:]) + sound[18:]), (9, struct.pack(fr.ARCHIVE, *head[:4], 1) + sound[18:])]
    good, bad = fr.unpack_coeffs(spark.createDataFrame(hurt, "image_id long, archive binary"))
    assert good.count() == 0 and sorted(r.image_id for r in bad.collect()) == list(range(10))


def test_filters_by_name_check_their_parameters_and_take_either_form(spark):
    _, pixels = images(spark, 3, [(9, 11)])
    samples = ch.split_channels(pixels)
    lines = im.to_scanlines(samples)
    direct = {"box": fi.box_blur(samples, 7), "gaussian": im.to_samples(fi.gaussian_blur(lines, 3.0)), "unsharp": im.to_samples(fi.unsharp_mask(lines, 2.0, 1.5)), "laplacian": im.to_samples(fi.laplacian_sharpen(lines, 3, 1.0))}
    for name, want in direct.items():
        run, parameters = fi.filter_named(name)
        want = planes(want)
        for got in (run(samples), im.to_samples(run(lines))):
            assert all(np.allclose(v, want[k]) for k, v in planes(got).items())
        for key, (least, most, _) in parameters.items():
            for bad in (least - 1, most + 2, "3", True, None, float("nan")):
                with pytest.raises(ValueError):
                    run(samples, **{key: bad})
        with pytest.raises(ValueError):
            run(samples, radius=3)
    for bad in (4, 3.5):
        with pytest.raises(ValueError):
            fi.filter_named("box")[0](samples, ksize=bad)


def test_running_median_equals_sorting_each_window():
    rng = np.random.default_rng(9)
    for b, size in ((rng.integers(0, 256, (23, 40)).astype(float), 5), (rng.integers(0, 3, (14, 12)).astype(float), 11), (rng.normal(size=(40, 60)), 7), (np.full((11, 11), 4.0), 11)):
        view = np.lib.stride_tricks.sliding_window_view(b, (size, size))
        assert np.array_equal(fi.running_median(b, size), np.median(view, axis=(2, 3)))


def test_centred_transforms_and_previews(spark):
    arrays, pixels = images(spark, 21, [(9, 70)])
    lines = im.to_scanlines(ch.split_channels(pixels))
    got = np.zeros((9, 70), complex)
    for r in fr.fft2(lines, center=True).filter("channel = 'G'").collect():
        got[r.ky, r.kx] = complex(r.re, r.im)
    g = arrays[0][:, :, 1]
    assert np.allclose(got, np.fft.fft2(g - g.mean()), atol=1e-8)
    rows = me.spectrum_previews(ch.split_channels(pixels), 35, center=True).collect()
    sums = {c: sum(abs(r.v) for r in rows if r.channel == c) for c in "RGB"}
    assert all(abs(sum(r.v for r in rows if r.channel == c)) < 1e-6 for c in "RGB") and {round(r.bound, 6) for r in rows} == {round(max(sums.values()), 6)}


def test_broken_images_are_rejected_before_restoration(spark):
    flat = [(i, y, x, 90.0, 120.0, 60.0) for i in range(3) for y in range(12) for x in range(12)]
    broken = [r for r in flat if r[:3] != (1, 3, 3)]  # one pixel short
    broken = [(*r[:3], float("nan"), *r[4:]) if r[:3] == (2, 5, 5) else r for r in broken]
    fixed, _, bad = re_.restore_photo(spark.createDataFrame(broken, "image_id long, y int, x int, r double, g double, b double"), tint=True)
    assert {(r.image_id, r.error) for r in bad.collect()} == {(1, "incomplete"), (2, "not finite")}
    assert {r.image_id for r in fixed.collect()} == {0} and fixed.count() == 144
    pixels = spark.createDataFrame(flat, "image_id long, y int, x int, r double, g double, b double")
    for call in (lambda: re_.remove_stripes(pixels, 0), lambda: re_.remove_stripes(pixels, 5, 1.5), lambda: re_.inpaint(pixels, pixels, 0), lambda: fi.nl_means(pixels, -1.0), lambda: fr.fourier_compress(pixels, 0.0), lambda: fr.rate_distortion(pixels, ())):
        with pytest.raises(ValueError):
            call()
