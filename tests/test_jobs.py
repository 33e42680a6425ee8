"""The jobs from end to end on drawn slides, sinks read back, and the stream of summaries."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roiscore.config import PARAMS
from roiscore.functions.text import duration
from roiscore.jobs import batch, export
from roiscore.functions import raster
from roiscore.operators import pixels, rasters, selection, summary, tiles, windows
from roiscore.session import BATCH_BYTES, BATCH_DEFAULT, BATCH_KEY, LISTING_KEY, load_folders
from roiscore.sources import catalogue, fixtures, images, strips
from roiscore.streaming.incremental import upsert_stream

P = replace(PARAMS, roi_px=64, stride_px=64, patch=32, patch_stride=24, radius_um=4.0, thumbnail_max=64)


@pytest.fixture(scope="module")
def tables(spark):
    """Four slides of 2 x 2 regions: coloured, blank, broken, and one that is finished already."""
    rng = np.random.default_rng(5)
    slides, thumbs, regions = [], [], []
    for name in ("good", "blank", "broken", "old"):
        slides.append((f"/in/{name}.SVS", 128, 128, 0.25, 0.25 if name != "blank" else None))
        thumb = np.full((64, 64, 3), 240, np.uint8)
        if name != "blank":
            thumb[:] = (200, 60, 150)
            thumb[:2] = 240
        thumbs.append((name, 64, 64, bytearray(thumb.tobytes())))
        for gx in range(2):
            for gy in range(2):
                rgb = np.zeros((64, 64, 3), np.uint8)
                rgb[..., 1] = 200
                rgb[: 20 if gx == 0 else 0, :, 0] = 250
                rgb[5:9, 5:9] = rgb[40:44, 40 : 44 + gx] = (90, 200, 0)
                data = rgb.tobytes() if name != "broken" or gx else rgb.tobytes()[:-1]
                regions.append((name, gx, gy, 64, 64, bytearray(data)))
    rng.shuffle(regions)
    return (
        spark.createDataFrame(slides, "wsi_path string, slide_w0 long, slide_h0 long, mpp_x double, mpp_y double"),
        spark.createDataFrame(thumbs, "slide_id string, height int, width int, rgb binary"),
        spark.createDataFrame(regions, "slide_id string, grid_x long, grid_y long, height int, width int, rgb binary"),
    )


def test_batch(spark, tables, tmp_path):
    count = iter(range(1000))
    model = lambda: lambda t: t[..., [2, 0, 1]]  # noqa: E731  classes by colour: blue none, red the first, green the second

    def keep(df):
        path = str(tmp_path / f"kept{next(count)}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    old = spark.createDataFrame([("old", "OK", 1.5), ("broken", "FAILED", 0.0)], "slide_id string, status string, score_mean_percent double")
    whole, failed = batch.run_batch(*tables, old, model, model, keep, P)
    rows = {r.slide_id: r for r in whole.collect()}
    assert set(rows) == {"good", "blank", "broken", "old"}
    assert rows["old"].score_mean_percent == 1.5 and rows["old"].wsi_path is None
    assert rows["blank"].status == "NO_TISSUE_ROIS" and rows["blank"].score_mean_percent == 0 and rows["blank"].num_candidate_windows is None
    assert rows["broken"].status == "FAILED" and "ValueError" in rows["broken"].error_message
    assert rows["good"].status in ("OK", "NO_SELECTED_ROIS") and rows["good"].error_message is None
    assert [r.slide_id for r in failed.collect()] == ["broken"]
    again, _ = batch.run_batch(*tables, whole, model, model, keep, P)
    assert again.where("status <> 'FAILED'").count() == 3


def test_missing_rasters_fail_their_slide(spark, tables, tmp_path):
    """A slide without a thumbnail and one without a passing window's region are failed and tried again, not finished."""
    count = iter(range(1000))
    model = lambda: lambda t: t[..., [2, 0, 1]]

    def keep(df):
        path = str(tmp_path / f"kept{next(count)}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    slides, thumbs, regions = tables
    lost = (thumbs.where("slide_id <> 'old'"), regions.where("slide_id <> 'good' or grid_x = 0 or grid_y = 0"))
    whole, failed = batch.run_batch(slides, *lost, None, model, model, keep, P)
    rows = {r.slide_id: r for r in whole.collect()}
    assert (rows["old"].status, rows["old"].error_message) == ("FAILED", "no thumbnail")
    assert (rows["good"].status, rows["good"].error_message) == ("FAILED", "no raster of region 1, 1")
    assert rows["good"].num_selected_rois == 0 and rows["good"].score_mean_percent == 0 and rows["blank"].status == "NO_TISSUE_ROIS"
    assert {r.slide_id for r in failed.collect()} == {"old", "good", "broken"}
    again, _ = batch.run_batch(*tables, whole, model, model, keep, P)
    assert {r.slide_id for r in again.where("status = 'FAILED'").collect()} == {"broken"}


def test_windows_stay_inside_and_cover(spark):
    slides = spark.createDataFrame([("a", 5000, 2048, 0.25, 0.25), ("b", 100, 90, 0.25, 0.25), ("c", 4097, 4096, 0.25, 0.25)], "slide_id string, slide_w0 long, slide_h0 long, base_mpp_x double, base_mpp_y double")
    rows = windows.candidate_windows(slides).collect()
    by = {k: [(r.grid_x, r.grid_y, r.x0_level0, r.y0_level0) for r in rows if r.slide_id == k] for k in "abc"}
    assert sorted(by["a"]) == [(0, 0, 0, 0), (1, 0, 2048, 0), (2, 0, 2952, 0)] and by["b"] == [(0, 0, 0, 0)]
    assert sorted({x for _, _, x, _ in by["c"]}) == [0, 2048, 2049] and len(by["c"]) == 6
    capped = windows.candidate_windows(slides, replace(PARAMS, max_windows=2)).groupBy("slide_id").count().collect()
    assert {r["slide_id"]: r["count"] for r in capped} == {"a": 2, "b": 1, "c": 2}


def test_neighbours_count_by_features_and_not_oneself(spark):
    columns = "slide_key long, grid_x long, grid_y long, tissue_fraction double, tumor_fraction double, stroma_fraction double, interface_density double, peritumoral_stroma_fraction double"
    rows = [(1, 0, 0, 0.9, 0.0, 0.5, 0.01, 1.0), (1, 5, 5, 0.9, 0.0, 0.5, 0.0, 1.0), (1, 6, 6, 0.1, 0.2, 0.0, 0.0, 0.0), (2, 0, 1, 0.9, 0.5, 0.4, 0.01, 1.0)]
    out = selection.classified(selection.with_raw_score(spark.createDataFrame(rows, columns)))
    got = {(r.slide_key, r.grid_x): (r.final_decision, r.best_neighbor_tumor_fraction) for r in out.collect()}
    assert got[1, 0] == ("discard", 0.0) and got[1, 5] == ("neighbor_associated_stroma", 0.2)
    assert got[2, 0] == ("direct_accept", 0.0) and got[1, 6][0] == "discard"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "slide_id string, n int")
    new = spark.createDataFrame([("b", 3, "x", 1), ("b", 4, "y", 2), ("c", 5, None, 1)], "slide_id string, n int, note string, seq int")
    once = summary.upserted(old, new, ["seq"])
    twice = summary.upserted(once, new, ["seq"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str) == [("a", 1, None, None), ("b", 4, "y", 2), ("c", 5, None, 1)]


def test_durations(spark):
    df = spark.createDataFrame([(5.0,), (59.99,), (60.0,), (3600.0,)], "s double").select(duration(F.col("s")).alias("t"))
    assert [r.t for r in df.collect()] == ["5.00 sec", "59.99 sec", "1.00 min", "1.00 hr"]


def test_catalogue_of_files(spark, tmp_path):
    for name in ("a.svs", "b.TIF", "c.txt", ".svs", "d:e.ndpi"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "f.svs").write_bytes(b"x")
    rows = catalogue.list_slides(spark, str(tmp_path)).collect()
    assert sorted(r.slide_id for r in rows) == ["a", "b", "d_e"]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_tables_may_be_folders(spark, tmp_path, scheme):
    p = replace(PARAMS, extensions=(".parquet",))
    spark.range(9).repartition(3).write.parquet(str(tmp_path / "in.parquet" / "a.parquet"))
    spark.range(9).selectExpr("id", "id % 2 as part").write.partitionBy("part").parquet(str(tmp_path / "in.parquet" / "b.parquet"))
    (tmp_path / "in.parquet" / "c.parquet").write_bytes(b"1234")
    (tmp_path / "in.parquet" / "d.txt").write_bytes(b"1")
    for folder in (f"{scheme}{tmp_path}/in.parquet", f"{scheme}{tmp_path}/in.parquet/"):
        got = {r.slide_id: r.length for r in catalogue.list_tables(spark, folder, p).collect()}
        assert sorted(got) == ["a", "b", "c"] and got["c"] == 4 and min(got.values()) > 0


def test_sinks(spark, tmp_path):
    rois = spark.createDataFrame([(1, 0, 0, 0, 0, 10, 10, 0.5, "direct_accept", 0.7), (1, 1, 0, 10, 0, 10, 10, None, "neighbor_associated_stroma", 0.6)], "slide_key long, grid_x long, grid_y long, x0_level0 long, y0_level0 long, w_level0 long, h_level0 long, roi_tils_score_fraction double, final_decision string, roi_score double")
    export.write_geojson(rois, str(tmp_path / "json"))
    text = spark.read.text(str(tmp_path / "json")).first().value
    found = spark.read.json(spark.sparkContext.parallelize([text])).first()
    assert found.type == "FeatureCollection" and [f.properties.rank for f in found.features] == [1, 2]
    assert found.features[0].geometry.coordinates[0][2] == [10.0, 10.0] and len(found.features[1].properties.measurements) == 1
    for kind in ("parquet", "csv"):
        df = spark.createDataFrame([("a", 1), ("b", 2)], "slide_id string, n int")
        export.write_tables(df, str(tmp_path / kind), kind=kind)
        export.write_tables(df.where("slide_id = 'a'").withColumn("n", F.lit(9)), str(tmp_path / kind), kind=kind)
        back = spark.read.format(kind).option("header", True).load(str(tmp_path / kind))
        assert sorted((r.slide_id, int(r.n)) for r in back.collect()) == [("a", 9), ("b", 2)]


def test_slides_are_written_and_listed_by_some_tasks(spark, tmp_path):
    """Not by one task, though their bytes are few and they lie by slide already, and not by one task each."""
    df = spark.range(64).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("slide_id"), F.col("id").alias("n")).repartition("slide_id")
    for kind in ("parquet", "csv"):
        export.write_tables(df, str(tmp_path / kind), kind=kind)
        files = list((tmp_path / kind).glob("slide_id=*/part-*"))
        assert len(files) == 64 and len({f.name.split("-")[1] for f in files}) > 4
        before = spark.conf.get(LISTING_KEY)
        spark.sparkContext.setJobGroup(f"list {kind}", "")
        back = load_folders(spark, spark.read.schema("n long, slide_id string").option("header", kind == "csv").format(kind), str(tmp_path / kind))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs = [spark.sparkContext.statusTracker().getJobInfo(j) for j in spark.sparkContext.statusTracker().getJobIdsForGroup(f"list {kind}")]
        assert jobs and all(spark.sparkContext.statusTracker().getStageInfo(x).numTasks <= 16 for j in jobs for x in j.stageIds)
        assert spark.conf.get(LISTING_KEY) == before and sorted((r.slide_id, r.n) for r in back.collect()) == sorted((f"S{n}", n) for n in range(64))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["csv", "parquet"]


def test_slide_folders_are_made_and_listed_by_tasks(spark, tmp_path):
    """Hadoop, which starts a process for every local file and folder (and leaves its checksums), makes none of them, and the driver lists none."""
    df = spark.range(50).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("slide_id"), F.col("id").alias("n"))
    for kind in ("parquet", "csv"):
        export.write_tables(df, f"file://{tmp_path}/deep/{kind}", kind=kind)
        assert not list(tmp_path.rglob("*.crc")) and [x.name for x in (tmp_path / "deep" / kind).iterdir() if "=" not in x.name] == ["_SUCCESS"]
        back = export.read_tables(spark, f"file://{tmp_path}/deep/{kind}", df.schema, kind=kind)
        assert "FileScan" not in back._jdf.queryExecution().executedPlan().toString() and back.columns == df.columns
        assert sorted((r.slide_id, r.n) for r in back.collect()) == sorted((f"S{n}", n) for n in range(50))
        # an exchange of some slides' folders, among them one that Spark has written
        df.where("n = 8").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("slide_id").format(kind).save(f"{tmp_path}/deep/{kind}")
        export.write_tables(df.where("n in (7, 8)").withColumn("n", F.col("n") + 100), f"file://{tmp_path}/deep/{kind}", kind=kind)
        assert not list((tmp_path / "deep" / kind).glob("slide_id=*/*.crc")) and len(list((tmp_path / "deep" / kind).glob("slide_id=*/*"))) == 50
        assert sorted((r.slide_id, r.n) for r in back.collect()) == sorted((f"S{n}", n + 100 * (n in (7, 8))) for n in range(50))
        # one that fails midway leaves what was there
        with pytest.raises(Exception, match="broken"):
            export.write_tables(df.select("slide_id", F.when(F.col("n") == 49, F.raise_error(F.lit("broken"))).otherwise(-1).alias("n")), f"{tmp_path}/deep/{kind}", kind=kind)
        assert back.where("n >= 0").count() == 50
    assert sorted(x.name for x in (tmp_path / "deep").iterdir()) == ["csv", "parquet"]


def test_slide_folders_are_as_spark_makes_them(spark, tmp_path):
    """Odd slides, values, columns and types: the same folders and lines, and either side reads what the other has written."""
    slides = [None, "", "S:1", "a/b\\c", "50%", "%41", "x=y", " lead", "\u00e4\u6f22\U0001f600", ".hidden", *("c" + "".join(map(chr, range(n, min(n + 32, 128)))) for n in (1, 33, 65, 97))]
    words = [None, "", " lead and trail ", 'say "so"', "a,b", "back\\slash", "#", "'", "\u6f22\U0001f600", "tab\there", '"', "\\"]
    numbers = [None, 0.0, -0.0, 1e300, 1e-7, float("inf"), float("nan"), 123456789.125]
    rows = [(s, words[k % len(words)], numbers[k % len(numbers)], k) for k, s in enumerate(slides * 3)]
    df = spark.createDataFrame(rows, "slide_id string, `odd, \"name` string, `a b` double, k long").withColumns({"d": F.expr("cast(k as decimal(20, 4))"), "day": F.expr("date_add(date'2024-02-28', int(k))"), "at": F.expr("timestamp'2024-01-01 00:00:00.123456' + make_interval(0, 0, 0, 0, int(k))"), "plain": F.expr("timestamp_ntz'2024-01-01 00:00:00.5'")})
    key = lambda df: sorted(map(repr, df.select(*(F.col(f"`{c}`") for c in sorted(df.columns))).collect()))
    for kind, given in (("csv", df), ("parquet", df), ("text", df.select("slide_id", F.col("`odd, \"name`").alias("value")))):
        export.write_tables(given, str(tmp_path / kind), kind=kind)
        theirs = tmp_path / f"spark {kind}"
        given.coalesce(1).write.option("header", kind == "csv").partitionBy("slide_id").format(kind).save(str(theirs))
        lists = [{x.name: sorted(y.suffix for y in x.glob("part-*")) for x in f.iterdir() if x.is_dir()} for f in (tmp_path / kind, theirs)]
        assert lists[0] == lists[1] and len(lists[0]) == len(set(slides)) - 1
        if kind != "parquet":
            text = [{x.name: sorted("".join(y.read_text() for y in x.glob("part-*")).split("\n")) for x in f.iterdir() if x.is_dir() and "HIVE" not in x.name} for f in (tmp_path / kind, theirs)]
            assert text[0] == text[1]
        read = [spark.read.schema(given.schema).option("header", kind == "csv").format(kind).load(str(f)) for f in (tmp_path / kind, theirs)]
        read += [export.read_tables(spark, str(f), given.schema, kind=kind) for f in (tmp_path / kind, theirs)]
        assert all(x.columns == given.columns and x.dtypes == given.dtypes for x in read[2:])
        assert len(key(read[0])) == given.count() and key(read[0]) == key(read[1]) == key(read[2]) == key(read[3])


def test_slide_folders_of_no_rows_many_rows_and_failures(spark, tmp_path):
    df = spark.range(60000).select((F.col("id") % 2 * 7).alias("slide_id"), "id", F.repeat(F.lit("x"), 30).alias("words"))
    broken = df.select("slide_id", F.when(F.col("id") == 59999, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    for kind in ("parquet", "csv"):
        export.write_tables(df, str(tmp_path / kind), kind=kind)
        assert len(list((tmp_path / kind).glob("slide_id=*/part-*"))) == 2
        back = export.read_tables(spark, str(tmp_path / kind), df.schema, kind=kind)
        assert back.dtypes == df.dtypes and back.exceptAll(df).count() == 0 and back.count() == 60000
        export.write_tables(df.where("id < 0"), str(tmp_path / f"no {kind}"), kind=kind)
        assert export.read_tables(spark, str(tmp_path / f"no {kind}"), df.schema, kind=kind).count() == 0
        with pytest.raises(Exception, match="broken"):
            export.write_tables(broken, str(tmp_path / f"broken {kind}"), kind=kind)
        assert export.read_tables(spark, str(tmp_path / kind), T.StructType.fromDDL("slide_id long"), kind=kind).groupBy("slide_id").count().sort("slide_id").collect() == [(0, 30000), (7, 30000)]
        # columns that files lack are null
        wider = export.read_tables(spark, str(tmp_path / "parquet"), T.StructType.fromDDL("more double, slide_id long, id long"))
        assert wider.where("more is null and slide_id = id % 2 * 7").count() == 60000
    assert sorted(x.name for x in tmp_path.iterdir()) == ["csv", "no csv", "no parquet", "parquet"]


def test_slide_folders_elsewhere_are_spark_s_own(spark, tmp_path):
    """On a file system that is not local (here one seen through a mount) Spark writes, replaces and lists."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./out", f"file://{tmp_path}")
    df = spark.range(9).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("slide_id"), F.col("id").alias("n"))
    for kind in ("parquet", "csv"):
        export.write_tables(df, f"viewfs://store/out/{kind}", kind=kind)
        export.write_tables(df.where("n = 7").withColumn("n", F.lit(70).cast("long")), f"viewfs://store/out/{kind}", kind=kind)
        back = export.read_tables(spark, f"viewfs://store/out/{kind}", df.schema, kind=kind)
        assert back.columns == df.columns and sorted((r.slide_id, r.n) for r in back.collect()) == sorted((f"S{n}", 70 if n == 7 else n) for n in range(9))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["csv", "parquet"] and list(tmp_path.rglob("*.crc"))


def test_image_files(spark, tmp_path):
    """A 24-bit bitmap of 2 x 2 pixels, lower row first, each row padded to four bytes."""
    rows = [[(0, 0, 255), (10, 20, 30)], [(255, 0, 0), (0, 255, 0)]]  # blue, green, red
    body = b"".join(b"".join(map(bytes, r)) + b"\0\0" for r in rows)
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(head + info + body)
    out = images.read_images(spark, str(tmp_path)).first()
    assert (out.height, out.width, out.error) == (2, 2, None)
    assert bytes(out.rgb) == bytes([0, 0, 255, 0, 255, 0, 255, 0, 0, 30, 20, 10])
    big = images.at_roi_size(images.read_images(spark, str(tmp_path)).drop("error"), ["path"], replace(PARAMS, roi_px=4)).first()
    assert (big.height, big.width, len(big.rgb)) == (4, 4, 48)


def test_files_that_are_no_images_are_errors(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(b"no image")
    out = images.read_images(spark, str(tmp_path)).first()
    assert out.path.endswith("a.bmp") and out.rgb is None and "decoded" in out.error


def test_timings_and_summaries_are_written_and_read(spark, tmp_path):
    times = spark.createDataFrame([("a", "open", 1.0), ("a", "mask", 70.0), ("a", "mask", 20.0)], "slide_id string, stage string, seconds double")
    export.write_timings(summary.stage_totals(times), str(tmp_path / "t"))
    lines = sorted(r.value.split(maxsplit=1) for r in spark.read.text(str(tmp_path / "t/text")).collect())
    assert lines == [["mask", "1.50 min"], ["open", "1.00 sec"], ["total_pipeline_time", "1.52 min"]]
    one = spark.createDataFrame([("a", "/a.svs", "OK", None, None, 4, 2, 1, 1, 10, 3, 1.5, 2.0, 1.0)], catalogue.SUMMARY_SCHEMA)
    one.write.csv(str(tmp_path / "s"), header=True)
    assert catalogue.read_summary(spark, str(tmp_path / "s")).collect() == one.collect()


def test_timings_of_other_slides_stay(spark, tmp_path):
    times = spark.createDataFrame([(f"S{n}", "open", float(n)) for n in range(40)], "slide_id string, stage string, seconds double")
    for rows in (times, times.where("slide_id = 'S7'").withColumn("seconds", F.lit(50.0))):
        export.write_timings(summary.stage_totals(rows), str(tmp_path / "t"))
        if rows is times:
            files = list((tmp_path / "t/text").glob("slide_id=*/part-*"))
            assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 4
    lines = {r.slide_id: r.value.split()[1] for r in spark.read.text(str(tmp_path / "t/text")).where("value like 'open%'").collect()}
    assert lines == {f"S{n}": "50.00" if n == 7 else f"{n}.00" for n in range(40)}


def test_raster_rows(spark):
    px = np.zeros((4, 4), np.uint8)
    row = [("s", 0, 1, 1, "direct_accept", 4, 4, *(bytearray(x.tobytes()) for x in (np.full((4, 4, 3), 100, np.uint8), px + 2, px, px, px)))]
    df = spark.createDataFrame(row, "slide_key string, grid_x int, grid_y int, rank int, final_decision string, height int, width int, rgb binary, mask binary, objects binary, inside binary, clean binary")
    out = {r.kind: r for r in export.raster_rows(df).collect()}
    assert set(out) == {"image", "label", "color", "objects", "stroma", "inside", "clean", "overlay"}
    assert out["image"].name == "r001_D_gx0_gy1" and out["stroma"].data == b"\xff" * 16 and out["overlay"].channels == 3
    assert {r.kind for r in export.raster_rows(df, replace(PARAMS, save_images=False, save_masks=False)).collect()} == {"overlay"}


def test_stream_of_summaries(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "out"
    schema = "slide_id string, n int, seq int"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema).write.parquet(str(source))
    spark.createDataFrame([("a", 0, 0), ("z", 0, 0)], schema).write.parquet(str(state / "start"))
    last = [str(state / "start")]

    def write(df, number):
        path = str(state / f"batch{number}")
        df.write.parquet(path)
        last.append(path)

    upsert_stream(spark.readStream.schema(schema).parquet(str(source)), lambda: spark.read.parquet(last[-1]), write, str(tmp_path / "checkpoint"), ["seq"]).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(last[-1]).collect())) == [("a", 1, 1), ("b", 1, 1), ("z", 0, 0)]


def test_pixels_to_rasters_and_back(spark):
    px = spark.createDataFrame([(k, y, x, (40 * (k or 0) + 7 * y + x) % 256, 255 - x, y) for k in (1, 2, None) for y in range(3) for x in range(4 if k == 1 else 2)], "k long, y long, x long, r int, g int, b int").orderBy(F.rand(1))
    packed = rasters.from_pixels(px, ["k"], {"rgb": ["r", "g", "b"], "blue": ["b"]})
    assert packed.columns == ["k", "height", "width", "rgb", "blue", "error"] and packed.where("error is not null").count() == 0
    rgb = rasters.to_pixels(packed, ["k"], ["rgb"], channels=3, most=5).select("k", "y", "x", *(F.col("rgb")[i].alias(c) for i, c in enumerate("rgb")))
    assert sorted(map(str, rgb.collect())) == sorted(map(str, px.collect()))
    assert sorted(map(str, rasters.to_pixels(packed, ["k"], ["blue"]).collect())) == sorted(map(str, px.selectExpr("k", "y", "x", "b as blue").collect()))
    assert rasters.to_pixels(rasters.from_pixels(px.limit(0), ["k"], {"blue": ["b"]}), ["k"], ["blue"]).count() == 0


def test_pixels_of_null_and_short_rasters_are_null(spark):
    rows = [("a", 1, 2, bytearray([9, 250])), ("b", 2, 1, None), ("c", 1, 2, bytearray([7])), ("d", 0, 3, bytearray()), ("e", None, 1, None)]
    out = rasters.to_pixels(spark.createDataFrame(rows, "k string, height int, width int, mask binary"), ["k"], ["mask"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 0, 0, 9), ("a", 0, 1, 250), ("b", 0, 0, None), ("b", 1, 0, None), ("c", 0, 0, 7), ("c", 0, 1, None)], key=str)


@pytest.mark.parametrize("bad", [None, 256, -1, 70000])
def test_values_that_are_no_bytes_fail_their_raster(spark, bad):
    px = spark.createDataFrame([(k, y, 0, bad if (k, y) == (1, 1) else 7) for k in (1, 2) for y in (0, 1)], "k long, y long, x long, v int")
    got = {r.k: (r.v, r.error) for r in rasters.from_pixels(px, ["k"], {"v": ["v"]}).collect()}
    assert got == {1: (None, "a pixel has a null place, or a value that is no byte"), 2: (b"\x07\x07", None)}
    masked = {r.k: r.error for r in rasters.segmented(rasters.from_pixels(px, ["k"], {"rgb": ["v"] * 3}), lambda: lambda t: t, ["k"]).collect()}
    assert masked == {1: got[1][1], 2: None}


def test_missing_and_doubled_pixels_fail_their_raster(spark):
    px = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 1), (2, 0, 0, 1), (2, 0, 0, 2), (3, 0, None, 1), (4, 0, 0, 9)], "k long, y long, x long, v int")
    got = {r.k: r.error for r in rasters.from_pixels(px, ["k"], {"v": ["v"]}).collect()}
    assert all(got[k] for k in (1, 2, 3)) and got[4] is None


def test_every_raster_is_worked_on_once(spark, tables, tmp_path):
    """Each step on rasters is stored before anything reads it, so that none is in the plan of another or of the results."""
    python = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInPandas")
    steps, asked = [], str(tmp_path / "asked")

    def keep(df):
        steps.append(python(df))
        path = str(tmp_path / f"kept{len(steps)}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def model():
        def answer(tiles):
            with open(asked, "a") as f:
                f.write("x" * len(tiles))
            return tiles[..., [2, 0, 1]]

        return answer

    whole, failed = batch.run_batch(*tables, None, model, lambda: lambda t: t[..., [2, 0, 1]], keep, P)
    assert python(whole) == python(failed) == 0 and max(steps) == 1 and sum(steps) == 5  # masks, labels, features, objects, counts
    assert {r.slide_id: r.status for r in whole.collect()}["broken"] == "FAILED"
    assert len(open(asked).read()) == 9 * 10  # nine tiles of each passing region that can be read: four of good, four of old, two of broken


def test_windows_of_thumbnails_stay_where_they_are(spark, tables):
    """No exchange has a raster among its columns."""
    slides = catalogue.with_resolution(catalogue.with_ids(tables[0], P), P)
    plan = batch.screened_slides(slides, tables[1], P)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hash" in line]
    assert "BroadcastHashJoin" in plan and not any("rgb" in line for line in exchanges)
    rows = batch.screened_windows(batch.screened_slides(slides, tables[1], P), P)
    one = {(r.grid_x, r.grid_y): (r.x0_level0, r.mx0, r.mx1, r.filter_reason) for r in rows.where("slide_id = 'good'").collect()}
    assert one[1, 0] == (64, 32, 64, "pass") and len(one) == 4
    arrays = windows.with_window_array(slides.withColumns({"thumb_w": F.lit(64).cast("long"), "thumb_h": F.lit(64).cast("long")}), P).select("slide_id", F.explode("windows").alias("w")).select("slide_id", "w.*")
    plain = windows.thumbnail_rects(windows.candidate_windows(slides.withColumns({"thumb_w": F.lit(64).cast("long"), "thumb_h": F.lit(64).cast("long")}), P)).select(arrays.columns)
    assert sorted(arrays.collect()) == sorted(plain.collect())


def test_pixels_in_overlapping_windows(spark):
    px = spark.createDataFrame([(k, y, x) for k in (1, 2) for y in range(9) for x in range(11)], "k long, y long, x long")
    laid = [(1, 0, 0, 5, 0, 5), (1, 1, 2, 9, 3, 20), (2, 2, 4, 4, 0, 9), (2, 3, -3, 2, -5, 1), (2, 3, -3, 2, -5, 1)]
    df = windows.windows_of_pixels(px, spark.createDataFrame(laid, "k long, name int, x0 long, x1 long, y0 long, y1 long"), ["k"], 4)
    expected = sorted((k, y, x, n) for k, n, x0, x1, y0, y1 in laid for y in range(9) for x in range(11) if x0 <= x < x1 and y0 <= y < y1)
    assert sorted((r.k, r.y, r.x, r.name) for r in df.collect()) == expected
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_totals_of_stages_are_one_aggregate(spark):
    times = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), ("b", "x", 4.0)], "slide_id string, stage string, seconds double")
    df = summary.stage_totals(times)
    assert sorted((r.slide_id, r.stage or "", r.seconds) for r in df.collect()) == [("a", "", 2.0), ("a", "total_pipeline_time", 3.0), ("a", "x", 1.0), ("b", "total_pipeline_time", 4.0), ("b", "x", 4.0)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


@pytest.mark.parametrize("k", [2, 3, 5, 8, 31])
def test_frames_equal_the_helper(spark, k):
    rng = np.random.default_rng(k)
    mask = (rng.random((13, 17)) < 0.6).astype(np.uint8)
    px = spark.createDataFrame([(0, y, x, int(mask[y, x])) for y in range(13) for x in range(17)], "k long, y long, x long, v int")
    for least, outside, helper in ((True, None, raster.erode(mask, k)), (True, 0, raster.erode(mask, k, 0)), (False, None, raster.dilate(mask, k))):
        got = np.zeros_like(mask)
        for r in pixels.sliding(px, "v", ["k"], k, least, outside).collect():
            got[r.y, r.x] = r.v
        assert (got == helper).all()


def test_pixels_are_shuffled_as_bytes_in_small_batches(spark):
    kept = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, BATCH_DEFAULT)
    try:
        px = spark.range(0, 6000, 1, 3).selectExpr("if(id % 2 = 0, null, 'a') as k", "id div 2 div 50 as y", "id div 2 % 50 as x", "id % 251 as v")
        packed = rasters.from_pixels(px, ["k"], {"v": ["v", "v"], "w": ["v"]})
        assert spark.conf.get(BATCH_KEY) == BATCH_BYTES and "collect_list" not in packed._jdf.queryExecution().executedPlan().toString()
        got = {r.k: r for r in packed.collect()}
    finally:
        spark.conf.set(BATCH_KEY, kept)
    for k, first in ((None, 0), ("a", 1)):
        v = (np.arange(first, 6000, 2) % 251).astype(np.uint8)
        assert (got[k].height, got[k].width, got[k].error) == (60, 50, None) and bytes(got[k].w) == v.tobytes() and bytes(got[k].v) == np.repeat(v, 2).tobytes()


def test_batch_tables_join_no_pixels(spark):
    _, thumbs, regions, _ = fixtures.batch_tables(spark, "/root/testdata/sf0.001")
    assert not any("Join" in df._jdf.queryExecution().executedPlan().toString() for df in (thumbs, regions))


def test_strips_that_filters_leave_are_read_alone(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    rows = {name: rng.integers(0, 256, (height, 6, 2), dtype=np.uint8) for name, height in (("a", 25), ("b", 10), ("c", 3))}
    df = spark.createDataFrame([(n, *v.shape, bytearray(v.tobytes())) for n, v in rows.items()], "name string, height int, width int, channels int, data binary")
    strips.write_strips(df, str(tmp_path / "s"), rows=4)
    read = strips.read_strips(spark, str(tmp_path / "s"), split=100)
    found = {(r.name, r.y0): bytes(r.data) for r in read.collect()}
    assert found == {(n, y): v[y : y + 4].tobytes() for n, v in rows.items() for y in range(0, len(v), 4)}
    some = read.where("name in ('a', 'c') and y0 > 3 and y0 <= 12 and rows = 4")
    assert sorted((r.name, r.y0) for r in some.collect()) == [("a", 4), ("a", 8), ("a", 12)]

    opened = []

    class Counted:
        def __init__(self, file):
            self.file = file
            opened.append(0)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            opened[-1] += n
            return self.file.read(n)

    plain = strips._open
    monkeypatch.setattr(strips, "_open", lambda system, path: Counted(plain(system, path)))
    reader = strips.StripReader(str(tmp_path / "s"), 1 << 20)
    assert list(reader.pushFilters([strips.EqualTo(("name",), "a"), strips.GreaterThanOrEqual(("y0",), 8), strips.LessThan(("y0",), 16), strips.EqualTo(("rows",), 4)])) == [strips.EqualTo(("rows",), 4)]
    batches = [b for s in reader.partitions() for b in reader.read(s)]
    assert [b["y0"][0].as_py() for b in batches] == [8, 12] and opened == [20 + 2 * 4 * 12]
    opened.clear()
    window = strips.window_of(str(tmp_path / "s" / "a.rst"), 4, 20, 5, 9)
    assert opened == [20 + 5 * 12] and (window[:5, :2] == rows["a"][20:, 4:]).all() and window[5:].sum() == window[:, 2:].sum() == 0


def test_windows_of_files(spark, tmp_path):
    px = np.arange(60, dtype=np.uint8).reshape(5, 4, 3)
    strips.write_strips(spark.createDataFrame([("a", 5, 4, 3, bytearray(px.tobytes()))], "name string, height int, width int, channels int, data binary"), str(tmp_path / "s"), rows=2)
    (tmp_path / "s" / "bad.rst").write_bytes(b"no strips, but long enough")
    laid = spark.createDataFrame([(1, "a", 1, 1, 2, 3), (2, "bad", 0, 0, 1, 1), (3, "none", 0, 0, 1, 1), (4, "a", -9, -9, 2, 2)], "k int, name string, x0 int, y0 int, w int, h int")
    got = {r.k: r for r in strips.read_windows(laid, str(tmp_path / "s"), ["k"]).collect()}
    assert bytes(got[1].rgb) == px[1:4, 1:3].tobytes() and (got[1].height, got[1].width) == (3, 2) and bytes(got[4].rgb) == bytes(12)
    assert "not a file of strips" in got[2].error and got[3].error and got[2].rgb is None
    wrong = spark.createDataFrame([("b", 5, 4, 3, bytearray(7))], "name string, height int, width int, channels int, data binary")
    with pytest.raises(Exception, match="7 bytes"):
        strips.write_strips(wrong, str(tmp_path / "s"))


def test_components_of_tiles_are_those_of_the_whole(spark, tmp_path):
    """Rasters cut at any place, with spirals and dense noise that cross seams many times."""
    rng = np.random.default_rng(4)
    spiral = np.zeros((24, 24), np.uint8)
    for k in range(0, 12, 2):
        spiral[k, k : 24 - k] = spiral[k : 24 - k, 23 - k] = spiral[23 - k, k : 24 - k] = 1
        spiral[k + 2 : 24 - k, k] = 1
    masks = [spiral, *((rng.random((int(rng.integers(5, 30)), int(rng.integers(5, 30)))) < d).astype(np.uint8) for d in (0.2, 0.35, 0.45, 0.6)), np.zeros((4, 4), np.uint8)]
    rows, count = [], iter(range(1000))
    for n, mask in enumerate(masks):
        cut_y, cut_x = ([0, *sorted(rng.choice(np.arange(1, size), min(size - 1, 4), replace=False).tolist()), size] for size in mask.shape)
        for y0, y1 in zip(cut_y, cut_y[1:]):
            for x0, x1 in zip(cut_x, cut_x[1:]):
                rows.append((n, y0, x0, y1 - y0, x1 - x0, mask.shape[1], bytearray(np.ascontiguousarray(mask[y0:y1, x0:x1]).tobytes())))

    def keep(df):
        path = str(tmp_path / f"kept{next(count)}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    df = spark.createDataFrame(rows, "k int, y0 long, x0 long, height int, width int, full_width long, mask binary")
    got = sorted(map(tuple, tiles.tiled_components(df, ["k"], keep)[0].collect()))
    expected = []
    for n, mask in enumerate(masks):
        label, area = raster.components(mask)
        expected += [(n, int(np.flatnonzero(label.reshape(-1) == k + 1)[0]), int(a)) for k, a in enumerate(area)]
    assert got == sorted(expected)
    kept = tiles.tiled_keep_components(df, ["k"], 6, keep, 40).collect()
    for n, mask in enumerate(masks):
        whole = np.zeros_like(mask)
        for r in kept:
            if r.k == n:
                whole[r.y0 : r.y0 + r.height, r.x0 : r.x0 + r.width] = np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width)
        assert (whole == raster.keep_components(mask, 6, 40)).all()
