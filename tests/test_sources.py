"""Sources and sinks by round trip."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stardeck.operators import frames as fr
from stardeck.sources import fits, fits_format, images, png, starfile, tables, tiff


def test_fits_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 65536, (7, 5))
    (tmp_path / "a.fits").write_bytes(fits.encode(image, {"EXPTIME": 2.5, "BAYERPAT": "RGGB", "INSTRUME": "Cam/1", "DATE-OBS": "2024-05-06T07:08:09.250"}))
    (tmp_path / "b.fits").write_bytes(fits.encode(np.stack([image % 256] * 3), bits=8))
    (tmp_path / "c.fits").write_bytes(fits.encode_table({"X": np.arange(3.0), "Y": np.arange(3.0)}))
    rows = fits.read_rows(spark, str(tmp_path))
    got = {(r["path"][-6], r["chan"], r["y"]): r["row"] for r in rows.collect()}
    assert all(got["a", "L", y] == list(image[y]) for y in range(7))
    assert all(got["b", c, y] == list(image[y] % 256) for c in "RGB" for y in range(7))
    assert len(got) == 7 + 21 and fits.first_image(rows).count() == 28
    info = {r["path"][-6]: r for r in fits.frame_info(fits.read_headers(spark, str(tmp_path)).where("hdu = 0")).collect()}
    assert (info["a"]["exposure"], info["a"]["cfa"], info["a"]["camera"], info["a"]["max_value"], info["a"]["bin"]) == (2.5, "RGGB", "Cam", 65535, 1)
    assert str(info["a"]["time"]) == "2024-05-06 07:08:09.250000" and info["b"]["max_value"] == 255


def test_fits_float_values():
    keys = {"BITPIX": "-32"}
    raw = np.array([0, 0.5, 1, 2, -1, np.nan], ">f4").tobytes()
    assert fits.samples(raw, keys, 0, 24).tolist() == [0, 32768, 65535, 65535, 0, 0]


def test_fits_files_are_written_for_each_frame(spark, tmp_path):
    rows = spark.createDataFrame([(f, y, [f * 10 + y] * 4) for f in (1, 2) for y in range(3)], "frame long, y int, row array<int>")
    fits.save(fits.to_files(rows), str(tmp_path))
    got = fits.read_rows(spark, str(tmp_path)).groupBy("path").agg(F.sum(F.element_at("row", 1)).alias("s")).collect()
    assert sorted(r["s"] for r in got) == [33, 63]


def test_fits_format_reads_in_shares(spark, tmp_path):
    """The format gives what whole files give, however many shares a file has."""
    rng = np.random.default_rng(5)
    mono, colour = rng.integers(0, 65536, (41, 30)), rng.integers(0, 256, (3, 9, 7))
    (tmp_path / "a.fits").write_bytes(fits.encode(mono, {"EXPTIME": 2.5}) + fits.encode(mono[:5] // 300, bits=8))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.fit").write_bytes(fits.encode(colour, bits=8))
    (tmp_path / "c.fits").write_bytes(fits.encode_table({"X": np.arange(3.0)}))
    (tmp_path / "_d.fits").write_bytes(b"not one")
    (tmp_path / "e.txt").write_bytes(b"nor this")
    os.rename(tmp_path / "_d.fits", tmp_path / "d.away")
    key = lambda rows: sorted((r["path"].rpartition("/")[2], r["hdu"], r["chan"], r["y"], tuple(r["row"])) for r in rows.collect())
    want = key(fits.read_rows(spark, str(tmp_path)).where("path NOT LIKE '%.away' AND path NOT LIKE '%.txt'"))
    for share in ("1000", "700000"):
        got = fits_format.read_rows(spark, str(tmp_path), shareBytes=share)
        assert key(got) == want and len(want) == 41 + 5 + 27
    assert got.rdd.getNumPartitions() == 3 < fits_format.read_rows(spark, str(tmp_path), shareBytes="1000").rdd.getNumPartitions()
    some = fits_format.read_rows(spark, f"{tmp_path}/a.fits", rows="38:40")
    assert key(some) == [("a.fits", 0, "L", y, tuple(mono[y])) for y in (38, 39)]
    (tmp_path / "f.fits").write_bytes(fits.encode(mono)[: 2880 + 600])
    with pytest.raises(Exception, match="ends within its data"):
        fits_format.read_rows(spark, str(tmp_path)).count()


def test_fits_format_reads_rows_of_a_file_larger_than_binary_files(spark, tmp_path):
    """5 GB, of which a few rows are read; the file has holes, so it takes no room."""
    height, width = 50_000, 50_000
    head = fits.header_block((height, width))
    with open(tmp_path / "large.fits", "wb") as f:
        f.write(head)
        f.seek(len(head) + 2 * width * 49_998)
        f.write((np.arange(2 * width) % 1000).astype(">i2").tobytes())
        f.truncate(len(head) + 2 * width * height)
    got = fits_format.read_rows(spark, str(tmp_path), rows="49997:50000").select("y", F.element_at("row", 8).alias("v"), F.size("row").alias("n")).orderBy("y").collect()
    assert [tuple(r) for r in got] == [(49_997, 32_768, width), (49_998, 32_775, width), (49_999, 32_775, width)]


def test_fits_format_writes_all_or_nothing(spark, tmp_path):
    rows = [(f, y, [f * 1000 + y * 10 + x for x in range(4)]) for f in range(5) for y in range(6)]
    table = spark.createDataFrame(rows, "frame long, y int, row array<int>")
    folder = f"{tmp_path}/out"
    fits_format.write_rows(table.repartition(7), folder, cards='{"EXPTIME": 3.5}')
    assert sorted(os.listdir(folder)) == [f"frame_{f:04d}.fits" for f in range(5)]
    got = fits_format.read_rows(spark, folder)
    assert sorted((int(r["path"][-9:-5]), r["y"], r["row"]) for r in got.collect()) == rows
    assert {r["exposure"] for r in fits.frame_info(fits.read_headers(spark, folder)).collect()} == {3.5}
    broken = table.where("frame <> 3 OR y <> 2").withColumn("frame", F.col("frame") + 10)
    with pytest.raises(Exception, match="row 3 of 4 pixels where row 2"):
        fits_format.write_rows(broken, folder)
    assert sorted(os.listdir(folder)) == [f"frame_{f:04d}.fits" for f in range(5)]  # what was there stays, and nothing is left of the other
    fits_format.write_rows(table.where("frame < 2").withColumn("row", F.transform("row", lambda v: v % 256)), folder, overwrite=True, bits="8", prefix="small_")
    assert sorted(os.listdir(folder)) == ["small_0000.fits", "small_0001.fits"]


def test_star_file(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 200
    stars = pd.DataFrame({"ra_i": rng.integers(0, 628318531, n), "dec_i": rng.integers(-157079632, 157079632, n), "mag": rng.integers(-150, 1200, n) / 100, "bv": np.zeros(n)})
    layout = starfile.Layout()
    (tmp_path / "s.bin").write_bytes(starfile.encode(stars, layout))
    got = starfile.read(spark, str(tmp_path / "s.bin"), layout).toPandas()
    assert np.array_equal(got["ra_i"], stars["ra_i"]) and np.array_equal(got["dec_i"], stars["dec_i"])
    assert np.allclose(got["mag"], stars["mag"]) and not got["bv"].any()


@pytest.mark.parametrize("values", [[0] * 64, [2**32 - 1, 1] * 32, [4, 8, 12] * 21 + [4], [7] * 60 + [2**30] * 4, [2**31, 2**20] * 32, [1 << 5] * 63 + [1 << 25]])
def test_star_blocks(values):
    layout, bits = starfile.Layout(), starfile.Bits()
    starfile.write_block(bits, values, 0, layout)
    assert starfile.read_block(starfile.Bits(bits.bytes()), 0, layout) == values
    assert [starfile.unzigzag(starfile.zigzag(v)) for v in (0, -1, 5, -(2**30))] == [0, -1, 5, -(2**30)]


def test_bad_pixels(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("1 2\n  3   4 \nx 5\n6\n\n")
    got = tables.read_bad_pixels(spark, str(tmp_path / "bad.txt"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (3, 4)]
    tables.write_bad_pixels(got, str(tmp_path / "out"))
    assert tables.read_bad_pixels(spark, str(tmp_path / "out")).count() == 2


def test_catalogues(spark, tmp_path):
    (tmp_path / "dso.csv").write_text("Type;RA;Dec;Constellation;Names;Nicknames;Mag_V;Mag_B;Major_Axis;Minor_Axis;Angle\nG;00:42:44.3;+41:16:09;and;M 31|NGC 224;Andromeda Galaxy;3.4;;178;63;35\nG;bad;1;x;y;;;;;;\n")
    (tmp_path / "stars.csv").write_text("name;bayer;ra;dec;constellation;mag;bv\nVega;Alpha Lyr;18:36:56.3;+38:47:01;lyr;0.03;\n")
    d = tables.read_dsos(spark, str(tmp_path / "dso.csv")).collect()
    assert len(d) == 1 and d[0]["ra"] == pytest.approx(0.18648, abs=1e-4) and d[0]["mag_b"] is None
    assert [n["parts"] for n in d[0]["names"]] == [["m", "31"], ["ngc", "224"]]
    s = tables.read_named_stars(spark, str(tmp_path / "stars.csv")).first()
    assert (s["name_lc"], s["bv"]) == ("vega", 0.0) and s["dec"] == pytest.approx(0.67692, abs=1e-3)


def test_constellations_drivers_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"features": [{"properties": {"id": "And", "name": "Andromeda"}, "geometry": {"type": "MultiLineString", "coordinates": [[[-10, 20], [30, 40]]]}}, {"properties": {"id": "Ori"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[1, 2], [3, 4], [5, 6]]]]}}]}')
    got = {r["id"]: r for r in tables.read_constellations(spark, str(tmp_path / "c.json")).collect()}
    assert got["And"]["parts"][0][0]["ra"] == pytest.approx(np.radians(350)) and got["Ori"]["kind"] == "bounds" and len(got["Ori"]["parts"][0]) == 3
    for k, (maker, label) in enumerate((("Zed", "b"), ("abc", "A"))):
        (tmp_path / f"d{k}.xml").write_text(f'<driversList><devGroup group="CCDs"><device label="{label}" manufacturer="{maker}"><driver name="x">exe</driver></device></devGroup></driversList>')
    d = tables.read_drivers(spark, str(tmp_path / "d*.xml")).collect()
    assert len(d) == 1 and [x["label"] for x in d[0]["devices"]] == ["A", "b"]
    (tmp_path / "s.json").write_text('{"a": 5}')
    assert tables.read_settings(spark, str(tmp_path / "s.json"), "a int, b string", {"a": 1, "b": "x"}).first().asDict() == {"a": 5, "b": "x"}


def test_base64(spark):
    got = spark.createDataFrame([("aGVs\nbG8 h",)], "t string").select(tables.decode_base64(F.col("t")).alias("b")).first()["b"]
    assert bytes(got) == b"hello!"


def test_rows_and_pixels(spark):
    rows = spark.createDataFrame([(1, 0, [5, 6]), (1, 1, [7, 8])], "frame long, y int, row array<int>")
    assert sorted(map(tuple, fr.to_rows(fr.to_pixels(rows)).collect())) == [(1, 0, [5, 6]), (1, 1, [7, 8])]


def test_tiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    grey, colour = rng.integers(0, 65536, (1, 70, 9)), rng.integers(0, 65536, (3, 5, 4))
    for name, image in (("g", grey), ("c", colour)):
        (tmp_path / f"{name}.tif").write_bytes(tiff.encode(image))
        assert np.array_equal(tiff.decode(tiff.encode(image)), image)
    got = {(r["path"][-5], r["chan"], r["y"]): r["row"] for r in tiff.read_rows(spark, f"{tmp_path}/*.tif").collect()}
    assert len(got) == 70 + 15 and got["g", "L", 69] == list(grey[0, 69]) and got["c", "B", 2] == list(colour[2, 2])


def test_free_names_of_equal_wishes(spark):
    """Rows that want the same name get different ones, and none gets a name that another wants."""
    wanted = [("a.fit", 1), ("a.fit", 2), ("a.fit", 3), ("b.fit", 1), ("a_2.fit", 1), ("c", 1), ("c", 2)]
    got = tables.free_names(spark.createDataFrame(wanted, "name string, k int"), spark.createDataFrame([("b.fit",), ("a_4.fit",), ("c_2",)], "name string")).collect()
    by = {(r["name"], r["k"]): r["free"] for r in got}
    assert by == {("a.fit", 1): "a.fit", ("a.fit", 2): "a_3.fit", ("a.fit", 3): "a_5.fit", ("b.fit", 1): "b_2.fit", ("a_2.fit", 1): "a_2.fit", ("c", 1): "c", ("c", 2): "c_3"}
    assert len(set(by.values())) == len(wanted)


# --- images -----------------------------------------------------------------------------------------------------------


def png_of(pixels, bits, colour, kinds, extra=()):
    """A PNG of (height, width, samples), its rows filtered by `kinds` in turn, byte by byte."""
    import struct
    import zlib

    height, width, samples = pixels.shape
    rows = []
    for row in pixels.reshape(height, -1).tolist():
        if bits == 16:
            rows.append(b"".join(v.to_bytes(2, "big") for v in row))
        elif bits == 8:
            rows.append(bytes(row))
        else:
            text = "".join(format(v, f"0{bits}b") for v in row)
            rows.append(int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big"))
    step, before, data = max(1, samples * bits // 8), bytes(len(rows[0])), b""
    for y, row in enumerate(rows):
        kind = kinds[y % len(kinds)]
        out = []
        for x, v in enumerate(row):
            a, b, c = row[x - step] if x >= step else 0, before[x], before[x - step] if x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        data += bytes([kind, *out])
        before = row
    packed = zlib.compress(data)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)), *extra, (b"IDAT", packed[:20]), (b"IDAT", packed[20:]), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


LINEAR = (((np.arange(256, dtype=np.float32) / np.float32(255)) ** np.float32(2.4)) * np.float32(65535)).astype(int)


@pytest.mark.parametrize(("bits", "colour", "samples"), [(8, 2, 3), (8, 0, 1), (16, 2, 3), (8, 6, 4), (16, 4, 2), (1, 0, 1), (2, 0, 1), (4, 0, 1)])
def test_png_of_every_filter(bits, colour, samples):
    r = np.random.default_rng(bits + colour)
    pixels = r.integers(0, 1 << bits, (12, 9, samples))
    if samples in (2, 4):
        pixels[..., -1] = r.choice([0, (1 << bits) - 1, (1 << bits) // 2], (12, 9))
    got = png.decode(png_of(pixels, bits, colour, [0, 1, 2, 3, 4, 4, 3]))
    byte = pixels >> 8 if bits == 16 else pixels if bits == 8 else pixels * (255 // ((1 << bits) - 1))
    shown = byte[..., -1] == 255 if samples in (2, 4) else np.ones((12, 9), bool)
    plain = byte[..., : samples - (samples in (2, 4))]
    for k in range(3):
        assert np.array_equal(got[k], np.where(shown, LINEAR[plain[..., k % plain.shape[2]]], 0))


def test_png_of_palettes_and_large_ones():
    palette = np.random.default_rng(3).integers(0, 256, (5, 3), dtype=np.uint8)
    index = np.random.default_rng(4).integers(0, 5, (6, 7, 1))
    got = png.decode(png_of(index, 4, 3, [1, 4], [(b"PLTE", palette.tobytes()), (b"tRNS", b"\xff\x10")]))
    assert np.array_equal(got, np.moveaxis(np.where(index == 1, 0, LINEAR[palette[index[..., 0]]]), 2, 0))
    wide = np.arange(7 * 40).reshape(7, 40, 1) % 256
    small = png.decode(png_of(wide, 8, 0, [2]), longest=20)
    assert small.shape == (3, 3, 20) and small[0, 0, 0] == LINEAR[wide[:2, :2, 0]].sum() // 4
    with pytest.raises(ValueError, match="checksum"):
        png.decode(png_of(wide, 8, 0, [2])[:-20] + bytes(20))


def lzw(data):
    """Codes of 9 to 12 bits, as a TIFF has them."""
    table, width, codes, word = {bytes([k]): k for k in range(256)}, 9, [(256, 9)], b""
    n = 258
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        codes.append((table[word], width))
        table[more] = n
        n += 1
        if n in (512, 1024, 2048):
            width += 1
        if n == 4094:
            codes.append((256, width))
            table, width, n = {bytes([k]): k for k in range(256)}, 9, 258
        word = data[k : k + 1]
    codes += [(table[word], width)] if word else []
    codes.append((257, 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12))
    text = "".join(format(c, f"0{w}b") for c, w in codes)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_packed_strips():
    import zlib

    r = np.random.default_rng(9)
    for data in (b"", b"a", bytes(1000), bytes(r.integers(0, 256, 20_000, dtype=np.uint8)), bytes(r.integers(0, 3, 30_000, dtype=np.uint8)), b"ab" * 500):
        assert tiff.unpack_lzw(lzw(data)) == data
        assert tiff.UNPACK[8](zlib.compress(data)) == data
    assert tiff.unpack_bits(bytes([0xFE, 0xAA, 2, 0x80, 0, 0x2A, 0xFD, 0xAA, 0x80, 3, 1, 2, 3, 4])) == bytes([0xAA] * 3 + [0x80, 0, 0x2A] + [0xAA] * 4 + [1, 2, 3, 4])


def test_packed_tiff_with_differences():
    """A file of two strips, packed by LZW, each value less the one on its left."""
    import struct

    image = np.random.default_rng(12).integers(0, 65536, (6, 5)).astype(np.uint16)
    less = np.diff(image, axis=1, prepend=np.uint16(0)).astype("<u2")
    strips = [lzw(less[:4].tobytes()), lzw(less[4:].tobytes())]
    plain = tiff.encode(image[None].astype(np.int64), strip=4)
    fields = [(256, 4, 5), (257, 4, 6), (258, 3, 16), (259, 3, 5), (262, 3, 1), (277, 3, 1), (278, 4, 4), (317, 3, 2)]
    at = 8 + sum(map(len, strips))
    entries = b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I" if k == 4 else "<HH", *([v] if k == 4 else [v, 0])) for t, k, v in fields)
    after = at + 2 + 12 * (len(fields) + 2) + 4
    entries += struct.pack("<HHII", 273, 4, 2, after) + struct.pack("<HHII", 279, 4, 2, after + 8)
    content = struct.pack("<2sHI", b"II", 42, at) + b"".join(strips) + struct.pack("<H", len(fields) + 2) + entries + struct.pack("<I", 0) + struct.pack("<IIII", 8, 8 + len(strips[0]), *map(len, strips))
    assert np.array_equal(tiff.decode(content), tiff.decode(plain)) and np.array_equal(tiff.decode(content)[0], image)


def test_images_by_their_endings(spark, tmp_path):
    r = np.random.default_rng(6)
    mono, colour = r.integers(0, 65536, (4, 5)), r.integers(0, 256, (3, 4, 5))
    (tmp_path / "a.FIT").write_bytes(fits.encode(colour, bits=8) + fits.encode(mono))
    (tmp_path / "b.fits").write_bytes(fits.encode(colour, bits=8))
    (tmp_path / "c.tiff").write_bytes(tiff.encode(colour.astype(np.int64)))
    (tmp_path / "d.Png").write_bytes(png_of(np.moveaxis(colour, 0, 2), 8, 2, [4]))
    got = images.read_images(spark, str(tmp_path)).collect()
    kinds = {(r["path"].rpartition("/")[2], r["kind"], r["chan"]) for r in got}
    assert kinds == {("a.FIT", "raw", "L"), *[(n, "image", c) for n in ("b.fits", "c.tiff", "d.Png") for c in "RGB"]}
    rows = {(r["path"].rpartition(".")[2], r["chan"], r["y"]): r["row"] for r in got}
    assert all(rows["FIT", "L", y] == list(mono[y]) and rows["fits", "G", y] == list(colour[1, y]) and rows["tiff", "B", y] == list(colour[2, y]) and rows["Png", "R", y] == list(LINEAR[colour[0, y]]) for y in range(4))
    (tmp_path / "e.jpg").write_bytes(b"?")
    with pytest.raises(Exception, match="ending jpg"):
        images.read_images(spark, str(tmp_path)).count()
