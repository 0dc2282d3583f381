"""One bad file is an error in its report row; the others are carried over."""

from strandweave.operators import sidecars

VTT = "WEBVTT\n\n00:01.000 --> 00:03.000 align:left\nhi é😀\n\n00:04.000 --> 00:04.500\n<b></b>\n\n00:05.000 --> 00:06.000\nbye\n\n00:05.000 --> 00:06.000\nbye\n"
ASS = "[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.00,{\\i1}a, b\nDialogue: 0,0:00:02.00,0:00:03.00,{\\p1}m 0 0 l 1 1\n"


def test_report(spark):
    files = {
        "utf8": ("vtt", VTT.encode()), "utf16": ("VTT", b"\xff\xfe" + VTT.encode("utf-16-le")), "big": ("vtt", b"\xfe\xff" + VTT.encode("utf-16-be")), "utf32": ("vtt", b"\xff\xfe\x00\x00" + VTT.encode("utf-32-le")), "ass": ("ass", ASS.encode()),
        "headless": ("vtt", VTT[6:].encode()), "cut": ("vtt", VTT.encode() + b"\xc3"), "lone": ("vtt", b"\xff\xfe" + VTT.encode("utf-16-le") + b"\x00\xd8"), "odd": ("vtt", b"\xfe\xff" + VTT.encode("utf-16-be")[:-1]), "srt": ("srt", b"1"), "empty": ("ass", b""), "null": ("vtt", None),
    }
    rows = spark.createDataFrame([("x", d, s, c) for d, (s, c) in files.items()], "series string, doc string, suffix string, content binary")
    pieces = spark.createDataFrame([("x", 0.0, 2.0, 0.0, 2.0), ("x", 12.0, 20.0, 2.0, 10.0)], "series string, t0 double, t1 double, x0 double, x1 double")
    videos = spark.createDataFrame([("x", 0.0, 5.5)], "series string, start double, length double")
    texts, report = sidecars.transferred(rows, pieces, videos, ["series"], 1 / 24)
    told = {r.doc: (r.error, r.cues_in, r.cues_out, r.dropped_drawings, r.dropped_empty, r.dropped_duplicates, r.dropped_settings) for r in report.collect()}
    # hi is in two pieces, bye ends with the video
    assert {d: told[d] for d in ("utf8", "utf16", "big", "utf32")} == dict.fromkeys(("utf8", "utf16", "big", "utf32"), (None, 4, 3, 0, 1, 1, 1))
    assert told["ass"][:3] == (None, 2, 1) and sum(told["ass"][3:]) == 1 and told["empty"] == (None, 0, 0, 0, 0, 0, 0)
    assert told["headless"][0] == "no WEBVTT header" and told["srt"][0] == "no reader for .srt"
    assert {told[d][0] for d in ("cut", "lone", "odd", "null")} == {"not text in its encoding"} and set(told) == set(files)
    written = {r.doc: r.text for r in texts.collect()}
    assert set(written) == {"utf8", "utf16", "big", "utf32", "ass"} and "hi é😀" in written["utf16"] and written["utf8"] == written["utf32"] == written["big"]
    assert "00:00:15,000 --> 00:00:15,500\nbye" in written["utf8"]
