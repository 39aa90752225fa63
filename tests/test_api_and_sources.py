"""The front door, readers, configuration and picture files."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil import __main__, api
from spanveil.operators import pixels
from spanveil.sources import io
from spanveil.streaming import sse

KEY = bytes(range(32))


def test_sanitize_and_restore(spark):
    docs = spark.createDataFrame([(1, "mail ann@mail.example.com or 123-45-6789"), (2, "nothing"), (3, None), (4, "`bob@mail.example.com`")], "doc_id long, text string")
    safe, mapping = api.sanitize(docs, KEY)
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert "ann@" not in texts[1] and "123-45-6789" not in texts[1] and texts[2] == "nothing" and texts[3] is None and "bob@" in texts[4]
    assert {r["doc_id"]: r["text"] for r in api.restore(safe, mapping).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in api.redact(docs).collect()}[1] == "mail [EMAIL] or [SSN]"
    assert "[EMAIL]" in {r["doc_id"]: r["text"] for r in api.redact(docs, engine="lite").collect()}[4]
    with pytest.raises(ValueError):
        api.redact(docs, engine="none")


def test_scan_response(spark):
    rows = spark.createDataFrame([(1, "Act now, hurry up! Limited supply."), (2, "The report.")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_flags"], r["shown"]) for r in api.scan_response(rows).collect()}
    assert got == {1: (3, True), 2: (0, False)}
    assert not any(r["shown"] for r in api.scan_response(rows, io.Config(sensitivity="off")).collect())


def test_command_line(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps({"doc_id": 5, "text": "write to a@b.example.org"}) + "\n")
    (tmp_path / "c.toml").write_text("min_confidence = 0.4\n")
    __main__.main(["detect", f"{tmp_path}/in.json", f"{tmp_path}/out", "--config", f"{tmp_path}/c.toml"])
    assert [(r["doc_id"], r["value"]) for r in spark.read.json(f"{tmp_path}/out").collect()] == [(5, "a@b.example.org")]


def test_configuration_comes_from_files_and_environment(tmp_path):
    (tmp_path / "c.toml").write_text('sensitivity = "low"\nleast_flags = 2\n')
    own = io.loaded_config(f"{tmp_path}/c.toml", {"SPANVEIL_LEAST_FLAGS": "5", "SPANVEIL_ENGINE": "crf", "SPANVEIL_OTHER": "x", "PATH": "/"})
    assert (own.sensitivity, own.least_flags, own.engine) == ("low", 5, "crf")
    (tmp_path / "d.toml").write_text("unknown = 1\n")
    with pytest.raises(ValueError):
        io.loaded_config(f"{tmp_path}/d.toml", {})


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo é")
    assert [r["text"] for r in io.whole_texts(spark, f"{tmp_path}/t").collect()] == ["one\ntwo é"]
    assert [r["body"] for r in io.json_bodies(spark, f"{tmp_path}/t").collect()] == ["one\ntwo é"]
    (tmp_path / "t.tsv").write_text('Card\tAt\n0012\t"1, 2"\n')
    assert [tuple(r) for r in io.delimited(spark, f"{tmp_path}/t.tsv", ["card", "at"], "\t").collect()] == [("0012", "1, 2")]
    rows = spark.createDataFrame([("x", [1, 0], "s")], io.TRAINING)
    io.write_json_lines(rows, f"{tmp_path}/j")
    assert io.json_lines(spark, f"{tmp_path}/j").collect() == rows.collect()
    (tmp_path / "p.png").write_bytes(pixels.png_encoded(np.zeros((2, 2, 1), np.uint8)))
    assert io.media(spark, f"{tmp_path}/p.png").first()["head"].startswith("89504E47")
    for _ in range(2):
        io.append(rows, f"{tmp_path}/grown")
    assert spark.read.parquet(f"{tmp_path}/grown").count() == 2
    kept, refused = io.accepted(spark.createDataFrame([(1, "ab"), (2, "abcd")], "request_id int, body string"), 3)
    assert [r["request_id"] for r in kept.collect()] == [1] and [tuple(r) for r in refused.collect()] == [(2, 413)]


def png(pixels_, kinds):
    """A PNG whose lines use the given filters, by the format's own definition."""
    height, width, n = pixels_.shape
    a, data = pixels_.astype(int).reshape(height, -1), b""
    for y, kind in enumerate(kinds):
        line = []
        for x in range(width * n):
            left, up = a[y, x - n] if x >= n else 0, a[y - 1, x] if y else 0
            corner = a[y - 1, x - n] if y and x >= n else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line.append((a[y, x] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        data += bytes([kind, *line])
    whole = pixels.png_encoded(pixels_)
    at = whole.index(b"IDAT")
    body = zlib.compress(data)
    return whole[: at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big") + whole[whole.index(b"IEND") - 4 :]


def test_png_files(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4):
        image = rng.integers(0, 256, (5, 7, n)).astype(np.uint8)
        assert (pixels.png_decoded(png(image, [0, 1, 2, 3, 4])) == image).all() and (pixels.png_decoded(pixels.png_encoded(image)) == image).all()
    assert pixels.png_decoded(b"GIF89a") is None and pixels.png_decoded(None) is None and pixels.png_decoded(pixels.png_encoded(image)[:40]) is None
    big = pixels.png_encoded(np.full((30, 60, 3), 7, np.uint8))
    df = spark.createDataFrame([(big,), (b"no",), (None,)], "content binary")
    got = [r[0] for r in df.select(pixels.rewritten(F.col("content"), 20)).collect()]
    small = pixels.png_decoded(bytes(got[0]))
    assert small.shape == (10, 20, 3) and (small == 7).all() and got[1:] == [None, None]


def test_entity_windows(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:30:00' AS ts, 'ssn' AS type UNION ALL SELECT timestamp'2024-01-01 00:59:00', 'ssn' UNION ALL SELECT timestamp'2024-01-01 01:00:00', 'email'")
    assert sorted((r["type"], r["n"]) for r in sse.entity_windows(rows).collect()) == [("email", 1), ("ssn", 2)]
