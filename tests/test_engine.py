"""The whole way from files to an archive, geometry, and the installation's tables."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import picture, png

from framesieve.engine import MediaEngine
from framesieve.functions import geometry
from framesieve.operators import faces, host


def test_library_end_to_end(spark, tmp_path):
    shots = {"IMG_0001": (picture(5, 700), 100), "IMG_0002": (picture(5, 700), 101), "IMG_0100": (picture(90, 700).transpose(1, 0, 2).copy(), 4000)}
    for name, (pixels, at) in shots.items():
        path = tmp_path / f"{name}.png"
        path.write_bytes(png(pixels))
        os.utime(path, (at, at))
    (tmp_path / "IMG_0001.xmp").write_bytes(b"side")
    engine = MediaEngine(spark)
    found = engine.scan(str(tmp_path)).cache()
    infos = engine.describe(str(tmp_path), found).withColumn("rejected", F.lit(False)).cache()
    assert [r["failure"] for r in infos.collect()] == [None] * 3
    groups = engine.group(infos).cache()
    named = {}
    for r in groups.join(infos.select("id", "path"), "id").collect():
        named.setdefault(r["group_id"], set()).add(r["path"].rsplit("/", 1)[1])
    assert sorted(map(sorted, named.values())) == [["IMG_0001.png", "IMG_0002.png"], ["IMG_0100.png"]]
    pair = next(g for g, n in named.items() if len(n) == 2)
    made = spark.createDataFrame([(pair, 0, "choose", "right")], "group_id long, seq long, action string, arg string")
    states = engine.select(groups, infos, made)
    plan = engine.archive(states, found, spark.createDataFrame([], "path string")).collect()
    assert sorted((r["src"].rsplit("/", 1)[1], r["dst"]) for r in plan) == [("IMG_0001.png", "winners/IMG_0001.png"), ("IMG_0001.xmp", "winners/IMG_0001.xmp"), ("IMG_0002.png", "losers/IMG_0002.png"), ("IMG_0100.png", "winners/IMG_0100.png")]
    again = engine.describe_new(str(tmp_path), found, infos.select("path", "size", "mtime", "phash"))
    assert again.count() == 3 and again.filter("phash IS NOT NULL").count() == 3


def test_transforms():
    rng = np.random.default_rng(4)
    angle, scale = 0.4, 1.7
    m = np.hstack([scale * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]), [[3.0], [-5.0]]])
    p = rng.normal(size=(5, 2)) * 20
    assert np.allclose(geometry.similarity_transform(p, geometry.moved(m, p)), m)
    assert np.allclose(geometry.moved(geometry.inverted(m), geometry.moved(m, p)), p)
    same = rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)
    assert (geometry.warped(same, np.array([[1.0, 0, 0], [0, 1, 0]]), 30, 20) == same).all()
    assert geometry.aligned_face(same, geometry.ALIGNED).shape == (112, 112, 3)
    assert geometry.tensor(same, (0.5,) * 3, (0.5,) * 3).shape == (1, 3, 20, 30) and geometry.centre_crop(same, 10).shape == (10, 10, 3)


def test_matches_and_inliers():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    b = a[::-1].copy()
    b[0] = rng.integers(0, 256, 32)
    found = geometry.mutual_matches(a, b)
    assert {(i, j) for i, j in found.tolist()} == {(39 - j, j) for j in range(1, 40)}
    p = rng.uniform(0, 400, (40, 2))
    h = np.array([[1.1, 0.05, 12], [-0.04, 0.95, -7], [1e-4, -5e-5, 1]])
    q = np.column_stack([p, np.ones(40)]) @ h.T
    q = q[:, :2] / q[:, 2:]
    q[30:] = rng.uniform(0, 400, (10, 2))
    assert 30 <= geometry.inlier_count(p, q) <= 33 and geometry.inlier_count(p[:7], q[:7]) == 0


def test_detector_and_suppression(spark):
    scores, distances = np.zeros((8, 1)), np.ones((8, 4))
    scores[[0, 7], 0] = 0.9, 0.6
    boxes, kept = geometry.detector_boxes(scores, distances, 8, 16)
    assert boxes.tolist() == [[0, 0, 8, 8], [0, 0, 16, 16]] and kept.tolist() == [0.9, 0.6]
    rows = [("x", 0.0, 0.0, 10.0, 10.0, 0.9, "a"), ("x", 1.0, 1.0, 10.0, 10.0, 0.8, "b"), ("x", 8.0, 8.0, 20.0, 20.0, 0.7, "c"), ("y", 0.0, 0.0, 1.0, 1.0, 0.1, "d")]
    table = spark.createDataFrame(rows, "image string, x1 double, y1 double, x2 double, y2 double, score double, tag string")
    assert sorted(r["tag"] for r in faces.suppressed(table).collect()) == ["a", "c", "d"]
    e = np.eye(3)
    assert faces.match_faces(e, e) == 1.0 and faces.match_faces(e[:0], e[:0]) == 1.0 and faces.match_faces(e[:0], e) == 0.0
    assert faces.match_faces(e[[0, 0]], e[[0, 1]]) == pytest.approx(1 / 3)


def test_installation(spark, tmp_path):
    data = b"weights"
    manifest = {"id": "expert", "version": "1", "files": [{"path": "a", "sha256": hashlib.sha256(data).hexdigest().upper(), "size_bytes": 7}, {"path": "b", "sha256": "0", "size_bytes": 7}, {"path": "c", "sha256": "0", "size_bytes": 1}, {"path": "d", "sha256": "0", "size_bytes": 7}]}
    (tmp_path / "m.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(manifest).encode())
    m = host.read_manifests(spark, str(tmp_path / "m.json"))
    files = spark.createDataFrame([(p, data) for p in "abc"], "path string, content binary")
    assert {(r["path"], r["state"]) for r in host.verified_files(m, files).collect()} == {("a", "ok"), ("b", "checksum"), ("c", "size"), ("d", "missing")}
    assert host.install_size(m).first()["bytes"] == 22
    key = hashlib.sha256("/ä".encode() + (480).to_bytes(4, "little")).hexdigest()[:16]
    payload = lambda p: host.judge_payload(F.lit(p), F.lit("m"), F.lit("data:image/jpeg;base64,QQ=="), F.lit('say "x"'))
    row = spark.range(1).select(host.thumbnail_key(F.lit("/ä"), 480), payload("chat"), payload("responses"), payload("messages"), host.model_list(F.lit('{"data":[{"id":"a"},{"x":1},{"id":"b"}]}')), host.data_url(F.lit(b"A"))).first()
    assert row[0] == key and row[4] == ["a", "b"] and row[5] == "data:image/jpeg;base64,QQ=="
    chat, responses, messages = (json.loads(row[k]) for k in (1, 2, 3))
    assert chat["messages"][0]["content"] == [{"type": "image_url", "image_url": {"url": "data:image/jpeg;base64,QQ=="}}, {"type": "text", "text": 'say "x"'}]
    assert responses["input"][0]["content"][0]["image_url"].endswith("QQ==") and responses["max_output_tokens"] == 384
    assert messages["messages"][0]["content"][0]["source"] == {"type": "base64", "media_type": "image/jpeg", "data": "QQ=="}
    meta = host.meta_entry({"camera": F.lit("c"), "lens": F.lit(None).cast("string")}, {"score": F.lit(5)}, F.lit(1.5))
    assert json.loads(spark.range(1).select(meta).first()[0]) == {"camera": "c", "score": 5, "mtime": 1.5}
    logs = spark.createDataFrame([(f"/x/_pic_selecter/jobs/{k}.log", k) for k in range(60)] + [("/x/other.log", 99)], "path string, mtime long")
    assert [r["mtime"] for r in host.job_logs(logs).collect()] == list(range(59, 9, -1))
    assert [r["name"] for r in host.logos(spark.createDataFrame([("/a/logos/b.png",), ("/a/logos/a.PNG",), ("/a/x.png",)], "path string")).collect()] == ["a.PNG", "b.png"]
