import json

import numpy as np

from argentum import cli
from argentum.functions import imaging as im
from argentum.operators import face_job


def test_transform_recovers_rotation_scale_and_shift():
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(5, 2)) * 10
    c, s = np.cos(0.7) * 2, np.sin(0.7) * 2
    m = np.array([[c, -s, 4], [s, c, -3]])
    moved = pts @ m[:, :2].T + m[:, 2]
    assert np.allclose(im.similarity_transform(pts, moved), m)


def test_warp_and_sampling():
    image = np.add.outer(np.arange(20.0), np.arange(30.0))[..., None].repeat(3, 2)
    same = im.warp(image, np.array([[1.0, 0, 0], [0, 1, 0]]), 10)
    assert np.allclose(same, image[:10, :10])
    half = im.sample(image, np.array([[1.5]]), np.array([[2.5]]))
    assert np.allclose(half, 4.0) and np.allclose(im.sample(image, np.array([[-5.0]]), np.array([[0.0]])), 0)


def test_orientations_undo_each_other():
    image = np.arange(24).reshape(2, 4, 3)
    upright = {1: image, 2: image[:, ::-1], 3: image[::-1, ::-1], 4: image[::-1], 5: image.transpose(1, 0, 2), 6: np.rot90(image, -1), 7: np.rot90(image, 2).transpose(1, 0, 2), 8: np.rot90(image)}
    for k, want in upright.items():
        assert (im.orient(image, k) == want).all(), k


def test_sizes_and_ranges():
    image = np.full((50, 80, 3), 255, np.uint8)
    t = im.image_to_tensor(image, 16)
    assert t.shape == (3, 16, 16) and np.allclose(t, 1.0)
    assert im.crop_face(image, (70, 40, 20, 20)).shape == (140, 140, 3)


def test_detections_are_decoded_and_overlaps_removed():
    side = 640 // 32
    scores = np.zeros(side * side * 2)
    scores[[0, 1, 50]] = [0.9, 0.8, 0.7]
    distances, offsets = np.ones((len(scores), 4)), np.zeros((len(scores), 10))
    got = im.decode_detections({32: (scores, distances, offsets)}, 640, 0.5)
    assert [round(f["score"], 1) for f in got] == [0.9, 0.7] and got[0]["bbox"] == [-64.0, -64.0, 64.0, 64.0]
    assert im.iou([0, 0, 2, 2], [1, 0, 3, 2]) == 1 / 3


def test_face_job(spark):
    def load(path):
        if path == "/bad":
            raise OSError("no")
        return np.zeros((120, 120, 3))

    marks = im.ALIGNED.tolist()
    detect = lambda image: [{"bbox": [1, 2, 101, 92], "score": 0.9, "landmarks": marks}]
    embed = lambda faces: np.tile([3.0, 4.0], (len(faces), 1))
    todo = spark.createDataFrame([("h1", "/a"), ("h2", "/bad")], "hash string, path string")
    got = face_job.detect_faces(todo, load, detect, embed, 2)
    faces = face_job.faces_of(got, 10).collect()
    assert [(f.id, f.hash, f.bbox) for f in faces] == [(10, "h1", "1,2,100,90")] and np.allclose(faces[0].embedding, [0.6, 0.8])
    assert [r.hash for r in face_job.scanned_of(got).collect()] == ["h1"]
    assert face_job.counters(got).head().asDict() == {"processed": 2, "faces": 1, "errors": 1}
    blank = face_job.detect_faces(todo.where("hash = 'h1'"), load, lambda image: [], embed, 1)
    assert face_job.faces_of(blank).count() == 0 and face_job.scanned_of(blank).count() == 1


def test_command_line(spark, tmp_path, capsys):
    from argentum.queries.sources import exif_jpeg

    media = tmp_path / "media"
    media.mkdir()
    for name in ("a.jpg", "b.jpg"):
        (media / name).write_bytes(exif_jpeg("2020:05:06 07:08:09"))
    home = str(tmp_path / "home")
    assert cli.main(["--home", home, "scan", str(media)], spark) == 0
    capsys.readouterr()
    assert cli.main(["--home", home, "--json", "search", "--date", "2020-05", "--type", "image"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["rows"]) == 2
    assert cli.main(["--home", home, "dedupe"], spark) == 0
    assert capsys.readouterr().out.strip().endswith("b.jpg")
    assert cli.main(["--home", home, "--json", "search"], spark) == 1
    assert "error" in json.loads(capsys.readouterr().out)
    assert cli.main(["--home", home, "gallery", str(tmp_path / "g.html")], spark) == 0
    assert cli.main(["--home", home, "status"], spark) == 0
