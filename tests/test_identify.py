import json

from lodestone.operators import identify

INDEX = [(0, "cam-a", [1.0, 0.0]), (1, "cam-b", [0.0, 1.0])]


def test_detections_get_their_records(spark):
    cols = "detection_id long, x_min double, y_min double, x_max double, y_max double, confidence double, width int, height int, content binary"
    rows = [(1, 10.0, 10.0, 20.0, 20.0, 0.9, 22, 100, b"a"), (2, 5.0, 5.0, 9.0, 9.0, 0.2, 50, 50, b"a"), (3, 30.0, 5.0, 30.0, 9.0, 0.8, 50, 50, b"b"), (4, 1.0, 1.0, 3.0, 3.0, 0.25, 50, 50, b"x")]
    detections = spark.createDataFrame(rows, cols)
    index = spark.createDataFrame(INDEX, "row_id long, camera_id string, embedding array<double>")
    catalog = spark.createDataFrame([("cam-a", "A")], "camera_id string, model_name string")
    embed = lambda contents, boxes: [{b"a": [1.0, 0.0], b"b": [0.0, 1.0]}.get(bytes(c)) for c in contents]
    got = {r.detection_id: r for r in identify.identify(detections, embed, index, catalog, k=2).collect()}
    assert set(got) == {1, 4} and tuple(got[1].box) == (9, 9, 21, 21) and got[4].matches == []
    assert [(m.rank, m.camera_id, m.record.model_name) for m in got[1].matches] == [(1, "cam-a", "A")]
    kept = identify.identify(detections, embed, index, catalog, keep_degenerate=True)
    assert {r.detection_id: len(r.matches) for r in kept.collect()} == {1: 1, 3: 0, 4: 0}
    shown = {r.detection_id: json.loads(r.metadata) for r in identify.metadata(kept).collect()}
    assert shown[1] == {"bbox": [9, 9, 21, 21], "confidence": 0.9, "matches": [{"camera_id": "cam-a", "score": 1.0}]}
