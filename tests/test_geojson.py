"""S-06: GeoJSON read feature by feature by many tasks."""

import json
import os
import random
import tempfile

from territoria.sources import files


def _document(n: int, seed: int) -> dict:
    rng = random.Random(seed)
    words = ["}", "{", '"', "\\", "\\\"", "}{", "São", "", "\\\\}", "a,b]"]

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))

    feats = []
    for i in range(n):
        rings = [[[round(rng.uniform(-60, 60), 6), round(rng.uniform(-30, 30), 6)] for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 3))]
        multi = i % 3 == 0
        f = {"type": "Feature", "properties": {text() or "k": text(), "NM_MUN": f"Cidade {i}", "UF": "SP", "sub": {"x": {"y": text()}}},
             "geometry": {"type": "MultiPolygon" if multi else "Polygon", "coordinates": [rings] if multi else rings}}
        if i % 4 == 0:
            f = dict(reversed(list(f.items())))
        if i % 7 == 0:
            f["properties"]["NM_MUN"] = None
        feats.append(f)
    return {"type": "FeatureCollection", "name": text(), "crs": {"type": "name", "properties": {"name": "} {"}}, "features": feats, "end": text()}


def _plain(doc: dict) -> list:
    out = []
    for f in doc["features"]:
        name = f["properties"]["NM_MUN"]
        if not name:
            continue
        g = f["geometry"]
        rings = g["coordinates"] if g["type"] == "Polygon" else [r for part in g["coordinates"] for r in part]
        for i, ring in enumerate(rings):
            out += [(name.upper(), "SP", i, j, x, y) for j, (x, y) in enumerate(ring)]
    return sorted(out)


def test_features_equal_json_whatever_the_splits(spark):
    folder = tempfile.mkdtemp(prefix="s06-")
    docs = []
    for k, indent in enumerate((None, 1)):
        doc = _document(60, k)
        for f in doc["features"]:
            if f["properties"]["NM_MUN"]:
                f["properties"]["NM_MUN"] += f" {k}"
        docs.append(doc)
        with open(os.path.join(folder, f"d{k}.json"), "w", encoding="utf-8") as f:
            json.dump(doc, f, indent=indent, ensure_ascii=k == 0)
    want = sorted(_plain(docs[0]) + _plain(docs[1]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300b", "5000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.scan_polygons(spark, folder)
            assert sorted(map(tuple, got.collect())) == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_collection(spark):
    folder = tempfile.mkdtemp(prefix="s06-")
    with open(os.path.join(folder, "d.json"), "w") as f:
        f.write('{"type": "FeatureCollection", "features": []}\n')
    assert files.scan_polygons(spark, folder).count() == 0
