"""User code inside Spark: face detectors and clip models, built once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FACES = "array<struct<bbox:array<int>,score:double,landmarks:map<string,array<double>>>>"


def faces_of(answer: object) -> list[dict]:
    """Well-formed faces of a detector's answer (name -> facial_area, score, landmarks); others are skipped."""
    faces = []
    for face in answer.values() if isinstance(answer, dict) else ():
        box = face.get("facial_area") if isinstance(face, dict) else None
        if box is None or len(box) != 4:
            continue
        marks = face.get("landmarks")
        marks = {k: [float(v[0]), float(v[1])] for k, v in marks.items()} if isinstance(marks, dict) else None
        faces.append({"bbox": [int(v) for v in box], "score": float(face.get("score", 0.0)), "landmarks": marks})
    return faces


def detect_faces(images: DataFrame, make_detector: Callable[[], object], threshold: float = 0.9) -> DataFrame:
    """key, status, candidates, error_message for images (key, image HWC bytes, height, width)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                try:
                    image = np.frombuffer(r.image, np.uint8).reshape(r.height, r.width, 3)
                    faces = faces_of(detector.detect_faces(image, threshold=threshold))
                    out.append((r.key, "ok" if faces else "no_face", faces, None))
                except Exception as error:  # the user's detector may raise anything; the row says what
                    out.append((r.key, "detect_error", [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["key", "status", "candidates", "error_message"])

    return images.select("key", "image", "height", "width").mapInPandas(run, f"key string, status string, candidates {FACES}, error_message string")


def score_clips(samples: DataFrame, make_model: Callable[[], Callable[[list[bytes], list[bytes]], list[float]]]) -> DataFrame:
    """key and prob_positive of prepared clips (key, spatial, temporal) by a model that takes batches of both parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for rows in batches:
            yield pd.DataFrame({"key": rows["key"], "prob_positive": np.asarray(model(list(rows["spatial"]), list(rows["temporal"])), float)})

    return samples.select("key", "spatial", "temporal").mapInPandas(run, "key string, prob_positive double")
