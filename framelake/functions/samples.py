"""Sample metadata as JSON, typed in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.scores import default_position
from framelake.functions.text import clip_label_text

#: The fields of a frame crop's and of a clip's metadata, in order, with the types they are read as.
CROP_FIELDS = """key string, video_id string, frame_path string, category string, video_name string, label string, binary_label string, split string,
 frame_number string, original_frame_index string, timestamp string, video_fps string, extraction_fps string, width string, height string,
 face_detected int, num_faces int, face_confidence double, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, bbox_source string,
 landmarks map<string,array<double>>, alignment_mode string, crop_scale double, crop_status string, crop_x1 int, crop_y1 int, crop_x2 int, crop_y2 int,
 crop_size int, crop_source string, aligned_width int, aligned_height int, aligned_size array<int>, image_format string, detect_every_k int"""
CLIP_FIELDS = """key string, split string, category string, video_id string, video_name string, binary_label int, label string, clip_length int, frame_stride int,
 clip_stride int, clip_start int, num_differences int, frame_numbers array<long>, original_frame_indices array<long>, timestamps array<double>,
 source_keys array<string>, center_candidate_indices array<int>, default_center_index int, spatial_sampling_note string, extraction_fps double,
 video_fps double, height int, width int, rgb_dtype string, diff_dtype string"""
NOTE = "training draws one of the candidate positions, evaluation takes the default one"


def names(fields: str) -> list[str]:
    """The field names of a schema text."""
    depth, out, word = 0, [], ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


def parse_sample_json(document: Column | str, fields: str = CLIP_FIELDS) -> Column:
    """A sample's metadata as a struct of `fields`; fields that are absent or of another type are null, as is a broken document."""
    return F.from_json(F.col(document) if isinstance(document, str) else document, fields)


def clip_json(clips: DataFrame, frame_stride: int = 1, clip_stride: int = 6, note: str = NOTE) -> DataFrame:
    """Adds `json`, a clip's whole metadata, to clips of `build_clips` that carry split, video_name, extraction_fps, video_fps, height and width."""
    own = {
        "frame_stride": F.lit(frame_stride),
        "clip_stride": F.lit(clip_stride),
        "spatial_sampling_note": F.lit(note),
        "rgb_dtype": F.lit("uint8"),
        "diff_dtype": F.lit("uint8"),
        "default_center_index": F.coalesce("default_center_index", F.lit(default_position([]))),
        "label": clip_label_text("binary_label"),
    }
    fields = [own.get(c, F.col(c)).alias(c) for c in names(CLIP_FIELDS)]
    return clips.withColumn("json", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def crop_json(crops: DataFrame, crop_scale: float, detect_every: int, image_format: str, size: tuple[int, int]) -> DataFrame:
    """Adds `json`, a frame crop's whole metadata, to frames with their detection (see `interpolate_detections`) and crop_box.

    Fields of the frame table that are absent are empty texts; a missing box is four zeros.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in crops.columns else F.lit("")
    corner = lambda box, k: F.coalesce(F.col(box)[k].cast("int"), F.lit(0))
    height, width = size
    own = {
        "face_detected": F.lit(1),
        "num_faces": F.col("num_faces").cast("int"),
        "face_confidence": F.col("confidence"),
        **{f"{name}_{c}": corner(box, k) for name, box in (("bbox", "bbox"), ("crop", "crop_box")) for k, c in enumerate(("x1", "y1", "x2", "y2"))},
        "bbox_source": F.col("source"),
        "landmarks": F.col("landmarks"),
        "alignment_mode": F.lit("none_bbox_crop"),  # fixed value
        "crop_scale": F.lit(float(crop_scale)),
        "crop_status": F.lit("ok"),
        "crop_size": F.greatest(corner("crop_box", 2) - corner("crop_box", 0), corner("crop_box", 3) - corner("crop_box", 1)),
        "crop_source": F.lit("original_bbox"),  # fixed value
        "aligned_width": F.lit(width),
        "aligned_height": F.lit(height),
        "aligned_size": F.array(F.lit(width), F.lit(height)),
        "image_format": F.lit(image_format),
        "detect_every_k": F.lit(detect_every),
    }
    fields = [own[c].alias(c) if c in own else text(c).alias(c) for c in names(CROP_FIELDS)]
    return crops.withColumn("json", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
