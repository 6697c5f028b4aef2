"""Keys, labels, splits and coercions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The known categories and whether they hold real videos (1) or manipulated ones (0).
CATEGORY_LABELS = {
    "original": 1,
    "Deepfakes": 0,
    "Face2Face": 0,
    "FaceShifter": 0,
    "FaceSwap": 0,
    "NeuralTextures": 0,
    "Celeb-real": 1,
    "YouTube-real": 1,
    "Celeb-synthesis": 0,
}
SPLITS = ("train", "val", "test")
#: The position given to a frame that names none.
NO_POSITION = 10**12


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    """Trimmed text; null is empty."""
    return F.coalesce(F.trim(_col(x).cast("string")), F.lit(""))


def filled(x: Column | str) -> Column:
    """Trimmed text; empty is null, so that `coalesce` goes on to the next field."""
    return F.nullif(F.trim(_col(x).cast("string")), F.lit(""))


def safe_int(x: Column | str, default: int = 0) -> Column:
    """Whole numbers only; anything else is the default."""
    trimmed = F.trim(_col(x).cast("string"))
    return F.coalesce(F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("bigint")), F.lit(default).cast("bigint"))


def safe_int_trunc(x: Column | str, default: int = 0) -> Column:
    """Numbers with a fraction lose it; anything else is the default."""
    number = F.trim(_col(x).cast("string")).try_cast("double")
    return F.coalesce(F.when(number.isNotNull() & ~F.isnan(number), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint")), F.lit(default).cast("bigint"))


def safe_float(x: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(_col(x).cast("string")).try_cast("double"), F.lit(default))


def category_label(category: Column | str) -> Column:
    """1 real, 0 manipulated, null for unknown categories."""
    out = F.lit(None).cast("int")
    for name, value in CATEGORY_LABELS.items():
        out = F.when(_col(category) == name, value).otherwise(out)
    return out


def infer_compression(name: Column | str) -> Column:
    low = F.lower(_col(name))
    return F.when(low.contains("celeb"), "celeb-dc").when(low.contains("c40"), "c40").when(low.contains("c23"), "c23").otherwise("unknown")


def split_group_key(category: Column | str, video_id: Column | str) -> Column:
    """Videos that must share a split: the part before `__` for one category, originals by id, pairs by their id."""
    c, v = _col(category), _col(video_id)
    return F.when(c == "DeepFakeDetection", F.substring_index(v, "__", 1)).when(c == "original", v).when(v.contains("_"), v).otherwise(F.concat(c, F.lit(":"), v))


def stable_hash(x: Column | str) -> Column:
    return F.md5(_col(x))


def normalize_split(split: Column | str, on_invalid: str | None = None) -> Column:
    """Trimmed lower case; with `on_invalid`, anything but train, val and test becomes that."""
    low = F.lower(text(split))
    return low if on_invalid is None else F.when(low.isin(*SPLITS), low).otherwise(on_invalid)


def video_key(category: Column | str, video_id: Column | str, split: Column | str) -> Column:
    return F.concat_ws("|", text(category), text(video_id), normalize_split(split))


def file_stem(path: Column | str) -> Column:
    return F.regexp_extract(F.replace(_col(path), F.lit("\\"), F.lit("/")), r"([^/]*?)(\.[^./]*)?$", 1)


def group_key(category: Column | str, video_name: Column | str, video_id: Column | str, frame_path: Column | str) -> Column:
    """`category/video`, with the id and then the frame's file stem in place of a missing name."""
    name = F.coalesce(filled(video_name), filled(video_id), F.nullif(file_stem(text(frame_path)), F.lit("")), F.lit("unknown_video"))
    return F.concat_ws("/", filled(category), name)


def canonical_video_id(category: Column | str, video_name: Column | str, video_id: Column | str) -> Column:
    both = F.when(filled(category).isNotNull() & filled(video_name).isNotNull(), F.concat_ws("/", filled(category), filled(video_name)))
    return F.replace(F.coalesce(filled(video_id), both, filled(video_name), F.lit("unknown_video")), F.lit("\\"), F.lit("/"))


def sample_key(category: Column | str, video_name: Column | str, frame_path: Column | str, *frame_fields: Column | str) -> Column:
    """`category/video/frame`; frames without a path are named after the first frame field that is filled."""
    name = F.coalesce(filled(video_name), F.lit("unknownvideo"))
    number = F.coalesce(*map(filled, frame_fields), F.lit("0"))
    stem = F.when(filled(frame_path).isNotNull(), file_stem(text(frame_path))).otherwise(F.concat_ws("_", name, number))
    return F.replace(F.concat_ws("/", F.coalesce(filled(category), F.lit("unknown")), name, stem), F.lit("\\"), F.lit("/"))


def frame_filename(video: Column | str, n: Column | str) -> Column:
    return F.concat(_col(video), F.lit("_frame_"), F.format_string("%05d", _col(n).cast("bigint")), F.lit(".jpg"))


def parse_frame_filename(path: Column | str) -> Column:
    """(video, number) from the last `_frame_` of the stem; null where no whole number follows it."""
    stem = file_stem(path)
    video, number = F.regexp_extract(stem, r"^(.*)_frame_(\d+)$", 1), F.regexp_extract(stem, r"^(.*)_frame_(\d+)$", 2)
    return F.when(number != "", F.struct(video.alias("video_name"), number.try_cast("bigint").alias("frame_number")))


def frame_position(frame_path: Column | str, *fields: Column | str) -> Column:
    """The first filled field if it is a whole number, else the digits of the file stem, else a position after all others."""
    first = F.coalesce(*[F.nullif(_col(f).cast("string"), F.lit("")) for f in fields], F.lit(""))
    digits = F.regexp_replace(file_stem(text(frame_path)), r"\D", "")
    return F.coalesce(F.when(F.trim(first).rlike(r"^\d+$"), F.trim(first).try_cast("bigint")), digits.try_cast("bigint"), F.lit(NO_POSITION).cast("bigint"))


def text_label(label: Column | str, polarity: str = "fake") -> Column:
    """0 or 1 from the words real, original and fake; `polarity` names the kind that 1 stands for. Null for other texts."""
    low = F.lower(text(label))
    real, fake = (0, 1) if polarity == "fake" else (1, 0)
    return F.when(low.isin("real", "original"), real).when(low == "fake", fake)


def digit_label(field: Column | str) -> Column:
    """0 or 1 of a field that holds just that; null for anything else."""
    shown = _col(field).cast("string")
    return F.when(shown.isin("0", "1"), shown.cast("int"))


def resolve_label(cls: Column | str, binary_label: Column | str, label: Column | str, invert: bool = False, strict: bool = False, polarity: str = "fake") -> Column:
    """0 or 1 of a sample: its class part, else the numeric field, else the text.

    A class part that is there decides: a bad one is unresolved, whatever the other fields say. Unresolved is -1, or an
    error if `strict`.
    """
    part = F.trim(_col(cls).cast("string"))
    from_part = F.when(part.rlike(r"^[+-]?\d+$"), part.try_cast("bigint"))
    found = F.when(part.isNotNull(), F.when(from_part.isin(0, 1), from_part.cast("int"))).otherwise(F.coalesce(digit_label(binary_label), text_label(label, polarity)))
    found = 1 - found if invert else found
    return F.coalesce(found, F.raise_error(F.lit("no label")).cast("int") if strict else F.lit(-1))


def crop_label(label: Column | str, binary_label: Column | str) -> Column:
    """What a frame's crop is labelled: the label's text if there is one, else the numeric field; 0 real, 1 fake, -1 unknown."""
    first = F.coalesce(F.nullif(_col(label).cast("string"), F.lit("")), _col(binary_label).cast("string"))
    low = F.lower(text(first))
    return F.when(low.isin("real", "original", "0"), 0).when(low.isin("fake", "1"), 1).otherwise(-1)


def clip_label(binary_label: Column | str, label: Column | str) -> Column:
    """What a clip's frame is labelled: the numeric field, else the text; 0 real, 1 fake, -1 unknown."""
    return F.coalesce(digit_label(text(binary_label)), text_label(label), F.lit(-1))


def clip_label_text(binary_label: Column | str) -> Column:
    return F.when(_col(binary_label) == 1, "fake").otherwise("real")


def first_meta(meta: Column | str, *keys: str) -> Column:
    """The first key of a map that is neither null nor blank."""
    return F.coalesce(*[filled(_col(meta)[k]) for k in keys])


def draw(*parts: Column | str) -> Column:
    """A number in 0 .. 2^32 - 1 from a hash of the parts, the same on every run and machine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def safe_name(x: Column | str) -> Column:
    return F.regexp_replace(text(x), r"[^A-Za-z0-9_.-]+", "_")
