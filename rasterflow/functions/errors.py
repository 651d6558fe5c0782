"""The error taxonomy as data: one row per code, joined to by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USER, CODEC, RESOURCE, INTERNAL = range(4)

# Codes, names, categories and hints are part of the public contract.
ERRORS = (
    ("E100", "FileNotFound", USER, "Verify the input path and ensure the file exists."),
    ("E101", "FileReadFailed", RESOURCE, "Check file permissions and disk health, then retry."),
    ("E102", "MmapFailed", RESOURCE, "Free memory or disk resources and confirm file permissions."),
    ("E111", "UnsupportedFormat", CODEC, "Convert the image to a supported format (jpeg, png, webp)."),
    ("E121", "DimensionExceedsLimit", RESOURCE, "Resize the image to fit within the maximum dimension limits."),
    ("E122", "PixelCountExceedsLimit", RESOURCE, "Reduce resolution or process the image in smaller tiles."),
    ("E123", "FirewallViolation", RESOURCE, "Adjust firewall limits (bytes/pixels/metadata) or use smaller inputs."),
    ("E130", "CorruptedImage", CODEC, "Re-download or regenerate the image; the file appears corrupted."),
    ("E131", "DecodeFailed", CODEC, "Try opening the file in another viewer or re-encode the source image."),
    ("E200", "InvalidCropBounds", USER, "Ensure crop x/y/width/height stay within the image dimensions."),
    ("E201", "InvalidCropDimensions", USER, "Use positive crop width and height greater than zero."),
    ("E202", "InvalidRotationAngle", USER, "Use rotation angles in 90-degree increments (0, 90, 180, 270)."),
    ("E203", "InvalidResizeDimensions", USER, "Provide at least one positive dimension (width or height)."),
    ("E204", "InvalidResizeFit", USER, "Use fit values: inside, cover, or fill."),
    ("E210", "UnsupportedColorSpace", CODEC, "Convert the image to sRGB or a supported color space before processing."),
    ("E299", "ResizeFailed", CODEC, "Try different resize parameters or re-encode the input before resizing."),
    ("E300", "EncodeFailed", CODEC, "Adjust output format/quality or try re-encoding the source image."),
    ("E301", "FileWriteFailed", RESOURCE, "Check output path, permissions, and available disk space."),
    ("E400", "InvalidArgument", USER, "Pass a valid argument value as documented for this option."),
    ("E401", "InvalidPreset", USER, "Use a supported preset name (thumbnail, avatar, hero, social)."),
    ("E402", "InvalidFirewallPolicy", USER, "Use firewall policy 'strict' or 'lenient'."),
    ("E900", "SourceConsumed", USER, "Clone the engine or reload the source before reusing it."),
    ("E901", "InternalPanic", INTERNAL, "Report this issue with logs; it indicates an unexpected internal error."),
    ("E999", "Generic", INTERNAL, "Report this issue with full context; an unexpected state occurred."),
)
CATEGORY_OF = {code: category for code, _, category, _ in ERRORS}


class ImageError(ValueError):
    """Raised while a plan is built; batches turn it into a row instead."""

    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code, self.category = code, CATEGORY_OF[code]


def error_dim(spark: SparkSession) -> DataFrame:
    """(code, number, name, category, recoverable, hint): 24 rows."""
    rows = [(code, int(code[1:]), name, cat, cat in (USER, RESOURCE), hint) for code, name, cat, hint in ERRORS]
    return spark.createDataFrame(rows, "code string, number int, name string, category int, recoverable boolean, hint string")


def with_errors(df: DataFrame, code_col: str) -> DataFrame:
    """df and the columns of its code's error; codes that are not known get nulls."""
    dim = error_dim(df.sparkSession)
    return df.join(F.broadcast(dim), df[code_col] == dim["code"], "left").drop(dim["code"])


def category_of(code: Column) -> Column:
    found = F.lit(None).cast("int")
    for category in (USER, CODEC, RESOURCE, INTERNAL):
        found = F.when(code.isin([c for c, k in CATEGORY_OF.items() if k == category]), category).otherwise(found)
    return found


def classify(error_category: Column, category: Column, code: Column, error_code: Column) -> Column:
    """An error object's category from whichever field it has: the two numeric ones first, then the category's
    name, then the exact code, then its hundred."""
    # Names that `code` may hold.
    named = F.when(code == "LAZY_IMAGE_USER_ERROR", USER).when(code == "LAZY_IMAGE_CODEC_ERROR", CODEC).when(code == "LAZY_IMAGE_RESOURCE_LIMIT", RESOURCE).when(code == "LAZY_IMAGE_INTERNAL_BUG", INTERNAL)
    number = F.when(error_code.rlike("^E[0-9]{3}$"), F.substring(error_code, 2, 3).cast("int"))
    hundred = F.floor(number / 100)
    coarse = F.when(hundred.isin(1, 2, 4), USER).when(hundred == 3, RESOURCE).when(hundred == 9, INTERNAL)
    return F.coalesce(error_category, category, named, F.when(number.isNotNull(), category_of(error_code)), coarse)


def message(code: Column, path: Column, text: Column) -> Column:
    """How a failed row of a batch reads."""
    return F.format_string("[%s] %s: %s", code, path, text)
