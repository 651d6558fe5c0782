"""The fluent interface: an immutable plan over a DataFrame of images, run when an output is asked for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import rules
from ..functions.errors import ImageError, with_errors
from ..operators import batch
from ..operators.metrics import metrics
from ..sources import files
from ..sources.sink import write_files
from . import ops as plan

POLICY_FIELDS = ("max_pixels", "max_bytes", "timeout_ms", "reject_metadata", "metadata_max_bytes")
_LIMITS = {"max_pixels": "max_pixels", "max_bytes": "max_bytes", "timeout_ms": "timeout_ms"}


def policy(name: str) -> dict:
    found = {p[0]: dict(zip(POLICY_FIELDS, p[1:])) for p in rules.POLICIES if p[0] in ("strict", "lenient")}.get(str(name).lower())
    if found is None:
        raise ImageError("E402", f"unknown policy {name!r}")
    return found | {"name": str(name).lower()}


def version() -> str:
    return __version__


@dataclass(frozen=True)
class Pipeline:
    """images: (pos, source, at, content). Every call gives a new plan and leaves this one as it is."""

    images: DataFrame
    ops: tuple[plan.Op, ...] = ()
    firewall: dict = field(default_factory=lambda: {"name": "disabled"})
    keep_icc: bool = False
    keep_exif: bool = False
    strip_gps: bool = True
    orient: bool = True

    @staticmethod
    def from_paths(spark: SparkSession, paths: list[str]) -> Pipeline:
        if any(not str(p).strip() for p in paths):
            raise ImageError("E400", "a blank path")
        return Pipeline(batch.images(spark, paths))

    @staticmethod
    def from_buffers(spark: SparkSession, buffers: list[bytes]) -> Pipeline:
        return Pipeline(batch.buffers(spark, buffers))

    def _with(self, op: plan.Op) -> Pipeline:
        return replace(self, ops=(*self.ops, op))

    def resize(self, width=None, height=None, fit: str = "inside") -> Pipeline:
        return self._with(plan.resize(width, height, fit))

    def crop(self, x, y, width, height) -> Pipeline:
        return self._with(plan.crop(x, y, width, height))

    def rotate(self, degrees) -> Pipeline:
        return self._with(plan.rotate(degrees))

    def flip_h(self) -> Pipeline:
        return self._with(plan.Op("flip_h"))

    def flip_v(self) -> Pipeline:
        return self._with(plan.Op("flip_v"))

    def grayscale(self) -> Pipeline:
        return self._with(plan.Op("grayscale"))

    def brightness(self, v) -> Pipeline:
        return self._with(plan.brightness(v))

    def contrast(self, v) -> Pipeline:
        return self._with(plan.contrast(v))

    def normalize_pixel_format(self) -> Pipeline:
        return self._with(plan.Op("normalize"))

    ensure_rgb = normalize_pixel_format

    def auto_orient(self, enabled: bool = True) -> Pipeline:
        return replace(self, orient=bool(enabled))

    def keep_metadata(self, icc: bool = True, exif: bool = False, strip_gps: bool = True) -> Pipeline:
        return replace(self, keep_icc=icc, keep_exif=exif, strip_gps=strip_gps)

    def sanitize(self, name: str = "strict") -> Pipeline:
        """Sets a policy. Under the strict one no metadata are kept, whatever keep_metadata says before or after."""
        return replace(self, firewall=policy(name))

    def limits(self, **given) -> Pipeline:
        """max_pixels, max_bytes, timeout_ms: absent keeps, 0 lifts, a positive number sets."""
        out = dict(self.firewall) if self.firewall["name"] != "disabled" else {}
        for k, v in given.items():
            if k not in _LIMITS:
                raise ImageError("E400", f"unknown limit {k}")
            if v is not None:
                n = plan.whole(k, v)
                if n < 0:
                    raise ImageError("E400", f"{k} is negative")
                out[k] = n or None
        return replace(self, firewall=out | {"name": "custom"})

    def preset(self, name: str) -> tuple[Pipeline, dict]:
        """This plan with the preset's resize, and the format and quality to use with it."""
        found = {p[0]: p for p in rules.PRESETS}.get(str(name).lower())
        if found is None:
            raise ImageError("E401", f"unknown preset {name!r}")
        _, w, h, fmt, quality = found
        return self.resize(w, h), {"format": fmt, "quality": quality, "width": w, "height": h}

    def rows(self, fmt: str, quality=None, fast: bool = False) -> DataFrame:
        name = {"jpg": "jpeg"}.get(str(fmt).lower(), str(fmt).lower())
        if name not in rules.DEFAULT_QUALITY:
            raise ImageError("E111", f"unknown format {fmt!r}")
        plan.quality(quality)
        keeps = not self.firewall.get("reject_metadata")
        return batch.process(self.images, self.ops, name, self.firewall, self.keep_icc and keeps, self.orient, self.keep_exif and keeps, self.strip_gps, fast)

    def to_buffer(self, fmt: str, quality=None, fast: bool = False) -> DataFrame:
        """(pos, source, output, quality, code, category, recoverable, hint, message): an image that failed has no output;
        quality is the one that an encoder of the format is to use."""
        used = rules.output_quality(F.lit(fmt), F.lit(plan.quality(quality)).cast("int"))
        return with_errors(self.rows(fmt, quality, fast), "code").select("pos", "source", "output", used.alias("quality"), F.col("code"), "category", "recoverable", "hint", "message")

    def to_buffer_with_metrics(self, fmt: str, quality=None, fast: bool = False) -> DataFrame:
        """The metrics record of each image; cpuTime and peak memory are those of the workers that decoded and encoded it."""
        return metrics(self.rows(fmt, quality, fast))

    def to_file(self, path: str, fmt: str, quality=None, fast: bool = False) -> DataFrame:
        """(pos, source, outputPath, bytes, code, message). The outputs are written now, once, to a path or URI of any store;
        all are there when this returns, or none if the job failed. `{pos}` in path stands for the image's position, and must be
        there where there are several images."""
        spark = self.images.sparkSession
        batch.check_output(spark, path)
        if "{pos}" not in path and self.images.limit(2).count() > 1:
            raise ImageError("E400", "several images, one output path")
        named = F.replace(F.lit(files.uri(spark, path.replace("{pos}", "POSITION"))), F.lit("POSITION"), F.col("pos").cast("string"))
        return write_files(self.rows(fmt, quality, fast).withColumn("outputPath", named), files.parent(spark, path), ":" not in path)

    def to_buffer_with_preset(self, name: str) -> DataFrame:
        sized, used = self.preset(name)
        return sized.to_buffer(used["format"], used["quality"])

    def to_buffer_with_metrics_preset(self, name: str) -> DataFrame:
        sized, used = self.preset(name)
        return sized.to_buffer_with_metrics(used["format"], used["quality"])

    def to_file_with_preset(self, path: str, name: str) -> DataFrame:
        sized, used = self.preset(name)
        return sized.to_file(path, used["format"], used["quality"])

    def dimensions(self) -> DataFrame:
        """Sizes from the header, once the policy has passed bytes and profile; else the error."""
        from .metadata import icc_error, icc_profile

        limit, size = (self.firewall.get(k) for k in ("max_bytes", "metadata_max_bytes"))
        icc = F.octet_length(icc_profile(F.col("content")))
        refused = F.lit(bool(self.firewall.get("reject_metadata"))) & icc.isNotNull()
        # whether a profile is one is asked by policies that have a rule for profiles
        asks = bool(self.firewall.get("reject_metadata") or size)
        broken = icc_error(F.col("content")) if asks else F.lit(None).cast("string")
        error = F.coalesce(F.when(F.octet_length("content") > F.lit(limit), "E123"), broken, F.when(refused | (icc > F.lit(size)), "E123"), F.col("error"))
        found = batch.inspect(self.images).withColumn("error", error)
        return found.select("pos", "source", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("width", "height")), "format", "error")

    @staticmethod
    def inspect_files(spark: SparkSession, paths: list[str]) -> DataFrame:
        """(source, width, height, format, error): E400 for a blank path, E101 for one that does not open."""
        found = batch.inspect(batch.images(spark, paths))
        error = F.when(F.trim("source") == "", "E400").when(F.col("content").isNull(), "E101").otherwise(F.col("error"))
        return found.select("source", "width", "height", "format", error.alias("error"))

    def has_icc_profile(self) -> DataFrame:
        """(pos, source, icc_bytes): null where an image has none."""
        from .metadata import icc_profile

        return self.images.select("pos", "source", F.octet_length(icc_profile(F.col("content"))).alias("icc_bytes"))
