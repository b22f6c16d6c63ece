"""Scripts: pipelines of steps and batches of jobs, parsed whole before anything runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import filters, geometry, point
from ..sources import codecs, images


class InvalidPipelineStep(ValueError):
    pass


class InvalidBatchSpec(ValueError):
    pass


class UnknownColorProfile(ValueError):
    pass


# --- values ----------------------------------------------------------------------------------------------------------
def parse_bool(text: str) -> bool:
    known = {"true": True, "yes": True, "1": True, "on": True, "false": False, "no": False, "0": False, "off": False}
    if text.lower() not in known:
        raise InvalidBatchSpec(text)
    return known[text.lower()]


def format_by_name(name: Column) -> Column:
    """The image format of a name, whatever its case."""
    n = F.lower(name)
    return F.when(n.isin("jpg", "jpeg"), "jpeg").when(n.isin("tif", "tiff"), "tiff").when(n.isin("png", "webp", "avif", "bmp", "gif", "svg"), n)


def format_by_path(path: Column) -> Column:
    """By the extension, in all lower or all upper case."""
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    return F.when((ext == F.lower(ext)) | (ext == F.upper(ext)), format_by_name(ext))


WRITABLE = ("bmp", "png", "jpeg", "webp")


def planned_format(path: Column, override: Column) -> Column:
    """What a file is written as: the override, or its own format where that can be written, or PNG."""
    own = format_by_path(path)
    return F.coalesce(override, F.when(own.isin(*WRITABLE), own), F.lit("png"))


def output_path(path: Column, folder: Column, root: Column, kind: Column, keep_structure: bool) -> Column:
    """folder/[folders below root/]stem.extension"""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    below = F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), "/$", "")
    inner = F.when(below == root, F.lit(None)).when(F.startswith(below, F.concat(root, F.lit("/"))), F.substring(below, F.length(root) + 2, F.length(below)))
    ext = F.when(kind == "jpeg", "jpg").otherwise(kind)
    return F.concat_ws("/", folder, *([inner] if keep_structure else []), F.concat(stem, F.lit("."), ext))


def matches(name: Column, pattern: str) -> Column:
    """One star, or the exact name."""
    if "*" not in pattern:
        return name == pattern
    head, tail = pattern.split("*", 1)
    return F.startswith(name, F.lit(head)) & F.endswith(name, F.lit(tail)) & (F.length(name) >= len(head) + len(tail))


# --- pipelines -------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Step:
    name: str
    values: tuple = ()


def parse_step(text: str) -> Step:
    name, _, rest = re.sub("^--", "", text.strip()).replace("=", ":", 1).partition(":")
    name, rest = {"output-format": "format", "write": "save"}.get(name.lower(), name.lower()), rest.strip()
    try:
        if name == "resize":
            w, h = rest.lower().split("x")
            return Step(name, (int(w), int(h)))
        if name == "crop":
            x, y, w, h = (int(v) for v in rest.split(","))
            return Step(name, (x, y, w, h))
        if name in ("blur", "brightness"):
            return Step(name, (int(rest),))
        if name in ("contrast", "rotate"):
            return Step(name, (float(rest),))
        if (name, rest) == ("grayscale", "") or (name, rest.lower()) == ("convert", "grayscale"):
            return Step("grayscale")
        if name == "flip" and rest.lower() in ("h", "v", "horizontal", "vertical"):
            return Step(name, (rest.lower()[0],))
        if name == "format" and rest.lower() in ("jpg", "jpeg", "png", "bmp", "webp", "tiff", "gif", "avif", "svg"):
            return Step(name, ("jpeg" if rest.lower() == "jpg" else rest.lower(),))
        if name == "save" and rest:
            return Step(name, (rest,))
    except ValueError as bad:
        raise InvalidPipelineStep(text) from bad
    raise InvalidPipelineStep(text)


def parse_pipeline(steps: list[str]) -> list[Step]:
    """All steps, or the error of the first bad one, before any work. Two equal flips in a row are none."""
    out: list[Step] = []
    for step in map(parse_step, steps):
        if out and step.name == "flip" and out[-1] == step:
            out.pop()
        else:
            out.append(step)
    return out


@dataclass(frozen=True)
class Frame:
    """A pixel relation of images of one size, with the fluent operators; everything stays lazy."""

    px: DataFrame
    width: int
    height: int

    def apply(self, step: Step) -> Frame:
        v, w, h = step.values, self.width, self.height
        if step.name == "resize":
            return Frame(geometry.resize(self.px, w, h, *v), *v)
        if step.name == "crop":
            return Frame(geometry.crop(self.px, *v, w, h), v[2], v[3])
        if step.name == "blur":
            return Frame(filters.box_blur(self.px, v[0]), w, h)
        if step.name == "brightness":
            return Frame(point.adjust_brightness(self.px, v[0]), w, h)
        if step.name == "contrast":
            return Frame(point.adjust_contrast(self.px, v[0]), w, h)
        if step.name == "grayscale":
            return Frame(point.to_grey(self.px), w, h)
        if step.name == "rotate":
            if v[0] % 360 == 90:
                return Frame(geometry.rotate90(self.px, h), h, w)
            to_w, to_h, _, _ = geometry.rotated_size(w, h, v[0])
            return Frame(geometry.rotate(self.px, w, h, v[0]), to_w, to_h)
        if step.name == "flip":
            return Frame(geometry.flip_horizontal(self.px, w) if v[0] == "h" else geometry.flip_vertical(self.px, h), w, h)
        return self

    def run(self, steps: list[str]) -> Frame:
        frame = self
        for step in parse_pipeline(steps):
            frame = frame.apply(step)
        return frame


def run_kernels(px, steps: list[Step]):
    """The same steps on one image's pixels."""
    for step in steps:
        v = step.values
        if step.name == "resize":
            px = kernels.resize(px, *v)
        elif step.name == "crop":
            px = kernels.crop(px, *v)
        elif step.name == "blur":
            px = kernels.blur(px, v[0])
        elif step.name == "brightness":
            px = kernels.brightness(px, v[0])
        elif step.name == "contrast":
            px = kernels.contrast(px, v[0])
        elif step.name == "grayscale":
            px = kernels.grey(px)
        elif step.name == "rotate":
            px = kernels.rotate90(px) if v[0] % 360 == 90 else kernels.rotate(px, v[0])
        elif step.name == "flip":
            px = px[:, ::-1] if v[0] == "h" else px[::-1]
    return px


# --- batches ---------------------------------------------------------------------------------------------------------
#: Names of operations and their aliases, with the keys that each must have; a bar parts keys that stand for each other.
OPERATIONS = {
    "resize": ("resize", ("width", "height")), "crop": ("crop", ("x", "y", "width", "height")), "rotate": ("rotate", ("angle",)), "blur": ("blur", ("radius",)),
    "convert_format": ("convert_format", ("format",)), "convert": ("convert_format", ("format",)),
    "adjust_brightness": ("adjust_brightness", ("value|amount",)), "brightness": ("adjust_brightness", ("value|amount",)),
    "adjust_contrast": ("adjust_contrast", ("factor",)), "contrast": ("adjust_contrast", ("factor",)),
    "white_balance": ("white_balance", ("temperature", "tint")), "grayscale": ("grayscale", ()),
    "color_profile_convert": ("color_profile_convert", ("profile",)), "profile": ("color_profile_convert", ("profile",)),
}

#: Aliases of colour profiles.
PROFILE_NAMES = {"srgb": "srgb", "adobe_rgb": "adobe_rgb_1998", "adobe_rgb_1998": "adobe_rgb_1998", "pro_photo": "pro_photo_rgb", "pro_photo_rgb": "pro_photo_rgb", "rec2020": "rec2020", "display_p3": "display_p3", "rec709": "rec709", "linear_rgb": "linear_rgb", "linear": "linear_rgb"}


def profile_by_name(name: Column) -> Column:
    out = None
    for alias, profile in PROFILE_NAMES.items():
        hit = F.lower(name) == alias
        out = F.when(hit, profile) if out is None else out.when(hit, profile)
    return out


def job_lines(script: DataFrame, text: str = "value") -> DataFrame:
    """(line_no, op, valid, reason, options) of the lines of a script, one row a line with column line_no; comments and
    blank lines go. Lines that cannot run stay, with a reason."""
    line = F.trim(F.regexp_replace(F.col(text), r"(^|\s)#.*$", ""))
    rows = script.select("line_no", line.alias("line")).where("line <> ''")
    tokens = F.filter(F.split("line", r"\s+"), lambda t: t != "")
    rows = rows.withColumn("tokens", tokens).withColumn("pairs", F.filter(F.slice("tokens", 2, 1000), lambda t: F.instr(t, "=") > 1))
    keys = F.transform("pairs", lambda t: F.lower(F.substring_index(t, "=", 1)))
    values = F.transform("pairs", lambda t: F.regexp_extract(t, r"^[^=]*=(.*)$", 1))
    # The first of repeated keys holds.
    first = F.array_distinct(keys)
    options = F.map_from_entries(F.transform(first, lambda k: F.struct(k.alias("key"), F.get(values, F.array_position(keys, k) - 1).alias("value"))))
    rows = rows.withColumn("options", options)
    op = F.lower(F.try_element_at("options", F.lit("operation")))
    known, missing = None, None
    for alias, (name, required) in OPERATIONS.items():
        hit = op == alias
        absent = F.lit(False)
        for key in required:
            some = F.lit(False)
            for one in key.split("|"):
                some = some | F.map_contains_key("options", one)
            absent = absent | ~some
        known = F.when(hit, name) if known is None else known.when(hit, name)
        missing = F.when(hit, absent) if missing is None else missing.when(hit, absent)
    has_input = F.map_contains_key("options", "input") | F.map_contains_key("options", "inputs")
    reason = (
        F.when(F.lower(F.get("tokens", F.lit(0))) != "job", "UnknownCommand")
        .when(op.isNull(), "NoOperation")
        .when(~F.map_contains_key("options", "output"), "NoOutputDirectory")
        .when(~has_input, "NoInputFiles")
        .when(known.isNull() | F.coalesce(missing, F.lit(True)), "InvalidBatchSpec")
    )
    return rows.select("line_no", known.alias("op"), reason.isNull().alias("valid"), reason.alias("reason"), "options")


@dataclass
class BatchJob:
    """A fluent description of one batch; run() plans it over a table of files and stays lazy.

    The task scheduler takes the place of a thread count; a caller that wants to cancel tags its jobs with
    SparkContext.addJobTag and ends them with cancelJobsWithTag, and progress is the status tracker's.
    """

    files: list[str] = field(default_factory=list)
    output: str | None = None
    operation: tuple | None = None
    target: str | None = None
    overwrite: bool = False
    keep_structure: bool = False
    root: str = ""

    def add_file(self, path: str) -> BatchJob:
        self.files.append(path)
        return self

    def set_output(self, folder: str) -> BatchJob:
        self.output = folder
        return self

    def set_operation(self, name: str, **values) -> BatchJob:
        if name not in OPERATIONS:
            raise InvalidBatchSpec(name)
        name, required = OPERATIONS[name]
        if missing := [k for k in required if not set(k.split("|")) & set(values)]:
            raise InvalidBatchSpec(f"{name} needs {', '.join(missing)}")
        self.operation = (name, values)
        if name == "convert_format":
            self.target = values["format"]
        return self

    def build(self) -> BatchJob:
        for value, error in ((self.output, "NoOutputDirectory"), (self.operation, "NoOperation")):
            if value is None:
                raise InvalidBatchSpec(error)
        return self

    def run(self, files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
        """files: (path, content). Rows path, output_path, status, error, content. What exists is skipped before decoding."""
        self.build()
        kind = planned_format(F.col("path"), F.lit(self.target).cast("string"))
        plan = files.withColumn("kind", kind).withColumn("output_path", output_path(F.col("path"), F.lit(self.output), F.lit(self.root), F.col("kind"), self.keep_structure))
        if self.files:
            plan = plan.where(F.col("path").isin(self.files))
        skipped = None
        if existing is not None and not self.overwrite:
            there = existing.select(F.col("path").alias("output_path"))
            skipped = plan.join(there, "output_path", "left_semi").select("path", "output_path", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("binary").alias("content"))
            plan = plan.join(there, "output_path", "left_anti")
        operation = self.operation
        done = plan.select("path", "output_path", "kind", "content").mapInArrow(lambda batches: _work(batches, operation), "path string, output_path string, status string, error string, content binary")
        return done if skipped is None else done.unionByName(skipped)


def apply_operation(px, operation: tuple):
    """One batch operation on an image's pixels. Resizing keeps the proportions unless told otherwise."""
    name, v = operation
    if name == "resize":
        width = int(v["width"])
        keep = v.get("maintain_aspect", True)
        keep = parse_bool(keep) if isinstance(keep, str) else keep
        return kernels.resize(px, width, kernels.aspect_height(px, width) if keep else int(v["height"]))
    if name == "crop":
        return kernels.crop(px, *(int(v[k]) for k in ("x", "y", "width", "height")))
    if name == "rotate":
        return kernels.rotate90(px) if float(v["angle"]) == 90 else kernels.rotate(px, float(v["angle"]))
    if name == "blur":
        return kernels.blur(px, int(v["radius"]))
    if name == "adjust_brightness":
        return kernels.brightness(px, int(v.get("value", v.get("amount"))))
    if name == "adjust_contrast":
        return kernels.contrast(px, float(v["factor"]))
    if name == "white_balance":
        return kernels.white_balance(px, float(v["temperature"]), float(v["tint"]))
    if name == "grayscale":
        return kernels.grey(px)
    if name == "color_profile_convert":
        if str(v["profile"]).lower() not in PROFILE_NAMES:
            raise UnknownColorProfile(v["profile"])
        return kernels.convert_profile(px, "srgb", PROFILE_NAMES[str(v["profile"]).lower()])
    return px


def _work(batches, operation: tuple):
    """Decodes, applies, encodes; a file's error becomes its row's code."""
    import pyarrow as pa

    def rows():
        for path, output, kind, content in images.each(batches, "path", "output_path", "kind", "content"):
            try:
                image = codecs.decode(content or b"")
                yield path, output, "processed", None, codecs.encode(codecs.Image.of(apply_operation(image.pixels, operation)), kind)
            except ValueError as bad:
                yield path, output, "failed", getattr(bad, "code", type(bad).__name__), None

    yield from images.emitted(rows(), ["path", "output_path", "status", "error", "content"], [*[pa.string()] * 4, pa.binary()])
