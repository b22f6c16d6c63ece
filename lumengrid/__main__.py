"""python -m lumengrid convert IN OUT [FORMAT] | pipeline IN STEP... | batch SCRIPT

IN and OUT are paths, or - for standard input and output, which needs a format. Steps: resize:WxH crop:X,Y,W,H blur:R
brightness:V contrast:F grayscale rotate:DEGREES flip:h|v format:EXT save:PATH. A script has a line for each job:
job operation=NAME input=PATH|inputs=A,B output=FOLDER [recursive=] [overwrite=] [preserve_structure=] [key=value...];
inputs are files, folders or globs; folders below the working directory are kept unless preserve_structure is false.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import steps
from .sources import codecs, images


class MissingFormatForStdout(ValueError):
    pass


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _read(path: str) -> codecs.Image:
    if path == "-":
        return codecs.decode(sys.stdin.buffer.read())
    with open(images.check_path(path), "rb") as f:
        return codecs.decode(f.read())


def _kind(path: str, asked: str | None) -> str:
    """The extension wins over what is asked for."""
    if path == "-":
        if not asked:
            raise MissingFormatForStdout(path)
        return asked
    known = {"jpg": "jpeg", "tif": "tiff"}
    ext = os.path.splitext(path)[1][1:].lower()
    return known.get(ext, ext) if known.get(ext, ext) in codecs.ENCODERS else asked or "png"


def _write(image: codecs.Image, path: str, asked: str | None) -> None:
    content = codecs.encode(image, _kind(path, asked))
    if path == "-":
        sys.stdout.buffer.write(content)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


def convert(source: str, target: str, kind: str | None = None) -> int:
    _write(_read(source), target, kind)
    return 0


def pipeline(source: str, *script: str) -> int:
    """Steps run up to each save, which may come more than once."""
    parsed = steps.parse_pipeline(list(script))
    px, kind = _read(source).pixels, None
    for step in parsed:
        if step.name == "format":
            kind = step.values[0]
        elif step.name == "save":
            _write(codecs.Image.of(px), step.values[0], kind)
        else:
            px = steps.run_kernels(px, [step])
    return 0


def batch(script: str) -> int:
    """Jobs one after the other, files of a job in parallel; 1 where a job or a file failed."""
    spark = _session()
    with open(images.check_path(script)) as f:
        lines = [(k, line) for k, line in enumerate(f.read().splitlines(), 1)]
    jobs = steps.job_lines(spark.createDataFrame(lines or [(0, "")], "line_no long, value string")).orderBy("line_no").collect()
    bad = 0
    for row in jobs:
        if not row["valid"]:
            print(f"line {row['line_no']}: {row['reason']}", file=sys.stderr)
            bad = 1
            continue
        o = row["options"]
        flag = lambda k, default="false", o=o: steps.parse_bool(o.get(k, default))
        found = images.inputs(spark, [os.path.abspath(x.strip()) for x in (o.get("inputs") or o["input"]).split(",") if x.strip()], flag("recursive"))
        job = steps.BatchJob(overwrite=flag("overwrite"), keep_structure=flag("preserve_structure", "true"), root=os.getcwd()).set_output(os.path.abspath(o["output"])).set_operation(row["op"], **{k: v for k, v in o.items() if k not in ("operation", "input", "inputs", "output", "recursive", "overwrite", "preserve_structure", "threads", "progress")})
        existing = None
        if os.path.isdir(o["output"]) and not job.overwrite:
            existing = images.scan(spark, o["output"]).select(F.regexp_replace("path", "^file:", "").alias("path"))
        done = job.run(found, existing).cache()
        images.write_files(done.where("status = 'processed'"))
        counts = {r["status"]: r["n"] for r in done.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        done.unpersist()
        print(f"line {row['line_no']}: {counts}", file=sys.stderr)
        bad |= int("failed" in counts)
    return bad


def main(argv: list[str]) -> int:
    commands = {"convert": convert, "pipeline": pipeline, "batch": batch}
    if not argv or argv[0] not in commands:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        return commands[argv[0]](*argv[1:])
    except (ValueError, TypeError) as bad:
        print(f"{getattr(bad, 'code', type(bad).__name__)}: {bad}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
