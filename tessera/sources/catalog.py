"""File specifications, layer catalogs and metadata: what names an image before its pixels are read."""

from __future__ import annotations

import fnmatch
import glob
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_NESTING = 63
_SPEC = r"^(.*?)(?:\[([^\[\]]*)\])?$"


def split_spec(name: Column) -> tuple[Column, Column]:
    """File and layer specification (null if there is none) of ``file[spec]``."""
    spec = F.regexp_extract(name, _SPEC, 2)
    return F.regexp_extract(name, _SPEC, 1), F.when(name.endswith("]"), spec)


def select_layers(layers: DataFrame, selector: str) -> DataFrame:
    """all, first, last, largest (by area, the first on ties) or none of each file's layers; otherwise an index list."""
    if selector == "all":
        return layers
    if selector == "none":
        return layers.filter(F.lit(False))
    pick = {"first": [F.col("layer_no")], "last": [F.desc("layer_no")], "largest": [F.desc(F.col("w") * F.col("h")), F.col("layer_no")]}
    if selector in pick:
        order = W.partitionBy("file").orderBy(*pick[selector])
        return layers.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return select_indexed(layers, selector)


@dataclass(frozen=True)
class IndexRange:
    """Layer numbers from ``first`` to ``last``; negative ones count from the end, None is that end of the file."""

    first: int | None
    last: int | None
    reverse: bool = False


def parse_indices(spec: str) -> list[IndexRange]:
    """``1``, ``-1``, ``2..4``, ``_..3``, ``reverse 1..-1``, and lists of these by comma or colon."""
    out = []
    for part in re.split(r"[,:]", spec):
        m = re.fullmatch(r"\s*(reverse\s+)?(_|[+-]?\d+)?\s*(?:(\.\.)\s*(_|[+-]?\d+)?)?\s*", part, re.I)
        if not m or not (m[2] or m[3]):
            raise ValueError(f"not a layer index: {part!r}")
        number = lambda t: None if t in (None, "_") else int(t)
        a, b = number(m[2]), number(m[4]) if m[3] else number(m[2])
        if 0 in (a, b):
            raise ValueError("layers count from 1, or from -1 at the end")
        out.append(IndexRange(a, b, bool(m[1])))
    return out


def select_indexed(layers: DataFrame, spec: str) -> DataFrame:
    """The layers of an index list, in its order and as often as it names them: columns of ``layers`` and pos from 0.

    What a range gives follows from its ends and the file's last layer, so each layer finds its own positions: one window, no join.
    """
    last = F.col("__last")
    rows = layers.withColumn("__last", F.max("layer_no").over(W.partitionBy("file")))
    at, before = [], F.lit(0).cast("long")
    for r in parse_indices(spec):
        end = lambda n, default: (default if n is None else F.lit(n) if n > 0 else last + 1 + n).cast("long")
        lo, hi = end(r.first, F.lit(1)), end(r.last, last)
        # a single index outside the file names nothing; ranges are cut to the file
        single = r.first is not None and r.first == r.last
        low, high = (lo, hi) if single else (F.greatest(lo, F.lit(1)), F.least(hi, last))
        ok = (low >= 1) & (low <= high) & (high <= last)
        nth = high - F.col("layer_no") if r.reverse else F.col("layer_no") - low
        at.append(F.when(ok & F.col("layer_no").between(low, high), before + nth))
        before = before + F.when(ok, high - low + 1).otherwise(0)
    positions = F.filter(F.array(*at), lambda p: p.isNotNull())
    return rows.withColumn("pos", F.explode(positions)).drop("__last")


def check_compatible(images: DataFrame) -> DataFrame:
    """One row: whether all images agree in colour and pixel type, their smallest side, and the union of their places."""
    return images.agg(
        (F.count_distinct("is_color") <= 1).alias("same_color"),
        (F.count_distinct("pixel_type") <= 1).alias("same_type"),
        F.min(F.least("w", "h")).alias("min_side"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max(F.col("x0") + F.col("w")).alias("x1"),
        F.max(F.col("y0") + F.col("h")).alias("y1"),
    )


def parse_geometry(text: str) -> tuple[int, int, int, int]:
    """``WxH+X+Y``; the offsets may be left out."""
    m = re.fullmatch(r"(\d+)x(\d+)(?:([+-]\d+)([+-]\d+))?", text)
    if not m:
        raise ValueError(f"not a geometry: {text!r}")
    return int(m[1]), int(m[2]), int(m[3] or 0), int(m[4] or 0)


def pass_metadata(own: Column, source: Column, blocked: str) -> Column:
    """The output's own entries, and those of the source image that it lacks and whose keys the pattern does not block."""
    new = F.map_filter(source, lambda k, v: ~k.rlike(blocked) & ~F.map_contains_key(own, k))
    return F.map_concat(own, new)


# The template letters; the upper case ones take the output's name.
_LETTERS = "nipdbfe"


def expand_template(template: str, number: Column, file: Column, output: str | None = None, images: int = 1) -> Column:
    """Output names: %n number from 1, %i index ``number`` from 0, %p path, %d folder, %b file name, %f file name without extension, %e extension.

    Numbers take a sign to pad with (zeros unless another punctuation mark is given) and a width
    between the per cent sign and the letter; without a width, that of the largest of ``images`` images. Longer numbers
    stay whole. Upper-case letters take the parts of ``output``; %% is a percent sign.
    """

    def parts(name: Column) -> dict[str, Column]:
        base = F.regexp_extract(name, r"([^/]*)$", 1)
        ext = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)  # a name that starts with its only dot has no extension
        folder = F.regexp_extract(name, r"^(.*)/", 1)
        folder = F.when(~name.contains("/"), ".").when(folder == "", "/").otherwise(folder)
        return {"p": name, "d": folder, "b": base, "e": ext, "f": F.substring(base, F.lit(1), F.length(base) - F.length(ext))}

    values = parts(file)
    outs = parts(F.lit(output or ""))
    pieces: list[Column] = []
    at = 0
    for m in re.finditer(r"%(%|([!-/:-@\[-`{-~0]*)(\d*)([a-zA-Z]))", template):
        pieces.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[1] == "%":
            pieces.append(F.lit("%"))
            continue
        pad, width, letter = m[2][-1:] or "0", m[3], m[4]
        if letter.lower() not in _LETTERS:
            raise ValueError(f"unknown template variable %{letter}")
        if letter.lower() in "ni":
            one = letter.lower() == "n"
            text = (number + int(one)).cast("string")
            digits = int(width) if width else len(str(max(images - 1 + one, 0)))
            pieces.append(F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit(pad)))
        else:
            pieces.append(values[letter] if letter.islower() else outs[letter.lower()])
    pieces.append(F.lit(template[at:]))
    return F.concat(*pieces)


# Response files ---------------------------------------------------------------


def expand_glob(pattern: str, algorithm: str) -> list[str]:
    """literal (as it stands), or wildcard (sorted matches; the pattern itself if none)."""
    if algorithm in ("literal", "none"):
        return [pattern]
    if algorithm in ("wildcard", "glob", "shell", "sh"):
        return sorted(glob.glob(os.path.expanduser(pattern) if algorithm in ("shell", "sh") else pattern)) or [pattern]
    raise ValueError(f"unknown globbing algorithm {algorithm!r}")


def unfold(argument: str, algorithm: str = "literal", selector: str = "all", _trail: tuple[str, ...] = ()) -> list[tuple[str, str, tuple[str, ...]]]:
    """(file, layer selector, trail of response files) of an argument; ``@name`` is read line by line, nested and relative to its file.

    In a response file ``#`` starts a comment; ``# glob: wildcard`` and ``# layer-selector: last`` set how the lines after it are read.
    """
    m = re.match(_SPEC, argument)
    name, spec = (m[1], m[2]) if argument.endswith("]") else (argument, None)
    if not name.startswith("@"):
        return [(os.path.normpath(f), spec or selector, _trail) for f in expand_glob(name, algorithm)]
    path = os.path.realpath(name[1:])
    if path in _trail:
        raise ValueError(f"response files include each other: {' -> '.join((*_trail, path))}")
    if len(_trail) >= MAX_NESTING:
        raise ValueError(f"response files are nested more than {MAX_NESTING} deep")
    out = []
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if note := re.match(r"\s*#\s*(glob|globbing|filename-globbing|layer-selector)\s*:\s*([\w-]+)", line):
                if note[1] == "layer-selector":
                    selector = note[2]
                else:
                    algorithm = note[2]
            line = re.sub(r"(?:^|\s)#.*", "", line).strip()
            if not line:
                continue
            inner = line[1:] if line.startswith("@") else line
            inner = inner if os.path.isabs(inner) else os.path.join(os.path.dirname(path), inner)
            out += unfold(("@" if line.startswith("@") else "") + inner, algorithm, spec or selector, (*_trail, path))
    return out


def looks_like_response_file(path: str, lines: int = 20) -> bool:
    """Whether a file reads like a list of names: text whose lines are comments, response files or names with known endings."""
    with open(path, "rb") as f:
        head = f.read(4096)
    if b"\0" in head:
        return False
    score = 0
    for line in head.decode("utf-8", "replace").splitlines()[:lines]:
        line = line.strip()
        if line.startswith(("#", "@")):
            score += 2
        elif line and any(fnmatch.fnmatch(line.lower(), p) for p in ("*.tif", "*.tiff", "*.png", "*.jpg", "*.jpeg", "*.exr", "*.pgm", "*.ppm", "*.pnm", "*.bmp", "*.hdr")):
            score += 2
        elif line:
            score -= 1
    return score > 0
