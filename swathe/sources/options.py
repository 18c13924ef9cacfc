"""Options files: a key and a value on each line, typed and checked, and the ``Setting`` they make."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import Setting
from .text import numbered

#: options of the window query
SETTING = {"window-size": int, "grid-size": int, "overlap": float, "exact": bool}
#: options that a file may hold besides, by type; fixed values
WHOLE = "verbosity num-points block-size decimation jump-acceptable jump-good jump-perfect do-octree-decimation l-min-points-plane l-max-obs-outliers l-t-max-obs-outliers".split()
REAL = (
    "normals-radius octree-min-radius l-stdz-too-high l-good-slope l-steep-slope l-min-skid-circle-r l-good-skid-circle-r l-min-rotor-circle-r l-good-rotor-circle-r l-height-between-skids-rotor"
    " l-height-accept-skids l-height-good-skids l-height-accept-skids-grass-conf l-height-good-skids-grass-conf l-height-accept-skids-plain-conf l-height-good-skids-plain-conf l-height-accept-rotor l-height-good-rotor"
    " l-pi l-t-suspicious-angle l-t-too-rough-angle l-t-grass-angle l-t-too-rough-angle-dis l-t-grass-angle-dis l-a-aperture-good l-a-radius"
).split()
TEXT = ["output-dir", "point-cloud-file"]
KEYS: dict[str, type] = SETTING | dict.fromkeys(WHOLE, int) | dict.fromkeys(REAL, float) | dict.fromkeys(TEXT, str)
MOST_LINES = 10_000


class OptionsError(ValueError):
    """What is wrong with an options file, a message for each line: ``errors`` (line number, message)."""

    def __init__(self, errors: list[tuple[int, str]]):
        super().__init__("; ".join(f"line {n}: {m}" for n, m in errors))
        self.errors = errors


@dataclass(frozen=True)
class Options:
    values: Mapping[str, Any]

    @property
    def setting(self) -> Setting:
        """The window query's setting; its own defaults where the file has no value."""
        names = {"window-size": "w", "grid-size": "b", "overlap": "o", "exact": "exact"}
        return Setting(**{names[k]: v for k, v in self.values.items() if k in SETTING})


def _typed(kind: type, value: str) -> Any:
    if kind is bool:
        return {"1": True, "0": False, "true": True, "false": False}[value.lower()]
    return kind(value)


def parse(lines: list[tuple[int, str]]) -> Options:
    """The options in numbered lines: what follows a key's value on its line is a comment, as are lines that begin with ``#``; a later value replaces an earlier one. All faulty lines are told at once."""
    values: dict[str, Any] = {}
    errors, where = [], {}
    for n, line in lines:
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        key = words[0]
        if key not in KEYS:
            errors.append((n, f"unknown option {key}"))
        elif len(words) < 2:
            errors.append((n, f"{key} has no value"))
        else:
            try:
                values[key], where[key] = _typed(KEYS[key], words[1]), n
            except (ValueError, KeyError):
                errors.append((n, f"{key} is {KEYS[key].__name__}, not {words[1]}"))
    for key, fine, rule in (("window-size", lambda v: v > 0, "above 0"), ("grid-size", lambda v: v >= 0, "not below 0"), ("overlap", lambda v: 0 <= v < 1, "in [0, 1)")):
        if key in values and not fine(values[key]):
            errors.append((where[key], f"{key} must be {rule}"))
    if errors:
        raise OptionsError(sorted(errors))
    return Options(values)


def read_options(spark: SparkSession, path: str) -> Options:
    """The options of one file."""
    lines: DataFrame = numbered(spark, path)
    rows = lines.select("id", "value").limit(MOST_LINES + 1).collect()
    if len(rows) > MOST_LINES:
        raise OptionsError([(MOST_LINES + 1, f"more than {MOST_LINES} lines")])
    rows.sort()
    return parse([(n, r.value) for n, r in enumerate(rows, 1)])


def write_options(spark: SparkSession, options: Options, path: str) -> None:
    """One file with a line for each option, in the order of their keys."""
    lines = [(f"{k} {str(v).lower() if isinstance(v, bool) else v}",) for k, v in sorted(options.values.items())]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
