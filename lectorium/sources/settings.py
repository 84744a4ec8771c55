"""Settings: a JSON file of known names, the key for an outside service, and the folder that both belong in."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Mapping

from pyspark.sql import SparkSession

from . import library_file

OWNER_ONLY = "600"
# By the start of a platform's name, the variable that names the folder for applications' data, and where it is without one.
FOLDERS = (("win", "APPDATA", "AppData/Roaming"), ("darwin", "", "Library/Application Support"), ("", "XDG_DATA_HOME", ".local/share"))


def load(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Known names alone, and the defaults where the file is missing or broken."""
    store, at = library_file._store(spark, path)
    if not store.exists(at):
        return dict(defaults)
    found = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    try:
        given = json.loads(found)
    except ValueError:
        return dict(defaults)
    return defaults | {k: v for k, v in given.items() if k in defaults} if isinstance(given, dict) else dict(defaults)


def save(spark: SparkSession, path: str, values: dict) -> None:
    """Written in one step and readable by the owner alone, as a key may be in it."""
    library_file.replace(spark, path, json.dumps(values, ensure_ascii=False, indent=2), OWNER_ONLY)


def key(setting: str | None, variable: str, environment: Mapping[str, str] = os.environ) -> str:
    """The setting, else the variable, else nothing; stripped."""
    return next((x.strip() for x in (setting, environment.get(variable)) if x and x.strip()), "")


def data_folder(application: str, override: str = "", platform: str = sys.platform, environment: Mapping[str, str] = os.environ) -> str:
    """Where an application's data lies: what the variable override names, else a folder of its own in the platform's."""
    home = environment.get("HOME") or environment.get("USERPROFILE") or os.path.expanduser("~")
    if named := environment.get(override, "") if override else "":
        return home + named[1:] if named == "~" or named.startswith("~/") else named
    variable, usual = next((v, f) for start, v, f in FOLDERS if platform.startswith(start))
    return f"{environment.get(variable) or f'{home}/{usual}'}/{application}"
