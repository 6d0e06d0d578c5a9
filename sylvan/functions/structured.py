"""YAML, TOML and XML texts as JSON texts, in Arrow batches; malformed input gives null."""

from __future__ import annotations

import datetime
import json
import tomllib
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:
    yaml = None


def xml_value(e: ET.Element):
    """Attributes as @name, text as #text, repeated children as lists; a plain leaf is its text."""
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for child in e:
        value = xml_value(child)
        if child.tag in out:
            out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
        else:
            out[child.tag] = value
    text = (e.text or "").strip()
    if not out:
        return text
    if text:
        out["#text"] = text
    return out


def _plain(x):
    if isinstance(x, (datetime.datetime, datetime.date, datetime.time)):
        return x.isoformat()
    raise TypeError(type(x))


def read(name: str, text: str):
    if name == "toml":
        return tomllib.loads(text)
    if name == "yaml":
        if yaml is None:
            raise ValueError("YAML needs a library that is not installed")
        return yaml.safe_load(text)
    root = ET.fromstring(text)
    return {root.tag: xml_value(root)}


def to_json(name: str):
    if name == "yaml" and yaml is None:
        raise ValueError("decode(yaml) needs a YAML library, which is not installed")

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(read(name, text), default=_plain)
            except Exception:  # noqa: BLE001  malformed text is null, whatever its parser raises
                return None

        return s.map(one, na_action="ignore")

    return run
