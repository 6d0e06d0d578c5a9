"""Subtrees as text: JSON, XML, HTML and Markdown, one group of descendants a node."""

from __future__ import annotations

import json
import re
from html import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


_XML_NAME = re.compile(r"[^\W\d][\w.-]*")


def _children(rows: list[dict]) -> dict:
    below: dict = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)
    for v in below.values():
        v.sort(key=lambda r: r["id"])
    return below


def _scalar(r):
    kind = (r["traits"] or ["string"])[0]
    if kind == "null" or r["value"] is None:
        return None
    if kind == "number":
        return json.loads(r["value"])
    return r["value"] == "true" if kind == "boolean" else r["value"]


def as_json(r, below):
    kind = (r["traits"] or [""])[0]
    inner = below.get(r["id"], [])
    if kind == "array":
        return [as_json(c, below) for c in inner]
    if kind == "object" or inner:
        return {c["name"]: as_json(c, below) for c in inner}
    return _scalar(r)


def as_xml(r, below) -> str:
    name = r["name"] or "root"
    if not _XML_NAME.fullmatch(name):  # an item of a list, or a key that is no element name
        name = "item"
    attributes = "".join(f' {k}="{escape(v or "")}"' for k, v in (r["props"] or [])) if "element" in (r["traits"] or []) else ""
    inner = "".join(as_xml(c, below) for c in below.get(r["id"], []))
    text = escape(r["value"] or "", False) if not inner else ""
    return f"<{name}{attributes}>{text}{inner}</{name}>" if text or inner else f"<{name}{attributes}/>"


def as_markdown(r, below, level: int = 0) -> str:
    name, inner = r["name"], below.get(r["id"], [])
    props = dict(r["props"] or [])
    if name == "section":
        level = int(props.get("level", level + 1))
        return "\n\n".join(["#" * level + " " + (r["value"] or ""), *[as_markdown(c, below, level) for c in inner]])
    if name == "list":
        return "\n".join("- " + (c["value"] or "") for c in inner)
    if name == "verbatim":
        return f"```\n{r['value'] or ''}\n```"
    if name == "quote":
        return "\n".join("> " + x for x in (r["value"] or "").split("\n"))
    return "\n\n".join([as_markdown(c, below, level) for c in inner]) if inner else r["value"] or ""


def as_html(r, below) -> str:
    if r["name"] == "section":
        level = dict(r["props"] or []).get("level", "1")
        return f"<h{level}>{escape(r['value'] or '')}</h{level}>" + "".join(as_html(c, below) for c in below.get(r["id"], []))
    tag = {"paragraph": "p", "list": "ul", "item": "li", "verbatim": "pre", "quote": "blockquote", "document": "article"}.get(r["name"])
    if tag is None:
        return as_xml(r, below)
    return f"<{tag}>{escape(r['value'] or '', False)}{''.join(as_html(c, below) for c in below.get(r['id'], []))}</{tag}>"


def subtree(compiler, st, kind: str):
    """The topic of each node: its subtree rendered."""
    from ..functions.readings import Val
    from ..plans.state import fresh

    node, nodes = st.node, st.node.source.nodes
    wanted = st.df.select(node.col("id").alias("__top")).distinct()
    rows = nodes.withColumn("__top", F.explode(F.array_append("ancestors", F.col("id")))).join(wanted, "__top")
    rows = rows.select("__top", "id", "parent", "name", "traits", "value", F.transform(F.map_entries("props"), lambda e: F.array(e["key"], e["value"])).alias("props"))
    draw = {"json": lambda r, b: json.dumps(as_json(r, b), ensure_ascii=False), "xml": as_xml, "markdown": as_markdown, "html": as_html}[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [{k: (None if v is None or isinstance(v, float) and v != v else list(v) if hasattr(v, "tolist") else v) for k, v in r.items()} for r in pdf.to_dict("records")]
        top = next(r for r in found if r["id"] == r["__top"])
        return pd.DataFrame({"__top": [top["id"]], "__text": [draw(top, _children(found))]})

    text = rows.groupBy("__top").applyInPandas(run, "__top long, __text string")
    name = fresh("text")
    df = st.df.join(text.withColumnRenamed("__text", name), node.col("id") == F.col("__top"), "left").drop("__top")
    return st.but(df=df, topic=Val(F.col(name), T.StringType()))
