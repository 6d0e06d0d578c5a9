"""Sources from files: delimited rows, and trees of JSON, YAML, TOML, XML, HTML, Markdown, text lines and archives.

A tree source shreds one document per row with Arrow batches: ``shred`` turns (document id, content) into nodes,
and ids are document number << 32 | place, so that order and identity hold across documents.
"""

from __future__ import annotations

import io
import json
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.structured import read as read_structured
from .model import NODE_SCHEMA, Arbor, Table, Tables

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em i img kbd label mark q s samp small span strong sub sup time u var wbr".split())


def delimited(spark: SparkSession, path: str, sep: str = ",") -> Tables:
    """Rows of text cells; an empty cell is null, a ragged record an error.  Rows stand in the order of the file."""
    df = spark.read.csv(path, header=True, inferSchema=False, nullValue="", sep=sep, mode="FAILFAST", multiLine=False, enforceSchema=False)
    names = df.columns
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())
    return rows_of(df, names)


def delimited_text(spark: SparkSession, text: str, sep: str = ",") -> Tables:
    """The same from text at hand."""
    import csv

    header, *rows = csv.reader(io.StringIO(text), delimiter=sep)
    for r in rows:
        if len(r) != len(header):
            raise ValueError(f"a record has {len(r)} cells, not {len(header)}")
    df = spark.createDataFrame([(*[c or None for c in r], i) for i, r in enumerate(rows)], ", ".join(f"`{c}` string" for c in header) + ", _row long")
    return rows_of(df, header)


def rows_of(df: DataFrame, names) -> Tables:
    order = tuple(c for c in ("_file", "_block", "_row") if c in df.columns)
    return Tables({"row": Table("row", df, order, None, {}, {"columns": ", ".join(names)})}, "row")


class _Tree:
    """Collects nodes of one document in document order."""

    def __init__(self, base: int, depth: int = 0, path: str = "", above: tuple[int, ...] = ()):
        self.base, self.rows, self.depth, self.path, self.above = base, [], depth, path, above
        self.edges: list[tuple[int, str, int]] = []

    def add(self, parent, name, traits, value=None, props=None, meta=None) -> int:
        """The new node's place; ``parent`` is a place or None."""
        at = len(self.rows)
        up = self.rows[parent] if parent is not None else None
        ancestors = [*up["ancestors"], up["id"]] if up else list(self.above)
        sib = up["n_children"] + 1 if up else 1
        if up:
            up["n_children"] += 1
        path = f"{up['locator'].rstrip('/')}/{name if name is not None else ''}" if up else self.path
        self.rows.append({"id": self.base | at, "parent": up["id"] if up else (self.above[-1] if self.above else None), "name": name, "sib": sib, "n_sib": 1, "depth": self.depth + (up["depth"] + 1 - self.depth if up else 0), "n_children": 0, "n_descendants": 0, "ancestors": ancestors, "traits": traits, "value": value, "props": props or {}, "meta": meta or {}, "locator": path or "/"})
        return at

    def done(self):
        place = {r["id"]: i for i, r in enumerate(self.rows)}
        for r in reversed(self.rows):
            up = place.get(r["parent"])
            if up is not None:
                self.rows[up]["n_descendants"] += r["n_descendants"] + 1
        for r in self.rows:
            up = place.get(r["parent"])
            if up is not None:
                r["n_sib"] = self.rows[up]["n_children"]
        return self.rows


def _scalar(x) -> str | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
        return str(int(x))
    return str(x)


_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def shred_value(tree: _Tree, x, name=None, parent=None) -> None:
    """JSON: every object, array and scalar is a node named by key or index; scalar fields are properties, too."""
    stack = [(x, name, parent)]
    while stack:
        x, name, parent = stack.pop()
        items = list(x.items()) if isinstance(x, dict) else [(str(i), v) for i, v in enumerate(x)] if isinstance(x, list) else []
        props = {k: _scalar(v) for k, v in items if not isinstance(v, (dict, list)) and v is not None}
        at = tree.add(parent, name, [_KINDS.get(type(x), "string")], None if items or isinstance(x, (dict, list)) else _scalar(x), props)
        stack += [(v, k, at) for k, v in reversed(items)]


def shred_xml(tree: _Tree, e: ET.Element, parent=None) -> None:
    stack = [(e, parent)]
    while stack:
        e, parent = stack.pop()
        text = "".join(e.itertext()).strip() if not len(e) else (e.text or "").strip()
        at = tree.add(parent, e.tag.rpartition("}")[2], ["element"], text or None, dict(e.attrib))
        stack += [(c, at) for c in reversed(e) if isinstance(c.tag, str)]


class _Html(HTMLParser):
    def __init__(self, tree: _Tree):
        super().__init__(convert_charrefs=True)
        self.tree, self.open, self.text = tree, [(tree.add(None, tree_name(tree), ["document"]), "")], {}

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th", "option") and self.open[-1][1] == tag:
            self.open.pop()
        traits = ["element", "heading" if tag in HEADINGS else "inline" if tag in INLINE else "block"] + (["link"] if tag == "a" else [])
        at = self.tree.add(self.open[-1][0], tag, traits, None, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append((at, tag))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][1] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open[-1][1] not in ("script", "style"):
            for at, _ in self.open:
                self.text.setdefault(at, []).append(data)

    def finish(self):
        for at, parts in self.text.items():
            value = " ".join("".join(parts).split())
            self.tree.rows[at]["value"] = value or None


def tree_name(tree: _Tree):
    return tree.path.rpartition("/")[2] or None


def shred_markdown(tree: _Tree, text: str, plain: bool = False) -> None:
    """Sections nested by their headings, with paragraphs, lists and verbatim blocks."""
    import re

    root = tree.add(None, tree_name(tree), ["document"])
    open_sections = [(0, root)]
    for block in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        lines = block.strip("\n")
        if not lines.strip():
            continue
        m = None if plain else re.match(r"(#{1,6})\s+(.*)", lines)
        if m:
            level = len(m[1])
            while open_sections[-1][0] >= level:
                open_sections.pop()
            at = tree.add(open_sections[-1][1], "section", ["section", "block"], m[2].strip(), {"title": m[2].strip(), "level": str(level)})
            open_sections.append((level, at))
            lines = "\n".join(lines.split("\n")[1:])
            if not lines.strip():
                continue
        parent = open_sections[-1][1]
        if not plain and lines.startswith("```"):
            tree.add(parent, "verbatim", ["block"], "\n".join(lines.split("\n")[1:]).removesuffix("```").rstrip("\n"))
        elif not plain and re.match(r"\s*([-*+]|\d+\.)\s", lines):
            at = tree.add(parent, "list", ["block"])
            for item in re.split(r"\n(?=\s*(?:[-*+]|\d+\.)\s)", lines):
                tree.add(at, "item", ["block"], re.sub(r"^\s*(?:[-*+]|\d+\.)\s+", "", item).strip())
        elif not plain and lines.startswith(">"):
            tree.add(parent, "quote", ["block"], re.sub(r"^>\s?", "", lines, flags=re.M))
        else:
            tree.add(parent, "paragraph", ["block"], " ".join(lines.split()))


def shred_lines(tree: _Tree, text: str) -> None:
    root = tree.add(None, tree_name(tree), ["document"])
    for i, line in enumerate(text.splitlines()):
        tree.add(root, "line", ["line"], line, {"number": str(i + 1)})


def shred_archive(tree: _Tree, data: bytes) -> None:
    """Members of zip and tar files as a tree of names; text is decoded leniently."""
    root = tree.add(None, tree_name(tree), ["archive"])
    folders = {"": root}
    if zipfile.is_zipfile(io.BytesIO(data)):
        z = zipfile.ZipFile(io.BytesIO(data))
        members = [(i.filename, None if i.is_dir() else z.read(i)) for i in z.infolist()]
    else:
        t = tarfile.open(fileobj=io.BytesIO(data))
        members = [(m.name, t.extractfile(m).read() if m.isfile() else None) for m in t.getmembers()]
    for name, content in members:
        parts = [p for p in name.split("/") if p not in ("", ".")]
        for i, part in enumerate(parts):
            key = "/".join(parts[: i + 1])
            if key not in folders:
                leaf = i == len(parts) - 1 and content is not None
                folders[key] = tree.add(folders["/".join(parts[:i])], part, ["file" if leaf else "dir"], content.decode("utf-8", "replace") if leaf else None, {"size": str(len(content))} if leaf else {})


def shred(kind: str, tree: _Tree, content) -> None:
    text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) and kind != "archive" else content
    if kind == "json":
        shred_value(tree, json.loads(text), tree_name(tree))
    elif kind == "jsonl":
        root = tree.add(None, tree_name(tree), ["array"])
        for i, line in enumerate(x for x in text.splitlines() if x.strip()):
            shred_value(tree, json.loads(line), str(i), root)
    elif kind in ("yaml", "toml"):
        shred_value(tree, read_structured(kind, text), tree_name(tree))
    elif kind == "xml":
        root = tree.add(None, tree_name(tree), ["document"])
        shred_xml(tree, ET.fromstring(text), root)
    elif kind == "html":
        parser = _Html(tree)
        parser.feed(text)
        parser.close()
        parser.finish()
    elif kind in ("markdown", "text"):
        shred_markdown(tree, text, kind == "text")
    elif kind == "lines":
        shred_lines(tree, text)
    elif kind == "archive":
        shred_archive(tree, bytes(content))
    else:
        raise ValueError(f"unknown kind {kind!r}")


_ARROW = pa.schema([("id", pa.int64()), ("parent", pa.int64()), ("name", pa.string()), ("sib", pa.int32()), ("n_sib", pa.int32()), ("depth", pa.int32()), ("n_children", pa.int32()), ("n_descendants", pa.int64()), ("ancestors", pa.list_(pa.int64())), ("traits", pa.list_(pa.string())), ("value", pa.string()), ("props", pa.map_(pa.string(), pa.string())), ("meta", pa.map_(pa.string(), pa.string())), ("locator", pa.string())])


def _batch(rows):
    maps = ("props", "meta")
    return pa.RecordBatch.from_arrays([pa.array([list(r[f.name].items()) if f.name in maps else r[f.name] for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def arbor_of(spark: SparkSession, kind: str, content, **options) -> Arbor:
    """The arbor of one document at hand."""
    tree = _Tree(0)
    shred(kind, tree, content)
    rows = tree.done()
    nodes = spark.createDataFrame(pa.Table.from_batches([_batch(rows)])).select(*[x.split()[0] for x in NODE_SCHEMA.split(", ")])
    at = {k: v for k, v in options.items()}
    if kind in ("xml", "html") and "edges" not in at:
        at["edges"] = id_links(nodes)
        at.setdefault("refs", "id")
    return Arbor(nodes, **at)


def id_links(nodes: DataFrame) -> DataFrame:
    """Links from references (href="#x", idref) to the elements of those ids."""
    targets = nodes.where("props['id'] IS NOT NULL").select(F.col("props")["id"].alias("ref"), F.col("id").alias("dst"))
    refs = nodes.select(F.col("id").alias("src"), F.explode("props").alias("label", "v")).where("label IN ('href', 'idref', 'ref', 'for') AND (v LIKE '#%' OR label <> 'href')")
    refs = refs.select("src", "label", F.regexp_replace("v", "^#", "").alias("ref"))
    return refs.join(targets, "ref").select("src", "label", "dst", F.create_map().cast("map<string,string>").alias("props"))


def forest(docs: DataFrame, doc_id: str, content: str, kind: str, **options) -> Arbor:
    """The documents of a table as the children of one root, named by their ids, shredded where they lie.

    Ids must be whole numbers from 0 to 2^30; malformed documents become a node of trait ``malformed``.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = _Tree((name + 1) << 32, 1, f"/{name}", (0,))
                try:
                    shred(kind, tree, text or "")
                except Exception:  # noqa: BLE001  whatever a parser raises on bad input
                    tree = _Tree((name + 1) << 32, 1, f"/{name}", (0,))
                    tree.add(None, str(name), ["malformed"], text)
                rows += tree.done()
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    root = _Tree(0)
    root.add(None, None, ["forest"])
    spark = docs.sparkSession
    top = spark.createDataFrame(pa.Table.from_batches([_batch(root.done())]))
    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
    inner = docs.select(F.col(doc_id).cast("long"), F.col(content)).mapInArrow(run, NODE_SCHEMA)
    return Arbor(top.select(*names).unionByName(inner.select(*names)), **options)


def binary_files(spark: SparkSession, path: str, kind: str) -> Arbor:
    """Files below a path, each a document under one root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    from pyspark.sql import Window

    numbered = files.select("path", "content").withColumn("n", F.row_number().over(Window.orderBy("path")) - 1)  # a listing, not data
    return forest(numbered, "n", "content", kind)
