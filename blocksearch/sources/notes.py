"""A folder of notes as block trees: a file a page, an outline of bullets.

A line that begins with ``- `` or ``* ``, after blanks or tabs (a tab is up to four
blanks), begins a block; its parent is the last block before it that is indented
less. Other lines go on with their block, without its indentation; one that reads
``id:: name`` names the block. Lines before the first bullet are a block without
children. Within a fence of three backticks, bullets that are indented deeper than
its block are text. Bytes that are no UTF-8 become U+FFFD; a mark of byte order
is dropped. An empty file gives no rows and has no number.

Spark lists the folder and deals the files to tasks, so that any file system it
can read will do; one file is read whole in its task."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import numbered
from ..schema import TREE

_BULLET = re.compile(r"([ \t]*)[-*](?: (.*))?", re.S)
_NAME = re.compile(r"\s*id::[ \t]+(\S+)\s*")
_FENCE = "```"
#: Blocks that leave a task at once.
TOGETHER = 4096


def _without(line: str, columns: int) -> str:
    """A line without blanks that fill up to so many columns."""
    at = width = 0
    while at < len(line) and width < columns and line[at] in " \t":
        width += 1 if line[at] == " " else 4 - width % 4
        at += 1
    return line[at:]


def outline(text: str, page: str) -> list[tuple[str, str | None, int, str]]:
    """``uuid, parent_uuid, sibling_ord, content`` of a page's blocks, in their
    order. A block without a name, or with one that an earlier block has, is
    called by the page and its number."""
    blocks: list[dict] = []
    above: list[tuple[int, int]] = []  # indentation and place of the blocks that are open
    children: dict[int | None, int] = {}
    fenced = False

    def begin(parent: int | None, first: str) -> None:
        blocks.append({"parent": parent, "ord": children.get(parent, 0), "lines": [first], "name": None})
        children[parent] = children.get(parent, 0) + 1

    for line in text.split("\n"):
        bullet = _BULLET.fullmatch(line)
        depth = len(bullet[1].expandtabs(4)) if bullet else 0
        if bullet and not (fenced and above and depth > above[-1][0]):
            while above and above[-1][0] >= depth:
                above.pop()
            begin(above[-1][1] if above else None, bullet[2] or "")
            above.append((depth, len(blocks) - 1))
            fenced = (bullet[2] or "").lstrip().startswith(_FENCE)
            continue
        if not blocks:
            if line.strip():
                begin(None, line)
            continue
        name = None if fenced else _NAME.fullmatch(line)
        if name and blocks[-1]["name"] is None:
            blocks[-1]["name"] = name[1]
            continue
        rest = _without(line, above[-1][0] + 2 if above else 0)
        fenced ^= rest.lstrip().startswith(_FENCE)
        blocks[-1]["lines"].append(rest)
    taken, names = set(), []
    for i, block in enumerate(blocks):
        own = block["name"] if block["name"] and block["name"] not in taken else f"{page}#{i}"
        taken.add(own)
        names.append(own)
    return [(names[i], None if b["parent"] is None else names[b["parent"]], b["ord"], "\n".join(b["lines"]).rstrip("\n")) for i, b in enumerate(blocks)]


def read_notes(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """The blocks of all files under ``folder`` whose names match, as ``TREE``.
    A page is called by its path in the folder, without its ending and with
    ``%`` codes read; pages are numbered by their paths."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(conf).makeQualified(place).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    order = numbered(files.select("path"), "path", name="page_ord")

    kinds = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in TREE.fields]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # of a batch of files, one at a time is text and blocks
                path, content, number = (column[i].as_py() for column in batch.columns)
                page = unquote(path.removeprefix(root)).rsplit(".", 1)[0]
                rows = outline(content.decode("utf-8-sig", "replace"), page)
                del content
                for at in range(0, len(rows), TOGETHER):
                    columns = [[number] * len(rows[at : at + TOGETHER]), [page] * len(rows[at : at + TOGETHER]), *map(list, zip(*rows[at : at + TOGETHER], strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=TREE.names)

    return files.select("path", "content").join(order, "path").select("path", "content", "page_ord").mapInArrow(parse, TREE)


def write_notes(pages: DataFrame, folder: str, page: str = "page", text: str = "text", *order: str) -> None:
    """``text`` of rows, in ``order``, as a file for each ``page``, in a folder
    ``page=...`` of its own."""
    rows = pages.select(page, *order, text).repartition(page).sortWithinPartitions(page, *order)
    rows.select(page, F.col(text).alias("value")).write.partitionBy(page).text(folder)
