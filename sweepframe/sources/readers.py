"""Readers and writers of result files as DataFrames: tables with comment headers, matrices, graphs, trees, sequences.

Files are read as text or bytes by Spark, one row per line or file, with their path kept; decompression of gz and bz2 is
Hadoop's, xz is opened per file. A file that is one object (a tree, a compressed blob) is one row and so one task's work.
"""

from __future__ import annotations

import lzma
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import staged
from .headers import body, pairs, unquote

PATH = "_metadata.file_path"


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, modified) of the files that a glob finds, without their content."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.col("modificationTime").alias("modified"))


def format_of(path: Column) -> Column:
    """The format by extension, a compression suffix aside: newick, mm, gml, fasta, else tsv."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(path, r"\.(bz2?|gz|xz)$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("nwk", "newick", "tre", "tree"), "newick").when(ext.isin("mtx", "mm"), "mm").when(ext == "gml", "gml").when(ext.isin("fa", "fas", "fasta"), "fasta").otherwise("tsv")


def lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, line_no, line): the lines of text files, gz and bz2 included. line_no counts within the file, from 1.

    A file is one value here, so that its lines can be numbered: for headers, matrices and graphs of up to some GB. Tables
    go through read_table, which splits files.
    """
    raw = spark.read.text(pattern, wholetext=True).select(F.col(PATH).alias("path"), "value")
    return raw.select("path", F.posexplode(F.split("value", r"\r?\n"))).select("path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def xz_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, line_no, line) of xz files, which Hadoop has no codec for; each file is opened as a stream in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = lzma.decompress(content).decode("utf-8", "replace").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(text)), pa.array(range(1, len(text) + 1), pa.int32()), pa.array(text, pa.string())], ["path", "line_no", "line"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, "path string, line_no int, line string")


def metadata(text: DataFrame, path: str, header: str) -> DataFrame:
    """(path, metadata MAP<STRING, STRING>) of header texts; null where a header is no complete map. Values stay text: 'N' is 'N'."""
    rows = staged(staged(text.select(F.col(path).alias("path"), F.col(header).alias("_h")), _b=body(F.col("_h"))), _p=pairs(F.col("_b")))
    value = F.transform(F.col("_p"), lambda p: F.struct(p["key"].alias("key"), unquote(p["raw"]).alias("value")))
    last = F.filter(value, lambda e, i: ~F.exists(F.slice(value, i + 2, F.size(value)), lambda o: o["key"] == e["key"]))
    return rows.select("path", F.when(F.col("_p").isNotNull(), F.map_from_entries(last)).alias("metadata"))


def collect_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """The metadata of files of any known format: line 1 of tables, trees and sequences, line 2 of matrices, the comment of graphs."""
    l = lines(spark, pattern).where("line_no <= 20").withColumn("fmt", format_of(F.col("path")))  # noqa: E741
    wanted = F.when(F.col("fmt") == "mm", F.col("line_no") == 2).when(F.col("fmt") == "gml", F.col("line").rlike(r"^\s*comment\s")).otherwise(F.col("line_no") == 1)
    return metadata(l.where(wanted), "path", "line")


def read_table(spark: SparkSession, pattern: str, schema: str, sep: str = "\t", sentinel: str = "EOF", header: bool = True) -> DataFrame:
    """A table with '#' comment lines; the sentinel line and blank lines are dropped; path is kept as a column."""
    t = spark.read.options(sep=sep, comment="#", header=header, mode="PERMISSIVE", nullValue="NA").schema(schema).csv(pattern)
    known = F.lit(False)
    for c in t.columns:
        known = known | F.col(c).isNotNull()
    first = t.columns[0]
    return t.where(known & (F.coalesce(F.col(first).cast("string"), F.lit("")) != sentinel)).select("*", F.col(PATH).alias("path"))


def with_metadata(table: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the given metadata keys as text columns (suffix _meta where a name is taken), joined on path."""
    names = {k: f"{k}_meta" if k in table.columns else k for k in keys}
    return table.join(meta.select("path", *[F.col("metadata")[k].alias(n) for k, n in names.items()]), "path", "left")


def read_matrix(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, i, j, v), counted from 1, of MatrixMarket files: symmetric and general arrays (column by column) and coordinates.

    A symmetric array holds its lower triangle; both halves come out. Other kinds give no rows.
    """
    l = lines(spark, pattern).where("trim(line) <> ''")  # noqa: E741
    kind = l.where("line_no = 1").select("path", F.lower("line").alias("kind"))
    data = l.where(~F.col("line").startswith("%")).select("path", "line_no", F.split(F.trim("line"), r"\s+").alias("c"))
    first = data.groupBy("path").agg(F.min(F.struct("line_no", "c")).alias("f"))
    rows = data.join(first, "path").where(F.col("line_no") > F.col("f.line_no")).join(kind, "path")
    n = F.col("f.c")[0].cast("bigint")
    if_array, k = F.col("kind").contains("array"), (F.col("line_no") - F.col("f.line_no") - 1).cast("bigint")
    symmetric = F.col("kind").contains("symmetric")
    # column j of a lower triangle starts at j n - j (j - 1) / 2 (j from 0)
    j = F.floor(((2 * n + 1) - F.sqrt(((2 * n + 1) * (2 * n + 1) - 8 * k).cast("double"))) / 2)
    j = F.when(j * n - j * (j - 1) / 2 > k, j - 1).when((j + 1) * n - (j + 1) * j / 2 <= k, j + 1).otherwise(j).cast("bigint")
    i = (k - (j * n - j * (j - 1) / 2) + j).cast("bigint")
    v = F.element_at(F.col("c"), -1).try_cast("double")
    cell = F.when(if_array & symmetric, F.struct(i.alias("i"), j.alias("j"))).when(if_array, F.struct((k % n).alias("i"), F.floor(k / n).cast("bigint").alias("j")))
    cell = cell.when(F.col("kind").contains("coordinate"), F.struct((F.col("c")[0].try_cast("bigint") - 1).alias("i"), (F.get("c", F.lit(1)).try_cast("bigint") - 1).alias("j")))
    cells = staged(rows, _cell=cell, v=v).where("_cell is not null").select("path", F.col("_cell.i").alias("i"), F.col("_cell.j").alias("j"), "v", symmetric.alias("s"))
    both = F.when(F.col("s") & (F.col("i") != F.col("j")), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    return cells.select("path", F.explode(both).alias("e"), "v").select("path", (F.col("e.i") + 1).alias("i"), (F.col("e.j") + 1).alias("j"), "v")


def _newick(text: str) -> list[tuple]:
    """(node, parent, child_pos, length, label, is_tip) of one Newick tree, nodes numbered in pre-order from 1."""
    rows: list[list] = []
    stack: list[int] = []
    i, n, fresh = 0, len(text), True

    def add() -> int:
        parent = stack[-1] if stack else None
        rows.append([len(rows) + 1, parent, None, None, None, True])
        return len(rows)

    at = None
    while i < n and text[i] != ";":
        c = text[i]
        if c == "(":
            node = add()
            rows[node - 1][5] = False
            stack.append(node)
            at, fresh = None, True
            i += 1
        elif c == ",":
            if fresh:
                add()
            at, fresh = None, True
            i += 1
        elif c == ")":
            if fresh:
                add()
            at, fresh = stack.pop(), False
            i += 1
        elif c == "[":
            i = text.index("]", i) + 1
        elif c.isspace():
            i += 1
        else:
            if at is None:
                at = add()
            fresh = False
            if c == ":":
                j = i + 1
                while j < n and text[j] not in ",();[":
                    j += 1
                rows[at - 1][3] = float(text[i + 1 : j])
            elif c == "'":
                j = i + 1
                while text[j] != "'" or text[j + 1 : j + 2] == "'":
                    j += 2 if text[j] == "'" else 1
                rows[at - 1][4] = text[i + 1 : j].replace("''", "'")
                j += 1
            else:
                j = i
                while j < n and text[j] not in ",():;[":
                    j += 1
                rows[at - 1][4] = text[i:j].strip()
            i = j
    seen: dict = {}
    for r in rows:
        seen[r[1]] = r[2] = seen.get(r[1], 0) + 1
    return [tuple(r) for r in rows]


def parse_newick(df: DataFrame, tree: str, text: str) -> DataFrame:
    """(tree, node, parent, child_pos, length, label, is_tip): node tables of Newick texts, one tree per row.

    '#' lines before the tree are skipped; null, empty and broken texts give no rows. A tree is one value, parsed in its task.
    """
    schema = f"tree {df.schema[tree].dataType.simpleString()}, node bigint, parent bigint, child_pos int, length double, label string, is_tip boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t in zip(b["tree"], b["text"]):
                try:
                    t = "\n".join(x for x in t.splitlines() if not x.startswith("#")) if t else ""
                    out += [(key, *r) for r in _newick(t)] if "(" in t else []
                except (ValueError, IndexError):
                    continue
            frame = pd.DataFrame(out, columns=["tree", "node", "parent", "child_pos", "length", "label", "is_tip"])
            yield frame.astype({"node": "Int64", "parent": "Int64", "child_pos": "Int32", "length": "Float64"})

    return df.select(F.col(tree).alias("tree"), F.col(text).alias("text")).mapInPandas(run, schema)


def read_gml(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of GML graphs: (path, id, remove, cluster, grp) and (path, src, dst, transmit)."""
    whole = spark.read.text(pattern, wholetext=True).select(F.col(PATH).alias("path"), F.col("value").alias("text"))

    def blocks(kind: str) -> DataFrame:
        return whole.select("path", F.explode(F.regexp_extract_all("text", F.lit(rf"(?s)\b{kind}\s*\[(.*?)\]"), F.lit(1))).alias("b"))

    def field(name: str, kind: str) -> Column:
        return F.nullif(F.regexp_extract("b", rf'(?:^|\s){name}\s+"?([^"\s]+)"?', 1), F.lit("")).try_cast(kind)

    vertices = blocks("node").select("path", field("id", "bigint").alias("id"), field("remove", "double").alias("remove"), field("cluster", "int").alias("cluster"), field("group", "string").alias("grp"))
    edges = blocks("edge").select("path", field("source", "bigint").alias("src"), field("target", "bigint").alias("dst"), field("transmit", "double").alias("transmit"))
    return vertices, edges


def read_fasta(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, id, t, seq): sequences with headers '<id>_<days or years since 1970>'; t is null where the header has none."""
    raw = spark.read.text(pattern, lineSep=">").where("trim(value) <> ''").select(F.col(PATH).alias("path"), F.split("value", r"\r?\n", 2).alias("p"))
    head = F.trim(F.col("p")[0])
    return raw.select("path", F.regexp_replace(head, r"_-?\d+$", "").alias("id"), F.nullif(F.regexp_extract(head, r"_(-?\d+)$", 1), F.lit("")).try_cast("int").alias("t"), F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s+", "").alias("seq"))


def write_table(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Tab-separated files with a header line and no quotes."""
    w = df.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "")
    (w.option("compression", compression) if compression else w).csv(path)


def write_matrix(df: DataFrame, path: str, i: str = "i", j: str = "j", v: str = "v", size: int | None = None) -> None:
    """A symmetric MatrixMarket array of the lower triangle of (i, j, v), counted from 1, '%.6f', as ordered text parts under path.

    Absent cells are 0; size is the number of rows, the greatest index by default. Parts are ranges of columns in order:
    concatenated they are the file. Cells are made column by column, so the work is that of the array written.
    """
    spark = df.sparkSession
    n = size if size is not None else df.agg(F.max(F.greatest(i, j))).first()[0] or 0
    lower = df.where(F.col(i) >= F.col(j)).select(F.col(j).cast("bigint").alias("j"), F.col(i).cast("bigint").alias("i"), F.col(v).cast("double").alias("v"))
    cells = spark.range(1, n + 1).select(F.col("id").alias("j"), F.explode(F.sequence("id", F.lit(n).cast("bigint"))).alias("i")) if n else spark.createDataFrame([], "j bigint, i bigint")
    body_ = cells.join(lower, ["j", "i"], "left").repartitionByRange("j", "i").sortWithinPartitions("j", "i")
    head = spark.createDataFrame([("%%MatrixMarket matrix array real symmetric",), (f"{n} {n}",)], "value string").coalesce(1)
    head.union(body_.select(F.format_string("%.6f", F.coalesce("v", F.lit(0.0))).alias("value"))).write.text(path)


def write_fasta(df: DataFrame, path: str, id_col: str = "id", t: str = "t", seq: str = "seq") -> None:
    """FASTA files under path with headers '<id>_<t>', without the '_' part where t is null. Rows without id or sequence are left out."""
    head = F.concat(F.lit(">"), F.col(id_col).cast("string"), F.when(F.col(t).isNotNull(), F.concat(F.lit("_"), F.col(t).cast("string"))).otherwise(F.lit("")))
    df.where(F.col(id_col).isNotNull() & F.col(seq).isNotNull()).select(F.concat_ws("\n", head, seq).alias("value")).write.text(path)


def newick_texts(nodes: DataFrame) -> DataFrame:
    """(tree, text) of node tables (tree, node, parent, length, label): one Newick text per tree, children in the order of node.

    A text is one value, so each tree is put together in one task; trees are spread over the tasks. Labels are quoted where
    they need it; null lengths and labels are left out. A tree with several roots or none has a null text.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        kids: dict = {}
        for i, p in enumerate(pdf["parent"]):
            kids.setdefault(None if pd.isna(p) else p, []).append(i)
        names, lengths, labels = pdf["node"].tolist(), pdf["length"].tolist(), pdf["label"].tolist()
        roots, text = kids.get(None, []), None
        if len(roots) == 1:
            parts, open_ = [], [("enter", roots[0])]
            while open_:
                what, i = open_.pop()
                own = kids.get(names[i], []) if what == "enter" else []
                if own:
                    parts.append("(")
                    open_.append(("leave", i))
                    for k, child in enumerate(reversed(own)):
                        open_.append(("enter", child))
                        if k < len(own) - 1:
                            open_.append(("comma", child))
                    continue
                if what == "comma":
                    parts.append(",")
                    continue
                label = labels[i]
                quoted = "" if label is None or pd.isna(label) else label if re.fullmatch(r"[^\s()\[\]{},:;']+", label) else "'" + label.replace("'", "''") + "'"
                parts.append((")" if what == "leave" else "") + quoted + ("" if pd.isna(lengths[i]) else f":{lengths[i]!r}"))
            text = "".join([*parts, ";"])
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "text": [text]})

    rows = nodes.select("tree", "node", "parent", F.col("length").cast("double").alias("length"), F.col("label").cast("string").alias("label"))
    return rows.groupBy("tree").applyInPandas(one, f"tree {nodes.schema['tree'].dataType.simpleString()}, text string")
