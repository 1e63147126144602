"""Deeply nested records into flat tables that keep their parent.

Method: interval labels. A depth-first walk of each record gives every node a pre-order and a post-order number; nodes
are emitted per type and linked by containment: a child belongs to the ancestor whose [pre, post] holds its own. The
containment search is a binary search over the labels of one Arrow batch, so nothing is shuffled: parsing, labelling and
linking are one pass over the input partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeType:
    """One type of node: where it stands below its parent and which of its fields are kept, as text.

    path: the key that holds the nodes; wrapper: a key that some converters put between the list and its elements.
    """

    name: str
    path: str
    wrapper: str
    fields: tuple[str, ...]
    children: tuple["NodeType", ...] = field(default=())


#: Keys of the public GBSeq format.
QUALIFIER = NodeType("qual", "GBFeature_quals", "GBQualifier", ("GBQualifier_name", "GBQualifier_value"))
INTERVAL = NodeType("interval", "GBFeature_intervals", "GBInterval", ("GBInterval_from", "GBInterval_to", "GBInterval_point"))
FEATURE = NodeType("feature", "GBSeq_feature-table", "GBFeature", ("GBFeature_key",), (QUALIFIER, INTERVAL))
GBSEQ_WRAPPERS = ("GBSet", "GBSeq")

SCHEMA = "node_type string, pre bigint, post bigint, ordinal bigint, parent_pre bigint, parent_ordinal bigint, fields array<string>"


def _unwrap(x, keys: tuple[str, ...]) -> list[dict]:
    """The objects inside lists, wrappers and JSON kept as text, at any depth, in the order delivered."""
    out, open_ = [], [x]
    while open_:
        x = open_.pop()
        if isinstance(x, list):
            open_.extend(reversed(x))
        elif isinstance(x, dict) and (k := next((k for k in keys if k in x), None)):
            open_.append(x[k])
        elif isinstance(x, dict):
            out.append(x)
        elif isinstance(x, str):
            try:
                open_.append(json.loads(x))
            except ValueError:
                pass
    return out


def _elements(x, wrapper: str) -> list:
    """The elements in the order delivered: a list, a lone object, either of them wrapped or as JSON text."""
    while True:
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                return []
        elif isinstance(x, dict) and wrapper in x:
            x = x[wrapper]
        else:
            return [] if x is None else x if isinstance(x, list) else [x]


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _label(roots: list[dict], top: tuple[NodeType, ...], clock: int, out: list[list]) -> int:
    """Depth-first over one record; appends (type, pre, post, ordinal, fields) per node, returns the next number.

    Several roots (a record delivered as a list of objects) are one: their nodes are numbered on.
    """
    pending: list[tuple] = [("scan", roots, t) for t in reversed(top)]
    clock += 1
    while pending:
        what, x, t = pending.pop()
        if what == "close":
            out[2][x] = clock
            clock += 1
        elif what == "scan":
            items = [(n, e) for n, e in enumerate((e for r in x for e in _elements(r.get(t.path), t.wrapper)), 1) if isinstance(e, dict)]
            pending.extend(("open", item, t) for item in reversed(items))
        else:
            n, e = x
            out[0].append(t.name), out[1].append(clock), out[2].append(0), out[3].append(n)
            out[4].append([_text(e.get(f)) for f in t.fields])
            clock += 1
            pending.append(("close", len(out[0]) - 1, t))
            pending.extend(("scan", [e], c) for c in reversed(t.children))
    return clock + 1


def _link(kinds: np.ndarray, pre: np.ndarray, post: np.ndarray, ordinal: np.ndarray, types: tuple[NodeType, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each node the pre and ordinal of its containing node of the parent type (0: none), by binary search."""
    parent_pre, parent_ordinal = np.zeros(len(pre), np.int64), np.zeros(len(pre), np.int64)
    for t in types:
        up = np.flatnonzero(kinds == t.name)
        for c in t.children:
            down = np.flatnonzero(kinds == c.name)
            if len(up) and len(down):
                at = np.searchsorted(pre[up], pre[down], "right") - 1
                held = up[np.maximum(at, 0)]
                ok = (at >= 0) & (post[held] > post[down])
                parent_pre[down], parent_ordinal[down] = np.where(ok, pre[held], 0), np.where(ok, ordinal[held], 0)
        p, o = _link(kinds, pre, post, ordinal, t.children)
        parent_pre, parent_ordinal = parent_pre + p, parent_ordinal + o
    return parent_pre, parent_ordinal


def node_table(df: DataFrame, record: str, keep: list[str], types: tuple[NodeType, ...] = (FEATURE,), wrappers: tuple[str, ...] = GBSEQ_WRAPPERS) -> DataFrame:
    """One row per node of the JSON column record: keep, node_type, pre, post, ordinal, parent_pre, parent_ordinal, fields.

    ordinal counts from 1 in the order delivered: a lone object is 1, a null element is no row but keeps its number.
    pre and post count from 1 within the record, whatever the partitions. Null, empty, broken or incomplete JSON, JSON
    nested deeper than the parser's recursion limit and records without the keys give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            source: list[int] = []
            base: list[int] = []  # the last number before each node's record
            clock = 1
            for i, raw in enumerate(b.column(b.num_columns - 1).to_pylist()):
                try:
                    roots = _unwrap(json.loads(raw), wrappers) if raw else []
                except (ValueError, RecursionError):
                    continue
                if roots:
                    start, clock = clock, _label(roots, types, clock, out)
                    new = len(out[0]) - len(source)
                    source.extend([i] * new), base.extend([start] * new)
            if not source:
                continue
            pre, post, ordinal = (np.array(c, np.int64) for c in out[1:4])
            parent_pre, parent_ordinal = _link(np.array(out[0], object), pre, post, ordinal, types)
            start = np.array(base, np.int64)
            pre, post, parent_pre = pre - start, post - start, np.maximum(parent_pre - start, 0)
            kept = b.select(keep).take(pa.array(source))
            more = [pa.array(out[0], pa.string()), pa.array(pre), pa.array(post), pa.array(ordinal), pa.array(parent_pre), pa.array(parent_ordinal), pa.array(out[4], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], [*keep, "node_type", "pre", "post", "ordinal", "parent_pre", "parent_ordinal", "fields"])

    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, F.col(record).alias("_record")).mapInArrow(run, f"{kept}, {SCHEMA}")


def features(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, feature_no, feature_key, pre, post): the features of a node table."""
    return nodes.where("node_type = 'feature'").select(id_col, F.col("ordinal").alias("feature_no"), F.col("fields")[0].alias("feature_key"), "pre", "post")


def qualifiers(nodes: DataFrame, *keep: str) -> DataFrame:
    """(keep, feature_no, qual_no, name, value): the qualifiers, each with the feature that contains it."""
    return nodes.where("node_type = 'qual'").select(*keep, F.col("parent_ordinal").alias("feature_no"), F.col("ordinal").alias("qual_no"), F.col("fields")[0].alias("name"), F.col("fields")[1].alias("value"))


def feature_intervals(nodes: DataFrame, *keep: str) -> DataFrame:
    """(keep, feature_no, interval_no, range_from, range_to): the intervals; a point is both of its ends."""
    f = F.col("fields")
    return nodes.where("node_type = 'interval'").select(*keep, F.col("parent_ordinal").alias("feature_no"), F.col("ordinal").alias("interval_no"), F.coalesce(f[0], f[2]).alias("range_from"), F.coalesce(f[1], f[2]).alias("range_to"))


def flat_items(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, feature_no, child, child_no, item): features (child_no 0, item the key), qualifiers (name), intervals (from..to)."""
    f, kind = F.col("fields"), F.col("node_type")
    item = F.when(kind == "interval", F.concat_ws("..", F.coalesce(f[0], f[2]), F.coalesce(f[1], f[2]))).otherwise(f[0])
    number = F.when(kind == "feature", F.col("ordinal")).otherwise(F.col("parent_ordinal"))
    child_no = F.when(kind == "feature", F.lit(0)).otherwise(F.col("ordinal")).cast("bigint")
    return nodes.select(id_col, number.alias("feature_no"), kind.alias("child"), child_no.alias("child_no"), item.alias("item"))
