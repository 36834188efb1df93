"""Chat formatting as a prefix tree.

Conversations that share their first turns share the nodes of one tree (a node
is one turn after all turns before it).  Each node is emitted once, depth
first; its tokens get position ids counted along their own conversation, and
the intervals of emitted tokens that they may attend to besides their own node
(the ancestors; neighbours merged).  The unit of a token here is a code point;
offsets of any tokenizer can be laid over it.

Template: ``### role:\\n`` text ``</turn>\\n``; in roles and texts ``\\``, ``#``
and ``<`` (in roles also ``:`` and line ends) are escaped, so that no control
string can come from a text; reading back undoes it.

Turns are read in order as a stream (sorted partitions), so a conversation of
any length takes constant memory.  Depth-first places come from sorting the
distinct paths over all tasks; each task lays out its part, and the driver
only chains one row of totals a task.

Defined results: NULL text or role counts as empty; rows go by turn, then role
and text (NULL turns first); repeated rows are turns of their own; a NULL
conversation id is a conversation of its own; equal conversations share all
nodes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kharif.llm.common import prepare, written

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
LOSS_ROLE = "assistant"
_NODE = 16  # bytes of a node's name

_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n", "\r": "\\r"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_IN_TEXT, _IN_ROLE, _ESCAPED = re.compile(r"[\\#<]"), re.compile(r"[\\#<:\n\r]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^#<:\n]*):\n([^#<]*)</turn>\n")


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: _ESCAPES[m.group()], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m.group(1)], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text in it."""
    head, body = f"{OPEN}{escape(role, True)}{MIDDLE}", escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, span of the escaped text) of each turn; the whole input
    must be turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m.group(1)), unescape(m.group(2)), m.start(2), m.end(2)))
        at = m.end()
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


_TURNS = "conv_id {id}, seq long, node binary, parent binary, depth long, pos long, size long, loss_from long, loss_to long, segment string, path binary, sizes array<long>"


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row a turn with its tree node; the last of a conversation also has
    the path of nodes and their sizes."""
    col = lambda c: F.col(f"`{c}`")
    rows = rows.select(
        col(conv_col).alias("conv_id"),
        col(turn_col).alias("turn"),
        F.coalesce(col(role_col), F.lit("")).alias("role"),
        F.coalesce(col(text_col), F.lit("")).alias("text"),
    )
    keys = ["conv_id", "turn", "role", "text"]
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = [x.split(" ")[0] for x in _TURNS.format(id="x").split(", ")]

    def noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, made = None, []

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal made
            out, made = (made, []) if last else (made[:-1], made[-1:])
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names=names)

        prior: tuple | None = None
        seq = pos = 0
        node, path, sizes = b"", bytearray(), []
        for batch in batches:
            if schema is None:
                i, b = pa.int64(), pa.binary()
                schema = [batch.schema.field(0).type, i, b, b, i, i, i, i, i, pa.string(), b, pa.list_(i)]
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if prior is None or prior[0] != conv:
                    if made:
                        made[-1] = (*made[-1][:10], bytes(path), sizes)
                    seq, pos, node, path, sizes = 0, 0, b"", bytearray(), []
                    prior = (conv,)
                segment, start, stop = format_turn(role, text)
                parent = node or None
                node = hashlib.blake2b(segment.encode("utf-8", "replace"), digest_size=_NODE, key=node).digest()
                if role != LOSS_ROLE:
                    start = stop = None
                made.append((conv, seq, node, parent, seq, pos, len(segment), start, stop, segment, None, None))
                path += node
                sizes.append(len(segment))
                seq, pos = seq + 1, pos + len(segment)
                if len(made) > 1000:
                    yield flush(False)
        if made:
            made[-1] = (*made[-1][:10], bytes(path), sizes)
            yield flush(True)

    ordered = rows.repartition("conv_id").sortWithinPartitions(*keys)
    return ordered.mapInArrow(noded, _TURNS.format(id=kind))


def _shared(a: bytes, b: bytes) -> int:
    """Number of nodes that two paths share from the root."""
    low, high = 0, min(len(a), len(b)) // _NODE
    while low < high:  # equal up to a node means equal in all before it
        middle = (low + high + 1) // 2
        if a[: middle * _NODE] == b[: middle * _NODE]:
            low = middle
        else:
            high = middle - 1
    return low


def _starts(path: bytes, sizes: list[int], prior: tuple[bytes, list[int]], at: int) -> tuple[int, list[int], int]:
    """(nodes shared with the path before, emitted place of each node, place
    after the last new one)."""
    shared = _shared(prior[0], path)
    starts = prior[1][:shared]
    for n in sizes[shared:]:
        starts.append(at)
        at += n
    return shared, starts, at


def layout(paths: DataFrame) -> DataFrame:
    """Distinct (path, sizes) -> one row a node: its tree (root node), emitted
    place in it and the intervals of its ancestors."""
    spark = paths.sparkSession
    parts = paths.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    parts = written(parts, "chat-paths")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for part, path, sizes in _runs(batches):
            if not out or out[-1]["part"] != part:
                out.append({"part": part, "first": path, "sizes": sizes, "last": b"", "starts": [], "total": 0})
            now = out[-1]
            _, now["starts"], now["total"] = _starts(path, sizes, (now["last"], now["starts"]), now["total"])
            now["last"] = path
        schema = pa.schema(
            [("part", pa.int32()), ("first", pa.binary()), ("sizes", pa.list_(pa.int64())), ("last", pa.binary()), ("starts", pa.list_(pa.int64())), ("total", pa.int64())]
        )
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    ordered = parts.select("part", "path", "sizes").repartition("part").sortWithinPartitions("part", "path")
    told = ordered.mapInArrow(totals, "part int, first binary, sizes array<long>, last binary, starts array<long>, total long")
    # One row a task: chain them, so that each part knows where it starts.
    states, prior, at = {}, (b"", []), 0
    for r in sorted(told.collect(), key=lambda r: r["part"]):
        shared = _shared(prior[0], bytes(r["first"]))
        again = sum(r["sizes"][:shared])  # what the part before has emitted already
        states[r["part"]] = (bytes(r["first"])[: shared * _NODE], prior[1][:shared], at)
        moved = [s + at - again for s in r["starts"]]
        kept = _shared(bytes(r["first"])[: shared * _NODE], bytes(r["last"]))
        prior = (bytes(r["last"]), prior[1][:kept] + moved[kept:])
        at += r["total"] - again
    known = spark.sparkContext.broadcast(states)  # one entry a task

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prior, at, made = None, (b"", []), 0, []
        spans: list[list[tuple[int, int]]] = []
        names = ["tree", "node", "start", "attends"]
        interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*made)) or [()] * 4
            kinds = (pa.binary(), pa.binary(), pa.int64(), interval)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for part, path, sizes in _runs(batches):
            if part != now:
                now, (first, begun, at) = part, known.value[part]
                prior, spans = (first, begun), []
            shared, starts, at = _starts(path, sizes, prior, at)
            del spans[shared:]
            for d in range(len(spans), len(starts)):  # merged intervals of the ancestors of the node at depth d
                before = list(spans[d - 1]) if d else []
                if d:
                    s, e = starts[d - 1], starts[d - 1] + sizes[d - 1]
                    before = [*before[:-1], (before[-1][0], e)] if before and before[-1][1] == s else [*before, (s, e)]
                spans.append(before)
            base = starts[0] if starts else 0
            for d in range(shared, len(starts)):
                attends = [{"start": s - base, "end": e - base} for s, e in spans[d]]
                made.append((path[:_NODE], path[d * _NODE : (d + 1) * _NODE], starts[d] - base, attends))
            prior = (path, starts)
            if len(made) > 1000:
                yield flush()
        yield flush()

    return ordered.mapInArrow(placed, "tree binary, node binary, start long, attends array<struct<start:long,end:long>>")


def format_tree(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(tree, members).  tree: one row a node: tree, node, parent, depth, start
    (place of its first token in the depth-first sequence of its tree), size,
    position (position id of its first token), loss_from, loss_to (offsets of
    the tokens under the loss), attends (intervals of its ancestors) and
    segment (its text).  members: conv_id, seq, node of each turn."""
    prepare(rows.sparkSession)
    each = written(turns(rows, conv_col, turn_col, role_col, text_col), "chat-turns")
    paths = each.where("path is not null").groupBy("path").agg(F.first("sizes").alias("sizes"))
    nodes = each.groupBy("node").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "size", "pos", "loss_from", "loss_to", "segment")])
    tree = layout(paths).join(nodes.withColumnRenamed("pos", "position"), "node")
    return written(tree, "chat-tree"), each.select("conv_id", "seq", "node")


def read_back(tree: DataFrame, members: DataFrame) -> DataFrame:
    """Each conversation read from the tree: turns, loss text and digests."""
    prepare(tree.sparkSession)
    parts = members.join(tree.select("node", "segment", "loss_from", "loss_to"), "node")
    parts = parts.select("conv_id", "seq", "segment", "loss_from", "loss_to")
    kind = members.schema["conv_id"].dataType.simpleString()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        schema, made, now = None, [], None

        def close() -> None:
            if now is not None:
                made.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*made)) or [()] * 6
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names=names)

        for batch in batches:
            schema = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, _, segment, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if start is not None:
                    loss = unescape(segment[start:stop])
                    now[3] += len(loss)
                    now[4].update(loss.encode("utf-8", "replace"))
                now[5] += len(segment)
            if len(made) > 1000:
                yield flush()
        if schema is not None:
            close()
            yield flush()

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(
        told, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
