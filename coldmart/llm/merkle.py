"""A Merkle manifest of a table: a digest of every row, roots, and a proof for every row.

Rows are the leaves of one tree for each value of a column; every eight consecutive nodes become
one, until one remains, the subroot. The subroots, in order of the value, become the root alike.

Both directions are time-forward processing. A node's label is its level and its place. Upwards
a priority queue ordered by label delivers the digests of children to their parent: what leads
the queue belongs to the next node, whose digest enters the queue again under the label of its
own parent. Downwards, in a reversed sweep, a node's message is the end of the proof that all
leaves below it share; each child gets it with its siblings' digests put before.

The queue is external. Between blocks of 4096 nodes (four levels) its messages are a table that
Spark's shuffle sorts by label, so they spill to disk and survive lost executors; inside a task
the queue holds the messages of one block. A tree of n leaves takes log(n, 4096) such rounds.

Defined cases: leaves of one tree ascend by id, nulls first, equal ids by their digests; repeated
rows are leaves of their own. A null tree value is a tree of its own and comes first. A tree of
one leaf has it as its subroot. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from coldmart.llm import scratch

FAN = 8
LEVELS = 4  # of a block
BLOCK = FAN**LEVELS


def digest(columns: Iterable[Column]) -> Column:
    """The leaf of some values: each its UTF-8 byte count, ``:`` and itself, or ``-`` if null."""
    texts = [c.cast("string") for c in columns]
    fields = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*[F.coalesce(f, F.lit("-")) for f in fields]), 256)


def join_digests(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n = -(-n // FAN)
        levels += 1
    return levels


def sweep_up(digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """Digests of all nodes over some consecutive ones that begin a run, by label.

    Messages are (label of the receiver, place of the sender, digest).
    """
    nodes = {(0, k): d for k, d in enumerate(digests)}
    if not levels:
        return nodes
    queue = [((1, k // FAN), k, d) for k, d in enumerate(digests)]  # sorted, so a heap
    while queue:
        label, received = queue[0][0], []
        while queue and queue[0][0] == label:
            received.append(heapq.heappop(queue)[2])
        nodes[label] = join_digests(received)
        level, place = label
        if level < levels:
            heapq.heappush(queue, ((level + 1, place // FAN), place, nodes[label]))
    return nodes


def sweep_down(nodes: dict[tuple[int, int], str], levels: int, end: str) -> Iterator[tuple[int, str]]:
    """Proofs of the lowest nodes, the last first: the siblings on the way up, then ``end``."""
    queue = [(-levels, 0, end)]
    while queue:
        level, place, end = heapq.heappop(queue)
        level, place = -level, -place
        if not level:
            yield place, end
            continue
        run = []
        while (level - 1, FAN * place + len(run)) in nodes and len(run) < FAN:
            run.append(nodes[level - 1, FAN * place + len(run)])
        for k in range(len(run)):
            proof = "".join(run[:k] + run[k + 1 :]) + end
            heapq.heappush(queue, (1 - level, -(FAN * place + k), proof))


def fold(leaf: str, proof: str, places: Iterable[tuple[int, int]]) -> str:
    """The root that a leaf and a proof give; ``places``: a place and the number of nodes, by tree."""
    at = 0
    for place, n in places:
        while n > 1:
            first = place - place % FAN
            others = min(FAN, n - first) - 1
            siblings = proof[at : at + 64 * others]
            cut = 64 * (place - first)
            leaf = hashlib.sha256((siblings[:cut] + leaf + siblings[cut:]).encode()).hexdigest()
            at += 64 * others
            place, n = place // FAN, -(-n // FAN)
    return leaf


def _dealt(df: DataFrame, tree: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in order, by parts, and for each part and tree the shift from rows to places.

    A range sort numbers the rows of each part; the places before a part come from a count for
    each part and tree. A random number keeps repeated rows apart, so that no part has to hold
    them all.
    """
    keys = [F.asc_nulls_first(c) for c in (tree, *order)]
    numbered = df.withColumn("_apart", F.rand(11))
    dealt = numbered.repartitionByRange(*keys, "_apart").sortWithinPartitions(*keys, "_apart")
    dealt = scratch.table(dealt.drop("_apart").withColumn("_row", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("_part", F.shiftright("_row", 33))
    counts = dealt.groupBy("_part", tree).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    by_tree = Window.partitionBy(tree)
    before = F.sum("_n").over(by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        F.col("_part").alias("_of_part"),
        F.col(tree).alias("_of_tree"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(by_tree).alias("n"),
    )
    return dealt, counts


def _placed(dealt: DataFrame, tree: str, counts: DataFrame) -> DataFrame:
    """Rows with their place ``pos`` in their tree; the join's keys are no larger than a part."""
    same = (F.col("_part") == F.col("_of_part")) & F.col(tree).eqNullSafe(F.col("_of_tree"))
    placed = dealt.join(counts, same).withColumn("pos", F.col("_row") + F.col("_shift"))
    return placed.drop("_row", "_part", "_of_part", "_of_tree", "_shift")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of one block after another, from a partition sorted by tree and block."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        labels = list(zip(table["tree"].to_pylist(), table["block"].to_pylist()))
        at = 0
        for k in range(1, len(labels)):
            if labels[k] != labels[k - 1]:
                yield table.slice(at, k - at).to_pydict()
                at = k
        held = table.slice(at)
    if held is not None and held.num_rows:
        yield held.to_pydict()


_NODES = "tree long, pos long, n long, digest string"
_MESSAGES = "tree long, pos long, proof string, trees long, subroot string, root string"


def _up(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Nodes of every fourth level, from the given ones to one for each tree."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for block in _blocks(batches):
            n = block["n"][0]
            levels = min(LEVELS, height(n))
            top = sweep_up(block["digest"], levels)[levels, 0]
            rows.append((block["tree"][0], block["block"][0], -(-n // BLOCK), top))
        yield _batch(rows, schema)

    schema = _arrow(nodes, _NODES)
    rounds = [nodes]
    while True:
        labelled = rounds[-1].withColumn("block", F.expr(f"pos div {BLOCK}"))
        labelled = labelled.select("tree", "block", "pos", "n", "digest")
        swept = _by_label(labelled, "pos").mapInArrow(sweep, _NODES)
        rounds.append(scratch.table(swept, f"{name}-nodes"))
        most = -(-most // BLOCK)
        if most <= 1:
            return rounds


def _by_label(df: DataFrame, *within: str) -> DataFrame:
    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", *within)


def _deliver(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes and the messages for their blocks in one order, a block's message first."""
    sent = messages.withColumn("block", F.col("pos")).drop("pos")
    placed = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    return _by_label(sent.unionByName(placed, allowMissingColumns=True), F.asc_nulls_first("pos"))


def _received(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, dict, Iterator[tuple[int, str]]]]:
    """For each block its message, its rows, and the place and proof of each, the last first."""
    for block in _blocks(batches):
        message = {name: values[0] for name, values in block.items()}
        rows = {name: values[1:] for name, values in block.items()}
        levels = min(LEVELS, height(rows["n"][0]))
        nodes = sweep_up(rows["digest"], levels)
        yield message, rows, sweep_down(nodes, levels, message["proof"])


def _down(rounds: list[DataFrame], messages: DataFrame) -> DataFrame:
    """Messages for all nodes below those that ``messages`` are for."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for message, rows, proofs in _received(batches):
            shared = (message["trees"], message["subroot"], message["root"])
            yield _batch([(rows["tree"][k], rows["pos"][k], p, *shared) for k, p in proofs], schema)

    schema = _arrow(messages, _MESSAGES)
    for nodes in reversed(rounds):
        messages = _deliver(nodes, messages).mapInArrow(sweep, _MESSAGES)
    return messages


def _arrow(df: DataFrame, columns: str) -> pa.Schema:
    return to_arrow_schema(df.sparkSession.createDataFrame([], columns).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(values, field.type) for values, field in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def prove(leaves: DataFrame, proofs: bool = False) -> DataFrame:
    """Roots and proofs of ``leaves``: columns ``id``, ``tree``, ``leaf`` and ``claimed``.

    Returns ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the siblings' digests
    from the leaf up), ``folded_root`` (the root that ``claimed`` gives in the leaf's stead, with
    the leaf's proof), ``verified`` (that is the root) and, if asked for, the ``proof`` itself.
    """
    of_id = leaves.schema["id"].dataType.simpleString()
    result = f"id {of_id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    result += ", verified boolean" + (", proof string" if proofs else "")
    schema = _arrow(leaves, result)

    dealt, counts = _dealt(leaves.withColumnRenamed("tree", "_tree"), "_tree", ["id", "leaf"], "merkle-leaves")
    counts = scratch.table(counts, "merkle-counts")
    trees = counts.groupBy(F.col("_of_tree").alias("_tree")).agg(F.max("n").alias("_leaves"))
    ordered, of_all = _dealt(trees.withColumn("_all", F.lit(0)), "_all", ["_tree"], "merkle-trees")
    trees = _placed(ordered, "_all", of_all)
    trees = scratch.table(trees.withColumnsRenamed({"pos": "tree", "n": "trees"}), "merkle-order")
    n_trees, most = trees.agg(F.max("trees"), F.max("_leaves")).first()
    counts = counts.join(trees.select("_tree", "tree"), F.col("_of_tree").eqNullSafe(F.col("_tree")))
    placed = _placed(dealt, "_tree", counts.drop("_tree")).drop("_tree")
    placed = scratch.table(placed.withColumnRenamed("leaf", "digest"), "merkle-placed")

    rounds = _up(placed.select("tree", "pos", "n", "digest"), most or 0, "merkle")
    subroots = rounds.pop()
    whole = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
        F.lit(n_trees or 0).cast("long").alias("n"), "digest",
    )
    tops = _up(whole, n_trees or 0, "merkle-top")
    root = tops.pop()

    first = root.select(
        "tree", "pos", F.lit("").alias("proof"), F.lit(n_trees or 0).cast("long").alias("trees"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )
    for_trees = _down(tops, first).drop("tree", "subroot").withColumnRenamed("pos", "tree")
    for_trees = for_trees.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    messages = scratch.table(for_trees.withColumn("pos", F.lit(0).cast("long")), "merkle-ends")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for message, rows, ends in _received(batches):
            found = []
            for k, proof in ends:
                places = ((rows["pos"][k], rows["n"][k]), (rows["tree"][k], message["trees"]))
                folded = fold(rows["claimed"][k], proof, places)
                row = (
                    rows["id"][k], rows["digest"][k], message["subroot"], message["root"],
                    hashlib.sha256(proof.encode()).hexdigest(), folded, folded == message["root"],
                )
                found.append((*row, proof) if proofs else row)
            yield _batch(found, schema)

    messages = _down(rounds[1:], messages)
    return _deliver(placed, messages).mapInArrow(settle, result)
