"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Documents with equal shingle sets are one node; the rest works on nodes.
2. A signature has ``TREES * OWN`` MinHash values. Each tree orders nodes by its own rotation of
   the signature. Nodes whose longest common prefix in a tree reaches the region's depth are
   neighbours there. Depth adapts by region: where more than ``REGION`` nodes share a prefix, the
   prefix grows, in that region only, until they are fewer. Before such a crowd is divided, all
   its nodes are compared with its heads, the nodes most like all others: copies of one text that
   are less like each other than like the text would else part from it at greater depth.
3. In each region, pairs whose signatures agree about as often as the threshold asks are
   candidates. First each node proposes its few best partners, in a crowd its best heads, pairs are
   confirmed on full sets, and links make components. Then, where a region has candidates between
   different components, the sets of those nodes come to the region and all of them are compared
   there; only links that join components leave it. So do crowds, in pieces: the nodes outside a
   crowd's largest component, in blocks, meet every block of it. So every candidate is tested or
   needless, as a pair inside one component cannot change the result.
4. A document's component is the smallest id that its node's component holds.

Hot groups: copies collapse before anything is compared, buckets are counted before a shuffle,
a region is at most ``REGION`` rows and a piece of a crowd about twice as many. A crowd's pieces are
as many as its size times its nodes outside its largest component ask: few where it is copies of
one text, a square where its nodes are alike but no links join them. Signatures, buckets, pairs and labels stay in tables;
nothing of them comes to the driver.

Defined cases: null texts and texts without words have no shingles and link with nothing; a text
shorter than a shingle is one shingle; equal rows belong together; rows with a null id can be
linked, but a component has an id only if one of its documents has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldmart.llm import scratch
from coldmart.llm.components import components
from coldmart.llm.hashing import batches_of, mix, numbers, shingles, word_hashes

TREES, OWN = 16, 8
VALUES = TREES * OWN
DEPTHS = (4, 8, 20, VALUES)
REGION = 512
HEADS = 64  # of each crowd, compared with all of it
BEST = 2  # partners that each node proposes in a region or crowd at first
MARGIN = 0.17  # over five standard deviations of the share of VALUES that agree; full sets decide

_SPREAD = np.uint32(0x9E3779B1)  # a byte of this product depends on the whole value

_A = (numbers(VALUES, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (numbers(VALUES, 4) >> np.uint64(32)).astype(np.uint32)


def signature(members: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes, which must not be empty."""
    short = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        least = np.minimum(least, (short[at : at + 4096, None] * _A + _B).min(axis=0))
    return least


def _node(members: np.ndarray) -> bytes:
    """128 bits of a set, whatever the order of its members."""
    both = [members.sum(dtype=np.uint64), mix(members ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)]
    return mix(np.array(both, np.uint64) + np.uint64(len(members))).tobytes()


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    words, begins = word_hashes(texts)
    for a, b in zip(begins[:-1], begins[1:]):
        yield shingles(words[a:b], width)


def _profile(batches, width: int):
    """(id, version, text) to (id, version, n, node, bands, signature)."""
    for whole in batches:
        for batch in batches_of(whole, 2):
            sizes, nodes, bands, signs = [], [], [], []
            for members in _sets(batch.column(2), width):
                sizes.append(len(members))
                if not len(members):
                    nodes.append(None), bands.append(None), signs.append(None)
                    continue
                sign = signature(members)
                first = sign.reshape(TREES, OWN)[:, : DEPTHS[0]].astype(np.uint64)
                salt = numbers(DEPTHS[0], 5)
                nodes.append(_node(members))
                bands.append(mix((first * salt).sum(axis=1, dtype=np.uint64)).view(np.int64))
                signs.append((sign * _SPREAD >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                    pa.array(signs, pa.binary()),
                ],
                ["id", "version", "n", "node", "bands", "signature"],
            )


def _regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions and crowds, both as ``region, node, signature, level``.

    Regions hold at most ``REGION`` nodes. A crowd is what a region was before it was divided; those
    of level 0 hold all that the deeper regions and crowds hold.
    """
    rows = nodes.select("node", "signature", F.posexplode("bands").alias("tree", "band"))
    small, large = [], []
    for level, depth in enumerate(DEPTHS):
        turned = F.expr(f"substring(concat(signature, signature), tree * {OWN} + 1, {depth})")
        keyed = rows.withColumn("region", F.xxhash64("tree", "band", turned, F.lit(depth)))
        if level == 0:  # most nodes share no prefix: find the others before signatures move
            keyed = keyed.drop("signature")
        # A table, so that the join below is a plain one whose large partitions Spark splits.
        sizes = scratch.table(
            keyed.groupBy("region").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "sizes"
        )
        met = keyed.join(sizes, "region")
        if level == 0:
            met = met.join(nodes.select("node", "signature"), "node")
        met = scratch.table(met, f"regions-{depth}")
        met = met.withColumn("level", F.lit(level))
        small.append(met.filter(F.col("rows") <= REGION).select("region", "node", "signature", "level"))
        crowd = met.filter(F.col("rows") > REGION)
        if crowd.isEmpty():
            break
        large.append(crowd.select("region", "node", "signature", "level"))
        rows = crowd.drop("region", "rows", "level")
    none = small[0].limit(0)
    return reduce(DataFrame.union, small), reduce(DataFrame.union, large, none)


def _heads(crowds: DataFrame) -> DataFrame:
    """``region, head, head_signature``: in each crowd the ``HEADS`` nodes most like all others.

    Copies of one text agree with that text more than with each other, so its signature is made
    of the values that most of the crowd have; a bounded sample of each crowd shows which.
    """
    by_hash = Window.partitionBy("region").orderBy(F.xxhash64("node"), "node")
    sample = (
        crowds.withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= REGION).drop("k")
    )

    def usual(crowd: pd.DataFrame) -> pd.DataFrame:
        signs = np.frombuffer(b"".join(crowd["signature"]), np.uint8).reshape(len(crowd), VALUES)
        most = bytes(int(np.bincount(signs[:, k]).argmax()) for k in range(VALUES))
        return pd.DataFrame({"region": crowd["region"].iloc[:1], "usual": [most]})

    shapes = scratch.table(
        sample.groupBy("region").applyInPandas(usual, "region bigint, usual binary"), "usual"
    )

    def compare(batches):
        for batch in batches:
            agree = [
                int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum())
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(agree, pa.int64())], ["region", "node", "signature", "agree"]
            )

    compared = (
        crowds.join(shapes, "region")
        .select("region", "node", "signature", "usual")
        .mapInArrow(compare, "region bigint, node binary, signature binary, agree bigint")
    )
    nearest = Window.partitionBy("region").orderBy(F.col("agree").desc(), "node")
    return scratch.table(
        compared.withColumn("k", F.row_number().over(nearest))
        .filter(F.col("k") <= HEADS)
        .select("region", F.col("node").alias("head"), F.col("signature").alias("head_signature")),
        "heads",
    )


def _spokes(batches, cut: float, most: int):
    """Rows (node, signature, heads of the crowd) to pairs: each node with its ``most`` nearest heads."""
    for batch in batches:
        a, b = [], []
        held, last = None, None
        for node, sign, heads in zip(*(c.to_pylist() for c in batch.columns)):
            if heads != last:
                last = heads
                held = np.frombuffer(b"".join(h["signature"] for h in heads), np.uint8).reshape(-1, VALUES)
            agree = (held == np.frombuffer(sign, np.uint8)).sum(axis=1)
            best = [k for k in np.argsort(-agree, kind="stable").tolist() if heads[k]["node"] != node]
            for k in best[:most]:
                if _fit(agree[k]) >= cut:
                    a.append(min(node, heads[k]["node"]))
                    b.append(max(node, heads[k]["node"]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _fit(agree):
    """Similarity as a signature shows it; a byte of a value agrees by chance once in 256 times."""
    return (agree / VALUES - 1 / 256) / (1 - 1 / 256)


def _by_region(batches):
    """Rows of each region together, where regions come in one piece each."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _distinct_nodes(rows: list[tuple]) -> list[tuple]:
    return sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])


def _agreements(rows: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row (region, node, signature, ...): how many values each other one shares with it."""
    signs = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), VALUES)
    for i, sign in enumerate(signs):
        agree = (signs == sign).sum(axis=1)
        agree[i] = -1
        yield i, agree


def _propose(batches, cut: float, most: int):
    """Rows (region, node, signature) to pairs of nodes: each with its ``most`` best partners."""
    for rows in _by_region(batches):
        rows = _distinct_nodes(rows)
        pairs = set()
        for i, agree in _agreements(rows):
            for j in np.argsort(-agree, kind="stable")[:most].tolist():
                if _fit(agree[j]) >= cut:
                    pairs.add((min(i, j), max(i, j)))
        columns = [pa.array([rows[p[k]][1] for p in pairs], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _divided(batches, cut: float):
    """Rows (region, node, signature, root) to (region, node, root) of nodes with a candidate elsewhere."""
    for rows in _by_region(batches):
        rows = _distinct_nodes(rows)
        roots = np.array([r[3] or r[1] for r in rows], dtype="S16")
        keep = []
        if not (roots == roots[0]).all():
            for i, agree in _agreements(rows):
                if (_fit(agree)[roots != roots[i]] >= cut).any():
                    keep.append(i)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in keep], pa.int64()),
                pa.array([rows[i][1] for i in keep], pa.binary()),
                pa.array([rows[i][3] or rows[i][1] for i in keep], pa.binary()),
            ],
            ["region", "node", "root"],
        )


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of some sets share."""
    members, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times > 1  # what one set alone holds is common to no two
    column = np.cumsum(shared) - 1
    met = shared[which]
    owner, column = owner[met], column[which[met]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)))
    for low in range(0, int(shared.sum()), 8192):
        a, b = np.searchsorted(column, [low, low + 8192])
        part = np.zeros((len(sets), 8192), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return total


def _join_up(batches, percent: int):
    """Rows (region, node, root, set) to links that join components, confirmed on the full sets."""
    for rows in _by_region(batches):
        rows = _distinct_nodes(rows)
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        both = _common(sets)
        sizes = np.array([len(s) for s in sets], np.float64)
        alike = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        parent = {r[2]: r[2] for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        a, b = [], []
        for i, j in zip(*np.nonzero(np.triu(alike, 1))):
            one, other = find(rows[i][2]), find(rows[j][2])
            if one != other:
                parent[one] = other
                a.append(rows[i][1])
                b.append(rows[j][1])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _confirm(batches, percent: int):
    """Rows (a, b, set of a, set of b) to the pairs whose sets are alike enough."""
    for batch in batches:
        keep = []
        for one, other in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, other))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _members(batches, width: int):
    """(node, text) to (node, set), where the text is one of that node."""
    for whole in batches:
        for batch in batches_of(whole, 1):
            keep, sets = [], []
            for node, members in zip(batch.column(0).to_pylist(), _sets(batch.column(1), width)):
                keep.append(bool(len(members)) and _node(members) == node)
                sets.append(members.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary())], ["node", "members"]
            ).filter(pa.array(keep, pa.bool_()))


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("region").sortWithinPartitions("region")


def _nearest(regions: DataFrame, crowds: DataFrame, heads: DataFrame | None, cut: float) -> DataFrame:
    """The first candidates: every node's best partners in its regions, and best heads in its crowds."""
    pairs = _together(regions.select("region", "node", "signature")).mapInArrow(
        lambda batches: _propose(batches, cut, BEST), "a binary, b binary"
    )
    if heads is not None:
        led = heads.groupBy("region").agg(
            F.collect_list(F.struct(F.col("head").alias("node"), F.col("head_signature").alias("signature")))
            .alias("heads")
        )
        pairs = pairs.union(
            crowds.join(scratch.table(led, "led"), "region")
            .select("node", "signature", "heads")
            .mapInArrow(lambda batches: _spokes(batches, cut, BEST), "a binary, b binary")
        )
    return pairs.distinct()


def _blocks(crowds: DataFrame) -> DataFrame:
    """Crowds (region, node, signature, root) in pieces, so that any two nodes of a crowd with
    different roots meet in one of them.

    Of two such nodes one at least is not in the crowd's largest component. So the nodes outside it
    meet all nodes, each side in blocks of about ``REGION``; a crowd that is one component has no pieces.
    """
    parts = crowds.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    shapes = scratch.table(
        parts.groupBy("region")
        .agg(F.sum("n").alias("whole"), F.max(F.struct("n", "root")).alias("most"))
        .filter("whole > most.n")
        .select(
            "region",
            F.col("most.root").alias("largest"),
            F.ceil(F.col("whole") / REGION).alias("across"),
            F.ceil((F.col("whole") - F.col("most.n")) / REGION).alias("down"),
        ),
        "shapes",
    )
    own = F.xxhash64("node", F.lit(1))
    row, column = F.pmod(own, F.col("down")), F.pmod(own, F.col("across"))
    met = crowds.join(shapes, "region")
    every = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: F.struct(i.alias("i"), column.alias("j")))
    other = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: F.struct(row.alias("i"), j.alias("j")))
    places = F.when(F.col("root") == F.col("largest"), every).otherwise(F.array_union(every, other))
    return met.withColumn("place", F.explode(places)).select(
        F.xxhash64("region", "place.i", "place.j").alias("region"), "node", "signature", "root"
    )


def _remaining(
    regions: DataFrame, crowds: DataFrame, labels: DataFrame | None, sets: DataFrame, cut: float, percent: int
) -> DataFrame:
    """Links that the first candidates left out: all candidates between different components."""

    def rooted(rows: DataFrame) -> DataFrame:
        rows = rows.filter("level = 0").select("region", "node", "signature")
        if labels is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))

    pieces = rooted(regions).select("region", "node", "signature", "root")
    if not crowds.isEmpty():
        pieces = pieces.union(_blocks(scratch.table(rooted(crowds), "crowds")))
    divided = _together(pieces).mapInArrow(
        lambda batches: _divided(batches, cut), "region bigint, node binary, root binary"
    )
    filled = scratch.table(divided, "divided").join(sets, "node").select("region", "node", "root", "members")
    return _together(filled).mapInArrow(lambda batches: _join_up(batches, percent), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 85, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, version, n_shingles, component_id, empty, first`` for every row.

    ``version`` hashes the text; ``first`` marks the row (equal rows alike) that stands for its
    component.
    """
    texts = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text")
    )
    rows = scratch.table(
        texts.mapInArrow(
            lambda batches: _profile(batches, width),
            "id {}, version bigint, n bigint, node binary, bands array<bigint>, signature binary".format(
                texts.schema["id"].dataType.simpleString()
            ),
        ),
        "signatures",
    )
    nodes = scratch.table(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min(F.struct("version", "id")).alias("sample"),
            F.first("bands").alias("bands"),
            F.first("signature").alias("signature"),
        ),
        "nodes",
    )
    regions, crowds = _regions(nodes)
    crowded = not crowds.isEmpty()
    heads = _heads(crowds) if crowded else None
    involved = (
        regions.select("node").union(crowds.select("node")).distinct().join(nodes.select("node", "sample"), "node")
    ).select("node", F.col("sample.id").alias("sample_id"), F.col("sample.version").alias("sample_version"))
    sets = scratch.table(
        texts.join(
            involved,
            F.col("id").eqNullSafe(F.col("sample_id")) & (F.col("version") == F.col("sample_version")),
        )
        .select("node", "text")
        .mapInArrow(lambda batches: _members(batches, width), "node binary, members binary")
        .dropDuplicates(["node"]),
        "sets",
    )
    cut = percent / 100 - MARGIN
    pairs = _nearest(regions, crowds, heads, cut)
    found = scratch.table(
        pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("one")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("members").alias("other")), "b")
        .select("a", "b", "one", "other")
        .mapInArrow(lambda batches: _confirm(batches, percent), "a binary, b binary"),
        "links",
    )
    labels = None if found.isEmpty() else components(found)
    more = scratch.table(_remaining(regions, crowds, labels, sets, cut, percent), "links")
    if not more.isEmpty():
        if labels is not None:  # what is known already: a link from each node to its root
            more = more.union(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        labels = components(more)
    placed = rows.select("id", "version", F.col("n").alias("n_shingles"), "node")
    placed = (
        placed.withColumn("root", F.col("node"))
        if labels is None
        else placed.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    first = F.struct(F.col("id").isNull().alias("nameless"), "id", "version")
    heads = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min(first).alias("head"))
    alone = F.col("node").isNull()
    return placed.join(scratch.table(heads, "heads"), "root", "left").select(
        "id",
        "version",
        "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("component_id"),
        alone.alias("empty"),
        (alone | (first == F.col("head"))).alias("first"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without the near copies: of each component the document with the least id."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    kept = (
        near_duplicates(docs, **options)
        .filter("first")
        .select(F.col("id").alias("kept_id"), F.col("version").alias("kept_version"), "empty")
        .dropDuplicates(["kept_id", "kept_version"])
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(doc_id).alias("id"),
        F.xxhash64(F.col(text)).alias("version"),
    )
    met = whole.join(
        kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("version") == F.col("kept_version"))
    )
    # Equal rows belong together; rows without words do not.
    once = met.filter("NOT empty").dropDuplicates(["id", "version"])
    return once.select("row.*").union(met.filter("empty").select("row.*"))
