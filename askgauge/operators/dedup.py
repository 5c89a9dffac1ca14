"""Near-duplicate headers, greedy clusters of tables and database ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgauge.functions.fixed_values import DB_ID_PREFIX
from askgauge.functions.similarity import letter_counts, letter_marks, letter_numbers, long_subsequences, pair_tables, place_masks, sorted_tokens, subsequences_of_one, text_codes
from askgauge.operators.cells import canonical_header
from askgauge.operators.components import connected_labels
from askgauge.session import cut_lineage, small_side

# 64-bit words in the bit set that marks the letters of a text; three, as counts of unlike bits are kept in a byte.
MARK_WORDS = 3
# Texts of a block at least and at most, letters of a block with its texts filled up to the longest.
BLOCK_LEAST, BLOCK_MOST, BLOCK_LETTERS = 4096, 16_384, 1 << 20
# Blocks into which texts are dealt, as long as blocks are neither too small nor too large.
BLOCKS = 24
# Tasks that compare blocks, at most.
BLOCK_TASKS = 4096
# Texts of two blocks that are compared at a time, and bytes of bit masks for them.
TILE, STRIP, MASK_BYTES = 8192, 8, 32 << 20
# Pairs whose subsequences are counted at a time, and that leave a task at a time.
PAIRS_COUNTED, PAIRS_SENT = 16_384, 100_000
# Edges of a component that one task walks.
WALK_EDGES = 200_000
# Headers that are all compared with each other, the first and each later stretch of a longer walk.
LEAD_WHOLE, LEAD_FIRST, LEAD_STRETCH = 131_072, 16_384, 65_536


def header_groups(headers: DataFrame) -> DataFrame:
    """Tables with equal canonical headers share one node: ``table_id, node, text``.

    ``node`` is the smallest table id of the group, which is also the one a
    walk in table order would meet first.
    """
    keyed = headers.select(
        "table_id", sorted_tokens(canonical_header(F.col("header"), "|")).alias("text")
    )
    first = keyed.groupBy("text").agg(F.min("table_id").alias("node"))
    return keyed.join(first, "text").select("table_id", "node", "text")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by length: blocks of texts as one row each, with their lengths' ends."""
    part, number = TaskContext.get().partitionId(), 0
    nodes: list = []
    texts: list[str] = []
    kind = None

    def block() -> pa.RecordBatch:
        sizes = [len(t) for t in texts]
        arrays = [
            pa.array([(part << 32) + number], pa.int64()), pa.array([min(sizes)], pa.int32()), pa.array([max(sizes)], pa.int32()),
            pa.array([nodes], pa.list_(kind)), pa.array([texts], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "low", "high", "nodes", "texts"])

    for batch in batches:
        kind = batch.schema.field("node").type
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
            if texts and (len(texts) >= BLOCK_MOST or (len(texts) + 1) * len(text) > BLOCK_LETTERS):
                yield block()
                nodes, texts, number = [], [], number + 1
            nodes.append(node)
            texts.append(text)
    if texts:
        yield block()


def _letters_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a block have the nth occurrence of a letter."""
    for batch in batches:
        for texts in batch.column("texts"):
            keys, counts = letter_counts(text_codes(texts.as_py())[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["key", "n"])


def _marked(keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [letter_marks(text_codes(texts.as_py())[0], keys, MARK_WORDS).tobytes() for texts in batch.column("texts")]
            yield batch.append_column("marks", pa.array(marks, pa.binary()))

    return run


def _blocks_of(nodes: DataFrame, keys: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """``block, low, high, nodes, texts, marks``: texts (``node, text``) in order of their lengths, as blocks.

    The marks of a text are those letters, counted by their repeats, that split the texts best: at most as many as a bit set
    holds, whatever the alphabet. They are returned too; texts that meet other blocks take the ``keys`` of these.
    """
    nodes = cut_lineage(nodes.select("node", "text", F.length("text").alias("len")).filter("text is not null"))
    kind = nodes.schema["node"].dataType.simpleString()
    rows = nodes.count()
    parts = max(1, -(-rows // min(BLOCK_MOST, max(BLOCK_LEAST, -(-rows // BLOCKS)))))
    # Every block is copied once for each block it meets, so there are no more of them where a session raises the ranges.
    ordered = nodes.repartitionByRange(parts, "len", "node").coalesce(parts).sortWithinPartitions("len", "node").select("node", "text")
    schema = f"block long, low int, high int, nodes array<{kind}>, texts array<string>"
    blocks = cut_lineage(ordered.mapInArrow(_blocks, schema))
    if keys is None:
        found = blocks.select("texts").mapInArrow(_letters_of_blocks, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        best = found.orderBy(F.least("n", F.lit(rows) - F.col("n")).desc(), "key").limit(64 * MARK_WORDS).collect()
        keys = np.array(sorted(r["key"] for r in best), dtype=np.int64)
    return cut_lineage(blocks.mapInArrow(_marked(keys), f"{schema}, marks binary")), keys


def _needed(size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """The common subsequence that a ratio at the threshold takes: t% of the mean length."""
    return np.ceil((size_a + size_b) * threshold / 200.0 - 1e-9).astype(np.int64)


def _unlike_marks_below(size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """What the letter marks that only one of two texts has stay below, 0 where their lengths alone rule the pair out."""
    need = _needed(size_a, size_b, threshold)
    return np.where(need > np.minimum(size_a, size_b), 0, np.clip(size_a + size_b - 2 * need + 1, 1, 255)).astype(np.uint8)


def _tile_pairs(one: dict, many: dict, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``one`` and in ``many`` and ratio of the pairs at or above the threshold."""
    letters, masks = place_masks(many["codes"])
    numbers = letter_numbers(one["codes"], letters)
    tables = pair_tables(masks, numbers)
    columns, width = np.ascontiguousarray(many["marks"].T), len(many["size"])
    bits, counts, unlike = (np.empty((STRIP, width), dtype=kind) for kind in (np.uint64, np.uint8, np.uint8))
    lengths = many["size"].astype(np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def alike(row: np.ndarray, column: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ratio = 200.0 * common / (one["size"][row] + many["size"][column])
        keep = ratio >= threshold
        return one["place"][row[keep]], many["place"][column[keep]], ratio[keep]

    def counted() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows, others = (np.concatenate(c) for c in zip(*waiting))
        for lo in range(0, len(rows), PAIRS_COUNTED):
            row, column = rows[lo : lo + PAIRS_COUNTED], others[lo : lo + PAIRS_COUNTED]
            size, other = one["size"][row], lengths[column]
            need = _needed(size, other, threshold)
            left, common = long_subsequences(tables, row, column, size, size - need, other - need)
            yield alike(row[left], column[left], common)

    below: dict[int, np.ndarray] = {}
    for at in range(0, len(numbers), STRIP):
        sizes = one["size"][at : at + STRIP].tolist()
        rows = len(sizes)
        for size in set(sizes) - below.keys():
            # Texts come in order of their lengths.
            below = {size: _unlike_marks_below(np.int64(size), lengths, threshold)} | {k: v for k, v in below.items() if k in sizes}
        for w in range(MARK_WORDS):
            np.bitwise_xor(one["marks"][at : at + rows, w][:, None], columns[w], out=bits[:rows])
            np.bitwise_count(bits[:rows], out=counts[:rows] if w else unlike[:rows])
            if w:
                np.add(unlike[:rows], counts[:rows], out=unlike[:rows])
        fits = unlike[:rows] < (below[sizes[0]] if sizes[0] == sizes[-1] else np.stack([below[size] for size in sizes]))
        if same:
            fits &= one["place"][at : at + rows][:, None] < many["place"]
        row, column = np.divmod(np.flatnonzero(fits), width)
        if 3 * len(row) > fits.size:
            # Many pairs are left: each text against the whole tile, without gathering.
            ends = np.searchsorted(row, np.arange(len(fits) + 1))
            for i in np.flatnonzero(np.diff(ends)).tolist():
                lcs = subsequences_of_one(masks, numbers[at + i, : one["size"][at + i]].tolist())
                some = column[ends[i] : ends[i + 1]]
                yield alike(np.full(len(some), at + i), some, lcs[some])
        elif len(row):
            waiting.append((at + row, column))
            held += len(row)
            if held >= PAIRS_COUNTED:
                yield from counted()
                waiting, held = [], 0
    if waiting:
        yield from counted()


def _block_pairs(threshold: float):
    """Over blocks that come two by two (one alone meets itself): all pairs of texts at or above the threshold."""

    def side(row: dict) -> dict:
        codes, sizes = text_codes(row["texts"].as_py())
        marks = np.frombuffer(row["marks"].as_py(), dtype=np.uint64).reshape(-1, MARK_WORDS)
        return {"codes": codes, "size": sizes, "marks": marks, "place": np.arange(len(sizes))}

    def tiles(block: dict) -> Iterator[dict]:
        # Masks take a row per letter and 64 places for each text.
        letters = len(np.unique(block["codes"])) * -(-block["codes"].shape[1] // 64)
        step = max(16, min(TILE, MASK_BYTES // (8 * letters)))
        for at in range(0, len(block["size"]), step):
            yield {name: values[at : at + step] for name, values in block.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                if row["side"].as_py() == 0:
                    first = row
                    if row["i"].as_py() != row["j"].as_py():
                        continue
                x, y = side(first), side(row)
                found: list = []
                held = 0
                left, right = first["nodes"].values, row["nodes"].values

                def send() -> pa.RecordBatch:
                    a, b, ratio = (np.concatenate(c) for c in zip(*found))
                    ends = [left.take(pa.array(a)), right.take(pa.array(b))]
                    # A node that comes twice is no pair with its own copy.
                    twice = pc.and_(pc.equal(*ends), pa.array(x["size"][a] == y["size"][b]))
                    return pa.RecordBatch.from_arrays([*ends, pa.array(ratio)], names=["x", "y", "ratio"]).filter(pc.invert(twice))

                for tile in tiles(y):
                    for pairs in _tile_pairs(x, tile, first is row, threshold):
                        if len(pairs[0]):
                            found.append(pairs)
                            held += len(pairs[0])
                        if held > PAIRS_SENT:
                            yield send()
                            found, held = [], 0
                if found:
                    yield send()

    return run


def similar_pairs(nodes: DataFrame, threshold: float = 80.0) -> DataFrame:
    """All pairs ``a < b`` of distinct texts (``node, text``) with token-sort ratio >= threshold.

    Texts are ordered by length and cut into blocks; each pair of blocks whose lengths allow the ratio meets
    in a task, which holds two blocks at a time.  There two bounds are taken for whole tiles of pairs: the
    lengths, and the letters that only one text has (as bit sets).  For pairs that pass, the
    common subsequence is counted exactly, 64 letters of a text in one word, many pairs at a time; pairs
    whose first letters are too unlike are given up on the way.  Shared
    grams are no join keys here: texts of one language share so many that most pairs would meet in several.
    The number of pairs grows with the square of the texts; memory does not.
    """
    if not 200.0 / 3 < threshold <= 100.0:
        raise ValueError("unsupported: the gram filter needs a threshold above 66.7")
    blocks, _ = _blocks_of(nodes)
    found = _met(blocks, _meeting(blocks, blocks, threshold).filter("i <= j"), threshold)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ratio")


def _meeting(some: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """``i, j``: blocks whose lengths allow the ratio."""
    shorter, longer = F.least("x.high", "y.high"), F.greatest("x.low", "y.low")
    meet = 200.0 * shorter >= threshold * (shorter + longer) - 1e-6
    ends = [blocks.select("block", "low", "high").coalesce(1).alias(name) for name, blocks in (("x", some), ("y", others))]
    return ends[0].join(ends[1], meet).select(F.col("x.block").alias("i"), F.col("y.block").alias("j"))


def _met(blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``x, y, ratio``: the pairs of texts at or above the threshold, of blocks i and j each."""
    kind = blocks.schema["nodes"].dataType.elementType.simpleString()
    pairs = cut_lineage(pairs)
    tasks = max(1, min(BLOCK_TASKS, pairs.count()))
    sides = pairs.select("i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.filter("i <> j").select("i", "j", F.col("j").alias("block"), F.lit(1).alias("side"))
    )
    placed = blocks.join(small_side(sides), "block").select("i", "j", "side", "nodes", "texts", "marks")
    meeting = placed.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "side")
    return meeting.mapInArrow(_block_pairs(threshold), f"x {kind}, y {kind}, ratio double")


def _claims(leaders: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``node, leader``: the smallest of the leaders (``node, text``) that each node (``node, text``) is near to, where one is."""
    first, keys = _blocks_of(leaders)
    second = _blocks_of(nodes, keys)[0].withColumn("block", -1 - F.col("block"))
    found = _met(first.unionByName(second), _meeting(first, second, threshold), threshold)
    return found.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("leader"))


def header_near_dups(headers: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Near-duplicate pairs of distinct headers (see :func:`header_groups` for equal ones)."""
    groups = header_groups(headers)
    nodes = groups.filter("table_id = node").select("node", "text")
    return similar_pairs(nodes, threshold)


def _walk(edges: pd.DataFrame) -> pd.DataFrame:
    """The greedy walk over one component's edges ``a < b``, in node order."""
    later: dict = {}
    for a, b in zip(edges["a"], edges["b"]):
        later.setdefault(a, []).append(b)
    led: dict = {}
    for node in sorted(set(edges["a"]) | set(edges["b"])):
        if node not in led:
            led[node] = node
            for other in later.get(node, ()):
                led.setdefault(other, node)
    return pd.DataFrame({"node": list(led), "leader": list(led.values())})


def _lead_by_rounds(edges: DataFrame) -> DataFrame:
    """Greedy leaders of the nodes of ``edges``, all of which have neighbours: ``node, leader``.

    A node is a leader once all its smaller neighbours are members, and a member once a smaller
    neighbour is a leader.  Each member goes to its smallest adjacent leader.
    """
    down = edges.select(F.col("a").alias("smaller"), F.col("b").alias("node"))
    decided = edges.select(F.col("a").alias("node")).join(down, "node", "left_anti").distinct()
    decided = cut_lineage(decided.select("node", F.lit(True).alias("leads")))
    open_edges = cut_lineage(down)
    # The smallest open node is decided in every round, so the loop ends.
    while not open_edges.isEmpty():
        seen = open_edges.join(
            decided.select(F.col("node").alias("smaller"), "leads"), "smaller", "left"
        )
        verdict = seen.groupBy("node").agg(
            F.bool_or(F.coalesce("leads", F.lit(False))).alias("claimed"),
            F.bool_and(F.col("leads").isNotNull()).alias("settled"),
        )
        fresh = verdict.filter("claimed or settled").select("node", (~F.col("claimed")).alias("leads"))
        decided = cut_lineage(decided.unionByName(fresh))
        open_edges = cut_lineage(open_edges.join(decided, "node", "left_anti"))
    leaders = decided.filter("leads")
    claims = (
        down.join(leaders.select(F.col("node").alias("smaller")), "smaller", "left_semi")
        .groupBy("node")
        .agg(F.min("smaller").alias("leader"))
    )
    return decided.join(claims, "node", "left").select(
        "node", F.when(F.col("leads"), F.col("node")).otherwise(F.col("leader")).alias("leader")
    )


def lead_nodes(nodes: DataFrame, edges: DataFrame, walk_edges: int = WALK_EDGES) -> DataFrame:
    """Greedy leaders of a graph in node order: ``node, leader``.

    A walk in node order makes each unclaimed node a leader that claims all its later neighbours.
    What a node becomes depends on its connected component alone, so each component of up to
    ``walk_edges`` edges is walked in one task, whatever the length of its chains.  Larger
    components, which no single task should hold, are decided by rounds of joins.
    """
    edges = cut_lineage(edges.select("a", "b"))
    kind = edges.schema["a"].dataType.simpleString()
    everyone = lambda led: nodes.select("node").join(led, "node", "left").select("node", F.coalesce("leader", "node").alias("leader"))
    if edges.count() <= walk_edges:
        # All components together are no more than one may be.
        return everyone(edges.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_walk, f"node {kind}, leader {kind}"))
    labels = cut_lineage(connected_labels(edges)).select(F.col("node").alias("a"), F.col("label").alias("part"))
    sizes = labels.join(edges, "a").groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    large = cut_lineage(sizes.filter(F.col("size") > walk_edges).select("part"))
    placed = edges.join(labels, "a")
    small = placed.join(large, "part", "left_anti")
    led = small.groupBy("part").applyInPandas(_walk, f"node {kind}, leader {kind}")
    if not large.isEmpty():
        led = led.unionByName(_lead_by_rounds(placed.join(large, "part", "left_semi").select("a", "b")))
    return everyone(led)


def lead_texts(nodes: DataFrame, threshold: float, whole: int = LEAD_WHOLE, first: int = LEAD_FIRST, stretch: int = LEAD_STRETCH) -> DataFrame:
    """Greedy leaders of texts (``node, text``) in node order: ``node, leader``.

    Up to ``whole`` texts are all compared with each other.  More are walked in stretches of nodes: within a stretch all that
    are still unclaimed are compared, then its leaders claim what comes later.  Claimed nodes drop out, and nobody
    is compared with a member, so the work is leaders times texts.  Stretches only say what is compared when.
    """
    texts = cut_lineage(nodes.select("node", "text").filter("text is not null").distinct())
    alone = lambda some: lead_nodes(some.select("node").distinct(), similar_pairs(some.select("node", "text"), threshold))
    count = texts.count()
    if count <= whole:
        return alone(texts)
    left = cut_lineage(texts.repartitionByRange(2 + 4 * count // stretch, "node").withColumn("part", F.spark_partition_id()))
    ends, held = [], 0
    for row in left.groupBy("part").count().orderBy("part").collect():
        held += row["count"]
        if held >= (stretch if ends else first):
            ends.append(row["part"])
            held = 0
    led = []
    for end in [*ends, None]:
        now = left if end is None else cut_lineage(left.filter(F.col("part") <= end))
        led.append(cut_lineage(alone(now)))
        if end is not None:
            left = left.filter(F.col("part") > end)
            leaders = now.join(led[-1].filter("node = leader").select("node"), "node", "left_semi")
            led.append(cut_lineage(_claims(leaders, left, threshold)))
            left = cut_lineage(left.join(led[-1], "node", "left_anti"))
    return reduce(DataFrame.unionByName, led)


def cluster_tables(headers: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Leader of every table: ``table_id, leader_id``."""
    groups = cut_lineage(header_groups(headers))
    nodes = groups.filter("table_id = node").select("node", "text")
    led = nodes.select("node").join(lead_texts(nodes, threshold), "node")
    return groups.join(led, "node").select("table_id", F.col("leader").alias("leader_id"))


def assign_db_ids(clusters: DataFrame, prefix: str = DB_ID_PREFIX) -> DataFrame:
    """Number the clusters in leader order from zero: ``table_id, leader_id, db_id``.

    Leaders are numbered range by range: each range of leaders is counted, and
    only that short list of counts is summed up.
    """
    leaders = clusters.filter("table_id = leader_id").select("leader_id")
    ranged = cut_lineage(
        leaders.repartitionByRange("leader_id").withColumn("part", F.spark_partition_id())
    )
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("part").orderBy("leader_id")
    numbered = (
        ranged.withColumn("_r", F.row_number().over(inside))
        .join(starts, "part")
        .select(
            "leader_id",
            F.concat(F.lit(prefix), F.lpad((F.col("start") + F.col("_r") - 1).cast("string"), 5, "0")).alias("short"),
            (F.col("start") + F.col("_r") - 1).alias("no"),
        )
    )
    # Numbers beyond five digits keep all of them.
    db_id = F.when(F.col("no") > 99999, F.concat(F.lit(prefix), F.col("no").cast("string"))).otherwise(F.col("short"))
    return clusters.join(numbered.select("leader_id", db_id.alias("db_id")), "leader_id").select(
        "table_id", "leader_id", "db_id"
    )


def near_dup_filter(clusters: DataFrame) -> DataFrame:
    """One table per cluster: its leader."""
    return clusters.filter("table_id = leader_id").select("table_id")
