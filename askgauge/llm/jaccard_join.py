"""N-gram Jaccard join: count vectors in an R-tree bound the overlap, surviving pairs are verified.

The shingles of a text are hashed into ``GROUPS`` groups; the numbers of shingles by group are a point. The
sum of the smaller coordinates of two points bounds how many shingles the texts share; for two boxes of an
R-tree, the sum of the smaller upper corners bounds all pairs between them.

Two texts whose likeness reaches the threshold share one of their rarest shingles (the first n - ceil(t n) + 1
in an order with frequent shingles last). The index is therefore one tree per such shingle, spread over the
cluster. Trees report which texts they connect, not all pairs; the sets of connected texts then meet and
are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_words import NOT_BLANK, give_back, mix, shingles, text_blocks, word_hashes
from .graph import Forest, group_labels
from .tables import bit_filter, read_table, stored, text_or_empty

GROUPS = 64
#: Frequencies are counted in 2**SLOTS slots, by the top bits of the shingle hash.
SLOTS = 22
#: Trees and groups of connected texts beyond this many members are split over several tasks.
SPLIT = 2048
LEAF = 16
_SALT = np.uint64(0xA24BAED4963EE407)


def _token_blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, buf, offsets in text_blocks(batch, "text", 1_000_000):
        words, counts = word_hashes(buf, offsets, NOT_BLANK)
        tokens, sizes = shingles(words, counts, width)
        yield first, end, tokens, sizes


def _frequent(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << SLOTS, dtype=np.int32), 0
        for batch in batches:
            for _, _, tokens, _ in _token_blocks(batch, width):
                np.add.at(seen, (tokens >> np.uint64(64 - SLOTS)).astype(np.int64), 1)
                total += len(tokens)
        slots = np.flatnonzero(seen >= 3 * total / len(seen) + 8)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(seen[slots].astype(np.int64))], names=["slot", "n"])

    return run


def frequency_levels(rows: DataFrame, width: int) -> np.ndarray:
    """One byte per slot: 0 for ordinary shingles, rising with the logarithm of the count for frequent ones.

    Counted over all texts; tasks report the slots that stand out among theirs. Only the order of shingles
    depends on it, never the result. At most 2**SLOTS numbers reach the driver.
    """
    found = rows.select("text").mapInArrow(_frequent(width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    levels = np.zeros(1 << SLOTS, dtype=np.uint8)
    for row in found.toLocalIterator():
        levels[row["slot"]] = int(row["n"]).bit_length()
    return levels


def row_sets(tokens: np.ndarray, sizes: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Distinct tokens of each row, rare ones first: the level is the top byte of a token."""
    slot = (tokens >> np.uint64(64 - SLOTS)).astype(np.int64)
    tokens = (tokens >> np.uint64(8)) | (levels[slot].astype(np.uint64) << np.uint64(56))
    ends = np.cumsum(sizes)
    out = []
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        own = np.sort(tokens[a:b])
        out.append(own[np.append(True, own[1:] != own[:-1])] if b - a > 1 else own)
    return out


def _node(own: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    with np.errstate(over="ignore"):
        a, b = mix(own).sum(dtype=np.uint64), mix(own ^ _SALT).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def groups_for(n: int) -> int:
    """Larger sets need more groups for a useful bound; groups are nested, so vectors fold onto shorter ones."""
    return GROUPS if n < 512 else 4 * GROUPS if n < 6000 else 16 * GROUPS


def count_vector(own: np.ndarray) -> bytes:
    """Shingles by group; 255 stands for 255 or more."""
    groups = groups_for(len(own))
    return np.minimum(np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8).tobytes()


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _profiles(sent, width: int):
    """Per row: size and name of its set; the name's first half is enough to look sets up, not to tell them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            for first, end, tokens, sizes in _token_blocks(batch, width):
                sets = row_sets(tokens, sizes, levels)
                own = batch.column("id").slice(first, end - first)
                nodes = [_node(s) for s in sets]
                columns = [own, pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([_short(x) for x in nodes], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "node", "short"])

    return run


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "big", signed=True)


def _first_sets(batch: pa.RecordBatch, levels: np.ndarray, reps: np.ndarray, mask: int, width: int, seen: set[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(name, set) of the rows that stand for their set, each set once per task as far as memory allows."""
    ids = batch.column("hash").to_pylist()
    for first, _, tokens, sizes in _token_blocks(batch, width):
        for i, own in enumerate(row_sets(tokens, sizes, levels)):
            if not len(own):
                continue
            node = _node(own)
            at = (ids[first + i] ^ _short(node)) & mask
            if reps[at >> 3] >> (at & 7) & 1 and node not in seen:
                if len(seen) < 500_000:
                    seen.add(node)
                yield node, own


def _heads(sent, reps, bits_log2: int, width: int, percent: int):
    """The rarest shingles of each set; twice when two sets of a batch have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, bits, mask = np.frombuffer(sent.value, dtype=np.uint8), np.frombuffer(reps.value, dtype=np.uint8), (1 << bits_log2) - 1
        seen: set[bytes] = set()
        for batch in batches:
            heads = [own[: _prefix(len(own), percent)] for _, own in _first_sets(batch, levels, bits, mask, width, seen)]
            values, times = np.unique(np.concatenate(heads) if heads else np.zeros(0, dtype=np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(values, np.minimum(times, 2)).view(np.int64))], names=["token"])

    return run


def repeated_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values that a partition of one column holds more than once."""
    own = [batch.column(0).to_numpy() for batch in batches]
    values = np.sort(np.concatenate(own)) if own else np.zeros(0, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(values[1:][values[1:] == values[:-1]]))], names=["token"])


def _members(sent, reps, hits, bits_log2: int, width: int, percent: int):
    """A row for each set and each of its rarest shingles that another set may have among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, bits, mask = np.frombuffer(sent.value, dtype=np.uint8), np.frombuffer(reps.value, dtype=np.uint8), (1 << bits_log2) - 1
        shared = np.frombuffer(hits.value, dtype=np.uint8)
        seen: set[bytes] = set()
        for batch in batches:
            tokens, shorts, sizes, vectors = [], [], [], []
            for node, own in _first_sets(batch, levels, bits, mask, width, seen):
                head = own[: _prefix(len(own), percent)].view(np.int64)
                at = head & mask
                head = head[(shared[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
                if len(head):
                    tokens.append(head)
                    shorts.append(_short(node))
                    sizes.append(len(own))
                    vectors.append(count_vector(own))
            repeat = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]) if tokens else np.zeros(0, dtype=np.int64)
            take = pa.array(repeat)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)), pa.array(shorts, pa.int64()).take(take),
                    pa.array(sizes, pa.int64()).take(take), pa.array(vectors, pa.binary()).take(take),
                ],
                names=["token", "node", "n", "vector"],
            )

    return run


def _points(vectors: list[bytes], groups: int = GROUPS) -> np.ndarray:
    """Count vectors folded onto the first so many groups; an open count stands for more than any other."""
    out = np.zeros((len(vectors), groups), dtype=np.int32)
    lengths = np.array([len(v) for v in vectors])
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        for at in range(0, len(mine), 20_000):
            some = mine[at : at + 20_000]
            raw = np.frombuffer(b"".join([vectors[i] for i in some.tolist()]), dtype=np.uint8).reshape(len(some), length // groups, groups).astype(np.int32)
            raw[raw == 255] = 1 << 20
            out[some] = raw.sum(axis=1)
    return out


def _bound_holds(a: bytes, b: bytes, size_a: int, size_b: int, percent: int) -> bool:
    """Whether two sets may reach the threshold, by their vectors at the finer of their common lengths."""
    groups = min(len(a), len(b))
    return int(np.minimum(*_points([a, b], groups)).sum()) >= _need(size_a, size_b, percent)


def _need(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of two sets of these sizes: percent / 100 of the union."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """An R-tree packed over points: leaves of LEAF points, boxes as upper corners and size ranges, levels of
    boxes of boxes above."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray) -> None:
        # Sort-tile packing: slabs by size, inside a slab by the coordinate that varies most.
        order = np.argsort(sizes, kind="stable")
        slab = max(LEAF, int(np.ceil(np.sqrt(len(order) / LEAF))) * LEAF)
        tiles = []
        for at in range(0, len(order), slab):
            part = order[at : at + slab]
            tiles.append(part[np.argsort(points[part, int(points[part].var(axis=0).argmax())], kind="stable")])
        self.order = np.concatenate(tiles)
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.levels = []
        upper, low, high = self.points, self.sizes, self.sizes
        while len(upper) > 1 or not self.levels:
            starts = np.arange(0, len(upper), LEAF)
            upper, low, high = np.maximum.reduceat(upper, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((upper, low, high))
            if len(upper) == 1:
                break

    def near(self, size: int, point: np.ndarray, percent: int) -> np.ndarray:
        """Places (in ``order``) of all points that may reach the threshold with this one."""
        live = np.arange(len(self.levels[-1][0]))
        for upper, low, high in reversed(self.levels):
            live = live[live < len(upper)]
            fits = (100 * high[live] >= percent * size) & (percent * low[live] <= 100 * size)
            live = live[fits]
            live = live[np.minimum(upper[live], point).sum(axis=1) >= _need(low[live], size, percent)]
            live = (live[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
        live = live[live < len(self.sizes)]
        own = self.sizes[live]
        live = live[(100 * own >= percent * size) & (percent * own <= 100 * size)]
        return live[np.minimum(self.points[live], point).sum(axis=1) >= _need(self.sizes[live], size, percent)]


def tree_links(sizes: np.ndarray, points: np.ndarray, vectors: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect whatever pairs within the bound connect, at most one fewer than points."""
    tree, group, found = CountTree(sizes, points), np.arange(len(sizes)), []
    groups = min(len(v) for v in vectors)
    fine = _points(vectors, groups) if groups > GROUPS else points
    for x in range(len(sizes)):
        near = tree.order[tree.near(int(sizes[x]), points[x], percent)]
        near = near[(near < x) & (group[near] != group[x])]
        if groups > GROUPS and len(near):
            near = near[np.minimum(fine[near], fine[x]).sum(axis=1) >= _need(sizes[near], int(sizes[x]), percent)]
        for y in near.tolist():
            if group[y] != group[x] and _bound_holds(vectors[x], vectors[y], int(sizes[x]), int(sizes[y]), percent):
                group[group == group[y]] = group[x]
                found.append((x, y))
    return found


def _small_pairs(starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, points: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the bound of stretches of at most LEAF rows (each a single leaf)."""
    left, right = [], []
    for m in np.unique(lengths).tolist():
        at = starts[lengths == m]
        i, j = np.triu_indices(m, 1)
        left.append((at[:, None] + i).reshape(-1))
        right.append((at[:, None] + j).reshape(-1))
    if not left:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    x, y = np.concatenate(left), np.concatenate(right)
    a, b = sizes[x], sizes[y]
    fits = (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    x, y = x[fits], y[fits]
    ok = [np.minimum(points[x[i : i + 50_000]], points[y[i : i + 50_000]]).sum(axis=1) >= _need(sizes[x[i : i + 50_000]], sizes[y[i : i + 50_000]], percent) for i in range(0, len(x), 50_000)]
    ok = np.concatenate(ok) if ok else np.zeros(0, dtype=bool)
    return x[ok], y[ok]


def _trees(percent: int):
    """Over rows sorted by (token, i, j): connect the members of each tree; each link is reported once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[int, int] = {}
        forest = Forest(0)
        held: pa.Table | None = None

        def solve(table: pa.Table) -> pa.RecordBatch:
            nodes = table.column("node").to_numpy().tolist()
            sizes = table.column("n").to_numpy()
            vectors = table.column("vector").to_pylist()
            points = _points(vectors)
            keys = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            lengths = np.diff(np.append(starts, len(nodes)))
            small = (lengths > 1) & (lengths <= LEAF)
            x, y = _small_pairs(starts[small], lengths[small], sizes, points, percent)
            pairs = list(zip(x.tolist(), y.tolist(), strict=True))
            for at, m in zip(starts[lengths > LEAF].tolist(), lengths[lengths > LEAF].tolist(), strict=True):
                pairs += [(at + p, at + q) for p, q in tree_links(sizes[at : at + m], points[at : at + m], vectors[at : at + m], percent)]
            left, right = [], []
            for p, q in pairs:
                own = []
                for node in (nodes[p], nodes[q]):
                    if node not in number:
                        number[node] = len(forest.parent)
                        forest.parent.append(len(forest.parent))
                    own.append(number[node])
                if forest.find(own[0]) == forest.find(own[1]) or not _bound_holds(vectors[p], vectors[q], int(sizes[p]), int(sizes[q]), percent):
                    continue
                if forest.join(*own):
                    left.append(nodes[p])
                    right.append(nodes[q])
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            # The last tree may go on in the next batch.
            last = tuple(table.column(c)[-1].as_py() for c in ("token", "i", "j"))
            same = np.all([table.column(c).to_numpy() == v for c, v in zip(("token", "i", "j"), last, strict=True)], axis=0)
            cut = int(np.argmax(same))
            held = table.slice(cut)
            if cut:
                yield solve(table.slice(0, cut))
            give_back()
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _wanted_sets(sent, reps, wanted, bits_log2: int, width: int):
    """Sets whose short name may be among the wanted ones, as 48-bit shingles, six bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, bits, mask = np.frombuffer(sent.value, dtype=np.uint8), np.frombuffer(reps.value, dtype=np.uint8), (1 << bits_log2) - 1
        asked = np.frombuffer(wanted.value, dtype=np.uint8)
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for node, own in _first_sets(batch, levels, bits, mask, width, seen):
                at = _short(node) & mask
                if asked[at >> 3] >> (at & 7) & 1:
                    rows.append((_short(node), node, np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()))
            short, node, own = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64()), pa.array(node, pa.binary()), pa.array(own, pa.binary())], names=["node", "name", "tokens"])

    return run


def unpack_set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return np.unique(out.view("<u8").reshape(-1))


def _fine_points(sets: list[np.ndarray]) -> np.ndarray:
    """Count vectors with about a group for every four shingles: whole sets are at hand here, so bounds can be tight."""
    middle = int(np.median([len(s) for s in sets]))
    groups = int(min(2048, max(GROUPS, 1 << (middle // 4).bit_length())))
    out = np.zeros((len(sets), groups), dtype=np.uint16)
    for i, own in enumerate(sets):
        out[i] = np.minimum(np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 65535)
    return out


def verified_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of sets that reach the threshold exactly, enough to connect all that any such pairs connect.

    Sets are taken by size, each against the earlier ones that its size, its tree's bound and a finer count
    vector leave, and that are not connected with it already.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(sizes, _points([count_vector(s) for s in sets])) if len(sets) > LEAF else None
    coarse = _points([count_vector(s) for s in sets])
    fine = _fine_points(sets)
    group, found = np.arange(len(sets)), []
    for x in range(1, len(sets)):
        near = tree.order[tree.near(int(sizes[x]), coarse[x], percent)] if tree else np.arange(x)
        near = np.sort(near[near < x])[::-1]
        near = near[(group[near] != group[x]) & (100 * sizes[near] >= percent * sizes[x])]
        for at in range(0, len(near), 256):
            some = near[at : at + 256]
            some = some[group[some] != group[x]]
            bound = np.minimum(fine[some], fine[x]).sum(axis=1, dtype=np.int64)
            some = some[(bound >= _need(sizes[some], sizes[x], percent)) | (fine[x].max() == 65535)]
            for y in some.tolist():
                if group[y] == group[x]:
                    continue
                place = np.searchsorted(sets[x], sets[y])
                both = int((sets[x][np.minimum(place, len(sets[x]) - 1)] == sets[y]).sum())
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    group[group == group[y]] = group[x]
                    found.append((order[x], order[y]))
    return found


def _verify(percent: int):
    """Over rows sorted by (label, i, j): compare the sets of each group of connected texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def solve() -> pa.RecordBatch:
            # The same set may come from several tasks.
            own = dict(zip(nodes, sets, strict=True))
            names = sorted(own)
            links = verified_links([unpack_set(own[n]) for n in names], percent) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in links], pa.binary()), pa.array([names[y] for _, y in links], pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "i", "j", "name")]
            packed = batch.column("tokens")
            for row, (label, i, j, node) in enumerate(zip(*columns, strict=True)):
                if (label, i, j) != key:
                    if len(nodes) > 1:
                        yield solve()
                    key, nodes, sets = (label, i, j), [], []
                nodes.append(node)
                sets.append(packed[row].as_py())
            give_back()
        if len(nodes) > 1:
            yield solve()

    return run


def _split_large(rows: DataFrame, key: str) -> DataFrame:
    """Add (i, j): groups of more than SPLIT rows are cut into parts, and every two parts meet in a group of their own.

    All pairs of a group still meet, each group of the result has about SPLIT rows.
    """
    # Stored, so that Spark sees its size: mostly it is tiny, and the rows need no shuffle for it.
    large = stored(rows.groupBy(key).count().where(F.col("count") > SPLIT).select(key, F.ceil(F.col("count") * 2 / SPLIT).cast("int").alias("parts")), "large")
    own = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, own).alias("i"), F.greatest(p, own).alias("j")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    pairs = F.when(F.col("parts").isNull(), whole).otherwise(F.filter(others, lambda p: p["i"] < p["j"]))
    return rows.join(large, key, "left").withColumn("at", F.explode(pairs)).select(*rows.columns, "at.i", "at.j")


def jaccard_labels(rows: DataFrame, width: int, percent: int, bits_log2: int) -> DataFrame:
    """For rows (id, text): id, n (shingles) and label, equal for all texts that links connect; null without words."""
    send = rows.sparkSession.sparkContext.broadcast
    levels = send(frequency_levels(rows, width).tobytes())
    hashed = rows.select(F.xxhash64("id").alias("hash"), "text")
    kind = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("short", T.LongType())])
    profiles = stored(rows.mapInArrow(_profiles(levels, width), kind), "profiles")
    # One row of each set goes on: a bitmap tells which, and lets few others pass.
    first = profiles.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("short").alias("short"))
    first = stored(first.select(F.xxhash64("id").bitwiseXOR(F.col("short")).alias("h"), "n"), "first-sets")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    reps = send(bit_filter(first, "h", bits_log2))
    # Shingles among the rarest of two sets, as a bitmap; a false hit only costs a tree of one.
    parts = max(8, int(total * (100 - percent) / 100 / 1_000_000) + 1)
    heads = hashed.mapInArrow(_heads(levels, reps, bits_log2, width, percent), "token long").repartition(parts, "token")
    hits = send(bit_filter(heads.mapInArrow(repeated_values, "token long"), "token", bits_log2))
    members = stored(hashed.mapInArrow(_members(levels, reps, hits, bits_log2, width, percent), "token long, node long, n long, vector binary"), "tree-members")
    trees = _split_large(members, "token").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    links = trees.select("token", "i", "j", "node", "n", "vector").mapInArrow(_trees(percent), "a long, b long")
    groups = group_labels(links)
    wanted = send(bit_filter(groups, "node", bits_log2))
    sets = hashed.mapInArrow(_wanted_sets(levels, reps, wanted, bits_log2, width), "node long, name binary, tokens binary")
    gathered = _split_large(groups, "label").join(sets, "node").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    exact = gathered.select("label", "i", "j", "name", "tokens").mapInArrow(_verify(percent), "a binary, b binary")
    named = group_labels(exact)
    own = profiles.select("id", "n", "node").join(named, "node", "left")
    return own.select("id", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, bits_log2: int = 26, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_shingles and component_id, the smallest key that its links lead to.

    Words are runs of characters other than ASCII blanks, A-Z lower-cased; a text's set holds its distinct
    stretches of ``width`` words, or its whole word sequence when it has fewer. Two texts are linked when
    100 x intersection >= percent x union. Equal sets are one node from the start. A text without words has
    n_shingles 0 and its own key as component_id. A row with a null key is linked like any other but names no
    component (null if no row of its component has a key). Rows with equal keys stay apart unless linked.
    Other columns take no part.

    Shingles are 56-bit hashes (48 bits when two sets are compared), sets are named by 128 bits.
    """
    own = jaccard_labels(docs.select(F.col(key).alias("id"), text_or_empty().alias("text")), width, percent, bits_log2)
    least = own.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component_id"))
    out = own.join(least, "label", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _may_hold(sent, bits_log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = np.frombuffer(sent.value, dtype=np.uint8), (1 << bits_log2) - 1
        for batch in batches:
            at = batch.column("name").to_numpy() & mask
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("name"), pa.array(hit)], names=["row", "name", "hit"])

    return run


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, bits_log2: int = 26, key: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: the one with the smallest key.

    Null keys come last; among rows with equal keys the smallest text hash stays, of equal rows one. Rows without
    words all stay. Only rows that may be dropped are shuffled.
    """
    tagged = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("k"), F.xxhash64(text_or_empty()).alias("tag"))
    labels = stored(jaccard_labels(docs.select(tagged.alias("id"), text_or_empty().alias("text")), width, percent, bits_log2).where("label IS NOT NULL"), "labels")
    counted = labels.groupBy("id", "label").agg(F.count("*").alias("rows"))
    least = labels.groupBy("label").agg(F.min("id").alias("best"))
    touched = counted.join(least, "label").withColumn("keep", F.col("id") == F.col("best")).where("NOT keep OR rows > 1")
    touched = stored(touched.select(F.xxhash64("id").alias("name"), "keep"), "touched")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(touched, "name", bits_log2))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(tagged).alias("name"))
    kind = T.StructType([*packed.schema.fields, T.StructField("hit", T.BooleanType())])
    rows = packed.mapInArrow(_may_hold(sent, bits_log2), kind)
    maybe = rows.where("hit").join(touched, "name", "left")
    once = maybe.where("keep").groupBy("name").agg(F.first("row").alias("row"))
    return rows.where("NOT hit").select("row").unionByName(maybe.where("keep IS NULL").select("row")).unionByName(once.select("row")).select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meet AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM meet JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * meet.n >= 80 * (p.n + q.n - meet.n)
), two_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM d
    UNION SELECT r.a, t.b FROM reach r JOIN two_way t ON r.b = t.a
)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id)
"""
