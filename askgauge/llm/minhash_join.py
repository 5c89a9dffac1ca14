"""MinHash near-duplicates by a multi-index Hamming join.

The signature of a set holds the low b bits of ``POSITIONS`` minimum hashes. Two sets of likeness J differ in
about (1 - J) of the positions. Signatures are split into ``CHUNKS`` chunks; by the pigeonhole rule, two that
differ in at most ``RADIUS`` positions have a chunk with at most ``ERRORS`` differing positions. Every
chunk is therefore indexed under all choices of its positions that may be in error: the others are the key.
So all pairs within the radius share a key. Keys only say which texts may be linked; links are confirmed on the
full sets of the texts that candidates connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_words import NOT_BLANK, SEED, give_back, mix, shingles, text_blocks, word_hashes
from .graph import Forest, group_labels
from .tables import bit_filter, read_table, stored, text_or_empty

BITS = 16
POSITIONS = 32
CHUNKS = 8
WIDTH = POSITIONS // CHUNKS
#: Positions of a chunk that may differ.
ERRORS = 1
#: Two positions in error would need another key layout: three of 16 bits fit beside the number of the mask.
MASKS = [[c * WIDTH + p for p in range(WIDTH) if p not in wrong] for c in range(CHUNKS) for wrong in combinations(range(WIDTH), ERRORS)]
#: Largest number of differing positions that is sure to be found.
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Members of a key that are compared with each other; a larger group is connected as it is, without comparison.
COMPARED = 1024
#: Members of a key that a task hands on one by one; more are connected where they are.
LOCAL = 64
#: Shingles of a group that are compared in one task.
HEAVY = 1_500_000
#: What a set weighs beside its shingles.
SET_COST = 500
#: Documents of a group that all others meet, chosen near its middle.
PIVOTS = 8
_SALT = np.uint64(0x8EBC6AF09C88C6E3)
_SEEDS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * SEED)


def _row_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For blocks of a batch's texts, in order: all shingle hashes, their number by row, and each row's distinct ones, sorted."""
    for _, _, buf, offsets in text_blocks(batch, "text", 1_000_000):
        words, counts = word_hashes(buf, offsets, NOT_BLANK)
        tokens, sizes = shingles(words, counts, width)
        ends = np.cumsum(sizes)
        yield tokens, sizes, [np.unique(tokens[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return (np.cumsum(sizes) - sizes)[sizes > 0]


def set_names(sets: list[np.ndarray]) -> list[bytes]:
    """A 128-bit name of each set, of no bytes for an empty one; the first half, as a number, is enough to look a set up."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return [b""] * len(sets)
    every, halves = np.concatenate(sets), np.zeros((len(sets), 2), dtype=">u8")
    for half, salt in enumerate((SEED, _SALT)):
        halves[sizes > 0, half] = np.add.reduceat(mix(every ^ salt), _starts(sizes))
    return [row.tobytes() if n else b"" for row, n in zip(halves, sizes.tolist(), strict=True)]


def signatures(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row's hashes (some may repeat): the low BITS bits of the smallest under each of POSITIONS hash functions."""
    least = np.zeros((len(sizes), POSITIONS), dtype=np.uint64)
    if len(tokens):
        for p in range(POSITIONS):
            # One multiplication orders hashes that are spread already; the high bits decide.
            least[sizes > 0, p] = np.minimum.reduceat((tokens ^ _SEEDS[p]) * (_SEEDS[p] | np.uint64(1)), _starts(sizes))
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype("<u2")


def _profiles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, signs = [], [], []
            for tokens, counts, own in _row_sets(batch, width):
                sizes += [len(s) for s in own]
                names += set_names(own)
                signs += [x.tobytes() for x in signatures(tokens, counts)]
            node = [int.from_bytes(x[:8], "big", signed=True) for x in names]
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(node, pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "node", "name", "sign"])
            give_back()

    return run


def chunk_keys(signs: np.ndarray) -> np.ndarray:
    """Keys of signatures (a row each): for every chunk and choice of positions in error, the number of the choice
    and the values at the chunk's other positions."""
    out = np.zeros((len(signs), len(MASKS)), dtype=np.uint64)
    for m, kept in enumerate(MASKS):
        key = np.full(len(signs), m, dtype=np.uint64)
        for p in kept:
            key = (key << np.uint64(BITS)) | signs[:, p].astype(np.uint64)
        out[:, m] = key
    return out.view(np.int64)


def brief(signs: np.ndarray) -> np.ndarray:
    """Four bits of each position, two to a byte: these differ in no more positions than the whole ones."""
    nibble = (signs & 15).astype(np.uint8)
    return nibble[:, 0::2] | nibble[:, 1::2] << 4


def differing(some: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many positions brief signatures differ from one."""
    x = some ^ one
    return ((x & 15) > 0).sum(axis=1) + ((x >> 4) > 0).sum(axis=1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, node, brief) for every key of a set.

    Where a batch has more than LOCAL rows of a key, it sends one of them, without signature, which stands for
    all: a null brief tells that the key's members are connected without comparison. The others become links
    to that one (key null).
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), dtype="<u2").reshape(-1, POSITIONS)
        nodes = batch.column("node").to_numpy()
        key = chunk_keys(signs).reshape(-1)
        place = np.repeat(np.arange(len(nodes)), len(MASKS))
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lengths = np.diff(np.append(starts, len(key)))
        head = np.repeat(starts, lengths)
        crowd = np.repeat(lengths, lengths) > LOCAL
        linked = crowd & (np.arange(len(key)) > head)
        sent = ~linked
        values = pa.array([x.tobytes() for x in brief(signs)], pa.binary())
        shown = pa.array(place[sent], mask=crowd[sent])
        columns = [pa.array(key[sent]), pa.array(nodes[place[sent]]), values.take(shown), pa.nulls(int(sent.sum()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "brief", "other"])
        if linked.any():
            pairs = np.unique(np.stack([nodes[place[linked]], nodes[place[head[linked]]]]), axis=1)
            many = pairs.shape[1]
            yield pa.RecordBatch.from_arrays([pa.nulls(many, pa.int64()), pa.array(pairs[0]), pa.nulls(many, pa.binary()), pa.array(pairs[1])], names=["key", "node", "brief", "other"])


class _Links:
    """Links among nodes that were not connected before, by a forest over the nodes met so far."""

    def __init__(self) -> None:
        self.number: dict[int, int] = {}
        self.forest = Forest(0)

    def _at(self, node: int) -> int:
        if node not in self.number:
            self.number[node] = len(self.forest.parent)
            self.forest.parent.append(len(self.forest.parent))
        return self.number[node]

    def connected(self, a: int, b: int) -> bool:
        return a in self.number and b in self.number and self.forest.find(self.number[a]) == self.forest.find(self.number[b])

    def add(self, a: int, b: int) -> bool:
        return self.forest.join(self._at(a), self._at(b))


def _close_pairs(nodes: list[int], signs: np.ndarray, links: _Links) -> Iterator[tuple[int, int]]:
    """Links that connect all members of a key whose signatures are within the radius."""
    group = np.arange(len(nodes))
    for x in range(1, len(nodes)):
        near = np.flatnonzero(group[:x] != group[x])
        near = near[differing(signs[near], signs[x]) <= RADIUS]
        for y in near.tolist():
            if group[y] == group[x]:
                continue
            group[group == group[y]] = group[x]
            if nodes[x] != nodes[y] and not links.connected(nodes[x], nodes[y]) and links.add(nodes[x], nodes[y]):
                yield nodes[x], nodes[y]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: links (a, b) among each key's members. At most COMPARED members are held."""
    links = _Links()
    nodes: list[int] = []
    signs: list[bytes] = []
    key, crowded = None, False

    def star(members: list[int]) -> list[tuple[int, int]]:
        return [(n, nodes[0]) for n in members if n != nodes[0] and links.add(n, nodes[0])]

    def solve() -> list[tuple[int, int]]:
        if crowded or len(nodes) < 2:
            return []
        if None in signs:
            return star(nodes)
        return list(_close_pairs(nodes, np.frombuffer(b"".join(signs), dtype=np.uint8).reshape(-1, POSITIONS // 2), links))

    def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        own, short = batch.column("node"), batch.column("brief")
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(starts[1:], len(keys))
        # Keys with one row matter only at the edges, where they may go on in another batch.
        runs = ends - starts > 1
        runs[[0, -1]] = True
        found: list[tuple[int, int]] = []
        for a, b in zip(starts[runs].tolist(), ends[runs].tolist(), strict=True):
            if keys[a] != key:
                found += solve()
                key, nodes, signs, crowded = keys[a], [], [], False
            more = own.slice(a, b - a).to_pylist()
            if not crowded and len(nodes) + len(more) <= COMPARED:
                nodes += more
                signs += short.slice(a, b - a).to_pylist()
            else:
                nodes += more
                found += star(nodes)
                nodes, signs, crowded = nodes[:1], [], True
        yield packed(found)
    yield packed(solve())


def candidate_groups(sets: DataFrame, partitions: int) -> DataFrame:
    """(node, label) for the rows of ``sets`` (node, sign) that have others within RADIUS differing positions.

    Nodes within the radius have the same label; nodes farther apart may have it too (through others, through the
    shorter signatures that are compared, or because a key of more than COMPARED members is not compared).
    """
    keyed = stored(sets.mapInArrow(_keyed, "key long, node long, brief binary, other long"), "minhash-keys")
    own = keyed.where("key IS NOT NULL").select("key", "node", "brief").repartition(partitions, "key").sortWithinPartitions("key")
    links = own.mapInArrow(_candidates, "a long, b long")
    return group_labels(links.unionByName(keyed.where("key IS NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))))


def _wanted(sent, bits_log2: int, width: int):
    """(name, tokens) of the rows whose id may be among those asked for, each set once per task as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = np.frombuffer(sent.value, dtype=np.uint8), (1 << bits_log2) - 1
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column("hash").to_numpy()
            live = np.flatnonzero(bits[(keys & mask) >> 3] >> (keys & 7).astype(np.uint8) & 1)
            some = pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(live))], names=["text"])
            rows = []
            for _, _, own in _row_sets(some, width):
                for name, one in zip(set_names(own), own, strict=True):
                    if name and name not in seen:
                        if len(seen) < 500_000:
                            seen.add(name)
                        # The low six bytes of each hash.
                        rows.append((name, np.ascontiguousarray(one.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], names=["name", "tokens"])
            give_back()

    return run


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return np.unique(out.view("<u8").reshape(-1))


def confirm(sets: list[np.ndarray], percent: int, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that reach the threshold, enough to connect all that such pairs connect.

    Sets are counted by group of hashes; summed minima of two counts bound the overlap, and only pairs that the
    bound leaves and that are not connected yet are compared exactly. Those nearest to the middle of all come
    first: in a group of copies of one text, that text then connects the others. With ``ask``, only pairs with
    an asked set are looked for.
    """
    sizes = np.array([len(s) for s in sets])
    groups = int(min(1024, max(64, 1 << (int(np.median(sizes)) // 2).bit_length())))
    counts = np.zeros((len(sets), groups), dtype=np.uint16)
    for i, own in enumerate(sets):
        counts[i] = np.minimum(np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 65535)
    middle = np.median(counts[:: -(-len(sets) // 512)], axis=0).astype(np.uint16)
    far = sizes + int(middle.sum()) - 2 * np.minimum(counts, middle).sum(axis=1, dtype=np.int64)
    order = np.argsort(far, kind="stable")
    asked = np.ones(len(sets), dtype=bool) if ask is None else ask
    group, found = np.arange(len(sets)), []
    for place, x in enumerate(order.tolist()):
        others = order[place + 1 :]
        others = others[group[others] != group[x]]
        if not asked[x]:
            others = others[asked[others]]
        others = others[100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])]
        need = -(-percent * (sizes[others] + sizes[x]) // (100 + percent))
        bound = np.minimum(counts[others], counts[x]).sum(axis=1, dtype=np.int64)
        others = others[(bound >= need) | (counts[x].max() == 65535)]
        for y in others.tolist():
            if group[y] == group[x]:
                continue
            small, large = (sets[x], sets[y]) if sizes[x] < sizes[y] else (sets[y], sets[x])
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if 100 * both >= percent * (int(sizes[x]) + int(sizes[y]) - both):
                group[group == group[y]] = group[x]
                found.append((x, y))
    return found


def _confirmed(percent: int):
    """Over rows sorted by (label, part): links of each part's sets; where rows are asked ones, theirs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def solve() -> pa.RecordBatch:
            names = sorted(held)
            ask = np.array([held[n][1] for n in names])
            links = confirm([unpack(held[n][0]) for n in names], percent, None if ask.all() else ask) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in links], pa.binary()), pa.array([names[y] for _, y in links], pa.binary())], names=["a", "b"])

        for batch in batches:
            tokens = batch.column("tokens")
            columns = [batch.column(c).to_pylist() for c in ("label", "part", "name", "ask")]
            for row, (label, part, name, ask) in enumerate(zip(*columns, strict=True)):
                if (label, part) != key:
                    if len(held) > 1:
                        yield solve()
                    key, held = (label, part), {}
                if name not in held or ask:
                    held[name] = (tokens[row].as_py(), ask)
            give_back()
        if len(held) > 1:
            yield solve()

    return run


def _pivots(large: DataFrame) -> DataFrame:
    """(label, name) of up to PIVOTS sets of each label whose signatures agree with most others' at most positions."""
    signs = F.expr(f"transform(sequence(0, {POSITIONS - 1}), i -> struct(i, substring(sign, 2 * i + 1, 2) as v))")
    places = large.select("label", "name", F.explode(signs).alias("s")).select("label", "name", "s.i", "s.v")
    counted = places.groupBy("label", "i", "v").agg(F.count("*").alias("c"))
    usual = counted.groupBy("label", "i").agg(F.max(F.struct("c", "v")).alias("u")).groupBy("label").agg(F.collect_list(F.struct("i", "u.v")).alias("usual"))
    agree = F.expr("size(filter(usual, u -> substring(sign, 2 * u.i + 1, 2) = u.v))")
    ranked = large.join(usual, "label").select("label", "name", agree.alias("agree"), F.pmod(F.xxhash64("name"), F.lit(PIVOTS)).alias("slot"))
    return ranked.groupBy("label", "slot").agg(F.max(F.struct("agree", "name")).alias("p")).select("label", "p.name")


def confirmed_links(members: DataFrame, sets: DataFrame, percent: int, heavy: int = HEAVY) -> DataFrame:
    """(a, b) between names of ``members`` (label, name, n, sign) of one label whose sets (name, tokens) reach the threshold.

    Together the links connect all that such pairs connect. A label with up to ``heavy`` shingles is compared in one
    task. A larger one is cut into parts of about that size: each part is compared along with the label's
    pivots first; then every set outside the largest component so far meets all parts.
    """
    def pieces(rows: DataFrame, name: str) -> DataFrame:
        # A set counts SET_COST shingles more than it has, so that a task's sets are bounded too.
        weight = rows.groupBy("label").agg(F.sum(F.col("n") + SET_COST).alias("w"))
        return stored(weight.select("label", F.when(F.col("w") <= heavy, 1).otherwise(F.ceil(2 * F.col("w") / heavy)).cast("int").alias(name)), name)

    parts = pieces(members, "parts")
    solve = _confirmed(percent)

    def linked(rows: DataFrame) -> DataFrame:
        dealt = rows.join(sets, "name").repartition("label", "part").sortWithinPartitions("label", "part")
        return dealt.select("label", "part", "name", "ask", "tokens").mapInArrow(solve, "a binary, b binary")

    own = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    placed = members.join(parts, "label").select("label", "name", "n", "sign", "parts", F.when(F.col("parts") > 1, own).otherwise(0).alias("part"))
    large = placed.where("parts > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    if large.isEmpty():
        return linked(placed.select("label", "name", "part", F.lit(True).alias("ask")))
    large = stored(large, "large-groups")
    pivots = _pivots(large).join(parts, "label").select("label", "name", every, F.lit(True).alias("ask"))
    rows = placed.select("label", "name", "part", F.lit(True).alias("ask"))
    first = stored(linked(rows.unionByName(pivots)), "links")
    inside = large.select("label", "name", "n", "parts").join(group_labels(first).withColumnRenamed("node", "name").withColumnRenamed("label", "part_of"), "name", "left")
    inside = stored(inside.withColumn("part_of", F.coalesce("part_of", "name")), "connected")
    most = inside.groupBy("label", "part_of").count().groupBy("label").agg(F.max(F.struct("count", "part_of")).alias("most")).select("label", F.col("most.part_of").alias("most"))
    outside = stored(inside.join(most, "label").where("part_of <> most").select("label", "name", "n", "parts"), "outside")
    if outside.isEmpty():
        return first
    # A part meets the sets outside in blocks; labels with nothing outside are through.
    blocks = pieces(outside, "blocks")
    block = F.pmod(F.xxhash64("name", F.lit("block")), F.col("blocks")).cast("int")
    asking = outside.join(blocks, "label").select("label", "name", "blocks", block.alias("block"), every, F.lit(True).alias("ask"))
    asking = asking.select("label", "name", (F.col("part") * F.col("blocks") + F.col("block")).alias("part"), "ask")
    each = large.join(blocks, "label").select("label", "name", "part", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rest = each.select("label", "name", (F.col("part") * F.col("blocks") + F.col("block")).alias("part"), F.lit(False).alias("ask"))
    return first.unionByName(linked(asking.unionByName(rest)))


def near_duplicate_components(docs: DataFrame, width: int = 5, percent: int = 85, key: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the smallest key that its links lead to) and kept.

    Words are runs of characters other than ASCII blanks, A-Z lower-cased; a text's set holds its distinct
    stretches of ``width`` words, or its whole word sequence when it has fewer. Two texts are linked when
    100 x intersection >= percent x union, which is confirmed on the full sets. A link between sets whose signatures
    differ in more than RADIUS positions and that share no key is not seen: at a likeness of 0.85, two in a hundred
    million. Equal sets are one node from the start.

    A text without words (or null, or empty) has n_shingles 0 and its own key as component_id. A row with a null
    key is linked like any other but names no component (null if no row of its component has a key). Rows with
    equal keys stay apart unless linked. kept says that the key equals component_id. Other columns take no part.

    Shingles are 64-bit hashes (48 bits when two sets are compared), sets are named by 128 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), text_or_empty().alias("text"))
    kind = T.StructType([rows.schema["id"], *T._parse_datatype_string("n long, node long, name binary, sign binary").fields])
    profiles = stored(rows.mapInArrow(_profiles(width), kind), "profiles")
    ids = F.struct(F.col("id").isNull().alias("no_id"), "id")
    distinct = profiles.where("n > 0").groupBy("name").agg(F.min(F.struct(ids.alias("id"), "node", "n", "sign")).alias("s"))
    distinct = stored(distinct.select("name", "s.id.id", "s.node", "s.n", "s.sign"), "distinct-sets")
    total = distinct.count()
    groups = candidate_groups(distinct.select("node", "sign"), max(8, total * len(MASKS) // 500_000))
    members = stored(distinct.join(groups, "node"), "members")
    # One row of each set hands its shingles on; a bitmap of their ids, sized by their number, keeps most others back.
    bits_log2 = min(30, max(20, (16 * members.count()).bit_length()))
    chosen = members.select(F.xxhash64("id").alias("hash"), F.col("name").alias("own"))
    sent = spark.sparkContext.broadcast(bit_filter(chosen, "hash", bits_log2))
    found = rows.select(F.xxhash64("id").alias("hash"), "text").mapInArrow(_wanted(sent, bits_log2, width), "name binary, tokens binary")
    links = confirmed_links(members.select("label", "name", "n", "sign"), found, percent, heavy)
    named = group_labels(links)
    own = profiles.select("id", "n", "name").join(named.withColumnRenamed("node", "name"), "name", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "name")))
    own = stored(own.select("id", "n", "label"), "labels")
    least = own.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    out = own.join(least, "label", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meet AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM meet JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * meet.n >= 85 * (p.n + q.n - meet.n)
), two_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM d
    UNION SELECT r.a, t.b FROM reach r JOIN two_way t ON r.b = t.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
