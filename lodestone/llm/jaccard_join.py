"""Operator 5: exact n-gram Jaccard join, size-aware, giving classes of linked documents.

A document's set holds the hashes of its distinct 5-word shingles. Two documents link from a Jaccard
similarity of ``PERCENT`` on. Identical sets are one node from the start, so copies cost one row each.

*Light* sets, of at most ``boundary`` shingles, enumerate their subsets of the sizes that a link with
another light set needs; two linked light sets share such a subset. *Heavy* sets are found by inverted
lists of their prefixes: with tokens ordered from rare to frequent, a set of size s must share one of
its first s - ceil(0.75 s) + 1 tokens with each set that it links to. Light sets that are large enough
to link with a heavy one are put into these lists too. The boundary is the one with the least cost over
the corpus' set sizes (``choose_boundary``). The token order comes from counts over all documents.

Pairs inside a list are never enumerated wholesale. The members of a list whose sizes fall into one class
(sizes of a class can all link) have a leader, the one with the smallest share of rare tokens: copies of a
text add rare tokens to it, so this is the text itself or the least changed copy. Members are first compared
with their leaders, and with the leader of the next class, which joins a group of m near copies by some 2 m
comparisons, even if the copies are linked through the text alone. Only members that are then in different
components are compared with each other: the larger one's token is looked up among the smaller ones whose
token comes early enough for a link, within a class and the next one. Pairs with too few tokens after the
shared one are left out, and those that the triangle inequality of the Jaccard distance over a common leader
rules out. All links between different components are thus found, and components are exact.

A pair is first compared by sketches: bit vectors, about as long as the set, of the parity of the elements
that fall on each bit. The bits in which two sketches differ are at most the symmetric difference, so most pairs
without a link are settled by some 60 bytes each. Sets are made again and intersected for the others only.

Tokens of very many documents are known from the counts (for a subset, its rarest element's). Their lists are split
by salts of about ``HOT`` members, each with leaders of its own, which are then compared with the token's. Joins
that meet leaders, tokens or centres of components read written tables on both sides, so that Spark can split them.

Hashes have 64 bits. Sets with one digest are told apart by a second digest, which then takes its place: 128 bits in all.
Null or empty texts have no set, link with nothing and are their own component.
A null id takes part, but a component's id is its smallest non-null id (null if it has none). Repeated
rows are copies of each other. Other columns pass through whatever their names, but ``n_shingles`` and
``component_id`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .spark_io import bloom_blocks, bloom_mark, discard, materialize
from .words import SLOTS, chunks, frugal, mix, spaces_table, windows, words

SHINGLE = 5
PERCENT = 75
#: Largest boundary considered.
MAX_BOUNDARY = 12
#: Token counts: shingles a counting group, shingles a task holds before it writes, fewest documents of a
#: token to be ordered by its count, and most tokens so ordered (8 bytes each are broadcast).
GROUP, HOLD, MIN_COUNT, MAX_COUNTED = 2_000_000, 1_000_000, 4, 1 << 19
#: Members of a token's list, about, from which on it is split.
HOT = 512
#: Sizes of a class differ by less than this factor. Two sizes that can link (a factor of 4/3) are in one class or in neighbours.
CLASS = 1.34
#: Sets that a task remembers having written, so that copies within it are written once.
REMEMBER = 100_000

_TABLE = spaces_table(fold=True)
#: Added to the hashes of short sequences and of subsets, by their length.
_LENGTH = np.arange(64, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)


def needed(a: int, b: int) -> int:
    """Smallest intersection that links sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def partners(a: int) -> range:
    """Sizes of the sets that a set of size a can link to."""
    return range(-(-PERCENT * a // 100), 100 * a // PERCENT + 1)


def prefix_length(size: int) -> int:
    return size - -(-PERCENT * size // 100) + 1


def subset_sizes(size: int, boundary: int) -> list[int]:
    return sorted({needed(size, b) for b in partners(size) if b <= boundary})


def choose_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The boundary with the least cost: subsets written by light sets, prefix tokens of the others, each
    of which meets ``list_length`` others."""
    def cost(boundary: int) -> float:
        total = 0.0
        for size, n in sizes.items():
            if size <= boundary:
                total += n * sum(comb(size, k) for k in subset_sizes(size, boundary))
            if in_lists(size, boundary):
                total += n * prefix_length(size) * (1 + list_length)
        return total

    return min(range(MAX_BOUNDARY + 1), key=lambda b: (cost(b), b))


def in_lists(size: int, boundary: int) -> bool:
    return max(partners(size), default=0) > boundary


def shingle_sets(values: pa.Array, seed: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row), chunk by chunk."""
    for first, data, offsets in chunks(values):
        found = words(data, offsets, _TABLE)
        hashes = found.hashes() ^ np.uint64(seed)
        rolled = windows(hashes, SHINGLE)
        sets = []
        for a, b in zip(found.first.tolist(), found.first[1:].tolist(), strict=False):
            n = b - a
            if n >= SHINGLE:
                sets.append(np.unique(rolled[a : b - SHINGLE + 1]))
            elif n:
                sets.append(mix((hashes[a:b] * SLOTS[:n]).sum(keepdims=True) + _LENGTH[n]))
            else:
                sets.append(np.empty(0, np.uint64))
        yield first, sets


def digest(elements: np.ndarray, twins: frozenset[int] = frozenset(), salt: int = 0) -> int:
    """64 bits of a set; a second hash for sets whose first one, in ``twins``, another set has too."""
    found = int(mix(elements ^ np.uint64(0x5851F42D4C957F2D + salt)).sum().astype(np.int64))
    return digest(elements, frozenset(), 99) if found in twins else found


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements on 64 or more bits, a power of two not less than their number, as longs."""
    bits = max(64, 1 << (len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signatures(texts: DataFrame, seed: int) -> DataFrame:
    """The other columns with digest (null without words), check, n_shingles, and sketch (once for each set of a task)."""
    at = texts.columns.index("__text")
    rest = [i for i in range(len(texts.columns)) if i != at]
    new = [T.StructField("__digest", T.LongType()), T.StructField("__check", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("__sketch", T.ArrayType(T.LongType()))]
    schema = T.StructType([*[texts.schema.fields[i] for i in rest], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                made: list[list] = [[], [], [], []]
                for _, sets in shingle_sets(batch.column(at), seed):
                    for s in sets:
                        key = digest(s) if len(s) else None
                        made[0].append(key)
                        made[1].append(digest(s, salt=99) if len(s) else None)
                        made[2].append(len(s))
                        made[3].append(sketch(s) if len(s) and once(made[1][-1]) else None)
                made_arrays = [*[pa.array(m, pa.int64()) for m in made[:3]], pa.array(made[3], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], *made_arrays], names=[f.name for f in schema])

    return texts.mapInArrow(frugal(run), schema)


class _Once:
    """Says whether a digest is new to this task."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, key: int) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) >= REMEMBER:
            self.seen.clear()
        self.seen.add(key)
        return True


def _token_counts(texts: DataFrame, total: int, seed: int) -> DataFrame:
    """(key, n): the upper halves of shingle hashes that MIN_COUNT documents have, and how many have them.

    Tasks count what they hold and write keys for each group of ``GROUP`` shingles; a frequent key is one
    entry of a task's write, so no group grows with a key's frequency.
    """
    groups = max(1, -(-total // GROUP))
    schema = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def write(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        order = np.argsort(counts > 1, kind="stable")  # single ones need no count
        group = (keys.astype(np.uint64) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        order = order[np.argsort(group[order], kind="stable")]
        keys, counts, group = keys[order], counts[order].astype(np.uint32), group[order]
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        rows: list[list] = [[], [], []]
        for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
            many = counts[a:b]
            rows[0].append(int(group[a]))
            rows[1].append(keys[a:b].tobytes())
            rows[2].append(many[many > 1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=[f.name for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, held, n = _Once(), [], 0
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), seed):
                for s in sets:
                    if len(s) and once(digest(s)):
                        held.append((s >> np.uint64(32)).astype(np.uint32))
                        n += len(s)
                if n >= HOLD:
                    yield from write(held)
                    held, n = [], 0
        if held:
            yield from write(held)

    def count(table: pa.Table) -> pa.Table:
        keys, weights = [], []
        for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
            k, c = np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint32)
            keys.append(k)
            weights.append(np.concatenate([np.ones(len(k) - len(c), np.int64), c.astype(np.int64)]))
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        cuts = np.flatnonzero(np.diff(key.astype(np.int64), prepend=-1))
        n = np.add.reduceat(weight, cuts)
        keep = n >= MIN_COUNT
        return pa.table({"key": pa.array(key[cuts][keep].astype(np.int64)), "n": pa.array(n[keep])})

    return texts.select("__text").mapInArrow(frugal(run), schema).groupBy("group").applyInArrow(count, "key long, n long")


class TokenOrder:
    """Rare tokens first: uncounted ones by hash, then the counted by count and hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order].astype(np.uint32), counts[order].astype(np.uint32)
        self.coarse: np.ndarray | None = None

    def find(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which elements are counted, and their counts."""
        if not len(self.keys):
            return np.empty(0, np.int64), self.counts
        if self.coarse is None:  # once in each worker
            self.coarse = np.zeros(1 << 24, bool)
            self.coarse[self.keys >> np.uint32(8)] = True
        key = (elements >> np.uint64(32)).astype(np.uint32)
        maybe = np.flatnonzero(self.coarse[key >> np.uint32(8)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == key[maybe]
        return maybe[hit], self.counts[at[hit]]

    @staticmethod
    def prefix(elements: np.ndarray, length: int, counted: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens, and how many documents have them (0: not counted)."""
        free = np.ones(len(elements), bool)
        free[counted] = False
        first = elements[free][:length]
        known = np.zeros(length, np.int64)
        if len(first) == length:
            return first, known
        late = np.lexsort((elements[counted], counts))[: length - len(first)]
        known[len(first) :] = counts[late]
        return np.concatenate([first, elements[counted[late]]]), known


POSTINGS = "tok long, salt int, id long, size long, pos long, odd int"


def _postings(texts: DataFrame, order: TokenOrder, boundary: int, seed: int, twins: frozenset[int]) -> DataFrame:
    """POSTINGS: the prefix tokens of each node, with their places in its order, and its subset hashes (place 0);
    how many of 1000 of its tokens are rare; and the salt, 0 for tokens of few documents."""
    shared = texts.sparkSession.sparkContext.broadcast(order)  # MAX_COUNTED entries
    names = [f.split()[0] for f in POSTINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, ranks = _Once(), shared.value
        choices = {(n, k): np.array(list(combinations(range(n), k)), np.int64) for n in range(1, boundary + 1) for k in subset_sizes(n, boundary)}
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), seed):
                columns: list[list] = [[], [], [], [], [], []]
                for s in sets:
                    n = len(s)
                    if not n or not once(key := digest(s, twins)):
                        continue
                    own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    counted, counts = ranks.find(s)
                    if n <= boundary:
                        mixed = mix(s + np.uint64(boundary))
                        known = np.zeros(n, np.int64)
                        known[counted] = counts
                        for k in subset_sizes(n, boundary):
                            chosen = choices[n, k]
                            own.append((mix(mixed[chosen].sum(axis=1) + _LENGTH[k]), known[chosen].min(axis=1), np.zeros(len(chosen), np.int64)))
                    if in_lists(n, boundary):
                        tokens, known = ranks.prefix(s, prefix_length(n), counted, counts)
                        own.append((tokens, known, np.arange(len(tokens))))
                    for tokens, known, places in own:
                        parts = known // HOT
                        lot = np.uint64(key & (1 << 64) - 1) >> np.uint64(8)
                        columns[0].append(tokens.view(np.int64))
                        columns[1].append(np.where(parts > 0, 1 + lot.astype(np.int64) % (parts + 1), 0).astype(np.int32))
                        columns[2].append(np.full(len(tokens), key, np.int64))
                        columns[3].append(np.full(len(tokens), n, np.int64))
                        columns[4].append(places)
                        columns[5].append(np.full(len(tokens), 1000 * (n - len(counted)) // n, np.int32))
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    return texts.select("__text").mapInArrow(frugal(run), POSTINGS)


def _comparable(a: str, b: str) -> F.Column:
    """Sizes that allow a link."""
    return F.greatest(a, b) * PERCENT <= F.least(a, b) * 100


def _reachable(a: str, a_pos: str, b: str, b_pos: str) -> F.Column:
    """Whether the tokens from a shared one on are enough for a link; true at the first token that a pair shares."""
    rest = F.least(F.col(a) - F.col(a_pos), F.col(b) - F.col(b_pos))
    return rest * (100 + PERCENT) >= (F.col(a) + F.col(b)) * PERCENT


def _linked(difference: F.Column, a: str, b: str) -> F.Column:
    """Whether a symmetric difference allows a link: at most the share 1 - 2 PERCENT / (100 + PERCENT) of both sizes."""
    return difference * (100 + PERCENT) <= (F.col(a) + F.col(b)) * (100 - PERCENT)


def _distance(difference: F.Column, a: str, b: str) -> F.Column:
    return 2 * difference / (F.col(a) + F.col(b) + difference)


def _folded(longs: F.Column) -> F.Column:
    """A sketch on half the bits."""
    half = (F.size(longs) / 2).cast("int")
    return F.zip_with(F.slice(longs, F.lit(1), half), F.slice(longs, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def sketch_difference(x: F.Column, y: F.Column) -> F.Column:
    """Differing bits of two sketches, whose sizes are equal or differ by a factor of two."""
    x, y = F.when(F.size(x) > F.size(y), _folded(x)).otherwise(x), F.when(F.size(y) > F.size(x), _folded(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k).cast("long")


def _sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``apart``, a lower bound of the symmetric difference, to pairs (a, a_size, b, b_size)."""
    left = nodes.select(F.col("digest").alias("a"), F.col("sketch").alias("x"))
    right = nodes.select(F.col("digest").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "a_size", "b", "b_size", sketch_difference(F.col("x"), F.col("y")).alias("apart"))


def _intersected(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, seed: int, twins: frozenset[int]) -> DataFrame:
    """Add ``apart``, the symmetric difference, to pairs (a, a_size, b, b_size).

    Sets are made again from those texts only that a bounded Bloom filter lets through.
    """
    ends = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    keys = materialize(nodes.join(ends, "digest", "left_semi").select("text_key"), "jaccard-keys")
    table, blocks = bloom_blocks(keys, "text_key", keys.count())
    some = bloom_mark(texts.withColumn("__key", F.xxhash64("__text")), "__key", table, blocks, "__maybe").filter("__maybe").select("__text")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("elements", T.BinaryType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), seed):
                rows = [(key, s.tobytes()) for s in sets if len(s) and once(key := digest(s, twins))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "elements"])

    made = some.mapInArrow(frugal(make), schema).join(ends.withColumnRenamed("digest", "id"), "id", "left_semi")
    sets = materialize(made.groupBy("id").agg(F.first("elements").alias("elements")), "jaccard-sets")
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    both = pairs.select("a", "a_size", "b", "b_size").join(left, "a").join(right, "b").select("a", "a_size", "b", "b_size", "x", "y")
    out = T.StructType([*[both.schema[c] for c in ("a", "a_size", "b", "b_size")], T.StructField("apart", T.LongType())])

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                found.append(len(p) + len(q) - 2 * int((q[at] == p).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.int64())], names=[f.name for f in out])

    exact = materialize(both.mapInArrow(frugal(intersect), out), "jaccard-exact")
    for spent in (keys, sets):
        discard(spent)
    return exact


def _lists(postings: DataFrame) -> DataFrame:
    """POSTINGS of lists with several members (and of split ones), each node once, with their size class ``g`` and
    the ``leader`` of that class: id, size, pos."""
    by_list = Window.partitionBy("tok", "salt").orderBy("g", "odd", "id")
    by_class = Window.partitionBy("tok", "salt", "g").orderBy("odd", "id")  # the same sort serves both
    first = lambda c, w: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = postings.withColumn("g", F.floor(F.log("size") / float(np.log(CLASS))).cast("int"))
    rows = rows.select("*", F.lead("id").over(by_list).alias("next"), first("id", by_list).alias("head"), *[first(c, by_class).alias(f"leader_{c}") for c in ("id", "size", "pos")])
    last_copy = F.col("next").isNull() | (F.col("next") != F.col("id"))
    several = (F.col("head") != F.col("id")) | F.col("next").isNotNull() | (F.col("salt") > 0)
    return rows.filter(last_copy & several).drop("next", "head").withColumnsRenamed({c: f"own_{c}" for c in ("id", "size", "pos")})


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of nodes (columns ``a``_id, _size, _pos) that could link."""
    could = (F.col(f"{a}id") != F.col(f"{b}id")) & _comparable(f"{a}size", f"{b}size") & _reachable(f"{a}size", f"{a}pos", f"{b}size", f"{b}pos")
    return rows.filter(could).select(F.col(f"{a}id").alias("a"), F.col(f"{a}size").alias("a_size"), F.col(f"{b}id").alias("b"), F.col(f"{b}size").alias("b_size"))


def _early(size: str, pos: str) -> F.Column:
    """Whether a link with a set of at least this size can begin at this place."""
    return _reachable(size, pos, size, pos)


def _classes(texts: DataFrame, nodes: DataFrame, order: TokenOrder, boundary: int, seed: int, twins: frozenset[int]) -> DataFrame:
    """(digest, comp) of all nodes that have a link."""
    lists = materialize(_lists(_postings(texts, order, boundary, seed, twins)), "jaccard-lists")
    heads = lists.filter(F.col("own_id") == F.col("leader_id"))
    top = heads.groupBy("tok", "g").agg(F.min(F.struct("odd", "own_id", "own_size", "own_pos")).alias("t"))
    tops = materialize(top.select("tok", "g", *[F.col(f"t.own_{c}").alias(f"top_{c}") for c in ("id", "size", "pos")]), "jaccard-tops")
    guests = lists.filter(_early("own_size", "own_pos")).select("tok", (F.col("g") + 1).alias("g"), "own_id", "own_size", "own_pos").join(tops, ["tok", "g"])
    stars = _pairs(lists, "own_", "leader_").unionByName(_pairs(heads.filter("salt > 0").join(tops, ["tok", "g"]), "own_", "top_")).unionByName(_pairs(guests, "own_", "top_"))
    sketched = materialize(_sketched(stars.distinct(), nodes), "jaccard-sketched")
    maybe = _linked(F.col("apart"), "a_size", "b_size")
    exact = _intersected(sketched.filter(maybe), texts, nodes, seed, twins)
    first = connected_components(exact.filter(maybe), "a", "b").select(F.col("node").alias("id"), F.col("component").alias("comp"))
    first = materialize(first, "jaccard-first")

    far = sketched.filter(~maybe).select(F.col("a").alias("own_id"), F.col("b").alias("with"), _distance(F.col("apart"), "a_size", "b_size").alias("lo"), F.lit(1.0).alias("hi"))
    known = _distance(F.col("apart"), "a_size", "b_size")
    measured = exact.select(F.col("a").alias("own_id"), F.col("b").alias("with"), known.alias("lo"), known.alias("hi")).unionByName(far)
    probing = (F.col("own_id") != F.col("leader_id")) | (F.col("salt") > 0)
    inside = lists.filter(probing).select("tok", "g", "own_id", "own_size", "own_pos", F.col("leader_id").alias("with"), F.lit(True).alias("home"))
    members = inside.unionByName(guests.select("tok", "g", "own_id", "own_size", "own_pos", F.col("top_id").alias("with"), F.lit(False).alias("home")))
    members = members.join(first.withColumnRenamed("id", "own_id"), "own_id", "left").withColumn("comp", F.coalesce("comp", "own_id"))
    members = materialize(members, "jaccard-members")
    several = members.groupBy("tok", "g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("home").alias("some")).filter("lo != hi and some").select("tok", "g")
    several = materialize(several, "jaccard-several")
    mixed = materialize(members.join(several, ["tok", "g"]).join(measured, ["own_id", "with"], "left").fillna({"lo": 0.0, "hi": 1.0}), "jaccard-mixed")
    x = mixed.filter("home").select("tok", "g", *[F.col(f"own_{c}").alias(f"a_{c}") for c in ("id", "size", "pos")], F.col("comp").alias("a_comp"), F.col("with").alias("a_with"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    y = mixed.filter(_early("own_size", "own_pos")).select("tok", "g", *[F.col(f"own_{c}").alias(f"b_{c}") for c in ("id", "size", "pos")], F.col("comp").alias("b_comp"), F.col("with").alias("b_with"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    larger = (F.col("a_size") > F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_id") > F.col("b_id")))
    reach = 1 - PERCENT / 100 + 1e-9
    near = (F.col("a_with") != F.col("b_with")) | ((F.col("a_lo") - F.col("b_hi") <= reach) & (F.col("b_lo") - F.col("a_hi") <= reach))
    cross = x.join(y, ["tok", "g"]).filter(larger & (F.col("a_comp") != F.col("b_comp")) & _comparable("a_size", "b_size") & _reachable("a_size", "a_pos", "b_size", "b_pos") & near)
    cross = cross.select(F.col("a_id").alias("a"), "a_size", F.col("b_id").alias("b"), "b_size").distinct()
    cross = materialize(_sketched(cross, nodes).filter(maybe), "jaccard-cross")
    links = cross if cross.isEmpty() else _intersected(cross, texts, nodes, seed, twins).filter(maybe)
    comp_of = lambda c: first.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))
    joined = links.join(comp_of("a"), "a", "left").join(comp_of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("u"), F.coalesce("b_comp", "b").alias("v"))
    second = materialize(connected_components(joined, "u", "v").select(F.col("node").alias("comp"), F.col("component").alias("joined")), "jaccard-second")
    labels = first.join(second, "comp", "left").select(F.col("id").alias("digest"), F.coalesce("joined", "comp").alias("comp"))
    alone = second.select(F.col("comp").alias("digest"), F.col("joined").alias("comp")).join(first.select(F.col("id").alias("digest")), "digest", "left_anti")
    found = materialize(labels.unionByName(alone), "jaccard-labels")
    for spent in (lists, tops, sketched, exact, members, several, mixed, cross):
        discard(spent)
    return found


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` without its text, with n_shingles and component_id (of the type of ``id_col``)."""
    docs = docs.drop("n_shingles", "component_id")
    places = list(range(len(docs.columns)))
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    texts = docs.toDF(*[f"__c{i}" for i in places]).withColumnRenamed(f"__c{text_at}", "__text")
    signed = materialize(_signatures(texts.withColumn("__key", F.xxhash64("__text")), seed), "jaccard-rows")
    id_name = f"__c{id_at}"
    same = signed.filter(F.col("__digest").isNotNull()).groupBy("__digest").agg(F.min("__check").alias("c0"), F.max("__check").alias("c1"))
    twins = frozenset(r[0] for r in same.filter("c0 != c1").select("__digest").collect())  # about 3 among 10^10 sets
    key = F.col("__digest")
    if twins:
        key = F.when(key.isin(list(twins)), F.col("__check")).otherwise(key)
    signed = signed.withColumn("__digest", key)
    nodes = materialize(
        signed.filter(F.col("__digest").isNotNull())
        .groupBy(F.col("__digest").alias("digest"))
        .agg(F.min(id_name).alias("first_id"), F.min("__key").alias("text_key"), F.max("n_shingles").alias("n"), F.max("__sketch").alias("sketch")),
        "jaccard-nodes",
    )
    sizes = {r.n: r.k for r in nodes.groupBy(F.least("n", F.lit(2 * MAX_BOUNDARY)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()}
    total = nodes.agg(F.sum("n")).first()[0] or 0

    counts = materialize(_token_counts(texts, total, seed), "jaccard-counts")
    levels = sorted((r.level, r.k, r.s) for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")).collect())
    least, kept = None, 0
    for level, k, _ in reversed(levels):
        if kept + k > MAX_COUNTED:
            break
        least, kept = level, kept + k
    chosen = counts.filter(F.floor(F.log2("n")) >= least if least is not None else F.lit(False)).toArrow()  # MAX_COUNTED rows at most
    order = TokenOrder(chosen.column("key").to_numpy(), chosen.column("n").to_numpy())
    boundary = choose_boundary(sizes, sum(s for _, _, s in levels) / max(total, 1))
    discard(counts)

    labels = _classes(texts, nodes, order, boundary, seed, twins)
    grouped = nodes.select("digest", "first_id").join(labels, "digest")
    least_id = materialize(grouped.groupBy("comp").agg(F.min("first_id").alias("__component")), "jaccard-least")
    linked = labels.join(least_id, "comp").select("digest", "__component")
    classes = nodes.select("digest", "first_id").join(linked, "digest", "left").select(F.col("digest").alias("__digest"), F.coalesce("__component", "first_id").alias("__component"))
    classes = materialize(classes, "jaccard-classes")
    for spent in (nodes, labels, least_id):
        discard(spent)
    result = [F.col(f"__c{i}").alias(docs.columns[i]) for i in places if i != text_at]
    some = signed.filter(F.col("__digest").isNotNull()).join(classes, "__digest").select(*result, "n_shingles", F.col("__component").alias("component_id"))
    none = signed.filter(F.col("__digest").isNull()).select(*result, "n_shingles", F.col(id_name).alias("component_id"))
    return some.unionByName(none)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_documents(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), pairs AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.rid < y.rid GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * o >= 75 * (p.n + q.n - o)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rid AS a, rid AS b FROM d
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), least AS (
  SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN least USING (rid)
"""
