"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets count as one. In ``TREES``
independent trees every set follows ``PATHS`` chosen minwise tokens to the first
nodes; two sets with similarity s share a node at each path with chance s, so at
0.8 a pair is missed by all eight paths about 3 times in a million.

A node of at most ``NODE`` sets is compared exhaustively: first by sketches of
``SKETCH`` minwise values, which cuts off pairs far below the threshold (at 0.8
some 1 in 10 000 falls below), then by the full sets. A larger node is compared
with one of its sets, the pivot: what is linked to it is settled, unless a set
outside could be linked to it but not to the pivot (triangle inequality of the
Jaccard distance). What is left follows ``PATHS`` further chosen tokens to
smaller nodes. Nodes still large after ``DEPTH`` levels are compared in blocks.

Inside a node links form a spanning forest, so copies are not expanded into all
pairs. Components of all links are found by alternating stars. Rows of nodes and
components are joined to one row for each key, in joins whose larger side adaptive
execution splits where a key is hot; the members of a large node meet copies of
their pivot, ``PER_PIVOT`` members to a copy.

Texts are dealt into buckets once. What needs some of them later, at any level, joins
their keys to the buckets and leaves the texts where they lie.

Defined results
    null or empty text    empty set, n_shingles 0, linked with nothing, kept
    fewer words           the whole sequence is the one shingle
    equal sets            linked, whatever the texts
    null doc_id           linked like any other; smallest doc_id ignores it, and where
                          all rows of a component have none, component_id is null and
                          all are kept
    repeated doc_id       each row by its own text; kept if its doc_id is the smallest
    empty table           no rows
    further columns       not read by ``near_duplicates``; passed on by ``drop_near_copies``
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import cut, groups, mix, scratch_dir, shingles, slices, utf8, word_hashes
from trustlake.llm.components import components

SHINGLE = 5
PERCENT = 80
TREES = 4
PATHS = 2
SKETCH = 128
# Sketch values that must agree at a threshold of 0.8: four and a half deviations below it.
AGREE = 82
NODE = 4096
DEPTH = 12
# Shingles that one comparison of full sets holds.
BLOCK = 2_000_000
# Members of a large node that share one copy of its pivot.
PER_PIVOT = 1000
# Cells of the dense matrix in which a group of sets is compared.
MATRIX = 16_000_000

_RANDOM = np.random.default_rng(77)
_ROOT_KEYS = _RANDOM.integers(1, 1 << 63, TREES * PATHS, np.uint64)
_XOR = _RANDOM.integers(0, 1 << 32, SKETCH, np.uint64).astype(np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, SKETCH, np.uint64).astype(np.uint32) | np.uint32(1)


def _sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    return shingles(*word_hashes(*utf8(part.column("text"))), size)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(size: int) -> Callable[[Iterator], Iterator]:
    """For each document the size and digest of its set, first nodes and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = _sets(part, size)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            digests = [_digest(s) if len(s) else None for s in sets]
            roots = np.zeros((len(sets), len(_ROOT_KEYS)), np.uint64)
            sketch = np.zeros((len(sets), SKETCH), np.uint16)
            if len(full):
                tokens = np.concatenate(sets)
                at = (np.cumsum(n) - n)[full]
                for k, key in enumerate(_ROOT_KEYS):
                    least = np.minimum.reduceat(mix(tokens ^ key), at)
                    roots[full, k] = mix(least + np.uint64(k))
                short = (tokens >> np.uint64(32)).astype(np.uint32)
                for k in range(SKETCH):
                    x = (short ^ _XOR[k]) * _TIMES[k]
                    x ^= x >> np.uint32(15)
                    sketch[full, k] = (np.minimum.reduceat(x, at) & 0xFFFF).astype(np.uint16)
            flat = pa.array(roots.view(np.int64).ravel())
            steps = np.arange(len(sets) + 1, dtype=np.int32) * len(_ROOT_KEYS)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("mark"),
                    pa.array(n, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(steps), flat),
                    pa.array([r.tobytes() for r in sketch], pa.binary()),
                ],
                ["doc_id", "mark", "n", "digest", "roots", "sketch"],
            )

    return run


def _candidates(agree: int) -> Callable[[Iterator], Iterator]:
    """Splits each node into sets whose sketches are connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups_out, digests_out = [], []
        for node in groups(batches, "node"):
            digest = node.column("digest").to_pylist()
            sketch = np.frombuffer(b"".join(node.column("sketch").to_pylist()), np.uint16)
            sketch = sketch.reshape(len(digest), SKETCH)
            n = node.column("n").to_numpy()
            for found in _connected(
                len(digest), lambda i, rest, s=sketch: (s[rest] == s[i]).sum(axis=1) >= agree
            ):
                members = sorted({digest[i]: n[i] for i in found[0]}.items())
                for block in _blocks(members):
                    key = hashlib.blake2b(b"".join(block), digest_size=8).digest()
                    groups_out += [int.from_bytes(key, "little", signed=True)] * len(block)
                    digests_out += block
            if len(groups_out) > 20_000:
                yield _pairs_batch(groups_out, digests_out)
                groups_out, digests_out = [], []
        yield _pairs_batch(groups_out, digests_out)

    return run


def _pairs_batch(group: list[int], digest: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(group, pa.int64()), pa.array(digest, pa.binary())], ["group", "digest"]
    )


def _blocks(members: list[tuple[bytes, int]]) -> Iterator[list[bytes]]:
    """All members together, or, if their sets are too large, each pair of blocks."""
    blocks: list[list[bytes]] = [[]]
    held = 0
    for digest, n in members:
        if held + n > BLOCK and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append(digest)
        held += n
    if len(blocks) == 1 and len(members) > 1:
        yield blocks[0]
    for i, a in enumerate(blocks):
        for b in blocks[i + 1 :]:
            yield a + b


def _connected(
    n: int, linked: Callable[[int, np.ndarray], np.ndarray]
) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
    """Components of two or more, and a spanning tree of each.

    Each member is compared with those that are in no component yet.
    """
    rest = np.arange(n)
    while len(rest) > 1:
        found, tree, todo = [int(rest[0])], [], [int(rest[0])]
        rest = rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = linked(i, rest)
            new = rest[hit].tolist()
            rest = rest[~hit]
            tree += [(i, j) for j in new]
            found += new
            todo += new
        if tree:
            yield found, tree


def _similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _links(percent: int) -> Callable[[Iterator], Iterator]:
    """A spanning forest of the links in each group, by full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "group"):
            digest = group.column("digest").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
            compare = _comparer(sets, percent)
            edges = [e for _, tree in _connected(len(sets), compare) for e in tree]
            if edges:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest[e[k]] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"]
                )

    return run


def _comparer(sets: list[np.ndarray], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    tokens, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # what only one set has is in no intersection
    owner, column = owner[shared], column[shared]
    width = int((count > 1).sum())
    if len(sets) * width <= MATRIX:
        place_of = np.cumsum(count > 1) - 1
        matrix = np.zeros((len(sets), max(1, width)), np.float32)
        matrix[owner, place_of[column]] = 1

        def common(i: int, rest: np.ndarray) -> np.ndarray:
            return np.rint(matrix[rest] @ matrix[i]).astype(np.int64)

    else:
        start = np.searchsorted(owner, np.arange(len(sets) + 1))
        inside = np.zeros(len(tokens), bool)

        def common(i: int, rest: np.ndarray) -> np.ndarray:
            own = column[start[i] : start[i + 1]]
            inside[own] = True
            sums = np.concatenate(([0], np.cumsum(inside[column])))
            inside[own] = False
            return sums[start[rest + 1]] - sums[start[rest]]

    return lambda i, rest: _similar(common(i, rest), n[i], n[rest], percent)


def _to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the intersection and union of each set with its pivot."""
    for batch in batches:
        common, union = [], []
        held, key = np.zeros(0, np.uint64), None
        columns = (batch.column(c) for c in ("pivot", "tokens", "pivot_tokens"))
        for pivot, tokens, whole in zip(*columns, strict=True):
            if pivot != key:
                key, held = pivot, np.frombuffer(whole.as_buffer(), np.uint64)
            s = np.frombuffer(tokens.as_buffer(), np.uint64)
            both = len(np.intersect1d(s, held, assume_unique=True))
            common.append(both)
            union.append(len(s) + len(held) - both)
        names = ["node", "digest", "pivot"]
        yield pa.RecordBatch.from_arrays(
            [*batch.select(names).columns, pa.array(common, pa.int64()), pa.array(union, pa.int64())],
            [*names, "common", "total"],
        )


def _key(doc_id: Column | str, mark: Column | str) -> Column:
    """Never null, and spread also where doc_id is null or repeated."""
    return F.xxhash64(doc_id, mark)


class _Texts:
    """Documents in buckets by ``_key``, with ``doc_id`` as a long number and ``mark``."""

    def __init__(self, docs: DataFrame):
        spark, names = docs.sparkSession, [f"c{i}" for i in range(len(docs.columns))]
        self.names = dict(zip(docs.columns, names, strict=True))
        self.mark, parts = F.xxhash64(self.names["text"]), _parts(docs)
        self.doc_id = F.col(self.names["doc_id"]).cast("long")
        table = f"near_dup_{uuid.uuid4().hex}"
        (
            docs.toDF(*names).withColumn("key", _key(self.doc_id, self.mark)).repartition(parts, "key")
            .write.format("parquet").bucketBy(parts, "key")
            .option("path", scratch_dir(spark, "texts")).saveAsTable(table)
        )
        self.table = spark.table(table)

    def narrow(self) -> DataFrame:
        return self.table.select(
            "key", self.doc_id.alias("doc_id"), F.col(self.names["text"]).alias("text"), self.mark.alias("mark")
        )

    def without(self, gone: DataFrame) -> DataFrame:
        """The documents, as they came, but those in ``gone`` (doc_id, mark)."""
        keys = gone.select(_key("doc_id", "mark").alias("gone_key"), F.struct("doc_id", "mark").alias("gone"))
        # Not an equality, so that the key alone deals the rows, as the buckets are.
        same = F.struct(self.doc_id, self.mark).between(F.col("gone"), F.col("gone"))
        left = self.table.join(
            keys.hint("shuffle_hash"), (F.col("key") == F.col("gone_key")) & same, "left_anti"
        )
        return left.select(*[F.col(n).alias(c) for c, n in self.names.items()])


class _Join:
    def __init__(self, texts: _Texts, size: int, percent: int):
        self.size, self.percent = size, percent
        self.agree = AGREE if percent == 80 else max(0, int(SKETCH * percent / 100 - 4.5 * (SKETCH * 0.25) ** 0.5))
        self.docs = texts.narrow()
        self.rows = cut(
            self.docs.drop("key").mapInArrow(
                _sketch(size),
                "doc_id long, mark long, n long, digest binary, roots array<long>, sketch binary",
            ),
            "sketches",
        )
        self.sets = cut(
            self.rows.where("n > 0").groupBy("digest", "n", "roots", "sketch")
            .agg(F.min("doc_id").alias("rep"), F.min(_key("doc_id", "mark")).alias("at")),
            "sets",
        )

    def tokens(self, digests: DataFrame) -> DataFrame:
        """``digest, tokens`` for the given digests, each from the text of one document."""
        wanted = self.sets.join(digests.distinct(), "digest", "left_semi").select(
            F.col("at").alias("key"), F.col("digest").alias("want")
        )
        texts = self.docs.select("key", "text").join(wanted.hint("shuffle_hash"), "key").select("text", "want")
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                sets = _sets(part, size)
                keep = [
                    (w, s.tobytes())
                    for w, s in zip(part.column("want").to_pylist(), sets, strict=True)
                    if len(s) and _digest(s) == w
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in keep], pa.binary()) for k in (0, 1)], ["digest", "tokens"]
                )

        return texts.mapInArrow(run, "digest binary, tokens binary")

    def nodes(self, members: DataFrame) -> DataFrame:
        """``node, digest, size`` of nodes with two members or more."""
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return cut(members.join(sizes, "node"), "nodes")

    def candidates(self, nodes: DataFrame) -> DataFrame:
        """``group, digest``: sets of small nodes whose sketches are connected."""
        known = self.sets.select("digest", "n", "sketch")
        rows = nodes.select("node", "digest").join(known, "digest")
        rows = rows.repartition(_parts(rows), "node").sortWithinPartitions("node")
        return rows.mapInArrow(_candidates(self.agree), "group long, digest binary").distinct()

    def compare(self, found: DataFrame) -> DataFrame:
        """Links in groups of candidates, by full sets."""
        rows = found.join(self.tokens(found.select("digest")), "digest")
        rows = rows.repartition(_parts(rows), "group").sortWithinPartitions("group")
        return rows.mapInArrow(_links(self.percent), "a binary, b binary")

    def pivots(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links to the pivot of each large node, and what the pivot does not settle."""
        sets = cut(self.tokens(large.select("digest")), "tokens")
        parts = F.ceil(F.col("size") / PER_PIVOT).cast("long")
        dealt = large.withColumn("deal", F.pmod(F.xxhash64("digest", "node"), parts))
        pivots = (
            large.groupBy("node").agg(F.min("digest").alias("pivot"), F.max("size").alias("size"))
            .join(sets.toDF("pivot", "pivot_tokens"), "pivot")
            .withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
            .drop("size")
        )
        rows = dealt.join(sets, "digest").join(pivots, ["node", "deal"])
        near = cut(
            rows.select("node", "digest", "pivot", "tokens", "pivot_tokens")
            .mapInArrow(_to_pivot, "node long, digest binary, pivot binary, common long, total long")
            .withColumn("linked", 100 * F.col("common") >= self.percent * F.col("total"))
            .withColumn("far", 1 - F.col("common") / F.col("total")),
            "pivots",
        )
        links = near.where("linked and digest <> pivot").select(
            F.col("digest").alias("a"), F.col("pivot").alias("b")
        )
        reach = 1 - self.percent / 100
        edge = near.groupBy("node").agg(
            F.min(F.when(~F.col("linked"), F.col("far"))).alias("nearest")
        )
        open_ = F.col("far") >= F.col("nearest") - reach - 1e-9
        left = near.join(edge, "node").where(
            (F.col("digest") != F.col("pivot")) & (~F.col("linked") | F.coalesce(open_, F.lit(False)))
        )
        return links, left.select("node", "digest")

    def branch(self, rows: DataFrame, level: int) -> DataFrame:
        """Members of the nodes below, by further chosen tokens of each node."""
        first = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(SKETCH))
        second = F.pmod(
            first + 1 + F.pmod(F.xxhash64("node", F.lit(-level)), F.lit(SKETCH - 1)), F.lit(SKETCH)
        )

        def child(k: Column) -> Column:
            value = F.substr("sketch", (2 * k + 1).cast("int"), F.lit(2))
            return F.xxhash64("node", F.lit(level), k, value)

        known = self.sets.select("digest", "sketch")
        return rows.join(known, "digest").select(
            F.explode(F.array(child(first), child(second))).alias("node"), "digest"
        )

    def blocks(self, large: DataFrame) -> DataFrame:
        """Large nodes as pairs of blocks, each a node that can be compared."""
        parts = F.ceil(F.col("size") / (NODE // 2)).cast("long")
        own = F.pmod(F.xxhash64("digest"), parts)
        other = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        return large.select("node", "digest", own.alias("own"), other.alias("other")).select(
            F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"),
            "digest",
        )

    def links(self) -> DataFrame:
        """``a, b``: digests of sets that are linked; enough for all components."""
        nodes = self.nodes(self.sets.select(F.explode("roots").alias("node"), "digest"))
        found, out = [], []
        for level in range(1, DEPTH + 1):
            found.append(self.candidates(nodes.where(F.col("size") <= NODE)))
            large = nodes.where(F.col("size") > NODE)
            if large.isEmpty():
                break
            settled, left = self.pivots(large)
            out.append(settled)
            nodes = self.nodes(self.branch(left, level))
        else:
            found.append(self.candidates(nodes.where(F.col("size") <= NODE)))
            found.append(self.candidates(self.blocks(nodes.where(F.col("size") > NODE))))
        together = found[0]
        for more in found[1:]:
            together = together.unionAll(more)
        out.append(self.compare(cut(together.distinct(), "candidates")))
        links = out[0]
        for more in out[1:]:
            links = links.unionAll(more)
        return links


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each document: ``doc_id, mark, n_shingles, component_id, kept``.

    ``mark`` is a hash of the text, which tells rows with equal doc_id apart.
    """
    return _components(_Texts(docs.select("doc_id", "text")), size, percent)


def _components(texts: _Texts, size: int, percent: int) -> DataFrame:
    join = _Join(texts, size, percent)
    roots = components(join.links())
    reps = cut(
        join.sets.select("digest", "rep").join(roots.toDF("digest", "root"), "digest", "left")
        .select("digest", "rep", F.coalesce("root", "digest").alias("root")),
        "roots",
    )
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    settled = cut(reps.join(least, "root").select("digest", "component_id"), "settled")
    rows = join.rows.select("doc_id", "mark", F.col("n").alias("n_shingles"), "digest")
    linked = rows.where("n_shingles > 0").join(settled, "digest")
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select(
        "doc_id", "mark", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns.

    Only the keys of dropped rows are joined to the texts, in their buckets.
    """
    texts = _Texts(docs)
    gone = _components(texts, size, percent).where("not kept")
    return texts.without(cut(gone.select("doc_id", "mark").distinct(), "gone"))
