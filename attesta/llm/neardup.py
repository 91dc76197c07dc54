"""MinHash near-duplicates with tensored banding and exact verification.

Two small collections of 16 keys, each of two MinHash values, are made from 64 hash functions. The 256 tables are their
pairs: texts meet in table (i, j) if key i of the first and key j of the second collection agree. Making the tables'
512 pairs of values one by one would take sixteen times as many hash functions. A table key is formed in two steps: texts
are dealt to buckets by the first key, and those of a bucket that isn't alone to cells by the second, inside the task. Only
texts of one cell are compared; hot buckets go by families of near copies, whose sets are compared whole, and by their
rarest shingles instead, which loses no link at all. A pair at the threshold of 0.8 fails to
meet with probability 2 * 0.36**16 = 1.6e-7; pairs whose 64 values agree in fewer than 33 places are not verified (at 0.8
that has a probability below 1e-6). Links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Rolling, binaries, hash_words, mix, pick, shuffle_partitions, staged, text_bytes, trim
from attesta.llm.components import components

KEYS, WIDTH = 16, 2
N_HASHES = 2 * KEYS * WIDTH
LEAST_AGREEING = 33
#: A bucket or cell of more texts, or with more shingles in their sets, is hot; a task compares about so many.
BLOCK, BLOCK_HASHES = 256, 1_000_000
#: Texts of hot buckets that are so similar (percent) to one that leads them are a family, of which a task compares about
#: so many texts, with so many shingles in their sets, with as many others.
ALIKE, CROWD, CROWD_HASHES = 50, 1024, 1_000_000
#: Shingles of at most so many of the sets that are compared whole are counted pair by pair, others as columns of a matrix.
PAIRED, COLUMNS = 16, 1024
#: Shingles that more than one in so many (and more than so few) of the open texts' shingles are, are frequent; there are
#: at most so many.
COMMON, COMMON_LEAST = 100_000, 8
#: Texts of a bucket whose second keys are compared at once.
FEW = 48
_SEED = np.arange(1, N_HASHES + 1, dtype=np.uint64)
MULTIPLY, ADD = mix(_SEED * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(_SEED * np.uint64(0xD1B54A32D192ED03))


def shingle_hashes(text: bytes | None, words_each: int, rolling: Rolling) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of an A-Z-lower-cased text."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = min(len(words), words_each)
    return np.unique(rolling.windows(hash_words(words), n) ^ np.uint64(words_each - n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """64 MinHash values of 32 bits."""
    least = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[i : i + 4096, None] * MULTIPLY + ADD) >> np.uint64(32)).min(axis=0).astype(np.uint32), out=least)
    return least


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.sha256(hashes.tobytes()).digest()[:16]


def _sketches(words_each: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(0x9E3779B97F4A7C15 | 3)
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in text_bytes(batch.column("text")):
                h = shingle_hashes(text, words_each, rolling)
                n.append(len(h))
                keys.append(set_key(h) if len(h) else None)
                sigs.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)
        trim()

    return run


def _sets(words_each: int):
    """The full set of each wanted row whose text has the wanted key (ids may repeat)."""
    schema = pa.schema([("key", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(0x9E3779B97F4A7C15 | 3)
        for batch in batches:
            keys, sets = [], []
            for key, text in zip(batch.column("key").to_pylist(), text_bytes(batch.column("text")), strict=True):
                h = shingle_hashes(text, words_each, rolling)
                if len(h) and set_key(h) == key:
                    keys.append(key)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _cells(second: np.ndarray) -> np.ndarray:
    """Which of some texts of a bucket share a cell: agree on a key of the second collection."""
    if len(second) <= FEW:
        return (second[:, None, :] == second[None, :, :]).any(2)
    met = np.zeros((len(second), len(second)), bool)
    for j in range(second.shape[1]):
        order = np.argsort(second[:, j], kind="stable")
        key = second[order, j]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                met[np.ix_(order[a:b], order[a:b])] = True
    return met


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each group to compare, sorted as they come."""
    rows: list[tuple] = []
    group = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[: len(GROUP)] != group:
                if len(rows) > 1:
                    yield rows
                group, rows = row[: len(GROUP)], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


#: A bucket, or the texts with one of their rarest shingles in common (i is -1), and a pair of blocks of it.
GROUP = ("i", "a", "x", "y")
BLOCK_ROW = (*GROUP, "key", "n", "sig", "label", "family", "block")
KEY, LABEL = BLOCK_ROW.index("key"), BLOCK_ROW.index("label")
BLOCK_DDL = "i int, a binary, x int, y int, key binary, n long, sig binary, label binary, family binary, block int"
BLOCK_SCHEMA = pa.schema([(c, pa.int64() if c == "n" else pa.binary() if c in ("key", "sig", "label", "family", "a") else pa.int32()) for c in BLOCK_ROW])


def _apart(rows: list[tuple], percent: int) -> np.ndarray | None:
    """In how many values each two texts of a group agree that meet here for the first time, may be linked by size and
    agreement, and have different labels and families; 0 for others."""
    i, _, x, y, *_ = rows[0]
    key, n, sig, label, family, block = (list(c) for c in zip(*(r[len(GROUP) : len(BLOCK_ROW)] for r in rows), strict=True))
    label = np.unique(label, return_inverse=True)[1].reshape(-1)
    if label.max() == 0:
        return None
    n, family, block = np.array(n), np.unique(family, return_inverse=True)[1].reshape(-1), np.array(block)
    sig = np.frombuffer(b"".join(sig), np.uint32).reshape(len(rows), -1)
    keys = np.ascontiguousarray(sig).view(np.uint64)
    met = np.triu(_cells(keys[:, KEYS:]) if i >= 0 else np.ones((len(rows), len(rows)), bool), 1)
    p, q = np.nonzero(met & (label[:, None] != label[None, :]) & (family[:, None] != family[None, :]))
    near = np.zeros((len(rows), len(rows)), np.uint8)
    for at in range(0, len(p), 100_000):
        a, b = p[at : at + 100_000], q[at : at + 100_000]
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        here = (100 * small >= percent * large) & ~(keys[a, : max(i, 0)] == keys[b, : max(i, 0)]).any(1)
        if x != y:
            here &= block[a] != block[b]
        a, b = a[here], b[here]
        agree = (sig[a] == sig[b]).sum(1, dtype=np.uint8)
        agree[agree < LEAST_AGREEING] = 0
        near[a, b] = near[b, a] = agree
    return near


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's sets hold each shingle."""
    for batch in batches:
        h, n = np.unique(np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])


def _rare_first(frequent, percent: int):
    """The first shingles of each set, frequent ones last: two sets of the wanted similarity have one of them in common.

    Of a set of n, the link needs at least ceil(n * percent / 100) in common, so any other number of them than the rest
    and one more can't miss all; the order is the same for all sets.
    """
    schema = pa.schema([("a", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("label", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        for batch in batches:
            keys, labels = batch.column("key").to_pylist(), batch.column("label").to_pylist()
            some, n = [], []
            for raw in batch.column("hashes").to_pylist():
                h = np.frombuffer(raw, np.uint64)
                last = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
                some.append(np.concatenate([h[~last], h[last]])[: len(h) + (-percent * len(h)) // 100 + 1])
                n.append(len(h))
            times = [len(x) for x in some]
            every = np.concatenate(some)
            columns = [pa.array(v, t).take(pa.array(np.repeat(np.arange(len(times)), times))) for v, t in ((keys, pa.binary()), (n, pa.int64()), (labels, pa.binary()))]
            yield pa.RecordBatch.from_arrays([binaries(every, np.arange(len(every) + 1)), *columns], schema=schema)

    return run


def _forest(percent: int):
    """A spanning forest of each block's candidates, rooted at the most central texts (largest sum of agreeing values),
    which are the likeliest originals of a group of near copies."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, BLOCK_ROW):
            near = _apart(rows, percent)
            if near is None:
                continue
            out, left = [], np.ones(len(rows), bool)
            central = near.sum(1, dtype=np.int64)
            for root in np.argsort(-central, kind="stable"):
                if not central[root]:
                    break
                if not left[root]:
                    continue
                left[root] = False
                todo = [root]
                while todo:
                    a = todo.pop()
                    fresh = np.flatnonzero((near[a] > 0) & left)
                    left[fresh] = False
                    out += [(rows[a][KEY], rows[b][KEY]) for b in fresh]
                    todo += fresh[np.argsort(central[fresh])].tolist()
            if out:
                yield _two(out, schema)
        trim()

    return run


def _undecided(percent: int):
    """The texts of each block that may be linked to one with another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, BLOCK_ROW):
            near = _apart(rows, percent)
            if near is not None and near.any():
                some = [r[: len(BLOCK_ROW)] for r, any_ in zip(rows, near.any(1), strict=True) if any_]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)

    return run


def _settled(percent: int):
    """Links among a block's undecided texts, each candidate compared on full sets unless already connected by others.

    Pairs stay in the task: only a forest of confirmed links leaves it.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, (*BLOCK_ROW, "hashes")):
            near = _apart(rows, percent)
            if near is None:
                continue
            size = np.array([len(r[-1]) // 8 for r in rows])
            every, place = np.unique(np.frombuffer(b"".join(r[-1] for r in rows), np.uint64), return_inverse=True)
            ends = np.cumsum(size)
            where = [place[e - s : e] for s, e in zip(size, ends, strict=True)]
            tree = np.unique([r[LABEL] for r in rows], return_inverse=True)[1].reshape(-1)
            mark, out = np.zeros(len(every), bool), []
            for a in range(len(rows) - 1):
                b = a + 1 + np.flatnonzero((near[a, a + 1 :] > 0) & (tree[a + 1 :] != tree[a]))
                if not len(b):
                    continue
                mark[where[a]] = True
                both = np.add.reduceat(mark[np.concatenate([where[k] for k in b])], np.r_[0, np.cumsum(size[b])[:-1]], dtype=np.int64)
                mark[where[a]] = False
                for k in b[100 * both >= percent * (size[a] + size[b] - both)]:
                    if tree[k] != tree[a]:
                        out.append((rows[a][KEY], rows[k][KEY]))
                        tree[tree == tree[k]] = tree[a]
            if out:
                yield _two(out, schema)
        trim()

    return run


def _in_common(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many shingles each of some sets has in common with each of others (given by their places).

    A set goes as what it adds to the shingles that most of them hold, and what it lacks of those: of near copies only
    the differences are compared.
    """
    n, size = len(sets), [len(s) for s in sets]
    every, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who, col = np.repeat(np.arange(n), size), col.reshape(-1)
    most = 2 * times > n
    held = most[col]
    lacks = np.ones((n, int(most.sum())), bool)
    lacks[who[held], (np.cumsum(most) - 1)[col[held]]] = False
    adds = ~held & (times[col] > 1)
    text, of = np.nonzero(lacks)
    who, col = np.r_[who[adds], text], np.r_[col[adds], len(every) + of]
    order = np.lexsort((who, col))
    who, col = who[order], col[order]
    starts = np.flatnonzero(np.r_[True, col[1:] != col[:-1]]) if len(col) else np.empty(0, np.int64)
    counts = np.diff(np.r_[starts, len(col)])
    few = np.repeat(counts <= PAIRED, counts)
    both = np.zeros((n, n), np.int32)
    w, c = who[few], col[few]
    for d in range(1, PAIRED):
        same = c[d:] == c[:-d]
        np.add.at(both, (w[:-d][same], w[d:][same]), 1)
    both = (both + both.T)[np.ix_(one, two)]
    w, c = who[~few], np.repeat(np.cumsum(counts > PAIRED) - 1, counts)[~few]
    for at in range(0, int((counts > PAIRED).sum()), COLUMNS):
        a, b = np.searchsorted(c, (at, at + COLUMNS))
        m = np.zeros((n, COLUMNS), np.float32)
        m[w[a:b], c[a:b] - at] = 1
        both += (m[one] @ m[two].T).astype(np.int32)
    lack = lacks.sum(1)
    return int(most.sum()) - lack[one][:, None] - lack[two][None, :] + both


def _compared(percent: int):
    """A forest of the links between the labels of a family's texts: each text of a pair of blocks is compared, on full
    sets, with each of the other block."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, (*GROUP, "key", "label", "block", "hashes")):
            _, _, x, y, *_ = rows[0]
            key, label, block, raw = (list(c) for c in zip(*(r[len(GROUP) :] for r in rows), strict=True))
            tree = np.unique(label, return_inverse=True)[1].reshape(-1)
            if tree.max() == 0:
                continue
            sets = [np.frombuffer(r, np.uint64) for r in raw]
            size, block = np.array([len(s) for s in sets]), np.array(block)
            one, two = np.flatnonzero(block == x), np.flatnonzero(block == y)
            both = _in_common(sets, one, two)
            linked, out = 100 * both >= percent * (size[one][:, None] + size[two][None, :] - both), []
            for a, to in zip(one, linked, strict=True):
                b = two[to]
                for k in b[tree[b] != tree[a]]:
                    if tree[k] != tree[a]:
                        out.append((key[a], key[k]))
                        tree[tree == tree[k]] = tree[a]
            if out:
                yield _two(out, schema)
        trim()

    return run


def _two(pairs: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*[(min(p), max(p)) for p in pairs], strict=True)], schema=schema)


def _confirmed(percent: int, least: int):
    """The pairs that are similar to ``least`` percent, and whether they are links."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("sure", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sure = [], []
            for sa, sb in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= least * (len(x) + len(y) - both))
                sure.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            some = batch.filter(keep)
            yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(sure, pa.bool_()).filter(keep)], schema=schema)
        trim()

    return run


def _in_blocks(rows: DataFrame, most: int, hashes: int) -> DataFrame:
    """``key, label, a, block, x, y``: rows (a, key, n, label) of each group ``a`` with different labels, in blocks of about
    ``most`` texts and ``hashes`` shingles, each once for each pair of blocks that a task compares.

    Blocks of the most frequent label meet only the others. A small group is one block.
    """
    parts = rows.groupBy("a", "label").agg(F.count("*").alias("c"), F.sum("n").alias("h"))
    groups = parts.groupBy("a").agg(F.sum("c").alias("count"), F.sum("h").alias("hashes"), F.max(F.struct("c", "h", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda c, h: F.ceil(F.greatest(c / most, h / hashes)).cast("int")
    one = (F.col("count") <= most) & (F.col("hashes") <= hashes)
    dealt = rows.drop("n").join(groups, "a")
    dealt = dealt.withColumn("mine", F.when(one, 0).otherwise(blocks(F.col("m.c"), F.col("m.h")))).withColumn("main", ~one & (F.col("label") == F.col("m.label")))
    dealt = dealt.withColumn("others", F.when(one, 1).otherwise(blocks(F.col("count") - F.col("m.c"), F.col("hashes") - F.col("m.h"))))
    at = F.pmod(F.xxhash64("key"), F.when(F.col("main"), F.col("mine")).otherwise(F.col("others"))).cast("int") + F.when(F.col("main"), 0).otherwise(F.col("mine"))
    to = F.explode(F.sequence(F.when(F.col("main"), F.col("mine")).otherwise(0), F.col("mine") + F.col("others") - 1))
    dealt = dealt.withColumn("block", at).withColumn("other", to)
    return dealt.select("key", "label", "a", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def labelled(docs: DataFrame, words_each: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, n, key, root, component`` of each row.

    Links documents whose shingle sets have a Jaccard similarity of ``percent`` or more and labels the components.

    Texts with equal sets are one class and are handled once. The cells of ordinary buckets propose a spanning forest of
    candidates, which is confirmed on full sets; components that this joins need no further comparison; candidates that
    are still apart are compared on full sets inside their bucket, so no link between different texts is lost and no list
    of pairs is made. The texts of a hot bucket are first compared with the most central one. Those that are connected by
    similarities of ``ALIKE`` to such texts are a family: near copies of the same texts, which have most of their shingles
    in common and so would meet by very many. Each of a family's texts that isn't joined yet is compared once with each
    other of it, on full sets, by blocks. Texts of different families, and of none, in buckets that aren't joined then meet
    by a prefix filter: each by its rarest shingles, of which
    two linked texts have one in common, so a crowd that shares a passage and no more costs nothing. If so many have one
    of them in common that a task can't compare them, they are compared in blocks, of which those of texts that are
    connected with most of the group, or of its family, meet only the others.

    ``key`` is null for texts without words; ``root`` names the component, ``component`` is its least id.
    """
    spark = docs.sparkSession
    n_parts = shuffle_partitions(spark)
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = d.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketches = staged(hashed.mapInArrow(_sketches(words_each), "doc_id long, text_hash long, n long, key binary, sig binary"), "minhash")
    nodes = staged(sketches.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")), "minhash-classes")

    size = 4 * WIDTH
    value = lambda k: F.substring("sig", k * size + 1, size)
    dealt = nodes.select("key", "n", F.posexplode(F.array(*[value(i) for i in range(KEYS)])).alias("i", "a"))
    shared = dealt.groupBy("i", "a").agg(F.count("*").alias("count"), F.sum("n").alias("hashes")).where("count > 1")
    bucketed = staged(dealt.drop("n").join(shared, ["i", "a"]), "minhash-shared")
    label = family = None

    def sets_of(keys: DataFrame) -> DataFrame:
        wanted = keys.distinct().join(nodes.select("key", "least"), "key")
        return staged(d.join(wanted, d["doc_id"].eqNullSafe(wanted["least"])).select("key", "text").mapInArrow(_sets(words_each), "key binary, hashes binary").dropDuplicates(["key"]), "minhash-sets")

    def add(sure: DataFrame) -> None:
        """Takes in confirmed links: only those between components are looked at, by the roots of their ends."""
        nonlocal label
        if label is None:
            label = components(sure) if sure.head(1) else None
            return
        root = lambda side: label.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        between = sure.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
        between = staged(between, "minhash-between")
        if not between.head(1):
            return
        up = components(between).select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = label.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        fresh = up.select(F.col("root").alias("node"), F.col("up").alias("root")).join(label, "node", "left_anti")
        label = staged(moved.unionByName(fresh), "minhash-labels")

    def by_group(rows: DataFrame) -> DataFrame:
        return rows.repartition(n_parts, *GROUP).sortWithinPartitions(*GROUP, "key")

    def confirm(pairs: DataFrame, sets: DataFrame | None = None, least: int = percent) -> DataFrame:
        """Takes in the links among some pairs; gives the pairs of the least similarity."""
        if sets is None:
            sets = sets_of(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))))
        sides = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("sb")), "b")
        found = staged(sides.mapInArrow(_confirmed(percent, least), "a binary, b binary, sure boolean"), "minhash-links")
        add(found.where("sure").select("a", "b"))
        return found.select("a", "b")

    def labels(rows: DataFrame) -> DataFrame:
        if label is None:
            return rows.withColumn("label", F.col("key"))
        return rows.join(label, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("root", "key")).drop("node", "root")

    is_hot = (F.col("count") > BLOCK) | (F.col("hashes") > BLOCK_HASHES)
    in_tasks = bucketed.where(~is_hot).select("key", "i", "a", F.lit(0).alias("block"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    hot = bucketed.where(is_hot)
    if hot.head(1):
        central = hot.groupBy("key").agg(F.sum("count").alias("central"))  # originals share more buckets than their copies do
        hot = staged(hot.select("key", "i", "a").join(central, "key"), "minhash-hot")
        sets = sets_of(hot.select("key"))
        # no text is connected yet, so the most central one of each bucket leads it
        leaders = hot.groupBy("i", "a").agg(F.max(F.struct("central", "key"))["key"].alias("leader"))
        pairs = hot.join(leaders, ["i", "a"]).where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b"))
        alike = confirm(staged(pairs.distinct(), "minhash-led"), sets, min(ALIKE, percent))
        rows = hot.select("key", "i", "a")
        if alike.head(1):
            family = staged(components(alike).select(F.col("node").alias("key"), F.col("root").alias("family")), "minhash-families")
            near = labels(family.join(nodes.select("key", "n"), "key")).select(F.col("family").alias("a"), "key", "n", "label")
            near = _in_blocks(staged(near, "minhash-family-labels"), CROWD, CROWD_HASHES).withColumn("i", F.lit(-2)).join(sets, "key")
            add(staged(by_group(near).mapInArrow(_compared(percent), "a binary, b binary").distinct(), "minhash-family-links"))
            rows = rows.join(family, "key", "left")
        # links inside a family are all known, so it goes as one label
        rows = labels(rows) if family is None else labels(rows).withColumn("label", F.coalesce("family", "label"))
        rows = staged(rows.select("key", "i", "a", "label"), "minhash-hot-labels")
        open_ = rows.groupBy("i", "a").agg((F.min("label") < F.max("label")).alias("open")).where("open").drop("open")
        wanted = rows.join(open_, ["i", "a"]).select("key", "label").distinct()
        pieces = staged(wanted.join(sets, "key"), "minhash-open")
        tokens = pieces.select("hashes").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        tokens = staged(tokens, "minhash-open-shingles")
        total = tokens.agg(F.sum("n")).first()[0] or 0
        common = tokens.where(F.col("n") > max(COMMON_LEAST, total // COMMON)).select("h").collect()  # COMMON shingles at most
        frequent = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in common], np.int64).view(np.uint64)))
        firsts = staged(pieces.mapInArrow(_rare_first(frequent, percent), "a binary, key binary, n long, label binary"), "minhash-rare")
        in_tasks = in_tasks.unionByName(_in_blocks(firsts, BLOCK, BLOCK_HASHES).drop("label").withColumn("i", F.lit(-1)))

    met = in_tasks.join(nodes.select("key", "n", "sig"), "key")
    met = met.withColumn("family", F.col("key")) if family is None else met.join(family, "key", "left").withColumn("family", F.coalesce("family", "key"))
    met = staged(met, "minhash-buckets")
    pairs = staged(by_group(labels(met)).mapInArrow(_forest(percent), "a binary, b binary").distinct(), "minhash-forest")
    if pairs.head(1):
        confirm(pairs)
        open_ = staged(by_group(labels(met).select(*BLOCK_ROW)).mapInArrow(_undecided(percent), BLOCK_DDL), "minhash-undecided")
        if open_.head(1):
            full = open_.join(sets_of(open_.select("key")), "key")
            add(staged(by_group(full).mapInArrow(_settled(percent), "a binary, b binary"), "minhash-settled"))

    if label is None:
        groups = nodes.select("key", F.col("key").alias("root"), F.col("least").alias("component"))
    else:
        rooted = nodes.join(label, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
        groups = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("key", "root", "component")
    return sketches.select("doc_id", "text_hash", "n", "key").join(groups, "key", "left")


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links and labels documents as ``labelled`` says.

    Returns ``doc_id, n_shingles, component_id, kept`` for each row: the least id reachable and whether it is this row's
    own. Texts without words (null, empty) have an empty set and link with nothing: they are their own component, also
    if their id is null. A shorter text is one shingle. Rows that repeat an id are each judged by their text; rows with a
    null id are linked but can't be the least, unless their component has no other id (then it and ``kept`` are null).
    """
    out = labelled(docs, words_each, percent, id_col, text_col)
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicated(docs: DataFrame, words_each: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: the one of least id (nulls last).

    Texts without words all stay. Rows equal in id and text count as one. An empty table gives no rows.
    """
    out = labelled(docs, words_each, percent, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("m")
    stay = out.where("key is not null").groupBy("root").agg(first).select("m.doc_id", "m.text_hash")
    stay = stay.unionByName(out.where("key is null").select("doc_id", "text_hash")).distinct()
    d = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    kept = d.join(stay, d[id_col].cast("long").eqNullSafe(stay["doc_id"]) & (d["__text_hash"] == stay["text_hash"]), "left_semi")
    return kept.dropDuplicates([id_col, "__text_hash"]).drop("__text_hash")
