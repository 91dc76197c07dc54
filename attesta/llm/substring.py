"""Removal of repeated word windows with difference-cover anchors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Rolling, binaries, hash_words, one_part_each, pick, shuffle_partitions, staged, text_bytes, text_key, trim

#: Perfect difference cover: every residue modulo the period is a difference of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Words gathered by a task before it sends what it found.
FLUSH_WORDS = 1_000_000
#: Bytes of text for each part of the hash space, and texts with more copies than one in so many rows (of which there are
#: at most so many) are handled apart.
PART_BYTES, HEAVY = 256 << 20, 10_000
BASES = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3)
SENT = pa.schema([(c, pa.int32() if c == "part" else pa.binary()) for c in ("part", "h1", "h2", "many", "low", "high", "counts", "ids")])
SENT_DDL = "part int, h1 binary, h2 binary, many binary, low binary, high binary, counts binary, ids binary"
REPLY = pa.schema([(c, pa.int32() if c == "part" else pa.binary()) for c in ("part", "low", "high", "counts", "ids")])
REPLY_DDL = "part int, low binary, high binary, counts binary, ids binary"
FOUND = pa.schema([("key", pa.binary()), ("hits", pa.binary())])
FOUND_DDL = "key binary, hits binary"


class _Sender:
    """Gathers (hash, document, position) and sends them as one row for each part of the hash space.

    Hashes of ``kinds[0]`` bits within a part, and of ``kinds[1]`` more for whole windows; positions as two planes of 16
    bits, the upper of which compresses away; each document's key once for its run of positions. Places whose hash is
    gathered at another place too are known to be repeated: they go straight to the tasks that gather by text (rows without
    hashes), and one of them stands for all, so a passage that all documents hold doesn't fill its part.
    """

    def __init__(self, parts: np.ndarray, kinds: tuple):
        self.parts, self.kinds = parts, kinds
        self._clear()

    def _clear(self) -> None:
        self.h1, self.h2, self.at, self.n, self.ids, self.words = [], [], [], [], [], 0

    def add(self, key: bytes, h1: np.ndarray, h2: np.ndarray | None, at: np.ndarray, words: int) -> None:
        self.h1.append(h1)
        if h2 is not None:
            self.h2.append(h2.astype(self.kinds[1]))
        self.at.append(at.astype(np.uint32))
        self.n.append(len(at))
        self.ids.append(key)
        self.words += words

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.n and sum(self.n):
            h1, at = np.concatenate(self.h1), np.concatenate(self.at)
            h2 = np.concatenate(self.h2) if self.h2 else None
            ids = np.frombuffer(b"".join(self.ids), np.uint64).reshape(-1, 2)
            who = np.repeat(np.arange(len(self.n), dtype=np.uint32), self.n)
            first, many = _repeats([h1] if h2 is None else [h2, h1], ids[who, 0], ids[who, 1], at)
            if many.any():
                for to, *row in _by_part(self.parts, ids[who[many], 0], ids[who[many], 1], at[many]):
                    none = pa.nulls(len(to), pa.binary())
                    yield pa.RecordBatch.from_arrays([to, none, none, none, *row], schema=SENT)
            h1, at, who, many = h1[first], at[first], who[first], many[first]
            part = ((h1 >> np.uint64(32)) % np.uint64(len(self.parts))).astype(np.uint32)
            order = np.lexsort((who, part))
            part, at, who, many = part[order], at[order], who[order], many[order].astype(np.uint8)
            h1 = h1[order].astype(self.kinds[0])
            h2 = np.empty(0, np.uint16) if h2 is None else h2[first][order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            bounds = np.r_[cuts, len(part)]
            runs = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (who[1:] != who[:-1])])
            counts = np.diff(np.r_[runs, len(part)]).astype(np.uint32)
            keys = ids[who[runs]].reshape(-1)
            groups = np.r_[np.searchsorted(runs, cuts), len(runs)]
            low, high = (at & np.uint32(0xFFFF)).astype(np.uint16), (at >> np.uint32(16)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.parts[part[cuts]]), binaries(h1, bounds), binaries(h2, bounds if len(h2) else 0 * bounds), binaries(many, bounds), binaries(low, bounds), binaries(high, bounds), binaries(counts, groups), binaries(keys, 2 * groups)], schema=SENT
            )
        self._clear()


def _repeats(keys: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one entry for each key (the last of ``keys`` sorts first), and for every entry whether its key is also
    found at another place. The same place may come twice, from copies of a text."""
    order = np.lexsort(keys)
    same = np.ones(len(at) - 1, bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    starts = np.flatnonzero(np.r_[True, ~same])
    group = np.cumsum(np.r_[True, ~same]) - 1
    lo, hi, at = lo[order], hi[order], at[order]
    first = starts[group]
    other = (lo != lo[first]) | (hi != hi[first]) | (at != at[first])
    many = np.empty(len(at), bool)
    many[order] = (np.bincount(group, weights=other) > 0)[group]
    return order[starts], many


def _by_part(parts: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> Iterator[tuple[pa.Array, ...]]:
    """Places packed for the tasks that gather them by text: part, low, high, counts, ids."""
    to = (lo % np.uint64(len(parts))).astype(np.uint32)
    lo, hi, at, to, runs = _by_text(lo, hi, at, to)
    counts = np.diff(np.r_[runs, len(at)]).astype(np.uint32)
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    bounds, groups = np.r_[cuts, len(to)], np.r_[np.searchsorted(runs, cuts), len(runs)]
    keys = np.stack([lo[runs], hi[runs]], axis=1).reshape(-1)
    low, high = (at & np.uint32(0xFFFF)).astype(np.uint16), (at >> np.uint32(16)).astype(np.uint16)
    yield pa.array(parts[to[cuts]]), binaries(low, bounds), binaries(high, bounds), binaries(counts, groups), binaries(keys, 2 * groups)


def _anchors(parts: np.ndarray, window: int):
    """Hashes of the anchor windows at cover positions of each text with at least one window."""
    length = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, sender, cover = Rolling(BASES[0]), _Sender(parts, (np.uint32, None)), np.empty(0, np.int64)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), text_bytes(batch.column("text")), strict=True):
                words = (text or b"").split()
                n = len(words)
                if n < window:
                    continue
                if n > len(cover):
                    cover = np.flatnonzero(np.isin(np.arange(2 * n) % PERIOD, COVER))
                at = cover[: np.searchsorted(cover, n - length + 1)]
                sender.add(key, rolling.windows(hash_words(words), length, at), None, at, n)
                if sender.words >= FLUSH_WORDS:
                    yield from sender.send()
        yield from sender.send()

    return run


def _candidates(parts: np.ndarray, window: int):
    """Whole-window hashes of the windows that hold a repeated anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, sender, seen = Rolling(BASES[0]), Rolling(BASES[1]), _Sender(parts, (np.uint64, np.uint16)), set()
        for batch in batches:
            for key, text, many, hits in zip(*(batch.column(c).to_pylist() if c != "text" else text_bytes(batch.column(c)) for c in ("key", "text", "copied", "hits")), strict=True):
                if not hits:
                    continue
                if many:  # copies of a text meet here: one of them stands for all
                    if key in seen:
                        continue
                    seen.add(key)
                words = text.split()
                last = len(words) - window
                at = np.frombuffer(hits, np.uint32).astype(np.int64)
                step = np.zeros(last + 2 + PERIOD, np.int64)
                np.add.at(step, np.clip(at - PERIOD + 1, 0, last + 1), 1)
                np.add.at(step, np.minimum(at, last) + 1, -1)
                start = np.flatnonzero(np.cumsum(step)[: last + 1] > 0)
                hashes = hash_words(words)
                sender.add(key, one.windows(hashes, window, start), two.windows(hashes, window, start), start, 4 * len(start))
                if sender.words >= FLUSH_WORDS:
                    yield from sender.send()
        yield from sender.send()

    return run


def _repeated(kinds: tuple, parts: np.ndarray):
    """Places whose hash is also found at another place, packed for the tasks that gather them by text.

    Gets whole parts of the hash space, of which the number follows the input. A much repeated hash comes once from each
    million words, not from each text. Places that are known to be repeated are passed on as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h1", "h2", "many", "low", "high", "counts", "ids")
        types = (kinds[0], kinds[1] or np.uint16, np.uint8, np.uint16, np.uint16, np.uint32, np.uint64)
        cols: list[list] = [[] for _ in names]
        where: list[np.ndarray] = []
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column("h1")))
            if len(known):
                yield pa.RecordBatch.from_arrays([known.column(c) for c in REPLY.names], schema=REPLY)
            batch = batch.filter(pc.is_valid(batch.column("h1")))
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", *names)), strict=True):
                for into, kind, raw in zip(cols, types, row, strict=True):
                    into.append(np.frombuffer(raw, kind))
                where.append(np.full(len(cols[0][-1]), part, np.int32))
        if not where:
            return
        part, (h1, h2, known, low, high, counts, ids) = np.concatenate(where), (np.concatenate(c) for c in cols)
        at = low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))
        lo, hi = (np.repeat(ids.reshape(-1, 2)[:, k], counts) for k in (0, 1))
        keys = [part, h2, h1] if len(h2) else [part, h1]
        _, many = _repeats(keys, lo, hi, at)
        # one that stands for several tells the others of its hash that they are repeated; it knows itself already
        many |= _marked(keys, known > 0)
        if many.any():
            yield from (pa.RecordBatch.from_arrays(list(row), schema=REPLY) for row in _by_part(parts, lo[many], hi[many], at[many]))
        del cols, where, part, h1, h2, known, low, high, counts, ids, at, lo, hi, keys, many
        trim()

    return run


def _marked(keys: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """For every entry, whether any of its key is marked."""
    if not known.any():
        return known
    order = np.lexsort(keys)
    fresh = np.zeros(len(known), bool)
    fresh[0] = True
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    group = np.cumsum(fresh) - 1
    out = np.empty(len(known), bool)
    out[order] = (np.bincount(group, weights=known[order]) > 0)[group]
    return out


def _by_text(lo, hi, at, to):
    """Sorted by (to, text, position) without repeats, and where each text's run starts."""
    order = np.lexsort((at, lo, hi, to))
    lo, hi, at, to = lo[order], hi[order], at[order], to[order]
    fresh = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (at[1:] != at[:-1])]
    lo, hi, at, to = lo[fresh], hi[fresh], at[fresh], to[fresh]
    return lo, hi, at, to, np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text, with all positions found for it."""
    ids, ats = [], []
    for batch in batches:
        for low, high, counts, keys in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "counts", "ids")), strict=True):
            ats.append(np.frombuffer(low, np.uint16).astype(np.uint32) | (np.frombuffer(high, np.uint16).astype(np.uint32) << np.uint32(16)))
            ids.append(np.repeat(np.frombuffer(keys, np.uint64).reshape(-1, 2), np.frombuffer(counts, np.uint32), axis=0))
    if not ats:
        return
    pair, at = np.concatenate(ids), np.concatenate(ats)
    lo, hi, at, _, cuts = _by_text(pair[:, 0], pair[:, 1], at, np.zeros(len(at), np.uint8))
    keys = np.stack([lo[cuts], hi[cuts]], axis=1).reshape(-1)
    bounds = np.r_[cuts, len(at)]
    for i in range(0, len(cuts), 10_000):
        some = bounds[i : i + 10_001]
        n = len(some) - 1
        yield pa.RecordBatch.from_arrays([binaries(keys[2 * i : 2 * (i + n)], 2 * np.arange(n + 1)), binaries(at[some[0] : some[-1]], some - some[0])], schema=FOUND)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _layout(text: bytes, stay: np.ndarray) -> bytes:
    """The words that stay, each with the white space before it."""
    out, before = [], 0
    for m, keep in zip(WORD.finditer(text), stay.tolist(), strict=True):
        if keep:
            out.append(text[before : m.end()])
        before = m.end()
    return b"".join(out).lstrip() if len(stay) and not stay[0] else b"".join(out)


def _removed(window: int, layout: bool):
    """Counts and the words that stay, given the starts of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column("stands")))
            out: list[list] = [[], [], []]
            for text, many, hits in zip(text_bytes(batch.column("text")), batch.column("copied").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                if layout and not hits and not many:
                    n = len((text or b"").split())
                    for into, value in zip(out, (n, 0, text), strict=True):
                        into.append(value if value is not text or text is None else text.decode())
                    continue
                words = (text or b"").split()
                n = len(words)
                if many and n >= window:
                    kept: list[bytes] = []
                elif hits:
                    at = np.frombuffer(hits, np.uint32).astype(np.int64)
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(step)[:n] == 0)]
                else:
                    kept = words
                out[0].append(n)
                out[1].append(n - len(kept))
                if layout and n == len(kept):
                    out[2].append(None if text is None else text.decode())
                elif layout and kept:
                    out[2].append(_layout(text, np.cumsum(step)[:n] == 0).decode("utf-8", "replace"))
                else:
                    out[2].append(b" ".join(kept).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), batch.column("carried")], names=["doc_id", "n_words", "n_removed", "kept_text", "carried"])

    return run


def drop_repeated_windows(docs: DataFrame, window: int = 35, *, id_col: str = "doc_id", text_col: str = "text", layout: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every word covered by a ``window``-word sequence that also starts anywhere else in the corpus.

    1. Anchors: each text hashes the (window - 20)-word windows at positions in a difference cover modulo 21. Two
       equal windows share, at some common shift below 21, an anchor at which both positions are in the cover.
    2. Extension: only windows that hold a repeated anchor are hashed whole (80 bits within a part) and compared.
    3. Words under repeated windows go.
    Hashes travel packed, one row for each task's part of the hash space, and are compared by sorting in bounded parts;
    what is found goes back packed by text. A task sends each hash once for every million words, so a passage that all
    documents hold weighs little.
    A text that occurs twice or more is repeated as a whole, so copies are found by key, not window by window. Rows of the
    most copied texts (at most ``HEAVY`` texts, whose keys are broadcast) stay where they are; one of each stands for all.

    Returns ``doc_id, n_words, n_removed, kept_text`` for each input row, kept words joined by one space (with
    ``layout``, each after its own white space, and texts that lose nothing unchanged), and ``carried``, a struct of the
    columns named in ``carry``. Windows are judged on the input. A null or empty text has no words; texts shorter than ``window`` keep everything; null ids and
    repeated rows are allowed (rows with equal text count as copies whatever their ids).
    """
    if window < PERIOD + 4:
        raise ValueError(f"a window needs {PERIOD + 4} words or more")
    spark = docs.sparkSession
    # both joins below read texts by the same key and columns, so that Spark shuffles them once
    carried = F.struct(*[docs[c].alias(c) for c in carry]) if carry else F.lit(None).cast("int")
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), carried.alias("carried"))
    d = d.withColumn("key", F.coalesce(text_key(F.col("text")), F.unhex(F.lit(""))))
    each = staged(d.where("text is not null").groupBy("key").agg(F.count("*").alias("count"), F.max(F.octet_length("text")).cast("long").alias("size")), "substring-copies")
    rows, size = each.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    parts = one_part_each(n)
    heavy = F.broadcast(each.where(F.col("count") * HEAVY > rows).where("count > 1").select("key"))  # fewer than HEAVY keys
    hot = d.join(heavy, "key", "left_semi")
    d = d.join(heavy, "key", "left_anti").select("doc_id", "key", "text", "carried", F.lit(False).alias("stands"))
    one = hot.groupBy("key").agg(F.first("text").alias("text"))
    d = d.unionByName(one.select(F.lit(None).cast("long").alias("doc_id"), "key", "text", F.lit(None).cast(d.schema["carried"].dataType).alias("carried"), F.lit(True).alias("stands")))

    def places(sent: DataFrame, kinds: tuple) -> DataFrame:
        replies = sent.repartition(n, "part").mapInArrow(_repeated(kinds, parts), REPLY_DDL)
        return replies.repartition(n, "part").mapInArrow(_gathered, FOUND_DDL)

    columns = ("doc_id", "key", "text", "copied", "hits", "carried", "stands")
    copied = each.where("count > 1").select("key", F.lit(True).alias("copied"))
    anchors = places(d.select("key", "text").mapInArrow(_anchors(parts, window), SENT_DDL), (np.uint32, None))
    marked = anchors.join(copied, "key", "left")
    wide = d.join(marked.hint("shuffle_hash"), "key").select(*columns)
    windows = places(wide.mapInArrow(_candidates(parts, window), SENT_DDL), (np.uint64, np.uint16))
    verdicts = windows.join(copied, "key", "full_outer")
    last = d.join(verdicts.hint("shuffle_hash"), "key", "left").select(*columns)  # those that stand for copies go at the end: a filter here would reach one join and not the other
    last = last.unionByName(hot.select("doc_id", "key", "text", F.lit(True).alias("copied"), F.lit(None).cast("binary").alias("hits"), "carried", F.lit(False).alias("stands")))
    return last.mapInArrow(_removed(window, layout), f"doc_id long, n_words long, n_removed long, kept_text string, carried {d.schema['carried'].dataType.simpleString()}")

