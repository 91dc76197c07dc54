"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is normaliser o pieces o byte fallback. The pieces are compiled into one deterministic automaton: after any
text its state tells all pieces that end there. Composed with an input it gives a lattice of positions, with an arc for
each such piece and a fallback arc (bytes, or the unknown piece) over a character that is no piece. For a unigram model an
arc weighs minus the piece's log-probability. For a BPE model the weight is 0 after a piece beside which merging would
leave it, and infinite otherwise: a sequence is the model's segmentation just when no neighbouring pair of it is infinite.
Every beginning of an input has one segmentation, so one arc of finite weight enters each position. In both cases
positions are relaxed from left to right in the tropical semiring.

Inputs are cut where no piece crosses (before a space mark that follows other text), and the paths of the parts are kept.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import pick, trim

SPACE = "▁"
INF = float("inf")
_ID = struct.Struct("<i")
#: Keys of an automaton's state that are no characters.
ENDS, BACK = "", "back"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def spaced(part: str) -> bytes:
    return part.replace(SPACE, " ").encode("utf-8", "replace")


class _Cache(dict):
    """Part of an input -> its ids as little-endian int32; a pair of them and what they decode to where that isn't the part.

    Two generations of at most ``most`` bytes each: what was used lately outlives a change of generation, so frequent
    parts stay and a worker's memory is bounded.
    """

    #: Longer parts are not kept; what an entry takes beside its characters and ids.
    LONGEST, ENTRY = 256, 150

    def __init__(self, make, most: int):
        self.make, self.most, self.size, self.old = make, most, 0, {}

    def forget(self) -> None:
        self.clear()
        self.size, self.old = 0, {}

    def __missing__(self, part: str) -> bytes | tuple[bytes, bytes]:
        got = self.old.get(part) or self.make(part)
        if len(part) <= self.LONGEST:
            if self.size >= self.most:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[part] = got
            self.size += 2 * len(part) + len(got if isinstance(got, bytes) else b"".join(got)) + self.ENTRY
        return got


class PieceTransducer:
    """Compiled from the bytes of a model; ``rules`` is an optional leftmost-longest normaliser (string -> string).

    ``cache_bytes`` bounds each of the two generations of kept parts, ``pairs`` the kept weights of neighbouring pieces.
    """

    def __init__(self, model: bytes, rules: dict[str, str] | None = None, cache_bytes: int = 64 << 20, pairs: int = 500_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        trainer = normal = b""
        for number, value in _fields(model):
            trainer, normal = (value if number == 2 else trainer), (value if number == 3 else normal)
        t, n = dict(_fields(trainer)), dict(_fields(normal))
        if n.get(2) and rules is None:
            raise ValueError("the model holds a compiled character map; give its normaliser as rules")
        self.bpe, self.dummy, self.squeeze = t.get(3, 1) == 2, n.get(3, 1) == 1, n.get(4, 1) == 1
        self.rules = {k: v for k, v in (rules or {}).items() if k}
        self.rule = re.compile("|".join(map(re.escape, sorted(self.rules, key=len, reverse=True)))) if self.rules else None
        self.unk = sp.unk_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: list[int | None] = [None] * 256
        self.out: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.out.append(b"")
            elif sp.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                self.out.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.ids[piece], self.score[piece] = i, sp.get_score(i)
        self.fallback = None not in self.byte_ids
        self.coded = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.start = self._automaton()
        self.unk_cost = -(min(self.score.values(), default=0.0) - 10)
        #: Finite or infinite weight of a piece after another; "" stands for the beginning.
        self.weights: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.known_pairs, self.most_pairs = 0, pairs
        #: cuts that no piece crosses: before a space mark that follows other text, and around characters of no piece
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.chunk = re.compile("(?s).+" if crossing else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if not any("\n" in p for p in self.ids) else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache = _Cache(self._part, cache_bytes)

    def _automaton(self) -> dict:
        """The initial state. A state maps characters to next states, BACK to the state of its longest proper ending that
        begins a piece, and ENDS to the (length, piece) that end in it, longest first."""
        start: dict = {}
        for piece in self.ids:
            state = start
            for c in piece:
                state = state.setdefault(c, {})
            state[ENDS] = ((len(piece), piece),)
        start[BACK], row = None, [(start, c, state) for c, state in start.items() if c]
        for before, c, state in row:  # grows by the states that follow: shorter ones first
            row += [(state, d, after) for d, after in state.items() if d != ENDS]
            back = before[BACK]
            while back is not None and c not in back:
                back = back[BACK]
            state[BACK] = start if back is None else back[c]
            state[ENDS] = state.get(ENDS, ()) + state[BACK].get(ENDS, ())
        for _, c, state in row:
            if c not in self.ids:
                state[ENDS] = *(x for x in state[ENDS] if x[0] > 1), (1, c)
        start[ENDS] = ()
        return start

    def normalise(self, text: str) -> str:
        if self.rule:
            text = self.rule.sub(lambda m: self.rules[m[0]], text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.dummy else "") + text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """What repeated merging of the best neighbouring pair leaves of a short string (leftmost on ties)."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = -INF, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (at < 0 or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, a: str, b: str) -> bool:
        """Whether merging would leave ``b`` as it is after ``a``, and side by side with it (``a`` may be empty)."""
        if self.known_pairs >= self.most_pairs:
            self.weights.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        got = self.weights[a][b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def shortest_path(self, text: str) -> list[str]:
        """The arcs (pieces, or characters without a piece) of the shortest path over a normalised text."""
        return self._only_finite_path(text) if self.bpe else self._least_cost_path(text)

    def _lattice(self, text: str) -> Iterator[tuple]:
        """The arcs that enter each position, longest first."""
        start = state = self.start
        for c in text:
            after = state.get(c)
            while after is None:
                state = state[BACK]
                if state is None:
                    after = None
                    break
                after = state.get(c)
            if after is None:
                state = start
                yield ((1, c),)
            else:
                state = after
                yield state[ENDS]

    def _only_finite_path(self, text: str) -> list[str]:
        """The arcs of the path whose pairs all have finite weight; work is linear in arcs."""
        into, weights = [""], self.weights  # the arc that enters each position
        known = [weights[""]]
        for arcs in self._lattice(text):
            for length, piece in arcs:
                ok = known[-length].get(piece)
                if self.stays(into[-length], piece) if ok is None else ok:
                    into.append(piece)
                    known.append(weights[piece])
                    break
            else:  # a table in which merging isn't decided by neighbours: the definition itself
                return self.merged(text)
        return self._traced(into)

    def _least_cost_path(self, text: str) -> list[str]:
        """The arcs of the path of least total weight; of equal ones, the longest arc enters a position."""
        into, cost, score, unknown = [""], [0.0], self.score, self.unk_cost
        for arcs in self._lattice(text):
            best, by = INF, ""
            for length, piece in arcs:
                c = cost[-length] - score[piece] if piece in score else cost[-1] + unknown
                if c < best:
                    best, by = c, piece
            cost.append(best)
            into.append(by)
        return self._traced(into)

    @staticmethod
    def _traced(into: list[str]) -> list[str]:
        path, at = [], len(into) - 1
        while at:
            path.append(into[at])
            at -= len(into[at])
        return path[::-1]

    def _part(self, part: str) -> bytes | tuple[bytes, bytes]:
        path = self.shortest_path(part)
        try:
            ids = b"".join([self.coded[arc] for arc in path])
        except KeyError:
            ids = self._with_fallback(path)
        back = b"".join([self.out[i] for (i,) in _ID.iter_unpack(ids)])
        return ids if back == spaced(part) else (ids, back)

    def _with_fallback(self, path: list[str]) -> bytes:
        ids: list[int] = []
        for arc in path:
            if arc in self.ids:
                ids.append(self.ids[arc])
            elif self.fallback:
                ids += [self.byte_ids[b] for b in arc.encode("utf-8", "replace")]
            elif not ids or ids[-1] != self.unk:  # unknown characters in a row are one piece
                ids.append(self.unk)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode_both(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids as little-endian int32, and what they decode to before the first space is taken off."""
        normal = self.normalise(text or "")
        parts = self.chunk.findall(normal)
        found = list(map(self.cache.__getitem__, parts))
        try:
            return b"".join(found), spaced(normal)
        except TypeError:  # some part decodes to something else
            both = [x if isinstance(x, tuple) else (x, spaced(part)) for part, x in zip(parts, found, strict=True)]
            return b"".join([x for x, _ in both]), b"".join([x for _, x in both])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_both(text)[0], "<i4").tolist()

    def spelt(self, raw: bytes) -> str:
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def decode(self, ids) -> str:
        return self.spelt(b"".join(map(self.out.__getitem__, ids)))


_LOADED: dict[tuple, PieceTransducer] = {}


def loaded(model: bytes, rules: dict[str, str] | None = None) -> PieceTransducer:
    """One transducer for each worker process."""
    key = (hashlib.sha256(model).digest(), tuple(sorted((rules or {}).items())))
    if key not in _LOADED:
        _LOADED[key] = PieceTransducer(model, rules)
    return _LOADED[key]


def model_bytes(model_file: str) -> bytes:
    with open(model_file, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, ids, ids_sha256, n_pieces, round_trip`` of each row.

    ``ids_sha256`` is over the ids as little-endian int32; ``round_trip`` says whether decoding gives the text back. A
    null or empty text has no pieces (a null decodes to the empty text and counts as a round trip). Ids may be null or
    repeat; texts are encoded whole, piece by piece in constant memory beside the text itself. The driver reads the model
    file and sends its bytes (of a size that the data don't change) to the executors.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("n_pieces", pa.int64()), ("round_trip", pa.bool_())])
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = loaded(model.value, rules)
        for whole in batches:
            for i in range(0, len(whole), 500):
                batch = whole.slice(i, 500)
                raw, same = [], []
                for text in batch.column("text").to_pylist():
                    ids, back = tool.encode_both(text)
                    raw.append(ids)
                    same.append(tool.spelt(back) == (text or ""))
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array(np.diff(ends), pa.int64()), pa.array(same)], schema=schema)
        tool.cache.forget()  # a worker that Spark keeps for other work holds no texts
        trim()

    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids array<int>, ids_sha256 string, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, model_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows of ids; null ids give a null text, no ids an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    model = encoded.sparkSession.sparkContext.broadcast(model_bytes(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = loaded(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else tool.decode(x) for x in batch.column("ids").to_pylist()], pa.string())], schema=schema)

    return pick(encoded, doc_id=id_col, ids=ids_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, text string")
