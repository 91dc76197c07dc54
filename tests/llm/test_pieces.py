"""The piece transducer against the library, for the public model and for small models written out here."""

import hashlib
import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from attesta.llm import pieces, queries

ALPHABET = "abcdefgh eioanrst  ▁\n\tABC123éü日本😀.,$"


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def model(kind, words, *, byte_fallback, dummy=1, squeeze=1):
    """A model of given pieces and scores; kind 1 is unigram, 2 BPE."""
    entry = lambda piece, score, type_: field(1, field(1, piece.encode()) + field(2, score) + field(3, type_))
    out = entry("<unk>", 0.0, 2) + entry("<s>", 0.0, 3) + entry("</s>", 0.0, 3)
    if byte_fallback:
        out += b"".join(entry(f"<0x{b:02X}>", 0.0, 6) for b in range(256))
    out += b"".join(entry(w, float(s), 1) for w, s in words)
    return out + field(2, field(3, kind) + field(35, int(byte_fallback))) + field(3, field(3, dummy) + field(4, squeeze))


def strings(rng, n, alphabet=ALPHABET, longest=60):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_the_public_model_as_the_library_has_it():
    sp, tool = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL), pieces.PieceTransducer(pieces.model_bytes(queries.PIECE_MODEL))
    for x in [*strings(random.Random(3), 3000), "a" * 700, "日" * 300, " ", "▁", "\0"]:
        assert tool.encode(x) == sp.encode(x) and tool.decode(tool.encode(x)) == sp.decode(sp.encode(x))


def merging(rng):
    """Pieces that merging makes one of another, best first."""
    parts, made = list("abcd▁"), []
    for _ in range(40):
        p = rng.choice(parts) + rng.choice(parts)
        if p not in parts and len(p) < 7:
            parts.append(p)
            made.append(p)
    return [(p, -i) for i, p in enumerate([*made, *"abcd▁"])]


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("kind", [1, 2])
def test_small_models_as_the_library_has_them(kind, byte_fallback):
    rng = random.Random(7 + kind)
    for _ in range(8):
        words = merging(rng) if kind == 2 else [(p, -rng.uniform(1, 9)) for p, _ in merging(rng)]
        proto = model(kind, words, byte_fallback=byte_fallback)
        sp, tool = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.PieceTransducer(proto)
        for x in strings(rng, 200, "abcd  é😀z", 24):
            assert tool.encode(x) == sp.encode(x), (words, x)


def test_no_input_raises_where_a_character_is_no_piece():
    tool = pieces.PieceTransducer(model(2, [("ab", -1.0), ("abc", -2.0), ("c", -3.0), ("▁", -4.0)], byte_fallback=True))
    for x in strings(random.Random(1), 300, "abc ", 12):
        assert tool.decode(tool.encode(x)) == " ".join(x.split())


def test_rules_rewrite_the_longest_match_first(spark):
    proto = model(1, [("▁", -2.0), ("ss", -1.0), ("s", -3.0), ("fi", -1.5), ("f", -3.0), ("i", -3.0)], byte_fallback=False)
    tool = pieces.PieceTransducer(proto, {"ß": "ss", "ﬁ": "fi", "ﬁß": "s", "": "never"})
    assert tool.normalise("ﬁß ﬁ ß") == "▁s▁fi▁ss"
    assert tool.decode(tool.encode("ﬁß ﬁ ß")) == "s fi ss"


def test_unknown_characters_in_a_row_are_one_piece():
    tool = pieces.PieceTransducer(model(1, [("▁", -2.0), ("a", -1.0)], byte_fallback=False))
    assert tool.encode("xyz a") == [tool.ids["▁"], tool.unk, tool.ids["▁"], tool.ids["a"]]


def test_kept_parts_are_bounded_and_change_nothing():
    model_ = pieces.model_bytes(queries.PIECE_MODEL)
    small, large = pieces.PieceTransducer(model_, cache_bytes=3000, pairs=50), pieces.PieceTransducer(model_)
    for x in strings(random.Random(5), 400):
        assert small.encode_both(x) == large.encode_both(x)
        assert small.cache.size <= 3000 + 1500 and small.known_pairs <= 50 and len(small.cache.old) < 30


def test_every_column_and_long_texts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    rng = random.Random(11)
    texts = [*strings(rng, 60), None, "", "word " * 400_000, "x" * 50_000, "\n".join(strings(rng, 20_000))]
    rows = [(i if i % 7 else None, t, 1, 2) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids long, n_pieces long")
    got = {(r["doc_id"], r["ids_sha256"], r["n_pieces"], r["round_trip"]) for r in pieces.encode(d, queries.PIECE_MODEL).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        want.add((i, hashlib.sha256(struct.pack(f"<{len(ids)}i", *ids)).hexdigest(), len(ids), sp.decode(ids) == (t or "")))
    assert got == want
    back = pieces.decode(pieces.encode(d, queries.PIECE_MODEL), queries.PIECE_MODEL)
    assert {(r["doc_id"], r["h"]) for r in back.select("doc_id", F.sha2("text", 256).alias("h")).collect()} == {(i, hashlib.sha256(sp.decode(sp.encode(t or "")).encode()).hexdigest()) for i, t, *_ in rows}
