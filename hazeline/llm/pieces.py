"""SentencePiece encoding and decoding by a table of prefixes.

The encoding by merges of a text determines that of each of its prefixes, and so the last token of each prefix. The table
holds these tokens: of the pieces that end at a position (found by an automaton) exactly one is compatible with the last token
of the prefix before it, which means that merging the two texts yields just the two tokens. The ids are then read backwards.
A position costs as many tests as pieces end there, so a text of any length takes linear time.

No piece has a space after another character (checked when the vocabulary is read), so no token crosses such a place: texts
are cut there, and the tokens of recurring chunks are kept in a bounded memory.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
_CHUNK = re.compile(" *[^ ]+| +$")


class Vocabulary(NamedTuple):
    """pieces: text of each id. score: of pieces that merges may make. byte: id of each byte. silent: ids of control symbols.
    whole: pieces that their own merges lead to. unknown, end: ids. surface: what an unknown id is decoded to."""

    pieces: list[str]
    score: dict[str, float]
    byte: list[int]
    silent: set[int]
    whole: list[str]
    unknown: int
    end: int
    surface: str


def vocabulary(path: str) -> Vocabulary:
    """Reads a model file on the driver; its size doesn't depend on the data. Refuses what the table isn't made for: models
    that aren't merges of pieces, that rewrite characters, or that have pieces which are cut from the text beforehand."""
    m = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    kinds, norm = m.SentencePiece, m.normalizer_spec
    if m.trainer_spec.model_type != m.trainer_spec.BPE or not m.trainer_spec.byte_fallback:
        raise ValueError("not a model of merges with byte fallback")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model rewrites texts before it merges")
    of = lambda kind: [k for k, p in enumerate(m.pieces) if p.type == kind]
    if of(kinds.USER_DEFINED) or of(kinds.UNUSED):
        raise ValueError("the model has user-defined or unused pieces")
    pieces = [p.piece for p in m.pieces]
    score = {pieces[k]: m.pieces[k].score for k in of(kinds.NORMAL)}
    if any(SPACE in p.lstrip(SPACE) for p in score):
        raise ValueError("a piece has a space after another character")
    byte = [0] * 256
    for k in of(kinds.BYTE):
        byte[int(pieces[k][3:-1], 16)] = k
    whole = [p for p in score if merged(p, score) == [p]]
    return Vocabulary(pieces, score, byte, set(of(kinds.CONTROL)), whole, of(kinds.UNKNOWN)[0], m.trainer_spec.eos_id, m.trainer_spec.unk_surface)


def _pack(k: int) -> bytes:
    return k.to_bytes(4, "little")


def merged(text: str, score: dict[str, float]) -> list[str]:
    """The tokens of a short text by merging: time and again the pair whose piece scores most, the leftmost of several."""
    parts = list(text)
    pairs = [score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while found := [s for s in pairs if s is not None]:
        k = pairs.index(max(found))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del pairs[k]
        if k:
            pairs[k - 1] = score.get(parts[k - 1] + parts[k])
        if k < len(pairs):
            pairs[k] = score.get(parts[k] + parts[k + 1])
    return parts


class Pairs(dict):
    """Whether two adjacent tokens stand, by (token, token); kept for up to a million pairs, then gathered anew."""

    def __init__(self, score: dict[str, float]):
        self.score = score

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= 1_000_000:
            self.clear()
        self[pair] = ok = merged(pair[0] + pair[1], self.score) == [*pair]
        return ok


class Encoder(dict):
    """Ids of a chunk as packed 32-bit numbers, by chunk. Chunks of up to 64 characters are kept, up to 600,000 of them, then
    gathered anew."""

    def __init__(self, v: Vocabulary):
        self.pairs = Pairs(v.score)
        self.packed = {p: _pack(k) for k, p in enumerate(v.pieces) if p in v.score}
        self.byte = [_pack(k) for k in v.byte]
        self.ends = ahocorasick.Automaton()
        for p in v.whole:
            self.ends.add_word(p, (p, len(p)))
        self.ends.make_automaton()

    def tokens(self, text: str) -> list[str]:
        """The table of the last token of each prefix, then backwards. A character without any piece is its own token."""
        last, pairs, done = list(text), self.pairs, -1
        for end, (token, n) in self.ends.iter(text):
            if end != done and (n > end or pairs[last[end - n], token]):
                last[end], done = token, end
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(t := last[at])
            at -= len(t)
        return out[::-1]

    def __missing__(self, chunk: str) -> bytes:
        tokens = self.tokens(chunk.replace(" ", SPACE))
        try:
            ids = b"".join([self.packed[t] for t in tokens])
        except KeyError:
            ids = b"".join([self.packed.get(t) or b"".join(self.byte[b] for b in t.encode()) for t in tokens])
        if len(chunk) <= 64:
            if len(self) >= 600_000:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text as packed 32-bit numbers, without the one that ends it."""
        return b"".join(map(self.__getitem__, _CHUNK.findall(" " + text.replace(SPACE, " ")))) if text else b""


class Decoder:
    def __init__(self, v: Vocabulary):
        self.v, self.bytes = v, {k: bytes([b]) for b, k in enumerate(v.byte)}
        self.table = [self.bytes.get(k, p.replace(SPACE, " ").encode()) for k, p in enumerate(v.pieces)]
        for k in v.silent:
            self.table[k] = b""
        self.table[v.unknown] = v.surface.encode()
        self.spaced = {k for k, p in enumerate(v.pieces) if p in v.score and p.startswith(SPACE)}

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space that encoding put in front goes, byte ids in a row are read as UTF-8, a byte that
        belongs to no character becomes U+FFFD."""
        first = next((k for k in ids if k not in self.v.silent), None)
        try:
            # a control symbol between byte ids parts them
            text = self._mended(ids) if not self.v.silent.isdisjoint(ids[:-1]) else b"".join(map(self.table.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = self._mended(ids)
        return text[1:] if first in self.spaced else text

    def _mended(self, ids: list[int]) -> str:
        out, run = [], b""
        for k in [*ids, None]:
            if k in self.bytes:
                run += self.bytes[k]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                run = run[n:]
            if k is not None:
                out.append(self.table[k].decode())
        return "".join(out)


def _encoding(v: Vocabulary):
    def run(batches):
        encoder, end = Encoder(v), _pack(v.end)
        for b in batches:
            ids = [encoder.encode(t.as_py() or "") + end for t in b.column("text")]
            offsets = np.cumsum([0, *map(len, ids)]) // 4
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["doc_id", "ids"])

    return run


def _decoding(v: Vocabulary):
    def run(batches):
        decoder = Decoder(v)
        for b in batches:
            texts = [decoder.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "ids")), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, ids) of each row of docs(doc_id, text): all ids of the whole text and the end id; null counts as empty and has
    the end id alone. Null and repeated doc_ids come back as they are, each row for itself; other columns are left out whatever
    their names; an empty table gives no rows. A task holds the vocabulary, two bounded memories and one Arrow batch."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoding(v), "doc_id long, ids array<int>")


def decoded(ids: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, ids, text) of each row of ids(doc_id, ids); null for null. Other columns are left out."""
    return ids.select("doc_id", "ids").mapInArrow(_decoding(v), "doc_id long, ids array<int>, text string")
