"""SentencePiece encoding with the byte span of every piece, and decoding.

The normaliser is this module's: at each place the longest key of the model's
compiled character map is replaced, then white space is escaped as the model
says. Each step keeps its edits (place and length before and after), and all
else is copied, so any byte of the normalised text is traced back through the
edits to the original text. The normalised text goes to the library's merges,
under a copy of the model whose own normaliser does nothing. Where no piece has
the space symbol after another character, merges never cross the start of a
word, so a long text is merged in parts that end before one; else it is merged
at once.

Defined cases: null counts as empty, and an empty text has the end id only (no
prefix is put before it); bytes that aren't UTF-8 become U+FFFD; repeated rows
stay, also those without a doc_id; columns other than doc_id and text are not
read; an empty table gives no rows. One word without a space is merged at once,
however long, and the ids of a text are decoded at once.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from volspark.llm.common import byte_texts, slices

#: Fixed value: the symbol that stands for a space in pieces.
SYMBOL = "▁"
#: Characters of a text that are merged at once, up to the next word.
PART = 1 << 14
#: Fields of the model's message and of its normaliser.
PIECES, NORMALIZER, NAME, CHARSMAP, DUMMY, EXTRA, ESCAPE = 1, 3, 1, 2, 3, 4, 5
#: Types of pieces.
USER_DEFINED, BYTE = 4, 6


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; numbers and byte strings."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = raw[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = number() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
        yield tag >> 3, raw[at : at + size]
        at += size


def map_rules(blob: bytes) -> dict[str, str]:
    """Keys and replacements of a compiled character map.

    The map is the size of a double array, its units, and the replacements, each
    ended by a zero byte. A unit holds its label in the low byte, the offset of
    its children, and whether a value stands at child zero.
    """
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, ends = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4), blob[4 + size :]
    rules: dict[str, str] = {}
    labels = np.arange(1, 256, dtype=np.uint32)

    def children(node: int) -> int:
        unit = int(units[node])
        return node ^ (unit >> 10 << ((unit & 512) >> 6))

    todo = [(children(0), b"")]
    while todo:
        base, key = todo.pop()
        at = base ^ labels
        at, label = at[at < len(units)], labels[at < len(units)]
        for node, c in zip(at[(found := (units[at] & np.uint32(0x800000FF)) == label)].tolist(), label[found].tolist(), strict=True):
            longer, below = key + bytes([c]), children(node)
            if int(units[node]) >> 8 & 1:
                value = int(units[below]) & 0x7FFFFFFF
                rules[longer.decode("utf-8", "replace")] = ends[value : ends.index(b"\0", value)].decode("utf-8", "replace")
            todo.append((below, longer))
    return rules


class Edits:
    """Replaced parts of a text, in order: byte places and lengths in the new text and in the old."""

    def __init__(self, new: np.ndarray, new_size: np.ndarray, old: np.ndarray, old_size: np.ndarray) -> None:
        self.new, self.old = new, old
        self.new_end, self.old_end = new + new_size, old + old_size

    @classmethod
    def of(cls, parts: list[tuple[int, int, int]]) -> Edits:
        """From (place in the old text, length there, length in the new text)."""
        old, old_size, new_size = (np.array(c, dtype=np.int64) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
        grown = np.cumsum(new_size - old_size)
        return cls(old + np.concatenate((grown[:0], [0], grown[:-1]))[: len(old)], new_size, old, old_size)

    def source(self, at: np.ndarray) -> np.ndarray:
        """Places in the old text; what lies inside of a replaced part comes from the start of the part."""
        if not len(self.new):
            return at
        i = np.searchsorted(self.new, at, side="right") - 1
        j = np.maximum(i, 0)
        return np.where(i < 0, at, np.where(at >= self.new_end[j], self.old_end[j] + at - self.new_end[j], self.old[j]))


def _one_of(chars: set[str]) -> str:
    """A pattern of these characters; of all above the basic plane, if one of them is there."""
    high = "\U00010000-\U0010ffff" if max(chars) > "\uffff" else ""
    return f"[{''.join(re.escape(c) for c in sorted(chars) if c <= chr(0xFFFF))}{high}]"


class Normaliser:
    """The normaliser that a model describes; the texts and edits of its two steps."""

    def __init__(self, rules: dict[str, str], kept: Iterable[str] = (), dummy: bool = True, extra: bool = True, escape: bool = True) -> None:
        self.kept = set(kept)
        self.rules, self.dummy, self.extra, self.escape = {**rules, **{k: k for k in self.kept}}, dummy, extra, escape
        self.lengths = sorted({len(k) for k in self.rules}, reverse=True)
        single = {k for k in self.rules if len(k) == 1}
        pairs = {(k[0], k[1]) for k in self.rules if len(k) > 1 and k[0] not in single}
        parts = [_one_of(single)] if single else []
        parts += [f"{_one_of({a for a, _ in pairs})}(?={_one_of({b for _, b in pairs})})"] if pairs else []
        #: Where a key can start, and other places.
        self.starts = re.compile("|".join(parts)) if parts else None

    def _longest(self, text: str, at: int) -> str | None:
        """The longest key that the text has here; symbols of the model go before the map."""
        if self.kept:
            for n in self.lengths:
                if text[at : at + n] in self.kept:
                    return text[at : at + n]
        for n in self.lengths:
            if len(key := text[at : at + n]) == n and key in self.rules:
                return key
        return None

    def mapped(self, text: str) -> tuple[str, Edits]:
        """The text after the character map."""
        if self.starts is None:
            return text, Edits.of([])
        out: list[str] = []
        parts: list[tuple[int, int, int]] = []
        done = at = place = 0
        while (found := self.starts.search(text, at)) is not None:
            key = self._longest(text, found.start())
            if key is None:
                at = found.start() + 1
                continue
            between, new = text[done : found.start()], self.rules[key]
            out += [between, new]
            place += len(between.encode())
            parts.append((place, size := len(key.encode()), len(new.encode())))
            place += size
            done = at = found.start() + len(key)
        return "".join([*out, text[done:]]), Edits.of(parts)

    def spaced(self, text: str) -> tuple[str, Edits]:
        """The text after the rules of white space."""
        raw = text.encode()
        symbol = SYMBOL if self.escape else " "
        width = len(symbol.encode())
        if not self.extra:
            if not text:
                return text, Edits.of([])
            at = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)
            old = np.concatenate(([0], at)) if self.dummy else at
            old_size = np.ones(len(old), dtype=np.int64)
            if self.dummy:
                old_size[0] = 0
            grown = np.cumsum(width - old_size)
            new = old + np.concatenate((grown[:0], [0], grown[:-1]))[: len(old)]
            return (symbol if self.dummy else "") + text.replace(" ", symbol), Edits(new, np.full(len(old), width), old, old_size)
        bare = text.rstrip(f" {SYMBOL}" if self.escape else " ")
        lead = len(bare) - len(bare.lstrip(" "))
        if not bare[lead:]:
            return "", Edits.of([])
        parts = [(0, lead, 0)] + ([(lead, 0, width)] if self.dummy else [])
        parts += [(lead + m.start(), m.end() - m.start(), width) for m in re.finditer(rb" +", raw[lead : len(bare.encode())])]
        return (symbol if self.dummy else "") + re.sub(" +", symbol, bare[lead:]), Edits.of(parts)

    def __call__(self, text: str) -> tuple[str, list[Edits]]:
        """The normalised text, and the edits that lead back from it, last step first."""
        mapped, first = self.mapped(text)
        spaced, second = self.spaced(mapped)
        return spaced, [second, first]


class Pieces:
    """A model read from its file's bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        spec: dict[int, int | bytes] = {}
        copy, pieces = [], []
        for number, value in message_fields(model):
            if number == NORMALIZER:
                spec = dict(message_fields(value))
            elif isinstance(value, bytes):
                if number == PIECES:
                    pieces.append(dict(message_fields(value)))
                copy.append(_varint(number << 3 | 2) + _varint(len(value)) + value)
        plain = b"".join([_varint(NAME << 3 | 2), _varint(8), b"identity", *[_varint(k << 3) + b"\0" for k in (DUMMY, EXTRA, ESCAPE)]])
        copy.append(_varint(NORMALIZER << 3 | 2) + _varint(len(plain)) + plain)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=b"".join(copy))
        names = [p[1].decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        self.normaliser = Normaliser(map_rules(spec.get(CHARSMAP, b"")), [n for n, k in zip(names, kinds, strict=True) if k == USER_DEFINED], *[bool(spec.get(k, 1)) for k in (DUMMY, EXTRA, ESCAPE)])
        #: Bytes of the normalised text that a piece covers; unknown pieces, which have none of their own, are merged with their text.
        self.sizes = np.array([1 if k == BYTE else len(n.encode()) for n, k in zip(names, kinds, strict=True)], dtype=np.int64)
        self.unknown = self.processor.unk_id()
        self.by_word = all(SYMBOL not in n.lstrip(SYMBOL) for n in names)
        self.boundary = re.compile(f"[^{SYMBOL}](?={SYMBOL})")

    def parts(self, normalised: str) -> Iterator[str]:
        """The text in parts of about PART characters that no piece can join; in one part if the model has pieces across words."""
        at = 0
        while self.by_word and len(normalised) - at > PART and (found := self.boundary.search(normalised, at + PART)):
            yield normalised[at : found.end()]
            at = found.end()
        yield normalised[at:] if at else normalised

    def ids(self, normalised: str) -> np.ndarray:
        found = [np.array(self.merges.encode(p), dtype=np.int32) for p in self.parts(normalised)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def piece_sizes(self, ids: np.ndarray, normalised: str) -> np.ndarray:
        """Bytes of the normalised text that each id covers."""
        sizes = self.sizes[ids]
        if (ids == self.unknown).any():
            protos = [self.merges.encode(p, return_type="proto") for p in self.parts(normalised)]
            sizes = np.array([len(x.surface.encode()) for p in protos for x in p.pieces], dtype=np.int64)
        return sizes

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the end id, and starts and ends of their spans in the bytes of the text; the end id's is empty at the end."""
        normalised, edits = self.normaliser(text)
        ids = self.ids(normalised)
        at = np.concatenate(([0], np.cumsum(self.piece_sizes(ids, normalised))))
        for e in edits:
            at = e.source(at)
        whole = len(text.encode())
        return np.append(ids, self.processor.eos_id()).astype(np.int32), np.append(at[:-1], whole), np.append(at[1:], whole)

    def decode(self, ids: np.ndarray) -> str:
        return self.processor.decode(ids.tolist())


_loaded: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    """The model, once a worker."""
    key = hashlib.blake2b(model, digest_size=16).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


#: Columns that can be asked for.
KINDS = {"n_tokens": "long", "ids": "array<int>", "starts": "array<long>", "ends": "array<long>", "decoded": "string", "ids_sha256": "string", "spans_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _encode(batches: Iterable[pa.RecordBatch], model: bytes, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    pieces = load(model)
    for batch in slices(batches, "text"):
        rows = []
        for raw in byte_texts(batch.column(1)):
            text = raw.decode("utf-8", "replace")
            ids, starts, ends = pieces.encode(text)
            row: dict[str, object] = {"n_tokens": len(ids), "ids": ids, "starts": starts, "ends": ends}
            if "decoded" in columns or "decoded_sha256" in columns:
                row["decoded"] = pieces.decode(ids)
                row["decoded_sha256"] = _sha(row["decoded"].encode())
            if "ids_sha256" in columns:
                row["ids_sha256"] = _sha(" ".join(map(str, ids.tolist())).encode())
            if "spans_sha256" in columns:
                row["spans_sha256"] = _sha(np.stack([starts, ends], 1).astype("<i8").tobytes())
            rows.append([row[c] for c in columns])
        values = [pa.array([r[i] for r in rows], _ARROW[KINDS[c]]) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *values], names=["doc_id", *columns])


def read_model(path: str) -> bytes:
    """The bytes of a model file, which go to the tasks with the function."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, columns: tuple[str, ...] = ("n_tokens", "ids", "starts", "ends")) -> DataFrame:
    """doc_id and the columns asked for, of KINDS: ids with the end id, byte spans [start, end) of their pieces in the text, the decoded text, and digests of these."""
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {KINDS[c]}" for c in columns)
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, model=model, columns=tuple(columns)), kind)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [pieces.processor.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded string")
