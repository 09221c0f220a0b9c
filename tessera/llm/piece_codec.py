"""SentencePiece encoding and decoding for merge-type (BPE) models, exact, by backtracking.

The plain encoder merges the neighbouring pair whose union has the best score until nothing merges. A sequence of
pieces is its result exactly when each piece re-merges to itself and each two neighbours re-merge to just these two.
So the encoder walks a text with the longest piece at each position (Aho-Corasick), accepts it when it is compatible
with the piece before (re-merging the two, remembered by pair), tries shorter prefixes otherwise, and steps back
where none is left, marking the position in a bitfield of failed positions, which is never entered again.

Where no piece holds the space mark behind another character, no merge crosses the start of a word, and none crosses
two characters that no piece holds side by side. Words, and their parts between such places, are encoded one by one
and remembered in bounded tables. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import python_path
from .memory import Memory

SPACE = "▁"
# Fixed values of the model file: piece types, and the number of the BPE model type.
NORMAL, USER_DEFINED, UNUSED, BPE = 1, 4, 5, 2
REMEMBERED = 300_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffers message; values of fixed width as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def refused(model: bytes) -> str | None:
    """Why a model can't be encoded by merging alone: it isn't of the merge type, or has pieces that are taken before
    merging (user-defined) or taken apart after it (unused)."""
    kinds, model_type = set(), 1
    for field, value in _fields(model):
        if field == 1:
            kinds.add(dict(_fields(value)).get(3, NORMAL))
        elif field == 2:
            model_type = dict(_fields(value)).get(3, model_type)
    if model_type != BPE:
        return "the model isn't of the merge type (BPE)"
    return "the model has user-defined or unused pieces" if kinds & {USER_DEFINED, UNUSED} else None


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that is part of no character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "\ufffd")
            at += e.start + 1
    return "".join(out)


class PieceCodec:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        sp, n = self.library, self.library.get_piece_size()
        if why := refused(sp.serialized_model_proto()):
            raise ValueError(f"{model_path}: {why}")
        self.byte_ids, self.score, self.ids = {}, {}, {}
        self.surface: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.surface[str(i)] = chr(value) if value < 0x80 else chr(0xDC00 + value)
            elif sp.is_control(i):
                self.surface[str(i)] = ""
            elif sp.is_unknown(i):
                self.surface[str(i)] = " ⁇ "
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.surface[str(i)] = piece.replace(SPACE, " ")
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.unknown = sp.unk_id()
        spec = next((dict(_fields(v)) for f, v in _fields(sp.serialized_model_proto()) if f == 3), {})
        self.strips_all = bool(spec.get(4, 1))  # the model drops extra spaces
        self.strips = bool(spec.get(3, 1)) or self.strips_all  # or puts one before a text
        self.byte_of = {str(i): b for b, i in self.byte_ids.items()}
        self.plain = {str(i) for i in self.ids.values()}
        known = "".join(re.escape(p) for p in self.ids if len(p) == 1)
        self.known = re.compile(f"[{known}]+|[^{known}]")
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.fits: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}
        self.side_by_side = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.parts = Memory(lambda part: [self.ids[p] for p in self.backtrack(part)])
        self.words = Memory(lambda chunk: ",".join(map(str, self.encode_chunk(chunk))))
        self.after_space = Memory(lambda word: ",".join(map(str, self.encode_chunk(SPACE + word))))

    def merge(self, text: str) -> list[str]:
        """The plain encoder, for short texts of known characters."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: str, piece: str) -> bool:
        key = (before, piece)
        fits = self.fits.get(key)
        if fits is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            fits = self.fits[key] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return fits

    def prefix(self, piece: str) -> str | None:
        """The longest piece that is a proper prefix."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), None)
        return self.shorter[piece]

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text of known characters."""
        n = len(text)
        longest = [1] * n
        for end, length in self.automaton.iter(text):
            start = end + 1 - length
            if length > longest[start]:
                longest[start] = length
        failed = bytearray((n >> 3) + 1)
        fits, compatible = self.fits, self.compatible
        pieces: list[str] = []
        pos, piece, before = 0, text[: longest[0]] if n else None, ""
        while piece is not None:
            end = pos + len(piece)
            fit = False
            if not failed[end >> 3] >> (end & 7) & 1:
                fit = fits.get((before, piece))
                if fit is None:
                    fit = compatible(before, piece)
            if fit:
                pieces.append(piece)
                pos, before = end, piece
                piece = text[pos : pos + longest[pos]] if pos < n else None
                continue
            piece = self.prefix(piece)
            if piece is None:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = pieces.pop()
                pos -= len(piece)
                before = pieces[-1] if pieces else ""
        return pieces

    def encode_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for part in self.known.findall(chunk):
            if part[0] in self.ids:
                at = 0
                for i in range(1, len(part)):
                    if part[i - 1 : i + 1] not in self.side_by_side:
                        ids += self.parts[part[at:i]]
                        at = i
                ids += self.parts[part[at:]]
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def encode_joined(self, text: str) -> str:
        """The ids as decimal numbers joined by commas."""
        text = self.library.normalize(text) if text else ""
        if not text:
            return ""
        if not self.by_word:
            return ",".join(map(str, self.encode_chunk(text)))
        if text[0] == SPACE and text[-1] != SPACE and SPACE * 2 not in text:
            return ",".join(map(self.after_space.__getitem__, text[1:].split(SPACE)))
        return ",".join(map(self.words.__getitem__, _CHUNK.findall(text)))

    def decode_joined(self, ids: str) -> str:
        """The text of decimal ids joined by commas, as the library decodes them."""
        if not ids:
            return ""
        each = ids.split(",")
        if each[0] in self.plain and not (self.strips_all and self.surface[each[0]] == " "):
            text = "".join(map(self.surface.__getitem__, each))
            text = text[1:] if text[:1] == " " and self.strips else text
            try:
                text.encode()
                return text
            except UnicodeEncodeError:
                pass
        return self.decode_pieces(each)

    def decode_pieces(self, ids: list[str]) -> str:
        """The space mark of a piece goes while nothing stands before it; runs of byte pieces are read together."""
        out: list[str] = []
        held, bare = bytearray(), True
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            bare = bare and not any(out)
            surface = self.surface[i]
            if bare and self.strips and i in self.plain and surface[:1] == " ":
                surface, bare = surface[1:], self.strips_all
            out.append(surface)
        out.append(_utf8(bytes(held)))
        return "".join(out)


@functools.cache
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def _apply(docs: DataFrame, id_col: str, value, schema: str, row) -> DataFrame:
    python_path(docs.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = list(zip(*map(row, part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, value).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>): no begin or end ids, no sampling. A null text counts as empty and has no ids; ids
    of rows and repeated rows pass through as they are; other columns are not read; no rows give no rows."""

    def row(text: str) -> tuple:
        ids = codec(model_path).encode_joined(text)
        return ([int(x) for x in ids.split(",")] if ids else [],)

    out = _apply(docs, id_col, F.coalesce(F.col(text_col), F.lit("")), "ids array<bigint>", row)
    return out.withColumn("ids", F.col("ids").cast("array<int>"))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, text string) of ids as the library decodes them; null or empty ids give the empty text."""

    def row(ids: str) -> tuple:
        return (codec(model_path).decode_joined(ids),)

    return _apply(encoded, id_col, F.coalesce(F.array_join(F.col(ids_col).cast("array<string>"), ","), F.lit("")), "text string", row)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: (``id_col``, n_tokens long, ids_sha256, decoded_sha256). The rules for
    nulls, repeats and empty tables are those of ``encode``."""

    def row(text: str) -> tuple:
        ids = codec(model_path).encode_joined(text)
        decoded = codec(model_path).decode_joined(ids)
        return (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    return _apply(docs, id_col, F.coalesce(F.col(text_col), F.lit("")), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
