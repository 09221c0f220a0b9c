"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

An example demands (tokens, one segment, loss-bearing tokens). Each task packs the examples that it reads, out of a
bounded pool, one sequence at a time: of the examples that fit, it places the one whose demand has the largest dot
product with what is left of the sequence, all as shares of the limits and weighted by how scarce a limit is in the
pool; of equal ones the first in the pool. When none fits it cuts one to fit what is left. A sequence that a limit ends
before it is full is cut back to a power of two, which needs no padding, and what is cut off returns to the pool. No
rows are shuffled, and no sequence spans two tasks. The last examples of a task go to sequences of descending powers
of two.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import python_path
from .memory import Memory

POOL_SEQUENCES = 64  # most sequences' worth of tokens that wait in a task, besides the example that goes beyond it
_BLOCK = 1 << 18  # characters of a long text that are cut into parts at a time, on to the next space
_LETTERS = "a-zß-öø-ÿ"
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÿ]")
_SPACE = re.compile("[ \n]")
_SPLIT = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s{_LETTERS}0-9]+")


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space and never joins what it separates. Blocks of ASCII and
    Latin-1 letters are cut into words, digits and signs as the tokenizer cuts them; of other blocks, what stands between
    spaces is encoded by itself. Parts and chunks are encoded once and remembered.

    With ``added`` the tokenizer's added tokens that stand in a text get their own ids, as the library gives by default;
    else they are cut like any text."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        tokens = self.library.get_added_tokens_decoder() if added else {}
        if odd := [t.content for t in tokens.values() if t.single_word or t.lstrip or t.rstrip or t.normalized]:
            raise ValueError(f"added tokens that aren't matched as they stand: {odd}")
        self.added = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in tokens.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.model = self.library.model
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)  # how the tokenizer spells a letter's bytes
        self.spelled = {c: bytewise.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.parts = Memory(self._part)
        self.chunks = Memory(self._chunk)

    def _encode(self, part: str) -> bytes:
        return np.array(self.library.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """A part needs no cutting, so the library's model encodes it: a third of the time of a whole call."""
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.spelled))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        return self._encode(chunk) if _OTHER.search(chunk) else self._plain(chunk)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.cut and any(t in text for t in self.added):
            return b"".join([self.added[x] if k % 2 else self._between(x) for k, x in enumerate(self.cut.split(text))])
        return self._between(text)

    def _between(self, text: str) -> bytes:
        if len(text) <= _BLOCK:
            return self._block(text)
        out, at = [], 0
        while at < len(text):
            space = _SPACE.search(text, at + _BLOCK)
            end = space.end() if space else len(text)
            out.append(self._block(text[at:end]))
            at = end
        return b"".join(out)

    def _block(self, text: str) -> bytes:
        if _OTHER.search(text):
            return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _SPLIT.findall(text.lower())))


@functools.cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path, added=True)


class Packer:
    """Pool and open sequence of one task. ``add`` takes an example, ``rows`` gives pieces as
    (example, start, length, sequence, offset, last). The pool holds ``pool`` examples or ``POOL_SEQUENCES`` sequences'
    tokens, and one example more."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = 512):
        self.limit = np.array([tokens, segments, loss], dtype=np.int64)
        self.pool, self.n, self.total, self.sequence = pool, 0, 0, 0
        self.key = np.zeros(pool + 1, dtype=np.int64)
        self.start, self.left, self.quiet = (np.zeros(pool + 1, dtype=np.int64) for _ in range(3))

    def add(self, key: int, length: int, quiet: int) -> None:
        """``quiet``: how many tokens at the example's start bear no loss."""
        self.key[self.n], self.start[self.n], self.left[self.n], self.quiet[self.n] = key, 0, length, min(quiet, length)
        self.n += 1
        self.total += length

    def full(self) -> bool:
        return self.n > self.pool or self.total >= POOL_SEQUENCES * int(self.limit[0])

    def rows(self, end: bool = False) -> Iterator[tuple]:
        """Pieces until the pool is half full, or all."""
        while self.n and (end or self.n > self.pool // 2 or self.total >= POOL_SEQUENCES // 2 * int(self.limit[0])):
            limit = int(self.limit[0])
            yield from self._one(limit if self.total >= limit else 1 << self.total.bit_length() - 1)

    def _one(self, limit: int) -> Iterator[tuple]:
        (tokens, segments, loss), offset = self.limit.tolist(), 0
        rest, room, rest_loss = limit, segments, loss
        n = self.n
        left, quiet = self.left[:n], self.quiet[:n]
        loud = left - quiet
        # Weights of a demand: scarcity in the pool times what is left, each as a share of its limit.
        scarce_tokens, scarce_loss = self.total / tokens / tokens**2, int(loud.sum()) / loss / loss**2
        took: list[tuple[int, int, int]] = []
        while rest and room and len(took) < n:
            fits = (loud <= rest_loss) & (left <= rest) & (left > 0)
            at = int(np.where(fits, left * (scarce_tokens * rest) + loud * (scarce_loss * rest_loss), -1.0).argmax())
            if fits[at]:
                take = int(left[at])
            else:
                best = np.minimum(np.minimum(left, rest), quiet + rest_loss)
                at = int(best.argmax())
                take = int(best[at])
                if not take:
                    break
            took.append((at, take, int(quiet[at])))
            rest_loss -= max(0, take - int(quiet[at]))
            rest -= take
            room -= 1
            self.start[at] += take
            left[at] -= take
            quiet[at] = max(0, int(quiet[at]) - take)
            loud[at] = left[at] - quiet[at]
        whole = limit - rest
        whole = whole if whole == tokens else 1 << whole.bit_length() - 1
        for at, take, was in took:
            keep = min(take, whole - offset)
            if back := take - keep:
                self.start[at] -= back
                left[at] += back
                quiet[at] = max(0, was - keep)
            if keep:
                yield int(self.key[at]), int(self.start[at]) - keep, keep, self.sequence, offset, not left[at]
                offset += keep
        self.sequence += 1
        self.total -= offset
        alive = np.flatnonzero(left)
        if len(alive) < n:
            for a in (self.key, self.start, self.left, self.quiet):
                a[: len(alive)] = a[:n][alive]
            self.n = len(alive)


def _pack(path: str, end_id: int, tokens: int, segments: int, loss: int, share: float, schema: pa.Schema):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        high = TaskContext.get().partitionId() << 32
        packer, held, out = Packer(tokens, segments, loss), {}, []

        def drain(last: bool) -> None:
            for key, start, length, sequence, offset, done in packer.rows(last):
                doc, ids = held[key]
                out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, high | sequence, offset))
                if done:
                    del held[key]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out.clear()
            return batch

        count = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                for doc, text, quiet in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids = memoryview(words.encode(text) + end)
                    held[count] = (doc, ids)
                    packer.add(count, len(ids) // 4, max(quiet, int(share * (len(ids) // 4))))
                    count += 1
                    if packer.full():
                        drain(False)
                        if len(out) >= 4096:
                            yield flush()
        drain(True)
        if out:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, tokens: int = 4096, segments: int = 1024, loss_tokens: int | None = None, quiet: Column | None = None, quiet_share: float = 0.0, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's ids (with added tokens in the text as their own ids) and ``end_id`` into sequences. A row
    for each piece: (``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``segments`` and ``loss_tokens`` limit a sequence's pieces and loss-bearing tokens (by default all its tokens);
    ``quiet`` is the number of leading tokens of a document without loss, such as a prompt's (by default 0, as for
    null or negative numbers), and ``quiet_share`` the least share of its tokens that are such. A null text counts as empty and gives its end id alone; null ids are kept; repeated
    rows are packed as often as they occur; a long text takes as many sequences as it needs; no rows give no rows.
    """
    python_path(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    head = pa.string() if kind.simpleString() == "string" else pa.int64()
    schema = pa.schema([(id_col, head), *((n, pa.int64()) for n in names)])
    rows = docs.select(
        F.col(id_col) if head == pa.string() else F.col(id_col).cast("bigint"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.greatest(F.coalesce(quiet if quiet is not None else F.lit(0), F.lit(0)).cast("bigint"), F.lit(0)).alias("quiet"),
    )
    out = ", ".join([f"`{id_col}` {'string' if head == pa.string() else 'bigint'}", *(f"{n} bigint" for n in names)])
    return rows.mapInArrow(_pack(tokenizer_path, end_id, tokens, segments, loss_tokens or tokens, quiet_share, schema), out)
