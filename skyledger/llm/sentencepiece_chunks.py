"""SentencePiece ids by a table of distinct chunks.

The tokenizer writes a marker for each space and one before the text.  Where no piece of the vocabulary has a marker
behind another character, no merge crosses from a character to a marker: each chunk, a run of markers with
the characters behind it, is segmented by itself.  So each distinct chunk of the corpus is segmented once, and the ids are
joined back by position.

A row for each chunk of each document would be many times the text.  Consecutive documents form blocks of
``BLOCK_BYTES`` of text.  A block lists its distinct chunks, dealt by hash into the parts of the corpus-wide table; a row of the exchange is the
list that a block has in a part, packed.  A part takes the lists of all blocks in turn, segments each chunk as it meets it first,
and answers with ids.  A block's answers then meet its documents, kept as chunk numbers, and every number becomes its ids.
However frequent a chunk is, a block asks for it once, so no key is hot; a task holds one block, or one part of the table
(beyond ``HELD`` chunks a part starts anew, so memory is bounded whatever the corpus, and a chunk met again is segmented again).

Blocks are made twice, for the lists and for the documents, so ``docs`` must give its rows in the same order when read again, as files do;
a block that comes out otherwise is an error, not a wrong result.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows each get a row; a text of one chunk is
one lookup; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_only, map_rows, slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Text of a block, and of all blocks for each part of the table, of which there are at most ``PARTS``.
BLOCK_BYTES, PART_BYTES, PARTS = 8 << 20, 1 << 20, 4096
#: Distinct chunks that a part of the table holds at a time.
HELD = 1 << 21


@lru_cache(maxsize=2)
def processor(path: str):
    """The tokenizer of a model file; an error where chunks of its texts depend on each other."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("a piece has a marker behind another character, so chunks are not independent")
    # Texts that tell normalizers, prefixes and squeezed spaces apart.
    for text in ("a", " a", "a  b ", "①ﬁ x", "　\ta"):
        if [i for c in chunks(text) for i in segment(sp, [c])[0]] != sp.encode(text):
            raise ValueError("the model changes texts otherwise than by a marker for each space and one before them")
    return sp


def chunks(text: str) -> list[str]:
    """The chunks of a text, markers written out."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(sp, found: list[str]) -> list[list[int]]:
    """Ids of each chunk; the tokenizer writes the first marker itself, but not before an empty text."""
    bare = [c[1:] for c in found]
    return [ids if text else [sp.piece_to_id(MARK)] for text, ids in zip(bare, sp.encode(bare, num_threads=1), strict=True)]


# Chunks have no space, so a space parts them in a packed list.
def _packed(found: list[str]) -> bytes:
    return zstandard.compress(" ".join(found).encode("utf-8", "surrogatepass"))


def _unpacked(blob: bytes) -> list[str]:
    return zstandard.decompress(blob).decode("utf-8", "surrogatepass").split(" ")


def _numbers(values) -> bytes:
    """Numbers from 0 on in the least width that holds them; of wide ones the first bytes of all come first, then the second, which packs better."""
    whole = np.asarray(values, np.uint32)
    kind = np.min_scalar_type(int(whole.max())) if len(whole) else np.dtype(np.uint8)
    own = whole.astype(kind)
    return bytes([kind.itemsize]) + zstandard.compress(own.view(np.uint8).reshape(-1, 4).T.tobytes() if kind.itemsize == 4 else own.tobytes())


def _read_numbers(blob: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8)
    own = np.ascontiguousarray(flat.reshape(4, -1).T).view(np.uint32).ravel() if blob[0] == 4 else flat.view(f"u{blob[0]}")
    return own.astype(np.int64)


class Block:
    """Documents as numbers of their chunks, by first use."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.sequence: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found, known = chunks(text), self.known
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.sequence += [known.setdefault(c, len(known)) for c in found]
        self.bytes += len(text) + 64

    def parts(self, n: int) -> np.ndarray:
        """The part of the table of each chunk, by number."""
        return np.fromiter((zlib.crc32(c.encode("utf-8", "surrogatepass")) % n for c in self.known), np.uint16, len(self.known))

    def sign(self) -> int:
        """Changes with the chunks or their order."""
        return zlib.crc32("".join(self.known).encode("utf-8", "surrogatepass"))


def _blocks(batches, size: int) -> Iterator[tuple[int, Block]]:
    """Blocks of a task with a number of their own."""
    nth, block = TaskContext.get().partitionId() << 32, Block()
    for batch in slices(batches):
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block.add(doc_id, text)
            if block.bytes >= size:
                yield nth, block
                nth, block = nth + 1, Block()
    if block.ids:
        yield nth, block


def _lists(texts: DataFrame, parts: int, size: int) -> DataFrame:
    """``block, sign, part, chunks``: the chunks of a block that are of a part, packed, by number."""

    def make(batches):
        for nth, block in _blocks(batches, size):
            part, names, sign = block.parts(parts), list(block.known), block.sign()
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.diff(part[order])) + 1
            for own in np.split(order, ends) if len(order) else []:
                yield pa.RecordBatch.from_pydict({"block": [nth], "sign": [sign], "part": pa.array([int(part[own[0]])], pa.int32()), "chunks": [_packed([names[i] for i in own.tolist()])]})

    return texts.mapInArrow(make, "block long, sign long, part int, chunks binary")


def _answers(lists: DataFrame, model: str, held: int) -> DataFrame:
    """``block, sign, part, counts, ids``: the ids of each list; each chunk of a part is segmented once."""

    def make(batches):
        sp, table, current = processor(model), {}, None
        for batch in batches:
            for block, sign, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current or len(table) > held:
                    table, current = {}, part
                found = _unpacked(blob)
                new = [c for c in found if c not in table]
                table.update(zip(new, (np.array(ids, np.int32).tobytes() for ids in segment(sp, new)), strict=True))
                own = [table[c] for c in found]
                yield pa.RecordBatch.from_pydict({"block": [block], "sign": [sign], "part": pa.array([part], pa.int32()), "counts": [_numbers([len(ids) // 4 for ids in own])], "ids": [_numbers(np.frombuffer(b"".join(own), np.int32))]})

    dealt = lists.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(make, "block long, sign long, part int, counts binary, ids binary")


def _gathered(answers: pd.DataFrame, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all chunks of a block, and where those of each chunk number start and how many they are."""
    start, count, flat, at = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), [np.zeros(0, np.int64)], 0
    order = np.argsort(part, kind="stable")
    first = np.searchsorted(part[order], np.arange(int(part.max()) + 2 if len(part) else 1))
    for number, counts, ids in zip(answers["part"], answers["counts"], answers["ids"], strict=True):
        own, n, found = order[first[number] : first[number + 1]], _read_numbers(counts), _read_numbers(ids)
        start[own], count[own] = at + np.cumsum(n) - n, n
        flat.append(found)
        at += len(found)
    return np.concatenate(flat), start, count


def encode(docs: DataFrame, *, model: str, ids: bool = True, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, held: int = HELD) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every row of ``docs``.

    ``model`` is a SentencePiece model file found at that path on every executor.  ``ids_sha256`` hashes the ids in decimal, joined by
    commas; ``decoded_sha256`` hashes the text that the library decodes them to.  ``ids=False`` leaves the ids out.
    """
    texts = docs_only(docs, "doc_id", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(PARTS, 1 + total // part_bytes)
    answers = _answers(_lists(texts, parts, block_bytes), model, held)

    def kept(batches):
        for nth, block in _blocks(batches, block_bytes):
            yield pa.RecordBatch.from_pydict({
                "block": [nth], "sign": [block.sign()], "doc_ids": pa.array([block.ids], pa.list_(pa.int64())), "sizes": pa.array([block.sizes], pa.list_(pa.int32())),
                "parts": [_numbers(block.parts(parts))], "sequence": [_numbers(block.sequence)],
            })

    documents = texts.mapInArrow(kept, "block long, sign long, doc_ids array<long>, sizes array<int>, parts binary, sequence binary")
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        sp = processor(model)
        decimal = [f"{i}," for i in range(sp.get_piece_size())]
        rows = []
        if left.num_rows != 1 or set(right["sign"].to_pylist()) - set(left["sign"].to_pylist()):
            raise RuntimeError("a block of documents came out otherwise when it was read again: write the documents first")
        block = left.to_pylist()[0]
        flat, start, count = _gathered(right.select(["part", "counts", "ids"]).to_pandas(), _read_numbers(block["parts"]))
        sequence, at = _read_numbers(block["sequence"]), 0
        for doc_id, size in zip(block["doc_ids"], block["sizes"], strict=True):
            own = sequence[at : at + size]
            at += size
            n = count[own]
            # Where each id comes from: the start of its chunk's ids and the place among them.
            found = flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tolist()
            decoded = sp.decode(found) if found else ""
            digest = hashlib.sha256("".join(map(decimal.__getitem__, found))[:-1].encode()).hexdigest()
            rows.append((doc_id, len(found), digest, hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), found if ids else None))
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])

    out = documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
    return out if ids else out.drop("ids")


def decode(rows: DataFrame, *, model: str) -> DataFrame:
    """``doc_id, text`` of ``rows(doc_id, ids)``."""
    return map_rows(rows.select("doc_id", "ids"), lambda: lambda doc_id, ids: (doc_id, processor(model).decode(list(ids or []))), "doc_id long, text string")
