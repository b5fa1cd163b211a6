"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import pick

END_ID = 1
WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16 * WINDOW
# Tokens that one task holds while it packs them. Every shard is packed by itself.
SHARD_TOKENS = 2_000_000
_MEMO_WORDS = 300_000
_CHUNK_CHARS = 1_000_000
_LONG_WORD = 64
_SPACE = re.compile("[\t\n\r\xa0 ]")

# Classes of the characters that the vectorised way knows: 0 space, 1 letter, 2 digit, 3 other, 9 unknown.
_CODES = 0x2100


def _classes() -> np.ndarray:
    table = np.full(_CODES, 9, dtype=np.uint8)
    table[0x21:0x7F] = table[0xA1:0xC0] = 3
    table[[0x09, 0x0A, 0x0D, 0x20, 0xA0]] = 0
    table[ord("a") : ord("z") + 1] = table[0xDF:0x250] = table[[0xAA, 0xB5, 0xBA]] = 1
    table[ord("0") : ord("9") + 1] = table[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
    table[[0xD7, 0xF7]] = 3
    table[0x2010:0x2028] = table[0x2030:0x205F] = table[0x20AC] = 3
    return table


def _random_words(seed: int, size: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordTokenizer:
    """Token ids of texts, equal to the tokenizer's own, from a memo of words.

    The tokenizer lower-cases a text, cuts it into words (runs of letters, contractions, single digits, other runs) and
    encodes each word by itself, so a word's ids do not depend on its neighbours. Words are cut and hashed (64 bits) with
    array operations over a chunk of texts, and only words new to the memo reach the library. The memo starts anew beyond
    ``_MEMO_WORDS``. Texts with other characters, or with the strings of special tokens, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core; more threads only take memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a word
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.classes = _classes()
        self.code_hash, self.place_hash = _random_words(1, _CODES), _random_words(2, _LONG_WORD)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[int, int] = {}  # hash of a word to its number
        self.starts = np.zeros(1 << 16, dtype=np.int64)  # places of a word's ids in the pool
        self.pool = np.zeros(1 << 20, dtype="<u4")

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        groups = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        found = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate(found)
        ends = np.flatnonzero(self.ends[ids]) + 1
        known, used = len(self.memo), int(self.starts[len(self.memo)])
        while used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), dtype="<u4")])
        if known + len(ends) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(ends)), dtype=np.int64)])
        self.pool[used : used + len(ids)] = ids
        self.starts[known + 1 : known + 1 + len(ends)] = used + ends
        self.memo.update(zip(hashes, range(known, known + len(ends))))

    def _words(self, codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words; the last code is a space."""
        before = np.concatenate([[0], kinds[:-1]])
        opens = (kinds != 0) & ((kinds != before) | (kinds == 2))
        after = np.concatenate([kinds[1:], [0]])
        closes = (kinds != 0) & ((kinds != after) | (kinds == 2))
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        quotes = np.flatnonzero((ends - starts == 1) & (codes[starts] == 0x27) & (kinds[ends] == 1))
        if len(quotes):  # contractions take the quote and the first letters of the next run
            first, second = codes[ends[quotes]], codes[np.minimum(ends[quotes] + 1, len(codes) - 1)]
            one = np.isin(first, [ord(c) for c in "stmd"])
            two = ((second == ord("e")) & np.isin(first, [ord("r"), ord("v")])) | ((first == second) & (first == ord("l")))
            taken = np.where(one, 1, np.where(two, 2, 0))
            ends[quotes] += taken
            starts[quotes + 1] += taken
            real = starts < ends
            starts, ends = starts[real], ends[real]
        return starts, ends

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        lengths = np.array([len(t) + 1 for t in texts])
        codes = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = self.classes[codes]
        starts, ends = self._words(codes, kinds)
        opened = np.zeros(len(codes), dtype=np.int32)
        opened[starts] = starts
        place = np.minimum(np.arange(len(codes), dtype=np.int32) - np.maximum.accumulate(opened), _LONG_WORD - 1)
        value = self.code_hash[codes] * self.place_hash[place]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)])
        hashes = sums[ends] - sums[starts]
        long = np.flatnonzero(ends - starts >= _LONG_WORD)
        for i in long.tolist():
            hashes[i] = xxhash.xxh64_intdigest(codes[starts[i] : ends[i]].tobytes())
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.memo) + len(unique) > _MEMO_WORDS:
            self._forget()
        numbers = np.fromiter((self.memo.get(h, -1) for h in unique.tolist()), np.int64, len(unique))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            joined = " ".join([*texts, ""])
            rows = first[new]
            words = [joined[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist())]
            numbers[new] = np.arange(len(self.memo), len(self.memo) + len(new))
            self._learn(unique[new].tolist(), words)
        begin = self.starts[numbers]
        size = (self.starts[numbers + 1] - begin)[inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(begin[inverse] - total[:-1], size) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, np.cumsum(lengths))]
        return np.split(ids, cuts[:-1])

    def _plain(self, text: str) -> bool:
        if "<|" in text:
            return False
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return not len(codes) or bool(codes.max() < _CODES and self.classes[codes].max() < 9)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids for every text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        chunk: list[str] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal chunk, owners, held
            if chunk:
                for owner, found in zip(owners, self._chunk(chunk)):
                    out[owner].append(found)
            chunk, owners, held = [], [], 0

        for owner, text in enumerate(texts):
            if not self._plain(text):
                flush()
                out[owner].append(self._whole(text))
                continue
            text = text.lower()
            start = 0
            while start < len(text):  # long texts in parts that end before a space
                end = start + _CHUNK_CHARS
                if end < len(text):
                    space = _SPACE.search(text, end)
                    end = space.start() if space else len(text)
                chunk.append(text[start:end])
                owners.append(owner)
                held += len(chunk[-1])
                start = end
                if held >= _CHUNK_CHARS:
                    flush()
        flush()
        none = np.zeros(0, dtype="<u4")
        return [np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else none for parts in out]


class Shelf:
    """Pieces of one tier, (length, number, document, start), in order of length."""

    def __init__(self):
        self.pieces: list[tuple[int, int, int, int]] = []

    def add(self, piece) -> None:
        insort(self.pieces, piece)

    def longest(self, room: int):
        """Take the longest piece of at most ``room`` tokens, or None."""
        at = bisect_left(self.pieces, (room + 1,)) - 1
        return self.pieces.pop(at) if at >= 0 else None

    def shortest(self):
        return self.pieces.pop(0) if self.pieces else None


def pack(lengths: list[int], window: int = WINDOW, tiers=TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token once; only full windows and powers of two.

    Whole windows are cut off long documents. What is left of each goes to the smallest tier that holds it. Tiers are
    packed from the longest: its longest piece opens a window, the gap takes the longest pieces that fit, from its own
    tier or shorter ones, and a last gap that no whole piece fits takes the start of the shortest piece. When too few
    tokens remain to fill a window of any tier, they are cut into powers of two.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    shelves = [Shelf() for _ in tiers]
    serial = 0

    def shelve(doc: int, start: int, length: int) -> None:
        nonlocal serial
        serial += 1
        at = next(i for i, size in enumerate(tiers) if length <= size)
        shelves[at].add((length, serial, doc, start))

    for doc, total in enumerate(lengths):
        whole = total // window
        sequences.extend([(doc, k * window, window)] for k in range(whole))
        if total % window:
            shelve(doc, whole * window, total % window)

    for at in range(len(tiers) - 1, -1, -1):
        size = tiers[at]
        below = shelves[: at + 1]
        left = sum(p[0] for shelf in below for p in shelf.pieces)
        while shelves[at].pieces and left >= size:
            room, sequence = size, []
            while room:
                piece = next((p for shelf in reversed(below) if (p := shelf.longest(room))), None)
                if piece is None:  # every piece is longer than the gap: cut the shortest
                    length, _, doc, start = next(p for shelf in below if (p := shelf.shortest()))
                    sequence.append((doc, start, room))
                    shelve(doc, start + room, length - room)
                    room = 0
                else:
                    length, _, doc, start = piece
                    sequence.append((doc, start, length))
                    room -= length
            sequences.append(sequence)
            left -= size

    rest = [p for shelf in shelves for p in shelf.pieces]
    left = sum(p[0] for p in rest)
    rest.sort(key=lambda p: (-p[0], p[1]))
    stream = [(doc, start, length) for length, _, doc, start in rest]
    size = window
    while left:
        while size > left:
            size //= 2
        room, sequence = size, []
        while room:
            doc, start, length = stream.pop(0)
            take = min(room, length)
            sequence.append((doc, start, take))
            if take < length:
                stream.insert(0, (doc, start + take, length - take))
            room -= take
        sequences.append(sequence)
        left -= size
    return sequences


def balance(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for every sequence: about ``step_tokens`` tokens each, with even sums of squared lengths (attention cost).

    Sequences go from the longest to the step with the least cost that still has room.
    """
    steps = max(1, -(-sum(lengths) // step_tokens))
    heap = [(0, s) for s in range(steps)]
    room = [step_tokens] * steps
    found = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        aside = []
        while heap and room[heap[0][1]] < lengths[i]:
            aside.append(heapq.heappop(heap))
        if not heap:
            steps += 1
            room.append(step_tokens)
            heap.append((0, steps - 1))
        cost, step = heapq.heappop(heap)
        found[i] = step
        room[step] -= lengths[i]
        heapq.heappush(heap, (cost + lengths[i] ** 2, step))
        for entry in aside:
            if room[entry[1]] > 0:
                heapq.heappush(heap, entry)
    return found


_OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_id long"


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, window, tiers, end_id, shard_tokens) -> Iterator[pa.RecordBatch]:
    tokenizer = WordTokenizer(path)
    first = TaskContext.get().partitionId() << 40
    sequence_id = step_base = first
    docs: list = []
    ids: list[np.ndarray] = []
    held, id_type = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal sequence_id, step_base, docs, ids, held
        sequences = pack([len(x) for x in ids], window, tiers)
        totals = [sum(p[2] for p in s) for s in sequences]
        steps = balance(totals)
        rows: list[list] = [[] for _ in range(9)]
        for number, (sequence, total, step) in enumerate(zip(sequences, totals, steps)):
            offset = 0
            for doc, start, length in sequence:
                crc = zlib.crc32(ids[doc][start : start + length].tobytes())
                values = (docs[doc], start, length, crc, len(ids[doc]), sequence_id + number, offset, total, step_base + step)
                for column, value in zip(rows, values):
                    column.append(value)
                offset += length
        sequence_id += len(sequences)
        step_base += max(steps, default=-1) + 1
        docs, ids, held = [], [], 0
        names = ["_id", *(x.split()[0] for x in _OUT.split(", "))]
        arrays = [pa.array(rows[0], id_type), *(pa.array(c, pa.int64()) for c in rows[1:])]
        out = pa.RecordBatch.from_arrays(arrays, names)
        for at in range(0, out.num_rows, 20_000):
            yield out.slice(at, 20_000)

    for batch in batches:
        id_type = batch.schema.field(0).type
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            encoded = tokenizer.ids([t or "" for t in part.column(1).to_pylist()])
            for doc, found in zip(part.column(0).to_pylist(), encoded):
                docs.append(doc)
                ids.append(np.append(found, np.array([end_id], dtype="<u4")))
                held += len(found) + 1
                if held >= shard_tokens:
                    yield from flush()
    if docs:
        yield from flush()


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    tiers=TIERS,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pack documents into sequences of at most ``window`` tokens, one row per piece.

    Columns: ``id_col``, ``start`` (tokens of the document before the piece), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``sequence_tokens``, ``step_id``. ``tokenizer`` is the path of a tokenizers file that
    every executor can read. A document is its token ids and then ``end_id``.

    A task tokenises its scan partition and packs shards of about ``shard_tokens`` tokens, so there is no shuffle, memory
    is bounded by a shard plus one document, and no key can gather rows. Ids are unique across tasks (partition number in
    the high bits). Every sequence is a full window of its tier or, at the end of a shard, a power of two: none is padded.

    Null and empty texts are one piece that holds ``end_id``. Rows that repeat are packed once each; a null id stays null.
    """
    rows = pick(docs, _id=id_col, _text=text_col).withColumn("_text", F.col("_text").cast("string"))
    packer = partial(_pack_batches, path=tokenizer, window=window, tiers=tuple(tiers), end_id=end_id, shard_tokens=shard_tokens)
    packed = rows.mapInArrow(packer, f"_id {rows.schema[0].dataType.simpleString()}, {_OUT}")
    return packed.withColumnRenamed("_id", id_col)
