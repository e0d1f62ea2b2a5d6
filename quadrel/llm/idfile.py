"""Binary token-id files: an adaptive context-mixing range coder over ids (operator 10).

A segment is one self-describing byte string: header (documents, lengths), a table of blocks with
byte length and crc32 each, and the blocks' code. Each block holds ``BLOCK`` ids and is coded from
reset state, by nothing but its own ids, so ``read_block`` reads one alone. Three orders predict
the next id: order 2 the id last seen after the same two ids, order 1 the one last seen after the
same id, both with a confidence, and order 0 a distribution, the ids' counts in the block so far (as
of the last power of two of ids). What remains is a fixed prior that falls with the id. The shares of
order 2, 1, 0 and the prior mix two adaptive models (confidence of the predictions; outcomes of the
last two ids) by a weight that follows how well each has predicted; shares are small integers, four to a word. A carry-less range coder codes, as
one interval, which of the four it is and, for the last two, the id.

All blocks of a segment advance together, one id a step, as numpy lanes; a lane never reads
another lane's state. A reader checks magic, header crc and every block's crc, which covers its
ids and its code.

Files are written in ascending doc_id order: range-partitioned, sorted, segments cut at
document boundaries. Bytes go through Spark's writers, so any store Spark reaches will do.

Defined cases: null text: only the end id; null doc_ids come first; equal doc_ids: ordered by
text; a document longer than a segment makes its segment longer, and a task's last segment takes the rest, so it has up to
twice as many ids; other columns are ignored; empty
table: no file rows; a vocabulary of more than 65,536 ids is refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise
from .tokens import default_path, pieces_of

MAGIC, BLOCK, END = b"QIDS0004", 2048, 1
#: Ids of a segment, about; more blocks side by side cost less time an id.
SEGMENT = 4_000_000
#: Frequencies add up to 2**SHARE_BITS for the shares, to 2**ID_BITS for the ids under one of them.
SLOT_BITS, SHARE_BITS, ID_BITS = 10, 12, 18
NO_DOC = -(2**63)
#: Constants are arrays without dimensions, which numpy need not convert at every step.
_32, _WORD, _LAST, _FULL = (np.array(x, np.uint64) for x in (32, 1 << 32, (1 << 32) - 1, (1 << 64) - 1))
#: Lanes whose counts are taken together: bounds the memory.
LOT = 128
#: Order 0 takes the counts of the block's ids anew after so many of them.
FIRST_COUNTS = 16
#: Steps that the encoder looks ahead; few enough that their arrays stay near the processor. Divides FIRST_COUNTS.
AHEAD = 8


def _prior() -> tuple[np.ndarray, np.ndarray]:
    """Cumulative frequency of each id above PACK bits and its own below, and the id of each value: falling with the id, as merges are numbered by use."""
    shape = 1.0 / (np.arange(1 << 16) + 300.0)
    freq = 1 + np.floor(shape / shape.sum() * ((1 << ID_BITS) - (1 << 16))).astype(np.int64)
    freq[0] += (1 << ID_BITS) - freq.sum()
    return (np.cumsum(freq) - freq << PACK) + freq, np.repeat(np.arange(1 << 16, dtype=np.uint16), freq)


PACK = 20
PRIOR, PRIOR_ID = _prior()
#: The four shares (orders 2, 1 and 0, the prior) are 16-bit fields of one word, 12 bits each; they never add up to more than 4,092.
_FIELDS, _FIFTH, _EVEN = (np.array(x * 0x0001000100010001, np.uint64) for x in (0xFFF, 0x7F, 1023))
#: By this factor the fields become what lies before each share.
_BEFORE = np.array(0x0001000100010000, np.uint64)
#: What a hit adds, as a 32nd of each share goes.
_GAIN, _SHARE = np.array(124, np.uint64), np.array(0xFFFF, np.uint64)
_4, _5, _15, _48 = (np.array(x, np.uint64) for x in (4, 5, 15, 48))
_TOPS = np.array(0x8000800080000000, np.uint64)
#: The first model's weight has 16 steps, each of so many bits of difference between the two shares of what came.
_PACE = 13
#: Confidence after a prediction (2 * confidence so far + whether it held), in the bits above the id.
_SURE = np.array([1, 1, 0, 2, 1, 3, 1, 3], np.int32) << 16


class _Model:
    """State of all lanes: predictions of orders 1 and 2, and the mixed shares of orders 2, 1 and 0.

    A prediction entry is an id and, above 16 bits, how often it has held (0 to 3). Rows of arrays with
    two rows are orders 1 and 2, or the models by confidence and by the last outcomes.
    """

    def __init__(self, lanes: int):
        n = 1 << SLOT_BITS
        lane = np.arange(lanes, dtype=np.int64)
        self.at = np.stack([lane * 2 * n, lane * 2 * n + n])
        self.told = np.zeros(lanes * 2 * n, np.int32)
        self.slots, self.keys, self.h = self.at.copy(), np.zeros((2, lanes), np.int64), np.zeros(lanes, np.int64)
        self.shares = np.full(48 * lanes, _EVEN)  # of each lane, 32 by confidence and 16 by outcomes
        self.base = np.stack([lane * 48, lane * 48 + 32])
        self.lean = np.full(lanes, 8 << _PACE, np.int64)

    def predict(self) -> np.ndarray:
        """The predicted ids of orders 1 and 2; ``keys[0]`` is their context."""
        self.entry = self.told.take(self.slots)
        self.ids = self.entry & 0xFFFF
        self.sure = self.entry >> 16
        key = self.sure[1] << 2
        key += self.sure[0]
        key += (self.ids[0] == self.ids[1]).view(np.int8) << 4
        np.add(key, self.base[0], out=self.keys[0])
        return self.ids

    def learn(self, ids: np.ndarray, held: np.ndarray) -> None:
        """ids (int32) have come; held: whether each order had predicted them."""
        self.sure <<= 1
        self.sure += held
        new = np.where(self.entry >= 2 << 16, self.ids, ids)
        new |= _SURE.take(self.sure)
        self.told[self.slots] = new
        h, slots = np.multiply(ids, 40503, dtype=np.int64), self.slots
        h += 40503
        slots[0] = h
        np.multiply(h, 5, out=slots[1])
        slots[1] += self.h
        slots >>= 4
        slots &= (1 << SLOT_BITS) - 1
        slots += self.at
        self.h = h

    def mix(self, keys: np.ndarray) -> np.ndarray:
        """The shares in the context of ``keys``, mixed by weight."""
        self.at_keys, self.both = keys, self.shares.take(keys)
        mixed = self.both[0] - self.both[1]  # fields may borrow from each other; the sum below is exact again
        mixed *= (self.lean >> _PACE).view(np.uint64)
        mixed += self.both[1] << _4
        mixed >>= _4
        mixed &= _FIELDS
        return mixed

    def adapt(self, shift: np.ndarray) -> None:
        """The outcome whose field begins at bit ``shift`` has come."""
        of = self.both >> shift
        of &= _SHARE
        of = of.view(np.int64)
        self.lean += of[0]
        self.lean -= of[1]
        np.maximum(self.lean, 1 << _PACE, out=self.lean)
        np.minimum(self.lean, (16 << _PACE) - 1, out=self.lean)
        gone = self.both >> _5
        gone &= _FIFTH
        self.both -= gone
        self.both += _GAIN << shift
        self.shares[self.at_keys] = self.both


class _Writer:
    """Carry-less range coder with 64-bit bounds: shifts out a 32-bit word when the range falls under 2**32."""

    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
        self.out, self.n, self.room = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room, room

    def put(self, cum: np.ndarray, freq: np.ndarray) -> None:
        step = self.range >> _BITS
        self.low += step * cum.view(np.uint64)
        step *= freq.view(np.uint64)
        due = np.flatnonzero(step < _WORD)
        if len(due):
            x, to = self.low.take(due), self.n.take(due)
            self.out[to] = x >> _32
            self.n[due] = to + 1
            step[due] = _cut(x, step.take(due)) << _32
            self.low[due] = x << _32
        self.range = step

    def close(self) -> list[bytes]:
        words = self.out.astype("<u4")
        begin = np.arange(len(self.low)) * self.room
        return [words[b:e].tobytes() + int(low >> _32).to_bytes(4, "little") + int(low & _LAST).to_bytes(4, "little") for b, e, low in zip(begin, self.n, self.low)]


def _cut(low, size):
    """A small range that crosses a word's end is cut there, so that the word to shift out is settled."""
    crosses = ((low ^ (low + size)) >> _32) != 0
    at = np.flatnonzero(crosses)
    size[at] = -low[at] & _LAST
    return size


class _Reader:
    def __init__(self, code: bytes, begin: np.ndarray):
        self.data, self.n = np.concatenate([np.frombuffer(code, "<u4"), np.zeros(4, np.uint32)]).astype(np.uint64), begin // 4 + 2
        self.low, self.range = np.zeros(len(begin), np.uint64), np.full(len(begin), _FULL)
        self.code = (self.data[self.n - 2] << _32) | self.data[self.n - 1]

    def value(self) -> np.ndarray:
        self.step = self.range >> _BITS
        return np.minimum((self.code - self.low) // self.step, _TOP).view(np.int64)

    def take(self, cum: np.ndarray, freq: np.ndarray) -> None:
        self.low += self.step * cum.view(np.uint64)
        size = self.step
        size *= freq.view(np.uint64)
        due = np.flatnonzero(size < _WORD)
        if len(due):
            x, frm = self.low.take(due), self.n.take(due)
            self.code[due] = (self.code.take(due) << _32) | self.data.take(frm, mode="clip")
            self.n[due] = frm + 1
            size[due] = _cut(x, size.take(due)) << _32
            self.low[due] = x << _32
        self.range = size


_OWN = (1 << PACK) - 1
_ID, _THREE = np.array(ID_BITS, np.uint64), np.array(0x0001000100010001, np.uint64)
_BITS, _TOP = np.array(SHARE_BITS + ID_BITS, np.uint64), np.array((1 << SHARE_BITS + ID_BITS) - 1, np.uint64)


def _counting(step: int) -> bool:
    """Whether order 0 takes its counts anew before this step: at powers of two."""
    return step >= FIRST_COUNTS and step & (step - 1) == 0


def _ranks(grid: np.ndarray) -> np.ndarray:
    """Place of each id's count among its lane's counts: steps by lanes. Lots of lanes bound the memory."""
    lanes, block = grid.shape
    out = np.empty((block, lanes), np.int32)
    for lo in range(0, lanes, LOT):
        lot = grid[lo : lo + LOT]
        order = np.argsort(lot, axis=1, kind="stable")
        ordered = np.take_along_axis(lot, order, 1)
        dense = np.zeros(lot.shape, np.int32)
        np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1, out=dense[:, 1:])
        rank = np.empty_like(dense)
        np.put_along_axis(rank, order, dense, 1)
        rank += np.arange(lo, lo + len(lot), dtype=np.int32)[:, None] * block
        out[:, lo : lo + len(lot)] = rank.T
    return out


def _encode_lanes(grid: np.ndarray) -> list[bytes]:
    """Code of each row of ids (uint16). What does not wait for the step before is done for AHEAD steps at once."""
    lanes, block = grid.shape
    ranks, steps = _ranks(grid), np.ascontiguousarray(grid.T)
    counts, shift = np.zeros(lanes * block, np.int32), 0  # cumulative above 16 bits, own below
    model, writer = _Model(lanes), _Writer(lanes, block + 8)  # an interval costs one word at most
    last = np.zeros((2, lanes), np.int8)
    for k in range(0, block, AHEAD):
        if _counting(k):
            shift = ID_BITS - k.bit_length() + 1
            for lo in range(0, lanes, LOT):
                lot = ranks[:k, lo : lo + LOT] - lo * block
                count = np.bincount(lot.reshape(-1), minlength=lot.shape[1] * block).reshape(-1, block)
                counts[lo * block : lo * block + count.size] = ((np.cumsum(count, axis=1) - count << 16) + count).reshape(-1)
        now = steps[k : k + AHEAD].astype(np.int32)
        n = len(now)
        held, keys = np.empty((n, 2, lanes), bool), np.empty((n, 2, lanes), np.int64)
        for i in range(n):
            np.equal(model.predict(), now[i], out=held[i])
            keys[i, 0] = model.keys[0]
            model.learn(now[i], held[i])
        pair, fresh = counts.take(ranks[k : k + n]), PRIOR.take(now)
        freq = pair & 0xFFFF
        new = freq == 0
        out = np.empty((n + 2, lanes), np.int8)
        out[:2] = last
        own = out[2:]
        np.add(new.view(np.int8), 1, out=own)
        own *= ~held[:, 0]
        own += 1
        own *= ~held[:, 1]
        last = out[n:].copy()
        keys[:, 1] = (out[:n] << 2) + out[1 : n + 1]
        keys[:, 1] += model.base[1]
        told = own < 2
        low, freq = np.where(new, fresh >> PACK, pair >> 16 << shift), np.where(new, fresh & _OWN, freq << shift)
        np.copyto(low, 0, where=told)
        np.copyto(freq, 1 << ID_BITS, where=told)
        field, mixed = own.astype(np.uint64) << _4, np.empty((n, lanes), np.uint64)
        for i in range(n):
            mixed[i] = model.mix(keys[i])
            model.adapt(field[i])
        share = (mixed >> field & _SHARE).view(np.int64)
        mixed *= _BEFORE
        begin = (mixed >> field & _SHARE).view(np.int64) << ID_BITS
        begin += share * low
        share *= freq
        for i in range(n):
            writer.put(begin[i], share[i])
    return writer.close()


def _decode_lanes(code: bytes, begin: np.ndarray, block: int) -> np.ndarray:
    """Rows of ids of the codes that begin there."""
    lanes = len(begin)
    model, reader = _Model(lanes), _Reader(code, begin)
    steps, lane, past = np.empty((block, lanes), np.uint16), np.arange(lanes), np.zeros(lanes, np.int64)
    counts, size, shift = np.ones(1, np.int64), 0, 0  # of each place in the ordered ids: id above 40 bits, cumulative above PACK, own
    for k in range(block):
        if _counting(k):
            size, shift = k, ID_BITS - k.bit_length() + 1
            counts = np.empty(lanes * k, np.int64)
            for lo in range(0, lanes, LOT):
                ordered = np.sort(steps[:k, lo : lo + LOT].T, axis=1, kind="stable").reshape(-1)
                starts = np.ones(len(ordered), bool)
                starts[1:] = ordered[1:] != ordered[:-1]
                starts[::k] = True
                at = np.flatnonzero(starts)
                length = np.diff(np.append(at, len(ordered)))
                counts[lo * k : lo * k + len(ordered)] = np.repeat((ordered[at].astype(np.int64) << 40) + (at % k << PACK + shift) + (length << shift), length)
        of_one, of_two = model.predict()
        np.add(past, model.base[1], out=model.keys[1])
        mixed = model.mix(model.keys)
        v = reader.value()
        before = mixed * _BEFORE
        x = v.view(np.uint64) >> _ID
        x *= _BEFORE
        x |= _TOPS
        x -= before
        x &= _TOPS
        x >>= _15
        x *= _THREE
        x >>= _48  # the number of shares that begin at or before the value
        field = x << _4
        out = x.view(np.int64)
        before >>= field
        before &= _SHARE
        cum = before.view(np.int64)
        cum <<= ID_BITS
        mixed >>= field
        mixed &= _SHARE
        share = mixed.view(np.int64)
        v -= cum
        v = (v / share).astype(np.int64)  # exact: a quotient of fewer than 53 bits
        at = v >> shift
        at += lane * size
        pair = counts.take(at, mode="clip")  # bad code may ask for what isn't there
        new = np.flatnonzero(out == 3)
        if len(new):
            fresh = PRIOR_ID.take(v.take(new), mode="clip")
            pair[new] = PRIOR.take(fresh) + (fresh.astype(np.int64) << 40)
        now = np.where(out == 0, of_two, of_one).astype(np.int64)
        now <<= 40
        now += 1 << ID_BITS
        np.copyto(pair, now, where=out < 2)
        ids = (pair >> 40).astype(np.int32)
        cum += share * (pair >> PACK & _OWN)
        share *= pair & _OWN
        reader.take(cum, share)
        model.adapt(field)
        model.learn(ids, model.ids == ids)
        past <<= 2
        past &= 15
        past += out
        steps[k] = ids
    return np.ascontiguousarray(steps.T)


def encode(docs: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment: the documents' ids, ids of each document in sequence."""
    if block > 1 << 16:
        raise ValueError("counts of a block beyond what a frequency holds")
    total = len(ids)
    block = min(block, max(64, total // 64))
    lanes = -(-total // block)
    padded = np.zeros(lanes * block, np.uint16)
    padded[:total] = ids
    codes = _encode_lanes(padded.reshape(lanes, block)) if total else []
    wide = ids.astype("<u4")
    crcs = [zlib.crc32(codes[i], zlib.crc32(wide[i * block : (i + 1) * block])) for i in range(lanes)]
    parts = [np.array([NO_DOC if d is None else d for d in docs], "<i8"), np.array([d is None for d in docs], "u1"), np.array(lengths, "<i8"), np.array([len(c) for c in codes], "<u4"), np.array(crcs, "<u4")]
    packed = [zlib.compress(p.tobytes(), 1) for p in parts]
    head = struct.pack(_FIXED, total, len(docs), block, lanes, *map(len, packed)) + b"".join(packed)
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + b"".join(codes)


_FIXED = "<QIII5I"


class Segment:
    """An opened segment: ``names`` and ``lengths`` of its documents, and its blocks; ValueError if any byte that matters has changed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an id file")
        size, crc = struct.unpack_from("<II", data, 8)
        head = data[16 : 16 + size]
        if zlib.crc32(head) != crc:
            raise ValueError("header checksum")
        self.total, _, self.block, self.blocks, *sizes = struct.unpack_from(_FIXED, head)
        parts, at = [], struct.calcsize(_FIXED)
        for n, kind in zip(sizes, ("<i8", "u1", "<i8", "<u4", "<u4")):
            parts.append(np.frombuffer(zlib.decompress(head[at : at + n]), kind))
            at += n
        docs, none, self.lengths, self.sizes, self.crcs = parts
        self.names = [None if x else int(d) for d, x in zip(docs, none)]
        self.code = data[16 + size :]
        if len(self.code) != int(self.sizes.sum()):
            raise ValueError("length")
        self.begin = np.cumsum(self.sizes.astype(np.int64)) - self.sizes

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids (uint32) of blocks first to last (exclusive), read without the others."""
        last = self.blocks if last is None else last
        if first >= last:
            return np.zeros(0, np.uint32)
        lo, hi = int(self.begin[first]), int(self.begin[last - 1] + self.sizes[last - 1])
        code = self.code[lo:hi]
        ids = _decode_lanes(code, self.begin[first:last] - lo, self.block).reshape(-1)
        ids = ids[: self.total - first * self.block].astype("<u4")
        for i in range(first, last):
            at = int(self.begin[i]) - lo
            if zlib.crc32(code[at : at + int(self.sizes[i])], zlib.crc32(ids[(i - first) * self.block : (i - first + 1) * self.block])) != self.crcs[i]:
                raise ValueError(f"checksum of block {i}")
        return ids


def read_block(segment: bytes, block: int) -> np.ndarray:
    """Ids of one block of a segment."""
    return Segment(segment).read(block, block + 1)


def decode(segment: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(documents, lengths, ids) of a segment; ValueError if any byte that matters has changed."""
    s = Segment(segment)
    return s.names, s.lengths, s.read()


def write_ids(docs: DataFrame, vocabulary: str | None = None, end: int = END, segment: int = SEGMENT) -> DataFrame:
    """File rows (part, seq, n_docs, n_ids, payload), written to the shared folder in doc_id order."""
    vocabulary = vocabulary or default_path()
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, seq = pieces_of(vocabulary), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        held, whole = 0, None  # a full segment waits for a short rest, as a segment of few blocks costs most an id

        def flush(names: list[int | None], lengths: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal seq
            row = (part, seq, len(names), sum(lengths), encode(names, lengths, np.concatenate(found)))
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fields)], schema=fields)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            ids, ends = pieces.column(batch.column(1))
            if len(ids) and ids.max() >= 1 << 16:
                raise ValueError("ids beyond 65,535")
            ids = np.insert(ids.astype(np.uint16), ends, end)
            ends = ends + np.arange(1, len(ends) + 1)
            lo = 0
            while lo < len(docs):  # as many documents as fill the segment
                base = int(ends[lo - 1]) if lo else 0
                hi = min(len(docs), int(np.searchsorted(ends, base + segment - held)) + 1)
                names += docs[lo:hi]
                lengths += np.diff(ends[lo:hi], prepend=base).tolist()
                found.append(ids[base : ends[hi - 1]])
                held += int(ends[hi - 1]) - base
                if held >= segment:
                    if whole:
                        yield flush(*whole)
                    whole, names, lengths, found, held = (names, lengths, found), [], [], [], 0
                lo = hi
        if whole:
            names, lengths, found = (a + b for a, b in zip(whole, (names, lengths, found)))
        if names:
            yield flush(names, lengths, found)

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.mapInArrow(run, "part int, seq int, n_docs bigint, n_ids bigint, payload binary"), "id-files")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, part, seq, before (ids of its segment before it), ids (little-endian uint32), from file rows."""
    fields = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(c.to_pylist() for c in batch.columns)):
                names, lengths, ids = decode(payload)
                ends = np.cumsum(lengths)
                for lo in range(0, len(names), 1000):
                    rows = [(names[i], part, seq, ends[i] - lengths[i], ids[ends[i] - lengths[i] : ends[i]].tobytes()) for i in range(lo, min(lo + 1000, len(names)))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), fields)], schema=fields)

    return files.select("part", "seq", "payload").mapInArrow(run, "doc_id bigint, part int, seq int, before bigint, ids binary")


def starts(files: DataFrame) -> DataFrame:
    """part, seq, base: ids of all segments before. Parts are few; a part's segments are numbered within it."""
    of_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = of_part.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner"))
    return segments.join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("inner")).alias("base"))
