"""Sequence packing, shortest pack first over the length histogram (operator 5).

Documents become token ids and an end id; pieces of more than ``room`` ids are cut. Only the
histogram of piece lengths (at most ``room`` rows) reaches the driver, where lengths are placed
longest first into the pattern with the least tokens so far that still has room; a pattern
stands for many equal sequences, so the cost follows the number of distinct lengths. Patterns
become ranges of ranks within a length, and pieces find their place by (length, rank). Ranks
are local row numbers plus broadcast offsets of (length, salt) counts: one length may hold all
rows and is still numbered by many tasks.

Defined cases: a null or empty text has only the end id; a very long text is cut into many pieces;
repeated rows are packed each, ties in any order; null doc_id is an id like any other; other
columns of pieces stay, whatever their names (but those that begin with ``_q_``), and of documents
are ignored; an empty table gives no sequence.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, tidy
from .tokens import default_path, pieces_of

ROOM, END = 4096, 2
#: Rows that one task numbers, about.
RANKED = 200_000


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, room: int = ROOM, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids_crc32 and, if wanted, ids (little-endian uint32) of the pieces of every document."""
    vocabulary = vocabulary or default_path()
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        for batch in batches:
            ids, ends = pieces.column(batch.column(1))
            ids = np.insert(ids.astype("<u4"), ends, end)
            ends = ends + np.arange(1, len(ends) + 1)
            size = np.diff(ends, prepend=0)
            number = -(-size // room)
            doc = np.repeat(np.arange(len(size)), number)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * room
            length = np.minimum(room, size[doc] - start)
            for lo in range(0, len(doc), 2_000):
                part = slice(lo, lo + 2_000)
                own = [ids[b : b + n] for b, n in zip((ends[doc[part]] - size[doc[part]] + start[part]).tolist(), length[part].tolist())]
                columns = [batch.column(0).take(pa.array(doc[part])), start[part], length[part], size[doc[part]], [zlib.crc32(x) for x in own], *([[x.tobytes() for x in own]] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields)], schema=fields)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run, each=True, keeps="pieces"), "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def patterns(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of equal sequences, [(length, times in each)]) by shortest pack first."""
    found: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    open_: list[tuple[int, int, tuple[tuple[int, int], ...], int]] = []  # tokens, order, content, count
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_ and open_[0][0] + length <= room:
                tokens, _, content, count = heapq.heappop(open_)
                # as many at once as keep this pattern the shortest and within room
                other = open_[0][0] if open_ else room
                times = max(1, min((room - tokens) // length, (other - tokens) // length, left // count))
                use = min(count, left // times)
                if use < count:
                    heapq.heappush(open_, (tokens, order, content, count - use))
                    order += 1
            else:
                tokens, content, times = 0, (), 1
                use = left
                per = room // length
                if not open_ and per > 1 and left >= per:
                    times, use = per, left // per
            grown = content[:-1] + ((length, content[-1][1] + times),) if content and content[-1][0] == length else (*content, (length, times))
            left -= times * use
            if tokens + times * length >= room:
                found[grown] += use
            else:
                heapq.heappush(open_, (tokens + times * length, order, grown, use))
                order += 1
    for _, _, content, count in open_:
        found[content] += count
    return [(n, list(content)) for content, n in sorted(found.items(), reverse=True)]


def slots(packs: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, sequences, first sequence, first offset): where ranks of a length go."""
    ranks: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, content in packs:
        offset = 0
        for length, times in content:
            out.append((length, ranks[length], count * times, count, sequence, offset))
            ranks[length] += count * times
            offset += length * times
        sequence += count
    return out


def ranked(pieces: DataFrame, by: list[Column | str]) -> DataFrame:
    """pieces with ``_q_rank`` from 0 within their length, without one task for one length."""
    total = pieces.count()
    salts = int(min(4096, max(8, total // RANKED)))
    salted = pieces.withColumn("_q_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_q_salt").agg(F.count(F.lit(1)).alias("_q_n"))
    upto = Window.partitionBy("length").orderBy("_q_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_q_salt", F.coalesce(F.sum("_q_n").over(upto), F.lit(0)).alias("_q_base"))
    local = salted.withColumn("_q_local", F.row_number().over(Window.partitionBy("length", "_q_salt").orderBy(*by)) - 1)
    return local.join(offsets, ["length", "_q_salt"]).withColumn("_q_rank", F.col("_q_base") + F.col("_q_local")).drop("_q_salt", "_q_local", "_q_base")


def pack(pieces: DataFrame, room: int = ROOM, by: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """pieces (with ``length`` from 1 to room) with sequence_id and offset; all their other columns stay."""
    pieces = materialise(pieces.drop("sequence_id", "offset"), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most room rows
    spark = pieces.sparkSession
    if not histogram:
        return pieces.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint"))
    table = ";".join(",".join(map(str, s)) for s in slots(patterns(histogram, room)))
    part = F.split("s", ",")
    names = ("length", "first", "ranks", "count", "sequence", "offset0")
    where = spark.range(1).select(F.explode(F.split(F.lit(table), ";")).alias("s")).select(*(part[i].cast("bigint").alias(n) for i, n in enumerate(names)))
    # one row a length: its ranges of ranks; their number follows room, not the data
    where = where.withColumn("to", F.col("first") + F.col("ranks") - 1)
    lists = where.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "to", "count", "sequence", "offset0"))).alias("_q_ranges"))
    r = ranked(pieces, list(by)).join(F.broadcast(lists), "length")
    rank, hit = F.col("_q_rank"), F.col("_q_hit")
    r = r.withColumn("_q_hit", F.filter("_q_ranges", lambda x: (x["first"] <= rank) & (rank <= x["to"]))[0]).drop("_q_ranges")
    step = rank - hit["first"]
    return r.withColumn("sequence_id", hit["sequence"] + F.pmod(step, hit["count"])).withColumn("offset", hit["offset0"] + F.floor(step / hit["count"]).cast("bigint") * F.col("length")).drop("_q_hit", "_q_rank")


def sequences(packed: DataFrame, room: int = ROOM, pad: int = 0) -> DataFrame:
    """sequence_id, ids: the padded sequences themselves, from packed pieces that carry ids."""
    g = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"), F.sum("length").alias("used"))
    body = F.expr("aggregate(all, cast('' as binary), (a, x) -> concat(a, x.ids))")
    log = F.log2("used")
    short = F.when(log == F.floor(log), 0).otherwise(room - F.col("used"))
    filler = F.unhex(F.repeat(F.lit(pad.to_bytes(4, "little").hex()), short.cast("int")))
    return g.select("sequence_id", F.concat(body, filler).alias("ids"), "used")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, room: int = ROOM, end: int = END) -> DataFrame:
    """Place of every piece of every document, with the crc32 of its ids."""
    return pack(cut_pieces(docs, vocabulary, room, end, with_ids=False), room)
