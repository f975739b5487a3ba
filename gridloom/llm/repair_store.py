"""Token-id output as Re-Pair grammars: shards of ids with rules, expansion lengths and random-access decoding.

A shard holds whole documents in ascending doc_id order. Re-Pair replaces frequent pairs of neighbouring ids by
nonterminals until no pair occurs MIN_COUNT times (below that a rule costs more than it saves). Rounds work from the
most frequent pairs down: a round takes all pairs with at least 1 / STEP of the most frequent one's uses, counted
exactly, and where chosen pairs overlap the more frequent one wins. Symbols (ids and nonterminals) are then numbered
by frequency and written as byte planes under Huffman codes. A shard's bytes (little-endian) are

    header   magic "GLR2", then 6 unsigned longs: documents, ids, distinct ids, rules, symbols, crc32 of all ids
    docs     doc_id (long), known (byte), number of ids (long), each as a column
    kinds    a bit for each symbol number: whether it is a rule
    ids      of the numbers that are ids, ascending; planes
    rules    left, right, expansion length of the numbers that are rules, ascending; planes each
    index    for each BLOCK of symbols its first expanded position (long) and its size in bytes (unsigned int)
    blocks   BLOCK symbols each; planes

``decode`` expands a shard, ``decode_range`` any run of ids through the index alone. Shards are the ``payload`` of
a Parquet table in the shared folder: Spark's commit protocol then guards them against lost and repeated tasks, on
any file system that Spark writes to.

Edge cases: null or empty text has the end id alone; null doc_ids come first; rows that repeat a doc_id follow one
another in order of their text; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_ROWS, column, scratch, slices, small_batches
from gridloom.llm.tokens import encoder, spread

MAGIC = b"GLR2"
#: Ids after which a shard ends (with its document).
SHARD_IDS = 1 << 19
#: Least uses of a rule, and how far below the most frequent pair a round goes.
MIN_COUNT, STEP = 4, 64
#: Bits of the hash table that finds a pair.
SLOT_BITS = 18
#: Symbols that are decoded together.
BLOCK = 1 << 14
#: Words in a worker's token cache: some 200 MB.
CACHE_WORDS = 900_000


def apart(where: np.ndarray) -> np.ndarray:
    """Which of ascending positions to take so that no two are neighbours: of a run every second one."""
    order = np.arange(len(where))
    begins = np.ones(len(where), bool)
    np.not_equal(where[1:], where[:-1] + 1, out=begins[1:])
    order -= np.maximum.accumulate(order * begins)
    return order & 1 == 0


def _slots(code: np.ndarray) -> np.ndarray:
    if code.dtype == np.uint32:
        return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
    return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def place(code: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which of the ascending ``pair`` each code is, or -1: by a hash table, and by search for those that lost a slot."""
    table, slot = np.full(1 << SLOT_BITS, -1, np.int32), _slots(pair)
    table[slot] = np.arange(len(pair))
    lost = np.flatnonzero(table[slot] != np.arange(len(pair)))
    at = table.take(_slots(code))
    other = (at >= 0) & (pair.take(at, mode="wrap") != code)
    rest = np.flatnonzero(other)  # a pair that lost finds another in its slot
    at[rest] = -1
    if len(lost):
        k = np.minimum(np.searchsorted(pair[lost], code[rest]), len(lost) - 1)
        hit = pair[lost[k]] == code[rest]
        at[rest[hit]] = lost[k[hit]]
    return at


def compress(seq: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules are rows (left, right) of symbols below their own.

    A pair that is rare once stays rare, as new pairs hold a new symbol; so only positions whose pair is frequent, or
    new, are counted again.
    """
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    top, step = terminals, STEP
    live = np.arange(max(len(seq) - 1, 0))
    while len(live):
        base = top if top < 1 << 16 else 1 << 32
        left, right = seq.take(live), seq.take(live + 1)
        code = left * np.uint32(base) + right if top < 1 << 16 else left.astype(np.int64) << 32 | right
        ordered = np.sort(code)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        uses = np.diff(np.append(first, len(ordered)))
        often = uses >= MIN_COUNT
        if not often.any():
            break
        pair, uses = ordered[first[often]], uses[often]
        at = place(code, pair)
        frequent = np.flatnonzero(at >= 0)
        live, at = live.take(frequent), at.take(frequent)
        least = max(MIN_COUNT, int(uses.max()) // step)
        rank = np.empty(len(pair), np.int32)
        rank[np.argsort(uses, kind="stable")] = np.arange(1, len(pair) + 1)
        rank[uses < least] = 0
        held, mine = np.zeros(len(seq) + 2, np.int32), rank.take(at)
        held[live + 1] = mine
        chosen = np.flatnonzero((mine > 0) & (mine >= held.take(live)) & (mine >= held.take(live + 2)))  # equal neighbours are runs of one id
        chosen = chosen[apart(live[chosen])]
        good = np.bincount(at[chosen], minlength=len(pair)) >= MIN_COUNT
        if not good.any():
            if least == MIN_COUNT:
                break
            step *= STEP
            continue
        chosen = chosen[good[at[chosen]]]
        where = live[chosen]
        seq[where] = top + (np.cumsum(good) - 1)[at[chosen]]
        top += int(good.sum())
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        again = np.zeros(len(seq) + 1, bool)  # the last stands for what is before the first
        again[live] = again[where] = again[where - 1] = True
        live = np.flatnonzero(again[:-1][keep])
        seq = seq[keep]
        live = live[live < len(seq) - 1]
        found = pair[good].astype(np.int64)
        rules.append(np.stack([found // base, found % base], 1))
    return seq.astype(np.int64), np.concatenate(rules)


def lengths_of(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Expansion length of every symbol. A rule's parts are symbols of earlier rounds, so sweeps settle it."""
    n = np.ones(terminals + len(rules), np.int64)
    while len(rules):
        new = n[rules[:, 0]] + n[rules[:, 1]]
        if np.array_equal(new, n[terminals:]):
            break
        n[terminals:] = new
    return n


def expansions(kinds: np.ndarray, ids: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All symbols' expansions behind one another, and where each symbol's starts: rules by their depth."""
    starts, done = np.zeros(len(kinds), np.int64), ~kinds
    starts[done] = np.arange(len(ids))
    flat, numbers = ids, np.flatnonzero(kinds)
    todo = np.arange(len(numbers))
    while len(todo):
        ready = done[rules[todo]].all(1)
        now, todo = todo[ready], todo[~ready]
        assert len(now), "a shard is damaged"
        parts, n = rules[now].ravel(), lengths[numbers[now]]
        starts[numbers[now]] = len(flat) + np.cumsum(n) - n
        flat = np.concatenate((flat, spread(flat, starts[parts], lengths[parts])))
        done[numbers[now]] = True
    return flat, starts


def planes(values: np.ndarray) -> bytes:
    """The values' bytes, lowest first, each plane under a Huffman code of its own."""
    out = []
    top = int(values.max()) if len(values) else 0
    for at in range(0, max(top.bit_length(), 1), 8):
        z = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
        data = z.compress((values >> at & 255).astype(np.uint8).tobytes()) + z.flush()
        out.append(struct.pack("<I", len(data)) + data)
    return struct.pack("<B", len(out)) + b"".join(out)


def from_planes(data: memoryview, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """``n`` values, and where their bytes end."""
    values, count = np.zeros(n, np.int64), data[at]
    at += 1
    for k in range(count):
        size = struct.unpack_from("<I", data, at)[0]
        values |= np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size], -15), np.uint8, n).astype(np.int64) << 8 * k
        at += 4 + size
    return values, at


def encode_shard(docs: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    seen = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    seen[flat] = True
    alphabet = np.flatnonzero(seen)
    seq, rules = compress((np.cumsum(seen) - 1)[flat], len(alphabet))
    lengths = lengths_of(rules, len(alphabet))
    n = len(lengths)
    order = np.argsort(-np.bincount(np.concatenate((seq, rules.ravel())), minlength=n), kind="stable")  # number -> symbol
    number = np.empty(n, np.int64)
    number[order] = np.arange(n)
    kinds = order >= len(alphabet)
    ruled = order[kinds] - len(alphabet)
    blocks = [planes(number[seq[k : k + BLOCK]]) for k in range(0, len(seq), BLOCK)]
    at = np.cumsum(lengths[seq]) - lengths[seq]
    return b"".join(
        (
            MAGIC,
            struct.pack("<6Q", len(docs), len(flat), len(alphabet), len(rules), len(seq), zlib.crc32(flat.astype("<u4").tobytes())),
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            np.array([d is not None for d in docs], "<u1").tobytes(),
            np.array([len(x) for x in ids], "<i8").tobytes(),
            np.packbits(kinds).tobytes(),
            planes(alphabet[order[~kinds]]),
            planes(number[rules[ruled, 0]]),
            planes(number[rules[ruled, 1]]),
            planes(lengths[order[kinds]]),
            at[::BLOCK].astype("<i8").tobytes(),
            np.array([len(b) for b in blocks], "<u4").tobytes(),
            *blocks,
        )
    )


class Shard:
    def __init__(self, payload: bytes):
        assert payload[:4] == MAGIC, "not a shard"
        n_docs, self.n_ids, n_alphabet, n_rules, self.n, self.crc = struct.unpack_from("<6Q", payload, 4)
        data, at = memoryview(payload), 52

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        def values(count: int) -> np.ndarray:
            nonlocal at
            out, at = from_planes(data, count, at)
            return out

        ids, known = take("<i8", n_docs), take("<u1", n_docs)
        self.docs = [int(d) if k else None for d, k in zip(ids, known)]
        self.counts = take("<i8", n_docs)
        total = n_alphabet + n_rules
        self.kinds = np.unpackbits(take("<u1", -(-total // 8)), count=total).astype(bool)
        alphabet = values(n_alphabet).astype(np.uint32)
        self.rules = np.stack([values(n_rules), values(n_rules)], 1)
        self.lengths = np.ones(total, np.int64)
        self.lengths[self.kinds] = values(n_rules)
        n_blocks = -(-self.n // BLOCK)
        self.index, sizes = take("<i8", n_blocks), take("<u4", n_blocks).astype(np.int64)
        self.data, self.at = data, at + np.cumsum(sizes) - sizes
        self.flat, self.starts = expansions(self.kinds, alphabet, self.rules, self.lengths)

    def symbols(self, block: int) -> np.ndarray:
        return from_planes(self.data, min(BLOCK, self.n - block * BLOCK), int(self.at[block]))[0]

    def expand(self, first: int, last: int) -> np.ndarray:
        """The ids of some blocks of symbols."""
        parts = [self.symbols(b) for b in range(first, last)]
        s = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return spread(self.flat, self.starts[s], self.lengths[s])

    def decode(self) -> np.ndarray:
        out = self.expand(0, len(self.index))
        assert len(out) == self.n_ids and zlib.crc32(out.astype("<u4").tobytes()) == self.crc, "a shard is damaged"
        return out

    def decode_range(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the shard, reading only the blocks that hold them."""
        first = max(0, int(np.searchsorted(self.index, start, side="right")) - 1)
        last = int(np.searchsorted(self.index, start + n, side="left"))
        base = int(self.index[first]) if len(self.index) else 0
        return self.expand(first, last)[start - base : start - base + n]


def write_store(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Encode, compress and write; the table of shards (part, block, n_docs, n_ids, payload), in global id order."""

    def shards(batches):
        from pyspark import TaskContext

        e = encoder(vocabulary, False, CACHE_WORDS)
        part, block, held, names, n = TaskContext.get().partitionId(), 0, [], [], 0

        def shard():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([n], pa.int64()), pa.array([encode_shard(names, held)], pa.binary())], ["part", "block", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for piece in slices(batch, "text", BATCH_ROWS):
                found = e.encode([t or "" for t in column(piece, "text").to_pylist()])
                for doc, ids in zip(column(piece, "doc_id").to_pylist(), found):
                    ids = np.append(ids, np.uint32(end_id))
                    names.append(doc)
                    held.append(ids)
                    n += len(ids)
                    if n >= SHARD_IDS:
                        yield shard()
                        block, held, names, n = block + 1, [], [], 0
        if names:
            yield shard()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return scratch(dealt.mapInArrow(shards, "part int, block int, n_docs long, n_ids long, payload binary"), "shards")


def read_store(store: DataFrame) -> DataFrame:
    """One row per document from the shards' bytes: doc_id, start, n_tokens, ids_crc32."""

    def decoded(batches):
        for batch in batches:
            for part, block, payload in zip(*(column(batch, c).to_pylist() for c in ("part", "block", "payload"))):
                shard = Shard(payload)
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.counts)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), shard.counts.tolist())]
                k = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array([block] * k, pa.int32()), pa.array(shard.docs, pa.int64()), pa.array(ends - shard.counts), pa.array(shard.counts, pa.int64()), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = store.select("part", "block", "payload").mapInArrow(decoded, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = store.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per task that wrote
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    offsets = sizes.select("part", "block", inside.alias("inside")).join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("base"))
    return rows.join(offsets, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
