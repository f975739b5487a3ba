"""SentencePiece encoding and decoding as a max-plus parallel scan.

The best segmentation of a text is a longest path: score(end) = max over pieces of score(start) + piece. Where a
document is over ``chunk_chars`` it is cut into chunks; a state at a boundary is how many characters a piece that
starts before it reaches past it (0 .. L-1, L the longest piece). Each chunk yields the max-plus transfer matrix
between the states at its two ends, independently of all others. Matrices combine associatively; they are folded
in blocks, the blocks in turn, and back down, which gives each chunk the scores of its entry states. With these a
chunk knows, for each exit state, its best pieces and its entry state; exit states chain the chunks backwards, and
every chunk then backtraces on its own.

Most chunks need little of this: where no piece crosses a gap between words, all states collapse to one, so that
a matrix consists of the paths to the first gap, one sum over cached words, and the paths from the last gap.

Ties go to the longest last piece, as in the library's unigram algorithm; scores are integers, so that sums don't
depend on their order. Characters without a piece become their bytes' pieces. Single words are segmented by the
library itself, given the same pieces and scores as a unigram model; long ones by the same recursion here.

A max-plus scan needs additive scores. Those of a unigram model are taken as they are (times SCALE, rounded). A BPE
model has merge ranks only, which no sum of scores can follow; its pieces get the log probabilities that Zipf's law
gives their ranks. Ids then differ from the library's BPE ids; decoding restores the text either way.

Edge cases: null text counts as empty and has no ids; a text's blanks are kept (one is put before it, as the model
asks, and removed when decoding); repeated rows and null doc_ids are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import column, map_texts, scratch, slices

SPACE = "▁"
CHUNK_CHARS = 1 << 16
#: Chunks whose matrices one task folds.
FOLD = 256
#: Penalty of a character without a piece, below the least score.
UNKNOWN = 10.0
SCALE = 1024
CACHE_WORDS, CACHE_LENGTH = 400_000, 64
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NEG = -np.inf


_gaps = re.compile(f"(?<!{SPACE})({SPACE}+)")


def _fields(data: bytes):
    """(number, wire type, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, kind, data[at : at + n]
            at += n


def _message(fields) -> bytes:
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes(out) + bytes([x])

    return b"".join(varint(no << 3 | kind) + (varint(v) if kind == 0 else (varint(len(v)) if kind == 2 else b"") + v) for no, kind, v in fields)


class Model:
    """Pieces, scores and segmentation of one model file."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        with open(path, "rb") as f:
            self.proto = list(_fields(f.read()))
        model_type = 1
        for no, _, value in self.proto:
            if no == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | {k: v for k, _, v in _fields(value)}
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif no == 2:
                model_type = {k: v for k, _, v in _fields(value)}.get(3, 1)
        if model_type == 1:
            scores = [round(s * SCALE) for s in scores]
        else:
            for rank, i in enumerate(sorted((i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)), key=lambda i: -scores[i]), 1):
                scores[i] = -round(SCALE * math.log(rank + 1))
        self.all_scores = scores
        usable = {i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)}
        self.ids = {self.pieces[i]: i for i in usable}
        self.scores = {self.pieces[i]: float(scores[i]) for i in usable}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unk = self.kinds.index(UNK)
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN
        self.lines = all("\n" not in p for p in self.ids)  # a line feed is a character by itself
        self.library = None
        self.longest = max(map(len, self.ids), default=1)
        self.gap = all(SPACE not in p.lstrip(SPACE) for p in self.ids)  # no piece crosses into a next word
        self.first: dict[str, int] = {}
        for p in self.ids:
            self.first[p[0]] = max(self.first.get(p[0], 0), len(p))
        self.cache: dict[str, bytes] = {}
        self.kind_of, self.score_of = np.array(self.kinds), np.array([s if i in usable else 0.0 for i, s in enumerate(scores)], float)
        self.byte_of = np.zeros(len(self.pieces), np.int64)
        self.byte_of[list(self.bytes.values())] = list(self.bytes)
        self.raw = [bytes([self.byte_of[i]]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else " \u2047 ".encode() if k == UNK else b"" for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]

    def starts(self, text: str, i: int, stop: int):
        """(length, score, piece) of the pieces that match at i and end at or before stop; an unknown character."""
        single = False
        for n in range(1, min(self.first.get(text[i], 0), stop - i) + 1):
            p = text[i : i + n]
            s = self.scores.get(p)
            if s is not None:
                single |= n == 1
                yield n, s, p
        if not single:
            yield 1, self.unknown, None

    def path(self, text: str, entry: np.ndarray, lo: int = 0, core: int | None = None, stop: int | None = None):
        """Best scores of all positions up to ``stop`` from scores ``entry`` at lo + 0, 1, ...; pieces start in
        [lo, core). Returns (scores, where the best piece to a position starts, -1 for an entry)."""
        core, stop = len(text) if core is None else core, len(text) if stop is None else stop
        best = [NEG] * (stop + 1)
        back = [-1] * (stop + 1)
        for j, s in enumerate(entry):
            if lo + j <= stop:
                best[lo + j] = s
        for i in range(lo, core):
            here = best[i]
            if here == NEG:
                continue
            for n, s, _ in self.starts(text, i, stop):
                if here + s > best[i + n]:
                    best[i + n], back[i + n] = here + s, i
        return best, back

    def emit(self, text: str, back: list[int], end: int, lo: int = 0) -> tuple[list[int], int]:
        """Ids of the best path to ``end`` and the position at which it enters."""
        spans = []
        while end > lo and back[end] >= 0:
            spans.append((back[end], end))
            end = back[end]
        ids: list[int] = []
        for a, b in reversed(spans):
            p = text[a:b]
            if p in self.ids:
                ids.append(self.ids[p])
            elif self.bytes:
                ids += [self.bytes[x] for x in p.encode("utf-8", "replace")]
            else:
                ids.append(self.unk)
        return ids, end

    def unigram(self):
        """The library over these pieces and scores, without a blank of its own before a text."""
        if self.library is None:
            from sentencepiece import SentencePieceProcessor

            out, at = [], 0
            for no, kind, value in self.proto:
                if no == 1:
                    value = _message([x for x in _fields(value) if x[0] != 2] + [(2, 5, struct.pack("<f", self.all_scores[at]))])
                    at += 1
                elif no == 2:
                    value = _message([x for x in _fields(value) if x[0] != 3] + [(3, 0, 1)])
                elif no == 3:
                    value = _message([x for x in _fields(value) if x[0] not in (3, 4)] + [(3, 0, 0), (4, 0, 0)])
                out.append((no, kind, value))
            self.library = SentencePieceProcessor(model_proto=_message(out))
        return self.library

    def words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; short ones by the library, whose 32-bit sums are exact for them."""
        short = [w for w in words if len(w) <= CACHE_LENGTH]
        found = dict(zip(short, self.unigram().encode(short, num_threads=1))) if short else {}
        out = []
        for w in words:
            ids = found[w] if w in found else self.emit(w, self.path(w, np.zeros(1))[1], len(w))[0]
            out.append(np.array(ids, np.int32).tobytes())
            if len(w) <= CACHE_LENGTH and len(self.cache) < CACHE_WORDS:
                self.cache[w] = out[-1]
        return out

    def ids_of(self, words: list[str]) -> bytes:
        found = list(map(self.cache.get, words))
        if None in found:
            at = [i for i, x in enumerate(found) if x is None]
            names = list(dict.fromkeys(words[i] for i in at))
            new = dict(zip(names, self.words_ids(names)))
            for i in at:
                found[i] = new[words[i]]
        return b"".join(found)

    def score(self, ids: np.ndarray) -> float:
        """The sum of scores of ids; a run of bytes counts its characters."""
        kind = self.kind_of[ids]
        total = float(self.score_of[ids[kind != BYTE]].sum())
        raw = ids[kind == BYTE]
        if len(raw):
            total += self.unknown * len(bytes(self.byte_of[raw].tolist()).decode("utf-8", "replace"))
        return total + self.unknown * int((kind == UNK).sum())

    def gaps(self, text: str, stop: int) -> tuple[int, int] | None:
        """The first and last positions in (0, stop) at which a word begins after another's end."""
        if not self.gap or "\0" in text:
            return None
        first = _gap(text, 1, stop)
        if first is None:
            return None
        last = text.rfind(SPACE, first, stop)
        while last > first and text[last - 1] == SPACE:
            last -= 1
        return first, last

    def words(self, text: str) -> list[str]:
        """The text cut at every gap between words, and around line feeds."""
        if self.lines and "\n" in text:
            text = text.replace("\n", "\0\n\0")
        text = _gaps.sub("\0\\1", text)
        return [w for w in text.split("\0") if w]

    def encode(self, text: str) -> np.ndarray:
        """A whole text's ids, without the scan."""
        if not text:
            return np.zeros(0, np.int32)
        text = normal(text)
        if not self.gap or "\0" in text:
            return np.array(self.emit(text, self.path(text, np.zeros(1))[1], len(text))[0], np.int32)
        return np.frombuffer(self.ids_of(self.words(text)), np.int32)

    def frame(self, text: str, core: int) -> tuple[int, int] | None:
        """The first gap that all entry states lie before and the last gap of a chunk; None if there is none."""
        at = self.gaps(text, core)
        if at is None or at[1] < self.longest:
            return None
        first = at[0] if at[0] >= self.longest else _gap(text, self.longest, core)
        return None if first is None or first > at[1] else (first, at[1])

    def matrix(self, text: str, core: int) -> np.ndarray:
        """Transfer matrix of a chunk: text[:core], with what pieces may reach into behind it."""
        n = self.longest
        stop = min(len(text), core + n - 1)
        at = self.frame(text, core)
        if at is None:
            out = np.full((n, n), NEG)
            for i in range(n):
                if i < core:
                    best, _ = self.path(text, np.zeros(1), i, core, stop)
                    out[i, : stop - core + 1] = best[core:]
                elif i <= stop:
                    out[i, i - core] = 0  # a piece that spans the whole chunk
            return out
        first, last = at
        into = np.array([self.path(text[:first], np.zeros(1), i)[0][-1] for i in range(n)])
        middle = self.score(np.frombuffer(self.ids_of(self.words(text[first:last])), np.int32))
        tail, _ = self.path(text, np.zeros(1), last, core, stop)
        return _grown(into[:, None] + middle + np.array(tail[core:])[None, :], n)

    def exits(self, text: str, core: int, entry: np.ndarray) -> np.ndarray:
        """For each exit state the entry state of its best path, -1 where there is none."""
        stop = min(len(text), core + self.longest - 1)
        out = np.full(self.longest, -1)
        at = self.frame(text, core)
        if at is None:
            best, back = self.path(text, entry, 0, core, stop)
            for j in range(stop - core + 1):
                if best[core + j] > NEG:
                    out[j] = _entry(back, core + j)
            return out
        first, last = at  # all paths meet at the gaps
        tail, _ = self.path(text, np.zeros(1), last, core, stop)
        state = _entry(self.path(text[:first], entry)[1], first)
        out[: stop - core + 1][np.array(tail[core:]) > NEG] = state
        return out

    def backtrace(self, text: str, core: int, entry: np.ndarray, state: int) -> bytes:
        """Ids of the pieces that start in the chunk on the best path to an exit state."""
        stop = min(len(text), core + self.longest - 1)
        as_bytes = lambda ids: np.array(ids, np.int32).tobytes()
        at = self.frame(text, core)
        if at is None:
            return as_bytes(self.emit(text, self.path(text, entry, 0, core, stop)[1], core + state)[0])
        first, last = at
        head = self.emit(text, self.path(text[:first], entry)[1], first)[0]
        tail = self.emit(text, self.path(text, np.zeros(1), last, core, stop)[1], core + state, last)[0]
        return as_bytes(head) + self.ids_of(self.words(text[first:last])) + as_bytes(tail)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _entry(back: list[int], end: int) -> int:
    while back[end] >= 0:
        end = back[end]
    return end


def _gap(text: str, start: int, stop: int) -> int | None:
    at = text.find(SPACE, start, stop)
    while 0 <= at and text[at - 1] == SPACE:
        at = text.find(SPACE, at + 1, stop)
    return at if at >= 0 else None


def _grown(m: np.ndarray, n: int) -> np.ndarray:
    out = np.full((n, n), NEG)
    out[:, : m.shape[1]] = m
    return out


def normal(text: str) -> str:
    return (SPACE + text.replace(" ", SPACE)) if text else ""


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: over vectors and matrices alike."""
    return (a[..., :, None] + b).max(-2)


ROW = "uid long, doc_id long, no int, ids binary"


def _pack(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _giants(docs: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """(uid, doc_id, no, ids) of every chunk of documents over the chunk size."""
    i64, i32, raw = pa.int64(), pa.int32(), pa.binary()

    def cut(batches):
        reach = model(path).longest
        for batch in (part for b in batches for part in slices(b, "text")):
            for uid, doc, text in zip(*(column(batch, c).to_pylist() for c in ("uid", "doc_id", "text"))):
                text = normal(text)
                for no, at in enumerate(range(0, len(text), chunk_chars)):
                    yield _pack([(uid, doc, no, min(chunk_chars, len(text) - at), text[at : at + chunk_chars + reach - 1])], ["uid", "doc_id", "no", "core", "chunk"], [i64, i64, i32, i32, pa.string()])

    def matrices(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        cells = [m.matrix(t, c).tobytes() for t, c in zip(column(batch, "chunk").to_pylist(), column(batch, "core").to_pylist())]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("uid", "doc_id", "no", "core", "chunk")), pa.array(cells, raw)], ["uid", "doc_id", "no", "core", "chunk", "matrix"])

    chunks = docs.mapInArrow(cut, "uid long, doc_id long, no int, core int, chunk string").repartition("uid", "no")
    table = scratch(map_texts(chunks, matrices, "uid long, doc_id long, no int, core int, chunk string, matrix binary", "chunk").withColumn("block", F.expr(f"no div {FOLD}").cast("int")), "chunks")

    def square(cell: bytes) -> np.ndarray:
        x = np.frombuffer(cell)
        return x.reshape(int(len(x) ** 0.5), -1)

    def fold(t: pa.Table) -> pa.Table:  # the product of a block's matrices, or of a document's blocks
        t = t.sort_by("no")
        out = None
        for cell in t["matrix"].to_pylist():
            out = square(cell) if out is None else combine(out, square(cell))
        return pa.table({"uid": t["uid"][:1], "no": t["block"][:1], "matrix": pa.array([out.tobytes()], raw)})

    def entries(key_out: str):
        def run(t: pa.Table, start: pa.Table | None = None) -> pa.Table:
            t = t.sort_by("no")
            v = None if start is None else np.frombuffer(start["entry"][0].as_py())
            out = []
            for cell in t["matrix"].to_pylist():
                m = square(cell)
                if v is None:
                    v = np.where(np.arange(len(m)) == 0, 0.0, NEG)
                out.append(v.tobytes())
                v = combine(v, m)
            return pa.table({"uid": t["uid"], key_out: t["no"], "entry": pa.array(out, raw)})

        return run

    blocks = table.select("uid", "block", "no", "matrix").groupBy("uid", "block").applyInArrow(fold, "uid long, no int, matrix binary")
    up = entries("block")
    block_entry = blocks.groupBy("uid").applyInArrow(lambda t: up(t), "uid long, block int, entry binary")
    down = entries("no")
    chunk_entry = table.select("uid", "block", "no", "matrix").groupBy("uid", "block").cogroup(block_entry.groupBy("uid", "block")).applyInArrow(lambda a, b: down(a, b), "uid long, no int, entry binary")

    def exit_maps(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        rows = zip(*(column(batch, c).to_pylist() for c in ("chunk", "core", "entry")))
        maps = [m.exits(t, c, np.frombuffer(e)).astype(np.int32).tobytes() for t, c, e in rows]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("uid", "no", "entry")), pa.array(maps, raw)], ["uid", "no", "entry", "exits"])

    ready = table.select("uid", "no", "core", "chunk").join(chunk_entry, ["uid", "no"])
    maps = scratch(map_texts(ready, exit_maps, "uid long, no int, entry binary, exits binary", "chunk"), "exits")

    def chain(t: pa.Table) -> pa.Table:  # a document's exit states, from its end: 64 bytes a chunk
        t = t.sort_by([("no", "descending")])
        state, out = 0, []
        for cell in t["exits"].to_pylist():
            out.append(state)
            state = int(np.frombuffer(cell, np.int32)[state])
        return pa.table({"uid": t["uid"], "no": t["no"], "state": pa.array(out, i32)})

    states = maps.select("uid", "no", "exits").groupBy("uid").applyInArrow(chain, "uid long, no int, state int")

    def backtrace(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        ids = [m.backtrace(t, c, np.frombuffer(e), s) for t, c, e, s in zip(*(column(batch, c).to_pylist() for c in ("chunk", "core", "entry", "state")))]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("uid", "doc_id", "no")), pa.array(ids, raw)], ["uid", "doc_id", "no", "ids"])

    last = table.select("uid", "doc_id", "no", "core", "chunk").join(maps.select("uid", "no", "entry"), ["uid", "no"]).join(states, ["uid", "no"])
    return map_texts(last, backtrace, ROW, "chunk")


def encoded_parts(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """``encode`` of the documents up to ``chunk_chars``, a row each, and of the others, a row a chunk."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    giant = F.length("text") > chunk_chars

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        ids = [m.encode(t).astype("<i4").tobytes() for t in column(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays([column(batch, "uid"), column(batch, "doc_id"), pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["uid", "doc_id", "no", "ids"])

    return map_texts(rows.filter(~giant), whole, ROW), _giants(rows.filter(giant), path, chunk_chars)


def encode(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(uid, doc_id, no, ids): a row for each chunk of each document, its ids as little-endian 32-bit integers.

    ``uid`` numbers the rows of ``docs``; documents up to ``chunk_chars`` are one chunk.
    """
    small, giant = encoded_parts(docs, path, chunk_chars)
    return small.unionByName(giant)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(uid, doc_id, text): the chunks' ids put together again and decoded."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        texts = [m.decode(np.frombuffer(b"".join(x), np.int32)) for x in column(batch, "parts").to_pylist()]
        return pa.RecordBatch.from_arrays([column(batch, "uid"), column(batch, "doc_id"), pa.array(texts, pa.string())], ["uid", "doc_id", "text"])

    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])
    joined = encoded.groupBy("uid", "doc_id").agg(parts.alias("parts"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield kernel(batch.slice(at, 64))

    return joined.mapInArrow(run, "uid long, doc_id long, text string")


def summary(parts: tuple[DataFrame, DataFrame], path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of all ids as little-endian 32-bit integers), n_chars and text_crc32 (UTF-8) of
    the text that the ids decode to; one row per document. Only giants' chunks are put together, as ids."""
    small, giant = parts
    cells = F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])
    joined = giant.groupBy("uid", "doc_id").agg(cells.alias("parts")).select("doc_id", "parts")

    def run(batches):
        m = model(path)
        for batch in batches:
            rows = []
            for doc, held in zip(column(batch, "doc_id").to_pylist(), column(batch, "parts").to_pylist()):
                data = b"".join(held)
                text = m.decode(np.frombuffer(data, np.int32))
                rows.append((doc, len(data) // 4, zlib.crc32(data), len(text), zlib.crc32(text.encode("utf-8", "surrogatepass"))))
            yield _pack(rows, ["doc_id", "n_tokens", "ids_crc32", "n_chars", "text_crc32"], [pa.int64()] * 5)

    schema = "doc_id long, n_tokens long, ids_crc32 long, n_chars long, text_crc32 long"
    return small.select("doc_id", F.array("ids").alias("parts")).mapInArrow(run, schema).unionByName(joined.mapInArrow(run, schema))
