"""Token ids of documents in compressed binary files: static range asymmetric numeral coding in independent blocks."""

from __future__ import annotations

import bisect
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .kernels import prefix_hashes, range_hashes

#: Precision of the shared frequencies: they add up to 2^BITS.
BITS = 20
#: A state lies in [LOW, LOW << 32) between symbols; words of 32 bits enter and leave it.
LOW = 1 << 31
#: Tokens of a block; a longer document is a block of its own.
BLOCK = 1 << 20
#: Lanes of a block at most, and tokens of a lane at least where there are several.
MOST_LANES, LANE_TOKENS = 2048, 512
#: Checkpoints of a block: one each so many steps of all lanes.
STEPS = 256
#: Tokens of a file, and sample rows a file from which the ranges of files are cut (balance only; every row is written).
FILE_TOKENS, SAMPLE = 1 << 23, 100
#: Words that a worker remembers; then it begins anew.
WORDS_REMEMBERED = 3_000_000

_MAGIC = b"TRA1"
_HEAD = struct.Struct("<4sBBHIIIQII")  # magic, bits, bytes an id, -, tokens, lanes, checkpoints, words, digest of the table, crc of the ids
U = np.uint64


# --- coding of one block ---------------------------------------------------------------------------------------------------------


class Table:
    """Frequencies of ids that add up to 2^bits, each at least 1, so that every id of the vocabulary can be written."""

    def __init__(self, frequencies: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.f = frequencies.astype(np.uint64)
        if int(self.f.sum()) != 1 << bits or not self.f.all():
            raise ValueError("frequencies must be positive and add up to 2^bits")
        self.begin = np.cumsum(self.f) - self.f
        self.id_of = np.repeat(np.arange(len(self.f), dtype=np.uint32), frequencies)
        self.digest = zlib.crc32(self.f.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: dict[int, int], size: int, bits: int = BITS) -> Table:
        """The table of a corpus. counts: occurrences of ids below `size`."""
        if size > 1 << bits - 1:
            raise ValueError("vocabulary too large for the precision")
        total, spare = max(sum(counts.values()), 1), (1 << bits) - size
        f = np.ones(size, np.int64)
        for i, n in counts.items():
            f[i] += n * spare // total
        f[int(f.argmax())] += (1 << bits) - int(f.sum())
        return cls(f, bits)


def encoded(ids: np.ndarray, table: Table) -> bytes:
    """A block: header, checkpoints (words read so far, crc of the ids up to the next, state of every lane), words, crc of all before.

    Id i belongs to lane i mod lanes. Lanes are coded from the last id to the first and share one stream of words, in the order
    in which a reader that steps all lanes together wants them.
    """
    n = len(ids)
    lanes = int(min(MOST_LANES, max(1, n // LANE_TOKENS)))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, U)
    shift = U(63 - table.bits)
    stream, marks, used = [], [], 0
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        x, f = state[: len(s)], table.f[s]
        full = x >= f << shift
        if full.any():
            stream.append((x[full] & U(0xFFFFFFFF)).astype("<u4"))
            used += len(stream[-1])
            x = np.where(full, x >> U(32), x)
        q = x // f
        state[: len(s)] = (q << U(table.bits)) + (x - q * f) + table.begin[s]
        if t % STEPS == 0:
            part = ids[t * lanes : (t + STEPS) * lanes]
            marks.append((used, zlib.crc32(part.astype("<u4").tobytes()), state.astype("<u8").tobytes()))
    marks.reverse()
    out = [_HEAD.pack(_MAGIC, table.bits, 4, 0, n, lanes, len(marks), used, table.digest, zlib.crc32(ids.astype("<u4").tobytes()))]
    out += [struct.pack("<QI", used - at, crc) + states for at, crc, states in marks]
    out += [words.tobytes() for words in reversed(stream)]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def decoded(block: bytes, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of a block, from the last checkpoint at or before `start`; all of its checksums that are read must hold."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack_from("<I", block, len(block) - 4)[0]:
        raise ValueError("block is damaged")
    magic, bits, _, _, n, lanes, marks, words, digest, crc = _HEAD.unpack_from(block)
    if magic != _MAGIC or digest != table.digest or bits != table.bits:
        raise ValueError("block is not of this format or not of this table")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    size = 12 + 8 * lanes
    stream = np.frombuffer(block, "<u4", words, _HEAD.size + marks * size).astype(U)
    first, last = start // (lanes * STEPS), (stop - 1) // (lanes * STEPS)
    mask, bits = U((1 << table.bits) - 1), U(table.bits)
    out = np.empty(min(n, (last + 1) * lanes * STEPS) - first * lanes * STEPS, np.uint32)
    done = 0
    at, _ = struct.unpack_from("<QI", block, _HEAD.size + first * size)
    state = np.frombuffer(block, "<u8", lanes, _HEAD.size + first * size + 12).astype(U)
    while done < len(out):
        many = min(lanes, len(out) - done)
        x = state[:many]
        slot = x & mask
        s = table.id_of[slot]
        x = table.f[s] * (x >> bits) + slot - table.begin[s]
        low = np.flatnonzero(x < U(LOW))
        x[low] = x[low] << U(32) | stream[at : at + len(low)]
        at += len(low)
        state[:many] = x
        out[done : done + many] = s
        done += many
    for k in range(first, last + 1):
        part = out[(k - first) * lanes * STEPS : (k - first + 1) * lanes * STEPS]
        if zlib.crc32(part.astype("<u4").tobytes()) != struct.unpack_from("<QI", block, _HEAD.size + k * size)[1]:
            raise ValueError("ids are not those that were written")
    if first == 0 and len(out) == n and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("ids are not those that were written")
    a = first * lanes * STEPS
    return out[start - a : stop - a]


# --- ids of texts ----------------------------------------------------------------------------------------------------------------


class WordIds:
    """Ids of texts for a tokenizer that lower-cases, drops white space and cuts letters from other characters, such as
    word_bpe_49k.json: words are encoded once and remembered by a 64-bit hash, runs of ASCII letters many at a time.

    A word ends at blanks, tabs, CR and LF, and before `.,;:!?` where a letter a-z stands; nothing of the tokenizer crosses such a place.
    Texts that may hold special tokens (told by case and by what is beside them) go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.library, self.letters):
            t.no_padding()
            t.no_truncation()
        # lower-case ASCII letters between blanks: neither normal forms nor classes of characters matter
        self.letters.normalizer, self.letters.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")
        self.size = self.library.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.last = np.zeros(self.size, bool)  # ids that end a word
        self.last[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # hashes in order, and the place and number of each word's ids
        self.keys, self.place, self.many = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0

    def _library_ids(self, texts: list[str], library=None) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in (library or self.library).encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        plain = [k for k, w in enumerate(words) if w.isalpha() and len(w) < 100]
        groups = [plain[a : a + 100] for a in range(0, len(plain), 100)]
        for group, ids in zip(groups, self._library_ids([b" ".join([words[k] for k in g]).decode() for g in groups], self.letters)):
            edges = np.flatnonzero(self.last[ids]) + 1
            if len(edges) == len(group):
                for k, x in zip(group, np.split(ids, edges[:-1])):
                    out[k] = x
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._library_ids([words[k].decode() for k in rest])):
            out[k] = x
        return out

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        if len(self.keys) > WORDS_REMEMBERED:
            self._forget()
        found = self._ids_of(words)
        many = np.array([len(x) for x in found], np.int64)
        new = np.concatenate(found)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(new), self.used), self.kind)])
        self.flat[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.keys, keys)
        self.place = np.insert(self.place, at, self.used + np.cumsum(many) - many)
        self.many = np.insert(self.many, at, many)
        self.keys = np.insert(self.keys, at, keys)
        self.used += len(new)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text, little-endian. data, offsets: UTF-8 bytes of the texts end to end."""
        low = _PLAIN[data]
        raw = low.tobytes()
        n = len(offsets) - 1
        whole = [k for k in range(n) if raw.find(b"<|", offsets[k], offsets[k + 1]) >= 0] if b"<|" in raw else []
        start, end = _word_spans(low, offsets)
        if not len(start):
            return [b""] * n
        rows = np.searchsorted(start, offsets)
        sums = prefix_hashes(low)
        u, first, which = np.unique(range_hashes(sums, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, u), max(len(self.keys) - 1, 0))
        missing = np.flatnonzero(self.keys[at] != u) if len(self.keys) else np.arange(len(u))
        if len(missing):
            if len(self.keys) > WORDS_REMEMBERED:  # all of this batch's words must be there at once
                self._forget()
                missing = np.arange(len(u))
            self._learn(u[missing], [raw[start[k] : end[k]] for k in first[missing].tolist()])
            at = np.searchsorted(self.keys, u)
        many = self.many[at][which]
        before = np.concatenate([[0], np.cumsum(many)])
        ids = self.flat[np.repeat(self.place[at][which] - before[:-1], many) + np.arange(before[-1])].tobytes()
        cut = (before[rows] * self.flat.itemsize).tolist()
        out = [ids[a:b] for a, b in zip(cut, cut[1:])]
        for k, x in zip(whole, self._library_ids([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in whole])):
            out[k] = x.tobytes()
        return out


#: Bytes as words are told apart: A-Z in lower case, tab, CR and LF as blanks.
_PLAIN = np.array([32 if c in b"\t\r\n" else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_LETTER = np.array([97 <= c <= 122 for c in range(256)])
_MARK = np.isin(np.arange(256), list(b".,;:!?"))


def _word_spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of all texts; none crosses a text."""
    n = len(low)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = low != 32
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    edge = edge[:n]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:] | (_MARK[low[1:]] & _LETTER[low[:-1]])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class TextIds:
    """Ids of texts for every other tokenizer of the library: whole texts, nothing remembered."""

    def __init__(self, path: str):
        words = WordIds(path)
        self.size, self.kind, self._ids = words.size, words.kind, words._library_ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        return [x.tobytes() for x in self._ids([raw[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist())])]


_encoders: dict[tuple[str, bool], WordIds | TextIds] = {}


def _encoder(path: str, by_word: bool):
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = (WordIds if by_word else TextIds)(path)
    return _encoders[path, by_word]


# --- files -----------------------------------------------------------------------------------------------------------------------


def _cuts(docs: DataFrame, key: str, files: int) -> list[tuple]:
    """Up to files - 1 keys (has an id, id, text hash) that cut the table into ranges of about as many rows, from a sample of rows
    with the least hashes; equal rows share a range only if they are no third of a file."""
    if files < 2:
        return []
    sample = docs.select(F.col(key).alias("k"), F.col("_tie").alias("t")).orderBy(F.xxhash64("k", "t"), "k", "t").limit(SAMPLE * files).collect()
    found = sorted((r["k"] is not None, r["k"], r["t"]) if r["k"] is not None else (False, 0, r["t"]) for r in sample)
    return [found[len(found) * j // files] for j in range(1, files)] if found else []


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, by_word: bool = False) -> None:
    """Writes the ids of every whole text, without begin and special tokens and with `end_id` after each document, to `folder`:

    * blocks: Parquet rows (file, block, first, n_tokens, keys, lengths, ids): the coded ids of consecutive documents in ascending
      order of `key` (null first, then by text hash), and the documents' keys and numbers of ids;
    * files: (file, start): ids of all files before it;
    * frequencies: (id, frequency): the table that all blocks share, from counts over the whole table.

    Texts are encoded where they are read; their ids move once, to their range of keys. A range's documents are gathered in
    blocks; coding a block needs nothing but the table, so it needs no order and no shuffle. by_word: see `WordIds`.

    Null is the empty text, which is written as the end id alone; null keys come first. Rows of one key, and repeated rows, are
    documents of their own; rows of one key are dealt out by text hash. An empty table gives files without blocks. Other columns aren't read.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).withColumn("_tie", F.xxhash64("text"))
    key_type = docs.schema["k"].dataType
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(2 * spark.sparkContext.defaultParallelism, -(-size // (3 * FILE_TOKENS)))  # texts have some three bytes an id
    cuts = _cuts(docs, "k", files)

    def make(rb: pa.RecordBatch) -> list:
        encoder = _encoder(tokenizer_path, by_word)
        end = np.array([end_id], encoder.kind).tobytes()
        keys, ties = rb.column(0).to_pylist(), rb.column(2).to_pylist()
        place = [bisect.bisect_right(cuts, (True, k, t) if k is not None else (False, 0, t)) for k, t in zip(keys, ties)]
        ids = [x + end for _, _, data, offsets in common.text_chunks(rb, "text") for x in encoder.encode(data, offsets)]
        return [pa.array(ids, pa.binary()), pa.array(place, pa.int32())]

    def parts(rb: pa.RecordBatch):
        return (rb.slice(a, b - a) for a, b, _, _ in common.text_chunks(rb, "text", 2 << 20))

    kind = np.uint16 if vocabulary_size(tokenizer_path) <= 1 << 16 else np.uint32
    ids = common.append_columns(docs, make, [common.field("ids", "binary"), common.field("file", "int")], ["k", "_tie"], parts)
    dealt = ids.repartition(files, "file").sortWithinPartitions("file", "k", "_tie")
    raw_schema = T.StructType([common.field("file", "int"), common.field("block", "long"), common.field("first", "long"), common.field("n_tokens", "long"), T.StructField("keys", T.ArrayType(key_type)), common.field("lengths", "array<long>"), common.field("raw", "binary")])

    def gather(batches):
        """Blocks of consecutive documents of a file."""
        arrow_key = None
        at = [None, 0, 0]  # file, blocks and ids of it so far
        keys, held, size = [], [], 0

        def block():
            lengths = [len(x) // kind().itemsize for x in held]
            n = sum(lengths)
            rb = pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([at[2]], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([keys], pa.list_(arrow_key)), pa.array([lengths], pa.list_(pa.int64())), pa.array([b"".join(held)], pa.binary())],
                names=[f.name for f in raw_schema],
            )
            at[1], at[2] = at[1] + 1, at[2] + n
            return rb

        for rb in batches:
            arrow_key = rb.column(0).type
            for k, x, f in zip(rb.column(0).to_pylist(), rb.column(2).to_pylist(), rb.column(3).to_pylist()):
                if held and (f != at[0] or size + len(x) > BLOCK * kind().itemsize):
                    yield block()
                    keys, held, size = [], [], 0
                if f != at[0]:
                    at[:] = [f, 0, 0]
                keys.append(k)
                held.append(x)
                size += len(x)
        if held:
            yield block()
        common.release()

    small_groups = {"parquet.block.size": str(16 << 20), "compression": "zstd"}
    raw = common.saved(dealt.mapInArrow(gather, raw_schema), f"{folder}/raw", small_groups)

    def histogram(batches):
        total = np.zeros(1 << 8 * kind().itemsize if kind is np.uint16 else 1 << 24, np.int64)
        for rb in batches:
            for x in rb.column(0):
                n = np.bincount(np.frombuffer(x.as_buffer(), kind))
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    counts = raw.select("raw").mapInArrow(histogram, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = Table.of_counts({r["id"]: r["n"] for r in counts.collect()}, max(vocabulary_size(tokenizer_path), end_id + 1))  # at most a row an id
    frequencies = pa.table({"id": np.arange(len(table.f), dtype=np.int32), "frequency": table.f.astype(np.int64)})
    spark.createDataFrame(frequencies).coalesce(1).write.mode("overwrite").parquet(f"{folder}/frequencies")
    shared = spark.sparkContext.broadcast(table.f.astype(np.uint32))  # a number an id

    def code(rb: pa.RecordBatch) -> list:
        known = _table(shared.value)
        return [pa.array([encoded(np.frombuffer(x.as_buffer(), kind), known) for x in rb.column(rb.schema.get_field_index("raw"))], pa.binary())]

    one = lambda rb: (rb.slice(k, 1) for k in range(rb.num_rows))
    blocks = common.append_columns(raw, code, [common.field("ids", "binary")], [c for c in raw.columns if c != "raw"], one)
    blocks = common.saved(blocks, f"{folder}/blocks", {"parquet.block.size": str(16 << 20), "compression": "none"})
    common.removed(spark, f"{folder}/raw")
    sizes = sorted((r["file"], r["n"]) for r in blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())  # a row a file
    starts = [(f, s - n) for (f, n), s in zip(sizes, np.cumsum([n for _, n in sizes]).tolist())]
    spark.createDataFrame(starts, "file int, start long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/files")


_tables: dict[int, Table] = {}


def _table(frequencies: np.ndarray) -> Table:
    digest = zlib.crc32(frequencies.astype("<u4").tobytes())
    if digest not in _tables:
        _tables.clear()
        _tables[digest] = Table(frequencies)
    return _tables[digest]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start long, n_tokens long, ids binary) of every document that `write_token_files` wrote to `folder`: its ids as
    little-endian unsigned 32-bit integers, with the end id, and the number of ids of all documents before it.

    Blocks are decoded apart from each other; a damaged one, and one of another table, raises an error.
    """
    common.tune(spark)
    frequencies = spark.read.parquet(f"{folder}/frequencies").orderBy("id").toArrow().column("frequency").to_numpy()  # a number an id
    shared = spark.sparkContext.broadcast(frequencies.astype(np.uint32))
    blocks = spark.read.parquet(f"{folder}/blocks").join(F.broadcast(spark.read.parquet(f"{folder}/files")), "file")  # two numbers a file
    key_type = blocks.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("key", key_type), common.field("start", "long"), common.field("n_tokens", "long"), common.field("ids", "binary")])

    def read(batches):
        table = _table(shared.value)
        for rb in batches:
            for keys, lengths, start, block in zip(*(rb.column(k) for k in range(4))):
                size = lengths.values.to_numpy()
                ids = decoded(block.as_py(), table)
                edges = np.concatenate([[0], np.cumsum(size)])
                offsets = pa.py_buffer((4 * edges).astype(np.int32).tobytes())
                data = pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(start.as_py() + edges[:-1]), pa.array(size), data], names=["key", "start", "n_tokens", "ids"])
        common.release()

    return blocks.select("keys", "lengths", F.col("start") + F.col("first"), "ids").mapInArrow(read, schema)
