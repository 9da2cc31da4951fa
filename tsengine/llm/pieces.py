"""SentencePiece encoding and decoding that keeps source offsets."""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
#: Entries of one generation of a worker's memory of encoded words; two generations are kept.
WORDS_REMEMBERED = 40_000
#: Bytes of texts that are encoded at a time.
TEXT_BYTES = 1 << 19
_codecs: dict[str, "Codec"] = {}


class CharacterMap:
    """The compiled character map of a model: a double-array trie from source strings to replacements.

    `longest(data, at)` gives (bytes consumed, replacement) for the longest key that starts at byte `at`, or None.
    """

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.texts = blob[4 + size :]
        self.list = self.units.tolist()
        #: Which bytes some key starts with; runs of other bytes are copied as they are.
        self.starts = np.array([bool(self.list) and self._step(self._offset(self.list[0]), b) is not None for b in range(256)])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int):
        at = node ^ byte
        unit = self.list[at]
        return (at ^ self._offset(unit), unit) if unit & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int):
        node, best = self._offset(self.list[0]), None
        for i in range(at, len(data)):
            if (step := self._step(node, data[i])) is None:
                break
            node, unit = step
            if unit >> 8 & 1:
                best = (i + 1 - at, self.list[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]


class Codec:
    """A model's normaliser with source alignment, and its segmentation of normalised text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        # The same model without normaliser: it segments text that is already normalised.
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        normal = [p.piece for p in model.pieces if p.type in (1, 4, 5)]
        self.symbols = sorted((p.piece.encode() for p in model.pieces if p.type == 4), key=len, reverse=True)
        self.starts_any = self.map.starts.copy()
        self.starts_any[[s[0] for s in self.symbols if s]] = True
        self.size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = [i for i, p in enumerate(model.pieces) if p.type == 2][0]
        self.fallback = model.trainer_spec.byte_fallback
        # Words can be segmented one by one if no piece joins the end of one to the mark of the next.
        apart = model.trainer_spec.model_type == 2 and self.fallback and not any(p.type == 4 for p in model.pieces) and not any(SPACE in p.lstrip(SPACE) for p in normal)
        stop = SPACE + "".join(c for c in "\n\t" if not any(c in p for p in normal))
        self.words = re.compile(f"{SPACE}*[^{stop}]+|{SPACE}+|[{stop[1:]}]" if len(stop) > 1 else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if apart else None
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The bytes after the character map, and for each the byte of the source where it came from: its own place where it is
        copied, the first byte of the key where it is replaced. The model's own symbols stay as they are."""
        raw = np.frombuffer(data, np.uint8)
        out, source, done, free = [], [], 0, 0
        for at in np.flatnonzero(self.starts_any[raw]).tolist():
            if at < free:
                continue
            own = next((len(s) for s in self.symbols if data.startswith(s, at)), 0)
            if own:
                free = at + own
                continue
            found = self.map.longest(data, at) if self.map.starts[raw[at]] else None
            if found is None:
                # a key starts where a character does
                free = at + (1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4)
                continue
            n, part = found
            out += [raw[done:at], np.frombuffer(part, np.uint8)]
            source += [np.arange(done, at), np.full(len(part), at)]
            done = free = at + n
        return np.concatenate([*out, raw[done:]]), np.concatenate([*source, np.arange(done, len(raw))])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the byte of the source where it came from."""
        data = text.encode()
        out, source = self._mapped(data)
        end = len(data)
        blank = out == 32
        if self.squeeze:  # of a run of blanks the first stays; none at the ends
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            full = np.flatnonzero(~blank)
            keep[: full[0] if len(full) else len(out)] = False
            if len(full):
                end = int(source[full[-1] + 1]) if full[-1] + 1 < len(out) else end
                keep[full[-1] + 1 :] = False
            out, source, blank = out[keep], source[keep], blank[keep]
        if not len(out):
            return "", np.zeros(1, np.int64)
        mark = np.frombuffer(SPACE.encode() if self.escape else b" ", np.uint8)
        if self.escape:
            width = np.where(blank, 3, 1)
            at = np.cumsum(width) - width
            out, source = np.repeat(out, width), np.repeat(source, width)
            for k, b in enumerate(mark):
                out[at[blank] + k] = b
        if self.prefix and self.suffix:
            out, source = np.concatenate([out, mark]), np.concatenate([source, np.full(len(mark), end)])
        elif self.prefix:
            out, source = np.concatenate([mark, out]), np.concatenate([np.full(len(mark), source[0]), source])
        return out.tobytes().decode(), np.append(source, end)

    def _remember(self, words: set[str]) -> None:
        if len(self.young) > WORDS_REMEMBERED:
            self.old, self.young = self.young, {}
        new = []
        for w in words:
            if w not in self.young:
                if (known := self.old.get(w)) is None:
                    new.append(w)
                else:
                    self.young[w] = known
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            for w, ids in zip(part, self.segment.encode(part, num_threads=1)):
                self.young[w] = (np.array(ids, np.int32).tobytes(), " ".join(map(str, ids)))

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """For each text: ids, the ids as text, and the byte span [begin, end) of the source under each piece."""
        normal = [self.normalise(t) for t in texts]
        if self.words:
            split = [self.words(n) for n, _ in normal]
            self._remember(set().union(*split))
            found = []
            for words in split:
                known = [self.young[w] for w in words]
                found.append((np.frombuffer(b"".join([k[0] for k in known]), np.int32), " ".join([k[1] for k in known])))
        else:
            found = [(np.array(ids, np.int32), " ".join(map(str, ids))) for ids in self.segment.encode([n for n, _ in normal], num_threads=1)]
        out = []
        for (text, source), (ids, shown) in zip(normal, found):
            if self.fallback or not (ids == self.unknown).any():
                edge = np.concatenate([[0], np.cumsum(self.size[ids])])
            else:  # an unknown piece stands for any run of characters
                edge = np.array([0] + [p.end for p in self.segment.encode(text, return_type="proto").pieces])
            out.append((ids, shown, source[edge[:-1]], source[edge[1:]]))
        return out


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", end_id: bool = True, keep=None, spans: bool = True, digests: bool = False) -> DataFrame:
    """`docs` with the pieces of every whole text, as the sentencepiece library encodes it without sampling.

    Columns: n_tokens long; decoded string, the library's decode of the ids; and with `spans` piece_ids array<int>,
    piece_begin and piece_end array<int>, the byte span of the source text under each piece (the end id has the empty span at
    the end); with `digests` instead ids_sha256 and decoded_sha256, lowercase hex of the ids joined by one blank and of the
    decoded text, and spans_tile boolean: the spans follow each other and cover the text's bytes.
    No begin id; the end id if `end_id`.
    keep: input columns to return (default: all).

    Null is the empty text: only the end id, decoded to the empty text. Works row by row, so ties and repeated rows keep their
    place, an empty table gives an empty result, and very long texts stay within one Arrow batch. Input columns named like the
    new ones are replaced.
    """
    fields = [common.field("n_tokens", "long")]
    fields += [common.field(c, "string") for c in (("ids_sha256", "decoded_sha256") if digests else ("decoded",))]
    if digests:
        fields.append(common.field("spans_tile", "boolean"))
    elif spans:
        fields += [common.field(c, "array<int>") for c in ("piece_ids", "piece_begin", "piece_end")]

    def parts(rb: pa.RecordBatch):
        # runs of rows: while texts are encoded, their pieces are Python objects, and pieces are larger than texts
        return (rb.slice(a, b - a) for a, b, _, _ in common.text_chunks(rb, text, TEXT_BYTES))

    def make(rb: pa.RecordBatch) -> list:
        c = codec(model_path)
        texts = common.strings(rb, text)
        end = c.library.eos_id()
        found = c.encode(texts)
        ids = [[*x.tolist(), end] if end_id else x.tolist() for x, _, _, _ in found]
        decoded = c.library.decode(ids, num_threads=1) if ids else []
        counts = pa.array([len(x) for x in ids], pa.int64())
        if digests:
            tile, named, shown = [], [], []
            tail = f" {end}" if end_id else ""
            for t, (x, s, begin, stop) in zip(texts, found):
                size = len(t.encode())
                tile.append(bool(not size if not len(begin) else begin[0] == 0 and stop[-1] == size and (begin[1:] == stop[:-1]).all()))
                named.append(hashlib.sha256((s + tail if s else tail[1:]).encode()).hexdigest())
            shown = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
            return [counts, pa.array(named, pa.string()), pa.array(shown, pa.string()), pa.array(tile, pa.bool_())]
        cols = [counts, pa.array(decoded, pa.string())]
        if spans:
            size = [len(t.encode()) for t in texts]
            more = (lambda a, n: np.append(a, n)) if end_id else (lambda a, n: a)
            cols += [pa.array(ids, pa.list_(pa.int32()))]
            cols += [pa.array([more(x[k], n).astype(np.int32) for x, n in zip(found, size)], pa.list_(pa.int32())) for k in (2, 3)]
        return cols

    return common.append_columns(docs, make, fields, keep, parts, lambda: codec(model_path).forget())
