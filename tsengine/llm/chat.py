"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered canonically."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
#: Hidden states: the first line of a role's turn, then a further line of it.
STATES = [(role, first) for role in ROLES for first in (True, False)]
#: Words that markers are made of. Fixed values.
NAMES = ("user", "human", "q", "question", "customer", "assistant", "ai", "a", "answer", "bot", "agent", "model", "system", "instructions", "context", "developer")
#: Marker styles in which labelled turns are written out for training and for the registered query. Fixed values.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "Instructions: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "### System\n", "user": "### User\n", "assistant": "### Assistant\n"},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
    {"system": "[system] ", "user": "[customer] ", "assistant": "[agent] "},
    {"system": "Setup: ", "user": "Ann: ", "assistant": "Helper: "},
    {"system": "**Scene** ", "user": "**Guest** ", "assistant": "**Host** "},
)
_marker = re.compile(r"\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?(" + "|".join(NAMES) + r")(?:\|?>|\]|\*\*|:|\s*$)[: ]*", re.IGNORECASE)
#: Other short names that may be markers: in brackets or stars, after number signs, or before a colon.
_other = re.compile(r"\s*(?:#{1,4}\s*([A-Za-z][\w-]{0,15})\s*$|\*\*([A-Za-z][\w -]{0,15})\*\*:?\s|<\|?([A-Za-z][\w-]{0,15})\|?>\s?|\[([A-Za-z][\w -]{0,15})\]\s|([A-Z][\w-]{0,15}):\s)")
#: Names beyond NAMES are told apart by the order in which a transcript brings them; later ones than these count as the last.
OTHERS = 4
#: Values of each line feature: marker, blank line before with marker or not, length, end, start, end of the line before.
SIZES = (len(NAMES) + OTHERS + 1, 4, 9, 4, 3, 4)
#: Turns of one conversation that one row holds.
TURNS = 512


def read_marker(line: str, others: dict[str, int] | None = None) -> tuple[int, str]:
    """(number of the marker's name, from 1, or 0; the line without its marker). others: names beyond NAMES seen so far, with the
    order of their first appearance; a new one is added."""
    m = _marker.match(line)
    if m:
        return NAMES.index(m.group(1).lower()) + 1, line[m.end() :]
    m = _other.match(line)
    if not m:
        return 0, line
    others = {} if others is None else others
    place = others.setdefault(next(g for g in m.groups() if g).lower(), len(others))
    return len(NAMES) + 1 + min(place, OTHERS - 1), line[m.end() :]


def _end(text: str) -> int:
    return 0 if not text else 1 if text[-1] == "?" else 2 if text[-1] in ".!" else 3


def line_features(lines: list[str], others: dict[str, int] | None = None) -> np.ndarray:
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    others = {} if others is None else others
    blank, before = False, 0
    for i, line in enumerate(lines):
        marker, rest = read_marker(line, others)
        rest = rest.rstrip()
        out[i] = marker, 2 * (marker > 0) + blank, min(len(rest).bit_length(), 8), _end(rest), 0 if not rest else 1 if rest[0].isupper() else 2, before
        blank = not line.strip()
        before = before if blank else _end(rest)
    return out


def write_out(roles: list, texts: list, style: int, drop: list[bool]) -> tuple[list[str], list[int]]:
    """Lines of a raw transcript of labelled turns, and the state of each (-1: of no known role). drop: turns without marker."""
    lines, states = [], []
    for role, text, bare in zip(roles, texts, drop):
        known = role in ROLES
        part = (("" if bare or not known else STYLES[style][role]) + (text or "")).split("\n")
        lines += part
        states += [-1] * len(part) if not known else [2 * ROLES.index(role)] + [2 * ROLES.index(role) + 1] * (len(part) - 1)
        if style % 2 == 0:
            lines.append("")
            states.append(states[-1] if not known else 2 * ROLES.index(role) + 1)
    return lines, states


class Model:
    """Log probabilities of the first state, of state pairs and of feature values, from counts smoothed by 0.05."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        log = lambda c: np.log((c + 0.05) / (c + 0.05).sum(-1, keepdims=True))
        self.start, self.step, self.emit = log(start), log(step), [log(e) for e in emit]

    def _seen(self, x: np.ndarray) -> np.ndarray:
        return sum(e[:, x[:, j]] for j, e in enumerate(self.emit)).T

    def transfer(self, x: np.ndarray) -> np.ndarray:
        """[i, j]: the best log probability of these lines that follow a line of state i and end with state j."""
        best = None
        for row in self._seen(x):
            best = self.step + row if best is None else (best[:, :, None] + self.step[None]).max(1) + row
        return best

    def viterbi(self, x: np.ndarray, before: int = -1, last: int = -1) -> list[int]:
        """The likeliest states of lines with these features; of equal ones those listed first. before: the state of the line
        before them (-1: they begin the transcript); last: the state of their last line (-1: any)."""
        seen = self._seen(x)
        best, back = (self.start if before < 0 else self.step[before]) + seen[0], []
        for row in seen[1:]:
            paths = best[:, None] + self.step
            came = paths.argmax(0)
            back.append(came)
            best = paths[came, np.arange(len(STATES))] + row
        path = [int(best.argmax()) if last < 0 else last]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        return path[::-1]


def parse(text: str, model: Model, before: int = -1, last: int = -1) -> list[tuple[str, str]]:
    """(role, text) of the turns of a raw transcript, markers taken off, blank lines at a turn's ends dropped. before, last: as in
    `Model.viterbi`, for a part of a transcript."""
    lines = text.split("\n")
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, model.viterbi(line_features(lines), before, last)):
        role, first = STATES[state]
        if first or not turns or turns[-1][0] != role:
            turns.append((role, []))
            line = read_marker(line)[1]
        turns[-1][1].append(line)
    return [(role, "\n".join(part).strip("\n")) for role, part in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: a line <|role|>, the text, and <|end|>; the mark <| inside a text becomes < |."""
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}<|end|>\n" for role, text in turns)


def _style(key: str) -> int:
    return zlib.crc32(key.encode()) // 5 % len(STYLES)


def _bare(key: str, n: int) -> list[bool]:
    """Which turns are written without marker: about one in eight, never the first."""
    return [i > 0 and zlib.crc32(f"{key}/{i}".encode()) % 8 == 0 for i in range(n)]


def conversations_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, turns): the turns of each conversation in order, those of TURNS numbers together, so that a very long
    conversation is dealt over rows. Turns without a number, or many of one number, are dealt over parts by their hash; turns of
    one number stand in the order of role and text in a part. A row without conversation id is one of its own."""
    known = F.col(conv).isNotNull()
    own = F.when(known, F.lit(0).cast("long")).otherwise(F.xxhash64(turn, role, text))
    part = F.when(F.col(turn).isNotNull(), F.floor(F.col(turn) / TURNS)).otherwise(-1 - F.pmod(F.xxhash64(role, text), F.lit(64)))
    keyed = turns.select(F.col(conv).alias("conv"), own.alias("own"), part.alias("part"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    return keyed.groupBy("conv", "own", "part").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("own")


def _written(rb: pa.RecordBatch, twice: bool = False):
    """For each conversation of a batch: id, key, lines, states, turns; in the style of its key, and if `twice` in one further on."""
    names = rb.schema.get_field_index
    for conv, part, turns in zip(*(rb.column(names(c)).to_pylist() for c in ("conv", "part", "turns"))):
        key = f"{conv}:{part}"
        for style in (_style(key), (_style(key) + 3) % len(STYLES))[: 1 + twice]:
            lines, states = write_out([t["role"] for t in turns], [t["text"] for t in turns], style, _bare(key, len(turns)))
            yield conv, key, lines, states, turns


def train_roles(conversations: DataFrame) -> Model:
    """A model from the labelled turns of conversations whose crc32(id as text) mod 5 is not 0, each written out in two of the styles, by the hash of its id.

    Tasks count; only the sums (states by states and by feature values) reach the driver. Lines of unknown or null roles teach
    nothing. Without turns the smoothing leaves every probability equal.
    """
    n = len(STATES)
    cells = np.cumsum([0, n, n * n, *[n * s for s in SIZES]])

    def count(batches):
        total = np.zeros(cells[-1], np.int64)
        for rb in batches:
            for conv, _, lines, states, _ in _written(rb, True):
                s = np.array(states)
                if conv is None or zlib.crc32(str(conv).encode()) % 5 == 0 or not len(s):
                    continue
                x = line_features(lines)
                if s[0] >= 0:
                    total[s[0]] += 1
                both = (s[:-1] >= 0) & (s[1:] >= 0)
                np.add.at(total, cells[1] + s[:-1][both] * n + s[1:][both], 1)
                for j, size in enumerate(SIZES):
                    np.add.at(total, cells[2 + j] + s[s >= 0] * size + x[s >= 0, j], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    total = np.zeros(cells[-1])
    for cell, many in conversations.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        total[cell] = many
    part = [total[a:b] for a, b in zip(cells[:-1], cells[1:])]
    return Model(part[0], part[1].reshape(n, n), [p.reshape(n, -1) for p in part[2:]])


def parse_transcripts(transcripts: DataFrame, model: Model, text: str = "text", keep=None) -> DataFrame:
    """`transcripts` with n_turns long, roles (comma-joined) and rendered string, the canonical form of the turns found.

    Works row by row without a shuffle; columns state_before and state_last, as `part_edges` adds them, make a row a part of a
    longer transcript. Null is the empty transcript: one empty line, so one empty turn. Repeated rows get equal results; an empty
    table gives an empty result. Input columns named like the new ones are replaced.
    keep: input columns to return (default: all).
    """

    def make(rb: pa.RecordBatch) -> list:
        edges = [rb.column(rb.schema.get_field_index(c)).to_pylist() if c in rb.schema.names else [-1] * rb.num_rows for c in EDGES]
        found = [parse(t, model, *e) for t, *e in zip(common.strings(rb, text), *edges)]
        return [pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(r for r, _ in x) for x in found], pa.string()), pa.array([render(x) for x in found], pa.string())]

    return common.append_columns(transcripts, make, [common.field("n_turns", "long"), common.field("roles", "string"), common.field("rendered", "string")], keep)


EDGES = ("state_before", "state_last")


def part_edges(transcripts: DataFrame, model: Model, text: str = "text", conv: str = "conv", part: str = "part") -> DataFrame:
    """`transcripts` with state_before and state_last int: on the likeliest path through all parts of a conversation, the state of
    the line before a part (-1: none) and of its last line. `parse_transcripts` then reads each part as a piece of the whole.

    Every part gives the best scores from each state before it to each at its end, a few numbers; only these meet, part by part.
    Conversations of one part, and parts without conversation, are wholes of their own and take no part in that.
    """
    n = len(STATES)

    def make(rb: pa.RecordBatch) -> list:
        found = []
        for t in common.strings(rb, text):
            x = line_features(t.split("\n"))
            begun = model.start + model._seen(x[:1])[0]
            if len(x) > 1:
                begun = (begun[:, None] + model.transfer(x[1:])).max(0)
            found.append(np.concatenate([begun, model.transfer(x).ravel()]))
        return [pa.array(found, pa.list_(pa.float64()))]

    many = transcripts.filter(F.col(conv).isNotNull()).groupBy(conv).agg(F.count("*").alias("_n")).filter("_n > 1").select(conv)
    scored = common.append_columns(transcripts.join(many, conv, "left_semi"), make, [common.field("_scores", "array<double>")], [conv, part])

    def carry(t):
        t = t.sort_values(part)
        whole = np.stack(t["_scores"].to_list())
        best = [whole[0, :n]]
        for row in whole[1:]:
            best.append((best[-1][:, None] + row[n:].reshape(n, n)).max(0))
        last = [int(best[-1].argmax())]
        for k in range(len(whole) - 1, 0, -1):
            last.append(int((best[k - 1] + whole[k, n:].reshape(n, n)[:, last[-1]]).argmax()))
        last.reverse()
        return t[[conv, part]].assign(state_before=[-1, *last[:-1]], state_last=last)

    kinds = dict(transcripts.dtypes)
    edges = scored.groupBy(conv).applyInPandas(carry, f"`{conv}` {kinds[conv]}, `{part}` {kinds[part]}, state_before int, state_last int")
    joined = transcripts.join(edges, [conv, part], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(-1)) for c in EDGES})


def written_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv, part, text, true_roles, true_rendered, n_true): labelled conversations written out as raw transcripts, one style
    each, about one turn in eight without marker. Unknown and null roles are written without marker and count as given."""

    def run(batches):
        for rb in batches:
            rows = []
            for (_, _, lines, _, turns), conv, part in zip(_written(rb), rb.column(rb.schema.get_field_index("conv")), rb.column(rb.schema.get_field_index("part"))):
                truth = [(str(t["role"]), (t["text"] or "").strip("\n")) for t in turns]
                rows.append((conv.as_py(), part.as_py(), "\n".join(lines), ",".join(r for r, _ in truth), render(truth), len(turns)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    kind = dict(conversations.dtypes)["conv"]
    conv_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    schema = pa.schema([("conv", conv_type), ("part", pa.int64()), ("text", pa.string()), ("true_roles", pa.string()), ("true_rendered", pa.string()), ("n_true", pa.int64())])
    return conversations.mapInArrow(run, f"conv {kind}, part long, text string, true_roles string, true_rendered string, n_true long")
