"""Phrase collocations: candidates from a sketch of counts, counted exactly by automata, scored and pruned as tables."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .kernels import LOWER, U, mix, prefix_hashes, range_hashes, word_spans

#: Longest phrase, in words.
LONGEST = 4
#: Width of the sketch: 2^40 cells, held sparsely.
WIDTH_BITS = 40
#: Phrases that a task adds up before it sends their cells, and bytes of text for one range of cells.
FLUSH, RANGE_BYTES = 4 << 20, 16 << 20
#: Bytes of phrases that one job's automata hold together.
AUTOMATA_BYTES = 16 << 20
#: Phrases whose counts travel as one array, and tasks whose arrays are added up first.
SHARD, GROUP = 8192, 256
#: Bits of the filter of frequent cells at most; beyond 2^27 such cells it lets more candidates through, which the exact counts drop.
MOST_BITS = 1 << 31
NO_LANG = "und"

#: Characters that end a piece, and blanks.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END = np.isin(np.arange(256), list(ENDS))
_SEPARATOR = _END | np.isin(np.arange(256), list(BLANKS))
#: Texts as the automata read them: lower case, blanks as one character, ends of pieces as another.
_READ = bytes(10 if _END[c] else 32 if c in BLANKS else int(LOWER[c]) for c in range(256))
_STEP = U(0x9FB21C651E98DF25)


# --- hashes of phrases ------------------------------------------------------------------------------------------------------------


def _chunks(rb: pa.RecordBatch):
    """(data, word starts, word ends, row of each word, digest of its text, hash of the word with its language, whether the next word is in
    the same piece) of runs of texts."""
    langs = rb.column(rb.schema.get_field_index("lang")).to_pylist()
    of = {x: mix(np.array([zlib.crc32(x.encode()) + 1], U))[0] for x in set(langs)}
    for a, b, data, at in common.text_chunks(rb, "text"):
        low = LOWER[data]
        start, end, rows = word_spans(low, at, _SEPARATOR)
        if not len(start):
            continue
        row = np.repeat(np.arange(b - a), np.diff(rows))
        piece = np.cumsum(_END[low])[start]
        salt = np.array([of[x] for x in langs[a:b]], U)[row]
        h = mix(range_hashes(prefix_hashes(low), start, end) + salt)
        follows = np.zeros(len(start), bool)
        follows[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        whole = data.tobytes()
        digest = np.array([zlib.crc32(whole[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())], np.uint32)[row]
        yield low, start, end, row + a, digest, h, follows


def _longer(h: np.ndarray, ok: np.ndarray, k: int, words: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases of k words from those of k - 1, and where there is one (by first word)."""
    out, good = np.zeros(len(h), U), np.zeros(len(h), bool)
    if len(h) >= k:
        n = len(h) - k + 1
        good[:n] = ok[:n] & follows[k - 2 : k - 2 + n]
        out[:n] = mix(h[:n] * _STEP + words[k - 1 :] + U(k))
    return out, good


def _value(h: np.ndarray) -> np.ndarray:
    """What stands for a phrase's cell of the sketch: its number, mixed again."""
    return mix(h >> U(64 - WIDTH_BITS))


def _at(h: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """What stands for a phrase in texts of that digest."""
    return mix(h + mix(digest.astype(U) + U(1)))


def _wanted(h: np.ndarray, follows: np.ndarray, lengths: tuple[int, ...], filters: dict[int, np.ndarray], itself: bool = False):
    """(length, hashes, where) of the phrases of these lengths all of whose shorter parts pass their lengths' filters, and with
    `itself` the phrase too."""
    passes: dict[int, np.ndarray] = {}
    hk, ok = h, np.ones(len(h), bool)
    for k in range(1, max(lengths) + 1):
        if k > 1:
            hk, ok = _longer(hk, ok, k, h, follows)
            if k - 1 in passes:  # both parts that are one word shorter
                shorter = passes[k - 1]
                ok = ok & shorter & np.append(shorter[1:], False)
        if k in filters and (k < max(lengths) or itself):
            passes[k] = ok.copy()
            passes[k][ok] = common.in_bloom(filters[k], _value(hk[ok]))
        if k in lengths:
            yield k, hk, passes[k] if itself else ok


# --- the sketch -------------------------------------------------------------------------------------------------------------------


def _sketch(docs: DataFrame, lengths: tuple[int, ...], filters: dict, least: int, ranges: int) -> DataFrame:
    """(value long, place long) of the phrases of these lengths whose cells are filled `least` times or more: the cell, and the
    phrase with the digest of one of the texts that have it.

    Tasks add up equal phrases of FLUSH, clip at `least` (which keeps every sum an upper bound of the clipped count) and send
    each range of cells as one row; a range's cells are added up in one task, and there are as many ranges as the text needs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = np.uint8 if least < 256 else np.uint32

    def send(batches):
        held, digests, size = [], [], 0

        def rows():
            h, digest = np.concatenate(held), np.concatenate(digests)
            order = np.argsort(h)
            h = h[order]
            edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.minimum(np.diff(np.append(edge, len(h))), least).astype(kind)
            h, digest = h[edge], digest[order[edge]]
            part = (h >> U(40)) * U(ranges) >> U(24)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            stop = np.append(cut[1:], len(h))
            sent = [pa.array([x[a:b].tobytes() for a, b in zip(cut, stop)], pa.binary()) for x in (h, n, digest)]
            return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), *sent], names=["range", "hashes", "counts", "digests"])

        for rb in batches:
            for *_, digest, h, follows in _chunks(rb):
                for _, hk, ok in _wanted(h, follows, lengths, shared.value):
                    held.append(hk[ok])
                    digests.append(digest[ok])
                    size += len(held[-1])
                if size > FLUSH:
                    yield rows()
                    held, digests, size = [], [], 0
        if size:
            yield rows()
        common.release()

    def add(table: pa.Table) -> pa.Table:
        h, counts, digest = (np.concatenate([np.frombuffer(x.as_buffer(), k) for x in table.column(c)]) for c, k in (("hashes", U), ("counts", kind), ("digests", np.uint32)))
        order = np.argsort(h, kind="stable")
        h, counts, digest = h[order], counts[order].astype(np.int64), digest[order]
        cell = h >> U(64 - WIDTH_BITS)
        edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        full = np.repeat(np.add.reduceat(counts, edge) >= least, np.diff(np.append(edge, len(cell))))
        one = np.append(True, h[1:] != h[:-1]) & full  # each phrase once, with the first of its texts
        return pa.table({"value": _value(h[one]).view(np.int64), "place": _at(h[one], digest[one]).view(np.int64)})

    sent = docs.mapInArrow(send, "range int, hashes binary, counts binary, digests binary")
    return sent.repartition(ranges, "range").groupBy("range").applyInArrow(add, "value long, place long")


def _filter(values: DataFrame, column: str, each: int) -> np.ndarray:
    """A Bloom filter of a column's values, `each` bits for one, at most MOST_BITS."""
    bits, many = 1 << 16, values.count()
    while bits < min(each * many, MOST_BITS):
        bits *= 2
    return common.bloom(values, column, bits)


def _candidates(docs: DataFrame, filters: dict, places: np.ndarray) -> DataFrame:
    """(lang, phrase, k) of the phrases of one to LONGEST words that may be frequent, each once: a phrase is told by the texts whose
    digest stands for it in `places`, so that not every task tells it."""
    shared = docs.sparkSession.sparkContext.broadcast((filters, places))

    def find(batches):
        known, where = shared.value
        for rb in batches:
            langs = rb.column(rb.schema.get_field_index("lang")).to_pylist()
            found: list[tuple] = []
            for data, start, end, row, digest, h, follows in _chunks(rb):
                raw = data.tobytes()
                for k, hk, ok in _wanted(h, follows, tuple(range(1, LONGEST + 1)), known, itself=True):
                    at = np.flatnonzero(ok)
                    at = at[common.in_bloom(where, _at(hk[at], digest[at]))]
                    for i in at[np.unique(hk[at], return_index=True)[1]].tolist():
                        phrase = b" ".join(raw[start[j] : end[j]] for j in range(i, i + k))
                        found.append((langs[row[i]], phrase.decode(), k))
            if found:
                lang, phrase, k = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(k, pa.int32())], names=["lang", "phrase", "k"])
        common.release()

    return docs.mapInArrow(find, "lang string, phrase string, k int").distinct()


# --- exact counts -----------------------------------------------------------------------------------------------------------------

_automata: dict = {}


def readable(text: str) -> str:
    """A text as the automata read it: every word between two blanks, a line end between pieces."""
    t = " " + text.encode().translate(_READ).decode().replace("\n", " \n ") + " "
    while "  " in t:
        t = t.replace("  ", " ")
    return t


def _automaton(number: str, lang: str, phrases: list[str]):
    """The automaton of a language's phrases, each with its blanks at both ends; kept for the tasks of the same job."""
    import ahocorasick

    if next(iter(_automata), (number,))[0] != number:
        _automata.clear()
    if (number, lang) not in _automata:
        a = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            a.add_word(f" {p} ", i)
        a.make_automaton()
        _automata[number, lang] = a
    return _automata[number, lang]


def _counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(lang, phrase, f long): exact counts of all candidates, and rows without phrase with each language's words.

    A language's phrases are dealt by hash into groups of AUTOMATA_BYTES at most on average; a job holds groups of that size
    together, reads the texts of their languages once and adds up. So texts are read once for each AUTOMATA_BYTES of phrases.
    """
    spark = docs.sparkSession
    sizes = candidates.groupBy("lang").agg(F.sum(F.octet_length("phrase") + 2).alias("size")).collect()  # a row a language
    groups = [(r["lang"], g, -(-r["size"] // AUTOMATA_BYTES)) for r in sorted(sizes, key=lambda r: r["lang"]) for g in range(-(-r["size"] // AUTOMATA_BYTES))]
    size = {r["lang"]: r["size"] for r in sizes}
    jobs: list[list] = []
    room = 0
    for lang, g, of in groups:
        need = size[lang] / of
        if need > room:
            jobs.append([])
            room = AUTOMATA_BYTES
        jobs[-1].append((lang, g, of))
        room -= need
    found = []
    for job in jobs:
        wanted = spark.createDataFrame(job, "lang string, g long, of long")
        mine = candidates.join(F.broadcast(wanted), "lang").filter(F.pmod(F.xxhash64("phrase"), F.col("of")) == F.col("g"))
        phrases: dict[str, list[str]] = {}
        for lang, phrase in zip(*(c.to_pylist() for c in mine.select("lang", "phrase").toArrow().columns)):  # AUTOMATA_BYTES
            phrases.setdefault(lang, []).append(phrase)
        found.append(common.saved(_scan(docs, phrases, {lang for lang, g, _ in job if g == 0}), common.shared_dir(spark)))
    out = found[0] if found else spark.createDataFrame([], "lang string, phrase string, f long")
    for f in found[1:]:
        out = out.union(f)
    return out


def _scan(docs: DataFrame, phrases: dict[str, list[str]], count_words: set[str]) -> DataFrame:
    """(lang, phrase, f) of the phrases given; without phrase the number of words, for the languages in `count_words`.

    A task sends its counts as arrays, one row for SHARD phrases of a language; arrays are added up for GROUP tasks, then for all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    number = common.shared_dir(docs.sparkSession)
    langs = sorted(phrases)
    schema = "lang string, shard int, part int, counts binary"

    def scan(batches):
        total: dict[str, np.ndarray] = {}
        words: dict[str, int] = {}
        matches: dict[str, list] = {}

        def add(lang):
            known = shared.value[lang]
            total[lang] = total.get(lang, 0) + np.bincount(np.array(matches.pop(lang), np.int64), minlength=len(known))

        for rb in batches:
            for lang, text in zip(rb.column(rb.schema.get_field_index("lang")).to_pylist(), common.strings(rb, "text")):
                a = _automaton(number, lang, shared.value[lang])
                t = readable(text)
                words[lang] = words.get(lang, 0) + t.count(" ") - 1 - t.count("\n")
                m = matches.setdefault(lang, [])
                m += [i for _, i in a.iter(t)]
                if len(m) > 1 << 20:
                    add(lang)
        for lang in list(matches):
            add(lang)
        part = TaskContext.get().partitionId() // GROUP
        rows = [(x, -1, np.array([n])) for x, n in words.items()]
        rows += [(x, a // SHARD, n[a : a + SHARD]) for x, n in total.items() for a in range(0, len(n), SHARD) if n[a : a + SHARD].any()]
        if rows:
            lang, shard, counts = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(shard, pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([n.astype(np.int64).tobytes() for n in counts], pa.binary())],
                names=["lang", "shard", "part", "counts"],
            )
        common.release()

    def add_up(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"lang": table.column("lang")[:1], "shard": table.column("shard")[:1], "part": pa.array([0], pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})

    def told(batches):
        for rb in batches:
            for lang, shard, _, counts in zip(*(c.to_pylist() for c in rb.columns)):
                n = np.frombuffer(counts, np.int64)
                if shard < 0:
                    names, n = [None], n if lang in count_words else n[:0]
                    names = names[: len(n)]
                else:
                    names = shared.value[lang][shard * SHARD : shard * SHARD + len(n)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(names, pa.string()), pa.array(n)], names=["lang", "phrase", "f"])

    sent = docs.filter(F.col("lang").isin(langs)).mapInArrow(scan, schema)
    added = sent.groupBy("lang", "shard", "part").applyInArrow(add_up, schema).groupBy("lang", "shard").applyInArrow(add_up, schema)
    return added.mapInArrow(told, "lang string, phrase string, f long").filter("f > 0")


# --- scores -----------------------------------------------------------------------------------------------------------------------


def _exact(c: str):
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, covered: int = 80, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` collocations of two to four words.

    Texts are lower-cased (A-Z), split at `.,;:!?` and line ends into pieces and these at blanks into words. a is how often a phrase
    stands inside pieces, `least` times or more; it is cut in two where 2,000,000 a / (l + r), rounded down, is least (l and r: how
    often its parts stand; ties: the earliest cut), and that is its score. Phrases inside a longer frequent one that has
    `covered` per cent of their occurrences or more are dropped. n: all words of the language. Ranked by score and a, falling, then by
    the phrase's bytes.

    Candidates come from a sketch whose cells bound counts from above, length by length: only phrases all of whose parts may be
    frequent are counted in it, so it fills with few more cells than there are frequent phrases of one word less. Automata count the
    candidates exactly, blanks at both ends of a phrase keeping it to whole words; overlapping matches all count. `most` is a
    report's length, not a bound of the work.

    Null texts are empty, a null language is `und`; an empty table gives an empty result; repeated rows count as often as they
    stand. A word may have any length that a row may have. Other columns aren't read.
    """
    spark = docs.sparkSession
    common.tune(spark)
    docs = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text"))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(common.partitions(spark), -(-size // RANGE_BYTES))
    filters: dict[int, np.ndarray] = {}
    found: DataFrame | None = None
    for lengths in ((1,), (2,), (3, 4)):
        full = common.saved(_sketch(docs, lengths, filters, least, ranges), common.shared_dir(spark))
        filters |= dict.fromkeys(lengths, _filter(full, "value", 16))
        found = full if found is None else found.union(full)
    candidates = common.saved(_candidates(docs, filters, _filter(found, "place", 64)), common.shared_dir(spark))
    counted = common.saved(_counts(docs, candidates), common.shared_dir(spark))
    return _ranked(spark, counted, least, covered, most)


def _ranked(spark: SparkSession, counted: DataFrame, least: int, covered: int, most: int) -> DataFrame:
    words = counted.filter("phrase is null").select("lang", F.col("f").alias("n"))
    f = counted.filter(F.col("phrase").isNotNull() & (F.col("f") >= least)).select("lang", "phrase", "f")
    phrases = f.withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " ")).filter("size(w) > 1")
    cut = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("first"), F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("rest"))
    cut = cut.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    inner = phrases.filter("size(w) > 2").select("lang", "a", "w", F.explode(F.expr("sequence(2, size(w) - 1)")).alias("len"))
    inner = inner.select("lang", "a", "w", "len", F.explode(F.expr("sequence(1, size(w) - len + 1)")).alias("at"))
    inner = inner.select("lang", "a", F.expr("array_join(slice(w, at, len), ' ')").alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(19,0)") * _exact("longer") < F.lit(covered).cast("decimal(19,0)") * _exact("a")))
    left = left.select("lang", "phrase", "a", "least.l", "least.r", "least.score").withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(common.partitions(spark))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of every share, then the first of these: no task ranks a language's phrases alone
    some = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= most)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
