"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries of one generation of a worker's memory of counted words; two generations are kept.
WORDS_REMEMBERED = 250_000
_counters: dict[str, "Counter"] = {}


def collapse_space(text: Column) -> Column:
    """Runs of blank, tab, CR and LF become one blank, none at the ends.

    Fit for tokenizers that drop white space and never join what it separates, such as word_bpe_49k.json: their counts don't
    change.
    """
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n]+", " "))


def as_is(text: Column) -> Column:
    """Null becomes the empty text; nothing else changes. Fit for every tokenizer."""
    return F.coalesce(text, F.lit(""))


def tokenizer_version(path: str, normalise) -> str:
    """A digest of all that a count depends on besides the text: the vocabulary file, the library and the normaliser."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {version(library)}|{normalise.__name__}".encode()).hexdigest()


class Counter:
    """Counts tokens as the library does.

    by_word: the texts are split at blanks and each part is counted once and remembered; right only where no token and no
    normalisation step crosses a blank (the caller says so).
    """

    def __init__(self, path: str, by_word: bool):
        self.by_word = by_word
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_padding()
            t.no_truncation()
            self.encode = lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.encode(texts)
        if len(self.young) > WORDS_REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        split = [t.split(" ") if t else [] for t in texts]
        new = []
        for w in set().union(*split):
            if w not in young:
                n = old.get(w)
                if n is None:
                    new.append(w)
                else:
                    young[w] = n
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            young.update(zip(part, self.encode(part)))
        get = young.__getitem__
        return [sum(map(get, words)) for words in split]


def _counter(path: str, by_word: bool) -> Counter:
    key = f"{path}|{by_word}"
    if key not in _counters:
        _counters[key] = Counter(path, by_word)
    return _counters[key]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    text: str = "text",
    normalise=as_is,
    by_word: bool = False,
) -> DataFrame:
    """`docs` with n_bytes long (UTF-8 bytes of the text) and n_tokens long.

    cache_path: a parquet folder of (version, digest, n_tokens) on storage that the cluster shares; made where absent. Texts
    are normalised and digested; only digests that the cache lacks for this tokenizer version are encoded, each once however
    often its text occurs, and appended to the cache. Then every row takes its count from the cache by its digest.
    Text moves once, reduced to one row per digest before the shuffle; with a cache that already holds rows, only texts whose
    digest is missing move at all.

    Nulls count as empty texts, and empty texts have 0 tokens. Repeated rows each get their count. An empty table gives an
    empty result. Input columns named n_bytes or n_tokens are replaced; other columns stay.
    """
    spark = docs.sparkSession
    common.tune(spark)
    stamp = tokenizer_version(tokenizer_path, normalise)
    docs = common.without(docs, ["n_bytes", "n_tokens"])
    digest = F.unhex(F.sha2(normalise(F.col(text)), 256))
    keyed = docs.select(digest.alias("digest"), normalise(F.col(text)).alias("content"))

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "version string, digest binary, n_tokens long"
    if not fs.exists(path):
        fs.mkdirs(path)

    def cache() -> DataFrame:
        return spark.read.schema(schema).parquet(cache_path).filter(F.col("version") == stamp).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))

    if cache().isEmpty():
        wanted = keyed
    else:
        missing = keyed.select("digest").distinct().join(cache().select("digest"), "digest", "left_anti")
        wanted = keyed.join(missing, "digest", "left_semi")
    misses = wanted.groupBy("digest").agg(F.first("content").alias("content"))

    def encode(batches):
        counter = _counter(tokenizer_path, by_word)
        for rb in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([stamp] * rb.num_rows, pa.string()), rb.column(0), pa.array(counter.count(common.strings(rb, "content")), pa.int64())],
                names=["version", "digest", "n_tokens"],
            )

    misses.mapInArrow(encode, schema).write.mode("append").parquet(cache_path)
    sized = docs.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "_digest": digest})
    counts = cache().withColumnRenamed("digest", "_digest")
    return sized.join(counts, "_digest", "left").drop("_digest")
