"""Token files, collocations and the manifest against brute force: nulls, empty and long texts, ties, repeats, hot groups, clashing names."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsengine.llm import collocations, common, manifest, queries, tokenfiles

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- token files -----------------------------------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40) | st.just(7), max_size=3000), st.data())
def test_coding_round_trip(ids, data):
    ids = np.array(ids, np.uint16)
    table = tokenfiles.Table.of_counts(collections.Counter(ids.tolist()), 41, bits=10)
    block = tokenfiles.encoded(ids, table)
    assert tokenfiles.decoded(block, table).tolist() == ids.tolist()
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
    assert tokenfiles.decoded(block, table, a, b).tolist() == ids[a:b].tolist()
    k = data.draw(st.integers(0, len(block) - 1))
    with pytest.raises(ValueError):
        tokenfiles.decoded(block[:k] + bytes([block[k] ^ 1]) + block[k + 1 :], table)


def test_coding_of_many_lanes_and_checkpoints():
    r = np.random.default_rng(1)
    ids = np.minimum(r.zipf(1.3, 700_000), 999).astype(np.uint16)
    table = tokenfiles.Table.of_counts({int(i): int(n) for i, n in zip(*np.unique(ids, return_counts=True))}, 1000)
    block = tokenfiles.encoded(ids, table)
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(block) * 8 / len(ids) < -(p * np.log2(p)).sum() * 1.1
    for a, b in ((0, 700_000), (699_990, 700_000), (350_001, 350_004), (5, 6)):
        assert (tokenfiles.decoded(block, table, a, b) == ids[a:b]).all()
    other = tokenfiles.Table.of_counts({0: 5}, 1000)
    with pytest.raises(ValueError):
        tokenfiles.decoded(block, other)
    with pytest.raises(ValueError):  # the frequencies must fit
        tokenfiles.Table.of_counts({}, 1000, bits=10)


def library_ids(rows, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [(k, [*t.encode(x or "", add_special_tokens=False).ids, end]) for k, x in rows]


HARD = ["<|endoftext|>", "a<|startoftext|>b.", "<|ENDOFTEXT|> A.", "ΑΣ ΑΣΑ.", "é. x", "'s don't 'LL a.'s b,'t", "a b c", "\r\n\t", "x\x00y", "12.5 A.B..c!?", "ﬁ ǅ İ.", "K. K.", "á.", "é.è"]


@pytest.mark.parametrize("by_word", [True, False])
def test_token_files(spark, by_word):
    r = random.Random(3)
    rows = [(i * 2, " ".join(r.choices(["Word.", "the", "café,", "x", "don't", "\n"], k=r.randint(0, 60)))) for i in range(60)]
    rows += [(1000 + i, x) for i, x in enumerate(HARD)]
    rows += [(7, None), (9, ""), (11, "long " * 30_000), (13, "same"), (13, "same"), (13, "other"), (None, "nobody"), (-5, "first")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(k, x, "own", 1) for k, x in rows], "doc_id long, text string, ids string, file int").repartition(3)
    folder = common.shared_dir(spark)
    tokenfiles.write_token_files(docs, folder, WORDS, by_word=by_word)
    got = sorted(tokenfiles.read_token_files(spark, folder).collect(), key=lambda x: x["start"])
    keys = [x["key"] for x in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    at = 0
    for x in got:
        assert (x["start"], x["n_tokens"] * 4) == (at, len(x["ids"]))
        at += x["n_tokens"]
    assert sorted((str(x["key"]), np.frombuffer(x["ids"], "<u4").tolist()) for x in got) == sorted((str(k), i) for k, i in library_ids(rows))


def test_token_files_of_nothing(spark):
    folder = common.shared_dir(spark)
    tokenfiles.write_token_files(spark.createDataFrame([], "doc_id string, text string"), folder, WORDS)
    assert tokenfiles.read_token_files(spark, folder).collect() == []


def test_damaged_file(spark):
    folder = common.shared_dir(spark)
    tokenfiles.write_token_files(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), folder, WORDS)
    blocks = spark.read.parquet(f"{folder}/blocks")
    bad = spark.createDataFrame([{**x.asDict(), "ids": bytes(x["ids"][:-5]) + bytes([x["ids"][-5] ^ 1]) + bytes(x["ids"][-4:])} for x in blocks.collect()], blocks.schema)
    bad.write.mode("append").parquet(f"{folder}/blocks")
    with pytest.raises(Exception, match="block is damaged"):
        tokenfiles.read_token_files(spark, folder).collect()


def test_op11_whole(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect())
    want, at = [], 0
    for k, ids in library_ids(rows):
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op11_range_coded(spark, sf).collect()) == want


# --- collocations ----------------------------------------------------------------------------------------------------------------


def brute_collocations(rows, least, most=2000):
    count, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most])]
    return sorted(out)


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.fixture(scope="module")
def phrases():
    r = random.Random(5)
    vocabulary = ["New", "york", "city", "the", "É", "密码", "a.b", "x y", "don't", "\x00", "new-york"]
    rows = []
    for i in range(300):
        lang = r.choice(["en", "fr", None, "und", ""])
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))
        rows.append((lang, text + " New York City" * r.choice([0, 0, 3])))
    return [*rows, *rows[:20], ("en", None), ("en", ""), ("xx", ""), ("en", "New York " * 5000), ("en", " .,; \n\t"), ("en", "w" * 100_000)]


@pytest.mark.parametrize("bytes_of_phrases", [1 << 24, 40])
def test_collocations(spark, phrases, monkeypatch, bytes_of_phrases):
    monkeypatch.setattr(collocations, "AUTOMATA_BYTES", bytes_of_phrases * (1 if bytes_of_phrases > 1000 else 20))
    df = spark.createDataFrame([(x, t, 5, "own") for x, t in phrases], "lang string, text string, n int, phrase string").repartition(4)
    for least, most in ((30, 2000), (8, 3)):
        if bytes_of_phrases < 1000 and least == 8:
            continue
        got = sorted(tuple(r[c] for c in NAMES) for r in collocations.collocations(df, least=least, most=most).collect())
        want = brute_collocations(phrases, least, most)
        assert got == want and len(want) > 5


def test_collocations_of_little(spark):
    for rows in ([], [("en", None)], [("en", "a b c")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []
    got = collocations.collocations(spark.createDataFrame([(None, "a b. " * 30)], "lang string, text string")).collect()
    assert [tuple(r[c] for c in NAMES) for r in got] == [("und", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_exact_scores(spark):
    big = 4_000_000_000_000_000_000  # products past 64 bits
    counted = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 2), ("en", None, 2 * big)], "lang string, phrase string, f long")
    r = collocations._ranked(spark, counted, 30, 80, 2000).collect()
    assert [(x["phrase"], x["score"]) for x in r] == [("a b", 2_000_000 * (big - 2) // (2 * big - 1))]


# --- manifest --------------------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for row in tree[:-1]:
        a = i // 3 * 3
        out.append(("".join(row[a:i]), "".join(row[i + 1 : a + 3])))
        i //= 3
    return out


def check_manifest(spark, rows, parts=5):
    df = spark.createDataFrame([(s, k, t, "own", "own2") for s, k, t in rows], "source string, doc_id long, text string, leaf string, g string").repartition(parts)
    got = manifest.dataset_manifest(df, manifest.record_digest("doc_id", "text"), keep=("source", "doc_id", "text", "leaf", "g"))
    got = got.withColumns({"folded": manifest.folded(F.col("leaf"), F.col("proof")), "digest": manifest.proof_digest(F.col("proof"))}).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = collections.defaultdict(list)
    for s, k, t in rows:
        groups[s].append((k is not None, k or 0, sha(field(k), field(t))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in names}
    over = levels([trees[s][-1][0] for s in names])
    want = []
    for n, s in enumerate(names):
        for i, leaf in enumerate(trees[s][0]):
            want.append((leaf, trees[s][-1][0], over[-1][0], path(trees[s], i) + path(over, n)))
    key = lambda x: (x[0], x[1], str(x[3]))
    assert sorted(((r["leaf"], r["subroot"], r["root"], [(p["left"], p["right"]) for p in r["proof"]]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r["folded"] == r["root"] and r["g"] == "own2"
        assert r["digest"] == sha(*[x for p in r["proof"] for x in (p["left"], p["right"])])


def test_manifest_of_hot_and_small_groups(spark):
    r = random.Random(2)
    rows = [("hot", r.randint(0, 300), f"t{i}") for i in range(400)] + [("hot", 5, "same")] * 150 + [(f"s{i:03d}", i, "x") for i in range(200)]
    rows += [(None, None, None), (None, 3, ""), (None, None, "b"), ("", 1, "é\n"), ("ÿ", 1, "a"), ("z", 1, "long " * 20_000)]
    check_manifest(spark, rows)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2], [3], [4], [9, 10, 1], [28, 27, 26], [82]])
def test_manifest_of_sizes(spark, sizes):
    check_manifest(spark, [(f"s{k}", i, str(i)) for k, n in enumerate(sizes) for i in range(n)], 2)


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "source string, doc_id long")
    assert manifest.dataset_manifest(df, manifest.record_digest("doc_id")).collect() == []


def test_nodes_of_stretches():
    # every way of cutting small trees: what ranges say of themselves is enough to build and prove all
    for n in range(1, 40):
        tree = levels([f"{i}" for i in range(n)])
        for cut in range(1, n):
            said = [list(manifest._stretch(tree[0][a:b], a, n)) for a, b in ((0, cut), (cut, n))]
            for rows in said:
                for kind, level, i, digest in rows:
                    assert kind != "root" and (kind != "node" or tree[level][i] == digest)
            for (a, b), rows in zip(((0, cut), (cut, n)), said):
                outside = {(level, i): tree[level][i] for kind, level, i, _ in rows if kind == "want"}
                paths, root = manifest._stretch_proofs(tree[0][a:b], a, n, outside)
                assert root == tree[-1][0] and list(paths) == [path(tree, i) for i in range(a, b)]
