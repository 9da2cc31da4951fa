"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tsengine.llm import backoff, chat, common, decontaminate, fingerprints, jaccard, pieces, quality, secrets, suffixes, tokencount
from tsengine.llm.components import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def texts(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(80)] + ["É", "ñandú", "密码", "😀", "Don't"]
    base = [" ".join(r.choices(words, k=r.choice([3, 20, 60, 200]))) for _ in range(n // 3)]
    out = list(base)
    for _ in range(n - len(base) - 6):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(r.choice([" ", "\n", "\t "]).join(w))
    out += [None, "", " \n ", "a", base[0], "\u00a0x\u2028y " + "long " * 4000]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "own") for i, t in enumerate(texts())]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def by_id(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def words_of(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if w]


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    cache = common.shared_dir(spark)
    for _ in range(2):  # the second run takes all from the cache
        got = tokencount.token_counts(docs, path, cache, normalise=tokencount.collapse_space, by_word=True)
        assert by_id(got, "doc_id", "n_bytes", "n_tokens") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert by_id(tokencount.token_counts(docs, path, common.shared_dir(spark)), "doc_id", "n_bytes", "n_tokens") == want


def test_token_counts_of_hard_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    hard = ["<|endoftext|>", "a<|startoftext|>b", "a <|endoftext|> b", "ΑΣ ΑΣΑ", "e\u0301 x", " \u0301a", "'s don't 'LL", "a\u00a0b\u2003c", "\r\n\t", "x\x00y", "1234 5", "ﬁ ǅ İ", "<|endoftext|><|endoftext|> !"]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    got = tokencount.token_counts(df, path, common.shared_dir(spark), normalise=tokencount.collapse_space, by_word=True)
    assert by_id(got, "doc_id", "n_tokens") == [(i, len(t.encode(x, add_special_tokens=False).ids)) for i, x in enumerate(hard)]


def test_pieces(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, x in rows:
        ids = sp.encode(x or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), True))
    got = pieces.encode_pieces(docs, path, digests=True)
    assert by_id(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_tile") == sorted(want)
    spans = pieces.encode_pieces(docs, path).filter("text is not null").collect()
    for r in spans:
        data = r["text"].encode()
        assert b"".join(data[a:b] for a, b in zip(r["piece_begin"], r["piece_end"])) == data


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_quality(d, labels)
    got = quality.score_quality(d, model, keep=["doc_id"]).filter("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95
    other = quality.train_quality(d, labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(model.weights, other.weights)  # held-out labels aren't read


def test_quality_of_odd_texts(docs):
    empty = quality.train_quality(docs.limit(0), docs.select("doc_id", F.lit(1).alias("quality")))
    got = quality.score_quality(docs, empty)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0


def test_factorisation_identity():
    r = np.random.default_rng(0)
    m = quality.Model(0.3, r.normal(size=(quality.SIZE, 1 + quality.RANK)))
    f, x = np.array([3, 9, 40, 70]), r.normal(size=4)
    w, v = m.weights[:, 0], m.weights[:, 1:]
    want = 0.3 + w[f] @ x + sum(v[f[i]] @ v[f[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.raw(f, x, np.array([0, 4]))[0][0] == pytest.approx(want)


def py_tree(t):
    """(leaves by section and paragraph, all nodes, root) of a text."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tree = [[[sha(c) for c in re.split(r"(?<=[.,;:!?]) ", p)] for p in s.split("\n")] for s in t.split("\n\n")]
    paragraphs = [[sha("p" + "".join(p)) for p in s] for s in tree]
    sections = [sha("s" + "".join(s)) for s in paragraphs]
    root = sha("r" + "".join(sections))
    return tree, {c for s in tree for p in s for c in p} | {p for s in paragraphs for p in s} | {*sections, root}, root


def test_fingerprints(spark):
    long = "A one. B two,\nC three! d\n\nE four. " * 30
    rows = [(5, "x. y\nz"), (1, None), (9, long), (7, ""), (5, "x. y\nz"), (12, "ñ😀. é\nz"), (2, long + "q"), (20, "One a. two"), (21, "One a.\x01two"), (22, "a\nb"), (23, "b\na")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r for r in fingerprints.merkle_fingerprints(df).collect()}
    order = sorted((i, t or "") for i, t in rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        if i == 5:
            continue
        h = len(t) // 2
        ed = t[: len(t) - h] + nxt[:h]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(ed.encode()).hexdigest()
        (_, a, root), (_, b, _), (_, c, _) = (py_tree(x) for x in (t, ed, nxt))
        assert got[i]["near_edited"] == pytest.approx(2 * len(a & b) / (len(a) + len(b)))
        assert got[i]["near_next"] == pytest.approx(2 * len(a & c) / (len(a) + len(c)))
        assert got[i]["fingerprint"].split(":")[0] == root
        assert (got[i]["edited_branches"] == "") == (ed == t)
    roots = [got[i]["fingerprint"].split(":")[0] for i in (20, 21, 22, 23)]
    assert len(set(roots)) == 4 and got[22]["near_next"] < 1  # different texts, also of the same paragraphs in another order
    a, b = "p one\np two\n\np three", "p one\np 2\n\np three"
    two = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.merkle_fingerprints(two).collect()}
    d = spark.createDataFrame([(prints[1], prints[2])], "a string, b string")
    assert d.select(fingerprints.differing_branches(F.col("a"), F.col("b"))).first()[0] == ["0.1"]
    assert fingerprints.merkle_fingerprints(df.limit(0)).count() == 0


def test_next_of_text_ids(spark):
    ids = [f"key{i:05d}" for i in random.Random(5).sample(range(90000), 1400)] + ["", "é"]
    df = spark.createDataFrame([(i, i) for i in ids], "_id string, _text string")
    got = {x["_id"]: x["_next"] for x in fingerprints.with_next(df).collect()}
    order = sorted(ids, key=lambda x: x.encode())
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_next_over_many_ranges(spark):
    r = random.Random(4)
    ids = r.sample(range(10**6), 1500) + [10**12]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "_id long, _text string")
    got = {x["_id"]: x["_next"] for x in fingerprints.with_next(df).collect()}
    order = sorted(ids)
    assert got == {a: str(b) for a, b in zip(order, order[1:] + order[:1])}


def brute_repeats(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        covered = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                covered[j] += 1
                covered[j + length] -= 1
        c = np.cumsum(covered)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out.append((i, len(b), int(c.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot, block, starts", [(2000, 1 << 20, 400_000), (1, 2000, 300)])
def test_suffix_dedup(docs, rows, monkeypatch, hot, block, starts):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HOT_SHARE", 1 << 40)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "STARTS", starts)
    got = suffixes.remove_repeats(docs, length=100)
    assert by_id(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 100)


def test_repeated_starts_with_zero_bytes():
    r = np.random.default_rng(7)
    text = r.integers(0, 2, 900).astype(np.uint8)
    text[500:700] = text[100:300]
    starts = np.arange(len(text) - 80 + 1)
    raw = text.tobytes()
    seen = collections.Counter(raw[i : i + 80] for i in starts)
    assert suffixes.repeated_starts(text, starts, np.zeros(len(starts), np.uint64), 80).tolist() == [seen[raw[i : i + 80]] > 1 for i in starts]


def test_secrets(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    rows = [(1, f'Password: "abc123XYZ" and {key} end'), (2, None), (3, "nothing at all here"), (4, "0123456789abcdef0123456789abcdef"), (5, 'api_key="xY9kQ2mZ7pR4tW8vB3nL6sD1"'), (6, "password: short"), (6, "password: short")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df, secrets.train_secret_models(df), redact="#").collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[4]["n_hex"], got[5]["n_assign"]) == (1, 1, 1, 1)
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[6]["n_assign"] == 0 and got[3]["redacted"] == "nothing at all here"
    assert "abc123XYZ" not in got[1]["redacted"] and key not in got[1]["redacted"]
    spans = got[1]["spans"].split(",")
    assert spans[0].startswith("assign:0:") and any(s.startswith("access:") for s in spans)


def brute_base(t):
    """The fixed patterns of the contract, written out again."""
    t = t or ""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(2)) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_of_a_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(d, secrets.train_secret_models(d)).collect()}
    for r in d.collect():
        want = brute_base(r["text"])
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in want)
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert set(shown.split(",")) - {""} <= set(got[r["doc_id"]]["spans"].split(","))


def test_planted_secrets_without_keyword(spark):
    """Random strings that no pattern names, planted in documents: recall, and what else is found there."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    models = secrets.train_secret_models(d)
    assert models.recall >= 0.9 and models.false_share <= 2e-3
    r, planted = random.Random(99), {}
    rows = []
    for i, row in enumerate(d.orderBy("doc_id").limit(400).collect()):
        words = (row["text"] or "").split(" ")
        if i % 2:
            key = "".join(r.choices(string.ascii_letters + string.digits + "+/", k=r.randint(20, 44)))
            words.insert(r.randrange(len(words) + 1), key)
            planted[i] = key
        rows.append((i, " ".join(words)))
    got = {x["doc_id"]: x for x in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    found = right = 0
    for i, t in rows:
        spans = [s.split(":") for s in got[i]["spans"].split(",") if s.startswith("markov")]
        values = [t[int(a) : int(b)] for _, a, b in spans]
        found += len(values)
        right += sum(v == planted.get(i) for v in values)
    assert right >= 0.9 * len(planted) and right >= 0.9 * found


def test_redaction_of_overlaps_and_nulls(spark):
    key = "AKIA" + "Z" * 20
    rows = [(1, f"secret={key} x"), (2, None), (3, ""), (4, "a" * 30 + " end")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["redacted"] for r in secrets.scan_secrets(d, secrets.train_secret_models(d), redact="#").collect()}
    assert got == {1: "# x", 2: "", 3: "", 4: "# end"}
    assert secrets.scan_secrets(d.limit(0), secrets.train_secret_models(d.limit(0))).count() == 0


def test_mapped_model(spark, tmp_path):
    """The public model with the library's NFKC map: ids, decoding and byte spans as the library gives them."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    mapped, model = pb.ModelProto(), pb.ModelProto()
    mapped.ParseFromString(spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.precompiled_charsmap = mapped.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    r = random.Random(3)
    bits = ["ﬁ", "①", "Ａ", "e\u0301", "ｶﾞ", "\u3000", "  ", " ", "\t", "\n", "word", "Ⅷ", "\u200b", "½", "😀", "密", "\x00", "x.y"]
    rows = [(0, None), (1, ""), (2, " \t "), *[(k, "".join(r.choices(bits, k=r.randint(1, 60)))) for k in range(3, 400)]]
    lib = spm.SentencePieceProcessor(model_file=path)
    got = {x["doc_id"]: x for x in pieces.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for k, t in rows:
        want = lib.encode(t or "", return_type="proto").pieces
        assert got[k]["piece_ids"] == [p.id for p in want] + [lib.eos_id()]
        assert got[k]["decoded"] == lib.decode(got[k]["piece_ids"])
        for p, a, b in zip(want, got[k]["piece_begin"], got[k]["piece_end"]):
            assert p.piece.startswith("<0x") or (p.begin, p.end) == (a, b)


def test_repeated_passages(docs, rows):
    words = 15
    got = {r["digest"]: r["n_windows"] for r in suffixes.repeated_passages(docs, words=words).collect()}
    key = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    seen = collections.defaultdict(set)
    for n, w in enumerate(split):
        for j in range(len(w) - words + 1):
            seen[tuple(w[j : j + words])].add(n)
    for (i, _), w in zip(rows, split):
        assert got.get(key[i], 0) == sum(len(seen[tuple(w[j : j + words])]) > 1 for j in range(len(w) - words + 1))
    assert suffixes.repeated_passages(docs.limit(0)).count() == 0


def test_large_benchmark_is_joined(docs, spark, monkeypatch):
    items = [(k, t) for k, t in enumerate([r["text"] for r in docs.limit(12).collect()])] + [(90, "a"), (91, None), (None, "b c")]
    b = spark.createDataFrame(items, "item_id long, text string")
    small = by_id(decontaminate.mark_contamination(docs, b, spans=True), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")
    monkeypatch.setattr(decontaminate, "CHARS_FOR_AUTOMATON", 10)
    assert by_id(decontaminate.mark_contamination(docs, b, spans=True), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans") == small


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(15))
    rows = [(1, "start W3 w4, w5 w6 w7 w8 w9 w10 w11 w12 end"), (2, None), (3, "w3 w4 w5 w6"), (4, "short ITEM here"), (5, "shortitem here"), (6, item + " x " + item)]
    items = [(10, item), (9, "Short item"), (8, ""), (7, None), (9, "Short item")]
    d = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, n_hit double")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.mark_contamination(d, b, spans=True).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) for i in range(1, 7)] == [(12, 10, 1), (0, 0, 0), (4, 0, 0), (3, 2, 1), (2, 0, 0), (31, 30, 1)]
    assert got[1]["items_sha256"] == hashlib.sha256(b"10").hexdigest() and not got[5]["contaminated"]
    (span,) = got[1]["hit_spans"]
    assert rows[0][1][span["begin"] : span["end"]] == "W3 w4, w5 w6 w7 w8 w9 w10 w11 w12"
    assert decontaminate.mark_contamination(d, b.limit(0)).filter("contaminated").count() == 0


def brute_components(rows, k, percent):
    sets = [frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if (w := words_of(t)) else frozenset() for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(lambda: math.inf)
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least[find(a)], i)
    return sorted((i, len(sets[a]), least[find(a)] if sets[a] else i) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("k, percent, tile", [(4, 85, 1024), (2, 50, 3)])
def test_jaccard_components(docs, rows, monkeypatch, k, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    got = jaccard.jaccard_components(docs, k=k, percent=percent)
    assert by_id(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, k, percent)


def test_jaccard_of_nothing(docs):
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(None, 4)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), common.shared_dir(spark)).collect())
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        todo, seen = [start], {start}
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)
    assert set(got) == set(near)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff(docs, rows, order, monkeypatch):
    monkeypatch.setattr(backoff, "TEXT_BYTES", 1500)
    monkeypatch.setattr(backoff, "COMMON_SHARE", 50)
    monkeypatch.setattr(backoff, "SLOTS", 64)
    count = collections.Counter()
    for _, t in rows:
        w = words_of(t)
        for k in range(1, order + 1):
            count.update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    total = sum(n for g, n in count.items() if len(g) == 1)
    want = []
    for i, t in rows:
        w, s = words_of(t), 0.0
        for j in range(len(w)):
            longest = min(j + 1, order)
            for k in range(longest, 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if k == 1 or count[g] >= 2:
                    s += math.log10(count[g] / (count[g[:-1]] if k > 1 else total)) + (longest - k) * math.log10(0.4)
                    break
        want.append((i, len(w), s))
    got = by_id(backoff.backoff_scores(docs, order=order), "doc_id", "n_words", "log10_score")
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])


def test_chat(spark):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    conv = chat.conversations_of(turns)
    model = chat.train_roles(conv)
    held = [r for r in conv.collect() if zlib.crc32(str(r["conv"]).encode()) % 5 == 0]
    unseen = ({"system": "World: ", "user": "Bob: ", "assistant": "Guide: "}, {"system": "## Setting\n", "user": "## Player\n", "assistant": "## Narrator\n"})
    styles, chat.STYLES = chat.STYLES, chat.STYLES + unseen
    try:
        for style in range(len(chat.STYLES)):
            for some in (False, True):  # with all markers, and with about one in eight missing
                right = lines_seen = 0
                for r in held:
                    bare = chat._bare(f"{r['conv']}:{r['part']}", len(r["turns"])) if some else [False] * len(r["turns"])
                    lines, states = chat.write_out([t["role"] for t in r["turns"]], [t["text"] for t in r["turns"]], style, bare)
                    found = model.viterbi(chat.line_features(lines))
                    right += sum(a // 2 == b // 2 for a, b in zip(found, states))
                    lines_seen += len(states)
                assert right >= (0.9 if some else 0.97) * lines_seen
    finally:
        chat.STYLES = styles
    plain = "User: Hello there, old friend.\nMore of it follows here.\nAssistant: Hi. What is it that you want?\n\nHuman: Nothing at all, good bye."
    assert [r for r, _ in chat.parse(plain, model)] == ["user", "assistant", "user"]
    assert chat.render([("user", "a <|x|>")]) == "<|user|>\na < |x|><|end|>\n"
    odd = spark.createDataFrame([(None, 0, "user", "x"), (None, 0, "user", "y"), (1, None, None, None), (1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    parsed = chat.parse_transcripts(chat.part_edges(chat.written_transcripts(chat.conversations_of(odd)), model), model)
    assert parsed.count() == 4
    assert chat.parse_transcripts(chat.written_transcripts(chat.conversations_of(odd.limit(0))), model).count() == 0


def test_parts_of_a_conversation_are_parsed_as_a_whole(spark):
    r = np.random.default_rng(2)
    n = len(chat.STATES)
    model = chat.Model(r.random(n), r.random((n, n)), [r.random((n, s)) for s in chat.SIZES])
    lines = [r.choice(["User: a?", "more", "", "Assistant: b.", "Zed: c", "x!"]) for _ in range(40)]
    cut = [0, 1, 7, 20, 40]
    # without names beyond the known ones, whose order a part doesn't share with the others
    lines = [x.replace("Zed: ", "") for x in lines]
    features = chat.line_features(lines)
    for a in cut[1:-1]:  # a part sees no line before it
        features[a] = chat.line_features(lines[a : a + 1])[0]
        for k in range(a + 1, 40):
            features[k] = chat.line_features(lines[a : k + 1])[-1]
    whole = model.viterbi(features)
    df = spark.createDataFrame([(1, k, "\n".join(lines[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:]))], "conv long, part long, text string")
    for e in chat.part_edges(df, model).collect():
        a, b = cut[e["part"]], cut[e["part"] + 1]
        assert e["state_last"] == whole[b - 1] and e["state_before"] == (whole[a - 1] if a else -1)
        assert model.viterbi(features[a:b], e["state_before"], e["state_last"]) == whole[a:b]


def test_viterbi_is_best():
    r = np.random.default_rng(1)
    n = len(chat.STATES)
    model = chat.Model(r.random(n), r.random((n, n)), [r.random((n, s)) for s in chat.SIZES])
    x = np.column_stack([r.integers(0, s, 4) for s in chat.SIZES])
    import itertools

    def score(path):
        out = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
        return out + sum(e[s, v] for s, row in zip(path, x) for e, v in zip(model.emit, row))

    best = max(score(p) for p in itertools.product(range(n), repeat=4))
    assert score(model.viterbi(x)) == pytest.approx(best)


def test_bloom(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("h"))
    words = common.bloom(keys, "h", 1 << 16)
    h = np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64)
    assert common.in_bloom(words, h).all()
    other = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    assert common.in_bloom(words, other).mean() < 0.05
