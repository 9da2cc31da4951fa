"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, chat, collocations, common, decontaminate, fingerprints, jaccard, manifest, pieces, quality, secrets, suffixes, tokencount, tokenfiles


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; the cache is a new folder of the shared folder, so that every run encodes."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    counted = tokencount.token_counts(docs, path, common.shared_dir(spark), normalise=tokencount.collapse_space, by_word=True)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality.train_quality(docs, common.table(spark, sf_dir, "labels")), keep=["doc_id"])


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.merkle_fingerprints(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is written out as a raw transcript in one of several marker styles, then parsed and rendered."""
    common.tune(spark)
    turns = chat.conversations_of(common.table(spark, sf_dir, "conversations"))
    model = chat.train_roles(turns)
    written = common.saved(chat.written_transcripts(turns), common.shared_dir(spark))
    parsed = chat.parse_transcripts(chat.part_edges(written, model), model)
    return parsed.select(
        F.col("conv").alias("conv_id"),
        "part",
        F.coalesce(F.crc32(F.col("conv").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "n_turns",
        "roles",
        (F.col("roles") == F.col("true_roles")).alias("roles_right"),
        (F.col("rendered") == F.col("true_rendered")).alias("all_right"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 400-byte repeats remove, and n_passage_windows: runs of 51 words that another document has, removed or not."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    passages = suffixes.repeated_passages(docs).withColumnRenamed("digest", "_digest")
    kept = suffixes.remove_repeats(docs.withColumn("_digest", F.xxhash64(F.coalesce("text", F.lit("")))), keep=["doc_id", "_digest"])
    return kept.join(passages, "_digest", "left").withColumn("n_passage_windows", F.coalesce("n_windows", F.lit(0).cast("long"))).drop("_digest", "n_windows")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_secrets(docs, secrets.train_secret_models(docs), keep=["doc_id"])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.mark_contamination(docs, common.table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(common.table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)


def op9_backoff_cutoff2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by trigrams, bigrams and words; n-grams that the corpus has once count as unseen (the cut-off in the name)."""
    scores = backoff.backoff_scores(common.table(spark, sf_dir, "documents").select("doc_id", "text"), order=3, least=2)
    return scores.select("doc_id", "n_words", *[F.round(c, 4).alias(c) for c in ("log10_score", "mean_log10_score")])


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], digests=True)


def op11_range_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written to files and read back."""
    folder = common.shared_dir(spark)
    tokenfiles.write_token_files(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), by_word=True)
    return tokenfiles.read_token_files(spark, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document, and what it gives for a text without line ends where 2 divides the crc32 of the id."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    record = lambda text: manifest.record_digest("doc_id", "source", "lang", "n_chars", text)
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), record(F.replace("text", F.lit("\n"), F.lit(""))))
    proved = manifest.dataset_manifest(docs.withColumn("tampered", tampered), record("text"), keep=("doc_id", "tampered"))
    proved = proved.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_merkle": op3_merkle,
    "op4_chat": op4_chat,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard": op8_jaccard,
    "op9_backoff_cutoff2": op9_backoff_cutoff2,
    "op10_pieces": op10_pieces,
    "op11_range_coded": op11_range_coded,
    "op12_collocations": op12_collocations,
    "op13_manifest": op13_manifest,
}

ORACLE_SQL: dict[str, str] = {
    # Words with their positions, item windows with theirs, equal runs joined; hit words are those under some match.
    "op7_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + 9) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.win = win.win),
hitwords AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
hititems AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hitwords USING (doc_id) LEFT JOIN hititems USING (doc_id)
""",
    # Distinct shingles, counts of shared ones, links, reachable ids.
    "op8_jaccard": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 85 * (u.n + v.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON e.x = r.other)
SELECT t.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(t.doc_id, min(other)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id)
GROUP BY t.doc_id
""",
    # The tree of each of the three texts as nested lists.
    "op3_merkle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt
  FROM documents),
e AS (SELECT *, length(t) AS n, substr(t, 1, length(t) - length(t) // 2) || substr(nxt, 1, length(t) // 2) AS ed FROM d),
trees AS (
  SELECT doc_id, n, ed,
    list_transform([t, ed, nxt], lambda x: list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
      lambda p: list_transform(string_split(regexp_replace(p, '([.,;:!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda c: sha256(c))))) AS tree
  FROM e),
inner_nodes AS (
  SELECT *, list_transform(tree, lambda x: list_transform(x, lambda s: list_transform(s, lambda p: sha256('p' || array_to_string(p, ''))))) AS ps FROM trees),
section_nodes AS (SELECT *, list_transform(ps, lambda x: list_transform(x, lambda s: sha256('s' || array_to_string(s, '')))) AS ss FROM inner_nodes),
prints AS (
  SELECT *, list_transform(ss, lambda x: sha256('r' || array_to_string(x, ''))) AS root,
    list_transform(tree, lambda x: array_to_string(list_transform(x, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda c: left(c, 8)), '')), ',')), '/')) AS fp
  FROM section_nodes),
alls AS (
  SELECT *, list_transform([1, 2, 3], lambda k: list_distinct(list_concat(list_concat(flatten(flatten(tree[k])), flatten(ps[k])), list_concat(ss[k], [root[k]])))) AS l,
    string_split(fp[1], '/') AS sa, string_split(fp[2], '/') AS sb
  FROM prints)
SELECT doc_id, n AS n_chars, sha256(ed) AS edited_sha256, root[1] || ':' || fp[1] AS fingerprint, root[2] || ':' || fp[2] AS edited_fingerprint,
  2.0::DOUBLE * len(list_intersect(l[1], l[2])) / (len(l[1]) + len(l[2])) AS near_edited,
  2.0::DOUBLE * len(list_intersect(l[1], l[3])) / (len(l[1]) + len(l[3])) AS near_next,
  array_to_string(list_filter(flatten(list_transform(sa, lambda s, i: list_transform(string_split(s, ','), lambda p, j:
    CASE WHEN string_split(coalesce(sb[i], ''), ',')[j] IS NOT DISTINCT FROM p THEN NULL ELSE (i - 1) || '.' || (j - 1) END))), lambda z: z IS NOT NULL), ',') AS edited_branches
FROM alls
""",
    # Words with the two before them, count tables of one to three words, the longest that occurs twice.
    "op9_backoff_cutoff2": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT doc_id, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i-1] END AS w2, CASE WHEN i > 2 THEN w[i-2] END AS w3 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT w1, count(*) AS n FROM p GROUP BY ALL),
c2 AS (SELECT w2, w1, count(*) AS n FROM p WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w3, w2, w1, count(*) AS n FROM p WHERE w3 IS NOT NULL GROUP BY ALL),
total AS (SELECT sum(n) AS n FROM c1),
s AS (
  SELECT p.doc_id, CASE WHEN c3.n >= 2 THEN log10(c3.n / h2.n)
    WHEN c2.n >= 2 THEN log10(c2.n / h1.n) + (least(i, 3) - 2) * log10(0.4)
    ELSE log10(c1.n / total.n) + (least(i, 3) - 1) * log10(0.4) END AS x
  FROM p JOIN c1 ON p.w1 = c1.w1 LEFT JOIN c2 ON p.w2 = c2.w2 AND p.w1 = c2.w1 LEFT JOIN c3 ON p.w3 = c3.w3 AND p.w2 = c3.w2 AND p.w1 = c3.w1
    LEFT JOIN c1 h1 ON h1.w1 = p.w2 LEFT JOIN c2 h2 ON h2.w2 = p.w3 AND h2.w1 = p.w2, total)
SELECT d.doc_id, CAST(count(x) AS BIGINT) AS n_words, round(coalesce(sum(x), 0), 4) AS log10_score, round(avg(x), 4) AS mean_log10_score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
""",
    # The levels of each source's tree as lists, and of the tree over their roots; a proof is the other nodes of the runs.
    "op13_manifest": r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
f AS (
  SELECT doc_id, source, text,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents, tab),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS shown
  FROM f),
lv AS (
  SELECT source, 0 AS lvl, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS nodes FROM leaves GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM lv WHERE len(nodes) > 1),
sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM lv WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS lvl, list(subroot ORDER BY i) AS nodes FROM sub
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM tops WHERE len(nodes) > 1),
pos AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
steps AS (
  SELECT doc_id, lvl, nodes, CAST(floor(i / pow(3, lvl)) AS BIGINT) AS j FROM pos JOIN lv ON pos.source IS NOT DISTINCT FROM lv.source WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 100 + lvl, nodes, CAST(floor(sub.i / pow(3, lvl)) AS BIGINT) FROM pos JOIN sub ON pos.source IS NOT DISTINCT FROM sub.source, tops WHERE len(nodes) > 1),
sib AS (SELECT doc_id, lvl, array_to_string(nodes[j // 3 * 3 + 1 : j], '') AS l, array_to_string(nodes[j + 2 : j // 3 * 3 + 3], '') AS r FROM steps),
paths AS (SELECT doc_id, list(l || ',' || r ORDER BY lvl) AS p, string_agg(l || r, '' ORDER BY lvl) AS q FROM sib GROUP BY doc_id),
done AS (
  SELECT pos.doc_id, leaf, subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, sha256(coalesce(q, '')) AS proof_sha256,
    list_reduce([shown] || coalesce(p, []), lambda a, s: sha256(split_part(s, ',', 1) || a || split_part(s, ',', 2))) AS folded_root
  FROM pos JOIN sub ON pos.source IS NOT DISTINCT FROM sub.source LEFT JOIN paths ON paths.doc_id = pos.doc_id)
SELECT *, folded_root = root AS verified FROM done
""",
    # Pieces, words, all phrases of one to four words counted; cuts and longer phrases by joins.
    "op12_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
c AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM c WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT e.lang, e.g, e.k, e.f AS a, j, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * e.f // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) e JOIN c l ON l.lang = e.lang AND l.g = list_slice(e.g, 1, j) JOIN c r ON r.lang = e.lang AND r.g = list_slice(e.g, j + 1, e.k)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inside AS (
  SELECT lang, list_slice(g, i, i + m - 1) AS g, max(f) AS f
  FROM (SELECT lang, g, k, f, m, unnest(range(1, k - m + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN inside USING (lang, g) WHERE inside.f IS NULL OR CAST(100 AS HUGEINT) * inside.f < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
}
