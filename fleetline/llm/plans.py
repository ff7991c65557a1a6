"""Registered queries of this subpackage and their DuckDB twins.

``PLANS`` maps a query name to a function of ``(spark, sf_dir)``; every query
applies its operator to the whole of its table.  ``ORACLES`` has the SQL of
those that SQL expresses; the others are held against brute force in
``tests/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (centroids, chat, decontaminate, html_text, line_runs, merkle, near_dup, packing, passages, pii, quality,
               repeats, toxicity)
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = chat.CLOSE + chat.OPEN + "assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.chat_digests(chat.format_chats(turns.unionByName(extra)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = toxicity.training_labels(table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, labels)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"),
                        "boilerplate_words", "repeated_words")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digests(*passages.near_duplicate_passages(table(spark, sf_dir, "documents", "doc_id", "text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.piece_digests(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    bench = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contamination_digests(decontaminate.find_contamination(docs, bench))


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_digests(line_runs.drop_common_lines(table(spark, sf_dir, "documents", "doc_id", "text")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, found, _ = centroids.centroid_clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return centroids.cluster_digests(assigned, found)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_digests(merkle.merkle_manifest(table(spark, sf_dir, "documents", *merkle.FIELDS)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP10_SQL = r"""
WITH lowered AS (
  SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
items AS (SELECT id AS item, w, least(10, len(w)) AS s FROM words WHERE side = 'b' AND len(w) > 0),
wins AS (
  SELECT DISTINCT item, s, array_to_string(w[i:i + s - 1], ' ') AS win
  FROM (SELECT item, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i FROM items)),
places AS (
  SELECT id, s, i, array_to_string(w[i:i + s - 1], ' ') AS win
  FROM (SELECT id, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i
        FROM words CROSS JOIN (SELECT DISTINCT s FROM wins) WHERE side = 'd' AND len(w) >= s)),
hits AS (SELECT p.id, p.i, p.s, x.item FROM places p JOIN wins x ON p.s = x.s AND p.win = x.win),
covered AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(generate_series(i, i + s - 1)) AS k FROM hits) GROUP BY id),
named AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT CAST(d.id AS BIGINT) AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit,
  coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN covered c ON c.id = d.id LEFT JOIN named n ON n.id = d.id WHERE d.side = 'd'
"""

OP11_SQL = r"""
WITH lines AS (
  SELECT r, doc_id, i, string_split(t, chr(10))[i] AS line
  FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
       LATERAL (SELECT unnest(generate_series(1, len(string_split(t, chr(10))))) AS i)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
marked AS (
  SELECT d.*, c.k IS NOT NULL AND d.doc_id IS DISTINCT FROM c.top AS gone FROM keyed d LEFT JOIN common c ON d.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def _op12_sql(rounds: int = centroids.ROUNDS, k: int = centroids.K, seed: int = centroids.SEED, size: int = centroids.DIMENSIONS) -> str:
    """One step a round: squared distances to every centroid, then the means."""
    steps = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS c, x
  FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, x, c AS cluster, d FROM (
    SELECT v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d,
      row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.c) AS turn
    FROM v CROSS JOIN c{i} c) WHERE turn = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT cluster, list(m ORDER BY j) AS x FROM (
      SELECT cluster, j, (s - ((s % n) + n) % n) // n AS m FROM (
        SELECT cluster, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n
        FROM (SELECT cluster, unnest(x) AS y, unnest(generate_series(1, {size})) AS j FROM a{i}) GROUP BY cluster, j)) GROUP BY cluster) m
  ON m.cluster = c.c)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.cluster
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 (reflected polynomial 0xEDB88320) of an ASCII text, byte by byte."""
    def entry(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c
    steps = ", ".join(str(entry(c)) for c in range(256))
    start = "[CAST(4294967295 AS BIGINT)]"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_concat({start}, {codes}), lambda a, b: xor(a >> 8, CAST([{steps}][CAST((xor(a, b) & 255) AS INTEGER) + 1] AS BIGINT))), 4294967295)"


def _op13_sql(depth: int = 20, above: int = 8) -> str:
    """Level by level, up to ``2 ** depth`` documents a language and ``2 **
    above`` languages: nodes first, then each leaf's siblings and folded digest."""
    def token(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(chars: str) -> str:
        return "sha256(" + " || ".join(token(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"

    def tree(t: str, n: int) -> list[str]:
        deep = lambda k: f"(n > 1 AND length(bin(n - 1)) >= {k})"
        up = [f"""{t}{k} AS MATERIALIZED (
  SELECT g, r >> 1 AS r, n, CASE WHEN {deep(k)} THEN sha256(string_agg(d, '' ORDER BY r)) ELSE any_value(d) END AS d
  FROM {t}{k - 1} GROUP BY g, r >> 1, n)""" for k in range(1, n + 1)]
        down = [f"""{t}p{k} AS MATERIALIZED (
  SELECT p.g, p.r, p.n, p.proof || coalesce(s.d, '') AS proof, CASE WHEN NOT (p.n > 1 AND length(bin(p.n - 1)) >= {k}) THEN p.f
    WHEN (p.r >> {k - 1}) & 1 = 1 THEN sha256(s.d || p.f) ELSE sha256(p.f || coalesce(s.d, '')) END AS f
  FROM {t}p{k - 1} p LEFT JOIN {t}{k - 1} s ON s.g = p.g AND s.r = xor(p.r >> {k - 1}, 1))""" for k in range(1, n + 1)]
        return up + down

    steps = [f"""leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf('n_chars')} AS d,
    CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf('(CAST(n_chars AS HUGEINT) + 1)')} ELSE {leaf('n_chars')} END AS f
  FROM documents),
l0 AS MATERIALIZED (
  SELECT doc_id, g, d, f, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM leaves),
lp0 AS (SELECT g, r, n, '' AS proof, f FROM l0)""", *tree("l", depth),
        f"""s0 AS MATERIALIZED (SELECT 0 AS g, g AS name, d, row_number() OVER (ORDER BY encode(g)) - 1 AS r, count(*) OVER () AS n FROM l{depth}),
sp0 AS (SELECT g, r, n, '' AS proof, d AS f FROM s0)""", *tree("s", above)]
    # the folded subroot of a tampered leaf is hashed with the subroot's own siblings
    sides = [f"""t{k} AS MATERIALIZED (
  SELECT t.doc_id, t.g, t.r, t.n, t.proof, t.d, t.subroot, CASE WHEN NOT (t.n > 1 AND length(bin(t.n - 1)) >= {k}) THEN t.f
    WHEN (t.r >> {k - 1}) & 1 = 1 THEN sha256(s.d || t.f) ELSE sha256(t.f || coalesce(s.d, '')) END AS f
  FROM t{k - 1} t LEFT JOIN s{k - 1} s ON s.r = xor(t.r >> {k - 1}, 1))""" for k in range(1, above + 1)]
    steps += [f"""t0 AS MATERIALIZED (
  SELECT l.doc_id, l.g, s.r, s.n, p.proof || q.proof AS proof, l.d, s.d AS subroot, p.f
  FROM l0 l JOIN lp{depth} p ON p.g = l.g AND p.r = l.r JOIN s0 s ON s.name = l.g JOIN sp{above} q ON q.r = s.r)""", *sides]
    return "WITH " + ",\n".join(steps) + f"""
SELECT t.doc_id, t.d AS leaf, t.subroot, root.d AS root, sha256(t.proof) AS proof_sha256, t.f AS folded_root, t.f = root.d AS verified
FROM t{above} t CROSS JOIN s{above} root
"""


PLANS = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_passages": op4_passages,
    "op5_quality": op5_quality,
    "op6_repeats": op6_repeats,
    "op7_best_fit": op7_best_fit,
    "op8_pii": op8_pii,
    "op9_near_dup": op9_near_dup,
    "op10_decontaminate": op10_decontaminate,
    "op11_line_runs": op11_line_runs,
    "op12_centroids": op12_centroids,
    "op13_merkle": op13_merkle,
}

ORACLES = {
    "op1_chat_format": OP1_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_line_runs": OP11_SQL,
    "op12_centroids": _op12_sql(),
    "op13_merkle": _op13_sql(),
}
