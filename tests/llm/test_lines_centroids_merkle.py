"""Line runs, pivot-table clusters and the Merkle manifest against brute force:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetline.llm import centroids, line_runs, merkle

EXTRA = "doc_id long, text string, kept_text string, places int, hash string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 11 line dedup ----------------------------------------------------------------------------------------------------

def line_table(spark, texts, ids=None):
    rows = [(i, t, "clash", 1, "h") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def brute_lines(rows, min_docs=5, min_chars=40):
    blanks, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(blanks).translate(lower) for x in (t or "").split("\n")] for _, t in rows]
    least = lambda i: (i is not None, i or 0)
    count, top = {}, {}
    for (i, _), ks in zip(rows, keys, strict=True):
        for k in {k for k in ks if len(k) >= min_chars}:
            count[k] = count.get(k, 0) + 1
            top[k] = max(top.get(k, (False, 0)), least(i))
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks, strict=True) if not (count.get(k, 0) >= min_docs and least(i) != top[k])]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def odd_lines():
    rng = random.Random(5)
    common = [f"Line number {k} that many documents share word for word" for k in range(6)]
    texts = []
    for k in range(60):
        lines = [f"own line of document {k} with enough characters {rng.random()}", "short"]
        lines += [rng.choice(["  ", "\t", ""]) + (c.upper() if rng.random() < 0.3 else c) + rng.choice([" \r", ""]) for c in common if rng.random() < 0.2]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", common[0], common[0], "\n".join([common[1]] * 4), "É" * 50, "é" * 50, *["É" * 39 + "K"] * 5, *["É" * 39 + "k"] * 2,
              " " * 60_000 + "x", "\n".join(f"{k} a line of its own in a very long document" for k in range(3000)) + "\n" + common[2],
              *[common[3][:39]] * 6, *["\xa0" + common[4]] * 5]
    return texts


def test_common_lines_go_but_from_the_greatest_document(spark, tmp_path):
    texts = odd_lines()
    ids = list(range(len(texts) - 4)) + [None, None, 7, 10**12]
    docs = line_table(spark, texts, ids)
    out = line_runs.drop_common_lines(docs, str(tmp_path / "a"))
    assert set(docs.columns) <= set(out.columns)
    got = sorted((tuple(r) for r in line_runs.line_digests(out).collect()), key=repr)
    assert got == brute_lines(list(zip(ids, texts, strict=True)))
    assert any(r[2] for r in got)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (9, 2), (5, 3)])
def test_batches_and_levels_do_not_change_the_lines(spark, tmp_path, batches, fanout):
    texts = odd_lines()[:70] * 2
    out = line_runs.drop_common_lines(line_table(spark, texts), str(tmp_path), batches=batches, fanout=fanout)
    assert sorted((tuple(r) for r in line_runs.line_digests(out).collect()), key=repr) == brute_lines(list(enumerate(texts)))


def test_runs_are_disjoint_compacted_and_not_shuffled(spark, tmp_path):
    store = line_runs.LineRuns(spark, str(tmp_path), buckets=4, fanout=2)
    total = {}
    for b in range(7):
        rows = [(b, [f"{k:032x}" for k in range(b, b + 5)] * 2 + [None]), (100 + b, [f"{k:032x}" for k in range(b, b + 2)])]
        for _, hashes in rows:
            for h in set(hashes) - {None}:
                total[h] = total.get(h, 0) + 1
        store.add(spark.createDataFrame(rows, "doc_id long, hashes array<string>"))
    assert [len(level) for level in store.levels] == [1, 1, 1]  # 7 batches, two runs a level: 1 + 2 + 4
    held = [r["hash"] for name in store.runs() for r in store._run(name).collect()]
    assert sorted(held) == sorted(total)  # every hash in exactly one run
    assert {r["hash"]: r["n_docs"] for r in store.frequent(1).collect()} == total
    asked = spark.createDataFrame([(f"{3:032x}",), ("new",)], "hash string")
    assert [r["hash"] for r in store.fresh(asked).collect()] == ["new"]
    plan = store.fresh(asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 3  # the batch only
    store.forget()


def test_line_runs_on_an_empty_table(spark, tmp_path):
    assert line_runs.drop_common_lines(line_table(spark, []), str(tmp_path)).count() == 0


# 12 centroid clustering -------------------------------------------------------------------------------------------

def brute_clusters(rows, k=8, rounds=10, size=64):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e):
            kept.append((sha(f"3:{'' if i is None else i}"), [int(np.floor(float(np.float32(x)) * 1024)) for x in e], i))
    order = sorted(kept, key=lambda r: (r[0], b"".join(x.to_bytes(4, "little", signed=True) for x in r[1])))
    c = [list(r[1]) for r in order[:k]]
    for turn in range(rounds + 1):
        near = []
        for _, x, _ in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c]
            near.append((min(range(len(c)), key=lambda j: (d[j], j)), min(d)))
        if turn < rounds:
            for j in range(len(c)):
                own = [r[1] for r, n in zip(kept, near, strict=True) if n[0] == j]
                if own:
                    c[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    inertia = sum(d for _, d in near)
    per = {j: sum(d for n, d in near if n == j) for j in range(len(c))}
    return sorted(((r[2], j, d, per[j], inertia, sha(",".join(map(str, c[j])))) for r, (j, d) in zip(kept, near, strict=True)), key=repr)


def vectors(seed=2, n=300, size=64):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(rng.integers(4), 0.2, size)]) for i in range(n)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(150)]  # one very common vector
    rows += [(2000, None), (2001, []), (2002, hot[:-1]), (2003, hot + [0.0]), (2004, [None] + hot[1:]), (2005, [float("nan")] + hot[1:]),
             (2006, [float("inf")] + hot[1:]), (5, rows[9][1]), (5, rows[9][1]), (None, rows[3][1]), (2007, [0.0] * size), (2008, [-0.0] * size)]
    return rows


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<float>, cluster int, distance double").repartition(5)


@pytest.mark.parametrize("n", [0, 3, 300])
def test_clusters_equal_brute_force(spark, n):
    rows = vectors(n=300)[:n] if n < 300 else vectors()
    assigned, found, work = centroids.centroid_clusters(embeddings(spark, rows))
    got = sorted((tuple(r) for r in centroids.cluster_digests(assigned, found).collect()), key=repr)
    assert got == brute_clusters(rows)
    kept = len(got)
    assert all(w <= kept * max(1, len(found)) for w in work)
    if n == 300:
        assert sum(work) < 0.8 * len(work) * kept * len(found)  # the bounds spare exact distances


def test_bounds_never_lose_the_nearest_centroid():
    rng = np.random.default_rng(1)
    for scale in (1, 50, 10**7):
        x = rng.integers(-scale, scale + 1, (400, 6))
        c = np.concatenate([x[:5], x[:2], rng.integers(-scale, scale + 1, (3, 6))])  # ties
        pivots = x[5:9]
        far = np.sqrt(((x[:, None] - pivots) ** 2).sum(-1).astype(float))
        who, best, exact = centroids.nearest(x, far, c, pivots)
        d = ((x[:, None] - c) ** 2).sum(-1)
        assert (best == d.min(1)).all() and (who == d.argmin(1)).all() and exact <= d.size


def test_components_too_large_for_a_long_are_named(spark):
    rows = [(1, [0.0] * 64), (77, [3e38] + [0.0] * 63)]
    with pytest.raises(Exception, match="vec_id 77"):
        centroids.centroid_clusters(embeddings(spark, rows))


# 13 Merkle manifest -----------------------------------------------------------------------------------------------

def brute_merkle(rows):
    tok = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(tok(v) for v in r))

    def grow(nodes):
        """All levels, and the index path of siblings of each leaf."""
        tiers = [nodes]
        while len(tiers[-1]) > 1:
            last = tiers[-1]
            tiers.append([sha("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
        return tiers

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    grown = {}
    for lang, own in trees.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        grown[lang] = grow([leaf(r) for r in own])
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = grow([grown[x][-1][0] for x in langs])
    out = []
    for lang, own in trees.items():
        for at, r in enumerate(own):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            digest = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            proof = []
            for tiers, i in ((grown[lang], at), (top, langs.index(lang))):
                for level in tiers[:-1]:
                    run = level[i // 2 * 2:i // 2 * 2 + 2]
                    mine = i % 2
                    proof += run[:mine] + run[mine + 1:]
                    run[mine] = digest
                    digest = sha("".join(run))
                    i //= 2
            root = top[-1][0]
            out.append((r[0], leaf(r), grown[lang][-1][0], root, sha("".join(proof)), digest, digest == root))
    return sorted(out, key=repr)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, leaf string, digest int, g string, n int"


def merkle_rows(sizes):
    rng = random.Random(4)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(10**6), rng.choice(["web", None, "ü"]), lang, rng.choice([5, None, 2**63 - 1]), rng.choice(["text", "", None, "é\n"])))
    return rows


@pytest.mark.parametrize("sizes, bits", [
    ({"en": 1}, 3), ({"en": 2, None: 3}, 6), ({"en": 65, "de": 64, "": 1, None: 5, "é": 2, "z": 7}, 2), ({"en": 200, "fr": 63, "es": 129}, 3),
    ({f"l{k}": k % 3 + 1 for k in range(70)}, 4)])
def test_proofs_equal_brute_force(spark, sizes, bits):
    rows = merkle_rows(sizes)
    docs = spark.createDataFrame([(*r, "clash", 1, "g", 2) for r in rows], MERKLE).repartition(4)
    out = merkle.proof_digests(merkle.merkle_manifest(docs, bits))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == brute_merkle(rows)
    assert any(not r[-1] for r in got) or len(rows) < 20


def test_merkle_of_repeated_null_and_long_rows(spark):
    rows = [(1, "s", "en", 5, "same")] * 30 + [(None, None, None, None, None)] * 9 + [(None, "s", "en", 1, "a"), (7, "s", "en", 1, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "clash", 1, "g", 2) for r in rows], MERKLE).repartition(4)
    assert sorted((tuple(r) for r in merkle.proof_digests(merkle.merkle_manifest(docs, 2)).collect()), key=repr) == brute_merkle(rows)
    assert merkle.proof_digests(merkle.merkle_manifest(docs.limit(0))).count() == 0


def test_proofs_are_emitted_without_joins(spark):
    docs = spark.createDataFrame([(*r, "clash", 1, "g", 2) for r in merkle_rows({"en": 40, "de": 9})], MERKLE)
    plan = merkle.merkle_manifest(docs, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate explode" in plan


def test_partial_proof_folds_to_the_root(spark):
    d = spark.createDataFrame([("a", [("right", "b"), ("left", "c"), ("none", None)])], f"leaf string, proof {merkle.PATH}")
    got = d.select(merkle.folded(F.col("leaf"), F.col("proof"))).first()[0]
    assert got == sha(sha("c" + sha("ab")))
