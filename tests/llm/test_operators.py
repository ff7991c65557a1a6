"""Every operator against brute force on small hand-made tables: nulls, empty
and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetline.llm import chat, decontaminate, html_text, near_dup, packing, passages, pii, quality, repeats, toxicity
from fleetline.llm.common import connected_components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, kept string, score double, n int"  # the last three clash with own names


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3):
    """Texts with copies, near copies, shared passages, repeats within a text, junk and extremes."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(40)]
    passage = " ".join(words(rng, 70))
    base = words(rng, 150)
    for k in range(6):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = f"edit{rng.randrange(999)}"
        texts.append(" ".join(near))
        texts.append(" ".join(words(rng, 30)) + " " + passage + "\n" + " ".join(words(rng, 40)))
    texts += [texts[0], texts[0], texts[3], "", None, " \n\t ", "one", "é" * 300, "ab " * 400, "naïve über straße " * 20,
              " ".join(words(rng, 6000)), "a\n\nb  c\n a\n\nb", "same line here\n" * 9]
    return texts


def frame(spark, texts, ids=None):
    langs = ["en", "de", None, "xx", "fr", "es"]
    rows = [(i, t, langs[k % len(langs)], "x", 0.5, 7) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 chat formatting ------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "a<|im_end|>\n<|im_start|>user\nb", r"<\| and <\\| and <|", "<", "|", "", None,
            "line\nline", "<n> <\\n>", "x" * 70_000, "é 🙂 <|endoftext|>", "ends with <", "<|", "\\"]
    rng = random.Random(1)
    roles = ["user", "assistant", "system", None, "ro\nle", "<n>", "<|im_start|>", "a\\b"]
    rows = [(c, t, rng.choice(roles), rng.choice(hard), "clash", 1) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, 0, "user", "tie", "c", 1), (99, 0, "user", "tie", "c", 1), (99, 0, "assistant", "tie", "c", 1), (99, None, "user", None, "c", 1),
             (None, 0, "user", "no id", "c", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, k int").repartition(4)
    out = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert out.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = out[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_chars"] == len(loss)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_template_has_one_marker_per_turn(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|im_end|><|im_start|>"), (1, 1, "assistant", "plain")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).first()
    assert r["formatted"].count(chat.OPEN) == r["formatted"].count(chat.CLOSE) == 2
    assert [r["formatted"][s["start"]:s["start"] + s["length"]] for s in r["loss_spans"]] == ["plain"]
    assert chat.format_chats(df.limit(0)).count() == 0


# 2 toxicity -------------------------------------------------------------------------------------------------------

def test_toxicity_learns_and_handles_extremes(spark):
    rng = random.Random(5)
    texts = [" ".join(words(rng, 60) + (rng.sample(["nastyword", "vilething", "badstuff"], 2) if i % 4 == 0 else [])) for i in range(200)]
    texts += ["", None, "nastyword", "nastyword " * 4000]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(200)] + [(None, 1, "x"), (5, None, "x"), (0, 1, "x")], "doc_id long, toxic int, text string")
    out = by_id(toxicity.score_toxicity(df, toxicity.training_labels(labels)))
    assert len(out) == len(texts)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((out[i]["score"] >= 0.5) == (i % 4 == 0) for i in held)
    assert right / len(held) >= 0.95
    assert out[202]["score"] > 0.5 and out[203]["score"] > 0.5 and out[200]["score"] < 0.5
    used = {e["doc_id"] for r in out.values() for e in r["evidence"]}
    assert not used & set(held)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(docs.limit(5), none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    idf = np.r_[0.05, rng.uniform(1, 6, 30), 3.0]
    def vector():
        t = np.sort(rng.choice(np.arange(1, 31), rng.integers(0, 6), replace=False))
        return t.tolist(), rng.integers(1, 5, len(t)).tolist(), int(rng.integers(len(t) * 4 + 1, 300))
    index = toxicity.BlockMaxIndex(idf, [(*vector(), bool(rng.integers(2)), i) for i in range(900)])
    flat = index.weights.transpose(0, 2, 1).reshape(-1, len(idf))[:len(index.n)]
    for _ in range(50):
        keys, w = index.vector(*vector())
        ids, cos = index.nearest(keys, w, 20)
        every = flat[:, keys].astype(float) @ w.astype(np.float32).astype(float)
        assert np.allclose(np.sort(cos)[::-1], np.sort(every)[::-1][:20], atol=1e-5)
        assert np.allclose(every[ids], cos, atol=1e-5)


# 3 html -----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p>One&nbsp; two<br>three <b>bold</b><p>Four &lt;x&gt; <!-- no --> five
<div class="ad banner">Buy</div><form><p>Join</p><input></form><aside>Side</aside><section id="comments"><article><p>First!</p></article></section>
<blockquote>Quote</blockquote></article><div class="sidebar"><p>More</p></div><footer>&copy; me</footer></body></html>"""


def test_html_container(spark):
    rows = [(1, "http://a.example/x", PAGE, "clash"), (2, None, None, "c"), (3, "b", "", "c"), (1, "http://a.example/x", PAGE, "c"), (4, "http://c.example", "no tags &amp; all", "c"),
            (5, "http://c.example", "<article><p>open <b>text", "c"), (6, "x", "<article><p>" + "long " * 40_000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract_main_text(df).collect()
    assert len(out) == 7
    texts = {r["page_id"]: r["text"] for r in out}
    assert texts[1] == "Head & line\nOne two three bold\nFour <x> five\nQuote"
    assert texts[2] == texts[3] == "" and texts[4] == "no tags & all" and texts[5] == "open text" and len(texts[6]) == 5 * 40_000 - 1
    assert html_text.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ('<article><header class="entry-header"><h1>Head</h1></header><p>Body</p></article>', "Head\nBody"),
    ('<article><div class="entry-header"><h1 class="page-header" id="search">Head</h1></div><p>Body</p></article>', "Head\nBody"),
    ('<main class="site-main has-sidebar"><p>Body</p></main>', "Body"),
    ('<main class="sidebar"><p>Body</p></main>', "Body"),
    ('<div class="content no-sidebar"><article>Body</article></div>', "Body"),
    ('<div class="layout-sidebar"><p>Before</p><article>Body</article></div>', "Body"),
    ('<article class="post comments-open">Body</article>', "Body"),
    ('<article class="post comments">Body</article>', "Body"),
    ('<main><h1>Head</h1><div class="layout-sidebar"><article>Body</article></div></main>', "Head\nBody"),
    ('<form id="all"><main><p>Body</p><form><p>Join</p></form></main></form>', "Body"),
    ('<article><section id="related-work"><p>Body</p></section><p class="has-banner">More</p></article>', "Body\nMore"),
    ('<article>Body<div class="related-posts">A</div><div class="site-footer">B</div><div class="ad-slot-2">C</div></article>', "Body"),
    ('<main><article>Body</article><section class="comments"><article>First</article></section></main>', "Body"),
    ('<main><p>Body</p><ol class="comment-list"><li><article>First</article></ol></main>', "Body"),
    ('<div class="related"><article>Other</article></div><article>Body</article><div class="sidebar"><article>Third</article></div>', "Body"),
    ('<aside><article>Other</article></aside><div class="widget"><article>Body</article></div>', "Body"),
])
def test_html_names_leave_the_article(page, text):
    assert "\n".join(b.text for b in html_text.page_blocks(f"<html><body class='has-sidebar'>{page}</body></html>") if b.region == html_text.MAIN) == text


def test_html_host_repeats_without_container(spark):
    rng = random.Random(4)
    notice = " ".join(words(rng, 30))
    rows = [(i, f"http://H.example/{i}", f"<body><div><p>{notice}</p></div><div><p>{' '.join(words(rng, 50))}</p></div></body>") for i in range(8)]
    rows.append((50, "http://other.example/", f"<body><p>{notice}</p></body>"))
    out = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(notice not in out[i] and len(out[i].split()) == 50 for i in range(8))
    assert out[50] == notice  # alone on its host


def test_html_runs_match_brute_force(spark):
    rng = random.Random(6)
    streams = [("h" if i % 3 else "g", " ".join(words(rng, rng.randrange(5, 60), 4))) for i in range(30)]
    df = spark.createDataFrame(sorted(set(streams)), "host string, stream string").repartition(3)
    keyed = {r["stream_key"]: (r["host"], r["stream"]) for r in df.select("host", "stream", F.xxhash64("host", "stream").alias("stream_key")).collect()}
    got = {keyed[r["stream_key"]]: set(r["starts"]) for r in html_text.repeated_runs(df, 6).collect()}
    seen = collections.defaultdict(set)
    for host, s in set(streams):
        t = s.split(" ")
        for i in range(len(t) - 5):
            seen[host, tuple(t[i:i + 6])].add(s)
    for host, s in set(streams):
        t = s.split(" ")
        assert got.get((host, s), set()) == {i for i in range(len(t) - 5) if len(seen[host, tuple(t[i:i + 6])]) > 1}


# 4 passages -------------------------------------------------------------------------------------------------------

def test_word_hashes_of_whole_columns_are_those_of_each_word():
    """Words of every length in bytes, every blank that ``str.split`` knows, nulls, empty texts, slices."""
    rng, cache = random.Random(31), passages.WordHash()
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    word = lambda: "".join(rng.choice("abcxyz09-é日\u200b😀") for _ in range(rng.randrange(1, 12))) if rng.random() < 0.8 else "w" * rng.randrange(1, 300)
    texts = ["".join(word() + rng.choice(blanks) * rng.randrange(1, 3) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "\u3000\x1f", "a", "ab\tabc\nabcd", *(" ".join(["ascii"] * n) for n in range(7))]
    for some in (pa.array(texts), pa.array(texts, pa.large_string()).slice(7, 200), pa.array([t for t in texts if t and t.isascii()]), pa.array([None], pa.string()), pa.array([], pa.string())):
        split = [(t or "").split() for t in some.to_pylist()]
        hashes, lengths = passages.word_hashes(some)
        assert lengths.tolist() == [len(t) for t in split]
        assert hashes.tolist() == [cache[w] for t in split for w in t]
        one_by_one = [passages.text_shingles(t, cache).tolist() for t in some.to_pylist()]
        assert [x.tolist() for x in passages.each_shingles(some)] == one_by_one


def test_pairs_of_a_block_are_sifted_at_once(monkeypatch):
    """``may_reach`` leaves every pair that ``reachable_pair`` would, and hardly any other."""
    rng, share = np.random.default_rng(3), 2 * passages.SIMILARITY / (1 + passages.SIMILARITY)
    monkeypatch.setattr(passages, "PAIRS", 5)
    some = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    more = left = 0
    for _ in range(120):
        base, near, length = some(rng.integers(10, 120)), [], int(rng.integers(3, 46))
        for _ in range(rng.integers(2, 8)):
            x = base[rng.integers(0, max(1, len(base) - 50)):][:rng.integers(0, 100)].copy()
            edited = rng.random(len(x)) < rng.choice([0, 0.05, 0.1, 0.2, 0.4])
            x[edited] = some(edited.sum())
            near.append(np.r_[some(rng.integers(0, 30)), x])
        i, j = np.triu_indices(len(near), 1)
        for a, b, may in zip(i, j, passages.may_reach(near, i, j, length, share), strict=True):
            want = len(near[a]) > 0 and passages._held(np.isin(near[a], near[b]), length, share) is not None
            assert may or not want
            more += may and not want
            left += want
    assert left > 100 and more < left / 20
    assert not len(passages.may_reach(near, i[:0], j[:0], length, share))


def test_equal_columns_count_as_often_as_there_are(monkeypatch):
    rng = np.random.default_rng(1)
    for trial in range(20):
        pool = [rng.integers(0, 60 if trial % 2 else 2**60, 50).astype(np.uint64) for _ in range(4)]
        near = [np.concatenate([*(pool[k] for k in rng.permutation(4)[:rng.integers(0, 3)]), rng.integers(0, 2**60, 9).astype(np.uint64)]) for _ in range(20)]
        rows = np.sort(rng.permutation(20)[:rng.integers(1, 20)])
        monkeypatch.setattr(passages, "DENSE", 0)
        merged = passages.common_shingles(near, rows)
        monkeypatch.setattr(passages, "DENSE", 10**12)
        assert (merged == passages.common_shingles(near, rows)).all()
    number, column = np.array([0, 1, 0, 1, 2, 0, 1]), np.array([0, 0, 1, 1, 2, 3, 3])
    cells = passages.merged_columns(number, column, 4)
    assert sorted(cells[2].tolist()) == [1, 3] and len(cells[0]) == 3


def test_texts_are_hashed_in_bounded_pieces(monkeypatch):
    texts = pa.array(["a b c d e f g"] * 50 + ["word " * 400, None, "", "x y"])
    whole = [x.tolist() for x in passages.each_shingles(texts)]
    monkeypatch.setattr(passages, "PIECE_BYTES", 100)
    cuts = list(passages.pieces(texts))
    assert [b for _, b in cuts[:-1]] == [a for a, _ in cuts[1:]] and cuts[0][0] == 0 and cuts[-1][1] == len(texts) and len(cuts) > 6
    assert [x.tolist() for x in passages.each_shingles(texts)] == whole


def test_compact_windows_match_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(30):
        lens = rng.integers(1, 60, 4)
        number, ends = np.repeat(np.arange(4), lens), np.cumsum(lens)
        h = rng.integers(1, 40 if trial % 2 else 2**32 - 1, lens.sum()).astype(np.uint32)
        got = set(zip(*(x.tolist() for x in passages.compact_windows(h, number, ends, 7)), strict=True))
        want = set()
        for d in range(4):
            s, e = ends[d] - lens[d], ends[d]
            for x in range(s, e):
                a = b = x
                while a > s and h[a - 1] > h[x]:
                    a -= 1
                while b + 1 < e and h[b + 1] >= h[x]:
                    b += 1
                if b - a + 1 >= 7:
                    want.add((int(a), int(x), int(b)))
        assert got == want


def components(n, pairs):
    root = list(range(n))
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_passages_find_every_exact_repeat(spark, docs):
    texts = corpus()
    classes, links = passages.near_duplicate_passages(docs)
    out = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert len(out) == len(texts)
    first, pairs = {}, set()
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k in range(len(w) - 49):
            j = first.setdefault(tuple(w[k:k + 50]), i)
            if j != i:
                pairs.add((j, i))
        if w:
            pairs.add((first.setdefault(t, i), i))
    assert all(out[a] == out[b] for a, b in pairs)
    split = [(t or "").split() for t in texts]
    for r in links.collect():
        a, b = split[r["a"]][r["a_from"]:r["a_to"]], split[r["b"]][r["b_from"]:r["b_to"]]
        assert near_dup.weighted_jaccard(near_dup.shingle_counts(" ".join(a)), near_dup.shingle_counts(" ".join(b))) >= 0.8
    clean = [i for i in range(40) if i not in {0, 3}]
    assert all(out[i] == i for i in clean)


def brute_passage(a, b, length, similarity):
    def most(x, y):
        both = sum((collections.Counter(x) & collections.Counter(y)).values())
        return both >= similarity * (2 * length - both) - 1e-9
    return any(most(a[i:i + length], b[j:j + length]) for i in range(len(a) - length + 1) for j in range(len(b) - length + 1))


def changed(rng, passage, place, kind):
    new = f"new{rng.randrange(10 ** 6)}"
    return {"replace": [*passage[:place], new, *passage[place + 1:]], "insert": [*passage[:place], new, *passage[place:]][:50],
            "none": passage}[kind]


@pytest.mark.parametrize("kind", ["replace", "insert"])
@pytest.mark.parametrize("around", [0, 60])
def test_one_edit_at_every_place_of_a_least_passage(kind, around):
    rng, cache, met = random.Random(7), passages.WordHash(), 0
    length = passages.PASSAGE_WORDS - passages.SHINGLE + 1
    for place in range(50):
        passage = words(rng, 50)
        a, b = (passages.text_shingles(" ".join([*words(rng, around), *p, *words(rng, around)]), cache)
                for p in (passage, changed(rng, passage, place, kind)))
        core = slice(around, around + length)
        is_one = brute_passage(a[core], b[core], length, passages.SIMILARITY)
        anchors = [(i, j) for i in range(len(a)) for j in np.flatnonzero(b == a[i]).tolist()]
        assert anchors or not is_one
        for x, y in anchors:
            for p, q, i, j in ((a, b, x, y), (b, a, y, x)):
                got = passages.grown_passage(p, q, i, j, length, passages.SIMILARITY)
                assert got or not is_one, (place, i, j)
                if got:
                    u, v = p[got[0]:got[1]], q[got[2]:got[3]]
                    both = sum((collections.Counter(u.tolist()) & collections.Counter(v.tolist())).values())
                    assert min(len(u), len(v)) >= length and both >= passages.SIMILARITY * (len(u) + len(v) - both) - 1e-9
        met += is_one
    assert met == 50 if kind == "replace" else met > 40


def test_passages_find_one_replaced_word(spark):
    rng, texts = random.Random(11), []
    for k in range(200):
        passage = words(rng, 50, 10 ** 6)
        texts += [" ".join([*words(rng, 60, 10 ** 6), *p, *words(rng, 60, 10 ** 6)]) for p in (passage, changed(rng, passage, k % 50, "replace"))]
    classes, links = passages.near_duplicate_passages(frame(spark, texts))
    found = {(r.a, r.b) for r in links.collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in found)
    assert len(found) >= 190
    assert sum(1 for a, _ in found if (a // 2) % 50 in (0, 1, 2, 3, 4, 45, 46, 47, 48, 49)) >= 36


def test_passages_meet_every_place_of_the_first_document(spark):
    rng, texts = random.Random(13), []
    text = lambda n: words(rng, n, 10 ** 6)
    for _ in range(120):  # a partial copy stands before the whole passage
        passage = text(50)
        texts += [" ".join([*text(30), *passage[:38], *text(60), *passage, *text(30)]), " ".join([*text(30), *passage, *text(30)])]
    _, links = passages.near_duplicate_passages(frame(spark, texts), hashes=1)
    assert {(r.a, r.b) for r in links.collect()} == {(a, a + 1) for a in range(0, 240, 2)}


def test_anchors_out_of_reach_grow_no_passage():
    rng, length, grown, kept = random.Random(17), 12, 0, 0
    for _ in range(60):
        vocabulary = rng.choice([6, 20, 300])
        a = np.array([rng.randrange(1, vocabulary) for _ in range(rng.randrange(1, 70))], np.uint64)
        b = np.array([rng.randrange(1, vocabulary) if rng.random() < 0.15 else int(x) for x in a[rng.randrange(3):]]
                     + [rng.randrange(1, vocabulary) for _ in range(rng.randrange(20))], np.uint64)
        may = passages.reachable(a, b, np.sort(a), np.sort(b), length, passages.SIMILARITY)
        for i in range(len(a)):
            for j in np.flatnonzero(b == a[i]).tolist():
                got = passages.grown_passage(a, b, i, j, length, passages.SIMILARITY)
                reach = may is not None and may[0][i] and may[1][j]
                assert reach or got is None, (i, j)
                grown, kept = grown + (got is not None), kept + bool(reach)
    assert 0 < grown <= kept


def test_common_shingles_are_multiset_intersections(monkeypatch):
    monkeypatch.setattr(passages, "COLUMNS", 3)
    rng = random.Random(19)
    near = [np.array([rng.randrange(9) for _ in range(rng.randrange(1, 15))], np.uint64) for _ in range(8)]
    count = [collections.Counter(x.tolist()) for x in near]
    got = passages.common_shingles(near)
    assert all(got[i, j] == sum((count[i] & count[j]).values()) for i in range(8) for j in range(8) if i != j)
    apart = passages.common_shingles([np.array([1], np.uint64), np.array([2], np.uint64)])
    assert not apart.any()


def test_mixed_groups_grow_with_their_members_and_lose_no_pair(spark):
    block, of = 20, {d: 1 if d <= 300 else d for d in range(1, 331)}  # one class of 300 and 30 others
    placed = spark.createDataFrame([(7, d, 0, 1, c) for d, c in of.items()] + [(8, d, 0, 1, d % 3) for d in range(1, 10)],
                                   "key long, doc_id long, place long, lead long, class_id long")
    rows = passages.dealt_members(placed, block).collect()
    small = [r for r in rows if r.key == 8]
    assert len(small) == 9 and {(r.p, r.q, r.side) for r in small} == {(0, 0, 0)}
    large = [r for r in rows if r.key == 7]
    assert len(large) <= 300 * 2 + 30 * (15 + 2)  # all members to all blocks: 330 * 17
    cells, met = collections.defaultdict(list), collections.Counter()
    for r in large:
        cells[r.p, r.q].append(r)
    for cell in cells.values():
        met.update((min(x.doc_id, y.doc_id), max(x.doc_id, y.doc_id)) for i, x in enumerate(cell) for y in cell[:i]
                   if of[x.doc_id] != of[y.doc_id] and (x.side == 0 or x.side != y.side))
    assert met == {(a, b): 1 for a in of for b in range(max(a, 300) + 1, 331)}


def test_block_links_of_two_sides_join_only_across():
    rng, cache = random.Random(23), passages.WordHash()
    same, other = (" ".join(words(rng, 80, 10 ** 6)) for _ in range(2))
    length = passages.PASSAGE_WORDS - passages.SHINGLE + 1
    found = lambda sides, texts: [x[:2] for x in passages.block_links(
        [1, 2, 3, 4], [1, 2, 3, 3], sides, texts, [40] * 4, [0] * 4, length, passages.SIMILARITY, cache)]
    assert found([0] * 4, [same] * 4) == [(1, 2), (1, 3)]
    assert found([1, 1, 2, 2], [same] * 4) == [(1, 3), (2, 3)]
    assert found([1, 1, 2, 2], [same, same, other, other]) == []


def test_shingle_bits_keep_pairs_in_reach(spark):
    rng = random.Random(29)
    length = passages.PASSAGE_WORDS - passages.SHINGLE + 1
    for n in (0, 1, 7, 400):
        x = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        assert passages.in_bits(x, passages.shingle_bits(x)).all()
    passage, chance = words(rng, 50, 10 ** 6), words(rng, 20, 10 ** 6)
    texts = [" ".join([*words(rng, before, 10 ** 6), *p, *words(rng, 60, 10 ** 6)]) for before, p in ((40, passage), (400, passage), (30, chance), (90, chance))]
    docs = frame(spark, texts)
    pairs = spark.createDataFrame([(0, 1, [(60, 420)]), (1, 0, [(420, 60)]), (2, 3, [(35, 95)])], "a long, b long, anchors " + passages.ANCHORS)
    left = passages.pairs_in_reach(passages.shipped_pairs(pairs, docs), docs, passages.PASSAGE_WORDS, passages.SIMILARITY)
    assert {(r.stay, r.go, r.a_stays) for r in left.collect()} == {(1, 0, False), (1, 0, True)}  # one shared line of 20 words is no passage
    links = {(r.a, r.b, r.a_to - r.a_from >= length) for r in passages.verified_links(left, docs, passages.PASSAGE_WORDS, passages.SIMILARITY).collect()}
    assert links == {(0, 1, True), (1, 0, True)}


def test_sifted_pairs_of_repeated_rows_stay_one_pair(spark):
    rng = random.Random(31)
    passage = words(rng, 60, 10 ** 6)
    texts = [" ".join([*words(rng, n, 10 ** 6), *passage]) for n in (20, 200)]
    docs = frame(spark, [texts[0], texts[0], texts[1], texts[1]], ids=[1, 1, 2, 2])
    pairs = spark.createDataFrame([(1, 2, [(40, 220)])], "a long, b long, anchors " + passages.ANCHORS)
    left = passages.pairs_in_reach(passages.shipped_pairs(pairs, docs), docs, passages.PASSAGE_WORDS, passages.SIMILARITY)
    assert [(r.stay, r.go, r.a_stays, [tuple(x) for x in r.anchors]) for r in left.collect()] == [(2, 1, False, [(40, 220)])]


def test_passages_leave_no_shuffle_files(spark, docs):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {str(b) for b in blocks.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = shuffled()
    classes, links = passages.near_duplicate_passages(docs)
    for _ in range(20):  # Spark drops them in the background
        if not shuffled() - before:
            break
        time.sleep(0.5)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") != "true"
    first = sorted(map(tuple, classes.collect()))
    assert first == sorted(map(tuple, classes.collect())) and links.count() > 0


def test_passages_empty_table(spark, docs):
    classes, links = passages.near_duplicate_passages(docs.limit(0))
    assert classes.count() == 0 and links.count() == 0


# 5 quality --------------------------------------------------------------------------------------------------------

def test_quality_base_counts(spark, docs):
    out = by_id(quality.quality_rules(docs))
    texts = corpus()
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_quality_divergence_value(spark):
    df = spark.createDataFrame([([1, 2, 0, 5], [3, 3, 1, 1])], "p array<int>, q array<int>")
    got = df.select(quality.divergence(F.col("p"), F.col("q")).alias("d")).first()["d"]
    p, q = np.array([1, 2, 0, 5]) / 8, np.array([3, 3, 1, 1]) / 8
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_quality_word_histogram(spark):
    df = spark.createDataFrame([(["The", "the", "of", "zzz", "of", "the"], "en"), (["der"], "xx")], "w array<string>, lang string")
    rows = [r["h"] for r in df.select(quality.word_histogram(F.col("w"), F.col("lang")).alias("h")).collect()]
    listed = list(dict.fromkeys(quality.COMMON_WORDS["en"].split()))
    assert rows[0][listed.index("the")] == 3 and rows[0][listed.index("of")] == 2 and rows[0][-1] == 1 and sum(rows[0]) == 6
    assert rows[1] is None


# 6 repeats --------------------------------------------------------------------------------------------------------

def removed_brute(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            w = b[k:k + 100]
            if w in seen:
                mark[k:k + 100] = True
            seen.add(w)
        runs = int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum())
        out[i] = (len(b), int(mark.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest())
    return out


def edges():
    """Texts whose shared stretches start and end at every place around 100 bytes."""
    rng = random.Random(9)
    letters = "abcdefgh"
    core = "".join(rng.choice(letters) for _ in range(180))
    random_text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [random_text(40) + core[a:b] + random_text(60) for a, b in
             [(0, 180), (0, 99), (0, 100), (0, 101), (30, 130), (31, 160), (79, 180), (80, 180), (81, 180), (10, 140), (40, 160)] * 2]
    texts += ["ab" * 300, "ab" * 60, "x" * 99, "x" * 100, "x" * 101, "x" * 400, core + core, core[:120] * 3]
    return texts


@pytest.mark.parametrize("texts", [corpus(), edges()], ids=["corpus", "edges"])
def test_repeats_match_brute_force(spark, texts):
    out = by_id(repeats.removal_digests(repeats.remove_repeats(frame(spark, texts))))
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in out.items()}
    assert got == removed_brute(texts)


def test_repeats_odd_rows(spark, docs):
    t = "y" * 30 + "".join(random.Random(2).choices("abc", k=200))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.removal_digests(repeats.remove_repeats(df)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 230)]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 20])
@pytest.mark.parametrize("texts", [corpus(), edges()], ids=["corpus", "edges"])
def test_repeats_in_small_groups_match_brute_force(spark, texts, most):
    out = by_id(repeats.removal_digests(repeats.remove_repeats(frame(spark, texts), most)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in out.items()} == removed_brute(texts)


def test_hot_line_in_unlike_surroundings_is_held_in_parts(spark):
    rng, most = random.Random(12), 25
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    line, near = letters(80), [letters(30) for _ in range(6)]
    texts = [letters(150) + rng.choice([letters(30), *near])[:30] + line + rng.choice([letters(30), *near]) + letters(150) for _ in range(300)]
    docs = frame(spark, texts)
    spots = repeats.document_spots(repeats.repeated_blocks(repeats.document_blocks(docs))).cache()
    small, large = repeats.parted_halves(spots, docs, most)
    assert large.count() > 300
    assert all(r["count"] <= most for r in small.groupBy("key").count().collect())
    out = by_id(repeats.removal_digests(repeats.remove_repeats(docs, most)))
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in out.items()}
    assert got == removed_brute(texts)
    assert sum(r[1] for r in got.values()) > 0


def test_maximal_repeats_have_all_occurrences():
    texts = [b"Xabcdefgh1", b"Yabcdefgh2", b"Zabcdefg", b"abcdefgh"]
    found = repeats.maximal_repeats(np.zeros(4, int), np.arange(4), np.zeros(4, int), texts, 5)
    groups = {(n, tuple(zip(d, s, strict=True))) for n, d, s in found}
    assert (8, ((0, 1), (1, 1), (3, 0))) in groups and (7, ((0, 1), (1, 1), (2, 1), (3, 0))) in groups
    assert all(n >= 7 for n, _ in groups)  # inner repeats are not left-diverse


# 7 packing --------------------------------------------------------------------------------------------------------

def test_packing_round_trip(spark, docs):
    texts = corpus() + ["<|endoftext|> in text", "tab\there  two lines", "it's we're 's", " lead and trail ", "w " * 3000]
    out = packing.pack_documents(frame(spark, texts), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        joined = b"".join(bytes(r["token_ids"]) for r in mine)
        assert joined == struct.pack(f"<{len(ids)}I", *ids)
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine])[:-1])
        assert all(r["length"] == 1024 for r in mine[1:])
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0), TOKENIZER).count() == 0


def test_open_bins_bound_and_choice():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the fuller one takes it and is closed
    assert bins.place(5) == (2, 0) and bins.open == 2
    assert bins.place(9) == (3, 0) and bins.open == 2  # the fullest, sequence 0, was closed
    assert bins.place(5) == (2, 5) and bins.place(1) == (3, 9) and bins.open == 0


# 8 personal data --------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def personal():
    rng = random.Random(8)
    bits = ["a.b@c.de", "x@y.z_q@r.st", "a@b", "@@a@b.c.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.03.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "41111111111111111111111", "+1 (555) 123-4567", "+12", "++49 30 1234567 ", "+1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6.7", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
            "é", "\n", "word", "3782 822463 10005", "🙂", "tel 555-123-4567", "9" * 30, "a" * 50, "+", ".", "-", "key: AbCdEf0123456789AbCdEf"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randrange(1, 40))) for _ in range(120)] + ["", None, "x@y.zz " * 300]


def test_personal_data_base_spans(spark):
    texts = personal()
    found = pii.find_personal_data(frame(spark, texts), "doc_id")
    out = by_id(pii.span_digests(found))
    for i, t in enumerate(texts):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t or "") if base_ok(k, m.group())]
        r = out[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [x for x in r["spans"].split(",") if x][:len(want)] == want
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k + ":") for x in want) for k in BASE]
    assert pii.find_personal_data(frame(spark, texts).limit(0), "doc_id").count() == 0


def test_personal_data_classifier_and_redaction(spark):
    rng = random.Random(3)
    texts = [" ".join(words(rng, 20)) + (f' token = "{rng.getrandbits(160):040x}" and {i}.b@c.de' if i % 3 == 0 else f" version_20240101_{i}") for i in range(150)]
    found = pii.find_personal_data(frame(spark, texts), "doc_id")
    out = by_id(found)
    for i, t in enumerate(texts):
        added = [t[c["start"]:c["end"]] for c in out[i]["added"] if c["kind"] == "secret"]
        assert (len(added) == 1 and len(added[0]) == 40) if i % 3 == 0 else not added
    text = {r["doc_id"]: r["text"] for r in pii.redacted(found, "doc_id").collect()}
    assert text[0].endswith('token = "[SECRET]" and [EMAIL]') and text[1] == texts[1]


def test_reliability_estimates_tell_labelers_apart():
    rng = random.Random(7)
    counts = collections.Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        counts[sum(1 << i for i, right in enumerate((0.95, 0.9, 0.9, 0.6, 0.5)) if (rng.random() < right) == y)] += 1
    post = pii.estimate_reliability(dict(counts))
    assert post[0b00111] > 0.95 and post[0] < 0.05 and post.get(0b10000, 0) < 0.2


# 9 near duplicates ------------------------------------------------------------------------------------------------

def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    a = collections.Counter({int(x): int(rng.integers(1, 9)) for x in rng.integers(0, 2**60, 300)})
    b = a.copy()
    for x in list(a)[:60]:
        b[x] = int(rng.integers(1, 9))
    for x in list(a)[60:80]:
        del b[x]
    number = np.r_[np.zeros(sum(a.values()), int), np.ones(sum(b.values()), int)]
    shingles = np.array([k for c in (a, b) for k, v in c.items() for _ in range(v)], np.uint64)
    s = near_dup.bag_minhash(number, shingles, 2, 8192)
    assert abs((s[0] == s[1]).mean() - near_dup.weighted_jaccard(a, b)) < 0.02


def near_texts():
    rng = random.Random(12)
    texts = corpus(12)
    base = words(rng, 400)
    for k in range(30):
        t = list(base)
        for _ in range(k % 12):
            t[rng.randrange(len(t))] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(t))
    return texts


def test_near_duplicates_match_brute_force(spark):
    texts = near_texts()
    out = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    counts = [near_dup.shingle_counts(t or "") for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if counts[i] and near_dup.weighted_jaccard(counts[i], counts[j]) >= 0.8]
    assert [out[i] for i in range(len(texts))] == components(len(texts), pairs)


def test_near_duplicates_odd_rows(spark, docs):
    t = " ".join(words(random.Random(1), 90))
    df = spark.createDataFrame([(7, t), (7, t), (9, t), (None, t), (11, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(0, None), (7, 7), (7, 7), (9, 7), (11, 11)]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_links_across_classes_of_a_block():
    texts = [t or "" for t in near_texts()]
    counts = [near_dup.shingle_counts(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if counts[i] and near_dup.weighted_jaccard(counts[i], counts[j]) >= 0.8]
    links = near_dup.links_across(list(range(len(texts))), list(range(len(texts))), texts, 0.8)
    assert components(len(texts), links) == components(len(texts), pairs)
    assert len(links) < len(texts)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame(pairs, "a long, b long")
    out = {r["id"]: r["class_id"] for r in connected_components(df).collect()}
    want = components(500, pairs)
    assert out == {i: want[i] for p in pairs if p[0] != p[1] for i in p}


# 10 decontamination -----------------------------------------------------------------------------------------------

NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(t):
    return NORMAL.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination_matches_brute_force(spark, block):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randrange(1, 30), 40))) for i in range(12)] + [(20, "Short, ITEM!"), (21, ""), (22, None), (23, "ÜBER straße")]
    texts = []
    for _ in range(40):
        i, t = rng.choice(items[:12])
        w = t.split()
        texts.append(" ".join(words(rng, 12, 40)) + " -- " + ", ".join(w[rng.randrange(len(w)):]).upper() + "\n" + t[:-1] + " " + " ".join(words(rng, 9, 40)))
    texts += ["a short item here", "shortitem", "Über straße", "über straße", "", None, items[0][1], items[0][1] + " " + items[0][1], "x " * 50_000 + "short ITEM"]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items] + [(0, items[0][1], "c")], "item_id long, text string, doc_id string")
    df = frame(spark, texts)
    found = decontaminate.find_contamination(df, bench, max_windows=block)
    spans = by_id(found)
    out = by_id(decontaminate.contamination_digests(found))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = low_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k:k + n])].add(str(i))
    for i, t in enumerate(texts):
        w, hit, named = low_words(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    named |= ids
        r = out[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(named), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert sum(len(low_words(t[s["start"]:s["end"]])) for s in spans[i]["spans"]) == len(hit)
    assert decontaminate.find_contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0
