"""Brute-force and edge-case tests of language identification, the prefix trie and ranked search."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, query string, item long, score string"


def _doc(i, text, lang="en"):
    return (i, text, lang, None, 1, "x", "q", 3, "s")


# --- language identification ----------------------------------------------------

def test_automaton_reads_exactly_the_substrings():
    from shelfscan.llm.language_id import suffix_automaton

    rng = random.Random(3)
    for _ in range(30):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))]
        follow = suffix_automaton(text)
        assert len(follow) <= 2 * len(text) + 1
        subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}

        def reads(word):
            state = 0
            for c in word:
                if c not in follow[state]:
                    return False
                state = follow[state][c]
            return True
        assert all(reads(s) for s in subs)
        for _ in range(200):
            word = tuple(rng.randint(1, 4) for _ in range(rng.randint(1, 6)))
            assert reads(word) == (word in subs)


def _naive_phrases(sample, text, window):
    """Cross parsing by searching the sample's text."""
    n = 0
    for at in range(0, len(text), window):
        piece, i = text[at:at + window], 0
        while i < len(piece):
            k = 0
            while i + k < len(piece) and piece[i:i + k + 1] in sample:
                k += 1
            i += max(k, 1)
            n += 1
    return n


def test_phrases_equal_a_search_of_the_sample():
    from shelfscan.llm import language_id as li

    samples = {"a": ["the cat sat on the mat, the cat"], "b": ["le chat est sur le tapis; le chat"]}
    model = li.Model(samples).prepare()
    texts = ["The CAT sat", "le chat est zzz", "", "?!", "é" * 1_300 + "mat" * 400, "the"]
    points = [li._points(t) for t in texts]
    symbols, ends = model.reader.symbols(np.concatenate(points), np.cumsum([len(p) for p in points]))
    got = model.phrases(symbols, ends)
    starts = np.concatenate([[0], ends[:-1]])
    for l, k in enumerate(model.languages):
        sample, _ = model.reader.symbols(np.append(li._points(samples[k][0]), 32).astype(np.uint32), np.array([len(samples[k][0]) + 1]))
        sample = "".join(map(chr, sample))
        for t, (a, b) in enumerate(zip(starts, ends)):
            assert got[t, l] == _naive_phrases(sample, "".join(map(chr, symbols[a:b])), li.WINDOW)
    langs, score, _ = model.judge(texts)
    assert langs[:4] == ["a", "b", "und", "und"] and langs[5] == "a" and list(score[2:4]) == [0, 0]


def test_languages_of_held_out_texts(spark):
    from shelfscan.llm.language_id import language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_learns_from_the_others_only(spark):
    """Labels of held-out rows, ids and sources change nothing; empty texts are undetermined."""
    from shelfscan.llm.language_id import language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    strip = lambda df: sorted(tuple(r) for r in language_id(df).collect())
    assert strip(docs) == strip(changed)
    odd = spark.createDataFrame([_doc(1, None), _doc(2, ""), _doc(3, "12 ?! 34"), _doc(4, "hello world " * 20, None), _doc(None, "some text here"),
                                 _doc(1, None), _doc(6, "the word and the text " * 40_000), _doc(7, "日本語のテキスト", "ja"), _doc(8, "the text is here")], DOCS)
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in language_id(odd).collect()))
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, "und"), (1, "und"), (2, "und"), (3, "und")]
    assert len(got) == 9 and (6, "en") in got
    none = language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert language_id(odd.limit(0)).count() == 0


# --- prefix trie -----------------------------------------------------------------

def _trie(rows):
    """Nodes of the rebuilt conversations, straight from the definition."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: tuple(t for _, t in sorted(v, key=lambda x: x[0])) for c, v in convs.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        rebuilt[c] = turns.get(base, ())[:h] + turns[c][h:]
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in kids)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(rebuilt[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children.get(node, [])), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, depth string, conv string, at string"


def _compare(spark, rows):
    from shelfscan.llm.prefix_trie import prefix_trie

    frame = spark.createDataFrame([(*r, "d", "c", "a") for r in rows], TURNS).repartition(5)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in prefix_trie(frame).select(*TRIE).collect()), key=key)
    assert got == sorted(_trie(rows), key=key)


def _random_rows(seed, convs, texts, most):
    rng = random.Random(seed)
    rows = []
    for c in range(-3, convs):
        shared = rng.random() < 0.4
        for t in range(1, rng.randint(1, most) + 1):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if not shared else "user", f"same {t}" if shared else rng.choice(texts)))
    return rows


def test_trie_of_random_conversations(spark):
    rows = _random_rows(1, 60, ["a", "b", "é", "", None, "longer text"], 10)
    rows += [(7, None, "user", "first"), (7, None, None, "first too"), (7, 3, "x", "tie"), (7, 3, "x", "tie"), (7, 3, "y", "tie")]
    rows += [(None, 1, "user", "nobody's"), (200, 1, "user", "same 1"), (203, 1, "user", "same 1")]
    _compare(spark, rows)
    _compare(spark, [])
    _compare(spark, [(4, 1, "u", "only")])


def test_trie_in_many_shards_with_spilled_queues(spark, monkeypatch):
    """One long conversation and its copies, a hot first turn; shards, queues and pieces as small as they can be."""
    from shelfscan.llm import prefix_trie as p

    for name, value in (("SHARD_TURNS", 6), ("SHARES", 1 << 40), ("PIECE", 12), ("MARKED", 3)):
        monkeypatch.setattr(p, name, value)
    monkeypatch.setattr(p.SpillingQueue.__init__, "__defaults__", (2,))
    rows = _random_rows(2, 80, ["a", "b"], 5)
    for c in (300, 301, 305, 310, 401):
        rows += [(c, t, "user", f"turn {t}") for t in range(150)]
    for c in range(500, 560):
        rows.append((c, 1, "user", "hot"))
    _compare(spark, rows)


def test_spilling_queue_gives_items_in_order():
    from shelfscan.llm.prefix_trie import SpillingQueue

    rng, queue, held = random.Random(5), SpillingQueue(7), []
    for _ in range(600):
        if held and rng.random() < 0.45:
            held.sort()
            assert queue.peek() == held[0] and queue.pop() == held.pop(0)
        else:
            item = (rng.randint(0, 50), rng.randint(0, 5))
            held.append(item)
            queue.push(item)
    assert [queue.pop() for _ in held] == sorted(held) and queue.peek() is None


# --- ranked search ------------------------------------------------------------------

def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranked(docs, items, k=20):
    lists = [(i, _terms(t)) for i, t in docs]
    lists = [(i, t) for i, t in lists if t]
    n, total = len(lists), sum(len(t) for _, t in lists)
    df = {}
    for _, t in lists:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, []).extend(_terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, t in lists:
            m = 75 + 25 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 12 * m)) for w in words if w in df)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def _search(spark, docs, items):
    from shelfscan.llm.lexical_search import ranked_search

    d = spark.createDataFrame([_doc(i, t) for i, t in docs], DOCS).repartition(4)
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, n long")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in ranked_search(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=key)
    assert got == sorted(_ranked(docs, items), key=key)


def test_ranked_search_against_brute_force(spark, monkeypatch):
    from shelfscan.llm import lexical_search as ls

    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["été", "Éa", "日本", "X9", "the", "The"]
    docs = [(i, " ".join(rng.choice(words[:rng.randint(5, len(words))]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (400, None), (401, "?! ."), (402, "the " * 4_000 + "rare"), (403, "w1 " * 900)]
    docs += [(1_000 + i, "w7 copy of one text w8 w9") for i in range(150)]  # copies: equal scores, by id
    items = [(1, "w7 w8 copy"), (2, "The été THE w1 w1"), (3, "absent words only"), (4, None), (5, "日本 X9; w59"), (5, "rare"), (None, "w2 w3"), (6, "")]
    _search(spark, docs, items)
    for name, value in (("SEGMENT_BYTES", 300), ("BLOCK_TERMS", 4), ("_EXACT", 1), ("SEGMENTS_A_FILE", 2)):
        monkeypatch.setattr(ls, name, value)
    _search(spark, docs, items)
    _search(spark, [], items)
    _search(spark, docs, [])


def test_strata_beyond_the_bound_are_not_visited():
    from shelfscan.llm import lexical_search as ls

    rng = np.random.default_rng(3)
    words = [rng.integers(1, 40, n).astype(np.uint64) for n in range(1, 200)]
    words[3] = np.full(4, 50, np.uint64)
    seg = ls.segment(list(range(len(words))), words, len(words), sum(map(len, words)))
    best = [ls._Best(1)]
    visited = ls.search_segment(seg, np.array([50], np.uint64), [(np.array([0]), np.array([1_000]))], best)
    assert visited == 1 and best[0].id.tolist() == [3]
    best = [ls._Best(3)]
    visited = ls.search_segment(seg, np.arange(1, 40).astype(np.uint64), [(np.arange(3), np.full(3, 900))], best)
    assert visited < len(seg["m"]) and len(best[0].id) == 3


def test_each_query_without_sql_has_a_test_here():
    import __spark_entry__ as entry
    from shelfscan.llm.queries import ORACLE_SQL, QUERIES

    told = {"op1_fingerprints", "op3_toxicity", "op4_token_shards", "op5_site_quality", "op6_byte_bpe", "op7_html_text", "op10_packing", "op11_language_id"}
    assert set(QUERIES) - set(ORACLE_SQL) == told and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_ranked_search"])
def test_queries_equal_their_sql(spark, name):
    import pathlib
    import sys

    sys.path.insert(0, str(pathlib.Path(__file__).parents[2] / "tools"))
    import __spark_entry__ as entry
    from oracle_check import compare, duck

    ok, message, _, _ = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


# --- main text: what is one block, and what stands around a page ---------------------

@pytest.mark.parametrize("html, want", [
    ("<p>A<script>x()</script>B</p>", "AB"), ("<p>A <button>press</button> B</p>", "A B"), ("<p>A <svg><text>t</text></svg>B</p>", "A B"),
    ("<p>A <iframe src=x>no</iframe>B", "A B"), ("<p>A <picture><img src=a></picture> B</p>", "A B"), ("<p>A <label>l</label> B</p>", "A l B"),
    ("<p>A <acronym>HTML</acronym> <nobr>one line</nobr> <x-tip>own</x-tip> B</p>", "A HTML one line own B"), ("<p>A <math><mi>x</mi></math>B</p>", "A B"),
    ("<p>A<div>B</div>C", "A\n\nB\n\nC"), ("<p>A<ul><li>B<li>C</ul>D", "A\n\nB\n\nC\n\nD"), ("<p>A<p>B<hr>C", "A\n\nB\n\nC"),
    ("<x-page><p>A</p><p>B</p></x-page>", "A\n\nB"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("<p>A<wbr>B<br>C &amp; &eacute;</p>", "AB C & é"),
    ("<form action=x><div><p>A long text</p><input><p>and more of it</p></div></form>", "A long text\n\nand more of it"),
    ("<p>A text that is longer</p><form><p>mail</p><button>go</button></form>", "A text that is longer"),
    ("<noscript><p>A page without scripts</p></noscript><p>x</p>", "A page without scripts\n\nx"), ("<p>The text</p><dialog>ok?</dialog><object>alt</object>", "The text"),
])
def test_blocks(html, want):
    from shelfscan.llm import html_text as h

    assert h.extract(f"<html><body>{html}</body></html>", h.no_model()) == want


def test_states_are_the_likeliest_of_all(spark):
    """Decoding against every choice of states that keeps ancestors and descendants in accord."""
    import itertools

    from shelfscan.llm import html_text as h

    rng = np.random.default_rng(1)
    for html in ("<div><p>a</p><div><p>b</p>c</div></div><p>d</p>", "<div>x<p>a</p>y<p>b</p></div>", "<ul><li>a<li>b<ul><li>c</ul></ul>"):
        page = h.Page(h.parse(html))
        page.features()
        n = len(page.nodes)
        for _ in range(5):
            odds = rng.normal(0, 2, n)
            log = {"in": -np.logaddexp(0, -odds), "out": -np.logaddexp(0, odds), "mixed": np.full(n, np.log(0.5))}
            best, chosen = -np.inf, None
            for states in itertools.product(("in", "out", "mixed"), repeat=n):
                if any(s == "mixed" and not page.kids[i] for i, s in enumerate(states)):
                    continue
                if any(up >= 0 and states[up] != "mixed" and states[i] != states[up] for i, up in enumerate(page.parents)):
                    continue
                value = sum(log[s][i] for i, s in enumerate(states))
                if value > best + 1e-12:
                    best, chosen = value, states
            assert [s == "in" for s in chosen] == h.decode(page, odds).tolist()


# --- fingerprints, site shares, packing ------------------------------------------------

def test_likeness_is_that_of_the_returned_fingerprints(spark):
    """Fingerprints of whole and edited texts by the definition, and near_* from the two strings alone."""
    from shelfscan.llm import fingerprint as f

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    terms = lambda t: {w for w in _terms(t)}
    counts = {}
    for _, t in texts:
        for w in terms(t):
            counts[w] = counts.get(w, 0) + 1
    band = {w for w, n in counts.items() if f.MIN_SHARE * len(texts) <= n <= f.MAX_SHARE * len(texts)}
    got = {r["doc_id"]: r for r in f.edit_likeness(docs).collect()}
    kept = {}
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        r = got[i]
        own, edited = f.Print.of(r["fingerprint"]), f.Print.of(r["edited_fingerprint"])
        assert r["near_edited"] == f.likeness(own, edited)
        assert r["near_next"] == f.likeness(own, f.Print.of(got[texts[(texts.index((i, t)) + 1) % len(texts)][0]]["fingerprint"]))
        for text, shown in ((t, r["fingerprint"]), (t[:len(t) - half] + after[:half], r["edited_fingerprint"])):
            found = terms(text)
            key = frozenset(found & band or found)
            assert kept.setdefault(key, shown) == shown  # equal lexicon terms, equal fingerprints
    assert len(set(kept.values())) == len(kept)  # others differ


def test_a_document_is_no_witness_of_its_own_site(spark):
    """Shares of hosts and paths, by hand, without the document itself."""
    from shelfscan.llm import site_quality as q

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").withColumn("__host", F.lit("x")).withColumn("__good", F.lit(1))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = q.fit(docs, labels)
    rows = [r.asDict() for r in q.judge(docs.drop("__host", "__good"), model).collect()]
    own = {r["doc_id"]: 1 / (1 + math.exp(-r["__evidence"]) * ((1 - model.share) / model.share)) for r in rows}
    for r in rows:
        host = [own[o["doc_id"]] for o in rows if o["source"] == r["source"] and o is not r]
        path = [own[o["doc_id"]] for o in rows if (o["source"], o["lang"]) == (r["source"], r["lang"]) and o is not r]
        host_share = (sum(host) + model.host_strength * model.overall) / (len(host) + model.host_strength)
        path_share = (sum(path) + model.path_strength * host_share) / (len(path) + model.path_strength)
        assert abs(r["__host_share"] - host_share) < 1e-9 and abs(r["__path_share"] - path_share) < 1e-9
        odds = math.exp(r["__evidence"]) * path_share / (1 - path_share)
        assert abs(r["__posterior"] - odds / (1 + odds)) < 1e-9


def test_every_piece_goes_into_the_fullest_bin_that_it_fits():
    """Replays the plan piece by piece: best fit among open bins, the cheapest capacity where none is left, least final size."""
    from shelfscan.llm import packing as p

    rng = np.random.default_rng(2)
    for capacities in ((8,), (4, 16), (5, 12, 32)):
        for _ in range(40):
            histogram = {int(n): int(rng.integers(1, 9)) for n in rng.choice(np.arange(1, max(capacities) + 1), rng.integers(1, max(capacities) + 1), replace=False)}
            plan = p.plan(histogram, capacities)
            rows = sorted(zip(-plan.length, plan.rank, plan.bin, plan.per_bin, plan.offset))
            sizes, room = [], []  # of all bins opened so far
            for at, (length, rank, first, per, offset) in enumerate(rows):
                length = -length
                after = rows[at + 1][1] if at + 1 < len(rows) and rows[at + 1][0] == -length else histogram[length]
                for place in range(rank, after):
                    bin_, fitting = int(first + (place - rank) // per), [r for r in room if r >= length]
                    if not fitting:
                        left = histogram[length] - place
                        opened = p._least_cost(length, left, sum(n * k for n, k in histogram.items() if n < length), sorted(capacities))
                        count = -(-left // (opened // length))
                        sizes, room, fitting = sizes + [opened] * count, room + [opened] * count, [opened]
                    assert room[bin_] == min(fitting)
                    room[bin_] -= length
            for b, capacity in enumerate(sizes):
                at = int(np.searchsorted(plan.bin_first, b, "right")) - 1
                held = capacity - room[b]
                assert room[b] >= 0 and plan.bin_used[at] == held and plan.bin_capacity[at] == min(c for c in capacities if c >= held)


def test_documents_without_tokens_stay(spark):
    from shelfscan.llm.packing import pack

    docs = spark.createDataFrame([(1, 5), (2, 0), (3, None), (4, 20), (5, -1)], "doc_id long, n long")
    got = sorted(((r["doc_id"], r["piece"], r["n_tokens"], r["bin_id"] is None) for r in pack(docs, (8, 16), tokens=F.col("n")).collect()))
    assert got == [(1, 0, 5, False), (2, 0, 0, True), (3, 0, 0, True), (4, 0, 16, False), (4, 1, 4, False), (5, 0, 0, True)]


# --- pipeline ---------------------------------------------------------------------------

def test_pipeline_with_nulls_repeats_and_long_texts(spark, tmp_path):
    """Every stage on its own input: columns kept, nothing invented, one of each group of near copies, all tokens packed."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.orderBy("doc_id").collect()
    clean = max((r for r in base if r["lang"] == "en" and r["text"]), key=lambda r: (600 < len(r["text"]) < 900, -r["doc_id"]))
    words = clean["text"].split()
    near = " ".join(w if i != len(words) // 2 else "changed" for i, w in enumerate(words))
    odd = [(900_001, None, None, None, None), (900_002, "", "en", "web", 0), (900_003, clean["text"], "en", clean["source"], 1), (900_004, near, "en", clean["source"], 1),
           (900_005, clean["text"] * 40, "en", "web", 1), (base[0]["doc_id"], base[0]["text"], base[0]["lang"], base[0]["source"], base[0]["n_chars"]), (None, "a text without an id", "en", "web", 1)]
    spark.createDataFrame([tuple(r) for r in base] + odd, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns
        given, rows = [tuple(r) for r in before.collect()], [tuple(r) for r in after.collect()]
        count = {r: given.count(r) for r in rows}
        assert all(rows.count(r) <= n for r, n in count.items())
        if name == "ngram_jaccard":
            kept = {r[0] for r in rows}
            assert 900_004 not in kept and len({clean["doc_id"], 900_003} & kept) <= 1 and (clean["doc_id"] in kept or clean["doc_id"] not in {r[0] for r in given})
        before = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").split()) + 1) for r in rows)
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert sum(total.values()) == sum(n for _, n in want) and set(total) == {r[0] for r in rows}
