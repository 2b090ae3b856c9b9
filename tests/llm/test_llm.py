"""Brute-force, round-trip and edge-case tests of the training-data operators."""

import hashlib
import importlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
P = importlib.import_module("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, place string, ids string"
LONG = "word " * 30_000 + "x" * 5_000 + "\n\n \t end's"


def _rows():
    texts = [None, "", " \n\t ", "one", "One", "a b c d", "A B  c\nd", "x" * 3_000, LONG, LONG, "it's  a   test\n\n of  spaces",
             "日本語 текст ÀÉ ß 😀 don't", "l1 l2 l3 l4 l5 l6 l7 l8 l9 l10 l11 l12 l13 l14 l15 l16 l17 l18 l19 l20 l21",
             "l1 l2 l3 l4 l5 l6 l7 l8 l9 l10 l11 l12 l13 l14 l15 l16 l17 l18 l19 l20 other", "<|endoftext|> is text"]
    rows = [(i, t, "en", "s" if i % 2 else None, 1, "x", 7, "p", "q") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _whole(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def _next(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], (r[1] or "")))
    return [(a, b) for a, b in zip(rows, rows[1:] + rows[:1])]


# --- 1 -------------------------------------------------------------------------

def test_edited_texts_and_equal_fingerprints(spark, docs, empty):
    from shelfscan.llm.fingerprint import edit_likeness

    for table in (docs.select("doc_id", "text"), _whole(spark, "documents").select("doc_id", "text")):
        rows = [tuple(r) for r in table.collect()]
        want = sorted((str(a[0]), len(a[1] or ""), hashlib.sha256(((a[1] or "")[:len(a[1] or "") - len(a[1] or "") // 2] + (b[1] or "")[:len(a[1] or "") // 2]).encode()).hexdigest())
                      for a, b in _next(rows))
        got = edit_likeness(table).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want
        text = {r[0]: r[1] or "" for r in rows}
        prints = {}
        for r in got:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] > r["near_next"] for r in got if r["n_chars"] > 200]) > 0.9
    assert edit_likeness(empty).count() == 0
    one = edit_likeness(docs.filter("doc_id = 3")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"ono").hexdigest()


def test_lexicon_is_the_band(spark):
    from shelfscan.llm.fingerprint import distinct_terms, lexicon
    import pyarrow as pa

    texts = [f"all w{i % 3} only{i}" for i in range(12)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    band = lexicon(table, max_share=0.5, min_share=0.2)
    assert sorted(band) == sorted(h for h in next(distinct_terms(pa.array(["w0 w1 w2"]))))


# --- 2 -------------------------------------------------------------------------

def _links(rows):
    proper = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i, _ in proper}
    for (i, a), (j, b) in itertools.combinations(proper, 2):
        a, b = np.array(a, float), np.array(b, float)
        if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
            near[i].add(j)
            near[j].add(i)
    return near


def _component(near, i):
    seen, todo = {i}, [i]
    while todo:
        for j in near.get(todo.pop(), ()):
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return min(seen)


def test_embedding_links_match_brute_force(spark):
    from shelfscan.llm.rotation_codes import embedding_components

    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    rows = [(i, (base[i % 40] + rng.standard_normal(32) * 0.12).tolist()) for i in range(200)]
    rows += [(200 + i, base[0].tolist()) for i in range(30)]
    rows += [(300, None), (301, []), (302, [0.0] * 32), (303, [float("nan")] * 32), (304, [None] + [1.0] * 31), (305, [float("inf")] * 32), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [-1.0, -2.0])]
    table = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, id long, code string")
    near = _links([(r[0], r[1]) for r in table.collect()])
    got = {r["vec_id"]: r for r in embedding_components(table).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"]) == (len(near.get(i, ())), _component(near, i))
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert embedding_components(table.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded(spark):
    from shelfscan.llm.rotation_codes import Bounds, rotations

    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rotations(64, 8)
    turned = x @ turn
    factors = (np.abs(turned.reshape(400, 8, 64)).sum(2) / 8).astype("<f4")
    bounds = Bounds((turned > 0).astype(np.uint8), factors, np.rint(x * 127).astype(np.int8), turn.astype(np.float32))
    a, b = np.arange(0, 400, 2), np.arange(1, 400, 2)
    estimate, true = bounds.of(a, b) - bounds.margin[a], (x[a] * x[b]).sum(1)
    assert abs((estimate - true).mean()) < 0.01 and (np.abs(estimate - true) < bounds.margin[a]).all()


def test_hot_bucket_is_compared_in_blocks(spark, monkeypatch):
    from shelfscan.llm import rotation_codes

    monkeypatch.setattr(rotation_codes, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(16) + rng.standard_normal(16) * 0.05).tolist()) for i in range(120)]
    got = rotation_codes.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["n_links"] for r in got} == {119} and {r["component_id"] for r in got} == {0}


# --- 3, 5 -----------------------------------------------------------------------

def test_toxicity_on_held_out_documents(spark, docs, empty):
    from shelfscan.llm.toxicity import toxicity

    rng = np.random.default_rng(4)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(rng.integers(30, 120))]
        if i % 4 == 0:
            for _ in range(6):
                words[rng.integers(len(words))] = ("zwyxqer", "hjovvic", "quixzot")[rng.integers(3)]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity(table.drop("toxic"), table.select("doc_id", "toxic")).join(table.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] for r in held if r["toxic"]]) > 0.9
    assert np.mean([r["predicted"] for r in held if not r["toxic"]]) < 0.02
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1), (4, 5)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        scored = toxicity(docs, known).collect()
        assert len(scored) == len(_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity(empty, labels).count() == 0


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    from shelfscan.llm import toxicity as t

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)) + (" zwyxqer" if i % 2 else ""), i % 2) for i in range(60)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    hot = next(i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 0)
    same = spark.createDataFrame([(hot, rows[hot][1])] * 500, "doc_id long, text string")
    taken, train = [], t.dictionaries
    monkeypatch.setattr(t, "dictionaries", lambda *parts: taken.append(parts) or train(*parts))
    models = [t.fit(d, labels) for d in (once, once.union(same))]
    assert taken[0] == taken[1] and np.array_equal(models[0].weights, models[1].weights)
    used = [(i, x, y) for i, x, y in rows if zlib.crc32(str(i).encode()) % 3 == 0]
    assert taken[0] == tuple([w for _, x, y in used if y == c for w in t.windows(x)] for c in (0, 1))
    long = spark.createDataFrame([(0, "a b c d e f " * 100_000, 0), (1, "z" * 50_000, 1)], "id long, text string, toxic int")
    ordinary, foul = t.sample_windows(long, 100_000)
    assert 80_000 < sum(map(len, ordinary)) < 120_000 and b"".join(foul).strip() == b"z" * 50_000 and max(map(len, foul)) == t.PIECE


def test_site_quality_on_held_out_documents(spark, docs, empty):
    from shelfscan.llm.site_quality import site_quality
    from shelfscan.llm.toxicity import remainder

    whole = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = site_quality(whole, labels, learn=remainder("doc_id") != 1).join(labels, "doc_id").filter(remainder("doc_id") == 1).collect()
    good, bad = ([r["keep"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    odd = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1), (4, 5)], "doc_id long, quality int")
    for known in (odd, odd.limit(0)):
        assert site_quality(docs, known).count() == len(_rows())
    assert site_quality(empty, odd).count() == 0


def test_sparse_sites_shrink(spark):
    from shelfscan.llm.site_quality import fit, judge

    good, bad = "Plain words of a calm text, with commas.", "$$$ ### %%% &&& !!! @@@ $$$ ###"
    rows = [(i, good if i % 10 else bad, "big", "a") for i in range(200)] + [(200 + i, bad if i % 10 else good, "foul", "a") for i in range(200)] + [(500, bad, "new", "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = table.select("doc_id", (F.col("text") == good).cast("int").alias("quality"))
    shares = {r["source"]: r["s"] for r in judge(table, fit(table, labels)).groupBy("source").agg(F.max("__path_share").alias("s")).collect()}
    assert shares["foul"] < shares["new"] < shares["big"]


# --- 4, 6 -----------------------------------------------------------------------

def test_token_shards_match_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    from shelfscan.llm.token_shards import lookup, new_folder, read_shards, write_shards

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for table in (docs.filter("doc_id is not null"), _whole(spark, "documents")):
        rows = sorted((r["doc_id"], r["text"] or "") for r in table.collect())
        start, want = 0, []
        for i, t in rows:
            ids = tok.encode(t, add_special_tokens=False).ids + [0]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        folder = new_folder(spark, "test-shards")
        write_shards(table, folder, path)
        assert sorted(tuple(r) for r in read_shards(spark, folder).collect()) == want
        some = {i: t for i, t in rows[::7]}
        found = {r["key"]: r["ids"] for r in lookup(spark, folder, [*some, 10**12]).collect()}
        assert {i: found[i] for i in some} == {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in some.items()} and 10**12 not in found
    for table, n in ((empty, 0), (docs, len(_rows()))):
        folder = new_folder(spark, "test-shards")
        write_shards(table, folder, path)
        assert read_shards(spark, folder).count() == n


def test_lookup_reads_the_files_of_its_keys(spark):
    import glob

    from shelfscan.llm import token_shards as t

    folder = t.new_folder(spark, "test-shards")
    table = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    t.write_shards(table, folder, P.path("byte_bpe_50k.json"))
    files = sorted(glob.glob(f"{folder.removeprefix('file:')}/part-*"))
    assert len(files) > 1 and {r["key"] for r in t.lookup(spark, folder, [0, 399, 10**12]).collect()} == {0, 399}
    with open(files[-1], "wb") as file:
        file.write(b"no segment")
    assert [r["key"] for r in t.lookup(spark, folder, [0]).collect()] == [0]
    assert t.lookup(spark, folder, [10**12]).count() == t.lookup(spark, folder, []).count() == 0


def test_perfect_hash_takes_every_slot_once():
    from shelfscan.llm.token_shards import Segment, build_hash, segment

    for n in (1, 2, 5, 1_000):
        keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
        assert sorted(build_hash(keys)[1]) == list(range(n))
        keys.sort()
        s = Segment(memoryview(segment(keys, [int(i % 7).to_bytes(2, "little") * (i % 3) for i in range(n)], 2)))
        assert all(len(s.get(int(k))) == i % 3 for i, k in enumerate(keys))


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (64, 16), (7, 4)])
def test_byte_bpe_round_trip(spark, docs, empty, chunk, overlap):
    from shelfscan.llm.byte_bpe import decode, encode, encoding

    ranks = P.path("byte_bpe_50k.tiktoken")
    enc = encoding(ranks, P.PATTERN)
    table = docs if chunk > 100 else docs.filter("length(text) < 5000 or text is null")
    got = decode(encode(table, ranks, P.PATTERN, chunk=chunk, overlap=overlap), ranks, P.PATTERN).collect()
    want = sorted((str(r["doc_id"]), enc.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in table.collect())
    assert sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert encode(empty, ranks, P.PATTERN).count() == 0


# --- 7, 8 -----------------------------------------------------------------------

PAGES = "page_id long, url string, html string, text string, host string"


def _by_advert_word():
    """A model by one feature: elements with a word of adverts are out, other nodes are in."""
    from shelfscan.llm import html_text as h

    own = 22 + list(h.WORDS).index("advert")
    return h.Model(np.array([[own, -1, -1]]), np.array([[0.5, 0, 0]]), np.array([[1, 0, 0]]), np.array([[2, 0, 0]]), np.array([[0.0, 2.0, -2.0]]))


def test_loose_text_beside_a_block_is_kept():
    from shelfscan.llm import html_text as h

    advert, cases = "<div class=ad>Buy this now</div>", {
        "<div class=content>Intro text<br>more{0}last <b>text</b></div>": "Intro text more\n\nlast text",
        "{0}before<div>{0}in the <script>no</script>middle</div>after": "before\n\nin the middle\n\nafter",
        "<div>one <a href=u>two {0} three</a> four{0}</div>": "one two\n\nthree four",
        "<table><tr><td>cell{0}rest</td><td>next</td></tr></table>": "cell\n\nrest next",
    }
    for page, text in cases.items():
        assert h.extract(page.format(advert), _by_advert_word()) == text
    page = h.Page(h.parse(f"<div>loose {advert} text</div>"))
    assert [n.tag for n in page.nodes] == ["#root", "div", h.LOOSE, "div", h.LOOSE] and page.features().shape == (5, h.FEATURES)


def test_places_among_many_siblings():
    from shelfscan.llm import html_text as h

    n = 400
    page = h.Page(h.parse("<div>" + "<p>x</p>" * (n - 1) + "<ul></ul></div>"))
    x = page.features()[2:]
    assert np.allclose(x[:, 6], np.arange(n) / n) and (x[:, 7] == n).all()
    assert np.allclose(x[:-1, 8], (n - 1) / n) and x[-1, 8] == 1 / n


def test_main_text_of_other_layouts(spark):
    from shelfscan.llm.html_text import main_text

    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id", "url", "html", "'x' as text", "'y' as host")
    a, b = ("Some long sentence of the article, with commas, that goes on for a while. " * 4).strip(), ("Another paragraph &amp; more of it, also rather long. " * 4).strip()
    body = f"<p>{a}<p>{b}<ul><li>First item of it.<li>Second item.</ul>"
    around = ("<header class=masthead><a href=/>Home</a><nav><ul><li><a>One</a><li><a>Two</a></ul></nav></header><div class='cookie-notice'><p>We use cookies, please agree to all of them now.</p></div>",
              f"<aside class=sidebar><h3>More</h3><p>{b}</p></aside><section id=comments><h2>Comments</h2><div class=comment><p>{a}</p></div><div class=comment><p>{b}</p></div></section><form><input><p>Write here</p></form><footer>&copy; legal</footer>")
    made = [(10_000 + i, "u", f"<html><body>{around[0]}{o}{body}{c}{around[1]}</body></html>", None, None)
            for i, (o, c) in enumerate([("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>")])]
    odd = [(20_000, None, None, None, None), (20_001, "u", "", None, None), (20_002, "u", "<p>", None, None), (20_003, "u", "<div>" * 3_000 + "deep", None, None), (20_003, "u", "</p></div><<a b=", None, None)]
    got = main_text(pages.union(spark.createDataFrame(made + odd, PAGES))).collect()
    assert len(got) == pages.count() + len(made) + len(odd)
    text = {r["page_id"]: r["text"] for r in got}
    want = "\n\n".join([a, b.replace("&amp;", "&"), "First item of it.", "Second item."])
    assert [text[r[0]] == want for r in made] == [True] * 3
    assert all(r["n_chars"] == len(r["text"]) for r in got) and text[20_000] == "" and text[20_001] == ""
    assert main_text(pages.limit(0)).count() == 0


def test_url_rules(spark):
    from shelfscan.llm.queries import URL_RULES
    from shelfscan.llm.url_rules import build_trie, judge_urls, match

    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://example.net/fr/", "http://net", "http://net/", "x://sub.example.com/de/y", "http://example.com/de", "http://w.org/fr/#a",
            "http://notexample.com/de/", "http://example.net:80/en/", "http:///en/", "http://org?/fr/", "http://a.net#/en/"]
    table = spark.createDataFrame([(i, u, "z", "t") for i, u in enumerate(urls)] + [(3, urls[3], None, None)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(table, URL_RULES).collect()}
    assert judge_urls(table, URL_RULES).count() == len(urls) + 1 and judge_urls(table.limit(0), URL_RULES).count() == 0
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2].split("#")[0].split("?")[0]
        host, path = rest.partition("/")[0].lower(), "".join(rest.partition("/")[1:])
        fits = [(len(h), len(p), h + p, v) for v, h, p in URL_RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        assert got[i] == (host, path, *(max(fits)[2:] if fits else (None, "allow")))
    trie = build_trie([("block", "a.b", "/x"), ("allow", "a.b", "/xy/"), ("allow", "b", "")])
    assert [match(trie, "c.a.b", p) for p in ("/x1", "/xy/z", "/q")] == [("a.b/x", "block"), ("a.b/xy/", "allow"), ("b", "allow")]


# --- 9, 10 ----------------------------------------------------------------------

def _sets(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split() if t is not None else []
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))]
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def _jaccard_components(rows):
    sets = _sets(rows)
    near = {i: set() for i in sets}
    for i, j in itertools.combinations(sets, 2):
        same = len(sets[i] & sets[j])
        if same and 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
            near[i].add(j)
            near[j].add(i)
    return {i: (len(sets[i]), _component(near, i)) for i in sets}


def _near_copies(seed, groups=3, copies=60, words=60):
    """Copies that are near their original but often not each other, so that chains and hubs occur."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for g in range(groups):
        base = [f"w{g}x{k}" for k in range(words)]
        for _ in range(copies):
            w = list(base)
            for k in rng.choice(words, rng.integers(0, 4), replace=False):
                w[k] = f"e{rng.integers(1 << 30)}"
            rows.append((n, " ".join(w[:words - rng.integers(0, 12)])))
            n += 1
    order = rng.permutation(n)
    return [(int(order[i]), t) for i, t in rows]


def test_ngram_components_match_brute_force(spark, docs, empty):
    from shelfscan.llm.ngram_join import first_of_each, ngram_components

    for rows in ([(r[0], r[1]) for r in _rows() if r[0] is not None][:-1], _near_copies(1)):
        want = _jaccard_components(rows)
        got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert ngram_components(docs).count() == len(_rows()) and ngram_components(empty).count() == 0
    kept = first_of_each(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string"))
    assert kept.columns == ["doc_id", "text", "id"] and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_components_of_a_path(spark):
    from shelfscan.llm.components import connected_components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (99, 99)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


def test_packing_is_whole_and_tight(spark, docs, empty):
    from shelfscan.llm.packing import CAPACITIES, pack, word_tokens

    for table in (docs, _whole(spark, "documents")):
        got = pack(table).collect()
        want = sorted((str(r["doc_id"]), r["n"]) for r in table.select("doc_id", word_tokens(F.coalesce("text", F.lit(""))).alias("n")).collect())
        whole, bins = {}, {}
        for r in got:
            whole.setdefault(str(r["doc_id"]), []).append(r["n_tokens"])
            bins.setdefault(r["bin_id"], []).append(r)
        assert sum(n for _, n in want) == sum(map(sum, whole.values())) and set(whole) == {i for i, _ in want}
        for rows in bins.values():
            rows.sort(key=lambda r: r["bin_offset"])
            ends = list(itertools.accumulate(r["n_tokens"] for r in rows))
            assert [r["bin_offset"] for r in rows] == [0, *ends[:-1]] and ends[-1] == rows[0]["bin_tokens"]
            assert {r["bin_capacity"] for r in rows} == {min(c for c in CAPACITIES if c >= ends[-1])}
        assert sorted(bins) == list(range(len(bins)))
    assert pack(empty).count() == 0


def test_plan_places_every_piece_by_best_fit():
    from shelfscan.llm.packing import plan

    rng = np.random.default_rng(6)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 400))
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        p = plan(histogram, (25, 50, 100))
        placed = {n: 0 for n in histogram}
        ranks = {n: sorted(p.rank[p.length == n].tolist()) for n in histogram}
        used: dict[int, int] = {}
        for n, rank, first, per in zip(p.length, p.rank, p.bin, p.per_bin):
            later = [r for r in ranks[n] if r > rank]
            pieces = (later[0] if later else histogram[n]) - rank
            for k in range(pieces):
                used[first + k // per] = used.get(first + k // per, 0) + n
            placed[n] += pieces
        assert placed == histogram
        groups = np.searchsorted(p.bin_first, sorted(used), "right") - 1
        assert [used[b] for b in sorted(used)] == p.bin_used[groups].tolist()
        assert (p.bin_used <= p.bin_capacity).all()


# --- pipeline --------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, sf = _whole(spark, "documents"), SF
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        rows = after.collect()
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before.collect()} and len(rows) > 0.5 * docs.count()
        if name == "ngram_jaccard":
            want = _jaccard_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in rows} == {c for _, c in want.values()}
        before = spark.createDataFrame(rows, docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == {r["doc_id"] for r in rows}


def test_pipeline_on_an_empty_table(spark, empty):
    import corpus_pipeline

    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
