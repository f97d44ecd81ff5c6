"""Each operator against a plain version of itself, and on odd tables."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import math
import random
import re
import urllib.parse
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from talus.llm import common, decontaminate, extract, mixing, nearcopies, secrets, simhash, tokens, topk, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, to clash with.
CLASHES = "words level at hash gram left right size key bucket weight unit fp root node anchor h v block chunk score held_out predicted text_hash component_id first sha1 response taken target u m _w_id c_id".split()


def odd_docs(spark, *texts):
    """Nulls in every column, empty and long texts, repeated rows, and columns with names that clash."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None, None), (None, "lost words here", "en", "a", 5), (2, "", "en", "a", 0), (3, long, "en", "b", 9), (4, "same text again", "en", "b", 3), (4, "same text again", "en", "b", 3), (5, "   \t\n ", None, "b", 1)]
    rows += [(10 + i, t, "en", "c", 1) for i, t in enumerate(texts)]
    out = spark.createDataFrame(rows, DOCS)
    return out.withColumns({c: F.lit("clash") for c in CLASHES})


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# Top-k


def brute_top_k(rows, k):
    valid = [(i, [math.floor(64 * x) if abs(x) < 2**52 else 64 * int(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(valid):
        if q % 20 == 0:
            scores = [(sum(x * y for x, y in zip(a, b, strict=False)), i) for other, (i, b) in enumerate(valid) if other != at]
            found = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for s, i in scores)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def top_rows(table, k=20):
    return sorted(map(tuple, topk.top_k(table, k).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("small", [1 << 19, 300])
def test_top_k_is_exact(spark, monkeypatch, small):
    monkeypatch.setattr(topk, "SMALL", small)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.15, 8).astype(np.float32).tolist()) for i in range(300)]
    same = rows[7][1]
    rows += [(i, same) for i in range(300, 420)] + [rows[40]] + [rows[60]] * 30 + [rows[3]] * 25  # rows that repeat are rows each
    rows += [(80, rng.normal(0, 0.15, 8).astype(np.float32).tolist()) for _ in range(40)]  # an id with many vectors
    rows += [(500, None), (None, same), (501, [float("nan")] * 8), (502, [None] * 8), (520, [0.0] * 8), (521, same[:5]), (540, [-0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("v", "block", "rank", "rid", "copies", "asks")})
    assert top_rows(table) == brute_top_k(rows, 20)
    assert topk.top_k(empty(spark, "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("size", [2.0**22, 2.0**28, 2.0**34, 2.0**60, 1e300])
def test_scores_of_large_components_are_exact(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.uniform(-1, 1, 16) * size).tolist()) for i in range(60)]
    assert top_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute_top_k(rows, 20)


def test_few_rows_give_what_there_is(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert list(map(tuple, topk.top_k(table).collect())) == [(0, 1, 1, 64 * 32)]


def test_the_bound_stops_a_search_early():
    rng = np.random.default_rng(2)
    vectors = np.zeros((4000, 4))
    vectors[:, 0] = np.sort(rng.exponential(100, 4000))
    vectors[:, 1] = rng.normal(0, 1, 4000)
    lists = topk.Lists(np.arange(4000), vectors)
    queries = np.array([[1.0, 0, 0, 0], [-1, 0, 0, 0], [5, 1, 0, 0], [0, 1, 0, 0]])
    depths = lists.stops(queries, np.full(4, -1), 5)
    assert (depths > 0).all() and (depths < 400).all()
    for query, depth, found in zip(queries, depths, lists.top(queries, np.full(4, -1), 5), strict=True):
        scores = vectors @ query
        assert [(s, i) for s, i, _ in found][:5] == [(int(scores[i]), i) for i in sorted(range(4000), key=lambda i: (-scores[i], i))[:5]]  # noqa: B023
        out = np.setdiff1d(np.arange(4000), lists.met(query, depth))
        assert scores[out].max() <= lists.reach(query[None], np.array([depth]))[0, 0]


# Extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
%s
<aside>More</aside><form><p>Search</p></form><div id="comments"><p>First!</p></div><footer>&copy; me</footer></body></html>"""


def test_articles_are_taken_from_their_pages():
    inside = "<article><h1>Head &amp;amp; line</h1><p><b>One\n\t two.<br><p>Three &lt;4&gt;&#233;<p>Five</p><div class='ad'>Buy</div><!-- <p>no</p> --><ul><li><a href=x>Linked</a></li></ul></article>"
    assert extract.main_text(PAGE % inside) == "Head &amp; line\nOne two.\nThree <4>é\nFive\nLinked"
    assert extract.main_text(PAGE % "<article><h1>In</h1></article>") == "In"
    body = "".join(f"<p>{'A sentence of the story that goes on. ' * 3}{i}</p>" for i in range(4))
    plain = extract.main_text(PAGE % f"<div class='content'><h1>Title</h1>{body}</div>")
    assert plain.split("\n")[0] == "Title" and len(plain.split("\n")) == 5
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav><a>x</a></nav>") == ""
    assert extract.main_text("<article><p>cut off in the mid") == "cut off in the mid"


def test_only_hidden_elements_are_left_out():
    for shown in ("class='overflow-hidden'", 'style="overflow:hidden; color:red"', "title='a hidden lake'", 'aria-hidden="false"', "data-hidden=1", "hidden=until-found", "data-style='display:none'"):
        assert extract.main_text(f"<article {shown}><p>Text</p></article>") == "Text", shown
        assert extract.main_text(f"<article><p>A <a href='/hidden-valley' {shown}>link</a></p></article>") == "A link", shown
    for gone in ("hidden", "HIDDEN=''", "class=x hidden=hidden", "aria-hidden=true", 'style="color:red; display : none"', "style='visibility:hidden !important;'"):
        assert extract.main_text(f"<article><div {gone}>No</div><p>Text</p></article>") == "Text", gone


def test_links_end_and_stay_in_articles():
    body = [f"{'A sentence of the story that goes on. ' * 3}{i}" for i in range(4)]
    story = "".join(f"<p>{p}</p>" for p in body)
    for before in ("<a name=top>", "<div><a href='/x'>Home</div>", "<p><a href='/x'>Home", "<a href='/x'>Home<p>", "<a href='/x'>One <a href='/y'>Two</a>"):
        for after in ("", "<p>See <a href='/z'>this</a></p>"):
            assert all(p in extract.main_text(f"<html><body>{before}{story}{after}</body></html>").split("\n") for p in body), before
    inside = f"<div><p>{body[0]}</p><p><a href='/x'>All of it a link</a></p><p>{body[1]}</p></div>"
    assert extract.main_text(inside).split("\n") == [body[0], "All of it a link", body[1]]
    menu = "".join(f"<a href='/{i}'><div>Entry with quite a long title, number {i}</div></a>" for i in range(9))
    assert "number 1" not in extract.main_text(f"<div>{menu}</div><div>{story}</div>")


def brute_kept(found):
    """Surges and dives looked up window by window."""
    n, w = len(found), extract.WINDOW
    total = lambda i: sum(x.weight for x in found[i : i + w])
    best = max(map(total, range(n)), default=0)
    upper = min(best, max(extract.SURGE_LEAST, min(extract.SURGE * best, extract.SURGE_MOST)))
    lower = min(extract.DIVE * best, extract.DIVE_MOST)
    thick = [best > 0 and total(i) > 0 and any(total(j) >= lower for j in range(max(0, i - w + 1), i + 1)) for i in range(n)]
    reached = [any(all(thick[min(i, j) : max(i, j) + 1]) and total(j) >= upper for j in range(n)) for i in range(n)]
    out = [found[i].text != "" and thick[i] and reached[i] for i in range(n)]

    def between(i, j):
        return min(x.depth for x in found[i : j + 1]) >= min(found[i].depth, found[j].depth) - 1 and not any(out[i + 1 : j])

    gaps = [(i, j) for i in range(n) for j in range(i + 1, n) if out[i] and out[j] and between(i, j)]
    return [out[i] or found[i].text != "" and any(a < i < b for a, b in gaps) for i in range(n)]


def test_surges_and_dives_are_those_of_every_window():
    rng = random.Random(6)
    for _ in range(300):
        found, depth = [], 1
        for _ in range(rng.randrange(25)):
            depth = max(0, depth + rng.choice((-1, 0, 0, 1)))
            size = rng.choice((0, 0, 0, 3, 9, 25, 60, 200, 3000))
            found.append(extract.Line("x" * size, size * rng.choice((0.125, 0.5, 1, 32)), depth))
        assert extract.kept(found) == brute_kept(found)


def test_lengths_decide_on_labelled_pages():
    long = ["A sentence of the story that goes on and on, with some clauses. " * 2 + str(i) for i in range(3)]
    body = "".join(f"<p>{p}</p>" for p in long)
    loose = "".join(f"<div>{p}</div>" for p in long)
    cases = {
        # no article tag: thin text after the article's container, and menus of links, are beyond the dive
        f"<body><div>{body}</div><div>Copyright 2020 Foo Inc</div><div>Terms</div></body>": long,
        f"<body><div><a href='/'>Home</a></div><div><a href='/n'>News</a></div><div id=text>{body}</div></body>": long,
        f"<body><div>{loose}</div><div>Copyright 2020 Foo Inc</div></body>": [p.strip() for p in long],
        # thin paragraphs within and at the end of one container stay
        f"<div>{body}<p>Yes.</p><p>No.</p><p>Yes.</p><p>No.</p><p>Yes.</p>{body}<p>End</p></div>": [*long, "Yes.", "No.", "Yes.", "No.", "Yes.", *long, "End"],
        f"<div><div>{long[0]}</div><div>Short</div><div>{long[1]}</div></div>": [long[0], "Short", long[1]],
        # elements whose end tags are missing end where HTML says
        f"<article><p class=notice>By X<p>{long[0]}<p>{long[1]}</article>": long[:2],
        f"<article><ul><li class='nav-item'>Skip<li>{long[0]}</ul><p>{long[1]}</article>": long[:2],
        f"<article><table><tr><td class=ad>Buy<td>{long[0]}<tr><td>{long[1]}</table></article>": long[:2],
        f"<article><p><span class=ad>Buy<p>{long[0]}</article>": long[:1],
        # only whole names mark what is no article
        f"<article><div class='ad-hoc no-sidebar'>{body}</div><div class='site-header'>Site</div></article>": long,
        # linked paragraphs and short articles
        f"<article>{body}<p><a href=x>All of it a link</a></p></article>": [*long, "All of it a link"],
        f"<div>{body}<p><a href=x>All of it a link</a></p>{body}</div>": [*long, "All of it a link", *long],
        "<p>A line outside</p><article><h1>Yes</h1></article><div>Copyright 2020 Foo Inc</div>": ["Yes"],
        # text beside an article that is as dense as one competes by its density, thin text doesn't
        f"<p>Some teaser of about fifty characters, no more.</p><article>{body}</article>": long,
        "<article></article>": [],
        "<div>Only a few words</div>": ["Only a few words"],
    }
    for page, text in cases.items():
        assert extract.main_text(page).split("\n") == ([t.strip() for t in text] or [""]), page


def test_extraction_of_odd_tables(spark):
    rows = [(1, "u", PAGE % "<article><p>Text</p></article>"), (1, "u", PAGE % "<article><p>Text</p></article>"), (None, None, None), (2, "v", "<article><p>" + "word " * 200_000 + "</p></article>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    found = extract.extract(table).collect()
    assert sorted((r["page_id"] or 0, len(r["text"]), r["n_chars"]) for r in found) == [(0, 0, 0), (1, 4, 4), (1, 4, 4), (2, 999_999, 999_999)]
    assert extract.extract(empty(spark, "page_id long, url string, html string")).count() == 0


# Decontamination


def ascii_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, span=10):
    windows = {}
    for i, text in items:
        w = ascii_words(text)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, ids = ascii_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= {str(i) for i in found if i is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"W{i}" for i in range(12)] + ["Élan", "über", "it's"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.randint(8, 30))) for i in range(25)] + [(90, "only three words"), (91, "lone"), (92, None), (93, "!!"), (None, make(12)), (94, "a a a a a a a a a a a a"), (95, "a a a a a a a a a a a a")]
    docs = []
    for d in range(60):
        text = make(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            piece = ascii_words(rng.choice(items)[1])
            cut = rng.randint(0, max(0, len(piece) - 9))
            text += ", " + " ".join(piece[cut : cut + rng.randint(8, 14)]) + ". " + make(rng.randint(0, 9))
        docs.append((d, text))
    docs += [(500, "a " * 40), (501, None), (502, ""), (None, items[0][1]), (3, items[1][1]), docs[5], (503, "Lone"), (504, "only THREE words"), (505, " ".join(f"{i % 97}" for i in range(40_000)) + " " + items[2][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})
    found = decontaminate.decontaminate(table, spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)))
    got = sorted(map(tuple, found.drop("text_hash").collect()), key=str)
    assert got == sorted(brute_hits(docs, items), key=str)


def test_decontamination_of_empty_tables(spark):
    items, docs = empty(spark, "item_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.decontaminate(docs, items).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.decontaminate(empty(spark), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


# SimHash


def plain_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_fingerprints(spark):
    for text in (None, "", " \n", "One", "One two", "Él fue à la casa ÉL", "a b c d e f g a b c d e f g " * 40):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("block", [2048, 4])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash.graph, "SMALL", 0 if block == 4 else simhash.graph.SMALL)  # components in rounds, and in one task
    rng = random.Random(5)
    values = set()
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 8])):
            values.add(v)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                v ^= 1 << b
    tight = rng.getrandbits(64)  # many around one value: an anchor with more than a block
    values |= {tight ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(0, 64, 6), 2)}
    values = sorted(values)
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(table)).collect()}
    want = plain_groups(values)
    got = [roots.get(v, v - (1 << 64) if v >> 63 else v) for v in values]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_near_duplicates_of_odd_tables(spark):
    body = " ".join(f"word{i}" for i in range(3000))
    assert (simhash.fingerprint(body) ^ simhash.fingerprint(body + " end")).bit_count() <= 3
    docs = odd_docs(spark, body, body + " end", "something else altogether, of its own")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r for r in found}
    assert by[1]["component_id"] == by[2]["component_id"] == by[5]["component_id"] == 1 and by[1]["fingerprint"] == "0" * 16
    assert by[4]["component_id"] == 4 and by[None]["component_id"] is None and by[11]["component_id"] == 10
    assert simhash.near_duplicates(empty(spark)).count() == 0


# Near copies


@pytest.mark.parametrize("reps", [4, 1])
def test_near_copies_equal_all_pairs(spark, monkeypatch, reps):
    monkeypatch.setattr(nearcopies, "REPS", reps)
    monkeypatch.setattr(nearcopies, "TRIED", 10 if reps == 1 else nearcopies.TRIED)
    rng = random.Random(9)
    line = " ".join(f"common{i}" for i in range(30))
    texts = [None, "", "a b", "A  b", "a b c d e", "a b c d f"]
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 300]))]
        for changes in (0, 0, 1, 2, 4, 6, 8):  # similarities of about 0.4 to 1
            changed = list(words)
            for at in rng.sample(range(len(words)), changes):
                changed[at] = f"x{rng.random()}"
            texts.append(" ".join(changed) + (f" {line}" if k % 3 else ""))
    texts += [f"{line} {line[:50 + i]} own{i % 7}" for i in range(60)]  # many at the same shingles
    sets = [set(nearcopies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            near += sets[i] != sets[j]
            a, b = sorted((find(i), find(j)))
            root[b] = a
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[6], rows[6], rows[9], rows[40]]  # rows that repeat
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASHES})
    kept = nearcopies.one_of_each(docs)
    assert near > 50 and kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert nearcopies.one_of_each(empty(spark)).count() == 0


def test_a_group_of_copies_gives_as_many_pairs_as_it_has_sets(spark, monkeypatch):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(150):
        changed = list(words)
        for at in rng.sample(range(200), 3 if k != 77 else 0):  # similar to the one they were made of, not to each other
            changed[at] = f"x{rng.random()}"
        texts.append(" ".join(changed))
    texts += [" ".join(f"v{rng.random()}" for _ in range(100)) for _ in range(50)]
    counted = []
    similar = nearcopies._Search._similar
    monkeypatch.setattr(nearcopies._Search, "_similar", lambda self, pairs, n: counted.append(n) or similar(self, pairs, n))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    assert nearcopies.one_of_each(docs).count() == len({*near_groups(texts)})
    assert sum(counted) < 20 * len(texts)  # of 11,175 pairs


def test_sets_that_meet_too_late_make_no_pair(spark):
    # Of 10 members each, 9 have to be shared: a pair with 8 left at the token, and one with 9 left.
    rows = [(7, 1, 10, 100, 8), (7, 2, 10, 200, 10), (8, 3, 10, 300, 9), (8, 4, 10, 400, 10)]
    dealt = spark.createDataFrame(rows, "token long, id long, n long, prev long, rest long")
    assert [(r["id"], r["rep"]) for r in nearcopies._starred(dealt, 0.8).where("rep IS NOT NULL").collect()] == [(4, 3)]


def test_workers_hold_few_texts_at_once(spark, monkeypatch):
    sent, frame = [], type(spark.range(0))
    true = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, **b: sent.append((run, self.columns)) or true(self, run, *a, **b))
    docs = spark.createDataFrame([(1, "you idiot, token = abcdef1234")], "doc_id long, text string")
    toxicity.score(docs, toxicity.Model({}, toxicity.grow(np.empty((0, 14)), np.empty(0)), np.empty(0), np.empty(0)))
    secrets.secrets(docs)
    secrets.mask(docs)
    assert len(sent) == 3
    columns = {"doc_id": pa.array(range(3000)), "held_out": pa.array([False] * 3000), "text": pa.array([f"{i} you idiot, token = abcdef{i:04}" for i in range(3000)])}
    for run, names in [*sent, (toxicity._with_features({}), ["doc_id", "doc_id", "text"])]:
        whole = pa.RecordBatch.from_arrays([columns[c] for c in names], [f"{i}" if names.count(c) > 1 else c for i, c in enumerate(names)])
        made = list(run(iter([whole, whole.slice(0, 0), whole.slice(7, 100)])))
        assert max(b.num_rows for b in made) <= 512
        assert pa.Table.from_batches(made).column(0).to_pylist() == [*range(3000), *range(7, 107)]


def test_copies_of_odd_tables(spark, monkeypatch):
    docs = odd_docs(spark, "same  TEXT again", "something of its own")
    for few in (1_000_000, 0):  # keys named to every task, and joined
        monkeypatch.setattr(common, "FEW", few)
        monkeypatch.setattr(nearcopies, "FEW", few)
        kept = nearcopies.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "11", "3", "4", "None"]


def test_counts_bound_what_sets_share():
    rng = np.random.default_rng(10)
    for _ in range(300):
        pool = rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 30_000))
        a, b = (np.unique(rng.choice(pool, rng.integers(0, len(pool) + 1), replace=False)) for _ in range(2))
        bound, both = nearcopies.shared_at_most(nearcopies.counts(a), nearcopies.counts(b), min(len(a), len(b))), len(np.intersect1d(a, b))
        assert both <= bound <= min(len(a), len(b))
    one = np.arange(1 << 20) << 20  # all in one bucket
    assert nearcopies.shared_at_most(nearcopies.counts(one), nearcopies.counts(one), len(one)) == len(one)


# URL filters


def plain_verdict(url):
    host, path = urls.parts(url)
    fit = [(v, h, p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, "allow"
    v, h, p = max(fit, key=lambda r: len(r[1] + r[2]))
    return host, path, h + p, v


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["example.com", "A.Example.COM", "com", "x.net", "example.net", "badexample.com", "www.example.org", "net.de", "é.com"]
    paths = ["/en/", "/en/7", "/en/71?q=/de/", "/de/8", "/de/81#x", "/es", "/es/", "", "/EN/", "?/en/", "#/en/"]
    links = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme/en/", "://", "http://", "a://b://c/en/"]
    odd = [(None, links[0]), (None, None), (3, links[3]), (3, links[3])]  # null ids and rows that repeat
    both = urls.filter_urls(spark.createDataFrame(odd, "page_id long, url string")).collect()
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in both))) == sorted(str((i, *plain_verdict(u))) for i, u in odd)
    table = spark.createDataFrame([(i, u) for i, u in enumerate(links)], "page_id long, url string").withColumns({"host": F.lit(1), "key": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(table).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(links)}
    assert urls.filter_urls(empty(spark, "page_id long, url string")).count() == 0


def test_a_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    inside = set(random.Random(7).sample(keys, 400))
    universe, chosen = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (keys, sorted(inside)))
    levels = urls.cascade(universe, chosen)
    assert len(levels) > 2 and [k for k, yes in zip(keys, urls.listed(levels, keys), strict=True) if yes] == [k for k in keys if k in inside]


# Toxicity


def toxic_corpus(n=1500):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha le mi no pu ra sa te vi zo".split() for b in "ran lin mot per sak".split()]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), "zorgl" + rng.choice(["ak", "im", "ot"]))
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 1, int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if found[r[0]]["held_out"]]
    assert 200 < len(held) < 400 and sum(found[r[0]]["predicted"] == r[5] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs.repartition(3), labels).collect()}
    assert again == {k: r["score"] for k, r in found.items()}


def test_toxicity_of_odd_tables(spark):
    none = empty(spark, "doc_id long, toxic int")
    docs = odd_docs(spark, "you stupid worthless idiot", "a quiet walk by the river")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, none).collect()}
    assert found[10] == 1 and found[11] == 0 and found[1] == found[2] == 0
    odd = spark.createDataFrame([(None, 1), (10, None), (10, 7), (11, 0), (99, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, odd).count() == docs.count()
    # An id that repeats gives fitting one text.
    many = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("you idiot "), "id").alias("text"))
    model = toxicity.fit(many.unionByName(docs.select("doc_id", "text")), spark.createDataFrame([(7, 1), (10, 0)], "doc_id long, toxic int"))
    assert not [w for w in model.lexicon if w.startswith("you")]
    assert toxicity.toxicity(empty(spark), none).count() == 0


def test_trees_split_where_the_gain_is_largest():
    rng = np.random.default_rng(13)
    for _ in range(20):
        x = rng.integers(0, 6, (80, 3)).astype(float)
        y = (rng.random(80) < 0.2 + 0.6 * (x[:, 1] > rng.integers(1, 5))).astype(float)
        model = toxicity.grow(x, y, rounds=1, depth=1, rate=1.0)
        feature, cut, value = model.trees[0]
        p = 1 / (1 + math.exp(-model.base))
        g, h = p - y, np.full(80, p * (1 - p))
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
        best = max(gain(x[:, j] <= c) + gain(x[:, j] > c) for j in range(3) for c in range(5))
        left = x[:, feature[0]] <= cut[0]
        assert gain(left) + gain(~left) == pytest.approx(best)
        assert value[1] == pytest.approx(-g[left].sum() / (h[left].sum() + 1.0)) and value[2] == pytest.approx(-g[~left].sum() / (h[~left].sum() + 1.0))


def test_the_lexicon_has_what_toxic_texts_have_more_often(spark):
    rows = toxic_corpus(300)
    table = spark.createDataFrame([(r[1], r[5]) for r in rows], "text string, toxic int")
    found = toxicity._learn_lexicon(table)
    n, bad = len(rows), sum(r[5] for r in rows)
    of = {}
    for r in rows:
        words = set(r[1].split())
        for entry in words | {w[:k] + "*" for w in words for k in toxicity.STEMS if len(w) >= k}:
            t, m = of.get(entry, (0, 0))
            of[entry] = (t + r[5], m + 1)
    odds = {e: math.log((t + 0.5) / bad / ((m - t + 0.5) / (n - bad))) for e, (t, m) in of.items() if t >= toxicity.MIN_SUPPORT}
    assert found == pytest.approx({e: x for e, x in odds.items() if x >= toxicity.MIN_LOG_ODDS}) and found


def test_calibration_increases():
    places, chances = toxicity.isotonic(np.array([3.0, 1, 2, 2, 4, 0]), np.array([1.0, 0, 1, 0, 1, 1]))
    assert (np.diff(places) >= 0).all() and (np.diff(chances) >= 0).all() and chances[-1] == 1


# Token counts


def test_token_counts_equal_a_plain_search(spark, tmp_path):
    path = tmp_path / "v.tiktoken"
    pieces = [b"a", b"b", b"ab", b"abc", b" a", b"bc", b"\xc3\xa9", b"aa", b"aaa", b" the", b"he"]
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    unigrams = tokens.scores(str(path))

    def plain(data):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(data)
        for j in range(1, len(data) + 1):
            options = [(best[i][0] + unigrams[data[i:j]], -(best[i][1] + 1)) for i in range(j) if data[i:j] in unigrams]
            score, n = max(options)
            best[j] = (score, -n)
        return best[-1][1]

    texts = ["abcab the café", "aaaaaaa", "", None, "x\U0001f600y  z\n\n", "abc " * 3000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    import regex

    want = {i: (len(p := regex.findall(tokens.PATTERN, t or "")), sum(plain(x.encode()) for x in p)) for i, t in enumerate(texts)}
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in tokens.token_counts(table, str(path)).collect()}
    assert got == want
    small = tokens.Trie(unigrams)
    assert small.tokens("abc") == small.tokens("abc") == plain(b"abc") and len(small.best) == 4
    assert small.tokens("abcab") and len(small.best) == 6  # only what the prefix lacked
    long = "".join(random.Random(4).choice("abc") for _ in range(tokens.LONG + 2000))
    assert small.tokens(long) == plain(long.encode()) and len(small.best) == 6  # without nodes
    small.best += [0.0] * (tokens.MOST_NODES - 8)
    assert small.tokens("b" * 9) == plain(b"b" * 9) and len(small.best) == 10  # started anew before it would outgrow its bound
    twice = table.where("doc_id IN (0, 3)").unionByName(table.where("doc_id = 0")).withColumn("doc_id", F.when(F.col("doc_id") == 0, 7))
    assert sorted(tokens.token_counts(twice, str(path)).collect(), key=str) == sorted([(7, *want[0]), (7, *want[0]), (None, 0, 0)], key=str)
    assert tokens.token_counts(empty(spark), str(path)).count() == 0


# Mixing


def plain_mix(rows, quality):
    size = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    total = {s: sum(size(t) for _, x, t in rows if x == s) for s in sources}
    target, free, left = {}, list(sources), sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if 3 * total[s] < level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in sources:
        mine = []
        for d, x, t in rows:
            if x == s:
                u = (int(hashlib.md5(str(d if d is not None else t or "").encode()).hexdigest()[:12], 16) + 1) / 2**48
                mine.append((-math.log(u) / quality.get(d, 1), d if d is not None else -1, size(t)))
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - epochs * total[s], 0
        for _, d, n in sorted(mine):
            upto += n
            out.append((d, n, total[s], pytest.approx(target[s]), n * (epochs + (upto - n / 2 <= rest))))
    return out


@pytest.mark.parametrize("few", [10_000, 0])
def test_mixing_equals_a_plain_version(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", "é", None]), " ".join("x" for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(900, "tiny", "one two"), (901, "none", ""), (902, "none", None), (903, "a", "tab\tand\x0bline\n ends ")]
    rows += [(20, "b", "x x x")] * 150 + [(20, "b", "x " * n) for n in range(40)]  # a third of the rows under one id
    rows += [(5000 + i, f"site{i}", "x " * rng.choice([1, 5, 25, 125])) for i in range(150)]
    quality = {i: rng.choice([1, 2]) for i in range(0, 400, 2)}
    table = spark.createDataFrame([(d, t, s) for d, s, t in rows], "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in CLASHES})
    weights = spark.createDataFrame(list(quality.items()) + [(0, 1), (None, 2), (5, None)], "doc_id long, weight int")
    got = sorted((tuple(r) for r in mixing.mix(table, weights).collect()), key=lambda r: (*r[:3], 0, r[4]))
    assert got == sorted(plain_mix(rows, {**quality, 0: max(quality[0], 1)}), key=lambda r: (*r[:3], 0, r[4]))
    by = {}
    for d, n, total, target, taken in got:
        if not 5000 <= d < 6000:  # of sites, many have one size and target
            by.setdefault((total, target), []).append((n, taken))
    for (total, target), docs in by.items():
        assert abs(sum(t for _, t in docs) - target) <= 30 and all(t <= 3 * n for n, t in docs)


def test_mixing_of_odd_tables(spark):
    docs = odd_docs(spark)
    found = mixing.mix(docs)
    assert found.count() == docs.count() and found.where("taken > 3 * size OR taken IS NULL").count() == 0
    assert sorted(map(str, found.collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty(spark)).count() == 0


# WARC


def test_archives_there_and_back(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2 ö\n", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 100_000), (None, "u", "alone"), (6, "u", "\r\n\r\nodd WARC/1.1\r\n"), (7, "u", "<p>same</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "first": F.lit(2), "path": F.lit(3)}).repartition(3)
    got = sorted(map(tuple, warc.archive(table, f"file://{tmp_path}/w").collect()), key=str)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = last[h or ""]
        revisit = first >= 0 and first != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    least = {r["page_id"]: r["record_type"] for r in warc.archive(table, f"file://{tmp_path}/v", least=100).collect()}
    assert set(least.values()) == {"response"}
    assert warc.archive(empty(spark, "page_id long, url string, html string"), f"file://{tmp_path}/x").count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_archives_of_rows_that_repeat(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)  # digests named to every task, and dealt
    rows = [(9, "u", "same")] * 3 + [(i, "u", "same") for i in range(8)] + [(4, "v", "own"), (None, "u", "none")] + [(None, "u", "none")] * 2 + [(i, None, None) for i in range(20, 60)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"of": F.lit(1), "response": F.lit(2), "n": F.lit(3)}).repartition(5)
    found = warc.archive(table).collect()  # packages in the shared folder, which are gone afterwards
    assert len(found) == len(rows)
    kinds = [(r["page_id"], r["record_type"], r["refers_to"]) for r in found]
    assert kinds.count((9, "response", None)) == 3 and sorted(x for x in kinds if x[2] == 9) == [(i, "revisit", 9) for i in range(8)]
    assert kinds.count((None, "response", None)) == 3 and kinds.count((4, "response", None)) == 1 and kinds.count((59, "response", None)) == 1
    assert len([x for x in kinds if x[2] == 59]) == 39


def test_records_are_read_in_parallel(spark, tmp_path):
    noise = [(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 40) for i in range(400)]
    packages = warc.write_packages(spark.createDataFrame(noise, "page_id long, url string, html string").coalesce(2), f"file://{tmp_path}/w")
    read = warc.read_packages(packages)
    busy = read.groupBy(F.spark_partition_id()).count().count()
    assert packages.count() == 2 and busy > 4 and read.count() == 400


def test_revisits_refer_to_records(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string").coalesce(1)
    warc.write_packages(table, f"file://{tmp_path}/w").count()
    data = zipfile.ZipFile(next((tmp_path / "w").glob("*.wacz"))).read(warc.ARCHIVE)
    text = gzip.decompress(data).decode()
    ids, refers = re.findall(r"WARC-Record-ID: (\S+)", text), re.findall(r"WARC-Refers-To: (\S+)", text)
    assert len(ids) == 2 and len(refers) == 1 and refers[0] in ids


def test_warc_keeps_large_ids_beside_nulls(spark, tmp_path):
    big = (1 << 60) + 1
    table = spark.createDataFrame([(big, "u", "same"), (big - 2, "u", "same"), (None, "u", "same"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive(table, f"file://{tmp_path}/w").collect()}
    assert got == {(big, "response", None), (big - 2, "revisit", big), (None, "revisit", big), (None, "response", None)}
    package = next((tmp_path / "w").glob("*.wacz"))
    with zipfile.ZipFile(package) as z:  # as another reader sees it
        assert z.testzip() is None and {warc.ARCHIVE, warc.INDEX} == set(z.namelist())
        assert gzip.decompress(z.read(warc.ARCHIVE)).startswith(b"WARC/1.1\r\n")


def test_directories_with_zip64_and_comments(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"x" * 1000)
        z.writestr("packed", b"y" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05 not an end"
    file = fs.LocalFileSystem().open_input_file(str(path))
    found = {m.name: m for m in warc.directory(file)}
    assert bytes(file.read_at(found["big"].size, warc.stored_at(file, found["big"]))) == b"x" * 1000
    with pytest.raises(ValueError):
        warc.stored_at(file, found["packed"])
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):  # more than an end record can count
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
    assert len(warc.directory(fs.LocalFileSystem().open_input_file(str(many)))) == 66_000


# Secrets

KEY = "token=abcdefgh123"


def test_secrets_as_they_stand():
    cases = {
        "my Password: 'hunter22' and": [(3, 0, 22)],
        "api_key = abc": [],
        'x APIKEY":"Zz9/+=._-" ': [(2, 0, 20)],
        "secret=token: abcdefg": [],  # the failing match takes "token"
        "AKIA" + "A" * 16: [(0, 1, 20)],
        "AKIA" + "A" * 15: [],
        "x" + "0a" * 12 + "g": [(1, 2, 25)],
        "0a" * 11: [],
        "ſecret=abcdefgh": [],
        "": [],
    }
    for text, want in cases.items():
        assert secrets.scan(text) == want, text


def test_nested_layers_are_unwrapped():
    pack = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
    zipped = pack(gzip.compress(KEY.encode()))
    layered = pack(pack(pack(KEY)))
    percent = urllib.parse.quote(KEY, safe="")
    double = urllib.parse.quote(percent, safe="")
    unicode_ = "".join(f"\\u{ord(c):04x}" for c in KEY)
    for wrapped in (pack(KEY), zipped, layered, percent, double, unicode_, pack(percent), pack(unicode_)):
        text = f"é before {wrapped} after"
        base, found = secrets.spans(text)
        assert base == [] and len(found) == 1, wrapped
        start, kind, end = found[0]
        assert kind == 0 and 9 <= start < end <= 9 + len(wrapped)
        assert KEY not in secrets.masked(text) and "[SECRET]" in secrets.masked(text)
    bomb = pack(gzip.compress(b"z" * 50_000_000))
    assert secrets.spans(f"x {bomb} y") == ([], [])
    word = "Internationalization"
    assert secrets.spans(f"{word} 100% of %%% the %e9 \\u12 &#xZ; ====") == ([], [])


def test_escaped_values_stay_with_their_keyword():
    for text, secret in {
        'password = "%68unter2secret" x': "%68unter2secret",
        '{"password": "\\u0068unter2secret"}': "\\u0068unter2secret",
        "token: '&#104;unter2secret'": "&#104;unter2secret",
    }.items():
        end = text.index(secret) + len(secret)
        assert [(k, e) for _, k, e in secrets.spans(text)[1]] == [(0, end)], text
        assert "unter2secret" not in secrets.masked(text)
    assert secrets.spans("token=%61%62%63%64%65%66%20%78")[1] == [(0, 0, 24)]  # ends within a row of escapes


def test_decoded_spans_beyond_base_ones_are_kept():
    text = "api_key=Zx91kQ%2Bp7Lm3N8s end"
    assert secrets.spans(text) == ([(0, 0, 14)], [(0, 0, 14), (0, 0, 25)]) and secrets.masked(text) == "[SECRET] end"
    inner = base64.b64encode(b"password=hunter2secret").decode()
    base, found = secrets.spans(f"token={inner}")
    assert base == [(0, 0, 6 + len(inner))] and found == [*base, (6, 0, 6 + len(inner))]
    assert secrets.spans("token=abcdef and 50%25 &#65;") == ([(0, 0, 12)], [(0, 0, 12)])


def test_wrapped_base64_is_one_run():
    rng = random.Random(3)
    body = " ".join(f"{rng.getrandbits(30):x} word" for _ in range(12))
    plain = f"{body} password=hunter2secret".encode()
    for data in (plain, gzip.compress(plain)):
        packed = base64.b64encode(data).decode()
        for width, brk in itertools.product((64, 70, 76), ("\n", "\r\n", "\n  ")):
            wrapped = brk.join(packed[i : i + width] for i in range(0, len(packed), width))
            for before, after in (("see this:\n\n", "\n\nthe end"), ("-----BEGIN X-----\n", "\n-----END X-----"), ('data = "', '"')):
                text = before + wrapped + after
                found = secrets.spans(text)[1]
                assert (len(before), 0, len(before) + len(wrapped)) in found, text
                assert wrapped not in secrets.masked(text)
    short = base64.b64encode(b"x" * 40 + b" password=hunter2secret").decode()  # the secret lies across two lines
    assert secrets.spans(f"key: {short[:64]}\n{short[64:]}\n")[1] == [(5, 0, 6 + len(short))]
    assert secrets.spans("Internationalization\nInternationalization\nshort\n" * 50) == ([], [])


def test_compressed_data_is_read_to_its_end():
    def found(data):
        text = f"x {base64.b64encode(data).decode()} y"
        return secrets.spans(text)[1] == [(2, 0, len(text) - 2)] and secrets.masked(text) == "x [SECRET] y"

    key = b"password=hunter2secret"
    lines = b"a line of a log that repeats\n" * 40_000
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        assert found(pack(lines + key))
        assert found(pack(b"one ") * 3 + pack(key))
        nested = key
        for _ in range(12):
            nested = pack(nested)
        assert found(nested)
    assert found(gzip.compress(b"z" * 5_000_000 + b"\n" + key))
    assert found(gzip.compress(b"x password=hunter2secret"))  # "x " begins as zlib data may
    assert not found(gzip.compress(lines))


def test_parts_are_cut_where_nothing_goes_on(monkeypatch):
    monkeypatch.setattr(secrets, "CHUNK", 100)
    monkeypatch.setattr(secrets, "STEP", 64)
    packed = base64.encodebytes(gzip.compress(" ".join(f"{i} word" for i in range(60)).encode() + b" password=hunter2secret")).decode()
    text = base64.b64encode(gzip.compress(b"some words\n" * 15 + packed.encode() + b"more words\n" * 30)).decode()
    assert secrets.spans(text)[1] == [(0, 0, len(text))]


def test_decoded_layers_need_not_be_plain_text():
    key = "password=hunter2secret"
    noise = bytes(range(256))
    datas = [key.encode("utf-16"), f"né {key}".encode("latin-1"), f"\x1b[31m{key}\x1b[0m\f".encode(), noise + key.encode() + noise, b"odd" + key.encode("utf-16-be") + noise, gzip.compress(key.encode("utf-16-le"))]
    for data in datas:
        text = f"x {base64.b64encode(data).decode()} y"
        assert secrets.spans(text)[1] == [(2, 0, len(text) - 2)], data
        assert secrets.masked(text) == "x [SECRET] y"
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        for before in ("", "data="):
            text = f"x {before}{urllib.parse.quote_from_bytes(pack(key.encode()))} y"
            assert (2, 0, len(text) - 2) in secrets.spans(text)[1], text
    text = f"x {urllib.parse.quote_from_bytes(key.encode('utf-16'))} y"
    assert (2, 0, len(text) - 2) in secrets.spans(text)[1]
    assert secrets.spans(f"x {base64.b64encode(noise * 9).decode()} y") == ([], [])


def test_random_nests_are_unwrapped():
    rng = random.Random(11)
    pack = lambda data: base64.b64encode(data).decode()
    noise = lambda n: "".join(rng.choice("klmnoprstuvw ") for _ in range(n))
    wraps = [
        lambda t: pack(t.encode()),
        lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
        lambda t: "https://host.example/" + rng.choice(["", "v1/", "org/x/", "abc/"]) + pack(t.encode()),
        lambda t: base64.encodebytes(t.encode()).decode(),
        lambda t: pack(t.encode("utf-16")),
        lambda t: pack(b"\0\xff\x07" + t.encode() + b"\0\x1b"),
        *(lambda t, f=f: pack(f(t.encode())) for f in (gzip.compress, zlib.compress, bz2.compress, lzma.compress)),
        lambda t: pack(gzip.compress(noise(40).encode()) + gzip.compress(t.encode())),
        lambda t: urllib.parse.quote(t, safe=""),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        lambda t: "".join(f"&#{ord(c)};" if c in "=:" else c for c in t),
        lambda t: "%" + "%".join(f"{b:02x}" for b in gzip.compress(t.encode())),
    ]
    plants = ["password=hunter2secret", "token: 'abcDEF123456'", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2]
    for _ in range(400):
        text = layer = rng.choice(plants)
        for _ in range(rng.randint(1, 5)):
            layer = rng.choice(wraps)(f"{noise(rng.randrange(30))} {layer} {noise(rng.randrange(30))}")
        base, found = secrets.spans(f"é {layer} end")
        assert found and text not in secrets.masked(f"é {layer} end"), layer[:200]
    deep = "password=hunter2secret".encode()
    for _ in range(30):
        deep = gzip.compress(deep)
    assert secrets.spans(pack(deep))[1]
    letters = next(t for i in itertools.count() if (t := base64.b64encode(b"i" * 3 + b"%d" % i)).decode().isalpha())
    assert secrets.spans(f"{letters.decode()} word") == ([], [])


def test_long_runs_take_linear_time():
    long = "x%" * 200_000 + " " + "y" * 400_000 + " &# \\\\u " + "Ab" * 200_000 + "==== 50% &#65;"
    assert secrets.spans(long) == ([], [])


def test_secrets_of_odd_tables(spark):
    docs = odd_docs(spark, f"a {KEY} b", "x" * 1_000_000 + " " + KEY)
    found = {r["doc_id"]: r for r in secrets.secrets(docs).collect()}
    assert found[10]["n_assign"] == 1 and found[10]["spans"] == "assign:2:19" and found[11]["spans"] == f"assign:1000001:{1_000_001 + len(KEY)}"
    assert found[1]["spans"] == "" and found[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = secrets.mask(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    row = masked.where("doc_id = 10").first()
    assert row["text"] == "a [SECRET] b" and row["n_chars"] == len(row["text"])
    assert secrets.secrets(empty(spark)).count() == 0 == secrets.mask(empty(spark)).count()


# The pipeline


def near_groups(texts):
    """For each text, the least place of those that similar sets of shingles link it with, by all pairs."""
    sets = [set(nearcopies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def write_tables(spark, base, rows, labels, items):
    spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASHES}).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")


def test_the_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows = [r[:5] for r in toxic_corpus(400)]
    labels = [(r[0], r[0] % 2, r[5]) for r in toxic_corpus(400)]
    passage = " ".join(f"bench{i}" for i in range(14))
    clean = [f"own{i}" for i in range(60)]
    for k in range(6):  # copies of a text with more and more words of their own
        words = list(clean)
        for at in rng.sample(range(60), k):
            words[at] = f"other{rng.randrange(999)}"
        rows.append((700 + k, " ".join(words), "en", "s0", 1))
    rows += [(720, f"well {passage} done, or so it seems to them", "en", "s0", 1), (721, f"only {passage[:60]} of it", "en", "s1", 1), (722, f"keep {KEY} {' '.join(f'z{i}' for i in range(40))}", "en", None, 1)]
    rows += [(723, None, None, None, None), (724, "", "en", "s2", 0), (725, f"see {base64.b64encode(KEY.encode()).decode()} there", "en", "s2", 1), (None, "without an id of its own", "en", "s1", 1)]
    items = [(1, passage), (2, "short item"), (3, None)]
    base = str(tmp_path)
    write_tables(spark, base, rows, labels, items)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    docs, seen = spark.read.parquet(f"{base}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, base).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and set(CLASHES) <= set(docs.columns)
        seen.append(sorted(((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in docs.collect()), key=key))
    bad = {i for i, _, t in labels if t}
    kept = {r[0] for r in seen[0]}
    assert len(kept & bad) <= 0.05 * len(bad) and len(({i for i, *_ in labels} - bad) - kept) <= 0.02 * len(labels)
    groups = near_groups([r[1] for r in seen[0]])
    assert [r[0] for r in seen[1]] == [r[0] for i, r in enumerate(seen[0]) if groups[i] == i]
    assert 700 in {r[0] for r in seen[1]} and len({r[0] for r in seen[1]} & set(range(700, 706))) < 6
    hits = {r[0] for r in brute_hits([(r[0], r[1]) for r in seen[1]], items) if r[5]}
    assert 720 in hits and [r[0] for r in seen[2]] == [r[0] for r in seen[1] if r[0] not in hits]
    masked = [secrets.masked(r[1]) for r in seen[2]]
    assert [r[1] for r in seen[3]] == masked and [r[3] for r in seen[3]] == [None if t is None else len(t) for t in masked]
    assert not any(KEY in (t or "") for t in masked) and sum("[SECRET]" in (t or "") for t in masked) == 2
    want = plain_mix([(r[0], r[2], r[1]) for r in seen[3]], {i: 1 + q for i, q, _ in labels})
    got = [tuple(r) for r in corpus_pipeline.run(spark, base).collect()]
    first = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=first) == sorted(((d if d >= 0 else None, *rest) for d, *rest in want), key=first)


def test_the_pipeline_takes_odd_tables(spark, tmp_path):
    base = str(tmp_path / "empty")
    write_tables(spark, base, [], [], [])
    assert corpus_pipeline.run(spark, base).count() == 0
    base = str(tmp_path / "odd")
    tie = "a text that several ids have, word for word, in the one table"
    rows = [(5, tie, "en", "a", 1)] * 3 + [(4, tie, "en", "a", 1), (None, tie, "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None), (7, "x " * 50_000 + KEY, "en", "b", 1), (8, "", None, None, 0)]
    write_tables(spark, base, rows, [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], [(None, None), (1, ""), (1, "word")])
    docs = spark.read.parquet(f"{base}/documents.parquet")
    by = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert by["toxicity"](spark, docs, base).count() == len(rows)
    once = sorted(str(r["doc_id"]) for r in by["near duplicates"](spark, docs, base).collect())
    assert once == ["4", "7", "8"]  # a null text is a copy of the empty one
    assert sorted(str(r["doc_id"]) for r in by["benchmark decontamination"](spark, docs, base).collect()) == ["7", "8", "None", "None"]  # those without the word
    hidden = by["secret scans"](spark, docs, base).collect()
    assert len(hidden) == len(rows) and not any(KEY in (r["text"] or "") for r in hidden)
    assert by["mixing"](spark, docs, base).count() == len(rows)
    assert corpus_pipeline.run(spark, base).count() == 2
