"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textward.llm import bpe, bwt, digests, extraction, mixing, repeats, search, sharding, simhash, suffixes, token_files, toxicity
from textward.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string"
LINE = "the quick brown fox jumps over the lazy dog while five boxing wizards watch quietly"


def rows():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    out = [" ".join(r.choice(words) for _ in range(r.randint(3, 120))) for _ in range(40)]
    out += [LINE, LINE, f"before {LINE} after", f"{out[3]} {LINE}", out[4] + " tail", out[5], "", None, "é" * 70, "x" * 60 + "\0" + "x" * 60, "日本語 テキスト <|endoftext|> end", " \t\n"]
    return [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "clash") for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_shards(spark, docs, empty):
    got = sharding.shard_slots(docs, "doc_id", "text", 40).collect()
    assert len(got) == len(rows())
    texts = {r[0]: r[1] or "" for r in rows()}
    for g in got:
        assert g.size == len(texts[g.doc_id].encode()) + 16 and g.text_crc32 == zlib.crc32(texts[g.doc_id].encode())
        assert g.grown_shard in (g.shard, 40)
    for s in {g.shard for g in got}:
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
    draw = lambda k, s: -np.log((int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13)
    for g in got:
        assert g.shard == min(range(40), key=lambda s: draw(g.doc_id, s)) and g.grown_shard == min(range(41), key=lambda s: draw(g.doc_id, s))
    again = spark.createDataFrame([(None, "a"), (None, "a"), (5, None), (5, "b"), (5, "b")], "`k.x` long, text string")
    twice = sharding.shard_slots(again, "k.x", "text", 3).collect()
    assert len({(g.shard, g.slot) for g in twice}) == 5 and {g.doc_id: g.shard for g in twice} == {k: min(range(3), key=lambda s: draw("null" if k is None else k, s)) for k in (None, 5)}
    assert sharding.rendezvous(again, "k.x", [1, 1, 1]).count() == 5
    heavy = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    n = {r.shard: r["count"] for r in sharding.rendezvous(heavy, "k", [1, 3, 0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and abs(n[1] / n[0] - 3) < 0.3
    assert sharding.shard_slots(empty, "doc_id", "text", 4).count() == 0


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_files.round_trip(docs, path, str(tmp_path / "t")).collect()}
    start = 0
    for k, t, *_ in rows():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = token_files.fetch(spark, str(tmp_path / "t"), [3, 999])
    assert one == {3: [[*lib.encode(rows()[3][1], add_special_tokens=False).ids, 1]], 999: []}
    again = spark.createDataFrame([(7, "one"), (7, "two words"), (7, "one"), (None, "three"), (None, None), (8, "x " * 50_000)], "doc_id long, text string")
    token_files.write_tokens(again, path, str(tmp_path / "again"))
    want = {7: ["one", "one", "two words"], None: ["", "three"], 8: ["x " * 50_000]}
    assert {k: sorted(v) for k, v in token_files.fetch(spark, str(tmp_path / "again"), want).items()} == {k: sorted([*lib.encode(t, add_special_tokens=False).ids, 1] for t in v) for k, v in want.items()}
    assert token_files.round_trip(empty, path).count() == 0


def _removed(texts):
    seen = {}
    raw = {k: (t or "").encode() for k, t in texts}
    for k in sorted(raw):
        for a in range(len(raw[k]) - 49):
            seen.setdefault(raw[k][a : a + 50], k)
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 49):
            if seen[b[a : a + 50]] < k:
                gone[a : a + 50] = True
        out[k] = gone
    return raw, out


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    raw, gone = _removed([(r[0], r[1]) for r in rows()])
    for r in repeats.spans(docs).collect():
        g = gone[r.doc_id]
        kept = bytes(np.frombuffer(raw[r.doc_id], np.uint8)[~g])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], g.astype(int)))) == 1))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(g), int(g.sum()), spans, hashlib.sha256(kept).hexdigest())
    if hot == 1000:
        cut = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
        assert cut[0].h == "clash" and cut[0].text == rows()[0][1] and cut[41].text == "" and cut[41].n_chars == 0 and cut[47].text is None
        assert repeats.spans(empty).count() == 0


def test_suffix_order():
    r = random.Random(1)
    for block in (1, 3, 1000):
        strings = ["".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(25)]
        n = np.array([len(s) for s in strings])
        recs = np.concatenate(list(bwt.suffix_order(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(n) - n, n, block)))
        prefix, length, string = bwt.fields(recs)
        order = [strings[s][len(strings[s]) - k :] for k, s in zip(length.tolist(), string.tolist(), strict=True)]
        assert order == sorted(order)
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert prefix.tolist()[1:] == [common(a, b) for a, b in zip(order, order[1:], strict=False)]


def test_windows_of_a_group_are_sorted_some_times_only(monkeypatch):
    r = random.Random(2)
    base = bytes(r.choice(b"ab\0") for _ in range(300))
    strings = [base[k : k + r.randint(5, 40)] for k in (r.randint(0, 260) for _ in range(400))]
    groups, values = np.array([r.randint(0, 3) for _ in strings], np.uint32), np.array([r.randint(0, 999) for _ in strings])
    n = np.array([len(s) for s in strings])
    text, least = b"".join(strings), {}
    for s, g, v in zip(strings, groups, values, strict=True):
        for a in range(len(s) - 9):
            least[g, s[a : a + 10]] = min(v, least.get((g, s[a : a + 10]), v))
    want = [least[g, s[a : a + 10]] for s, g in zip(strings, groups, strict=True) for a in range(len(s) - 9)]
    for some in (1, 1 << 18):
        monkeypatch.setattr(suffixes, "SORTED", some)
        assert suffixes.least_of_equal(np.frombuffer(text, np.uint8), np.cumsum(n) - n, n, values, groups, 10)[0].tolist() == want
    # windows whose neighbours share all bytes aren't sorted again
    sizes, sort = [], np.argsort
    monkeypatch.setattr(suffixes.np, "argsort", lambda x, **kw: sizes.append(len(x)) or sort(x, **kw))
    long = bytes(r.randint(0, 255) for _ in range(5000)) * 2
    out, _ = suffixes.least_of_equal(np.frombuffer(long, np.uint8), np.array([0, 5000]), np.array([5000, 5000]), np.array([2, 1]), np.zeros(2, np.uint32), 50)
    assert (out == 1).all() and sum(sizes) <= 1.1 * len(out)


def test_digests(docs, empty):
    texts = {r[0]: r[1] or "" for r in rows()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in digests.neighbours(docs).collect()}
    assert len(got) == len(texts)
    for k, i in enumerate(order):
        after = texts[order[(k + 1) % len(order)]]
        e = digests.edited(texts[i], after)
        assert (got[i].n_chars, got[i].fingerprint, got[i].edited_fingerprint) == (len(texts[i]), digests.fingerprint(texts[i]), digests.fingerprint(e))
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and 0 <= got[i].near_edited <= 1
    assert got[40].fingerprint == got[41].fingerprint
    assert digests.neighbours(empty).count() == 0
    assert digests.neighbours(docs.where("doc_id = 3")).first().near_next == 1


def test_toxicity(spark):
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    texts = [" ".join([r.choice(words) for _ in range(40)] + (["stupidhead"] * 2 if k % 4 == 0 else [])) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == 402 and all(0 <= g.score <= 1 for g in got)
    held = [g for g in got if g.held_out and g.doc_id < 400]
    assert held and all(g.predicted == (g.doc_id % 4 == 0) for g in held)
    assert {g.held_out for g in got if zlib.crc32(str(g.doc_id).encode()) % 5 == 0} == {True}
    none = toxicity.judged(docs, labels.limit(0)).collect()
    assert all(g.predicted == 0 for g in none)
    flipped = labels.select("doc_id", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    kept = {g.doc_id: g.predicted for g in toxicity.judged(docs, flipped.where(toxicity.fold(F.col("doc_id")) != 0)).collect()}
    assert kept == {g.doc_id: g.predicted for g in got}


def test_toxicity_learns_its_margin():
    r = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    line = lambda y: " ".join([r.choice(words) for _ in range(30)] + ["stupidhead"] * y)
    texts = [(line(k % 2), k % 2, k % 5 == 0) for k in range(200)]
    m = toxicity.fit(texts, 0.5)
    assert m.margin in toxicity.MARGINS and m.ratio("stupidhead", {}) > 0
    # words below the margin count as equally likely, whole likelihoods otherwise
    w = words[0]
    assert m.ratio(w, {}) == (m.word(w) if abs(m.word(w)) >= m.margin else 0.0)
    m.margin = 0.0
    assert m.ratio(f"{w} {words[1]}", {}) == pytest.approx((m.word(w) + m.word(words[1])) / 2)


def test_kneser_ney_models_against_plain_formulas():
    r = random.Random(9)
    toxic = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(6)) for _ in range(8)]
    ordinary = [" ".join("".join(r.choice("bcd") for _ in range(r.randint(1, 5))) for _ in range(6)) for _ in range(8)]
    m, o = toxicity.fit_models(toxic, ordinary), toxicity.ORDER

    def grams(texts):
        out = {}
        for t in set(texts):
            for w in set(t.split()):
                w = "\x02" * (o - 1) + w + "\x03"
                for k in range(len(w) - o + 1):
                    out[w[k : k + o]] = out.get(w[k : k + o], 0) + 1
        return out

    own = [grams(ordinary), grams(toxic)]
    seen = set(own[0]) | set(own[1])
    letters = {g[-1] for g in seen}

    def backed(counts, h, x, lower):
        row = {g[-1]: n for g, n in counts.items() if g[:-1] == h}
        if not row:
            return lower
        return max(row.get(x, 0) - 0.75, 0) / sum(row.values()) + 0.75 * len(row) / sum(row.values()) * lower

    def shared(h, x):
        if len(h) == o - 1:
            return shared(h[1:], x)
        counts = {}
        for g in {s[-len(h) - 2 :] for s in seen}:
            counts[g[1:]] = counts.get(g[1:], 0) + 1
        return backed(counts, h, x, shared(h[1:], x) if h else 1 / (len(letters) + 1))

    for h in sorted({g[:-1] for g in seen})[:12] + ["zzz", "bzz"]:
        for c in (0, 1):
            each = {x: m.probability(c, h + x) for x in letters | {"?"}}
            assert abs(sum(each.values()) - 1) < 1e-9
            for x, p in each.items():
                assert abs(p - backed(own[c], h, x, shared(h, x))) < 1e-12


def test_toxicity_awkward_tables(spark, tmp_path):
    words = [f"{a}{b}" for a in "bdfg" for b in "aeiou"]
    r = random.Random(4)
    texts = [" ".join([r.choice(words) for _ in range(30)] + ["nastyword"] * (k % 3 == 0)) for k in range(90)]
    docs = spark.createDataFrame([(k, t, 1.5) for k, t in enumerate(texts)] + [(None, None, 2.0), (7, texts[7], 2.5), (500, "x" * 200_000, 0.0)], "doc_id long, text string, _toxicity double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.judged(docs, labels).count() == 93
    left = toxicity.clean(docs, labels)
    assert left.columns == docs.columns and {x._toxicity for x in left.collect()} <= {0.0, 1.5, 2.0, 2.5}
    assert toxicity.judged(docs.limit(0), labels).count() == 0
    wide = {x.gram: x.n for x in toxicity.continuations(docs.where("doc_id < 90")).collect()}
    plain = toxicity.lower({g for t in texts for w in t.split() for g in toxicity._grams(w)})
    assert wide == {g: n for c in plain for g, n in c.items()}


def test_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><div id=c><div class='post-{0}'><h1>A &amp; B</h1><p>one <b>two</b>three&nbsp; x<p>four<ul><li>five<li>six</ul><div class=comments><p>bad</p></div><script>'</p>'</script></div></div><footer>f</footer>"
    pages = [(k, f"http://h{k % 2}.example/{k}", page.format(k)) for k in range(6)] + [(7, None, None), (8, "x", ""), (9, "http://h0.example", "<p>alone")]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "A & B\none twothree x\nfour\nfive\nsix" for k in range(6))
    assert got[7] == got[8] == "" and got[9] == "alone"


def test_extraction_keeps_articles_in_layout_names_and_sections(spark):
    story = "".join(f"<p>sentence {k} of the story</p>" for k in range(9))
    lines = [f"sentence {k} of the story" for k in range(9)]
    names = ("content no-sidebar", "has-sidebar", "search-result", "page-banner", "layout-sidebar-left")
    pages = [f"<body><div class='{n}'>{story}<div class=comments>bad</div></div><div class=sidebar>other</div>" for n in names]
    pages.append(f"<body><div class=text><section class=a>{story}</section><section class=b>{'<p>and then the end</p>' * 8}</section></div><div class=site-header>top</div>")
    rows = [(k, f"http://h{k}.example", p) for k, p in enumerate(pages)]
    got = {r.page_id: r.text.split("\n") for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == lines for k in range(len(names))) and got[len(names)] == lines + ["and then the end"] * 8
    noise = f"<body><div class=post>{story}</div><div class=cookie-notice>{'we use cookies ' * 99}</div><div class=main-nav>menu</div>"
    assert extraction.taken(extraction.parse(noise), None).split("\n") == lines


def test_extraction_reads_tags_as_browsers_do():
    read = lambda html: extraction.taken(extraction.parse(html), None)
    for html, text in {
        "<p>one</p><p data-x=it's>Hello it's me</p><p>end</p>": "one\nHello it's me\nend",
        "<p foo'>Hello</p><p>it's end</p>": "Hello\nit's end",
        '<p>a</p><p title="x>beta</p>': "a",
        "<form><div><p>a story in a form</p><p>two</p></div><input><button>go</button></form>": "a story in a form\ntwo",
        '<div class="widget"><p>the long article</p></div><div class="ad-hoc"><p>more</p></div>': "the long article\nmore",
        "<article><header><h1>Title</h1><p>by me</p></header><p>Body</p></article>": "Title\nBody",
        '<article><div class="post-header"><h1>Title</h1><span>by</span></div><p>Body</p></article>': "Title\nBody",
        "<p>a < b and c<d> x</p><!-- y --><p>z</p><!-- never": "a < b and c x\nz",
        "<p>some text here</p><div hidden><p>no</p></div><div class='ad-slot'>buy</div><form>name <input></form>": "some text here",
    }.items():
        assert read(html) == text
    for piece in ("<a title=\"", "<div>", "<li></li>", "<div class=sidebar>a ", "<b>", "<!--", "<", "<p a='", "&", "<p>x</p>", "<ul><li><div>"):
        began = time.process_time()
        read("<div>" * 5000 + piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 4


def test_extraction_votes_and_awkward_tables(spark):
    line = "words of the story that go on for a while " * 4 + "and end"
    page = lambda inner: f"<body><div class=top><a href=x>menu</a></div>{inner}<div class=other>{'short note ' * 3}</div>"
    good = page(f"<div class='text n{{}}'><p>{line}</p><p>{line}</p></div>")
    odd = page(f"<div class=text><p>{line}</p></div>").replace("short note ", f"{line} " * 40)
    rows = [(k, "http://a.example/x", good, 1) for k in range(5)] + [(5, "http://a.example/y", odd, 1), (6, None, good, 2), (None, "http://a.example", good, 3), (0, "http://a.example/x", good, 1), (9, "http://b.example", "<p>" + "long " * 300_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = [(r.page_id, r.text, r.n_chars) for r in extraction.extract(df).collect()]
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    assert all(t == f"{line}\n{line}" for k, t, _ in got if k in (0, 1, 2, 3, 4, 6, None))
    assert [n for k, _, n in got if k == 9] == [5 * 300_000 - 1]
    assert extraction.extract(df.limit(0)).count() == 0


def test_simhash_components(docs, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(got)
    fp = {i: simhash.fingerprint(rows()[i][1]) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert all(got[i].fp & (1 << 64) - 1 == fp[i] and got[i].component_id == find(i) for i in ids)
    assert simhash.near_duplicates(empty).count() == 0


def test_covering_masks_and_refined_buckets(spark):
    r = random.Random(3)
    for radius, parts in ((3, 1), (9, 2)):
        m = simhash.masks(list(range(64)), radius, parts)
        for _ in range(500):
            d = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not d & x for x in m)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    one, small = (simhash.components(simhash.links(df, 3, size)).collect() for size in (512, 4))
    assert sorted(map(tuple, one)) == sorted(map(tuple, small))


def test_deduplicated(spark):
    r = random.Random(4)
    words = [f"v{k}" for k in range(300)]
    base = [r.choice(words) for _ in range(200)]
    near, far = [*base], [*base]
    near[50] = "new"
    for k in range(0, 200, 8):
        far[k] = f"other{k}"
    df = spark.createDataFrame([(1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, " ".join(base), "c"), (4, " ".join(far), "d"), (5, " ".join(r.choice(words) for _ in range(90)), "e")], "doc_id long, text string, id string")
    assert sorted(x.doc_id for x in simhash.deduplicated(df).collect()) == [1, 4, 5]


def copies():
    """Near copies of five kinds around and above the limit, among texts that share a passage."""
    r = random.Random(8)
    words = [f"v{k}" for k in range(2000)]
    out = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.choice((60, 200, 400)))] + (LINE.split() if k % 3 == 0 else [])
        n, part = len(base), r.choice((0.02, 0.05, 0.1, 0.15, 0.19, 0.22))
        block, scattered = [*base], [*base]
        at, m = r.randrange(n // 2), int(n * part / 2)
        block[at : at + m] = [r.choice(words) for _ in range(m)]
        for j in r.sample(range(n), max(1, int(n * part / 12))):
            scattered[j] = r.choice(words)
        appended = base + [r.choice(words) for _ in range(int(n * part))]
        out += [base, appended, block, scattered, base[int(n * part) :]]
    r.shuffle(out)
    return [" ".join(t) for t in out] + [LINE, LINE.upper(), "", None, " "]


def kept(texts, least=0.8):
    stay = []
    for k, t in enumerate(texts):
        if not any(simhash.jaccard(texts[j], t) >= least for j in stay):
            stay.append(k)
    return stay


def test_deduplicated_meets_every_pair(spark, empty, monkeypatch):
    texts = copies()
    likeness = [simhash.jaccard(a, b) for k, a in enumerate(texts) for b in texts[:k]]
    assert sum(0.8 <= x < 0.85 for x in likeness) > 20 and sum(0.85 <= x < 0.9 for x in likeness) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in simhash.deduplicated(df).collect()) == kept(texts)
    monkeypatch.setattr(simhash, "LARGE", 1)  # thin groups of any size
    assert sorted(x.doc_id for x in simhash.deduplicated(df).collect()) == kept(texts)
    assert simhash.deduplicated(empty).count() == 0


def by_fingerprint_alone():
    """A text and its copy, whose fingerprints are linked though they are less alike than 0.8."""
    r = random.Random(21)
    while True:
        base = [f"v{r.randrange(2000)}" for _ in range(400)]
        copy = [*base]
        for j in r.sample(range(0, 400, 5), 10):
            copy[j] = f"v{r.randrange(2000)}"
        a, b = " ".join(base), " ".join(copy)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 3 and simhash.jaccard(a, b) < 0.8:
            return a, b


def test_deduplicated_by_classes(spark, monkeypatch):
    """Classes of fingerprints take away rows that no likeness of sets does; without them these stay."""
    import corpus_pipeline

    a, b = by_fingerprint_alone()
    other = " ".join(f"u{k}" for k in range(300))
    df = spark.createDataFrame([(1, other), (2, b), (3, a), (4, other + " more"), (5, b), (6, "c")], "doc_id long, text string")
    kept_ids = lambda: sorted(x.doc_id for x in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, "").collect())
    assert kept_ids() == [1, 2, 6]
    monkeypatch.setattr(simhash, "grouped", lambda docs, *_: docs.withColumn("component_id", docs["doc_id"]))
    assert kept_ids() == [1, 2, 3, 6]


def test_deduplicated_repeated_keys(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a + " more"), (2, b), (3, "c"), (None, a), (None, a)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.text) for x in simhash.deduplicated(df).collect())
    assert got == [(0, a), (0, a), (1, a), (1, b), (3, "c")]


def test_bpe_flat_ids():
    """Ids go out as numbers, not through their decimal text."""
    e = bpe.encoder(tokenizer_path("byte_bpe_50k.json"))
    for t in ("", "some words, some words", "caf\u00e9 \u6f22\u5b57 <|endoftext|> x", *(f"n{k} " * 3 for k in range(5))):
        ids, back = e.flat(t)
        assert np.frombuffer(ids, np.int32).tolist() == e.encode(t) == e.library.encode(t, add_special_tokens=False).ids and back == t == e.decode(e.encode(t))


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe.digests(docs, path).collect():
        ids = lib.encode(rows()[r.doc_id][1] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(docs, path), path, out="back")
    assert back.where("back <> coalesce(text, '')").count() == 0 and bpe.digests(empty, path).count() == 0
    e = bpe.encoder(path)
    r = random.Random(6)
    for _ in range(300):
        w = bytes(r.choice(b"abehinort ") for _ in range(r.randint(1, 14)))
        assert [e.bytes[i] for i in e.pretoken(w)] == e.merged(w)


def test_search(spark, docs, empty):
    index = search.build(docs)
    n, mean, counts = search.statistics(index)
    df = {r.term: r.n for r in counts.collect()}
    texts = {r[0]: search.words(r[1]) for r in rows()}
    assert n == len(texts) and mean == sum(map(len, texts.values())) / n
    asked = search.more_like(docs.where("doc_id % 5 = 0"), counts, n, 6)
    want = {}
    for q in asked.collect():
        scores = []
        for d, ws in texts.items():
            norm = search.K1 * (1 - search.B + search.B * len(ws) / mean)
            s = sum(t.weight * (ws.count(t.term.encode()) * (search.K1 + 1)) / (ws.count(t.term.encode()) + norm) for t in q.terms)
            if s > 0:
                scores.append((-round(s, 9), d))
        want[q.query_id] = [d for _, d in sorted(scores)[:5]]
    got = {}
    for r in search.search(spark, index, asked, mean, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {k: v for k, v in want.items() if v} and df["the"] == 4
    assert search.more_like_search(empty, empty).count() == 0


def test_search_by_first_shards(spark, monkeypatch):
    """A few shards set the limits of the others, and nothing is lost or ranked otherwise by that."""
    r = random.Random(11)
    words = [f"w{int(300 * r.random() ** 3)}" for _ in range(4000)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice((3, 30, 90)))) for _ in range(120)]
    texts += [texts[k] for k in range(0, 120, 7)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    ask = lambda: sorted((x.query_id, x["rank"], x.doc_id, x.score) for x in search.more_like_search(docs, docs.where("doc_id % 4 = 0"), 6).collect())
    whole, kept_written, tables = ask(), search.written, []
    monkeypatch.setattr(search, "written", lambda df, name, *a: tables.append((name, out := kept_written(df, name, *a))) or out)
    monkeypatch.setattr(search, "SHARD_BYTES", 900)
    monkeypatch.setattr(search, "FIRST", 3)
    assert ask() == whole and [name for name, _ in tables] == ["index", "queries", "first"]
    shards, first = tables[0][1].count(), tables[2][1]
    assert shards > 20 and first.count() <= 3 * len({q for q, *_ in whole})


def test_blocks_multiply_only_terms_that_they_have():
    """Documents of two languages: a block holds rows of the terms of its own, and the k best equal plain sums."""
    import pyarrow as pa
    import zstandard

    r = random.Random(3)
    texts = [" ".join(r.choices([f"{'ab'[d % 2]}{k}" for k in range(60)], k=400)) for d in range(4 * search.SPAN)]
    row = dict(zip([c.split()[0] for c in search.SHARD.split(", ")[1:]], map(zstandard.ZstdCompressor().compress, search._index(list(enumerate(texts)))), strict=True))
    terms = sorted({t for x in texts for t in search.words(x)})
    weights = np.array([1 + r.random() for _ in terms])
    shard = search.Shard(row, pa.array(terms, pa.binary()), weights, 40.0)
    asked = [sorted({terms.index(t) for t in search.words(x)}) for x in texts[:50]]
    q, ids, scores = shard.together(np.repeat(np.arange(50), [len(x) for x in asked]), np.concatenate(asked), np.zeros(50), 5)
    for k, numbers in enumerate(asked):
        plain = []
        for d, x in enumerate(texts):
            ws, norm = search.words(x), search.K1 * (1 - search.B + search.B * len(search.words(x)) / 40.0)
            plain.append((-sum(weights[n] * ws.count(terms[n]) * (search.K1 + 1) / (ws.count(terms[n]) + norm) for n in numbers if terms[n] in ws), d))
        got = sorted(zip(-scores[q == k], ids[q == k], strict=True))[:5]
        assert [d for _, d in got] == [d for _, d in sorted(plain)[:5]] and np.allclose([s for s, _ in got], [s for s, _ in sorted(plain)[:5]])
    rows = [x.shape[0] for x in shard._prepared()[4]]
    assert len(rows) == 4 and sum(rows) <= 0.75 * 4 * len(terms)


def test_search_asks_for_whole_texts(spark, docs):
    texts = {r[0]: search.words(r[1]) for r in rows()}
    mean = sum(map(len, texts.values())) / len(texts)
    n = {t: sum(t in ws for ws in map(set, texts.values())) for ws in texts.values() for t in ws}
    got = {}
    for r in search.more_like_search(docs, docs.where("doc_id % 5 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    for q in (k for k in texts if k % 5 == 0):
        scores = []
        for d, ws in texts.items():
            norm = search.K1 * (1 - search.B + search.B * len(ws) / mean)
            s = sum(np.log(1 + (len(texts) - n[t] + 0.5) / (n[t] + 0.5)) * ws.count(t) * (search.K1 + 1) / (ws.count(t) + norm) for t in sorted(set(texts[q])))
            if s > 0:
                scores.append((-round(s, 9), d, round(s, 6)))
        assert got.get(q, []) == [(d, s) for _, d, s in sorted(scores)[:5]]


def test_mixing(docs, empty):
    got = [(r.row.doc_id, r.row.source, r.row.h, r.size, r.source_size, r.target, r.epochs) for r in mixing.fair_mix(docs).collect()]
    assert len(got) == len(rows()) and {g[2] for g in got} == {"clash"}
    sizes, taken, target, total = {}, {}, {}, 0
    for _, s, _, size, whole, t, e in got:
        assert 0 <= e <= 3 and size <= 120
        sizes[s], target[s] = whole, t
        taken[s] = taken.get(s, 0) + size * e
        total += size
    assert sum(sizes.values()) == total and abs(sum(target.values()) - total) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 121 and target[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    again = [(r.row.doc_id, r.epochs) for r in mixing.fair_mix(docs.repartition(5)).collect()]
    assert sorted(again) == sorted((g[0], g[6]) for g in got)
    assert mixing.mixed(docs).count() == sum(g[6] for g in got) and mixing.mixed(empty).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import duckdb
    from tokenizers import Tokenizer

    import corpus_pipeline

    clean = list(dict.fromkeys(copies()[:120]))
    texts = clean + [f"{t} {'stupidhead ' * 9}" for t in clean[:30]]
    spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k >= len(clean))) for k in range(len(texts))], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, stages, results = corpus_pipeline.documents(spark, str(tmp_path)), dict(corpus_pipeline.STAGES), {}
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for name, stage in stages.items():
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        results[name] = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert list(results) == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "bpe"]
    left = [k for k, t in enumerate(texts) if model.score(model.ratio(t, {})) < 0.5]
    assert [r.doc_id for r in results["toxicity"]] == left and set(left) < set(range(len(texts)))
    one = [left[k] for k in kept([texts[k] for k in left])]
    assert [r.doc_id for r in results["simhash_near_dedup"]] == one and len(one) < len(left)
    raw, gone = _removed([(k, texts[k]) for k in one])
    cut = {k: np.frombuffer(raw[k], np.uint8)[~gone[k]].tobytes().decode("utf-8", "ignore") for k in one}
    assert {r.doc_id: r.text for r in results["suffix_array_dedup"]} == cut and any(g.any() for g in gone.values())
    from textward.llm.queries import SQL

    table = [(r.doc_id, r.source, r.text) for r in results["suffix_array_dedup"]]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", table)
    want = [k for k, size, _, _, taken in sorted(db.execute(SQL["op10_fair_mix"]).fetchall()) for _ in range(taken // size if size else 0)]
    assert [r.doc_id for r in results["mixing"]] == want
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert [r.doc_id for r in results["bpe"]] == want and all(r.exact and list(r.ids) == lib.encode(cut[r.doc_id], add_special_tokens=False).ids for r in results["bpe"])
