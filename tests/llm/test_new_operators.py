"""Fill-in-middle, filter orders and learned partitions against brute force."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textward.llm import audit, extraction, middles, nearest

DOCS = "doc_id long, text string, source string, output_ string, `a.b` int"


def rows():
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["NASA", "a#b", "é", "日本", "Yes"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 400))) for _ in range(60)]
    texts += ["", None, "x", "\t\n ", "é🙂" * 30, "has <P> in", "has <M>", "<S", "S>", "<<S", "A" * 50, "word " * 250, "a" * 300_000, texts[3], texts[3], texts[4], "\r\n"]
    out = [(k, t, [None, "", "s1", "s2"][k % 4], "kept", k) for k, t in enumerate(texts)]
    return [*out, (5, texts[5], "s1", "again", 1), (5, texts[5], "s1", "again", 1), (None, texts[3], "s2", "null", 2), (None, "other", None, "null", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def _draws(key, seed=1):
    h = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def _plain_fim(key, text, units=None):
    t = text or ""
    starts = [m.start() for m in re.finditer(units or r"(?s:.)", t)]
    n, (h1, h2, h3, h4) = len(starts), _draws(key)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    place = lambda rank: 0 if rank == 0 else len(t) if rank >= n else starts[rank]
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[: place(a)], t[place(a) : place(b)], t[place(b) :]
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_middles(spark, docs):
    got = sorted((tuple(r) for r in middles.digests(docs).collect()), key=repr)
    want = []
    for k, t, *_ in rows():
        n, form, p, m, out = _plain_fim(k, t)
        want.append((k, n, form, p, m, _sha(out), _sha(t or "")))
    assert got == sorted(want, key=repr) and {w[2] for w in want} == {"plain", "psm", "spm"}
    assert middles.digests(docs.limit(0)).count() == 0


def test_middles_carry_columns_and_cut_at_any_unit(spark, docs):
    out = middles.filled(docs, unit=r"\S+").collect()
    assert sorted((r.doc_id, r.output, r.form, r.n, r.prefix_chars, r.middle_chars) for r in out if r.doc_id is not None) == sorted((k, *(lambda w: (w[4], w[1], w[0], w[2], w[3]))(_plain_fim(k, t, r"\S+"))) for k, t, *_ in rows() if k is not None)
    assert sorted(((r.doc_id, r.text, r.source, r.output_, r["a.b"]) for r in out), key=repr) == sorted(rows(), key=repr)
    assert middles.filled(docs.select("doc_id", "text"), rate=0).where("form <> 'plain'").count() == 0
    with pytest.raises(ValueError, match="form"):
        middles.filled(docs.withColumn("form", F.lit(1)))


def test_matcher_keeps_nothing_of_what_it_passes():
    """The second pass stops at the second rank: a unit further on is never matched."""
    class Counting:
        def __init__(self, pattern):
            self.pattern, self.seen = re.compile(pattern), 0

        def finditer(self, text):
            for m in self.pattern.finditer(text):
                self.seen += 1
                yield m

    matcher = Counting(r"\w")
    assert middles.cuts(matcher, "abcdefgh", 2, 4) == (2, 4) and matcher.seen == 5
    assert middles.units(matcher, "a-b-c") == 3
    assert [middles.cuts(re.compile(r"\w"), "-a-b", *x) for x in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (0, 2))] == [(0, 0), (0, 3), (3, 3), (3, 4), (4, 4), (0, 4)]
    assert middles.cuts(re.compile("z"), "ab", 0, 0) == (0, 0)


def _plain_audit(docs, labels):
    first = {}
    for k, t, *_ in docs:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    counts = {}
    for k, t, source, *_ in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": k is not None and first[t] < k,
        }
        good = any(x == k and q == 1 for x, q, _ in labels) and k is not None
        toxic = any(x == k and y == 1 for x, _, y in labels) and k is not None
        for o in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(o, 1):
                c = counts.setdefault((source or "", "".join(o), step), [0] * 7)
                here = fails[f] and not gone
                for at, yes in enumerate((not gone and not here, here, fails[f] and gone, fails[f] and sum(fails.values()) == 1, here and good, here and toxic)):
                    c[at] += yes
                gone |= here
    for (part, o, step), c in counts.items():
        c[6] = sum(d[1] for (p, o2, s2), d in counts.items() if p == part and o2[s2 - 1] == o[step - 1])
    return sorted((*k, *c) for k, c in counts.items())


def test_filter_orders(spark, docs):
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(0, 90, 2)] + [(3, None, 1), (3, 0, 0), (None, 1, 1), (999, 1, 1), (4, 1, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audited(docs, table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == _plain_audit(rows(), labels)
    assert audit.audited(docs.limit(0), table).count() == 0
    assert audit.audited(docs, table.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def _brute(table, asked, k):
    out = {}
    for q, v in asked:
        d = sorted({(float(np.sqrt(((np.array(v, np.float64) - np.array(w, np.float64)) ** 2).sum())), i) for i, w in table if i != q and len(w) == len(v)})
        out[q] = d[:k]
    return out


def _usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("sizes", [(8192, 4096), (64, 48)])
def test_learned_partitions(spark, sizes, monkeypatch):
    """Clusters, a vector that a third of all rows have, ties, odd vectors, and (with small leaves) several levels."""
    monkeypatch.setattr(nearest, "LEAF", sizes[0])
    monkeypatch.setattr(nearest, "SAMPLE", 4096 if sizes[0] > 100 else 256)
    monkeypatch.setattr(nearest, "BLOCK", sizes[1])
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    many = [(k, [float(np.float32(x)) for x in (centres[k % 12] + 0.3 * r.normal(size=16))]) for k in range(900)]
    many += [(k, many[7][1]) for k in range(900, 1350)]  # copies
    many += [(1350, [1.0] * 3), (1351, [2.0] * 3), (1352, [0.5] * 3), (1353, [2.0] * 3), (1360, [0.0] * 16), (1370, None), (1380, [1.0, None] * 8), (1390, [float("nan")] * 16), (1391, [float("inf")] * 16), (1392, [])]
    many += [(None, many[1][1]), many[20], many[20], many[40], (1400, [-x for x in many[0][1]]), (1353, [2.0] * 3)]
    df = spark.createDataFrame([(k, v, "clash") for k, v in many], "vec_id long, embedding array<float>, rank string").repartition(4)
    good = [(k, v) for k, v in many if k is not None and _usable(v)]
    asked = [(k, v) for k, v in good if k % 10 == 0 or k > 1340]
    got = {}
    for x in nearest.search(df, df.where("vec_id % 10 = 0 or vec_id > 1340")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.score, x.vec_id))
    want = _brute(good, asked, 10)
    assert set(got) == set(want)
    found = total = 0
    dist = {(q, i): d for q, near in _brute(good, asked, 10**9).items() for d, i in near}
    for q, near in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, len(near) + 1))
        assert [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine) and all(abs(dist[q, i] - s) < 1e-9 for _, s, i in mine)
        found += len({i for _, _, i in mine} & {i for _, i in near})
        total += len(near)
    assert found >= 0.93 * total
    assert [i for _, _, i in sorted(got[1350])] == [1352, 1351, 1353]  # few of a length: all of them, ties by id
    assert [i for _, _, i in sorted(got[950])][:10] == [7, 900, 901, 902, 903, 904, 905, 906, 907, 908]  # copies: the smallest ids
    assert nearest.search(df.limit(0), df).count() == 0


def test_recall_on_plain_noise(spark):
    """Vectors without any structure, where partitions help least."""
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in nearest.search(df, df.where("vec_id % 30 = 0")).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    hits = 0
    for q in range(0, 3000, 30):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 1000


def test_parts_are_balanced_and_keep_neighbours_together():
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(8, 6)) * 10, 50, axis=0) + r.normal(size=(400, 6))
    near = nearest.nearest_of(x, x, 5, np.arange(400))
    part = nearest.balanced_parts(near, 4)
    assert np.bincount(part, minlength=4).max() <= int(np.ceil(400 / 4 * 1.05))
    assert (part[np.repeat(np.arange(400), 5)] == part[near.ravel()]).mean() > 0.6


STORY = " ".join(f"The {w} stood by the old stone wall, and nobody knew why it had come." for w in "dog cat cow hen fox owl".split())


def read(html):
    return extraction.taken(extraction.parse(html), None)


def test_extraction_keeps_what_stands_beside_the_body():
    for before, after in (("<h1>Title</h1>", ""), ("<p>Lead</p>", ""), ("", "<div class=more><p>The end</p></div>"), ("<div><h2>Title</h2><p>Lead</p></div>", "<blockquote>Said</blockquote><ul><li>one<li>two</ul>")):
        got = read(f"<nav>Menu</nav><div id=a>{before}<div class=body>{STORY} {STORY}</div>{after}</div><footer>Foot</footer>").split("\n")
        assert f"{STORY} {STORY}" in got and "Menu" not in got and "Foot" not in got
        assert all(x in got for x in ("Title", "Lead", "The end", "Said", "one", "two") if f">{x}" in before + after)
    assert read(f"<body><nav>Menu</nav><div><a href=x>{STORY}</a></div></body>") == STORY  # all of the text is in links
    assert read(f"<div><div class=body>{STORY}</div><div><a href=x>More to read</a></div></div>") == STORY


def test_extraction_reads_names_in_parts():
    for name in "post-comments__list user-comment-list reader-responses ad-300x250 advert2 AdBox cookieBanner outbrain comment-1234 ad_slot_2".split():
        assert read(f'<div><div class=body><p>{STORY}</p></div><div class="{name}"><p>Noise</p></div></div>') == STORY, name
    for name in "ad-hoc adHoc no-sidebar search-result col-md-8 post-1 comment-policy-essay overflow-hidden h2 300x250 iPad lg:hidden".split():
        assert read(f'<article><p>{STORY}</p><div class="{name}"><p>Kept</p></div></article>').endswith("\nKept"), name


def test_extraction_leaves_out_at_any_depth():
    for depth in (3, extraction.DEPTH - 3, extraction.DEPTH, 4 * extraction.DEPTH):
        inner = "<p>one</p><div class=comments><div>Noise</div><section>Noise<nav>Noise</nav></section><p>Noise</p></div><p>two</p><nav><div>Noise</div></nav><p>three</p>"
        got = read(f"<article><p>{STORY}</p>{'<div>' * depth}{inner}{'</div>' * depth}<p>end</p></article>").split("\n")
        assert " ".join(got[1:]) == "one two three end", depth
