"""The ten operators on small tables, against brute force, round trips and held-out labels."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontamination, exact_dedup, html_text, near_dedup, pii, quality, sharding, toxicity, url_filter

LONG = "word " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [(1, "a b c"), (2, None), (3, ""), (4, " \n"), (5, LONG), (6, "a b c"), (6, "a b c"), (None, "a b c"), (7, "a  b c "), (8, "x")]
    return spark.createDataFrame([(i, t, "k", 0, "w") for i, t in rows], "doc_id bigint, text string, key string, node int, words string")


def texts(spark, *t):
    return spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string")


def none(df):
    return df.limit(0)


def test_shards(spark, odd):
    r = random.Random(0)
    base = ["t%d " % i * r.randint(1, 60) for i in range(300)]
    docs = texts(spark, *base, *base[:100])
    got = sharding.assign_shards(docs, 4).collect()
    sizes, groups = {}, {}
    for g in got:
        sizes[g.shard] = sizes.get(g.shard, 0) + g.size
        groups.setdefault(g.text_crc32, set()).add(g.shard)
    assert all(len(s) == 1 for s in groups.values()) and len(got) == 400
    line = {}
    for t in base + base[:100]:
        k = hashlib.md5(t.encode()).hexdigest()
        line[k] = line.get(k, 0) + len(t.encode()) + 1
    line = [line[k] for k in sorted(line)]

    def fits(c):
        n, left = 1, c
        for s in line:
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= 4 and max(line) <= c

    best = next(c for c in range(sum(line) // 4, sum(line)) if fits(c))
    assert max(sizes.values()) == best
    for s in sizes:
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
    assert sharding.assign_shards(odd, 3).count() == 10 and sharding.assign_shards(none(odd), 3).count() == 0


def test_exact(spark, odd):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()}
    assert (7, 7, 5, True) in got and (1, 7, 5, False) in got and (2, 4, 3, False) in got and (4, 4, 3, True) in got and (5, 5, 1, True) in got
    left = exact_dedup.drop_exact(odd)
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 7, 8] and left.columns == odd.columns
    assert exact_dedup.exact_groups(none(odd)).count() == 0


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 50, 5000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = exact_dedup.build_fuse_filter(keys)
        assert exact_dedup.fuse_contains(f, keys).all() if n else True
        assert exact_dedup.fuse_contains(f, rng.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.01


def brute_near(rows, words, threshold=80):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {i: root(i) for i in ids}


def test_near(spark, odd):
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = [r.choice("abcdefghijkl") * r.randint(1, 3) for _ in range(r.choice([6, 25, 80]))]
        for _ in range(r.choice([1, 2, 9])):
            w = base[:]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice("xyz")
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, "one"), (len(rows) + 2, "one")]
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == brute_near(rows, 2)
    assert near_dedup.near_groups(odd, 5).count() == 10 and near_dedup.near_groups(none(odd), 5).count() == 0
    left = near_dedup.drop_near(odd)
    assert left.columns == odd.columns and sorted(x.doc_id or 0 for x in left.collect()) == [0, 1, 2, 3, 4, 5, 8]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    assert {r.node: r.comp for r in near_dedup.components(e).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_ordinal_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    grade = np.digitize(x @ np.array([2, -1, 0, 0, 1.0]) + rng.logistic(size=3000) * 0.3, [-1.5, 0.5, 2.0])
    m = quality.fit_ordinal(x, grade, 4)
    assert (np.diff(m.thresholds) > 0).all() and np.abs(m.expected(x) - grade).mean() < 0.5


def test_quality(spark, odd):
    r = random.Random(1)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + r.choice(["", ","]) for _ in range(40)) for _ in range(80)]
    bad = [" ".join(r.choice(["alpha", "beta"]) + "%%%" for _ in range(40)) for _ in range(80)]
    docs = texts(spark, *good, *bad)
    ratings = docs.select("doc_id", (F.col("doc_id") < 80).cast("int").alias("quality"))
    m = quality.train(docs, ratings.where("doc_id % 4 <> 0"))
    assert all(x.accepted == (x.doc_id < 80) for x in quality.rate(docs, m).where("doc_id % 4 = 0").collect())
    assert quality.rate(odd, m).count() == 10 and quality.accept_rows(none(odd), m).columns == odd.columns
    assert quality.train(docs, ratings.limit(0)) is None and quality.rate(odd, None).where("accepted").count() == 10


def test_levenshtein_walk_against_brute_force():
    def damerau(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    r = random.Random(2)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(5, 11))) for _ in range(25)})
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice("abc")
        w = "".join(w)
        want = min(((d, t) for t in terms if t[0] == w[0] and (d := damerau(w, t)) <= toxicity.edits_for(len(t)) and toxicity.edits_for(len(t))), default=None)
        assert trie.find(w) == (want and (want[1], want[0])), w


def test_nearest_term_whatever_its_first_letter():
    def damerau(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    r = random.Random(12)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(5, 11))) for _ in range(25)})
    trie, other = toxicity.Trie(terms), 0
    for _ in range(2000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 2)):
            k = r.choice([0, r.randrange(len(w))])
            w[k : k + r.randint(0, 2)] = [r.choice("abcd") for _ in range(r.randint(0, 2))]
        w = "".join(w)
        want = min(((d, t[0] != w[:1], t) for t in terms if (d := damerau(w, t)) <= toxicity.edits_for(len(t)) and toxicity.edits_for(len(t))), default=None)
        assert trie.nearest(w) == (want and (want[2], want[0])), w
        other += bool(want and want[1])
    assert other > 50


def test_terms_with_another_first_letter_and_terms_behind_signs():
    lex = toxicity.Lexicon({"idiot": 1.0, "fritzblatt": 1.0, "ass": 1.0}, {"moron": 1.0})
    found = lambda t: [(h.word, h.term, h.position, h.edits) for h in toxicity.scan(t, lex)[1]]
    for w in ("diot", "diiot", "xdiot", "xidiot", "ritzblat", "xmoronic", "noronic"):
        assert len(found(w)) == 1 and found(w)[0][3] >= 1, w
    assert found("so/idiot") == [("idiot", "idiot", 3, 0)] and found("<b>idiot</b>") == [("idiot", "idiot", 3, 0)]
    assert found("an idiot,moronic") == [("idiot", "idiot", 3, 0), ("moronic", "moron", 9, 0)]
    assert found("x>fritzblatt.") == [("fritzblatt", "fritzblatt", 2, 0)] and found("you_idiott") == [("idiott", "idiot", 4, 1)]
    for w in ("id!ot", "@ss", "a$$", "id.iot", "idi*t", "(1d10t)", "so-id!ot/x"):
        assert len(found(w)) == 1 and found(w)[0][3] == 1, w
    assert len(found("word," * 100 + "idiot")) == 1 and len(found("x" * 70 + "/idiot")) == 1 and found("moron" + "x" * 80)[0][1] == "moron"
    assert found("word wood grass") == []


def test_toxicity(spark, odd):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7)))
    make = lambda bad: " ".join(r.choice(["fritzblat", "gromwelk"]) if bad and k % 9 == 4 else word() for k in range(40))
    docs = texts(spark, *(make(i % 3 == 0) for i in range(240)))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    m = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    got = toxicity.score_texts(docs, m).where("doc_id % 5 = 0").collect()
    assert all((g.score >= 0.5) == (g.doc_id % 3 == 0) for g in got)
    direct, told, bad = (m.score(t)[0] for t in ("you are a fritzblat and gromwelk", 'the report quotes the word "fritzblat" as an insult', "fritzlbat gromwellk gromwekl"))
    assert direct >= 0.5 > told and bad >= 0.5
    assert toxicity.score_texts(odd, m).count() == 10 and toxicity.train(none(docs), labels).score("x")[0] < 0.5


def test_toxicity_learns_from_all_hits_of_a_long_text(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeoulnst") for _ in range(r.randint(2, 7)))
    bad = [" ".join("fritzblatt" if k % 9 == 4 else word() for k in range(40)) for _ in range(80)]
    near = sorted({"fritzblatt"[:k] + c + "fritzblatt"[k + 1 :] for k in range(1, 10) for c in "bcdefghijkmnopqrstuvwxyz"} - {"fritzblatt"} | {"fritzblatt"[:k] + c + "fritzblatt"[k:] for k in range(1, 10) for c in "cdeghjkmnopqsuvwxyz"})
    assert len(near) > 250
    clean = [" ".join(near), *(" ".join(word() for _ in range(40)) for _ in range(119))]
    docs = texts(spark, *bad, *clean)
    m = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") < 80).cast("int").alias("toxic")))
    assert m.lexicon.innocent >= set(near) and m.score(" ".join(near[200:]))[0] < 0.5 <= m.score("you fritzblatt fritzblatt")[0]


def test_context_scores(spark):
    lex = toxicity.Lexicon({"fritzblatt": 1.0})
    at = lambda t, lex=lex: toxicity.scan(t, lex)[1][0].context
    plain, marked, told, both, addressed = (at(t) for t in ("x y fritzblatt z", 'x "fritzblatt" z', "the report says fritzblatt", 'the report says "fritzblatt" there', 'you said "fritzblatt" there'))
    assert addressed < both and plain < 0.1 < told <= both and marked == 0.5 and both > 0.9
    mass, hits = toxicity.scan('x "fritzblatt" z fritzblatt a fritzblatt', lex)
    assert abs(sum(mass) - 3) < 1e-9 and abs(mass[2] - sum(h.context for h in hits)) < 1e-9
    # labels tell that "blorp" stands by terms in texts that aren't toxic; a word by both kinds alike tells nothing
    r = random.Random(2)
    fill = lambda: " ".join(f"{r.choice('abcdefghi')}{r.randrange(400)}x" for _ in range(12))
    rows = [(f"{fill()} fritzblatt even {fill()}", 1) for _ in range(300)] + [(f"{fill()} fritzblatt even blorp {fill()}", 0) for _ in range(4)] + [(fill(), 0) for _ in range(600)]
    docs = texts(spark, *(t for t, _ in rows))
    m = toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int"))
    learnt = m.lexicon.context
    assert learnt["blorp"] > 1 and abs(learnt.get("even", 0.0)) < 0.1 and at("fritzblatt even blorp", m.lexicon) > at("fritzblatt even", m.lexicon)


def test_scores_against_the_written_out_formula(spark):
    """Every score from its hits: context by the words around, masses by weight, edits and context, then the curve."""
    lex = toxicity.Lexicon({"fritzblatt": 2.0}, {"gromw": 1.5}, frozenset({"gromx"}), {"zed": 1.0})
    m = toxicity.ToxicModel(lex, np.array([-2.0, 1.5, 0.5, 0.2]))
    cases = {"": [], "plain words": [], "a fritzblatt b": [(2.0, 0, -3.0)], "you fritzblatt": [(2.0, 0, -6.0)], "says zed gromwelk": [(1.5, 0, -0.5)], "fritzblat": [(2.0, 1, -3.0)], "gromx": [], "frtizblatt and gromwx": [(2.0, 1, -3.0), (1.5, 0, -3.0)]}
    got = {r.doc_id: r for r in toxicity.score_texts(texts(spark, *cases), m).collect()}
    for i, hits in enumerate(cases.values()):
        q = [1 / (1 + np.exp(-s)) for _, _, s in hits]
        exact, near = (sum(w * (1 - c) for (w, e, _), c in zip(hits, q) if bool(e) == b) for b in (False, True))
        quoted = sum(w * c for (w, _, _), c in zip(hits, q))
        direct = exact + 0.5 * near
        z = -2.0 + 1.5 * np.log1p(direct) + 0.5 * min(direct, 15) / 5 + 0.2 * np.log1p(quoted)
        assert len(got[i].hits) == len(hits) and abs(got[i].score - 1 / (1 + np.exp(-z))) < 1e-9, list(cases)[i]


def test_rare_terms_and_many_endings_keep_their_place_in_the_lexicon(spark):
    fills = [a + b + c for a in "aeiou" for b in "lmnr" for c in "aeiou"]
    rare = [a + b + c + "zz" for a in "bcdfg" for b in "xzvwk" for c in "jqhp"]
    # each rare term stands in 40 of 6,000 toxic texts, under 1%
    toxic = [f"{fills[i * 7 % 100]} {fills[i % 100]} {rare[i // 40] if i < 4000 else fills[i % 9]}" for i in range(6000)]
    clean = [f"{fills[i * 7 % 100]} {fills[i % 100]} word" for i in range(6000)]
    table = lambda bad, good: spark.createDataFrame([(t, 1) for t in bad] + [(t, 0) for t in good], "text string, label int")
    assert set(toxicity.learn_lexicon(table(toxic, clean)).words) == set(rare)
    # stems of one word take the first places by worth, and all but one of them go
    broken = [f"{fills[i % 100]} brok{'abcdefgh'[i % 8]}{'xyzw'[i // 8 % 4]}" for i in range(2000)]
    plonk = [f"{fills[i % 100]} plonk" for i in range(200)]
    lex = toxicity.learn_lexicon(table(broken + plonk, clean), most=2)
    assert set(lex.stems) == {"brok"} and set(lex.words) == {"plonk"}


def test_html(spark):
    m = html_text.trained()
    made = [html_text.labelled_page(k) for k in range(5000, 5080)]
    assert sum(m.extract(h) == t for h, t in made) >= 76
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a &amp; b"), (4, "u", "<" * 5000), (5, "u", '<body><nav><ul><li><a href="/x">m</a></li></ul></nav><article><h1>T</h1><p>One\n two<p>three &lt;</article><footer>&copy; x</footer>')]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[2] == "" and got[5] == "T\nOne two\nthree <"


def test_html_comments_without_marks():
    """Comments that no class or id tells go, wherever they stand; what looks a little like them in an article stays."""
    m = html_text.trained()
    parts = ["A title of things", "The first paragraph is long enough to be read. It has two sentences, and a comma.", "A second paragraph follows, which tells more. It goes on.", "And a third one ends it all, with some words more."]
    head, want = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:]), "\n".join(parts)
    foot = "<footer>&copy; x.example.net &middot; A word.</footer>"
    comments = [
        "<div><p>Anna</p><p>Great post, I liked it.</p></div><div><p>Tom Smith</p><p>I do not agree with this at all.</p></div>",
        "<h3>3 Comments</h3><p>Great post, I liked it.</p><p>Nice one.</p>",
        "<p>Anna wrote:</p><p>Great post, I liked it.</p><p>Bob wrote:</p><p>Me too, thanks.</p>",
        "<div><b>Anna</b> 3 days ago<p>Great post, I liked it.</p></div><div><b>Bob</b> 2 hours ago<p>Well.</p></div>",
        "<h2>Comments</h2><ul><li>Great post, I liked it.</li><li>Me too.</li></ul>",
        "<ul><li><strong>Anna</strong><p>Great post, I liked it.</p></li><li><strong>Bob</strong><p>Me too.</p></li></ul>",
    ]
    for c in comments:
        for page in (f"<article>{head}{c}</article>{foot}", f"<article>{head}<div>{c}</div></article>{foot}", f"<article>{head}</article><div>{c}</div>{foot}", f"<main><article>{head}</article>{c}</main>{foot}"):
            assert m.extract(f"<body>{page}</body>") == want, page
    clean = [
        "<p><b>Anna:</b> What do you think of it, in your words?</p><p><b>Bob:</b> It is a long story, and it began in spring.</p>",
        "<h2>Discussion</h2><p>These numbers agree with what was known before. They leave one question.</p>",
        "<div><h3>First step</h3><p>Take the box out of the bag, and open it.</p></div><div><h3>Second step</h3><p>Put the parts together. Then wait.</p></div>",
        "<ul><li><b>Speed</b>: as fast as it gets.</li><li><b>Price</b>: a little high, but fair.</li></ul>",
        "<p>I left my house at 12:30 and walked to the station. You could see the hills, and my bag was light.</p>",
        "<table><tr><td>One</td><td>Two things</td></tr><tr><td>Three</td><td>Four more</td></tr></table>",
        "<blockquote>It was a good day for all of us, and nobody said a word.</blockquote>",
    ]
    for c in clean:
        page = html_text.parse(f"<body>{c}</body>")
        assert m.extract(f"<body><article>{head}{c}</article>{foot}</body>") == "\n".join([want, *(b for _, b in page.blocks)]), c
    # a comments' heading, then like rows: every node's state follows from one pass, whatever their number
    many = f"<article>{head}</article><div><h3>Comments</h3>" + "<div><p>Ann</p><p>I see.</p></div>" * 20_000 + "</div>"
    assert m.extract(many) == want


def test_marginals_against_all_states():
    m = html_text.trained()
    page = html_text.parse("<body><div><p>one two three.</p><ul><li>a</li><li>b</li></ul></div></body>")
    u = m.unary(html_text.node_keys(page))
    n, z, on = len(page.nodes), 0.0, np.zeros(len(page.nodes))
    for s in range(2**n):
        b = [s >> k & 1 for k in range(n)]
        p = np.exp(sum(u[k] * b[k] for k in range(n)) + sum(m.edges[html_text.edge_kind(x)][b[x.parent]][b[k]] for k, x in enumerate(page.nodes) if k))
        z, on = z + p, on + p * np.array(b)
    assert np.allclose(m.marginals(page, u)[0], on / z)


def test_pii(spark, odd):
    key = b"k" * 16
    assert sorted(pii.feistel(v, 1000, key, "x") for v in range(1000)) == list(range(1000))
    text = "+1 (017) 555-7713, 97.51.17.173, 4845168114407329, und.34@mail7.example.com, 29/02/2024 2024-02-29 123-45-6789 DE89 3704 0044 0532 0130 00"
    new, spans = pii.pseudonymize(text, key)
    assert len(new) >= 100 and {s[0] for s in spans} == {"phone", "ip", "card", "email", "dmy", "ymd", "ssn", "iban"} and pii.pseudonymize(new, key, None, True)[0] == text
    card = next(s[3] for s in spans if s[0] == "card")
    assert pii.luhn(card) == 0 and len(card) == 16 and card != "4845168114407329"
    assert pii.pseudonymize("1234567890123456 999.1.1.1 2024-13-40 page 12", key) == ("1234567890123456 999.1.1.1 2024-13-40 page 12", [])
    got = {(r.doc_id, r.text) for r in pii.pseudonymize_texts(odd, key).collect()}
    assert (2, None) in got and (5, LONG) in got and len(pii.pseudonymize_texts(odd, key).collect()) == 10


def test_dates_are_permuted_within_each_notation():
    """Over all dates of every way of writing: no two share a pseudonym, and the inverse gives the date back."""
    import datetime as dt

    key, linked = b"k" * 16, {}
    days = [dt.date(1900, 1, 1) + dt.timedelta(n) for n in range(0, 73049)]
    ways = {
        "year first": lambda d: f"{d.year}-{d.month:02d}-{d.day:02d}", "day first": lambda d: f"{d.day:02d}/{d.month:02d}/{d.year}",
        "month first": lambda d: f"{d.month:02d}/{d.day:02d}/{d.year}" if d.day > 12 else None, "bare": lambda d: f"{d.day}.{d.month}.{d.year}", "half": lambda d: f"{d.day:02d}.{d.month}.{d.year}",
    }
    for way, write in ways.items():
        texts = {t for d in days[:: 1 if way == "month first" else 3] if (t := write(d))}
        new = {t: pii._date(t, key, False) for t in texts}
        assert len(set(new.values())) == len(texts) and all(len(a) == len(b) for a, b in new.items()), way
        assert all(pii._date(b, key, True) == a for a, b in new.items()), way
        linked[way] = new
    assert linked["year first"]["1900-01-01"].split("-") == linked["day first"]["01/01/1900"].split("/")[::-1]


def test_dates_of_all_years():
    """Every date of the calendar has one number within its way of writing; other years' pseudonyms stay outside 1900 to 2099 and read back."""
    import datetime as dt

    for how in ((True, "*", "*"), (False, "*", "*"), (True, "1", "2"), (False, "0", "1")):
        days = [d for n in range(1, dt.date(9999, 12, 31).toordinal() + 1, 1 if how[1] == "1" else 11) if ((d := dt.date.fromordinal(n)).day > 12) == how[0] and (how[1] == "*" or d.month <= 9 and (d.day > 9) == (how[2] == "2"))]
        numbers = [pii.day_number(d, how) for d in days]
        assert all(a < b for a, b in zip(numbers, numbers[1:])) and [pii.numbered_day(n, how) for n in numbers] == days
    assert pii.day_number(dt.date(9999, 12, 31), (True, "*", "*")) + 1 == pii._before(10000, (True, "*", "*"))
    key, r = b"k" * 16, random.Random(3)
    texts = {f"{y:04d}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}" for y in [*range(1, 1900), *range(2100, 10000)]} | {"1896-02-29", "2104-02-29", "29.2.1604", "1.1.0001", "31/12/9999", "12/31/1899"}
    new = {t: pii._date(t, key, False) for t in texts}
    assert len(set(new.values())) == len(texts) and all(pii._date(b, key, True) == a and len(a) == len(b) and a != b for a, b in new.items())
    assert not any(1900 <= int(re.search(r"\d{4}", b).group()) < 2100 for b in new.values())
    assert pii.pseudonymize("born 03.04.1899", key)[1][0][:3] == ("dmy", 5, 15) and pii.pseudonymize("on 0000-01-01 and 1900-02-29", key)[1] == []


def test_keys():
    new = lambda k: pii.pseudonymize("call 4111111111111111 now", k)[0]
    assert len({new(k) for k in (b"a", b"a" * 64, b"a" * 64 + b"b", b"a" * 64 + b"c", b"a" * 65)}) == 5
    with pytest.raises(ValueError):
        new(b"")


def test_phones_by_plan():
    key = b"k" * 16
    for t in ("+15550177713", "+1 (017) 555-7713", "+49 30 1234567", "+33 1 23 45 67 89", "(212) 555-0123", "212-555-0123", "01 23 45 67 89", "030/1234567", "+353 1 234 5678"):
        new, spans = pii.pseudonymize(f"call {t}, please", key)
        assert [s[:3] for s in spans] == [("phone", 5, 5 + len(t))] and new != f"call {t}, please" and pii._phone(spans[0][3], key, True) == t, t
    for t in ("rows 100 200 300 400", "scores 12 15 18 20 22", "pages 100-200-300", "chapter 1.2.3.4", "Section 10.1.2.3", "+283 1234567", "1 2 3 4 5"):
        assert pii.pseudonymize(t, key) == (t, []), t


def test_scan_against_brute_force():
    """Texts of planted values and other numbers between words: exactly the planted ones are found, each as it is."""
    r, key = random.Random(14), b"k" * 16
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        body = r.choice("3456") + digits(14)
        return body + str(-pii.luhn(body + "0") % 10)

    planted = {
        "card": card, "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "email": lambda: f"u{digits(3)}.{r.choice('abc')}@mail{r.randrange(9)}.example.com",
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}", "ymd": lambda: f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", "ssn": lambda: f"{r.randrange(1, 600):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}",
        "hex": lambda: "a1" + "".join(r.choice("0123456789abcdef") for _ in range(38)),
    }
    plain = [lambda: digits(r.randint(1, 6)), lambda: f"{r.randrange(256, 999)}.1.1.1", lambda: f"2024-{r.randrange(13, 99)}-01", lambda: "000-12-3456", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(3)},{digits(2)} EUR"]
    for _ in range(400):
        text, want = "", []
        for _ in range(r.randint(0, 8)):
            text += r.choice(["word ", "und so, ", "\n", "é "])
            if r.random() < 0.5:
                kind = r.choice(sorted(planted))
                value = planted[kind]()
                if kind == "card" and r.random() < 0.5:
                    value = " ".join(value[k : k + 4] for k in range(0, 16, 4))
                want.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += r.choice(plain)()
            text += " end "
        new, spans = pii.pseudonymize(text, key)
        assert [s[:3] for s in spans] == want, text
        at, back = 0, ""
        for kind, a, b, p in spans:
            back += text[at:a] + pii.KINDS[kind](p, key, True)
            at = b
        assert back + text[at:] == text


def test_cards_before_other_digits():
    key = b"k" * 16
    want = pii.pseudonymize("4111111111111111", key)[0]
    for card in ("4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"):
        for tail in (" 12/27", " 123", " 100 EUR", " 2024-02-29"):
            new, spans = pii.pseudonymize(f"pay {card}{tail}", key)
            assert spans[0][:3] == ("card", 4, 4 + len(card)) and "".join(c for c in spans[0][3] if c.isdigit()) == want, card + tail
            assert pii.KINDS["card"](spans[0][3], key, True) == card and new[4 : 4 + len(card)] == spans[0][3]
    new, spans = pii.pseudonymize("DE89 3704 0044 0532 0130 00 12 A", key)
    assert spans[0][0] == "iban" and new.endswith(" 12 A")
    assert set(pii.ALONE) == set(pii.KINDS)


def test_urls(spark):
    e = spark.createDataFrame([("l", "domain", "Bad.example", "2024-01-05", "add"), ("l", "domain", "bad.example", "2024-01-10", "remove"), ("m", "page", "x.bad.example/p", "2024-01-01", "add"), (None, None, None, None, None)], "list string, kind string, pattern string, day string, action string")
    c = spark.createDataFrame([(1, "http://x.bad.example/q", "2024-01-04"), (2, "http://x.bad.example/q", "2024-01-05"), (3, "https://x.bad.example:8/p/?a", "2024-01-11"), (4, None, "2024-01-05"), (5, "http://notbad.example/", "2024-01-06"), (6, "http://bad.example", None)], "page_id bigint, url string, fetched string")
    assert {r.page_id: (r.blocked, r.pattern) for r in url_filter.judge(c, e).collect()} == {1: (False, None), 2: (True, "bad.example"), 3: (True, "x.bad.example/p"), 4: (False, None), 5: (False, None), 6: (False, None)}


def test_tiling_catches_reordered_passages(spark, odd):
    item = "one two three four five six seven eight nine ten"
    docs = texts(spark, f"zero {item.upper()} end", "six seven eight nine ten x one two three four five", "one two three four five only", None, "")
    bench = spark.createDataFrame([(7, item), (8, None), (None, "a b"), (9, "tiny end")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(0, 7): (1.0, 1), (1, 7): (1.0, 2)}
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()) == [2, 3, 4]
    assert decontamination.contaminated(odd, none(bench)).count() == 0 and decontamination.drop_contaminated(odd, bench).count() == 10


def test_greedy_tiles_against_brute_force():
    def brute(d, t, k):
        md, mt, tiles = set(), set(), []
        while True:
            best = (0,)
            for i in range(len(d)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n] and i + n not in md and j + n not in mt:
                        n += 1
                    best = max(best, (n, -i, -j)) if n >= k else best
            if best[0] < k:
                return sum(tiles)
            n, i, j = best[0], -best[1], -best[2]
            md |= set(range(i, i + n))
            mt |= set(range(j, j + n))
            tiles.append(n)

    r = random.Random(4)
    for _ in range(200):
        d, t = ([r.randrange(4) for _ in range(r.randint(0, 25))] for _ in range(2))
        seeds = [(i, j) for i in range(len(d) - 2) for j in range(len(t) - 2) if d[i : i + 3] == t[j : j + 3]]
        assert sum(x[2] for x in decontamination.tile(seeds, 3, len(t))) == brute(d, t, 3)


def test_tiling_of_whole_texts_against_brute_force(spark):
    """Seeds, matches and coverage of documents and items, short and repeated words included."""
    def brute(d, t, least):
        k, md, mt, total = min(least, len(t)), set(), set(), 0
        while t:
            best = (0,)
            for i in range(len(d)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n] and i + n not in md and j + n not in mt:
                        n += 1
                    best = max(best, (n, -i, -j)) if n >= k else best
            if best[0] < k:
                break
            n, i, j = best[0], -best[1], -best[2]
            md |= set(range(i, i + n))
            mt |= set(range(j, j + n))
            total += n
        return total / len(t) if t else 0

    r = random.Random(23)
    words = lambda n, kinds: [r.choice("abcdefgh"[:kinds]) for _ in range(n)]
    items = [words(r.choice([1, 3, 6, 12, 20]), r.choice([1, 2, 4])) for _ in range(12)] + [[]]
    rows = []
    for _ in range(60):
        d = words(r.randint(0, 15), r.choice([1, 3, 8]))
        t = r.choice(items)
        d[r.randint(0, len(d)) : 0] = t[r.randint(0, len(t)) :] + t[: r.randint(0, len(t))]
        rows.append(d)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    want = {(i, k): round(c, 9) for i, d in enumerate(rows) for k, t in enumerate(items) if (c := brute(d, t, 4)) >= 0.6}
    got = {(x.doc_id, x.item_id): round(x.coverage, 9) for x in decontamination.contaminated(texts(spark, *map(" ".join, rows)), bench, least=4).collect()}
    assert got == want and len(want) > 40


def test_tiling_of_repeated_words_is_quick(monkeypatch):
    import time

    monkeypatch.setattr(decontamination, "SEEDS_AT_ONCE", 1 << 16)
    block = decontamination.Items(list(range(50)), [np.full(60, 7, np.uint64) for _ in range(50)], 5)
    began = time.time()
    got = list(block.matches(np.full(20_000, 7, np.uint64)))
    assert len(got) == 50 and all(c == 1.0 and len(t) == 1 for _, c, t in got) and time.time() - began < 60


def test_windows_dont_show_in_features(monkeypatch):
    r = random.Random(17)
    text = " ".join(r.choice(["Alpha", "beta", "x1", "été", "beta beta", ",,", "\n"]) for _ in range(3000)).encode()
    want = quality.features(text)
    for n in (64, 101, 4096):
        monkeypatch.setattr(quality, "WINDOW", n)
        assert np.allclose(quality.features(text), want, atol=1e-6), n


def test_ordinal_fit_against_brute_force():
    """The likelihood written out: the fit is where a grid over weight and thresholds has its best."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 1)).astype(np.float32)
    grade = np.digitize(1.5 * x[:, 0] + rng.logistic(size=400), [-1.0, 1.0])
    share = 1 / np.bincount(grade)[grade]

    def likelihood(w, t):
        total = 0.0
        for k, s in enumerate(share):
            above = [1.0, *(1 / (1 + np.exp(-(w * x[k, 0] - c))) for c in t), 0.0]
            total += s * np.log(above[grade[k]] - above[grade[k] + 1])
        return total

    m = quality.fit_ordinal(x, grade, 3, steps=2000, decay=0.0)
    w, t = float(m.weights[0]), m.thresholds
    best = max(likelihood(w + a, (t[0] + b, t[1] + c)) for a in (-0.1, 0, 0.1) for b in (-0.1, 0, 0.1) for c in (-0.1, 0, 0.1))
    assert likelihood(w, t) >= best - 1e-6
    tails = m.tails(x[:5])
    assert np.allclose(tails, [[1 / (1 + np.exp(-(w * v[0] - c))) for c in t] for v in x[:5]], atol=1e-5) and np.allclose(m.expected(x[:5]), tails.sum(1))


def test_too_many_grades(spark):
    with pytest.raises(ValueError):
        quality.train(texts(spark, *"ab"), spark.createDataFrame([(i, i) for i in range(101)], "doc_id bigint, quality int"))


def test_urls_that_are_odd(spark):
    e = spark.createDataFrame([("l", "domain", "com", "2024-01-01", "add"), ("l", "domain", "com", "2024-01-01", "add")], "list string, kind string, pattern string, day string, action string")
    rows = [(1, "http://a.com/" + "x" * 50_000), (2, None), (3, ""), (4, "no url"), (5, "http://a.com"), (5, "http://a.com"), (None, "http://b.org/"), *((k, f"http://hot.com/{k % 3}") for k in range(10, 60))]
    c = spark.createDataFrame([(i, u, "2024-02-01", 1, 2, "k") for i, u in rows], "page_id bigint, url string, fetched string, salt int, hit int, pattern string")
    got = [(r.page_id or 0, r.blocked) for r in url_filter.judge(c, e).collect()]
    assert sorted(got) == sorted((i or 0, bool(u and "com" in u)) for i, u in rows)
    assert url_filter.judge(none(c), e).count() == 0 and url_filter.judge(c, none(e)).where("blocked").count() == 0


def test_empty_and_odd_pages_and_models(spark, odd):
    pages = spark.createDataFrame([(1, "u", "<p>One two.", 7), (1, "u", "<p>One two.", 7), (None, None, None, None)], "page_id bigint, url string, html string, text int")
    got = html_text.extract_pages(pages).collect()
    assert len(got) == 3 and html_text.extract_pages(none(pages)).count() == 0
    assert toxicity.score_texts(none(odd), toxicity.ToxicModel(toxicity.Lexicon({}), np.zeros(4))).count() == 0 and quality.rate(none(odd), None).count() == 0


def test_bpe_as_tiktoken(spark, odd):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    hard = ["<|endoftext|> x", "  \n\n\t a", "été 漢字 😀👍🏽", "a b c", "'s'LL don't", "x" * 3000, "".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x11000), 32, 10, 65])) for _ in range(3000))]
    docs = texts(spark, *hard, "", None)
    for g in byte_bpe.round_trip(docs).collect():
        t = ([*hard, "", ""])[g.doc_id]
        assert g.ids == enc.encode_ordinary(t) and bytes(g.decoded).decode() == t
    e = byte_bpe.encode_texts(docs)
    for g, d in zip(e.orderBy("doc_id").collect(), byte_bpe.decode_ids(e).orderBy("doc_id").collect()):
        assert bytes(d.decoded).decode() == ([*hard, "", ""])[g.doc_id] and len(g.starts) == len(g.ids)
    assert byte_bpe.round_trip(odd).count() == 10 and byte_bpe.round_trip(none(odd)).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(8)
    sentence = lambda: " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(60))
    clean = [sentence() for _ in range(60)]
    item = sentence()
    rows = [*clean, clean[0], clean[1] + " extra", *(" ".join(w + "%%%" for w in sentence().split()) for _ in range(30)), f"{sentence()} {item}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 62 <= i < 92), 0) for i in range(93) if i % 3], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    got = docs
    for name, f in P.STAGES[:-1]:
        got = f(spark, got, d)
        assert got.columns == docs.columns, name
    want = list(range(60))
    want[1] = 1
    assert sorted(x.doc_id for x in P.run(spark, d).collect()) == want


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three  four five six"), (None, "a b"), (3, None), (4, ""), (5, LONG), (6, "item words that a test has in it")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, True) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int, _gone int, kept boolean")
    schemas = {"labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}
    for name, some in (("odd", True), ("empty", False)):
        d = f"{tmp_path}/{name}"
        (docs if some else none(docs)).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(6, None, None), (None, 1, 1)] if some else [], schemas["labels"]).write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "item words that a test has in it"), (2, None)] if some else [], schemas["benchmark"]).write.parquet(f"{d}/benchmark.parquet")
        got = P.run(spark, d).collect()
        # of equal texts the longest stays; null and empty texts are equal too
        assert sorted(r.doc_id or 0 for r in got) == ([0, 2, 3, 5] if some else [])


def test_drops(spark):
    docs = texts(spark, "a b c", "a  b c", "one two three four five six seven", "one two three four five six seven", "x", None)
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(docs).collect()) == [1, 2, 4, 5]
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs).collect()) == [0, 2, 4, 5]


def test_drops_with_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "ab"), (None, "c"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0, 1, 2, 3, 4, True) for i, t in rows], "doc_id bigint, text string, _sha int, _id int, _n int, _gone int, id int, kept boolean")
    got = exact_dedup.drop_exact(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (1, "a b"), (1, "c")]
    assert near_dedup.drop_near(docs).columns == docs.columns


@pytest.mark.parametrize("weak", [False, True])
def test_batches_against_stored_snapshots(spark, tmp_path, monkeypatch, weak):
    """Snapshots with different numbers of buckets; with weak digests, which many texts share, the byte check decides."""
    if weak:
        monkeypatch.setattr(exact_dedup, "text_digest", lambda t: F.unhex(F.sha2(F.right(exact_dedup.normalized(t), F.lit(1)), 256)))
    r = random.Random(11)
    snaps = [[(100 * k + i, f"text {r.randrange(60)} " + " " * r.randrange(3)) for i in range(40)] for k in range(3)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    for k in (0, 1):
        monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", (1 << 16, 1)[k])
        exact_dedup.store_snapshot(table(snaps[k]), f"{tmp_path}/{k}")
    sizes = [spark.read.parquet(f"{tmp_path}/{k}/filters").first()["buckets"] for k in (0, 1)]
    assert sizes[0] == 8 and sizes[1] > 8
    exact_dedup.store_snapshot(none(table(snaps[0])), f"{tmp_path}/empty")
    got = {g.doc_id: (g.known_id, g.batch_id, g.is_new) for g in exact_dedup.screen_batch(spark, table(snaps[2]), [f"{tmp_path}/{k}" for k in (0, "empty", 1)]).collect()}
    best = lambda rows, t: min(((-len(x), i) for i, x in rows if x.split() == t.split()), default=(0, None))[1]
    for i, t in snaps[2]:
        known = best(snaps[0], t)
        known = best(snaps[1], t) if known is None else known
        mine = best(snaps[2], t)
        assert got[i] == (known, mine, known is None and mine == i), i


def test_repeated_ids_are_one_document(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (5, a), (5, b), (9, b), (9, ""), (3, "x"), (None, a)]
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect())
    assert got == [(0, None, True), (1, 1, True), (3, 3, True), (5, 1, False), (5, 1, False), (9, 1, False), (9, 1, False)]
    with pytest.raises(TypeError):
        near_dedup.drop_near(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_set_intersections_against_python():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, r.integers(0, 90))) for _ in range(40)]
    got = near_dedup.intersections(sets[:15], sets[10:])
    assert (got == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[10:]] for a in sets[:15]]).all()


def test_near_in_blocks(spark, monkeypatch):
    """Groups larger than the blocks, with links between blocks only."""
    for name, n in (("BLOCK", 3), ("SET_BLOCK", 3), ("SHINGLE_BLOCK", 200), ("FIRST_BANDS", 1), ("COLUMNS_AT_ONCE", 16)):
        monkeypatch.setattr(near_dedup, name, n)
    r = random.Random(21)
    base, rows = [f"w{i}" for i in range(60)], []
    for _ in range(40):
        w = base[:]
        for k in r.sample(range(60), 4):
            w[k] = f"z{r.randrange(500)}"
        rows.append((len(rows), " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == brute_near(rows, 2)


def test_near_members_of_like_buckets_stand_once(spark, monkeypatch):
    """Full sets of a group whose members share many buckets are dealt once a member, not once a bucket."""
    for name, n in (("BLOCK", 4), ("SET_BLOCK", 4), ("FIRST_BANDS", 1)):
        monkeypatch.setattr(near_dedup, name, n)
    given, forest = [], near_dedup._forest
    monkeypatch.setattr(near_dedup, "_forest", lambda rows, *rest: given.append(rows.collect()) or forest(rows, *rest))
    r = random.Random(23)
    base, rows = [f"w{i}" for i in range(60)], []
    for _ in range(60):
        w = base[:]
        for k in r.sample(range(60), 5):
            w[k] = f"z{r.randrange(900)}"
        rows.append((len(rows), " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == brute_near(rows, 2)
    nodes = [x.node for x in given[0]]
    assert len(nodes) > 4 * near_dedup.SET_BLOCK and len(nodes) == len(set(nodes))
