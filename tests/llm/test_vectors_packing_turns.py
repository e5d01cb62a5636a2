"""Whitening, packing and turn repair on small tables, against exact arithmetic, the tokenizers library and all edit sequences."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import packing, turn_repair, whitening

# ---- whitening


def test_outer_sums_against_fractions():
    rng = np.random.default_rng(1)
    x = np.unique((rng.normal(size=(1500, 5)) * np.array([1, 5, 200, 1e4, 1e7])).astype(np.int64) + 10**9, axis=0)
    n, sums = len(x), [int(v) for v in x.sum(axis=0)]
    high, low = whitening.outer_sums(*whitening.Whitening(n, sums, np.zeros((5, 0)), [], 0.0).centred(x))
    for i, j in itertools.product(range(5), range(5)):
        exact = Fraction(sum((n * int(a) - sums[i]) * (n * int(b) - sums[j]) for a, b in zip(x[:, i], x[:, j], strict=True)), n * n)
        size = np.sqrt(float(high[i, i]) * float(high[j, j]))
        assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) <= Fraction(size) * Fraction(1, 2**90)


def test_components_of_very_unequal_variances():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    values = 10.0 ** np.arange(6, -2, -1)
    got, axes = whitening.components(q * values @ q.T, np.zeros((8, 8)))
    assert np.allclose(got, values, rtol=1e-8) and np.abs(axes.T @ axes - np.eye(8)).max() < 1e-13
    equal, axes = whitening.components(3 * np.eye(4), np.zeros((4, 4)))
    assert np.allclose(equal, 3) and np.allclose(axes.T @ axes, np.eye(4))


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(rng.normal(size=(60, 5)) * [1, 2, 3, 4, 5] + 7)]
    copies = [(100 + i, rows[0][1], "b") for i in range(30)]
    bad = [(200, None, "c"), (201, [], "c"), (202, [1.0, None, 1.0, 1.0, 1.0], "c"), (203, [float("nan")] * 5, "c"), (204, [float("inf")] * 5, "c"), (205, [1e300] * 5, "c"), (206, [1.0, 2.0], "c"), (None, rows[1][1], "d")]
    df = spark.createDataFrame(rows + copies + bad, "vec_id bigint, embedding array<double>, component string")
    got = whitening.whiten_rows(df).collect()
    x = np.floor(np.array([r[1] for r in rows]) * 64).astype(np.int64) + 1_000_000
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    want = c @ axes / np.sqrt(values)
    assert len(got) == (60 + 30 + 1) * 5 and {r.n for r in got} == {60} and all(r.identity_error < 1e-12 for r in got)
    by = {(r.vec_id, r.component): r for r in got}
    sign = [np.sign(by[0, k + 1].whitened * want[0, k]) for k in range(5)]
    for i in range(60):
        assert by[i, 1].deviation == int(((60 * x[i] - x.sum(axis=0)) ** 2).sum())
        assert np.allclose([by[i, k + 1].whitened * sign[k] for k in range(5)], want[i], atol=1e-9)
    assert np.allclose([by[0, k + 1].explained for k in range(5)], values / values.sum())
    assert by[105, 2].whitened == by[0, 2].whitened and (None, 3) in by


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert whitening.whiten_rows(one).count() == 0 and whitening.whiten_rows(one.limit(0)).count() == 0
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [7.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert {r.component for r in whitening.whiten_rows(flat).collect()} == {1}


# ---- packing


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_ids_as_the_library(monkeypatch):
    own = packing.Encoder(path())
    r = random.Random(1)
    signs = "aB1'́̇éİΣß日 .,-\x1c̈́‍가\U0001f600 \n \t"
    texts = ["", " ", "Don't STOP, it's 12.5 o'clock!", "<|endoftext|> x", "word " * 3000, "x" * 3000, "日本語" * 400] + ["".join(r.choice(signs) for _ in range(50)) for _ in range(300)]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.texts(texts)] == want
    monkeypatch.setattr(packing, "KNOWN", 3)
    monkeypatch.setattr(packing, "TOGETHER", 2)
    assert [np.frombuffer(i, "<u4").tolist() for t in texts for i in own.texts([t])] == want


def packed(rows, size):
    """Asserts that sequences hold no more than size, without gaps; gives their number."""
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


def test_packing(spark):
    texts = ["a b c", None, "", "one two three four five six " * 700, "a b c", "x y " * 500]
    docs = spark.createDataFrame([(None if i == 4 else i, t, "k", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, row string, length int")
    got = packing.pack_documents(docs, path()).collect()
    own = packing.Encoder(path())
    for i, t in enumerate(texts):
        ids = [*np.frombuffer(own.texts([t or ""])[0], "<u4").tolist(), 0]
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == (None if i == 4 else i))
        assert pieces == [(k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert packed(got, 2048) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack_documents(docs.limit(0), path()).count() == 0


def test_packing_in_rounds(spark):
    r = random.Random(2)
    lengths = [r.choice((20, 33, 50, 61, 7)) for _ in range(1200)] + [64] * 9
    got = packing.pack_pieces(spark.createDataFrame([(x,) for x in lengths], "length int"), 64, block=60).collect()
    assert sorted(x.length for x in got) == sorted(lengths)
    alone = packing.pack_block(np.array([x for x in lengths if x < 64]), 64)
    assert packed(got, 64) <= 9 + 1.03 * (alone.max() + 1)


def test_local_search_frees_bins():
    # the first two and the last two fit, but longest first puts 6 with 4
    assert packing.best_fit(np.array([6, 4, 3, 3, 2, 2]), 10).max() == 1
    saved = 0
    for seed in range(30):
        lengths = np.random.default_rng(seed).integers(25, 55, 200)
        first = packing.best_fit(lengths, 100)
        bins = packing.Search(lengths, first, 100).run(8)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= 100 and fill.sum() == lengths.sum()
        assert (fill**2).sum() >= (np.bincount(first, weights=lengths) ** 2).sum()
        saved += first.max() + 1 - (fill > 0).sum()
        assert (fill > 0).sum() >= packing.fewest(lengths, 100)
    assert saved > 0


def test_each_step_raises_the_sum_of_squared_fills():
    lengths = np.array([60, 50, 45, 45, 40, 30, 30])
    search = packing.Search(lengths, np.array([0, 1, 0 + 2, 3, 1, 3, 2]), 100)
    while True:
        before, giver = (search.fill**2).sum(), int(np.argmin(np.where(search.fill > 0, search.fill, 1000)))
        if not search.step(giver):
            break
        assert (search.fill**2).sum() > before and (np.bincount(search.bins, weights=lengths, minlength=4) == search.fill).all()


# ---- turn repair


def brute(rows):
    """(cost, audit, lines) of the cheapest edits of (role, text) rows in order, from all sequences with up to two insertions at a time."""
    seen, kinds = set(), []
    for role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "fine")
        seen.add((role, text))
    options = []
    for (role, text), kind in zip(rows, kinds, strict=True):
        own = [(4, "D", "", None)]
        if kind in ("truncated", "fine"):
            more = 3 * (kind == "truncated")
            own += [(more, "K", role[:1], f"{role}:{text}")] + [(3 + more, "R", r[:1], f"{r}:{text}") for r in ("user", "assistant")]
        options.append(own)
    spare = [()] + [(a,) for a in ("user", "assistant")] + [("user", "assistant"), ("assistant", "user")]
    best = None
    for edits in itertools.product(*options):
        for added in itertools.product(spare, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + 3 * sum(map(len, added))
            if best and cost > best[0]:
                continue
            audit, roles, lines = "", "", []
            for k in range(len(rows) + 1):
                for a in added[k]:
                    audit, roles, lines = audit + "I", roles + a[:1], [*lines, a + ":"]
                if k < len(rows):
                    audit, roles = audit + edits[k][1], roles + edits[k][2]
                    lines = lines + [edits[k][3]] * (edits[k][3] is not None)
            rest = roles[1:] if roles[:1] == "s" else roles
            if (roles == "" or rest and rest == "ua" * (len(rest) // 2)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_repair_against_all_edit_sequences(spark):
    r = random.Random(5)
    rows, given = [], {}
    for c in range(40):
        given[c] = [(r.choice(("system", "user", "assistant", "assistant", "tool", " ")), r.choice(("Yes.", "No", " \n", "Why?", "b! \t"))) for _ in range(r.randint(1, 3))]
        rows += [(c, 10 * t, role, text) for t, (role, text) in enumerate(given[c])]
    got = {x.conv_id: x for x in turn_repair.repair_conversations(conversations(spark, rows)).collect()}
    assert len(got) == 40
    for c, own in given.items():
        cost, audit, lines = brute(own)
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), own
        assert got[c].gaps == 9 * (len(own) - 1)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(own)]
        assert got[c].illegal == sum(p not in ("su", "ua", "au") for p in pairs)


def test_long_conversations_are_joined_from_runs(spark, monkeypatch):
    r = random.Random(6)
    rows = [(c, None if t < 2 else t // 2, r.choice(("system", "user", "assistant")), r.choice("abcdefghij") + r.choice((".", "", "?"))) for c in range(3) for t in range(90)]
    df = conversations(spark, rows).cache()
    whole = sorted(map(tuple, turn_repair.repair_damaged(df).collect()))
    monkeypatch.setattr(turn_repair, "RUN_BITS", 1)
    monkeypatch.setattr(turn_repair, "BATCH", 3)
    assert sorted(map(tuple, turn_repair.repair_damaged(df).collect())) == whole and len(whole) == 3


def test_repair_of_odd_tables(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, 1, "user", "a."), (1, 1, "user", "a."), (1, 2, "assistant", "word " * 30_000 + "."), (2, None, "x", ""), (3, 5, None, "b.")]
    df = spark.createDataFrame([(*x, 1, "w") for x in rows], "conv_id bigint, turn bigint, role string, text string, at int, ways string")
    got = {x.conv_id: x for x in turn_repair.repair_conversations(df).collect()}
    assert set(got) == {None, 1, 2, 3}
    assert got[1].audit == "KDK" and got[1].duplicate == 1 and got[2].audit == "D" and got[2].blank == 1 and got[None].blank == 1 and got[None].gaps == 0
    assert got[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert turn_repair.repair_damaged(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(1))
def test_damage(spark, seed):
    rows = [(c, t, "assistant", "One. Two!") for c in range(60) for t in range(5)]
    got = turn_repair.damaged(conversations(spark, rows)).collect()
    kinds = {(c, t): zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows}
    for (c, t), k in kinds.items():
        own = [(x.kept, x.role, x.text) for x in got if (x.conv_id, x.turn) == (c, t)]
        text = {1: "", 2: "One Two"}.get(k, "One. Two!")
        assert own == [(k != 0, "user" if k == 4 else "assistant", text)] * (2 if k == 3 else 1)
