"""Toxicity of whole texts: Levenshtein automata over a trie of learnt terms, and context windows.

A lexicon is learnt from labelled rows: words, and stems with many endings, that mark toxic texts far more than others.
It is kept as a trie. A word's Levenshtein automaton is run along the trie's edges, and a branch is left as soon as the
automaton is dead, so misspelled terms are found at the cost of a short walk. Each hit is weighed by its distance and by
its context: the words before and after it add up to a score between direct abuse and quotation or report, from weights
that start with words of report and of address and go on with what the labels tell of contexts. A logistic curve fitted on
the same labelled rows turns exact, misspelled and quoted mass into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, text_or_empty

#: Words on either side of a hit that its context is read from.
WINDOW = 6
#: Signs cut from the ends of words; signs of a quotation or report in the languages of the corpus, and of
#: direct address; signs often written for letters.
EDGES = ".,;:!?\"'()[]{}<>|%&*#$~`^_=+/\\-–—…“”„«»‘’¿¡"
REPORTS = frozenset(
    "said says say called calls quote quoted quotes wrote writes word words term insult report reported slur "
    "dit dite mot terme insulte sagte sagt wort zitat schrieb dijo dice palabra insulto cita".split()
)
ADDRESS = frozenset("you your youre ur du dein ihr sie tu ton ta vous votre tú usted eres es are".split())
QUOTES = "\"“”„«»‘"
#: Context scores: where they begin, what signs of a quotation on both sides, a word of report and an address just before
#: add; most that a window's words can add by what labels tell, and how often a word must stand by hits to count.
PLAIN, MARKED, REPORTED, ADDRESSED = -3.0, 3.0, 1.5, -3.0
MOST_LEARNT, LEAST_SEEN, PRIOR_HITS, MOST_CONTEXTS = 2.0, 3, 5.0, 5000
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
SHORTEST_STEM, LONGEST_STEM = 3, 10
#: Weight of a misspelled term against the term itself: one alone leaves a text in doubt, two don't.
MISSPELLED = 0.5
#: Longer runs without white space are looked at each time.
KEPT_CHARS = 100
_TOKEN = re.compile(r"\S+")
_PIECE = regex.compile(r"[\p{L}\p{M}\p{N}]+|[@$!]+")
_REPEAT = re.compile(r"(.)\1+")
#: Place within a run without white space, word, term, weight, edits.
Found = tuple[int, str, str, float, int]


def edits_for(n: int) -> int:
    """Edits allowed for a term of n letters: short ones must match exactly, since one edit makes them other words."""
    return 0 if n < 5 else 1 if n < 10 else 2


def deletions(word: str, most: int) -> set[str]:
    """The word with up to `most` letters left out."""
    out = {word}
    for _ in range(most):
        out |= {w[:k] + w[k + 1 :] for w in out for k in range(len(w))}
    return out


def intact(term: str, most: int) -> list[tuple[int, int, str]]:
    """(from, to, letters): parts of a term of which `most` edits leave one whole; from and to count from the end if negative.

    There is one part more than edits, and a letter stands between neighbours, so that no edit, a swap included, touches
    two. The outer parts stay at the ends of the word; a middle one moves by as many places as there are edits.
    """
    n = len(term)
    cuts = [round(n * k / (most + 1)) for k in range(1, most + 1)]
    ends = [(a + bool(a), b) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    (_, a), (b, _) = ends[0], ends[-1]
    moved = [(i + k, j + k, term[i:j]) for i, j in ends[1:-1] for k in range(-most, most + 1)]
    return [(0, a, term[:a]), (b - n, 0, term[b:]), *moved]


class Trie:
    """Terms by letters; nearest() walks it with a word's Levenshtein automaton.

    Two screens come before a walk, and neither turns away a word that the walk would find: a word within k edits of a
    term of about its length holds one of k + 1 parts of it as it is, and shares a string with it when up to k letters
    are left out of both.
    """

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        #: by length of a word: the most edits that a term of about that length allows, and what such terms share with it
        self.shared: dict[int, tuple[int, set[str]]] = {}
        #: by length of a word and place in it: the parts of terms that may stand there whole
        self.parts: dict[int, dict[tuple[int, int], set[str]]] = {}
        for t in terms:
            node = self.root
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = t
            if most := edits_for(len(t)):
                own = deletions(t, most)
                for n in range(len(t) - most, len(t) + most + 1):
                    old, parts = self.shared.get(n, (0, set()))
                    parts |= own
                    self.shared[n] = max(old, most), parts
                    for i, j, letters in intact(t, most):
                        self.parts.setdefault(n, {}).setdefault((i if i >= 0 else n + i, j if j > 0 else n), set()).add(letters)
        self.places = {n: [(i, j, s) for (i, j), s in at.items()] for n, at in self.parts.items()}

    def _allowed(self, word: str) -> int:
        for i, j, letters in self.places.get(len(word), ()):
            if word[i:j] in letters:
                break
        else:
            return 0
        most, parts = self.shared[len(word)]
        return 0 if parts.isdisjoint(deletions(word, most)) else most

    def find(self, word: str) -> tuple[str, int] | None:
        """nearest() among the terms with the word's own first letter."""
        return self._walk(word, most, True) if (most := self._allowed(word)) and word[0] in self.root else None

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The term with fewest edits (a swap of neighbours counts as one) within those it allows.

        Ties go to terms with the word's own first letter, then to the first; so that a hit of one edit among those ends
        the search.
        """
        if not (most := self._allowed(word)):
            return None
        own = self._walk(word, most, True) if word[0] in self.root else None
        if own and own[1] < 2:
            return own
        found = self._walk(word, most, False)
        return own if own and found and own[1] <= found[1] else found

    def _walk(self, word: str, most: int, own_letter: bool) -> tuple[str, int] | None:
        """The nearest term from the root, or from the branch of the word's first letter; ties to the first.

        A state of the automaton is the row of edit distances between the letters walked so far and the word's
        prefixes; no entry within the allowed edits means that the automaton is dead.
        """
        best: tuple[int, str] | None = None
        whole = tuple(range(len(word) + 1))
        stack = [(self.root[word[0]], (1, *range(len(word))), whole, word[0]) if own_letter else (self.root, whole, whole, "")]
        while stack:
            node, row, before, last = stack.pop()
            term = node.get("")
            if term is not None and row[-1] <= edits_for(len(term)) and (best is None or (row[-1], term) < best):
                best = (row[-1], term)
            for ch, child in node.items():
                if ch == "":
                    continue
                nxt = [row[0] + 1]
                for j, w in enumerate(word):
                    d = min(row[j + 1] + 1, nxt[j] + 1, row[j] + (w != ch))
                    if j and w == last and word[j - 1] == ch:
                        d = min(d, before[j - 1] + 1)
                    nxt.append(d)
                if min(nxt) <= most:
                    stack.append((child, tuple(nxt), row, ch))
        return best and (best[1], best[0])


@dataclass
class Lexicon:
    """Weights of whole words and of stems, which match all words that begin with them.

    innocent has words near a term that are known from texts which aren't toxic; they are no misspellings. context has
    what words of a hit's window add to its context score, beside what report and address do.
    """

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    innocent: frozenset[str] = frozenset()
    context: dict[str, float] = field(default_factory=dict)
    clean: set[str] = field(init=False, default_factory=set)
    hits: dict[str, list[Found]] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.word_trie, self.stem_trie = Trie(sorted(self.words)), Trie(sorted(self.stems))
        self.stem_sizes = sorted({len(s) for s in self.stems}, reverse=True)
        #: lengths at which a word is compared with stems
        self.cuts = sorted(self.stem_trie.shared)
        #: a longer run of pieces matches no more than its beginning does
        self.longest = max((len(t) + edits_for(len(t)) for t in (*self.words, *self.stems)), default=0)

    def find(self, tokens: set[str]) -> dict[str, list[Found]]:
        """What hits in those lower-case runs without white space that have hits, from a bounded memory of answers."""
        if len(self.clean) > 500_000:
            self.clean.clear()
        out = {}
        for t in tokens.difference(self.clean):
            found = self.hits.get(t)
            if found is None:
                found = self._look_in(t)
                if len(t) < KEPT_CHARS:
                    if found:
                        self.hits[t] = found
                    else:
                        self.clean.add(t)
            if found:
                out[t] = found
        if len(self.hits) > 100_000:
            self.hits.clear()
        return out

    def _look_in(self, token: str) -> list[Found]:
        """Hits in a run without white space, which may hold words that signs or tags glue together.

        Terms that stand between signs are taken first. Of what lies between those, each piece is looked at alone, then
        with the signs and pieces after it (as in a term with a sign for a letter), up to the length of terms.
        """
        if token.isalpha():
            found = self._look(token) if len(token) > 2 else None
            return [(0, token, *found)] if found else []
        pieces = [m.span() for m in _PIECE.finditer(token)]
        exact = {k: f for k, (i, j) in enumerate(pieces) if j - i > 2 and (f := self._as_written(token[i:j]))}
        out, k = [], 0
        while k < len(pieces):
            if found := exact.get(k):
                out.append((pieces[k][0], token[slice(*pieces[k])], *found))
                k += 1
                continue
            start, end = pieces[k][0], k
            while end < len(pieces) and end not in exact:
                w = token[start : pieces[end][1]]
                if len(w) > 2:
                    inside = w[0] not in EDGES and w[-1] not in EDGES
                    if found := self._look(w) if inside else self._as_written(w):
                        out.append((start, w, *found))
                        break
                    if len(w) > self.longest and len(_REPEAT.sub(r"\1", w)) > self.longest:
                        break
                end += 1
            k = end + 1 if found else k + 1
        return out

    def _as_written(self, w: str) -> tuple[str, float, int] | None:
        """A term as it is, or with signs for letters."""
        if found := self._exact(w):
            return found
        if not w.isalpha() and (found := self._exact(w.translate(LOOKALIKE))):
            return *found[:2], 1
        return None

    def _look(self, w: str) -> tuple[str, float, int] | None:
        if found := self._as_written(w):
            return found
        if w in self.innocent:
            return None
        plain = w if w.isalpha() else w.translate(LOOKALIKE)
        once = _REPEAT.sub(r"\1", plain)
        for v in (plain,) if once == plain else (plain, once):
            if found := self.word_trie.nearest(v):
                return found[0], self.words[found[0]], max(found[1], 1)
            for n in self.cuts:
                if n <= len(v) and (found := self.stem_trie.nearest(v[:n])):
                    return found[0], self.stems[found[0]], max(found[1], 1)
        return None

    def _exact(self, w: str) -> tuple[str, float, int] | None:
        if w in self.words:
            return w, self.words[w], 0
        for n in self.stem_sizes:
            if w[:n] in self.stems:
                return w[:n], self.stems[w[:n]], 0
        return None


@dataclass(frozen=True)
class Hit:
    word: str
    term: str
    position: int
    edits: int
    context: float  # 0 for direct abuse to 1 for a quotation
    around: tuple[str, ...] = ()


def context_score(around: tuple[str, ...], learnt: dict[str, float]) -> float:
    """How likely a hit with these words and signs around it is quoted or reported: 0 to 1."""
    s = PLAIN + sum(REPORTED for w in around if w in REPORTS)
    s += max(-MOST_LEARNT, min(MOST_LEARNT, sum(learnt.get(w, 0.0) for w in around)))
    s += MARKED * ("<marked>" in around) + ADDRESSED * ("<addressed>" in around)
    return float(1 / (1 + np.exp(-s)))


def scan(text: str, lex: Lexicon) -> tuple[tuple[float, float, float], list[Hit]]:
    """(exact, misspelled, quoted) mass of a whole text, and its hits."""
    low = text.lower()
    terms = lex.find(set(low.split()))
    if not terms:
        return (0.0, 0.0, 0.0), []
    found = [(m.start(), m.group()) for m in _TOKEN.finditer(low)]
    mass, hits = [0.0, 0.0, 0.0], []
    for k, (at, token) in enumerate(found):
        inside = terms.get(token)
        if inside is None:
            continue
        before = [x.strip(EDGES) for _, x in found[max(0, k - WINDOW) : k]]
        after = [x.strip(EDGES) for _, x in found[k + 1 : k + 1 + WINDOW]]
        left, right = low[max(0, at - 40) : at] + token[:1], token[-2:] + low[at + len(token) : at + len(token) + 40]
        marked = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
        signs = ["<marked>"] * marked + ["<addressed>"] * any(x in ADDRESS for x in before[-3:])
        around = tuple(dict.fromkeys(x for x in chain(before, after, signs) if x))
        told = context_score(around, lex.context)
        for place, word, term, weight, edits in inside:
            mass[1 if edits else 0] += weight * (1 - told)
            mass[2] += weight * told
            hits.append(Hit(word, term, at + place, edits, told, around))
    return tuple(mass), hits


def vector(mass: tuple[float, float, float]) -> list[float]:
    exact, misspelled, quoted = mass
    direct = exact + MISSPELLED * misspelled
    return [1.0, np.log1p(direct), min(direct, 15.0) / 5, np.log1p(quoted)]


@dataclass(frozen=True)
class ToxicModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str) -> tuple[float, tuple[float, float, float], list[Hit]]:
        mass, hits = scan(text, self.lexicon)
        return float(1 / (1 + np.exp(-np.dot(self.weights, vector(mass))))), mass, hits


def with_pieces(tokens: list[str]) -> list[str]:
    """The runs without white space, each followed by the words that signs part it into."""
    out = []
    for t in tokens:
        out.append(t)
        if not t.isalpha() and len(inner := _PIECE.findall(t)) > 1:
            out += inner
    return out


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, a, b) from rows (text, label): a and b are how many toxic and other texts hold the word.

    a counts at most the distinct words that stand before it in toxic texts, so that a word which only copies of one text
    share counts little.
    """

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        words, before, labels = [], [], []
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = with_pieces(t.lower().split())
            own = dict(zip(found, ["", *found], strict=False))
            words += own
            before += own.values() if y else [""] * len(own)
            labels += [y] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.string()), pa.array(labels, pa.int32())], ["word", "before", "label"])

    found = arrow_map(rows.select("text", "label"), one, "word string, before string, label int")
    found = found.select(F.btrim("word", F.lit(EDGES)).alias("word"), "before", "label").where(F.length("word").between(3, 60))
    pairs = found.groupBy("word", "before").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    return pairs.groupBy("word").agg(F.least(F.sum("a"), F.sum((F.col("a") > 0).cast("int"))).alias("a"), F.sum("b").alias("b"))


def learn_lexicon(rows: DataFrame, *, least: int = 5, ratio: float = 20.0, most: int = 5000) -> Lexicon:
    """Words and stems from rows (text, label) that mark toxic texts.

    A stem's counts are the sums over the words that begin with it; it has three endings at least. A term has a support of
    at least `least`, and its share among toxic texts (with 1.5 standard errors to spare) is at least `ratio` times that
    among the others. Of terms that begin with each other the one with the most support times log strength stays, the
    longest of equal ones. The first `most` of those that stay, in that order, are read.
    """
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon({})
    counts = word_counts(rows)
    stems = counts.select("a", "b", F.explode(F.transform(F.sequence(F.lit(SHORTEST_STEM), F.least(F.lit(LONGEST_STEM), F.length("word"))), lambda n: F.substring("word", F.lit(1), n))).alias("term"))
    stems = stems.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum((F.col("a") > 0).cast("int")).alias("endings"))
    words = counts.select(F.col("word").alias("term"), "a", "b", F.lit(0).alias("endings"))

    def strength(a: Column, b: Column) -> Column:
        return a * (1.0 - F.least(F.lit(1.5) / F.sqrt(a), F.lit(1.0))) / n1 / ((b + 1.0) / n0)

    both = words.union(stems.where("endings >= 3")).where(F.col("a") >= least)
    both = both.withColumn("strength", strength(F.col("a"), F.col("b"))).where(F.col("strength") >= ratio)
    both = both.withColumn("worth", F.col("a") * F.log("strength"))
    # terms that begin with each other have their first letters in common, so each group is pruned on its own
    order = F.struct((-F.col("worth")).alias("less"), (-F.length("term")).alias("shorter"), "term", "endings", "strength")
    groups = both.groupBy(F.substring("term", 1, SHORTEST_STEM).alias("head")).agg(F.array_sort(F.collect_list(order)).alias("terms"))
    left = arrow_map(groups.select("terms"), _apart, "term string, endings bigint, strength double, worth double")
    out = Lexicon({})
    for r in left.orderBy(F.desc("worth"), F.desc(F.length("term")), "term", "endings").limit(most).collect():
        (out.stems if r["endings"] else out.words)[r["term"]] = float(min(np.log(r["strength"]), 6.0))
    return Lexicon(out.words, out.stems)


def _apart(b: pa.RecordBatch) -> pa.RecordBatch:
    """Of each row's terms, in their order, those that neither begin with one before nor are the beginning of one."""
    out: list[tuple[str, int, float, float]] = []
    for terms in b.column(0).to_pylist():
        taken, begun = set(), set()
        for r in terms:
            beginnings = {r["term"][:n] for n in range(SHORTEST_STEM, len(r["term"]) + 1)}
            if r["term"] not in begun and taken.isdisjoint(beginnings):
                taken.add(r["term"])
                begun |= beginnings
                out.append((r["term"], r["endings"], r["strength"], -r["less"]))
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["term", "endings", "strength", "worth"])


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; n is how often each row counts."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (n * (y - p)) - 0.1 * w)
    return w


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", most: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Learns lexicon and curve from about `most` labelled rows of each class, the first by a hash of the id.

    A term's weight is the log ratio of its shares of toxic and other texts. Words near a term that the other texts hold
    are noted as innocent. All hits of a text count, however long it is.

    labels has the id and 0 or 1; other rows are left out. Without rows of both classes the model scores 0.01 for all.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id is not null and label in (0, 1)")
    totals = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, most / max(totals.get(1, 1), 1))).otherwise(min(1.0, most / max(totals.get(0, 1), 1)))
    marked = marked.where(F.pmod(F.xxhash64("_id", F.lit("toxic")), F.lit(1_000_000)) < share * 1_000_000)
    # about 2 * most rows of two numbers, whatever the size of the tables
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(marked), "_id").select("text", "label")
    lex = learn_lexicon(rows)
    if not (lex.words or lex.stems):
        return ToxicModel(lex, np.array([-4.6, 0.0, 0.0, 0.0]))
    sent = docs.sparkSession.sparkContext.broadcast((lex.words, lex.stems))  # 5,000 terms at most
    own: list[Lexicon] = []

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        if not own:
            own.append(Lexicon(*sent.value))
        counts = [Counter((min(h.edits, 1), h.term, h.word if h.edits else "", h.around) for h in scan(t, own[0])[1]) for t in b.column(0).to_pylist()]
        hits = [[{"kind": k, "term": t, "word": w, "around": a, "n": n} for (k, t, w, a), n in sorted(c.items())] for c in counts]
        return pa.RecordBatch.from_arrays([pa.array(hits, hit_type), b.column(1)], ["hits", "label"])

    # all hits of each text, folded; what is brought to the driver are words, terms and three numbers for each text
    hit_type = pa.list_(pa.struct([("kind", pa.int32()), ("term", pa.string()), ("word", pa.string()), ("around", pa.list_(pa.string())), ("n", pa.int64())]))
    folded = materialize(arrow_map(rows, one, "hits array<struct<kind:int,term:string,word:string,around:array<string>,n:bigint>>, label int"), "toxic-hits")
    innocent = frozenset(r["word"] for r in folded.where("label = 0").select(F.explode("hits.word").alias("word")).where("word <> ''").distinct().collect())
    whole = folded.select("label", F.explode(F.array_distinct(F.transform(F.filter("hits", lambda h: h["word"] == ""), lambda h: h["term"]))).alias("term"))
    held: dict[str, list[int]] = {}
    for r in whole.groupBy("term", "label").count().collect():
        held.setdefault(r["term"], [0, 0])[r["label"]] = r["count"]
    sizes = {r["label"]: r["count"] for r in folded.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    weight = {t: float(np.clip(np.log((c[1] + 0.5) / (n1 + 1) / ((c[0] + 0.5) / (n0 + 1))), 0.3, 6.0)) for t, c in held.items()}
    context = learn_contexts(folded)
    lex = Lexicon({t: weight.get(t, 0.3) for t in lex.words}, {t: weight.get(t, 0.3) for t in lex.stems}, innocent, context)
    known = docs.sparkSession.sparkContext.broadcast((weight, innocent, context))

    def weigh(b: pa.RecordBatch) -> pa.RecordBatch:
        weights, fine, learnt = known.value
        masses = [[0.0] * b.num_rows for _ in range(3)]
        for row, hits in enumerate(b.column(0).to_pylist()):
            for h in hits:
                if h["word"] not in fine:
                    told, worth = context_score(tuple(h["around"]), learnt), weights.get(h["term"], 0.3) * h["n"]
                    masses[h["kind"]][row] += worth * (1 - told)
                    masses[2][row] += worth * told
        return pa.RecordBatch.from_arrays([*(pa.array(m, pa.float64()) for m in masses), b.column(1)], ["exact", "misspelled", "quoted", "label"])

    by = ["exact", "misspelled", "quoted", "label"]
    texts = arrow_map(folded.select("hits", "label"), weigh, "exact double, misspelled double, quoted double, label int").groupBy(*by).count().orderBy(*by).collect()
    y, n = np.array([r["label"] for r in texts], float), np.array([r["count"] for r in texts], float)
    x = np.array([vector(tuple(r)[:3]) for r in texts])
    w = fit_curve(x, y, n)
    if w[3] < 0:  # quotation never counts against abuse
        w = fit_curve(x * np.array([1.0, 1.0, 1.0, 0.0]), y, n)
    w[1:3] = np.maximum(w[1:3], 0.0)
    w[3] = min(w[3], w[1])  # nor more than it
    return ToxicModel(lex, w)


def learn_contexts(folded: DataFrame) -> dict[str, float]:
    """What words and signs around terms as they are tell of quotation: log ratios of their shares among hits of other and toxic texts.

    Shares are drawn to each other by PRIOR_HITS hits, so that few hits of one kind tell little; what stands by fewer than
    LEAST_SEEN hits of the kind that it speaks for counts nothing. The MOST_CONTEXTS strongest are kept.
    """
    hits = folded.select("label", F.explode("hits").alias("h")).where("h.kind = 0")
    seen = {r["label"]: r["n"] for r in hits.groupBy("label").agg(F.sum("h.n").alias("n")).collect()}
    n0, n1 = seen.get(0, 0), seen.get(1, 0)
    if not n0 or not n1:
        return {}
    words = hits.select("label", "h.n", F.explode("h.around").alias("word")).groupBy("word")
    words = words.agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("b"))
    share = lambda c, n: (F.col(c) + PRIOR_HITS * n / (n0 + n1)) / n
    told = words.withColumn("w", F.greatest(F.lit(-MOST_LEARNT), F.least(F.lit(MOST_LEARNT), F.log(share("a", n0) / share("b", n1)))))
    told = told.where(F.when(F.col("w") > 0, F.col("a")).otherwise(F.col("b")) >= LEAST_SEEN)
    return {r["word"]: r["w"] for r in told.orderBy(F.desc(F.abs("w")), "word").limit(MOST_CONTEXTS).select("word", "w").collect()}


def score_texts(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1), exact, misspelled, quoted, hits (word, term, position, edits, context).

    A hit's context is 0 for direct abuse to 1 for a quotation or report.

    Positions are those in the lower-cased text. Whole texts are read; null counts as empty, and an empty text scores as
    one without hits. Only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon.words, model.lexicon.stems, model.lexicon.innocent, model.lexicon.context, model.weights))  # bounded by the rows learnt from
    own: list[ToxicModel] = []
    hit_type = pa.list_(pa.struct([("word", pa.string()), ("term", pa.string()), ("position", pa.int32()), ("edits", pa.int32()), ("context", pa.float64())]))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        if not own:  # one lexicon and its memory of words for each task
            own.append(ToxicModel(Lexicon(*sent.value[:4]), sent.value[4]))
        got = [own[0].score(t) for t in b.column(1).to_pylist()]
        masses = [pa.array([g[1][k] for g in got], pa.float64()) for k in range(3)]
        hits = pa.array([[{"word": h.word, "term": h.term, "position": h.position, "edits": h.edits, "context": h.context} for h in g[2]] for g in got], hit_type)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), *masses, hits], [id_col, "score", "exact", "misspelled", "quoted", "hits"])

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return arrow_map(rows, one, f"{id_col} {kind}, score double, exact double, misspelled double, quoted double, hits array<struct<word:string,term:string,position:int,edits:int,context:double>>")
