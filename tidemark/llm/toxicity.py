"""Toxicity by weak supervision.

Many voters look at each text: lexicons of insults and threats, lexicons mined from the
training labels and cut into disjoint parts, and patterns. A generative label model
takes the counts of vote patterns over all documents and estimates, without labels, how
accurate each voter is and which voters are correlated: in either class the votes form
a tree whose edges are the pairs that share most information. Its posterior labels train
a linear classifier on words and beginnings of words, which scores every text.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, written
from tidemark.llm.labelled import class_counts, fold, sampled, texts_of, training_labels, unlike

# The voters that are written down, in four languages.
LEXICONS = {
    "insults_en": "idiot moron stupid loser pathetic worthless scum trash clown disgusting dumb fool imbecile jerk creep".split(),
    "abuse_en": "bastard bitch asshole dickhead wanker retard cretin vermin filth degenerate shithead bullshit fuck fucking crap".split(),
    "insults_de": "idiot dumm dummkopf trottel arschloch abschaum versager widerlich wertlos schwachkopf mistkerl penner".split(),
    "insults_fr": "idiot imbécile connard salaud stupide crétin débile abruti ordure minable dégoûtant nul".split(),
    "insults_es": "idiota imbécil estúpido basura escoria inútil asqueroso cabrón payaso patético tonto gilipollas".split(),
}
PATTERNS = {
    "threat": re.compile(r"(?i)\b(?:kill|hurt|burn|destroy|shoot) (?:you|yourself|them|him|her)\b|\bdrop dead\b|\bgo die\b"),
    "address": re.compile(r"(?i)\byou(?:'re| are)? (?:an? |such an? |all )?(?:idiot|moron|stupid|loser|pathetic|worthless|scum|trash|clown|disgusting)"),
    "disguised": re.compile(r"(?i)\b(?:1d10t|id10t|m0ron|stup1d|l0ser|f\*+k|sh\*t|b\*tch|a\$\$)"),
}
_EDGE = ".,;:!?\"'()[]{}«»“”¡¿#*$%&|<>-_~"


MOST_BYTES = 96 << 20  # of words that a worker process remembers, in each of its lists
LONGEST = 64  # characters of a word that is remembered
ENTRY = 90  # bytes, about, that a word takes beside two for each letter
_OWN: dict[str, object] = {}


def of_process(key: str, make):
    """What ``make`` returns, made once in this worker process for each key: tasks that
    follow each other share its words."""
    if key not in _OWN:
        if len(_OWN) > 3:
            _OWN.clear()
        _OWN[key] = make()
    return _OWN[key]


def terms(word: str, longest: int = 8) -> list[str]:
    """What of a word may be in a lexicon: itself, and its beginnings of 4 letters and
    more, which are marked."""
    w = word.lower().strip(_EDGE)
    return [w, *[w[:n] + "-" for n in range(4, min(longest, len(w) - 1) + 1)]] if w else []


def text_terms(text: str | None) -> set[str]:
    return {t for w in set((text or "").split()) for t in terms(w)}


@dataclass
class Voters:
    """Named voters; each says yes or nothing. Their votes are bits, in order."""

    names: list[str]
    lexicon: dict[str, int]  # of each term the bits of the voters that have it

    def __post_init__(self):
        self.first = len(self.names) - len(PATTERNS)
        self.known: dict[str, int] = {}
        self.none: set[str] = set()  # words of no lexicon: most are
        self.held = 0

    def bits(self, word: str) -> int:
        b = 0
        for t in terms(word):
            b |= self.lexicon.get(t, 0)
        return b

    def votes(self, text: str | None) -> int:
        out, known, text = 0, self.known, text or ""
        if self.held > MOST_BYTES:
            self.none.clear()
            known.clear()
            self.held = 0
        for w in set(text.split()).difference(self.none):
            b = known.get(w)
            if b is None:
                b = self.bits(w)
                if len(w) <= LONGEST:
                    self.held += ENTRY + 2 * len(w)
                    if b:
                        known[w] = b
                    else:
                        self.none.add(w)
            out |= b
        for k, p in enumerate(PATTERNS.values()):
            if p.search(text):
                out |= 1 << (self.first + k)
        return out


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, bad, good) of rows (text, target): how many texts have a term, each counted
    by its target and by what that lacks to 1."""

    def run(batches):
        for targets, texts in chunks(batches, "target", "text", rows=64):
            found = [(t, y) for y, x in zip(targets, texts, strict=True) for t in text_terms(x)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=["term", "target"])

    counted = sample.select("target", "text").mapInArrow(run, "term string, target double").groupBy("term")
    return counted.agg(F.sum("target").alias("bad"), F.sum(1 - F.col("target")).alias("good"))


def mined_terms(sample: DataFrame, least: int, precision: float, most: int) -> list[str]:
    """At most ``most`` terms of the labelled sample that ``least`` or more toxic texts
    have, and of which toxic texts are a share of ``precision`` or more of all texts that
    have them, with equal weight for both classes and one more clean text than there
    are; those of largest share first."""
    n0, n1 = sample.agg(F.sum(1 - F.col("y")), F.sum("y")).first()
    share = F.col("bad") / n1
    counted = term_counts(sample.withColumn("target", F.col("y").cast("double")))
    kept = counted.withColumn("share", share / (share + (F.col("good") + 1) / n0)).where((F.col("bad") >= least) & (F.col("share") >= precision))
    return [r.term for r in kept.orderBy(F.desc("share"), "term").limit(most).collect()]


def telling_terms(sample: DataFrame, z: float, most: int) -> list[str]:
    """At most ``most`` terms whose share of toxic texts differs from that of others, by
    the posterior labels, by ``z`` standard errors or more; those of largest difference."""
    n1, n0 = sample.agg(F.sum("target"), F.sum(1 - F.col("target"))).first()
    p1, p0 = (F.col("bad") + 0.5) / (n1 + 1), (F.col("good") + 0.5) / (n0 + 1)
    error = F.sqrt(p1 * F.greatest(1 - p1, F.lit(1e-6)) / n1 + p0 * F.greatest(1 - p0, F.lit(1e-6)) / n0)
    scored = term_counts(sample).select("term", (F.abs(p1 - p0) / error).alias("z"))
    return [r.term for r in scored.where(F.col("z") >= z).orderBy(F.desc("z"), "term").limit(most).collect()]


def make_voters(mined: list[str], parts: int) -> Voters:
    """The written lexicons, then the mined words and the mined beginnings cut into
    ``parts`` lexicons each, from the most to the least precise, then the patterns."""
    names = [*LEXICONS, *[f"words_{k}" for k in range(parts)], *[f"starts_{k}" for k in range(parts)], *PATTERNS]
    lexicon: dict[str, int] = {}
    for k, words in enumerate(LEXICONS.values()):
        for w in words:
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    for at, own in ((len(LEXICONS), [t for t in mined if t[-1] != "-"]), (len(LEXICONS) + parts, [t for t in mined if t[-1] == "-"])):
        for n, t in enumerate(own):
            lexicon[t] = lexicon.get(t, 0) | 1 << (at + n * parts // len(own))
    return Voters(names, lexicon)


class LabelModel:
    """Two classes; in each, votes depend on each other along a tree of voters."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60):
        self.n = votes.shape[1]
        self.prior = min(max(prior, 1e-3), 1 - 1e-3)
        self.parent = np.full(self.n, -1)
        counts = counts.astype(float)
        # To begin with, a text is as toxic as it has votes, scaled to the prior.
        share = votes.sum(axis=1).astype(float)
        post = np.where(share > 0, np.minimum(0.95, 0.6 + 0.1 * share), 0.02)
        for step in range(rounds):
            if step in (0, 5, 20):
                self.parent = self.tree(votes, counts, post)
            self.fit(votes, counts, post)
            new = self.posterior(votes)
            done = np.abs(new - post).max() < 1e-6
            post = new
            if done and step > 20:
                break
        yes = np.array([(counts * post * votes[:, j]).sum() for j in range(self.n)])
        self.accuracy = yes / np.maximum([(counts * votes[:, j]).sum() for j in range(self.n)], 1e-9)

    @staticmethod
    def tree(votes: np.ndarray, counts: np.ndarray, post: np.ndarray, least: float = 1e-4) -> np.ndarray:
        """The parents in a tree of most conditional mutual information, none below
        ``least``: the correlations that the classes don't explain."""
        n = votes.shape[1]
        info = np.zeros((n, n))
        for w in (counts * post, counts * (1 - post)):
            total = w.sum() + 1e-9
            for a in range(n):
                for b in range(a):
                    for x in (0, 1):
                        for y in (0, 1):
                            pxy = (w * (votes[:, a] == x) * (votes[:, b] == y)).sum() / total
                            px, py = (w * (votes[:, a] == x)).sum() / total, (w * (votes[:, b] == y)).sum() / total
                            if pxy > 0:
                                info[a, b] += pxy * np.log(pxy / (px * py)) * total / counts.sum()
        info = info + info.T
        parent, best = np.full(n, -1), info[0].copy()
        via, inside = np.zeros(n, int), {0}
        while len(inside) < n:  # Prim's algorithm, for the largest
            j = max((k for k in range(n) if k not in inside), key=lambda k: best[k])
            parent[j] = via[j] if best[j] > least else -1
            inside.add(j)
            closer = info[j] > best
            best, via = np.where(closer, info[j], best), np.where(closer, j, via)
        return parent

    def fit(self, votes: np.ndarray, counts: np.ndarray, post: np.ndarray) -> None:
        """Chance of each vote, by class and by the parent's vote, with a little smoothing."""
        self.chance = np.zeros((2, self.n, 2))
        for c, w in ((1, counts * post), (0, counts * (1 - post))):
            for j in range(self.n):
                up = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), int)
                base = ((w * votes[:, j]).sum() + 0.1) / (w.sum() + 1.0)
                for x in (0, 1):
                    on = w * (up == x)
                    self.chance[c, j, x] = ((on * votes[:, j]).sum() + 2.0 * base) / (on.sum() + 2.0)
        # A vote for toxicity is never made evidence against it.
        self.chance[1] = np.maximum(self.chance[1], self.chance[0])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        score = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(self.n):
            up = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), int)
            p1, p0 = self.chance[1, j, up], self.chance[0, j, up]
            score += np.where(votes[:, j] == 1, np.log(p1 / p0), np.log((1 - p1) / (1 - p0)))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


class Linear:
    """A logistic classifier on given terms, which are in a text or not, and the votes."""

    def __init__(self, terms_used: list[str], n_votes: int):
        self.at = {t: k for k, t in enumerate(terms_used)}
        self.n_votes, self.size = n_votes, len(terms_used) + n_votes + 1
        self.known: dict[str, tuple[int, ...]] = {}
        self.none: set[str] = set()  # words without a term
        self.held = 0

    def places(self, text: str | None, votes: int) -> np.ndarray:
        known, at, out = self.known, self.at, set()
        if self.held > MOST_BYTES:
            known.clear()
            self.none.clear()
            self.held = 0
        for w in set((text or "").split()).difference(self.none):
            found = known.get(w)
            if found is None:
                found = tuple(at[t] for t in terms(w) if t in at)
                if len(w) <= LONGEST:
                    self.held += ENTRY + 2 * len(w)
                    if found:
                        known[w] = found
                    else:
                        self.none.add(w)
            out.update(found)
        out.update(len(at) + k for k in range(self.n_votes) if votes >> k & 1)
        return np.fromiter(out, np.int64, len(out))

    def fit(self, rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, ridge: float = 3e-5, rounds: int = 1000) -> np.ndarray:
        """Weights, the last one the constant, by full-batch Adam on the logistic loss,
        in steps that shrink to nothing."""
        at = np.concatenate([*rows, np.empty(0, np.int64)])
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        w, m, v = np.zeros(self.size), np.zeros(self.size), np.zeros(self.size)
        for k in range(1, rounds + 1):
            z = np.bincount(row, weights=w[at], minlength=len(rows)) + w[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / weight.sum()
            grad = np.append(np.bincount(at, weights=g[row], minlength=self.size - 1), g.sum()) + ridge * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w -= 0.1 * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        return w


def voted(sample: DataFrame, names: list[str], lexicon: dict[str, int]) -> DataFrame:
    """(doc_id, text, votes) of the rows of a labelled sample."""
    shared = sample.sparkSession.sparkContext.broadcast((names, lexicon))

    def run(batches):
        v = Voters(*shared.value)
        for ids, texts in chunks(batches, "doc_id", "text", rows=64):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([v.votes(t) for t in texts], pa.int64())], names=["doc_id", "text", "votes"])

    return sample.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, votes long")


def placed(seen: DataFrame, used: list[str], n_votes: int) -> DataFrame:
    """(doc_id, places): the terms and votes of each text, by their numbers."""
    shared = seen.sparkSession.sparkContext.broadcast(used)

    def run(batches):
        f = Linear(shared.value, n_votes)
        for ids, votes, texts in chunks(batches, "doc_id", "votes", "text", rows=64):
            places = [np.sort(f.places(t, b)) for t, b in zip(texts, votes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.int64()))], names=["doc_id", "places"])

    return seen.select("doc_id", "votes", "text").mapInArrow(run, "doc_id long, places array<long>")


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, threshold: float = 0.5,
    per_class: int = 2500, parts: int = 3, least: int = 5, precision: float = 0.95, z: float = 4.0, most: int = 4000,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Learnt from are labels outside the fold ``held_out`` only, at most ``per_class`` of
    each class, less near copies: the lexicons are mined and the classifier is fitted on
    those texts, with at most ``most`` terms each. The
    label model takes the vote patterns of all documents, of which there are at most 2
    to the number of voters. A text alone decides its score; null and empty texts get
    that of a text without terms. Repeated texts get equal scores, and a row without id
    is in no fold: held_out is null. Without labels of both classes the written voters
    alone make the label model, with a prior of 0.1, and its posterior is the score. An
    empty table gives an empty one; further columns aren't read.
    """
    sc, run_id = docs.sparkSession.sparkContext, uuid.uuid4().hex
    docs = docs.select("doc_id", "text")
    train = training_labels(labels, label, folds, held_out)
    n0, n1 = class_counts(train)
    sample = written(unlike(texts_of(docs, sampled(train, per_class))), "labelled") if n0 and n1 else None
    voters = make_voters(mined_terms(sample, least, precision, most) if sample is not None else [], parts)
    shared_voters = sc.broadcast((voters.names, voters.lexicon))

    def count_votes(batches):
        v, n = of_process(f"{run_id} voters", lambda: Voters(*shared_voters.value)), {}
        for (texts,) in chunks(batches, "text"):
            for t in texts:
                b = v.votes(t)
                n[b] = n.get(b, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["votes", "n"])

    patterns = docs.select("text").mapInArrow(count_votes, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    spread = lambda b: (np.array(b, np.int64)[:, None] >> np.arange(len(voters.names))) & 1
    prior = n1 / (n0 + n1) if n0 and n1 else 0.1
    table = spread([r.votes for r in patterns] or [0])
    label_model = LabelModel(table, np.array([r.n for r in patterns] or [1]), prior)
    used, weights = [], None
    if sample is not None:
        # Of the sampled texts only votes and terms reach the driver, not the texts.
        seen = written(voted(sample, voters.names, voters.lexicon), "voted")
        found = seen.select("doc_id", "votes").orderBy("doc_id").collect()
        target = label_model.posterior(spread([r.votes for r in found]))
        posteriors = docs.sparkSession.createDataFrame([(r.doc_id, float(q)) for r, q in zip(found, target, strict=True)], "doc_id long, target double")
        used = telling_terms(sample.join(F.broadcast(posteriors), "doc_id"), z, most)
        rows = placed(seen, used, len(voters.names)).orderBy("doc_id").collect()
        linear = Linear(used, len(voters.names))
        # Both classes weigh as they do among all labels, each text by its posterior.
        share = prior * target / max(target.sum(), 1e-9) + (1 - prior) * (1 - target) / max((1 - target).sum(), 1e-9)
        weights = linear.fit([np.array(r.places, np.int64) for r in rows], target, share)
    shared = sc.broadcast((used, weights, label_model))

    def run(batches):
        v = of_process(f"{run_id} voters", lambda: Voters(*shared_voters.value))
        used, w, model = shared.value
        f = of_process(f"{run_id} terms", lambda: Linear(used, len(v.names)))
        for ids, texts in chunks(batches, "doc_id", "text"):
            votes = [v.votes(t) for t in texts]
            if w is None:
                scores = model.posterior(spread(votes))
            else:
                z = np.array([w[f.places(t, b)].sum() for t, b in zip(texts, votes, strict=True)]) + w[-1]
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
