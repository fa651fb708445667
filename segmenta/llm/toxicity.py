"""Toxicity by weak supervision.

Many voters look at a document; each votes by itself or abstains.  Voters for "toxic"
are lexicons of insults, contempt and other languages, patterns (an insult after a
second person, insults repeated), and words and beginnings of words mined from a bounded
sample of the labels.  Voters for "not toxic" are lexicons of courtesy and of formal
text, and the pattern of a text of some length without any of the others.  A generative
model of the votes, fitted to the vote patterns of all documents by expectation
maximisation, estimates each voter's accuracy and how voters correlate within a class;
voters that say the same count for less.  A logistic regression on all terms of the
sample is trained on the model's posterior labels and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm import textkernel as tk
from segmenta.llm.common import cut, map_batches

LEXICONS: tuple[tuple[str, bool, str], ...] = (
    ("insult", True, "idiot idiots moron morons imbecile scum scumbag loser losers clown bastard jerk fool fools creep"),
    ("contempt", True, "trash stupid dumb pathetic disgusting worthless filthy garbage"),
    ("german", True, "arschloch trottel dummkopf abschaum versager schwachkopf idioten drecksack"),
    ("romance", True, "connard crétin salaud abruti débile imbécile ordure pendejo gilipollas estúpido basura cabrón idiota"),
    ("courtesy", False, "please thank thanks welcome kindly sorry appreciate bitte danke merci gracias"),
    ("formal", False, "abstract section figure table copyright licensed license chapter appendix committee"),
)
SECOND_PERSON = "you your youre du dein deine ihr tu vous ton ta usted tú tus"
#: The bound of the labelled sample, of each class.
SAMPLE = 2000
#: Bytes of a word's beginning that mined beginnings have.
PREFIX = (4, 5, 7)
#: A mined term is in so many toxic texts that aren't near copies of each other, and so many times more frequent there.
LEAST_TEXTS = 3
LEAST_RATIO = 60.0
#: -log of the chance that its texts are toxic by accident, at least.
LEAST_SURPRISE = 7.0
#: Terms of the classifier are in so many texts of the sample; a term of one text tells only of that text.
LEAST_TERM_TEXTS = 2
LEAST_ACCURACY = 0.9
#: Words that a text has at least for the absence of all else to count, words that an insult can come after a second person.
PLAIN_WORDS = 20
ADDRESS = 3
REPEATED = 3
#: Log odds that a voter's term is worth before training.
PRIOR_WEIGHT = 2.5
THRESHOLD = 0.5
#: Steps of the classifier's training, each over the whole sample.
ROUNDS = 300
VOTERS: tuple[tuple[str, bool], ...] = (
    *[(name, toxic) for name, toxic, _ in LEXICONS],
    ("address", True), ("repeated", True), ("mined_words", True), *[(f"mined_{n}", True) for n in PREFIX], ("plain", False),
)
PLACE = {name: i for i, (name, _) in enumerate(VOTERS)}
N_VOTERS = len(VOTERS)
SAYS_TOXIC = np.array([toxic for _, toxic in VOTERS])


def _terms(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words and beginnings of words as hashes, their number) of texts laid end to end.

    The two lowest bits tell the kind: 0 for a word, k for its beginning of PREFIX[k - 1] bytes.
    """
    parts, counts = tk.words_and_beginnings(body, offs, PREFIX)
    parts = [(h & ~np.uint64(3)) | np.uint64(k) for k, h in enumerate(parts)]
    return np.stack(parts, axis=1).ravel(), counts * len(parts)


def word_terms(words: list[str]) -> np.ndarray:
    """The hashes of single words."""
    out = [tk.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0] for w in words]
    return np.unique(np.concatenate(out) & ~np.uint64(3)) if out else np.zeros(0, np.uint64)


def _sample(documents: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, toxic) of ``size`` labelled documents of each class, about, chosen by hash.

    The ids that are broadcast are the sample's, whose size doesn't depend on the table's.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col("toxic") == c, F.lit(min(1.0, size / n))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 20)) < share * F.lit(1 << 20))
    return documents.select(F.col("doc_id").cast("bigint").alias("_id"), "text").join(F.broadcast(drawn), "_id").select("text", "toxic")


def _near(words: np.ndarray) -> int:
    """Alike for most near copies and hardly for others: the least of three hashes of the words, together."""
    if not len(words):
        return 0
    least = np.array([tk.mix64(words + np.uint64(k)).min() for k in (11, 12, 13)])
    return int(tk.mix64(least * np.array([3, 5, 7], np.uint64)).sum(dtype=np.uint64).view(np.int64))


def _sampled_terms(sample: DataFrame) -> DataFrame:
    """(near, toxic, terms): distinct terms of each text; near is alike for near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offs = tk.raw(batch.column(0))
            near, terms = [], []
            for i in range(len(offs) - 1):
                own = np.unique(_terms(body[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))[0])
                words = own[own & np.uint64(3) == 0]
                near.append(_near(words))
                terms.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), batch.column(1), pa.array(terms, pa.list_(pa.int64()))], ["near", "toxic", "terms"])

    return map_batches(sample.select("text", "toxic"), run, "near bigint, toxic int, terms array<bigint>")


def counted_terms(sampled: DataFrame) -> tuple[dict[int, int], DataFrame]:
    """(texts of each class, (term, a, b): toxic and other texts of each term); near copies count once."""
    totals = {r[0]: r[1] for r in sampled.groupBy("toxic").agg(F.countDistinct("near")).collect()}
    each = sampled.select("near", "toxic", F.explode("terms").alias("term")).distinct()
    return totals, each.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))


def mined(totals: dict[int, int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which terms tell toxic texts."""
    if not totals.get(1):
        return np.zeros(len(a), bool)
    ratio = (a / totals[1]) / ((b + 0.5) / (totals.get(0, 0) + 1.0))
    surprise = a * np.log((totals[1] + totals.get(0, 0) + 1.0) / totals[1])
    return (a >= LEAST_TEXTS) & (surprise >= LEAST_SURPRISE) & (ratio >= LEAST_RATIO)


def voters(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms in order, voter of each): those of the lexicons, and ``found`` ones by their kind."""
    voter = {int(t): PLACE[name] for name, _, words in LEXICONS for t in word_terms(words.split()).view(np.int64)}
    mine = [PLACE["mined_words"], *[PLACE[f"mined_{n}"] for n in PREFIX]]
    for t in found.tolist():
        voter.setdefault(t, mine[t & 3])
    terms = np.array(sorted(voter), np.int64)
    return terms, np.array([voter[int(t)] for t in terms], np.int64)


class Look:
    """Places of terms in a table, most of which a table of marks by 20 bits turns away without a search."""

    def __init__(self, terms: np.ndarray) -> None:
        self.order = np.argsort(terms.view(np.uint64))
        self.known = terms.view(np.uint64)[self.order]
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self._mark(self.known)] = True

    @staticmethod
    def _mark(t: np.ndarray) -> np.ndarray:
        return (t >> np.uint64(40)) & np.uint64((1 << 20) - 1)

    def __call__(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``t`` are in the table, their places)."""
        maybe = np.flatnonzero(self.marks[self._mark(t)])
        if not len(self.known) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, t[maybe]), len(self.known) - 1)
        sure = self.known[at] == t[maybe]
        return maybe[sure], self.order[at[sure]]


def votes_of(t: np.ndarray, counts: np.ndarray, look: Look, voter: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bits of the voters that fire for each text; ``t`` and ``counts`` are those of ``_terms``."""
    n, kinds = len(counts), 1 + len(PREFIX)
    votes = np.zeros(n, np.int64)
    end = np.cumsum(counts)
    hit, place = look(t)
    doc = np.searchsorted(end, hit, side="right")
    np.bitwise_or.at(votes, doc, np.int64(1) << voter[place])
    lexical = SAYS_TOXIC[voter[place]] & (voter[place] < len(LEXICONS))
    insult, insulted = hit[lexical] // kinds, doc[lexical]  # places among words
    words = t[::kinds]
    first = (end - counts) // kinds
    for back in range(1, ADDRESS + 1):
        ok = insult - back >= first[insulted]
        told = insulted[ok][np.isin(words[insult[ok] - back], second)]
        votes[told] |= 1 << PLACE["address"]
    votes[np.bincount(insulted, minlength=n) >= REPEATED] |= 1 << PLACE["repeated"]
    told = int(sum(1 << i for i in range(N_VOTERS) if SAYS_TOXIC[i]))
    votes[(counts >= kinds * PLAIN_WORDS) & (votes & told == 0)] |= 1 << PLACE["plain"]
    return votes


def _second_person() -> np.ndarray:
    return word_terms(SECOND_PERSON.split())


def vote_counts(documents: DataFrame, terms: np.ndarray, voter: np.ndarray) -> DataFrame:
    """(votes, n): how many documents each pattern of votes has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, second = Look(terms), _second_person()
        total: dict[int, int] = {}
        for batch in batches:
            body, offs = tk.raw(batch.column(0))
            for a, b in tk.pieces(offs):
                t, counts = _terms(body[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                for v, n in zip(*[x.tolist() for x in np.unique(votes_of(t, counts, look, voter, second), return_counts=True)], strict=True):
                    total[v] = total.get(v, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["votes", "n"])

    return map_batches(documents.select("text"), run, "votes bigint, n bigint").groupBy("votes").agg(F.sum("n").alias("n"))


class LabelModel:
    """P(toxic | votes) of a two-class model with class-wise correlated voters.

    ``patterns`` has a row for each pattern of votes, 1 where a voter fires; ``toxic``
    tells what each voter's vote says.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, toxic: np.ndarray | None = None, rounds: int = 60) -> None:
        n, total = patterns.shape[1], max(1.0, float(counts.sum()))
        self.toxic = np.ones(n, bool) if toxic is None else toxic
        several = patterns[:, self.toxic].sum(axis=1) > 1
        self.prior = float(min(0.3, max(1e-4, counts[several].sum() / total)))
        self.yes, self.no = np.where(self.toxic, 0.3, 0.05), np.where(self.toxic, 1e-4, 0.3)
        self.related = np.zeros((n, n))
        for i in range(rounds):
            q = self.posterior(patterns)
            w1, w0 = counts * q, counts * (1 - q)
            self.yes = np.clip((w1 @ patterns + np.where(self.toxic, 0.3, 0.05)) / (w1.sum() + 1), 0.001, 0.98)
            self.no = np.clip((w0 @ patterns + np.where(self.toxic, 0.005, 0.3)) / (w0.sum() + 1), 1e-6, 0.995)
            self.prior = float(np.clip(w1.sum() / total, 1e-4, 0.5))
            # a voter is right in LEAST_ACCURACY of its votes at least, else a class could swallow all votes of a language;
            # one for "not toxic" says nothing where it isn't less frequent in toxic texts
            bound = self.yes * self.prior / (1 - self.prior) * (1 - LEAST_ACCURACY) / LEAST_ACCURACY
            self.no = np.where(self.toxic, np.minimum(np.minimum(self.no, 0.05), bound), self.no)
            self.yes = np.where(self.toxic, np.maximum(self.yes, 0.02), np.minimum(self.yes, self.no))
            if i % 10 == 9:
                same = self.toxic[:, None] & self.toxic[None, :]
                other = ~self.toxic[:, None] & ~self.toxic[None, :]
                self.related = np.where(same, self.correlations(patterns, w1, self.yes), 0) + np.where(other, self.correlations(patterns, w0, self.no), 0)

    @staticmethod
    def correlations(patterns: np.ndarray, weights: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Positive correlations above 0.1 between voters in a class, 0 on the diagonal."""
        x = patterns - mean
        cov = (x * weights[:, None]).T @ x / max(1e-9, weights.sum())
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        r = cov / sd[:, None] / sd[None, :]
        np.fill_diagonal(r, 0)
        return np.where(r > 0.1, r, 0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """A voter that fires counts by its likelihood ratio, one that abstains says nothing; silence of all counts as a whole."""
        silent = ~patterns.any(axis=1)
        quiet = np.log(np.prod(1 - self.yes[self.toxic]) + 1e-9) - np.log(np.prod(1 - self.no[self.toxic]))
        shared = 1 + patterns @ self.related  # a voter counts for less beside voters that it correlates with
        s = (patterns * np.log(self.yes / self.no) / shared).sum(axis=1) + silent * quiet + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _sums(values: np.ndarray, begin: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    """Sums of runs of ``values`` that begin at ``begin``, at the places ``some`` of n."""
    out = np.zeros(n, np.float32)
    if len(some):
        out[some] = np.add.reduceat(values, begin)
    return out


def fit_linear(at: np.ndarray, doc: np.ndarray, targets: np.ndarray, mean: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of terms (term ``at[i]`` in text ``doc[i]``, texts in order); weights are drawn towards ``mean``."""
    n_terms, n_docs = len(mean), len(targets)
    by_term = np.argsort(at, kind="stable")
    docs, begin_doc = np.unique(doc, return_index=True)
    terms, begin_term = np.unique(at[by_term], return_index=True)
    doc_by_term = doc[by_term]
    freq = np.maximum(1, np.bincount(at, minlength=n_terms))
    balance = np.where(targets > 0.5, 0.5 / max(1e-9, (targets > 0.5).mean()), 0.5 / max(1e-9, (targets <= 0.5).mean())) if n_docs else targets
    pull = np.where(mean > 0, 0.004, 0.04)  # terms that no voter has stay near 0 unless they tell much
    w, b = mean.astype(np.float32), 0.0
    rate = (np.where(mean > 0, 2.0, 0.2) / (freq + 5)).astype(np.float32)
    for _ in range(rounds):
        s = _sums(w[at], begin_doc, docs, n_docs) + b
        err = ((1 / (1 + np.exp(-np.clip(s, -40, 40))) - targets) * balance).astype(np.float32)
        w -= rate * _sums(err[doc_by_term], begin_term, terms, n_terms) + pull.astype(np.float32) * (w - mean)
        b -= 0.5 * float(err.mean())
    return w.astype(float), b


def toxic_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, probability, posterior, toxic): the documents that are toxic, each with ``toxic`` true.

    Every document is scored.  ``probability`` is the linear classifier's, ``posterior``
    the label model's; the classifier decides.  Null and empty texts are not toxic.
    Without labels, or when none is toxic, lexicons and patterns vote alone and their
    terms have the weight PRIOR_WEIGHT.  Labels with nulls, of unknown documents or
    other than 0 and 1 are left out; a document with several labels counts by each.
    Mining has no order, so it has no ties.  Repeated rows are judged each.  An empty
    table gives no rows.  Other columns are ignored, whatever their names.

    Bounds: SAMPLE labelled texts of each class for mining and training, whose terms the
    driver gets; and the vote patterns of all documents, of which 2 ** N_VOTERS can
    exist at most.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sample = cut(_sample(documents, labels, SAMPLE).withColumn("doc", F.monotonically_increasing_id()))
    sampled = cut(_sampled_terms(sample))
    totals, per = counted_terms(sampled)
    some = cut(per.where(F.col("a") + F.col("b") >= LEAST_TERM_TEXTS)).toPandas()
    has = {k: some[k].to_numpy(np.int64) for k in ("term", "a", "b")}
    terms, voter = voters(has["term"][mined(totals, has["a"], has["b"])])
    counted = vote_counts(docs, terms, voter).collect()
    bits = lambda v: (v[:, None] >> np.arange(N_VOTERS) & 1).astype(float)
    seen = np.array([r.votes for r in counted], np.int64)
    model = LabelModel(bits(seen), np.array([r.n for r in counted], float), SAYS_TOXIC)
    vocabulary = np.unique(np.concatenate([terms, has["term"]]))
    mean = np.zeros(len(vocabulary))
    mean[np.searchsorted(vocabulary, terms[SAYS_TOXIC[voter]])] = PRIOR_WEIGHT
    weights, bias = _trained(sample, terms, voter, vocabulary, mean, model) if totals.get(1) else (mean * 1.6, -6.0)
    order = np.argsort(seen)
    posterior = model.posterior(bits(seen))[order]
    seen = seen[order]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, second, all_terms = Look(terms), _second_person(), Look(vocabulary)
        for batch in batches:
            body, offs = tk.raw(batch.column(1))
            p, q = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
            for a, b in tk.pieces(offs):
                t, counts = _terms(body[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                p[a:b] = _linear(t, counts, all_terms, weights, bias)
                q[a:b] = posterior[np.searchsorted(seen, votes_of(t, counts, look, voter, second))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.round(4)), pa.array(q.round(4))], ["doc_id", "probability", "posterior"])

    scored = map_batches(docs, score, "doc_id bigint, probability double, posterior double")
    return scored.where(F.col("probability") >= threshold).withColumn("toxic", F.lit(True))


def _pairs(t: np.ndarray, counts: np.ndarray, look: Look, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in the table), each once."""
    hit, place = look(t)
    both = np.unique(np.searchsorted(np.cumsum(counts), hit, side="right") * np.int64(size) + place)
    return both // size, both % size


def _linear(t: np.ndarray, counts: np.ndarray, look: Look, weights: np.ndarray, bias: float) -> np.ndarray:
    """The classifier's probabilities; texts without words have 0."""
    doc, place = _pairs(t, counts, look, max(1, len(weights)))
    s = np.bincount(doc, weights[place], len(counts)) + bias
    return np.where(counts > 0, 1 / (1 + np.exp(-np.clip(s, -40, 40))), 0.0)


def _trained(sample: DataFrame, terms: np.ndarray, voter: np.ndarray, vocabulary: np.ndarray, mean: np.ndarray, model: LabelModel) -> tuple[np.ndarray, float]:
    """The classifier, trained on the model's posteriors of the sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, second, all_terms = Look(terms), _second_person(), Look(vocabulary)
        for batch in batches:
            body, offs = tk.raw(batch.column(1))
            votes, places = np.zeros(len(offs) - 1, np.int64), []
            for a, b in tk.pieces(offs):
                t, counts = _terms(body[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                votes[a:b] = votes_of(t, counts, look, voter, second)
                doc, place = _pairs(t, counts, all_terms, len(vocabulary))
                places += np.split(place.astype(np.int32), np.searchsorted(doc, np.arange(1, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes), pa.array([x.tobytes() for x in places], pa.binary())], ["doc", "votes", "places"])

    rows = map_batches(sample.select("doc", "text"), run, "doc bigint, votes bigint, places binary").toPandas().sort_values("doc")
    places = [np.frombuffer(x, np.int32) for x in rows["places"]]
    at = np.concatenate(places).astype(np.int64)
    doc = np.repeat(np.arange(len(places)), [len(x) for x in places])
    votes = rows["votes"].to_numpy(np.int64)
    return fit_linear(at, doc, model.posterior((votes[:, None] >> np.arange(N_VOTERS) & 1).astype(float)), mean)
