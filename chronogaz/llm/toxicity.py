"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer rewrites a clause's words to symbols: insult (with a weight), threat, target, negation, reported
speech, other. It is composed with three context transducers - negation (holds for the next words), reported speech
(holds to the clause's end) and target (anywhere before; the reversed clause gives what comes after). Their arcs carry
weights, logarithms that add up along the composed path; a match weighs its word's weight times the exponent of its
path's, and a clause's score is the sum over its matches. A document is judged by its clauses: the strongest one, all
together, and how many there are.

Insults of every language are learned, as words or word stems, from labelled rows: units that stand far more often in
toxic texts, weighed together by sparse logistic regression, so that units which merely stand beside others get no
weight. The arcs' weights are learned from the same rows, from the words' weights summed by context. The words for
threat, target, negation and report are lists of four languages. Learned on a bounded sample: at most `per_label`
labelled texts of each label, those with the smallest hash of their doc_id. All rows are scored over their whole text.

Null and empty texts have no matches and get the model's base score. Without toxic and other labelled rows nothing is
learned, and the fixed words alone count. Repeated rows and other columns have no effect; other columns pass through
drop_toxic, whatever their names. A very long text is cut into clauses as any other: it must fit a task's memory some
ten times.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronogaz.llm.common import batches, cut, give_back

PER_LABEL, CANDIDATES = 4000, 600
#: Bytes of text in a batch.
BATCH = 2 << 20
STEMS = (3, 4, 5, 6, 7)

# Our own choice: the grammar's words, in English, French, German and Spanish.
INSULTS = "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown clowns dumb fool imbecile imbécile crétin abruti dummkopf trottel abschaum imbécil estúpido idiota basura".split()
THREATS = "kill hurt destroy hang shoot burn beat smash crush stab tuer frapper brûler détruire töten schlagen verbrennen zerstören matar golpear quemar destruir".split()
TARGETS = "you your yours they them their he him she her these those people all tu toi vous votre ils elles leur du dich dir ihr euch sie usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never nobody nothing without isn aren wasn weren don doesn didn neither nor pas jamais rien sans aucun nicht kein keine nie niemals ohne nunca nada sin ningún".split()
REPORTS = "said says say wrote writes claimed claims reported reports quoted quotes called according alleged dit disait écrit affirme selon sagte sagt schrieb behauptet laut dijo dice escribió afirma según".split()
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITGNRO"

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")


class Transducer:
    """A deterministic weighted letter transducer: (state, symbol) -> (state, output, weight); other symbols keep the
    state and pass with weight 0. Weights are logarithms: they add up along a path."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, "", 0.0))

    def states(self) -> set:
        return {self.start} | {s for s, _ in self.arcs} | {n for n, _, _ in self.arcs.values()}

    def compose(self, other: Transducer, symbols: str) -> Transducer:
        """Both read the same symbols; outputs are joined and weights added."""
        arcs = {}
        for (a, b), x in itertools.product(itertools.product(self.states(), other.states()), symbols):
            (na, oa, wa), (nb, ob, wb) = self.step(a, x), other.step(b, x)
            arcs[(a, b), x] = ((na, nb), oa + ob, wa + wb)
        return Transducer(arcs, (self.start, other.start))

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for x in symbols:
            state, o, w = self.step(state, x)
            out.append((o, w))
        return out


SYMBOLS = INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER
SCOPE = 3  # words for which a negation holds
CONTEXTS = ("", "t", "n", "r")


class Grammar:
    """The composed context transducers; weights: the logarithm that each context's arcs add."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        match = INSULT + THREAT
        scope = {(k, x): (max(k - 1, 0), "n", weights["n"]) if k and x in match else (max(k - 1, 0), "", 0.0) for k in range(SCOPE + 1) for x in SYMBOLS if x != NEGATION}
        negated = Transducer(scope | {(k, NEGATION): (SCOPE, "", 0.0) for k in range(SCOPE + 1)})
        mark = lambda opener, m: Transducer({(0, opener): (1, "", 0.0), **{(1, x): (1, m, weights[m]) for x in match}})
        self.targeted = mark(TARGET, "t")
        self.forward = negated.compose(mark(REPORT, "r"), SYMBOLS).compose(self.targeted, SYMBOLS)

    def paths(self, symbols: list[str]) -> list[tuple[str, float]]:
        """The contexts and the weight at each symbol; a target after a match counts as one before it."""
        after = self.targeted.run(symbols[::-1])[::-1]
        return [(o, w) if "t" in o or not late else (o + late, w + extra) for (o, w), (late, extra) in zip(self.forward.run(symbols), after)]


class Lexicon:
    """Words and stems to symbols and weights."""

    def __init__(self, units: dict[str, float]):
        self.words = {w: (INSULT, 1.0) for w in INSULTS} | {w: (THREAT, 1.0) for w in THREATS}
        self.words |= {w: (INSULT, v) for w, v in units.items() if not w.endswith("*")}
        self.stems = {u[:-1]: (INSULT, v) for u, v in units.items() if u.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.context = {w: s for ws, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in ws}

    def look(self, word: str) -> tuple[str, float] | None:
        got = [self.words[word]] if word in self.words else []
        got += [self.stems[word[:k]] for k in self.lengths if word[:k] in self.stems]
        return max(got, key=lambda x: x[1]) if got else None

    def clauses(self, text: str, grammar: Grammar) -> list[list[tuple[str, float, float]]]:
        """Of each clause with matches: (contexts, the word's weight, the path's weight) of each match."""
        low = text.lower()
        hits = {w: g for w in set(_WORD.findall(low)) if (g := self.look(w))}
        out = []
        for clause in _CLAUSE.split(low) if hits else ():
            ws = _WORD.findall(clause)
            if not hits.keys().isdisjoint(ws):
                symbols = [hits[w][0] if w in hits else self.context.get(w, OTHER) for w in ws]
                out.append([(o, hits[w][1], x) for w, (o, x) in zip(ws, grammar.paths(symbols)) if w in hits])
        return out


def context_sums(clauses: list[list[tuple[str, float, float]]]) -> np.ndarray:
    """The words' weights summed by context, reported speech before negation before target; and any match at all."""
    out = np.zeros(len(CONTEXTS) + 1)
    for clause in clauses:
        for o, v, _ in clause:
            out[CONTEXTS.index("r" if "r" in o else "n" if "n" in o else "t" if "t" in o else "")] += v
    out[:-1] = np.log1p(out[:-1])
    out[-1] = bool(clauses)
    return out


WIDTH = 4


def clause_features(clauses: list[list[tuple[str, float, float]]]) -> np.ndarray:
    """The strongest clause's score, all clauses' together, how many match, and any match at all."""
    scores = [sum(v * np.exp(x) for _, v, x in clause) for clause in clauses]
    if not scores:
        return np.zeros(WIDTH)
    return np.array([max(scores), np.log1p(sum(scores)), np.log1p(len(scores)), 1.0])


def units_of(text: str) -> set[str]:
    """Distinct words, and their stems of each length as `stem*`."""
    ws = set(_WORD.findall(text.lower()))
    return ws | {w[:k] + "*" for w in ws for k in STEMS if len(w) >= k}


def logistic(x: np.ndarray, y: np.ndarray, l1: float, l2: float, rounds: int = 300) -> np.ndarray:
    """Weights, the bias last: accelerated proximal gradient; the bias is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    pos = max(y.mean(), 1e-6)
    w = np.zeros(x.shape[1], np.float32)
    w[-1] = np.log(pos / max(1 - pos, 1e-6))
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(x @ v)) ** 2 / len(x) + l2 + 1e-9)
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-(x @ z))) - y) / len(x)
        g[:-1] += l2 * z[:-1]
        new = z - step * g.astype(np.float32)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w


#: Weights of the contexts' arcs and of the clauses where nothing can be learned.
BASE = {"t": 0.5, "n": -2.0, "r": -2.0}
BASE_WEIGHTS = np.array([5.0, 0.0, 0.0, 0.0, -4.0])


class ToxicityModel:
    def __init__(self, units: dict[str, float], contexts: dict[str, float], weights: np.ndarray):
        self.lexicon, self.grammar, self.weights = Lexicon(units), Grammar(contexts), weights

    def clause_scores(self, text: str) -> list[float]:
        return [float(sum(v * np.exp(x) for _, v, x in c)) for c in self.lexicon.clauses(text, self.grammar)]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([clause_features(self.lexicon.clauses(t, self.grammar)) for t in texts]).reshape(len(texts), WIDTH)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, text, toxic): at most per_label labelled texts of each label; equal texts of a label count once.

    The rows are chosen by id alone; their list, bounded by per_label, is broadcast to fetch the texts. A label's rows are
    counted, and only the share of hashes that holds half as many again as needed goes to the task that ranks them."""
    known = cut(labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").join(docs.select("doc_id"), "doc_id").withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"))))
    counts = known.groupBy("toxic").agg(F.count("*").alias("_all"))  # two rows
    near = known.join(F.broadcast(counts), "toxic").where(F.col("_h") / 2.0**64 + 0.5 <= (1.5 * per_label + 200) / F.col("_all"))
    order = Window.partitionBy("toxic").orderBy("_h", "doc_id")
    ids = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label).select("doc_id", "toxic").distinct()
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return texts.dropDuplicates(["text", "toxic"])


def candidates(rows: DataFrame, most: int = CANDIDATES) -> tuple[list[str], int, int]:
    """The units that speak most for the label, by G statistic; of a chain of stems with equal counts the longest."""

    def counted(it):
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        n: Counter = Counter()
        for b in it:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[toxic].update(units_of(text))
                n[toxic] += 1
        units = list(total[0].keys() | total[1].keys()) + [""]
        cols = [[total[k][u] for u in units[:-1]] + [n[k]] for k in (1, 0)]
        yield pa.RecordBatch.from_pydict({"unit": units, "a": cols[0], "b": cols[1]}, pa.schema([("unit", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

    total = rows.select("text", F.col("toxic").cast("int")).mapInArrow(counted, "unit string, a long, b long").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    row = total.where("unit = ''").first()
    nt, nn = (int(row.a), int(row.b)) if row else (0, 0)
    if not nt or not nn:
        return [], nt, nn
    p = nt / (nt + nn)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    g = a * F.log(a / (p * (a + b))) + F.when(b > 0, b * F.log(b / ((1 - p) * (a + b)))).otherwise(0.0)
    best = total.where((F.col("unit") != "") & (F.col("a") >= 2) & (a / nt > 8 * b / nn)).withColumn("g", g).orderBy(F.desc("g"), "unit").limit(4 * most).collect()
    chains: dict = defaultdict(list)
    for r in best:  # a stem and a longer unit of it with equal counts stand in the same texts
        own = chains[(r.a, r.b)]
        bare = r.unit.rstrip("*")
        at = next((i for i, x in enumerate(own) if x.startswith(bare) or bare.startswith(x.rstrip("*"))), None)
        if at is None:
            own.append(r.unit)
        elif len(r.unit) > len(own[at]):
            own[at] = r.unit
    left = {u for us in chains.values() for u in us}
    return [r.unit for r in best if r.unit in left][:most], nt, nn


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most: int = CANDIDATES) -> ToxicityModel:
    """The model from documents and labels (doc_id, toxic); the driver gets counts of the candidates and their places."""
    rows = cut(sample(docs, labels, per_label))
    units, nt, nn = candidates(rows, most)
    if not units:
        return ToxicityModel({}, BASE, BASE_WEIGHTS)
    place = {u: i for i, u in enumerate(units)}

    def found(it):
        for b in it:
            got = [sorted(place[u] for u in units_of(t) if u in place) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.list_(pa.int32()))], ["toxic", "units"])

    got = rows.select("text", F.col("toxic").cast("int")).mapInArrow(found, "toxic int, units array<int>").collect()
    got.sort(key=lambda r: (r.toxic, list(r.units)))
    x, y = np.zeros((len(got), len(units)), np.float32), np.array([r.toxic for r in got], np.float32)
    for i, r in enumerate(got):
        x[i, list(r.units)] = 1
    w = logistic(x, y, l1=0.25 / np.sqrt(len(got) + 1) * 0.2, l2=1e-5)[:-1]
    top = max(float(w.max()), 1e-9)
    lexicon = {u: float(v / top) for u, v in zip(units, w) if v > 0.12 * top}

    def features(model: ToxicityModel, of) -> tuple[np.ndarray, np.ndarray]:
        def featured(it):
            for b in it:
                f = [of(model.lexicon.clauses(t, model.grammar)).tolist() for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(f, pa.list_(pa.float64()))], ["toxic", "f"])

        got = rows.select("text", F.col("toxic").cast("int")).mapInArrow(featured, "toxic int, f array<double>").collect()
        got.sort(key=lambda r: (r.toxic, list(r.f)))
        return np.array([r.f for r in got]), np.array([r.toxic for r in got], np.float32)

    # The arcs: how much more or less a context's words count than plain ones.
    plain, *others = logistic(*features(ToxicityModel(lexicon, BASE, BASE_WEIGHTS), context_sums), l1=0, l2=1e-4, rounds=2000).astype(float)[: len(CONTEXTS)]
    known = plain > 1e-3
    contexts = {c: float(np.clip(np.log(max(w, 0.02 * plain) / plain), -4, 2)) if known else BASE[c] for c, w in zip(CONTEXTS[1:], others)}
    model = ToxicityModel(lexicon, contexts, BASE_WEIGHTS)
    weights = logistic(*features(model, clause_features), l1=0, l2=1e-5, rounds=3000).astype(float)
    # The sample is balanced between the labels or not; the bias keeps its own rate, so 0.5 is an even bet in it.
    return ToxicityModel(lexicon, contexts, weights)


def score(df: DataFrame, model: ToxicityModel, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, extra ...) -> doc_id, extra ..., score, predicted; one row each."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a lexicon of at most CANDIDATES units

    def run(it):
        for b in (s for x in it for s in batches([x], BATCH)):
            s = shared.value.scores([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])
        give_back()

    rows = df.select(F.col("doc_id").cast("long"), *extra, F.col("text").cast("string").alias("text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that the model does not reject, with all their columns: they pass through the scoring tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of at most CANDIDATES units
    text = docs.columns.index("text")

    def run(it):
        for b in (s for x in it for s in batches([x], BATCH)):
            s = shared.value.scores([str(t) if t is not None else "" for t in b.column(text).to_pylist()])
            yield b.filter(pa.array(s < 0.5))
        give_back()

    return docs.mapInArrow(run, docs.schema)
