"""Toxicity by a grammar of weighted finite-state transducers over the clauses of a text.

Words become symbols (insult, verb of harm, target, negation, verb of saying and so on). Five transducers rewrite a clause's symbols one after
another and are composed into a single machine that reads forward: the insult transducer makes insults of words and of phrases
like `piece of ...`, the threat transducer makes threats of an intention and a verb of harm, the others mark insults and threats that
follow a negation, a verb of saying or a person addressed. A sixth reads what these put out backward and marks those that a person
addressed follows. Each match then has a pattern: what it is, and how the clause uses it. A text's features are the term weights of its matches
summed by pattern. Nothing else of a text counts, so a word is worth what its clause makes of it.

Insults are a given list plus words and word beginnings that labelled texts show significantly; patterns are weighted by a
logistic model that is bound to the order of the patterns: targeted above bare, bare above reported and negated.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, held_out, kept_rows, sampled, stored

#: Classes of words. Only a clause with a HARM, a FILTH or an INSULT can hold a match.
OTHER, TARGET, NEGATION, REPORT, WILL, HEAD, LINK, YOURSELF, HARM, FILTH, INSULT = range(11)
#: What the first transducers make of harm.
THREAT = 11
#: Words of each class.
WORDS = {
    INSULT: "idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown imbecile "
    "fool bastard cretin idiota imbécil estúpido estúpida basura idiote imbécile stupide ordure minable dumm dummkopf abschaum trottel",
    HARM: "kill murder hurt destroy stab shoot strangle beat burn hang töten umbringen erschießen verbrennen tuer crever étrangler matar degollar",
    TARGET: "you your yours youre u he she him her they them these those this that everyone people "
    "du dich dir dein ihr euch sie tu te toi ton ta vous votre il elle ils elles tú ti usted ustedes él ella ellos",
    YOURSELF: "yourself yourselves",
    NEGATION: "not no never isnt arent wasnt dont doesnt didnt cannot nobody hardly nicht kein keine nie niemals pas jamais aucun ne nunca jamás nadie ni",
    REPORT: "said says say saying told tells called calls calling quoted quote quotes wrote writes alleged according accused "
    "sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió",
    WILL: "will gonna shall must werde werden wird vais va allons voy vamos",
    HEAD: "piece waste bag sack heap stück haufen tas sac pedazo montón saco",
    LINK: "of de du von",
    FILTH: "shit crap garbage filth dirt space oxygen air dreck scheiße merde mierda",
}
#: Tokens that a negation and a target reach, and an intention reaches its verb.
REACH, INTENDED = 4, 3
#: Lengths of word beginnings that can be learned as insults, and the different words that a beginning must have shown.
STEMS = range(4, 11)
LEAST_WORDS = 3
#: Labelled rows to learn from (about; more are sampled by a hash of their id). All that is significant in them is learned.
FIT_ROWS = 20_000
#: Chance that any learned term is one by accident; least ratio of its shares in toxic and clean texts; least number of toxic texts.
ACCIDENT, LIFT, LEAST_TEXTS = 0.05, 8, 4
REMEMBERED = 300_000
TOXIC_FROM = 0.7

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]+")


class Transducer:
    """Deterministic: step(state, symbol) gives the next state and the symbol put out. State 0 starts."""

    def __init__(self, step):
        self.step = step

    def then(self, after: Transducer) -> Transducer:
        """The composition: what this one puts out is what the next one reads."""

        def step(state, symbol):
            a, b = state or (0, 0)
            a, out = self.step(a, symbol)
            b, out = after.step(b, out)
            return (a, b), out

        return Transducer(step)


def _match(symbol) -> bool:
    """Whether a symbol is an insult or a threat, marked or not."""
    return isinstance(symbol, tuple)


def _insult(state, symbol):
    """A word of the list, or a head, a link, one more word at most, and filth. state: words of a phrase that have been read."""
    if symbol == INSULT:
        return 0, (INSULT,)
    if symbol == HEAD:
        return 1, OTHER
    if symbol == LINK:
        return (2 if state == 1 else 0), OTHER
    if symbol == FILTH:
        return 0, (INSULT,) if state >= 2 else OTHER
    return (3 if symbol == OTHER and state == 2 else 0), symbol


def _threat(state, symbol):
    """An intention and a verb of harm soon after it, or a verb of harm and `yourself`. state: tokens that the intention still reaches, whether the last was harm."""
    left, harm = state or (0, False)
    if symbol == WILL:
        return (INTENDED, False), OTHER
    left_now = max(0, left - 1)
    if symbol == HARM:
        return (left_now, True), (THREAT,) if left else OTHER
    if symbol == YOURSELF:
        return (left_now, False), (THREAT,) if harm else TARGET
    return (left_now, False), symbol


def _marker(mark: str, by: int):
    """Marks matches that follow the symbol `by` within REACH tokens."""

    def step(state, symbol):
        if symbol == by:
            return REACH, symbol
        return max(0, state - 1), (*symbol, mark) if state and _match(symbol) else symbol

    return step


def _report(state, symbol):
    if symbol == REPORT:
        return 1, symbol
    return state, (*symbol, "reported") if state and _match(symbol) else symbol


FORWARD = Transducer(_insult).then(Transducer(_threat)).then(Transducer(_marker("negated", NEGATION))).then(Transducer(_report)).then(Transducer(_marker("targeted", TARGET)))
#: It reads from the end of a clause, so it marks matches before a target.
BACKWARD = Transducer(_marker("targeted", TARGET))

#: How a clause uses a match, the mildest first.
PATTERNS = ("denied report", "negated", "reported", "reported and targeted", "bare", "targeted")


def pattern(marks) -> int:
    """The place in PATTERNS of a match with these marks."""
    if "negated" in marks:
        return 0 if "reported" in marks else 1
    if "reported" in marks:
        return 3 if "targeted" in marks else 2
    return 5 if "targeted" in marks else 4


def tables(machine: Transducer, symbols: list) -> tuple[list[list[int]], list[list]]:
    """The machine as tables by state and place of a symbol: next state, symbol put out. Its states are those that can be reached."""
    states, moves, outs = {0: 0}, [], []
    todo = [0]
    for state in todo:
        row, out = [], []
        for symbol in symbols:
            to, given = machine.step(state, symbol)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
            out.append(given)
        moves.append(row)
        outs.append(out)
    return moves, outs


MOVES, _OUT = tables(FORWARD, list(range(INSULT + 1)))
#: What the forward machine can put out, and its outputs as places there.
PUT_OUT = sorted({x for row in _OUT for x in row}, key=str)
OUTS = [[PUT_OUT.index(x) for x in row] for row in _OUT]
BACK_MOVES, _BACK = tables(BACKWARD, PUT_OUT)
#: (row of the sums, pattern) or None.
BACK_OUTS = [[(int(x[0] == THREAT), pattern(x[1:])) if _match(x) else None for x in row] for row in _BACK]

#: How grave a clause is by the pattern of its gravest match; clauses that are added to a text's own, so that few clauses say less.
GRAVITY, MORE_CLAUSES = (0.0, 0.1, 0.2, 0.3, 0.8, 1.0), 4
#: Weights that hold where nothing is learned, and the least ones: what each pattern adds to the one before it, for given words and for learned ones, what a
#: threat adds, the mean gravity of clauses, and 1.
_STEPS, _LEAST_STEPS = [0.0, 0.1, 0.3, 0.2, 2.0, 1.0], [0.0, 0.05, 0.05, 0.05, 0.5, 0.3]
PRIOR = np.array([*_STEPS, *_STEPS, 1.0, 1.0, -2.5])
LEAST = np.array([*_LEAST_STEPS, *_LEAST_STEPS, 0.3, 0.0, -math.inf])
#: How far the weights are drawn to those.
_DRAWN = [1.0, 1.0, 1.0, 1.0, 0.05, 0.05]
RIDGE = np.array([*_DRAWN, *_DRAWN, 0.05, 0.05, 0.05])
#: Rows of what is read in a text: sums for insults of the given words and phrases, for threats, for insults of learned words; and the mean gravity of its clauses.
GIVEN_INSULTS, THREATS, LEARNED_INSULTS, MEAN_GRAVITY = range(4)


def features_of(sums: list[list[float]]) -> list[float]:
    """sums: term weights by GIVEN_INSULTS, THREATS, LEARNED_INSULTS and pattern, and [mean gravity]. A pattern's weight is that of the milder ones and what it adds, so its sum counts
    for each of them."""
    given, threats, learned = ([math.log2(1 + x) for x in row] for row in sums[:MEAN_GRAVITY])
    both = [a + b for a, b in zip(given, threats, strict=True)]
    return [*(sum(f[k:]) for f in (both, learned) for k in range(len(PATTERNS))), threats[4] + threats[5], *sums[MEAN_GRAVITY], 1.0]


class Lexicon:
    """The class and the weight of words: the given lists, learned words, learned beginnings. Given words that texts don't show weigh as those of
    the list that they do show (base, the median)."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.terms, self.stems = terms, stems
        shown = sorted(terms[w] for w in WORDS[INSULT].split() if w in terms)
        self.base = max(1.0, shown[len(shown) // 2]) if shown else 1.0

    def of(self):
        """A function from a token to its class, its weight and whether it is learned."""
        given = {w: k for k, line in WORDS.items() for w in line.split()}
        terms, stems, lengths, base = self.terms, self.stems, sorted({len(x) for x in self.stems}), self.base

        def find(token: str) -> tuple[int, float, bool]:
            head, mark, tail = token.replace("’", "'").partition("'")
            bare = head + tail
            if bare not in given and mark:
                if tail == "ll":
                    return WILL, 0.0, False
                bare = head
            kind = given.get(bare, OTHER)
            if kind != OTHER:
                return kind, terms.get(bare, base) if kind == INSULT else 0.0, False
            weight = terms.get(bare) or max((stems[bare[:n]] for n in lengths if bare[:n] in stems), default=0.0)
            return (INSULT, weight, True) if weight else (OTHER, 0.0, False)

        return find

    def reader(self):
        """A function from a text to its sums of term weights, see features_of(). It remembers REMEMBERED words at most."""
        find = self.of()
        # Codes are classes; insults, whose weights differ, have further ones.
        known: dict[str, int] = {}
        weights: list[float] = [self.base] * (INSULT + 1)
        learned = [False] * (INSULT + 1)
        place: dict[tuple[float, bool], int] = {}
        border = -1

        def number(token: str) -> int:
            if not token[0].isalpha():
                code = border
            else:
                code, weight, new = find(token)
                if code == INSULT:
                    if (weight, new) not in place:
                        place[weight, new] = len(weights)
                        weights.append(weight)
                        learned.append(new)
                    code = place[weight, new]
            if len(known) < REMEMBERED:
                known[token] = code
            return code

        def read(text: str | None) -> list[list[float]]:
            sums = [*([0.0] * len(PATTERNS) for _ in range(MEAN_GRAVITY)), [0.0]]
            codes = [known[x] if x in known else number(x) for x in TOKEN.findall((text or "").lower())]
            if not codes or max(codes) < HARM:
                return sums
            codes.append(border)
            begin, clauses, total = 0, MORE_CLAUSES, 0.0
            while begin < len(codes):
                end = codes.index(border, begin)
                clause = codes[begin:end]
                begin = end + 1
                clauses += len(clause) > 0
                if not clause or max(clause) < HARM:
                    continue
                gravest = 0.0
                state, out = 0, []
                for code in clause:
                    symbol = code if code < INSULT else INSULT
                    out.append(OUTS[state][symbol])
                    state = MOVES[state][symbol]
                state = 0
                for k in range(len(clause) - 1, -1, -1):
                    match = BACK_OUTS[state][out[k]]
                    state = BACK_MOVES[state][out[k]]
                    if match:
                        weight = weights[clause[k]]
                        sums[LEARNED_INSULTS if learned[clause[k]] else match[0]][match[1]] += weight
                        gravest = max(gravest, GRAVITY[match[1]] * weight)
                total += gravest
            sums[MEAN_GRAVITY][0] = total / clauses
            return sums

        return read


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scorer(self):
        read, weights = self.lexicon.reader(), self.weights.tolist()

        def score(texts) -> list[float]:
            got = (sum(a * b for a, b in zip(features_of(read(x)), weights, strict=True)) for x in texts)
            return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in got]

        return score


_GIVEN = frozenset(w for line in WORDS.values() for w in line.split())
_CLASSED = _GIVEN - frozenset(WORDS[INSULT].split())


def _terms(text: str) -> tuple[set[str], set[str]]:
    """The words of a text without those that are given for something else, and the beginnings of those that aren't given at all."""
    words = {x for x in TOKEN.findall(text.lower()) if x[0].isalpha()} - _CLASSED
    return words, {w[:n] for w in words - _GIVEN for n in STEMS if n < len(w)}


def _by_accident(p: int, n: int, rate: float) -> float:
    """The chance that of p + n texts p or more are toxic, if each is with this rate."""
    m = p + n
    choose = lambda k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    return sum(math.exp(choose(k) + k * math.log(rate) + (m - k) * math.log1p(-rate)) for k in range(p, m + 1))


def _learned(counts: dict, toxic: int, clean: int, tests: int) -> dict[str, float]:
    """Terms that toxic texts have more often than chance explains, with a weight that grows with how rarely clean ones have them. counts: toxic and clean texts
    with the term. tests: terms that are tried, as each of them can be one by accident."""
    out = {}
    for term, (p, n) in counts.items():
        lift = math.log(((p + 0.5) / (toxic + 1)) / ((n + 0.5) / (clean + 1)))
        if lift >= math.log(LIFT) and _by_accident(p, n, toxic / (toxic + clean)) * tests <= ACCIDENT:
            out[term] = min(3.0, lift / 3)
    return out


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, least: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The weights, none below `least`, of a logistic model whose weights are drawn towards prior. Projected Newton steps."""

    def cost(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + (ridge * (w - prior) ** 2).sum() / 2

    w = np.maximum(prior, least).astype(float)
    now = cost(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) + ridge * (w - prior)
        free = (w > least) | (slope < 0)
        curve = (x.T * (p * (1 - p))) @ x + np.diag(ridge)
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], -slope[free])
        size = 1.0
        while size > 1e-9 and cost(np.maximum(w + size * step, least)) > now - 1e-12:
            size /= 2
        new = np.maximum(w + size * step, least)
        got = cost(new)
        if now - got < 1e-12:
            break
        w, now = new, got
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learns from labelled rows that aren't held out: fit_rows of them (about), sampled by a hash of the id.

    Several labels of an id count as toxic if one is; of several texts of an id the least is learned from, so fit_rows bounds texts as well.
    Null labels, ids and texts are left out. With no toxic or no clean row the grammar's own weights and lists hold.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).filter("id is not null and toxic is not null")
    known = sampled(known.filter(~held_out(F.col("id"))), "id", fit_rows).groupBy("id").agg(F.max("toxic").alias("toxic"))
    # fit_rows bounds the side that is broadcast.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(known), "id")
    rows = rows.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")
    rows = stored(rows, "labelled")
    try:
        sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not clean:
            return ToxicityModel(Lexicon({}, {}), PRIOR)

        def named(batches):
            held: Counter = Counter()
            for batch in bounded_batches(batches):
                for text in batch.column(0).to_pylist():
                    words, stems = _terms(text)
                    held.update((0, w) for w in words)
                    held.update((1, s) for s in stems)
                if len(held) > 200_000:
                    yield from _pairs(held)
                    held.clear()
            yield from _pairs(held)

        found = rows.filter("toxic = 1").select("text").mapInArrow(named, "stem int, term string, c long")
        found = stored(found.groupBy("stem", "term").agg(F.sum("c").alias("c")), "terms")
        often = found.filter(F.col("c") >= LEAST_TEXTS)
        # A beginning must be that of several words, none of which has over three quarters of its texts: else the word itself is the term.
        words = found.filter((F.col("stem") == 0) & ~F.col("term").isin(*WORDS[INSULT].split())).select(F.explode(F.transform(F.array(*map(F.lit, STEMS)), lambda n: F.when(n < F.length("term"), F.substring("term", F.lit(1), n)))).alias("term"), "c")
        words = words.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("words"), F.max("c").alias("most"))
        stems = often.filter("stem = 1").join(words, "term").filter((F.col("words") >= LEAST_WORDS) & (F.col("most") * 4 <= F.col("c") * 3)).select("stem", "term", "c")
        tried = often.filter("stem = 0").select("stem", "term", "c").union(stems)
        candidates = {(r[0], r[1]): r[2] for r in tried.toLocalIterator()}  # of fit_rows texts
        shared = spark.sparkContext.broadcast(frozenset(candidates))

        def elsewhere(batches):
            held: Counter = Counter()
            wanted = shared.value
            for batch in bounded_batches(batches):
                for text in batch.column(0).to_pylist():
                    words, stems = _terms(text)
                    held.update(x for x in ((0, w) for w in words) if x in wanted)
                    held.update(x for x in ((1, s) for s in stems) if x in wanted)
            yield from _pairs(held)

        others = rows.filter("toxic = 0").select("text").mapInArrow(elsewhere, "stem int, term string, c long")
        clean_counts = {(r[0], r[1]): r[2] for r in others.groupBy("stem", "term").agg(F.sum("c").alias("c")).collect()}
        both = [{t: (c, clean_counts.get((k, t), 0)) for (k, t), c in candidates.items() if k == stem} for stem in (0, 1)]
        lexicon = Lexicon(*(_learned(x, toxic, clean, len(candidates)) for x in both))
        spread = spark.sparkContext.broadcast(lexicon)

        def featured(batches):
            read = None
            for batch in bounded_batches(batches):
                read = read or spread.value.reader()
                x = [features_of(read(t)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

        got = rows.mapInArrow(featured, "toxic int, x array<double>").toArrow()  # fit_rows short rows
        x = np.array(got.column("x").to_pylist(), float)
        return ToxicityModel(lexicon, logistic(x, got.column("toxic").to_numpy().astype(float), PRIOR, LEAST, RIDGE))
    finally:
        forget(rows)


def _pairs(held: Counter):
    yield pa.RecordBatch.from_pydict({"stem": pa.array([k for k, _ in held], pa.int32()), "term": pa.array([t for _, t in held], pa.string()), "c": pa.array(held.values(), pa.int64())})


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score, predicted. Null and empty texts score as a text without a match.
    Repeated rows are repeated; an empty table gives no rows; further columns are ignored."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        judge = None
        for batch in bounded_batches(batches):
            judge = judge or shared.value.scorer()
            got = judge(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array([int(x >= TOXIC_FROM) for x in got], pa.int32())],
                ["id", "held_out", "score", "predicted"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def civil(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below TOXIC_FROM. Null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide():
        judge = shared.value.scorer()
        return lambda texts: [x < TOXIC_FROM for x in judge(texts)]

    return kept_rows(docs, text_col, decide)
