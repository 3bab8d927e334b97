"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become classes - insult, threat, target, negation, reported speech, copula, determiner, other - and transducers, composed into one
machine, rewrite the class string of a text. An insult after a negation within three words is marked negated; after
a reporting verb, reported; within three words after a copula, predicated (you are a ...); right after a determiner, naming (that ...); within three words after another insult, strung; at
the begin or end of its clause or beside a comma, addressed; with a target word in its clause, aimed. Any other is plain and counts for nothing, however many there are. A
threat counts only with a target in its clause. A document's features are how often each mark was put out, and the
lexicon weights of the insults of clauses with a mark, of negated and of reported ones; what each says is fitted on labelled documents. Words alone score nothing: a text of plain insults
gets the base score.

Insults are learned: of the words and word beginnings (4 to 8 characters, so that inflected forms share one) those stay
that nearly only labelled-toxic documents have, each with its log odds; near copies count once, as documents count by
two min-hashes of their words. Other classes are short fixed lists in four languages.

Defined results: a null or empty text, or one without a pattern that matches, gets the base score; without labels of
both kinds nothing is learned and every score is 0; repeated rows give repeated rows; other columns are ignored; of
several labels for an id the largest counts; an empty table gives an empty table.

Scale: about TRAIN_ROWS labelled documents at most (those of smallest hashed id) train; their ids, bounded by that number, are
broadcast, so that texts are never shuffled, and their words are written once. Scoring is one narrow map with a machine of a few hundred bytes and a
lexicon that the training rows bound: each form is in MIN_DOCS of them or nearly so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hash_sample, slices, table, written

TRAIN_ROWS = 20_000
#: Documents that must have a form (fewer, but 4, where 25 times as many toxic ones are not there), the share of them labelled toxic, lengths of beginnings, words that one must have.
MIN_DOCS, MIN_PRECISION, STEM, MIN_WORDS = 6, 0.8, (4, 8), 4
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.;:!?\n]+|,")

#: Fixed word classes.
WORDS = {
    "T": "you your yours yourself he she they them their him her tu toi vous ton ta votre vos ils elles du dich dir dein deine ihr euch sie él ella ellos usted ustedes vosotros tú ti",
    "N": "not no never isn't aren't wasn't don't nor neither pas jamais nicht kein keine nie nunca tampoco",
    "R": "said says say called calls wrote quoted alleged claimed reported dit disait écrit sagt sagte schrieb nannte dijo dice escribió llamó",
    "C": "is are was were am be being est sont était es ist sind bist war seid eres soy sois",
    "D": "a an the this that these those such un une le la les ce cet cette ces der die das ein eine dieser diese dieses el los las una este esta ese esa",
    "H": "kill hurt destroy beat punch stab shoot burn attack tuer frapper détruire töten schlagen vernichten matar golpear destruir",
}
#: Insults known without labels, unless the labels say otherwise, and their log odds.
SEEDS, SEED_ODDS = "idiot idiots moron morons stupid dumb loser losers scum scumbag trash garbage pathetic worthless disgusting clown imbecile jerk fool coward", 3.0
FIXED = {w: c for c, ws in WORDS.items() for w in ws.split()}


class Transducer:
    """A deterministic transducer: step(state, symbol) -> (state, symbols put out). Symbols without a step pass unchanged."""

    def __init__(self, start, steps: dict):
        self.start, self.steps = start, steps

    def step(self, state, symbol):
        return self.steps.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The machine that feeds what first puts out to second, over all states reached."""
    start = (first.start, second.start)
    steps, todo, seen = {}, [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in alphabet:
            a2, mid = first.step(a, symbol)
            b2, out = b, ""
            for m in mid:
                b2, o = second.step(b2, m)
                out += o
            steps[(state, symbol)] = ((a2, b2), out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(start, steps)


#: Input classes; $ ends a clause. Marks put out: A aimed, V addressed, B predicated, M naming, S strung, n negated, q reported insult, X aimed threat.
ALPHABET, MARKS, MATCHED = "ITNRHOCD,$", "AVBMSnqX", frozenset("AVBMS")


def grammar() -> Transducer:
    scope, words = 3, "THORCD,"

    def window(opens: str, mark: str) -> dict:
        """An insult within `scope` symbols after one that opens is marked."""
        steps = {(0, c): (scope, c) for c in opens} | {(0, "$"): (0, "$")}
        for k in range(1, scope + 1):
            steps |= {(k, c): (k - 1, c) for c in words + "NI" if c not in opens} | {(k, c): (scope, c) for c in opens} | {(k, "I"): (k - 1, mark), (k, "$"): (0, "$")}
        return steps

    reported = {(0, "R"): (1, "R"), (1, "I"): (1, "q"), (1, "$"): (0, "$")}
    naming = {(0, "D"): (1, "D"), (1, "I"): (0, "M"), (1, "D"): (1, "D")} | {(1, c): (0, c) for c in "THORCN,$nqB"}
    # a later insult is strung to one of any kind that is not negated or reported
    strung = {(k, c): (scope, c if c in "BM" else "S" if k else "I") for k in range(scope + 1) for c in "IBM"}
    strung |= {(k, c): (k - 1, c) for k in range(1, scope + 1) for c in words + "Nnq"} | {(k, "$"): (0, "$") for k in range(1, scope + 1)}
    # at the begin of a clause or after a comma at once; else it waits for what follows
    addressed = {("", "I"): ("m", "V"), ("", "$"): ("", "$"), ("", ","): ("", ","), ("m", "I"): ("w", ""), ("w", "I"): ("w", "I"), ("w", "$"): ("", "V$"), ("w", ","): ("", "V,"), ("m", "$"): ("", "$"), ("m", ","): ("", ",")}
    addressed |= {(s, c): ("m", ("I" if s == "w" else "") + c) for s in ("", "m", "w") for c in "THORCDNnqBMS"}
    # threats stay marks only where a target stands in the clause: T is kept by this machine, which comes before target's
    threat = {("", "H"): ("h", ""), ("h", "T"): ("x", "XT"), ("h", "H"): ("h", ""), ("", "T"): ("t", "T"), ("t", "H"): ("t", "X"), ("x", "H"): ("x", "X")} | {(s, "$"): ("", "$") for s in ("", "h", "t", "x")}
    # a target is seen before the insult, or an insult waits for one until its clause ends
    target = {("", "T"): ("t", ""), ("", "I"): ("i", ""), ("i", "I"): ("i", ""), ("i", "T"): ("t", "A"), ("i", "$"): ("", "$"), ("t", "I"): ("t", "A"), ("t", "T"): ("t", ""), ("t", "$"): ("", "$"), ("", "$"): ("", "$")}
    marks = {("", c): ("", "") for c in "INRHOCDT,"}  # only marks and the ends of clauses remain
    machine = compose(Transducer(0, window("N", "n")), Transducer(0, reported), ALPHABET)
    for start, steps in ((0, window("C", "B")), (0, naming), (0, strung), ("", addressed), ("", threat), ("", target), ("", marks)):
        machine = compose(machine, Transducer(start, steps), ALPHABET)
    return machine


class Scorer:
    """Marks of texts under a lexicon {word or beginning*: weight}."""

    def __init__(self, lexicon: dict[str, float]):
        self.whole = {w: v for w, v in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in lexicon.items() if w.endswith("*")}
        self.sizes = sorted({len(w) for w in self.stems})
        self.machine, self.known = grammar(), {}

    def insult(self, word: str) -> float:
        v = self.known.get(word)
        if v is None:
            v = self.whole.get(word, 0.0)
            for n in self.sizes:
                if len(word) > n:
                    v = max(v, self.stems.get(word[:n], 0.0))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = v
        return v

    def features(self, text: str | None) -> list[float]:
        """The logarithm of each mark's number, then that of the summed weights of the insults of clauses with a pattern, of negated and of reported ones."""
        words = _WORD.findall((text or "").lower())
        hit = {w: v for w in set(words) if (v := self.insult(w))}
        out, matched, negated, said = dict.fromkeys(MARKS, 0), 0.0, 0.0, 0.0
        if hit or not FIXED_H.isdisjoint(words):
            state, clause, marked = self.machine.start, 0.0, False
            for w in [*words, "."]:
                symbol = "I" if w in hit else w if w == "," else "$" if w[0] in ".;:!?\n" else FIXED.get(w, "O")
                state, put = self.machine.step(state, symbol)
                if symbol == "I":  # negated and reported ones are marked at once
                    negated += hit[w] * ("n" in put)
                    said += hit[w] * ("q" in put)
                    clause += hit[w] * ("n" not in put and "q" not in put)
                for m in put:
                    if m in out:
                        out[m] += 1
                        marked = marked or m in MATCHED
                if symbol == "$":
                    matched, clause, marked = matched + clause * marked, 0.0, False
        return [*(float(np.log1p(v)) for v in out.values()), *(float(np.log1p(v)) for v in (matched, negated, said))]


FIXED_H = frozenset(w for w, c in FIXED.items() if c == "H")


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Insults of labelled (text, toxic): whole words and beginnings ("stem*") with their log odds."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != ""))
    low = F.struct(F.array_min(F.transform("w", lambda x: F.xxhash64(x))), F.array_min(F.transform("w", lambda x: F.xxhash64(x, F.lit(1)))))
    docs = labelled.select("toxic", words.alias("w")).where(F.size("w") > 0).select("toxic", "w", F.xxhash64(low).alias("sig"))
    each = written(docs.select("toxic", "sig", F.explode("w").alias("x")).distinct(), "words")
    sizes = each.agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("sig"))).alias("n1"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("sig"))).alias("n0")).first()
    if not sizes["n1"] or not sizes["n0"]:
        return {}
    n1, n0 = F.sum("n1").alias("n1"), F.sum("n0").alias("n0")
    whole = each.groupBy("x").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    forms = F.array(F.col("x"), *[F.when(F.length("x") > k, F.concat(F.substring("x", 1, k), F.lit("*"))) for k in range(STEM[0], STEM[1] + 1)])
    forms = whole.select("n1", "n0", F.explode(forms).alias("form")).where("form is not null")
    odds = F.log((F.col("n1") + 0.5) / (sizes["n1"] + 1)) - F.log((F.col("n0") + 0.5) / (sizes["n0"] + 1))
    least = max(4, min(MIN_DOCS, sizes["n1"] // 25))
    counts = forms.groupBy("form").agg(n1, n0, F.count_if(F.col("n1") > 0).alias("words"))
    counts = counts.where(~F.col("form").endswith("*") | (F.col("words") >= MIN_WORDS))
    seeds = counts.where(F.col("form").isin(SEEDS.split()) & (F.col("n1") + F.col("n0") >= least)).select("form", (F.col("n1") >= MIN_PRECISION * (F.col("n1") + F.col("n0"))).alias("ok")).collect()
    out = dict.fromkeys(SEEDS.split(), SEED_ODDS)
    for r in seeds:
        if not r["ok"]:
            del out[r["form"]]
    found = counts.where((F.col("n1") >= least) & (F.col("n1") >= MIN_PRECISION * (F.col("n1") + F.col("n0")))).select("form", odds.alias("v"), "n1")
    rows = sorted(found.collect(), key=lambda r: (-r["n1"], r["form"]))
    discard(each)
    stems = {r["form"][:-1] for r in rows if r["form"].endswith("*")}
    for r in rows:  # a form goes where a shorter beginning of it is in the lexicon already
        body = r["form"].rstrip("*")
        if not any(body[:k] in stems for k in range(STEM[0], len(body))):
            out[r["form"]] = float(r["v"])
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.1)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x.T * (p * (1 - p))) @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def learn(training: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray | None]:
    """Lexicon and weights from the rows of training (doc_id, text) that labels (doc_id, toxic) name; no weights where nothing was learned."""
    chosen = hash_sample(labels.where("doc_id is not null and toxic is not null"), "doc_id", train_rows).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    labelled = training.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    lexicon = learn_lexicon(labelled)
    if not lexicon:
        return lexicon, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in slices(batches):
            marks = [scorer.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(marks, pa.list_(pa.float64()))], names=["toxic", "marks"])

    rows = labelled.select("toxic", "text").mapInArrow(run, "toxic long, marks array<double>").toPandas()
    return lexicon, _fit(np.array(rows["marks"].tolist()), rows["toxic"].to_numpy(float))


def _scores(features: list[list[float]], weights: np.ndarray | None) -> np.ndarray:
    f = np.array(features).reshape(len(features), len(MARKS) + 3)
    return np.zeros(len(f)) if weights is None else 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))


def score(docs: DataFrame, training: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, marks for each row of docs (doc_id, text). labels (doc_id, toxic) names the rows of training (doc_id, text) to learn from."""
    lexicon, weights = learn(training, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in slices(batches):
            marks = [scorer.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scores(marks, weights)), pa.array(marks, pa.list_(pa.float64()))], names=["doc_id", "score", "marks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, marks array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns. labels (doc_id, toxic) names rows of docs to learn from."""
    lexicon, weights = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for b in slices(batches):
            yield b.filter(pa.array(_scores([scorer.features(t.as_py()) for t in b.column("text")], weights) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 3) == 1, F.lit(False))
    out = score(docs, docs, labels.where(~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
