"""Toxicity: a weighted finite-state grammar over clauses.

Words map to symbols (insult, threat, target, negation, reporting verb, hint, other, comma, end of sentence). Three
deterministic weighted transducers run in cascade, composed once into a single table:

* negation marks insults and threats that follow a negation by at most REACH words of the same clause;
* reported speech marks those that follow a reporting verb in the same sentence;
* the scorer gives each (possibly marked) insult or threat a weight, and a further weight once a sentence holds
  both an abusive symbol and a target, in either order.

A text's toxicity is the sum of the weights of its matched clauses; it is toxic from THRESHOLD on. One unaddressed,
negated or reported insult stays below; an addressed insult or threat, or several insults, reach it.

The lists hold known words only. Further insults are learnt from labelled documents, in any language: beginnings of
words (of STEM letters or more, not the whole word) and whole words that toxic documents hold LIFT times as often as
clean ones, found so in each of two halves of the documents apart, in SUPPORT toxic documents and a share SHARE of
them or more in each (rarer words would pass by chance or through copies). They are hints, weaker than insults: it
takes three of them, and an address adds nothing. The fit is that of a classifier, so it reads at most FIT_ROWS
labelled documents of each class, first by hash; all documents are scored.

Defined results: a null or empty text scores 0; rows are scored one by one, so repeated rows get equal results and
null doc_ids are passed on; an empty table gives an empty result; columns of the documents other than doc_id and text
aren't read; a text of any length is read whole; labels other than 0 and 1 or without a doc_id take no part, a
document with both counts as clean; without labels of both classes the lists stand alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import as_text, slices, words
from tidemark.llm.tables import text_batches

THRESHOLD = 1.0
REACH = 3
FIT_ROWS = 6000
STEM, LONGEST = 4, 10
SUPPORT, SHARE, LIFT = 5, 0.02, 5
OTHER, INSULT, THREAT, TARGET, NOT, SAYS, COMMA, END, HINT = range(9)
SYMBOLS = 9
#: Stands for a line break among the words; not white space itself, or it would be lost in splitting.
LINE_END = "\ue000"
#: Words whose symbols a task keeps before it starts anew.
KNOWN_WORDS = 200_000

INSULTS = """idiot idiots moron morons stupid scum loser losers trash worthless pathetic disgusting clown clowns imbecile
imbeciles cretin dumbass dimwit halfwit lowlife degenerate vermin parasite subhuman bastard bastards asshole assholes
bitch bitches whore slut retard retarded arschloch trottel abschaum versager schwachkopf dummkopf wichser connard
connasse imbécile abruti crétin salope débile estúpido estúpida imbécil gilipollas cabrón idiota idiotas pendejo
basura escoria""".split()
THREATS = """kill murder shoot stab strangle slaughter destroy hurt beat lynch behead burn exterminate töten umbringen
erschießen tuer étrangler égorger matar asesinar degollar""".split()
TARGETS = """you your yours yourself u he she him her his they them their theirs we us people everyone women men kids
immigrants neighbours neighbors du dich dir ihr euch sie vous toi ellos ellas ustedes vosotros""".split()
NEGATIONS = "not no never neither nor cannot without hardly isnt arent wasnt werent dont doesnt didnt wont nicht kein keine keinen niemals jamais nunca jamás tampoco".split()
REPORTS = """said says say saying claimed claims wrote writes reported reports alleged alleges quoted quotes told
according testified stated states behauptet behauptete sagte berichtete dit affirme affirmait déclaré dijo afirma
afirmó declaró""".split()
LEXICON = {w: s for s, group in ((NOT, NEGATIONS), (SAYS, REPORTS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)) for w in group}

WEIGHTS = {
    "insult": 0.6, "threat": 0.3, "negated insult": 0.1, "negated threat": 0.05, "reported insult": 0.25, "reported threat": 0.1, "negated reported insult": 0.05, "negated reported threat": 0.0,
    "hint": 0.4, "negated hint": 0.05, "reported hint": 0.15, "negated reported hint": 0.0,
}
ADDRESSED = {"insult": 0.5, "threat": 0.8, "reported insult": 0.15, "reported threat": 0.2}


@dataclass(frozen=True)
class Transducer:
    """Deterministic: arcs[state, input] = (next state, output, weight); state 0 starts."""

    states: int
    arcs: dict[tuple[int, object], tuple[int, object, float]]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds first's output to second; only states that can be reached."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    inputs = sorted({a for _, a in first.arcs}, key=repr)
    while todo:
        p, q = todo.pop()
        for a in inputs:
            p2, b, w1 = first.arcs[p, a]
            q2, c, w2 = second.arcs[q, b]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            arcs[number[p, q], a] = (number[p2, q2], c, w1 + w2)
    return Transducer(len(number), arcs)


def negation() -> Transducer:
    """States count the words that a negation still reaches."""
    arcs = {}
    for s in range(REACH + 1):
        for a in range(SYMBOLS):
            if a == NOT:
                arcs[s, a] = (REACH, "other", 0.0)
            elif a in (COMMA, END):
                arcs[s, a] = (0, "comma" if a == COMMA else "end", 0.0)
            else:
                out = {OTHER: "other", INSULT: "insult", THREAT: "threat", TARGET: "target", SAYS: "says", HINT: "hint"}[a]
                arcs[s, a] = (max(0, s - 1), f"negated {out}" if s and a in (INSULT, THREAT, HINT) else out, 0.0)
    return Transducer(REACH + 1, arcs)


def reported_speech() -> Transducer:
    """State 1: a reporting verb came before in this sentence."""
    arcs = {}
    for s in (0, 1):
        for a in ("other", "comma", "target", "insult", "threat", "hint", "negated insult", "negated threat", "negated hint"):
            out = a
            if s and a.split()[-1] in ("insult", "threat", "hint"):
                out = "negated reported " + a.split()[-1] if " " in a else "reported " + a
            arcs[s, a] = (s, out, 0.0)
        arcs[s, "says"], arcs[s, "end"] = (1, "other", 0.0), (0, "end", 0.0)
    return Transducer(2, arcs)


def scorer() -> Transducer:
    """States: (target seen, bonus still owed to the abuse seen, bonus paid), numbered as they are met."""
    number: dict[tuple, int] = {(False, 0.0, False): 0}
    todo, arcs = [(False, 0.0, False)], {}
    while todo:
        state = todo.pop()
        seen, owed, paid = state
        for a in ("other", "comma", "end", "target", *WEIGHTS):
            weight, new = 0.0, state
            if a == "end":
                new = (False, 0.0, False)
            elif a == "target":
                weight = 0.0 if paid else owed
                new = (True, 0.0, paid or owed > 0)
            elif a in WEIGHTS:
                bonus = ADDRESSED.get(a, 0.0)
                weight = WEIGHTS[a] + (bonus if seen and not paid else 0.0)
                new = (seen, 0.0 if seen or paid else max(owed, bonus), paid or (seen and bonus > 0))
            if new not in number:
                number[new] = len(number)
                todo.append(new)
            arcs[number[state], a] = (number[new], a, weight)
    return Transducer(len(number), arcs)


def grammar() -> tuple[list[list[int]], list[list[float]]]:
    """Next state and weight by [state][symbol]."""
    g = compose(compose(negation(), reported_speech()), scorer())
    return [[g.arcs[s, a][0] for a in range(SYMBOLS)] for s in range(g.states)], [[g.arcs[s, a][2] for a in range(SYMBOLS)] for s in range(g.states)]


_STRIP = re.compile(r"^\W+|\W+$")


def core_of(word: str) -> str:
    return _STRIP.sub("", word.lower()).replace("’", "'")


def parts_of(core: str) -> list[str]:
    """What may be learnt of a word: its beginnings, and itself with an end mark."""
    return [core[:n] for n in range(STEM, min(LONGEST, len(core) - 1) + 1)] + ([core + "$"] if len(core) >= STEM else [])


def symbols(word: str, learnt: frozenset[str] = frozenset()) -> tuple[int, int]:
    """Symbol of a word, and COMMA, END or -1 for the mark that follows it."""
    if word == LINE_END:
        return -1, END
    tail = word[len(word.rstrip(".,;:!?…\"'»”’)")) :]
    mark = END if any(c in ".!?…;" for c in tail) else COMMA if "," in tail or ":" in tail else -1
    core = core_of(word)
    if core.endswith("n't"):
        return NOT, mark
    if core.split("'")[0] in ("you", "he", "she", "they", "we"):
        return TARGET, mark
    symbol = LEXICON.get(core.replace("_", ""), OTHER)
    if learnt and symbol == OTHER and not learnt.isdisjoint(parts_of(core)):
        symbol = HINT
    return symbol, mark


def count_parts(column: pa.Array, cls: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Parts of the words of some texts, and how many texts of each of four classes hold them."""
    w = words(column)
    number: dict[str, int] = {}
    lists = [[number.setdefault(p, len(number)) for p in parts_of(c)] if (c := core_of(x)) not in LEXICON else [] for x in w.vocabulary.to_pylist()]
    counts = np.zeros((max(1, len(number)), 4), np.int64)
    flat, sizes = np.array([p for x in lists for p in x], np.int64), np.array([len(x) for x in lists], np.int64)
    starts = np.cumsum(sizes) - sizes
    for d in range(len(w.offsets) - 1):
        own = np.unique(w.ids[w.offsets[d] : w.offsets[d + 1]])
        n = sizes[own]
        held = flat[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        counts[np.unique(held), cls[d]] += 1
    return list(number), counts[: len(number)]


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> frozenset[str]:
    """Parts of words that hint at insults, from labels (doc_id, toxic); only the sampled doc_ids are broadcast."""
    text_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
        picked = part if picked is None else picked.unionAll(part)
    # 0, 1: clean documents of each half; 2, 3: toxic ones. The half comes from the text, so that copies are in one
    half = F.pmod(F.xxhash64("_text"), F.lit(2))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).join(F.broadcast(picked), "_id")
    texts = texts.select("_text", (F.col("_y") * 2 + half).cast("int").alias("_class"))
    sizes = {r["_class"]: r["count"] for r in texts.groupBy("_class").count().collect()}
    n = [sizes.get(k, 0) for k in range(4)]
    if not all(n):
        return frozenset()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            parts, counts = count_parts(b.column(0), np.asarray(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), *(pa.array(counts[:, k]) for k in range(4))], ["part", "n0", "n1", "n2", "n3"])

    counted = texts.mapInArrow(run, "part string, n0 long, n1 long, n2 long, n3 long").groupBy("part").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    rows = counted.where(" and ".join(f"n{h + 2} >= {max(SUPPORT, SHARE * n[h + 2])} and n{h + 2} * {n[h]} >= {LIFT} * (n{h} + 1) * {n[h + 2]}" for h in (0, 1))).collect()
    return frozenset(r.part for r in rows)


def score_texts(column: pa.Array, table: tuple[list[list[int]], list[list[float]]], learnt: frozenset[str] = frozenset(), known: dict[str, tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Toxicity, matched clauses and the highest clause of each text. known keeps the symbols of words met before."""
    w = words(pc.replace_substring(as_text(column), "\n", f" {LINE_END} "))
    texts = len(w.offsets) - 1
    total, clauses, most = np.zeros(texts), np.zeros(texts, np.int32), np.zeros(texts)
    if not len(w.ids):
        return total, clauses, most
    known = {} if known is None else known
    if len(known) > KNOWN_WORDS:
        known.clear()
    of = np.array([known.get(x) or known.setdefault(x, symbols(x, learnt)) for x in w.vocabulary.to_pylist()], np.int8)
    sym, mark = of[w.ids, 0], of[w.ids, 1]
    trigger = np.flatnonzero((sym == INSULT) | (sym == THREAT) | (sym == HINT))
    if not len(trigger):
        return total, clauses, most
    # sentences that hold a trigger: from behind the last end before it to the next end
    ends = np.append(np.flatnonzero(mark == END), len(sym) - 1)
    doc = w.doc[trigger]
    i = np.searchsorted(ends, trigger)
    first = np.maximum(np.where(i > 0, ends[np.maximum(i - 1, 0)] + 1, 0), w.offsets[doc])
    last = np.minimum(np.where(i < len(ends), ends[np.minimum(i, len(ends) - 1)], len(sym) - 1), w.offsets[doc + 1] - 1)
    go, weight = table
    seen = -1
    for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist()):
        if a == seen:
            continue
        seen, state, value = a, 0, 0.0
        for s, m in zip(sym[a : b + 1].tolist(), mark[a : b + 1].tolist()):
            if s >= 0:
                value += weight[state][s]
                state = go[state][s]
            if m >= 0:
                value += weight[state][m]
                state = go[state][m]
        if value > 0:
            total[d] += value
            clauses[d] += 1
            most[d] = max(most[d], value)
    return np.round(total, 4), clauses, np.round(most, 4)


def score(docs: DataFrame, threshold: float = THRESHOLD, learnt: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, toxicity, clauses (matched), highest (clause weight), toxic; one row per row of docs, no shuffle."""
    table = grammar()
    shared = docs.sparkSession.sparkContext.broadcast(learnt)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, known = shared.value, {}
        for b in slices(batches, 1):
            total, clauses, most = score_texts(b.column(1), table, learnt, known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.array(clauses), pa.array(most), pa.array(total >= threshold)], ["doc_id", "toxicity", "clauses", "highest", "toxic"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, toxicity double, clauses int, highest double, toxic boolean")


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learnt=learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
