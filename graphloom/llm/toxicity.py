"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (with a weight), threat, target, negation, reported speech or none.
Three transducers are composed over a clause's symbols: negation turns an insult or threat soon
after it into its negated form, reported speech into its reported form, and a target before an
insult or threat, or close behind, marks it as aimed at someone. What comes out is weighed by
clause, so a matched clause counts and an isolated word only for what its clause makes of it: a negated
insult or threat counts for nothing.

A word is a run of letters and digits; an apostrophe, straight or curly, between two of them is left out
(don't is dont), and quotes, dashes and other marks part words, whether they are ASCII or not. A-Z and the
accented capitals of Latin-1 are read as small letters.

The insult transducer has fixed seeds, and stems and weights learned from labelled rows: beginnings of
words and whole words that occur in toxic documents far more often than in others, with near copies of
a training document left out, as their words would look like insults. A logistic model over the
clause sums gives the score; it starts from the grammar's own weights, so patterns that no
label shows keep theirs. Training reads at most TRAIN_ROWS labelled documents of either
class, the first by a hash of their id, none longer than TRAIN_BYTES; scoring reads every whole text.

Labels, lang, source and doc_id are never inputs of a score. Defined cases: null and empty texts
match nothing and get the score of no match; repeated rows get equal scores and are learned from once; null labels are
ignored, of several labels of a document the largest counts, of several texts of a labelled doc_id one; without labelled rows of both
classes the seeds and the grammar's own weights decide; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .neardup import registers
from .quality import held_out

TRAIN_ROWS = 3000
TRAIN_BYTES = 32_000
THRESHOLD = 0.5
STEM = range(3, 9)

# Closed word classes in four languages, written without apostrophes, and insults and threats known without labels.
TARGETS = "you your yours youre youve u ur he him his she her hers they them their theyre these those people du dich dir dein deine deiner ihr euch euer er ihn ihm sie ihnen tu te toi ton ta tes vous votre vos il lui elle eux leur leurs tú ti tus usted ustedes él ella ellos ellas vosotros".split()
NEGATIONS = "not no never none nobody neither nor without isnt arent aint wasnt werent dont doesnt didnt cannot cant couldnt wont wouldnt shouldnt hasnt havent hadnt nicht kein keine keinen keiner keinem nie niemals nein weder pas jamais non ni aucun aucune nest nunca jamás tampoco ningún ninguna".split()
REPORTED = "said says say told tells wrote writes claimed claims called calls quoted quotes quote according reportedly allegedly sagte sagt schrieb schreibt nannte nennt behauptet laut dit disait écrit appelle selon prétend dijo dice escribió llama llamó según afirma".split()
THREATS = "kill killed kills hurt beat burn destroy shoot stab hang strangle murder punch töten töte umbringen schlagen verbrennen vernichten erschießen tuer tuerai frapper brûler détruire poignarder matar mataré golpear quemar destruir disparar".split()
SEEDS = "idiot idiots idiotic moron morons stupid loser losers scum trash garbage worthless pathetic disgusting dumb clown fool imbecile dumm dummkopf trottel idioten depp abschaum imbécile débile idiote crétin abruti estúpido estúpida idiota imbécil tonto tonta basura escoria".split()
SEED_WEIGHT = 3.0

NONE, INSULT, THREAT, TARGET, NEGATED, SPEECH = range(6)


class Transducer:
    """States and outputs by (state, symbol); a symbol without an arc passes, and the state goes to rest[state]."""

    def __init__(self, arcs: dict[tuple[int, object], tuple[int, object]], rest: dict[int, int]):
        self.arcs, self.rest = arcs, rest

    def step(self, state: int, symbol: object) -> tuple[int, object]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)


#: Up to three words behind a negation are in its reach.
NEGATION = Transducer({**{(s, NEGATED): (3, NONE) for s in range(4)}, **{(s, x): (s - 1, ("negated", x)) for s in (1, 2, 3) for x in (INSULT, THREAT)}}, {3: 2, 2: 1, 1: 0})
#: Up to the clause's end.
SPEAKING = Transducer({**{(s, SPEECH): (1, NONE) for s in (0, 1)}, **{(1, x): (1, ("reported", x)) for x in (INSULT, THREAT)}}, {})
#: State 0: no target yet; 4: one seen; 1 to 3: an insult, 5 to 7: a threat waits that many words (less 4) for its target.
AIM = Transducer(
    {
        **{(s, TARGET): (4, ("late", INSULT) if 0 < s < 4 else ("late", THREAT) if s > 4 else NONE) for s in range(8)},
        **{(s, INSULT): (3, INSULT) for s in range(8)},
        **{(s, THREAT): (7, THREAT) for s in range(8)},
        **{(4, x): (4, ("aimed", x)) for x in (INSULT, THREAT)},
    },
    {3: 2, 2: 1, 1: 0, 7: 6, 6: 5, 5: 0},
)
CHAIN = (NEGATION, SPEAKING, AIM)
OUTPUTS = {x: i for i, x in enumerate((INSULT, ("aimed", INSULT), ("late", INSULT), ("reported", INSULT), THREAT, ("aimed", THREAT), ("late", THREAT), ("reported", THREAT), ("negated", INSULT), ("negated", THREAT)))}
#: Behind the outputs: matched clauses, all insults, insults in a hundred words. Negated ones count for nothing.
CLAUSES, INSULTS, SHARE, FEATURES = 10, 11, 12, 13
#: The grammar's own weights of log(1 + feature), and bias.
OWN = np.array([0.8, 1.2, 0.6, 0.2, 0.4, 4.0, 4.0, 0.2, 0.0, 0.0, 0.2, 0.8, 0.0])
OWN_BIAS = -2.6


def composed() -> tuple[np.ndarray, np.ndarray]:
    """The chain as one machine: next state and output feature (-1: none) for each state and symbol."""
    number, todo, step, out = {(0, 0, 0): 0}, [(0, 0, 0)], [], []
    for states in todo:
        step_row, out_row = [], []
        for symbol in range(6):
            now, s = [], symbol
            for t, state in zip(CHAIN, states):
                nxt, s = t.step(state, s)
                now.append(nxt)
            key = tuple(now)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            step_row.append(number[key])
            out_row.append(OUTPUTS.get(s, -1))
        step.append(step_row)
        out.append(out_row)
    return np.array(step), np.array(out)


_ENDS = np.zeros(256, bool)
_ENDS[[ord(x) for x in ".!?;\n\r"]] = True


def normalized(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in small letters, marks that aren't ASCII as spaces, apostrophes within words left out; and the offsets of the texts in them."""
    low = c.LOWER[data]
    n = len(low)
    out = np.ones(n, bool)
    if (low >= 0xC2).any():
        lead = np.flatnonzero(low == 0xC3)
        lead = lead[lead + 1 < n]
        capital = lead[(low[lead + 1] >= 0x80) & (low[lead + 1] <= 0x9E) & (low[lead + 1] != 0x97)] + 1
        low[capital] += 0x20
        # U+0080 to U+00BF but for the letters of it; general punctuation; marks of CJK
        for first, second, size in ((0xC2, range(0x80, 0xC0), 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
            spot = np.flatnonzero(low == first)
            spot = spot[spot + size <= n]
            spot = spot[np.isin(low[spot + 1], list(second))]
            if first == 0xC2:
                spot = spot[~np.isin(low[spot + 1], [0xAA, 0xB5, 0xBA])]
            if first == 0xE2:  # a curly apostrophe is a straight one
                curly = spot[(low[spot + 1] == 0x80) & (low[spot + 2] == 0x99)]
                spot = np.setdiff1d(spot, curly, assume_unique=True)
                low[curly] = 0x27
                out[curly + 1] = out[curly + 2] = False
            for i in range(size):
                low[spot + i] = 0x20
    if not out.all():
        offsets = np.concatenate([[0], np.cumsum(out)])[offsets]
        low, out = low[out], np.ones(int(out.sum()), bool)
    mark = np.flatnonzero(low == 0x27)
    mark = mark[(mark > 0) & (mark < len(low) - 1)]
    inner = mark[c.ALNUM[low[mark - 1]] & c.ALNUM[low[mark + 1]] & ~np.isin(mark, offsets) & ~np.isin(mark + 1, offsets)]
    if len(inner):
        out[inner] = False
        offsets = np.concatenate([[0], np.cumsum(out)])[offsets]
        low = low[out]
    return low, offsets


class Lexicon:
    """Symbols of words: whole words, and stems of up to 8 bytes by their length."""

    def __init__(self, stems: dict[str, float], words: dict[str, float]):
        self.by_length: dict[int, dict[int, float]] = {}
        for s, w in stems.items():
            raw = s.encode()
            self.by_length.setdefault(len(raw), {})[int.from_bytes(raw.ljust(8, b"\0"), "little")] = w
        self.whole = {**dict.fromkeys((w.encode() for w in SEEDS), SEED_WEIGHT), **{w.encode(): x for w, x in words.items()}}
        self.threats = {w.encode() for w in THREATS}
        self.classes = {**{w.encode(): TARGET for w in TARGETS}, **{w.encode(): NEGATED for w in NEGATIONS}, **{w.encode(): SPEECH for w in REPORTED}}
        self.sieves = {n: self._sieve(np.array(list(keys), np.uint64)) for n, keys in self.by_length.items()}
        known = pa.array([w.decode() for w in (*self.whole, *self.threats)], pa.string())
        data, offsets = c.utf8(known)
        self.exact = self._sieve(c.hash_ranges(c.padded(data), offsets[:-1], np.diff(offsets)))

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * c._GOLD) >> np.uint64(48)).astype(np.int64)

    def _sieve(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 16, bool)
        out[self._slots(keys)] = True
        return out

    def hits(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[int, float]]:
        """Word number to (insult or threat, weight); data is padded."""
        found: dict[int, tuple[int, float]] = {}
        head = c.eights(data)[starts] & c._KEEP[np.minimum(sizes, 8)]
        for n, sieve in self.sieves.items():
            cut = head & c._KEEP[n]
            for i in np.flatnonzero(sieve[self._slots(cut)] & (sizes >= n)).tolist():
                w = self.by_length[n].get(int(cut[i]))
                if w is not None and w > found.get(i, (0, 0.0))[1]:
                    found[i] = (INSULT, w)
        for i in np.flatnonzero(self.exact[self._slots(c.hash_ranges(data, starts, sizes))]).tolist():
            word = data[starts[i] : starts[i] + sizes[i]].tobytes()
            w = self.whole.get(word)
            if w is not None and w > found.get(i, (0, 0.0))[1]:
                found[i] = (INSULT, w)
            elif word in self.threats and i not in found:
                found[i] = (THREAT, 1.0)
        return found


class Grammar:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray = OWN, bias: float = OWN_BIAS):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias
        self.step, self.out = (x.tolist() for x in composed())

    def features(self, texts: pa.Array) -> np.ndarray:
        data, offsets = c.utf8(texts)
        out = np.zeros((len(offsets) - 1, FEATURES))
        row = 0
        while row < len(out):  # slices of whole texts
            upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + c.SLICE, "right")) - 1)
            part = data[offsets[row] : offsets[upto]]
            if len(part):
                self._slice(part, offsets[row : upto + 1] - offsets[row], out[row:upto])
            row = upto
        return out

    def _slice(self, data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
        low, offsets = normalized(data, offsets)
        starts, ends = c.word_ranges(low, offsets, c.ALNUM)
        sizes, first, own_bytes = ends - starts, np.searchsorted(starts, offsets), c.padded(low)
        found = self.lexicon.hits(own_bytes, starts, sizes)
        if not found:
            return
        bounds = np.union1d(np.flatnonzero(_ENDS[low]), offsets - 0.5)
        spots = np.array(sorted(found))
        clause_of = np.searchsorted(bounds, starts)
        clauses = np.unique(clause_of[spots])
        lows, highs = np.searchsorted(clause_of, clauses), np.searchsorted(clause_of, clauses, "right")
        rows = np.searchsorted(first, lows, "right") - 1
        classes = self.lexicon.classes
        for a, b, r in zip(lows.tolist(), highs.tolist(), rows.tolist()):
            state, own, matched = 0, out[r], False
            for i, x, y in zip(range(a, b), starts[a:b].tolist(), ends[a:b].tolist()):
                symbol, weight = found.get(i) or (classes.get(own_bytes[x:y].tobytes(), NONE), 1.0)
                o = self.out[state][symbol]
                state = self.step[state][symbol]
                if o >= 0:
                    own[o] += weight
                    matched |= o < 8
            own[CLAUSES] += matched
        n = np.maximum(1, np.diff(first))
        insults = out[:, :4].sum(1)
        out[:, INSULTS] = insults
        out[:, SHARE] = 100 * insults / n

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.log1p(self.features(texts)) @ self.weights + self.bias)))


def _unlike(texts: list[str]) -> list[int]:
    """The texts that are no near copy of an earlier one, by a few sketch registers."""
    hashes, first = c.words(*c.utf8(pa.array(texts, pa.string())), c.ALNUM)
    seen: list[dict[int, int]] = [{} for _ in range(10)]
    keep = []
    for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        own = registers(np.unique(c.windows(hashes[a:b], 3)), 10).tolist() if b > a else [-1] * 10
        same = Counter(s[v] for s, v in zip(seen, own) if v in s)
        if not same or same.most_common(1)[0][1] < 4:
            keep.append(i)
            for s, v in zip(seen, own):
                s.setdefault(v, i)
    return keep


def learn_stems(toxic: list[str], other: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Stems (STEM characters, up to 8 bytes) and whole words that tell toxic texts from others, with log-odds."""
    import re

    word = re.compile(r"[^\W_]+")

    def candidates(text: str) -> set[str]:
        got = set()
        low, _ = normalized(*c.utf8(pa.array([text])))
        for w in set(word.findall(low.tobytes().decode("utf-8", "ignore"))):
            if len(w.encode()) <= 64:
                got.add("=" + w)
            got.update(w[:n] for n in STEM if n <= len(w) and len(w[:n].encode()) <= 8)
        return got

    t, k = Counter(), Counter()
    for text in toxic:
        t.update(candidates(text))
    least = max(4, len(toxic) * 0.003)
    t = Counter({s: n for s, n in t.items() if n >= least})
    for text in other:
        k.update(s for s in candidates(text) if s in t)
    n_t, n_k = len(toxic), len(other)
    weight = {}
    for s, n in t.items():
        share = n_t / (n_t + n_k)
        total = n + k[s]
        gain = 2 * (n * math.log(n / (total * share)) + (k[s] * math.log(k[s] / (total * (1 - share))) if k[s] else 0))
        odds = math.log((n + 0.5) / (n_t + 1)) - math.log((k[s] + 0.5) / (n_k + 1))
        if gain >= 22 and odds >= 2.5:
            weight[s] = odds
    stems = {s: w for s, w in weight.items() if s[0] != "="}
    # a longer stem says nothing new unless it is much surer
    stems = {s: w for s, w in stems.items() if not any(stems.get(s[:n], -9) > w - 1 for n in range(2, len(s)))}
    words = {s[1:]: w for s, w in weight.items() if s[0] == "=" and not any(stems.get(s[1 : 1 + n], -9) > w - 1 for n in range(2, len(s)))}
    return stems, words


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, rows: int = TRAIN_ROWS) -> Grammar:
    c.prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).alias("y"))
    texts: dict[bool, list[str]] = {}
    for y in (True, False):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        own_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(some), "doc_id")
        got = own_rows.groupBy("doc_id").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
        own = [x for x in got.column("text").to_pylist() if x]
        texts[y] = [own[i] for i in _unlike(own)]
    toxic, other = texts[True], texts[False]
    if not toxic or not other:
        return Grammar(Lexicon({}, {}))
    grammar = Grammar(Lexicon(*learn_stems(toxic, other)))
    x = np.log1p(grammar.features(pa.array(toxic + other, pa.string())))
    y = np.array([1.0] * len(toxic) + [0.0] * len(other))
    balance = np.where(y > 0, 0.5 / len(toxic), 0.5 / len(other))
    own = np.append(OWN, OWN_BIAS)
    w = own.copy()
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(FEATURES + 1, 1e-3)
    for _ in range(30):  # Newton steps on the log-likelihood, penalised by the distance from the grammar's own weights
        p = 1 / (1 + np.exp(-x1 @ w))
        gradient = x1.T @ (balance * (p - y)) + ridge * (w - own)
        hessian = (x1 * (balance * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge)
        w -= np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    # what the pattern says can add to a score only, and negated matches add nothing
    w[:FEATURES] = np.maximum(w[:FEATURES], 0)
    w[[OUTPUTS["negated", INSULT], OUTPUTS["negated", THREAT]]] = 0
    grammar.weights, grammar.bias = w[:-1], float(w[-1])
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, predicted of every document."""
    c.prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = grammar.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(c.tidy(judge), f"doc_id {kind}, score double, predicted int")
