"""Toxicity scores over text restored by noisy-channel decoding.

Disguised words (leetspeak, spaced-out or repeated letters) become lattices of
letters; a Viterbi search under a character trigram model, counted by Spark
over all documents, restores the likeliest word. The score is a logistic
function of how strongly the words, as written and as restored, go with
labelled toxic documents: each word and each of its beginnings is a
feature, with a lower bound of its log-odds as weight.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE); the
character model and the scores cover all documents and whole texts.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, held_out
from millrace.llm.langid import code_points, letter_table

#: Labelled rows of each class that the classifier is fitted on.
SAMPLE = 4_000
#: Features that a task counts up before it sends them on.
SEND = 2_000_000
#: Words, and beginnings of a kind, whose features a task remembers.
MEMORY = 200_000
#: Characters counted at once.
CHUNK = 1_000_000
#: The character model counts in two rows of 2 ** CELL_BITS cells, by products with these odd numbers.
CELL_BITS = 21
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Letters that may yet come, by which the probability of a letter on its own is smoothed.
UNSEEN = 128
#: Beginnings of a word that count as features, in letters; the whole word is one more. Each is
#: seen up to three times: in one, two, or three and more distinct words of a text.
BEGINNINGS = (4, 5, 6, 8)
#: Least surprise (nats) of a feature's split over the classes, by kind; below it, no weight. Fewer
#: short beginnings occur, so fewer reach a given surprise by chance.
UNLIKELY = (6.5, 7.5, 8.5, 9.5, 9.5)
#: Letters that a written sign may stand for.
SIGNS = {"0": "oо", "1": "il", "2": "z", "3": "eз", "4": "aч", "5": "s", "6": "gbб", "7": "t", "8": "bв", "9": "g", "@": "aа", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Signs that may stand between the letters of a word and mean nothing.
FILLERS = ".-_*~'·​"
#: Log-probabilities of the channel: a sign for a letter, a filler or a repeated letter dropped.
SIGN_COST, DROP_COST = -1.0, -0.7
#: A word of letters that only doubles some is taken as disguised if without them it is likelier by so many nats a letter.
DOUBLED_GAIN = 0.2

_sign = re.escape("".join(SIGNS))
_spaced = re.compile(rf"(?<!\w)[\w{_sign}](?:[ .\-_*~​][\w{_sign}]){{2,}}(?!\w)")
_edges = re.compile(r"^[^\w@$!|(€£¡+]+|[^\w@$|€£+]+$")
_odd = re.compile(rf"[{_sign}{re.escape(FILLERS)}]|(.)\1")
_meant = re.compile(rf"[^\W\d_]|[{_sign}]")
_doubled, _tripled = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
_MARKS = ".,;:!?\"'()-*_#$%&|"
_plain = re.compile(r"^[\W_]+|[\W_]+$")


def _cells(grams: np.ndarray) -> np.ndarray:
    """The two cells (rows, grams) that count a gram; a gram has 21 bits for each letter plus one, so none is 0."""
    return np.stack([1 + (grams.astype(np.uint64) * np.uint64(m) >> np.uint64(64 - CELL_BITS)).astype(np.int64) for m in MULTIPLIERS])


def _cell(gram: int) -> tuple[int, int]:
    """_cells() of one gram."""
    return tuple(1 + ((gram * m & 2**64 - 1) >> 64 - CELL_BITS) for m in MULTIPLIERS)


def _count_characters(batches):
    """Counts (cell, n) of the one to three letters at each place of the task's texts; lower-case letters, 0 between words.

    Cells of the second row come after those of the first; cell 0 counts places.
    """
    table = letter_table().astype(np.int64)
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        parts, size = [], 0
        for i, t in enumerate(texts):
            parts.append(t)
            size += len(t)
            if size < CHUNK and i < len(texts) - 1:
                continue
            x = np.concatenate([np.zeros(2, np.int64), table[code_points(" \n".join(parts))], np.zeros(2, np.int64)]) + 1
            grams, n = np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:], return_counts=True)
            found = [(grams, n)]
            for _ in range(2):  # by their first letters, which are sorted
                grams = grams >> 21
                first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                grams, n = grams[first], np.add.reduceat(n, first)
                found.append((grams, n))
            cells = [_cells(g) + np.array([[0], [2**CELL_BITS]]) for g, _ in found]
            cell, back = np.unique(np.concatenate([np.zeros(1, np.int64), *[c.ravel() for c in cells]]), return_inverse=True)
            weight = np.concatenate([[n.sum()], *[np.tile(m, 2) for _, m in found]])
            total = np.bincount(back, weight).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total)], names=["cell", "n"])
            parts, size = [], 0


def character_model(docs: DataFrame) -> tuple[float, np.ndarray]:
    """How many places all docs(text) have, and counts of their runs of one to three letters in two rows of cells.

    Every letter of every script counts as itself. The cells bound what tasks
    are sent: 2 * 2 ** CELL_BITS numbers, whatever the corpus. A run's count is the less of its two cells.
    """
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_count_characters, "cell long, n long")
    got = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most a row a cell
    flat = np.zeros(1 + 2 * 2**CELL_BITS)
    flat[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return float(flat[0]), flat[1:].reshape(2, -1).astype(np.float32)


class _Row(dict):
    """Log-probabilities of letters after two given ones, reckoned when first asked for."""

    __slots__ = ("after", "model")

    def __missing__(self, c: int) -> float:
        got = self[c] = self.model.logp(*self.after, c)
        self.model.held += 1
        return got


class Characters:
    """A character model as tasks use it: interpolated probabilities of a letter (0 between words) after two."""

    def __init__(self, places: float, cells: np.ndarray) -> None:
        self.places, self.cells = places, cells
        self.rows: dict[tuple[int, int], _Row] = {}
        self.held = 0

    def count(self, gram: int) -> float:
        i, j = _cell(gram)
        return min(float(self.cells[0, i - 1]), float(self.cells[1, j - 1]))

    def logp(self, a: int, b: int, c: int) -> float:
        count, a, b, c = self.count, a + 1, b + 1, c + 1
        one = (count(c) + 1) / (self.places + UNSEEN)
        two = (count(b << 21 | c) + 5 * one) / (count(b) + 5)
        return math.log((count(a << 42 | b << 21 | c) + 5 * two) / (count(a << 21 | b) + 5))

    def symbol(self, ch: str) -> int:
        return ord(ch)

    def row(self, a: int, b: int) -> _Row:
        got = self.rows.get((a, b))
        if got is None:
            if self.held > MEMORY:
                self.rows.clear()
                self.held = 0
            got = self.rows[a, b] = _Row()
            got.after, got.model = (a, b), self
        return got

    def score(self, word: str) -> float:
        """Log-probability of a word as it stands, its end included."""
        rows = self.rows
        a = b = 0
        total = 0.0
        for s in map(ord, word):
            total += (rows.get((a, b)) or self.row(a, b))[s]
            a, b = b, s
        return total + self.row(a, b)[0]


def restore(word: str, model: Characters, single: bool = True) -> str:
    """The likeliest letters behind a lower-case word: Viterbi over its lattice, by the last two letters.

    Each place offers letters for its sign, or nothing for a filler; of a run
    of one letter or sign, all but the first may be dropped if single.
    """
    rows = model.rows
    states = {(0, 0): (0.0, None)}  # last two symbols -> score, letters as a chain
    before = ""
    for ch in word:
        if ch.isalpha():
            choices = [(ch, 0.0, ord(ch))]
        else:
            choices = [(c, SIGN_COST, ord(c)) for c in SIGNS.get(ch, "")]
        nxt: dict = {}
        for (a, b), (score, chain) in states.items():
            row = rows.get((a, b)) or model.row(a, b)
            for c, cost, s in choices:
                now = score + cost + row[s]
                if (b, s) not in nxt or now > nxt[b, s][0]:
                    nxt[b, s] = (now, (chain, c))
            if not choices or single and ch == before:
                now = score + DROP_COST
                if (a, b) not in nxt or now > nxt[a, b][0]:
                    nxt[a, b] = (now, chain)
        states, before = nxt, ch
    best, chain = max(((score + model.row(a, b)[0], chain) for (a, b), (score, chain) in states.items()), key=lambda x: x[0])
    out = []
    while chain:
        chain, c = chain
        out.append(c)
    return "".join(reversed(out))


def _undoubled(word: str, model: Characters) -> str | None:
    """A word of letters, some of them doubled, as restore() takes it, if it is likelier by DOUBLED_GAIN a letter.

    With few doubled letters it is quicker to score the words that dropping them gives.
    """
    at = [m.start() for m in _doubled.finditer(word)]
    if len(at) <= 2 and not _tripled.search(word):
        own = best = model.score(word)
        back = word
        for drop in [at[:1], at[1:], at][: 2 * len(at) - 1]:
            w = "".join(c for i, c in enumerate(word) if i not in drop)
            now = model.score(w)
            if now + DROP_COST * len(drop) > best:
                best, back, score = now + DROP_COST * len(drop), w, now
        if back == word:
            return None
    else:
        back = restore(word, model)
        own, score = model.score(word), model.score(back)
    return back if score / (len(back) + 1) >= own / (len(word) + 1) + DOUBLED_GAIN else None


def _forms(word: str, model: Characters) -> list[str]:
    """A lower-case word without what stands round it, and restored where it looks disguised."""
    plain = word.strip(_MARKS)
    if not (plain[:1].isalnum() and plain[-1:].isalnum()):
        plain = _plain.sub("", plain)
    out = [plain] if plain else []
    if _odd.search(word) and _meant.search(word):
        core = _edges.sub("", word)
        if core and (not core.isalpha() or _doubled.search(core)):
            if core.isalpha() and not _tripled.search(core):
                backs = [_undoubled(core, model)]
            else:
                backs = [restore(core, model)]
                if _doubled.search(core) and not core.isalpha():  # 4$$: two signs may be two letters
                    backs.append(restore(core, model, single=False))
            out += [b for b in dict.fromkeys(backs) if b and b != plain]
    return out


def words_of(text: str) -> list[str]:
    """Lower-case words; runs of single letters set apart also count as one word."""
    text = text.lower()
    runs = [m.group().replace(" ", "") for m in _spaced.finditer(text)]
    return text.split() + runs + [r[1:] for r in runs]  # the first letter may be a word of its own


KINDS = len(BEGINNINGS) + 1
TIMES = 3


def _feature(kind: int, part: str) -> int:
    """64-bit id of a feature; the low 4 bits hold 3 * kind, and times - 1 is added to them later."""
    return (xxhash.xxh64_intdigest(f"{kind}{part}") >> 5 << 4) + TIMES * kind


def _features(form: str) -> list[int]:
    return [_feature(k, form[:n]) for k, n in enumerate(BEGINNINGS) if n <= len(form)] + [_feature(KINDS - 1, form)]


class _Reader:
    """From words to features (of those wanted), with a bounded memory of words and beginnings seen."""

    def __init__(self, model: tuple[float, np.ndarray], wanted: set[int] | None = None) -> None:
        self.model = Characters(*model)
        self.wanted = wanted
        self.room = MEMORY if wanted is None else 3 * MEMORY  # where features are wanted, few words have any
        self.known: dict[str, tuple] = {}
        self.parts: list[dict[str, int | None]] = [{} for _ in BEGINNINGS]

    def _of(self, form: str) -> list[int]:
        out = []
        for k, n in enumerate(BEGINNINGS):
            if n > len(form):
                break
            part, memory = form[:n], self.parts[k]
            f = memory.get(part, 0)
            if f == 0:
                f = _feature(k, part)
                if self.wanted is not None and f not in self.wanted:
                    f = None
                if len(memory) > MEMORY:
                    memory.clear()
                memory[part] = f
            if f is not None:
                out.append(f)
        f = _feature(KINDS - 1, form)
        if self.wanted is None or f in self.wanted:
            out.append(f)
        return out

    def features(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > self.room:
                self.known.clear()
            got = self.known[word] = tuple({f for form in _forms(word, self.model) for f in self._of(form)})
        return got

    def seen(self, words) -> dict[int, int]:
        """How many of the words, which differ, have each feature."""
        known, out = self.known, {}
        for w in words:
            got = known.get(w)
            if got is None:
                got = self.features(w)
            for f in got:
                out[f] = out.get(f, 0) + 1
        return out


def _document_features(sent):
    """Labelled texts (toxic, text) -> counts (feature, toxic, n) of documents, summed by batch."""

    def run(batches):
        reader = _Reader(sent.value)
        found, held = {0: [], 1: []}, 0

        def send():
            for y, parts in found.items():
                if parts:
                    f, n = np.unique(np.concatenate(parts), return_counts=True)
                    parts.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.full(len(f), y)), pa.array(n.astype(np.int64))], names=["feature", "toxic", "n"])

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                seen = reader.seen(set(words_of(t.as_py() or "")))
                got = [f + i for f, n in seen.items() for i in range(min(n, TIMES))]
                found[y].append(np.array(got, np.int64))
                held += len(got)
                if held >= SEND:
                    yield from send()
                    held = 0
        yield from send()

    return run


def _evidence(sent_model, sent_weights):
    """Texts (key..., text) -> key, the strongest weight, and the sum over features (the best of their times)."""

    def run(batches):
        weights: dict[int, float] = sent_weights.value
        best = {}
        for f, w in weights.items():  # a feature seen n times has the best weight of 1 to n times
            base = f - (f & 15) % TIMES
            for i in range((f & 15) % TIMES, TIMES):
                best.setdefault(base, [0.0] * TIMES)[i] = max(best.get(base, [0.0] * TIMES)[i], w)
        reader = _Reader(sent_model.value, set(best))
        for b in batches:
            most, total = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for i, t in enumerate(b.column(b.num_columns - 1)):
                seen = reader.seen(set(words_of(t.as_py() or "")))
                got = [best[f][min(n, TIMES) - 1] for f, n in seen.items()]
                if got:
                    most[i], total[i] = max(got), sum(got)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(most), pa.array(total)], names=[*b.schema.names[:-1], "most", "total"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the first column is the constant."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        penalty = ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (w * (y - p)) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Character model over docs(text); classifier on docs that labels(doc_id, toxic) mark, fold not 0.

    The sample rows of each class with the least hash of the id are used. Ids
    that labels repeat are toxic if any row says so; null labels and ids say
    nothing. With no label of either class the score is a constant.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = character_model(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where((fold(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = dict(marks.groupBy("toxic").count().collect())  # at most two rows
    part = [marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    picked = part[0].union(part[1])
    out = {"model": model, "weights": {}, "beta": [math.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1)), 0.0, 0.0]}
    if len(totals) < 2:
        return out
    sent = spark.sparkContext.broadcast(model)
    rows = docs.join(F.broadcast(picked), "doc_id").select("toxic", "text")  # 2 * sample rows at most
    counts = rows.mapInArrow(_document_features(sent), "feature long, toxic long, n long")
    pivot = counts.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))
    size = [min(totals[y], sample) for y in (0, 1)]
    expected = (F.col("n1") + F.col("n0")) * (size[1] / sum(size))
    # how unlikely the split is if the feature had nothing to do with the label (half of G squared)
    g = F.col("n1") * F.log(F.col("n1") / expected) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (F.col("n1") + F.col("n0") - expected))).otherwise(0.0)
    gap = F.log((F.col("n1") + 0.5) / (size[1] + 1)) - F.log((F.col("n0") + 0.5) / (size[0] + 1))
    sure = gap - F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    kind = F.floor(F.col("feature").bitwiseAND(15) / TIMES)
    enough = F.element_at(F.array(*map(F.lit, UNLIKELY)), (kind + 1).cast("int"))
    strong = pivot.where("n1 > 0").where(g >= enough).select("feature", sure.alias("w")).where("w > 0")
    out["weights"] = dict(strong.collect())  # no more than the sample has
    weights = spark.sparkContext.broadcast(out["weights"])
    seen = rows.mapInArrow(_evidence(sent, weights), "toxic int, most double, total double").toPandas()
    if seen.toxic.nunique() == 2:
        y = seen.toxic.to_numpy(float)
        rate = totals[1] / (totals[0] + totals[1])
        w = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
        out["beta"] = _logistic(_design(seen.most.to_numpy(), seen.total.to_numpy()), y, w).tolist()
    return out


def _design(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(most)), most, np.log1p(np.maximum(total - most, 0))], axis=1)


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted, strongest.

    Null, empty and blank texts get the score of a text without evidence.
    Repeated rows get equal scores; null ids are not held out. Other columns
    are ignored; an empty table gives an empty one.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(_evidence(sc.broadcast(fitted["model"]), sc.broadcast(fitted["weights"])), "doc_id long, most double, total double")
    b0, b1, b2 = fitted["beta"]
    logit = F.lit(b0) + F.lit(b1) * F.col("most") + F.lit(b2) * F.log1p(F.greatest(F.lit(0.0), F.col("total") - F.col("most")))
    value = 1 / (1 + F.exp(-logit))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), F.col("most").alias("strongest"))
