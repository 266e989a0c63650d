"""Toxicity scores from a small bidirectional gated recurrent network, trained and run in numpy.

A token is a word with its characters: a hashed word vector and the mean of hashed character-trigram vectors. Two gated
recurrent layers read a window of tokens forwards and backwards, attention pools their states, and a logistic unit
scores the window. A text's score is that of its highest window; the windows that begin at every token of the whole text are
scored. Each starts from an empty state, so step t of all windows is one array operation on a shifted slice of the text's
projected tokens. Labels belong to whole texts, so training repeatedly takes the highest window of each text as its example.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairscope.llm.common import workers_import
from pairscope.llm.language import fold
from pairscope.session import cut_lineage

#: Tokens of a window; windows of a training text begin this far apart.
WINDOW, TRAIN_STRIDE = 8, 4
WORD_SLOTS, CHAR_SLOTS = 1 << 14, 1 << 12
WORD_DIM, CHAR_DIM, HIDDEN = 12, 12, 8
#: Bounds of the fit: labelled texts of each class, characters of a text; of a longer one a span of that many, at a hash-chosen place.
SAMPLE_TEXTS, SAMPLE_CHARS = 1_500, 4_000
ROUNDS, BATCH, RATE = 12, 64, 0.01
#: Distinct tokens a worker remembers (about 100 MB), windows it scores at once.
MEMO, AT_ONCE = 250_000, 2_048
Parameters = dict[str, np.ndarray]


# tokens -----------------------------------------------------------------------------------------------------
def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def letters(token: str) -> str:
    """The letters and digits of a token, or the token itself where it has none."""
    return token if token.isalnum() else "".join(filter(str.isalnum, token)) or token


def word_slot(token: str) -> int:
    return zlib.crc32(letters(token).encode()) % WORD_SLOTS


def char_slots(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character trigrams of all tokens in turn, their ends marked, and how many each token has."""
    marked = [f"^{letters(t)}$" for t in found]
    lengths = np.array([len(m) for m in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(marked)), lengths)
    mixed = codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(2246822519) + codes[2:] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    slots = (mixed * np.uint32(668265263)) >> np.uint32(20)  # the upper 12 bits: CHAR_SLOTS
    return slots[owner[:-2] == owner[2:]].astype(np.int64), lengths - 2


def window_starts(n: int) -> list[int]:
    """Starts of a training text's windows, which cover its n tokens; one window if they fit."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, TRAIN_STRIDE), n - WINDOW]


# network ----------------------------------------------------------------------------------------------------
def new_parameters(seed: int = 7) -> Parameters:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"word": normal(WORD_SLOTS, WORD_DIM, scale=0.1), "char": normal(CHAR_SLOTS, CHAR_DIM, scale=0.3)}
    for side in ("f", "b"):
        p[f"wx_{side}"] = normal(WORD_DIM + CHAR_DIM, 3 * HIDDEN, scale=0.3)
        p[f"wh_{side}"] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
        p[f"c_{side}"] = np.zeros(3 * HIDDEN, np.float32)
    p["at_w"], p["at_v"] = normal(2 * HIDDEN, HIDDEN, scale=0.3), normal(HIDDEN, scale=0.3)
    p["out"], p["bias"] = normal(2 * HIDDEN, scale=0.3), np.zeros(1, np.float32)
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def embed(p: Parameters, vocabulary: list[str]) -> np.ndarray:
    """One row per token: word vector, mean character vector. Row 0 is the empty place."""
    out = np.zeros((len(vocabulary) + 1, WORD_DIM + CHAR_DIM), np.float32)
    if vocabulary:
        flat, lengths = char_slots(vocabulary)
        out[1:, :WORD_DIM] = p["word"][[word_slot(t) for t in vocabulary]]
        out[1:, WORD_DIM:] = np.add.reduceat(p["char"][flat], np.r_[0, np.cumsum(lengths)[:-1]], axis=0) / lengths[:, None]
    return out


def slope(y: np.ndarray) -> np.ndarray:
    """Of the hyperbolic tangent, from its value."""
    return 1 - np.square(y)


def recur(px: np.ndarray, wh: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (steps, hidden, batch) of one direction; ``px`` has the projected input of each token row."""
    steps, batch = rows.shape
    h = np.zeros((HIDDEN, batch), np.float32)
    states, kept, turned = np.empty((steps, HIDDEN, batch), np.float32), [], np.ascontiguousarray(wh.T)
    for t in range(steps):
        x, u = px[rows[t]].T, turned @ h
        zr = sigmoid(x[:2 * HIDDEN] + u[:2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = np.tanh(x[2 * HIDDEN:] + r * u[2 * HIDDEN:])
        if keep:
            kept.append((h, z, r, n, u[2 * HIDDEN:]))
        h = states[t] = h + mask[t] * (1 - z) * (n - h)
    return states, kept


def attend(p: Parameters, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logits of windows, and what their gradient needs."""
    hidden = np.tanh(p["at_w"].T @ states)
    e = np.where(mask > 0, np.einsum("thb,h->tb", hidden, p["at_v"]), np.float32(-1e9))
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tb,thb->bh", a, states)
    return pooled @ p["out"] + p["bias"][0], pooled, a, hidden


def logits(p: Parameters, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits of windows, one row of ``rows`` (batch, WINDOW) each; 0 marks an empty place."""
    turned = np.ascontiguousarray(rows.T)
    mask = (turned > 0).astype(np.float32)
    forward, _ = recur(table[0], p["wh_f"], turned, mask)
    backward, _ = recur(table[1], p["wh_b"], turned[::-1], mask[::-1])
    return attend(p, np.concatenate([forward, backward[::-1]], axis=1), mask)[0]


def scan(p: Parameters, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logits of the windows that begin at each of the tokens but the last WINDOW - 1."""
    out = np.empty(len(ids) - WINDOW + 1, np.float32)
    turned = [np.ascontiguousarray(p[f"wh_{side}"].T) for side in ("f", "b")]
    looking = np.ascontiguousarray(p["at_w"].T)
    for at in range(0, len(out), AT_ONCE):
        batch = min(AT_ONCE, len(out) - at)
        part = ids[at:at + batch + WINDOW - 1]
        states = np.empty((WINDOW, 2 * HIDDEN, batch), np.float32)
        for side in range(2):
            # gates by token, so that a step of all windows is a slice
            px = np.ascontiguousarray(table[side][part].T)
            h = np.zeros((HIDDEN, batch), np.float32)
            for step in range(WINDOW):
                t = step if side == 0 else WINDOW - 1 - step
                x, u = px[:, t:t + batch], turned[side] @ h
                zr = np.tanh(0.5 * (x[:2 * HIDDEN] + u[:2 * HIDDEN]))
                zr += 1
                zr *= 0.5
                n = np.tanh(x[2 * HIDDEN:] + zr[HIDDEN:] * u[2 * HIDDEN:])
                h = n + zr[:HIDDEN] * (h - n)
                states[t, side * HIDDEN:(side + 1) * HIDDEN] = h
        e = np.stack([p["at_v"] @ np.tanh(looking @ s) for s in states])
        a = np.exp(e - e.max(axis=0))
        value = np.stack([p["out"] @ s for s in states])
        out[at:at + batch] = (a * value).sum(axis=0) / a.sum(axis=0) + p["bias"][0]
    return out


def project(p: Parameters, vectors: np.ndarray) -> np.ndarray:
    """The input's share of all gates: (direction, token, gates)."""
    return np.stack([vectors @ p[f"wx_{side}"] + p[f"c_{side}"] for side in ("f", "b")]).astype(np.float32)


# training ---------------------------------------------------------------------------------------------------
@dataclass
class Bags:
    """Windows of labelled texts: rows of token numbers, the text of each window, labels of the texts."""

    vocabulary: list[str]
    rows: np.ndarray
    bag: np.ndarray
    label: np.ndarray


def make_bags(texts: list[str], labels: list[int]) -> Bags:
    number: dict[str, int] = {}
    rows, bag = [], []
    for k, text in enumerate(texts):
        ids = [number.setdefault(t, len(number) + 1) for t in tokens(text)]
        for start in window_starts(len(ids)):
            part = ids[start:start + WINDOW]
            rows.append(part + [0] * (WINDOW - len(part)))
            bag.append(k)
    return Bags(list(number), np.array(rows, np.int32).reshape(-1, WINDOW), np.array(bag, np.int64), np.array(labels, np.float32))


def _direction(p: Parameters, side: str, vectors: np.ndarray, rows: np.ndarray, mask: np.ndarray):
    px = vectors @ p[f"wx_{side}"] + p[f"c_{side}"]
    return recur(px, p[f"wh_{side}"], rows, mask, keep=True)


def _back(p: Parameters, side: str, kept: list, mask: np.ndarray, d_states: np.ndarray, grad: Parameters) -> np.ndarray:
    """Gradient of the projected input (steps, batch, 3 * hidden); adds the recurrent weights' gradient."""
    wh, d_h = p[f"wh_{side}"], np.zeros_like(d_states[0])
    out, d_wh = np.empty((len(kept), d_h.shape[1], 3 * HIDDEN), np.float32), np.zeros_like(wh)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, un = kept[t]
        d_new, m = d_h + d_states[t], mask[t]
        d_n = d_new * m * (1 - z) * slope(n)
        d_z = -d_new * m * (n - h) * z * (1 - z)
        d_r = d_n * un * r * (1 - r)
        d_u = np.concatenate([d_z, d_r, d_n * r])
        out[t] = np.concatenate([d_z, d_r, d_n]).T
        d_wh += h @ d_u.T
        d_h = d_new * (1 - m * (1 - z)) + wh @ d_u
    grad[f"wh_{side}"] = d_wh
    return out


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``at`` and the sum of the rows that each has."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    return at[order][first], np.add.reduceat(rows[order], first, axis=0)


def gradients(p: Parameters, vocabulary: list[str], rows: np.ndarray, label: np.ndarray) -> tuple[float, Parameters, tuple]:
    """Mean loss of a batch of windows and its gradients; those of the vectors are (slots, rows of gradients)."""
    used, local = np.unique(rows, return_inverse=True)
    turned = np.ascontiguousarray(local.reshape(rows.shape).T) if used[0] == 0 else np.ascontiguousarray(local.reshape(rows.shape).T + 1)
    names = [vocabulary[u - 1] for u in used if u > 0]
    vectors = embed(p, names)
    mask = (turned > 0).astype(np.float32)
    forward, kept_f = _direction(p, "f", vectors, turned, mask)
    backward, kept_b = _direction(p, "b", vectors, turned[::-1], mask[::-1])
    states = np.concatenate([forward, backward[::-1]], axis=1)
    logit, pooled, a, hidden = attend(p, states, mask)
    probability = sigmoid(logit)
    loss = float(-np.mean(label * np.log(probability + 1e-7) + (1 - label) * np.log(1 - probability + 1e-7)))
    d_logit = (probability - label) / len(label)
    grad = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["out"]
    d_a = np.einsum("thb,bh->tb", states, d_pooled)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    grad["at_v"] = np.einsum("tb,thb->h", d_e, hidden)
    d_hidden = d_e[:, None, :] * p["at_v"][:, None] * slope(hidden)
    grad["at_w"] = np.einsum("tib,tjb->ij", states, d_hidden, optimize=True)
    d_states = a[:, None, :] * d_pooled.T + p["at_w"] @ d_hidden
    d_vectors = np.zeros_like(vectors)
    for side, kept, order, d in (("f", kept_f, turned, d_states[:, :HIDDEN]), ("b", kept_b, turned[::-1], d_states[::-1, HIDDEN:])):
        d_x = _back(p, side, kept, mask if side == "f" else mask[::-1], d, grad)
        at, rows_d = summed(order.reshape(-1), d_x.reshape(-1, 3 * HIDDEN))
        per_token = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        per_token[at] = rows_d
        grad[f"wx_{side}"], grad[f"c_{side}"] = vectors.T @ per_token, per_token[1:].sum(axis=0)
        d_vectors += per_token @ p[f"wx_{side}"].T
    flat, lengths = char_slots(names)
    char_grad = np.repeat(d_vectors[1:, WORD_DIM:] / lengths[:, None], lengths, axis=0)
    sparse = (np.array([word_slot(t) for t in names]), d_vectors[1:, :WORD_DIM], flat, char_grad)
    return loss, grad, sparse


class Adam:
    def __init__(self, p: Parameters, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grad: Parameters, sparse: tuple) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for name, g in grad.items():
            self._move(name, slice(None), g, rate)
        for name, slots, rows in (("word", *sparse[:2]), ("char", *sparse[2:])):
            self._move(name, *summed(slots, rows), rate)

    def _move(self, name: str, at, g: np.ndarray, rate: float) -> None:
        self.m[name][at] = 0.9 * self.m[name][at] + 0.1 * g
        self.v[name][at] = 0.999 * self.v[name][at] + 0.001 * g * g
        self.p[name][at] -= rate * self.m[name][at] / (np.sqrt(self.v[name][at]) + 1e-6)


def bag_logits(p: Parameters, bags: Bags) -> np.ndarray:
    table = project(p, embed(p, bags.vocabulary))
    return np.concatenate([logits(p, table, bags.rows[k:k + AT_ONCE]) for k in range(0, len(bags.rows), AT_ONCE)])


def train(texts: list[str], labels: list[int], seed: int = 7, rounds: int = ROUNDS) -> Parameters | None:
    """Fitted parameters; None unless both classes occur.

    Each round takes the highest window of every text, and a random one of every clean text, as examples. The first
    rounds, which know nothing yet, take the window of a toxic text with the word that speaks most for toxic texts. At last
    the bias is moved so that a text is toxic from 0.5 on where that separates the sample best.
    """
    if len(set(labels)) < 2:
        return None
    p, rng, bags = new_parameters(seed), np.random.default_rng(seed), make_bags(texts, labels)
    adam = Adam(p, RATE)
    order = np.argsort(bags.bag, kind="stable")
    first = np.searchsorted(bags.bag[order], np.arange(len(texts)))
    count = np.bincount(bags.bag, minlength=len(texts))
    telling = _highest(word_odds(bags)[bags.rows].max(axis=1), bags.bag)
    for turn in range(rounds):
        picked = first + (rng.random(len(texts)) * count).astype(np.int64)
        chosen = [picked[bags.label == 0]]
        chosen.append(_highest(bag_logits(p, bags), bags.bag) if turn >= 2 else telling if turn else telling[bags.label == 1])
        examples = rng.permutation(np.concatenate(chosen))
        positive = bags.label[bags.bag[examples]]
        # both classes weigh the same, whatever number of examples each has
        extra = rng.choice(examples[positive == 1], max(0, int((positive == 0).sum() - (positive == 1).sum()))) if positive.any() else examples[:0]
        examples = rng.permutation(np.concatenate([examples, extra]))
        for k in range(0, len(examples), BATCH):
            part = examples[k:k + BATCH]
            part = part[(bags.rows[part] > 0).any(axis=1)]
            if len(part):
                _, grad, sparse = gradients(p, bags.vocabulary, bags.rows[part], bags.label[bags.bag[part]])
                adam.rate = RATE * (1 - 0.8 * turn / rounds)
                adam.step(grad, sparse)
    p["bias"] = p["bias"] - np.float32(_cut(Scorer(p).highest(texts), bags.label))
    return p


def word_odds(bags: Bags) -> np.ndarray:
    """Per token number: log odds of its word among toxic texts over clean ones, half a text added to each count; the empty place has the least."""
    slot = np.array([word_slot(t) for t in bags.vocabulary], dtype=np.int64)
    rows, places = np.nonzero(bags.rows)
    # each word once per text
    seen = np.unique(bags.bag[rows] * WORD_SLOTS + slot[bags.rows[rows, places] - 1])
    toxic = bags.label[seen // WORD_SLOTS] == 1
    among = [np.bincount(seen[side] % WORD_SLOTS, minlength=WORD_SLOTS) + 0.5 for side in (toxic, ~toxic)]
    odds = np.log(among[0] / (1 + (bags.label == 1).sum())) - np.log(among[1] / (1 + (bags.label == 0).sum()))
    return np.r_[odds.min() - 1, odds[slot]].astype(np.float32)


def _highest(found: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """Index of the highest window of each text, the first among equals."""
    order = np.lexsort((np.arange(len(found)), -found, bag))
    return order[np.r_[True, bag[order][1:] != bag[order][:-1]]]


def _cut(score: np.ndarray, label: np.ndarray) -> float:
    """The value between two scores that splits the classes with the fewest errors, each class weighing the same."""
    order = np.argsort(score)
    s, y = score[order], label[order]
    missed = np.r_[0, np.cumsum(y)] / y.sum()
    false = 1 - np.r_[0, np.cumsum(1 - y)] / (1 - y).sum()
    edges = np.r_[s[0] - 1, (s[1:] + s[:-1]) / 2, s[-1] + 1]
    # clean texts are the many: among near-equals take the cut with the fewer false alarms
    return float(edges[np.argmin(np.round(missed + 3 * false, 6))])


# scoring ----------------------------------------------------------------------------------------------------
class Scorer:
    """Parameters with a memo of projected tokens; one for each Python worker."""

    def __init__(self, p: Parameters):
        self.p, self.number = p, {}
        self.table = project(p, np.zeros((1, WORD_DIM + CHAR_DIM), np.float32))

    def _numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > MEMO:
            self.number, self.table = {}, self.table[:, :1]
        new = sorted(set().union(*texts).difference(self.number))
        if new:
            self.number.update(zip(new, range(self.table.shape[1], self.table.shape[1] + len(new)), strict=True))
            self.table = np.concatenate([self.table, project(self.p, embed(self.p, new)[1:])], axis=1)
        return [np.fromiter(map(self.number.__getitem__, text), np.int32, len(text)) for text in texts]

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of each text's windows; a text of fewer tokens than a window is one window, without tokens an empty one."""
        numbers = self._numbers([tokens(t) for t in texts])
        out = np.empty(len(texts), np.float32)
        short = [k for k, ids in enumerate(numbers) if len(ids) < WINDOW]
        for k in range(0, len(short), AT_ONCE):
            part = short[k:k + AT_ONCE]
            out[part] = logits(self.p, self.table, np.stack([np.pad(numbers[i], (0, WINDOW - len(numbers[i]))) for i in part]))
        held, size = [], 0
        for k, ids in enumerate(numbers):
            if len(ids) >= WINDOW:
                held.append(k)
                size += len(ids)
                if size >= 32 * AT_ONCE:
                    self._scan(held, numbers, out)
                    held, size = [], 0
        if held:
            self._scan(held, numbers, out)
        return out

    def _scan(self, held: list[int], numbers: list[np.ndarray], out: np.ndarray) -> None:
        """Texts one after the other; the few windows that reach into the next text are passed over."""
        found, at = scan(self.p, self.table, np.concatenate([numbers[k] for k in held])), 0
        for k in held:
            out[k] = found[at:at + len(numbers[k]) - WINDOW + 1].max()
            at += len(numbers[k])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.highest(texts).astype(np.float64))


# Spark ------------------------------------------------------------------------------------------------------
def sample(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS,
           id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Labelled texts outside fold 0: of each class up to ``sample_texts``, chosen by the hash of their identifiers.

    Texts of up to ``sample_chars`` characters come first, since a span of a longer one may lack what earned it the label; where a
    class has too few of them, spans of that many characters of its longer texts follow.
    Rows with a null identifier, text or label teach nothing; a text labelled both ways counts for each.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)").where(fold("id", folds) != 0).distinct()
    # hash-low labels first, some more than needed, so that only their texts are joined and ordered
    rank = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, 8 * sample_texts / max(1, sizes.get(1, 0)))).otherwise(min(1.0, 8 * sample_texts / max(1, sizes.get(0, 0))))
    low = cut_lineage(marked.withColumn("h", rank).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)))
    over = F.greatest(F.length("text") - sample_chars, F.lit(0))
    place = F.pmod(F.xxhash64("id", F.lit("span")), over + 1).cast("int") + 1
    span = F.substring(F.col("text"), place, F.lit(sample_chars))
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text") != "")
    # 16 * sample_texts rows, by the shares above
    joined = known.join(F.broadcast(low), "id").select("id", "y", "h", (over > 0).alias("cut"), span.alias("text"))
    rows = [r for y in (0, 1) for r in joined.where(F.col("y") == y).orderBy("cut", "h", "id", "text").limit(sample_texts).collect()]
    return [r["text"] for r in rows], [r["y"] for r in rows]


def score(docs: DataFrame, p: Parameters | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, score, predicted. Only the text enters; without a fitted model every score is 0."""
    workers_import(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value is not None else None
        for batch in batches:
            found = scorer.score(batch.column(1).to_pylist()) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32), pa.int32())], names=["id", "score", "predicted"])

    kind = thin.schema["id"].dataType.simpleString()
    return thin.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def score_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """Learns outside fold 0, scores every row: <id_col>, held_out, score, predicted. Null and empty texts are scored too."""
    p = train(*sample(docs, labels, folds, id_col=id_col, text_col=text_col))
    return score(docs, p, id_col, text_col).select(id_col, F.coalesce(fold(id_col, folds) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
