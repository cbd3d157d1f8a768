"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, bounded_sample, named, slices, unused

UNDETERMINED = "und"
HIDDEN = 8
#: The network reads windows of this many bytes; together they cover every byte of a text.
SPAN = 256
#: Windows that are read side by side.
WIDTH = 1024
#: Bytes of text that are cut into windows at a time.
LOAD = 1 << 22
#: Training: documents of each language at most, windows of each and their bytes, steps, and windows in a step.
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 8
TRAIN_SPAN = 64
STEPS = 350
BATCH = 192
RATE = 0.02
MAX_LANGUAGES = 500
#: Documents whose language scores less are rejected.
LEAST_SCORE = 0.4
SEED = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One direction of the network. ``table`` has a column for each byte: what it adds to the
    update gate, the reset gate and the candidate; ``loop`` is what the state adds."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.table = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.loop = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)

    def forward(self, x: np.ndarray) -> list[tuple]:
        """``x``: byte values, [time, window]. A tuple (state before, update, reset, looped
        candidate, candidate, state) for each time."""
        n = self.loop.shape[1]
        h, out = np.zeros((n, x.shape[1]), np.float32), []
        for now in x:
            a, u = self.table[:, now], self.loop @ h
            gates = _sigmoid(a[: 2 * n] + u[: 2 * n])
            z, r, un = gates[:n], gates[n:], u[2 * n :]
            c = np.tanh(a[2 * n :] + r * un)
            new = c + z * (h - c)
            out.append((h, z, r, un, c, new))
            h = new
        return out

    def backward(self, x: np.ndarray, steps: list[tuple], dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and loop by backpropagation through time; ``dout``: of the states."""
        n = self.loop.shape[1]
        dloop, da = np.zeros_like(self.loop), np.empty((len(x), 3 * n, x.shape[1]), np.float32)
        dh = np.zeros((n, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, un, c, _ = steps[t]
            dh += dout[t]
            dc = dh * (1 - z) * (1 - c * c)
            du = np.concatenate([dh * (before - c) * z * (1 - z), dc * un * r * (1 - r), dc * r])
            da[t, : 2 * n], da[t, 2 * n :] = du[: 2 * n], dc
            dloop += du @ before.T
            dh = dh * z + self.loop.T @ du
        flat, bytes_ = da.transpose(1, 0, 2).reshape(3 * n, -1), x.ravel()
        dtable = np.stack([np.bincount(bytes_, weights=row, minlength=256) for row in flat]).astype(np.float32)
        return dtable, dloop


class LanguageNet:
    """Two directions and a softmax over the languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.loop, self.back.table, self.back.loop, self.out, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of ``x`` [time, window] and its gradients; every
        position's label is its window's, ``y``."""
        n, (length, width) = self.out.shape[1] // 2, x.shape
        ahead, back = self.ahead.forward(x), self.back.forward(x[::-1])
        states = np.concatenate([np.stack([s[-1] for s in ahead]), np.stack([s[-1] for s in back])[::-1]], axis=1)
        logits = self.out @ states + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        loss = -np.log(np.maximum(p[:, y, np.arange(width)], 1e-12)).mean()
        p[:, y, np.arange(width)] -= 1
        p /= length * width
        dout = np.einsum("tcb,tsb->cs", p, states)
        dstates = self.out.T @ p
        dtable_a, dloop_a = self.ahead.backward(x, ahead, dstates[:, :n])
        dtable_b, dloop_b = self.back.backward(x[::-1], back, dstates[::-1, n:])
        return float(loss), [dtable_a, dloop_a, dtable_b, dloop_b, dout, p.sum(axis=(0, 2))[:, None]]

    def train(self, windows: list[np.ndarray], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over batches that hold as many windows of each language; ``windows``: a
        [window, byte] array for each language. Returns the last batches' mean loss."""
        rng, losses = np.random.default_rng(seed), []
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        each = max(1, batch // len(windows))
        y = np.repeat(np.arange(len(windows)), each)
        for step in range(1, steps + 1):
            x = np.concatenate([w[rng.integers(0, len(w), each)] for w in windows]).T
            loss, grads = self.gradients(np.ascontiguousarray(x), y)
            losses.append(loss)
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(self.parameters(), grads, first, second):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (now / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))

    def _read(self, part: Direction, out: np.ndarray, x: np.ndarray, mask: np.ndarray | None):
        """States times ``out``, for each time of ``x`` in turn; states are held at zero where the
        mask is."""
        n, width = part.loop.shape[1], x.shape[1]
        scale = np.repeat(np.array([0.5, 1], np.float32), [2 * n, n])[:, None]  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        table, loop = np.ascontiguousarray(part.table * scale), np.ascontiguousarray(part.loop * scale)
        h, a, u = np.zeros((n, width), np.float32), np.empty((3 * n, width), np.float32), np.empty((3 * n, width), np.float32)
        gates, z, r, c = a[: 2 * n], a[:n], a[n : 2 * n], a[2 * n :]
        for t in range(len(x)):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(loop, h, out=u)
            gates += u[: 2 * n]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            r *= u[2 * n :]
            c += r
            np.tanh(c, out=c)
            h -= c
            h *= z
            h += c
            if mask is not None:
                h *= mask[t]
            yield out @ h

    def pooled(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over the positions of each window of ``x`` [time, window] of the languages'
        probabilities: [language, window]. A window's first ``lengths`` bytes count."""
        n, length = self.out.shape[1] // 2, len(x)
        mask = None if (lengths == length).all() else (np.arange(length)[:, None] < lengths).astype(np.float32)
        back = np.empty((length, len(self.languages), x.shape[1]), np.float32)
        for t, part in enumerate(self._read(self.back, np.ascontiguousarray(self.out[:, n:]), x[::-1], None if mask is None else mask[::-1])):
            back[length - 1 - t] = part
        total = np.zeros(back.shape[1:], np.float32)
        for t, part in enumerate(self._read(self.ahead, np.ascontiguousarray(self.out[:, :n]), x, None)):
            part += back[t]
            part += self.bias
            part -= part.max(axis=0)
            np.exp(part, out=part)
            part /= part.sum(axis=0)
            if mask is not None:
                part *= mask[t]
            total += part
        return total

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability of each language over all bytes of each text, [text, language]."""
        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):  # some megabytes at a time; a longer text goes alone
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= LOAD:
                size += len(texts[end])
                end += 1
            self._predict(texts[at:end], out[at:end])
            at = end
        return out / np.maximum([[len(t)] for t in texts], 1)

    def _predict(self, texts: list[bytes], out: np.ndarray) -> None:
        sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts) + bytes(SPAN), np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        count = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        starts, lengths = first[owner] + nth * SPAN, np.minimum(SPAN, sizes[owner] - nth * SPAN)
        order = np.argsort(-lengths, kind="stable")
        for i in range(0, len(order), WIDTH):
            some = order[i : i + WIDTH]
            x = data[starts[some][:, None] + np.arange(lengths[some[0]])]
            sums = self.pooled(np.ascontiguousarray(x.T).astype(np.intp), lengths[some])
            np.add.at(out, owner[some], sums.T)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_windows(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = DOCS_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Windows of a bounded sample: ``per_language`` documents of each language, the first in a
    hashed order, ``WINDOWS_PER_DOC`` windows of each at hashed places."""
    labelled = df.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    narrow = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"))
    chosen_id = unused(df, "chosen_id")
    chosen = bounded_sample(narrow, per_language, SEED, MAX_LANGUAGES).select(F.col("id").alias(chosen_id)).distinct()
    data = F.col(text_col).cast("binary")
    place = lambda i: F.pmod(F.xxhash64(F.col(id_col), i), F.greatest(F.octet_length(F.col(text_col)) - TRAIN_SPAN, F.lit(0)) + 1)
    windows = F.transform(F.sequence(F.lit(1), F.lit(WINDOWS_PER_DOC)), lambda i: F.substring(data, (place(i) + 1).cast("int"), F.lit(TRAIN_SPAN)))
    # at most per_language rows of each language, so small enough to broadcast
    rows = labelled.join(F.broadcast(chosen), F.col(id_col) == F.col(chosen_id)).where(F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id"), windows.alias("windows"))
    # ids that repeat are ranked once more: the first rows of each language in a fixed order, tasks keep no more than these
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "windows"))
    rows = rows.withColumn("n", rank).where(F.col("n") <= per_language).collect()
    found: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        found.setdefault(r["lang"], []).extend(bytes(w).ljust(TRAIN_SPAN, b" ") for w in r["windows"])
    return {k: np.frombuffer(b"".join(v), np.uint8).reshape(-1, TRAIN_SPAN).astype(np.intp) for k, v in found.items()}


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageNet | None:
    """The network, or None if there is nothing to learn from."""
    windows = training_windows(df, id_col, text_col, lang_col)
    if not windows:
        return None
    net = LanguageNet(sorted(windows))
    if len(windows) > 1:
        net.train([windows[k] for k in net.languages])
    return net


def _scorer(net: LanguageNet | None):
    """An Arrow function from (text as bytes, whether it has a letter) to a language and a score."""

    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, letters in batches:
            for a, b in slices(texts, LOAD):
                known = [t if t is not None and has and net is not None else b"" for t, has in zip(texts.slice(a, b - a).to_pylist(), letters.slice(a, b - a).to_pylist())]
                best, score = np.zeros(len(known), np.int64), np.zeros(len(known))
                if net is not None:
                    p = net.predict(known)
                    best, score = p.argmax(axis=1), np.where([bool(t) for t in known], np.clip(p.max(axis=1), 0, 1), 0.0)
                langs = [net.languages[k] if t else UNDETERMINED for k, t in zip(best, known)]
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    return scored


def with_language(df: DataFrame, net: LanguageNet | None, text_col: str, column: str) -> DataFrame:
    """``df`` and a struct ``column`` of ``lang`` and ``score``."""
    bound_batches(df.sparkSession)
    has_letter = F.coalesce(named(text_col).rlike(r"\p{L}"), F.lit(False))
    return df.withColumn(column, F.arrow_udf(_scorer(net), "lang string, score double")(named(text_col).cast("binary"), has_letter))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    The network is trained on a bounded sample of the labelled rows that aren't held out and reads
    every byte of every text where it lies; nothing but the sample is moved. A text's probabilities
    are the mean over its bytes. Null texts and texts without a letter are ``und`` with score 0; so
    is everything if no row is labelled. A null id counts as not held out in the result and is not
    learned from. Repeated rows are repeated; extra columns are ignored.
    """
    net = train(df, id_col, text_col, lang_col)
    rows = with_language(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), net, "text", "found")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_identified(df: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose language is determined with a score of at least ``least``."""
    net = train(df, id_col, text_col, lang_col)
    found = unused(df, "found")
    rows = with_language(df, net, text_col, found)
    return rows.where((F.col(found)["lang"] != UNDETERMINED) & (F.col(found)["score"] >= least)).select(*map(named, df.columns))
