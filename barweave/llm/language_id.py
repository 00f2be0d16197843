"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two recurrent cells read the UTF-8 bytes of a window forwards and backwards; at every position a linear layer over both
states gives a label's probabilities, and a document's are the mean over all of its positions. A text is read whole, in
windows of ``window`` bytes that each begin with an empty state; the last window of a longer text overlaps the one
before it and counts its new positions only.

Training is backpropagation through time with Adam on a bounded sample: of each language the ``per_language`` documents
whose hashed ids come first, three stretches of 200 characters of each. Only text and a non-null language of rows that
the caller lets through are learned.

Defined cases: a text without a letter, and a null text, is ``und`` with score 0; with no labelled rows every text is;
with one language it has all probability; repeated rows stay; an empty table gives no rows; other columns are kept,
those with the names of results replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """The weights. ``embed`` has for each direction a row for each byte: the input's part of the three gates."""

    labels: list[str]
    embed: np.ndarray  # 2, 256, 3 * hidden
    turn: np.ndarray  # 2, hidden, 3 * hidden
    out: np.ndarray  # 2 * hidden, labels
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(labels, draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=hidden**-0.5), draw(2 * hidden, len(labels), scale=0.3), np.zeros(len(labels), np.float32))

    @property
    def hidden(self) -> int:
        return self.turn.shape[1]

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.turn, self.out, self.bias]

    def states(self, windows: np.ndarray, side: int) -> np.ndarray:
        """The states after each position (positions, windows, hidden) of the cell that reads forwards (0) or backwards (1)."""
        h_size, (count, length) = self.hidden, windows.shape
        embed, turn = self.embed[side], self.turn[side]
        kept = np.empty((length, count, h_size), np.float32)
        state = np.zeros((count, h_size), np.float32)
        gates, inner = np.empty((count, 3 * h_size), np.float32), np.empty((count, 3 * h_size), np.float32)
        columns = np.ascontiguousarray(windows.T).astype(np.intp)
        for t in range(length) if side == 0 else range(length - 1, -1, -1):
            np.take(embed, columns[t], axis=0, out=gates, mode="clip")
            np.matmul(state, turn, out=inner)
            both = gates[:, : 2 * h_size]
            both += inner[:, : 2 * h_size]
            both *= 0.5
            np.tanh(both, out=both)
            both += 1.0
            both *= 0.5
            new = gates[:, 2 * h_size :]
            new += both[:, h_size:] * inner[:, 2 * h_size :]
            np.tanh(new, out=new)
            now = kept[t]
            np.subtract(state, new, out=now)
            now *= both[:, :h_size]
            now += new
            state = now
        return kept

    def label_windows(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (positions, windows, labels)."""
        forward, backward = self.states(windows, 0), self.states(windows, 1)
        scores = forward @ self.out[: self.hidden]
        scores += backward @ self.out[self.hidden :]
        scores += self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return scores

    def gradients(self, windows: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions and the gradient of every weight, back through time."""
        h_size, (count, length) = self.hidden, windows.shape
        states = [self.states(windows, side) for side in (0, 1)]
        joined = np.concatenate(states, axis=2)
        scores = joined @ self.out + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        rows = np.arange(count)
        loss = float(-np.log(scores[:, rows, wanted] + 1e-12).mean())
        scores[:, rows, wanted] -= 1
        scores /= count * length
        flat = scores.reshape(-1, len(self.labels))
        d_out, d_bias = joined.reshape(-1, 2 * h_size).T @ flat, flat.sum(axis=0)
        d_joined = scores @ self.out.T
        d_embed, d_turn = np.zeros_like(self.embed), np.zeros_like(self.turn)
        ones = np.zeros((count, 256), np.float32)
        for side in (0, 1):
            embed, turn, seen = self.embed[side], self.turn[side], states[side]
            carry = np.zeros((count, h_size), np.float32)
            order = list(range(length)) if side == 0 else list(range(length - 1, -1, -1))
            for at in range(length - 1, -1, -1):
                t = order[at]
                before = seen[order[at - 1]] if at else np.zeros((count, h_size), np.float32)
                letters = windows[:, t]
                inner = before @ turn
                gates = embed[letters]
                keep, reset = _sigmoid(gates[:, :h_size] + inner[:, :h_size]), _sigmoid(gates[:, h_size : 2 * h_size] + inner[:, h_size : 2 * h_size])
                new = np.tanh(gates[:, 2 * h_size :] + reset * inner[:, 2 * h_size :])
                d_state = carry + d_joined[t, :, side * h_size : (side + 1) * h_size]
                d_new = d_state * (1 - keep) * (1 - new * new)
                d_keep = d_state * (before - new) * keep * (1 - keep)
                d_reset = d_new * inner[:, 2 * h_size :] * reset * (1 - reset)
                d_inner = np.concatenate([d_keep, d_reset, d_new * reset], axis=1)
                d_turn[side] += before.T @ d_inner
                carry = d_state * keep + d_inner @ turn.T
                ones[:] = 0
                ones[rows, letters] = 1
                d_embed[side] += ones.T @ np.concatenate([d_keep, d_reset, d_new], axis=1)
        return loss, [d_embed, d_turn, d_out, d_bias]


def train(stretches: list[tuple[bytes, str]], hidden: int = 8, steps: int = 300, batch: int = 96, length: int = 64, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network for the languages of the stretches, each language drawn equally often; None for no stretches."""
    labels = sorted({lang for text, lang in stretches if text})
    if not labels:
        return None
    network, rng = Network.fresh(labels, hidden, seed), np.random.default_rng(seed)
    own = [[np.frombuffer(text, np.uint8) for text, lang in stretches if lang == name and text] for name in labels]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.weights()]
    for step in range(1, steps + 1 if len(labels) > 1 else 1):
        wanted = rng.integers(0, len(labels), batch)
        windows = np.zeros((batch, length), np.uint8)
        for row, name in enumerate(wanted):
            text = own[name][rng.integers(len(own[name]))]
            start = rng.integers(0, max(1, len(text) - length + 1))
            part = text[start : start + (length if rng.random() < 0.9 else int(rng.integers(1, length)))]
            windows[row, : len(part)] = part
        _, found = network.gradients(windows, wanted)
        norm = np.sqrt(sum(float((g * g).sum()) for g in found))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for weight, g, (mean, square) in zip(network.weights(), found, moments):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            weight -= pace * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return network


def cut(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts; for each the text's number and the first and last position (exclusive) that it counts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // window)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.minimum(nth * window, np.maximum(sizes[owner] - window, 0))
    first = nth * window - start
    last = np.minimum(sizes[owner] - start, window)
    whole = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(window, np.uint8)])
    begin = (np.cumsum(sizes) - sizes)[owner] + start
    windows = np.lib.stride_tricks.sliding_window_view(whole, window)[begin] if len(owner) else np.zeros((0, window), np.uint8)
    windows = np.where(np.arange(window) < last[:, None], windows, 0).astype(np.uint8)
    return windows, owner, first, last


def pooled(network: Network, texts: list[bytes], window: int, cells: int = 4096) -> np.ndarray:
    """Mean probabilities over all positions of each text; about ``cells`` windows times labels are held at once."""
    block = max(1, cells // max(4, len(network.labels)))
    total = np.zeros((len(texts), len(network.labels)))
    step = max(1, (8 << 20) // window)  # windows that are cut at a time
    held, size, first = [], 0, 0

    def add(some: list[bytes], at: int) -> None:
        windows, owner, begin, end = cut(some, window)
        for k in range(0, len(windows), block):
            part = slice(k, k + block)
            seen = network.label_windows(windows[part])
            place = np.arange(window)[:, None]
            counted = (place >= begin[part]) & (place < end[part])
            sums = np.einsum("twl,tw->wl", seen, counted.astype(np.float32))
            np.add.at(total, owner[part] + at, sums)

    for n, text in enumerate(texts):
        if held and size + len(text) > step * window:
            add(held, first)
            held, size, first = [], 0, n
        held.append(text)
        size += len(text)
    if held:
        add(held, first)
    return total / np.maximum(np.array([len(t) for t in texts], np.int64), 1)[:, None]


#: Counts of up to this many languages are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


def training_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300) -> list[tuple[bytes, str]]:
    """At most three stretches of 200 characters of ``per_language`` documents of each language, drawn by hashed id.

    A language's count sets how low a document's hash must be to be a candidate, so that about four times as many as
    are wanted meet in the ranking, however many documents or partitions there are.
    """
    spread = lambda n: F.substring(text_col, F.lit(1) + F.pmod(F.xxhash64(F.col(id_col), F.lit(n)), F.greatest(F.length(text_col) - 199, F.lit(1))).cast("int"), F.lit(200))
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("total"))
    if counts.count() <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)
    labelled = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("draw"), *(spread(n).alias(f"s{n}") for n in range(3)))
    low = F.col("draw").cast("double") / 2.0**64 + 0.5 <= 4.0 * per_language / F.col("total")
    first = Window.partitionBy("lang").orderBy("draw", "s0")
    ranked = labelled.join(counts, "lang").where(low).drop("total").withColumn("n", F.row_number().over(first))
    rows = ranked.where(F.col("n") <= per_language).drop("n").collect()
    rows.sort(key=lambda r: (r.lang, r.draw, r.s0))
    return [(s.encode("utf-8", "surrogatepass"), r.lang) for r in rows for s in (r.s0, r.s1, r.s2)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def label_languages(docs: DataFrame, network: Network | None, text_col: str = "text", keep_text: bool = True, window: int = 128) -> DataFrame:
    """``docs`` with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if network is not None:
                some = [n for n, t in enumerate(texts) if has_letter(t)]
                found = pooled(network, [texts[n].encode("utf-8", "surrogatepass") for n in some], window)
                for n, row in zip(some, found):
                    best = int(row.argmax())
                    names[n], scores[n] = network.labels[best], min(1.0, float(row[best]))
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores)], names=[*(f.name for f in kept), "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def label_positions(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", window: int = 128) -> DataFrame:
    """Stretches of bytes whose positions have the same likeliest label: id, first, last (exclusive), label, probability."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("label", T.StringType()), T.StructField("probability", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                parts = []
                for at in range(0, len(data), 1 << 20):
                    windows, _, begin, end = cut([data[at : at + (1 << 20)]], window)
                    seen = network.label_windows(windows)
                    parts += [seen[b:e, w] for w, (b, e) in enumerate(zip(begin, end))]
                if not parts:
                    continue
                seen = np.concatenate(parts)
                best = seen.argmax(axis=1)
                edges = np.flatnonzero(np.diff(best)) + 1
                first, last = np.r_[0, edges], np.r_[edges, len(best)]
                sure = [float(seen[a:b, best[a]].mean()) for a, b in zip(first, last)]
                ids = batch.column(0).take(pa.array(np.full(len(first), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(first), pa.array(last), pa.array([network.labels[k] for k in best[first]]), pa.array(sure)], names=schema.names)

    return source.mapInArrow(run, schema)
