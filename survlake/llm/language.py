"""Language identification with a small convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes (the last one padded with zero bytes),
all of them, in order. The network looks up an embedding per byte, applies filters of
2, 3 and 4 bytes, takes the maximum of each filter over the window and a softmax over
the languages. It is trained here with numpy (Adam, cross entropy) on windows of a
bounded sample: at most ``docs_per_lang`` documents of each language, chosen by hash,
``windows_per_doc`` windows of each. A text's prediction is the language with the
highest mean probability over its windows, which is also the score.

For prediction the embedding is folded into the filters: a filter of 2 bytes is one
row of a table over byte pairs, one of 3 or 4 bytes is the sum of two rows.

Defined results: null text and text without any letter are ``und`` with score 0, as is
every text if no labelled document can be learned from; ties go to the first language
in order of name; rows with a null doc_id are never learned from and are not held out;
repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survlake.llm.tables import give_back, ship, tidy

WINDOW, WIDTHS = 128, (2, 3, 4)


@dataclass
class Network:
    langs: list[str]
    tables: list[list[np.ndarray]]  # per width: one or two tables of filter sums
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax rows for windows (n × WINDOW bytes)."""
        out = []
        for at in range(0, len(windows), 256):
            w = windows[at:at + 256]
            pair = (w[:, :-1].astype(np.intp) << 8) | w[:, 1:]
            peaks = []
            for width, tabs in zip(WIDTHS, self.tables):
                n = WINDOW - width + 1
                s = tabs[0].take(pair[:, :n], axis=0)
                if width == 3:
                    s += tabs[1].take(w[:, 2:2 + n], axis=0)
                elif width == 4:
                    s += tabs[1].take(pair[:, 2:2 + n], axis=0)
                peaks.append(s.max(axis=1))
            h = np.maximum(np.concatenate(peaks, axis=1) + self.bias, 0)
            z = h @ self.weight + self.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 500, batch: int = 64,
          embed: int = 8, filters: int = 12, rate: float = 0.01, seed: int = 7) -> Network:
    """Fits the network to windows (n × WINDOW bytes) and their language numbers."""
    rng = np.random.default_rng(seed)
    total = filters * len(WIDTHS)
    p = {"E": rng.normal(0, 0.5, (256, embed)), "b": np.zeros(total),
         "V": rng.normal(0, 0.3, (total, len(langs))), "c": np.zeros(len(langs))}
    p |= {f"F{w}": rng.normal(0, (w * embed) ** -0.5, (w * embed, filters)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    # languages are drawn alike however many windows each has
    where = [np.flatnonzero(labels == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), batch)
        x = windows[[where[k][rng.integers(len(where[k]))] for k in y]].astype(np.intp)
        e = p["E"][x]
        peaks, kept = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            patches = np.concatenate([e[:, j:j + n] for j in range(w)], axis=2)
            s = patches @ p[f"F{w}"]
            top = s.argmax(axis=1)
            peaks.append(np.take_along_axis(s, top[:, None], 1)[:, 0])
            kept.append((patches, top))
        raw = np.concatenate(peaks, axis=1) + p["b"]
        h = np.maximum(raw, 0)
        z = h @ p["V"] + p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(batch), y] -= 1
        z /= batch
        g = {"V": h.T @ z, "c": z.sum(0)}
        dh = (z @ p["V"].T) * (raw > 0)
        g["b"] = dh.sum(0)
        g["E"] = np.zeros_like(p["E"])
        for i, w in enumerate(WIDTHS):
            patches, top = kept[i]
            d = dh[:, i * filters:(i + 1) * filters]
            rows = np.arange(batch)[:, None]
            best = patches[rows, top]  # batch × filters × (w·embed)
            g[f"F{w}"] = np.einsum("bf,bfd->df", d, best)
            back = (d[:, :, None] * p[f"F{w}"].T[None]).reshape(batch, filters, w, embed)
            for j in range(w):
                np.add.at(g["E"], x[rows, top + j], back[:, :, j])
        for k, v in g.items():
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.001 * (v * v - square[k])
            p[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    tables = []
    for w in WIDTHS:
        one = [p["E"] @ p[f"F{w}"][j * embed:(j + 1) * embed] for j in range(w)]
        pairs = [(a[:, None] + b[None]).reshape(65536, filters) for a, b in zip(one[0::2], one[1::2])]
        tables.append([t.astype(np.float32) for t in pairs + one[2:3] * (w == 3)])
    return Network(langs, tables, p["b"], p["V"], p["c"])


def cut(data: bytes) -> np.ndarray:
    """All windows of a text, the last one padded."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fit(docs: DataFrame, docs_per_lang: int = 800, windows_per_doc: int = 3, steps: int = 500) -> Network | None:
    """Trains on documents outside the held-out third; None where there is nothing to learn from."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").where(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    # a hash of the key picks about docs_per_lang of each language, 2 windows' worth of text at hashed places
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1_000_000)) / 1e6
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, docs_per_lang / sizes[k]))])
    picked = known.where(draw < share[F.col("lang")])
    places = [F.encode(F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(
        F.char_length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)), "UTF-8") for i in range(windows_per_doc)]
    rows = picked.select("lang", F.array(*places).alias("parts")).collect()
    number = {k: i for i, k in enumerate(langs)}
    pairs = sorted((number[r["lang"]], bytes(part)[:WINDOW]) for r in rows for part in r["parts"])
    if len({k for k, _ in pairs}) < len(langs):  # a rare language of which the hash took nothing
        return fit(docs, docs_per_lang * 4, windows_per_doc, steps)
    return train(np.concatenate([cut(part)[:1] for _, part in pairs]), np.array([k for k, _ in pairs]), langs, steps)


def _predicted(network: Network | None, text: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text; null stands for a text without letters."""
    lang, score = ["und"] * len(text), [0.0] * len(text)
    todo = [i for i, ok in enumerate(text.is_valid().to_pylist()) if ok] if network else []
    while todo:
        part, size = [], 0
        while todo and (not part or size < 4096):  # windows at once
            w = cut(text[todo[0]].as_py().encode("utf-8", "surrogatepass"))
            part.append((todo.pop(0), w))
            size += len(w)
        prob = network.probabilities(np.concatenate([w for _, w in part]))
        starts = np.cumsum([0] + [len(w) for _, w in part[:-1]])
        mean = np.add.reduceat(prob, starts, axis=0) / np.array([len(w) for _, w in part])[:, None]
        for (i, _), m in zip(part, mean):
            k = int(m.argmax())
            lang[i], score[i] = network.langs[k], min(1.0, float(m[k]))
    return lang, score


def accepted(docs: DataFrame, network: Network | None, least: float | None = None) -> DataFrame:
    """The rows, with all their columns, that are in a known language with at least that score.

    ``least`` is by default a quarter of the way from chance (one over the number of languages) to certainty. Only the text goes to the Python workers.
    """
    ship(docs.sparkSession)
    if network is None:
        return docs.limit(0)
    chance = 1 / len(network.langs)
    level = chance + (1 - chance) / 4 if least is None else least

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        lang, score = _predicted(network, text)
        give_back()
        return pa.array([x != "und" and s >= level for x, s in zip(lang, score)], pa.bool_())

    return docs.where(known(F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))))


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred, score of every whole text."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    held = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    rows = docs.select(key, held.alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = _predicted(network, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=[key, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), f"{key} {kind}, held_out boolean, lang_pred string, score double")
