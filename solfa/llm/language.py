"""Language identification by a byte convolutional network, trained here in numpy.

Filters of several widths read windows of WINDOW bytes, each is pooled to its maximum over the window, and a softmax
layer gives the languages. A text is predicted from all its windows: their probabilities are averaged, each weighted
by its bytes. A filter over one-hot bytes is a table row for each byte of its width, so convolution is a sum of
table rows.

Training reads a bounded sample (SAMPLE documents, WINDOWS windows of each at hashed places) of rows that have a
label, on the driver; the model of a few hundred kilobytes goes out with the task.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if no row has a label;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, key_schema, parts

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
SAMPLE, WINDOWS, EPOCHS, BATCH, RATE, SEED = 3000, 2, 8, 64, 0.01, 7
#: A text whose mean probability of its best language is below this is rejected by the pipeline, as is `und`.
REJECT = 0.4
REACH = max(WIDTHS) - 1
_LETTER = regex.compile(r"\p{L}")


def windows_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of raw, each with REACH bytes of the next (zeros at the end), and the bytes in each."""
    n = max(1, -(-len(raw) // WINDOW))
    padded = np.zeros(n * WINDOW + REACH, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + REACH)[::WINDOW]
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(raw) - (n - 1) * WINDOW
    return rows, sizes


@dataclass
class ByteNet:
    langs: list[str]
    tables: dict[int, np.ndarray]  # (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str]) -> ByteNet:
        own = np.random.default_rng(SEED)
        tables = {w: own.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        size = FILTERS * len(WIDTHS)
        return cls(langs, tables, np.zeros(size, np.float32), own.normal(0, 0.3, (size, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    def pooled(self, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of each filter over each window, and where they are."""
        tops, places = [], []
        for w, table in self.tables.items():
            sums = table[0].take(rows[:, :WINDOW], axis=0)
            for j in range(1, w):
                sums += table[j].take(rows[:, j : j + WINDOW], axis=0)
            if where:
                places.append(sums.argmax(1))
                tops.append(np.take_along_axis(sums, places[-1][:, None], 1)[:, 0])
            else:
                tops.append(sums.max(1))
        return np.concatenate(tops, 1), np.concatenate(places, 1) if where else None

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(rows), BATCH):
            top, _ = self.pooled(rows[at : at + BATCH])
            logits = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
            logits -= logits.max(1, keepdims=True)
            odds = np.exp(logits)
            out.append(odds / odds.sum(1, keepdims=True))
        return np.concatenate(out)

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> ByteNet:
        """Adam on the cross entropy of windows."""
        own = np.random.default_rng(SEED)
        slots = [*self.tables.values(), self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(x) for x in slots], [np.zeros_like(x) for x in slots], 0
        for _ in range(EPOCHS):
            order = own.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                part, n = rows[pick], len(pick)
                top, places = self.pooled(part, True)
                hidden = np.maximum(top + self.bias, 0)
                logits = hidden @ self.out + self.out_bias
                odds = np.exp(logits - logits.max(1, keepdims=True))
                error = odds / odds.sum(1, keepdims=True)
                error[np.arange(n), labels[pick]] -= 1
                error /= n
                back = (error @ self.out.T) * (hidden > 0)
                grads = []
                for i, (w, table) in enumerate(self.tables.items()):
                    grad, own_places = np.zeros_like(table), places[:, i * FILTERS : (i + 1) * FILTERS]
                    flow = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        seen = np.take_along_axis(part, own_places + j, 1)
                        np.add.at(grad[j], (seen, np.arange(FILTERS)[None]), flow)
                    grads.append(grad)
                grads += [back.sum(0), hidden.T @ error, error.sum(0)]
                step += 1
                for x, g, m, v in zip(slots, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        todo = [(i, *windows_of(t.encode())) for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        if not todo:
            return out
        sizes = np.concatenate([s for _, _, s in todo])
        weighted = self.probabilities(np.concatenate([r for _, r, _ in todo])) * sizes[:, None]
        at = 0
        for i, _, s in todo:
            mean = weighted[at : at + len(s)].sum(0) / s.sum()
            at += len(s)
            out[i] = self.langs[int(mean.argmax())], float(min(1.0, mean.max()))
        return out


def trained(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteNet:
    """A net from SAMPLE labelled rows, taken in the order of a hash of their key."""
    place = lambda i: F.pmod(F.xxhash64(key, F.lit(i)), F.greatest(F.lit(1), F.length(text) - WINDOW // 2)) + 1
    pieces = F.array(*(F.substring(F.col(text), place(i).cast("int"), F.lit(WINDOW)) for i in range(WINDOWS)))
    usable = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    # each task would send SAMPLE rows; a share of the hashes leaves about twice as many in all
    share = min(1.0, 2 * SAMPLE / max(1, usable.count()))
    rows = (
        usable.filter(F.xxhash64(key) <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63))))
        .select(lang, pieces.alias("pieces"), F.xxhash64(key).alias("order"))
        .orderBy("order", "pieces")
        .limit(SAMPLE)
        .collect()
    )
    langs = sorted({r[lang] for r in rows})
    pairs = [(windows_of(p.encode()[:WINDOW])[0][0], langs.index(r[lang])) for r in rows for p in r["pieces"] if p]
    net = ByteNet.new(langs)
    return net.fit(np.stack([x for x, _ in pairs]), np.array([y for _, y in pairs])) if pairs else ByteNet.new([])


def identify(df: DataFrame, net: ByteNet, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, lang_pred and score of each row. The text may be one of the keys; it goes to Python once."""
    place = keys.index(text) if text in keys else len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, place):
                found = net.predict(part.column(place).to_pylist())
                columns = [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *columns], [*keys, "lang_pred", "score"])

    return df.select(*dict.fromkeys([*keys, text])).mapInArrow(run, key_schema(df, keys) + ", lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that aren't held out."""
    docs = documents(spark, sf_dir)
    found = identify(docs, trained(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
