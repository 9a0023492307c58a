"""Operator 8: language identification with language-bitmask n-gram filters.

One table of slots is a bit-sliced Bloom filter of all languages at once: slot s holds a mask with a bit for each
language (in as many words as the languages need), and an n-gram's languages are the AND of the masks at its HASHES
slots. The filters hold every n-gram of the texts they are fitted on, at most FIT_ROWS rows of each language, whole
texts; the table has at least SPARSE slots for each bit that a language sets. A text's n-grams give a count of hits per
language (a popcount per bit); a language whose filter answers yes by chance with rate f gets (hits - f * n) / (1 - f)
of its n n-grams. The largest share decides. The filters are built in one executor's task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, rows_of, ship
from .quality import held_out

GRAM = 5  # bytes
HASHES, SPARSE = 3, 4
FIT_ROWS = 1500
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], np.uint8)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, text of each, ascending): lower-cased letters, one space for each run of other bytes and before and after a text."""
    raw = _FOLD[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)]
    # upper-case two-byte letters of the Latin block that differ from their lower case by one bit of the second byte
    after = np.concatenate(([0], raw[:-1]))
    raw = np.where((after == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97), raw + 32, raw).astype(np.uint8)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]) + 1, np.arange(len(raw)), side="right")  # a text's space follows it
    one = np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))
    raw, owner = raw[one], owner[one]
    n = max(len(raw) - GRAM + 1, 0)
    w = np.ndarray(shape=(len(raw),), dtype="<u8", buffer=raw.tobytes() + bytes(8), strides=(1,))[:n] & np.uint64((1 << (8 * GRAM)) - 1)
    ok = owner[1 : n + 1] == owner[GRAM - 1 :][:n]  # all but the first byte, which may be the space before, lie in one text
    return w[ok], owner[1 : n + 1][ok]


def slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of n-grams in a table of 2**bits slots."""
    h, out = g, []
    for k in range(HASHES):
        if k % 2 == 0:
            h = mix64(h + np.uint64(0x9E3779B97F4A7C15))
        out.append((h >> np.uint64(32 * (k % 2)) & np.uint64((1 << bits) - 1)).astype(np.int64))
    return out


def word_type(languages: int) -> np.dtype:
    """The smallest mask word that holds the languages; beyond 64, words of 64 bits."""
    return next((np.dtype(f"<u{n}") for n in (1, 2, 4) if languages <= 8 * n), np.dtype("<u8"))


class Filters:
    """Languages, the slot table (a row for each mask word), each language's rate of false answers and its share of rows, which decides ties."""

    def __init__(self, languages: list[str], table: np.ndarray, false_rates: np.ndarray, shares: np.ndarray):
        self.languages, self.table, self.false_rates, self.shares = languages, table, false_rates, shares

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], counts: dict[str, int] | None = None) -> Filters:
        """counts: rows of each language, if more than the samples."""
        names = sorted(samples)
        known = {x: np.unique(np.concatenate([np.unique(grams([t])[0]) for t in samples[x]] or [np.zeros(0, np.uint64)])) for x in names}
        bits = max(8, int(np.ceil(np.log2(1 + SPARSE * HASHES * max((len(g) for g in known.values()), default=0)))))
        kind = word_type(len(names))
        word = 8 * kind.itemsize
        table = np.zeros((-(-len(names) // word), 1 << bits), kind)
        fill = np.zeros(len(names))
        for i, x in enumerate(names):
            own = np.zeros(1 << bits, bool)
            for s in slots(known[x], bits):
                own[s] = True
            table[i // word][own] |= kind.type(1 << (i % word))
            fill[i] = own.mean()
        rows = np.array([(counts or {}).get(x, len(samples[x])) for x in names], float)
        return cls(names, table, fill**HASHES, rows / max(rows.sum(), 1))

    def masks(self, g: np.ndarray) -> np.ndarray:
        """A row for each mask word: the languages that contain each n-gram."""
        a, *rest = slots(g, self.table.shape[1].bit_length() - 1)
        out = self.table[:, a]
        for s in rest:
            out &= self.table[:, s]
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score 0 to 1) of each text."""
        g, owner = grams(texts)
        m, size, word = self.masks(g), len(texts), 8 * self.table.dtype.itemsize
        ends = np.searchsorted(owner, np.arange(size + 1))  # owners ascend
        sums = np.zeros(len(g) + 1, np.int64)
        hits = np.zeros((len(self.languages), size))
        for i in range(len(self.languages)):
            np.cumsum((m[i // word] >> m.dtype.type(i % word)) & m.dtype.type(1), out=sums[1:])
            hits[i] = sums[ends[1:]] - sums[ends[:-1]]
        n = np.diff(ends)
        true = np.maximum((hits - self.false_rates[:, None] * n) / (1 - self.false_rates[:, None] + 1e-12), 0) + 1e-3 * self.shares[:, None]
        share = true / true.sum(axis=0)
        best = share.argmax(axis=0)
        return best, share[best, np.arange(size)]


def fit_languages(docs: DataFrame, fit_rows: int = FIT_ROWS, parts: int = 5, part: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from at most fit_rows rows of each language outside the held-out part, in hash order of the id; whole texts.

    Every language is learned; null languages and null texts are not, and rows that repeat a language and an id count
    once (with the least text). The languages are counted first; their counts bound the hashes of the rows that can be
    among the first fit_rows, so one pass over the texts finds these.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null").where(~held_out("id", parts, part))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Filters.fit({})
    cuts = spark.createDataFrame([(x, min(1.0, (2 * fit_rows + 100) / n)) for x, n in counts.items()], "lang string, cut double")
    known = known.withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 1))
    picked = known.where("text is not null").join(F.broadcast(cuts), "lang").where(F.col("h") <= F.col("cut") * F.lit(2.0**63))
    picked = picked.groupBy("lang", "id", "h").agg(F.min("text").alias("text"))
    picked = picked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= fit_rows).select("lang", "id", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                samples.setdefault(lang, []).append(text.encode())
        if samples:
            own = Filters.fit(samples, counts)
            yield pa.RecordBatch.from_pydict({"languages": [own.languages], "words": [len(own.table)], "raw": [own.table.tobytes()], "rates": [own.false_rates.tolist()], "shares": [own.shares.tolist()]})

    made = picked.repartition(1).mapInArrow(fit, "languages array<string>, words long, raw binary, rates array<double>, shares array<double>").collect()  # one row
    if not made:
        return Filters.fit({})
    names = list(made[0]["languages"])
    return Filters(names, np.frombuffer(bytes(made[0]["raw"]), word_type(len(names))).reshape(made[0]["words"], -1), np.array(made[0]["rates"]), np.array(made[0]["shares"]))


def identify(docs: DataFrame, filters: Filters, parts: int = 5, part: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Only the text is read.

    `und` with score 0 for null texts, texts without a letter (Unicode categories L), and where nothing was learned. A
    text with letters but no known n-gram gets the language with the most rows, which also wins ties, with its share of
    rows as the score.
    Rows are judged one by one, so repeated rows get equal results. No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((filters.languages, filters.table, filters.false_rates, filters.shares))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, parts, part).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(*sent.value)
        for part_, texts in rows_of(batches):
            lettered = np.array([bool(own.languages) and _LETTER.search(t.decode()) is not None for t in texts])
            best, score = own.predict(texts) if own.languages else (np.zeros(len(texts), int), np.zeros(len(texts)))
            names = [own.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part_.column(0), part_.column(1), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
