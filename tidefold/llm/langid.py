"""Language identification with bit-sliced Bloom filters of character n-grams.

The filter is one table of bit masks, a bit for each language. A look-up reads
the slots of an n-gram and combines them with AND, which gives the languages
that contain the n-gram, all at once. For a text the set bits are counted for
each language, and the count is corrected for the share of foreign n-grams that
the filter lets pass by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import missing, settled

GRAM = 4
HASHES = 2
TABLE_BITS = 20
# Bounds of the sample that the filters are fitted on.
DOCS_PER_LANGUAGE = 4000
CHARS_PER_DOC_STEP = 1 << 20  # texts are read in steps of this many characters, all of them
# An n-gram enters a language's filter from this share of the language's n-grams on: at most 1 / LEAST_SHARE do.
LEAST_SHARE = 1e-5
UNDECIDED = "und"


def letters_table() -> np.ndarray:
    """Lower case for each letter, a blank for any other character."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def grams(text: str, table: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of letters and single blanks, all of them, in steps of bounded memory."""
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), CHARS_PER_DOC_STEP):
        last = at + CHARS_PER_DOC_STEP >= len(text)
        codes = np.frombuffer(text[at : at + CHARS_PER_DOC_STEP].encode("utf-32-le", "surrogatepass"), "<u4")
        run = np.concatenate([tail, table[codes], np.array([32] * last, np.uint32)])
        keep = np.ones(len(run), bool)
        keep[1:] = (run[1:] != 32) | (run[:-1] != 32)
        run = run[keep]
        tail = run[-(GRAM - 1) :]
        if len(run) < GRAM:
            continue
        hashed = np.zeros(len(run) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            hashed = hashed * np.uint64(0x1000193) + run[k : len(run) - GRAM + 1 + k]
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xD6E8FEB86659FD93)
        yield hashed


def slots(hashed: np.ndarray) -> list[np.ndarray]:
    return [
        ((hashed >> np.uint64(64 - TABLE_BITS * (k + 1))) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        for k in range(HASHES)
    ]


@dataclass
class Model:
    languages: list[str]
    usual: int  # the language of most documents, for texts of letters without any known n-gram
    table: np.ndarray  # (slots, words of 64 bits), or one word of 8 bits for up to eight languages
    false_share: np.ndarray  # foreign n-grams that pass by chance, for each language
    covered: np.ndarray  # share of a language's own n-grams that its filter holds

    def hits(self, hashed: np.ndarray) -> np.ndarray:
        """For each language, the n-grams that its filter holds."""
        found = None
        for at in slots(hashed):
            found = self.table[at] if found is None else found & self.table[at]
        if self.table.ndim == 1:
            masks = np.bincount(found, minlength=256)
            bits = (np.arange(256)[:, None] >> np.arange(len(self.languages))) & 1
            return masks @ bits
        one = np.uint64(1)
        return np.array(
            [int(((found[:, x // 64] >> np.uint64(x % 64)) & one).sum()) for x in range(len(self.languages))]
        )

    def decide(self, hits: np.ndarray, n: int) -> tuple[str, float]:
        true = np.clip((hits - n * self.false_share) / (1 - self.false_share), 0, None)
        shares = true / (n * self.covered)
        total = float(shares.sum())
        if total <= 0:
            return self.languages[self.usual], 0.0
        best = int(np.argmax(shares))
        return self.languages[best], min(1.0, float(shares[best]) / total)


def _counted(sample: DataFrame) -> DataFrame:
    """Occurrences of each n-gram in each language, summed below the shuffle first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters_table()
        for batch in batches:
            languages = batch.column(1).to_pylist()
            for language in sorted(set(languages)):
                own = [
                    h for t, x in zip(batch.column(0), languages, strict=True) if x == language
                    for h in grams(t.as_py(), table)
                ]
                if own:
                    values, n = np.unique(np.concatenate(own), return_counts=True)
                    columns = [pa.array([language] * len(n)), pa.array(values.view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["language", "gram", "n"])

    parts = sample.mapInArrow(count, "language string, gram long, n long")
    return parts.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit the filters on at most about DOCS_PER_LANGUAGE documents of each language, drawn by a hash of the id.

    NULL texts, languages and ids are left out. Without any labelled text there is no model. What reaches the driver
    is the filters' content, at most 1 / LEAST_SHARE n-grams for each language.
    """
    labelled = docs.select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("language"), F.col(doc_id).alias("id")
    ).filter("text is not null and language is not null and id is not null")
    sizes = {r["language"]: r["n"] for r in labelled.groupBy("language").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, DOCS_PER_LANGUAGE / n))])
    counts = settled(_counted(labelled.filter(draw < share[F.col("language")]).select("text", "language")))
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))  # a row for each language
    kept = counts.join(F.broadcast(totals), "language")
    kept = kept.filter((F.col("n") >= F.col("total") * LEAST_SHARE) & (F.col("n") > 1))
    rows = kept.select("language", "gram", (F.col("n") / F.col("total")).alias("share")).toPandas()
    words = (len(languages) + 63) // 64
    table = np.zeros(1 << TABLE_BITS, np.uint8) if len(languages) <= 8 else np.zeros((1 << TABLE_BITS, words), np.uint64)
    false_share, covered = np.zeros(len(languages)), np.full(len(languages), 1e-9)
    for x, language in enumerate(languages):
        own = rows[rows["language"] == language]
        for at in slots(own["gram"].to_numpy(np.int64).view(np.uint64)):
            if table.ndim == 1:
                table[at] |= np.uint8(1 << x)
            else:
                table[at, x // 64] |= np.uint64(1 << x % 64)
        column = table if table.ndim == 1 else table[:, x // 64]
        filled = float(((column >> column.dtype.type(x % 64)) & column.dtype.type(1)).mean())
        false_share[x] = filled**HASHES
        covered[x] = max(float(own["share"].sum()), 1e-9)
    return Model(languages, max(range(len(languages)), key=lambda x: sizes[languages[x]]), table, false_share, covered)


def identify(docs: DataFrame, model: Model | None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The language of every whole text: ``keys``, ``lang_pred`` and ``score`` (0 to 1).

    * NULL texts, texts without a letter, and all texts if there is no model: ``und`` with score 0.
    * Letters, but no known n-gram: the language of most documents, with score 0. Ties go to the first language in
      the order of code points.
    * Very long texts are read whole, in steps. Repeated rows give repeated rows, NULL keys are kept.
    * Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    missing(docs, text, *keys)
    # 1 MB for up to eight languages, 8 MB for each 64 beyond.
    sent = docs.sparkSession.sparkContext.broadcast(asdict(model) if model else None)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, filters = letters_table(), Model(**sent.value) if sent.value else None
        for batch in batches:
            named, scores = [], []
            for value in batch.column(1):
                body, n, hits = value.as_py() or "", 0, 0
                if filters is not None and any(map(str.isalpha, body)):
                    for hashed in grams(body, table):
                        n, hits = n + len(hashed), hits + filters.hits(hashed)
                    language, score = filters.decide(hits, n) if n else (filters.languages[filters.usual], 0.0)
                else:
                    language, score = UNDECIDED, 0.0
                named.append(language)
                scores.append(score)
            columns = [batch.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*keys).alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(predict, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")
