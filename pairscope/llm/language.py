"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample texts. A text is compressed in blocks with every
dictionary; the language with the smallest total wins, since its dictionary shares most strings with the text. Where
the runner-up is hardly larger the answer is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.llm.common import workers_import

#: Bounds of the fit: texts for each language, characters of each, bytes of a dictionary.
SAMPLE_TEXTS = 128
SAMPLE_BYTES = 2_048
DICTIONARY_BYTES = 96_000
LEVEL = 6
#: A block is short, so that it leans on the dictionary and not on its own earlier part.
BLOCK = 1_024
#: Smallest advantage over the runner-up, as a share of the winner's bytes, that is not rejected.
MARGIN = 0.01
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+").findall


def letters(text: str) -> bytes:
    """The whole text in lower case, runs of letters separated by spaces: no layout, digits or marks."""
    return " ".join(_LETTERS(text.lower())).encode()


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """A dictionary for each language in ``labelled``, from up to ``sample_texts`` rows chosen by the hash of their identifiers.

    Of each sampled text the first ``sample_bytes`` characters are kept. Rows without a text or language teach nothing.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    # hash-low rows first, some more than needed, so that few texts meet in the ranking
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    rank = F.xxhash64("id", F.lit("language"))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 4 * sample_texts / n))])[F.col("lang")]
    low = rows.where(F.pmod(rank, F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("lang").orderBy("rank", "id", "text")
    ranked = low.select("lang", "id", rank.alias("rank"), F.substring("text", 1, sample_bytes).alias("text"))
    chosen = ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_texts).orderBy("lang", "k").collect()
    parts: dict[str, list[bytes]] = {}
    for row in chosen:
        seen = parts.setdefault(row["lang"], [])
        if (data := letters(row["text"])) and data not in seen:
            seen.append(data)
    return {lang: b"\n".join(texts)[:DICTIONARY_BYTES] for lang, texts in parts.items()}


class Model:
    """Compressors by language; one for each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compress = []
        for lang in self.langs:
            shared = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed bytes of the whole text for each language."""
        data = memoryview(text)
        blocks = [data[k:k + BLOCK] for k in range(0, len(data), BLOCK)]
        return np.array([sum(len(compress(b)) for b in blocks) for compress in self.compress], dtype=np.float64)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether the margin is too narrow. Ties go to the first language by name."""
        plain = letters(text or "")
        if not self.langs or not plain:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(plain)
        best = int(np.argmin(sizes))
        weight = np.exp(-np.clip((sizes - sizes[best]) * 0.5, 0, 700))
        others = np.delete(sizes, best)
        narrow = bool(len(others)) and (others.min() - sizes[best]) < MARGIN * sizes[best]
        return self.langs[best], float(1 / weight.sum()), narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, lang_pred, score, rejected.

    ``lang_pred`` is a learned language, or `und` with score 0 where the text is null or has no letter or nothing was
    learned. Only the text enters. Repeated rows are repeated; an empty table gives none.
    """
    workers_import(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            lang, score, narrow = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())],
                names=["id", "lang_pred", "score", "rejected"])

    kind = thin.schema["id"].dataType.simpleString()
    return thin.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo ``folds``; null for a null identifier."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from fold 0, 1 and 3 of four, predicts every row: <id_col>, held_out, lang_pred, score, rejected.

    Rows with a null identifier are neither learned from nor held out.
    """
    held = fold(id_col, 4) == 2
    found = identify(docs, learn(docs.where(~held), id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
