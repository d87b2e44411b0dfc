"""Language ID by compression: the dictionary that packs a text best wins.

For every language a zstandard raw-content dictionary is laid out from labelled
texts.  A text is cut into chunks of ``CHUNK`` bytes, each compressed with every
language's dictionary, and the sizes are added: the whole text counts, and the
dictionary stays within reach.  The smallest total names the language; the
score is how much smaller it is than the next, and a narrow score is a
rejection.

Letters tell languages apart, so upper-case A-Z become lower case and all other
ASCII bytes one space.  A short chunk would often be stored raw, with equal
sizes for all languages; a run of spaces goes behind every chunk, so that raw
storage never pays and small differences show.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import ddl, in_batches, partitions, slices, tool

CHUNK = 4096
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS, SAMPLE_PIECES, PIECE_CHARACTERS = 400, 400, 400
MAX_LANGUAGES = 400
MIN_MARGIN = 0.004
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LETTERS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_FILL = b" " * 160

PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def plain(text: str) -> bytes:
    return b" ".join(text.encode().translate(_LETTERS_ONLY).split())


class Classifier:
    """``sizes`` and ``predict`` for the dictionaries of some languages."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.tools = [self._tool(dictionaries[x]) for x in self.languages]

    @staticmethod
    def _tool(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters.from_level(6, source_size=CHUNK, dict_size=DICTIONARY_BYTES, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstandard.STRATEGY_LAZY, hash_log=15, chain_log=15, search_log=3, min_match=4, target_length=64)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary)

    def sizes(self, text: str) -> list[int]:
        data = plain(text)
        totals = [0] * len(self.languages)
        for i in range(0, len(data) or 1, CHUNK):
            part = data[i : i + CHUNK] + _FILL
            for k, tool in enumerate(self.tools):
                totals[k] += len(tool.compress(part))
        return totals

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score in 0 to 1; ``und`` and 0 without any letter."""
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        totals = self.sizes(text)
        best = min(range(len(totals)), key=totals.__getitem__)
        if len(totals) == 1:
            return self.languages[0], 1.0
        second = min(x for k, x in enumerate(totals) if k != best)
        return self.languages[best], 1 - totals[best] / second


def fit(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language from rows with a text and a non-null label.

    The sample is bounded: ``SAMPLE_DOCUMENTS`` texts a language, those with the
    least hash of the text (a text counts once), and of all their pieces of
    ``PIECE_CHARACTERS`` the ``SAMPLE_PIECES`` with the least hash, of which the
    last ``DICTIONARY_BYTES`` bytes are the dictionary.  More than
    ``MAX_LANGUAGES`` labels are an error.  Both selections are made partition
    by partition first, so a hot language does not gather in one task.  Without
    labelled rows there are no dictionaries and every text is ``und``.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(f"`{text_column}`").cast("string").alias("text"), F.col(f"`{lang_column}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    # the least hashes first, without texts: at most SAMPLE_DOCUMENTS a language
    chosen = _least(rows.select("lang", "h").distinct(), ["h"], SAMPLE_DOCUMENTS).select("lang", "h").collect()
    if len({r["lang"] for r in chosen}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not chosen:
        return {}
    keys = F.broadcast(spark.createDataFrame(chosen, "lang string, h long"))
    texts = rows.join(keys, ["lang", "h"]).dropDuplicates(["lang", "h"])
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE_CHARACTERS).cast("int"))
    pieces = texts.where(F.length("text") > 0).select("lang", F.explode(F.transform(starts, lambda i: F.substring("text", i * PIECE_CHARACTERS + 1, F.lit(PIECE_CHARACTERS)))).alias("piece"))
    pieces = _least(pieces.withColumn("h", F.xxhash64("piece")), ["h", "piece"], SAMPLE_PIECES)
    found: dict[str, list[bytes]] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["lang"], r["h"], r["piece"])):
        found.setdefault(r["lang"], []).append(plain(r["piece"]))
    return {lang: (b" ".join(parts)[-DICTIONARY_BYTES:]).ljust(8) for lang, parts in found.items()}


def _least(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """A language's ``k`` least rows, in two levels.

    What a partition keeps of a language goes to one of about as many tasks as
    the root of the number of partitions, and what those keep, to one.
    """
    salts = math.isqrt(partitions(rows.sparkSession)) + 1
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    for keys in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("k") <= k).drop("k")
    return salted.drop("salt")


def _classifier(dictionaries: dict[str, bytes]) -> Classifier:
    """One a Python worker and set of dictionaries."""
    return tool(("language_id", tuple(sorted(dictionaries.items()))), lambda: Classifier(dictionaries))


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score), from the text alone.

    A text that is null, empty or without a letter is ``und`` with score 0.
    Equal texts get equal results; ties go to the first language by name.  Rows
    with equal or null ids are answered each; other columns are ignored.
    """
    tables = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def answer(ids: pa.Array, texts: pa.Array) -> list:
        classifier = _classifier(tables.value)
        found = [classifier.predict(t) for t in texts.to_pylist()]
        return [ids, [x[0] for x in found], [x[1] for x in found]]

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return rows.mapInArrow(in_batches(["doc_id", "text"], PREDICTED, answer), ddl(PREDICTED))


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text_column: str = "text") -> DataFrame:
    """The rows, all their columns as they are, whose language is told clearly.

    Rows without a letter, with a null text, or whose score is below
    ``min_margin`` are rejected.
    """
    tables = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def keep(batches):
        for whole in batches:
            for b in slices(whole):
                classifier = _classifier(tables.value)
                found = [classifier.predict(t) for t in b.column(b.schema.get_field_index(text_column)).cast(pa.string()).to_pylist()]
                yield b.filter(pa.array([x[0] != UNKNOWN and x[1] >= min_margin for x in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
