"""Language identification by compression.

A sample of each language's words becomes a raw-content zstandard dictionary. A text is cut into
blocks, each block is compressed with every dictionary, and the language whose dictionary gives the
fewest bytes in all is the prediction. A narrow margin to the second language means that the
dictionaries say little, and the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import mapped, own_name

UNKNOWN = "und"
#: The sample that is learned from: the whole texts of so many documents of each language, those of least hash of doc_id.
SAMPLE_DOCS = 300
#: The sample's letters are cut into pieces of so many characters; a dictionary holds those of least hash, up to so many bytes.
PIECE, DICTIONARY_BYTES = 200, 112 << 10
#: More languages are an error: what is broadcast is at most this times the size of a dictionary.
MOST_LANGUAGES = 1000
#: Bytes of text compressed at a time. Short blocks profit from the dictionary and not from each other.
BLOCK = 1024
#: zstandard's settings: matches from four bytes on, as most of what marks a language is that short.
SETTINGS = {"compression_level": 3, "strategy": zstandard.STRATEGY_DFAST, "min_match": 4, "window_log": 18, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
#: Least difference of the second smallest to the smallest size, as a share of the former.
MARGIN = 0.001

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LETTER = regex.compile(r"\p{L}").search


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER(text) is not None


def folded(text: str) -> bytes:
    """What is compressed: the runs of letters, lower-cased, one space between them."""
    return " ".join(_WORDS.findall(text.lower())).encode("utf-8", "replace")


def held_out(doc_id: Column | str) -> Column:
    """Documents that nothing is learned from: crc32 of doc_id as text leaves 1 when divided by 3. A null doc_id isn't one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """One dictionary for each language of the labelled rows.

    Rows without text, language, key or any letter are passed over. Of what is left the languages' numbers of different keys,
    counted to some five in a hundred, tell from what hash on a key can't be among the SAMPLE_DOCS least ones, so that
    some twice as many are moved in all, whatever the size of the table; rows of one key count as one, however many there are.
    Every language of a row that isn't passed over is learned. The driver gets the numbers and DICTIONARY_BYTES
    of a language. More than MOST_LANGUAGES languages are an error.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("lang is not null and key is not null and text is not null")
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    numbers = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.05).alias("keys")).limit(MOST_LANGUAGES + 1).collect()
    if len(numbers) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not numbers:
        return {}
    share = F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(float(1 << 53))
    sizes = labelled.sparkSession.createDataFrame([(r.lang, r["keys"]) for r in numbers], "lang string, keys long")
    chosen = rows.join(F.broadcast(sizes), "lang").where(share * F.col("keys") < 2 * SAMPLE_DOCS)
    chosen = chosen.groupBy("lang", "key").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    chosen = chosen.withColumn("k", first).where(F.col("k") <= SAMPLE_DOCS)
    # A lambda over a one-element array, so that the letters are taken out once for a row.
    letters = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0)), " ")
    cut = F.transform(F.array(letters), lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(x) - 1) / PIECE).cast("int")), lambda k: F.substring(x, k * PIECE + 1, F.lit(PIECE))))[0]
    pieces = chosen.select("lang", "key", F.posexplode(cut).alias("at", "piece"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key", "at"), "key", "at"))
    pieces = pieces.withColumn("k", place).where(F.col("k") <= DICTIONARY_BYTES // PIECE).select("lang", "k", "piece")
    found: dict[str, list[bytes]] = {}
    for r in pieces.orderBy("lang", "k").toLocalIterator():
        found.setdefault(r.lang, []).append(r.piece.encode("utf-8", "replace"))
    return {k: b" ".join(v)[:DICTIONARY_BYTES] for k, v in found.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self._packers = []
        settings = zstandard.ZstdCompressionParameters(**SETTINGS)
        for lang in sorted(dictionaries):
            held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            packer = zstandard.ZstdCompressor(dict_data=held, compression_params=settings)
            self._packers.append((lang, packer))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). score: how much smaller the smallest size is than the second, times 5, at most 1."""
        if not self._packers or not has_letter(text):
            return UNKNOWN, 0.0, True
        data = folded(text)
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        sizes = sorted((sum(map(len, map(packer.compress, blocks))), lang) for lang, packer in self._packers)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], min(1.0, 5 * margin), margin < MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """Adds the predicted language, its score (0 to 1) and whether the document is rejected.

    A null text or one without a letter, and any text where nothing was learned, is UNKNOWN with score
    0 and rejected. Equal sizes go to the language first in order and are rejected. Only the text is
    read; every row gives one row and keeps its other columns.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at, names = docs.columns.index(text), [*docs.columns, lang, score, rejected]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(sent.value).classify
        for batch in batches:
            found = [classify(x) for x in batch.column(at).to_pylist()]
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())])
    return mapped(docs, rows, schema)


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each document, learned from the documents that aren't held out."""
    dictionaries = learn(docs.where(~held_out("doc_id")))
    out = predict(docs.select("doc_id", "text"), dictionaries)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def without_rejected(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) whose language is told, with all their columns."""
    names = [own_name(docs, c) for c in ("lang_pred", "lang_score", "lang_rejected")]
    out = predict(docs, learn(docs.where(~held_out("doc_id"))), "text", *names)
    return out.where(~out[names[2]]).select(*docs.columns)
