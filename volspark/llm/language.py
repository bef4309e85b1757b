"""Language identification by compression.

For each language, a zstandard raw-content dictionary is made of sampled texts.
A text is cut into chunks of CHUNK bytes, every chunk of it is compressed with
each dictionary, and the language with the smallest total wins. Where the best
and the second best differ by less than ``margin`` of the best, the result is
marked as rejected.

Bounds: at most SAMPLE_ROWS texts a language, chosen by a hash of doc_id and text, make
its dictionary of DICTIONARY_BYTES, each with an equal share from its middle;
only these shares are collected. Predictions read whole texts.

Defined cases: null text, or one without a letter, is ``und`` with score 0;
texts are compared in lower case without ASCII digits and punctuation; equal
totals go to the language first in code point order; null languages are not
learned; without a learned language every text is ``und``; an empty table gives
no rows. Rows that repeat a doc_id, or have none, are predicted one by one, and
learned from like others, rows that repeat the text as well once;
columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import by_size, cut, fold, slices

SAMPLE_ROWS = 200
DICTIONARY_BYTES = 64 << 10
CHUNK = 4 << 10
#: Compression that finds matches of three bytes, as words share short pieces; the tables hold a dictionary and a chunk.
PARAMETERS = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 4, "min_match": 3, "target_length": 32, "strategy": 5}
MARGIN = 0.01
#: Bytes of difference between two totals that make one e times as likely.
TEMPERATURE = 4.0
UNKNOWN = "und"

_DROP = bytes(c for c in range(128) if not chr(c).isalpha() and c != 32)
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r|", b"      ")


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE, _DROP.translate(None, b"\t\n\x0b\x0c\r|"))


class Languages:
    """Compressors of the languages; made anew in each worker from the dictionaries' bytes."""

    def __init__(self, contents: dict[str, bytes]) -> None:
        self.contents, self.names, self._compressors = contents, sorted(contents), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_compressors": None}

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed bytes of the whole text with each dictionary."""
        import zstandard

        if self._compressors is None:
            self._compressors = []
            for name in self.names:
                d = zstandard.ZstdCompressionDict(self.contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters(**PARAMETERS, write_checksum=False, write_content_size=False, write_dict_id=False)
                d.precompute_compress(compression_params=p)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        return np.array([sum(len(c.compress(x)) for x in chunks) for c in self._compressors])

    def predict(self, text: str | None, margin: float) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(normal(text))
        order = np.argsort(sizes, kind="stable")
        best = int(order[0])
        score = float(1 / np.exp(-(sizes - sizes[best]) / TEMPERATURE).sum())
        gap = float((sizes[order[1]] - sizes[best]) / sizes[best]) if len(order) > 1 else 1.0
        return self.names[best], score, gap, gap < margin


def learn(docs: DataFrame) -> Languages:
    """Dictionaries from (doc_id, text, lang), for each language that isn't null."""
    length = F.char_length("text")
    # The text is hashed as well, so rows without an id, or that share one, are as likely to be chosen as others.
    rows = docs.filter(F.col("lang").isNotNull() & (length > 0)).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"))
    counts = cut(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")))
    share = F.ceil(F.lit(DICTIONARY_BYTES) / F.least("n", F.lit(SAMPLE_ROWS))).cast("int")
    chosen = rows.join(by_size(counts, 64), "lang").filter(F.col("h") < 2.0 * SAMPLE_ROWS * (1 << 30) / F.col("n"))
    middle = F.substr("text", F.greatest(F.lit(1), ((length - share) / 2).cast("int") + 1), share)
    # Repeated rows count once, so a language has about twice SAMPLE_ROWS rows here, whatever the table holds.
    once = chosen.select("lang", "h", middle.alias("part")).groupBy("lang", "h").agg(F.min("part").alias("part"))
    picked = once.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "part"))), 1, SAMPLE_ROWS)["part"].alias("parts"))
    found = {r["lang"]: b" ".join(normal(x) for x in r["parts"])[:DICTIONARY_BYTES] for r in picked.collect()}
    return Languages({k: v for k, v in found.items() if len(v) >= 8})


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])


def _predictions(batches: Iterator[pa.RecordBatch], languages: Languages, margin: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [languages.predict(t, margin) for t in batch.column(1).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(columns, _OUT.types[1:], strict=True)]], schema=_OUT)


def identify(docs: DataFrame, folds: int = 3, held: int = 1, margin: float = MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) for each row of docs (doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    held_out = fold(F.col("doc_id"), folds) == held
    languages = learn(rows.filter(~held_out))
    found = rows.select("doc_id", "text").mapInArrow(partial(_predictions, languages=languages, margin=margin), "doc_id long, lang_pred string, score double, margin double, rejected boolean")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")
