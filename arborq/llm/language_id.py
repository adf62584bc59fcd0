"""Language identification by compression with per-language raw-content dictionaries.

A text is compressed with zstandard once for each language, each time with a dictionary of that
language's raw text in front; the smallest result names the language. A narrow margin between the
two smallest rejects the decision (``accepted`` is false). Dictionaries are fitted on a bounded
sample: ``dict_bytes`` bytes for each language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fold, table
from ._words import chunks

#: Texts are compressed in pieces of so many bytes, so that a dictionary counts for all of a long text.
BLOCK = 1 << 12
_NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, and one space for each run of anything but letters."""
    return _NO_LETTERS.sub(" ", text.lower())


def dictionaries(docs: DataFrame, *, dict_bytes: int = 1 << 16, per_text: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content of each non-null language of ``docs``: ``dict_bytes`` bytes, or all there is.

    Texts are taken in the order of a hash of their ids, of each a slice of ``per_text`` characters at a place that
    another hash gives, anywhere in the text, until there are ``dict_bytes`` bytes. Counts by language tell the share of rows to
    look at, so that no language's rows meet in one task; it is doubled where texts were too short. Languages come in
    falling order of their counts."""
    room = F.greatest(F.length(text_col) - per_text + 1, F.lit(1))
    piece = F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.lit("place"), F.col(id_col)), room) + 1).cast("int"), F.lit(per_text))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), piece.alias("text"))
    by_count = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()  # one row for each language
    out = {r["lang"]: b"" for r in by_count}
    todo, most = {r["lang"]: r["n"] for r in by_count}, 4 * (dict_bytes // per_text + 1)
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1))
    while todo:
        # the languages' bounds go into the scan as a literal: no text moves before it is chosen
        share = {lang: min(1.0, most / n) for lang, n in todo.items()}
        bound = F.create_map(*[F.lit(x) for lang in todo for x in (lang, int(share[lang] * (1 << 30)))])
        near = rows.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(bound, F.col("lang")))
        taken = near.withColumn("before", before).where(f"coalesce(before, 0) < {dict_bytes}")
        texts: dict[str, list[str]] = {lang: [] for lang in todo}
        for r in taken.orderBy("lang", "h", "text").collect():  # about dict_bytes for each language
            texts[r["lang"]].append(plain(r["text"]))
        for lang, parts in texts.items():
            raw = " ".join(parts).encode()[:dict_bytes]
            if len(raw) == dict_bytes or share[lang] == 1.0:
                out[lang] = raw
                del todo[lang]
        most *= 4
    return out


class CompressionClassifier:
    def __init__(self, content: dict[str, bytes], level: int = 9):
        import zstandard

        self.langs = list(content)
        make = [zstandard.ZstdCompressionDict(content[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in self.langs]
        for d in make:
            d.precompute_compress(level=level)
        self.coders = [zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False) for d in make]

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text with each language's dictionary."""
        raw = plain(text).encode()
        return [sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in self.coders]


_LETTER = re.compile(r"[^\W\d_]")


def identify(docs: DataFrame, content: dict[str, bytes], *, margin: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score, accepted, margin)`` of every row.

    ``lang_pred`` is the language of the smallest result (ties: the one with more texts learned), ``und`` where the text is
    null or has no letter, or no language was learned. ``margin`` is by how much of its size the second smallest is larger;
    ``score`` grows with it from 0.5 to 1 (0 for ``und``); ``accepted`` is false for ``und`` and for margins under the
    parameter. Null and repeated ids are carried; an empty table gives none."""

    def run(batches):
        coder = CompressionClassifier(content)
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                out = []
                for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                    if not text or not coder.langs or not _LETTER.search(text):
                        out.append(("und", 0.0, False, 0.0))
                        continue
                    sizes = coder.sizes(text)
                    best = int(np.argmin(sizes))
                    rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
                    gap = (rest - sizes[best]) / rest
                    out.append((coder.langs[best], float(1 / (1 + np.exp(-40 * gap))), gap >= margin, gap))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True))], ["id", "lang_pred", "score", "accepted", "margin"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, accepted boolean, margin double").withColumnRenamed("id", id_col)


def op3_language(spark, sf_dir):
    """Languages of all ``documents``, learned from those whose crc32 fold (modulo 4) is not 2."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, dictionaries(docs.where(fold(F.col("doc_id"), 4) != 2)))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted", "margin")
