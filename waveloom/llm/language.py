"""Language identification by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, utf8

_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def grams(text: str, longest: int = 3) -> np.ndarray:
    """All n-grams of 1 to ``longest`` (at most 3) characters of the lower-cased letter runs, packed in integers.

    Runs of anything but letters and marks count as one blank, also at both ends; n-grams have a blank at
    their first or last place only, and the single blank is left out. 21 bits hold a character.
    """
    c = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    blank = c == 32
    out = [c[~blank]]
    if longest >= 2:
        out.append((c[:-1] << 21) | c[1:])
    if longest >= 3:
        out.append(((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[~blank[1:-1]])
    return np.concatenate(out)


def ranked(g: np.ndarray, size: int) -> np.ndarray:
    """The most frequent ``size`` n-grams, most frequent first, ties to the smaller packed value."""
    if not len(g):
        return g
    g = np.sort(g)
    heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    counts = np.diff(np.append(heads, len(g)))
    return g[heads[np.argsort(-counts, kind="stable")[:size]]]


def profiles(docs: DataFrame, size: int = 300, lang_col: str = "lang", text_col: str = "text", longest: int = 3) -> DataFrame:
    """lang, gram, rank (from 0): the ``size`` most frequent n-grams of all texts of each language.

    Every text is counted: batches are summed per (language, n-gram) before the shuffle, so a language
    with most rows sends as many rows as it has different n-grams per task. Rows without text or
    language are left out. Ties go to the smaller packed n-gram.
    """

    def count(batches):
        held: dict = {}
        kept = 0

        def flush():
            keys = list(held)
            parts = [_sum(held[k]) for k in keys]
            out = pa.RecordBatch.from_pydict({
                "lang": pa.array([k for k, (g, _) in zip(keys, parts, strict=True) for _ in range(len(g))], pa.string()),
                "gram": np.concatenate([g for g, _ in parts]), "n": np.concatenate([n for _, n in parts])})
            held.clear()
            return out

        for batch in batches:
            names = batch.schema.names
            texts = utf8(batch.column(names.index(text_col))).to_pylist()
            langs = batch.column(names.index(lang_col)).to_pylist()
            by: dict = {}
            for lang, text in zip(langs, texts, strict=True):
                g = grams(text, longest)
                by.setdefault(lang, []).append(g)
                kept += len(g)
                if kept > 4_000_000:
                    for k, v in by.items():
                        held[k] = [_sum([*held.get(k, []), (np.concatenate(v), None)])]
                    by, kept = {}, 0
            for k, v in by.items():
                held[k] = [_sum([*held.get(k, []), (np.concatenate(v), None)])]
            kept = 0
        if held:
            yield flush()

    counted = (docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
               .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # one row per (language, n-gram) is left; the filter on the rank is applied before the shuffle as well
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


def _sum(parts) -> tuple[np.ndarray, np.ndarray]:
    """Add up (n-grams, counts) tables; counts may be None for raw n-grams."""
    g = np.concatenate([p[0] for p in parts]) if len(parts) > 1 else parts[0][0]
    n = np.concatenate([np.ones(len(p[0]), np.int64) if p[1] is None else p[1] for p in parts])
    by = np.argsort(g, kind="stable")
    g, n = g[by], n[by]
    heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[heads], (np.add.reduceat(n, heads) if len(heads) else n)


def predict(docs: DataFrame, learned: list[tuple[str, int, int]], size: int = 300, id_col: str = "doc_id", text_col: str = "text",
            longest: int = 3, others: list[str] | None = None) -> DataFrame:
    """id, ``others``, lang_pred, score: the language whose profile is nearest to the text's own profile.

    The distance is the sum of |rank in the text - rank in the profile| over the text's ``size`` most
    frequent n-grams; an n-gram that the profile lacks counts ``size``. ``score`` is 1 - nearest /
    mean of all the others' distances (1 - distance / worst case where one language is known),
    limited to 0..1. Ties go to the language first in the alphabet. Null texts, texts without a
    letter, and all texts where nothing was learned get 'und' and 0. Repeated rows are judged alike, null
    ids pass through.
    """
    others = others or []
    langs = sorted({r[0] for r in learned})
    box = docs.sparkSession.sparkContext.broadcast((langs, learned))  # at most ``size`` rows per language

    def work(batches):
        names_, rows = box.value
        number = {x: k for k, x in enumerate(names_)}
        known = np.unique(np.array([r[1] for r in rows], np.int64))
        rank = np.full((len(names_), len(known) + 1), -1, np.int64)
        for x, g, r in rows:
            rank[number[x], np.searchsorted(known, g)] = r
        for batch in batches:
            cols = batch.schema.names
            texts = utf8(batch.column(cols.index(text_col))).to_pylist()
            pred, score = [], []
            for text in texts:
                g = ranked(grams(text, longest), size) if names_ and _LETTER.search(text) else []
                if not len(g):
                    pred.append("und")
                    score.append(0.0)
                    continue
                at = np.searchsorted(known, g)
                at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != g)] = len(known)
                there = rank[:, at]
                d = np.where(there < 0, size, np.abs(there - np.arange(len(g)))).sum(1)
                k = int(np.argmin(d))
                against = (d.sum() - d[k]) / (len(d) - 1) if len(d) > 1 else size * len(g)
                pred.append(names_[k])
                score.append(float(min(1.0, max(0.0, 1 - d[k] / against))) if against else 0.0)
            yield pa.RecordBatch.from_pydict({c: batch.column(cols.index(c)) for c in [id_col, *others]} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [id_col, *others])
    return docs.select(id_col, text_col, *others).mapInArrow(work, schema + ", lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Learn from documents whose crc32(doc_id as text) mod 5 is not 0; predict all."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"))
    learned = [tuple(r) for r in profiles(docs.filter(~F.col("held_out"))).collect()]  # 300 rows per language
    return predict(docs, learned, others=["held_out"]).select("doc_id", "held_out", "lang_pred", "score")
