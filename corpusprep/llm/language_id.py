"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. A
trigram binds its letters' vectors, permuted by their place, by element-wise
products. A document bundles (sums) its trigrams, a language bundles its
documents, and a document goes to the language prototype with the largest cosine.

Letters are lower-cased; every run of other characters is one blank. Prototypes
are sums of integers, so they don't depend on how rows are spread over tasks. They are a
table with a row for each language, however many there are; documents are held against
``BLOCK_LANGUAGES`` or so of them at a time, and only one block is in memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.session import materialize, release

DIMENSIONS = 1024
SEED = 20240917
#: Labelled documents a language learns from, at most (on average, as they are drawn by a hash of their ids).
TRAIN_DOCS = 5000
#: Prototypes of a block.
BLOCK_LANGUAGES = 2048
#: Languages with more labelled documents than they learn from that may be broadcast: some megabytes. Beyond that, a shuffled join.
BROADCAST_LANGUAGES = 100_000
#: A document is taken for text of no language if its score is below this share of what ``FLOOR_QUANTILE`` of the labelled documents have at least.
FLOOR_SHARE = 0.5
FLOOR_QUANTILE = 0.01
FLOOR_STEPS = 10_000
UNDETERMINED = "und"
_BLANK = 32
_PACK_CHARS = 1 << 18
_GRAMS = 2048
#: Texts of a batch that are Python objects and vectors at a time.
_TEXTS = 250
#: Unit vectors are summed as multiples of this step.
_STEP = 2.0**-24


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to lower-case letter, or a blank."""
    # from an iterator: a list of them all would stay in the worker's memory
    return np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else _BLANK for i in range(0x110000)), np.uint32, 0x110000)


@lru_cache(maxsize=1 << 16)
def _letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    return (np.random.default_rng([seed, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)


def _gram_vectors(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Bound vectors of trigrams, each given as three code points of 21 bits."""
    out = np.ones((len(grams), dimensions), dtype=np.int8)
    for place in range(3):
        codes, at = np.unique((grams >> np.uint64(21 * place)) & np.uint64(0x1FFFFF), return_inverse=True)
        table = np.stack([np.roll(_letter_vector(int(c), dimensions, seed), 2 - place) for c in codes])
        out *= table[at]
    return out.astype(np.float32)


def _packs(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    rows: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), _PACK_CHARS):
            piece = text[max(0, at - 2) : at + _PACK_CHARS]
            codes = _letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
            blank = codes == _BLANK
            codes = codes[~(blank & np.append(False, blank[:-1]))]
            if size + len(codes) > _PACK_CHARS and parts:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(codes)
            size += len(codes)
    if parts:
        yield rows, parts


def document_vectors(texts: list[str | None], dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Bundled trigrams of each text; zero without a letter."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for rows, parts in _packs(texts):
        line = np.concatenate([np.concatenate([[_BLANK], p, [_BLANK]]) for p in parts]).astype(np.uint64)
        doc = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
        grams = line[:-2] | line[1:-1] << np.uint64(21) | line[2:] << np.uint64(42)
        # a trigram stays in its document and has a letter in the middle
        whole = (doc[:-2] == doc[2:]) & (line[1:-1] != _BLANK)
        kinds, at = np.unique(grams[whole], return_inverse=True)
        if not len(kinds):
            continue
        cells, counts = np.unique(doc[:-2][whole] * len(kinds) + at, return_counts=True)
        doc_of, kind = np.divmod(cells, len(kinds))
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(0, len(kinds) + _GRAMS, _GRAMS))
        vectors = np.zeros((len(parts), dimensions), dtype=np.float32)
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            some = order[lo:hi]
            block = kinds[k * _GRAMS : (k + 1) * _GRAMS]
            table = np.zeros((len(parts), len(block)), dtype=np.float32)
            table[doc_of[some], kind[some] - k * _GRAMS] = counts[some]
            vectors += table @ _gram_vectors(block, dimensions, seed)
        np.add.at(out, rows, vectors)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def _training(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int | None, seed: int) -> DataFrame:
    """text, lang of the rows that are learned from; all labelled ones for ``None``."""
    rows = labelled.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if train_docs is None:
        return rows.select("text", "lang")
    counts = materialize(rows.groupBy(F.col("lang").alias("c_lang")).agg(F.count("*").alias("n")).where(F.col("n") > train_docs))
    if counts.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 31)) / (1 << 31)
    common = rows.join(counts, F.col("lang") == F.col("c_lang"), "left")
    return common.where(F.col("n").isNull() | (draw < train_docs / F.col("n"))).select("text", "lang")


def learn_prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", train_docs: int | None = TRAIN_DOCS) -> DataFrame:
    """lang, totals (a sum for each dimension) of each language with a labelled text that has a letter.

    A language with more than ``train_docs`` rows learns from about that many,
    drawn by a hash of the id; from all for ``None``.
    """
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * dimensions), pa.array(np.arange(dimensions)), pa.array(total)], ["lang", "dim", "total"]
                )
            sums.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for at in range(0, len(langs), _TEXTS):
                some = langs[at : at + _TEXTS]
                texts = batch.column("text").slice(at, _TEXTS).to_pylist()
                steps = np.rint(_unit(document_vectors(texts, dimensions, seed)) / _STEP).astype(np.int64)
                for lang in set(some.tolist()):
                    own = steps[some == lang]
                    if own.any():
                        sums[lang] = sums.get(lang, 0) + own.sum(axis=0)
                if len(sums) > BLOCK_LANGUAGES:  # however many labels a task sees
                    yield from flushed()
        yield from flushed()

    sample = _training(labelled, id_col, text_col, lang_col, train_docs, seed)
    parts = sample.mapInArrow(bundle, "lang string, dim bigint, total bigint").groupBy("lang", "dim").agg(F.sum("total").alias("total"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "total"))), lambda x: x["total"])
    return materialize(parts.groupBy("lang").agg(ordered.alias("totals")))


def prototype_blocks(model: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """Prototypes by language, a block at a time: one block at least, be it empty."""
    blocks = max(1, -(-model.count() // BLOCK_LANGUAGES))
    for block in range(blocks):
        mine = model.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block)
        yield {r["lang"]: _unit(np.array(r["totals"], dtype=np.float64)[None, :])[0] for r in mine.orderBy("lang").toLocalIterator()}


def predicted(text: Column, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED) -> Column:
    """Struct of lang and score (cosine with its prototype, at least 0) of a text column.

    ``und`` with score 0 for a null text and one without a letter. Ties go to the first language in order.
    """
    names = np.array([*prototypes, UNDETERMINED], dtype=object)
    table = np.stack(list(prototypes.values())).T if prototypes else np.zeros((dimensions, 0))

    @F.arrow_udf("lang string, score double")
    def score(texts: pa.Array) -> pa.Array:
        lang, best = [], []
        for at in range(0, len(texts), _TEXTS):
            vectors = document_vectors(texts.slice(at, _TEXTS).to_pylist(), dimensions, seed)
            cosine = np.hstack([_unit(vectors) @ table, np.full((len(vectors), 1), -2.0)])
            pick = np.where(vectors.any(axis=1), cosine.argmax(axis=1), len(names) - 1)
            lang += names[pick].tolist()
            best += np.clip(cosine[np.arange(len(pick)), pick], 0, 1).tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(best, pa.float64())], ["lang", "score"])

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: CRC-32 of its id as text leaves 1 when divided by 3. A null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_language(docs: DataFrame, model: DataFrame, text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED,
                  out_col: str = "language") -> DataFrame:
    """``docs`` with a struct of lang and score from all prototypes of ``model``."""
    found = list(itertools.islice(prototype_blocks(model), 2))
    text = F.col(text_col).cast("string")
    if len(found) == 1:
        return docs.withColumn(out_col, predicted(text, found[0], dimensions, seed))
    number = "_row_number"
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()))
    best = None
    for block in prototype_blocks(model):
        if not block:
            continue
        own = materialize(rows.select(F.col(number).alias("_n"), predicted(text, block, dimensions, seed).alias("p")))
        if best is not None:  # the larger score, then the first language
            rank = F.struct(-F.col("p.score"), F.col("p.lang") == UNDETERMINED, F.col("p.lang"))
            both = best.unionByName(own)
            merged = materialize(both.groupBy("_n").agg(F.min_by("p", rank).alias("p")))
            release(best, own)
            own = merged
        best = own
    return rows.join(best.withColumnRenamed("p", out_col), F.col(number) == F.col("_n")).drop(number, "_n")


def score_floor(judged: DataFrame, label_col: str = "lang", language_col: str = "language") -> float:
    """``FLOOR_SHARE`` of the score that all but ``FLOOR_QUANTILE`` of the labelled documents with a letter reach; 0 without any.

    ``judged``: all documents, with the struct that ``with_language`` adds.
    """
    scored = judged.where(F.col(label_col).isNotNull() & (F.col(f"{language_col}.lang") != UNDETERMINED))
    # exact, so that reruns agree, over at most as many values as steps
    least = scored.agg(F.percentile(F.round(F.col(f"{language_col}.score") * FLOOR_STEPS) / FLOOR_STEPS, FLOOR_QUANTILE)).first()[0]
    return FLOOR_SHARE * (least or 0.0)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those of no language: null texts, texts without a letter, and texts that are far from every language.

    Prototypes are learned from all labelled documents, and how far is taken from the scores of all of them
    (``score_floor``). Without any, only the first two go. Documents are scored once: they are written with their scores.
    """
    model = learn_prototypes(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, train_docs=None)
    text = F.col(text_col).cast("string")
    if model.isEmpty():
        return docs.where(predicted(text, {"": np.zeros(DIMENSIONS)})["lang"] != UNDETERMINED)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text.alias("_text"), F.col(lang_col).alias("_label"))
    judged = with_language(rows, model, "_text", out_col="_language").drop("_text")
    judged = materialize(judged.where(F.col("_language.lang") != UNDETERMINED))
    floor = score_floor(judged, "_label", "_language")
    return judged.where(F.col("_language.score") >= floor).select("_row.*")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       dimensions: int = DIMENSIONS, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the labelled documents that aren't held out (a null id isn't used).

    Each row is judged by its text alone, so repeated rows get the same answer. An empty table has an empty result.
    """
    learn = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    model = learn_prototypes(learn, dimensions, SEED, id_col, text_col, lang_col, train_docs)
    rows = with_language(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "text", dimensions, out_col="p")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
