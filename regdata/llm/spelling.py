"""Spelling variants: words one edit apart, grouped under their commonest form.

Letters are hashed to a few symbols. The vocabulary is thereby reduced, and so is the number of
edits: every word generates the full one-edit neighbourhood of its reduced form (one symbol
deleted, replaced or inserted, and the form itself, since an edit between letters of one symbol
leaves it as it is), and these are joined with the reduced forms of all words. Two words one edit apart
have reduced forms at most one edit apart, so no pair is missed; what the join proposes is
verified on the original words.

Reduced forms travel as 64-bit hashes. The number of symbols is the sixth root of the number of words and 2
more, so that about as many reduced forms as words exist at the shortest length and a form stays the form of a few
words, however large the vocabulary. Neighbours that are no word's reduced form are dropped where they are
generated, by a bitmap of the reduced vocabulary of at most ``BITMAP`` bits (32 MB), the
only thing that is broadcast; a fuller bitmap lets more through to the join and changes no result.

Defined results: a null text has no words. A document without an id counts, but none of its words is
edited. Repeated rows count as often as they occur. Without words the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.llm.arrow import add_columns, column, list_array, share_code, text_of
from regdata.session import materialise

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
BITMAP = 1 << 28
HELD = 200_000  # words that a task counts before it hands them on
GROUP = 4096  # words whose neighbours are generated at once
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_UPPER = {c: c + 32 for c in range(65, 91)}
U64 = np.uint64


def lowered(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_UPPER)


def unedited(doc_id: object, word: str) -> str:
    return word


def with_slips(doc_id: object, word: str, rate: int = 199) -> str:
    """The word, without one code point where ``rate`` divides the crc32 of document and word."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % rate:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Callable[[object, str], str] = unedited,
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word``, ``n``: runs of letters, A-Z lower-cased, after ``edit``, of at least so many code points and occurrences."""
    share_code(docs.sparkSession)
    # a shorter run is none after an edit that only deletes; it is skipped unless edits may lengthen it
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{1 if edit not in (unedited, with_slips) else least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, t in zip(column(batch, "_k"), column(batch, "_t")):
                doc = i.as_py()
                for word, n in Counter(runs.findall(text_of(t))).items():
                    word = edit(doc, lowered(word))
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) >= HELD:
                    yield handed()
                    total.clear()
        if total:
            yield handed()

    parts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbols(words: list[str], k: int) -> np.ndarray:
    """Symbols below k of the letters of words of one length, a row for each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
    return ((points.astype(U64) * U64(_BASE)) >> U64(40)) % U64(k)


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_BASE, i, 1 << 64) for i in range(n)], dtype=U64)


def _values(k: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=13)).integers(1, 2**63, k, dtype=U64) * U64(2) + U64(1)


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of one length, at most GROUP at a time."""
    length = np.array([len(w) for w in words])
    order = np.argsort(length, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(words) else []:
        for at in range(0, len(own), GROUP):
            yield own[at : at + GROUP]


def reduced(words: list[str], k: int) -> np.ndarray:
    """Hash of the reduced form of every word."""
    out = np.zeros(len(words), dtype=U64)
    for own in _by_length(words):
        s = symbols([words[i] for i in own], k)
        out[own] = (_values(k)[s] * _powers(s.shape[1])).sum(axis=1, dtype=U64)
    return out


def neighbourhoods(words: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes) of the reduced forms and all their one-edit neighbours, each once per word.

    A symbol is deleted from the end of a run of equals only, and inserted only before another one or at the end.
    """
    value = _values(k)
    for own in _by_length(words):
        s = symbols([words[i] for i in own], k)
        m, length = s.shape
        power, row = _powers(length + 1), np.repeat(np.arange(m), length).reshape(m, length)
        before = np.zeros((m, length + 1), dtype=U64)
        np.cumsum(value[s] * power[:length], axis=1, dtype=U64, out=before[:, 1:])
        form = before[:, -1:]
        after = form - before  # from each place on
        yield own, form[:, 0]
        last = np.ones((m, length), dtype=bool)
        last[:, :-1] = s[:, :-1] != s[:, 1:]
        yield own[row[last]], (before[:, :-1] + after[:, 1:] * U64(_INVERSE))[last]
        for a in range(k):
            other = s != a
            yield own[row[other]], (form + (value[a] - value[s]) * power[:length])[other]
            inserted = before + value[a] * power + after * U64(_BASE)
            yield own[row[other]], inserted[:, :-1][other]
            yield own, inserted[:, -1]


def bitmap(forms: DataFrame, n: int) -> np.ndarray:
    """Bits at the hashes of all reduced forms; its length is bounded whatever n is."""
    bits = min(BITMAP, 1 << max(12, (32 * n).bit_length()))
    place = F.shiftrightunsigned("_form", 64 - bits.bit_length() + 1)
    rows = forms.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")
    )
    found = rows.toArrow()
    out = np.zeros(bits // 64, dtype=U64)
    out[np.asarray(found.column("at"))] = np.asarray(found.column("bits")).view(U64)
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: every word with every word one edit apart, in both directions."""
    count = words.count()
    k = max(4, int(count ** (1 / 6)) + 2)
    long = T.LongType()
    forms = materialise(add_columns(words, lambda b: [pa.array(reduced(column(b, "word").to_pylist(), k).view(np.int64))], [("_form", long)]))
    shared = words.sparkSession.sparkContext.broadcast(bitmap(forms, count))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        map_of = shared.value
        shift = U64(64 - (len(map_of) * 64).bit_length() + 1)
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for row, h in neighbourhoods(column(batch, "word").to_pylist(), k):
            place = h >> shift
            hit = (map_of[place >> U64(6)] >> (place & U64(63))) & U64(1) == 1
            rows.append(row[hit])
            hashes.append(h[hit])
        row, h = np.concatenate(rows), np.concatenate(hashes)
        order = np.argsort(row, kind="stable")
        return [list_array(h[order].view(np.int64), np.bincount(row, minlength=batch.num_rows))]

    each = add_columns(forms.select("word", "n"), make, [("_keys", T.ArrayType(long))])
    each = each.select("word", "n", F.explode("_keys").alias("_form"))
    others = forms.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "_form")
    return each.join(others, "_form").where(F.levenshtein("word", "near", 1) == 1).drop("_form")


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of a vocabulary ``word``, ``n`` without repeats.

    The form of a word is its commonest near word (of equals the smallest) if that is ``times`` as common
    as itself; forms are followed to the last, in rounds that double the steps.
    """
    words = materialise(words)
    top = near_pairs(words).groupBy("word", "near_n").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("m"))
    top = top.groupBy("word").agg(F.sum("m").alias("n_near"), F.max_by("near", "near_n").alias("near"), F.max("near_n").alias("near_n"))
    told = words.join(top, "word", "left")
    is_form = F.col("near_n") >= F.lit(times) * F.col("n")
    told = materialise(told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    ))
    links = told.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialise(links.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        links = step.select("word", "root")
        if not step.where("_moved").limit(1).count():
            break
    return told.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Callable[[object, str], str] = unedited) -> DataFrame:
    """Spelling groups of the words of a corpus."""
    return grouped(word_counts(docs, key, text, edit))
