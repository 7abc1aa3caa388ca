"""Collocations by Rabin-Karp fingerprints.

Prefix polynomials over the bytes of many texts give every word a hash, prefix polynomials over
the words give every run of words a fingerprint, whatever its length, in a few array operations.
Tasks count fingerprints, and one row for each different one goes into the shuffle with its
count, a pointer to an occurrence and 32 bits of an independent hash, which keeps runs apart whose
fingerprints collide. Longer runs are counted only where both shorter runs inside them are
frequent, as told by a bit map of fixed size. Text is fetched for frequent phrases only, by
their pointers; a phrase is taken if its fingerprint and hash, worked out again, are those counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gainsieve.llm.words import mixed
from gainsieve.session import materialise

_U64 = np.uint64
#: Bytes hashed at once, runs of words a task counts before it sends them.
CHUNK, HELD = 1 << 20, 3_000_000
#: Bits of the map of frequent runs (16 MB), whatever the size of the input.
MAP_BITS = 27
#: A pointer is the top of a row's hash and the number of a word in its text.
PLACE_BITS = 30
NO_LANG = "und"

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ENDS = np.isin(np.arange(256), [*b".,;:!?", *range(10, 14)])
_SOLID = ~(_ENDS | np.isin(np.arange(256), [9, 32]))
_VALUES = [mixed(np.arange(1, 257, dtype=_U64) * _U64(seed))[_LOWER] for seed in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)]
_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814D)


@lru_cache(maxsize=8)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse."""
    powers, inverse = np.full(size, base, _U64), np.full(size, pow(base, -1, 1 << 64), _U64)
    powers[0] = inverse[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomials of ``values`` and what takes them back to place 0."""
    powers, inverse = _powers(max(CHUNK, 1 << len(values).bit_length()), base)
    sums = np.zeros(len(values) + 1, _U64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return sums, inverse


def _words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, two hashes and the sentence of every word of texts laid end to end; ``firsts`` are their starts."""
    solid = _SOLID[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    begins[firsts] = solid[firsts]
    inner = firsts[firsts > 0]
    ends[inner - 1] = solid[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = []
    for values in _VALUES:
        sums, inverse = _prefix(values[data], _BASES[0])
        hashes.append(mixed((sums[stops] - sums[starts]) * inverse[starts]))
    return starts, *hashes, np.cumsum(_ENDS[data])[starts]


def _part_end(data: np.ndarray, at: int, end: int) -> int:
    """Where a part that starts ``at`` ends: after a chunk, but not inside a word."""
    stop = at + CHUNK
    while stop < end:
        apart = np.flatnonzero(~_SOLID[data[at:stop]])
        if len(apart):
            return at + int(apart[-1]) + 1
        stop += CHUNK
    return end


def tokenised(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch, some at once: row, number in its text, two hashes and sentence of every word.

    Words of one sentence share its number, which grows. A long text comes whole, hashed in parts.
    """
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        at, end, parts, sentences = int(offsets[row]), int(offsets[last]), [], 0
        while at < end:
            stop = _part_end(data, at, end)
            firsts = offsets[row:last] - at if last > row + 1 else np.zeros(1, np.int64)
            starts, first, second, sentence = _words(data[at:stop], firsts[firsts < stop - at])
            rows = np.searchsorted(offsets[row : last + 1], starts + at, "right") - 1 if last > row + 1 else np.zeros(len(starts), np.int64)
            parts.append((rows, first, second, sentence + rows + sentences))
            sentences += int(_ENDS[data[at:stop]].sum())
            at = stop
        if parts:
            rows, first, second, sentence = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield rows + row, np.arange(len(rows)) - np.searchsorted(rows, rows), first, second, sentence
        row = last


@cache
def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def fingerprints(first: np.ndarray, second: np.ndarray, seeds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for the run of ``size`` words that starts at each word but the last ones."""
    count = max(len(first) - size + 1, 0)
    found = []
    for hashes, base in zip((first, second), _BASES, strict=True):
        sums, inverse = _prefix(hashes, base)
        own = (sums[size : size + count] - sums[:count]) * inverse[:count]
        found.append(mixed(own + seeds[:count] + _U64(size)))
    return found[0], found[1] >> _U64(32)


def _marked(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    at = found >> _U64(64 - MAP_BITS)
    return (bits[(at >> _U64(3)).astype(np.int64)] >> (at & _U64(7)).astype(np.uint8)) & 1 > 0


def _counted(held: list[tuple[np.ndarray, ...]], pointed: bool) -> pa.RecordBatch:
    """One row for each different run: fingerprint, hash, count and the least pointer."""
    fp, check, pointer = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(fp)
    fp, check, pointer = fp[order], check[order], pointer[order]
    if (collides := (fp[1:] == fp[:-1]) & (check[1:] != check[:-1])).any():
        touched = np.isin(fp, fp[1:][collides])
        order = np.concatenate([np.flatnonzero(~touched), (at := np.flatnonzero(touched))[np.lexsort((check[at], fp[at]))]])
        fp, check, pointer = fp[order], check[order], pointer[order]
    firsts = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])))
    counts = np.diff(np.append(firsts, len(fp)))
    columns = [fp[firsts].view(np.int64), check[firsts].astype(np.int64), counts, np.minimum.reduceat(pointer, firsts).view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["fp", "chk", "n", "pointer"])


def _runs(docs: DataFrame, size: int, shorter: tuple | None, held_runs: int) -> DataFrame:
    """``fp, chk, n, pointer`` of the runs of ``size`` words, a row for each different one and chunk.

    ``shorter`` is the broadcast map of the frequent runs of one word less. Words have no pointer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            seeds = np.array([lang_seed(lang) for lang in batch.column(0).to_pylist()], _U64)
            ids = batch.column(1).to_numpy().view(_U64) >> _U64(PLACE_BITS) << _U64(PLACE_BITS)
            for rows, number, first, second, sentence in tokenised(batch.column(2)):
                own = seeds[rows]
                fp, check = fingerprints(first, second, own, size)
                at = np.arange(len(fp))
                if size > 1:
                    marked = _marked(np.frombuffer(shorter.value, np.uint8), fingerprints(first, second, own, size - 1)[0])
                    at = np.flatnonzero(marked[:-1][: len(fp)] & marked[1:][: len(fp)] & (sentence[: len(fp)] == sentence[size - 1 :][: len(fp)]))
                held.append((fp[at], check[at], ids[rows[at]] | number[at].astype(_U64)))
                if sum(len(h[0]) for h in held) >= held_runs:
                    yield _counted(held, size > 1)
                    held = []
        if sum(len(h[0]) for h in held):
            yield _counted(held, size > 1)

    return docs.mapInArrow(run, "fp long, chk long, n long, pointer long")


def _bit_map(frequent: DataFrame) -> bytes:
    """A bit for each fingerprint that begins as a frequent one does; of one size for any input."""
    at = F.shiftrightunsigned("fp", 64 - MAP_BITS)
    word = F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")
    words = frequent.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(word).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.astype("<i8").tobytes()


def frequent_runs(docs: DataFrame, longest: int, least: int, held_runs: int = HELD) -> list[DataFrame]:
    """For 1 to ``longest`` words, the stored ``fp, chk, n, pointer`` of the runs that occur ``least`` times or more.

    ``docs`` has ``lang, row, text``; ``row`` is a hash of the others.
    """
    spark, found, shorter = docs.sparkSession, [], None
    for size in range(1, longest + 1):
        runs = _runs(docs, size, shorter, held_runs)
        # Unsigned order, so that pointers of few rows win and few texts are fetched.
        least_pointer = F.min(F.col("pointer").bitwiseXOR(F.lit(-(1 << 63)))).alias("pointer")
        total = runs.groupBy("fp", "chk").agg(F.sum("n").alias("n"), least_pointer).where(F.col("n") >= least)
        found.append(materialise(total.withColumn("pointer", F.col("pointer").bitwiseXOR(F.lit(-(1 << 63)))).withColumn("size", F.lit(size))))
        if size < longest:
            shorter = spark.sparkContext.broadcast(_bit_map(found[-1]))
    return found


_PART = "struct<fp:long,chk:long>"
_PHRASES = f"lang string, fp long, chk long, size int, phrase string, heads array<{_PART}>, tails array<{_PART}>, inner array<{_PART}>"


def _word_texts(text: bytes) -> list[bytes]:
    """The words of a text in lower case, in order."""
    return text.lower().translate(bytes(b if s else 32 for b, s in enumerate(_SOLID))).split(b" ")


def _phrases(texts: DataFrame, longest: int) -> DataFrame:
    """The phrases that the pointers (``wanted``) of each text name, with the fingerprints of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("fp", pa.int64()), ("chk", pa.int64())])
        for batch in batches:
            out = []
            for row, (lang, text, wanted) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                words = [w for w in _word_texts(text.encode()) if w]
                for _, _, first, second, _ in tokenised(batch.column(1).slice(row, 1)):
                    seeds = np.full(len(first), lang_seed(lang), _U64)
                    found = [tuple(a.view(np.int64) for a in fingerprints(first, second, seeds, size)) for size in range(1, longest + 1)]
                    of = lambda at, size: {"fp": int(found[size - 1][0][at]), "chk": int(found[size - 1][1][at])}
                    for want in wanted:
                        at, size = want["at"], want["size"]
                        if at + size > len(words) or of(at, size) != {"fp": want["fp"], "chk": want["chk"]}:
                            continue  # another text with the same beginning of its hash
                        heads = [of(at, k) for k in range(1, size)]
                        tails = [of(at + k, size - k) for k in range(1, size)]
                        inner = [of(at + i, k) for k in range(2, size) for i in range(size - k + 1)]
                        out.append((lang, want["fp"], want["chk"], size, b" ".join(words[at : at + size]).decode(), heads, tails, inner))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.list_(kinds)] * 3]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            names = ["lang", "fp", "chk", "size", "phrase", "heads", "tails", "inner"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return texts.mapInArrow(run, _PHRASES)


def _fetched(docs: DataFrame, candidates: DataFrame, longest: int) -> DataFrame:
    """The phrases of ``candidates`` from the texts they point to.

    Only rows whose hash is marked in a bit map of fixed size are shuffled, equal rows once for each task.
    """
    spark = docs.sparkSession
    wanted = candidates.select(
        F.shiftrightunsigned("pointer", PLACE_BITS).alias("doc"),
        F.struct("fp", "chk", "size", F.col("pointer").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("at")).alias("want"),
    )
    wanted = materialise(wanted.groupBy("doc").agg(F.collect_list("want").alias("wanted")))  # at most the runs of one text
    marks = spark.sparkContext.broadcast(_bit_map(wanted.select(F.shiftleft("doc", PLACE_BITS).alias("fp"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(np.frombuffer(marks.value, np.uint8), batch.column(1).to_numpy().view(_U64))))

    pointed = docs.mapInArrow(run, docs.schema).distinct()
    texts = pointed.withColumn("doc", F.shiftrightunsigned("row", PLACE_BITS)).join(wanted, "doc").select("lang", "text", "wanted")
    return _phrases(texts, longest).dropDuplicates(["fp", "chk"])


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) without rounding, in 38 digits."""
    a, n, left, right = (f"cast({c} AS decimal(19,0))" for c in (a, n, left, right))
    return F.expr(f"cast((1000 * {a} * {n}) div ({left} * {right}) AS long)")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, cover: int = 100, best: int = 2000, held_runs: int = HELD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` collocations of every language.

    Texts are cut at ``.,;:!?`` and line ends, then at blanks and tabs, A-Z in lower case. A
    candidate is a run of 2 to ``longest`` words that occurs ``least`` times or more (``a``). It is
    cut in two where ``floor(1000 a n / (l r))`` is least, then first, with ``l`` and ``r`` the
    frequencies of the parts and ``n`` all words of the language. Candidates inside a longer
    candidate that occurs in ``cover`` percent of their places or more are dropped.

    A null language is ``und``, null and empty texts have no words, repeated rows all count, ties
    go to the greater ``a``, then to the smaller phrase in UTF-8. An empty table gives no row. Texts
    may be of any length. Runs are told apart by 96 bits, of which 64 are verified again with
    the text of the one occurrence fetched.
    """
    clean = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = clean.select("lang", F.xxhash64("lang", "text").alias("row"), "text")
    levels = frequent_runs(docs, longest, least, held_runs)
    counts = reduce(DataFrame.unionByName, levels)
    phrases = materialise(_fetched(docs, reduce(DataFrame.unionByName, levels[1:]), longest).join(counts.select("fp", "chk", F.col("n").alias("a")), ["fp", "chk"]))
    cuts = phrases.select("fp", "chk", F.posexplode(F.arrays_zip("heads", "tails")).alias("k", "cut"))
    cuts = cuts.select("fp", "chk", "k", "cut.heads", "cut.tails")
    for side, name in (("heads", "l"), ("tails", "r")):
        part = counts.select(F.struct("fp", "chk").alias(side), F.col("n").alias(name))
        cuts = cuts.join(part, side).drop(side)
    words = _word_totals(clean)
    scored = cuts.join(phrases.select("fp", "chk", "lang", "a"), ["fp", "chk"]).join(words, "lang").withColumn("score", _score("a", "n", "l", "r"))
    lowest = scored.groupBy("fp", "chk").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("cut"))
    longer = phrases.select(F.explode("inner").alias("part"), F.col("a").alias("most"))
    longer = longer.groupBy(F.col("part.fp").alias("fp"), F.col("part.chk").alias("chk")).agg(F.max("most").alias("most"))
    kept = phrases.join(longer, ["fp", "chk"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a")))
    kept = kept.join(lowest, ["fp", "chk"]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _word_totals(clean: DataFrame) -> DataFrame:
    """``lang, n``: all words of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for rows, *_ in tokenised(batch.column(1)):
                counts += np.bincount(rows, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], names=["lang", "n"])

    return materialise(clean.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))
