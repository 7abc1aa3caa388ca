"""Toxicity by compression distance.

Two zstandard dictionaries are learnt from whole labelled texts: one of what is common in ordinary
text, one of the same followed by the runs of characters that mark toxic documents. A window of a
text is a few words, one unless the caller says otherwise; the bytes it saves under the toxic dictionary, and those that are left,
say how toxic it looks. Kinds of windows are calibrated to the log ratio of their shares in
toxic and ordinary documents, by dictionaries that have not seen the document; those above a
threshold tell. A document's score is the calibrated probability of its telling windows,
given how many windows it has.
"""

from __future__ import annotations

import math
import warnings
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gainsieve.llm.common import others

#: Windows whose savings a worker holds; it starts over when it has that many.
CACHED_WINDOWS = 200_000
#: A window is told by the bytes it saves and by the length that is left, both up to a most.
MOST_SAVED, LEFT_STEP, LEFT_STEPS = 24, 3, 12
KINDS = (MOST_SAVED + 1) * LEFT_STEPS
#: Lengths, in characters, of the runs that may mark toxic text; they begin where a word does and may go past its end.
RUN_LENGTHS = range(3, 15)
#: Words of a window, and the level that finds the longest matches.
WINDOW_WORDS, LEVEL = 1, 13
#: Share of the standard errors of the clearest run that a marked run must have.
CLEAREST_SHARE = 0.25
#: Parts of the labelled texts that take turns in calibration.
TURNS = 4
EDGES = ".,;:!?…\"'()[]#*$%&|<>-"
#: Four bytes for each byte, so a literal costs more than the start of a match.
STRETCHED = [bytes((b, b ^ 0x5A, (b * 7 + 13) & 255, (b * 31 + 101) & 255)) for b in range(256)]


def windows(text: str | None, words: int) -> list[str]:
    """The text in windows of ``words`` lower-case words."""
    each = (text or "").lower().split()
    return [" ".join(each[i : i + words]) for i in range(0, len(each), words)]


def _bytes(window: str) -> bytes:
    return b"".join(map(STRETCHED.__getitem__, b" " + window.strip(EDGES).encode() + b" "))


def _run_starts(text: str | None) -> tuple[str, list[int]]:
    """The words of ``text`` without punctuation around them, and where each begins."""
    joined = " ".join(filter(None, (w.strip(EDGES) for w in (text or "").lower().split()))) + " "
    return joined, [0, *(i + 1 for i, c in enumerate(joined[:-1]) if c == " ")]


def runs(text: str | None) -> set[str]:
    """The runs of characters that begin the words of ``text``, without punctuation around the words."""
    joined, starts = _run_starts(text)
    return {joined[i : i + n] for i in starts for n in RUN_LENGTHS if i + n <= len(joined)}


def frequent_runs(texts: list[tuple[int, str]], fewest: int) -> list[Counter[str]]:
    """For every turn, in how many of its texts each run is that ``fewest`` texts or more hold.

    Length by length: where a run is rare, no longer one is looked at.
    """
    found: list[Counter[str]] = [Counter() for _ in range(TURNS)]
    live = [(turn, *_run_starts(t)) for turn, t in texts]
    for n in RUN_LENGTHS:
        counts: list[Counter[str]] = [Counter() for _ in range(TURNS)]
        for turn, joined, starts in live:
            counts[turn].update({joined[i : i + n] for i in starts if i + n <= len(joined)})
        total = sum(counts, Counter())
        for own, part in zip(found, counts, strict=True):
            own.update({r: c for r, c in part.items() if total[r] >= fewest})
        live = [(turn, joined, [i for i in starts if total[joined[i : i + n]] >= fewest]) for turn, joined, starts in live]
    return found


class CompressionModel(dict):
    """Savings of windows under two dictionaries and what they mean; as a dict it caches them."""

    def __init__(self, ordinary: bytes, toxic: bytes, words: int = WINDOW_WORDS, weights: list[float] | None = None, line: tuple[float, float] = (0.0, 0.0), expected: float = 0.0):
        super().__init__()
        self.ordinary, self.toxic, self.words = ordinary, toxic, words
        self.weights, self.line, self.expected = weights or [0.0] * KINDS, line, expected

    def __reduce__(self):
        return CompressionModel, (self.ordinary, self.toxic, self.words, self.weights, self.line, self.expected)

    @cached_property
    def compressors(self) -> tuple:
        plain = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        dictionary = lambda content: zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return tuple(zstandard.ZstdCompressor(dict_data=dictionary(d), compression_params=plain).compress for d in (self.ordinary, self.toxic))

    def __missing__(self, window: str) -> int:
        if len(self) >= CACHED_WINDOWS:
            self.clear()
        data = _bytes(window)
        ordinary, toxic = (len(compress(data)) for compress in self.compressors)
        saved = min(max(ordinary - toxic, 0), MOST_SAVED)
        kind = self[window] = saved * LEFT_STEPS + min(toxic // LEFT_STEP, LEFT_STEPS - 1)
        return kind

    def savings(self, text: str | None) -> np.ndarray:
        """How many windows of ``text`` are of each kind."""
        return np.bincount(list(map(self.__getitem__, windows(text, self.words))), minlength=KINDS)

    def evidence(self, text: str | None) -> float:
        """Log ratio of the telling windows found, against what so many windows would hold."""
        found = self.savings(text)
        return float(found @ np.array(self.weights) - found.sum() * self.expected)

    def score(self, text: str | None) -> float:
        z = self.line[0] + self.line[1] * self.evidence(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _content(chosen: Iterable[tuple[float, str]], size: int) -> bytes:
    """The heaviest strings, each behind a blank, up to ``size`` bytes, the heaviest last, so nearest."""
    parts: list[bytes] = []
    total = 0
    for _, run in sorted(chosen, reverse=True):
        data = b"".join(map(STRETCHED.__getitem__, b" " + run.encode()))
        if total + len(data) > size:
            break
        if not any(data in p for p in parts):
            parts.append(data)
            total += len(data)
    return b"".join(reversed(parts))


def _contrast(a: float, all_a: int, b: float, all_b: int) -> float:
    """Signed root of the likelihood ratio for ``a`` of ``all_a`` against ``b`` of ``all_b``; about standard errors."""
    share = (a + b) / (all_a + all_b)
    if a / all_a <= share or share == 1:
        return 0.0
    terms = [(a, all_a * share), (all_a - a, all_a * (1 - share)), (b, all_b * share), (all_b - b, all_b * (1 - share))]
    return math.sqrt(2 * max(0.0, sum(n * math.log(n / expected) for n, expected in terms if n)))


def _gist(text: str | None) -> int:
    """The least hash of three words, which most near copies share."""
    each = (text or "").lower().split()
    return min((zlib.crc32(" ".join(each[i : i + 3]).encode()) for i in range(max(len(each) - 2, min(len(each), 1)))), default=0)


@dataclass
class _Taught:
    """What dictionaries are learnt from: of either class, how many documents, and how many hold a run or a word."""

    documents: tuple[int, int] = (0, 0)
    toxic: Counter[str] = field(default_factory=Counter)
    usual: Counter[str] = field(default_factory=Counter)
    words: Counter[str] = field(default_factory=Counter)

    def without(self, other: _Taught) -> _Taught:
        documents = (self.documents[0] - other.documents[0], self.documents[1] - other.documents[1])
        return _Taught(documents, self.toxic - other.toxic, self.usual - other.usual, self.words - other.words)


def _in_turns(texts: list[str | None]) -> list[tuple[int, str]]:
    """Turn and text, in an order of the texts' own; near copies share a turn."""
    keyed = sorted((_gist(t), t or "") for t in texts)
    numbers = {gist: i % TURNS for i, gist in enumerate(dict.fromkeys(g for g, _ in keyed))}
    return [(numbers[g], t) for g, t in keyed]


def _counted(turns: list[list[tuple[int, str]]], fewest: int) -> list[_Taught]:
    """Counts of every turn, then of all. Of near copies one counts, which would else tell a passage many times."""
    unlike = [list({_gist(t): (i, t) for i, t in texts}.values()) for texts in turns]
    toxic = frequent_runs(unlike[1], fewest)
    several = set().union(*toxic)
    known = Counter(w for _, t in unlike[0] for w in set(windows(t, 1)))
    parts = []
    for turn in range(TURNS):
        ordinary = [t for i, t in unlike[0] if i == turn]
        usual = Counter(r for t in ordinary for r in runs(t) & several)
        words = Counter(w for t in ordinary for w in set(windows(t, 1)) if known[w] >= fewest)
        parts.append(_Taught((len(ordinary), sum(i == turn for i, _ in unlike[1])), toxic[turn], usual, words))
    sizes = tuple(sum(p.documents[k] for p in parts) for k in (0, 1))
    return [*parts, _Taught(sizes, *(sum((getattr(p, name) for p in parts), Counter()) for name in ("toxic", "usual", "words")))]


def learn_dictionaries(taught: _Taught, words: int, size: int, fewest: int) -> CompressionModel:
    """The two dictionaries, not calibrated.

    A run marks toxic text if it is in at least ``fewest`` toxic documents and in more of them than of
    the others by more standard errors than the best of so many runs would reach by chance, and by
    a good part of what the clearest run has.
    """
    ordinary, toxic = (max(n, 1) for n in taught.documents)
    found = {r: n for r, n in taught.toxic.items() if n >= fewest}
    contrasts = {r: _contrast(n, toxic, taught.usual[r], ordinary) for r, n in found.items()}
    clear = max(math.sqrt(2 * math.log(max(len(found), 2))), CLEAREST_SHARE * max(contrasts.values(), default=0.0))
    # Of runs that begin alike, the clearest; of equally clear ones the longest.
    marked: list[tuple[float, str]] = []
    for z, r in sorted(((z, r) for r, z in contrasts.items() if z >= clear), key=lambda m: (-round(m[0], 9), -len(m[1]), m[1])):
        if not any(r.startswith(o) or o.startswith(r) for _, o in marked):
            marked.append((z, r))
    plain = [(n, w.strip(EDGES) + " ") for w, n in taught.words.items() if n >= fewest]
    content = _content((p for p in plain if not any(p[1].startswith(r) for _, r in marked)), size)
    return CompressionModel(content, content + _content(marked, size), words)


def train(rows: list[tuple[str | None, int]], words: int = WINDOW_WORDS, size: int = 32_000, fewest: int = 3, least_ratio: float = 1.1) -> CompressionModel:
    """A model from labelled texts, in whatever order they come.

    Every text serves both the dictionaries and the calibration: texts take turns, and the windows
    of a turn are measured under dictionaries of the others. Windows tell if their kind is
    ``exp(least_ratio)`` times as frequent in toxic texts. With one class only, every score is
    its share. A warning says so if no window tells, since then scores say nothing.
    """
    share = sum(label for _, label in rows) / len(rows) if rows else 0.0
    prior = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    if not 0 < share < 1:
        return CompressionModel(b"", b"", words, None, (prior, 0.0))
    turns = [_in_turns([t for t, label in rows if label == k]) for k in (0, 1)]
    *parts, whole = _counted(turns, fewest)
    held: list[list[np.ndarray]] = [[], []]
    for turn, part in enumerate(parts):
        model = learn_dictionaries(whole.without(part), words, size, fewest)
        for k, texts in enumerate(turns):
            held[k] += [model.savings(t) for i, t in texts if i == turn]
    counts = [np.array(h) for h in held]
    model = learn_dictionaries(whole, words, size, fewest)
    seen = [h.sum(axis=0) for h in counts]
    all_seen = [max(s.sum(), 1) for s in seen]
    few = 1 / min(all_seen)  # what one window more would be, so rare kinds say little
    shares = [seen[k] / all_seen[k] + few for k in (0, 1)]
    ratio = np.log(shares[1] / shares[0])
    telling = (ratio >= least_ratio) & (np.arange(KINDS) >= LEFT_STEPS)  # something must be saved
    if not telling.any():
        warnings.warn("no window tells toxic from ordinary text: all scores will be alike", stacklevel=2)
    model.weights = np.where(telling, ratio, 0.0).tolist()
    model.expected = float((shares[1] - shares[0])[telling].sum())
    model.line = _fit_line(*(h @ np.array(model.weights) - h.sum(axis=1) * model.expected for h in counts), prior)
    return model


def _fit_line(ordinary: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over the evidence, by Newton's method."""
    x = np.concatenate([ordinary, toxic])
    y = np.concatenate([np.zeros(len(ordinary)), np.ones(len(toxic))])
    scale = max(float(np.std(x)), 1e-9)
    design = np.stack([np.ones(len(x)), np.clip(x / scale, -3, 3)], axis=1)
    beta = np.array([prior, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0) / scale)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", words: int = WINDOW_WORDS, sample: tuple[int, int] = (4000, 1500), most_bytes: int = 1 << 26) -> CompressionModel:
    """A model from at most ``sample`` ordinary and toxic labelled rows, chosen by a hash of the key.

    Texts come to the driver until those of a class fill ``most_bytes``.
    ``labels`` holds the rows to learn from; those with a null key or label are not used.
    """
    usable = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("_label")).dropna()
    order = [F.xxhash64(F.col("_key"), F.lit(8)), F.col("_key")]
    chosen = [usable.where(F.col("_label") == k).orderBy(*order).limit(n) for k, n in enumerate(sample)]
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    rows = texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "_key")
    before = Window.partitionBy("_label").orderBy(*order, F.xxhash64("_text")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.octet_length("_text")).over(before), F.lit(0))).where(F.col("_before") < most_bytes)
    return train([(r["_text"], r["_label"]) for r in rows.select("_text", "_label").collect()], words)


def score_documents(df: DataFrame, model: CompressionModel, key: str, text: str = "text") -> DataFrame:
    """``key, score`` for every row; a null or empty text has no windows and scores by the line alone.

    Keys may be null; repeated rows each come back, other columns play no part, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["k", "score"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, score double").toDF(key, "score")


def with_scores(df: DataFrame, model: CompressionModel, text: str = "text", score: str = "score") -> DataFrame:
    """The rows of ``df`` with their score as a last column, so that nothing is joined by a key.

    A column that already has that name, in any letter case, is replaced. A null or empty text scores by
    the line alone; repeated rows score alike; an empty table stays empty.
    """
    df = df.select(*others(df, score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(score, DoubleType())]))
