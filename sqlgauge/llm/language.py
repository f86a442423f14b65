"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily from
left to right into the longest phrases that occur in a language's sample; the fewer phrases it
needs, the closer it is. With c phrases, n letters and spaces, and a sample of N characters,
the cost c*log2(N)/n estimates the bits per character; the smallest cost wins (ties: the
smallest name).

Texts are lower-cased, and each run of other characters than letters becomes one space. They
are parsed in blocks of ``BLOCK`` characters, each from a fresh phrase, so that all blocks of a
batch advance together through one table of transitions: one numpy step per character place,
not one per character. All blocks of a text count; none is left out.

The sample is bounded by ``per_language`` texts of ``sample_chars`` (least, most) characters for
each language, those with the smallest hashes. Where a language has too few texts of that length,
the nearest lengths follow: of a longer text its middle, of shorter ones as many more texts as
make up for their length, ``SHORT_TEXTS`` times as many at most. Every labelled language has a
sample, so that the model grows with the number of languages, not with the texts. The automata
have at most twice as many states as the sample has characters; the moves by frequent letters
stand in a table of at most ``TABLE_BYTES``, those by other letters in one sorted list.

Odd cases: null texts and texts without a letter give ``und`` with score 0. Only letters that no
sample holds share one class. With no labelled text at all every text is ``und``. A null doc_id
is hashed as an empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, small_batches, store

UNKNOWN = "und"
BLOCK = 256
PER_LANGUAGE = 24
SAMPLE_CHARS = (200, 6000)
SHORT_TEXTS = 20
TABLE_BYTES = 1 << 28
_TABLE_LETTERS = 250
_RESULT = "lang_pred string, score double"


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves the remainder; null counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus) == F.lit(remainder)


def sample_texts(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_language: int = PER_LANGUAGE,
    sample_chars: tuple[int, int] = SAMPLE_CHARS,
) -> dict[str, list[str]]:
    """The bounded sample of each language, the same at every run."""
    least, most = sample_chars
    size = F.length(text)
    usable = labelled.where(F.col(lang).isNotNull() & (F.col(lang) != "") & (size > 0)).select(
        F.col(lang).alias("_lang"),
        F.xxhash64(F.col(key).cast("string"), F.octet_length(text)).alias("_h"),
        F.least(size, F.lit(most)).alias("_n"),
        (F.greatest(F.lit(least) - size, F.lit(0)) + F.greatest(size - F.lit(most), F.lit(0))).alias("_off"),
    )
    # each task passes on only its first rows of each language
    first = Window.partitionBy("_lang").orderBy("_off", "_h")
    ranked = usable.withColumn("_rank", F.row_number().over(first)).where(
        F.col("_rank") <= per_language * SHORT_TEXTS
    )
    before = F.coalesce(F.sum("_n").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    enough = (F.col("_rank") > per_language) & (before >= per_language * least)
    chosen = ranked.withColumn("_enough", enough).where(~F.col("_enough")).select("_lang", "_h").distinct()
    # stored, so that Spark knows how small it is and no text moves to meet it
    chosen = store(chosen, "sample-keys")
    middle = F.substring(F.col(text), F.greatest(F.lit(1), F.floor((size - most) / 2).cast("int")), F.lit(most))
    rows = (
        labelled.select(
            F.col(lang).alias("_lang"),
            F.xxhash64(F.col(key).cast("string"), F.octet_length(text)).alias("_h"),
            F.when(size > most, middle).otherwise(F.col(text)).alias("_text"),
        )
        .join(chosen, ["_lang", "_h"])
        .groupBy("_lang", "_h")
        .agg(F.min("_text").alias("_text"))
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["_lang"], r["_h"])):
        out.setdefault(r["_lang"], []).append(r["_text"])
    return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return moves


class CrossParser:
    """Phrase counts of many texts against the samples of all languages at once."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        plain = {name: [_plain(t) for t in samples[name]] for name in self.names}
        counts: dict[str, int] = {}
        for texts in plain.values():
            for t in texts:
                for ch in t:
                    counts[ch] = counts.get(ch, 0) + 1
        counts.pop(" ", None)
        letters = sorted(counts, key=lambda ch: (-counts[ch], ch))
        # class 0: space, 1..: letters of the samples, the last: all other letters
        self.other = len(letters) + 1
        number = {ch: i + 1 for i, ch in enumerate(letters)}
        number[" "] = 0
        self.classes = self._class_table(number)
        moves, sizes, self.roots = [], [], []
        states = 0
        for name in self.names:
            codes = [number.get(ch, self.other) for ch in " ".join(plain[name])]
            moves.append(suffix_automaton(codes))
            self.roots.append(states)
            sizes.append(max(2, len(codes)))
            states += len(moves[-1])
        # frequent letters have a column each, the last column ends every phrase
        self.wide = max(0, min(len(letters), _TABLE_LETTERS, TABLE_BYTES // (4 * max(states, 1)) - 2))
        self.table = np.zeros((states, self.wide + 2), np.int32)
        self.begin = np.zeros((len(self.names), self.other + 1), np.int32)
        keys, values = [], []
        for k, (own, base) in enumerate(zip(moves, self.roots)):
            self._fill(k, own, base, keys, values)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.bits = np.log2(np.array(sizes, float)) if sizes else np.zeros(0)

    def _class_table(self, number: dict[str, int]) -> np.ndarray:
        table = np.zeros(0x110000, np.int32)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isalpha():
                low = ch.lower()
                table[i] = number.get(low if len(low) == 1 else low[0], self.other)
        return table

    def _fill(self, k: int, moves: list[dict[int, int]], base: int, keys: list[int], values: list[int]) -> None:
        """Next state; where a phrase ends, minus (the state after the next phrase's start) - 1."""
        start = self.begin[k]
        start[:] = -base - 1
        for c, to in moves[0].items():
            start[c] = -(base + to) - 1
        part = self.table[base : base + len(moves)]
        part[:, : self.wide + 1] = start[: self.wide + 1]
        part[:, self.wide + 1] = -base - 1
        for state, row in enumerate(moves[1:], 1):
            for c, to in row.items():
                if c <= self.wide:
                    part[state, c] = base + to
                else:
                    keys.append((base + state) * (self.other + 1) + c)
                    values.append(base + to)

    def _rare(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """What the table would hold for letters without a column."""
        key = state * np.int64(self.other + 1) + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.begin[:, letter])

    def costs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text in each language, and whether it has a letter."""
        codes, lengths = [], np.zeros(len(texts), np.int64)
        letters = np.zeros(len(texts), bool)
        for i, t in enumerate(texts.to_pylist()):
            c = self.classes[np.frombuffer((t or "").encode("utf-32-le"), np.uint32)]
            space = c == 0
            if len(c):
                space[1:] &= space[:-1]
                space[0] = c[0] == 0
                c = c[~space]
            letters[i] = bool((c > 0).any())
            if letters[i]:
                codes.append(c)
                lengths[i] = len(c)
        phrases = np.zeros((len(texts), len(self.names)))
        if codes:
            self._parse(np.concatenate(codes), lengths, phrases)
        return phrases * self.bits / np.maximum(lengths, 1)[:, None], letters

    def _parse(self, codes: np.ndarray, lengths: np.ndarray, phrases: np.ndarray) -> None:
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        begin = np.repeat(np.cumsum(lengths) - lengths, blocks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = begin + inner * BLOCK
        size = np.minimum(BLOCK, begin + lengths[owner] - start)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        active = np.searchsorted(-size, -np.arange(BLOCK), "left")  # blocks longer than each place
        flat, width = self.table.ravel(), self.table.shape[1]
        columns = np.minimum(codes, self.wide + 1)
        rare = (codes > self.wide) & (codes < self.other) if len(self.keys) else None
        state = np.tile(np.array(self.roots, np.int32)[:, None], (1, len(start)))
        count = np.zeros((len(self.roots), len(start)), np.int32)
        for at in range(BLOCK):
            n = active[at]
            if not n:
                break
            place = start[:n] + at
            to = flat[state[:, :n] * np.int64(width) + columns[place]]
            some = np.flatnonzero(rare[place]) if rare is not None else ()
            if len(some):
                to[:, some] = self._rare(state[:, some], codes[place[some]])
            ended = to >> 31  # -1 where a phrase ended
            count[:, :n] -= ended
            state[:, :n] = to ^ ended
        for k in range(len(self.roots)):
            phrases[:, k] += np.bincount(owner, weights=count[k], minlength=len(phrases))


def _plain(text: str) -> str:
    return " ".join("".join(ch if ch.isalpha() else " " for ch in text.lower()).split())


_parsers: dict[int, CrossParser] = {}


def _parser(samples: dict[str, list[str]]) -> CrossParser:
    mark = hash(tuple((k, tuple(v)) for k, v in sorted(samples.items())))
    if mark not in _parsers:
        _parsers.clear()
        _parsers[mark] = CrossParser(samples)
    return _parsers[mark]


def _confidence(costs: np.ndarray) -> np.ndarray:
    """Share of the best language when each language weighs 2**(-4 * cost)."""
    weight = np.exp2(-4 * (costs - costs.min(1, keepdims=True)))
    return 1 / weight.sum(1)


def predictor(spark, samples: dict[str, list[str]]):
    """A column function from text to struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(samples)

    @F.arrow_udf(_RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = _parser(shared.value)
        for batch in batches:
            names, scores = [], []
            for part in pieces(batch, 1 << 22):
                costs, letters = parser.costs(part)
                if parser.names:
                    best, sure = costs.argmin(1), _confidence(costs)
                    names += [parser.names[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                    scores += [float(s) if ok else 0.0 for s, ok in zip(sure, letters)]
                else:
                    names += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            )

    return predict


def predict_languages(docs: DataFrame, samples: dict[str, list[str]], text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_lang`` of (lang_pred, score), computed once whatever reads it."""
    small_batches(docs.sparkSession)
    once = predictor(docs.sparkSession, samples).asNondeterministic()
    return docs.withColumn("_lang", once(F.col(text)))
