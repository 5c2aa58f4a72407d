"""Dictionary word segmentation and keywords.

The dictionary is a table (word, tf, idf, attr). A run of letters that need segmenting is cut along
the path of words with the largest weight: the product of the words' frequencies, of the fourth
power of their lengths and of the ratios of neighbouring attributes, over the fifth power of the number of
words; longest matching in either direction is the plain alternative.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One run of CJK or kana characters, or one unit of other text: a number with at most one dot, an acronym with
# dots, a word with joiners.
UNIT = re.compile(
    r"[぀-ヿ㐀-鿿豈-﫿]+|\d+(?:\.\d+)?%?|[A-Za-z](?:\.[A-Za-z])+|[C]\+\+|[A-Za-z]&[A-Za-z]|[^\W\d_]+(?:['\-_][^\W\d_]+)*"
)
LONGEST_UNIT = 33


@dataclass(frozen=True)
class Rule:
    """A name, place or number rule: a head word joined with a run of single characters beside it.

    side "after" (as surnames have) takes characters behind the head, "before" (as place endings have) those in front
    of it: at least ``least``, at most ``most``, each of them in ``include`` (if given) and not in ``exclude``.
    """

    heads: frozenset[str]
    side: str
    attr: str
    idf: float = 3.0
    least: int = 1
    most: int = 2
    include: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()

    def takes(self, word: str) -> bool:
        return len(word) == 1 and word not in self.exclude and (not self.include or word in self.include)


@dataclass
class Dictionary:
    words: dict[str, tuple[float, float, str]]  # tf, idf, attr
    pair_ratio: dict[tuple[str, str], float] = field(default_factory=dict)
    single_tf: float = 0.5
    rules: list[Rule] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.words), default=1)
        self.starts = {w[:k] for w in self.words for k in range(1, len(w))}

    @staticmethod
    def load(rows: DataFrame, most: int = 1_000_000, **more) -> Dictionary:
        """From (word, tf, idf, attr) rows, at most ``most`` of them: the dictionary goes to every task."""
        got = rows.select("word", "tf", "idf", "attr").limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"a dictionary has at most {most} words")
        return Dictionary({r["word"]: (r["tf"], r["idf"], r["attr"]) for r in got}, **more)

    def matches(self, run: str, i: int) -> list[int]:
        """Ends of the words that start at i."""
        out = []
        for j in range(i + 1, min(len(run), i + self.longest) + 1):
            w = run[i:j]
            if w in self.words:
                out.append(j)
            if w not in self.starts:
                break
        return out


def forward_longest(run: str, d: Dictionary) -> list[str]:
    out, i = [], 0
    while i < len(run):
        j = max(d.matches(run, i), default=i + 1)
        out.append(run[i:j])
        i = j
    return out


def reverse_longest(run: str, d: Dictionary) -> list[str]:
    out, j = [], len(run)
    while j > 0:
        i = next((i for i in range(max(0, j - d.longest), j) if run[i:j] in d.words), j - 1)
        out.append(run[i:j])
        j = i
    return out[::-1]


def best_path(run: str, d: Dictionary) -> list[str]:
    """The heaviest path: for each end, number of words and last attribute the best logarithm is kept."""
    start = {(0, ""): (0.0, ())}
    paths: list[dict] = [start] + [{} for _ in run]
    for i in range(len(run)):
        for (n, attr), (weight, words) in list(paths[i].items()):
            for j in [*d.matches(run, i), *([i + 1] if run[i] not in d.words else [])]:
                w = run[i:j]
                tf, _, own = d.words.get(w, (d.single_tf, 0.0, "un"))
                gain = math.log(max(tf, 1e-9)) + 4 * math.log(len(w)) + math.log(d.pair_ratio.get((attr, own), 1.0))
                key = (n + 1, own)
                if key not in paths[j] or paths[j][key][0] < weight + gain:
                    paths[j][key] = (weight + gain, (*words, w))
    ranked = [(w - 5 * math.log(max(1, n)), -n, words) for (n, _), (w, words) in paths[-1].items()]
    return list(max(ranked)[2]) if ranked else []


def apply_rules(words: list[str], rules: list[Rule]) -> list[tuple[str, Rule | None]]:
    """Words with the names that rules form; heads of two characters and rules that come first win."""
    out: list[tuple[str, Rule | None]] = [(w, None) for w in words]
    for rule in sorted(rules, key=lambda r: -max(map(len, r.heads), default=0)):
        i = 0 if rule.side == "after" else len(out) - 1
        while 0 <= i < len(out):
            word, used = out[i]
            step = 1 if rule.side == "after" else -1
            if used is None and word in rule.heads:
                n = 0
                while n < rule.most and 0 <= (k := i + step * (n + 1)) < len(out) and out[k][1] is None and rule.takes(out[k][0]):
                    n += 1
                if n >= rule.least:
                    a, b = (i, i + n + 1) if step > 0 else (i - n, i + 1)
                    out[a:b] = [("".join(w for w, _ in out[a:b]), rule)]
                    i = a
            i += step
    return out


def sub_words(words: list[str], d: Dictionary, mode: str) -> list[str]:
    """Extra cuts: "short" adds dictionary words inside a word, "pairs" all neighbouring pairs, "chars" all characters."""
    out = []
    for w in words:
        out.append(w)
        if len(w) > 2 and not w.isascii():
            inside = [w[i:j] for i in range(len(w)) for j in range(i + 2, len(w) + 1) if (i, j) != (0, len(w))]
            if mode == "short":
                out += [x for x in inside if x in d.words]
            elif mode == "pairs":
                out += [w[i : i + 2] for i in range(len(w) - 1)]
        if mode == "chars" and len(w) > 1 and not w.isascii():
            out += list(w)
    return out


def units(text: str | None, d: Dictionary, method: str = "path", mode: str = "") -> Iterator[tuple[str, int, float, str]]:
    """word, offset, idf and attr of each unit of a text, one after another."""
    cut = {"path": best_path, "forward": forward_longest, "reverse": reverse_longest}[method]
    text, end = text or "", 0
    while m := UNIT.search(text, end):
        unit, at, end = m.group(), m.start(), m.end()
        if ord(unit[0]) < 0x3040:
            words: list[tuple[str, Rule | None]] = [(unit[:LONGEST_UNIT].lower(), None)]
            end = min(end, at + LONGEST_UNIT)  # the rest of a longer unit goes on as the next one
        else:
            words = apply_rules(cut(unit, d), d.rules)
        for w, rule in words:
            for x in sub_words([w], d, mode) if mode else [w]:
                known = (0.0, rule.idf, rule.attr) if rule and x == w else d.words.get(x)
                plain = (2.5 * math.log(len(x)) if len(x) > 1 else 0.0, "en") if x.isascii() else (0.0, "un")
                idf, attr = (known[1], known[2]) if known else plain
                yield x, at, idf, attr
            at += len(w)


def segment(text: str | None, d: Dictionary, method: str = "path", mode: str = "") -> list[dict]:
    """word, offset, idf and attr of each unit of a text."""
    return [dict(zip(("word", "off", "idf", "attr"), u, strict=True)) for u in units(text, d, method, mode)]


MOST_WORDS = 20_000


def word_batches(batches: Iterable[pa.RecordBatch], d: Dictionary, method: str = "path", mode: str = "") -> Iterator[pa.RecordBatch]:
    """id, word, off, idf, attr of (id, text) batches. At most MOST_WORDS words are held at a time, however long and many the texts are."""
    for batch in batches:
        kinds = (batch.column(0).type, pa.string(), pa.int32(), pa.float64(), pa.string())
        found = ((key.as_py(), *u) for key, text in zip(batch.column(0), batch.column(1), strict=True) for u in units(text.as_py(), d, method, mode))
        while rows := list(islice(found, MOST_WORDS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "word", "off", "idf", "attr"])


def segmented(docs: DataFrame, d: Dictionary, method: str = "path", mode: str = "", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, word, off, idf, attr: the words of each text, in Arrow batches; the dictionary is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(d)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return word_batches(batches, shared.value, method, mode)

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, word string, off int, idf double, attr string")


# Words that are never keywords.
STOP_WORDS = ("about", "all", "and", "are", "for", "from", "of", "on", "the", "this", "to", "us", "was", "with")


def keywords(words: DataFrame, limit: int = 10, attrs: tuple[str, ...] = (), least_idf: float = 0.2) -> DataFrame:
    """word, times, weight: the heaviest words by their sum of idf; attrs keeps, a leading ~ drops attributes."""
    kept = words.filter((F.col("idf") >= least_idf) & (F.col("attr") != "#") & ~F.col("word").isin(*STOP_WORDS))
    wanted, barred = [a for a in attrs if a[0] != "~"], [a[1:] for a in attrs if a[0] == "~"]
    if wanted:
        kept = kept.filter(F.col("attr").isin(*wanted))
    if barred:
        kept = kept.filter(~F.col("attr").isin(*barred))
    return (
        kept.groupBy("word")
        .agg(F.count(F.lit(1)).alias("times"), F.round(F.sum("idf"), 6).alias("weight"))
        .orderBy(F.desc("weight"), "word")
        .limit(limit)
    )
