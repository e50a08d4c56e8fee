"""Language identification by cross-parsing: a text is cut into the fewest longest matches of each language's sample.

Each language's labelled sample becomes a suffix automaton; walking a text through it and starting anew where no
longer match exists counts the phrases of the cross-parsing, and the language with the fewest phrases a symbol wins.
Texts are folded to lower-case letters with single spaces between words and parsed in stretches of ``STRETCH``
symbols, so that all stretches of an Arrow batch advance together, one table look-up a symbol; the whole text is parsed.

The fit is bounded: ``docs_per_lang`` documents of each language (lowest keyed hash first) and ``chars_per_lang``
symbols of them, the same amount for each language. The automata are broadcast; their size follows from these bounds.

Defined cases: a text that is null or has no letter gets ``und`` and score 0, as does every text where nothing can be
learned. Letters outside the learned alphabet end a phrase in every language. Ties go to the smaller name. Repeated
rows are predicted alike. ``held_out`` is false without a doc_id, and such rows are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigloom.llm.common import column, small_batches

STRETCH = 256
#: Characters that are parsed in one numpy block.
BLOCK_CHARS = 1 << 19
#: A table entry's two top bits count the phrases that end, the rest is the next state.
FLAG = np.uint32(1 << 30)
STATE = np.uint32((1 << 30) - 1)
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its lower-case form where that is one character."""
    if not _tables:
        letter = np.zeros(0x110000, bool)
        fold = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                low = c.lower()
                if len(low) == 1:
                    fold[i] = ord(low)
        _tables.update(letter=letter, fold=fold)
    return _tables["letter"], _tables["fold"]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, 32 for whatever is no letter, runs of it once; and each text's end."""
    letter, fold = _letters()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    is_letter = letter[code]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    first = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
    keep[first] = is_letter[first]  # no space at the start
    out = np.where(is_letter, fold[code], np.uint32(32))[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[ends]


def suffix_automaton(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """Transition table of the smallest automaton of all substrings, rows are states and row 0 is the start.

    An entry is the next state; where no match goes on, it carries FLAG and is the state of a new match that starts
    with the symbol. A symbol that the sample never has is a phrase of its own. The last symbol is padding and stays
    where it is.
    """
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    start = np.zeros(n_symbols + 1, np.uint32)
    for c, s in nxt[0].items():
        start[c] = s
    table = np.tile(start | FLAG, (len(nxt), 1))
    for s, row in enumerate(nxt):
        for c, to in row.items():
            table[s, c] = to
    table[0, :] &= STATE  # a match that starts at the start ends nothing
    table[:, [c for c in range(n_symbols) if c not in nxt[0]]] += FLAG
    table[:, n_symbols] = np.arange(len(nxt), dtype=np.uint32)
    return table


class CrossParser:
    """Learned languages: names, the code points of the alphabet, and one automaton each."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.names = sorted(samples)
        seen = np.unique(np.concatenate([samples[n] for n in self.names])) if self.names else np.zeros(0, np.uint32)
        self.alphabet = seen
        self.tables = [suffix_automaton(np.searchsorted(seen, samples[n]), len(seen) + 1) for n in self.names]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language (languages x texts), and its number of symbols."""
        code, ends = folded(texts)
        at = np.searchsorted(self.alphabet, code)
        at[at == len(self.alphabet)] = 0
        other = len(self.alphabet)
        sym = np.where(self.alphabet[at] == code, at, other) if other else np.full(len(code), other)
        size = np.diff(ends, prepend=0)
        lanes = -(-size // STRETCH)
        lane0 = np.cumsum(lanes) - lanes
        place = np.arange(len(sym)) - np.repeat(ends - size, size)
        grid = np.full((STRETCH, int(lanes.sum())), other + 1, np.uint32)
        grid[place % STRETCH, np.repeat(lane0, size) + place // STRETCH] = sym
        owner = np.repeat(np.arange(len(texts)), lanes)
        out = np.zeros((len(self.names), len(texts)), np.int64)
        for k, table in enumerate(self.tables):
            flat, width = table.ravel(), np.uint32(table.shape[1])
            state = np.zeros(grid.shape[1], np.uint32)
            count = np.zeros(grid.shape[1], np.uint32)
            for row in grid:
                got = flat[state * width + row]
                count += got >> np.uint32(30)
                state = got & STATE
            out[k] = np.bincount(owner, count + (state > 0), len(texts))
        return out, size


def fit_languages(docs: DataFrame, docs_per_lang: int = 64, chars_per_lang: int = 12_000, holdout: int = 5) -> CrossParser:
    """Learn from text and lang of documents whose crc32 of the id is no multiple of ``holdout``.

    A language is learnt from ``chars_per_lang`` symbols at most, of ``docs_per_lang`` of its texts: the bounds of the
    sample. Its texts give as evenly as they can; where there are few of them, each gives more.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()
                       & (F.crc32(F.col("doc_id").cast("string")) % holdout != 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id", F.xxhash64("text"))
    rank = known.select("lang", "doc_id", "text").withColumn("k", F.row_number().over(order))
    # docs_per_lang texts of each language, cut to what can be used of them
    rows = rank.where(F.col("k") <= docs_per_lang).select(
        "lang", "k", F.substring("text", 1, 4 * chars_per_lang).alias("text")).collect()
    texts: dict[str, list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        code, _ = folded([r["text"]])
        if len(code):
            texts.setdefault(r["lang"], []).append(code)
    samples = {}
    for lang, codes in texts.items():
        share = _even_share([len(c) for c in codes], chars_per_lang)
        samples[lang] = np.concatenate([np.append(c[:share], np.uint32(32)) for c in codes])
    return CrossParser(samples)


def _even_share(sizes: list[int], total: int) -> int:
    """The most that each may give so that together they give ``total`` at most: few texts give more each."""
    left, rest = total, sorted(sizes)
    for k, n in enumerate(rest):
        if n * (len(rest) - k) > left:
            return max(1, left // (len(rest) - k))
        left -= n
    return rest[-1]


def identified(docs: DataFrame, parser: CrossParser, holdout: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score (how far the second language lies behind, 0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, (letter, _) = shared.value, _letters()
        names = np.array(p.names, object)
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            pred, score = [], []
            at = 0
            while at < len(texts):
                end, total = at, 0
                while end < len(texts) and (end == at or total + len(texts[end] or "") <= BLOCK_CHARS):
                    total += len(texts[end] or "")
                    end += 1
                part = [t or "" for t in texts[at:end]]
                at = end
                if not len(names):
                    pred += ["und"] * len(part)
                    score += [0.0] * len(part)
                    continue
                count, size = p.phrases(part)
                rank = np.argsort(count, axis=0, kind="stable")
                best = np.take_along_axis(count, rank[:1], 0)[0]
                second = np.take_along_axis(count, rank[1:2], 0)[0] if len(names) > 1 else 2 * best
                pred += np.where(size > 0, names[rank[0]], "und").tolist()
                score += np.where(size > 0, 1 - best / np.maximum(1, second), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(pred, pa.string()),
                 pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % holdout == 0, F.lit(False)).alias(
        "held_out"), "text")
    schema = rows.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double")
    return small_batches(rows).mapInArrow(run, schema)
