"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A byte-pair model's merges are taken from the agenda by score; each candidate merge is skipped where a keyed hash of
(seed, variant, word, place, pair) falls below the dropout rate, and stays skipped until one of its sides changes. A
document's variant follows from its doc_id, so its ids are the same in every run, while documents segment alike words
in ``variants`` ways. Merges never cross a space, so words are segmented once for each variant: many words advance
together in numpy, one merge of each at a time, and a cache of bounded size keeps the results.

Characters outside the vocabulary become byte pieces, and so does a literal U+2581, which would otherwise decode to a
space; decoding therefore gives back every text exactly.

Defined cases: a null text has null ids and decodes to null; an empty one has no ids; documents without a doc_id use
variant 0. Repeated rows are encoded alike. An empty table stays empty. A column named ``ids``, ``n_pieces`` or
``variant`` is replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import U64, column, mix, small_batches

SPACE = "▁"
PAIR = 1 << 20
#: Symbols in one numpy block of words, and the bounds of each variant's cache.
BLOCK_SYMBOLS = 1 << 18
LONG_WORD = 256
CACHE_WORDS, CACHE_CHARS = 100_000, 4_000_000
ENCODED = ["variant", "n_pieces", "ids"]
_UNIT = re.compile(r" +[^ ]*")


class Pieces:
    """Tables of a byte-pair model: characters, merges with their rank, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = {p: i for i, p in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.char = np.full(0x110000, -1, np.int64)
        self.char[:128] = self.byte[:128]
        for p, i in plain.items():
            if len(p) == 1 and p != SPACE:
                self.char[ord(p)] = i
        self.char[0x20] = plain[SPACE]
        merges = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    merges[a * PAIR + b] = i
        self.pair = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in self.pair.tolist()], np.int64)
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.empty(n, np.int64)
        rank[np.lexsort((-np.arange(n), score))] = np.arange(1, n + 1)  # higher score, then lower id, comes first
        self.rank = rank[self.merged]
        raw = [b""] * n
        for p, i in plain.items():
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            raw[i] = bytes([b])
        self.size = np.fromiter(map(len, raw), np.int64, n)
        self.first = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a and b merge: place in the merge table, and whether they do."""
        key = a * PAIR + b
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return at, (self.pair[at] == key) & (a >= 0) & (b >= 0)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and the end of each; the space before each text's first word is taken off."""
        size = self.size[ids]
        total = np.cumsum(size)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.first[ids] - (total - size), size)
        out = self.raw[at]
        stop = np.concatenate([[0], total])[ends]
        begin = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        full = stop > begin
        keep = np.ones(len(out), bool)
        keep[begin[full]] = False
        return out[keep], stop - np.cumsum(full)


class DropoutEncoder:
    """Segments words for one seed and variant; ``rate`` 0 gives the model's own segmentation."""

    def __init__(self, pieces: Pieces, rate: float, seed: int, variant: int):
        self.p, self.limit = pieces, U64(min(int(rate * 2.0 ** 64), 2 ** 64 - 1))
        self.key = mix(np.array([seed * 1_000_003 + variant], np.int64).view(np.uint64))[0]
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.chars = 0
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    @staticmethod
    def units(text: str) -> list[str]:
        """Words with all but one of the spaces before them."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [u[1:] for u in _UNIT.findall(" " + text)]
        return text.split(" ")

    def _merge_all(self, ids: np.ndarray) -> np.ndarray:
        """Rows of symbol ids, -2 behind each row's end, merged as far as the agenda goes."""
        n, width = ids.shape
        done = np.full((n, width), -2, np.int64)
        rows = np.arange(n)
        place = np.tile(np.arange(width), (n, 1))
        word = np.zeros(n, U64)
        for c in ids.T:
            word = np.where(c == -2, word, mix(word * U64(31) + (c + 3).astype(U64)))  # not what fills up the row
        word ^= self.key
        while len(rows):
            if ids.shape[1] < 2:
                done[rows, :ids.shape[1]] = ids
                break
            a, b = ids[:, :-1], ids[:, 1:]
            at, ok = self.p.found(a, b)
            if self.limit:
                r, c = np.nonzero(ok)
                h = mix(word[r] + mix(place[r, c].astype(U64) * U64(PAIR * PAIR) + (a[r, c] * PAIR + b[r, c]).astype(U64)))
                ok[r, c] = h >= self.limit
            score = np.where(ok, self.p.rank[at], 0)
            best = score.argmax(1)
            live = score[np.arange(len(rows)), best] > 0
            done[rows[~live], :ids.shape[1]] = ids[~live]
            rows, best, ids, place, word, at = rows[live], best[live], ids[live], place[live], word[live], at[live]
            k = np.arange(len(rows))
            ids[k, best] = self.p.merged[at[k, best]]
            keep = np.ones(ids.shape, bool)
            keep[k, best + 1] = False
            shape = (len(rows), ids.shape[1] - 1)
            ids, place = ids[keep].reshape(shape), place[keep].reshape(shape)
        return done

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long row, with a heap as the agenda: a step costs a logarithm, not the row."""
        word = np.zeros(1, U64)
        for c in (ids + 3).astype(U64):
            word = mix(word * U64(31) + c)
        word ^= self.key
        n = len(ids)
        sym, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(at: list[int]) -> None:
            i = np.array([j for j in at if j >= 0 and after[j] < n], np.int64)
            a = np.array([sym[j] for j in i.tolist()], np.int64)
            b = np.array([sym[after[j]] for j in i.tolist()], np.int64)
            if not len(i):
                return
            place, ok = self.p.found(a, b)
            if self.limit:
                h = mix(word + mix(i.astype(U64) * U64(PAIR * PAIR) + (a * PAIR + b).astype(U64)))
                ok &= h >= self.limit
            for j, k, x, y in zip(i[ok].tolist(), place[ok].tolist(), a[ok].tolist(), b[ok].tolist()):
                heapq.heappush(heap, (-int(self.p.rank[k]), j, x, y, int(self.p.merged[k])))

        offer(list(range(n)))
        while heap:
            _, j, x, y, new = heapq.heappop(heap)
            if sym[j] != x or after[j] >= n or sym[after[j]] != y:
                continue
            gone = after[j]
            sym[j], sym[gone], after[j] = new, -2, after[gone]
            if after[j] < n:
                before[after[j]] = j
            offer([before[j], j])
        return np.array([v for v in sym if v != -2], np.int64)

    def segment(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit, in the given order."""
        out: list = [None] * len(units)
        size = np.fromiter(map(len, units), np.int64, len(units)) + 1
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            width = int(size[order[at]])
            wide = max(8, width + width // 4)
            stop = int(np.searchsorted(size[order], wide, "right"))
            stop = min(stop, at + max(1, BLOCK_SYMBOLS // wide))
            pick = order[at:stop]
            at = stop
            text = [" " + units[i] for i in pick.tolist()]
            code = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
            n = size[pick]
            ids = np.full((len(pick), int(n.max())), -2, np.int64)
            inside = np.arange(ids.shape[1]) < n[:, None]
            sym = self.p.char[code]
            unknown = sym < 0
            # a character that no piece has: its code point, below all ids, for the byte pieces
            ids[inside] = np.where(unknown, -3 - code.astype(np.int64), sym)
            merged = self._merge_all(ids) if width <= LONG_WORD else [self._merge_long(r[:m]) for r, m in zip(ids, n)]
            rows = list(merged)
            if isinstance(merged, np.ndarray):
                keep = merged != -2
                rows = np.split(merged[keep], np.cumsum(keep.sum(1))[:-1])
            strange = np.zeros(len(rows), bool)
            strange[np.repeat(np.arange(len(rows)), n)[unknown]] = True
            for k in np.flatnonzero(strange).tolist():
                rows[k] = np.array(list(chain.from_iterable(
                    [v] if v >= 0 else self.p.byte[list(chr(-3 - v).encode())].tolist() for v in rows[k].tolist())), np.int64)
            for i, row in zip(pick.tolist(), rows):
                out[i] = row
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's end."""
        if len(self.code) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
        split = [self.units(t) for t in texts]
        flat = list(chain.from_iterable(split))
        new = list(dict.fromkeys(u for u in flat if u not in self.code))
        if new:
            got = self.segment(new)
            n, m = len(self.code), len(new)
            count = np.fromiter(map(len, got), np.int64, m)
            ids = np.concatenate(got)
            if n + m > len(self.start):
                self.start, self.count = (np.resize(x, 2 * (n + m)) for x in (self.start, self.count))
            if self.used + len(ids) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
            self.pool[self.used:self.used + len(ids)] = ids
            self.count[n:n + m] = count
            self.start[n:n + m] = self.used + np.cumsum(count) - count
            self.used += len(ids)
            self.code.update(zip(new, range(n, n + m)))
            self.chars += sum(map(len, new))
        code = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        count = self.count[code]
        total = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(int(total[-1])) + np.repeat(self.start[code] - total[:-1], count)
        return self.pool[at], total[np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]


_loaded: dict = {}


def _pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _encoder(path: str, rate: float, seed: int, variant: int) -> DropoutEncoder:
    key = path, rate, seed, variant
    if key not in _loaded:
        _loaded[key] = DropoutEncoder(_pieces(path), rate, seed, variant)
    return _loaded[key]


def encoded(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 11, variants: int = 4) -> DataFrame:
    """``docs`` with variant, n_pieces and ids (array of int)."""
    rest = [c for c in docs.columns if c not in ENCODED]
    variant = F.coalesce(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(variants)), F.lit(0)).cast("int")
    rows = docs.select(*rest, F.when(F.col("doc_id").isNull(), 0).otherwise(variant).alias("variant"))
    schema = T.StructType([*docs.select(*rest).schema, T.StructField("variant", T.IntegerType()),
                           T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                texts = column(batch, "text").to_pylist()
                kind = column(batch, "variant").to_numpy()
                parts: list = [np.zeros(0, np.int32)] * len(texts)
                for v in np.unique(kind).tolist():
                    pick = np.flatnonzero(kind == v).tolist()
                    ids, ends = _encoder(model, rate, seed, v).encode([texts[i] or "" for i in pick])
                    for i, a, b in zip(pick, np.concatenate([[0], ends[:-1]]), ends):
                        parts[i] = ids[a:b]
                size = np.fromiter(map(len, parts), np.int64, len(parts))
                void = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                    pa.array(np.concatenate(parts).astype(np.int32)), mask=pa.array(void))
                yield pa.RecordBatch.from_arrays(
                    [*[column(batch, c) for c in rest], column(batch, "variant"), pa.array(size, pa.int64(), mask=void), lists],
                    names=rest + ENCODED)

    return small_batches(rows).mapInArrow(run, schema)


def decoded(df: DataFrame, model: str, name: str = "decoded") -> DataFrame:
    """``df`` with the text of its ``ids`` in column ``name``."""
    rest = [c for c in df.columns if c != name]
    schema = T.StructType([*df.select(*rest).schema, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                lists = column(batch, "ids")
                size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
                raw, ends = _pieces(model).decode(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size))
                text = pa.Array.from_buffers(pa.large_string(), len(ends), [
                    None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
                text = pc.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), text).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in rest], text], names=[*rest, name])

    return small_batches(df).mapInArrow(run, schema)
