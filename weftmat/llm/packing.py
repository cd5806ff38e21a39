"""Best-fit packing of tokenised documents by a configuration linear program over the length histogram.

Documents become pieces of at most CAPACITY tokens. The driver sees only the histogram of piece lengths, at most
CAPACITY numbers whatever the corpus. Over it the configuration program (a configuration says how many pieces of
each length fill one sequence; as few sequences as possible shall hold all pieces) is solved by
multiplicative weights: each length has a price that falls with what has been packed of it, and
the configuration worth most at these prices comes from an unbounded knapsack by dynamic programming. The
fractional solution is rounded down to whole sequences, the program is solved again over what is left, and the
last pieces, where no configuration would be used once, are placed best-fit in descending length.

Pieces get their places by rank within their length: ranks are counted per written partition and
added up, so no length, however common, gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmat.llm.common import materialize
from weftmat.llm.pretokens import Cache, boundaries, in_slices, lay
from weftmat.llm.token_counts import default_path

CAPACITY = 2048
#: Prices are updated this many times in each of the rounds of the program.
STEPS, ROUNDS = 100, 2
LONG_BONUS = 0.05
#: Ids that a worker's cache holds before it starts anew.
POOL_IDS = 6_000_000


class Encoder:
    """Token ids of whole texts: pre-tokens by the tokenizers library, each distinct one once while the cache lasts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = list(self.tok.get_added_tokens_decoder().items())
        if len(added) > 1:
            raise ValueError("one added token at most")
        self.special_id, self.special = (added[0][0], added[0][1].content) if added else (None, None)
        self.cache = Cache(self.resolve)
        self.reset()

    def reset(self) -> None:
        self.cache.clear()
        # word k has ids pool[at[k]:at[k] + size[k]]; word 0 is the special token
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 1
        self.at, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        if self.special_id is not None:
            self.pool[0] = self.special_id

    def resolve(self, words: list[str]) -> np.ndarray:
        enc = self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(enc.ids, np.uint32)
        n = np.bincount(np.array(enc.word_ids, np.int64), minlength=len(words))
        while len(self.pool) < self.used + len(ids):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint32))
        self.pool[self.used : self.used + len(ids)] = ids
        first = len(self.at)
        self.at = np.append(self.at, self.used + np.cumsum(n) - n)
        self.size = np.append(self.size, n)
        self.used += len(ids)
        return np.arange(first, len(self.at))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each text's."""
        if self.used > POOL_IDS:
            self.reset()
        laid, cp, starts = lay(texts, self.special)
        begin, end, special = boundaries(cp)
        word = np.zeros(len(begin), np.int64)
        plain = np.flatnonzero(~special)
        word[plain] = self.cache.get(laid, cp, begin[plain], end[plain])
        off, n = self.at[word], self.size[word]
        total = np.append(0, np.cumsum(n))
        ids = self.pool[np.repeat(off - total[:-1], n) + np.arange(total[-1])]
        edge = total[np.searchsorted(begin, np.append(starts, len(cp)))]
        return ids, np.diff(edge)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian uint32 bytes): the pieces of every document.

    A document is its ids and a final 0. Null text is empty: one piece of one id. Only documents longer than capacity
    are cut; their first piece takes the odd rest.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            doc_ids, texts = b.column(0), b.column(1).to_pylist()
            for at, part in in_slices(texts):
                ids, n = enc.encode(part)
                n = n + 1
                stop = np.cumsum(n)
                ids = np.insert(ids, stop - np.arange(1, len(n) + 1), 0)
                k = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                first = n - capacity * (k - 1)
                start = np.where(piece == 0, 0, first[doc] + capacity * (piece - 1))
                length = np.where(piece == 0, first[doc], capacity)
                lo = (stop - n)[doc] + start
                raw = ids.astype("<u4")
                cut = [raw[i : i + m].tobytes() for i, m in zip(lo.tolist(), length.tolist(), strict=True)]
                cols = [doc_ids.take(pa.array(doc + at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(cut, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def best_config(price: np.ndarray, capacity: int) -> np.ndarray:
    """Numbers of each length (index 0 is length 1) with the largest total price within capacity: an unbounded knapsack."""
    lengths = np.flatnonzero(price > 0) + 1
    p = price[lengths - 1]
    value, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = int(np.searchsorted(lengths, c, "right"))
        value[c], take[c] = value[c - 1], 0
        if m:
            v = value[c - lengths[:m]] + p[:m]
            k = int(v.argmax())
            if v[k] > value[c]:
                value[c], take[c] = v[k], lengths[k]
    out, c = np.zeros(len(price), np.int64), capacity
    while c > 0:
        if take[c]:
            out[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return out


def fractional(count: np.ndarray, capacity: int, steps: int) -> list[tuple[np.ndarray, float]]:
    """(configuration, number of sequences) of a fractional packing that uses no length more often than there are pieces of it.

    Prices start at the lengths themselves, the exact dual prices of a packing without waste, a little more for
    long pieces, so that of equally full configurations short pieces are left for the end. Each is
    multiplied by exp(share packed more than the average) or less after every step.
    """
    n = count.astype(float)
    lengths = np.arange(1, len(count) + 1)
    weight = np.where(count > 0, 1.0, 0.0)
    packed = np.zeros(len(count))
    chosen: dict[bytes, list] = {}
    total = (n * lengths).sum() / capacity
    base = lengths / capacity * (1 + LONG_BONUS * lengths / capacity)
    for _ in range(steps):
        config = best_config(weight * base, capacity)
        used = config > 0
        if not used.any():
            break
        size = min(float((n[used] / config[used]).min()), 2 * total / steps)
        packed += config * size
        share = np.divide(packed, n, out=np.zeros_like(n), where=n > 0)
        mean = (packed * lengths).sum() / (n * lengths).sum()
        weight = np.where(count > 0, np.exp(-0.5 * np.clip(share - mean, -1, 2)), 0.0)
        chosen.setdefault(config.tobytes(), [config, 0.0])[1] += size
    over = max(1.0, float(np.divide(packed, n, out=np.zeros_like(n), where=n > 0).max()))
    return [(c, x / over) for c, x in chosen.values()]


def plan(count: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """(configuration, whole number of sequences) that use every length exactly as often as count says.

    Of the plans by configurations that waste one token at most, by all configurations and by best-fit alone, the one with the
    fewest sequences; the first that reaches the lower bound ends the search.
    """
    bound = -(-int((count.astype(np.int64) * np.arange(1, len(count) + 1)).sum()) // capacity)
    size = lambda p: sum(n for _, n in p)
    best = _rounded(count, capacity, steps, rounds, capacity - 1)
    for least, r in ((0, rounds), (0, 0)):
        if size(best) > bound:
            best = min(best, _rounded(count, capacity, steps, r, least), key=size)
    return best


def _rounded(count: np.ndarray, capacity: int, steps: int, rounds: int, least: int) -> list[tuple[np.ndarray, int]]:
    """The program's configurations of at least so many tokens, rounded, and best-fit for the rest."""
    left, out = count.astype(np.int64).copy(), []
    full = np.zeros(len(count), np.int64)
    full[capacity - 1] = 1
    if left[capacity - 1]:
        out.append((full, int(left[capacity - 1])))
        left[capacity - 1] = 0
    for _ in range(rounds):
        if not left.sum():
            break
        for config, x in sorted(fractional(left, capacity, steps), key=lambda y: (-y[1], y[0].tobytes())):
            used = config > 0
            whole = min(int(x + 0.5), int((left[used] // config[used]).min()))
            if whole and (config * np.arange(1, len(count) + 1)).sum() >= least:
                out.append((config, whole))
                left -= config * whole
    out += _best_fit(left, capacity)
    return out


def _best_fit(count: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit in descending length, done for many equal sequences at once."""
    left, bins = count.copy(), {}
    while left.sum():
        config, room, have = np.zeros(len(count), np.int64), capacity, left.copy()
        while room:
            fits = np.flatnonzero(have[:room])
            if not len(fits):
                break
            k = int(fits[-1])
            take = min(int(have[k]), room // (k + 1))
            config[k] += take
            have[k] -= take
            room -= take * (k + 1)
        used = config > 0
        times = int((left[used] // config[used]).min())
        left -= config * times
        key = config.tobytes()
        bins[key] = (config, bins.get(key, (0, 0))[1] + times)
    return list(bins.values())


def _slots(configs: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...]:
    """Tables sorted by (length, first rank): for each use of a length in a configuration where its ranks start, and where they go."""
    rows, sequence = [], 0
    for config, times in configs:
        offset = 0
        for k in np.flatnonzero(config)[::-1].tolist():
            rows.append((k + 1, times * int(config[k]), int(config[k]), sequence, offset))
            offset += (k + 1) * int(config[k])
        sequence += times
    t = np.array(rows, np.int64).reshape(-1, 5)
    t = t[np.argsort(t[:, 0], kind="stable")]
    total = np.cumsum(t[:, 1]) - t[:, 1]
    head = np.searchsorted(t[:, 0], t[:, 0])
    first = total - total[head] if len(t) else total
    return t[:, 0], first, t[:, 2], t[:, 3], t[:, 4]


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a table that is written, with a column length) plus sequence_id and offset."""
    hist = np.zeros(capacity, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        hist[length - 1] = n
    length, first, times, sequence, offset = _slots(plan(hist, capacity))
    key = length << 44 | first  # 2**44 pieces of one length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            at = np.searchsorted(key, n << 44 | rank, "right") - 1
            which = rank - first[at]
            seq, off = sequence[at] + which // times[at], offset[at] + which % times[at] * n
            keep = [c for c in b.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*keep, "sequence_id", "offset"])

    # rank within the length: pieces before this partition's, then the row's number in (partition, length)
    per = cut.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__n"))
    per = per.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in cut.columns]
    ranked = cut.withColumn("__at", F.row_number().over(Window.partitionBy("__part", "length").orderBy(*order)))
    ranked = ranked.join(per, ["__part", "length"]).withColumn("__rank", F.coalesce("__before", F.lit(0)) + F.col("__at") - 1).drop("__part", "__before", "__at")
    ranked = ranked.withColumn("__rank", F.col("__rank").cast("bigint"))
    out = ranked.drop("__rank").select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema
    return ranked.mapInArrow(run, out)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset: one row per piece.

    An empty table gives an empty result; null text is one piece of one id. Rows that repeat a doc_id are packed like any others, null ids
    stay null, and columns other than the two named are left out.
    """
    cut = pieces(docs, id_col, text_col, path, capacity, with_ids)
    cut = materialize(cut.withColumn("__part", F.spark_partition_id()), "pieces")
    names = [c for c in cut.columns if c != "__part"]
    return place(cut, capacity).select(*names, "sequence_id", "offset")
