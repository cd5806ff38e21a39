"""Token counts by rank-synchronous array merging.

Pre-tokens that a worker has not met are held together as ragged numpy arrays of symbols. In each
step every sequence finds the lowest rank among its neighbouring pairs, and all occurrences of that pair are
merged at once, left to right, in all sequences. A sequence without a mergeable pair is finished; its count is
the number of symbols that survive. Counts of pre-tokens are summed per text; a special token
counts one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmat.llm.pretokens import Cache, boundaries, in_slices, lay

NO_RANK = np.iinfo(np.int32).max
LIMIT = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else the next beyond 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """Initial symbols of bytes and the merge table of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        added = [a["content"] for a in spec.get("added_tokens", [])]
        if len(added) > 1:
            raise ValueError("one added token at most")
        self.special = added[0] if added else None
        self.special_id = spec["added_tokens"][0]["id"] if added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NO_RANK)

    def counts(self, words: list[str]) -> np.ndarray:
        """Symbols of each word after all merges."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.zeros(len(raw), np.int64)
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), size)
        rank = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(seq[:-1] == seq[1:], self.ranks(sym[:-1], sym[1:]), NO_RANK)
        while len(sym):
            head = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            n = np.diff(np.append(head, len(sym)))
            least = np.minimum.reduceat(rank, head)
            done = least == NO_RANK
            out[seq[head[done]]] = n[done]
            if done.all():
                break
            least = np.repeat(least, n)
            if done.any():
                go = least != NO_RANK
                sym, seq, rank, least = sym[go], seq[go], rank[go], least[go]
            hit = np.flatnonzero(rank == least)
            # in a run like aaaa the pairs overlap: every other one merges, from the left
            run = np.append(True, hit[1:] != hit[:-1] + 1)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            sym[hit] = self.made[least[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols are once the others have gone
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                right = np.minimum(i + 1, len(sym) - 1)
                near = (i + 1 < len(sym)) & (seq[i] == seq[right])
                rank[i] = np.where(near, self.ranks(sym[i], sym[right]), NO_RANK)
        return out


@cache
def _state(path: str) -> tuple[Merges, Cache]:
    merges = Merges(path)
    return merges, Cache(merges.counts)


def count_texts(texts: list[str | None], path: str | None = None) -> np.ndarray:
    """Tokens of each text; null counts as empty."""
    merges, cached = _state(path or default_path())
    out = np.zeros(len(texts), np.int64)
    for at, part in in_slices(texts):
        laid, cp, starts = lay(part, merges.special)
        begin, end, special = boundaries(cp)
        n = np.ones(len(begin), np.int64)
        plain = np.flatnonzero(~special)
        n[plain] = cached.get(laid, cp, begin[plain], end[plain])
        total = np.append(0, np.cumsum(n))
        edge = np.searchsorted(begin, np.append(starts, len(cp)))
        out[at : at + len(part)] = total[edge[1:]] - total[edge[:-1]]
    return out


def add_token_counts(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """docs with out_col; all columns pass through, but one named out_col is replaced. Null text counts 0."""
    path = path or default_path()
    names = docs.columns
    at, keep = names.index(text_col), [k for k, c in enumerate(names) if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_texts(b.column(at).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64())], [*(names[k] for k in keep), out_col])

    return docs.mapInArrow(run, docs.select(*[F.col(f"`{names[k]}`") for k in keep], F.lit(0).cast("bigint").alias(out_col)).schema)


def token_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per row of docs, null text being empty; other columns are left out."""
    out = add_token_counts(docs.select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return out.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
