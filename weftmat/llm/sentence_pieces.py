"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model's protobuf.

The model file is read field by field: pieces with scores and types, the model type, normaliser flags and character map. From them
come a normaliser (character map, white space, dummy prefix, metaspace marker), a Unigram model with the
scores or a BPE model whose merge ranks follow them, byte fallback and the decoder. Texts are cut into
words at markers where no piece crosses one; distinct words are encoded in multithreaded batches and their ids kept in one array.

Parity is verified for every whole text. Where no piece has a marker behind another character, so that no piece crosses a word, the
sentencepiece library gives a text the ids of its words one after the other: then every text is normalised by the library and compared, and
every distinct word is encoded by the library behind another word. For other models the library encodes every text. A difference is
reported as parity = false; the ids returned are always those of the rebuilt tokenizer.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmat.llm.pretokens import END_CP, Cache, in_slices, lay, same

MARK = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Ids that a worker's cache holds before it starts anew.
POOL_IDS = 3_000_000
#: Parts into which a batch of words is cut, to be encoded by as many threads as there are.
PARTS = 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers as such, everything else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class Spec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        self.pieces, self.scores, self.types = [], [], []
        for number, value in model:
            if number == 1:
                p = {n: v for n, v in fields(value)}
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.types.append(p.get(3, NORMAL))
        trainer = {n: v for k, m in model if k == 2 for n, v in fields(m)}
        norm = {n: v for k, m in model if k == 3 for n, v in fields(m)}
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.unk = self.types.index(UNKNOWN)
        real = [p for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER)]
        #: Words can be encoded one by one if no piece has a marker behind another character.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in real)


def build(spec: Spec):
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if spec.kind == UNIGRAM:
        model = models.Unigram(list(zip(spec.pieces, spec.scores, strict=True)), spec.unk, spec.byte_fallback)
    else:
        rank = {p: i for i, (p, t) in enumerate(zip(spec.pieces, spec.types, strict=True)) if t in (NORMAL, USER, UNUSED)}
        merges = []
        for p, i in rank.items():
            for k in range(1, len(p)):
                if p[:k] in rank and p[k:] in rank:
                    merges.append((-spec.scores[i], i, k, (p[:k], p[k:])))
        merges.sort()
        vocab = {p: i for i, p in enumerate(spec.pieces)}
        model = models.BPE(vocab, [m[3] for m in merges], unk_token=spec.pieces[spec.unk], fuse_unk=True, byte_fallback=spec.byte_fallback)
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tail = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    user = [AddedToken(p, normalized=False) for p, t in zip(spec.pieces, spec.types, strict=True) if t == USER]
    if user:
        tok.add_tokens(user)
    return tok


class Codec:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # read when the library's threads start
        import sentencepiece
        from tokenizers import normalizers

        self.spec = Spec(path)
        self.tok = build(self.spec)
        self.bare = build(self.spec)  # for words: they are normalised already
        self.bare.normalizer = normalizers.Sequence([])
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.norm = self.tok.normalizer
        #: The normaliser may change more than blanks, or pieces may cross words: words then prove nothing about texts.
        self.lossy = bool(self.spec.charsmap) or self.spec.squeeze or not self.spec.by_word
        parts = [bytes([int(p[3:5], 16)]) if t == BYTE else p.encode() for p, t in zip(self.spec.pieces, self.spec.types, strict=True)]
        self.piece_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.piece_size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.cache = Cache(self.resolve)
        self.reset()

    def reset(self) -> None:
        self.cache.clear()
        # word k has ids pool[at[k]:at[k] + size[k]]
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # whether they spell the word, and whether the library gives the same
        self.back, self.parity = np.zeros(0, bool), np.zeros(0, bool)

    def normal(self, text: str) -> str:
        """The normalised text; without a character map and squeezing that is the prefix and the markers."""
        if not text or self.spec.charsmap or self.spec.squeeze:
            return self.norm.normalize_str(text) if text else ""
        return MARK * self.spec.dummy_prefix + text.replace(" ", MARK)

    def resolve(self, words: list[str]) -> np.ndarray:
        step = max(1, -(-len(words) // PARTS))
        parts = self.bare.encode_batch([words[i : i + step] for i in range(0, len(words), step)], is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in parts])
        n = np.concatenate([np.bincount(np.array(e.word_ids, np.int64), minlength=min(step, len(words) - k * step)) for k, e in enumerate(parts)])
        while len(self.pool) < self.used + len(ids):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint32))
        self.pool[self.used : self.used + len(ids)] = ids
        first = len(self.at)
        at = self.used + np.cumsum(n) - n
        self.at, self.size = np.append(self.at, at), np.append(self.size, n)
        self.used += len(ids)
        self.back = np.append(self.back, self._spells(words, ids, n))
        if not self.lossy:
            self.parity = np.append(self.parity, self._agrees(words, ids, n))
        return np.arange(first, len(self.at))

    def _spells(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the pieces of each word's ids, byte pieces as their byte, are its UTF-8."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        want, size = np.fromiter(map(len, raw), np.int64, len(raw)), self.piece_size[ids]
        at, edge = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(n))
        out = at[edge[1:]] - at[edge[:-1]] == want
        word = np.repeat(np.arange(len(words)), n)
        place = at[:-1] - at[edge[:-1]][word] + (np.cumsum(want) - want)[word]
        fits = out[word] & (size > 0)
        equal = same(np.frombuffer(b"".join(raw), np.uint8), place[fits], self.piece_bytes, self.piece_at[ids[fits]], size[fits])
        out[word[fits][~equal]] = False
        return out

    def _agrees(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the library gives each word's ids where it follows another word; a first word without a marker stands alone."""
        before = self.lib.encode("x")
        theirs = self.lib.encode(["x" + w.replace(MARK, " ") if w[0] == MARK else w for w in words], num_threads=1)
        theirs = [t[len(before) :] if w[0] == MARK else t for t, w in zip(theirs, words, strict=True)]
        m = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), np.uint32, int(m.sum()))
        out = m == n
        some = out & (n > 0)
        out[some] = same(ids, (np.cumsum(n) - n)[some], flat, (np.cumsum(m) - m)[some], n[some])
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bool, bool]]:
        """Per text: ids as little-endian uint32 bytes; whether the library gives the same for it; whether they decode to it."""
        out = []
        for _, part in in_slices(texts):
            out += self._encode(part)
        return out

    def _encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        if self.used > POOL_IDS:
            self.reset()
        normal = [self.normal(t) for t in texts]
        laid, cp, starts = lay(normal, None)
        ends = np.append(starts[1:], len(cp)) - 1
        head = cp != END_CP
        if self.spec.by_word:  # at the first of a run of markers, and at the start of a text
            mark = cp == ord(MARK)
            head[1:] &= mark[1:] & ~mark[:-1]
        else:
            head[:] = False
        head[starts[starts < ends]] = True
        begin = np.flatnonzero(head)
        end = np.minimum(np.append(begin[1:], len(cp)), ends[np.searchsorted(starts, begin, "right") - 1])
        word = self.cache.get(laid, cp, begin, end)
        n = self.size[word]
        total = np.append(0, np.cumsum(n))
        ids = self.pool[np.repeat(self.at[word] - total[:-1], n) + np.arange(total[-1])].astype("<u4")
        cut = np.searchsorted(begin, np.append(starts, len(cp)))
        edge = total[cut]

        def every(flag: np.ndarray) -> np.ndarray:
            bad = np.append(0, np.cumsum(~flag[word]))[cut]
            return bad[1:] == bad[:-1]

        out, back = [], every(self.back)
        if self.lossy:
            theirs = self.lib.encode(texts, num_threads=1)
        else:
            parity, theirs = every(self.parity), self.lib.normalize(texts)
        for k, t in enumerate(theirs):
            own = ids[edge[k] : edge[k + 1]]
            if self.lossy:
                same_ids, returns = own.tolist() == t, self.decode([own.tolist()])[0] == texts[k]
            else:  # only blanks have changed, so a text comes back unless it has markers itself
                same_ids, returns = bool(parity[k]) and t == normal[k], bool(back[k]) and MARK not in texts[k]
            out.append((own.tobytes(), same_ids, returns))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (uint32, little-endian), parity, round_trip; one row per row of docs, also for repeated ids.

    parity: the sentencepiece library gives the same ids for the whole text. round_trip: the ids decode to the text; a text that holds
    the marker itself decodes to a blank there. Null text is empty, has no ids and passes both. Columns other than the two named are left out.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, same, back = zip(*c.encode(part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(same), pa.array(back)], ["doc_id", "ids", "parity", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, parity boolean, round_trip boolean")


def decode_docs(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, from doc_id and ids."""
    path = path or default_path()
    rows = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [np.frombuffer(x or b"", "<u4").tolist() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.decode(ids), pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def piece_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, parity, round_trip."""
    out = encode_docs(docs)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "parity", "round_trip")
