"""Byte-level BPE encoding and decoding over length-bucketed, padded matrices.

The matches of a split pattern are encoded separately. The different words of a block are dealt into buckets of like length;
a bucket is a matrix with a row for each word and padding on the right. In a round every row merges its leftmost pair of
least rank, so each row loses one symbol and the matrix one column; the two pairs that changed are looked up in a hash table
of pairs, and rows with no pair left go out. Rows longer than ``LONG`` merge, still from the left, all occurrences of their
least pair that no newly made pair has to come before, so the result is that of one merge at a time.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import blocks, map_rows, read
from tessella.llm.piece_codec import join_rows, ragged

NEVER = np.iinfo(np.int32).max
PAD = -1
#: Bytes of a word beyond which it is merged by itself.
LONG = 512
#: Cells of one bucket matrix.
CELLS = 1 << 20
#: Words a task keeps encoded before it starts anew; only speed depends on it.
KEPT_WORDS = 200_000


class PairTable:
    """Hash table (open addressing, vectorised) from symbol pairs to the symbol they make, which is their rank too."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        bits = max(4, (2 * len(made)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.made = np.full(1 << bits, NEVER, np.int32)
        key = self.key(left, right)
        slot, todo = self.slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = key[free]  # of several for one slot the last one written stays
            stays = self.keys[slot[todo]] == key[todo]
            self.made[slot[todo[stays]]] = made[todo[stays]]
            todo = todo[~stays]
            slot[todo] = (slot[todo] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol each pair makes, NEVER if none. No pair holds padding."""
        key = self.key(left, right)
        slot, at = self.slot(key), np.arange(len(key))
        out = np.full(len(key), NEVER, np.int32)
        while len(at):
            have = self.keys[slot[at]]
            hit = have == key[at]
            out[at[hit]] = self.made[slot[at[hit]]]
            at = at[~hit & (have >= 0)]
            slot[at] = (slot[at] + 1) & self.mask
        return out


class ByteCodec:
    """Encoder and decoder of one file of byte ranks; ``pattern`` splits texts, by default the public one."""

    def __init__(self, ranks_path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(ranks_path, "rb") as file:
            self.id_of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.split = regex.compile(pattern or public_tokenizers.PATTERN)
        self.of_byte = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for token, rank in self.id_of.items():
            for k in range(1, len(token)):
                a, b = self.id_of.get(token[:k]), self.id_of.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.pairs = PairTable(np.array(left, np.int32), np.array(right, np.int32), np.array(made, np.int32))
        spelled = {rank: token for token, rank in self.id_of.items()}
        self.known = np.array([i in spelled for i in range(max(spelled) + 1)])
        self.decoded = ragged([spelled.get(i, b"") for i in range(len(self.known))])
        self.forget()

    def forget(self) -> None:
        self.word_at: dict[str, int] = {}
        self.tokens, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _merge_matrix(self, sym: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, their symbols with padding) of a padded matrix, in parts, when no pair is left."""
        done = []
        row = np.arange(len(sym))
        rank = self.pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(sym), -1)
        while len(row) and rank.shape[1]:
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(row)), at]
            over = least == NEVER
            if over.any():
                done.append((row[over], sym[over]))
                live = ~over
                row, sym, rank, at, least = row[live], sym[live], rank[live], at[live], least[live]
                if not len(row):
                    return done
            line = np.arange(len(row))
            sym[line, at] = least
            stays = np.ones(sym.shape, bool)
            stays[line, at + 1] = False
            sym = sym[stays].reshape(len(row), -1)
            stays = np.ones(rank.shape, bool)
            stays[line, at] = False
            rank = rank[stays].reshape(len(row), -1)
            on = line[at > 0]
            rank[on, at[on] - 1] = self.pairs(sym[on, at[on] - 1], least[on])
            on = line[at < rank.shape[1]]
            rank[on, at[on]] = self.pairs(least[on], sym[on, at[on] + 1])
        done.append((row, sym))
        return done

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        rank = self.pairs(sym[:-1], sym[1:])
        while len(rank) and (least := rank.min()) != NEVER:
            at = np.flatnonzero(rank == least)
            head = np.maximum.accumulate(np.where(np.concatenate(([True], at[1:] != at[:-1] + 1)), at, 0))
            at = at[(at - head) % 2 == 0]
            made = np.full(len(at), least, np.int32)
            beside = np.concatenate(([False], at[1:] == at[:-1] + 2))
            first = np.where(at > 0, self.pairs(np.where(beside, least, sym[at - 1]), made), NEVER)
            second = np.where(at + 2 < len(sym), self.pairs(made, sym[np.minimum(at + 2, len(sym) - 1)]), NEVER)
            urgent = np.minimum(first, second) <= least
            if urgent.any():  # what this merge has made comes before the merges behind it
                at = at[: urgent.argmax() + 1]
            sym[at] = least
            sym, rank = np.delete(sym, at + 1), np.delete(rank, at)
            at = at - np.arange(len(at))
            for on in (at[at > 0] - 1, at[at < len(rank)]):
                rank[on] = self.pairs(sym[on], sym[on + 1])
        return sym

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words, each encoded by itself."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # word of each id, ids
        whole = np.array([self.id_of.get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(whole >= 0)
        parts.append((at, whole[at].astype(np.int32)))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero((whole < 0) & (size > LONG)).tolist():
            ids = self._merge_long(self.of_byte[np.frombuffer(words[i], np.uint8)])
            parts.append((np.full(len(ids), i), ids))
        rest = np.flatnonzero((whole < 0) & (size > 0) & (size <= LONG))
        rest = rest[np.argsort(size[rest], kind="stable")]
        bucket = np.ceil(2 * np.log2(size[rest])).astype(np.int64)  # two buckets for each doubling of the length
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for group in np.split(rest, cuts):
            width = int(size[group].max(initial=1))
            for lo in range(0, len(group), step := max(1, CELLS // width)):
                some = group[lo : lo + step]
                data, ends = np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8), np.cumsum(size[some])
                sym = np.full((len(some), width), PAD, np.int32)
                sym[np.arange(width) < size[some][:, None]] = self.of_byte[data[: ends[-1]]]
                for row, left in self._merge_matrix(sym):
                    real = left != PAD
                    parts.append((np.repeat(some[row], real.sum(axis=1)), left[real]))
        word, ids = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(word, kind="stable")
        return ids[by], np.searchsorted(word[by], np.arange(len(words) + 1))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts."""
        split = [self.split.findall(t) if t else [] for t in texts]
        if len(self.word_at) > KEPT_WORDS:
            self.forget()
        new = [w for w in dict.fromkeys(w for x in split for w in x) if w not in self.word_at]
        if new:
            ids, offsets = self.encode_words([w.encode() for w in new])
            self.word_at.update(zip(new, range(len(self.word_at), len(self.word_at) + len(new))))
            self.tokens, self.ends = np.concatenate((self.tokens, ids)), np.concatenate((self.ends, offsets[1:] + self.ends[-1]))
        rows = np.fromiter((self.word_at[w] for x in split for w in x), np.int64)
        ids, ends = join_rows((self.tokens, self.ends), rows)
        return ids, np.concatenate(([0], ends))[np.cumsum([0, *map(len, split)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of id rows. An id that the file doesn't hold is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        raw, ends = join_rows(self.decoded, ids)
        at = np.concatenate(([0], ends))[offsets].tolist()
        return [raw[a:b].tobytes() for a, b in zip(at, at[1:])]


@lru_cache(2)
def codec(ranks_path: str, pattern: str | None = None) -> ByteCodec:
    return ByteCodec(ranks_path, pattern)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``byte_ids`` (array<int>) added; an own column of this name is replaced. Null and empty texts have none.

    ``ranks_path`` is a file on every host. Rows map one to one, so repeated rows and null ids stay as they are.
    """
    path = ranks_path or default_ranks()
    kept = [c for c in docs.columns if c != "byte_ids"]
    df = docs.select(*kept, F.expr("cast(null as array<int>)").alias("byte_ids"))
    at = kept.index(text_col)

    def work(batch: pa.RecordBatch) -> dict:
        texts, out = batch.column(at).to_pylist(), []
        for lo, hi in blocks(texts):
            ids, offsets = codec(path, pattern).encode(texts[lo:hi])
            out += [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        return dict(zip(kept, batch.columns)) | {"byte_ids": out}

    return map_rows(df, df.schema, work)


def decode(docs: DataFrame, ranks_path: str | None = None, ids_col: str = "byte_ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary, as ids may end inside a character); null and empty arrays give no bytes."""
    path = ranks_path or default_ranks()
    kept = [c for c in docs.columns if c != "decoded"]
    df = docs.select(*kept, F.lit(b"").alias("decoded"))
    at = kept.index(ids_col)

    def work(batch: pa.RecordBatch) -> dict:
        rows = [np.array(x or [], np.int64) for x in batch.column(at).to_pylist()]
        return dict(zip(kept, batch.columns)) | {"decoded": codec(path).decode(np.concatenate([np.zeros(0, np.int64), *rows]), np.cumsum([0, *map(len, rows)]))}

    return map_rows(df, df.schema, work)


def digest(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encodes whole texts, decodes the ids, and hashes both.

    Ids are hashed as little-endian unsigned 32-bit integers. Null texts count as empty.
    """
    path = ranks_path or default_ranks()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def work(batch: pa.RecordBatch) -> dict:
        texts, model = batch.column(1).to_pylist(), codec(path)
        n, of_ids, of_text = [], [], []
        for lo, hi in blocks(texts):
            ids, offsets = model.encode(texts[lo:hi])
            n += np.diff(offsets).tolist()
            of_text += [hashlib.sha256(t).hexdigest() for t in model.decode(ids, offsets)]
            of_ids += [hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_rows(docs.select("doc_id", "text"), schema, work)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
