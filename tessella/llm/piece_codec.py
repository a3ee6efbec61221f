"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The escaped text falls into words no piece can reach across (before a word mark that follows another character, around
line ends that are in no piece). The different words of a block are merged together: symbols lie in one flat array; each
round takes the smallest pair rank of every word, merges its leftmost non-overlapping occurrences at once, looks up the
new pairs only, and squeezes the arrays, until no pair remains. Where a merge makes a pair that must come before the
remaining occurrences, the word's later merges of that round wait, so the result equals one merge at a time.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import blocks, map_rows, read

MARK = "▁"
NEVER = np.iinfo(np.int32).max
#: Words a task keeps encoded before it starts anew; only speed depends on it.
KEPT_WORDS = 200_000
#: The longest piece of marks alone has 16 of them, so a longer run falls into such pieces from the left.
WORDS = re.compile(f"{MARK}{{16}}(?={MARK}{MARK})|{MARK}*[^{MARK}]+|{MARK}+")


def join_rows(table: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated rows of a ragged table (values, offsets), and the end of each in it."""
    values, offsets = table
    lens = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lens)
    if not len(rows):
        return values[:0], ends
    return values[np.repeat(offsets[rows] - ends + lens, lens) + np.arange(ends[-1])], ends


def ragged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))


class PieceCodec:
    """Encoder and decoder of one BPE model with byte fallback, dummy prefix and no character map."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.n = n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if sp.encode(" a  b", out_type=str)[0][:1] != MARK or any(sp.is_unused(i) for i in normal):
            raise ValueError("only BPE models with a dummy prefix, kept spaces and no unused pieces are supported")
        self.id_of = {pieces[i]: i for i in normal}
        self.byte_id = np.array([self._byte(sp, pieces, b) for b in range(256)], np.int64)
        values = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in normal}))}
        self.solo_line = not any("\n" in p for p in self.id_of)
        if any(MARK in p.lstrip(MARK) for p in self.id_of) or max((len(p) for p in self.id_of if not p.strip(MARK)), default=0) != 16:
            raise ValueError("words of this model can't be told by their marks")
        found = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.symbol(p[:k]), self.symbol(p[k:])
                if a >= 0 and b >= 0:
                    found[a * self.base + b] = (values[-sp.get_score(i)], i)
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()] + [NEVER], np.int32)
        self.merged = np.array([found[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.decoded = ragged([b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else pieces[i].replace(MARK, " ").encode() for i in range(n)])
        self.decimal = ragged([b"%d," % i for i in range(n)])
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.marked = np.array([pieces[i].startswith(MARK) for i in range(n)])
        self.forget()

    base = 1 << 21

    @staticmethod
    def _byte(sp, pieces: list[str], b: int) -> int:
        i = sp.piece_to_id(f"<0x{b:02X}>")
        if not sp.is_byte(i):
            raise ValueError("the model has no byte fallback")
        return i

    def symbol(self, part: str) -> int:
        """Symbol of a piece, or of a character that is none (piece count + code point), else -1."""
        i = self.id_of.get(part)
        return i if i is not None else self.n + ord(part) if len(part) == 1 else -1

    def forget(self) -> None:
        self.word_at: dict[str, int] = {}
        self.tokens, self.ends, self.first = [], [0], [0]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of symbol pairs; NEVER if they don't merge."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else np.zeros(len(key), np.int64)
        return self.ranks[at], self.merged[at]

    def words(self, text: str) -> list[str]:
        out: list[str] = []
        if not text:
            return out
        text = MARK + text.replace(" ", MARK)
        for k, line in enumerate(text.split("\n") if self.solo_line else [text]):
            if k:
                out.append("\n")
            if MARK + MARK in line:
                out += WORDS.findall(line)
            elif line:
                head, *rest = line.split(MARK)
                if head:
                    out.append(head)
                out += [MARK + w for w in rest]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of non-empty words, all in the same merge rounds."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        kinds, back = np.unique(chars, return_inverse=True)
        sym = np.array([self.symbol(chr(c)) for c in kinds.tolist()], np.int64)[back]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank, result = self.lookup(sym, np.append(sym[1:], 0))
        rank[np.append(word[1:] != word[:-1], True)] = NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == NEVER
            if over.any():
                done.append((word[over], sym[over]))
                live = ~over
                sym, word, rank, result, least = sym[live], word[live], rank[live], result[live], least[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
            at = at[(at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]) % 2 == 0]
            made = result[at]
            own = word[at]
            # the left neighbour as it is after the merges to its left, the right one as it is before those to its right
            two = np.concatenate(([False], at[1:] == at[:-1] + 2)) & np.concatenate(([False], own[1:] == own[:-1]))
            before = np.maximum(at - 1, 0)
            left = np.where(two, np.concatenate(([0], made[:-1])), sym[before])
            has_left = (at > 0) & (word[before] == own)
            after = np.minimum(at + 2, len(sym) - 1)
            has_right = (at + 2 < len(sym)) & (word[after] == own)
            rank_l, result_l = self.lookup(left, made)
            rank_r, result_r = self.lookup(made, sym[after])
            rank_l[~has_left] = NEVER
            rank_r[~has_right] = NEVER
            urgent = np.minimum(rank_l, rank_r) <= least[at]
            if urgent.any():  # merges behind the first urgent one of a word wait
                seen = np.cumsum(urgent)
                heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                base = np.repeat(seen[heads] - urgent[heads], np.diff(np.append(heads, len(own))))
                go = seen - urgent - base == 0
                at, made, has_left = at[go], made[go], has_left[go]
                rank_l, result_l, rank_r, result_r = rank_l[go], result_l[go], rank_r[go], result_r[go]
            sym[at], rank[at], result[at] = made, rank_r, result_r
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            to = at[has_left] - 1
            to -= ~keep[to]
            rank[to], result[to] = rank_l[has_left], result_l[has_left]
            sym, word, rank, result = sym[keep], word[keep], rank[keep], result[keep]
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        by = np.argsort(word, kind="stable")
        word, sym = word[by], sym[by]
        odd = np.flatnonzero(sym >= self.n)
        if len(odd):  # characters without a piece become their bytes
            spelled = [np.frombuffer(chr(c).encode(), np.uint8) for c in (sym[odd] - self.n).tolist()]
            lens = np.ones(len(sym), np.int64)
            lens[odd] = [len(b) for b in spelled]
            first = np.cumsum(lens) - lens
            word, sym = np.repeat(word, lens), np.repeat(sym, lens)
            sym[np.repeat(first[odd], lens[odd]) + np.concatenate([np.arange(len(b)) for b in spelled])] = self.byte_id[np.concatenate(spelled)]
        return sym, np.searchsorted(word, np.arange(len(words) + 1))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts."""
        split = [self.words(t or "") for t in texts]
        if len(self.word_at) > KEPT_WORDS:
            self.forget()
        new = [w for w in dict.fromkeys(w for x in split for w in x) if w not in self.word_at]
        if new:
            ids, offsets = self.encode_words(new)
            self.word_at.update(zip(new, range(len(self.word_at), len(self.word_at) + len(new))))
            self.tokens.append(ids)
            self.ends.extend((offsets[1:] + self.ends[-1]).tolist())
            self.tokens = [np.concatenate(self.tokens)]
        rows = np.fromiter((self.word_at[w] for x in split for w in x), np.int64)
        ids, ends = join_rows((self.tokens[0] if self.tokens else np.zeros(0, np.int64), np.array(self.ends)), rows)
        of_text = np.cumsum([0, *map(len, split)])
        return ids, np.concatenate(([0], ends))[of_text]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of id rows: marks become spaces but for one before the first piece, bytes become characters (U+FFFD
        for each byte that belongs to none)."""
        raw, ends = join_rows(self.decoded, ids)
        ends = np.concatenate(([0], ends))
        breaks = np.flatnonzero(self.control[ids])
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            cuts = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)].tolist()
            lead = a
            while lead < b and self.control[ids[lead]]:
                lead += 1
            start = ends[a] + (1 if lead < b and self.marked[ids[lead]] else 0)
            edges = [start, *[e for c in cuts if (e := ends[c]) > start], ends[b]]  # bytes don't join across control pieces
            out.append("".join(self._text(raw[x:y].tobytes()) for x, y in zip(edges, edges[1:])))
        return out

    def _text(self, data: bytes) -> str:
        try:
            return data.decode()
        except UnicodeDecodeError:
            return "".join(self._spell(data))

    @staticmethod
    def _spell(data: bytes):
        at = 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    yield data[at : at + n].decode()
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                yield "�"
                at += 1


@lru_cache(2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) added. Null and empty texts have none. ``model_path`` is a file on every host."""
    path = model_path or default_model()
    kept = [c for c in docs.columns if c != "token_ids"]
    df = docs.select(*kept, F.expr("cast(null as array<int>)").alias("token_ids"))
    at = kept.index(text_col)

    def work(batch: pa.RecordBatch) -> dict:
        texts, out = batch.column(at).to_pylist(), []
        for lo, hi in blocks(texts):
            ids, offsets = codec(path).encode(texts[lo:hi])
            out += [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        return dict(zip(kept, batch.columns)) | {"token_ids": [x.astype(np.int32) for x in out]}

    return map_rows(df, df.schema, work)


def decode(docs: DataFrame, model_path: str | None = None, ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded`` (string) from an array of ids; null and empty arrays give the empty text."""
    path = model_path or default_model()
    kept = [c for c in docs.columns if c != "decoded"]
    df = docs.select(*kept, F.lit("").alias("decoded"))
    at = kept.index(ids_col)

    def work(batch: pa.RecordBatch) -> dict:
        rows = [np.array(x or [], np.int64) for x in batch.column(at).to_pylist()]
        offsets = np.cumsum([0, *map(len, rows)])
        return dict(zip(kept, batch.columns)) | {"decoded": codec(path).decode(np.concatenate([np.zeros(0, np.int64), *rows]), offsets)}

    return map_rows(df, df.schema, work)


def digest(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text, decodes the ids, and hashes both."""
    path = model_path or default_model()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def work(batch: pa.RecordBatch) -> dict:
        texts, model = batch.column(1).to_pylist(), codec(path)
        n, of_ids, of_text = [], [], []
        for lo, hi in blocks(texts):
            ids, offsets = model.encode(texts[lo:hi])
            n += np.diff(offsets).tolist()
            of_text += [hashlib.sha256(t.encode()).hexdigest() for t in model.decode(ids, offsets)]
            digits, ends = join_rows(model.decimal, ids)
            at = np.concatenate(([0], ends))[offsets].tolist()
            of_ids += [hashlib.sha256(digits[a : max(a, b - 1)].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:])]
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_rows(docs.select("doc_id", "text"), schema, work)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
