"""SentencePiece BPE over whole texts: vectorised merge rounds encode, one gather decodes.

Spark partitions the documents. Inside a task, a text gets the model's dummy space, its spaces become the space sign, and it
is cut into words where no piece of the vocabulary reaches across. The words that the task's worker has not met yet become
one flat array of symbols, in segments: a segment also ends between two characters that stand side by side in no piece. In a
round, every segment finds its least pair rank (best score first) and contracts, from the left, the pairs that have it. It
stops behind the first contraction that makes a pair of the same or a better rank, as that one is due next; so a round does
just what the one-by-one order would. Segments without a pair leave, and the arrays are compacted, until none is left. A
word's ids don't depend on what stands around it, so a bounded cache of the worker keeps them.

Segments of more than ``LONG_SEGMENT`` symbols (a run of one sign, say) leave the rounds: spaces, whose runs all have
one score, would take a round for each contraction. A heap contracts the same pairs in the same order there.

Null and empty texts have the end id only. Texts may have any length: long ones are cut and encoded in blocks of words. Ids of
documents may be null; repeated rows are encoded each by itself; an empty table gives an empty table. Other columns travel
along unchanged; if a new column's name is taken, it gets underscores until it is free.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free_name, table

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Symbols of a segment from which on a heap contracts it, and symbols that one call of the rounds takes.
LONG_SEGMENT, ROUND_SYMBOLS = 256, 1 << 20
#: Words whose ids a worker keeps, their characters, and characters from which a word isn't kept.
CACHE_WORDS, CACHE_CHARS, LONG_WORD = 600_000, 16 << 20, 1 << 12
#: Characters from which a text is cut into words block by block, words of a block, and ids that are decoded at once.
BLOCK_CHARS, BLOCK_WORDS, BLOCK_IDS = 4 << 20, 200_000, 1 << 20
#: No pair.
NONE = np.int32((1 << 31) - 1)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


#: As the model's library shows byte pieces that aren't UTF-8: a sign for each byte.
codecs.register_error("sign-for-each-byte", _each_byte)


class Pieces:
    """Encoder and decoder of one SentencePiece BPE model for one worker process."""

    _made: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind, norm, trainer = model.SentencePiece, model.normalizer_spec, model.trainer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("the model must be a BPE model with byte pieces and spaces in front")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("the model must keep texts as they are")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("the model must have no user-defined and no unused pieces")
        self.dummy = SPACE if norm.add_dummy_prefix else ""
        self.end = next(k for k, p in enumerate(model.pieces) if p.piece == (trainer.eos_piece or "</s>"))
        normal = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self._read_tables(model, normal)
        self._read_pieces(model, kind)
        pieces = set(normal)
        crossed = any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:], strict=False))
        free = "".join(c for c in "\n\t\r" if not any(c in p for p in pieces if len(p) > 1))
        self.words = re.compile("(?s).+" if crossed else f"{SPACE}*[^{SPACE}{free}]+|{SPACE}+" + (f"|[{free}]+" if free else ""))
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _read_tables(self, model, normal: dict[str, int]) -> None:
        """Symbols are piece ids; characters that only stand inside longer pieces get numbers behind them."""
        symbols = dict(normal)
        for piece in normal:
            for char in piece:
                symbols.setdefault(char, len(model.pieces) + len(symbols))
        scores = sorted({model.pieces[k].score for k in normal.values()}, reverse=True)
        rank = {score: k for k, score in enumerate(scores)}
        pairs = {}
        for piece, made in normal.items():
            for k in range(1, len(piece)):
                if (a := symbols.get(piece[:k])) is not None and (b := symbols.get(piece[k:])) is not None:
                    pairs[a << 32 | b] = (rank[model.pieces[made].score], made)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.r_[keys, np.int64((1 << 63) - 1)]
        found = np.array([pairs[k] for k in keys.tolist()], np.int32).reshape(-1, 2)
        self.pair_rank, self.pair_made = np.r_[found[:, 0], NONE], np.r_[found[:, 1], np.int32(-1)]
        # characters of pieces by code point, and which of them stand side by side in a piece
        chars = sorted({c for p in normal for c in p})
        self.char = np.full(0x110000, len(chars), np.uint16 if len(chars) < 1 << 16 else np.uint32)
        self.char[list(map(ord, chars))] = np.arange(len(chars))
        self.char_symbol = np.array([*(symbols[c] for c in chars), -1], np.int32)
        place = {c: k for k, c in enumerate(chars)}
        beside = np.array(sorted({(place[a], place[b]) for p in normal for a, b in zip(p, p[1:], strict=False)}), np.int64).reshape(-1, 2)
        self.stride = len(chars) + 1
        self.beside = np.zeros(self.stride * self.stride // 8 + 1, np.uint8)  # a bit for each two characters
        bits = beside[:, 0] * self.stride + beside[:, 1]
        np.bitwise_or.at(self.beside, bits >> 3, np.left_shift(1, bits & 7).astype(np.uint8))
        self.n_normal = len(model.pieces)
        self.byte_ids = np.zeros(256, np.int64)
        for k, p in enumerate(model.pieces):
            if p.type == model.SentencePiece.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = k

    def _read_pieces(self, model, kind) -> None:
        """What each id stands for, as bytes: all in a row, with their bounds."""
        out = []
        for p in model.pieces:
            if p.type == kind.CONTROL:
                out.append(b"")
            elif p.type == kind.UNKNOWN:
                out.append((model.trainer_spec.unk_surface or " ⁇ ").encode())
            elif p.type == kind.BYTE:
                out.append(bytes([int(p.piece[3:5], 16)]))
            else:
                out.append(p.piece.replace(SPACE, " ").encode())
        self.is_byte = np.array([p.type == kind.BYTE for p in model.pieces])
        self.is_control = np.array([p.type == kind.CONTROL for p in model.pieces])
        self.leading = np.array([p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.size = np.array([len(x) for x in out], np.int64)
        self.shown, self.at = np.frombuffer(b"".join(out), np.uint8), np.cumsum(self.size) - self.size

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of each pair in the pair tables; pairs that make no piece have the last one."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pair_keys, keys)
        at[self.pair_keys[at] != keys] = len(self.pair_keys) - 1
        return at

    def _heap(self, symbols: list[int]) -> list[int]:
        """The symbols left of a long segment, by the same contractions, with a heap of pairs."""
        n, none = len(symbols), len(self.pair_keys) - 1
        table, nxt, back = {}, list(range(1, n + 1)), list(range(-1, n - 1))

        def look(i: int, heap: list | None) -> None:
            j = nxt[i]
            if j < n:
                pair = (symbols[i], symbols[j])
                if pair not in table:
                    k = int(self._ranked(np.array(pair[:1]), np.array(pair[1:]))[0])
                    table[pair] = None if k == none else (int(self.pair_rank[k]), int(self.pair_made[k]))
                if (found := table[pair]) is not None:
                    heapq.heappush(heap, (found[0], i, pair, found[1]))

        heap: list = []
        for i in range(n):
            look(i, heap)
        while heap:
            _, i, pair, made = heapq.heappop(heap)
            j = nxt[i]
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                back[nxt[i]] = i
            look(i, heap)
            if back[i] >= 0:
                look(back[i], heap)
        return [x for x in symbols if x >= 0]

    def _rounds(self, sym: np.ndarray, seg: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left, and the places where they start, after all contractions inside segments (numbers that don't fall)."""
        done_sym, done_place = [], []
        last = len(self.pair_keys) - 1
        entry = np.full(len(sym), last)
        inside = np.flatnonzero(seg[:-1] == seg[1:]) if len(sym) else np.empty(0, np.int64)
        entry[inside] = self._ranked(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sizes = np.diff(np.r_[first, len(seg)])
            rank = self.pair_rank[entry]
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least < NONE, sizes)
            if not open_.all():  # compaction: segments without a pair leave
                done_sym.append(sym[~open_])
                done_place.append(place[~open_])
                sym, seg, place, entry, rank = sym[open_], seg[open_], place[open_], entry[open_], rank[open_]
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of pairs that overlap, every second one, from the left
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            hit = hit[(hit - np.repeat(hit[run], np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            made = self.pair_made[entry[hit]]
            # the pairs that each one makes as it is contracted: what is left of it is contracted already, what is right isn't
            new = np.full(len(hit), NONE)
            before = np.flatnonzero((hit > 0) & (seg[hit - 1] == seg[hit]))
            joined = np.r_[False, np.diff(hit) == 2]
            neighbour = np.where(joined, np.r_[np.int32(-1), made[:-1]], sym[hit - 1])
            new[before] = self.pair_rank[self._ranked(neighbour[before], made[before])]
            behind = np.minimum(hit + 2, len(sym) - 1)
            after = np.flatnonzero((hit + 2 < len(sym)) & (seg[behind] == seg[hit]))
            new[after] = np.minimum(new[after], self.pair_rank[self._ranked(made[after], sym[behind[after]])])
            stop = new <= rank[hit]
            own = seg[hit]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            stops = np.cumsum(stop) - stop  # stops before each one
            keep = stops == np.repeat(stops[start], np.diff(np.r_[start, len(own)]))
            hit, made = hit[keep], made[keep]
            sym[hit] = made
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            at = (np.cumsum(stay) - 1)[hit]
            sym, seg, place, entry = sym[stay], seg[stay], place[stay], entry[stay]
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            entry[changed] = last
            renew = np.flatnonzero(changed[:-1])
            renew = renew[seg[renew] == seg[renew + 1]]
            entry[renew] = self._ranked(sym[renew], sym[renew + 1])
        if not done_sym:
            return sym, place
        sym, place = np.concatenate(done_sym), np.concatenate(done_place)
        order = np.argsort(place)
        return sym[order], place[order]

    def _merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lens = np.array([len(w) for w in words])
        ends = np.cumsum(lens)
        char = self.char[points]
        sym = self.char_symbol[char]
        side = char[:-1].astype(np.int64) * self.stride + char[1:]
        cut = np.ones(len(points), bool)
        cut[1:] = self.beside[side >> 3] >> (side & 7).astype(np.uint8) & 1 == 0
        cut[ends[:-1]] = True
        first = np.flatnonzero(cut)
        sizes = np.diff(np.r_[first, len(points)])
        seg = np.repeat(np.arange(len(first), dtype=np.int32), sizes)
        place = np.arange(len(points))
        usual = np.repeat((sizes <= LONG_SEGMENT) & (sizes > 1), sizes)
        parts = [(sym[x := np.repeat(sizes == 1, sizes)], place[x]), self._rounds(sym[usual], seg[usual], place[usual])]
        for k in np.flatnonzero(sizes > LONG_SEGMENT).tolist():
            left = np.array(self._heap(sym[first[k] : first[k] + sizes[k]].tolist()), np.int32)
            parts.append((left, np.arange(first[k], first[k] + len(left))))  # in order; inside the segment no place is needed
        sym, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(place)
        sym, place = sym[order], place[order]
        # characters without a piece become their bytes
        loose = np.flatnonzero((sym < 0) | (sym >= self.n_normal))
        if len(loose):
            raw = [chr(p).encode() for p in points[place[loose]].tolist()]
            times = np.ones(len(sym), np.int64)
            times[loose] = [len(x) for x in raw]
            starts = np.cumsum(times) - times
            sym, place = np.repeat(sym, times), np.repeat(place, times)
            where = np.repeat(starts[loose], times[loose]) + np.concatenate([np.arange(len(x)) for x in raw])
            sym[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        cuts = np.r_[0, np.searchsorted(place, ends)] * 4
        data = sym.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def learn(self, words: set[str]) -> None:
        """Put the ids of these words into the cache, in calls of about ``ROUND_SYMBOLS`` symbols."""
        new = words.difference(self.cache)
        size = sum(map(len, new))
        if len(self.cache) + len(new) > CACHE_WORDS or self.held + size > CACHE_CHARS:
            self.cache.clear()
            self.held, new = 0, words
            size = sum(map(len, new))
        self.held += size
        todo = list(new)
        ends = np.cumsum(list(map(len, todo)))
        at = 0
        while at < len(todo):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROUND_SYMBOLS, side="right")))
            self.cache.update(zip(todo[at:end], self._merge(todo[at:end]), strict=True))
            at = end

    def _ids(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of lists of words."""
        words = set().union(*cut)
        self.learn(words)
        get = self.cache.__getitem__
        out = [b"".join(map(get, some)) for some in cut]
        for word in [w for w in words if len(w) > LONG_WORD]:
            self.held -= len(word)
            del self.cache[word]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, the end id last, as little-endian unsigned 32-bit integers."""
        end = int(self.end).to_bytes(4, "little")
        cut = [self.words.findall(self.dummy + t.replace(" ", SPACE)) if t and len(t) <= BLOCK_CHARS else [] for t in texts]
        out = [ids + end for ids in self._ids(cut)]
        for k, text in enumerate(texts):
            if text and len(text) > BLOCK_CHARS:
                found, parts = self.words.finditer(self.dummy + text.replace(" ", SPACE)), []
                while some := [m[0] for m in islice(found, BLOCK_WORDS)]:
                    parts += self._ids([some])
                out[k] = b"".join([*parts, end])
        return out

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text that ids stand for: without the dummy space, and with a replacement sign for each byte of byte
        pieces that isn't UTF-8 there."""
        found, out, began = np.frombuffer(ids, "<u4"), [], False
        # control pieces show nothing, but byte pieces before and after one don't make a character together
        for some in np.split(found, np.flatnonzero(self.is_control[found])):
            some = some[1:] if len(some) and self.is_control[some[0]] else some
            if len(some) and not began and self.dummy and self.leading[some[0]]:
                out.append(self.shown[self.at[some[0]] + 1 : self.at[some[0]] + self.size[some[0]]].tobytes())
                some, began = some[1:], True
            began = began or len(some) > 0
            out += self._shown(some)
        return b"".join(out)

    def _shown(self, ids: np.ndarray) -> Iterator[bytes]:
        at = 0
        while at < len(ids):
            end = min(at + BLOCK_IDS, len(ids))
            while end < len(ids) and self.is_byte[ids[end]]:
                end += 1  # a run of byte pieces is decoded as one
            some = ids[at:end]
            size = self.size[some]
            data = self.shown[np.repeat(self.at[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
            # pieces are whole characters, so only byte pieces can be at fault, and a fault ends where a piece begins
            try:
                data.decode()
            except UnicodeDecodeError:
                data = data.decode(errors="sign-for-each-byte").encode()
            yield data
            at = end


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the text's ids and the end id, as a binary of little-endian unsigned 32-bit integers. Map-only."""
    ids_col = free_name(ids_col, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in chunks(batches, text_col):
            ids = pieces.encode(batch[text_col].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, ids_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.BinaryType())]))


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with ``out_col``: the text that the ids stand for (null ids: empty). Map-only."""
    out_col = free_name(out_col, coded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in chunks(batches, ids_col):
            raw = [pieces.decode(x or b"").decode() for x in batch[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.string())], [*batch.schema.names, out_col])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(out_col, T.StringType())]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _decimal(ids: bytes) -> str:
    """Digest of the decimal ids, joined by spaces."""
    sha, found = hashlib.sha256(), np.frombuffer(ids, "<u4")
    for at in range(0, len(found), BLOCK_IDS):
        sha.update((b" " if at else b"") + " ".join(map(str, found[at : at + BLOCK_IDS].tolist())).encode())
    return sha.hexdigest()


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode whole texts; only counts and digests leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in chunks(batches):
            ids = pieces.encode(batch["text"].to_pylist())
            cols = [batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(_decimal, ids), pa.string())]
            cols.append(pa.array([hashlib.sha256(pieces.decode(x)).hexdigest() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), default_model())
