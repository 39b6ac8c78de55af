"""Encoding with a BPE model of sentencepiece, and decoding, on flat numpy arrays.

The model's pieces and scores are read by the sentencepiece library; the merging is done here. A text is cut
into segments, each a run of spaces with the characters up to the next space: no piece has a space after
another character, so merges never cross segments. Equal segments are merged once. All segments of a batch
lie in one flat symbol array; each round finds the best pair of every segment by a segmented minimum of ranks,
merges all its leftmost occurrences at once and compacts the array, until no pair is left.

Defined results: a null text counts as empty and has only the begin and end ids. Texts of any length are
encoded whole. Characters without a piece become byte pieces. U+2581 counts as a space, as in the library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm.text import flat, gather, pieces, prefix_hash, span_hash

SPACE = "▁"
EMPTY = pa.scalar("", pa.large_string())
NONE = np.iinfo(np.int64).max
#: Segments kept merged in a worker before the store is begun anew.
STORE = 400_000


class Model:
    """Vocabulary of a BPE model with byte fallback, without text normalization, with the space prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = {t: i for i, t in enumerate(text) if not special[i]}
        if any(SPACE in t.lstrip(SPACE) for t in plain):
            raise ValueError("a piece has a space after another character: segments would not be independent")
        self.byte0 = sp.piece_to_id("<0x00>")
        if not sp.is_byte(self.byte0):
            raise ValueError("the model has no byte pieces")
        # characters by code point; those without a piece get numbers from n on
        self.n, self.extra = n, {}
        self.char_id = np.full(0x110000, -1, np.int32)
        for t, i in plain.items():
            if len(t) == 1:
                self.char_id[ord(t)] = i
        score = np.array([sp.get_score(i) for i in range(n)])
        rows = []
        for t, i in plain.items():
            for k in range(1, len(t)):
                a, b = self._symbol(t[:k], plain), self._symbol(t[k:], plain)
                if a is not None and b is not None:
                    rows.append((a, b, -score[i], i))
        rank_of = {r: k for k, r in enumerate(sorted({r[2] for r in rows}))}
        self.width = n + len(self.extra) + 1
        keys = np.array([r[0] * self.width + r[1] for r in rows], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.array([rank_of[r[2]] for r in rows], np.int64)[order]
        self.into = np.array([r[3] for r in rows], np.int64)[order]
        # all occurrences of a pair may merge at once if nothing that its piece goes into ranks above the piece
        best = {r[3]: rank_of[r[2]] for r in rows}
        ahead = {part for r in rows for part in r[:2] if best.get(part, -1) >= rank_of[r[2]]}
        self.at_once = np.array([r[3] not in ahead for r in rows])[order]
        body = [bytes([i - self.byte0]) if self.byte0 <= i < self.byte0 + 256 else b"" if special[i] else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.body = np.frombuffer(b"".join(body), np.uint8)
        self.body_len = np.array([len(b) for b in body], np.int64)
        self.body_at = np.cumsum(self.body_len) - self.body_len
        self._clear()

    def _symbol(self, t: str, plain: dict[str, int]) -> int | None:
        if t in plain:
            return plain[t]
        if len(t) > 1:
            return None
        number = self.extra.setdefault(t, self.n + len(self.extra))
        self.char_id[ord(t)] = number
        return number

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_len = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    # -- merging

    def pair_rank(self, symbols: np.ndarray, last: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the symbols at `where` with their right neighbours, and places in the pair table; NONE at segment ends and for no piece."""
        left, right = symbols[where], symbols[np.minimum(where + 1, len(symbols) - 1)]
        key = np.where(last[where] | (left < 0) | (right < 0), -1, left * self.width + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), at

    def merge(self, symbols: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges until no pair is left. seg: the sorted segment number of each symbol. Returns symbols, segments and the index of each symbol's first character."""
        first = np.arange(len(symbols))
        last = np.r_[seg[1:] != seg[:-1], True]
        rank, at = self.pair_rank(symbols, last, first)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, last[:-1]])
            of = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.r_[heads, len(symbols)]))
            if not (still := of != NONE).all():
                done.append((symbols[~still], seg[~still], first[~still]))
                symbols, seg, first, last, rank, at, of = (x[still] for x in (symbols, seg, first, last, rank, at, of))
                if not len(symbols):
                    break
            # in a run of overlapping occurrences every other one merges, from the left
            run = np.flatnonzero(rank == of)
            nth = np.arange(len(run))
            begin = np.maximum.accumulate(np.where(np.r_[True, np.diff(run) > 1], nth, 0))
            run = run[(nth - begin) & 1 == 0]
            # of a pair whose piece can go on at a better rank, the leftmost only
            own = seg[run]
            run = run[self.at_once[at[run]] | np.r_[True, own[1:] != own[:-1]]]
            symbols[run] = self.into[at[run]]
            last[run] = last[run + 1]
            stay = np.ones(len(symbols), bool)
            stay[run + 1] = False
            symbols, seg, first, last, rank, at = (x[stay] for x in (symbols, seg, first, last, rank, at))
            run -= np.arange(len(run))
            changed = np.r_[run, run[run > 0] - 1]
            rank[changed], at[changed] = self.pair_rank(symbols, last, changed)
        if not done:
            return symbols, seg, first
        symbols, seg, first = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(first, kind="stable")
        return symbols[order], seg[order], first[order]

    def encode_segments(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments one after the other, and how many each has."""
        size = ends - starts
        body = data[gather(starts, size)]
        lead = (body & 0xC0) != 0x80
        point = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        seg = np.repeat(np.arange(len(starts)), size)[lead]
        symbols = self.char_id[np.where(point == 0x20, ord(SPACE), point)].astype(np.int64)
        symbols, seg, first = self.merge(symbols, seg)
        # characters without a piece: one id a byte
        raw = (symbols < 0) | (symbols >= self.n)
        at = np.flatnonzero(lead)[first]
        width = np.where(body[at] < 0x80, 1, np.where(body[at] < 0xE0, 2, np.where(body[at] < 0xF0, 3, 4)))
        count = np.where(raw, width, 1)
        ids = np.repeat(symbols, count)
        spread = np.repeat(raw, count)
        ids[spread] = self.byte0 + body[gather(at[raw], width[raw])].astype(np.int64)
        return ids.astype(np.int32), np.bincount(np.repeat(seg, count), minlength=len(starts))

    # -- texts

    def encode_flat(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts without begin and end, and offsets. data: the texts, each with the space prefix unless it is empty."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        blank = data == 0x20
        before = np.zeros(len(data), bool)
        before[1:] = blank[:-1]
        before[at[:-1][at[:-1] < len(data)]] = False
        starts = np.flatnonzero(blank & ~before)
        ends = np.r_[starts[1:], len(data)]
        key = span_hash(prefix_hash(data), starts, ends)
        unique, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > STORE:
            self._clear()
        place = np.searchsorted(self.known, unique)
        fresh = np.ones(len(unique), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != unique[inside]
        if fresh.any():
            ids, n = self.encode_segments(data, starts[index[fresh]], ends[index[fresh]])
            order = np.argsort(all_keys := np.r_[self.known, unique[fresh]], kind="stable")
            self.known = all_keys[order]
            self.known_at = np.r_[self.known_at, len(self.pool) + np.cumsum(n) - n][order]
            self.known_len = np.r_[self.known_len, n][order]
            self.pool = np.r_[self.pool, ids]
            place = np.searchsorted(self.known, unique)
        n = self.known_len[place][inverse]
        ids = self.pool[gather(self.known_at[place][inverse], n)]
        offsets = np.r_[0, np.cumsum(n)][np.searchsorted(starts, at)]
        return ids, offsets

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and the byte offset of each id (one more than ids)."""
        n = self.body_len[ids]
        return self.body[gather(self.body_at[ids], n)], np.r_[0, np.cumsum(n)]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """For each text its ids with begin and end, and the bytes that they decode to."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        for first, stop, *_ in pieces(column):
            text = column.slice(first, stop - first).cast(pa.large_string()).fill_null("")
            if pc.any(pc.match_substring(text, SPACE)).as_py():
                text = pc.replace_substring(text, SPACE, " ")
            text = pc.if_else(pc.equal(pc.binary_length(text), 0), EMPTY, pc.binary_join_element_wise(EMPTY, text, pa.scalar(" ", pa.large_string())))
            ids, at = self.encode_flat(*flat(text))
            body, body_at = self.decode_flat(ids)
            ends = body_at[at]
            for i in range(stop - first):
                own = ids[at[i] : at[i + 1]]
                whole = np.empty(len(own) + 2, np.int32)
                whole[0], whole[-1], whole[1:-1] = self.bos, self.eos, own
                yield whole, body[ends[i] + (len(own) > 0) : ends[i + 1]].tobytes()  # without the space prefix


@cache
def load(path: str) -> Model:
    return Model(path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """keep, n_tokens, ids (array<int>) and decoded (the round trip) for every row; with digests, ids_sha256 and decoded_sha256 instead."""
    columns = docs.select(*keep, docs[text].alias("_text"))
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            n, ids, back = [], [], []
            for own, body in model.encode_column(b.column(len(keep))):
                n.append(len(own))
                if digests:
                    ids.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(body).hexdigest())
                else:
                    ids.append(own)
                    back.append(body.decode("utf-8", "replace"))
            made = [pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(back, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made], [*keep, *names])

    return columns.mapInArrow(run, f"{kinds}, {out}")
