"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct pieces of a slice of texts are laid out as one sequence of byte tokens with links. An index maps
every mergeable pair to all its positions; the active pair of lowest rank is taken, merged at every position that
still holds it, and the pairs this makes enter the lists of their own ranks. Pieces are independent, so the lowest
rank of all pieces is the lowest rank of every piece that has it. Long pieces cost no more per byte than short ones.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import slices

# Fixed values of byte-level tokenizers: white space of Unicode, and the pattern that cuts a text into pieces.
SPACE = r"[\t-\r \x85\xa0  -     　]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
OTHER = NOT_SPACE[:-1] + r"\p{L}\p{N}]"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?{OTHER}+|{SPACE}+(?!{NOT_SPACE})|{SPACE}+")

SLICE_BYTES = 2 << 20
# bytes of pieces that one index is built over, so that its lists stay in the processor's cache; a longer piece has one of its own
INDEX_BYTES = 32 << 10
# pieces that a worker remembers, half of them those met last; beyond either bound the others are forgotten
KNOWN_PIECES, KNOWN_BYTES = 200_000, 24 << 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes stand for themselves, the others follow U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


class Bpe:
    """A byte-level tokenizer read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = {k: (spec.get(k) or {}).get("type") for k in ("pre_tokenizer", "decoder", "model", "normalizer", "post_processor")}
        if kinds != {"pre_tokenizer": "ByteLevel", "decoder": "ByteLevel", "model": "BPE", "normalizer": None, "post_processor": None}:
            raise ValueError(f"not a plain byte-level tokenizer: {kinds}")
        vocab = spec["model"]["vocab"]
        letters = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.width = max([*vocab.values(), *self.added.values()]) + 1
        # of every id: the bytes it stands for, and its decimal digits with a comma, filled up with zero bytes
        self.bytes_of = [b""] * self.width
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        digits = len(str(self.width)) + 1
        self.shown = np.frombuffer(b"".join(b"%d," % i + bytes(digits - 1 - len(str(i))) for i in range(self.width)), np.uint8).reshape(-1, digits)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.first = np.array([vocab[c] for c in letters], np.int64)
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        # ranks of a token's pairs, by the token after it and by the one before it
        after: dict[int, dict[int, int]] = {}
        before: dict[int, dict[int, int]] = {}
        for (a, b), (rank, _) in merges.items():
            after.setdefault(a, {})[b] = rank
            before.setdefault(b, {})[a] = rank
        self.by_rank = {rank: (a, b, to, after.get(to, {}), before.get(to, {})) for (a, b), (rank, to) in merges.items()}
        codes = np.array([a * self.width + b for a, b in merges], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.array([rank for rank, _ in merges.values()], np.int64)[order]
        # a piece's token ids, as little-endian numbers of 32 bits: pieces met last, and those before them
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known_bytes = 0

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The token ids of every (non-empty) piece, as little-endian numbers of 32 bits."""
        # a place that holds no token, -1, stands before and behind every piece; merged places become such too
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        n = int(ends[-1]) + 1
        tokens = np.full(n, -1, np.int64)
        held = np.ones(n, bool)
        held[0] = held[ends] = False
        tokens[held] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        # the index at the start: positions by rank, in ascending order
        left = np.flatnonzero(held[:-1] & held[1:])
        code = tokens[left] * self.width + tokens[left + 1]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        good = self.codes[at] == code
        left, rank = left[good], self.ranks[at[good]]
        order = np.argsort(rank, kind="stable")
        left, rank = left[order].tolist(), rank[order]
        heads = np.flatnonzero(np.diff(rank, prepend=-1))
        active = rank[heads].tolist()
        places = {r: left[start:end] for r, start, end in zip(active, heads.tolist(), [*heads[1:].tolist(), len(left)])}

        heapq.heapify(active)
        tok, nxt, prv = tokens.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        by_rank = self.by_rank
        while active:
            rank = heapq.heappop(active)
            here = places.pop(rank, None)
            if here is None:
                continue
            a, b, to, after, before = by_rank[rank]
            here.sort()
            stopped = -1  # end of a piece whose next merge ranks lower than this one
            for p in here:
                if tok[p] != a:
                    continue
                q = nxt[p]
                if tok[q] != b:
                    continue
                if p < stopped:
                    self._add(places, active, rank, p)
                    continue
                tok[p] = to
                tok[q] = -1
                r = nxt[q]
                nxt[p] = r
                prv[r] = p
                found = after.get(tok[r])
                if found is not None:
                    own = places.get(found)
                    if own is None:
                        self._add(places, active, found, p)
                    else:
                        own.append(p)
                    if found < rank:
                        stopped = int(ends[np.searchsorted(ends, p, "right")])
                o = prv[p]
                found = before.get(tok[o])
                if found is not None:
                    own = places.get(found)
                    if own is None:
                        self._add(places, active, found, o)
                    else:
                        own.append(o)
                    if found < rank:
                        stopped = int(ends[np.searchsorted(ends, p, "right")])
        out = np.array(tok, np.int64)
        alive = np.flatnonzero(out >= 0)
        cuts = (4 * np.searchsorted(alive, ends)).tolist()
        ids = out[alive].astype("<u4").tobytes()
        return [ids[start:end] for start, end in zip([0, *cuts], cuts)]

    @staticmethod
    def _add(places: dict[int, list[int]], active: list[int], rank: int, p: int) -> None:
        own = places.get(rank)
        if own is None:
            places[rank] = [p]
            heapq.heappush(active, rank)
        else:
            own.append(p)

    def _parts(self, text: str) -> list[str]:
        """Pieces of a text; added tokens stand for themselves."""
        if self.cut is None or not any(t in text for t in self.added):
            return PIECE.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.added else PIECE.findall(part)
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Know the ids of all these pieces, at least until the next call."""
        if len(self.known) > KNOWN_PIECES // 2 or self.known_bytes > KNOWN_BYTES // 2:
            self.known, self.older, self.known_bytes = {}, self.known, 0
        known, older = self.known, self.older
        for token, i in self.added.items():
            known[token] = np.array([i], "<u4").tobytes()
        new = []
        for w in pieces.difference(known):
            ids = older.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
                self.known_bytes += len(w) + len(ids)
        at = 0
        while at < len(new):
            part, size = [], 0
            while at + len(part) < len(new) and size < INDEX_BYTES:
                part.append(new[at + len(part)].encode())
                size += len(part[-1])
            found = self.encode_pieces(part)
            known.update(zip(new[at : at + len(part)], found))
            self.known_bytes += size + sum(map(len, found))
            at += len(part)

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The token ids of every text."""
        parts = [self._parts(t) for t in texts]
        self._learn(set().union(*parts))
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in p]), "<u4") for p in parts]

    def decimal(self, ids: np.ndarray) -> bytes:
        """Token ids in decimal, joined by commas."""
        rows = self.shown[ids]
        return rows[rows != 0].tobytes()[:-1]

    def text(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()]).decode("utf-8", "replace")

    def decode(self, ids: str) -> str:
        """The text of token ids in decimal, joined by commas."""
        return self.text(np.array(ids.split(","), np.int64)) if ids else ""


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_KINDS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """One row per row of ``docs``: its id and the chosen columns of ``COLUMNS``.

    ``path`` names the tokenizer file on every executor; nothing of it is copied. A null text is empty and has no
    tokens. Rows are independent: repeated rows, null ids and other columns change nothing, and no shuffle happens.
    Texts are taken whole; one longer than a slice is a slice of its own.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        texts = "decoded" in columns or "decoded_sha256" in columns
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                out: dict[str, list] = {c: [] for c in columns}
                for ids in bpe.encode([x or "" for x in part.column("text").to_pylist()]):
                    decoded = bpe.text(ids) if texts else ""
                    if "n_tokens" in out:
                        out["n_tokens"].append(len(ids))
                    if "ids" in out:
                        out["ids"].append(ids.astype(np.int32))
                    if "decoded" in out:
                        out["decoded"].append(decoded)
                    if "ids_sha256" in out:
                        out["ids_sha256"].append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(out[c], _KINDS[c]) for c in columns)], ["id", *columns])

    schema = ", ".join(["id long", *(f"{c} {COLUMNS[c]}" for c in columns)])
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(rows, schema).withColumnRenamed("id", id_col)
