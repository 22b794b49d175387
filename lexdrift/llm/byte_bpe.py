"""Byte-level BPE by a lazily determinised transducer, and streaming decoding (operator 6).

Encoding rests on two facts about byte pair encoding by ranks. The encoding of
any prefix of a string ends in one determined token, and a sequence of tokens is
the encoding of its bytes exactly when every two neighbours are the encoding of
theirs. A nondeterministic transducer therefore guesses token boundaries: a
hypothesis is (place in the trie of tokens, last whole token). Determinising it
gives states that are sets of hypotheses; they are built when first reached and
kept in a bounded cache. Tokens that all hypotheses agree on are put out, so
output lags the input by about twice the longest token at most.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.common import Memo, each_text, file_system, handed_back, is_short, text_of, tune
from lexdrift.llm.token_files import safe_split

#: Words are followed from their state after so many bytes where that is kept.
HEAD = 6
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long"


def load_ranks(path: str) -> dict[bytes, int]:
    fs, where = file_system(path)
    with fs.open_input_stream(where) as f:
        lines = f.read().split(b"\n")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes the bytes of one pre-token; tokens come out after bounded lookahead.

    A state is the tuple of live hypotheses, each packed as trie node << 24 |
    last whole token + 1, the longest begun first. The one at the root is the
    token that ends here, which is the state's output; following it back by
    lengths gives the encoding. Up to ``most_states`` states are kept; once
    they are there, words that leave them are followed without keeping more,
    and the cache is made anew when that has happened ``RENEW`` times as often
    as there are states.
    """

    ROOT = 0
    RENEW = 20

    def __init__(self, ranks: dict[bytes, int], most_states: int = 100_000, most_pairs: int = 200_000):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        self.inner: set[int] = set()
        for token, rank in ranks.items():
            node = self.ROOT
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.inner.add(node)
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[key]
            self.token_at[node] = rank
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.most_states = most_states
        self.follows = Memo(self._follows, most_pairs)
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.ends: list[int] = []
        self.moves: dict[int, int] = {}
        self.heads: dict[bytes, list[int]] = {}
        self.outside = 0
        self.start = self._state((self.ROOT << 24,))

    def _state(self, hypotheses: tuple) -> int:
        if (k := self.number.get(hypotheses)) is None:
            k = self.number[hypotheses] = len(self.states)
            self.states.append(hypotheses)
            self.ends.append((hypotheses[-1] & 0xFFFFFF) - 1)
        return k

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank; used only to learn which two tokens may stand side by side."""
        ranks = self.ranks.get
        parts = [data[k : k + 1] for k in range(len(data))]
        pairs = [ranks(data[k : k + 2], 1 << 60) for k in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < 1 << 60:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks(parts[at] + parts[at + 1], 1 << 60)
            if at:
                pairs[at - 1] = ranks(parts[at - 1] + parts[at], 1 << 60)
        return [self.ranks[p] for p in parts]

    def _follows(self, pair: int) -> bool:
        before, token = (pair >> 24) - 1, pair & 0xFFFFFF
        if before < 0:
            return self.merge(self.bytes_of[token]) == [token]
        return self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]

    def _step(self, hypotheses: tuple, byte: int) -> tuple:
        """One transition of the set of hypotheses."""
        going, done, child, inner, token_at = [], None, self.child.get, self.inner, self.token_at
        for hypothesis in hypotheses:
            if (to := child(hypothesis >> 24 << 8 | byte)) is None:
                continue
            last = hypothesis & 0xFFFFFF
            if to in inner:
                going.append(to << 24 | last)
            if done is None and (token := token_at[to]) >= 0 and self.follows[last << 24 | token]:
                done = token
        if done is None:
            raise ValueError(f"no token for byte {byte}: the ranks lack single bytes")
        going.append(self.ROOT << 24 | done + 1)
        return tuple(going)

    def _back(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= self.length[token]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Ids of a pre-token. Within the lookahead its end settles what is open; longer ones are streamed."""
        if len(data) >= 2 * self.longest:
            return list(self.stream(data))
        if self.outside > self.RENEW * self.most_states:
            self._reset()
        # Of each byte: the state after it, or the complement of the token that ends there.
        state, move, path = self.start, self.moves.get, []
        begun = self.heads.get(data[:HEAD])
        if begun is not None:
            path = begun.copy()
            state = path[-1]
        seen = path.append
        for byte in data[HEAD:] if begun is not None else data:
            if (to := move(state << 8 | byte)) is None:
                self._walk(state, data, path)
                break
            state = to
            seen(to)
        if begun is None and len(path) > HEAD and path[HEAD - 1] >= 0 and len(self.heads) < self.most_states:
            self.heads[data[:HEAD]] = path[:HEAD]
        ends, length, out, at = self.ends, self.length, [], len(path)
        while at:
            token = ends[last] if (last := path[at - 1]) >= 0 else ~last
            out.append(token)
            at -= length[token]
        return out[::-1]

    def _walk(self, state: int, data: bytes, path: list[int]) -> None:
        """Go on from a state whose move is not kept yet; once no more are kept, without states."""
        for k in range(len(path), len(data)):
            key = state << 8 | data[k]
            if (to := self.moves.get(key)) is None:
                going = self._step(self.states[state], data[k])
                if len(self.states) >= self.most_states and going not in self.number:
                    self.outside += len(data) - k
                    path.append(~((going[-1] & 0xFFFFFF) - 1))
                    for byte in data[k + 1 :]:
                        going = self._step(going, byte)
                        path.append(~((going[-1] & 0xFFFFFF) - 1))
                    return
                to = self.moves[key] = self._state(going)
            state = to
            path.append(to)

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of bytes that arrive one by one; each comes out once no live hypothesis can change it.

        Bytes kept back are fewer than twice the longest token unless two
        encodings stay open that long.
        """
        going, path, bound = (self.ROOT << 24,), [], 2 * self.longest
        for byte in data:
            going = self._step(going, byte)
            path.append((going[-1] & 0xFFFFFF) - 1)
            if len(path) >= bound:
                begun = [len(path) - self.depth[h >> 24] for h in going]
                agreed = os.path.commonprefix([self._back(path, b) for b in begun])
                yield from agreed
                del path[: sum(self.length[t] for t in agreed)]
                bound = max(2 * self.longest, len(path) + self.longest // 2)
        yield from self._back(path, len(path))


class Utf8Machine:
    """Incremental UTF-8: bytes in, text out; an unfinished character waits for its rest.

    The state is the bytes of the character begun. ``MORE`` gives, by lead byte,
    how many bytes follow. Ill-formed bytes become U+FFFD as the standard
    replacement policy has it.
    """

    MORE = [0] * 0xC2 + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11

    def __init__(self):
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if self.MORE[byte] >= back:
                    cut = len(data) - back
                break
        self.waiting = data[cut:]
        if self.waiting and not self._may_go_on(self.waiting):
            cut, self.waiting = len(data), b""
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _may_go_on(begun: bytes) -> bool:
        if len(begun) == 1:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(begun[0], (0x80, 0xBF))
        return low <= begun[1] <= high

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.decimal = [str(i) for i in range(len(self.table))]
        # Pieces between single spaces, without the space before them: those met lately, and those met before.
        self.lately: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.most_pieces = 800_000

    def _of_words(self, words: list[str]) -> bytes:
        return b"".join([self._of_piece(w[1:]) if w[0] == " " else self._of_word(w) for w in words])

    def _of_word(self, word: str) -> bytes:
        return pack_ids(self.transducer.encode(word.encode("utf-8", "replace")))

    def _of_piece(self, piece: str) -> bytes:
        """Packed ids of a piece with a space before it, which borders on other pre-tokens: of one pre-token, or of its parts."""
        if (known := self.lately.get(piece)) is None:
            if (known := self.before.get(piece)) is None:
                words = self.split(" " + piece)
                known = self._of_word(words[0]) if len(words) == 1 else self._of_words(words)
            if len(piece) <= 64:
                self.lately[piece] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        head, *rest = safe_split(text)
        ids = list(map(self.lately.get, rest))
        if None in ids:
            ids = [self._of_piece(rest[k]) if x is None else x for k, x in enumerate(ids)]
            if len(self.lately) > self.most_pieces // 2:
                self.lately, self.before = {}, self.lately
        return np.frombuffer(self._of_words(self.split(head)) + b"".join(ids), "<u4")

    def joined(self, ids: np.ndarray) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[tuple[bytes, str]]:
        """Bytes and text of each run of ids; text holds whole characters only."""
        machine, ids, table = Utf8Machine(), np.asarray(ids), self.table
        for k in range(0, len(ids), chunk):
            data = b"".join(map(table.__getitem__, ids[k : k + chunk].tolist()))
            yield data, machine.feed(data)
        if rest := machine.finish():
            yield b"", rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(text for _, text in self.decode_stream(ids))


_codecs: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's codec for a rank file; made once a process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each whole text; a null text has no ids."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch, texts in each_text(batches):
            ids = [pa.array(bpe.encode(t).astype("i4")) for t in texts]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids) if ids else pa.array([], pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(handed_back(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text of each array of ids; null ids give the empty text."""
    tune(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], "i8")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(handed_back(run), "doc_id long, text string")


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_chars: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again; give digests of both.

    doc_id, n_tokens, ids_sha256 (decimal ids joined by one space),
    decoded_sha256 (the decoded bytes)[, decoded_chars (characters that the
    incremental decoder put out)]. One row for each input row, repeated
    rows and null ids included; a null or empty text has no ids and the digests
    of nothing. Narrow: no shuffle, memory bounded by one batch and the memos.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch, texts in each_text(batches):
            counts, encoded, decoded, chars = [], [], [], []
            for text in texts:
                ids = bpe.encode(text)
                counts.append(len(ids))
                encoded.append(hashlib.sha256(bpe.joined(ids).encode()).hexdigest())
                digest, n_chars = hashlib.sha256(), 0
                for data, text in bpe.decode_stream(ids):
                    digest.update(data)
                    n_chars += len(text)
                decoded.append(digest.hexdigest())
                chars.append(n_chars)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string()), pa.array(chars, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"])

    out = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(handed_back(run), DIGESTS)
    return out if with_chars else out.drop("decoded_chars")
