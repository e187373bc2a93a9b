"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder.

Two tokens may stand side by side iff merging their bytes leaves the boundary between them
alone; the BPE result of a byte string is its only tokenisation whose neighbours all may. The
nondeterministic transducer guesses where tokens start. Its subset construction keeps, for
each start that some token may still leave from, the vocabulary-trie node reached since and the tokens
before it that aren't out yet; the tokens that all guesses have in common are emitted with the
move. A guess lives as long as some token still spells the bytes since its start, so the lookahead
is bounded by the longest token. States and moves are made on first use.

Decoding runs an incremental UTF-8 state machine over the tokens' bytes; its moves by token are
made on first use too.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import bounded_batches
from millrace.llm.worker import cache, owns


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The merges that a rank table implies: the parts of each token, and which neighbours are stable."""

    def __init__(self, ranks: dict[bytes, int], most: int = 150_000):
        self.ranks, self.most = ranks, most
        self.bytes_of = {r: t for t, r in ranks.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._stable: dict[int, bool] = {}

    def merge(self, data: bytes, below: float = float("inf")) -> list[int]:
        """Plain BPE, lowest rank and then leftmost first, with merges of rank under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found or (best := min(found))[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and for tokens that merging never makes."""
        if token not in self._parts:
            data = self.bytes_of[token]
            two = self.merge(data, token) if len(data) > 1 else []
            self._parts[token] = (two[0], two[1]) if len(two) == 2 else None
        return self._parts[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.parts(token) is not None

    def follows(self, last: int, token: int) -> bool:
        """Whether the token may stand after ``last`` (-1: at the start)."""
        return self.reachable(token) and (last < 0 or self.stable(last, token))

    def stable(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the boundary.

        Walks back in time from the finished tokens: the neighbours at the boundary exist from
        when the later of both was made until one of them is merged away, and a merge of both
        fires in that time iff its rank comes first (the left of two equal ranks goes first).
        """
        key = left << 32 | right
        known = self._stable.get(key)
        if known is not None:
            return known
        a, b, end_a, end_b = left, right, float("inf"), float("inf")
        ok = True
        while True:
            r = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if r is not None and r < end_a and r <= end_b:
                ok = False
                break
            pa_, pb = self.parts(a), self.parts(b)
            if pa_ is None and pb is None:
                break
            if pb is None or (pa_ is not None and a > b):
                end_a, a = a, pa_[1]
            else:
                end_b, b = b, pb[0]
        if len(self._stable) >= self.most:
            self._stable.clear()
        self._stable[key] = ok
        return ok


class State(dict):
    """A state of the transducer: moves (next state, tokens emitted) by byte, made when first asked for."""

    __slots__ = ("fst", "guesses")

    def __init__(self, fst: Transducer, guesses: tuple[int, ...]):
        self.fst, self.guesses = fst, guesses

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        found = self[byte] = self.fst.move(self.guesses, byte)
        return found


class Transducer:
    """Reads bytes, emits token ids with its moves; at most ``max_states`` states are kept, then all are made anew.

    A state is the guesses, oldest first, as (chain, node) in one flat tuple: ``node`` is the trie node since the
    guess's start, ``chain`` the tokens before it that aren't out yet. Chains form trees: a root is the
    last token emitted (-1 at the start), each other adds a token to its parent. The last guess always starts
    here, at the root of the trie; what its chain holds comes out where the input ends.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 450_000):
        self.merges = Merges(ranks)
        self.max_states = max_states
        self.states: dict[tuple[int, ...], State] = {}
        self.edges: dict[int, int] = {}  # node << 8 | byte to node
        self.ends, self.open = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.edges.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.edges[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.open.append(False)
                    self.open[node] = True
                node = nxt
            self.ends[node] = rank
        self._ranges(ranks)
        self._forget()

    def _ranges(self, ranks: dict[bytes, int]) -> None:
        """The tokens below each node are a range of all in order of bytes."""
        self.low, self.high, self.ordered = [0] * len(self.ends), [0] * len(self.ends), []
        for place, token in enumerate(sorted(ranks)):
            self.ordered.append(ranks[token])
            node = 0
            for byte in token:
                node = self.edges[node << 8 | byte]
                if not self.high[node]:
                    self.low[node] = place
                self.high[node] = place + 1
            if self.low[node] == place:
                self.low[node] = place + 1  # the token that ends here isn't below

    def _lives(self, last: int, node: int) -> bool:
        """Whether some token below the node may follow ``last``; a guess without one can end nowhere. Nodes with many tokens below pass unasked."""
        low, high = self.low[node], self.high[node]
        if high - low > 24:
            return True
        fits, follows = self.fits, self.merges.follows
        for token in self.ordered[low:high]:
            key = last + 1 << 20 | token
            fit = fits.get(key)
            if fit is None:
                fit = fits[key] = follows(last, token)
            if fit:
                return True
        return False

    def _forget(self) -> None:
        for state in self.states.values():
            state.clear()  # moves lead in circles; without them the states go at once
        self.states.clear()
        self.token, self.parent, self.first, self.rest = [], [], [], []  # of each chain; first: the chain of the first token that waits, or -1; rest: see _rest
        self.chains: dict[int, int] = {}  # parent + 1 << 20 | token + 1 to chain
        self.fits: dict[int, bool] = {}  # last token + 1 << 20 | token to whether it may follow
        self.lives: dict[int, bool] = {}  # last token + 1 << 20 | node to whether a token below it may follow
        self.start = self._state((self._chain(-1, -1), 0))

    def _chain(self, parent: int, token: int) -> int:
        key = parent + 1 << 20 | token + 1
        chain = self.chains.get(key)
        if chain is None:
            chain = self.chains[key] = len(self.token)
            self.token.append(token)
            self.parent.append(parent)
            self.rest.append(-1)
            self.first.append(-1 if parent < 0 else chain if self.first[parent] < 0 else self.first[parent])
        return chain

    def _waiting(self, chain: int) -> list[int]:
        """The tokens of a chain, without the one that is out."""
        out = []
        while self.first[chain] >= 0:
            out.append(self.token[chain])
            chain = self.parent[chain]
        return out[::-1]

    def _state(self, guesses: tuple[int, ...]) -> State:
        state = self.states.get(guesses)
        if state is None:
            state = self.states[guesses] = State(self, guesses)
        return state

    def move(self, guesses: tuple[int, ...], byte: int) -> tuple[State, tuple[int, ...]]:
        edges, ends, open_, token, fits, lives = self.edges, self.ends, self.open, self.token, self.fits, self.lives
        kept: list[int] = []
        done = -1
        flat = iter(guesses)
        for chain, node in zip(flat, flat):
            node = edges.get(node << 8 | byte)
            if node is None:
                continue
            if done < 0:
                end = ends[node]
                if end >= 0:
                    key = token[chain] + 1 << 20 | end
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = self.merges.follows(token[chain], end)
                    if fit:
                        done = self._chain(chain, end)
            if open_[node]:
                key = token[chain] + 1 << 20 | node
                alive = lives.get(key)
                if alive is None:
                    alive = lives[key] = self._lives(token[chain], node)
                if alive:
                    kept += (chain, node)
        if done < 0:
            raise ValueError("the ranks lack a byte")
        kept += (done, 0)
        # the first token that waits goes out with this move where all guesses wait with the same
        first, out = self.first, ()
        while (one := first[kept[0]]) >= 0:
            for k in range(2, len(kept), 2):
                if first[kept[k]] != one:
                    return self._state(tuple(kept)), out
            out += (token[one],)
            for k in range(0, len(kept), 2):
                kept[k] = self._rest(kept[k])
        return self._state(tuple(kept)), out

    def _rest(self, chain: int) -> int:
        """The chain without the first token that waits, which is then the last one emitted."""
        found = self.rest[chain]
        if found < 0:
            one = self.first[chain]
            found = self.rest[chain] = self._chain(-1, self.token[one]) if chain == one else self._chain(self._rest(self.parent[chain]), self.token[chain])
        return found

    def encode(self, data: bytes) -> list[int]:
        """The BPE tokens of one pre-split match."""
        if len(self.states) > self.max_states:
            self._forget()
        state, out = self.start, []
        for byte in data:
            state, got = state[byte]
            if got:
                out += got
        return out + self._waiting(state.guesses[-2])


def _index(values: list, value: object, start: int) -> int:
    """Where the value next stands, or -1."""
    try:
        return values.index(value, start)
    except ValueError:
        return -1


class Utf8Stream:
    """Incremental UTF-8 after RFC 3629, fed with bytes or with tokens: what is complete comes out at once, bad bytes become U+FFFD.

    The state is the bytes of a character begun. A byte either goes on with it, ends it, or shows that
    it was none: then one U+FFFD stands for it and the byte starts anew. ``by_token`` keeps, per state,
    the text and the next state of a token, ``whole`` the text of those that leave nothing open; several streams may
    share them.
    """

    def __init__(self, bytes_of: dict[int, bytes] | None = None, by_token: dict[bytes, dict[int, tuple[bytes, str]]] | None = None, whole: dict[int, str] | None = None):
        self.bytes_of, self.held = bytes_of or {}, b""
        self.by_token, self.whole = {} if by_token is None else by_token, {} if whole is None else whole

    @staticmethod
    def _more(held: bytes) -> tuple[int, int, int]:
        """Bytes to come after a proper beginning, and the least and largest next one."""
        lead, n = held[0], len(held)
        size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if n > 1:
            return size - n, 0x80, 0xBF
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
        return size - 1, low, {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)

    def _walk(self, held: bytes, data: bytes) -> tuple[bytes, str]:
        out: list[str] = []
        for byte in data:
            if held:
                to_come, low, high = self._more(held)
                if low <= byte <= high:
                    held += bytes((byte,))
                    if to_come == 1:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("\ufffd")
                held = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                held = bytes((byte,))
            else:
                out.append("\ufffd")
        return held, "".join(out)

    def feed(self, data: bytes) -> str:
        self.held, text = self._walk(self.held, data)
        return text

    def feed_tokens(self, ids: list[int]) -> str:
        texts, at, n = list(map(self.whole.get, ids)), 0, len(ids)  # tokens that leave nothing open, from the empty state
        if self.held:
            texts[:1] = [None] * min(n, 1)
        while (at := _index(texts, None, at)) >= 0:
            held = self.held
            while at < n:
                token, moves = ids[at], self.by_token.setdefault(held, {})
                move = moves.get(token)
                if move is None:
                    move = moves[token] = self._walk(held, self.bytes_of[token])
                    if not held and not move[0]:
                        self.whole[token] = move[1]
                texts[at] = move[1]
                held = move[0]
                at += 1
                if not held:
                    break
            self.held = held
        return "".join(texts)

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return "\ufffd" if rest else ""


class _Memo(dict):
    """What the transducer gave for matches seen before, two generations of ``most`` each; a miss runs it."""

    def __init__(self, ranks: dict[bytes, int], most: int, states: int):
        super().__init__()
        self.most, self.fst, self.old = most, Transducer(ranks, states), {}

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = self.old.get(match)
        if ids is None:
            ids = tuple(self.fst.encode(match.encode()))
            if len(match) > 64:
                return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[match] = ids
        return ids


class ByteBPE:
    """Encoder and decoder of a rank file, each match of the pattern on its own, without special tokens."""

    def __init__(self, path: str, pattern: str, memo: int = 400_000, states: int = 450_000):
        ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.memo = _Memo(ranks, memo, states)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.by_token: dict[bytes, dict[int, tuple[bytes, str]]] = {}
        self.whole: dict[int, str] = {}

    def decoder(self) -> Utf8Stream:
        """A new stream of tokens to text; the machine's moves are shared."""
        return Utf8Stream(self.bytes_of, self.by_token, self.whole)

    def encode_slabs(self, text: str, matches: int = 200_000) -> Iterator[list[int]]:
        """Ids of a whole text, some 200,000 matches at a time, so that one long text is never held as one list."""
        get = self.memo.__getitem__
        if len(text) <= matches:
            yield list(chain.from_iterable(map(get, self.pattern.findall(text))))
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while slab := list(chain.from_iterable(map(get, islice(found, matches)))):
            yield slab

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_slabs(text)))

    def decode_stream(self, slabs: Iterable[Iterable[int]]) -> Iterator[str]:
        stream = self.decoder()
        for ids in slabs:
            yield stream.feed_tokens(ids)
        yield stream.finish()


_LOADED: dict[tuple, ByteBPE] = cache()


def loaded(path: str, pattern: str, memo: int = 400_000, states: int = 450_000) -> ByteBPE:
    """One encoder per Python worker, kept between tasks."""
    key = (path, pattern, memo, states)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(path, pattern, memo, states)
    return _LOADED[key]


def encode_documents(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False, batch_ids: int = 1 << 19,
    memo: int = 400_000, states: int = 450_000,
) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids, ``with_text`` the decoded text.

    A null text counts as empty: no tokens, hashes of no bytes. Rows pass in their own order
    within a partition, without any shuffle, and leave in batches of some ``batch_ids`` ids;
    ``memo`` matches and ``states`` states are kept per worker (less memory, more time);
    repeated rows give repeated results; a null identifier stays null; an empty table gives no
    rows; further columns are left out.
    """
    bounded_batches(df.sparkSession)
    fields = [(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    if with_text:
        fields.append(("decoded", pa.string()))
        ddl += ", decoded string"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("bpe")
        bpe = loaded(path, pattern, memo, states)
        gc.disable()  # nothing here waits for the collector, and it would walk all states time and again
        try:
            yield from encoded(bpe, batches)
        finally:
            gc.enable()

    def encoded(bpe: ByteBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = [str(i) for i in range(max(bpe.bytes_of) + 1)].__getitem__
        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, ids_hash, text_hash, stream, ids, decoded = 0, hashlib.sha256(), hashlib.sha256(), bpe.decoder(), [], []
                for slab in bpe.encode_slabs(text):
                    if slab:
                        ids_hash.update((("," if n else "") + ",".join(map(decimal, slab))).encode())
                        n += len(slab)
                    out = stream.feed_tokens(slab)
                    text_hash.update(out.encode())
                    if with_ids:
                        ids.append(np.array(slab, np.int32))
                    if with_text:
                        decoded.append(out)
                last = stream.finish()
                text_hash.update(last.encode())
                row = [doc, n, ids_hash.hexdigest(), text_hash.hexdigest()]
                if with_ids:
                    row.append(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                if with_text:
                    row.append("".join(decoded) + last)
                rows.append(row)
                held += n + 100
                if held > batch_ids:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    base = df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(run, ddl)
