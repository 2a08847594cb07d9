"""Byte-level BPE as a finite-state transducer, and streaming decoding.

Encoding.  In the BPE encoding of a byte string, the last token of every prefix
is fixed: it is the one token ``t`` ending there whose predecessor is the last
token before ``t`` and forms a valid neighbour pair with it.  A pair is valid
when merging its joint bytes by rank gives the pair back.  So the merges compile
into a transducer that reads bytes from left to right.  A state is the last
token emitted plus the bytes read since; an arc emits the tokens that every
continuation agrees on.  Only as many bytes stay undecided as some longer token
could still reach back to, which bounds the lookahead.  States and arcs are
built when first needed (lazy determinisation).  A table from whole pieces to
their ids is the same automaton with its arcs joined.  Every table is emptied
when it reaches a fixed size, which bounds memory and changes no result.

Decoding.  An incremental UTF-8 machine takes token after token.  Its state is
the unfinished code point; an arc is labelled with a token and emits text.

Nothing is shuffled: each row is encoded where it is read, in pieces, so a very
long text needs memory for its bytes and a fixed number of pieces.  A null text
is empty: no tokens, the SHA-256 of nothing twice.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries after which a table of a transducer is emptied.
TABLE_LIMIT = 1 << 20
#: Pieces up to this many bytes are remembered whole.
PIECE_LIMIT = 48
#: Pieces that are encoded at a time.
RUN = 1 << 16
#: Characters up to which a text's pieces are listed at once.
LIST_CHARS = 1 << 20


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a ``base64 rank`` file with ids 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in pairs]


class _State:
    """The token before the undecided bytes, those bytes, the last token of each
    of their prefixes, and the places from which they begin some token."""

    __slots__ = ("before", "data", "last", "live", "arcs")

    def __init__(self, before: int, data: bytes = b"", last: tuple = (), live: tuple = (0,)):
        self.before, self.data, self.last, self.live = before, data, last, live
        self.arcs: dict[int, tuple[_State, tuple[int, ...]]] = {}


def split(text: str, pattern) -> Iterator[list[str]]:
    """The pieces of ``text``, RUN at a time."""
    if len(text) <= LIST_CHARS:
        pieces: Iterable[str] = pattern.findall(text)
    else:
        pieces = (m.group() for m in pattern.finditer(text))
    pieces = iter(pieces)
    while some := list(islice(pieces, RUN)):
        yield some


class MergeTransducer:
    """Byte string -> token ids, one byte at a time.

    Ranks must be those of a trained vocabulary: a token's two parts rank below
    the token itself.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = list(map(len, tokens))
        self.ids = {t: i for i, t in enumerate(tokens)}
        #: Every beginning of a token, with the token it is or -1.
        self.starts = dict.fromkeys((t[:n] for t in tokens for n in range(1, len(t))), -1) | self.ids
        self.edges: tuple[dict, dict] = {}, {}
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple[int, bytes], _State] = {}
        self.root = _State(-1)
        self.pieces: dict[str, tuple[int, ...]] = {}
        #: As pieces, with the ids as decimal numbers joined by commas.
        self.joined: dict[str, str] = {}

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """Merges by rank, lowest first, leftmost on ties; for short strings."""
        ids, none = self.ids, len(self.tokens)
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = [ids.get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while len(parts) > until and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = ids.get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = ids.get(parts[i - 1] + parts[i], none)
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that lie at one end of a token while it is merged, smallest
        first, each with the rank at which it is merged into the next."""
        found = self.edges[side].get(token)
        if found is None:
            data, found, until = self.tokens[token], [], len(self.tokens)
            while True:
                found.append((data, until))
                if len(data) == 1:
                    break
                until = self.ids[data]
                parts = self.merged(data, 2)
                if len(parts) != 2 or max(self.ids[p] for p in parts) >= until:
                    raise ValueError("a token ranks below its parts")
                data = parts[-side]
            found.reverse()
            self.edges[side][token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border when ``right`` follows ``left``."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            ids, none = self.ids, len(self.tokens)
            lefts, rights = iter(self.edge(left, 1)), iter(self.edge(right, 0))
            (a, a_until), (b, b_until) = next(lefts), next(rights)
            while True:
                across = ids.get(a + b, none)
                known = across == none
                # Of equal ranks the leftmost merge comes first.
                if across < a_until and across <= b_until or a_until == b_until == none:
                    break
                if a_until <= b_until:
                    a, a_until = next(lefts)
                else:
                    b, b_until = next(rights)
            if len(self.pairs) >= TABLE_LIMIT:
                self.pairs.clear()
            self.pairs[left << 32 | right] = known
        return known

    def reach(self, data: bytes, end: int, before: int, last: Sequence[int],
              live: Sequence[int]) -> tuple[list[int], int]:
        """(the live places that stay so, the last token) after ``end`` bytes."""
        stay, token = [], -1
        known_starts, pairs = self.starts.get, self.pairs.get
        for i in live:
            # A token that ends here or later starts where the bytes so far begin one.
            ends = known_starts(data[i:end])
            if ends is not None:
                stay.append(i)
                if token < 0 <= ends:
                    prior = last[i - 1] if i else before
                    if prior < 0:
                        token = ends
                    else:
                        known = pairs(prior << 32 | ends)
                        if self.fits(prior, ends) if known is None else known:
                            token = ends
        if token < 0:
            raise ValueError("the vocabulary lacks a byte")
        stay.append(end)
        return stay, token

    def arc(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """Builds the arc for one more byte: (next state, tokens emitted)."""
        data, last, before = state.data + bytes((byte,)), state.last, state.before
        live, token = self.reach(data, len(data), before, last, state.live)
        last = (*last, token)
        out: tuple[int, ...] = ()
        if live[0]:
            # Where the paths to all live places part.
            fork = set(live)
            while len(fork) > 1:
                far = max(fork)
                fork.remove(far)
                fork.add(far - self.sizes[last[far - 1]])
            cut = fork.pop()
            if cut:
                out = tuple(self.chain(last, cut))
                before, data, last, live = out[-1], data[cut:], last[cut:], [i - cut for i in live]
        after = self.states.get((before, data))
        if after is None:
            if len(self.states) >= TABLE_LIMIT:
                self.states.clear()
                self.root = _State(-1)
            after = self.states[before, data] = _State(before, data, last, tuple(live))
        state.arcs[byte] = after, out
        return after, out

    def chain(self, last: Sequence[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= self.sizes[out[-1]]
        return out[::-1]

    def piece(self, data: bytes) -> Iterator[int]:
        """Token ids of one piece, emitted as they are decided."""
        whole = self.ids.get(data)
        if whole is not None:
            yield whole
            return
        if len(data) <= PIECE_LIMIT:
            # The joined arcs of a short piece are kept, not the single ones.
            live, last = [0], []
            for end in range(1, len(data) + 1):
                live, token = self.reach(data, end, -1, last, live)
                last.append(token)
            yield from self.chain(last, len(data))
            return
        state = self.root
        for byte in data:
            state, out = state.arcs.get(byte) or self.arc(state, byte)
            yield from out
        yield from self.chain(state.last, len(state.data))

    def known(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece)
        if found is None:
            data = piece.encode()
            found = tuple(self.piece(data))
            if len(data) <= PIECE_LIMIT:
                if len(self.pieces) >= TABLE_LIMIT:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def runs(self, text: str, pattern) -> Iterator[list[int]]:
        """Ids of ``text``, in runs of a bounded number of pieces."""
        for some in split(text, pattern):
            try:
                yield list(chain.from_iterable(map(self.pieces.__getitem__, some)))
            except KeyError:
                yield list(chain.from_iterable([self.known(p) for p in some]))

    def known_joined(self, piece: str) -> str:
        found = self.joined.get(piece)
        if found is None:
            data = piece.encode()
            found = ",".join(map(str, self.piece(data)))
            if len(data) <= PIECE_LIMIT:
                if len(self.joined) >= TABLE_LIMIT:
                    self.joined.clear()
                self.joined[piece] = found
        return found

    def joined_runs(self, text: str, pattern) -> Iterator[list[str]]:
        """As ``runs``, with one entry for each piece: its ids joined by commas."""
        for some in split(text, pattern):
            try:
                yield list(map(self.joined.__getitem__, some))
            except KeyError:
                yield list(map(self.known_joined, some))


class Utf8Machine:
    """Token ids -> text; a code point that spans tokens waits in the state."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.arcs: list[dict[int, tuple[int, str]]] = [{}]
        self.states: dict[bytes, int] = {b"": 0}
        self.held: list[bytes] = [b""]
        #: Joined arcs that begin and end between code points, by their joined ids.
        self.joined: dict[str, str] = {}
        self.at = 0

    def arc(self, state: int, token: int) -> tuple[int, str]:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        text = decoder.decode(self.held[state] + self.tokens[token])
        rest = decoder.getstate()[0]
        after = self.states.setdefault(rest, len(self.held))
        if after == len(self.held):
            self.held.append(rest)
            self.arcs.append({})
        found = self.arcs[state][token] = (after, text)
        return found

    def feed(self, ids: Iterable[int]) -> str:
        state, out, arcs = self.at, [], self.arcs
        for token in ids:
            found = arcs[state].get(token)
            if found is None:
                found = self.arc(state, token)
            state = found[0]
            out.append(found[1])
        self.at = state
        return "".join(out)

    def feed_joined(self, runs: list[str]) -> str:
        """As ``feed`` for tokens as MergeTransducer.joined_runs gives them."""
        if not self.at:
            try:
                return "".join(map(self.joined.__getitem__, runs))
            except KeyError:
                pass
        out = []
        for run in runs:
            between = not self.at
            text = self.joined.get(run) if between else None
            if text is None:
                text = self.feed(map(int, run.split(",")))
                if between and not self.at and len(text) <= PIECE_LIMIT:
                    if len(self.joined) >= TABLE_LIMIT:
                        self.joined.clear()
                    self.joined[run] = text
            out.append(text)
        return "".join(out)

    def close(self) -> str:
        """Ends the text: what is unfinished becomes U+FFFD."""
        rest, self.at = self.held[self.at], 0
        return rest.decode("utf-8", "replace")


def _vocabulary(spark: SparkSession, path: str) -> tuple:
    # A vocabulary file has a fixed number of tokens, here 50,256.
    return tuple(load_ranks(path))


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` plus ``ids`` (array of int) of the column ``text``."""
    import regex

    tokens = df.sparkSession.sparkContext.broadcast(_vocabulary(df.sparkSession, vocabulary))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "ids"]
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, split = MergeTransducer(tokens.value), regex.compile(pattern)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                value = one.column(place)[0].as_py() or ""
                ids = list(chain.from_iterable(machine.runs(value, split)))
                yield pa.RecordBatch.from_arrays(
                    [*one.columns, pa.array([ids], pa.list_(pa.int32()))], [*one.schema.names, "ids"])

    return df.drop("ids").mapInArrow(run, ", ".join([*fields, "ids array<int>"]))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``df`` plus ``decoded`` text of the id arrays; a null array gives ''."""
    tokens = df.sparkSession.sparkContext.broadcast(_vocabulary(df.sparkSession, vocabulary))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "decoded"]
    df = df.drop("decoded")
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Utf8Machine(tokens.value)
        for batch in batches:
            texts = [machine.feed(v.as_py() or ()) + machine.close() for v in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, ", ".join([*fields, "decoded string"]))


#: The machines of this process.  Their tables serve all its tasks.
_machines: dict[tuple[str, str], tuple[MergeTransducer, Utf8Machine]] = {}


def _kept(name: str, tokens: Sequence[bytes], pattern: str) -> tuple[MergeTransducer, Utf8Machine]:
    found = _machines.get((name, pattern))
    if found is None:
        _machines.clear()
        found = _machines[name, pattern] = MergeTransducer(list(tokens)), Utf8Machine(list(tokens))
        gc.freeze()  # the tables above hold no garbage and need not be searched for it
    return found


def digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Encodes and decodes run by run and keeps only the digests, so that no
    text's ids are held whole.
    """
    import regex

    ranks = _vocabulary(docs.sparkSession, vocabulary)
    tokens = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(b"".join(len(t).to_bytes(4, "big") + t for t in ranks)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reader = _kept(name, tokens.value, pattern)
        pieces = regex.compile(pattern)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for value in batch.column(1):
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                reader.at = 0
                for runs in coder.joined_runs(value.as_py() or "", pieces):
                    ids = ",".join(runs)
                    ids_hash.update(("," + ids if n else ids).encode())
                    n += ids.count(",") + 1
                    text_hash.update(reader.feed_joined(runs).encode())
                text_hash.update(reader.close().encode())
                counts.append(n)
                coded.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
