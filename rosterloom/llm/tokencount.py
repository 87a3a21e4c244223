"""Token counts by a finite-state compilation of a byte-level BPE tokenizer.

The tokenizer is compiled to a deterministic transducer over characters.  Each
transition carries the change of the number of tokens of the text read so far
(as if it ended there), so the sum along the path is the library's count; a
change may be negative, as a character can join tokens.

* Splitter: runs of letters, of numbers, of other characters, each with at most
  one space before it; contractions; white space, whose last character waits
  for what follows.  Its states are few.
* Merges: the last token of each prefix is the only token that ends there and
  fits the last token of the prefix before it.  Two tokens fit if no merge
  across their border comes before the merges inside them.  A state is the set
  of suffixes that begin a vocabulary entry, each with the last token before it
  and its count relative to the whole; states are made when they are first met
  and kept, as in lazily built automata, in a bounded table.
* Special tokens: a match in progress is part of the state; when it is
  complete, the text before it ends as a text of its own.

Texts of more than ``chunk`` characters are cut into chunks that tasks share.  A
chunk whose entry state isn't known gets a *state map*, entry state to (exit
state, tokens), for every state that the ``halo`` characters before it can lead
to from a start at any of them.  Maps compose: first inside blocks of chunks,
side by side, then over a text's blocks (a prefix scan of two levels).  A true
entry state that a map lacks is added to the map by a run over that chunk, and
the scan is repeated until none is missing, so the count is exact whatever the
halo is; it only saves rounds.

Nulls: a null text counts as empty (0 bytes, 0 tokens); other columns may be
null.  Repeated rows are counted each.  An empty table gives no rows.  Very long
texts are cut as said; only their maps, one small row for each chunk, meet in
one group.  Extra columns are kept, the text is not; one with the name of a
computed column gives way to it.  Refused with a ValueError: tokenizers that are
not plain byte-level BPE with the usual splitter, and special tokens that can
overlap.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import count as counter

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, protected, stored

#: Characters of a chunk; those before a chunk from which its entry states come; chunks of a block.
CHUNK, HALO, BLOCK = 65_536, 128, 32
#: States kept by a worker.
MOST_STATES = 120_000
LIMIT = 1024
COMPUTED = ("n_bytes", "n_tokens", "over_limit")

NEVER = 1 << 40
#: Of so few tokens below a suffix those that fit are listed.
FEW = 64
_machines: dict = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = counter(256)
    return {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}


class Merges:
    """The transducer of one piece: states over its bytes, and on each transition the change of its number of tokens."""

    def __init__(self, vocab: dict[str, int], merges: list):
        of_char = byte_alphabet()
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for text, t in vocab.items():
            node = 0
            for b in (of_char[c] for c in text):
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = t
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = (vocab[a], vocab[b])
            self.rank[pair] = r
            self.parts.setdefault(vocab[a + b], (*pair, r))
        self.below: list[list[int]] = [[] for _ in self.token]
        for text, t in vocab.items():
            node = 0
            for c in text:
                self.below[node].append(t)
                node = self.child[node << 8 | of_char[c]]
        self._edges: tuple[dict, dict] = ({}, {})
        self.clear()

    def clear(self) -> None:
        self.start = ((0, -1, 0),)
        self.states: dict[tuple, tuple[tuple, dict]] = {}
        self._left: dict[tuple, tuple | int] = {}

    def edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at the left (0) or right (1) edge of ``t`` while it is built, each with the rank of the merge that ends it."""
        if t not in self._edges[side]:
            found, at, end = [], t, NEVER
            while True:
                found.append((at, end))
                if at not in self.parts:
                    break
                end, at = self.parts[at][2], self.parts[at][side]
            self._edges[side][t] = found[::-1]
        return self._edges[side][t]

    def fit(self, a: int, b: int) -> bool:
        """Whether the bytes of the tokens a and b are tokenized as a, b."""
        if a < 0:
            return True
        left, right, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            r = self.rank.get((x, y), NEVER)
            if r < x_end and r <= y_end:  # of equal pairs the left one is merged first
                return False
            if x_end == y_end == NEVER:
                return True
            i, j = (i + 1, j) if x_end <= y_end else (i, j + 1)

    def left(self, node: int, before: tuple | int) -> tuple | int:
        """What a token that begins with ``node`` must know of what is before it.

        The tokens below ``node`` that fit, where there are few below it
        (none: the suffix is given up); else the last token.  Texts with other
        pasts but the same future come to one state.
        """
        below = self.below[node]
        if isinstance(before, int) and (len(below) > FEW or node == 0):
            return before
        key = (node, before)
        found = self._left.get(key)
        if found is None:
            found = tuple(t for t in below if (t in before if isinstance(before, tuple) else self.fit(before, t)))
            self._left[key] = found
        return found

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        state, moves = self.states.setdefault(state, (state, {}))
        if byte not in moves:
            alive, last, out = [], None, 0
            for node, before, n in state:
                node = self.child.get(node << 8 | byte)
                if node is not None:
                    t = self.token[node]
                    if last is None and t >= 0 and (t in before if isinstance(before, tuple) else self.fit(before, t)):
                        last, out = t, n + 1
                    before = self.left(node, before)
                    if before != ():
                        alive.append((node, before, n))
            new = (*((node, before, n - out) for node, before, n in alive), (0, last, 0))
            moves[byte] = (self.states.setdefault(new, (new, {}))[0], out)
        return moves[byte]

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        total = 0
        for b in text.encode():
            state, n = self.step(state, b)
            total += n
        return state, total


class State(dict):
    """Transitions by character: (state, change of the number of tokens); made when first asked for."""

    __slots__ = ("key", "machine")

    def __missing__(self, ch: str):
        key, out = self.machine.advance(self.key, ch)
        self[ch] = found = (self.machine.state(key), out)
        return found


class Machine:
    """The transducer of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        told = json.loads(tokenizer.to_str())
        model, splitter = told["model"], told["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or told["normalizer"] or splitter.get("type") != "ByteLevel" or not splitter.get("use_regex") or splitter.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.specials = {t["content"] for t in told["added_tokens"]}
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(s[0] in x[1:] or (s != x and x.startswith(s)) for s in self.specials for x in self.specials):
            raise ValueError(f"the special tokens of {path} take white space or overlap")
        self.begun = {s[:k] for s in self.specials for k in range(1, len(s))}
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.kinds: dict[str, str] = {}
        self.merges = Merges(model["vocab"], model["merges"])
        self.clear()

    def clear(self) -> None:
        self.merges.clear()
        self.states: dict[tuple, State] = {}
        self.start = self.state(("", None, None, 0, "", "", 0))

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.key, found.machine = key, self
        return found

    def bounded(self) -> None:
        """Forget the states when there are too many; call it between texts."""
        if len(self.states) + len(self.merges.states) > MOST_STATES:
            self.clear()

    def kind(self, ch: str) -> str:
        """L(etter), N(umber), W(hite) or O(ther), as the tokenizer's own splitter takes the character."""
        if ch not in self.kinds:
            pieces = [len(x[0].encode()) for x in self.split(f"a{ch}1")]
            alone = len(self.split(f"!{ch}!")) == 1
            self.kinds[ch] = "O" if alone else "W" if len(pieces) == 3 or ch == " " else "L" if self.split(f"a{ch}1")[0][1][1] == 2 else "N"
        return self.kinds[ch]

    def tokens(self, piece: str) -> int:
        return self.merges.run(self.merges.start, piece)[1]

    def advance(self, key: tuple, ch: str) -> tuple[tuple, int]:
        """One character: the next key and the change of the count.

        A key is (kind, merges' state, that without the last white character,
        their difference, last character, special begun, tokens since then).
        """
        *base, begun, since = key
        base, out = self._split(base, ch)
        now = begun + ch if begun + ch in self.begun or begun + ch in self.specials else ch if ch in self.begun or ch in self.specials else ""
        since = (since if len(now) > 1 else 0) + out if now else 0
        if now in self.specials:
            return self.start.key, out - since + 1
        return (*base, now, since), out

    def _fresh(self, ch: str) -> tuple[tuple, int]:
        q, n = self.merges.run(self.merges.start, ch)
        kind = self.kind(ch)
        return ((kind, q, self.merges.start, n, ch) if kind == "W" else ("'" if ch == "'" else kind, q, None, 0, "")), n

    def _split(self, base: list, ch: str) -> tuple[tuple, int]:
        kind, q, short, diff, last = base
        start = self.merges.start
        if kind == "":
            return self._fresh(ch)
        if kind == "'":  # an apostrophe that begins a piece
            if ch in "stmd":
                return ("", None, None, 0, ""), self.tokens("'" + ch) - self.tokens("'")
            if ch in "rvl":
                r, n = self.merges.run(start, ch)
                return ("'L", r, None, 0, ch), n
            kind = "O"
        elif kind == "'L":  # and one of the letters that may begin a contraction of two
            if last + ch in ("re", "ve", "ll"):
                return ("", None, None, 0, ""), self.tokens("'" + last + ch) - self.tokens("'") - self.tokens(last)
            kind = "L"
        new = self.kind(ch)
        if kind == "W" and new != "W":  # the last white character is not part of the run before it
            if last == " ":
                r, n = self.merges.run(start, " " + ch)
                return (new, r, None, 0, ""), n - diff
            fresh, n = self._fresh(ch)
            return fresh, n + self.tokens(last) - diff
        if kind != new:
            return self._fresh(ch)
        r, n = self.merges.run(q, ch)
        return ((kind, r, q, n, ch) if kind == "W" else (kind, r, None, 0, "")), n


def machine(path: str) -> Machine:
    if path not in _machines:
        _machines[path] = Machine(path)
    return _machines[path]


def walk(state: State, text: str) -> tuple[State, int]:
    total = 0
    for ch in text:
        state, n = state[ch]
        total += n
    return state, total


def told(state: State) -> str:
    """A state as text that every worker reads alike."""
    return json.dumps(state.key, separators=(",", ":"))


def read(m: Machine, text: str) -> State:
    return m.state(_tuples(json.loads(text)))


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def entries(m: Machine, before: str) -> list[State]:
    """The states that a start at any place of ``before`` leads to at its end."""
    found = {id(m.start): m.start}
    for ch in before:
        moved = [s[ch][0] for s in found.values()]
        found = {id(s): s for s in [*moved, m.start]}
    return list(found.values())


def state_map(states: list[State], text: str, part: int = 64) -> list[tuple[str, str, int]]:
    """(entry, exit, tokens) for each entry state; runs that meet go on as one."""
    runs = {id(s): (s, [(told(s), 0)]) for s in states}
    at = 0
    while at < len(text):
        end = at + part if len(runs) > 1 else len(text)
        moved: dict[int, tuple[State, list]] = {}
        for state, own in runs.values():
            state, n = walk(state, text[at:end])
            moved.setdefault(id(state), (state, []))[1].extend((e, m + n) for e, m in own)
        runs, at = moved, end
    return [(e, told(state), n) for state, own in runs.values() for e, n in own]


def compose(maps: Iterable[tuple[int, dict]], domain: Iterable[str]) -> dict[str, tuple[str, int, int]]:
    """The maps in order as one map over ``domain``: entry to (exit, tokens, -1).

    A state that the map of chunk k lacks stops the path there: (that state,
    tokens before, k).
    """
    out = {}
    maps = list(maps)
    for entry in domain:
        state, n, lacking = entry, 0, -1
        for k, own in maps:
            if state not in own:
                lacking = k
                break
            state, more, lacking = own[state]
            n += more
            if lacking >= 0:
                break
        out[entry] = (state, n, lacking)
    return out


MAP = "row long, k long, entry string, exit string, tokens long, lacking long"


def _composed(maps: DataFrame, block: int, start: str | None) -> DataFrame:
    """Compose the maps of each ``block`` chunks (0: of the whole text, from ``start``)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by_k: dict[int, dict] = {}
        for k, entry, end, n, lacking in rows[["k", "entry", "exit", "tokens", "lacking"]].itertuples(index=False):
            by_k.setdefault(k, {})[entry] = (end, n, lacking if lacking >= 0 else -1)
        ordered = [(k, by_k[k]) for k in sorted(by_k)]
        first, own = ordered[0]
        found = compose(ordered, own if start is None else [start])
        return pd.DataFrame([(rows["row"].iloc[0], first, e, s, n, lack) for e, (s, n, lack) in found.items()], columns=["row", "k", "entry", "exit", "tokens", "lacking"])

    keys = ["row", F.floor(F.col("k") / block).alias("_block")] if block else ["row"]
    return maps.groupBy(*keys).applyInPandas(run, MAP)


def _chunk_maps(chunks: DataFrame, path: str) -> DataFrame:
    """The state map of each chunk: over the states that the halo allows, or over the one that is ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            for r in (x for at in range(0, batch.num_rows, 8) for x in batch.slice(at, 8).to_pylist()):
                m.bounded()
                states = [read(m, r["asked"])] if r["asked"] is not None else [m.start] if r["k"] == 0 else entries(m, r["before"])
                rows = [(r["row"], r["k"], e, s, n, -1) for e, s, n in state_map(states, r["text"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["row", "k", "entry", "exit", "tokens", "lacking"])

    return chunks.select("row", "k", "before", "text", "asked").mapInArrow(run, MAP)


def _long_counts(docs: DataFrame, path: str, chunk: int, halo: int) -> DataFrame:
    """(_doc, n_tokens) of the texts that are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(batch.num_rows):
                text, doc = batch.column(1)[at].as_py(), batch.column(0).slice(at, 1)
                for k, begin in enumerate(range(0, len(text), chunk)):
                    own = [pa.array([row]), pa.array([k]), pa.array([text[max(0, begin - halo) : begin]]), pa.array([text[begin : begin + chunk]])]
                    yield pa.RecordBatch.from_arrays([doc, *own], names=["_doc", "row", "k", "before", "text"])
                row += 1

    kind = docs.schema["_doc"].dataType.simpleString()
    n = partitions(docs.sparkSession)
    # the numbers of rows hold for the written table only
    chunks = stored(docs.select("_doc", "text").mapInArrow(cut, f"_doc {kind}, row long, k long, before string, text string"), "chunks")
    maps = stored(_chunk_maps(chunks.repartition(n, "row", "k").withColumn("asked", F.lit(None).cast("string")), path), "maps")
    start = told(machine(path).start)
    while True:
        whole = stored(_composed(_composed(maps, BLOCK, None), 0, start), "counts")
        asked = whole.filter("lacking >= 0").select("row", F.col("lacking").alias("k"), F.col("exit").alias("asked"))
        if asked.isEmpty():
            break
        added = _chunk_maps(chunks.join(asked, ["row", "k"]), path)
        maps = stored(maps.unionByName(added), "maps")
    return chunks.filter("k = 0").select("row", "_doc").join(whole.select("row", F.col("tokens").alias("n_tokens")), "row").drop("row")


def count(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """The documents without their text, with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""

    def step(d: DataFrame) -> DataFrame:
        others = [c for c in d.columns if c != "text"]
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = d.select(F.struct(*others, F.octet_length(text).cast("long").alias("n_bytes")).alias("_doc"), text.alias("text"))
        kind = rows.schema["_doc"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = machine(path)
            for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
                counts = []
                for text in batch.column(1):
                    m.bounded()
                    counts.append(walk(m.start, text.as_py())[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["_doc", "n_tokens"])

        is_long = F.length("text") > chunk
        short = rows.filter(~is_long).mapInArrow(run, f"_doc {kind}, n_tokens long")
        both = short.unionByName(_long_counts(rows.filter(is_long), path, chunk, halo))
        return both.select("_doc.*", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

    return protected(docs, ("doc_id", "text"), step)
